"""New batches against all history by graph index shards (problem 6).

Each different text is a vector of signs of its shingles (random projection, so the cosine of two vectors estimates how
alike their shingle sets are). A text is routed to one cell for each of ``ROUTES`` min-hashes of its shingles: two texts
of similarity s meet in a given route with probability s, whatever the size of the corpus, and the number of cells
is chosen for the size history is to reach, so a cell does not grow with it.

``History`` is the index of all batches accepted so far, kept in a folder all executors share:

* ``shards``: for each batch and cell a navigable small-world graph (near neighbours, links back, and long links at
  random) with its vectors and keys, as one row. The table is bucketed by cell, so a batch is brought to the shards and
  history is not moved. ``compact`` merges the shards of a cell.
* ``sets``: the shingles of each text, for exact comparison.
* ``keys``: hashes of accepted texts and urls, bucketed by hash.

A batch is staged once (``stage``: vectors, routes and shingles of its own texts), checked (``seen``) and then accepted
(``accept``); no text of an earlier batch is read again.

The beam of every shard is widened until it finds what an exhaustive search of a sample of ``TUNING_QUERIES`` queries
finds; a shard for which the widest beam does not is always searched exhaustively. A beam full of texts that are near can
hide others behind it, so the shard is then searched exhaustively for that query. The nearest ``NEAREST`` texts of each
shard are compared exactly, shingle by shingle; for a query that none of these settles, and that had more, all the
others are.

A cell that gets more than ``SPLIT`` texts of one batch (a family of near copies can hold a third of all rows) is split
by stored text. A query goes to the part of its own hash first, and to all other parts if it is not settled there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shingles import WordHashes, mix, overlap, shingles, word_hashes
from pagemill.llm.stored import StoredTable, bucket_count, note, noted, together
from pagemill.shared import discard, materialize, scratch, shared_folder, spread

ROUTES = 6
CELL = 2048
SPLIT = 4 * CELL
DIMENSIONS = 64
NEIGHBOURS = 10
LONG_LINKS = 4
PIVOTS = 128
#: Nodes a search opens at a time.
STEP = 4
#: Queries searched at a time, few enough for what they touch to stay in cache.
QUERY_BLOCK = 512
BEAMS = (8, 16, 32, 64, 128)
TUNING_QUERIES = 64
TUNING_RECALL = 0.97
#: Shards of a cell from which a compaction merges them.
MOST_SHARDS = 5
#: Cosine from which a text found is compared exactly. Texts of similarity 0.6 have 0.75 on average, deviation 0.06.
LEAST_COSINE = 0.5
#: Texts of each shard that are compared first; the others only where these settle nothing.
NEAREST = 64
#: Most rows of keys (8 bytes each) that are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bits kept of a shingle's hash in the stored sets: two sets of 250 shingles have a false match with probability 6e-8.
_SET_BYTES = 5
_FIRST_BATCH = -(2**31) + 1


def embed(own: np.ndarray) -> np.ndarray:
    """Sum of the sign vectors of shingles, scaled to int8."""
    signs = np.unpackbits(mix(own).view(np.uint8).reshape(len(own), 8), axis=1)
    # sums of up to 255 bits fit the bytes they come in
    total = 2.0 * np.add.reduceat(signs, np.arange(0, len(own), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64) - len(own)
    return np.round(total * (127.0 / max(1.0, np.abs(total).max()))).astype(np.int8)


def unit(vectors: np.ndarray) -> np.ndarray:
    floats = vectors.astype(np.float32)
    return floats / np.maximum(np.linalg.norm(floats, axis=1, keepdims=True), 1e-9)


def packed_set(own: np.ndarray) -> bytes:
    """Distinct high bits of sorted shingle hashes, in order."""
    high = own >> np.uint64(64 - 8 * _SET_BYTES)
    kept = own[np.r_[True, high[1:] != high[:-1]]] if len(own) else own
    return kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _SET_BYTES, 8), np.uint8)
    wide[:, 8 - _SET_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, _SET_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


class Shard:
    """A navigable small-world graph over unit vectors; ``stored`` are the vectors as they are kept (int8)."""

    def __init__(self, stored: np.ndarray, ids: np.ndarray, links: np.ndarray, beam: int):
        self.stored, self.vectors, self.ids, self.links, self.beam = stored, unit(stored), ids, links, beam
        n = len(ids)
        self.pivots = np.arange(n, dtype=np.int64) if n <= PIVOTS else np.linspace(0, n - 1, PIVOTS).astype(np.int64)

    @classmethod
    def build(cls, stored: np.ndarray, ids: np.ndarray) -> Shard:
        shard = cls(stored[:0], ids[:0], np.empty((0, 2 * NEIGHBOURS + LONG_LINKS), np.int64), BEAMS[0])
        return shard.extended(stored, ids)

    def extended(self, stored: np.ndarray, ids: np.ndarray) -> Shard:
        """The graph with more nodes, put in by blocks: each links to its nearest among those before it and in its block."""
        old, n = len(self.ids), len(self.ids) + len(ids)
        every, every_ids = np.concatenate([self.stored, stored]), np.concatenate([self.ids, ids])
        vectors = unit(every)
        links = np.empty((n, 2 * NEIGHBOURS + LONG_LINKS), np.int64)
        links[:old] = self.links
        links[old:] = np.arange(old, n)[:, None]
        for a in range(old, n, QUERY_BLOCK):
            b = min(a + QUERY_BLOCK, n)
            k = min(NEIGHBOURS, b - 1)
            if k <= 0:
                continue
            scores = vectors[a:b] @ vectors[:b].T
            scores[np.arange(b - a), np.arange(a, b)] = -9
            near = np.argpartition(scores, b - k, axis=1)[:, b - k :]
            links[a:b, :k] = near
            # links back, each in one of the neighbour's places for these, so that texts nobody is near to can be reached
            source, target = np.repeat(np.arange(a, b), k), near.ravel()
            links[target, NEIGHBOURS + source % NEIGHBOURS] = source
        rng = np.random.default_rng(n)
        links[old:, 2 * NEIGHBOURS :] = rng.integers(0, n, (n - old, LONG_LINKS))
        shard = Shard(every, every_ids, links, self.beam)
        if n > PIVOTS:
            shard.tune(disturbed(vectors[:: max(1, n // TUNING_QUERIES)], n))
        return shard

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the best ``beam`` nodes a search from the nearest pivots meets."""
        q, n = len(queries), len(self.ids)
        beam = min(beam, n)
        start = queries @ self.vectors[self.pivots].T
        if len(self.pivots) == n:  # every node is a pivot
            top = np.argpartition(start, n - beam, axis=1)[:, n - beam :] if beam < n else np.tile(np.arange(n), (q, 1))
            return top, np.take_along_axis(start, top, 1)
        first = min(beam, STEP)
        best = np.argpartition(start, len(self.pivots) - first, axis=1)[:, -first:]
        ids = np.full((q, beam), -1, np.int64)
        cosines = np.full((q, beam), -2, np.float32)
        ids[:, :first] = self.pivots[best]
        cosines[:, :first] = np.take_along_axis(start, best, 1)
        seen = np.zeros((q, n), bool)
        seen[np.arange(q)[:, None], self.pivots[best]] = True
        done = np.zeros((q, beam), bool)
        scratch = np.empty((q, n), np.int16)
        active, step = np.arange(q), min(STEP, beam)
        while len(active):
            open_cosines = np.where(done[active] | (ids[active] < 0), -3, cosines[active])
            pick = np.argpartition(open_cosines, -step, axis=1)[:, -step:]
            value = np.take_along_axis(open_cosines, pick, 1)
            moving = value.max(1) > -3
            active, pick, value = active[moving], pick[moving], value[moving]
            if not len(active):
                break
            done[active[:, None], pick] = True
            nodes = np.where(value > -3, ids[active[:, None], pick], ids[active, pick[np.arange(len(active)), value.argmax(1)]][:, None])
            fresh = self.links[nodes].reshape(len(active), -1)
            # a node that was met before, or twice in this step, does not count
            place = np.arange(fresh.shape[1], dtype=np.int16)
            scratch[active[:, None], fresh] = place
            new = ~seen[active[:, None], fresh] & (scratch[active[:, None], fresh] == place)
            seen[active[:, None], fresh] = True
            row, column = np.nonzero(new)
            score = np.full(fresh.shape, -2, np.float32)
            score[row, column] = np.einsum("ij,ij->i", self.vectors[fresh[row, column]], queries[active[row]])
            all_ids = np.concatenate([ids[active], fresh], 1)
            all_scores = np.concatenate([cosines[active], score], 1)
            all_done = np.concatenate([done[active], np.zeros(fresh.shape, bool)], 1)
            top = np.argpartition(all_scores, all_scores.shape[1] - beam, axis=1)[:, -beam:]
            cosines[active] = np.take_along_axis(all_scores, top, 1)
            ids[active] = np.where(cosines[active] > -2, np.take_along_axis(all_ids, top, 1), -1)
            done[active] = np.take_along_axis(all_done, top, 1)
        return ids, cosines

    def tune(self, queries: np.ndarray) -> None:
        """From the beam it has, widen the beam until a sample's nearest texts above LEAST_COSINE are found as by an exhaustive search; if the
        widest does not find them, the shard is searched exhaustively (beam 0).

        The sample is stored texts, disturbed as linked texts are, and so has near texts in every shard.
        """
        truth = (queries @ self.vectors.T).max(1)
        wanted = truth >= LEAST_COSINE
        if not wanted.any():
            return
        for beam in BEAMS:
            if beam < self.beam:
                continue
            self.beam = beam
            if beam >= len(self.ids):
                break
            _, cosines = self.search(queries[wanted], beam)
            if (cosines.max(1) >= truth[wanted] - 1e-4).mean() >= TUNING_RECALL:
                return
        self.beam = 0

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, cosine) of what the tuned beam finds above LEAST_COSINE, and of all there is for queries
        whose beam is full of it."""
        if self.beam:
            ids, cosines = self.search(queries, self.beam)
            above = cosines >= LEAST_COSINE
            full = above.all(1) & (cosines.shape[1] < len(self.ids))
            row, column = np.nonzero(above & ~full[:, None])
            found = [(row, ids[row, column], cosines[row, column])]
        else:
            full, found = np.ones(len(queries), bool), []
        again = np.flatnonzero(full)
        if len(again):
            row, position, cosine = self.all_near(queries[again])
            found.append((again[row], position, cosine))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def all_near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = queries @ self.vectors.T
        row, position = np.nonzero(scores >= LEAST_COSINE)
        return row, position, scores[row, position]

    def row(self) -> dict:
        small = np.uint16 if len(self.ids) < 1 << 16 else np.uint32
        return {"n": len(self.ids), "ids": self.ids.tobytes(), "vectors": self.stored.tobytes(), "links": self.links.astype(small).tobytes(), "beam": self.beam}

    @classmethod
    def of_row(cls, row: dict) -> Shard:
        n = row["n"]
        links = np.frombuffer(row["links"], np.uint16 if n < 1 << 16 else np.uint32).reshape(n, -1).astype(np.int64)
        return cls(np.frombuffer(row["vectors"], np.int8).reshape(n, -1), np.frombuffer(row["ids"], np.int64), links, row["beam"])


def disturbed(vectors: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    noisy = vectors + rng.normal(0, 0.8 / np.sqrt(vectors.shape[1]), vectors.shape).astype(np.float32)
    return noisy / np.linalg.norm(noisy, axis=1, keepdims=True)


def nearest_first(row: np.ndarray, position: np.ndarray, cosine: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the finds are among the ``most`` nearest of their query, and the queries that have more."""
    order = np.lexsort((position, -cosine, row))
    sorted_row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(sorted_row, sorted_row)
    return order[rank < most], np.unique(sorted_row[rank >= most])


_STAGED = "batch int, key long, cells binary, vector binary, shingles binary"


def _stage(size: int, least_words: int, cells: int):
    seeds = mix(np.arange(1, ROUTES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for number, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                hashes = word_hashes(text, cache)
                if len(hashes) < least_words:
                    continue
                own = shingles(hashes, size)
                if not len(own):
                    continue
                routes = (mix(own[None, :] ^ seeds[:, None]).min(1) % np.uint64(cells)).astype(np.int32)
                for column, value in zip(rows, (number, key, routes.tobytes(), embed(own).tobytes(), packed_set(own))):
                    column.append(value)
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], ["batch", "key", "cells", "vector", "shingles"])

    return run


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each route of (key, cells, vector)."""
    for batch in batches:
        n = batch.num_rows
        cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
        at = pa.array(np.repeat(np.arange(n), ROUTES))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(ROUTES, dtype=np.int32), n)), pa.array(cells), batch.column(0).take(at), batch.column(2).take(at)], ["route", "cell", "key", "vector"])


_FOUND = "a long, b long, more boolean"


def _search(most: int | None):
    """Texts of the stored shards near each asking text: the ``most`` nearest of each shard, or all of them. A row with
    ``more`` names a text for which a shard had more than these."""

    def run(asks: pa.Table, shards: pa.Table) -> pa.Table:
        early, late, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if asks.num_rows and shards.num_rows:
            keys, first = np.unique(asks["key"].to_numpy(), return_index=True)
            vectors = unit(np.frombuffer(b"".join(asks["vector"].take(pa.array(first)).to_pylist()), np.int8).reshape(len(keys), -1))
            for stored in shards.to_pylist():
                shard = Shard.of_row(stored)
                for a in range(0, len(keys), QUERY_BLOCK):
                    row, position, cosine = (shard.near if most else shard.all_near)(vectors[a : a + QUERY_BLOCK])
                    if most:
                        kept, rest = nearest_first(row, position, cosine, most)
                        row, position = row[kept], position[kept]
                        more.append(keys[a + rest])
                    early.append(shard.ids[position])
                    late.append(keys[a + row])
        pairs = np.unique(np.stack([np.concatenate(early), np.concatenate(late)], 1), axis=0)
        rest = np.unique(np.concatenate(more))
        a, b = np.concatenate([pairs[:, 0], np.zeros(len(rest), np.int64)]), np.concatenate([pairs[:, 1], rest])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "more": pa.array(np.arange(len(a)) >= len(pairs))})

    return run


_SHARDS = "route int, cell int, part int, n int, ids binary, vectors binary, links binary, beam int"


def _rows_of(route: int, cell: int, part: int, shards: list[Shard]) -> pa.Table:
    rows = [{"route": route, "cell": cell, "part": part} | s.row() for s in shards]
    kinds = [("route", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("links", pa.binary()), ("beam", pa.int32())]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


def _build(group: pa.Table) -> pa.Table:
    keys, first = np.unique(group["key"].to_numpy(), return_index=True)
    vectors = np.frombuffer(b"".join(group["vector"].take(pa.array(first)).to_pylist()), np.int8).reshape(len(keys), -1)
    shuffled = np.random.default_rng(len(keys)).permutation(len(keys))
    return _rows_of(*(group[c][0].as_py() for c in ("route", "cell", "part")), [Shard.build(vectors[shuffled], keys[shuffled])])


def _merge(group: pa.Table) -> pa.Table:
    """The shards of one cell and part, each smaller one put into the largest as long as that has room."""
    rows = sorted(group.to_pylist(), key=lambda r: (-r["n"], r["ids"]))
    merged = []
    while rows:
        whole = [rows.pop(0)]
        size = whole[0]["n"]
        while rows and size + rows[0]["n"] <= SPLIT:
            size += rows[0]["n"]
            whole.append(rows.pop(0))
        first, others = Shard.of_row(whole[0]), [Shard.of_row(r) for r in whole[1:]]
        merged.append(first.extended(np.concatenate([s.stored for s in others]), np.concatenate([s.ids for s in others])) if others else first)
    return _rows_of(*(group[c][0].as_py() for c in ("route", "cell", "part")), merged)


def _compare(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([unpacked_set(x) for x in batch.column(k).to_pylist()] for k in (1, 2))
            both = np.array([overlap(x, y) for x, y in zip(a, b)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["b"]).filter(pa.array(both * (num + den) >= num * total))

    return run


class History:
    """The index of the batches accepted so far, in ``folder``; opened again if there is one.

    ``cells``: number of cells of each route, for the number of texts history is to reach divided by ``CELL``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, cells: int = 1, size: int = 5, num: int = 4, den: int = 5, least_words: int = 1):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
        fresh = {"cells": cells, "size": size, "num": num, "den": den, "least_words": least_words, "buckets": bucket_count(spark), "version": 0, "batches": [], "shards": 0, "split": False}
        self.about = noted(spark, self.folder, fresh)
        self.keys = StoredTable(spark, f"{self.folder}/keys", "h1 long, h2 long", "h1, h2", self.about["buckets"])
        self.shards = self._shard_table()

    def _shard_table(self) -> StoredTable:
        return StoredTable(self.spark, f"{self.folder}/shards-{self.about['version']}", _SHARDS, "route, cell, part", self.about["buckets"])

    def _sets(self) -> DataFrame | None:
        paths = [p for _, p in self.about["batches"] if p]
        return self.spark.read.schema("key long, shingles binary").parquet(*paths) if paths else None

    def drop(self) -> None:
        """Remove the index, its folder included."""
        self.keys.drop()
        self.shards.drop()
        discard(self.spark, self.folder, *(p for _, p in self.about["batches"] if p))

    def stage(self, texts: DataFrame) -> DataFrame:
        """Vector, cells and shingles of each text of (batch, key, text) that has enough words."""
        how = self.about
        return texts.mapInArrow(_stage(how["size"], how["least_words"], how["cells"]), _STAGED)

    def _parts(self) -> DataFrame:
        """(route, cell, parts) of the cells that are split, of which there are few."""
        return self.shards.read().groupBy("route", "cell").agg((F.max("part") + 1).alias("parts")).where("parts > 1")

    def like(self, staged: DataFrame) -> DataFrame:
        """(key) of the staged texts that are like a text of an accepted batch."""
        held = self._sets()
        if held is None:
            return self.spark.createDataFrame([], "key long")
        routed = staged.select("key", "cells", "vector").mapInArrow(_routed, "route int, cell int, key long, vector binary")
        parts = self._parts() if self.about["split"] else None
        if parts is None:
            asks = routed.withColumn("parts", F.lit(1))
        else:
            asks = routed.join(parts, ["route", "cell"], "left").fillna(1, ["parts"])
        own_part = F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int")
        found = self._found(asks.withColumn("part", own_part), NEAREST)
        linked = materialize(self._linked(found.where("not more"), staged), "graph-links")
        rest = found.where("more").select(F.col("b").alias("key")).distinct()
        if parts is not None:
            rest = rest.union(asks.where("parts > 1").select("key")).distinct()
        rest = materialize(rest.join(linked, "key", "left_anti"), "graph-rest")
        if not rest.isEmpty():
            again = asks.join(rest, "key", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            others = self._found(again, None).where("not more")
            linked = linked.union(self._linked(others, staged))
        return linked.distinct()

    def _found(self, asks: DataFrame, most: int | None) -> DataFrame:
        by = ["route", "cell", "part"]
        asks = asks.select(*by, "key", "vector")
        shards = self.shards.read()
        if most is None:  # few ask again, and only the shards of their cells are read
            asks = materialize(asks, "graph-asks")
            if asks.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
                shards = shards.join(F.broadcast(asks.select(*by).distinct()), by, "left_semi").select(*shards.columns)
        near = asks.groupBy(*by).cogroup(shards.groupBy(*by)).applyInArrow(_search(most), _FOUND)
        return materialize(near.distinct(), "graph-found")

    def _linked(self, candidates: DataFrame, staged: DataFrame) -> DataFrame:
        """(key) of the texts b of candidate pairs that stand the exact comparison with their a."""
        pairs = candidates.select("a", "b")
        ends, held = pairs.select(F.col("a").alias("key")).distinct(), self._sets()
        few = pairs.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        if few:
            held = held.join(F.broadcast(ends), "key", "left_semi")
        early = pairs.join(held.groupBy("key").agg(F.first("shingles").alias("of_a")).withColumnRenamed("key", "a"), "a")
        own = staged.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
        own = own.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi") if few else own
        both = early.join(own.dropDuplicates(["b"]), "b")
        return both.select("b", "of_a", "of_b").mapInArrow(_compare(self.about["num"], self.about["den"]), "b long").select(F.col("b").alias("key")).distinct()

    def known(self, rows: DataFrame, h1: str, h2: str) -> DataFrame:
        """The rows whose pair of hashes an accepted batch has."""
        keys = self.keys.read().select(F.col("h1").alias(h1), F.col("h2").alias(h2))
        return rows.join(keys, [h1, h2], "left_semi")

    def accept(self, batch: int, staged: DataFrame, staged_path: str | None, hashes: DataFrame) -> None:
        """Add a batch: a shard of its own in each cell it has texts in, its shingles, which
        stay where it was staged (None if it has no text long enough), and its (h1, h2) of texts and urls."""
        routed = staged.select("key", "cells", "vector").mapInArrow(_routed, "route int, cell int, key long, vector binary")
        sizes = {(r[0], r[1]): r[2] for r in routed.groupBy("route", "cell").count().where(F.col("count") > SPLIT).collect()}  # at most ROUTES * rows / SPLIT
        if sizes:
            self.about["split"] = True
            rows = [(route, cell, -(-n // SPLIT)) for (route, cell), n in sizes.items()]
            routed = routed.join(self.spark.createDataFrame(rows, "route int, cell int, parts int"), ["route", "cell"], "left")
            routed = routed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("key", F.lit(11)), F.col("parts")), F.lit(0)).cast("int"))
        else:
            routed = routed.withColumn("part", F.lit(0))
        shards = routed.select("route", "cell", "part", "key", "vector").groupBy("route", "cell", "part").applyInArrow(_build, _SHARDS)
        together(self.spark, lambda: self.shards.append(shards), lambda: self.keys.append(hashes.select("h1", "h2").distinct()))
        self.about["batches"].append((batch, staged_path))
        self.about["shards"] += 1
        note(self.spark, self.folder, self.about)

    def compact(self) -> None:
        """Merge the shards of every cell; the tables of before are removed."""
        before = self.shards
        merged = before.read().groupBy("route", "cell", "part").applyInArrow(_merge, _SHARDS)
        self.about["version"] += 1
        self.shards = self._shard_table()
        self.shards.append(merged)
        self.about["shards"] = 1
        note(self.spark, self.folder, self.about)
        before.drop()


def seen_before(pages: DataFrame, id_col: str, text_col: str, batch_col: str, url: Column | None = None, size: int = 5, num: int = 4, den: int = 5, least_words: int = 1, cells: int | None = None) -> DataFrame:
    """(id) of the rows whose text is like, or the same as, a text of an earlier batch, or whose url an earlier batch has.

    Batches are checked and accepted one after the other. Texts that are null or have fewer than ``least_words`` words are
    never found by text, '' and null urls never by url. A null batch counts as the first. Repeated rows and copies within a
    batch are no reason; other columns are ignored; an empty table gives none.
    """
    spark = pages.sparkSession
    batch = F.coalesce(F.col(batch_col).cast("int"), F.lit(_FIRST_BATCH))
    address = F.lit(None).cast("string") if url is None else F.when(url != "", url)
    rows = pages.select(F.col(id_col).alias("id"), batch.alias("batch"), F.col(text_col).alias("text"), address.alias("url"))
    history = History(spark, None, cells or max(1, pages.count() // CELL), size, num, den, least_words)
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    # each text is looked at once, whatever its batch; the batches then come in one by one
    staging = history.stage(spread(rows.where("text is not null").select("batch", F.xxhash64("text").alias("key"), "text")))
    hashes = rows.select("id", "batch", F.xxhash64("text").alias("t1"), F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit("text"))).alias("t2"), F.xxhash64("url").alias("u1"), F.when(F.col("url").isNotNull(), F.xxhash64("url", F.lit("url"))).alias("u2"))
    together(spark, lambda: staging.write.partitionBy("batch").parquet(f"{folder}/staged"), lambda: hashes.write.partitionBy("batch").parquet(f"{folder}/hashes"))
    found = []
    fields = ", ".join(f for f in _STAGED.split(", ") if not f.startswith("batch"))
    numbers = [r[0] for r in spark.read.schema(hashes.schema).parquet(f"{folder}/hashes").select("batch").distinct().orderBy("batch").collect()]
    staged_numbers = {r[0] for r in spark.read.schema(_STAGED).parquet(f"{folder}/staged").select("batch").distinct().collect()} if numbers else set()
    for number in numbers:
        own = spark.read.schema("id " + dict(hashes.dtypes)["id"] + ", t1 long, t2 long, u1 long, u2 long").parquet(f"{folder}/hashes/batch={number}")
        path = f"{folder}/staged/batch={number}" if number in staged_numbers else None
        staged = spark.read.schema(fields).parquet(path) if path else spark.createDataFrame([], fields)
        texts = own.join(staged.select(F.col("key").alias("t1")).distinct(), "t1", "left_semi")
        if history.about["batches"]:
            with scratch(spark):
                like = own.join(history.like(staged).withColumnRenamed("key", "t1"), "t1", "left_semi").where("t2 is not null").select("id")
                again = history.known(texts, "t1", "t2").select("id")
                urls = history.known(own.where("u2 is not null"), "u1", "u2").select("id")
                found.append(materialize(like.union(again).union(urls).distinct(), "seen", keep=True))
        accepted = texts.select(F.col("t1").alias("h1"), F.col("t2").alias("h2")).union(own.where("u2 is not null").select("u1", "u2"))
        if number != numbers[-1]:
            history.accept(number, staged, path, accepted)
            if history.about["shards"] >= MOST_SHARDS:
                history.compact()
    history.drop()
    discard(spark, folder)
    out = spark.createDataFrame([], f"id {dict(hashes.dtypes)['id']}") if not found else found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()
