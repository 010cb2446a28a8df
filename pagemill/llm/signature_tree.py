"""Near-duplicate texts by signature trees (problem 4).

Two texts are linked if the distinct sequences of ``size`` consecutive words in both make up at least
``num/den`` of those in either. The join is exact:

1. Every text is reduced to its set of shingles, a 512-bit bitmap of them (its *signature*) and its size.
2. All texts order their shingles the same way, rare ones first (rarity: counts over all texts in a table of fixed
   length). Two linked texts share one of their first ``n - ceil(t n) + 1`` shingles, so a text is sent, once, to each
   *cell* (hash range of shingles) in which it has such a shingle.
3. In a cell, the texts under each shingle form a signature tree, whatever their number: leaves of ``LEAF`` texts, texts
   with the same leading shingles side by side, each node with the OR of its texts' bitmaps and the range of their sizes. A
   dual traversal of each tree with itself, all trees of the cell together, drops every pair of nodes whose largest
   possible overlap is too small.
4. The shared leading shingles of a pair are added up over the cells; pairs that cannot reach the threshold any more
   are dropped, and the rest are compared exactly, shingle by shingle.

Exact copies are one text throughout, and come back through a membership table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.shared import materialize, spread
from pagemill.llm.shingles import WordHashes, overlap, shingles, word_hashes

#: Entries of the table of shingle counts, a power of two; as a broadcast it takes one byte each, whatever the corpus.
RARITY_SLOTS = 1 << 20
RARITY_SLICES = 64
SIGNATURE_BITS = 512
#: Texts of the corpus for each cell: with these, a cell has some 100 000 to a million rows of about 100 bytes at any size.
CELL_TEXTS = 10_000
LEAF = 2
FANOUT = 4
#: Pairs of nodes looked at together, and pairs of texts a cell holds before it hands them on.
_NODE_PAIRS = 1 << 15
_TEXT_PAIRS = 1 << 21


class SignatureForest:
    """A tree for each run of texts; ``starts`` are the places at which runs begin in the arrays of texts.

    ``levels[k]`` covers the texts of a run in nodes of ``LEAF * FANOUT**k``; a run's root is its one node on some level.
    """

    def __init__(self, signatures: np.ndarray, sizes: np.ndarray, excess: np.ndarray, starts: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.texts = (signatures, sizes, sizes, excess)
        self.starts, self.lengths = starts, np.diff(np.concatenate([starts, [len(sizes)]]))
        #: pairs of nodes tested, and dropped by size and by overlap
        self.tested = self.by_size = self.by_overlap = 0
        self.levels, runs, counts = [], np.arange(len(starts)), -(-self.lengths // LEAF)
        below, first_below, count_below, fanout = self.texts, starts, self.lengths, LEAF
        while len(runs):
            run = np.repeat(runs, counts)
            first = np.zeros(len(starts), np.int64)
            first[runs] = np.cumsum(counts) - counts
            count = np.zeros(len(starts), np.int64)
            count[runs] = counts
            within = np.arange(len(run)) - first[run]
            children = first_below[run] + within * fanout
            bits, low, high, extra = below
            nodes = (bits[children], low[children], high[children], extra[children])
            size = np.minimum(fanout, count_below[run] - within * fanout)
            for k in range(1, fanout):
                more = np.flatnonzero(size > k)
                child = children[more] + k
                nodes[0][more] |= bits[child]
                nodes[1][more] = np.minimum(nodes[1][more], low[child])
                nodes[2][more] = np.maximum(nodes[2][more], high[child])
                nodes[3][more] = np.maximum(nodes[3][more], extra[child])
            self.levels.append((nodes, run, first, count))
            below, first_below, count_below, fanout = nodes, first, count, FANOUT
            going = counts > 1
            runs, counts = runs[going], -(-counts[going] // FANOUT)

    def _possible(self, nodes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes, or of texts, can hold a link by their sizes and the largest overlap their bitmaps allow."""
        bits, low, high, extra = nodes
        kept = np.flatnonzero((a == b) | (self.num * low[b] <= self.den * high[a]) & (self.num * low[a] <= self.den * high[b]))
        self.tested += len(a)
        self.by_size += len(a) - len(kept)
        a, b = a[kept], b[kept]
        most = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(extra[a], extra[b])
        enough = (a == b) | (most * (self.num + self.den) >= self.num * (low[a] + low[b]))
        self.by_overlap += len(a) - int(enough.sum())
        return kept[enough]

    def _children(self, a, b, first, count, within_a, within_b, fanout: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children (x <= y) of pairs of nodes of one run."""
        i, j = (g.ravel() for g in np.meshgrid(np.arange(fanout), np.arange(fanout), indexing="ij"))
        x, y = within_a[:, None] * fanout + i, within_b[:, None] * fanout + j
        keep = (x < count[:, None]) & (y < count[:, None]) & ((a != b)[:, None] | (x <= y))
        base = np.broadcast_to(first[:, None], x.shape)[keep]
        return base + x[keep], base + y[keep]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (a < b) of texts that may be linked."""
        stack = []
        for level, (_, run, first, count) in enumerate(self.levels):
            roots = first[np.unique(run)[count[np.unique(run)] == 1]]
            stack.extend((level, roots[k : k + _NODE_PAIRS], roots[k : k + _NODE_PAIRS]) for k in range(0, len(roots), _NODE_PAIRS))
        while stack:
            level, a, b = stack.pop()
            nodes, run, first, _ = self.levels[level]
            kept = self._possible(nodes, a, b)
            a, b = a[kept], b[kept]
            if not len(a):
                continue
            own = run[a]
            within_a, within_b = a - first[own], b - first[own]
            if level:
                _, _, first_below, count_below = self.levels[level - 1]
                x, y = self._children(a, b, first_below[own], count_below[own], within_a, within_b, FANOUT)
                stack.extend((level - 1, x[k : k + _NODE_PAIRS], y[k : k + _NODE_PAIRS]) for k in range(0, len(x), _NODE_PAIRS))
                continue
            x, y = self._children(a, b, self.starts[own], self.lengths[own], within_a, within_b, LEAF)
            x, y = x[x != y], y[x != y]
            kept = self._possible(self.texts, x, y)
            yield x[kept], y[kept]


def cell_pairs(sizes, signatures, tokens, owners, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts of a cell: pairs that may be linked, with the number of leading shingles they share here (in parts)."""
    n = len(sizes)
    excess = sizes - np.bitwise_count(signatures).sum(1, dtype=np.int64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owners, tokens)
    order = np.lexsort((sizes[owners], least[owners], tokens))
    tokens, owners = tokens[order], owners[order]
    again = np.concatenate([[False], tokens[1:] == tokens[:-1]]) if len(tokens) else np.empty(0, bool)
    shared = again | np.concatenate([again[1:], [False]]) if len(tokens) else again
    tokens, owners = tokens[shared], owners[shared]
    if not len(tokens):
        return
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    forest = SignatureForest(signatures[owners], sizes[owners], excess[owners], starts, num, den)
    held, number = [], 0

    def counted():
        pairs, times = np.unique(np.concatenate(held), return_counts=True)
        return pairs // n, pairs % n, times

    for x, y in forest.pairs():
        a, b = owners[x], owners[y]
        held.append(np.minimum(a, b) * n + np.maximum(a, b))
        number += len(a)
        if number > _TEXT_PAIRS:
            yield counted()
            held, number = [], 0
    if number:
        yield counted()


def _count_slots(size: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHashes(), np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            sets = [shingles(h, size) for t in batch.column(0).to_pylist() if len(h := word_hashes(t, cache)) >= least_words]
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(RARITY_SLOTS - 1)).astype(np.int64), minlength=RARITY_SLOTS)
        slices = [x.tobytes() for x in np.split(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), RARITY_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(RARITY_SLICES), pa.int32()), pa.array(slices, pa.binary())], ["slice", "counts"])

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(x, np.uint32).astype(np.int64)
            totals[k] = totals[k] + x if k in totals else x
    classes = [np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for x in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(classes, pa.binary())], ["slice", "counts"])


def rarity_table(texts: DataFrame, size: int, least_words: int) -> np.ndarray:
    """Class (whole log2 of the count) of each slot of shingle hashes, counted over all texts; RARITY_SLOTS bytes."""
    parts = texts.mapInArrow(_count_slots(size, least_words), "slice int, counts binary")
    done = parts.repartitionById(RARITY_SLICES, F.col("slice")).mapInArrow(_sum_slices, "slice int, counts binary").collect()
    table = np.zeros(RARITY_SLOTS, np.uint8).reshape(RARITY_SLICES, -1)
    for row in done:
        table[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return table.ravel()


def _routes(rarity, size: int, least_words: int, num: int, den: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, classes, seen = WordHashes(), rarity.value, set()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    continue
                hashes = word_hashes(text, cache)
                if len(hashes) < least_words:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                own = shingles(hashes, size)
                n = len(own)
                if not n:
                    continue
                bits = np.zeros(SIGNATURE_BITS, np.uint8)
                bits[(own >> np.uint64(40)).astype(np.int64) % SIGNATURE_BITS] = 1
                signature = np.packbits(bits).tobytes()
                rank = classes[(own & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)]
                first = own[np.lexsort((own, rank))[: n - -(-num * n // den) + 1]]
                cell = ((first >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                first, cell = first[order], cell[order]
                cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                for a, b in zip(cuts, np.r_[cuts[1:], len(cell)]):
                    for column, value in zip(rows, (int(cell[a]), key, n, signature, first[a:b].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["cell", "key", "n", "signature", "first"])

    return run


def _join_cell(num: int, den: int):
    def joined(own: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, at = np.unique(own["key"].to_numpy(), return_index=True)
        own = own.take(pa.array(at))
        sizes = own["n"].to_numpy().astype(np.int64)
        signatures = np.frombuffer(b"".join(own["signature"].to_pylist()), np.uint64).reshape(len(keys), -1)
        first = own["first"].to_pylist()
        tokens = np.frombuffer(b"".join(first), np.uint64)
        owners = np.repeat(np.arange(len(keys)), [len(x) // 8 for x in first])
        for a, b, shared in cell_pairs(sizes, signatures, tokens, owners, num, den):
            for k in range(0, len(a), 65536):
                i, j = a[k : k + 65536], b[k : k + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(keys[j]), pa.array(sizes[i].astype(np.int32)), pa.array(sizes[j].astype(np.int32)), pa.array(shared[k : k + 65536].astype(np.int32))], ["a", "b", "n_a", "n_b", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their cells, and one cell is held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if held and held[0].column(0)[0].as_py() != cells[a]:
                    yield from joined(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = [shingles(word_hashes(t, cache), size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "own"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            both = np.array([overlap(x, y) for x, y in zip(a, b)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
            keep = pa.array(both * (num + den) >= num * total)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both / np.maximum(total - both, 1))], ["a", "b", "similarity"])
            yield out.filter(keep)

    return run


def keyed(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the 64-bit key that exact copies share; null texts are left out."""
    return pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("key", F.xxhash64("text"))


def exact_links(candidates: DataFrame, pages: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) of keys those at or above the threshold, compared shingle by shingle.

    Each text is taken apart once; what is brought to its pairs is its sorted shingles.
    """
    ends = candidates.select(F.col("a").alias("key")).union(candidates.select(F.col("b").alias("key"))).distinct()
    held = keyed(pages, id_col, text_col).select("key", "text").join(ends, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    held = materialize(held.mapInArrow(_sets(size), "key long, own binary"), "near-sets")
    both = candidates.join(held.select(F.col("key").alias("a"), F.col("own").alias("of_a")), "a").join(held.select(F.col("key").alias("b"), F.col("own").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(_verify(num, den), "a long, b long, similarity double")


def similar_texts(pages: DataFrame, id_col: str, text_col: str, size: int = 5, num: int = 4, den: int = 5, least_words: int = 1, cells: int | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of keys of different texts at or above ``num/den``; keys are ``xxhash64(text)``, a < b.

    Null and empty texts, and texts with fewer than ``least_words`` or ``size`` words, have no pair. Repeated rows and
    exact copies count once. Other columns of ``pages`` are ignored whatever their names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    texts = spread(pages.select(text_col))
    rarity = spark.sparkContext.broadcast(rarity_table(texts, size, least_words))
    cells = cells or max(spark.sparkContext.defaultParallelism, pages.count() // CELL_TEXTS)
    source = spread(keyed(pages, id_col, text_col).select("key", "text"))
    routed = source.mapInArrow(_routes(rarity, size, least_words, num, den, cells), "cell int, key long, n int, signature binary, first binary")
    by_cell = routed.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell")
    partial = by_cell.mapInArrow(_join_cell(num, den), "a long, b long, n_a int, n_b int, shared int")
    # What is shared beyond both prefixes is at most the longer of the two rests.
    need = F.lit(num) * (F.col("n_a") + F.col("n_b"))
    tail = F.greatest(*[F.expr(f"({num} * {c} + {den - 1}) div {den} - 1") for c in ("n_a", "n_b")])
    candidates = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).where((F.col("shared") + tail) * (num + den) >= need).select("a", "b")
    candidates = materialize(candidates, "near-candidates")
    return exact_links(candidates, pages, id_col, text_col, size, num, den)


def similar_pairs(pages: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """All pairs of rows (id_a < id_b) with different, similar texts; copies are expanded."""
    links = materialize(similar_texts(pages, id_col, text_col, **how).select("a", "b"), "near-links")
    ends = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).distinct()
    members = materialize(keyed(pages, id_col, text_col).select("id", "key").join(ends, "key", "left_semi").distinct(), "near-members")
    pairs = links.join(members.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class): the smallest node each node is connected with; ``edges`` (a, b), ``nodes`` (node).

    Labels spread along links and through the label's own label, so a chain of length n takes about log2 n rounds. A
    node's neighbours are reduced to their smallest label before any shuffle; every round is written to the shared
    folder, and only a count of changes reaches the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("class")).distinct(), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("class", F.coalesce("near", "class")).alias("next"), "class")
        via = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        step = step.join(via, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("next"), "class")
        step = materialize(step, "labels")
        labels = step.select("node", F.col("next").alias("class"))
        if step.where("next <> class").isEmpty():
            return labels


def near_duplicate_classes(pages: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """One row per row id: (id, class_id, links). ``class_id`` is the smallest id of the class; ``links`` counts the
    different texts the row's text is linked with. Rows with a null text are a class of their own with no link."""
    links = materialize(similar_texts(pages, id_col, text_col, **how).select("a", "b"), "near-links")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("links"))
    classes = components(links, ends.distinct())
    rows = pages.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).isNull().alias("none")).distinct()
    rows = rows.join(classes.withColumnRenamed("node", "key"), "key", "left").join(degree.withColumnRenamed("node", "key"), "key", "left")
    group = F.when(F.col("none"), F.struct(F.lit(1).alias("k"), F.col("id").alias("v"))).otherwise(F.struct(F.lit(0).alias("k"), F.coalesce("class", "key").alias("v")))
    rows = materialize(rows.select("id", group.alias("group"), F.when(F.col("none"), 0).otherwise(F.coalesce("links", F.lit(0))).alias("links")), "near-rows")
    least = rows.groupBy("group").agg(F.min("id").alias("class_id"))
    return rows.join(least, "group").select("id", "class_id", F.col("links").cast("long").alias("links"))
