"""Texts into containers of fixed capacity (problem 8) by conflict-constrained best fit.

Sizes are tokens of a public tokenizer. Texts are dealt to independent packers by hash; a packer takes its texts from
the longest to the shortest and puts each into the container with the least room left that it fits into and that it may
join: a container holds no two texts of one duplicate cluster, and of one source at most as many as the layers of its
source bitmap. Containers are kept by residual; the search goes on to the next residual until a compatible one is found.
Of frequent sources and clusters it is counted how many containers of each residual are closed to them, so that a residual
with no other is passed over at once. Texts without words have no cluster.
Only a text larger than the capacity is split: into full containers and a rest that is packed like any text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.shared import spread

#: Folder of the public tokenizers' files, and the file and pattern used.
TOKENIZERS = os.environ.get("PAGEMILL_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Most texts of one packer, on average.
PACKER_TEXTS = 20_000
#: Kinds of containers worked on in one pass; texts of one source or cluster from which it is frequent.
KINDS_A_PASS = 1_000
FREQUENT = 64


def token_counter(folder: str, file: str):
    """A function text -> number of tokens; read once for each worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text)) if text else 0


def _count(folder: str, file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(folder, file)
        for batch in batches:
            tokens = pa.array([count(t) for t in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), tokens], ["id", "source", "cluster", "tokens"])

    return run


def source_layers(tokens: list[int], sources: list, capacity: int) -> int:
    """Most texts of one source in a container: four times the largest source's share of the texts of a full container."""
    counts: dict = {}
    for s in sources:
        if s is not None:
            counts[s] = counts.get(s, 0) + 1
    mean = max(1.0, sum(min(t, capacity) for t in tokens) / max(1, len(tokens)))
    share = max(counts.values(), default=0) / max(1, len(tokens))
    return max(1, int(-(-4 * share * capacity // mean)))


def pack(ids: list[int], tokens: list[int], sources: list, clusters: list, capacity: int, layers: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(place of the text, piece, first token, tokens, container) of every piece; containers count from 0.

    Texts of no token take no room, and still obey the conflicts. Ties go to the smaller id.
    """
    layers = layers or source_layers(tokens, sources, capacity)
    source_counts, cluster_counts = Counter(s for s in sources if s is not None), Counter(c for c in clusters if c is not None)
    source_bits = {s: 1 << k for k, s in enumerate(source_counts)}
    # only clusters of two or more texts can conflict and need a bit
    cluster_bits = {c: 1 << k for k, c in enumerate(c for c, n in cluster_counts.items() if n > 1)}
    closed: dict = {("s", s): Counter() for s, n in source_counts.items() if n > FREQUENT} | {("c", c): Counter() for c, n in cluster_counts.items() if n > FREQUENT}
    held_sources: list[list[int]] = []
    held_clusters: list[int] = []
    closed_to: list[list] = []  # the frequent sources and clusters a container is closed to
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r is set if a container has residual r
    out = []

    def add(container: int, residual: int, k: int) -> None:
        nonlocal filled
        bit = source_bits.get(sources[k], 0)
        for layer, mask in enumerate(held_sources[container]):
            if not mask & bit:
                held_sources[container][layer] = mask | bit
                if bit and layer == layers - 1 and ("s", sources[k]) in closed:
                    closed_to[container].append(("s", sources[k]))
                break
        held_clusters[container] |= cluster_bits.get(clusters[k], 0)
        if ("c", clusters[k]) in closed:
            closed_to[container].append(("c", clusters[k]))
        for key in closed_to[container]:
            closed[key][residual] += 1
        by_residual[residual].append(container)
        filled |= 1 << residual

    def take(residual: int, at: int) -> int:
        nonlocal filled
        bins = by_residual[residual]
        container, bins[at] = bins[at], bins[-1]
        bins.pop()
        if not bins:
            filled &= ~(1 << residual)
        for key in closed_to[container]:
            closed[key][residual] -= 1
        return container

    def open_container() -> int:
        held_sources.append([0] * layers)
        held_clusters.append(0)
        closed_to.append([])
        return len(held_clusters) - 1

    rests = []
    for k, n in enumerate(tokens):
        full = (n - 1) // capacity if n > capacity else 0
        for piece in range(full):
            out.append((k, piece, piece * capacity, capacity, open_container()))
        rests.append((-(n - full * capacity), ids[k], k, full))
    for size, _, k, piece in sorted(rests):
        size = -size
        source_bit, cluster_bit = source_bits.get(sources[k], 0), cluster_bits.get(clusters[k], 0)
        counts = [closed[key] for key in (("s", sources[k]), ("c", clusters[k])) if key in closed]
        chosen, ahead = -1, filled >> size << size
        while ahead and chosen < 0:
            residual = (ahead & -ahead).bit_length() - 1
            bins = by_residual[residual]
            if not any(c[residual] == len(bins) for c in counts):
                for at in range(len(bins) - 1, -1, -1):
                    b = bins[at]
                    if not (held_clusters[b] & cluster_bit or held_sources[b][-1] & source_bit):
                        chosen = take(residual, at)
                        break
            ahead &= ahead - 1
        if chosen < 0:
            chosen, residual = open_container(), capacity
        add(chosen, residual - size, k)
        out.append((k, piece, piece * capacity, size, chosen))
    return out


_SCHEMA = "container_kind string, packer int, container long, doc_id long, piece int, first_token int, tokens int"


def _pack_group(capacities: dict[str, int]):
    def run(group: pa.Table) -> pa.Table:
        columns = {c: group[c].to_pylist() for c in ("id", "tokens", "source", "cluster", "packer", "kind")}
        kind, packer = columns["kind"][0], columns["packer"][0]
        rows = pack(columns["id"], columns["tokens"], columns["source"], columns["cluster"], capacities[kind])
        values = [(kind, packer, container, columns["id"][k], piece, first, n) for k, piece, first, n, container in rows]
        names = ("container_kind", "packer", "container", "doc_id", "piece", "first_token", "tokens")
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.table({name: pa.array([v[k] for v in values], t) for k, (name, t) in enumerate(zip(names, types))})

    return run


def fill_containers(documents: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str = TOKENIZERS, file: str = RANKS, packer_texts: int = PACKER_TEXTS) -> DataFrame:
    """One row per container kind and piece of a text: (container_kind, packer, container, doc_id, piece, first_token, tokens).

    (container_kind, packer, container) names a container. Null and empty texts have 0 tokens and a container; null
    sources and texts without words never conflict; a repeated row is one text; other columns are ignored; kinds with a null or non-positive
    capacity are left out; empty tables give no rows. Texts are duplicates if they have the same words.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.lower(F.trim(F.col(source_col))), r"^www\.", "").alias("source"), F.when(words != "", F.xxhash64(words)).alias("cluster"), F.col(text_col).alias("text"))
    sized = spread(rows).mapInArrow(_count(folder, file), "id long, source string, cluster long, tokens int")
    packers = max(1, documents.count() // packer_texts)
    dealt = sized.dropDuplicates(["id"]).withColumn("packer", F.pmod(F.xxhash64("id"), F.lit(packers)).cast("int"))
    capacities = containers.where("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.max("capacity_tokens").cast("int"))
    result, kinds = None, {}

    def filled(kinds: dict[str, int]) -> DataFrame:
        every = dealt.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")))
        packed = every.groupBy("kind", "packer").applyInArrow(_pack_group(kinds), _SCHEMA)
        return packed if result is None else result.union(packed)

    for kind, capacity in capacities.toLocalIterator():
        kinds[kind] = capacity
        if len(kinds) == KINDS_A_PASS:
            result, kinds = filled(kinds), {}
    return filled(kinds) if kinds or result is None else result


def fill_of(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, containers, texts, tokens, fill): how full the containers of each kind are."""
    by_container = filled.groupBy("container_kind", "packer", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("texts"))
    by_kind = by_container.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    capacity = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    return by_kind.join(capacity, "container_kind").select("container_kind", "containers", "texts", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
