"""Signature trees, graph shards, site lines and leaks against brute force, and their edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import graph_index, leaks, signature_tree, site_lines
from pagemill.llm.shingles import WordHashes, overlap, shingles, word_hashes

WORDS = re.compile(r"[^\W_]+")


def shingle_set(text, size):
    w = WORDS.findall((text or "").lower())
    return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset()


def corpus(seed=1, families=25, words=80):
    """Texts with copies, edited copies, reordered copies, and a family that is a third of all rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(1 + rng.randint(0, 3)):
            own = list(base)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                cut = rng.randrange(len(own))
                own = own[cut:] + own[:cut]
            texts.append(" ".join(own))
    hot = [rng.choice(vocabulary) for _ in range(words)]
    for k in range(len(texts) // 2):
        own = list(hot)
        own[k % words] = f"x{k % 12}"
        texts.append(" ".join(own))
    texts += texts[:5] + [texts[0].upper(), "", "   ", "few words", None, None]
    return [(k, t, k % 4) for k, t in enumerate(texts)]


def brute_pairs(rows, size, num, den, least):
    sets = {i: shingle_set(t, size) for i, t, *_ in rows if t and len(WORDS.findall(t)) >= least}
    text = {i: t for i, t, *_ in rows}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and text[a] != text[b] and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
            out.add((a, b))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rows = corpus()
    # columns that clash with the operators' own names
    return rows, spark.createDataFrame([(i, t, b, "k", 1) for i, t, b in rows], "page long, body string, part int, key string, id int")


@pytest.mark.parametrize("size,num,den,least", [(3, 3, 5, 60), (5, 4, 5, 1), (2, 9, 10, 1)])
def test_pairs_are_those_of_brute_force(pages, size, num, den, least):
    rows, df = pages
    got = signature_tree.similar_pairs(df, "page", "body", size=size, num=num, den=den, least_words=least)
    assert {tuple(r) for r in got.collect()} == brute_pairs(rows, size, num, den, least)


def test_classes_have_a_row_for_each_id(pages):
    rows, df = pages
    got = {r["id"]: r for r in signature_tree.near_duplicate_classes(df, "page", "body", size=3, num=3, den=5).collect()}
    assert set(got) == {i for i, *_ in rows}
    pairs = brute_pairs(rows, 3, 3, 5, 1)
    parent = {i: i for i in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same_text = [(a[0], b[0]) for a, b in itertools.combinations([r for r in rows if r[1] is not None], 2) if a[1] == b[1]]
    for a, b in [*pairs, *same_text]:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r["class_id"] for i, r in got.items()} == {i: root(i) for i in got}
    text = {i: t for i, t, _ in rows}
    links = {i: len({text[b if a == i else a] for a, b in pairs if i in (a, b)}) for i in got}
    assert {i: r["links"] for i, r in got.items()} == links


def test_tree_traversal_loses_nothing():
    rng = np.random.default_rng(3)
    cache = WordHashes()
    sets = []
    families = rng.integers(0, 10**6, (40, 60))
    for k in range(300):
        base = families[k % 40].copy()
        base[rng.integers(0, 60, 3)] = rng.integers(0, 10**6, 3)
        sets.append(shingles(word_hashes(" ".join(map(str, base)), cache), 3))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), 512), np.uint8)
    for k, s in enumerate(sets):
        bits[k, (s >> np.uint64(40)).astype(np.int64) % 512] = 1
    signatures = np.packbits(bits, axis=1).view(np.uint64)
    excess = sizes - np.bitwise_count(signatures).sum(1, dtype=np.int64)
    for starts in ([0], [0, 2, 5, 6, 150]):
        forest = signature_tree.SignatureForest(signatures, sizes, excess, np.array(starts), 3, 5)
        run = np.searchsorted(starts, np.arange(len(sets)), "right")
        found = [(int(a), int(b)) for i, j in forest.pairs() for a, b in zip(i, j)]
        true = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if run[a] == run[b] and 8 * overlap(sets[a], sets[b]) >= 3 * (sizes[a] + sizes[b])}
        assert true and true <= set(found) and len(found) == len(set(found))
        assert all(a < b and run[a] == run[b] for a, b in found) and len(found) < 2 * len(true)


def test_trees_prune_nodes_by_overlap(spark):
    """On the pages of sf0.1 trees are built, and most pairs of different nodes in them go for their bitmaps' overlap."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/sent_pages.parquet").where("markdown is not null").select("markdown").limit(6000).collect()]
    cache, sets = WordHashes(), []
    for text in dict.fromkeys(texts):
        if len(hashes := word_hashes(text, cache)) >= 60:
            sets.append(shingles(hashes, 3))
    sizes = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), 512), np.uint8)
    for k, s in enumerate(sets):
        bits[k, (s >> np.uint64(40)).astype(np.int64) % 512] = 1
    signatures = np.packbits(bits, axis=1).view(np.uint64)
    excess = sizes - np.bitwise_count(signatures).sum(1, dtype=np.int64)
    # texts that share one shingle, families side by side
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    least = np.array([s[0] for s in sets])
    order = np.lexsort((sizes[owners], least[owners], tokens))
    tokens, owners = tokens[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(tokens)]]))
    members = np.concatenate([owners[s : s + n] for s, n in zip(starts, lengths) if 8 <= n <= 64][:3000])
    runs = [n for n in lengths if 8 <= n <= 64][:3000]
    forest = signature_tree.SignatureForest(signatures[members], sizes[members], excess[members], np.concatenate([[0], np.cumsum(runs)[:-1]]), 3, 5)
    assert len(forest.levels) >= 3
    for _ in forest.pairs():
        pass
    assert forest.by_overlap > 0.5 * (forest.tested - forest.by_size)


def test_empty_tables(pages, spark):
    df = pages[1].limit(0)
    assert signature_tree.similar_pairs(df, "page", "body").count() == 0
    assert signature_tree.near_duplicate_classes(df, "page", "body").count() == 0
    assert graph_index.seen_before(df, "page", "body", "part").count() == 0
    assert graph_index.seen_before(df, "page", "body", "part", F.col("body")).count() == 0
    assert site_lines.repeated_lines(df, "page", "key", "body").count() == 0
    items = spark.createDataFrame([], "item_id long, passage string")
    assert leaks.leaked_items(df, items, "page", "body").count() == 0


def brute_seen(rows, size, num, den, least):
    first = {}
    pairs = brute_pairs(rows, size, num, den, least)
    part = {i: -99 if b is None else b for i, _, b in rows}
    out = {b for a, b in pairs if part[a] < part[b]} | {a for a, b in pairs if part[b] < part[a]}
    for i, t, _ in rows:
        if t and len(WORDS.findall(t)) >= least:
            first[t] = min(first.get(t, 99), part[i])
    return out | {i for i, t, _ in rows if t in first and first[t] < part[i] and len(WORDS.findall(t)) >= least}


def test_new_batches(spark):
    rows = [(i, t, None if i == 7 else b) for i, t, b in corpus(2, 40)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page long, body string, part int, batch string")
    got = {r[0] for r in graph_index.seen_before(df, "page", "body", "part", size=3, num=3, den=5, least_words=60).collect()}
    want = brute_seen(rows, 3, 3, 5, 60)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_graph_recall_against_exhaustive_search():
    rng = np.random.default_rng(1)
    stored = np.round(30 * rng.normal(size=(3000, graph_index.DIMENSIONS))).clip(-127, 127).astype(np.int8)
    whole = graph_index.Shard.build(stored, np.arange(3000))
    grown = graph_index.Shard.build(stored[:2000], np.arange(2000)).extended(stored[2000:], np.arange(2000, 3000))
    again = graph_index.Shard.of_row(whole.row())
    assert (again.links == whole.links).all() and (again.vectors == whole.vectors).all() and again.beam == whole.beam
    queries = graph_index.disturbed(whole.vectors[::10], 9)
    truth = (queries @ whole.vectors.T).max(1)
    for shard in (whole, grown):
        assert shard.beam in graph_index.BEAMS
        _, cosines = shard.search(queries, shard.beam)
        assert (cosines.max(1) >= truth - 1e-4).mean() >= 0.9


def test_shards_search_exhaustively_where_beams_do_not_do():
    rng = np.random.default_rng(2)
    base = rng.normal(size=graph_index.DIMENSIONS)
    stored = np.round(25 * (base + 0.4 * rng.normal(size=(900, graph_index.DIMENSIONS)))).clip(-127, 127).astype(np.int8)
    shard = graph_index.Shard.build(stored, np.arange(900))
    queries = graph_index.disturbed(shard.vectors[::90], 3)
    for beam in (8, 0):  # every text is near, so beams are full; and a shard that no beam suits
        shard.beam = beam
        row, position, cosine = shard.near(queries)
        want = queries @ shard.vectors.T >= graph_index.LEAST_COSINE
        assert want.sum() == len(row) and want[row, position].all()


def test_sets_are_packed():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (graph_index.unpacked_set(graph_index.packed_set(values)) == np.unique(values >> np.uint64(24))).all()
    assert len(graph_index.unpacked_set(b"")) == 0


def test_history_is_kept_from_batch_to_batch(spark, tmp_path, monkeypatch):
    """A later batch is checked by an index opened anew, with nothing of the earlier texts at hand; compaction changes no answer."""
    rows = [r for r in corpus(8, 20) if r[1]]
    folder, how = f"file://{tmp_path}/index", {"size": 3, "num": 3, "den": 5, "least_words": 60}
    df = spark.createDataFrame(rows, "page long, text string, batch int").withColumn("key", F.xxhash64("text"))
    for number in range(4):
        history = graph_index.History(spark, folder, 2, **how)
        path = f"file://{tmp_path}/staged-{number}"
        own = df.where(F.col("batch") == number)
        history.stage(own.select("batch", "key", "text")).drop("batch").write.parquet(path)
        staged = spark.read.parquet(path)
        before = {r[0] for r in history.like(staged).collect()}
        if number == 3:
            history.compact()
            assert history.about["shards"] == 1 and {r[0] for r in history.like(staged).collect()} == before
            got = {r[0] for r in own.join(history.like(staged), "key").select("page").collect()}
        history.accept(number, staged, path, own.select(F.col("key").alias("h1"), F.xxhash64("text", F.lit("text")).alias("h2")))
        assert history.known(own.withColumn("second", F.xxhash64("text", F.lit("text"))), "key", "second").count() == own.count()
    # a batch is brought to the stored shards, which stay where they are
    asks = staged.select("key", "cells", "vector").mapInArrow(graph_index._routed, "route int, cell int, key long, vector binary").withColumn("part", F.lit(0))
    by = ["route", "cell", "part"]
    near = asks.select(*by, "key", "vector").groupBy(*by).cogroup(history.shards.read().groupBy(*by)).applyInArrow(graph_index._search(4), graph_index._FOUND)
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    history.drop()
    pairs, part = brute_pairs(rows, 3, 3, 5, 60), {i: b for i, _, b in rows}
    want = {x for a, b in pairs for x, y in ((a, b), (b, a)) if part[x] == 3 and part[y] < 3}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_split_cells(spark, monkeypatch):
    rows = corpus(5, 20)
    df = spark.createDataFrame(rows, "page long, body string, part int")
    monkeypatch.setattr(graph_index, "SPLIT", 20)
    got = {r[0] for r in graph_index.seen_before(df, "page", "body", "part", size=3, num=3, den=5, least_words=60).collect()}
    want = brute_seen(rows, 3, 3, 5, 60)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_partner_behind_full_beams(spark):
    """Each new text has one partner of similarity 0.61 among 150 stored texts of 0.58, which are about as near by cosine."""
    rng, rows, wanted = random.Random(4), [], set()
    fresh = itertools.count()
    for family in range(8):
        base = [f"b{family}x{k}" for k in range(100)]
        for k in range(151):
            cut, at = (22 if k == 75 else 24), rng.randrange(1, 74)
            rows.append((len(rows), " ".join(base[:at] + [f"n{next(fresh)}" for _ in range(cut)] + base[at + cut :]), 0))
        rows.append((len(rows), " ".join(base), 1))
        wanted.add(rows[-1][0])
    assert brute_seen(rows[:152], 3, 3, 5, 60) == {151}
    df = spark.createDataFrame(rows, "page long, body string, part int")
    assert {r[0] for r in graph_index.seen_before(df, "page", "body", "part", size=3, num=3, den=5, least_words=60).collect()} == wanted


def test_seen_urls(spark):
    df = spark.createDataFrame([(1, "u", 0), (2, "u", 1), (3, "u", 0), (4, "", 0), (5, "", 1), (6, None, 2), (7, "v", None), (8, "v", 0)], "page long, url string, batch int")
    df = df.withColumn("body", F.lit(None).cast("string"))
    assert {r[0] for r in graph_index.seen_before(df, "page", "body", "batch", F.col("url")).collect()} == {2, 8}


LINES = "This line is repeated 2020 times!\nown line of page {k} with enough words {w}\nshort\n> This LINE is_repeated 7 times\r\n"


def test_site_lines(spark):
    rng = random.Random(1)
    rows = [(k, f"https://{'www.' if k % 2 else ''}S.test/{k}", LINES.format(k=chr(97 + k), w="x" * k), k % 3) for k in range(7)]
    rows += [(k, "https://sub.s.test/a", LINES.format(k="q", w="y"), 0) for k in range(20, 25)]
    rows += [(30, None, None, 1), (31, "https://s.test/", "", None), rows[0]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page long, url string, body string, part int")
    got = {tuple(r) for r in site_lines.repeated_lines(df, "page", "url", "body", "part").collect()}
    assert got == {(k, n) for k in range(7) for n in (0, 3)}
    removed = site_lines.repeated_lines(df, "page", "url", "body")
    built = {r["id"]: r for r in site_lines.rebuild(df, "page", "body", removed).collect()}
    assert set(built) == set(range(7)) and built[1]["text"] == "own line of page b with enough words x\nshort\n" and built[1]["removed"] == 2


def test_line_counts_merge_as_deltas(spark, tmp_path):
    """The line crosses with the second partition, which brings in the first one's documents; later ones bring their own only."""
    rows = [(k, "https://s.test/", "the same long line for all of them\nown line of words no other has " + "abcdefghi"[k], k // 4) for k in range(9)]
    df = spark.createDataFrame(rows, "page long, url string, body string, part int")
    found, out = site_lines.occurrences(df, "page", "url", "body", "part"), []
    for part in (0, 1, 2):
        counts = site_lines.LineCounts(spark, folder=f"file://{tmp_path}/counts")  # opened anew each time
        out.append(sorted(tuple(r) for r in counts.merge(found.where(F.col("part") == part)).collect()))
        if part == 1:
            counts.compact()
    assert out == [[], [(k, 0) for k in range(8)], [(8, 0)]]
    assert sorted(r["documents"] for r in counts.state().collect()) == [1] * 9 + [9]


def brute_leaks(docs, items, least=13):
    import unicodedata

    plain = lambda t: WORDS.findall(unicodedata.normalize("NFC", t).lower()) if t else []
    grams = {}
    for i, p in items:
        w = plain(p)
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(d, i) for d, t in docs for w in [plain(t)] for k in range(len(w) - least + 1) for i in grams.get(tuple(w[k : k + least]), ())}


@pytest.mark.parametrize("share,block", [(0.0, 10**9), (1 / 40, 10**9), (0.1, 10**9), (1 / 40, 400)])
def test_leaks(spark, share, block):
    rng = random.Random(3)
    words = ["a", "bé", "c3", "dog", "ever", "é", "word", "长句", "слово"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for k in range(20)] + [(50, None), (51, ""), (52, "a b c d e f g h i j k l m")]
    docs = []
    for k in range(60):
        filler = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        w = (rng.choice(items[:20])[1].split())[: rng.choice([12, 13, 30])]
        docs.append((k, ", ".join(filler[:20]) + "\n" + " - ".join(w).upper() + "\n" + " ".join(filler[20:])))
    docs += [(100, None), (101, ""), (102, "A. B, c; D e f g\u00a0h i j k l M"), (103, "e\u0301 " * 5), docs[0]]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, passage string, doc_id int")
    got = leaks.leaked_items(d, i, edit_share=share, block_chars=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["exact"]} == brute_leaks(docs, items)
    assert all(r["exact"] or r["edits"] > 0 or share == 0 for r in got)


def nearest(pattern, text):
    """Edit distance of a pattern and the stretch of a text nearest to it."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_leaks_with_edits_are_those_of_brute_force(spark):
    """Windows with typing errors, dropped and added characters, in texts of the same words."""
    rng = random.Random(9)
    words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))) for _ in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(18))) for k in range(8)]
    docs, share = [], 0.04
    for k in range(90):
        part = items[k % 8][1].split()[k % 5 : k % 5 + 13]
        chars = list(" ".join(part))
        for _ in range(k % 6):
            at, how = rng.randrange(len(chars)), rng.randrange(3)
            if chars[at] != " ":
                chars[at : at + 1] = [["z"], [], [chars[at], "q"]][how]
        filler = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        docs.append((k, " ".join(filler[:15] + ["".join(chars)] + filler[15:])))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), edit_share=share).collect()}
    want = {}
    for d, text in docs:
        for i, passage in items:
            w = passage.split()
            windows = [" ".join(w[k : k + 13]) for k in range(len(w) - 12)]
            within = [n for x in windows if (n := nearest(x, text)) <= int(share * len(x))]
            if within:
                want[d, i] = min(within)
    assert len(want) > 30 and got == want


def test_banded_distances():
    code = lambda *texts: np.array([leaks.codes_of(t) for t in texts])
    assert leaks.banded_distances(code("kitten", "abcdef"), np.array([6, 3]), code("xkitteenyyy", "zzabzzzzzzz")).tolist() == [1, 1]
    assert leaks.banded_distances(code("abc"), np.array([3]), code("abc")).tolist() == [0]
