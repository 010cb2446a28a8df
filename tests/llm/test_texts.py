"""The text operators on small cases with known answers, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import main_content, markup, packing, residue, sentences, text_types
from pagemill.llm.code_spans import code_lines

PROSE = "The new bridge is open to all of the people who live in the town, and it has been built by a local team. "


# --- problem 1 ---

@pytest.fixture(scope="module")
def model():
    positive = [f for line in residue.SEEDS.split("\n") for f in residue.passages(line, True)] * 3
    rng = random.Random(1)
    words = "bridge town people garden engine local quiet report table window build open live team year new old and the of in with for pages search".split()
    unlabelled = [residue._features([rng.choice(words) for _ in range(rng.randint(4, 14))]) for _ in range(3000)]
    unlabelled += [f for line in ("Home | News | About", "We use cookies to improve your visit.", "Read more", PROSE) for _ in range(60) for f in residue.passages(line)]
    return residue.train(positive, unlabelled)


@pytest.mark.parametrize("text", ["Error 404. Page not found.", "# Please enable JavaScript and reload.", "Lorem ipsum dolor sit amet consectetur", PROSE + "\n\n{{ user.name }}", PROSE + "${total}", "Dear [INSERT NAME], hello", "Coming soon. [insert content]", "Bitte JavaScript im Browser aktivieren.", "Traceback:\n  File \"/srv/a.py\", line 3, in run\nValueError: value is missing"])
def test_residue_is_found(model, text):
    assert model.record(text) > 0


@pytest.mark.parametrize("text", [None, "", "   ", PROSE, "```\n{{ user.name }}\n```", "Write `{{ name }}` in the report of the town.", "The table {{cite|title=x}} of the town", "The window is open. Home | News | About", "\\frac{a}{b} of the garden", "[link](/a) to the garden"])
def test_other_text_is_not(model, text):
    assert model.record(text) <= 0


def test_expectation_maximization_learns_wordings_beside_trusted_ones():
    """A wording no trusted record has, always with one they have, is learned from unlabelled passages; a single round does not know it."""
    rng = random.Random(5)
    words = "bridge town people garden engine local quiet report table window open live team year new old".split()
    plain = [residue._features([rng.choice(words) for _ in range(8)]) for _ in range(4000)]
    trusted = [residue._features("the requested document does not exist".split())] * 40
    beside = [residue._features("the requested document does not exist zonk flurb".split())] * 40
    one, many = (residue.train(trusted, plain + beside, rounds=r) for r in (1, 8))
    assert one.odds(["zonk", "flurb"]) < 0 < many.odds(["zonk", "flurb"])
    assert many.odds(["bridge", "town", "garden"]) < 0


def test_samples_are_bounded(spark):
    """One id on all rows, or one text: a sample is no larger for it."""
    df = spark.range(5000).select(F.lit(7).alias("page_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("title"))
    assert len(residue._sample(df, "page_id", F.col("title"), 100)) <= 100
    assert main_content.fit_lines(df.withColumn("n", F.lit(3)), "page_id", "title", "n", 20) is None


def test_residue_tables(spark, model):
    info = spark.createDataFrame([(1, "Page not found", "ok"), (2, None, "ok"), (3, "A new bridge for the town", "bad_title"), (1, "Page not found", "ok"), (5, "{{ page.title }}", None)], "page_id long, title string, reason string")
    sent = spark.createDataFrame([(2, "Access denied."), (3, PROSE), (4, None), (6, "")], "page_id long, markdown string")
    assert sorted(r[0] for r in residue.flagged_pages(info, sent, model).collect()) == [1, 2, 5]
    assert residue.flagged_pages(info.limit(0), sent.limit(0)).count() == 0
    assert residue.flagged_pages(info, sent).count() >= 0  # the model it fits itself


# --- problem 2 ---

PAGE = ["Home | News | About", "", "# The bridge", "", PROSE, "", "- one", "- two", "", "© 2020 The Town. All rights reserved."]


def count(lines):
    return sum(len("".join(x.split())) for x in lines)


def test_body_by_count():
    assert main_content.body_range(PAGE, count(PAGE[2:8])) == (2, 8)
    assert main_content.body_range(PAGE, count(PAGE[2:8]) + 2) == (2, 8)
    assert main_content.body_range(PAGE, count(PAGE)) == (2, 8)  # a count that takes menu and legal line in is not believed
    assert main_content.body_range(PAGE, 0) == (0, 0)
    assert main_content.body_range(["", " "], 5) == (0, 0)
    first, stop = main_content.body_range(PAGE, None)
    assert first <= 4 < stop


def test_body_tables(spark):
    text = "\n".join(PAGE)
    df = spark.createDataFrame([(1, text, count(PAGE[2:8]), 9), (2, None, 5, 9), (3, "", None, 9), (4, text, None, 9)], "page long, md string, chars int, first int")
    lines = sorted(tuple(r) for r in main_content.chrome_lines(df.where("page < 4"), "page", "md", "chars").collect())
    assert lines == [(1, 0), (1, 9)]
    body = {r["id"]: r for r in main_content.bodies(df, "page", "md", "chars").collect()}
    assert body[1]["body"] == "\n".join(PAGE[2:8]) and body[1]["first"] == 2 and body[2]["body"] is None and body[3]["body"] == ""
    assert main_content.chrome_lines(df.limit(0), "page", "md", "chars").count() == 0


def test_an_outdated_count_does_not_decide():
    """A count that fits one wrong region only: the lines speak against it."""
    wrong = count(PAGE[6:])
    assert main_content.counted_regions(PAGE, wrong) == [(6, 10)]
    pages = [(PAGE, (2, 8)), (["Home", "", "# A lamp", "", PROSE, "", "© 2021 The Lamp Shop"], (2, 5))] * 5
    model = main_content.LineModel.train(pages)
    assert main_content.body_range(PAGE, wrong, model) == (2, 8)
    assert main_content.body_range(PAGE, None, model) == (2, 8)


def test_bodies_without_any_count(spark):
    """Fitted to one half of the pages, ratios and line model find the bodies of the other half without its counts."""
    rows = [(r[0].split("\n"), r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/sent_pages.parquet").where("markdown <> '' and crawler_report.main_content_chars > 0").select("markdown", "crawler_report.main_content_chars").collect()]
    known = [(lines, found[0]) for lines, n in rows if len(found := main_content.counted_regions(lines, n)) == 1]
    model = main_content.LineModel.train(known[::2])
    true = found = both = 0
    for lines, (a, b) in known[1::2]:
        x, y = main_content.body_range(lines, None, model)
        own = {k for k, line in enumerate(lines) if line.strip() and not a <= k < b}
        got = {k for k, line in enumerate(lines) if line.strip() and not x <= k < y}
        true, found, both = true + len(own), found + len(got), both + len(own & got)
    assert 2 * both / (true + found) >= 0.95


def test_tags_over_lines():
    raw = main_content.ratios(["<div", ' class="x">', "plain text of some length", "a <b>b</b> c"])
    assert raw[2] == 25 and raw[3] < 5


# --- problem 3 ---

def test_types(spark):
    rng = random.Random(2)
    rows, kind = [], {}
    name = lambda: rng.choice("KLMN") + "".join(rng.choice("aeioubdg") for _ in range(6))
    for k in range(240):
        which = ("prose", "list", "table", "junk")[k % 4 if k < 80 else 0]
        if which == "prose":
            body = "\n\n".join(" ".join(rng.sample(PROSE.split(), 18)) + "." for _ in range(5))
        elif which == "list":
            body = "\n".join(f"- {name()} {name()} {name()}" for _ in range(20))
        elif which == "table":
            body = "\n".join(f"| {name()} | {name()} | {rng.randint(1, 99)} |" for _ in range(20))
        else:
            body = "\n".join("".join(rng.choice("qxzvkw #$%&@!?;:~7") for _ in range(60)) for _ in range(16))
        text = "# Title of the page\n\n" + body
        rows.append((k, text, count(text.split("\n")), "v"))
        kind[k] = which
    rows += [(900, None, 1, "v"), (901, "", None, "v"), (902, "few words", None, "v"), rows[0]]
    df = spark.createDataFrame(rows, "page long, md string, chars int, votes string")
    got = {r["id"]: r for r in text_types.typed(df, "page", "md", "chars").collect()}
    assert set(got) == set(kind)
    right = sum((got[k]["prose_posterior"] >= 0.5) == (kind[k] == "prose") for k in kind)
    assert right >= 0.98 * len(kind)
    assert text_types.typed(df.limit(0), "page", "md", "chars").count() == 0


def test_statistics():
    row = dict(zip(text_types.STATISTICS, text_types.statistics(["# Title", "", "The cat sat on the mat.", "- one two", "```", "code here", "```"])))
    assert row["words"] == 8 and row["lines"] == 2 and row["marker_share"] == 2 / 8 and row["ending_share"] == 6 / 8
    assert text_types.statistics([])[0] == 0 and text_types.learn({}) == {}


# --- problem 7 ---

MARKUP = [
    ("<p>text</p>", {"html"}), ("a &nbsp; b", {"html"}), ("[[page|name]]", {"wiki"}), ("it is '''bold'''", {"wiki"}), ("== Head ==", {"wiki"}), ("{{t|a=b}}", {"wiki"}), ("{| class=x\n|-\n| a\n|}", {"wiki"}),
    ("\\section{A}", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("so $x^2 = y$ holds", {"latex"}), ("\\(a + b\\)", {"latex"}), ("<b>x</b> [[y]] \\textbf{z}", {"html", "wiki", "latex"}),
    ("costs $5 or $6", set()), ("a < b and b > c", set()), ("{{ name }}", set()), ("${x} and ${y}", set()), ("[[4, 21]]", set()), ("```\n<p>x</p>\n```", set()), ("write `<b>` or `&amp;`", set()), ("AT&T", set()), ("the dogs' and cats' food", set()), ("", set()), (None, set()), ("~~~\n[[a]]\n~~~\n<hr>", {"html"}),
]


def test_markup(spark):
    df = spark.createDataFrame([(k, t, "m") for k, (t, _) in enumerate(MARKUP)], "page long, md string, markup string")
    found = {}
    for page, kind in markup.markup_kinds(df, "page", "md").collect():
        found.setdefault(page, set()).add(kind)
    assert found == {k: kinds for k, (_, kinds) in enumerate(MARKUP) if kinds}
    texts = {r["id"]: r["text"] for r in markup.clean_texts(df, "page", "md").collect()}
    assert texts[22] is None and texts[17] == MARKUP[17][0] and texts[12] == MARKUP[12][0]
    assert markup.markup_kinds(df.limit(0), "page", "md").count() == 0


@pytest.mark.parametrize("dirty,clean", [("<h2>Head</h2>", "## Head"), ("<ul>\n<li>a</li>\n<li>b &amp; c</li>\n</ul>", "- a\n- b & c"), ("== Head ==\nsee [[p|this]]", "## Head\nsee this"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "- a"), ("\\section{A} and $x^2 = y$", "## A and $x^2 = y$"), ("the <b>new</b> `<b>` tag", "the **new** `<b>` tag"), ("{|\n|-\n| a || b\n|}", "| a | b |\n| --- | --- |"), ("```\n<b>\n```", "```\n<b>\n```")])
def test_cleaning_keeps_structure(dirty, clean):
    assert markup.clean(dirty, markup.trees()) == clean


def test_block_types(spark):
    page = "# The bridge\n\n" + PROSE + "\n\n- one\n- two\n\n```\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n* [A](/a)\n* [B](/b)\n* [C](/c)\n\n<p>" + PROSE + "</p>"
    df = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "", 0)], "page long, md string, id int")
    rows = sorted(tuple(r) for r in markup.typed_blocks(df, "page", "md").collect())
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [(0, 1, "heading", ""), (2, 3, "text", ""), (4, 6, "list", ""), (11, 14, "table", ""), (15, 18, "menu", ""), (19, 20, "text", "html")]


def test_fences():
    assert code_lines(["a", "```x", "b", "~~~", "```", "c", "~~~", "d"]) == [False, True, True, True, True, False, True, True]


# --- problem 8 ---

def test_packing_invariants():
    rng = random.Random(7)
    n, capacity = 800, 200
    ids, tokens = list(range(n)), [rng.choice([0, 3, 20, 50, 90, 150, 199, 200, 201, 700]) for _ in range(n)]
    sources, clusters = [rng.choice([None, "hot", "hot", *"abcdefgh"]) for _ in range(n)], [rng.randint(0, 300) for _ in range(n)]
    rows = packing.pack(ids, tokens, sources, clusters, capacity, layers=2)
    whole, room, held = [0] * n, {}, {}
    for k, piece, start, size, container in rows:
        assert start == piece * capacity and size <= capacity
        whole[k] += size
        room[container] = room.get(container, 0) + size
        if tokens[k] <= capacity or size < capacity or start + size == tokens[k]:
            held.setdefault(container, []).append(k)
    assert whole == tokens and max(room.values()) <= capacity
    assert all(sum(1 for r in rows if r[0] == k) == (1 if tokens[k] <= capacity else -(-tokens[k] // capacity)) for k in range(0, n, 37))
    for members in held.values():
        assert len({clusters[k] for k in members}) == len(members)
        own = [sources[k] for k in members if sources[k]]
        assert all(own.count(s) <= 2 for s in own)


def test_packing_fills_well():
    rng = random.Random(3)
    tokens = [rng.randint(5, 400) for _ in range(4000)]
    rows = packing.pack(list(range(4000)), tokens, [None] * 4000, list(range(4000)), 1000)
    assert sum(tokens) / (1000 * len({r[4] for r in rows})) > 0.99


def test_many_texts_of_one_cluster_or_of_no_token():
    """300 texts without a token share containers; thousands of one cluster are placed without looking at each other's containers."""
    rows = packing.pack(list(range(300)), [0] * 300, [None] * 300, [None] * 300, 100)
    assert len({r[4] for r in rows}) == 1
    import time

    def seconds(n):
        start = time.process_time()
        rows = packing.pack(list(range(n)), [10] * n, [None] * n, ["same"] * n, 100)
        assert len({r[4] for r in rows}) == n
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.2


def test_containers(spark):
    docs = spark.createDataFrame([(1, "one two three", "a.test"), (2, None, None), (3, "", "a.test"), (4, "word " * 300, "b.test"), (5, "One, two three!", "c.test"), (1, "one two three", "a.test")], "doc_id long, text string, source string")
    kinds = spark.createDataFrame([("s", 64), ("l", 512), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = packing.fill_containers(docs, kinds).collect()
    assert {r["container_kind"] for r in rows} == {"s", "l"}
    for kind in ("s", "l"):
        own = [r for r in rows if r["container_kind"] == kind]
        assert {r["doc_id"] for r in own} == {1, 2, 3, 4, 5}
        # texts with the same words never share a container
        place = {r["doc_id"]: r["container"] for r in own if r["doc_id"] in (1, 5)}
        assert place[1] != place[5]
    assert sum(r["tokens"] for r in rows if r["container_kind"] == "s" and r["doc_id"] == 4) == sum(r["tokens"] for r in rows if r["container_kind"] == "l" and r["doc_id"] == 4)
    fill = {r["container_kind"]: r for r in packing.fill_of(packing.fill_containers(docs, kinds), kinds).collect()}
    assert set(fill) == {"s", "l"} and all(r["texts"] == 5 and 0 < r["fill"] <= 1 for r in fill.values())
    assert packing.fill_containers(docs.limit(0), kinds).count() == packing.fill_containers(docs, kinds.limit(0)).count() == 0


# --- problem 10 ---

@pytest.fixture(scope="module")
def events(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    return sentences.train([r[0] for r in texts])


@pytest.mark.parametrize("text,starts", [
    ("", []), ("  \n\n ", []), ("One line", [0]), ("  It was cold. The valve is new.", [2, 15]), ("Title of it\n\nThe town paid.", [0, 13]), ("The town\npaid. It was.", [0, 15]), ("- one two\n- three", [0, 10]), ("1) one\n2) two", [0, 7]),
    ("He met Dr. Moltek. They left.", [0, 19]), ("It paid 3.5 million. The town", [0, 21]), ('"Is it open?" asked the man. He left.', [0, 29]), ("Move the valve (do not open it!) and wait. It was.", [0, 43]), ("我们打开阀门。水泵是新的！", [0, 7]), ("สะพานใหม่มาก สะพานเก่ามาก", [0, 13]), ("a\r\n\r\nb", [0, 5]), ("The bridge.The town", [0, 11]),
])
def test_boundaries(events, text, starts):
    assert sentences.sentence_starts(text, events) == starts


def test_sentence_tables(spark, events):
    df = spark.createDataFrame([(1, "It is new. The pump is old.", 0), (2, None, 0), (3, "", 0), (4, "word " * 20_000, 0)], "doc_id long, text string, start_char int")
    assert sorted(tuple(r) for r in sentences.sentences(df, model=events).collect()) == [(1, 0), (1, 11), (4, 0)]
    assert sentences.sentences(df.limit(0)).count() == 0
    assert sentences.sentences(df).where("id = 4").count() == 1


def test_paragraphs_without_marks(spark, events):
    """Without end marks most sentences of a long paragraph are found again, and little else; short ones stay whole."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("text").collect()
    true = found = both = 0
    for (text,) in texts:
        for a, b in sentences.units(text):
            unit = text[a:b]
            bare = re.sub(r"[.!?]+(?=\s|$)", "", unit)
            own = {len(unit[:s].split()) for s in sentences.sentence_starts(unit, events)}
            if len(own) < 4 or len(bare.split()) < sentences.LONG_UNIT or any(m in bare for m in sentences.END_MARKS):
                continue
            got = {len(bare[:s].split()) for s in sentences.sentence_starts(bare, events)}
            true, found, both = true + len(own), found + len(got), both + len(own & got)
    assert true > 300 and both >= 0.8 * true and both >= 0.9 * found
    assert sentences.sentence_starts("A heading with no mark\nThe next line", events) == [0]


def test_scripts_without_marks_and_spaces(spark):
    """Chinese and Japanese paragraphs without any mark: most sentences are found again by the characters around their ends."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text like '%。%'").select("text").collect()]
    model = sentences.train(texts)
    true = found = both = 0
    for text in texts:
        for a, b in sentences.units(text):
            parts = [re.sub(r"[^\u3040-\u30ff\u3400-\u9fff]", "", x) for x in re.split("[。！？]", text[a:b])]
            bare = "".join(parts)
            if len(bare) < sentences.LONG_SCRIPT:
                continue
            starts = {sum(map(len, parts[:k])) for k, x in enumerate(parts) if x}
            got = set(sentences.sentence_starts(bare, model))
            true, found, both = true + len(starts), found + len(got), both + len(starts & got)
    assert true > 1000 and both >= 0.65 * true and both >= 0.8 * found
    assert sentences.sentence_starts("新桥今天开放", model) == [0]


def test_written_places_give_the_same_sentences(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentences.fit(sentences.read(df, "doc_id", "text"))
    assert sorted(map(tuple, sentences.sentences(df).collect())) == sorted((k, s) for k, t in enumerate(texts) if t for s in sentences.sentence_starts(t, model))


def test_posteriors_are_those_of_all_paths(events):
    rng = random.Random(1)
    found = [sentences.Place(k, rng.choice(["dr.", "bridge.", "q?\"s"]), "<word>.", rng.choice(["The", "asked", "Jones"]), rng.choice([1, 5])) for k in range(6)]
    weight, on = {}, [0.0] * 6
    for path in range(64):
        bits = [path >> k & 1 for k in range(6)]
        w = 1.0
        for k, b in enumerate(bits):
            if b:
                w *= events.odds(found[k]) * (events.short_odds if k and bits[k - 1] and found[k].words <= sentences.NEAR_WORDS else 1)
        weight[path] = w
        for k, b in enumerate(bits):
            on[k] += w * b
    total = sum(weight.values())
    assert events.posteriors(found) == pytest.approx([x / total for x in on], rel=1e-6, abs=1e-9)


def test_sentence_counts_are_of_all_texts(spark):
    """An abbreviation seen in 4 of 9,000 texts is in the model: every text counts, and the parts' counts add up."""
    texts = ["It was a day. We met Qrx. Smith there."] * 4 + ["It was a day. The sun was out."] * 8_996
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole, parts = sentences.train(texts), sentences.fit(sentences.read(df, "doc_id", "text"))
    assert "qrx." in parts.event and whole.event.keys() == parts.event.keys()
    assert all(abs(p - parts.event[b]) < 1e-9 for b, p in whole.event.items())
