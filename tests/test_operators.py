import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import fixed
from pagemill.operators import dedup, frontier, jobs
from pagemill.plans import catalogue
from tests.conftest import SMALL


def sequential_gate(rows):
    """The gate's rules as a fold, one page after another."""
    canonicals, first, out = set(), {}, {}
    for seq, url, canonical, sig, meta, detail in rows:
        if canonical is not None:
            if canonical in canonicals:
                out[seq] = "duplicate_canonical:" + canonical
                continue
            canonicals.add(canonical)
        canonicals.add(url)
        if sig not in first:
            first[sig] = (url, meta)
            out[seq] = "ok"
        elif not detail:
            out[seq] = "duplicate_content:" + first[sig][0]
        else:
            out[seq] = "duplicate_content_and_title:" + first[sig][0] if first[sig][1] == meta else "ok"
    return out


def test_gate_equals_the_fold(spark):
    rng, data, want = random.Random(4), [], {}
    for job in range(60):
        n = rng.randint(1, 9)
        rows = []
        for seq in range(n):
            canonical = rng.choice([None, None, *(f"u{k}" for k in range(n)), "c1"])
            rows.append((seq, f"u{seq}", None if canonical == f"u{seq}" else canonical, rng.choice("pqr"), rng.choice("xy"), rng.random() < 0.5))
        data += [(f"j{job}", *r) for r in rows]
        want |= {(f"j{job}", seq): reason for seq, reason in sequential_gate(rows).items()}
    df = spark.createDataFrame(data, "job_id string, seq long, url string, canonical string, sig string, meta string, is_detail boolean")
    assert {(r[0], r[1]): r[2] for r in dedup.duplicate_gate(df).collect()} == want
    assert dedup.duplicate_gate(df.limit(0)).count() == 0


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), ("a", 1, "y")], "k string, seq int, v string")
    assert sorted(map(tuple, dedup.first_by(df, ["k"], ["seq"]).collect())) == [("a", 1, "y"), ("b", 1, None)]
    assert sorted(map(tuple, dedup.last_by(df, ["k"], ["seq"]).collect())) == [("a", 2, "x"), ("b", 1, None)]


def graph(spark):
    edges = [("j", 1, "s", "a", 60), ("j", 2, "s", "b", 90), ("j", 3, "b", "c", 50), ("j", 4, "c", "s", 90), ("j", 5, "a", "d", -26), ("j", 6, "c", "d", 0), ("j", 7, "d", "e", 80), ("j", 8, "s", "bad", -25)]
    df = spark.createDataFrame(edges, "job_id string, seq long, parent_norm string, norm string, score int").withColumn("reason", F.lit("accepted"))
    return df, spark.createDataFrame([("j", "s"), ("k", "t")], "job_id string, norm string")


def test_frontiers(spark):
    edges, seeds = graph(spark)
    rounds = {(r["job_id"], r["norm"]): (r["depth"], r["status"]) for r in frontier.crawl_rounds(edges, seeds, max_depth=4, max_pages=4).collect()}
    assert rounds == {("j", "s"): (0, "completed"), ("j", "a"): (1, "completed"), ("j", "b"): (1, "completed"), ("j", "c"): (2, "completed"), ("j", "d"): (3, "pending"), ("k", "t"): (0, "completed")}
    exact = {(r["job_id"], r["norm"]): (r["depth"], r["visit"]) for r in frontier.crawl_exact(edges, seeds, max_depth=4, max_pages=4).collect()}
    assert exact == {("j", "s"): (0, 0), ("j", "b"): (1, 1), ("j", "a"): (1, 2), ("j", "c"): (2, 3), ("j", "d"): (3, -1), ("k", "t"): (0, 0)}


def rounds_of(edges, seeds, max_depth):
    """Brute force of one job's crawl in rounds: {norm: (depth, status)}."""
    most, out = max(s["max_pages"] for s in seeds), {}
    for s in seeds:
        out[s["norm"]] = (0, 100, min(s["seq"], out[s["norm"]][2]) if s["norm"] in out else s["seq"])
    done, pending = set(), set(out)
    for depth in range(1, max_depth + 2):
        claimed = sorted(pending, key=lambda n: (-out[n][1], out[n][2], n))[: most - len(done)]
        done |= set(claimed)
        pending -= set(claimed)
        if depth > max_depth:
            break
        for e in edges:  # by seq
            score = e["score"] - 6 * depth
            if e["parent_norm"] in claimed and e["norm"] not in out and score >= fixed.LEAST_SCORE:
                out[e["norm"]] = (depth, score, e["seq"])
                pending.add(e["norm"])
    return {n: (d, "completed" if n in done else "pending") for n, (d, *_) in out.items()}


def best_first_of(edges, seeds, max_depth):
    """Brute force of one worker's crawl: {norm: (depth, visit)}."""
    most, out, waiting = max(s["max_pages"] for s in seeds), {}, []
    for s in sorted(seeds, key=lambda s: (s["seq"], s["norm"])):
        if s["norm"] not in out:
            out[s["norm"]] = [0, -1]
            waiting.append((-100, len(out), s["norm"]))
    for visit in range(most):
        if not waiting:
            break
        waiting.sort()
        norm = waiting.pop(0)[2]
        out[norm][1], depth = visit, out[norm][0] + 1
        for e in edges:
            score = e["score"] - 6 * depth
            if e["parent_norm"] == norm and e["norm"] not in out and depth <= max_depth and score >= fixed.LEAST_SCORE:
                out[e["norm"]] = [depth, -1]
                waiting.append((-score, len(out), e["norm"]))
    return {n: tuple(x) for n, x in out.items()}


@pytest.mark.parametrize("budget", [None, 7])
def test_crawls_of_the_tables_are_those_of_brute_force(spark, budget):
    """All seeds, depth 5 and each job's budget; of 7 pages and fewer it binds."""
    edges, seeds = catalogue._edges(spark, SMALL), catalogue._crawl_seeds(spark, SMALL)
    if budget:
        seeds = seeds.withColumn("max_pages", F.lit(budget) - F.pmod(F.hash("job_id"), F.lit(budget - 1)))
        rounds, exact = frontier.crawl_rounds(edges, seeds), frontier.crawl_exact(edges, seeds)
    else:
        rounds, exact = catalogue.queries()["frontier_crawl"](spark, SMALL), catalogue.queries()["frontier_exact"](spark, SMALL)
    links, starts = {}, {}
    for e in sorted(edges.collect(), key=lambda e: e["seq"]):
        links.setdefault(e["job_id"], []).append(e)
    for s in seeds.collect():
        starts.setdefault(s["job_id"], []).append(s)
    want = {(j, n): v for j, own in starts.items() for n, v in rounds_of(links.get(j, []), own, 5).items()}
    assert {(r["job_id"], r["norm"]): (r["depth"], r["status"]) for r in rounds.collect()} == want
    assert any(d > 1 for d, _ in want.values()) and any(s == "pending" for _, s in want.values()) == bool(budget)
    want = {(j, n): v for j, own in starts.items() for n, v in best_first_of(links.get(j, []), own, 5).items()}
    assert {(r["job_id"], r["norm"]): (r["depth"], r["visit"]) for r in exact.collect()} == want


def sequential_limit(times, most, seconds):
    accepted, out = [], []
    for t in times:
        accepted = [a for a in accepted if t - a < seconds]
        out.append(len(accepted) < most)
        if out[-1]:
            accepted.append(t)
    return out


def test_rate_limit(spark):
    rng, rows, want, n = random.Random(2), [], {}, 0
    for client in range(12):
        t = 0
        times = []
        for _ in range(40):
            t += rng.choice([0, 1, 3, 70])
            times.append(t)
        for t, ok in zip(times, sequential_limit(times, 2, 10)):
            rows.append((n, client, t))
            want[n] = ok
            n += 1
    df = spark.createDataFrame(rows, "request_id long, client int, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["request_id"]: r["accepted"] for r in jobs.rate_limit(df, "client", "ts", 2, 10).collect()} == want


def test_sending(spark):
    rows = [(1, 1, 503), (1, 2, 200), (1, 3, 200), (2, 1, 400), (2, 2, 200), (3, 1, 0), (3, 2, 0), (3, 3, 500), (3, 4, 408), (3, 5, 200), (1, 1, 503)]
    df = spark.createDataFrame(rows, "req_id long, attempt int, status int")
    assert sorted(map(tuple, jobs.send_outcomes(df).collect())) == [(1, 2, 200, True), (2, 1, 400, False), (3, 4, 408, False)]


def test_eta(spark):
    row = spark.sql("SELECT 'PROCESSING' AS status, 5 AS crawled, 0 AS discovered, 100 AS max_pages, 10 AS elapsed")
    c = F.col
    assert row.select(jobs.status_eta(c("status"), c("crawled"), c("discovered"), c("max_pages"), c("elapsed"))).first()[0] == 296


def test_listing_and_status(spark):
    rows = [(1, "j", 1, "SEND", 5), (2, "j", 2, "SKIP", 99), (3, "j", 3, "SEND", None), (4, "j", 4, "SEND", 7), (4, "j", 4, "SEND", 7)]
    df = spark.createDataFrame(rows, "page_id long, job_id string, seq long, decision string, score int")
    assert [r["page_id"] for r in jobs.listing(df, page_size=3).collect()] == [4, 1, 3]
    assert [r["page_id"] for r in jobs.listing(df, page=2, page_size=3).collect()] == [2]
    got = spark.createDataFrame([(5, 0), (4, 1), (1, 5), (0, 9)], "failed int, sent int").select(jobs.final_status(F.col("failed"), F.col("sent"))).collect()
    assert [r[0] for r in got] == ["FAILED", "COMPLETED_WITH_ERRORS", "COMPLETED_WITH_ERRORS", "COMPLETED"]


def test_sinks_and_sitemaps(spark, tmp_path):
    import gzip

    from pagemill.sources import payloads, sitemaps
    from tests.conftest import SMALL

    pages = spark.read.parquet(f"{SMALL}/sent_pages.parquet")
    payloads.write_pages(pages, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == pages.count()
    raw = spark.createDataFrame([(1, bytearray(gzip.compress(b"<loc>x</loc>"))), (2, bytearray(b"<loc>y\xff</loc>")), (3, None)], "id int, body binary")
    assert [r[0] for r in raw.orderBy("id").select(sitemaps.decoded(F.col("body"))).collect()] == ["<loc>x</loc>", "<loc>y</loc>", None]
    answers = spark.createDataFrame([('{"id": "7", "job_id": ""}',), ('{"document_id": "8", "id": "9"}',), (None,)], "a string")
    assert [r[0] for r in answers.select(payloads.document_id(F.col("a"))).collect()] == ["7", "8", None]


def test_long_chains_of_canonical_links(spark):
    """Page k names page k - 1: every second one is turned away, however long the chain."""
    rows = [("j", k, f"u{k}", f"u{k - 1}" if k else None) for k in range(120)] + [("i", 1, "a", "z"), ("i", 2, "b", "z"), ("i", 3, "c", "b"), ("i", 4, "d", "c")]
    df = spark.createDataFrame(rows, "job_id string, seq long, url string, canonical string")
    got = {(r["job_id"], r["seq"]): r["reason"] for r in dedup.canonical_rejects(df).collect()}
    assert got == {("j", k): f"duplicate_canonical:u{k - 1}" for k in range(1, 120, 2)} | {("i", 2): "duplicate_canonical:z", ("i", 4): "duplicate_canonical:c"}


def test_nested_sitemaps_and_those_of_robots_files(spark):
    from pagemill.sources import sitemaps

    depth = 9
    bodies = [(f"https://s.test/m{k}.xml", f"<loc>https://s.test/p{k}</loc><loc>https://s.test/m{k + 1}.xml</loc>") for k in range(depth)] + [("https://www.s.test/sitemap.xml", "<loc>https://s.test/w</loc>")]
    robots = spark.createDataFrame([("s.test", "User-agent: *\r\nSITEMAP:  https://s.test/m0.xml \nSitemap:\nDisallow: /x"), ("www.s.test", None)], "host string, body string")
    seeds = sitemaps.first_sitemaps(spark.createDataFrame([("https://s.test/",)], "url string"), robots)
    ordered = [r["url"] for r in seeds.orderBy("place").collect()]
    assert ordered[0] == "https://s.test/m0.xml" and ordered[1] == "https://s.test/sitemap.xml" and len(ordered) == 13
    found = sitemaps.sitemap_urls(seeds, spark.createDataFrame(bodies, "url string, body string"))
    assert {(r["url"], r["parent"]) for r in found.collect()} == {(f"https://s.test/p{k}", f"https://s.test/m{k}.xml") for k in range(depth)} | {("https://s.test/w", "https://www.s.test/sitemap.xml")}
    assert sitemaps.sitemap_urls(seeds, spark.createDataFrame(bodies, "url string, body string"), most=3).count() < depth


def test_discovery_stages(spark):
    from pagemill.operators import discovery

    page = ("j", "https://s.test/a/")
    handlers = spark.createDataFrame([(*page, 1, "viewItem('b', '/x/')", "t" * 200), (*page, 2, "viewItem('b', '/x')", "later"), (*page, 3, None, None)], "job_id string, page string, row int, onclick string, text string")
    assert [(r["norm"], r["row"], len(r["text"])) for r in discovery.handler_links(handlers).collect()] == [("https://s.test/x/b", 1, 100)]

    limits = spark.createDataFrame([("blog_detail", 1, False), ("home", 1, False), ("home", 7, False), ("section", 1, True)], "route string, depth int, seen boolean")
    got = [tuple(r[0]) for r in limits.select(discovery.stage_limits(F.col("route"), F.col("depth"), F.col("seen"))).collect()]
    assert got == [(False, True, 8, 4, True, False), (True, True, 80, 60, False, True), (False, False, 0, 0, False, False), (False, True, 80, 60, True, True)]

    controls = [(*page, k, text, aria, visible, nav, 6, True) for k, (text, aria, visible, nav) in enumerate([("More", None, True, False), ("MORE ", "", True, False), ("Accept all", None, True, False), ("Menu", None, True, True), ("Tab", "two", False, False), (None, "Open", True, False), ("Beyond", None, True, False)])]
    shown = spark.createDataFrame(controls, "job_id string, page string, row int, text string, aria_label string, visible boolean, in_nav boolean, buttons int, skip_nav boolean")
    assert sorted((r["row"], r["label"]) for r in discovery.clicked(shown).collect()) == [(0, "more"), (5, "open")]

    after = spark.createDataFrame([(*page, 1, 0, "https://s.test/old#x"), (*page, 1, 1, "https://s.test/new"), (*page, 2, 0, "https://www.s.test/new/"), (*page, 2, 1, "https://s.test/two"), (*page, 2, 2, "mailto:x")], "job_id string, page string, row int, place int, url string")
    base = spark.createDataFrame([(*page, "https://s.test/old"), (*page, None)], "job_id string, page string, url string")
    assert sorted((r["row"], r["norm"]) for r in discovery.revealed_links(after, base).collect()) == [(1, "https://s.test/new"), (2, "https://s.test/two")]

    anchors = spark.createDataFrame([(*page, k, h) for k, h in enumerate(["#", "#a", "#!", "#a", None, "/x"] + [f"#s{k}" for k in range(40)])], "job_id string, page string, row int, href string")
    assert sorted(r["row"] for r in discovery.fragment_controls(anchors).collect()) == [1, *range(6, 29)]

    dialogs = spark.createDataFrame([(*page, 2, " b "), (*page, 1, "a"), (*page, 3, " ")], "job_id string, page string, row int, text string")
    assert discovery.revealed_text(dialogs).first()["text"] == "a\n\n---\n\nb"

    offer = lambda *rows: spark.createDataFrame([(*page, k, u, s, "") for k, (u, s) in enumerate(rows)], "job_id string, page string, row int, url string, source string, text string")
    order = discovery.in_stage_order({"dom": offer(("https://s.test/one", "dom")), "click": offer(("https://s.test/two", "click_revealed"), ("https://s.test/one/", "click_revealed"))})
    assert [(r["seq"], r["source"]) for r in order.orderBy("seq").collect()] == [(1, "click_revealed"), (2, "click_revealed"), (3, "dom")]
    first = discovery.first_offers(order.withColumn("visit", F.lit(1)))
    assert {(r["norm"], r["source"]) for r in first.collect()} == {("https://s.test/one", "click_revealed"), ("https://s.test/two", "click_revealed")}

    stages = spark.createDataFrame([("j", "click", 3, 1, False, "back"), ("j", "click", 1, None, True, None), ("j", "nav_hover", 5, None, False, None), ("j", "hash", 2, None, False, "goto")], "job_id string, stage string, found int, navigations int, nav_cached boolean, restored string")
    assert discovery.interactions(stages).first().asDict() == {"job_id": "j", "menus_interacted": 1, "clicks_interacted": 2, "nav_links_found": 5, "click_links_found": 4, "hash_links_found": 2, "navigation_links_found": 1, "nav_fingerprint_cache_hits": 1, "restore_via_back": 1, "restore_via_goto": 1}


def test_hot_keys_in_blocks_of_time(spark):
    """One key has most rows, over many blocks: the same counts as row by row."""
    rng = random.Random(6)
    rows = [(k, "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.randrange(0, 40_000), rng.random() < (0.3 if k % 2 else 0.95)) for k in range(600)] + [(1000, "hot", None, True)]
    df = spark.createDataFrame(rows, "id long, user string, sec int, failed boolean").withColumn("ts", F.timestamp_seconds("sec"))
    recent = {r["id"]: (r["recent"], r["span"]) for r in jobs.rolling_rate(df, "user", "ts", 900, 1000).collect()}
    assert len(recent) == len(rows)
    for i, user, sec, _ in rows[:600]:
        near = [s for _, u, s, _ in rows if u == user and s is not None and sec - 900 <= s <= sec]
        assert recent[i] == (len(near), float(sec - min(near)))
    dated = df.where("sec is not null")
    got = {r["id"]: r["aborted"] for r in jobs.circuit_breaker(dated, "user", ["ts", "id"], "failed", 700).collect()}
    for user in ("hot", "a", "b", None):
        total = bad = 0
        given_up = False
        for i, _, _, failed in sorted((r for r in rows[:600] if r[1] == user), key=lambda r: (r[2], r[0])):
            total, bad = total + 1, bad + failed
            given_up |= total >= fixed.ABORT_AFTER and bad / total > fixed.ABORT_RATE
            assert got[i] == given_up
