from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import fixed, links, routes, urls


def values(spark, items, *columns, schema="id int, x string"):
    df = spark.createDataFrame(list(enumerate(items)), schema)
    return [tuple(r)[1:] for r in df.select("id", *columns).orderBy("id").collect()]


NORMALIZED = [
    ("https://www.site.test/a", "https://site.test/a"), ("http://site.test/a", "https://site.test/a"), ("https://site.test/a?utm_source=x&gclid=1", "https://site.test/a"),
    ("https://site.test/a#b", "https://site.test/a"), ("https://site.test/a/", "https://site.test/a"), ("https://site.test", "https://site.test/"), ("https://SITE.test/CaSe", "https://site.test/CaSe"),
    ("ftp://site.test/a", ""), ("", ""), (None, ""), ("https://site.test//", "https://site.test"), ("https://site.test/a;v=1", "https://site.test/a"), ("http://localhost:80/a", "http://localhost:80/a"),
    ("https://u:p@site.test:8/a", "https://u:p@site.test:8/a"), ("https://[bad/a", None), ("https://site.test/a?b=&c", "https://site.test/a?b=&c="), ("https://site.test/a?z=1&a=%7E+x", "https://site.test/a?a=~+x&z=1"),
]


def test_normalize(spark):
    got = values(spark, [a for a, _ in NORMALIZED], urls.normalize_url(F.col("x")))
    assert [g[0] for g in got] == [b for _, b in NORMALIZED]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "utm_x", "ref", "id"]), st.text("abc-_.~ 1", max_size=4)), max_size=4), st.text("ab/-", max_size=8))
def test_normalize_is_idempotent_and_like_the_standard_library(spark, pairs, path):
    url = "http://www.Site.test/" + path.lstrip("/") + "?" + urlencode(pairs)
    (once,), (twice,) = values(spark, [url], urls.normalize_url(F.col("x"))), values(spark, [url], urls.normalize_url(urls.normalize_url(F.col("x"))))
    assert once == twice
    wanted = sorted((k, v) for k, v in pairs if k not in ("utm_x", "ref"))
    assert parse_qsl(urlsplit(once[0]).query, keep_blank_values=True) == wanted


REASONS = [
    ("", "empty_url"), (None, "malformed_url"), ("ftp://s.test/", "unsupported_scheme"), ("https://t.test/", "external_domain"), ("https://blog.s.test/", "external_domain"), ("https://s.test/a.pdf", "asset_extension"),
    ("https://s.test/static/a", "asset_or_system_path"), ("https://s.test/send.php", "action_endpoint"), ("https://s.test/a?tag=x", "query_policy"), ("https://s.test/" + "a/" * 13, "path_too_deep"),
    ("https://s.test/blog-details", "bare_detail_stub"), ("https://s.test/privateer", "robots_disallowed:/private"), ("https://s.test/ok", "accepted"), ("https://www.s.test/ok", "accepted"), ("https://s.test/static/a.pdf?tag=1", "asset_extension"),
]


def test_reject_reason(spark):
    rules = F.array(F.lit("/private"), F.lit("/privateer"))
    got = values(spark, [a for a, _ in REASONS], urls.reject_reason(F.col("x"), F.lit("s.test"), F.lit(False), rules))
    assert [g[0] for g in got] == [b for _, b in REASONS]


def test_routes_and_scores(spark):
    cases = [("https://s.test/blog/x-y", "sitemap", "Read more", 1, 40 + 32 + 25 + 10 + 8 - 6), ("https://s.test/", "start", None, 0, 100), ("https://s.test/stage", None, "", 2, 10 - 30 - 12), ("https://s.test/a?q=1", "dom", "x", 0, 15 - 25 - 100)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "id int, url string, source string, anchor string, depth int, want int")
    assert [r[0] for r in df.orderBy("id").select(routes.score(F.col("url"), F.col("source"), F.col("anchor"), F.col("depth"), F.lit(False))).collect()] == [c[-1] for c in cases]
    kinds = [("https://s.test/team/jo", "team_detail"), ("https://s.test/stories", "section"), ("https://s.test/events", "section"), ("https://s.test/x/y", "general_detail"), ("https://s.test/vacancy", "section"), ("https://s.test/terms", "legal")]
    assert [g[0] for g in values(spark, [a for a, _ in kinds], routes.classify_route(F.col("x")))] == [b for _, b in kinds]


LINKS = [
    "c", "./c", "../c", "../../c", "../../../c", "../../../../c", "c/./d", "c/../d", "c/..", "c/.", "..", ".", "../", "./", "/c/../d", "/../c", "/./c/.", "../c?x=../y", "c#../d", "c;v=../1", "?y=2", "#f", "", "//t.test/c", "https://t.test/a/../b", "c//d", "d/../../e/",
]


@pytest.mark.parametrize("base", ["https://s.test/a/b/c/d", "https://s.test/a/b/", "https://s.test/", "https://s.test", "https://s.test/a?q=/x/y"])
def test_joined_is_like_the_standard_library(spark, base):
    got = [g[0] for g in values(spark, LINKS, links.joined(F.lit(base), F.col("x")))]
    assert dict(zip(LINKS, got)) == {link: link if "://" in link else urljoin(base, link) for link in LINKS}


def test_an_address_taken_apart_once_gives_the_same_answers(spark):
    every = [a for a, _ in REASONS] + [u for u, _ in NORMALIZED if u] + ["https://s.test/A/b;c=1/d;e=2?x=1&Y=2", "https://s.test/a\nb", "nonsense", "https://u@s.test:1/x"]
    df = urls.with_address(spark.createDataFrame(list(enumerate(every)), "id int, x string"), "at", "x")
    told = lambda u: [urls.reject_reason(u, F.lit("s.test"), F.lit(False), F.array(F.lit("/private"))), routes.classify_route(u), routes.score(u, F.lit("dom"), F.lit("view"), F.lit(1), F.lit(False)), urls.host_of(u), urls.path_of(u), urls.segments(u)]
    once, each = (df.select("id", *[c.alias(f"c{k}") for k, c in enumerate(told(u))]).orderBy("id").collect() for u in (urls.Address(F.col("x"), F.col("at")), F.col("x")))
    assert once == each
    norms = urls.with_normalized(spark.createDataFrame(list(enumerate(every)), "id int, x string"), "norm", F.col("x")).orderBy("id").collect()
    assert [r["norm"] for r in norms] == [g[0] for g in values(spark, every, urls.normalize_url(F.col("x")))]


def test_handlers(spark):
    got = values(spark, ["submitForm2(event, 'a', '', 'jobs')", "viewItem('b', '/x/')", "location.href='/go'"], links.handler_paths(F.col("x")), links.script_targets(F.col("x")))
    assert got == [(["/jobs/a"], []), (["/x/b"], []), ([], ["/go"])]


@pytest.mark.parametrize("table", [fixed.TRACKING_KEYS, fixed.BLOCKED_QUERY_KEYS, fixed.ASSET_EXTENSIONS, fixed.TRACKERS])
def test_fixed_values_are_lower_case_and_distinct(table):
    assert len(set(table)) == len(table) and all(x == x.lower() for x in table)
