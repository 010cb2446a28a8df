"""Queries of the engine's own operators over the whole tables, and the SQL they are compared with.

Queries on literal rows (``VALUES``) are those of operators the tables have no input for, such as raw HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import fixed, links, markdown, routes, text, urls
from pagemill.functions.html import read_page
from pagemill.functions.register import register
from pagemill.operators import dedup, discovery, frontier, jobs
from pagemill.plans import pipeline, samples, sql
from pagemill.shared import materialize, once, spread, table
from pagemill.sources import payloads, requests, robots, sitemaps

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rows(spark: SparkSession, values: samples.Rows) -> DataFrame:
    return spark.sql(values.select())


def _job_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").select("job_id", urls.host_of(F.col("url")).alias("root"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "link_graph").select("job_id", "seq", "parent", "url", "source", "anchor_text").distinct()


_PAGE_SQL = "(SELECT DISTINCT page_id, job_id, seq, url, route_type, title, h1, score, decision, status, main_content_chars FROM page_info)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_info").select("page_id", "job_id", "seq", "url", "route_type", "title", "h1", "score", "decision", "status", "main_content_chars").distinct()


# --- urls ---

@query("url_normalize", f"SELECT page_id, {sql.normalized('url')} AS norm FROM page_info")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "page_info").select("page_id", urls.normalize_url(F.col("url")).alias("norm"))


@query("url_normalize_literals", f"SELECT id, {sql.normalized('url')} AS norm FROM {samples.URLS.sql()}")
def url_normalize_literals(spark, sf_dir):
    return _rows(spark, samples.URLS).select("id", urls.normalize_url(F.col("url")).alias("norm"))


@query("url_host_parts", f"SELECT s.page_id, {sql.host('s.url')} AS host, {sql.host('s.url')} = {sql.host('j.url')} AS same FROM sent_pages s JOIN jobs j USING (job_id)")
def url_host_parts(spark, sf_dir):
    sent = table(spark, sf_dir, "sent_pages").select("page_id", "job_id", "url")
    return sent.join(_job_roots(spark, sf_dir), "job_id").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.same_site(F.col("url"), F.col("root")).alias("same"))


_LINK_SQL = f"(SELECT DISTINCT l.job_id, l.seq, l.parent, l.url, l.source, l.anchor_text, {sql.host('j.url')} AS root, {sql.normalized(f'({sql.joined("l.parent", "l.url")})')} AS norm FROM link_graph l JOIN jobs j USING (job_id))"


_PREFIX_LIST = sorted(p for (p,) in samples.PREFIXES.rows)


@query("url_reject_reason", f"SELECT reason, count(*) AS n FROM (SELECT {sql.reason('norm', 'root', sql.strings(_PREFIX_LIST))} AS reason FROM {_LINK_SQL}) GROUP BY reason")
def url_reject_reason(spark, sf_dir):
    """All links, with the same rules of a robots file for each site."""
    roots = _job_roots(spark, sf_dir).withColumn("disallowed", F.array(*[F.lit(p) for p in _PREFIX_LIST]))
    return frontier.candidates(_links(spark, sf_dir), roots).groupBy("reason").agg(F.count("*").alias("n"))


_REJECTED = f"(SELECT id, root, string_split(rules, ' ') AS rules, {sql.normalized('url')} AS norm FROM {samples.REJECTS.sql()})"


@query("url_reject_literals", f"SELECT id, {sql.reason('norm', 'root', 'rules')} AS reason FROM {_REJECTED}")
def url_reject_literals(spark, sf_dir):
    """Each of the reasons, and several at once."""
    rows = _rows(spark, samples.REJECTS).withColumn("norm", urls.normalize_url(F.col("url")))
    return rows.select("id", urls.reject_reason(F.col("norm"), F.col("root"), F.lit(False), F.split("rules", " ")).alias("reason"))


@query("url_predicates_literals", f"SELECT id, {sql.is_asset('url')} AS asset, {sql.is_system('url')} AS system, {sql.is_action('url')} AS action, {sql.is_stub('url')} AS stub, {sql.is_blocked_query('url')} AS blocked, {sql.is_blocked_query('url', True)} AS blocked_following FROM {samples.CLEAN_URLS.sql()}")
def url_predicates_literals(spark, sf_dir):
    u = F.col("url")
    return _rows(spark, samples.CLEAN_URLS).select("id", urls.is_asset(u).alias("asset"), urls.is_asset_or_system_path(u).alias("system"), urls.is_action_endpoint(u).alias("action"), F.coalesce(urls.is_bare_detail_stub(u), F.lit(False)).alias("stub"), urls.is_blocked_query(u, F.lit(False)).alias("blocked"), urls.is_blocked_query(u, F.lit(True)).alias("blocked_following"))


@query("href_usable", f"SELECT id, coalesce({sql.strip('lower(raw)')} IN {sql.one_of(fixed.PLACEHOLDER_HREFS)}, true) AS placeholder, NOT ({sql.strip("coalesce(raw, '')")} IN ('', '#!', '/') OR contains(coalesce(raw, ''), '{{') OR regexp_matches(lower({sql.strip("coalesce(raw, '')")}), '^({'|'.join(fixed.BLOCKED_SCHEMES)})')) AS usable FROM {samples.HREFS.sql()}")
def href_usable(spark, sf_dir):
    return _rows(spark, samples.HREFS).select("id", urls.is_placeholder_href(F.col("raw")).alias("placeholder"), urls.is_usable_link(F.col("raw")).alias("usable"))


@query("robots_anti_join", f"SELECT page_id FROM (SELECT DISTINCT page_id, url FROM page_info) p WHERE NOT EXISTS (SELECT 1 FROM {samples.PREFIXES.sql()} WHERE starts_with(CASE WHEN regexp_replace(lower({sql.path('p.url')}), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower({sql.path('p.url')}), '/+$', '') END, prefix))")
def robots_anti_join(spark, sf_dir):
    # the prefixes of a site are one small array for each of its rows, so no join of all rows with all prefixes
    prefixes = _rows(spark, samples.PREFIXES).agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
    pages = table(spark, sf_dir, "page_info").select("page_id", "url").distinct().withColumn("k", F.lit(1))
    return pages.join(F.broadcast(prefixes.withColumn("k", F.lit(1))), "k").where(urls.robots_prefix(F.col("url"), F.col("prefixes")).isNull()).select("page_id")


@query("robots_parse", f"""WITH lines AS (SELECT host, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS row FROM {samples.ROBOTS.sql()}),
own AS (SELECT host, row, trim(raw) AS line, CASE WHEN starts_with(lower(trim(raw)), 'user-agent:') THEN trim(regexp_replace(trim(raw), '^[^:]*:', '')) END AS said FROM lines),
seen AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY host ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agent FROM own)
SELECT DISTINCT host, regexp_replace(lower(trim(regexp_replace(line, '^[^:]*:', ''))), '/+$', '') AS prefix FROM seen
WHERE starts_with(lower(line), 'disallow:') AND agent IN {sql.one_of(fixed.ROBOTS_AGENTS)} AND regexp_replace(lower(trim(regexp_replace(line, '^[^:]*:', ''))), '/+$', '') <> ''""")
def robots_parse(spark, sf_dir):
    return robots.disallowed_prefixes(_rows(spark, samples.ROBOTS))


@query("sitemap_locs", f"SELECT url, {sql.normalized('loc')} AS loc FROM (SELECT url, unnest(regexp_extract_all(body, '(?i)<loc>\\s*(.*?)\\s*</loc>', 1)) AS loc FROM {samples.SITEMAPS.sql()})")
def sitemap_locs(spark, sf_dir):
    return _rows(spark, samples.SITEMAPS).select("url", F.explode(sitemaps.locations(F.col("body"))).alias("loc")).select("url", urls.normalize_url(F.col("loc")).alias("loc"))


@query("sitemap_pages", f"""WITH RECURSIVE bases AS (SELECT unnest(['https://site.test', 'https://www.site.test']) AS base, unnest([0, 1]) AS b),
start AS (SELECT base || p AS url, b * 100 + i AS place FROM bases, (SELECT unnest({sql.strings(fixed.SITEMAP_PATHS)}) AS p, unnest(range({len(fixed.SITEMAP_PATHS)})) AS i)),
locs AS (SELECT url AS parent, row, {sql.normalized('loc')} AS url FROM (SELECT url, unnest(regexp_extract_all(body, '(?i)<loc>\\s*(.*?)\\s*</loc>', 1)) AS loc, generate_subscripts(regexp_extract_all(body, '(?i)<loc>\\s*(.*?)\\s*</loc>', 1), 1) AS row FROM {samples.SITEMAPS.sql()})),
read AS (SELECT url, 0 AS level FROM start UNION SELECT l.url, r.level + 1 FROM read r JOIN locs l ON l.parent = r.url WHERE regexp_matches(l.url, '\\.(xml|gz)$') AND r.level < 5),
levels AS (SELECT url, min(level) AS level FROM read GROUP BY url)
SELECT 'site.test' AS root, l.url, arg_max(l.parent, v.level * 1000 + l.row) AS parent FROM locs l JOIN levels v ON v.url = l.parent WHERE l.url <> '' AND NOT regexp_matches(l.url, '\\.(xml|gz)$') AND {sql.host('l.url')} = 'site.test' GROUP BY l.url""")
def sitemap_pages(spark, sf_dir):
    start = spark.sql("SELECT 'https://site.test/' AS url")
    return sitemaps.sitemap_urls(sitemaps.first_sitemaps(start), _rows(spark, samples.SITEMAPS))


@query("tracking_filter", f"SELECT id, (resource IN {sql.one_of(fixed.HEAVY_RESOURCES)} OR len(list_filter({sql.strings(fixed.TRACKERS)}, lambda t: contains(lower(url), t))) > 0) AS dropped FROM {samples.REQUESTS.sql()}")
def tracking_filter(spark, sf_dir):
    return _rows(spark, samples.REQUESTS).select("id", routes.is_dropped_request(F.col("url"), F.col("resource")).alias("dropped"))


# --- routes and candidates ---

@query("route_classify", f"SELECT page_id, {sql.route('url')} AS route, ends_with({sql.route('url')}, '_detail') AS detail FROM page_info")
def route_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "page_info").select("page_id", routes.classify_route(F.col("url")).alias("route"))
    return rows.withColumn("detail", routes.is_detail(F.col("route")))


@query("route_literals", f"SELECT id, {sql.route('url')} AS route, {sql.route('url')} IN {sql.one_of(fixed.DISCOVERY_ROUTES)} AS discovery FROM {samples.CLEAN_URLS.sql()}")
def route_literals(spark, sf_dir):
    rows = _rows(spark, samples.CLEAN_URLS).select("id", routes.classify_route(F.col("url")).alias("route"))
    return rows.withColumn("discovery", routes.is_discovery(F.col("route")))


@query("route_counts", f"SELECT job_id, route_type, count(*) AS n FROM {_PAGE_SQL} WHERE route_type IS NOT NULL GROUP BY job_id, route_type")
def route_counts(spark, sf_dir):
    return jobs.route_counts(_pages(spark, sf_dir)).select("job_id", F.explode("route_type_counts").alias("route_type", "n"))


@query("canonical_generic_parent", f"SELECT id, (lower(own) <> lower(other) AND regexp_matches(other, '(?i)^/({fixed.GENERIC_PARENTS})/?$') AND starts_with(lower(own), lower(other) || '/')) AS generic FROM (SELECT id, CASE WHEN a = '' THEN '/' ELSE a END AS own, CASE WHEN b = '' THEN '/' ELSE b END AS other FROM (SELECT id, regexp_replace({sql.path('url')}, '/+$', '') AS a, regexp_replace({sql.path('canonical')}, '/+$', '') AS b FROM {samples.CANONICALS.sql()}))")
def canonical_generic_parent(spark, sf_dir):
    return _rows(spark, samples.CANONICALS).select("id", routes.is_generic_parent(F.col("url"), F.col("canonical")).alias("generic"))


@query("candidate_score", f"SELECT job_id, seq, {sql.score('norm', 'source', 'anchor_text', '1')} AS score FROM {_LINK_SQL} WHERE norm <> ''")
def candidate_score(spark, sf_dir):
    rows = frontier.candidates(_links(spark, sf_dir), _job_roots(spark, sf_dir)).where("norm <> ''")
    return rows.select("job_id", "seq", (F.col("score") - 6).alias("score"))


_FIRST_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, norm ORDER BY seq) AS place FROM (SELECT job_id, seq, norm, {sql.score('norm', 'source', 'anchor_text', '1')} AS score, {sql.reason('norm', 'root')} AS reason FROM {_LINK_SQL}) WHERE reason = 'accepted' AND score >= {fixed.LEAST_SCORE}) WHERE place = 1)"


@query("link_dedup_first_wins", f"SELECT job_id, norm, seq, score FROM {_FIRST_SQL}")
def link_dedup_first_wins(spark, sf_dir):
    rows = frontier.candidates(_links(spark, sf_dir), _job_roots(spark, sf_dir))
    return frontier.admitted(rows, 1).select("job_id", "norm", "seq", "score")


@query("frontier_topk", f"SELECT job_id, norm, seq, score, place FROM (SELECT job_id, norm, seq, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, seq) AS place FROM {_FIRST_SQL}) WHERE place <= 20")
def frontier_topk(spark, sf_dir):
    """The 20 best candidates of each job: the report of what a crawl would open next."""
    from pyspark.sql import Window

    best = Window.partitionBy("job_id").orderBy(F.desc("score"), "seq")
    rows = link_dedup_first_wins(spark, sf_dir).withColumn("place", F.row_number().over(best)).where("place <= 20")
    return rows.select("job_id", "norm", "seq", "score", "place")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier.candidates(_links(spark, sf_dir), _job_roots(spark, sf_dir)).where("reason = 'accepted'")
    # pages have many links: each is normalised once
    parents = urls.with_normalized(table(spark, sf_dir, "link_graph").select("parent").distinct(), "parent_norm", F.col("parent"))
    return rows.join(parents, "parent").select("job_id", "seq", "parent_norm", "norm", "reason", "score")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").select("job_id", urls.normalize_url(F.col("url")).alias("norm"))


@query("frontier_rounds", f"""WITH RECURSIVE edges AS MATERIALIZED (SELECT DISTINCT job_id, {sql.normalized('parent')} AS parent_norm, norm, {sql.score('norm', 'source', 'anchor_text', '0')} AS score FROM {_LINK_SQL} WHERE {sql.reason('norm', 'root')} = 'accepted'),
reach AS (SELECT job_id, {sql.normalized('url')} AS norm, 0 AS depth FROM jobs UNION SELECT e.job_id, e.norm, r.depth + 1 FROM reach r JOIN edges e ON e.job_id = r.job_id AND e.parent_norm = r.norm WHERE r.depth < 3 AND e.score - 6 * (r.depth + 1) >= {fixed.LEAST_SCORE})
SELECT job_id, norm, min(depth) AS depth FROM reach GROUP BY job_id, norm""")
def frontier_rounds(spark, sf_dir):
    """What three rounds reach, with a budget that does not bind: then a url's depth is its distance from the start."""
    found = frontier.crawl_rounds(_edges(spark, sf_dir), _seeds(spark, sf_dir), max_depth=3, max_pages=1_000_000_000)
    return found.select("job_id", "norm", "depth")


def _crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each job's crawl begins, with its own budget: its start page, then its pages of depth 0 (no link leads from the start page to these)."""
    jobs_ = table(spark, sf_dir, "jobs").select("job_id", "url", "max_pages")
    own = table(spark, sf_dir, "page_info").where("depth = 0").join(jobs_.select("job_id", "max_pages"), "job_id")
    rows = jobs_.select("job_id", "url", F.lit(-(2**40)).alias("seq"), "max_pages").unionByName(own.select("job_id", "url", (F.col("seq") - 2**39).alias("seq"), "max_pages"))
    return once(rows, "norm", urls.normalize_url(F.col("url"))).where(f"norm <> '' or seq = {-(2**40)}").select("job_id", "norm", "seq", "max_pages")


_CRAWL_SEEDS = f"SELECT job_id, norm, seq, max_pages FROM (SELECT job_id, {sql.normalized('url')} AS norm, {-(2**40)} AS seq, max_pages FROM jobs UNION ALL SELECT p.job_id, {sql.normalized('p.url')}, p.seq - {2**39}, j.max_pages FROM page_info p JOIN jobs j USING (job_id) WHERE p.depth = 0) WHERE norm <> '' OR seq = {-(2**40)}"
_CRAWL_EDGES = f"SELECT DISTINCT job_id, seq, {sql.normalized('parent')} AS parent_norm, norm, {sql.score('norm', 'source', 'anchor_text', '0')} AS score FROM {_LINK_SQL} WHERE {sql.reason('norm', 'root')} = 'accepted'"


@query("frontier_crawl", sql.crawl(_CRAWL_EDGES, _CRAWL_SEEDS, 5))
def frontier_crawl(spark, sf_dir):
    """The whole crawl in rounds, from all seeds to depth 5 within each job's budget; frontier_rounds is what its SQL says, the start pages alone."""
    return frontier.crawl_rounds(_edges(spark, sf_dir), _crawl_seeds(spark, sf_dir))


@query("frontier_exact", sql.best_first(_CRAWL_EDGES, _CRAWL_SEEDS, 5))
def frontier_exact(spark, sf_dir):
    return frontier.crawl_exact(materialize(_edges(spark, sf_dir), "edges"), _crawl_seeds(spark, sf_dir))


# --- html ---

@query("links_href", f"SELECT id, unnest(list_filter(regexp_extract_all(html, '(?i)href\\s*=\\s*[''\"]([^''\"]*)[''\"]', 1), lambda x: NOT ({sql.strip('lower(x)')} IN {sql.one_of(fixed.PLACEHOLDER_HREFS)} OR {sql.strip('x')} = '/' OR contains(x, '{{') OR regexp_matches({sql.strip('lower(x)')}, '^({'|'.join(fixed.BLOCKED_SCHEMES)})')))) AS link FROM {samples.HTML.sql()}")
def links_href(spark, sf_dir):
    return _rows(spark, samples.HTML).select("id", F.explode(links.href_links(F.col("html"))).alias("link"))


@query("links_html_regex", f"""SELECT id, link FROM (SELECT id, unnest(list_concat(list_filter(regexp_extract_all(html, 'href=[''"]([^''"]+)[''"]', 1), lambda x: NOT regexp_matches(x, '^(javascript:|mailto:|#)')), regexp_extract_all(html, '"path"\\s*:\\s*"([^"]+)"', 1), regexp_extract_all(html, '"url"\\s*:\\s*"(https?://[^"]+)"', 1), regexp_extract_all(html, '[''"](/[a-zA-Z0-9\\-_][a-zA-Z0-9\\-_/]*)[''"]', 1))) AS link FROM {samples.HTML.sql()})
WHERE NOT ({sql.strip('lower(link)')} IN {sql.one_of(fixed.PLACEHOLDER_HREFS)} OR {sql.strip('link')} = '/' OR contains(link, '{{') OR regexp_matches({sql.strip('lower(link)')}, '^({'|'.join(fixed.BLOCKED_SCHEMES)})') OR {sql.is_asset('link')})""")
def links_html_regex(spark, sf_dir):
    return _rows(spark, samples.HTML).select("id", F.explode(links.source_links(F.col("html"))).alias("link"))


@query("links_onclick", f"SELECT id, unnest({sql.handler_paths('onclick')}) AS link FROM {samples.ONCLICK.sql()}")
def links_onclick(spark, sf_dir):
    return _rows(spark, samples.ONCLICK).select("id", F.explode(links.handler_paths(F.col("onclick"))).alias("link"))


@query("links_joined", f"SELECT id, {sql.joined('base', 'link')} AS url FROM {samples.JOINS.sql()}")
def links_joined(spark, sf_dir):
    return _rows(spark, samples.JOINS).select("id", links.joined(F.col("base"), F.col("link")).alias("url"))


@query("link_baseline_difference", f"SELECT l.job_id, l.norm, count(*) AS n FROM {_LINK_SQL} l WHERE l.source LIKE '%click%' AND l.norm <> '' AND NOT EXISTS (SELECT 1 FROM {_LINK_SQL} b WHERE b.source NOT LIKE '%click%' AND b.job_id = l.job_id AND b.norm = l.norm) GROUP BY l.job_id, l.norm")
def link_baseline_difference(spark, sf_dir):
    """Links that only clicks reveal: those the page itself, or a sitemap, has not."""
    rows = frontier.candidates(_links(spark, sf_dir), _job_roots(spark, sf_dir)).where("norm <> ''").select("job_id", "norm", "source")
    base = rows.where("source NOT LIKE '%click%'").select("job_id", "norm")
    return rows.where("source LIKE '%click%'").join(base, ["job_id", "norm"], "left_anti").groupBy("job_id", "norm").agg(F.count("*").alias("n"))


@query("page_title_h1", f"""SELECT id, title, h1, CASE WHEN h1 <> '' THEN h1 ELSE title END AS effective_title FROM (SELECT id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\\s*<[^>]*>\\s*', '', 'g')) AS h1 FROM {samples.HTML.sql()})""")
def page_title_h1(spark, sf_dir):
    rows = _rows(spark, samples.HTML).withColumn("page", read_page("html", "url")).select("id", "page.title", "page.h1")
    return rows.withColumn("effective_title", F.coalesce(F.nullif("h1", F.lit("")), "title"))


def _tag_sql(pattern: str) -> str:
    return sql.plain_text(f"regexp_extract(html, '(?is){pattern}', 1)")


_HEAD_SQL = ", ".join(f"nullif({_tag_sql(p)}, '')" for p in ("<h1[^>]*>(.*?)</h1>", '<h2[^>]*class=.page_title.[^>]*>(.*?)</h2>', '<h3[^>]*class=.post_title.[^>]*>(.*?)</h3>', "<h2[^>]*>(.*?)</h2>", "<h3[^>]*>(.*?)</h3>"))
_DATA_SQL = "regexp_extract(html, '(?is)<script type=.application/ld.json.>(.*?)</script>', 1)"
_NEXT_SQL = "regexp_extract(html, '(?is)<script id=.__NEXT_DATA__.>(.*?)</script>', 1)"


@query("page_meta", f"""SELECT id, coalesce({_HEAD_SQL}, '') AS best_heading, CASE WHEN canonical = '' THEN '' ELSE {sql.joined('url', 'canonical')} END AS canonical_url, CASE WHEN refresh = '' THEN '' ELSE {sql.joined('url', 'refresh')} END AS refresh_url, '' AS og_url,
array_to_string(list_concat(list_filter([json_extract_string(data, '$."@id"'), coalesce(json_extract_string(data, '$.mainEntityOfPage."@id"'), json_extract_string(data, '$.mainEntityOfPage.url'))], lambda x: starts_with(x, 'http')), list_transform(list_filter([json_extract_string(next, '$.a.path')], lambda x: starts_with(x, '/')), lambda x: regexp_extract(url, '^[a-z]+://[^/]*') || x)), ' ') AS data_urls
FROM (SELECT id, url, html, regexp_extract(html, '(?i)<link rel="canonical" href="([^"]*)"', 1) AS canonical, trim(regexp_extract(html, '(?i)http-equiv="refresh" content="[^"]*url=([^"]*)"', 1), chr(39)) AS refresh, nullif({_DATA_SQL}, '')::JSON AS data, nullif({_NEXT_SQL}, '')::JSON AS next FROM {samples.HTML.sql()})""")
def page_meta(spark, sf_dir):
    return _rows(spark, samples.HTML).withColumn("page", read_page("html", "url")).select("id", "page.best_heading", "page.canonical_url", "page.refresh_url", "page.og_url", F.array_join("page.data_urls", " ").alias("data_urls"))


_LINK_PAIRS = " UNION ALL ".join(f"SELECT id, url, unnest(list_zip(regexp_extract_all(html, '{p}', 1), regexp_extract_all(html, '{p}', 2))) AS x, generate_subscripts(regexp_extract_all(html, '{p}', 1), 1) + {k} AS k FROM {samples.HTML.sql()}" for k, p in ((0, "(?is)<a[^>]*\\shref=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"), (1000, "(?is)<[a-z]+[^>]*\\sdata-href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</")))


@query("page_links", f"SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS place, {sql.joined('url', 'link')} AS url, 'dom_post_interaction' AS source, {sql.plain_text('text')} AS text FROM (SELECT id, url, k, x[1] AS link, x[2] AS text FROM ({_LINK_PAIRS})) WHERE {sql.usable('link')}")
def page_links(spark, sf_dir):
    return _rows(spark, samples.HTML).withColumn("page", read_page("html", "url")).select("id", F.posexplode("page.links").alias("place", "link")).select("id", "place", "link.*")


@query("page_content")
def page_content(spark, sf_dir):
    return _rows(spark, samples.HTML).withColumn("page", read_page("html", "url")).select("id", "page.markdown", "page.selector", "page.main_content_chars")


_ANCHOR_SQL = f"(SELECT id, url, unnest(list_filter(regexp_extract_all(html, '(?is)(?:<a[^>]*\\shref|data-href)=[\"'']([^\"'']*)[\"'']', 1), lambda x: x <> '' AND {sql.usable('x')})) AS link FROM {samples.HTML.sql()})"


@query("page_links_sql", f"SELECT id, {sql.joined('url', 'link')} AS url FROM {_ANCHOR_SQL}")
def page_links_sql(spark, sf_dir):
    """The links of pages by the table function in SQL."""
    register(spark)
    _rows(spark, samples.HTML).createOrReplaceTempView("pagemill_html")
    return spark.sql("SELECT h.id, l.url FROM pagemill_html h, LATERAL explode_links(h.html, h.url) l")


@query("heading_probe", f"""SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS place, tag, text, class FROM (SELECT id, k, regexp_extract(head, '^<([a-z0-9]+)', 1) AS tag, substr({sql.plain_text("regexp_replace(regexp_replace(head, '</?(b|i)>', '', 'g'), '^<[^>]*>|</[a-z0-9]+>$', '', 'g')")}, 1, 120) AS text, regexp_extract(head, '^<[^>]*class=.([^\"'']*)', 1) AS class
FROM (SELECT id, unnest(regexp_extract_all(html, '(?is)<h[1-4][^>]*>.*?</h[1-4]>')) AS head, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-4][^>]*>.*?</h[1-4]>'), 1) AS k FROM {samples.HTML.sql()}))""")
def heading_probe(spark, sf_dir):
    register(spark)
    return _rows(spark, samples.HTML).select("id", F.posexplode(F.call_function("headings", "html")).alias("place", "heading")).select("id", "place", "heading.*")


@query("spa_routes", f"SELECT id, {sql.joined(sql.q('https://s.test/p/q'), 'path')} AS url FROM (SELECT s.id, t.value ->> '$' AS path FROM {samples.STATES.sql()} s, json_tree(CASE WHEN json_valid(s.state) THEN s.state END) t WHERE t.type = 'VARCHAR') WHERE starts_with(path, '/')")
def spa_routes(spark, sf_dir):
    register(spark)
    rows = _rows(spark, samples.STATES)
    return rows.select("id", F.explode(F.call_function("spa_routes", "state", F.lit("https://s.test/p/q"))).alias("url"))


_JUDGED_SQL = sql.quality("md", "title", "chars", "route")
_SIGNED_SQL = f"""(SELECT *, row_number() OVER (ORDER BY seq) AS n, {sql.signature('md')} AS sig, lower(title) || '|' || lower(h1) AS meta, CASE WHEN link IS NOT NULL AND {sql.normalized(f"({sql.joined('url', 'link')})")} <> norm THEN {sql.normalized(f"({sql.joined('url', 'link')})")} END AS canonical FROM judged WHERE reason = 'ok')"""


@query("page_decisions", f"""WITH RECURSIVE once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY seq) AS place FROM (SELECT *, {sql.normalized('url')} AS norm FROM {samples.CRAWLED.sql()})) WHERE place = 1 AND norm <> ''),
read AS (SELECT seq, url, norm, http_status, {sql.route('norm')} AS route, coalesce(nullif(h1, ''), {_tag_sql("<title>(.*?)</title>")}) AS title, h1, trim(regexp_replace(bare, '<[^>]*>', ' ', 'g')) || coalesce(chr(10) || chr(10) || revealed_text, '') AS md, length({sql.plain_text('bare')}) AS chars, nullif(regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1), '') AS link
FROM (SELECT *, {_tag_sql("<h1>(.*?)</h1>")} AS h1, regexp_replace(html, '(?is)<title>.*?</title>', '') AS bare FROM once)),
judged AS MATERIALIZED (SELECT *, CASE WHEN http_status >= 400 THEN 'http_' || http_status ELSE {_JUDGED_SQL} END AS reason FROM read),
fold AS (SELECT 0::BIGINT AS n, 0 AS seq, NULL::VARCHAR AS gate, []::VARCHAR[] AS held, []::STRUCT(sig VARCHAR, url VARCHAR, meta VARCHAR)[] AS contents UNION ALL
SELECT n, seq, gate, CASE WHEN starts_with(gate, 'duplicate_canonical') THEN held ELSE list_concat(held, [norm, coalesce(canonical, norm)]) END, CASE WHEN starts_with(gate, 'duplicate_canonical') OR first IS NOT NULL THEN contents ELSE list_append(contents, {{'sig': sig, 'url': norm, 'meta': meta}}) END
FROM (SELECT *, CASE WHEN list_contains(held, canonical) THEN 'duplicate_canonical:' || canonical WHEN first IS NULL THEN 'ok' WHEN NOT ends_with(route, '_detail') THEN 'duplicate_content:' || first.url WHEN first.meta = meta THEN 'duplicate_content_and_title:' || first.url ELSE 'ok' END AS gate
FROM (SELECT g.*, f.held, f.contents, list_filter(f.contents, lambda x: x.sig = g.sig)[1] AS first FROM fold f JOIN {_SIGNED_SQL} g ON g.n = f.n + 1)))
SELECT seq, CASE WHEN starts_with(reason, 'http_') THEN 'PAGE_ERROR' WHEN reason <> 'ok' THEN 'SKIP_LOW_QUALITY' WHEN gate <> 'ok' THEN 'SKIP_DUPLICATE' ELSE 'SEND' END AS decision, CASE WHEN reason <> 'ok' THEN reason ELSE gate END AS reason FROM judged LEFT JOIN (SELECT seq, gate FROM fold WHERE n > 0) USING (seq)""")
def page_decisions(spark, sf_dir):
    """The whole way of a job's pages from HTML to a decision."""
    return pipeline.decide(_rows(spark, samples.CRAWLED)).select(F.col("seq").cast("int").alias("seq"), "decision", "reason")


@query("job_requests", f"""SELECT id, CASE WHEN body IS NOT NULL THEN coalesce((body ->> '$.max_pages')::INT, 300) END AS max_pages, CASE WHEN body IS NULL THEN 'body' ELSE array_to_string(list_filter([CASE WHEN NOT regexp_matches(coalesce(body ->> '$.url', ''), '^https?://') THEN 'url' END, CASE WHEN coalesce(body ->> '$.tenant_id', '') = '' THEN 'tenant_id' END, CASE WHEN coalesce(body ->> '$.agent_id', '') = '' THEN 'agent_id' END,
{", ".join(f"CASE WHEN coalesce((body ->> '$.{n}')::INT, {d}) NOT BETWEEN {low} AND {high} THEN '{n}' END" for n, (d, low, high) in requests.NUMBERS.items())}], lambda x: x IS NOT NULL), ' ') END AS faults FROM {samples.REQUEST_BODIES.sql()}""")
def job_requests(spark, sf_dir):
    rows = requests.read_requests(_rows(spark, samples.REQUEST_BODIES))
    return rows.select("id", "request.max_pages", F.array_join("faults", " ").alias("faults"))


_REGIONS_SQL = " || ".join(f"CASE WHEN {r} = '' THEN '' ELSE '|' || {r} END" for r in (rf"trim(regexp_replace(regexp_extract(html, '(?is)<{t}[\s>].*?</{t}>'), '\s+', ' ', 'g'))" for t in ("nav", "header", "footer")))


@query("nav_fingerprint_first", f"SELECT id, length(own) < 21 OR row_number() OVER (PARTITION BY own ORDER BY id) = 1 AS is_first FROM (SELECT id, {_REGIONS_SQL} AS own FROM {samples.HTML.sql()})")
def nav_fingerprint_first(spark, sf_dir):
    rows = _rows(spark, samples.HTML).withColumn("job_id", F.lit("j")).withColumn("fingerprint", links.nav_fingerprint(F.col("html")))
    return dedup.first_fingerprints(rows, ["job_id"], "fingerprint", "id").select("id", "is_first")


# --- text ---

@query("text_signature", f"SELECT doc_id, {sql.signature('text')} AS sig, sha256(text) AS hash FROM documents")
def text_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_signature(F.col("text")).alias("sig"), text.content_hash(F.col("text")).alias("hash"))


@query("hash_check", "SELECT page_id, CASE WHEN content_hash IS NULL THEN 'none' WHEN content_hash = sha256(markdown) THEN 'same' WHEN lower(trim(regexp_replace(content_hash, '^sha256[:-]', ''))) = sha256(markdown) THEN 'same, written differently' ELSE 'other' END AS told FROM sent_pages")
def hash_check(spark, sf_dir):
    told, own = F.col("content_hash"), text.content_hash(F.col("markdown"))
    plain = F.lower(F.trim(F.regexp_replace(told, "^sha256[:-]", "")))
    return table(spark, sf_dir, "sent_pages").select("page_id", F.when(told.isNull(), "none").when(told == own, "same").when(plain == own, "same, written differently").otherwise("other").alias("told"))


@query("text_normalize", f"SELECT page_id, {sql.compared('title')} AS plain FROM sent_pages")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "sent_pages").select("page_id", text.compared(F.col("title")).alias("plain"))


@query("md_spacing", f"SELECT page_id, sha256({sql.spacing('markdown')}) AS spaced FROM sent_pages")
def md_spacing(spark, sf_dir):
    return table(spark, sf_dir, "sent_pages").select("page_id", F.sha2(text.spacing(F.col("markdown")), 256).alias("spaced"))


@query("md_line_noise", f"SELECT page_id, count(*) AS lines, count(*) FILTER (WHERE NOT {sql.kept('line')}) AS noise FROM (SELECT page_id, {sql.strip('raw')} AS line FROM (SELECT page_id, unnest(string_split(markdown, chr(10))) AS raw FROM sent_pages)) GROUP BY page_id")
def md_line_noise(spark, sf_dir):
    own = F.transform(text.lines(F.col("markdown")), urls.strip)
    rows = spread(table(spark, sf_dir, "sent_pages").select("page_id", "markdown"))
    return rows.select("page_id", F.size(own).alias("lines"), (F.size(own) - F.size(text.kept_lines(own))).alias("noise"))


@query("md_line_dedup", f"SELECT page_id, count(*) FILTER (WHERE length(k) < 4 OR place = 1) AS kept FROM (SELECT page_id, k, row_number() OVER (PARTITION BY page_id, k ORDER BY row) AS place FROM (SELECT page_id, {sql.compared('raw')} AS k, row FROM (SELECT page_id, unnest(string_split(markdown, chr(10))) AS raw, generate_subscripts(string_split(markdown, chr(10)), 1) AS row FROM sent_pages))) GROUP BY page_id")
def md_line_dedup(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "sent_pages").select("page_id", "markdown"))
    return rows.select("page_id", F.size(text.lines(text.without_repeated_lines(F.col("markdown")))).alias("kept"))


@query("md_heading_collapse", f"""WITH lines AS (SELECT id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS row FROM {samples.MARKDOWN.sql()}),
heads AS (SELECT id, row, {sql.compared("regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)")} AS h FROM lines WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')),
gone AS (SELECT id, row FROM (SELECT *, lag(h) OVER (PARTITION BY id ORDER BY row) AS before FROM heads) WHERE h <> '' AND h = before)
SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.row) AS text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = l.id AND g.row = l.row) GROUP BY l.id""")
def md_heading_collapse(spark, sf_dir):
    return _rows(spark, samples.MARKDOWN).select("id", text.without_repeated_headings(F.col("md")).alias("text"))


@query("md_preprocess_report")
def md_preprocess_report(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "sent_pages").select("page_id", "markdown"))
    rows = markdown.with_cleaned(rows, "markdown", "done")
    return rows.select("page_id", F.sha2("done.text", 256).alias("text_hash"), "done.report.*")


_QUALITY = sql.quality("s.markdown", "s.title", "s.crawler_report.main_content_chars", "s.crawler_report.route_type")


def _judged(spark, sf_dir):
    rows = table(spark, sf_dir, "sent_pages").select("page_id", "markdown", "title", F.col("crawler_report.main_content_chars").alias("chars"), F.col("crawler_report.route_type").alias("route"))
    return spread(rows).select("page_id", text.quality_reason(F.col("markdown"), F.col("title"), F.col("chars"), F.col("route")).alias("reason"))


@query("quality_gate", f"SELECT page_id, {_QUALITY} AS reason FROM sent_pages s")
def quality_gate(spark, sf_dir):
    return _judged(spark, sf_dir)


@query("quality_reason_counts", f"SELECT reason, count(*) AS n FROM (SELECT split_part({_QUALITY}, ':', 1) AS reason FROM sent_pages s) GROUP BY reason")
def quality_reason_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query("job_content_words", f"SELECT doc_id, ({' + '.join(f'CASE WHEN contains(lower(text), {sql.q(w)}) THEN 1 ELSE 0 END' for w in fixed.JOB_WORDS)}) >= {fixed.LEAST_JOB_WORDS} AS job FROM documents")
def job_content_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_job_content(F.col("text")).alias("job"))


# --- duplicates ---

def _gate_rows(spark, sf_dir):
    """Sent pages with their content signature, in the order of page_info, one row for each url of a job."""
    sent = table(spark, sf_dir, "sent_pages").select("page_id", text.content_signature(F.col("markdown")).alias("sig"))
    rows = _pages(spark, sf_dir).join(sent, "page_id").withColumn("url", urls.normalize_url(F.col("url"))).where("url <> ''")
    meta = F.concat(urls.strip(F.lower(F.coalesce("title", F.lit("")))), F.lit("|"), urls.strip(F.lower(F.coalesce("h1", F.lit("")))))
    rows = rows.select("job_id", "seq", "page_id", "url", "sig", meta.alias("meta"), F.coalesce(F.endswith("route_type", F.lit("_detail")), F.lit(False)).alias("is_detail"))
    return dedup.first_by(rows, ["job_id", "url"], ["seq", "page_id"])


_GATE_SQL = f"""(SELECT * FROM (SELECT p.job_id, p.seq, p.page_id, {sql.normalized('p.url')} AS url, {sql.signature('s.markdown')} AS sig, {sql.strip("lower(coalesce(p.title, ''))")} || '|' || {sql.strip("lower(coalesce(p.h1, ''))")} AS meta, coalesce(ends_with(p.route_type, '_detail'), false) AS is_detail,
row_number() OVER (PARTITION BY p.job_id, {sql.normalized('p.url')} ORDER BY p.seq, p.page_id) AS place FROM {_PAGE_SQL} p JOIN sent_pages s USING (page_id)) WHERE place = 1 AND url <> '')"""


@query("dedup_content", f"""SELECT job_id, seq, CASE WHEN n > 1 AND NOT is_detail THEN 'duplicate_content:' || first_url WHEN n > 1 AND meta = first_meta THEN 'duplicate_content_and_title:' || first_url ELSE 'ok' END AS reason
FROM (SELECT *, row_number() OVER w AS n, first_value(url) OVER w AS first_url, first_value(meta) OVER w AS first_meta FROM {_GATE_SQL} WINDOW w AS (PARTITION BY job_id, sig ORDER BY seq))""")
def dedup_content(spark, sf_dir):
    return dedup.content_reasons(_gate_rows(spark, sf_dir)).select("job_id", "seq", "reason")


@query("dedup_canonical", f"""WITH RECURSIVE pages AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM {samples.GATE.sql()}),
fold AS (SELECT 0::BIGINT AS n, 0 AS seq, NULL::VARCHAR AS reason, []::VARCHAR[] AS held UNION ALL
SELECT p.n, p.seq, CASE WHEN list_contains(f.held, p.canonical) THEN 'duplicate_canonical:' || p.canonical END, CASE WHEN list_contains(f.held, p.canonical) THEN f.held ELSE list_concat(f.held, [p.url, coalesce(p.canonical, p.url)]) END FROM fold f JOIN pages p ON p.n = f.n + 1)
SELECT seq, reason FROM fold WHERE reason IS NOT NULL""")
def dedup_canonical(spark, sf_dir):
    rows = _rows(spark, samples.GATE).withColumn("job_id", F.lit("j")).withColumn("seq", F.col("seq").cast("long"))
    return dedup.canonical_rejects(rows).select(F.col("seq").cast("int").alias("seq"), "reason")


# --- jobs ---

_COUNT_SQL = """(SELECT job_id, count(*) AS crawled, count(*) FILTER (WHERE decision = 'SEND' AND status = 'completed') AS sent, count(*) FILTER (WHERE status = 'failed_send') AS failed_sends,
count(*) FILTER (WHERE decision = 'SKIP_DUPLICATE') AS skipped_duplicates, count(*) FILTER (WHERE decision = 'SKIP_LOW_QUALITY') AS skipped_quality, count(*) FILTER (WHERE decision = 'PAGE_ERROR') AS page_errors,
count(*) FILTER (WHERE decision IS NOT NULL OR status IS NOT NULL) AS finished
FROM (SELECT DISTINCT * FROM page_info) GROUP BY job_id)"""


@query("job_stats", f"SELECT * FROM {_COUNT_SQL}")
def job_stats(spark, sf_dir):
    return jobs.page_counters(table(spark, sf_dir, "page_info"))


@query("discovered_counts", f"SELECT job_id, count(DISTINCT norm) AS discovered FROM (SELECT job_id, {sql.normalized('url')} AS norm FROM page_info) WHERE norm <> '' GROUP BY job_id")
def discovered_counts(spark, sf_dir):
    rows = urls.with_normalized(table(spark, sf_dir, "page_info").select("job_id", "url"), "norm", F.col("url"))
    return jobs.discovered(rows, "norm")


@query("final_status", f"SELECT job_id, CASE WHEN sent + failed_sends >= {fixed.ABORT_AFTER} AND failed_sends / (sent + failed_sends) > {fixed.ABORT_RATE} THEN 'FAILED' WHEN failed_sends > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM {_COUNT_SQL}")
def final_status(spark, sf_dir):
    return job_stats(spark, sf_dir).select("job_id", jobs.final_status(F.col("failed_sends"), F.col("sent")).alias("status"))


@query("job_progress", f"SELECT j.job_id, coalesce(c.crawled, 0) AS pages, j.crawled, date_diff('second', j.created_at, coalesce(j.completed_at, j.updated_at)) AS elapsed FROM jobs j LEFT JOIN {_COUNT_SQL} c USING (job_id)")
def job_progress(spark, sf_dir):
    counts = job_stats(spark, sf_dir).select("job_id", F.col("crawled").alias("pages"))
    # whole seconds are counted between the starts of seconds
    whole = lambda c: F.floor(jobs.micros(c) / 1_000_000)
    rows = table(spark, sf_dir, "jobs").join(counts, "job_id", "left")
    return rows.select("job_id", F.coalesce("pages", F.lit(0)).alias("pages"), "crawled", (whole(F.coalesce("completed_at", "updated_at")) - whole(F.col("created_at"))).alias("elapsed"))


@query("health", f"SELECT count(*) FILTER (WHERE status IN {sql.one_of(fixed.ACTIVE_STATUSES)}) AS active_jobs, count(*) AS total_jobs, count(*) FILTER (WHERE status IN {sql.one_of(fixed.ACTIVE_STATUSES)}) < {fixed.MOST_ACTIVE} AS admits FROM jobs")
def health(spark, sf_dir):
    return jobs.health(table(spark, sf_dir, "jobs"))


@query("pages_listing", "SELECT page_id, decision, score FROM (SELECT DISTINCT * FROM page_info WHERE decision = 'SEND') ORDER BY CASE WHEN decision = 'SEND' THEN 0 ELSE 1 END, coalesce(score, 0) DESC, seq, page_id LIMIT 100 OFFSET 100")
def pages_listing(spark, sf_dir):
    """The second page of the list of sent pages."""
    return jobs.listing(table(spark, sf_dir, "page_info"), decision="SEND", page=2, page_size=100).select("page_id", "decision", "score")


@query("pages_total", "SELECT count(*) AS total, ceil(count(*) / 100)::BIGINT AS pages FROM (SELECT DISTINCT * FROM page_info WHERE decision = 'SEND')")
def pages_total(spark, sf_dir):
    """How many rows, and pages of the list, there are of sent pages."""
    return jobs.listing_total(table(spark, sf_dir, "page_info"), decision="SEND", page_size=100)


_REJECT_COUNT = f"SELECT job_id, count(*) FILTER (WHERE reason <> 'accepted') AS rejected FROM (SELECT job_id, {sql.reason('norm', 'root')} AS reason FROM {_LINK_SQL} WHERE norm <> '') GROUP BY job_id"


@query("rejected_urls", _REJECT_COUNT)
def rejected_urls(spark, sf_dir):
    """Links turned away in each job, counted as often as they were met."""
    rows = frontier.candidates(_links(spark, sf_dir), _job_roots(spark, sf_dir)).where("norm <> ''")
    return rows.groupBy("job_id").agg(F.count_if(F.col("reason") != "accepted").alias("rejected"))


_OFFERS = "(SELECT *, CASE source WHEN 'nav_hover' THEN 0 WHEN 'click_revealed' THEN 1 WHEN 'nav_click_revealed' THEN 1 WHEN 'card_click_revealed' THEN 1 WHEN 'popup_click_revealed' THEN 1 WHEN 'hash_nav' THEN 2 WHEN 'spa_routing' THEN 3 WHEN 'onclick_attr' THEN 4 WHEN 'html_regex' THEN 6 WHEN 'html_pattern' THEN 6 WHEN 'json_ld' THEN 7 WHEN 'meta_refresh' THEN 8 ELSE 5 END AS stage FROM (SELECT DISTINCT job_id, seq, parent, url, source FROM link_graph))"


@query("stage_order_first", f"SELECT job_id, norm, parent, source FROM (SELECT *, row_number() OVER (PARTITION BY job_id, norm ORDER BY visit, stage, seq, url, source) AS place FROM (SELECT o.job_id, o.parent, o.source, o.stage, o.seq, o.url, v.visit, {sql.normalized(f'({sql.joined("o.parent", "o.url")})')} AS norm FROM {_OFFERS} o JOIN (SELECT job_id, parent, min(seq) AS visit FROM link_graph GROUP BY job_id, parent) v USING (job_id, parent)) WHERE norm <> '') WHERE place = 1")
def stage_order_first(spark, sf_dir):
    """Who offers each address first, when a page's stages come in their order: the union of the streams of candidates."""
    stage_of = {"nav_hover": "nav_hover", "click_revealed": "click", "nav_click_revealed": "click", "card_click_revealed": "click", "popup_click_revealed": "click", "hash_nav": "hash", "spa_routing": "spa", "onclick_attr": "onclick", "html_regex": "html", "html_pattern": "html", "json_ld": "json_ld", "meta_refresh": "meta_refresh"}
    rows = table(spark, sf_dir, "link_graph").select("job_id", F.col("parent").alias("page"), F.col("seq").alias("row"), "url", "source", F.lit("").alias("text")).distinct()
    visits = rows.groupBy("job_id", "page").agg(F.min("row").alias("visit"))
    names = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in stage_of.items() for x in pair]), F.coalesce("source", F.lit(""))), F.lit("dom"))
    rows = materialize(rows.withColumn("name", names), "offers")
    ordered = discovery.in_stage_order({name: rows.where(F.col("name") == name) for name in fixed.STAGES})
    joined = ordered.withColumn("url", links.joined(F.col("page"), F.col("url"))).join(visits, ["job_id", "page"])
    return discovery.first_offers(joined).select("job_id", "norm", F.col("page").alias("parent"), "source")


_CLICK_SQL = f"(SELECT *, trim(lower(coalesce(text, ''))[1:120]) || ' ' || lower(coalesce(aria_label, ''))[1:80] AS raw FROM {samples.CONTROLS.sql()})"


@query("clicked_controls", f"""SELECT row, label FROM (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY row) AS again FROM (SELECT *, trim(raw) AS label FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY row) AS place FROM {_CLICK_SQL})
WHERE place <= 7 AND visible AND NOT in_nav) WHERE NOT ({' OR '.join(f"contains(label, {sql.q(w)})" for w in fixed.NOISE_LABELS)})) WHERE again = 1""")
def clicked_controls(spark, sf_dir):
    rows = _rows(spark, samples.CONTROLS).withColumn("job_id", F.lit("j")).withColumn("buttons", F.lit(7)).withColumn("skip_nav", F.lit(True))
    return discovery.clicked(rows).select("row", "label")


@query("stage_limits", f"""SELECT page_id, depth <= {fixed.CLICK_DEPTH} AS click, CASE WHEN depth > {fixed.CLICK_DEPTH} THEN 0 WHEN ends_with(route, '_detail') THEN {fixed.DETAIL_BUTTONS} ELSE {fixed.MOST_BUTTONS} END AS buttons, route IN {sql.one_of(fixed.DISCOVERY_ROUTES)} AND depth <= {fixed.MENU_DEPTH} AS hover, depth <= {fixed.CLICK_DEPTH} AND NOT ends_with(route, '_detail') AS hash
FROM (SELECT DISTINCT page_id, depth, {sql.route('url')} AS route FROM page_info) WHERE depth IS NOT NULL""")
def stage_limits(spark, sf_dir):
    """What may be done on each page, by its route and depth."""
    rows = table(spark, sf_dir, "page_info").where("depth is not null").select("page_id", "depth", routes.classify_route(F.col("url")).alias("route")).distinct()
    rows = rows.withColumn("may", discovery.stage_limits(F.col("route"), F.col("depth"), F.lit(False)))
    return rows.select("page_id", "may.click", "may.buttons", "may.hover", "may.hash")


_ETA_SQL = """CASE WHEN crawled < 1 OR status = 'QUEUED' THEN NULL WHEN status IN ('COMPLETED', 'COMPLETED_WITH_ERRORS', 'FAILED') THEN 0 WHEN total - crawled <= 0 THEN NULL
ELSE floor((total - crawled) / greatest(greatest(1, floor(crawled * 3 / 10)) / greatest(elapsed * 0.5::DOUBLE, 1) * 0.6::DOUBLE + crawled / greatest(elapsed * 1::DOUBLE, 1) * 0.4::DOUBLE, 0.02::DOUBLE)) END::BIGINT"""


@query("eta_status", f"SELECT job_id, {_ETA_SQL} AS eta FROM (SELECT *, CASE WHEN discovered > crawled THEN least(max_pages, discovered) ELSE max_pages END AS total, date_diff('second', created_at, updated_at) AS elapsed FROM jobs)")
def eta_status(spark, sf_dir):
    whole = lambda c: F.floor(jobs.micros(c) / 1_000_000)
    rows = table(spark, sf_dir, "jobs").withColumn("elapsed", whole("updated_at") - whole("created_at"))
    return rows.select("job_id", jobs.status_eta(F.col("status"), F.col("crawled"), F.col("discovered"), F.col("max_pages"), F.col("elapsed")).alias("eta"))


@query("eta_engine", f"""SELECT id, CASE WHEN lefts = 0 THEN 0 ELSE floor(lefts / greatest(CASE WHEN recent >= 3 AND elapsed > 10 THEN recent / greatest(span * 1::DOUBLE, 1) ELSE greatest(crawled, 1) / greatest(elapsed * 1::DOUBLE, 1) END, 0.01::DOUBLE) *
CASE WHEN greatest(crawled, 1) > 10 AND queue < 20 THEN 0.7::DOUBLE WHEN greatest(crawled, 1) < 5 THEN 1.5::DOUBLE ELSE 1::DOUBLE END) END::BIGINT AS eta FROM (SELECT *, queue + greatest(0, max_pages - greatest(crawled, 1)) AS lefts FROM {samples.ETAS.sql()})""")
def eta_engine(spark, sf_dir):
    c = F.col
    return _rows(spark, samples.ETAS).select("id", jobs.engine_eta(c("queue"), c("crawled"), c("max_pages"), c("recent"), c("span"), c("elapsed")).alias("eta"))


@query("rolling_60s_rate", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def rolling_60s_rate(spark, sf_dir):
    return jobs.rolling_rate(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "event_id", "recent")


@query("circuit_breaker", f"""SELECT user_id, event_id, max(tripped) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS aborted FROM (SELECT *, count(*) OVER w >= {fixed.ABORT_AFTER} AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / count(*) OVER w > {fixed.ABORT_RATE} AS tripped
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def circuit_breaker(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return jobs.circuit_breaker(rows, "user_id", ["ts", "event_id"], "failed").select("user_id", "event_id", "aborted")


@query("rate_limit", """WITH RECURSIVE ordered AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold AS (SELECT user_id, n, event_id, true AS accepted, t AS last FROM ordered WHERE n = 1 UNION ALL
SELECT o.user_id, o.n, o.event_id, o.t - f.last >= 86400000000, CASE WHEN o.t - f.last >= 86400000000 THEN o.t ELSE f.last END FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id AS request_id, user_id, accepted FROM fold""")
def rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    return jobs.rate_limit(rows, "user_id", "ts", max_requests=1, seconds=86_400)


@query("send_retry_outcome", f"""WITH a AS (SELECT DISTINCT * FROM send_attempts), stops AS (SELECT req_id, coalesce(min(CASE WHEN status NOT IN {sql.one_of(fixed.RETRIED_STATUSES)} THEN attempt END), {fixed.MOST_ATTEMPTS}) AS stop FROM a GROUP BY req_id)
SELECT req_id, count(DISTINCT attempt) AS attempts, arg_max(status, attempt) AS status, arg_max(status, attempt) BETWEEN 200 AND 299 AS ok FROM a JOIN stops USING (req_id) WHERE attempt <= stop AND attempt <= {fixed.MOST_ATTEMPTS} GROUP BY req_id""")
def send_retry_outcome(spark, sf_dir):
    return jobs.send_outcomes(table(spark, sf_dir, "send_attempts"))


@query("load_outcomes", f"""SELECT page_id, bool_or(good) AS loaded, arg_min(http_status, attempt) FILTER (WHERE good) AS http_status, CASE WHEN NOT bool_or(good) THEN substr(arg_max(error, attempt) FILTER (WHERE NOT good), 1, {fixed.ERROR_CHARS}) END AS error
FROM (SELECT *, coalesce(problem <> 'error', true) AS good FROM {samples.LOADS.sql()} WHERE attempt <= {fixed.MOST_LOADS}) GROUP BY page_id""")
def load_outcomes(spark, sf_dir):
    return jobs.load_outcomes(_rows(spark, samples.LOADS))


@query("ttl_expiry", f"SELECT job_id FROM jobs WHERE status IN {sql.one_of(fixed.FINAL_STATUSES)} AND created_at < (SELECT max(updated_at) FROM jobs) - INTERVAL {fixed.JOB_SECONDS} SECONDS")
def ttl_expiry(spark, sf_dir):
    rows = table(spark, sf_dir, "jobs")
    now = rows.agg(F.max("updated_at").alias("now"))
    return jobs.expired(rows.crossJoin(F.broadcast(now)), F.col("now")).select("job_id")


@query("payload_json", """SELECT page_id, to_json({'tenant_id': tenant_id, 'agent_id': agent_id, 'url': url, 'title': title, 'markdown': markdown, 'content_hash': content_hash, 'crawler_report': {'depth': crawler_report.depth, 'score': crawler_report.score, 'source': crawler_report.source, 'route_type': crawler_report.route_type, 'main_content_chars': crawler_report.main_content_chars, 'preprocessing_report': crawler_report.preprocessing_report}})::VARCHAR AS payload FROM sent_pages""")
def payload_json(spark, sf_dir):
    return payloads.payload(table(spark, sf_dir, "sent_pages"))


@query("payload_fields", "SELECT page_id, tenant_id, crawler_report.depth AS depth, crawler_report.preprocessing_report.removed_images AS images FROM sent_pages")
def payload_fields(spark, sf_dir):
    """Fields read back out of the payload."""
    read = lambda path: F.get_json_object("payload", path)
    return payloads.payload(table(spark, sf_dir, "sent_pages")).select("page_id", read("$.tenant_id").alias("tenant_id"), read("$.crawler_report.depth").cast("int").alias("depth"), read("$.crawler_report.preprocessing_report.removed_images").cast("int").alias("images"))
