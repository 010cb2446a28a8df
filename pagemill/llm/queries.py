"""Queries p1_ to p10_ and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.llm import graph_index, leaks, main_content, markup, packing, residue, sentences, signature_tree, site_lines, text_types
from pagemill.plans import sql
from pagemill.shared import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.flagged_pages(table(spark, sf_dir, "page_info"), table(spark, sf_dir, "sent_pages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    info, sent = table(spark, sf_dir, "page_info"), table(spark, sf_dir, "sent_pages")
    model = residue.page_model(info, sent)
    pages = sent.select("page_id", "markdown", F.col("crawler_report.main_content_chars").alias("chars"))
    lines = main_content.chrome_lines(pages, "page_id", "markdown", "chars", judge=spark.sparkContext.broadcast(model))
    titles = residue.scores(info, "page_id", "title", model, title=True).where("odds > 0").select("id").distinct()
    return lines.join(titles, "id", "left_anti").withColumnRenamed("id", "page_id")


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's body alone, and which lines it is."""
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "markdown", F.col("crawler_report.main_content_chars").alias("chars"))
    return main_content.bodies(pages, "page_id", "markdown", "chars").withColumnRenamed("id", "page_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    info, sent = table(spark, sf_dir, "page_info"), table(spark, sf_dir, "sent_pages")
    pages = sent.select("page_id", "markdown", F.col("crawler_report.main_content_chars").alias("chars"))
    types = text_types.typed(pages, "page_id", "markdown", "chars")
    other = materialize(types.where("prose_posterior < 0.5").select(F.col("id").alias("page_id")).distinct(), "not-prose")
    # which of these are cases of problem 1 is judged last, as only theirs need to be known
    model = residue.page_model(info, sent)
    flagged = residue.flagged_pages(info.join(other, "page_id", "left_semi"), sent.join(other, "page_id", "left_semi"), model)
    return other.join(flagged, "page_id", "left_anti")


def p3_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the type of every page with words, and what page_info says of its length."""
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "markdown", F.col("crawler_report.main_content_chars").alias("chars"))
    told = table(spark, sf_dir, "page_info").groupBy("page_id").agg(F.max("markdown_chars").alias("told_chars"))
    lengths = pages.select("page_id", F.length("markdown").alias("markdown_chars")).join(told, "page_id", "left")
    types = text_types.typed(pages, "page_id", "markdown", "chars", least_words=1).withColumnRenamed("id", "page_id")
    return types.join(lengths, "page_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "markdown")
    pairs = signature_tree.similar_pairs(pages, "page_id", "markdown", size=3, num=3, den=5, least_words=60)
    return pairs.select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's group of near duplicates, and the number of different texts its own is linked with."""
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "markdown")
    return signature_tree.near_duplicate_classes(pages, "page_id", "markdown", size=3, num=3, den=5, least_words=60).withColumnRenamed("id", "page_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "url", "markdown", "batch_no")
    return site_lines.repeated_lines(pages, "page_id", "url", "markdown", "batch_no").withColumnRenamed("id", "page_id")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with repeated lines, without these lines, and how many there were."""
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "url", "markdown", "batch_no")
    removed = site_lines.repeated_lines(pages, "page_id", "url", "markdown", "batch_no")
    return site_lines.rebuild(pages, "page_id", "markdown", removed).select(F.col("id").alias("page_id"), F.col("text").alias("markdown"), "removed")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "sent_pages").select("page_id", "url", "markdown", "batch_no")
    seen = graph_index.seen_before(pages, "page_id", "markdown", "batch_no", normalize_url(F.col("url")), size=3, num=3, den=5, least_words=60)
    return seen.withColumnRenamed("id", "page_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold part of an item's passage, also with small edits."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_kinds(table(spark, sf_dir, "sent_pages"), "page_id", "markdown").withColumnRenamed("id", "page_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(table(spark, sf_dir, "sent_pages"), "page_id", "markdown").withColumnRenamed("id", "page_id")


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.typed_blocks(table(spark, sf_dir, "sent_pages"), "page_id", "markdown").withColumnRenamed("id", "page_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill_of(p8_containers(spark, sf_dir), table(spark, sf_dir, "containers"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_bodies": p2_bodies, "p3_found": p3_found, "p3_types": p3_types, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_rebuilt": p5_rebuilt, "p6_found": p6_found, "p7_found": p7_found, "p7_clean": p7_clean, "p7_blocks": p7_blocks, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found}


_SITE = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_LINE = r"regexp_replace(trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')), '\d+', '0', 'g')"

_SHINGLES = r"""words AS MATERIALIZED (SELECT page_id, batch_no, url, markdown, regexp_extract_all(lower(markdown), '[\p{L}\p{N}]+') AS w FROM sent_pages WHERE markdown IS NOT NULL),
shingles AS MATERIALIZED (SELECT DISTINCT page_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 60)),
sizes AS MATERIALIZED (SELECT page_id, count(*) AS n FROM shingles GROUP BY page_id),
shared AS MATERIALIZED (SELECT a.page_id AS a, b.page_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.page_id < b.page_id GROUP BY a.page_id, b.page_id),
alike AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.page_id = a JOIN sizes y ON y.page_id = b WHERE 5 * common >= 3 * (x.n + y.n - common))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_SHINGLES} SELECT a AS page_id_a, b AS page_id_b FROM alike JOIN words x ON x.page_id = a JOIN words y ON y.page_id = b WHERE x.markdown <> y.markdown",
        "p5_found": f"""WITH lines AS MATERIALIZED (SELECT page_id, line_no, site, {_LINE} AS own FROM (SELECT page_id, {_SITE} AS site, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no FROM sent_pages)),
often AS (SELECT site, own FROM lines WHERE length(own) >= 20 GROUP BY site, own HAVING count(DISTINCT page_id) >= 6)
SELECT DISTINCT page_id, line_no::INT AS line_no FROM lines JOIN often USING (site, own)""",
        "p4_groups": f"""WITH RECURSIVE {_SHINGLES}, links AS MATERIALIZED (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
same AS (SELECT page_id AS a, min(page_id) OVER (PARTITION BY markdown) AS b FROM sent_pages WHERE markdown IS NOT NULL),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT a, b FROM same UNION SELECT b, a FROM same),
reach AS (SELECT page_id AS root, page_id AS node FROM sent_pages UNION SELECT r.root, e.b FROM reach r JOIN edges e ON e.a = r.node),
degree AS (SELECT l.a AS page_id, count(DISTINCT y.markdown) AS links FROM links l JOIN words x ON x.page_id = l.a JOIN words y ON y.page_id = l.b WHERE x.markdown <> y.markdown GROUP BY l.a)
SELECT r.root AS page_id, min(r.node) AS class_id, coalesce(any_value(d.links), 0) AS links FROM reach r LEFT JOIN degree d ON d.page_id = r.root GROUP BY r.root""",
        "p5_rebuilt": f"""WITH raw AS MATERIALIZED (SELECT page_id, {_SITE} AS site, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS line_no FROM sent_pages),
lines AS MATERIALIZED (SELECT *, {_LINE} AS own FROM raw), often AS (SELECT site, own FROM lines WHERE length(own) >= 20 GROUP BY site, own HAVING count(DISTINCT page_id) >= 6),
marked AS (SELECT l.page_id, l.line, l.line_no, o.own IS NOT NULL AS gone FROM lines l LEFT JOIN often o USING (site, own))
SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS markdown, count(*) FILTER (WHERE gone)::INT AS removed FROM marked GROUP BY page_id HAVING count(*) FILTER (WHERE gone) > 0""",
        "p6_found": f"""WITH {_SHINGLES}, pages AS (SELECT page_id, batch_no, {sql.normalized('url')} AS norm FROM sent_pages)
SELECT DISTINCT page_id FROM (SELECT CASE WHEN x.batch_no < y.batch_no THEN y.page_id ELSE x.page_id END AS page_id FROM alike JOIN words x ON x.page_id = a JOIN words y ON y.page_id = b WHERE x.batch_no <> y.batch_no
UNION SELECT p.page_id FROM pages p JOIN (SELECT norm, min(batch_no) AS first FROM pages WHERE norm <> '' GROUP BY norm) f USING (norm) WHERE p.batch_no > f.first)""",
        "p9_found": r"""WITH items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\p{L}\p{N}]+') AS w FROM eval_items) WHERE len(w) >= 13)),
docs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM docs JOIN items USING (g)""",
    }
