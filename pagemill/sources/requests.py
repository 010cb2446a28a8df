"""Requests for jobs: JSON texts into rows, with defaults, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import urls

# Whole-number fields with their default, least and most value.
NUMBERS = {
    "max_depth": (5, 0, 20), "max_pages": (300, 1, 5000), "concurrent_workers": (5, 1, 20), "min_markdown_chars": (120, 0, 5000), "min_detail_body_chars": (250, 0, 5000),
    "page_timeout_ms": (18000, 5000, 60000), "network_idle_timeout_ms": (4000, 0, 10000), "post_load_wait_ms": (600, 0, 5000), "max_scroll_px": (8000, 0, 30000),
    "menu_discovery_max_depth": (6, 0, 10), "click_discovery_max_depth": (6, 0, 20), "nav_hover_wait_ms": (600, 100, 3000), "post_click_wait_ms": (800, 100, 5000),
    "max_nav_items_to_hover": (30, 0, 100), "max_buttons_to_click": (80, 0, 300), "max_navigation_clicks_per_page": (60, 0, 300), "navigation_click_timeout_ms": (6000, 1000, 20000),
}
# Switches with their default.
SWITCHES = {
    "use_sitemap": True, "use_click_discovery": True, "use_menu_discovery": True, "extract_click_revealed_content": True, "follow_query_urls": False,
    "enable_preprocessing": True, "block_heavy_resources": True, "block_tracking_scripts": True, "respect_robots_txt": True, "hash_nav_discovery": True,
    "enable_navigation_click_discovery": True, "enable_nav_fingerprint_cache": True,
}
TEXTS = ["url", "tenant_id", "agent_id"]

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in TEXTS] + [T.StructField(n, T.LongType()) for n in NUMBERS] + [T.StructField(n, T.BooleanType()) for n in SWITCHES]
)


def parsed(body: Column) -> Column:
    """The fields of a request, defaults filled in; null where it is no JSON."""
    raw = F.from_json(body, SCHEMA)
    fields = [raw[n].alias(n) for n in TEXTS]
    fields += [F.coalesce(raw[n], F.lit(d)).cast("int").alias(n) for n, (d, _, _) in NUMBERS.items()]
    fields += [F.coalesce(raw[n], F.lit(d)).alias(n) for n, d in SWITCHES.items()]
    return F.when(raw.isNotNull(), F.struct(*fields))


def faults(request: Column) -> Column:
    """Names of the fields that are missing or out of bounds, in the order of the fields; ['body'] for no request."""
    bad = [F.when(F.coalesce(urls.normalize_url(request["url"]), F.lit("")) == "", F.lit("url"))]
    bad += [F.when(F.coalesce(request[n], F.lit("")) == "", F.lit(n)) for n in TEXTS[1:]]
    bad += [F.when(~request[n].between(low, high), F.lit(n)) for n, (_, low, high) in NUMBERS.items()]
    return F.when(request.isNull(), F.array(F.lit("body"))).otherwise(F.array_compact(F.array(*bad)))


def read_requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """``bodies`` with ``request`` (struct, null if it is no JSON) and ``faults`` (array of field names, empty if none)."""
    return bodies.withColumn("request", parsed(F.col(body_col))).withColumn("faults", faults(F.col("request")))
