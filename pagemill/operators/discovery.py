"""What a page's stages of discovery offer, from tables of what was captured, and the union of their candidates in stage order.

Captured rows are of one page of a job each: (job_id, page, row, ...), ``row`` the order in which things were met on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import fixed, links, routes, urls
from pagemill.shared import once

_PAGE = ["job_id", "page"]


def stage_limits(route_type: Column, depth: Column, nav_seen: Column, most_buttons: int = fixed.MOST_BUTTONS, most_navigations: int = fixed.MOST_NAVIGATIONS, menu_depth: int = fixed.MENU_DEPTH, click_depth: int = fixed.CLICK_DEPTH) -> Column:
    """What may be done on a page: (hover, click, buttons, navigations, skip_nav, hash).

    Detail pages get few clicks, none in their navigation, and no fragments; menus are opened on pages of discovery that are
    not deep and whose navigation was not seen before.
    """
    detail, clicks = routes.is_detail(route_type), depth <= click_depth
    buttons = F.when(detail, min(most_buttons, fixed.DETAIL_BUTTONS)).otherwise(most_buttons)
    navigations = F.when(detail, fixed.DETAIL_NAVIGATIONS).otherwise(most_navigations)
    hover = routes.is_discovery(route_type) & ~nav_seen & (depth <= menu_depth)
    return F.struct(hover.alias("hover"), clicks.alias("click"), F.when(clicks, buttons).otherwise(0).alias("buttons"), F.when(clicks, navigations).otherwise(0).alias("navigations"), (nav_seen | detail).alias("skip_nav"), (clicks & ~detail).alias("hash"))


def handler_links(handlers: DataFrame) -> DataFrame:
    """(job_id, page, row, norm, text): addresses that click handlers (job_id, page, row, onclick, text) build, each once a
    page with the text of the first element that leads there."""
    found = handlers.select(*_PAGE, "row", F.substring("text", 1, fixed.HANDLER_TEXT_CHARS).alias("text"), F.posexplode(links.handler_paths(F.col("onclick"))).alias("place", "path"))
    rows = urls.with_normalized(found, "norm", links.joined(F.col("page"), F.col("path"))).where("norm <> ''")
    first = rows.groupBy(*_PAGE, "norm").agg(F.min_by(F.struct("row", "place", "text"), F.struct("row", "place")).alias("first"))
    return first.select(*_PAGE, "first.row", "norm", "first.text")


def label_of(text: Column, aria_label: Column) -> Column:
    """The label of a control: the beginnings of its text and of its label for readers, in lower case."""
    own = F.substring(urls.strip(F.lower(F.coalesce(text, F.lit("")))), 1, fixed.LABEL_CHARS)
    return urls.strip(F.concat(own, F.lit(" "), F.substring(F.lower(F.coalesce(aria_label, F.lit(""))), 1, fixed.ARIA_CHARS)))


def clicked(controls: DataFrame) -> DataFrame:
    """The controls that are clicked, of (job_id, page, row, text, aria_label, visible, in_nav, buttons, skip_nav): visible, among
    the first ``buttons`` of the page, not in a navigation that is skipped, without a word of noise, one for each label."""
    place = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("row"))
    rows = once(controls.withColumn("place", place).where("place <= buttons and visible and not (skip_nav and in_nav)"), "label", label_of(F.col("text"), F.col("aria_label")))
    quiet = rows.where(~F.exists(F.array(*[F.lit(w) for w in fixed.NOISE_LABELS]), lambda w: F.contains(F.col("label"), w)))
    first = quiet.groupBy(*_PAGE, "label").agg(F.min("row").alias("row"))
    return quiet.join(first, [*_PAGE, "label", "row"], "left_semi").drop("place")


def revealed_links(shown: DataFrame, baseline: DataFrame) -> DataFrame:
    """(job_id, page, row, place, norm): links that are there after a click, ``shown``: (job_id, page, row, place, url), and
    neither on the page before, ``baseline``: (job_id, page, url), nor after an earlier click."""
    known = urls.with_normalized(baseline.select(*_PAGE, "url"), "norm", F.col("url")).select(*_PAGE, "norm").distinct()
    rows = urls.with_normalized(shown.select(*_PAGE, "row", "place", "url"), "norm", F.col("url")).where("norm <> ''")
    first = rows.groupBy(*_PAGE, "norm").agg(F.min(F.struct("row", "place")).alias("first"))
    return first.join(known, [*_PAGE, "norm"], "left_anti").select(*_PAGE, "first.row", "first.place", "norm")


def fragment_controls(anchors: DataFrame) -> DataFrame:
    """The anchors (job_id, page, row, href) that lead to a place on their page and are followed: of the first ones, each href once."""
    own = anchors.where(F.startswith("href", F.lit("#")) & ~F.col("href").isin("#", "#!"))
    place = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("row"))
    early = own.withColumn("place", place).where(F.col("place") <= fixed.MOST_FRAGMENTS)
    return early.groupBy(*_PAGE, "href").agg(F.min("row").alias("row"))


def revealed_text(dialogs: DataFrame) -> DataFrame:
    """(job_id, page, text): what dialogs (job_id, page, row, text) said after clicks, in order, empty ones left out."""
    rows = dialogs.select(*_PAGE, "row", urls.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("row", "text")))
    return rows.groupBy(*_PAGE).agg(F.array_join(F.transform(parts, lambda x: x["text"]), fixed.BETWEEN_DIALOGS).alias("text"))


def in_stage_order(streams: dict[str, DataFrame]) -> DataFrame:
    """Candidates of all stages, (job_id, page, row, url, source, text) each, with ``stage`` and ``seq``: the order in which a page's
    stages offer them, which decides who comes first. ``streams``: by the names of ``fixed.STAGES``, those there are."""
    rows = None
    for number, name in enumerate(fixed.STAGES):
        if name in streams:
            own = streams[name].select(*_PAGE, F.lit(number).alias("stage"), "row", "url", "source", "text")
            rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("stage", "row", "url", "source")))


def first_offers(candidates: DataFrame) -> DataFrame:
    """Of each normalised address of a job its first offer; pages in the order ``visit``, offers of a page by ``seq``."""
    rows = urls.with_normalized(candidates, "norm", F.col("url")).where("norm <> ''")
    kept = [c for c in rows.columns if c not in ("job_id", "norm")]
    first = rows.groupBy("job_id", "norm").agg(F.min_by(F.struct(*kept), F.struct("visit", "seq")).alias("first"))
    return first.select("job_id", "norm", "first.*")


def interactions(stages: DataFrame) -> DataFrame:
    """Counters of each job's interactions, of rows (job_id, stage, found, navigations, nav_cached, restored): one for each stage
    run on a page, with the links it found, how many by leaving the page, and how the page was come back to ('back', 'goto')."""
    own = lambda stage: F.col("stage") == stage
    found = lambda stage: F.coalesce(F.sum(F.when(own(stage), F.col("found"))), F.lit(0))
    return stages.groupBy("job_id").agg(
        F.count_if(own("nav_hover")).alias("menus_interacted"), F.count_if(own("click")).alias("clicks_interacted"),
        found("nav_hover").alias("nav_links_found"), found("click").alias("click_links_found"), found("hash").alias("hash_links_found"),
        F.coalesce(F.sum(F.when(own("click"), F.col("navigations"))), F.lit(0)).alias("navigation_links_found"),
        F.count_if(F.col("nav_cached")).alias("nav_fingerprint_cache_hits"),
        F.count_if(F.col("restored") == "back").alias("restore_via_back"), F.count_if(F.col("restored") == "goto").alias("restore_via_goto"),
    )
