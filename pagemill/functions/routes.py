"""Route classes of urls and scores of crawl candidates, as native column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import fixed, urls
from pagemill.functions.urls import Address


def classify_route(url: Column | Address) -> Column:
    """The route class of a url by its path; null for null."""
    at = urls.address(url)
    result = F.when(at.url.isNull(), F.lit(None).cast("string"))
    # one search for any of the patterns spares most urls the search for each
    some_detail = at.path.rlike("(?i)/(?:" + "|".join(heads for _, heads in fixed.DETAIL_ROUTES) + ")/[^/]")
    detail = F.lit(None).cast("string")
    for route, heads in reversed(fixed.DETAIL_ROUTES):
        detail = F.when(at.path.rlike(f"(?i)/(?:{heads})/[^/]"), route).otherwise(detail)
    depth = F.size(at.segments)
    listing = F.lit("section")
    for route, names in reversed(fixed.LISTING_ROUTES):
        listing = F.when(at.path.rlike(f"(?i)^/(?:{names})/?$"), route).otherwise(listing)
    return result.when(some_detail, detail).when(depth == 0, "home").when(depth == 1, listing).otherwise("general_detail")


def is_detail(route: Column) -> Column:
    return F.endswith(route, F.lit("_detail"))


def is_discovery(route: Column) -> Column:
    return route.isin(fixed.DISCOVERY_ROUTES)


def is_generic_parent(current: Column, canonical: Column) -> Column:
    """Whether a canonical link points to a listing above the page instead of the page."""

    def bare(url):
        trimmed = F.regexp_replace(urls.path_of(url), "/+$", "")
        return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)

    own, other = bare(current), bare(canonical)
    return (F.lower(own) != F.lower(other)) & other.rlike(f"(?i)^/({fixed.GENERIC_PARENTS})/?$") & F.startswith(F.lower(own), F.concat(F.lower(other), F.lit("/")))


def _points(table: dict[str, int], key: Column, other: int) -> Column:
    known = F.create_map(*itertools.chain(*[(F.lit(k), F.lit(v)) for k, v in table.items()]))
    return F.coalesce(F.try_element_at(known, key), F.lit(other))


def _any_word(text: Column, words: list[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(words))


def score(url: Column | Address, source: Column, anchor: Column, depth: Column, follow: Column, route: Column | None = None) -> Column:
    """Points of a crawl candidate; a null source or anchor counts as an unknown one. ``route``: the url's, where it is known."""
    at = urls.address(url)
    return (
        _points(fixed.SOURCE_POINTS, F.coalesce(source, F.lit("")), fixed.OTHER_SOURCE_POINTS)
        + _points(fixed.ROUTE_POINTS, classify_route(at) if route is None else route, 0)
        + F.when(_any_word(F.lower(anchor), fixed.USEFUL_ANCHORS), 25).otherwise(0)
        + F.when(F.size(at.segments) >= 2, 10).otherwise(0)
        + F.when(F.contains(at.lower_path, F.lit("-")), 8).otherwise(0)
        - F.when(_any_word(at.lower_path, fixed.LOW_VALUE_PATHS), 30).otherwise(0)
        - F.when(at.query != "", 25).otherwise(0)
        - F.when(urls.is_blocked_query(at, follow), 100).otherwise(0)
        - F.when(urls.is_action_endpoint(at) | urls.is_asset_or_system_path(at), 100).otherwise(0)
        - F.when(urls.is_bare_detail_stub(at), 60).otherwise(0)
        - depth * 6
    )


def is_tracking_request(url: Column) -> Column:
    found = F.lit(False)
    for tracker in fixed.TRACKERS:
        found = found | F.contains(F.lower(url), F.lit(tracker))
    return found


def is_dropped_request(url: Column, resource: Column, heavy: bool = True, tracking: bool = True) -> Column:
    """Requests a page load does without: heavy resources and trackers."""
    return F.coalesce((F.lit(heavy) & resource.isin(fixed.HEAVY_RESOURCES)) | (F.lit(tracking) & is_tracking_request(url)), F.lit(False))
