"""Url normalisation, predicates and the reject cascade, as native column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import fixed
from pagemill.shared import once

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of a url, '' if absent; splits any string and never fails."""
    return F.regexp_extract(url, _PARTS, number)


class Address:
    """The parts of a url as columns: scheme, authority, path (without parameters), query.

    Of a column of urls each part is a search of its own; ``taken_apart`` makes a struct of all in one, which is computed
    once a row (``with_address``) and then read.
    """

    def __init__(self, url: Column, held: Column | None = None):
        self.url = url
        self.scheme, self.authority, self.query = (part(url, k) if held is None else held[name] for k, name in ((1, "scheme"), (2, "authority"), (4, "query")))
        self.path = _without_parameters(part(url, 3)) if held is None else held["path"]
        self.lower_path = F.lower(self.path) if held is None else held["lower_path"]
        self.segments = F.filter(F.split(self.path, "/"), lambda x: x != "") if held is None else held["segments"]
        self.keys = query_keys_of(self.query) if held is None else held["keys"]


def address(url: Column | Address) -> Address:
    return url if isinstance(url, Address) else Address(url)


_CUT = "\u0001\u0002\u0001"


def split_parts(url: Column) -> Column:
    """Scheme, authority, path and query as an array, by one search."""
    return F.split(F.regexp_replace(url, "(?s)" + _PARTS, "$1" + _CUT + "$2" + _CUT + "$3" + _CUT + "$4"), _CUT)


def _without_parameters(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(";")), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def with_address(df: DataFrame, name: str, url: str) -> DataFrame:
    """``df`` with a struct of the parts of its column ``url``; ``Address(F.col(url), F.col(name))`` reads them."""
    rows = once(df, name, split_parts(F.col(url)))
    rows = once(rows, name, F.struct(F.col(name)[0].alias("scheme"), F.col(name)[1].alias("authority"), _without_parameters(F.col(name)[2]).alias("path"), F.col(name)[3].alias("query")))
    held = F.col(name)
    segments = F.filter(F.split(held["path"], "/"), lambda x: x != "")
    keys = F.when(held["query"] == "", F.array().cast("array<string>")).otherwise(query_keys_of(held["query"]))
    return once(rows, name, F.struct(held["scheme"].alias("scheme"), held["authority"].alias("authority"), held["path"].alias("path"), F.lower(held["path"]).alias("lower_path"), held["query"].alias("query"), segments.alias("segments"), keys.alias("keys")))


def with_normalized(df: DataFrame, name: str, url: Column) -> DataFrame:
    """``df`` with ``normalize_url(url)``, in steps of which each is computed once a row."""
    rows = once(df, name, bare_url(url))
    rows = once(rows, "__split", F.struct(F.col(name).alias("bare"), split_parts(F.col(name)).alias("parts")))
    parts = F.col("__split.parts")
    return once(rows.drop(name), name, _normal(F.col("__split.bare"), parts[0], parts[1], parts[2], parts[3])).drop("__split")


def path_of(url: Column | Address) -> Column:
    """The path without the parameters (``;...``) of its last segment."""
    return address(url).path


def canonical_host(host: Column) -> Column:
    """Host in lower case without blanks around it and without one leading ``www.``; '' for null."""
    return F.regexp_replace(strip(F.lower(F.coalesce(host, F.lit("")))), r"^www\.", "")


def host_of(url: Column | Address) -> Column:
    """Canonical host of a url, without user and port."""
    return canonical_host(F.regexp_extract(address(url).authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def is_malformed(url: Column | Address) -> Column:
    return address(url).authority.rlike(r"\[[^\]]*$|^[^\[]*\]")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """The key and value of each part of a query, decoded, blanks kept."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.when(F.instr(x, "=") > 0, F.regexp_replace(x, r"^[^=]*=", "")).otherwise("")).alias("v")))


def query_keys_of(query: Column) -> Column:
    return F.array_distinct(F.transform(query_pairs(query), lambda x: F.lower(x["k"])))


def normalize_url(url: Column) -> Column:
    """The url as pages are told apart by: https (local hosts keep their scheme), lower-case host without ``www.``, no
    fragment, no parameters, no trailing slash, no tracking keys, the rest of the query sorted.

    '' for null, empty and other schemes than http and https; null for a malformed host.
    """
    bare = bare_url(url)
    return _normal(bare, *(part(bare, k) for k in (1, 2, 3, 4)))


def bare_url(url: Column) -> Column:
    """Without white space around it and without fragment; '' for null."""
    return F.regexp_replace(strip(F.coalesce(url, F.lit(""))), r"(?s)#.*$", "")


def _normal(bare: Column, scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    scheme, authority = F.lower(scheme), F.lower(authority)
    local = F.lit(False)
    for host in fixed.LOCAL_HOSTS:
        local = local | F.contains(authority, F.lit(host))
    own = _without_parameters(path)
    path = F.when(own.isin("", "/"), F.lit("/")).when(F.endswith(own, F.lit("/")), F.regexp_replace(own, r"/+$", "")).otherwise(own)
    wanted = F.filter(query_pairs(query), lambda x: ~(F.startswith(F.lower(x["k"]), F.lit("utm_")) | F.lower(x["k"]).isin(fixed.TRACKING_KEYS)))
    kept = F.array_join(F.transform(F.array_sort(wanted), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    shown = F.when(query == "", F.lit("")).otherwise(F.regexp_replace(F.concat(F.lit("?"), kept), r"^\?$", ""))
    host = F.when(F.startswith(authority, F.lit("www.")), F.substring(authority, 5, 1 << 30)).otherwise(authority)
    whole = F.concat(F.when(local, scheme).otherwise(F.lit("https")), F.lit("://"), host, path, shown)
    malformed = F.contains(authority, F.lit("[")) | F.contains(authority, F.lit("]"))
    return F.when(~scheme.isin("http", "https"), F.lit("")).when(malformed & authority.rlike(r"\[[^\]]*$|^[^\[]*\]"), F.lit(None)).otherwise(whole)


def same_site(url: Column | Address, root_host: Column) -> Column:
    return host_of(url) == canonical_host(root_host)


def segments(url: Column | Address) -> Column:
    return address(url).segments


def is_placeholder_href(raw: Column) -> Column:
    return F.coalesce(strip(F.lower(raw)).isin(fixed.PLACEHOLDER_HREFS), F.lit(True))


def is_usable_link(raw: Column) -> Column:
    """Whether a raw href may lead to a page; null and '' do not."""
    text = strip(F.coalesce(raw, F.lit("")))
    return ~(text.isin("", "#!", "/") | F.contains(text, F.lit("{")) | F.lower(text).rlike("^(" + "|".join(fixed.BLOCKED_SCHEMES) + ")"))


def is_asset(url: Column | Address) -> Column:
    return address(url).lower_path.rlike(r"\.(" + "|".join(fixed.ASSET_EXTENSIONS) + ")$")


def is_asset_or_system_path(url: Column | Address) -> Column:
    known = F.array(*[F.lit(x) for x in fixed.ASSET_SEGMENTS + fixed.SYSTEM_SEGMENTS])
    return F.arrays_overlap(F.split(address(url).lower_path, "/"), known)


def is_action_endpoint(url: Column | Address) -> Column:
    path = address(url).lower_path
    return path.rlike(r"\.(" + "|".join(fixed.ACTION_EXTENSIONS) + ")$") & path.rlike("|".join(fixed.ACTION_WORDS))


def is_bare_detail_stub(url: Column | Address) -> Column:
    own = segments(url)
    return (F.size(own) == 1) & F.lower(F.try_element_at(own, F.lit(-1))).rlike("-details?$")


def is_blocked_query(url: Column | Address, follow: Column) -> Column:
    at = address(url)
    always = F.arrays_overlap(at.keys, F.array(*[F.lit(x) for x in fixed.BLOCKED_QUERY_KEYS]))
    foreign = F.size(F.array_except(at.keys, F.array(*[F.lit(x) for x in fixed.ALLOWED_QUERY_KEYS]))) > 0
    return (at.query != "") & (always | (~follow & (foreign | (F.size(at.keys) > 1))))


def robots_prefix(url: Column | Address, disallowed: Column) -> Column:
    """The smallest disallowed prefix of the path, null if there is none. Prefixes end anywhere, not only at slashes."""
    trimmed = F.regexp_replace(address(url).lower_path, "/+$", "")
    path = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    return F.array_min(F.filter(F.coalesce(disallowed, F.array().cast("array<string>")), lambda p: F.startswith(path, p)))


def reject_reason(url: Column | Address, root_host: Column, follow: Column, disallowed: Column) -> Column:
    """Why a normalised url is not crawled, the first rule that holds; 'accepted' if none does."""
    at = address(url)
    blocked = robots_prefix(at, disallowed)
    return (
        F.when(at.url.isNull(), "malformed_url")
        .when(at.url == "", "empty_url")
        .when(~F.lower(at.scheme).isin("http", "https"), "unsupported_scheme")
        .when(~same_site(at, root_host), "external_domain")
        .when(is_asset(at), "asset_extension")
        .when(is_asset_or_system_path(at), "asset_or_system_path")
        .when(is_action_endpoint(at), "action_endpoint")
        .when(is_blocked_query(at, follow), "query_policy")
        .when(F.size(at.segments) > fixed.MOST_SEGMENTS, "path_too_deep")
        .when(is_bare_detail_stub(at), "bare_detail_stub")
        .when(blocked.isNotNull(), F.concat(F.lit("robots_disallowed:"), blocked))
        .otherwise("accepted")
    )
