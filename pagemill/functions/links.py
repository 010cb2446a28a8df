"""Links of raw HTML and of scripts by patterns, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import fixed, urls



def _without_dots(path: Column) -> Column:
    """A path with its dot segments resolved: . goes, .. takes the segment before it; at the root there is none to take."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    steps = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def step(held, x):
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", held).otherwise(F.concat(held, F.array(x)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    folder = last.isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def joined(base: Column, link: Column) -> Column:
    """A link resolved against its page as browsers do: absolute links, //host, /path, ?query, #fragment and plain names.

    Absolute links stay as they are, those of the page's own scheme too; dot segments of all others are resolved.
    """
    parts = urls.split_parts(base)
    scheme, authority, path = parts[0], parts[1], parts[2]
    origin = F.concat(scheme, F.lit("://"), authority)
    # what follows a path is not part of it
    own, rest = F.regexp_extract(link, r"^[^?#;]*", 0), F.regexp_extract(link, r"^[^?#;]*(.*)$", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    whole = F.when(F.startswith(link, F.lit("/")), own).otherwise(F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own), "/{2,}", "/"))
    dotted = F.contains(whole, F.lit("/."))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(origin, F.when(dotted, _without_dots(whole)).otherwise(whole), rest))
    )


def _usable(found: Column) -> Column:
    return F.filter(found, lambda x: urls.is_usable_link(x) & ~urls.is_placeholder_href(x))


def href_links(html: Column) -> Column:
    """Usable href values of an HTML text, in order."""
    return _usable(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*['"]([^'"]*)['"]"""), F.lit(1)))


def source_links(html: Column) -> Column:
    """Links four patterns find in raw HTML, pattern by pattern, repeats kept: hrefs, "path" and "url" values, quoted paths."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in fixed.SOURCE_LINK_PATTERNS])
    return F.filter(_usable(found), lambda x: ~urls.is_asset(x))


def script_targets(onclick: Column) -> Column:
    """Targets of plain navigation in a click handler: location and window.open with a quoted link."""
    return _usable(F.regexp_extract_all(onclick, F.lit("(?i)" + fixed.SCRIPT_TARGET_PATTERN), F.lit(1)))


def handler_paths(onclick: Column) -> Column:
    """Paths built by navigation handlers with quoted arguments; handlers of fewer than 15 characters have none."""
    trim = lambda x: F.regexp_replace(x, "^/+|/+$", "")

    def built(pattern, section_group):
        both = F.arrays_zip(F.regexp_extract_all(onclick, F.lit(pattern), F.lit(1)).alias("slug"), F.regexp_extract_all(onclick, F.lit(pattern), F.lit(section_group)).alias("section"))
        if section_group == 3:
            both = F.filter(both, lambda x: ~F.contains(x["section"], F.lit("/")))
            return F.transform(both, lambda x: F.concat(F.lit("/"), x["section"], F.lit("/"), trim(x["slug"])))
        return F.transform(both, lambda x: F.concat(F.regexp_replace(x["section"], "/+$", ""), F.lit("/"), trim(x["slug"])))

    plain = F.filter(F.regexp_extract_all(onclick, F.lit(fixed.QUOTED_PATH_PATTERN), F.lit(1)), lambda x: ~x.rlike(r"\.(js|css|png|jpg)$"))
    every = F.concat(built("(?i)" + fixed.FORM_HANDLER_PATTERN, 3), built("(?i)" + fixed.PLAIN_FORM_HANDLER_PATTERN, 3), built("(?i)" + fixed.PATH_HANDLER_PATTERN, 2), plain)
    return F.when(F.length(F.coalesce(onclick, F.lit(""))) < fixed.LEAST_HANDLER_CHARS, F.array().cast("array<string>")).otherwise(every)


def nav_regions(html: Column) -> Column:
    """The first nav, header and footer of an HTML text, white space collapsed, joined by bars."""
    first = [F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{t}[\s>].*?</{t}>", 0), r"(?U)\s+", " ")) for t in ("nav", "header", "footer")]
    return F.concat_ws("|", *first)


def nav_fingerprint(html: Column) -> Column:
    """Hash of the regions around a page's content; '' if they are shorter than 20 characters."""
    regions = nav_regions(F.coalesce(html, F.lit("")))
    return F.when(F.length(regions) < 20, F.lit("")).otherwise(F.sha2(regions, 256))
