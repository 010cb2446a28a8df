"""SQL, for DuckDB, of the operators: the same values by another engine. Used for comparison only."""

from __future__ import annotations

from pagemill.functions import fixed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(values: list) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def part(url: str, number: int) -> str:
    return rf"regexp_extract({url}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', {number})"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def path(url: str) -> str:
    return f"regexp_replace({part(url, 3)}, ';[^/]*$', '')"


def host(url: str) -> str:
    authority = rf"regexp_extract({part(url, 2)}, '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1)"
    return rf"regexp_replace({strip(f'lower({authority})')}, '^www\.', '')"


def pairs(query: str) -> str:
    cut = "CASE WHEN instr(x, '=') > 0 THEN instr(x, '=') ELSE length(x) + 1 END"
    decoded = lambda e: f"url_decode(replace({e}, '+', ' '))"
    return f"list_transform(list_filter(string_split({query}, '&'), lambda x: x <> ''), lambda x: {{'k': {decoded(f'substr(x, 1, {cut} - 1)')}, 'v': {decoded(f'substr(x, {cut} + 1)')}}})"


def encoded(text: str) -> str:
    return f"replace(url_encode({text}), '%20', '+')"


def normalized(url: str) -> str:
    bare = f"regexp_replace({strip(f'coalesce({url}, {q("")})')}, '#.*$', '', 's')"
    scheme, authority, own = f"lower({part(bare, 1)})", f"lower({part(bare, 2)})", path(bare)
    local = " OR ".join(f"contains({authority}, {q(h)})" for h in fixed.LOCAL_HOSTS)
    wanted = f"list_filter({pairs(part(bare, 4))}, lambda p: NOT (starts_with(lower(p.k), 'utm_') OR lower(p.k) IN {one_of(fixed.TRACKING_KEYS)}))"
    query = f"array_to_string(list_transform(list_sort({wanted}), lambda p: {encoded('p.k')} || '=' || {encoded('p.v')}), '&')"
    trimmed = f"CASE WHEN {own} IN ('', '/') THEN '/' ELSE regexp_replace({own}, '/+$', '') END"
    bad = rf"regexp_matches({authority}, '\[[^\]]*$|^[^\[]*\]')"
    return (
        f"CASE WHEN {scheme} NOT IN ('http', 'https') THEN '' WHEN {bad} THEN NULL ELSE (CASE WHEN {local} THEN {scheme} ELSE 'https' END) || '://' || "
        rf"regexp_replace({authority}, '^www\.', '') || ({trimmed}) || (CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) END"
    )


def segments(url: str) -> str:
    return f"list_filter(string_split({path(url)}, '/'), lambda x: x <> '')"


def keys(url: str) -> str:
    return f"list_distinct(list_transform({pairs(part(url, 4))}, lambda p: lower(p.k)))"


def is_asset(url: str) -> str:
    return rf"regexp_matches(lower({path(url)}), '\.({'|'.join(fixed.ASSET_EXTENSIONS)})$')"


def is_system(url: str) -> str:
    return f"list_has_any(list_transform({segments(url)}, lambda x: lower(x)), {strings(fixed.ASSET_SEGMENTS + fixed.SYSTEM_SEGMENTS)})"


def is_action(url: str) -> str:
    own = f"lower({path(url)})"
    return rf"(regexp_matches({own}, '\.({'|'.join(fixed.ACTION_EXTENSIONS)})$') AND regexp_matches({own}, '{'|'.join(fixed.ACTION_WORDS)}'))"


def is_stub(url: str) -> str:
    return f"(len({segments(url)}) = 1 AND regexp_matches(lower({segments(url)}[1]), '-details?$'))"


def is_blocked_query(url: str, follow: bool = False) -> str:
    own = keys(url)
    always = f"list_has_any({own}, {strings(fixed.BLOCKED_QUERY_KEYS)})"
    foreign = f"len(list_filter({own}, lambda k: k NOT IN {one_of(fixed.ALLOWED_QUERY_KEYS)})) > 0 OR len({own}) > 1"
    return f"({part(url, 4)} <> '' AND ({always}{'' if follow else ' OR ' + foreign}))"


def robots_path(url: str) -> str:
    own = f"regexp_replace(lower({path(url)}), '/+$', '')"
    return f"(CASE WHEN {own} = '' THEN '/' ELSE {own} END)"


def reason(url: str, root: str, prefixes: str = "[]::VARCHAR[]") -> str:
    blocked = f"list_min(list_filter({prefixes}, lambda p: starts_with({robots_path(url)}, p)))"
    return (
        f"CASE WHEN {url} IS NULL THEN 'malformed_url' WHEN {url} = '' THEN 'empty_url' WHEN lower({part(url, 1)}) NOT IN ('http', 'https') THEN 'unsupported_scheme' "
        f"WHEN {host(url)} <> {root} THEN 'external_domain' WHEN {is_asset(url)} THEN 'asset_extension' WHEN {is_system(url)} THEN 'asset_or_system_path' "
        f"WHEN {is_action(url)} THEN 'action_endpoint' WHEN {is_blocked_query(url)} THEN 'query_policy' WHEN len({segments(url)}) > {fixed.MOST_SEGMENTS} THEN 'path_too_deep' "
        f"WHEN {is_stub(url)} THEN 'bare_detail_stub' WHEN {blocked} IS NOT NULL THEN 'robots_disallowed:' || {blocked} ELSE 'accepted' END"
    )


def route(url: str) -> str:
    own = path(url)
    detail = " ".join(f"WHEN regexp_matches({own}, '(?i)/({heads})/[^/]+') THEN '{name}'" for name, heads in fixed.DETAIL_ROUTES)
    listing = " ".join(f"WHEN regexp_matches({own}, '(?i)^/({names})/?$') THEN '{name}'" for name, names in fixed.LISTING_ROUTES)
    return f"CASE WHEN {url} IS NULL THEN NULL {detail} {listing} WHEN len({segments(url)}) = 0 THEN 'home' WHEN len({segments(url)}) = 1 THEN 'section' ELSE 'general_detail' END"


def points(table: dict[str, int], key: str, other: int) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def score(url: str, source: str, anchor: str, depth: str) -> str:
    own = f"lower({path(url)})"
    return (
        f"({points(fixed.SOURCE_POINTS, source, fixed.OTHER_SOURCE_POINTS)} + {points(fixed.ROUTE_POINTS, f'({route(url)})', 0)} "
        f"+ CASE WHEN regexp_matches(lower(coalesce({anchor}, '')), '{'|'.join(fixed.USEFUL_ANCHORS)}') THEN 25 ELSE 0 END "
        f"+ CASE WHEN len({segments(url)}) >= 2 THEN 10 ELSE 0 END + CASE WHEN contains({own}, '-') THEN 8 ELSE 0 END "
        f"- CASE WHEN regexp_matches({own}, '{'|'.join(fixed.LOW_VALUE_PATHS)}') THEN 30 ELSE 0 END - CASE WHEN {part(url, 4)} <> '' THEN 25 ELSE 0 END "
        f"- CASE WHEN {is_blocked_query(url)} THEN 100 ELSE 0 END - CASE WHEN {is_action(url)} OR {is_system(url)} THEN 100 ELSE 0 END "
        f"- CASE WHEN {is_stub(url)} THEN 60 ELSE 0 END - {depth} * 6)"
    )


def joined(base: str, link: str) -> str:
    origin = f"{part(base, 1)} || '://' || {part(base, 2)}"
    folder = f"regexp_replace({part(base, 3)}, '[^/]*$', '')"
    own, rest = f"regexp_extract({link}, '^[^?#;]*')", f"regexp_extract({link}, '^[^?#;]*(.*)$', 1, 's')"
    whole = f"(CASE WHEN starts_with({link}, '/') THEN {own} ELSE regexp_replace((CASE WHEN {folder} = '' THEN '/' ELSE {folder} END) || {own}, '/{{2,}}', '/', 'g') END)"
    parts = f"string_split({whole}, '/')"
    # lists of one step each, folded: '..' takes the last step away
    steps = f"list_transform({parts}[2:len({parts}) - (CASE WHEN {parts}[-1] IN ('.', '..') THEN 0 ELSE 1 END)], lambda x: [x])"
    folded = f"list_reduce(list_prepend([''], {steps}), lambda held, x: CASE WHEN x[1] = '..' THEN (CASE WHEN len(held) > 1 THEN held[1:len(held) - 1] ELSE held END) WHEN x[1] = '.' THEN held ELSE list_concat(held, x) END)"
    last = f"(CASE WHEN {parts}[-1] IN ('.', '..') THEN '' ELSE {parts}[-1] END)"
    resolved = f"(CASE WHEN contains({whole}, '/.') THEN array_to_string(list_append({folded}, {last}), '/') ELSE {whole} END)"
    return (
        rf"CASE WHEN regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN {link} WHEN starts_with({link}, '//') THEN {part(base, 1)} || ':' || {link} "
        f"WHEN {link} = '' THEN {base} WHEN starts_with({link}, '?') THEN {origin} || {part(base, 3)} || {link} "
        f"WHEN starts_with({link}, '#') THEN regexp_replace({base}, '#.*$', '') || {link} ELSE {origin} || {resolved} || {rest} END"
    )


def compared(text: str) -> str:
    plain = rf"regexp_replace({strip(f'lower({text})')}, '[*_`#>\-\[\]().,:;!|]+', ' ', 'g')"
    return strip(rf"regexp_replace({plain}, '\s+', ' ', 'g')")


def spacing(text: str) -> str:
    unix = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    single = rf"regexp_replace(regexp_replace({unix}, '[\t\x0b\x0c]+', ' ', 'g'), '[ \x{{a0}}]+', ' ', 'g')"
    return strip(rf"regexp_replace(regexp_replace({single}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' +\n', chr(10), 'g')")


def signature(text: str) -> str:
    return rf"CASE WHEN coalesce({text}, '') = '' THEN '' ELSE sha256(lower(regexp_replace(regexp_replace({text}, 'https?://\S+', '', 'g'), '[^a-zA-Z]', '', 'g'))) END"


def noise(line: str) -> str:
    own, low = compared(line), f"lower({line})"
    letters = rf"length(regexp_replace({own}, '[^\p{{L}}]', '', 'g'))"
    return (
        f"({own} = '' OR {own} IN {one_of(fixed.UI_PHRASES)} OR regexp_matches({line}, '^https?://\\S+$') OR regexp_matches({line}, '^[^\\p{{L}}\\p{{N}}]+$') "
        f"OR (regexp_matches({low}, '\\b({fixed.ASSET_LINE_FOLDERS})/') AND regexp_matches({low}, '\\.({fixed.ASSET_LINE_ENDINGS})\\b')) "
        f"OR {own} IN {one_of(fixed.SOCIAL_NAMES)} OR (length({own}) <= 2 AND {letters} <= 1))"
    )


def kept(line: str) -> str:
    return f"(NOT {noise(line)} OR (starts_with({line}, '#') AND length({compared(line)}) >= 2))"


def quality(text: str, title: str, chars: str, route_type: str) -> str:
    body = strip(f"coalesce({text}, '')")
    words = rf"regexp_extract_all(lower({body}), '[\p{{L}}\p{{N}}_]+')"
    detail = f"coalesce(ends_with({route_type}, '_detail'), false)"
    job = " + ".join(f"CASE WHEN contains(lower({body}), {q(w)}) THEN 1 ELSE 0 END" for w in fixed.JOB_WORDS)
    least = f"CASE WHEN {route_type} = 'job_detail' AND ({job}) >= {fixed.LEAST_JOB_WORDS} THEN {min(fixed.LEAST_DETAIL_CHARS, fixed.JOB_DETAIL_CHARS)} ELSE {fixed.LEAST_DETAIL_CHARS} END"
    return (
        f"CASE WHEN regexp_matches(lower(coalesce({title}, '')), '{'|'.join(fixed.BAD_TITLES)}') THEN 'bad_title' "
        f"WHEN regexp_matches(substr(lower({body}), 1, {fixed.BAD_PHRASE_CHARS}), '{'|'.join(fixed.BAD_PHRASES)}') THEN 'bad_phrase' "
        f"WHEN {detail} AND coalesce({chars}, 0) < ({least}) THEN 'detail_body_too_short:' || coalesce({chars}, 0)::VARCHAR "
        f"WHEN NOT {detail} AND length({body}) < {fixed.LEAST_CHARS} THEN 'too_short' WHEN len({words}) < {fixed.LEAST_PAGE_WORDS} THEN 'too_few_words' "
        f"WHEN len({words}) > {fixed.MANY_WORDS} AND len(list_distinct({words})) / len({words}) < {fixed.LEAST_DISTINCT_SHARE} THEN 'low_unique_word_ratio' ELSE 'ok' END"
    )


def handler_paths(onclick: str) -> str:
    """A list of the paths that handlers with quoted arguments build."""
    found = lambda pattern, group: f"regexp_extract_all({onclick}, {q(pattern)}, {group})"
    plain = lambda text: f"regexp_replace({text}, '^/+|/+$', '', 'g')"

    def section(pattern):
        both = f"list_zip({found('(?i)' + pattern, 1)}, {found('(?i)' + pattern, 3)})"
        return f"list_transform(list_filter({both}, lambda x: NOT contains(x[2], '/')), lambda x: '/' || x[2] || '/' || {plain('x[1]')})"

    folder = f"list_transform(list_zip({found('(?i)' + fixed.PATH_HANDLER_PATTERN, 1)}, {found('(?i)' + fixed.PATH_HANDLER_PATTERN, 2)}), lambda x: regexp_replace(x[2], '/+$', '') || '/' || {plain('x[1]')})"
    quoted = rf"list_filter({found(fixed.QUOTED_PATH_PATTERN, 1)}, lambda x: NOT regexp_matches(x, '\.(js|css|png|jpg)$'))"
    return f"CASE WHEN length({onclick}) >= {fixed.LEAST_HANDLER_CHARS} THEN list_concat({section(fixed.FORM_HANDLER_PATTERN)}, {section(fixed.PLAIN_FORM_HANDLER_PATTERN)}, {folder}, {quoted}) ELSE [] END"


def usable(link: str) -> str:
    return f"NOT ({strip(f'lower({link})')} IN {one_of(fixed.PLACEHOLDER_HREFS)} OR {strip(link)} = '/' OR contains({link}, '{{') OR regexp_matches({strip(f'lower({link})')}, '^({'|'.join(fixed.BLOCKED_SCHEMES)})'))"


def plain_text(html: str) -> str:
    """Stripped strings between tags, one after the other."""
    return rf"trim(regexp_replace(regexp_replace({html}, '\s*<[^>]*>\s*', chr(1), 'g'), chr(1), '', 'g'))"


def crawl(edges: str, seeds: str, depth: int) -> str:
    """A crawl in rounds, unrolled: in each the best pending urls of a job are crawled within its budget, and their links admitted."""
    parts = [
        f"edges AS MATERIALIZED ({edges})", f"seeds AS MATERIALIZED ({seeds})", "budgets AS (SELECT job_id, max(max_pages) AS budget FROM seeds GROUP BY job_id)",
        "f0 AS MATERIALIZED (SELECT job_id, norm, 0 AS depth, 100 AS score, min(seq) AS seq FROM seeds GROUP BY job_id, norm)",
    ]
    for d in range(depth + 1):
        done = f"(SELECT job_id, norm FROM d{d - 1})" if d else "(SELECT NULL AS job_id, NULL AS norm WHERE false)"
        now = f"SELECT job_id, norm FROM (SELECT f.job_id, f.norm, row_number() OVER (PARTITION BY f.job_id ORDER BY f.score DESC, f.seq, f.norm) AS place FROM f{d} f ANTI JOIN {done} x ON x.job_id = f.job_id AND x.norm = f.norm) JOIN budgets USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS used FROM {done} GROUP BY job_id) USING (job_id) WHERE place + coalesce(used, 0) <= budget"
        parts.append(f"n{d} AS MATERIALIZED ({now})")
        parts.append(f"d{d} AS MATERIALIZED (SELECT * FROM n{d}" + (f" UNION ALL SELECT * FROM d{d - 1})" if d else ")"))
        if d < depth:
            new = f"SELECT e.job_id, e.norm, {d + 1} AS depth, arg_min(e.score - {6 * (d + 1)}, e.seq) AS score, min(e.seq) AS seq FROM edges e SEMI JOIN n{d} n ON n.job_id = e.job_id AND n.norm = e.parent_norm ANTI JOIN f{d} f ON f.job_id = e.job_id AND f.norm = e.norm WHERE e.score - {6 * (d + 1)} >= {fixed.LEAST_SCORE} GROUP BY e.job_id, e.norm"
            parts.append(f"f{d + 1} AS MATERIALIZED (SELECT * FROM f{d} UNION ALL {new})")
    return f"WITH {', '.join(parts)} SELECT f.job_id, f.norm, f.depth, f.score, f.seq, CASE WHEN x.norm IS NULL THEN 'pending' ELSE 'completed' END AS status FROM f{depth} f LEFT JOIN d{depth} x ON x.job_id = f.job_id AND x.norm = f.norm"


def best_first(edges: str, seeds: str, depth: int) -> str:
    """A crawl with one worker, step by step: the best url that waits, the first of equals, then its links in order."""
    least = fixed.LEAST_SCORE
    waiting = "list_max(list_filter(list_transform(found, lambda x, i: {'score': CASE WHEN x.visit < 0 THEN x.score END, 'place': -i}), lambda x: x.score IS NOT NULL))"
    here = "p.found[p.place].depth"
    new = f"list_filter(coalesce(l.links, []), lambda x: x.score - 6 * ({here} + 1) >= {least} AND {here} < {depth} AND NOT list_contains(list_transform(p.found, lambda y: y.norm), x.norm))"
    return f"""WITH RECURSIVE raw AS MATERIALIZED ({edges}), seeds AS MATERIALIZED ({seeds}),
links AS MATERIALIZED (SELECT job_id, parent_norm, list({{'norm': norm, 'score': score}} ORDER BY seq) AS links FROM (SELECT job_id, parent_norm, norm, score, min(seq) AS seq FROM raw WHERE score - 6 >= {least} GROUP BY ALL) GROUP BY job_id, parent_norm),
start AS (SELECT job_id, max(budget) AS budget, list({{'norm': norm, 'depth': 0, 'score': 100, 'visit': -1}} ORDER BY seq) AS found FROM (SELECT job_id, norm, min(seq) AS seq, max(max_pages) AS budget FROM seeds GROUP BY job_id, norm) GROUP BY job_id),
crawl AS (SELECT job_id, budget, 0 AS done, found, true AS going FROM start UNION ALL
SELECT job_id, budget, done + (place IS NOT NULL)::INT, CASE WHEN place IS NULL THEN found ELSE list_concat(list_transform(found, lambda x, i: {{'norm': x.norm, 'depth': x.depth, 'score': x.score, 'visit': CASE WHEN i = place THEN done ELSE x.visit END}}), list_filter(fresh, lambda x, i: list_position(list_transform(fresh, lambda y: y.norm), x.norm) = i)) END, place IS NOT NULL
FROM (SELECT p.*, list_transform({new}, lambda x: {{'norm': x.norm, 'depth': {here} + 1, 'score': x.score - 6 * ({here} + 1), 'visit': -1}}) AS fresh
FROM (SELECT *, -({waiting}).place AS place FROM crawl WHERE going AND done < budget) p LEFT JOIN links l ON l.job_id = p.job_id AND l.parent_norm = p.found[p.place].norm)),
last AS (SELECT job_id, arg_max(found, done) AS found FROM crawl GROUP BY job_id)
SELECT job_id, x.norm, x.depth, x.score, x.visit FROM (SELECT job_id, unnest(found) AS x FROM last)"""
