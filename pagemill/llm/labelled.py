"""Labelled pages for the trees of markup residue, made by a rule: blocks in the order of a page, each with its markups.

Words and forms are drawn from the lists below by a fixed seed; the labels are those of the form a block was made by.
"""

from __future__ import annotations

import random

PAGES = 90
_NOUNS = "garden lamp river stone window kettle ladder orchard baker meadow lantern cellar harvest drawer candle saddle pebble willow basket anchor".split()
_VERBS = "keeps moves shows carries opens follows paints gathers lifts mends".split()
_OTHER = "the a our every small green quiet old heavy early and under beside without near".split()

Block = tuple[frozenset[str], str]


def _sentence(rng: random.Random, least: int = 5, most: int = 22) -> str:
    words = [rng.choice(rng.choice((_NOUNS, _VERBS, _OTHER, _OTHER))) for _ in range(rng.randint(least, most))]
    return " ".join(words).capitalize() + rng.choice((".", ".", ".", "?", "!"))


def _name(rng: random.Random) -> str:
    return rng.choice(_NOUNS)


def _with(rng: random.Random, middle: str) -> str:
    """A sign in running text of any length."""
    parts = [_sentence(rng) for _ in range(rng.randint(1, 3))]
    words = parts[rng.randrange(len(parts))].split()
    words.insert(rng.randint(1, len(words)), middle)
    return " ".join([*parts, " ".join(words)]) if rng.random() < 0.6 else " ".join(words)


def _html(rng: random.Random) -> list[str]:
    n, m = _name(rng), _name(rng)
    inline = [f"<strong>{n}</strong>", f"<em>{n}</em>", f'<a href="/{n}">{m}</a>', f'<span class="{m}">{n}</span>', f"{n}<br/>", f"{n} &amp; {m}", f"{n}&nbsp;{m}", f"it&#8217;s {n}", f"&quot;{n}&quot;", f"{n} &mdash; {m}", f"<b>{n}</b>", f"<sup>{rng.randint(1, 9)}</sup>", f"<code>{n}</code>"]
    whole = [f"<p>{_sentence(rng)}</p>", f"<ul>\n<li>{n}</li>\n<li>{m}</li>\n</ul>", f"<table><tr><td>{n}</td><td>{m}</td></tr></table>", f"<h2>{n.title()}</h2>", f"<!-- {n} -->", f"<li>{n} {m}</li>", f'<div class="{n}">', "</div>", f"<div>\n{_sentence(rng)}\n</div>", f'<img src="/{n}.png">', f"<td>{n}</td>", f"<input type=text disabled> {n}"]
    return [_with(rng, rng.choice(inline)), rng.choice(whole)]


def _wiki(rng: random.Random) -> list[str]:
    n, m = _name(rng), _name(rng)
    inline = [f"[[{n.title()} {m}]]", f"[[{n}|{m}]]", f"'''{n}'''", f"''{n} {m}''", f"{{{{cite book|title={n}|year={rng.randint(1900, 2020)}}}}}", f"{{{{convert|{rng.randint(2, 90)}|km|mi}}}}", f"[[File:{n}.jpg|thumb|{m}]]"]
    whole = [f"== {n.title()} ==", f"=== {n} and {m} ===\n{_sentence(rng)}", f"{{| class=wikitable\n|-\n| {n} || {m}\n|}}", f"{{|\n! {n}\n|-\n| {m}\n|}}", f"{{{{infobox\n|name={n}\n|kind={m}\n}}}}", "|}", f"{{| class={n}"]
    return [_with(rng, rng.choice(inline)), rng.choice(whole)]


def _latex(rng: random.Random) -> list[str]:
    n, m, a, b = _name(rng), _name(rng), rng.choice("abcnxyz"), rng.choice("ijkmpq")
    inline = [f"\\textbf{{{n}}}", f"\\emph{{{n}}}", f"\\({a} + {b}\\)", f"${a}_{{{b}}} = {b}^2$", f"${a} < {b}$", f"{a} \\le {b}", f"\\cite{{{n}}}", f"\\(\\alpha_{b}\\)", f"$\\sum {a}$"]
    whole = [f"\\section{{{n.title()}}}", f"\\subsection*{{{n} {m}}}", f"\\begin{{itemize}}\n\\item {n}\n\\item {m}\n\\end{{itemize}}", f"$$\n\\frac{{{a}}}{{{b}}}\n$$", f"\\[ {a} = {b} \\]", f"\\item {n} {m}", f"\\begin{{equation}}\n{a} = {b}\n\\end{{equation}}", f"$$ {a} + {b} $$", "\\end{itemize}", f"\\begin{{quote}}\n{_sentence(rng)}"]
    return [_with(rng, rng.choice(inline)), rng.choice(whole)]


def _plain(rng: random.Random) -> list[str]:
    n, m, a, b, x, y = _name(rng), _name(rng), rng.choice("abipqsu"), rng.choice("cdefxy"), rng.randint(1, 90), rng.randint(100, 900)
    inline = [f"{x} < {y}", f"{y} > {x}", f"{b} <{a} and {y}> {b}", f"${x} or ${y}", f"${x},000 and ${y}.50", f"[[{x}, {y}]]", f"[{n}]", f"AT&T", f"{n.title()} & {m.title()}", f"{{{{ {n}.{m} }}}}", f"${{{n}}}", f"<%= {n} %>", f"[INSERT {n.upper()}]", f"C:\\{n}\\{m}", f"{n} = {m}", f"`<{a}>{n}`", f"`\\textbf{{{n}}}`", f"`[[{n}]]`", f"the {n}s' {m}", f"{x}' {y}\"", f"/{n}?{a}={x}&copy={y}", f"**{n}**", f"_{m}_", f"[{n}](/{m})", f"{n} <- {m}", f"{n} -> {m}", f"<{n}@{m}.test>", f"{x}% of ${y}", f"{{{n}}}", f"%{n.upper()}%", f"<https://{n}.test/{m}>"]
    whole = [f"# {n.title()} {m}", f"## {n}", f"- {n}\n- {m}\n- {n} {m}", f"1. {n}\n2. {m}", f"| {n} | {m} |\n|---|---|\n| {x} | {y} |", f"[{n}](/{n}) | [{m}](/{m}) | [Home](/)", f"* [{n}](/{n})\n* [{m}](/{m})", f"{n.title()} > {m.title()}", f"Home | {n} | {m}", f"> {_sentence(rng)}", "====", "----", _rows(rng, "| {} || {}"), _rows(rng, "| {} || {}"), _rows(rng, "{} & {} \\\\"), _rows(rng, "{} & {} \\\\"), f"{n}: {x}\n{m}: {y}", f"{n},{x},{y}\n{m},{y},{x}", f"if ({a} && {b}) then {n}", f"&{n} {m}|;\\ {{k}} '' = <", f"{{{{ {n} }}}}", f"{{% if {n} %}}", f"{x} {y} {x} {y}", f"We use cookies. [{n.title()}] [{m.title()}]"]
    return [_sentence(rng), _with(rng, rng.choice(inline)), rng.choice(whole), " ".join(_sentence(rng) for _ in range(3))]


def _broken(rng: random.Random, kind: str) -> list[str]:
    """A table that blank lines cut into several blocks."""
    n = _name(rng)
    if kind == "wiki":
        return [f"{{| class={n}\n|-", _rows(rng, "| {} || {}"), "|}"][: rng.randint(2, 3)]
    return ["\\begin{tabular}{ll}", _rows(rng, "{} & {} \\\\"), "\\end{tabular}"][: rng.randint(2, 3)]


def _rows(rng: random.Random, form: str) -> str:
    return "\n".join(form.format(_name(rng), rng.choice((_name(rng), rng.randint(1, 900)))) for _ in range(rng.randint(1, 4)))


def labelled_pages(pages: int = PAGES, seed: int = 11) -> list[list[Block]]:
    """Pages of 5 to 12 blocks; a third of the pages have no markup, the others one or two kinds."""
    rng = random.Random(seed)
    makers = {"html": _html, "wiki": _wiki, "latex": _latex}
    out = []
    for k in range(pages):
        kinds = rng.sample(sorted(makers), k % 3)
        page: list[Block] = []
        for _ in range(rng.randint(5, 12)):
            kind = rng.choice([*kinds, ""]) if kinds else ""
            if kind in ("wiki", "latex") and rng.random() < 0.25:
                page.extend((frozenset([kind]), block) for block in _broken(rng, kind))
                continue
            blocks = makers[kind](rng) if kind else _plain(rng)
            page.append((frozenset([kind] if kind else []), rng.choice(blocks)))
        if len(kinds) == 2:  # two in one block
            first, second = (makers[kind](rng)[0] for kind in kinds)
            page.insert(rng.randrange(len(page)), (frozenset(kinds), first + " " + second))
        out.append(page)
    return out
