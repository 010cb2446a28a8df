"""Lines and text outside code."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^[ \t>]{0,6}(`{3,}|~{3,})")
_SPAN = re.compile(r"(`+)(?:(?!`).)+?\1(?!`)", re.S)


def code_lines(lines: list[str]) -> list[bool]:
    """Whether each line is part of a fenced code block, its fences included; an open block ends with the text."""
    out, fence = [], ""
    for line in lines:
        mark = _FENCE.match(line) if "`" in line or "~" in line else None
        if fence:
            out.append(True)
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence) and not line.strip(" \t>`~\r"):
                fence = ""
        elif mark:
            fence = mark.group(1)
            out.append(True)
        else:
            out.append(False)
    return out


def without_spans(line: str) -> str:
    return _SPAN.sub(" ", line) if "`" in line else line
