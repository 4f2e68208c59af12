"""Reading order of scanned pages: lines by columns, whatever order the scan gave them in."""

from __future__ import annotations

import re
from collections.abc import Sequence

#: Blanks that part the columns of lines joined across the page.
_GAP = re.compile(r"(?<=\S) {3,}(?=\S)")
#: Two left edges farther apart than this share of the page's width belong to different columns.
_EDGE_SHARE = 0.08


def _by_boxes(lines: list[str], x0: Sequence[int], x1: Sequence[int], y0: Sequence[int], columns: int) -> list[str] | None:
    """Lines by column and height; None where the boxes show no columns."""
    left = [min(a, b) for a, b in zip(x0, x1, strict=True)]
    width = max(max(a, b) for a, b in zip(x0, x1, strict=True)) - min(left)
    edges = sorted(set(left))
    starts = [edges[0]]
    for a, b in zip(edges, edges[1:]):
        if b - a > max(40, _EDGE_SHARE * width):
            starts.append(b)
    if len(starts) == 1:
        return lines
    column = [sum(1 for s in starts[1:] if e >= s) for e in left]
    order = sorted(range(len(lines)), key=lambda i: (column[i], y0[i]))
    return [lines[i] for i in order]


def _split_joined(lines: list[str]) -> list[str] | None:
    """Lines joined across columns by a wide gap, taken apart; None if few lines have such a gap."""
    parts = [_GAP.split(line.strip(" ")) for line in lines]
    wide = [len(p) for p in parts if len(p) > 1]
    if 2 * len(wide) < len(lines) or not wide:
        return None
    columns = max(set(wide), key=wide.count)
    out: list[list[str]] = [[] for _ in range(max(columns, max(wide)))]
    for p in parts:
        for i, piece in enumerate(p):
            out[i].append(piece)
    return [piece for col in out for piece in col]


def _deal(lines: list[str], columns: int) -> list[str]:
    """Rows across columns dealt back into columns, where the last column may be shorter."""
    height = -(-len(lines) // columns)
    last = len(lines) - (columns - 1) * height
    if last < 0:
        return lines
    out: list[list[str]] = [[] for _ in range(columns)]
    i = 0
    for row in range(height):
        for c in range(columns if row < last else columns - 1):
            if i < len(lines):
                out[c].append(lines[i])
                i += 1
    return [line for col in out for line in col]


def readings(text: str, x0: Sequence[int] | None, x1: Sequence[int] | None, y0: Sequence[int] | None, columns: int | None) -> list[list[str]]:
    """The page's lines in reading order: one reading, or two (as given, and dealt into columns) where a page of several columns has no
    usable boxes. An empty text has one empty line.
    """
    lines = text.replace("\r", "").split("\n")
    if len(lines) > 1 and "   " in text and (apart := _split_joined(lines)) is not None:
        return [apart]
    if (columns or 1) <= 1 or len(lines) < 3:
        return [lines]
    if x0 is not None and len(x0) == len(lines) and None not in x0 and None not in y0 and None not in x1:
        return [_by_boxes(lines, x0, x1, y0, columns) or lines]
    return [lines, _deal(lines, columns)]
