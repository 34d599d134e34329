"""Cutting oversized texts into pieces at natural boundaries, by packing a structure tree.

A text becomes a tree: headings hold what follows them, blocks hold lines, indented lines belong to the line above.
Sibling subtrees are merged up to the limit; only a node that is too large itself is opened. A line without structure is
cut after sentences, else after white space, else anywhere but inside CR LF or before a combining mark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "item_kind string, item_id bigint, piece_no int, start int, body_start int, end int, n_chars int"
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEAD = re.compile(r"(#{1,6})(?:[ \t]|$)")
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_SENTENCE = re.compile(r"(?<=[.!?;。！？；])[\"')\]]*\s+|(?<=[。！？；])")
_SPACE = re.compile(r"\s+")
_CLOSER = re.compile(r"[ \t]*(?:[}\])]|end\b|else\b|elif\b|except\b|finally\b|catch\b)")


def _tree(text: str, markdown: bool) -> list:
    """The top-level nodes; a node is (start, end, children). Nodes tile their parent, parents tile the text."""
    lines, pos, fence, blank = [], 0, None, False
    for m in _LINE.finditer(text):
        if m.end() == m.start():
            break
        line = m.group()
        bare = line.strip()
        if markdown:
            f = _FENCE.match(line)
            h = None if fence or f else _HEAD.match(line)
            if h:
                rank = len(h[1])
            elif fence:
                rank = 60
            else:
                rank = 20 if blank or not lines or lines[-1][1] < 10 else 40 + min(len(line) - len(line.lstrip(" \t")), 15) + (not re.match(r"\s*(?:[-*+]|\d+[.)])\s", line)) * 2
            if f and (fence is None or bare.startswith(fence)):
                fence = None if fence else f[1]
        else:
            width = len(line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4))
            rank = (2 * width + 1 if _CLOSER.match(line) else 2 * width) if bare else 10**6
            if rank == 0 and not blank and lines and lines[-1][1] < 10**6:
                rank = 1  # a line at the margin right below another belongs to its block
        blank = not bare
        if blank and lines:
            rank = 10**6
        lines.append((pos, rank))
        pos = m.end()
    root: list = []
    open_: list = [(-1, root)]
    for i, (start, rank) in enumerate(lines):
        while open_[-1][0] >= rank:
            open_.pop()
        node = [start, lines[i + 1][0] if i + 1 < len(lines) else len(text), []]
        open_[-1][1].append(node)
        open_.append((rank, node[2]))
    todo = [(n, None) for n in root]
    order = []
    while todo:
        n, _ = todo.pop()
        order.append(n)
        todo += [(c, n) for c in n[2]]
    for n in reversed(order):  # a node ends with its last child; its own line becomes its first child
        if n[2]:
            n[2].insert(0, [n[0], n[2][0][0], []])
            n[1] = n[2][-1][1]
    return root


def _cut_line(text: str, a: int, b: int, room: int) -> list[int]:
    """Ends of runs of at most `room` characters that tile [a, b), at sentence ends, else white space, else anywhere."""
    ends = []
    while b - a > room:
        window = text[a : a + room]
        at = max((m.end() for m in _SENTENCE.finditer(window) if m.end() > room // 2), default=0) or max((m.end() for m in _SPACE.finditer(window)), default=0)
        if not at:
            at = room
            while at > 1 and (unicodedata.combining(text[a + at]) or text[a + at - 1 : a + at + 1] == "\r\n"):
                at -= 1
        a += at
        ends.append(a)
    return [*ends, b]


def cut(text: str, limit: int, overlap: int, markdown: bool) -> list[tuple[int, int, int]]:
    """(start, body_start, end) of each piece, in characters; one piece if the text is within the limit.

    text[start:end] has at most `limit` characters and starts with the `overlap` characters before body_start, all of which
    the piece before holds; the bodies tile the text. An overlap that leaves no room below the limit is an error, a negative
    one is none. An empty text has one empty piece.
    """
    if limit < 1 or overlap >= limit:
        raise ValueError("the limit must be positive and above the overlap")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, overlap)
    room = limit - overlap
    units: list[tuple[int, bool]] = []  # end, and whether a piece has to end there: beside a subtree that is too long for one
    todo = [(*n, False) for n in reversed(_tree(text, markdown))]
    while todo:
        a, b, kids, own = todo.pop()
        if kids is None:  # the end of a subtree
            units[-1] = (b, True)
            continue
        if b - a <= room:
            units.append((b, False))
            continue
        if units and not own:
            units[-1] = (a, True)
        if kids:  # the node's own line stays with what it heads
            todo.append((b, b, None, False))
            todo += [(*k, i == 1) for i, k in reversed(list(enumerate(kids)))]
        else:
            units += [(x, False) for x in _cut_line(text, a, b, room)]
            units[-1] = (b, True)
    pieces, body, last = [], 0, 0
    for end, close in units:
        if end - body > (room if pieces else limit):
            pieces.append((max(0, body - overlap) if pieces else 0, body, last))
            body = last
        last = end
        if close and body < end < len(text):
            pieces.append((max(0, body - overlap) if pieces else 0, body, end))
            body = end
    pieces.append((max(0, body - overlap) if pieces else 0, body, last))
    return pieces


def _pieces(with_text: bool):
    cols = [c.split()[0] for c in PIECES.split(", ")] + ["text"] * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, item, text, limit, overlap, md in zip(b["item_kind"], b["item_id"], b["text"], b["max_chars"], b["overlap_chars"], b["markdown"]):
                out += [(kind, item, k, s, body, e, e - s, *([text[s:e]] if with_text else [])) for k, (s, body, e) in enumerate(cut(text, limit, overlap, md))]
            yield pd.DataFrame(out, columns=cols)

    return run


def oversized(items: DataFrame) -> DataFrame:
    """The items (item_kind, item_id, text, max_chars, overlap_chars, markdown) over their limit. Null texts, limits and ids never are."""
    over = items.where(F.col("item_id").isNotNull() & (F.length("text") > F.col("max_chars")))
    return over.select("item_kind", "item_id", "text", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"), "markdown")


def piece_spans(items: DataFrame) -> DataFrame:
    """PIECES of each oversized item, whole texts whatever their length; repeated rows give their pieces once."""
    return oversized(items).mapInPandas(_pieces(False), PIECES).distinct()


def split_items(items: DataFrame) -> DataFrame:
    """PIECES and the text of each piece, cut in the same pass. Only oversized items are shuffled, once, to take repeated rows out."""
    return oversized(items).dropDuplicates(["item_kind", "item_id"]).mapInPandas(_pieces(True), f"{PIECES}, text string")
