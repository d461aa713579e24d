"""Splitting oversized items at natural boundaries by packing a tree of their structure.

An item is a tree: headings by rank (outside fenced blocks), blocks between blank lines (a fenced block that fits is one), list items by
their nesting, elements of markup, lines, sentences, clauses, words. A node that fits is a leaf. A node that does not is
opened, and only such a node: neighbouring children that fit are merged, whole, as long as they fit together, and the pieces of
a child that had to be opened stay by themselves. So a cut falls at the highest boundary there is and no piece runs from the
inside of one node into the next.

Limits: a piece is its core plus an overlap, a suffix of the text before it of at most a tenth of the limit that begins
at a sentence or else a word. Cores are packed to nine tenths of the limit; a single unbroken stretch longer than that
but within the limit keeps its place, and its overlap shrinks. Only a stretch without white space longer than the limit is
cut hard, after a punctuation mark where there is one in the last tenth. Compressed and encrypted payloads, which have no
text, are cut hard every ``limit`` bytes less the overlap. The cores of an item put together are the item, byte for byte.

Sizes are code points for text and UTF-8 bytes for payloads; a damaged payload keeps its undecodable bytes as such.
Cases: null, empty and fitting items give no row; of several rows of an item the smallest value counts; items of any
length are split whole; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from high to low; a cut falls at the end of a match. Headings are found by rank, list items by indentation.
_HEADING = re.compile(r"^(#{1,6})[ \t]|<h([1-6])\b", re.M | re.I)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*\n?|\Z)", re.M | re.S)
_ENTRY = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]", re.M)
_BLOCK, _LIST = re.compile(r"\n[ \t]*(?:\n[ \t]*)+"), None
_SENTENCE, _WORD = re.compile(r"[.!?…][\"'”»)\]]*\s+"), re.compile(r"\s+")
_LEVELS = (
    _BLOCK, _LIST, re.compile(r"</(?:section|article|div|table|ul|ol|blockquote|pre)>\s*", re.I), re.compile(r"</(?:p|li|tr|dd|h[1-6])>\s*|<[bh]r\s*/?>\s*", re.I),
    re.compile(r"\n"), _SENTENCE, re.compile(r"[,;:–—][\"'”»)\]]*\s+"), _WORD,
)
_MARK = re.compile(r"[,;:.>}\])/&|]")
SCHEMA = "kind string, key string, piece int, start int, core int, stop int, hard boolean, text string, bytes binary"


class _Item:
    """A text with the size of any stretch of it."""

    def __init__(self, text: str, limit: int, in_bytes: bool):
        self.text, self.limit, self.over = text, limit, limit // 10
        self.room = limit - self.over
        self.off = None
        if in_bytes and not text.isascii():
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            width[(c >= 0xDC80) & (c <= 0xDCFF)] = 1  # an undecodable byte
            self.off = np.concatenate([[0], np.cumsum(width)])
        self.fences = [m.span() for m in _FENCE.finditer(text)]
        self.whole = [f for f in self.fences if self.size(*f) <= self.room]  # those that can stay whole

    def size(self, a: int, b: int) -> int:
        return b - a if self.off is None else int(self.off[b] - self.off[a])

    def inside(self, x: int, spans: list[tuple[int, int]]) -> bool:
        i = bisect_left(spans, (x, -1)) - 1
        return i >= 0 and x < spans[i][1]

    def reach(self, a: int, room: int) -> int:
        """The furthest position at most ``room`` after a, at least one character."""
        if self.off is None:
            return a + room
        return max(a + 1, int(np.searchsorted(self.off, self.off[a] + room, "right")) - 1)

    def children(self, a: int, b: int, level: int) -> tuple[list[tuple[int, int]], int]:
        """The node's parts at the first level that divides it, and the level below."""
        while level < 6 + len(_LEVELS):
            if level < 6:  # headings of this rank or higher begin a part
                cuts = [m.start() for m in _HEADING.finditer(self.text, a, b) if (len(m[1]) if m[1] else int(m[2])) <= level + 1 and m.start() > a and not self.inside(m.start(), self.fences)]
            elif _LEVELS[level - 6] is _LIST:  # the entries of least indentation begin a part, until none is left
                entries = [(len(m[1].expandtabs(4)), m.start()) for m in _ENTRY.finditer(self.text, a, b) if m.start() > a and not self.inside(m.start(), self.fences)]
                cuts = [x for deep, x in entries if deep == min(entries)[0]]
                level -= bool(cuts)
            else:
                cuts = [m.end() for m in _LEVELS[level - 6].finditer(self.text, a, b) if m.end() < b]
                if level == 6:
                    cuts = [x for x in cuts if not self.inside(x, self.whole)]
            level += 1
            if cuts:
                edges = [a, *cuts, b]
                return list(zip(edges, edges[1:])), level
        return [], level

    def pack(self, a: int, b: int, level: int = 0) -> list[tuple[int, int, bool]]:
        """(start, stop, cut hard at its end) of the cores of a node."""
        if self.size(a, b) <= self.room:
            return [(a, b, False)]
        parts, below = self.children(a, b, level)
        if not parts:
            return self.stretch(a, b)
        out: list[tuple[int, int, bool]] = []
        join = False  # whether the last piece is made of whole parts
        for s, e in parts:
            if self.size(s, e) > self.room:
                out, join = out + self.pack(s, e, below), False
            elif join and self.size(out[-1][0], e) <= self.room:
                out[-1] = (out[-1][0], e, False)
            else:
                out.append((s, e, False))
                join = True
        return out

    def stretch(self, a: int, b: int) -> list[tuple[int, int, bool]]:
        """Text without a boundary inside: kept whole within the limit (white space may follow it), else cut hard."""
        word = a + len(self.text[a:b].rstrip())
        if self.size(a, b) <= self.limit:
            return [(a, b, False)]
        out = []
        if self.size(a, word) <= self.limit:  # only the white space after it is too much
            out.append((a, word, False))
            a = word
        while self.size(a, b) > self.room:
            cut = self.reach(a, self.room)
            marks = [m.end() for m in _MARK.finditer(self.text, max(a + 1, cut - self.over), cut)]
            cut = marks[-1] if marks else cut
            out.append((a, cut, not self.text[a:cut].isspace()))
            a = cut
        if a < b:
            out.append((a, b, False))
        return out

    def overlap(self, prev: int, start: int, stop: int) -> int:
        """Where the overlap before a core begins; within the piece before and the limit."""
        room = min(self.over, self.limit - self.size(start, stop))
        first = start
        if room > 0 and start > prev:
            first = start - room if self.off is None else int(np.searchsorted(self.off, self.off[start] - room, "left"))
            first = max(prev, first)
        if first >= start or first == prev:
            return first
        for boundary in (_SENTENCE, _WORD):
            if (m := boundary.search(self.text, first, start)) and m.end() < start:
                return m.end()
        return first if not re.search(r"\s", self.text[first:start]) else start


def split_text(text: str, limit: int, in_bytes: bool = False) -> list[tuple[int, int, int, bool]]:
    """(start with overlap, start of the core, stop, cut hard) of each piece."""
    item, out, prev = _Item(text, limit, in_bytes), [], 0
    for a, b, hard in item.pack(0, len(text)):
        out.append((item.overlap(prev, a, b) if out else a, a, b, hard))
        prev = a
    return out


def _pieces(limit: int, in_bytes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, key, text, raw, opaque in zip(b["kind"], b["key"], b["text"], b["bytes"], b["opaque"]):
                if opaque:
                    raw, step, over = bytes(raw), limit - limit // 10, limit // 10
                    n = max(1, -(-(len(raw) - over) // step))
                    rows += [(kind, key, i, i * step, i * step + (over if i else 0), min(len(raw), i * step + limit), True, None, raw[i * step : i * step + limit]) for i in range(n)]
                    continue
                text = text if text is not None else bytes(raw).decode("utf-8", "surrogateescape")
                for i, (s, c, e, hard) in enumerate(split_text(text, limit, in_bytes)):
                    part = text[s:e]
                    data = part.encode("utf-8", "surrogateescape") if in_bytes else None
                    rows.append((kind, key, i, s, c, e, hard, part.encode("utf-8", "replace").decode() if in_bytes else part, data))
            yield pd.DataFrame(rows, columns=["kind", "key", "piece", "start", "core", "stop", "hard", "text", "bytes"])

    return run


def split_oversized(df: DataFrame, kind: str, key: Column, value: Column, limit: int, opaque: Column | None = None) -> DataFrame:
    """kind, key, piece, start, core, stop, hard, text, bytes: the pieces of every item larger than ``limit``.

    ``value``: a string (limit in code points) or binary (limit in bytes). ``opaque``: true for values that hold no text.
    ``text[start:core]`` is shared with the piece before; ``hard``: the piece ends inside a stretch that had to be cut.
    """
    in_bytes = df.select(value.alias("v")).dtypes[0][1] == "binary"
    big = F.octet_length(value) > limit if in_bytes else F.length(value) > limit
    rows = df.filter(big & key.isNotNull()).select(key.alias("key"), value.alias("v"), (F.lit(False) if opaque is None else F.coalesce(opaque, F.lit(False))).alias("opaque"))
    rows = rows.groupBy("key").agg(F.min(F.struct("v", "opaque")).alias("m"))
    rows = rows.select(F.lit(kind).alias("kind"), "key", (F.lit(None).cast("string") if in_bytes else F.col("m.v")).alias("text"), (F.col("m.v") if in_bytes else F.lit(None).cast("binary")).alias("bytes"), F.col("m.opaque").alias("opaque"))
    return rows.mapInPandas(_pieces(limit, in_bytes), SCHEMA)
