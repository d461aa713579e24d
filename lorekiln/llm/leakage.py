"""Evaluation passages inside training documents: MinHash containment search over equal-sized windows, verified exactly.

A short passage inside a long document has a small share of the document's shingles, so a sketch of the whole document
hardly ever meets it. Containment search therefore works by size: whatever the document's size, it is partitioned into
overlapping windows of the smallest size that counts as a leak, ``run`` words or ``run - 4`` five-word shingles, and each
window's MinHash (the smallest of its shingle hashes) is its key. A passage is indexed by the same windows. A common run
of ``run`` words is one whole window on both sides, with the same MinHash, so no leak is missed, in a document of any
size. Windows that share a MinHash are candidates only; a candidate counts if its ``run`` words equal a run of the passage.

Windows take the partition by size to its end: in a partition of documents of x shingles, an item of q shingles that shares
the 8 of a run has a Jaccard similarity of 8 / (x + q - 8), a few hundredths for whole pages, which no affordable number of
hashes finds; between windows of the run's own size it is 1 (figures in the README).

The passages are held-out items, few beside the corpus; their number of characters is checked. Up to ``BROADCAST_CHARS`` the
index goes to every task and documents are read once, without a shuffle. Beyond, the MinHashes of documents and passages are
joined to find the documents that may leak, and the windows of these meet those of the passages by MinHash and words, so texts travel once
however many items share a hash; both ways give the same rows.

Words are runs of letters and digits; case and accents are ignored. Cases: null or short texts and passages match nothing, null ids
give no row; repeated passages all count; a repeated document or item gives its rows once; very long texts are read whole; empty tables give none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stages import write_stage

BROADCAST_CHARS, SHINGLE = 8_000_000, 5
WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ҃-҉֑-ֽً-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        return WORD.findall(text)
    return WORD.findall(text.lower())


class WindowHasher:
    """The MinHash of each window of ``run`` words."""

    def __init__(self, run: int):
        self.run, self.seen = run, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(words) < self.run:
            return np.array([], dtype=np.uint64)
        if len(self.seen) > 500_000:
            self.seen.clear()
        seen, get = self.seen, self.seen.get
        h = np.fromiter([g if (g := get(w)) is not None else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], dtype=np.uint64, count=len(words))
        n = len(h) - SHINGLE + 1
        s = h[:n].copy()
        for i in range(1, SHINGLE):
            s = s * _STEP + h[i : n + i]
        s = (s ^ (s >> np.uint64(31))) * _M1
        s = (s ^ (s >> np.uint64(27))) * _M2
        width, at = self.run - SHINGLE + 1, 1
        while at * 2 <= width:  # minima of 2, 4, 8 ... shingles, then of the rest
            s, at = np.minimum(s[:-at], s[at:]), at * 2
        return np.minimum(s[: len(s) - (width - at)], s[width - at :]) if width > at else s


def _index(passages: list[tuple[int, str]], run: int) -> tuple[np.ndarray, dict[str, list[int]]]:
    """Sorted MinHashes of all windows, and the items of every run of words."""
    hasher, keys, runs = WindowHasher(run), [], defaultdict(set)
    for item, passage in passages:
        words = plain_words(passage)
        keys.append(hasher(words))
        for i in range(len(words) - run + 1):
            runs[" ".join(words[i : i + run])].add(item)
    return np.unique(np.concatenate(keys)) if keys else np.array([], dtype=np.uint64), {k: sorted(v) for k, v in runs.items()}


def _hits(keys: np.ndarray, windows: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
    return np.nonzero(keys[at] == windows)[0]


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, run: int = 12, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """doc, item: every document with ``run`` or more consecutive words in common with an item's passage; distinct."""
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") > 0))
    i = items.select(F.col(item_id).cast("long").alias("item"), F.col(passage).alias("passage")).filter(F.col("item").isNotNull() & F.col("passage").isNotNull())
    if (i.agg(F.sum(F.length("passage"))).first()[0] or 0) > broadcast_chars:
        return _find_by_join(d, i, run)
    keys, runs = _index([tuple(r) for r in i.collect()], run)  # within the bound just checked

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WindowHasher(run)
        for b in batches:
            out = []
            for doc, t in zip(b["doc"], b["text"]):
                words = plain_words(t)
                windows = hasher(words)
                if len(keys) and len(windows) and len(hit := _hits(keys, windows)):
                    found = set()
                    for w in hit:
                        found.update(runs.get(" ".join(words[w : w + run]), ()))
                    out += [(doc, x) for x in sorted(found)]
            yield pd.DataFrame(out, columns=["doc", "item"])

    return d.mapInPandas(scan, f"doc {d.schema['doc'].dataType.simpleString()}, item bigint").distinct()


def _find_by_join(d: DataFrame, i: DataFrame, run: int) -> DataFrame:
    kind = d.schema["doc"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WindowHasher(run)
        for b in batches:
            for doc, t in zip(b["doc"], b["text"]):
                got = np.unique(hasher(plain_words(t)))
                if len(got):
                    yield pd.DataFrame({"doc": [doc] * len(got), "key": got.view(np.int64)})

    def windows(id_: str, text: str):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hasher = WindowHasher(run)
            for b in batches:
                for x, t in zip(b[id_], b[text]):
                    words = plain_words(t)
                    got = hasher(words)
                    if len(got):
                        yield pd.DataFrame({id_: [x] * len(got), "key": got.view(np.int64), "words": [" ".join(words[k : k + run]) for k in range(len(got))]})

        return go

    own = write_stage(i.mapInPandas(windows("item", "passage"), "item bigint, key bigint, words string").distinct())
    maybe = write_stage(d.mapInPandas(keys, f"doc {kind}, key bigint").join(own.df.select("key").distinct(), "key", "left_semi").select("doc").distinct())
    found = d.join(maybe.df, "doc", "left_semi").mapInPandas(windows("doc", "text"), f"doc {kind}, key bigint, words string")
    return found.join(own.df, ["key", "words"]).select("doc", "item").distinct()
