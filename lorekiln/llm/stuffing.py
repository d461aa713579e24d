"""Keyword-stuffed and link-list pages: words covered by repeated maximal substrings, combined with missing clause structure.

A page is read as its words, cut into runs: a run ends at any punctuation mark or other sign between two words and at the end of a line (marks
of quotation, apostrophes and hyphens apart). No word list and no language is assumed. A run holds no clause if

* it is short, at most ``CLAUSE`` words: items of a list, cells of a table, parts of an address, tags; or
* it is made of repeats: its words are covered by repeated maximal substrings of the page, sequences of words that occur
  ``TIMES`` times or more; three quarters of them by sequences of three words or more, four fifths by two or more, or all but a
  few by single words (``SHARES``: the shorter the repeats, the more they must cover). Keywords strung together without a mark, and phrases that differ in one word only, have the length of a
  sentence but not its variety.

Repeats come from the suffix automaton of the page's words: each state stands for the sequences that end at the same
places; the number of these places, added up along the suffix links, tells how often they occur; following each word's state
up to the first that occurs often enough gives the longest such repeat that ends there. Coverage alone would not do, since
prose repeats itself, nor would runs, since keywords need no marks; a page is stuffed if more than ``more_than`` of its words
stand in runs of either kind. Prose has such runs too, seldom for a third of
its words, hence the bound above one half.
Copies of a sentence or line of ``PASSAGE`` words or more
are judged as one, so a passage that is repeated as a whole stays prose.

The automaton takes a whole page, however long: time and memory are linear in its words. It is not built for a page whose words, by
how often each occurs, cannot be covered enough (``most_loose``, a bound, so the rows are the same).

Cases: null, empty and wordless texts are not stuffed; case is ignored; repeated rows are each judged; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAUSE, TIMES, PASSAGE = 3, 3, 8
#: The share of a run's words that repeats must cover, by the least length of the repeats that are counted.
SHARES = {3: 0.75, 2: 0.8, 1: 0.95}
PART = re.compile(r"[^\W_]+")
WORD = re.compile(r"[^\W_]+(?:['’`_-]+[^\W_]+)*")
UNIT = re.compile(r"\n+|(?<=[.!?…;])[\"'”’»)\]}]*\s+")
#: What ends a run: the end of a line, and any sign but white space and marks of quotation, emphasis and hyphenation.
BREAK = re.compile(r"\n|[^\w\s'’`\"“”«»*-]")


def word_runs(text: str) -> list[tuple[list[str], int]]:
    """The words of a text, in runs that no mark and no end of a line divides, with how often the sentence or line occurs."""
    units: list[tuple[list[list[str]], int]] = []
    seen: dict[tuple, int] = {}
    for unit in UNIT.split(text.lower()):
        own = [run for part in BREAK.split(unit) if (run := WORD.findall(part))]
        key = tuple(w for run in own for w in run)
        if len(key) >= PASSAGE and len(set(key)) > len(key) // 2:
            at = seen.setdefault(key, len(units))
            if at < len(units):
                units[at] = (units[at][0], units[at][1] + 1)
                continue
        units.append((own, 1))
    return [(run, times) for own, times in units for run in own]


def longest_repeats(symbols: Sequence, times: int = TIMES) -> list[int]:
    """For each place the length of the longest sequence ending there that occurs ``times`` times or more, by a suffix automaton."""
    nxt: list[dict] = [{}]
    link, length, ends, last, prefix = [-1], [0], [0], 0, []
    for sym in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(1)
        p = last
        while p != -1 and sym not in nxt[p]:
            nxt[p][sym] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][sym]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(0)
                link[q] = link[cur] = copy
                while p != -1 and nxt[p].get(sym) == q:
                    nxt[p][sym] = copy
                    p = link[p]
        last = cur
        prefix.append(cur)
    order = sorted(range(1, len(nxt)), key=length.__getitem__)
    for s in reversed(order):
        ends[link[s]] += ends[s]
    long = [0] * len(nxt)
    for s in order:
        long[s] = length[s] if ends[s] >= times else long[link[s]]
    return [long[s] for s in prefix]


def covered(repeats: Sequence[int], least: int) -> list[bool]:
    """Which places lie in a repeat of ``least`` or more, given the longest repeat that ends at each place."""
    out, reach = [False] * len(repeats), len(repeats)
    for i in range(len(repeats) - 1, -1, -1):
        if repeats[i] >= least:
            reach = min(reach, i + 1 - repeats[i])
        out[i] = reach <= i
    return out


def _size(word: str) -> int:
    return 1 if word.isalnum() else len(PART.findall(word))


def most_loose(runs: list[tuple[list[str], int]]) -> float:
    """A bound on the share that ``page_scores`` can give: words of a repeat occur as often as it does, each by itself."""
    n = Counter(w for run, _ in runs for w in run)
    total = loose = 0
    for run, times in runs:
        size = times * sum(map(_size, run))
        total += size
        if len(run) <= CLAUSE or sum(n[w] >= TIMES for w in run) >= min(SHARES.values()) * len(run):
            loose += size
    return loose / total if total else 0.0


def page_scores(text: str, more_than: float = -1.0) -> tuple[float, float, float]:
    """(share of words in runs without a clause, share in short runs, share covered by repeats of two words or more); zeros if there
    are no words, or where the first can be seen not to be above ``more_than`` from how often single words occur."""
    runs = word_runs(text)
    words = [w for run, _ in runs for w in run]
    if not words or most_loose(runs) <= more_than:
        return 0.0, 0.0, 0.0
    repeats = longest_repeats(words)
    hits = {least: covered(repeats, least) for least in SHARES}
    at = total = loose = short = again = 0
    for run, times in runs:
        size = [_size(w) for w in run]
        end, n = at + len(run), sum(size) * times
        total += n
        again += times * sum(s for s, h in zip(size, hits[2][at:end]) if h)
        if len(run) <= CLAUSE:
            short += n
            loose += n
        elif any(sum(hit[at:end]) >= SHARES[least] * len(run) for least, hit in hits.items()):
            loose += n
        at = end
    return loose / total, short / total, again / total


def stuffed_pages(df: DataFrame, doc_id: str, text: str, more_than: float = 0.63) -> DataFrame:
    """doc, loose, short, repeated of the pages that are stuffed; the shares of ``page_scores``."""
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.length("text") > 0)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc, *score) for doc, t in zip(b["doc"], b["text"]) if (score := page_scores(t, more_than))[0] > more_than]
            yield pd.DataFrame(out, columns=["doc", "loose", "short", "repeated"])

    return rows.mapInPandas(judge, f"doc {rows.schema['doc'].dataType.simpleString()}, loose double, short double, repeated double")
