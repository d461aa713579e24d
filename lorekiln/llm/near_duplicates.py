"""Near-duplicate records by pigeonring filtering of sketches, verified on exact shingle sets.

A record's set of word shingles is sketched as ``SEGMENTS`` x ``WIDTH`` min-hashes, arranged in segments on a ring. Two
sketches are compared in the Hamming space of positions: a pair of Jaccard similarity J differs in a share 1-J of them,
so at most ``budget`` positions (mean plus 3.3 standard deviations at the threshold).

1. Records with equal shingle and tag sets form a class; only its representative (smallest id) is compared, so a group of
   copies costs nothing however large.
2. Representatives that agree in a whole segment meet: one row per segment, joined by key. The row carries, in two bits a position,
   the next ``FOLLOW`` segments around the ring.
3. Pigeonring: if the differences around the ring sum to at most a budget, then from some segment on every chain of consecutive
   segments stays within its proportional share. The chain that begins at the common segment is grown inside the join, a segment
   at a time, and the pair is dropped at the first prefix beyond its share, before any sketch is fetched and before pairs are made
   distinct. (Two bits show three quarters of the differences; the budget is that of the differences shown.)
4. The sketches of the survivors are fetched and the full Hamming distance must keep the budget.
5. The pair is verified on its exact shingle and tag sets, made from the whole texts.

The principle's first link, a segment with at most its share of differences (1 of 3 at similarity 0.6), would take three wildcard keys a
segment and would let nearly all pairs through; the common segment is asked to be equal instead. A pair at the threshold (0.6) has no
equal segment with a chance of (1-0.6^3)^28 = 0.11 %, more similar pairs far less; the chains lose next to nothing, since
several segments are equal (README: pairs before and after, recall).

A segment that very many records share (estimated on a fixed share of them) is cut into blocks that meet each other in different tasks; its
pairs are tested where they meet and only survivors leave the join.

Cases: null, blank or too short texts and, where tags are asked for, unreadable or empty tags put a record in no pair;
repeated ids count once (one of their rows, chosen by hash); texts of any length are used whole; an empty table gives none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stages import Scope, Stage, write_stage

SEGMENTS, WIDTH, FOLLOW = 28, 3, 20
BROADCAST_IDS, CLASS_BLOCK = 200_000, 2048
#: A key is split if, on one in ``HOT_SHARE`` of the records, it is likely to have more than ``HOT_BLOCK`` of all.
HOT_SHARE, HOT_BLOCK = 32, 8192
WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(11)
_MUL = (_rng.integers(0, 2**31, SEGMENTS * WIDTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, SEGMENTS * WIDTH, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; the hash of a word is remembered, within a bound."""

    def __init__(self, size: int, least_words: int):
        self.size, self.least, self.seen = size, max(least_words, size), {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        words = "\0".join(WORD.findall(text or "")).lower().split("\0")
        if len(words) < self.least:
            return None
        if len(self.seen) > 500_000:
            self.seen.clear()
        seen, get = self.seen, self.seen.get
        h = np.fromiter([g if (g := get(w)) is not None else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], dtype=np.uint64, count=len(words))
        s = h[: len(h) - self.size + 1].copy()
        for i in range(1, self.size):
            s = s * _STEP + h[i : len(h) - self.size + 1 + i]
        return np.unique(_mix(s))


def tag_set(tags: str | None) -> frozenset[str] | None:
    """The trimmed, lower-cased tags of a readable, non-empty JSON array, else None."""
    try:
        got = json.loads(tags) if tags else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, list) or not got:
        return None
    return frozenset((t if isinstance(t, str) else json.dumps(t)).strip().lower() for t in got)


def _class(sh: np.ndarray, tags: frozenset) -> bytes:
    """A hash of both sets."""
    whole = xxhash.xxh3_128(sh.tobytes())
    whole.update("\0".join(sorted(tags)).encode("utf-8", "surrogatepass"))
    return whole.digest()


def _sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The min-hashes of several sets at once, one row a set."""
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(_MUL), len(sets)), dtype=np.uint32)
    for j in range(len(_MUL)):
        low[j] = np.minimum.reduceat(h * _MUL[j] + _ADD[j], starts)
    return (low.T & np.uint32(0xFFFF)).astype("<u2")  # of a minimum only the lower bits are evenly spread


def _ring(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment of each sketch two numbers: the lowest two bits of each position of the ``FOLLOW`` segments after it, half of them each."""
    half = FOLLOW * WIDTH // 2
    at = (np.arange(SEGMENTS)[:, None] * WIDTH + WIDTH + np.arange(FOLLOW * WIDTH)[None, :]) % (SEGMENTS * WIDTH)
    shift = np.arange(half, dtype=np.int64) * 2
    follow = (sketches & 3).astype(np.int64)[:, at]
    return (follow[:, :, :half] << shift).sum(axis=2), (follow[:, :, half:] << shift).sum(axis=2)


def _records(df: DataFrame, id_col: str, text: str, tags: str | None) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), (F.col(tags) if tags else F.lit(None).cast("string")).alias("tags")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())


def _sketches(rows: DataFrame, shingle: int, least_words: int, with_tags: bool) -> DataFrame:
    """id, class, sketch of every record that can be in a pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle, least_words)
        for b in batches:
            ids, kinds, sets, size = [], [], [], 0
            for i, text, tags in zip(b["id"], b["text"], b["tags"]):
                t = tag_set(tags) if with_tags else frozenset()
                if t is None or (sh := shingler(text)) is None:
                    continue
                ids.append(i)
                kinds.append(_class(sh, t))
                sets.append(sh)
                size += len(sh)
                if size > 16_384:  # what the arrays of a pass fit in the cache with
                    yield pd.DataFrame({"id": ids, "class": kinds, "sketch": [r.tobytes() for r in _sketch(sets)]})
                    ids, kinds, sets, size = [], [], [], 0
            if ids:
                yield pd.DataFrame({"id": ids, "class": kinds, "sketch": [r.tobytes() for r in _sketch(sets)]})

    return rows.mapInPandas(run, "id string, class binary, sketch binary")


def _budget(positions: int, similarity: float, shown: float = 1.0) -> int:
    """The most differences of a pair at the threshold: mean and 3.3 standard deviations; ``shown``: the share of differences that is seen."""
    p = (1 - similarity) * shown
    return int(np.ceil(positions * p + 3.3 * np.sqrt(positions * p * (1 - p))))


def _keys(reps: DataFrame) -> DataFrame:
    """key, u, near, far: one row per segment of a sketch, with the segments that follow it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                s = np.frombuffer(b"".join(part["sketch"]), dtype="<u2").reshape(len(part), -1)
                seg = s.reshape(len(part), SEGMENTS, WIDTH).astype(np.uint64)
                key = np.arange(SEGMENTS, dtype=np.uint64)[None, :]
                for j in range(WIDTH):
                    key = _mix(key * _STEP + seg[:, :, j])
                near, far = _ring(s)
                yield pd.DataFrame({"key": key.view(np.int64).ravel(), "u": np.repeat(part["u"].to_numpy(), SEGMENTS), "near": near.ravel(), "far": far.ravel()})

    return reps.select("u", "sketch").mapInPandas(run, "key bigint, u bigint, near bigint, far bigint")


def _chain_holds(budget: int) -> Column:
    """Whether every chain from the common segment on stays within its share of the differences shown, the shortest first."""
    half, ok = FOLLOW // 2, F.col("u") < F.col("u2")
    odd = 0x5555555555555555
    parts = []
    for c in ("near", "far"):
        x = F.col(c).bitwiseXOR(F.col(c + "2"))
        parts.append(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(odd)))
    for length in range(2, FOLLOW + 2):
        followers = length - 1
        seen = F.bit_count(parts[0].bitwiseAND(F.lit(4 ** (WIDTH * min(followers, half)) - 1)))
        if followers > half:
            seen = seen + F.bit_count(parts[1].bitwiseAND(F.lit(4 ** (WIDTH * (followers - half)) - 1)))
        if followers in (1, 2, 3, 4, 6, 8, half, 15, FOLLOW):
            ok = ok & (seen <= length * budget // SEGMENTS)
    return ok


def _meet(keys: DataFrame, reps: DataFrame, budget: int) -> DataFrame:
    """u, u2: pairs that agree in a segment from which the chains hold."""
    sample = _keys(reps.filter(F.pmod(F.xxhash64("u", F.lit(9)), F.lit(HOT_SHARE)) == 0)).groupBy("key").count()
    hot = write_stage(sample.filter(F.col("count") > HOT_BLOCK // HOT_SHARE).select("key", F.ceil(F.col("count") * HOT_SHARE / HOT_BLOCK).cast("int").alias("blocks")))
    left = keys
    right = keys.withColumnsRenamed({"u": "u2", "near": "near2", "far": "far2"})
    on = ["key"]
    if not hot.df.isEmpty():
        blocks = F.coalesce("blocks", F.lit(1))
        left = left.join(hot.df, "key", "left").withColumn("block", F.pmod(F.xxhash64("u", F.lit(4)), blocks).cast("int")).drop("blocks")
        right = right.join(hot.df, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        on = ["key", "block"]
    return left.join(right, on).filter(_chain_holds(budget)).select("u", "u2").distinct()


def _sets(rows: DataFrame, shingle: int, least_words: int, with_tags: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle, least_words)
        for b in batches:
            out = []
            for u, c, text, tags in zip(b["u"], b["class"], b["text"], b["tags"]):
                sh, t = shingler(text), tag_set(tags) if with_tags else frozenset()
                if sh is not None and t is not None and _class(sh, t) == bytes(c):  # not another row of the same id
                    out.append((u, sh.tobytes(), sorted(t)))
            yield pd.DataFrame(out, columns=["u", "sh", "tags"])

    return rows.mapInPandas(run, "u bigint, sh binary, tags array<string>")


class NearDuplicates:
    """``members`` (id, class, rep) and ``links`` (rep_a, rep_b, jaccard): copies by class, and links between classes."""

    def __init__(self, members: Stage, links: Stage):
        self._members, self._links = members, links

    @property
    def members(self) -> DataFrame:
        return self._members.df

    @property
    def links(self) -> DataFrame:
        return self._links.df

    def pairs(self) -> DataFrame:
        """id_a, id_b: every pair of different ids, copies included. As long as the answer is, so only where it is asked for."""
        m = self.members.select("id", "rep")
        size = m.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / CLASS_BLOCK).cast("int").alias("blocks")).filter(F.col("blocks") > 1)
        split = m.join(size, "rep", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # so that a large class is made by many tasks
        one = split.select(F.col("id").alias("id_a"), "rep", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
        two = split.select(F.col("id").alias("id_b"), "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        same = one.join(two, ["rep", "block"]).filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
        a, b = m.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
        cross = self.links.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return same.unionByName(cross)

    def degrees(self) -> DataFrame:
        """id, class_id, copies, links: copies besides itself, and links of its class to other classes."""
        both = self.links.select(F.col("rep_a").alias("rep")).unionByName(self.links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        size = self.members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("copies"))
        return self.members.select("id", "rep").join(size, "rep").join(both, "rep", "left").select("id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(df: DataFrame, id_col: str, text: str, tags: str | None = None, similarity: float = 0.8, tag_similarity: float = 0.0, shingle: int = 5, least_words: int = 5, broadcast_ids: int = BROADCAST_IDS) -> NearDuplicates:
    """Pairs whose word shingles have a Jaccard similarity of ``similarity`` or more and whose tags one of ``tag_similarity``."""
    with Scope() as scope:
        members, links = _find(df, id_col, text, tags, similarity, tag_similarity, shingle, least_words, broadcast_ids)
        return NearDuplicates(scope.keep(members), scope.keep(links))


def _find(df: DataFrame, id_col: str, text: str, tags: str | None, similarity: float, tag_similarity: float, shingle: int, least_words: int, broadcast_ids: int) -> tuple[Stage, Stage]:
    rows, with_tags = _records(df, id_col, text, tags), tags is not None
    positions = SEGMENTS * WIDTH
    budget = _budget(positions, similarity)
    made = write_stage(_sketches(rows, shingle, least_words, with_tags))
    # of repeated rows of an id, and of rows of a class, one each; the maximum and minimum are taken before the shuffle
    own = made.df.groupBy("id").agg(F.min("class").alias("class"))
    rep = own.groupBy("class").agg(F.min("id").alias("rep"))
    members = write_stage(own.join(rep, "class"))
    heads = members.df.filter(F.col("id") == F.col("rep")).select("id", "class")
    sketches = write_stage(made.df.join(heads, ["id", "class"], "left_semi").dropDuplicates(["id", "class"]).withColumn("u", F.xxhash64("class")))
    made.release()
    reps = sketches.df
    cand = _meet(_keys(reps), reps, _budget(positions, similarity, 0.75))
    left, right = reps.select("u", F.col("id").alias("id_a"), F.col("sketch").alias("s1")), reps.select(F.col("u").alias("u2"), F.col("id").alias("id_b"), F.col("sketch").alias("s2"))

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), dtype="<u2").reshape(len(b), -1) for c in ("s1", "s2"))
                yield b[(x != y).sum(axis=1) <= budget][["u", "u2", "id_a", "id_b"]]

    close = write_stage(cand.join(left, "u").join(right, "u2").mapInPandas(full, "u bigint, u2 bigint, id_a string, id_b string"))
    wanted = close.df.select(F.col("u"), F.col("id_a").alias("id")).unionByName(close.df.select(F.col("u2").alias("u"), F.col("id_b").alias("id"))).distinct().join(reps.select("u", "id", "class"), ["u", "id"])
    if close.df.count() <= broadcast_ids // 2:  # so few ids go to the texts; more ids meet them by a shuffle
        wanted = F.broadcast(wanted)
    sets = write_stage(_sets(rows.join(wanted, "id").select("u", "class", "text", "tags"), shingle, least_words, with_tags).dropDuplicates(["u"]))
    a, b = sets.df.withColumnsRenamed({"sh": "sh1", "tags": "t1"}), sets.df.withColumnsRenamed({"u": "u2", "sh": "sh2", "tags": "t2"})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            js, ok = np.zeros(len(p)), np.zeros(len(p), dtype=bool)
            for i, (x, y, t, s) in enumerate(zip(p["sh1"], p["sh2"], p["t1"], p["t2"])):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                js[i] = both / (len(x) + len(y) - both)
                t, s = set(t), set(s)
                ok[i] = js[i] >= similarity - 1e-12 and (not with_tags or len(t & s) >= tag_similarity * len(t | s) - 1e-12)
            yield pd.DataFrame({"rep_a": p["id_a"], "rep_b": p["id_b"], "jaccard": js})[ok]

    checked = close.df.join(a, "u").join(b, "u2").select("id_a", "id_b", "sh1", "sh2", "t1", "t2").mapInPandas(verify, "rep_a string, rep_b string, jaccard double")
    return members, write_stage(checked.groupBy("rep_a", "rep_b").agg(F.max("jaccard").alias("jaccard")))


def link_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, group: connected components by alternating large and small stars; group is the smallest node.

    Every step is an aggregation and a join on nodes; a node with very many links is never gathered.
    """
    edges = write_stage(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter(F.col("x") != F.col("y")).distinct())
    mark = lambda s: s.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    before = None
    while (now := mark(edges)) != before:
        before = now
        both = edges.df.unionByName(edges.df.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = write_stage(both.join(low, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = large.df.groupBy("x").agg(F.min("y").alias("m"))
        small = large.df.join(low, "x")
        nxt = write_stage(small.filter(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).distinct())
        edges.release()
        large.release()
        edges = nxt
    out = edges.df
    return out.select(F.col("x").alias("node"), F.col("y").alias("group")).unionByName(out.select(F.col("y").alias("node"), F.col("y").alias("group")).distinct())
