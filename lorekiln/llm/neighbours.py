"""Nearest neighbours of every vector by collision-counting hashing, query-aware, inside coarse cells.

Coarse cells (``vectors.Cells``): a vector's home is the cell whose point is nearest, one cell for about ``CELL`` vectors, fitted on
a bounded sample of about ``SAMPLE`` vectors; a query visits its ``probes`` nearest cells, so what is sent grows in proportion to the
table at every size. Where more than ``MOST`` cells are wanted, points are made of a centre and a direction; a cell that comes
out far too full is fitted again on its own vectors. A cell is cut into blocks of at most ``BLOCK`` vectors, each met by chunks of
at most ``BLOCK`` queries, so no task holds more than two blocks.

In a block: M single random projections, each a sorted array of the block's projected values. A query opens a window
centred on its own projected value in each array; the rows inside it collide. A window is read off the array as a set of
rows (the difference of two prefixes of the array, one bit a row), and collisions are counted on such sets in binary, 64 rows
a word. Windows start narrow and widen (virtual rehashing: the arrays stay, only the window's ends move): a query ends
with the narrow window if more than k verified rows lie within the radius it stands for, else with the one of the wanted
least cosine. Only rows with at least L of M collisions are verified by their exact cosine. The half-width is RATIO times
the radius, so that a vector inside the radius collides in one array with probability 2*Phi(RATIO)-1 = 0.80; with M = 32 and
L = 18 it is missed with a chance under 0.1 %.

Vectors travel to the blocks in half precision, which the block's bounds allow for; the pairs found there are verified once
more on the vectors themselves.

Equal vectors are one vector with several ids: only the representative is searched for; each list takes the k+1 smallest
ids of an equal group, which is all that a list of k can hold (a ranking cut before the shuffle), so no pairs within a group are formed.

Cases: rows without a usable vector or id are left out; repeated ids count once; ties go to the smaller id; an empty
table, or one with a single vector, gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.llm.vectors import place_in_cells, unpack
from lorekiln.plans.stages import Scope, write_stage

#: HALF: how far a cosine of vectors in half precision may be off.
HALF = 0.002
SAMPLE, MOST, CELL, BLOCK, PROBES, ARRAYS, ENOUGH, RATIO, SEED = 16_384, 2048, 1024, 2048, 4, 32, 18, 1.28, 7
#: Widening: parts of the last radius, and the arrays and collisions that tell whether a narrow window can be the last.
PARTS, LOOK, LOOK_ENOUGH, GRID, EDGE = (0.25, 1.0), 8, 5, 1024, 8.0


class _Arrays:
    """The sorted projections of a block. A window of an array is a set of rows, held as one bit a row, made from two prefixes."""

    def __init__(self, base: np.ndarray, proj: np.ndarray):
        values = base @ proj
        order = np.argsort(values, axis=0, kind="stable")
        grid = np.linspace(-EDGE, EDGE, GRID + 1, dtype=values.dtype)  # window ends are rounded outwards to this grid
        self.rank = np.array([np.searchsorted(v, grid) for v in np.take_along_axis(values, order, 0).T])
        self.rank[:, 0], self.rank[:, -1] = 0, len(base)
        n, words = len(base), -(-len(base) // 64)
        self.first = np.zeros((proj.shape[1], n + 1, words), dtype=np.uint64)  # [m, r]: the r rows of smallest value
        rank = np.arange(1, n + 1)
        for m in range(proj.shape[1]):
            self.first[m, rank, order[:, m] >> 6] = np.uint64(1) << (order[:, m] & 63).astype(np.uint64)
            np.bitwise_or.accumulate(self.first[m], axis=0, out=self.first[m])

    def window(self, m: int, at: np.ndarray, half: float) -> np.ndarray:
        """For each query the rows whose value in array m is within ``half`` of the query's."""
        step = GRID / (2 * EDGE)
        lo, hi = np.floor((at - half + EDGE) * step), np.ceil((at + half + EDGE) * step)
        lo, hi = (self.rank[m].take(np.clip(x, 0, GRID).astype(np.intp)) for x in (lo, hi))
        out = self.first[m].take(hi, axis=0)
        return np.bitwise_xor(out, self.first[m].take(lo, axis=0), out=out)


def _collided(sets: Iterator[np.ndarray], enough: int) -> np.ndarray:
    """The rows, as bits, that are in at least ``enough`` of the sets: collisions are counted in binary, one bit plane a digit."""
    planes: list[list[np.ndarray]] = [[] for _ in range(8)]

    def add(x: np.ndarray, digit: int) -> None:
        planes[digit].append(x)
        if len(planes[digit]) == 3:
            a, b, c = planes[digit]
            one = a ^ b
            planes[digit] = [one ^ c]
            add((a & b) | (one & c), digit + 1)

    for x in sets:
        add(x, 0)
    for digit in range(7):
        if len(planes[digit]) == 2:
            a, b = planes[digit]
            planes[digit] = [a ^ b]
            add(a & b, digit + 1)
    more, same = np.uint64(0), ~np.uint64(0)
    for digit in range(7, -1, -1):
        p = planes[digit][0] if planes[digit] else np.uint64(0)
        if enough >> digit & 1:
            same = same & p
        else:
            more, same = more | (same & p), same & ~p
    return more | same


def _search(base: np.ndarray, query: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, cosine) of cosine ``least`` or more, found by counting collisions."""
    proj = np.random.default_rng(SEED).standard_normal((base.shape[1], ARRAYS)).astype("f4")
    arrays, pq = _Arrays(base, proj), (query @ proj).T.copy()
    far = float(np.sqrt(max(0.0, 2 - 2 * least)))
    active, out = np.arange(len(query)), []
    for part in PARTS:
        radius = far * part
        count = lambda rows, m, enough, radius=radius: _collided((arrays.window(i, pq[i, rows], RATIO * radius) for i in range(m)), enough)
        ask = active
        if part < 1 and len(active):  # only queries that a first look gives more than k rows can end with this window
            ask = active[np.bitwise_count(count(active, LOOK, LOOK_ENOUGH)).sum(axis=1) > k]
        if not len(ask):
            continue
        met = count(ask, ARRAYS, ENOUGH)
        qi, wi = np.nonzero(met)
        bits = np.unpackbits(met[qi, wi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        qi, bi = qi[at], wi[at] * 64 + bit
        cos = np.einsum("ij,ij->i", query[ask[qi]], base[bi])
        done = np.bincount(qi[cos >= 1 - radius * radius / 2], minlength=len(ask)) > k  # the query itself may be among them
        final = done if part < 1 else np.ones(len(ask), dtype=bool)
        ok = (cos >= least) & final[qi]
        out.append((ask[qi[ok]], bi[ok], cos[ok]))
        active = np.setdiff1d(active, ask[final], assume_unique=True)
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.array([], int),) * 3


def _best(side: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k of largest cosine of their side's vector, ties with the k-th included."""
    order = np.lexsort((-cos, side))
    first = np.concatenate([[True], side[order][1:] != side[order][:-1]]) if len(order) else np.array([], dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    rank = np.arange(len(order)) - start
    kth = np.full(len(order), -2.0)
    at_k = np.minimum(start + k - 1, len(order) - 1)
    same = side[order][at_k] == side[order] if len(order) else first
    kth[same] = cos[order][at_k][same]
    keep = np.zeros(len(order), dtype=bool)
    keep[order] = (rank < k) | (cos[order] >= kth - 2 * HALF)
    return keep


def similar_pairs(vectors: DataFrame, dim: int, k: int, least: float, probes: int = PROBES, most: int = MOST) -> DataFrame:
    """a, b, cos, a < b: pairs of different vectors (rows u, v; u a hash of v) of cosine ``least`` or more, for lists of k.

    A pair that is in neither vector's k best of a block cannot be in a list of k, so a block gives at most k rows (and
    ties) a vector, however dense it is.
    """
    seen, cells = place_in_cells(vectors, "u", dim, CELL, probes, most, SAMPLE)
    if seen is None:
        return vectors.sparkSession.createDataFrame([], "a bigint, b bigint, cos double")
    slice_ = lambda col, n_: F.pmod(F.xxhash64(F.col(col), F.lit(1)), F.col(n_)).cast("int")
    homes = seen.df.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("nb"))
    visits = seen.df.select(F.explode("cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    need = homes.join(visits, "cell").select("cell", F.ceil(F.col("nb") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("chunks"))
    if cells.n <= 2 * MOST:
        need = F.broadcast(need)  # one row per cell
    # in a cell of one block and one chunk a vector at home is sent once, as both
    both = (F.col("blocks") == 1) & (F.col("chunks") == 1)
    base = seen.df.select("u", "w", F.col("home").alias("cell")).join(need, "cell").select("cell", slice_("u", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "u", "w", F.lit(True).alias("own"), both.alias("asks"))
    query = seen.df.select("u", "w", "home", F.explode("cell").alias("cell")).join(need, "cell").filter(~(both & (F.col("cell") == F.col("home"))))
    query = query.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), slice_("u", "chunks").alias("chunk"), "u", "w", F.lit(False).alias("own"), F.lit(True).alias("asks"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        b, q = pdf[pdf["own"]], pdf[pdf["asks"]]
        if not len(b) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "cos": []})
        half = lambda w: np.frombuffer(b"".join(w), dtype="<f2").reshape(len(w), dim).astype("f4")
        x, y, ub, uq, found = half(b["w"]), half(q["w"]), b["u"].to_numpy(), q["u"].to_numpy(), []
        for at in range(0, len(x), 2 * BLOCK):  # hashing fills blocks unevenly
            qi, bi, cos = _search(x[at : at + 2 * BLOCK], y, k, least - HALF)
            found.append((uq[qi], ub[at + bi], cos))
        qa, ba, cos = (np.concatenate(p) for p in zip(*found))
        other = qa != ba
        qa, ba, cos = qa[other], ba[other], cos[other]
        keep = _best(qa, cos, k) | _best(ba, cos, k)
        lo, hi = np.minimum(qa, ba)[keep], np.maximum(qa, ba)[keep]
        return pd.DataFrame({"a": lo, "b": hi, "cos": cos[keep].astype("float64")}).drop_duplicates(["a", "b"])

    met = write_stage(base.unionByName(query).groupBy("cell", "block", "chunk").applyInPandas(meet, "a bigint, b bigint, cos double").select("a", "b").distinct())

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                cos = np.einsum("ij,ij->i", unpack(p["va"], dim).astype("f8"), unpack(p["vb"], dim).astype("f8"))
                yield p[["a", "b"]].assign(cos=cos)[cos >= least - 1e-7]

    one, two = vectors.select(F.col("u").alias("a"), F.col("v").alias("va")), vectors.select(F.col("u").alias("b"), F.col("v").alias("vb"))
    seen.release()
    return met.df.join(one, "a").join(two, "b").mapInPandas(verify, "a bigint, b bigint, cos double")


def neighbour_lists(usable: DataFrame, dim: int, k: int, least: float, probes: int = PROBES) -> DataFrame:
    """id, other, cos, rank: of every id the up to k most similar other ids with a cosine of ``least`` or more.

    ``usable`` as made by ``usable_vectors``. Ranks go by cosine descending, then id.
    """
    with Scope() as scope:
        return scope.keep(write_stage(_lists(usable, dim, k, least, probes))).df


def _lists(usable: DataFrame, dim: int, k: int, least: float, probes: int) -> DataFrame:
    rows = write_stage(usable.select("id", "v", F.xxhash64("v").alias("u")))
    first = F.row_number().over(Window.partitionBy("u").orderBy("id"))
    reps = write_stage(rows.df.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("u").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    pairs = similar_pairs(reps.df.select("u", "v"), dim, k, least, probes)
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("w"), "cos").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("w"), "cos"))
    other = both.join(reps.df.select(F.col("u").alias("w"), "ids"), "w").select("u", "cos", F.explode("ids").alias("other"))
    equal = reps.df.select("u", F.lit(1.0).alias("cos"), F.explode("ids").alias("other"))
    # by u the k+1 best; a cosine is rounded so that the order of a sum does not decide a tie
    near = F.row_number().over(Window.partitionBy("u").orderBy("far", "other"))
    best = other.unionByName(equal).select("u", (-F.round("cos", 6)).alias("far"), "other").withColumn("r", near).filter(F.col("r") <= k + 1)
    best = best.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("far", "other"))).alias("p"))
    mine = rows.df.select("id", "u").join(best, "u").select("id", F.posexplode(F.slice(F.filter("p", lambda p: p["other"] != F.col("id")), 1, k)).alias("i", "p"))
    return mine.select("id", F.col("p.other").alias("other"), (-F.col("p.far")).alias("cos"), (F.col("i") + 1).alias("rank"))
