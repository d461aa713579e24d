"""Similarity clusters by parallel pivot correlation clustering on smoothed rows, described by medoids.

Copies: equal vectors count once, and near copies too: a row with n rows within ``copies``, itself included, has a weight of 1 / n.
So copies are no cluster and hide none, and all rows take part: in a large cluster many members are that close by chance.

Rounds: of the rows that are in no cluster yet, the first ``FIRST`` in the order of a hash of their id, ``MORE`` times as many
in each round, are candidates; in the last round all that are left, so every row has been a candidate or was absorbed. A
single row is far from its group's direction and meets many rows by chance, so a candidate is smoothed: it moves to
the mean of the rows within ``RADII`` of it, in steps. What lies within ``INNER`` of it then is a group if it has ``least`` rows or more
and the mean cosine of its pairs is ``similar`` or more; rows that are near by chance have far less (the square of the radius), however
many they are, so the test holds at every density of the background. Candidates fail as soon as their pairs are too loose. Candidates
whose directions have a cosine of ``same`` or more are neighbours; those that are the local minimum of the hash order among their
neighbours become pivots, in parallel, absorb their neighbours, and so on with the rest. Rows within ``member`` of a pivot leave.

Reassignment: each row goes to its closest pivot, pivots move to the mean of their dense inner part, pivots that have become
neighbours are joined, twice. The member closest to its direction is the medoid: for cosines, the member with
the largest mean similarity to all members.

Scale: candidates meet rows in coarse cells (``vectors.Cells``), whose vectors are packed once into blocks; a candidate visits
``PROBES`` cells of about ``CELL`` rows, so a round costs candidates times a constant. Pivots and directions are written tables of any
length; rows are compared with them in blocks of at most about ``BLOCK`` that travel to the tasks. Rows and pairs are never gathered.

Unusable vectors, null ids and rows close to no direction are in no cluster; repeated ids count once; equal vectors lie in
one cluster; an empty table gives no row; a null note counts as no namespace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.llm.vectors import Cells, hash_cut, place_in_cells, unpack, usable_vectors
from lorekiln.plans.stages import Scope, Stage, write_stage

CELL, PROBES, MOST, SAMPLE, BLOCK, FIRST, MORE, SLICES = 2048, 8, 2048, 16_384, 4096, 2048, 8, 64
#: Cosines within which a candidate gathers rows, step by step, and the least mean cosine of the pairs it may then have. Wider ones
#: would draw it over to a neighbouring cluster that is larger. ``INNER``: the inner part of a cluster, which must be dense.
RADII, LOOSE, FEW, INNER = (0.5, 0.62, 0.66), (0.0, 0.34, 0.4), 3, 0.6
_DIRECTION = "q bigint, n double, m binary"


def _each() -> Column:
    """Counts the rows of a stage while it is written."""
    return F.lit(True)


def _half(packed: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<f2").reshape(-1, dim).astype("f4")


def _pack(rows: DataFrame, hash_col: str, cell: str, count: int | None = None) -> DataFrame:
    """cell, u, w, k: the vectors of a cell in rows of up to about ``BLOCK``, as packed values, with their weights or 1; ``count``: how many there are, if known."""
    rows = rows.select(F.col(cell).alias("cell"), F.col(hash_col).alias("u"), "w", F.col("k") if "k" in rows.columns else F.lit(1.0).alias("k"))
    if count is None or count > BLOCK:
        size = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("slices"))
        rows = rows.join(size, "cell").withColumn("slice", F.pmod(F.xxhash64("u", F.lit(3)), "slices"))
    else:  # a cell holds no more than all of them
        rows = rows.withColumn("slice", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "u": [pdf["u"].to_numpy(dtype="<i8").tobytes()], "w": [b"".join(pdf["w"])], "k": [pdf["k"].to_numpy(dtype="<f8").tobytes()]})

    return rows.groupBy("cell", "slice").applyInPandas(run, "cell bigint, u binary, w binary, k binary")


def _visits(directions: DataFrame, cells: Cells, dim: int, probes: int) -> DataFrame:
    """q, w, cell: each direction (q, m) with the cells it visits, one row a visit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = unpack(b["m"], dim)
                yield pd.DataFrame({"q": b["q"], "w": [r.tobytes() for r in m.astype("<f2")], "cell": list(cells.near(m, probes))})

    return directions.select("q", "m").mapInPandas(run, "q bigint, w binary, cell array<bigint>").select("q", "w", F.explode("cell").alias("cell"))


def _gather(directions: DataFrame, count: int, blocks: Stage, cells: Cells, dim: int, radius: float, below: float, least: int) -> DataFrame:
    """q, n, m: directions moved to the mean of the rows within ``radius`` of them, where these are ``least`` or more whose pairs have a mean cosine of ``below`` or more."""
    asked = _pack(_visits(directions, cells, dim, PROBES), "q", "cell", count)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qs, qw, bw, bk in zip(b["q"], b["qw"], b["w"], b["k"]):
                q, y, x = np.frombuffer(qs, dtype="<i8"), _half(qw, dim), _half(bw, dim)
                k, near = np.frombuffer(bk, dtype="<f8"), y @ x.T >= radius
                hit = near.any(axis=1)
                if hit.any():
                    near = near[hit]
                    yield pd.DataFrame({"q": q[hit], "n": near @ k, "n2": near @ k**2, "s": list(near.astype("f4") @ (x * k[:, None].astype("f4")))})

    met = asked.select("cell", F.col("u").alias("q"), F.col("w").alias("qw")).join(blocks.df.select("cell", "w", "k"), "cell").select("q", "qw", "w", "k").mapInPandas(meet, "q bigint, n double, n2 double, s array<float>")
    return _means(met, "q", dim, below, least)


def _means(parts: DataFrame, key: str, dim: int, below: float, least: int) -> DataFrame:
    """q, n, m of partial weights, their squares and sums (n, n2, s), where n >= ``least`` and the mean cosine of the pairs, which these give, is ``below`` or more."""
    sums = parts.groupBy(F.col(key).alias("q")).agg(F.sum("n").alias("n"), F.sum("n2").alias("n2"), F.array(*[F.sum(F.col("s")[i].cast("double")) for i in range(dim)]).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s, n, n2 = np.array(list(b["s"])), b["n"].to_numpy(dtype="f8"), b["n2"].to_numpy(dtype="f8")
                size = np.einsum("ij,ij->i", s, s)
                ok = (n >= least - 1e-6) & (size - n2 >= below * (n * n - n2) - 1e-6 * n * n) & (size > 0)
                m = (s[ok] / np.sqrt(size[ok])[:, None]).astype("<f4")
                yield pd.DataFrame({"q": b["q"][ok], "n": b["n"][ok], "m": [r.tobytes() for r in m]})

    return sums.mapInPandas(run, _DIRECTION)


def _weights(rows: DataFrame, seen: Stage, blocks: Stage, dim: int, copies: float) -> DataFrame:
    """u, v, k: each row (u, v) with its weight, 1 by the number of rows within ``copies``; close copies share one of their two nearest cells."""
    asked = _pack(seen.df.select("u", "w", F.explode(F.slice("cell", 1, 2)).alias("at")), "u", "at")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qs, qw, bs, bw in zip(b["q"], b["qw"], b["u"], b["w"]):
                q, u = np.frombuffer(qs, dtype="<i8"), np.frombuffer(bs, dtype="<i8")
                n = ((_half(qw, dim) @ _half(bw, dim).T >= copies) & (q[:, None] != u)).sum(axis=1)
                yield pd.DataFrame({"u": q[n > 0], "n": n[n > 0]})

    near = asked.select("cell", F.col("u").alias("q"), F.col("w").alias("qw")).join(blocks.df.select("cell", "u", "w"), "cell").select("q", "qw", "u", "w").mapInPandas(meet, "u bigint, n bigint")
    return rows.join(near.groupBy("u").agg(F.sum("n").alias("n")), "u", "left").select("u", "v", (1 / (1 + F.coalesce("n", F.lit(0)))).alias("k"))


def _in_blocks(rows: DataFrame, directions: Stage, fold: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """Rows after ``fold(rows, ids, directions)`` with every block of about half of ``BLOCK`` directions, sorted by id; fold keeps their columns."""
    blocks = max(1, -(-directions.counted // (BLOCK // 2)))
    schema = rows.schema
    for i in range(blocks):
        block = sorted(directions.df.filter(F.pmod(F.xxhash64("q", F.lit(5)), F.lit(blocks)) == i).select("q", "m").collect())  # about BLOCK / 2 rows
        if not block:
            continue
        ids, m = np.array([r.q for r in block], dtype="i8"), np.array([np.frombuffer(r.m, dtype="<f4") for r in block])

        def run(batches: Iterator[pd.DataFrame], ids=ids, m=m) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield fold(b, ids, m)

        rows = rows.mapInPandas(run, schema)
        if i % 4 == 3:
            rows = write_stage(rows).df
    return rows


def _closest(rows: DataFrame, directions: Stage, dim: int) -> DataFrame:
    """Adds ``c``, the closest direction, and ``cos`` to rows with a vector v."""

    def fold(b: pd.DataFrame, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        s = unpack(b["v"], dim) @ m.T
        best = s.argmax(axis=1)
        cos = s[np.arange(len(b)), best].astype("f8")
        better = cos > b["cos"].to_numpy()
        return b.assign(c=np.where(better, ids[best], b["c"]), cos=np.where(better, cos, b["cos"]))

    return _in_blocks(rows.select("*", F.lit(0).cast("long").alias("c"), F.lit(-2.0).alias("cos")), directions, fold)


def _pivots(directions: Stage, dim: int, same: float) -> Stage:
    """The directions left when local minima of the hash order absorb their neighbours (cosine ``same`` or more) until none is left.

    Every direction is compared with every other: two of one cluster need not share a cell, and if both stayed, they would divide it.
    """

    def fold(b: pd.DataFrame, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        near = unpack(b["m"], dim) @ m.T >= same
        return b.assign(low=np.minimum(b["low"], np.where(near.any(axis=1), ids[near.argmax(axis=1)], b["q"])))  # ids are sorted

    active, kept = directions, []
    while active.counted:  # the smallest hash is a local minimum in each round
        low = _in_blocks(active.df.withColumn("low", F.col("q")), active, fold)
        kept.append(new := write_stage(low.filter(F.col("low") == F.col("q")).drop("low"), _each()))
        if new.counted == active.counted:
            break
        rest = active.df.join(new.df.select("q"), "q", "left_anti").select("q", "n", F.col("m").alias("v"))
        active = write_stage(_closest(rest, new, dim).filter(F.col("cos") < same).select("q", "n", F.col("v").alias("m")), _each())
    if len(kept) == 1:
        return kept[0]
    pivots = directions.df.limit(0)
    for more in kept:
        pivots = pivots.unionByName(more.df)
    return write_stage(pivots, _each())


def _moved(rows: DataFrame, directions: Stage, dim: int, radius: float, similar: float, least: int) -> DataFrame:
    """q, n, m: directions moved to the mean of the rows that are closest to them and within ``radius``, if these are a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, at = np.unique(b["c"].to_numpy(), return_inverse=True)
                s, k = np.zeros((len(c), dim)), b["k"].to_numpy()
                np.add.at(s, at, unpack(b["v"], dim) * k[:, None])
                yield pd.DataFrame({"q": c, "n": np.bincount(at, k), "n2": np.bincount(at, k**2), "s": list(s.astype("f4"))})

    parts = _closest(rows, directions, dim).filter(F.col("cos") >= radius).select("c", "v", "k").mapInPandas(run, "q bigint, n double, n2 double, s array<float>")
    return _means(parts, "q", dim, similar, least)


def similarity_clusters(df: DataFrame, id_col: str, vector: str, dim: int, note: str | None = None, similar: float = 0.45, same: float = 0.75, member: float = 0.47, least: int = 8, copies: float = 1.1, refine: int = 2) -> DataFrame:
    """id, note, cluster, cos: each clustered row with its cluster's medoid id and its cosine to the cluster's direction.

    ``similar``: least mean cosine of the pairs of a cluster's inner part. ``same``: cosine of two directions that are one cluster.
    ``member``: least cosine of a member and its direction. ``copies``: cosine of copies, which together count as one row; by default there
    is no such bound, and equal vectors count each.
    """
    with Scope() as scope:
        labelled = _labelled(df, id_col, vector, dim, note, similar, same, member, least, copies, refine)
        if labelled is None:
            return df.sparkSession.createDataFrame([], "id string, note string, cluster string, cos double")
        scope.keep(labelled)
    medoid = labelled.df.groupBy("c").agg(F.min_by("id", F.struct((-F.round("cos", 6)).alias("far"), "id")).alias("cluster"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return labelled.df.join(medoid.select("c", "cluster"), "c").select("id", "note", "cluster", "cos")


def _labelled(df: DataFrame, id_col: str, vector: str, dim: int, note: str | None, similar: float, same: float, member: float, least: int, copies: float, refine: int) -> Stage | None:
    """id, note, c, cos: rows with their direction."""
    rows = write_stage(usable_vectors(df, id_col, vector, dim, note))
    once = rows.df.select(F.col("h").alias("u"), "v")
    if copies <= 1:
        once = rows.df.groupBy("v").agg(F.min("h").alias("u")).select("u", "v")
    todo = write_stage(once.withColumn("k", F.lit(1.0)), _each())
    seen, cells = place_in_cells(todo.df, "u", dim, CELL, PROBES, MOST, SAMPLE, todo.counted)
    if seen is None:
        return None
    blocks = write_stage(_pack(seen.df.select("u", "w", "home"), "u", "home"))
    if copies <= 1:
        todo = write_stage(_weights(todo.df.select("u", "v"), seen, blocks, dim, copies), _each())
        blocks.release()
        blocks = write_stage(_pack(seen.df.join(todo.df.select("u", "k"), "u").select("u", "w", "k", "home"), "u", "home"))
    seen.release()
    whole, found, ask, cut, steps = todo, [], FIRST, -(2**63), tuple(zip(RADII, LOOSE, (2, min(FEW, least), min(FEW, least))))
    while left := todo.counted:
        cut = hash_cut(left, ask, cut)  # all that are left lie above the last cut
        now = todo.df.filter(F.col("u") <= cut).select(F.col("u").alias("q"), F.col("v").alias("m"))
        n = now.count()
        if not n:
            continue
        for radius, below, few in steps:
            nxt = write_stage(_gather(now, n, blocks, cells, dim, radius, below, few), _each())
            now, n = nxt.df, nxt.counted
            if not n:
                break
        if n:  # the test of the inner part moves no direction
            group = _gather(now, n, blocks, cells, dim, INNER, similar, least).select("q")
            nxt = write_stage(now.join(group, "q", "left_semi"), _each())
            n = nxt.counted
        rest = todo.df.filter(F.col("u") > cut)
        if n:
            new = _pivots(nxt, dim, same)
            found.append(new)
            rest = _closest(rest, new, dim).filter(F.col("cos") < member).select("u", "v", "k")
        todo, ask = write_stage(rest, _each()), ask * MORE
    if not found:
        return None
    directions = found[0]
    if len(found) > 1:
        all_ = found[0].df
        for more in found[1:]:
            all_ = all_.unionByName(more.df)
        directions = _pivots(write_stage(all_, _each()), dim, same)
    for _ in range(refine):
        directions = _pivots(write_stage(_moved(whole.df, directions, dim, INNER, similar, least), _each()), dim, same)
    return write_stage(_closest(rows.df.select("id", "note", "v"), directions, dim).filter(F.col("cos") >= member).select("id", "note", "c", "cos"))


def describe_clusters(labelled: DataFrame, typical: int = 3) -> DataFrame:
    """cluster, size, notes, n_notes, typical: size, sorted distinct notes, and the members closest to the direction."""
    rank = F.row_number().over(Window.partitionBy("cluster", "slice").orderBy(F.desc("cos"), "id"))
    top = labelled.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES))).withColumn("r", rank).filter(F.col("r") <= typical)
    top = top.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "id"))), 1, typical).alias("t"))
    size = labelled.groupBy("cluster", "note").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.sum("n").alias("size"), F.array_sort(F.collect_set("note")).alias("notes"))
    return size.join(top, "cluster").select("cluster", "size", F.size("notes").alias("n_notes"), "notes", F.col("t.id").alias("typical"))
