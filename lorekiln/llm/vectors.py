"""Usable vectors of a table, as unit vectors of 32-bit floats packed into one binary value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stages import Stage, write_stage


def unpack(packed: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f4").reshape(len(packed), dim)


def usable_vectors(df: DataFrame, id_col: str, vector: str, dim: int, carry: str | None = None) -> DataFrame:
    """id, h, note, v: one row per id that has a usable vector, that is ``dim`` finite numbers, not all zero.

    ``v`` is the unit vector, ``h`` a hash of the id that orders rows at random but repeatably, ``note`` the carried column.
    Rows with a null id or an unusable vector are left out; of several usable rows of an id the smallest ``v`` is taken.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), (F.col(carry) if carry else F.lit(None)).cast("string").alias("note"), F.col(vector).alias("e"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("e") == dim))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array([np.asarray(e, dtype=np.float64) for e in b["e"]])
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(x).all(axis=1) & (top > 0)
                x, b = x[ok] / top[ok, None], b[ok]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"id": b["id"], "note": b["note"], "v": [r.tobytes() for r in x.astype("<f4")]})

    packed = rows.mapInPandas(pack, "id string, note string, v binary")
    one = packed.groupBy("id").agg(F.min(F.struct("v", "note")).alias("m"))
    return one.select("id", F.xxhash64("id").alias("h"), F.col("m.note").alias("note"), F.col("m.v").alias("v"))


def hash_cut(n: int, want: int, after: int = -(2**63)) -> int:
    """The hash up to which about ``want`` of n rows lie whose 64-bit hashes are spread evenly above ``after``.

    A filter by it takes the rows that come first in hash order without any task sending that many to the driver.
    """
    return 2**63 - 1 if n <= want else after + max(1, (2**63 - 1 - after) * want // n)


def _fit(x: np.ndarray, cells: int, rounds: int = 3) -> np.ndarray:
    """``cells`` unit vectors: rows of the sample, moved to the direction of what is nearest to them."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        norm = np.linalg.norm(s, axis=1)
        c[norm > 1e-6] = s[norm > 1e-6] / norm[norm > 1e-6, None]
    return c


class Cells:
    """A division of the unit vectors into cells around points: ``centres``, or where more are wanted, centre + ``reach`` x direction.

    Points are compared with a vector by their distance, whether they stand for a centre, a part of one or a refitted cell, so a
    vector always visits the same number of cells.
    """

    def __init__(self, centres: np.ndarray, inner: np.ndarray | None, reach: float, extra: np.ndarray):
        self.centres, self.inner, self.reach, self.extra = centres, inner, reach, extra
        self.parts = 1 if inner is None else len(inner)
        self.cross = None if inner is None else centres @ inner.T
        self.n = len(centres) * self.parts + len(extra)

    @staticmethod
    def fit(x: np.ndarray, wanted: int, most: int) -> Cells:
        """About ``wanted`` cells from a sample: up to ``most`` centres, each divided by common directions if that is too few."""
        centres = _fit(x, min(most, wanted, len(x)))
        parts, none = min(most, -(-wanted // len(centres)), len(x)), centres[:0]
        if wanted <= most or parts < 2:
            return Cells(centres, None, 0.0, none)
        d = x - centres[(x @ centres.T).argmax(axis=1)]
        d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)
        inner = _fit(d, parts)
        rest = x - centres[(x @ centres.T).argmax(axis=1)]
        return Cells(centres, inner, float((rest @ inner.T).max(axis=1).mean()), none)

    def near(self, v: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each vector, the nearest first."""
        probes = min(probes, self.n)
        out = np.empty((len(v), probes), dtype=np.int64)
        step = 8192 if self.inner is None else 128
        for at in range(0, len(v), step):
            x = v[at : at + step]
            s = x @ self.centres.T
            ids = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            if self.inner is not None:
                first = min(s.shape[1], 2 * probes)
                top = np.argpartition(-s, first - 1, axis=1)[:, :first]
                fine = (x @ self.inner.T)[:, None, :] - self.cross[top]
                fine = np.take_along_axis(s, top, 1)[:, :, None] + self.reach * fine - self.reach**2 / 2
                s, ids = fine.reshape(len(x), -1), (top[:, :, None] * self.parts + np.arange(self.parts)).reshape(len(x), -1)
            if len(self.extra):
                more = np.arange(len(self.extra)) + len(self.centres) * self.parts
                s, ids = np.concatenate([s, x @ self.extra.T], axis=1), np.concatenate([ids, np.broadcast_to(more, (len(x), len(more)))], axis=1)
            top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
            out[at : at + step] = np.take_along_axis(ids, top, 1)
        return out


def _sampled(rows: DataFrame, hash_col: str, n: int, want: int) -> np.ndarray:
    got = sorted(rows.filter(F.col(hash_col) <= hash_cut(n, want)).select(F.col(hash_col).alias("h"), "v").collect())
    return np.array([np.frombuffer(r.v, dtype="<f4") for r in got])


def place_in_cells(vectors: DataFrame, hash_col: str, dim: int, cell: int, probes: int, most: int, sample: int, count: int | None = None) -> tuple[Stage | None, Cells | None]:
    """(``hash_col``, w, home, cell: every vector in half precision with its cell and the cells it visits; the cells).

    Cells are fitted on a sample of about ``sample`` vectors, the first by hash. Where a cell comes out with more than eight
    times ``cell`` vectors it is fitted again, on a sample of its own vectors within the same bound, until no such cell
    is left or division does not help (vectors that all but coincide).
    """
    n = vectors.count() if count is None else count
    x = _sampled(vectors, hash_col, n, sample)
    if not len(x):
        return None, None
    cells, before = Cells.fit(x, max(1, -(-n // cell)), most), None
    while True:

        def visit(batches: Iterator[pd.DataFrame], cells=cells) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = unpack(b["v"], dim)
                    top = cells.near(v, probes)
                    yield pd.DataFrame({hash_col: b[hash_col], "w": [r.tobytes() for r in v.astype("<f2")], "home": top[:, 0], "cell": list(top)})

        seen = write_stage(vectors.select(hash_col, "v").mapInPandas(visit, f"{hash_col} bigint, w binary, home bigint, cell array<bigint>"))
        dense = seen.df.groupBy("home").count().filter(F.col("count") > 8 * cell)
        worst = dense.agg(F.sum("count"), F.max("count")).first()
        if not worst[0] or (before is not None and worst[1] > 0.5 * before) or len(cells.extra) > most:
            return seen, cells
        before = worst[1]
        own = seen.df.join(dense, "home", "left_semi").filter(F.xxhash64(hash_col, F.lit(len(cells.extra))) <= hash_cut(worst[0], sample)).select("home", hash_col, "w").collect()
        by: dict[int, list] = {}
        for r in sorted(own):
            by.setdefault(r.home, []).append(np.frombuffer(r.w, dtype="<f2").astype("f4"))
        extra = [_fit(np.array(g), max(2, len(g) // 24)) for _, g in sorted(by.items()) if len(g) > 1]
        seen.release()
        cells = Cells(cells.centres, cells.inner, cells.reach, np.concatenate([cells.extra, *extra]).astype("f4"))


def nearest_centre(centres: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], dim: int, columns: list[str]):
    """A function for mapInPandas: adds ``c``, the centre of largest cosine, and ``cos`` to the rows for which keep(c, cos) holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = unpack(b["v"], dim) @ centres.T
                c = s.argmax(axis=1)
                cos = s[np.arange(len(b)), c]
                ok = keep(c, cos)
                out = b[columns].assign(c=c.astype("int32"), cos=cos.astype("float64"))
                yield out[ok]

    return run


def centre_sums(rows: DataFrame, centres: np.ndarray, least: float, dim: int, heads: np.ndarray | None = None, copies: float = 1.1) -> list:
    """(c, n, sum of the unit vectors) of each centre over the rows whose cosine with their nearest centre is ``least`` or more.

    Rows whose cosine with one of ``heads`` is ``copies`` or more are left out. Each task adds up its own rows first; what is
    collected is one row per centre.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(centres), dtype=np.int64), np.zeros((len(centres), dim))
        for b in batches:
            if len(b):
                x = unpack(b["v"], dim)
                s = x @ centres.T
                c = s.argmax(axis=1)
                ok = s[np.arange(len(b)), c] >= least
                if heads is not None and len(heads):
                    ok &= (x @ heads.T).max(axis=1) < copies
                n += np.bincount(c[ok], minlength=len(centres))
                np.add.at(total, c[ok], x[ok])
        hit = np.nonzero(n)[0]
        yield pd.DataFrame({"c": hit.astype("int32"), "n": n[hit], "s": list(total[hit])})

    part = rows.select("v").mapInPandas(run, "c int, n bigint, s array<double>")
    sums = part.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)])
    return [(r[0], r[1], np.array(r[2:])) for r in sums.orderBy("c").collect()]
