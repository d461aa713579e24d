"""Exact nearest-neighbour search and semantic search with post-filters.

Queries go to the tasks in blocks of at most ``BLOCK`` vectors (their number is counted first; more blocks mean more
passes over the vectors). A task keeps the k best of each query so far, over all its batches, so what is shuffled is at most k
rows per query and task, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.text import has_all
from lorekiln.plans.stages import write_stage

BLOCK, TILE, DIGITS, SAMPLE, BROADCAST_HITS = 4096, 1024, 6, 4096, 1_000_000


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances, smaller is closer; inner product and cosine negated. Equal vectors give equal scores."""
    dot = q @ x.T
    if metric == "ip":
        return -dot
    if metric == "cosine":
        with np.errstate(all="ignore"):
            return -dot / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * dot))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", query_col: str = "query") -> DataFrame:
    """query, id, distance, rank: the k closest vectors of each query; ties go to the smaller id.

    ``vectors`` (id, embedding) and ``queries`` (query, embedding) hold usable vectors of one dimension. Scores are rounded
    to six digits before they are compared. For ``ip`` and ``cosine`` the column holds the similarity, largest first.
    """
    spark, kind, qkind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
    blocks = max(1, -(-queries.count() // BLOCK))
    sign = 1 if metric == "l2" else -1
    out = None
    for n in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == n)
        rows = own.select(query_col, "embedding").collect()  # one block
        if not rows:
            continue
        ids, q = np.array([r[0] for r in rows], dtype=object), np.array([r[1] for r in rows], dtype=np.float64)

        def best(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            kept, at = pd.DataFrame({"n": [], id_col: [], "distance": []}), np.arange(len(q))[:, None]
            for b in batches:
                b = b.sort_values(id_col)  # so that a stable sort breaks ties by id
                for start in range(0, len(b), TILE):
                    tile = b.iloc[start : start + TILE]
                    d = np.round(_scores(q, np.array(list(tile["embedding"]), dtype=np.float64), metric), DIGITS) + 0.0
                    top = np.argsort(d, axis=1, kind="stable")[:, :k]
                    new = pd.DataFrame({"n": np.repeat(np.arange(len(q)), top.shape[1]), id_col: tile[id_col].to_numpy()[top.ravel()], "distance": d[at, top].ravel()})
                    kept = new if not len(kept) else pd.concat([kept, new]).sort_values(["n", "distance", id_col], kind="stable").groupby("n", sort=False).head(k)
            if len(kept):
                yield pd.DataFrame({query_col: ids[kept["n"].to_numpy(dtype=int)], id_col: kept[id_col].to_numpy(), "distance": kept["distance"].to_numpy()})

        part = vectors.select(id_col, "embedding").mapInPandas(best, f"{query_col} {qkind}, {id_col} {kind}, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{query_col} {qkind}, {id_col} {kind}, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy("distance", id_col))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("distance", F.col("distance") * sign)


class CoarseIndex:
    """Vectors written by coarse cell, so that a search reads only the folders of the cells it probes.

    Cells are the surroundings of centres fitted on about ``SAMPLE`` vectors; every vector is in one cell, the sample's bound is the
    number of cells' as well.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, id_col: str = "id"):
        self.id_col, self.schema = id_col, vectors.select(id_col).schema[id_col].dataType.simpleString()
        # the rows of lowest hash by a filter: a sorted limit would send as many rows from every task
        n = vectors.count()
        cut = 2**63 - 1 if n <= SAMPLE else -(2**63) + 2**64 * SAMPLE // n
        x = np.array([r[0] for r in vectors.filter(F.xxhash64(id_col) <= cut).select("embedding").collect()], dtype=np.float64)
        cells = max(1, min(len(x), cells or round(2 * len(x) ** 0.5)))
        centres = x[:cells].copy()
        for _ in range(4 if len(x) else 0):
            near = _scores(x, centres, "l2").argmin(axis=1)
            for c in range(cells):
                if (near == c).any():
                    centres[c] = x[near == c].mean(axis=0)
        self.centres = centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(cell=_scores(np.array(list(b["embedding"]), dtype=np.float64), centres, "l2").argmin(axis=1))

        placed = vectors.select(id_col, "embedding")
        self.stage = write_stage(placed.mapInPandas(place, f"{id_col} {self.schema}, embedding {placed.schema['embedding'].dataType.simpleString()}, cell bigint").repartition("cell"), partition_by="cell") if n else None

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_col: str = "query") -> DataFrame:
        """query, id, distance, rank by Euclidean distance among the ``probes`` cells closest to each query.

        By default six tenths of the cells, which finds over nine tenths of the true neighbours of vectors without any structure and
        nearly all where there is some; with fewer, fewer folders are read.
        """
        spark, id_col, qkind = queries.sparkSession, self.id_col, queries.schema[query_col].dataType.simpleString()
        schema, cells = f"{query_col} {qkind}, {id_col} {self.schema}, distance double", len(self.centres)
        out = spark.createDataFrame([], schema)
        if self.stage is None:
            return out.withColumn("rank", F.lit(0))
        probes = min(cells, probes or max(8, round(0.6 * cells)))
        blocks = max(1, -(-queries.count() // BLOCK))
        for n in range(blocks):
            own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == n)
            rows = own.select(query_col, "embedding").collect()  # one block
            if not rows:
                continue
            ids, q = np.array([r[0] for r in rows], dtype=object), np.array([r[1] for r in rows], dtype=np.float64)
            asks = np.zeros((cells, len(q)), dtype=bool)
            np.put_along_axis(asks, np.argsort(_scores(q, self.centres, "l2"), axis=1)[:, :probes].T, True, axis=0)

            def best(batches: Iterator[pd.DataFrame], ids=ids, q=q, asks=asks) -> Iterator[pd.DataFrame]:
                kept = None
                for b in batches:
                    found = [] if kept is None else [kept]
                    for c, own in b.groupby("cell"):
                        who = np.nonzero(asks[c])[0]
                        if len(who):
                            d = np.round(_scores(q[who], np.array(list(own["embedding"]), dtype=np.float64), "l2"), DIGITS)
                            found.append(pd.DataFrame({"n": np.repeat(who, len(own)), id_col: np.tile(own[id_col].to_numpy(), len(who)), "distance": d.ravel()}))
                    if found:
                        kept = pd.concat(found).sort_values(["n", "distance", id_col]).groupby("n", sort=False).head(k)
                if kept is not None:
                    yield pd.DataFrame({query_col: ids[kept["n"].to_numpy(dtype=int)], id_col: kept[id_col].to_numpy(), "distance": kept["distance"].to_numpy()})

            probed = self.stage.df.filter(F.col("cell").isin([int(c) for c in np.nonzero(asks.any(axis=1))[0]]))
            out = out.unionByName(probed.mapInPandas(best, schema))
        rank = F.row_number().over(Window.partitionBy(query_col).orderBy("distance", id_col))
        return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def coarse_knn(vectors: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int | None = None, id_col: str = "id", query_col: str = "query") -> DataFrame:
    """As ``knn`` by Euclidean distance, through a coarse index made for the purpose."""
    return CoarseIndex(vectors, cells, id_col).search(queries, k, probes, query_col)


def search(concepts: DataFrame, queries: DataFrame, k: int = 10, namespace: str | None = "default", tags: tuple[str, ...] = (), prefilter: bool = False, coarse: bool = False) -> DataFrame:
    """query, id, distance, namespace, tag_list, has_md, has_tf, rank.

    ``namespace`` None searches all. By default the filters apply to the closest 3k (all namespaces: k) rows, so fewer than
    k may come out although more exist; ``prefilter`` filters first. ``coarse`` looks only into the cells close to a query, for
    very many queries.
    """
    keep = F.lit(True)
    if namespace is not None:
        keep = keep & F.coalesce(F.col("namespace") == namespace, F.lit(False))
    if tags:
        keep = keep & has_all(F.col("tag_list"), list(tags))
    meta = concepts.select("id", "namespace", "tag_list", F.col("markdown").isNotNull().cast("int").alias("has_md"), F.col("thoughtform").isNotNull().cast("int").alias("has_tf"))
    source = concepts.filter(keep) if prefilter else concepts
    most = k if prefilter or namespace is None else 3 * k
    hits = (coarse_knn if coarse else knn)(source.select("id", "embedding"), queries, most).drop("rank")
    if queries.count() * most <= BROADCAST_HITS:  # the hits go to the concepts; more hits meet them by a shuffle
        hits = F.broadcast(hits)
    found = meta.join(hits, "id").filter(keep)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def index_from(concepts: DataFrame) -> DataFrame:
    """The vector index rebuilt from the stored embeddings."""
    return concepts.filter(F.col("embedding").isNotNull()).select("id", "embedding")


def rebuild_index(index: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """``replace`` takes the new rows only; ``upsert`` keeps indexed rows whose id is not among the new ones."""
    if mode == "replace":
        return new
    if mode != "upsert":
        raise ValueError("mode must be replace or upsert")
    return index.join(new.select("id"), "id", "left_anti").unionByName(new)
