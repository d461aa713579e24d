"""Cutting a plan at a stage: tables written to the folder all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) and the
master is local is a folder of this machine used. A stage table is an ordinary Parquet table, so it survives the loss of
any executor, is pruned by column when read, and is removed when the driver's process ends or earlier by ``release``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/") + "/lorekiln"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lorekiln-")
    return _LOCAL[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _sweep() -> None:
    for path, spark in list(_WRITTEN.items()):
        _remove(spark, path)
    _WRITTEN.clear()


class Scope:
    """Stages written inside the block are removed at its end, but for those that ``keep`` names; what is returned must not read others."""

    def __enter__(self) -> Scope:
        self.stages: list[Stage] = []
        self.kept: list[Stage] = []
        _SCOPES.append(self)
        return self

    def keep(self, stage: Stage) -> Stage:
        self.kept.append(stage)
        return stage

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        for s in self.stages:
            if s not in self.kept:
                s.release()
            elif _SCOPES:  # an outer block decides in its turn
                _SCOPES[-1].stages.append(s)


_SCOPES: list[Scope] = []


class Stage:
    """A written table: ``df`` reads it again, ``release`` removes it."""

    def __init__(self, spark: SparkSession, path: str, schema, counted: int | None = None):
        self.spark, self.path, self.schema, self.counted = spark, path, schema, counted

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def release(self) -> None:
        _remove(self.spark, self.path)
        _WRITTEN.pop(self.path, None)


def write_stage(df: DataFrame, count_if: Column | None = None, partition_by: str | None = None) -> Stage:
    """Computes ``df`` once, writes it to the shared folder and returns the written table.

    ``count_if``: rows to count while they are written, as ``Stage.counted``. ``partition_by``: a column to make folders of.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    n = None
    if count_if is None:
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    else:
        seen = Observation()
        df.observe(seen, F.count_if(count_if).alias("n")).write.parquet(path)
        n = seen.get["n"]
    stage = Stage(spark, path, df.schema, n)
    if _SCOPES:
        _SCOPES[-1].stages.append(stage)
    return stage
