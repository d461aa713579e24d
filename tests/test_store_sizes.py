import hashlib

from pyspark.sql import functions as F

from lorekiln.operators.store import dedupe_key


def test_one_key_per_group_at_every_size(spark):
    big = spark.range(50_001).select(F.lit("big").alias("ns"), F.col("id").alias("ts"), F.col("id").cast("string").alias("id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"))
    few = spark.createDataFrame([(None, 2, "b", "y"), (None, 1, "a", "x"), ("nohash", 1, "c", None)], "ns string, ts bigint, id string, hash string")
    got = {r.ns: (r.records, r.dedupe_key) for r in dedupe_key(big.unionByName(few), "ns").collect()}
    want = {"big": (50_001, ":".join(f"h{i}" for i in range(50_001))), None: (2, "x:y"), "nohash": (1, "")}
    assert got == {k: (n, hashlib.sha256((v + ":none:false").encode()).hexdigest()) for k, (n, v) in want.items()}
