import pytest
from pyspark.sql import functions as F

from lorekiln.functions.providers import NoModel, entities_or_empty, joined_context, model_column
from lorekiln.operators.search import coarse_knn, knn
from lorekiln.sources.retry import retry, waits


def test_models(spark):
    class Upper(NoModel):
        name = "upper"

        def complete(self, prompts):
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(model_column(Upper(), "complete", F.col("t"))).collect()] == ["A", None]
    with pytest.raises(Exception, match="none is configured"):
        df.select(model_column(NoModel(), "summarize", F.col("t"))).collect()
    assert entities_or_empty('{"entities":[1],"x":2}') == {"entities": [1], "relationships": [], "contextGraph": {}} and entities_or_empty("no") == entities_or_empty(None) == entities_or_empty("[]")
    assert spark.range(1).select(joined_context(F.array(F.lit("a"), F.lit("b")))).first()[0] == "a\n\n---\n\nb"


def test_retry():
    assert waits(4, lambda: 0.0) == [0.25, 0.5, 1.0] and max(waits(2, lambda: 1.0)) == 0.3125
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retry(flaky, sleep=slept.append) == "ok" and len(slept) == 2
    with pytest.raises(OSError):
        retry(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=slept.append)
    with pytest.raises(ValueError):
        retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=slept.append)


def test_coarse_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "query")
    true = {(r.query, r.id) for r in knn(v, q, 10).collect()}
    got = {(r.query, r.id) for r in coarse_knn(v, q, 10).collect()}
    assert len(true & got) >= 0.9 * len(true)
    assert coarse_knn(v.limit(0), q, 3).count() == 0 and coarse_knn(v, q.limit(0), 3).count() == 0
