import itertools
import random

import pytest
from pyspark.sql import functions as F

from lorekiln.llm.p1_queries import instant_ns
from lorekiln.llm.survivorship import build_survivors, choose_bundles, is_missing, uuid_key

ROWS = "id string, n bigint, version int, ts bigint, a string, b string, c string, g string, r string, t string, w string"


def choose(df, bundles, fds=(), trust=None, least=2):
    got = choose_bundles(df, F.col("id"), F.col("n"), [F.col("version"), F.col("ts")], bundles, fds, trust, least=least)
    return {(r.group_key, r.bundle): r.from_id for r in got.collect()}


def frame(spark, rows):
    return spark.createDataFrame([r + ("x",) * (11 - len(r)) for r in rows], ROWS)  # g, r, t, w clash with the operator's own names


def test_order_ties_and_missing(spark):
    df = frame(spark, [("k", 3, None, 9, "n/a", "", None), ("k", 1, 2, 5, " ", "x", None), ("k", 2, 2, 5, "v", None, "-"), ("k", 9, 2, 5, "w", "y", "?"), ("solo", 4, 1, 1, "s", "s", "s"), (None, 5, 9, 9, "z", "z", "z"), ("k", 3, None, 9, "n/a", "", None)])
    got = choose(df, {"record": (), "a": ("a",), "b": ("b",), "c": ("c",)})
    assert got == {("k", "record"): 1, ("k", "a"): 2, ("k", "b"): 1}  # null version last, ties to the smaller number, none has c
    assert choose(df.limit(0), {"record": ()}) == {}
    assert choose(df, {"ab": ("a", "b")})[("k", "ab")] == 9  # a bundle is taken whole
    assert ("solo", "record") in choose(df, {"record": ()}, least=1)


def test_keys_and_instants(spark):
    u = "7e16a6c7-51eb-47f0-ab15-a59048cffb53"
    df = spark.createDataFrame([(u,), (u.upper(),), ("{" + u + "}",), ("urn:uuid:" + u,), (f" {u}\n",), (u.replace("-", ""),), ("x" + u,), (None,)], "s string")
    assert [r[0] for r in df.select(uuid_key(F.col("s"))).collect()] == [u.replace("-", "")] * 6 + [None, None]
    ns = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_001,), (0,), (-1,), (None,)], "v bigint").select(instant_ns(F.col("v"))).collect()
    assert [r[0] for r in ns] == [1_700_000_000 * 10**9, 1_700_000_000 * 10**9, 1_700_000_000_000_001_000, None, None, None]
    miss = spark.createDataFrame([(" N/A ",), ("naïve",), ("",), (None,), ("[REDACTED]",)], "s string").select(is_missing(F.col("s"))).collect()
    assert [r[0] for r in miss] == [True, False, True, True, True]


def brute(rows, bundles, fds):
    """The largest total trust over all ways to give bundles candidates or leave them empty; a neighbour that is empty or determines nothing forbids nothing."""
    cands = {b: [r for r in rows if all(r[f] not in (None, "") for f in fs)] for b, fs in bundles.items()}
    home, best = {f: b for b, fs in bundles.items() for f in fs}, 0
    for pick in itertools.product(*[[None, *cands[b]] for b in bundles]):
        by, ok = dict(zip(bundles, pick)), True
        for lhs, rhs in fds:
            x, y = by[home[lhs]], by[home[rhs]]
            if x is not None and y is not None:
                both = [r for r in rows if r in cands[home[lhs]] and r in cands[home[rhs]] and r[lhs] == x[lhs]]
                want = max(both, key=lambda r: (r["w"], r["version"], -r["n"]), default=None)
                ok &= want is None or y[rhs] == want[rhs]
        if ok:
            best = max(best, sum(r["w"] for r in pick if r is not None))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_branch_and_bound_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [dict(n=i, version=r.randrange(3), w=r.randrange(1, 9), a=r.choice(["p", "q", "r", None]), b=r.choice(["x", "y", "", None]), c=r.choice(["u", "v", None])) for i in range(9)]
    df = spark.createDataFrame([("k", x["n"], x["version"], 0, x["a"], x["b"], x["c"], None, None, None, str(x["w"])) for x in rows], ROWS)
    bundles, fds = {"A": ("a",), "B": ("b",), "C": ("c",)}, [(("a",), ("b",)), (("a",), ("c",))]
    got = choose(df, bundles, fds, F.col("w").cast("int"))
    by = {x["n"]: x for x in rows}
    assert sum(by[n]["w"] for n in got.values()) == brute(rows, bundles, [("a", "b"), ("a", "c")])
    build = build_survivors(df, choose_bundles(df, F.col("id"), F.col("n"), [F.col("version"), F.col("ts")], bundles, fds, F.col("w").cast("int")), "n", bundles).first()
    assert build.a == by[got[("k", "A")]]["a"]


def test_dependencies_must_form_a_tree(spark):
    df = frame(spark, [("k", 1, 1, 1, "a", "b", "c")])
    b = {"A": ("a",), "B": ("b",), "C": ("c",)}
    for fds in ([(("a",), ("b",)), (("b",), ("c",)), (("a",), ("c",))], [(("a",), ("b",)), (("b",), ("a",))], [(("a", "b"), ("c",))]):
        with pytest.raises(ValueError):
            choose(df, b, fds)


@pytest.mark.parametrize("seed,order", [(0, "ABC"), (3, "ABC"), (3, "BAC"), (5, "CBA"), (6, "BAC")])
def test_open_bundles_against_brute_force(spark, seed, order):
    r = random.Random(seed)
    rows = [dict(n=i, version=r.randrange(3), w=r.randrange(1, 9), a=r.choice(["p", "q", "r", None]), b=r.choice(["x", "y", "", None]), c=r.choice(["u", "v", None])) for i in range(9)]
    df = spark.createDataFrame([("k", x["n"], x["version"], 0, x["a"], x["b"], x["c"], None, None, None, str(x["w"])) for x in rows], ROWS)
    bundles, fds = {b: (b.lower(),) for b in order}, [(("a",), ("b",)), (("a",), ("c",))]
    got = choose_bundles(df, F.col("id"), F.col("n"), [F.col("version"), F.col("ts")], bundles, fds, F.col("w").cast("int"))
    w = {x["n"]: x["w"] for x in rows}
    assert sum(w[x.from_id] for x in got.collect()) == brute(rows, bundles, [("a", "b"), ("a", "c")])


def test_a_source_without_an_author_survives(spark):
    df = frame(spark, [("k", 1, 1, 1, None, "src", None), ("k", 2, 2, 1, "-", "other", None), ("solo", 3, 1, 1, None, "s", None), ("u", 4, 1, 1, "ann", None, None), ("u", 5, 1, 1, None, "t", None)])
    got = choose_bundles(df, F.col("id"), F.col("n"), [F.col("version"), F.col("ts")], {"A": ("a",), "B": ("b",)}, [(("a",), ("b",))], least=1)
    assert {(r.group_key, r.bundle): r.from_id for r in got.collect()} == {("k", "B"): 2, ("solo", "B"): 3, ("u", "A"): 4, ("u", "B"): 5}


def test_partial_bundles_and_empty_groups_survive(spark):
    df = frame(spark, [("k", 1, 1, 1, "text", "n/a", None), ("k", 2, 2, 1, None, "en", None), ("full", 3, 9, 1, "t", None, None), ("full", 4, 1, 1, "u", "de", None), ("none", 5, 1, 1, "-", None, "")])
    bundles = {"record": (), "ab": ("a", "b"), "c": ("c",)}
    got = choose_bundles(df, F.col("id"), F.col("n"), [F.col("version"), F.col("ts")], bundles, least=1)
    built = {r.group_key: (r.a, r.b, r.c) for r in build_survivors(df, got, "n", bundles).collect()}
    assert built == {"k": ("text", None, None), "full": ("u", "de", None), "none": (None, None, None)}
    fds = [(("a",), ("c",))]  # the same where a dependency touches the bundle
    tied = choose_bundles(df, F.col("id"), F.col("n"), [F.col("version"), F.col("ts")], bundles, fds, least=1)
    assert {r.group_key: r.from_id for r in tied.collect() if r.bundle == "ab"} == {"k": 1, "full": 4}
