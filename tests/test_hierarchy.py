import random

import pytest
from pyspark.sql import functions as F

from lorekiln.operators.hierarchy import build_hierarchy, expand_descendants, expand_paths


def brute(links):
    up = {}
    for n, p in links:
        if n is not None:
            ps = [q for q in (up.get(n), p) if q is not None and q.strip()]
            up[n] = min(ps) if ps else None
    up = {n: p if p in up else None for n, p in up.items()}
    out = {}
    for n in up:
        path, seen = [n], {n}
        while up[path[-1]] is not None and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if up[path[-1]] is None:
            out[n] = (path[-1], len(path) - 1, path[::-1])
        else:
            loop = path[path.index(up[path[-1]]) :]
            out[n] = (min(loop), -1, None)
    return out


def check(spark, links):
    df = spark.createDataFrame(links, "node string, parent string").withColumns({"root": F.lit("x"), "size": F.lit(None).cast("int"), "head": F.lit(1)})
    tree = build_hierarchy(df, "node", "parent")
    got = {r.node: r for r in tree.collect()}
    want = brute(links)
    assert {n: (r.root, r.depth) for n, r in got.items()} == {n: w[:2] for n, w in want.items()}
    paths = {r.node: list(r.path) for r in expand_paths(tree).collect()}
    assert paths == {n: w[2] for n, w in want.items() if w[2]}
    pairs = {(r.ancestor, r.descendant) for r in expand_descendants(tree).collect()}
    assert pairs == {(a, n) for n, w in want.items() if w[2] for a in w[2][:-1]}
    for a in (r for r in got.values() if not r.in_cycle):  # descendants are an interval of labels
        inside = {r.node for r in got.values() if not r.in_cycle and r.root == a.root and a.pre < r.pre <= a.pre + a.size - 1}
        assert inside == {d for x, d in pairs if x == a.node}
        assert len(a.segments) <= len(got).bit_length() + 1


def test_shapes(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(70)]
    star = [("hub", "")] + [(f"s{i:02}", "hub") for i in range(40)]
    loops = [("a", "b"), ("b", "c"), ("c", "a"), ("t1", "a"), ("t2", "t1"), ("self", "self"), ("under", "self")]
    odd = [(None, "c001"), ("lost", "nowhere"), ("c005", "c004"), ("two", "c001"), ("two", "c002"), ("kid", "lost"), ("blank", "  ")]
    check(spark, chain + star + loops + odd)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    r = random.Random(seed)
    check(spark, [(f"n{i}", f"n{r.randrange(max(1, i))}" if r.random() < 0.95 else f"n{r.randrange(60)}") for i in range(60)])


def test_empty(spark):
    tree = build_hierarchy(spark.createDataFrame([], "node string, parent string"), "node", "parent")
    assert tree.count() == 0 and expand_paths(tree).count() == 0
