import numpy as np
from pyspark.sql import functions as F

from lorekiln.llm.clustering import _pack, _pivots, _weights, describe_clusters, similarity_clusters
from lorekiln.llm.neighbours import _Arrays, _best, _collided, _search, neighbour_lists, similar_pairs
from lorekiln.llm.vectors import place_in_cells, usable_vectors
from lorekiln.plans.stages import write_stage

SCHEMA = "id string, embedding array<float>, namespace string, c int, v string, h string, u string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], ns, 1, "v", "h", "u") for i, e, ns in rows], SCHEMA)


def blobs(seed=3, dim=16, sizes=(60, 40, 30), noise=15):
    r = np.random.default_rng(seed)
    out = []
    for k, n in enumerate(sizes):
        d = r.standard_normal(dim)
        d /= np.linalg.norm(d)
        for i in range(n):
            e = r.standard_normal(dim)
            out.append((f"k{k}-{i:03}", d + 0.8 * e / np.linalg.norm(e), f"ns{i % 2}" if k else None))
    return out + [(f"z{i:03}", r.standard_normal(dim), "z") for i in range(noise)]


BAD = [("null", None, "n"), ("short", [1.0], "n"), ("zero", [0.0] * 16, "n"), ("nan", [float("nan")] * 16, "n"), ("inf", [float("inf")] + [0.0] * 15, "n"), (None, [1.0] * 16, "n"), ("hole", [None] + [1.0] * 15, "n")]


def test_usable(spark):
    df = table(spark, BAD + [("big", [3e38] * 16, "n"), ("ok", [2.0] + [0.0] * 15, "n"), ("ok", [2.0] + [0.0] * 15, "n")])
    got = {r.id: np.frombuffer(r.v, "<f4") for r in usable_vectors(df, "id", "embedding", 16).collect()}
    assert set(got) == {"big", "ok"} and abs(np.linalg.norm(got["big"]) - 1) < 1e-5 and got["ok"][0] == 1


def test_clusters(spark):
    rows = blobs()
    df = table(spark, rows + rows[:20] + BAD)
    got = similarity_clusters(df, "id", "embedding", 16, "namespace", similar=0.4, same=0.85, member=0.6)
    by = {r.id: r.cluster for r in got.collect()}
    for k, n in enumerate((60, 40, 30)):
        assert len({by[f"k{k}-{i:03}"] for i in range(n) if f"k{k}-{i:03}" in by}) == 1
    assert sum(i.startswith("k") for i in by) >= 125 and sum(i.startswith("z") for i in by) <= 3 and len(set(by.values())) == 3
    d = {r.cluster: r for r in describe_clusters(got).collect()}
    assert sorted(r.size for r in d.values()) == sorted(list(by.values()).count(c) for c in d) and all(r.typical[0] == r.cluster and len(r.typical) == 3 for r in d.values())
    assert {len(r.notes) for r in d.values()} >= {2}


def test_clusters_of_little(spark):
    for rows in ([], BAD, [("one", [1.0] * 16, "n")]):
        assert similarity_clusters(table(spark, rows), "id", "embedding", 16).count() == 0
    same = similarity_clusters(table(spark, [(f"i{n:02}", [1.0] * 16, None) for n in range(12)]), "id", "embedding", 16)
    assert {r.cluster for r in same.collect()} == {"i00"} and same.count() == 12


def brute(rows, k, least):
    ids = sorted({i for i, e, _ in rows})
    x = np.array([next(e for j, e, _ in rows if j == i) for i in ids], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))
        out[i] = [ids[b] for b in order[:k]]
    return {i: o for i, o in out.items() if o}


def lists(df, k, least, dim=16):
    out = {}
    for r in neighbour_lists(usable_vectors(df, "id", "embedding", dim), dim, k, least).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(150):
        e = r.standard_normal(16)
        rows += [(f"i{i:03}-{j}", e + 0.12 * r.standard_normal(16) * j, None) for j in range(r.integers(1, 6))]
    rows += [(f"copy{j:02}", rows[0][1], None) for j in range(25)]
    want, got = brute(rows, 4, 0.92), lists(table(spark, rows + rows[:9] + BAD), 4, 0.92)
    found = sum(len(set(got.get(i, [])) & set(o)) for i, o in want.items())
    assert found >= 0.98 * sum(map(len, want.values()))
    assert got["copy05"] == want["copy05"] and all(set(o) <= set(want.get(i, [])) or len(o) == 4 for i, o in got.items())


def test_neighbours_of_little(spark):
    for rows in ([], BAD, [("one", [1.0] * 16, "n")]):
        assert lists(table(spark, rows), 3, 0.9) == {}
    assert lists(table(spark, [("b", [1.0] * 16, ""), ("a", [2.0] * 16, ""), ("c", [1.0] + [-1.0] * 15, "")]), 3, 0.9) == {"a": ["b"], "b": ["a"]}


def test_collisions_find_nearly_all():
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 64)).astype("f4")
    x = np.concatenate([x, x[:200] + 0.25 * r.standard_normal((200, 64)).astype("f4")])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, b, cos = _search(x, x, 10, 0.92)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.92))}
    got = set(zip(q.tolist(), b.tolist()))
    assert got <= want | {(i, i) for i in range(800)} and len(got & want) >= 0.99 * len(want)


def test_copies_inside_a_cluster_are_members_not_a_cluster(spark):
    rows = blobs(sizes=(80, 60), noise=0)
    r = np.random.default_rng(9)
    kin = [(f"k0-kin{i:02}", rows[0][1] + 0.02 * r.standard_normal(16), None) for i in range(12)]
    lone = r.standard_normal(16)
    far = [(f"lone{i}", lone + 0.02 * r.standard_normal(16), None) for i in range(9)]
    got = similarity_clusters(table(spark, rows + kin + far), "id", "embedding", 16, similar=0.4, same=0.85, member=0.6, copies=0.85)
    by = {x.id: x.cluster for x in got.collect()}
    assert len(set(by.values())) == 2 and not any(i.startswith("lone") for i in by) and {by[i] for i, _, _ in kin if i in by} <= {by["k0-001"]}


def test_best_of_each_side():
    side = np.array([5, 5, 5, 5, 2, 2, 9])
    cos = np.array([0.91, 0.95, 0.93, 0.93, 0.99, 0.92, 0.97])  # far further apart than half precision
    assert _best(side, cos, 2).tolist() == [False, True, True, True, True, True, True]
    assert _best(side, cos, 1).tolist() == [False, True, False, False, True, False, True]
    assert _best(side[:0], cos[:0], 3).tolist() == []


def test_divided_cells_find_nearly_all(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((9000, 32))
    x = np.concatenate([x, x[:3000] + 0.22 * r.standard_normal((3000, 32))]).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, e.tobytes()) for i, e in enumerate(x)], "i bigint, v binary").selectExpr("xxhash64(v) AS u", "v", "i")
    ids = {r.u: r.i for r in df.collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in similar_pairs(df.select("u", "v"), 32, 10, 0.92, most=8).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.92)) if i < j}
    assert len(want) > 2000 and got <= want and len(got) >= 0.95 * len(want)


def test_collisions_are_counted_exactly():
    r = np.random.default_rng(3)
    x, q = (r.standard_normal((n, 8)).astype("f4") for n in (130, 70))
    proj = r.standard_normal((8, 32)).astype("f4") / 3
    arrays, pq, px = _Arrays(x, proj), q @ proj, x @ proj
    sets = [arrays.window(m, pq[:, m], 0.7) for m in range(32)]
    hit = np.array([np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :130] for s in sets])
    near = np.abs(pq.T[:, :, None] - px.T[:, None, :])
    assert (hit[near <= 0.7] == 1).all() and (hit[near > 0.75] == 0).all()  # ends are rounded outwards to the grid
    for enough in (1, 5, 18, 32):
        got = np.unpackbits(_collided(iter(sets), enough).view(np.uint8), axis=1, bitorder="little")[:, :130]
        assert ((hit.sum(axis=0) >= enough) == got).all()


def test_full_cells_are_fitted_again(spark):
    r = np.random.default_rng(7)
    one = np.ones(32) / np.sqrt(32)
    x = np.concatenate([r.standard_normal((600, 32)), one + 0.05 * r.standard_normal((4000, 32))]).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(e.tobytes(),) for e in x], "v binary").selectExpr("xxhash64(v) AS u", "v")
    seen, cells = place_in_cells(df, "u", 32, 16, 4, 3, 256)  # 9 cells to begin with
    assert len(cells.extra) and max(r[1] for r in seen.df.groupBy("home").count().collect()) <= 4000 / 2 and seen.df.count() == 4600
    assert all(r.home == r.cell[0] and len(set(r.cell)) == 4 for r in seen.df.collect())


def test_copies_do_not_hide_their_cluster(spark):
    r = np.random.default_rng(4)
    d = r.standard_normal((2, 64))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    unit = lambda e: e / np.linalg.norm(e)
    rows = [(f"k{k}-{i:02}", d[k] + 0.9 * unit(r.standard_normal(64)), None) for k in range(2) for i in range(40)]
    rows += [(f"equal{i:03}", rows[0][1], None) for i in range(300)] + [(f"near{i:03}", rows[40][1] + 0.02 * r.standard_normal(64), None) for i in range(300)]
    by = {x.id: x.cluster for x in similarity_clusters(table(spark, rows), "id", "embedding", 64, copies=0.8).collect()}
    one, two = by["equal000"], by["near000"]
    assert one != two and sum(by.get(f"k0-{i:02}") == one for i in range(40)) >= 38 and sum(by.get(f"k1-{i:02}") == two for i in range(40)) >= 38
    assert sum(by.get(f"equal{i:03}") == one for i in range(300)) == 300 and sum(by.get(f"near{i:03}") == two for i in range(300)) == 300


def test_rounds_go_on_until_every_row_was_a_candidate(spark, monkeypatch):
    monkeypatch.setattr("lorekiln.llm.clustering.FIRST", 12)
    monkeypatch.setattr("lorekiln.llm.clustering.MORE", 1)
    r = np.random.default_rng(6)
    ids = [x.id for x in spark.createDataFrame([(f"i{n:03}",) for n in range(72)], "id string").orderBy(F.xxhash64("id")).collect()]
    d = r.standard_normal(64)
    d /= np.linalg.norm(d)
    rows = [(i, np.eye(64)[n], None) for n, i in enumerate(ids[:60])]
    rows += [(i, d + 0.6 * e / np.linalg.norm(e), None) for i in ids[60:] for e in [r.standard_normal(64)]]
    got = similarity_clusters(table(spark, rows), "id", "embedding", 64, copies=0.9)
    assert {x.id for x in got.collect()} == set(ids[60:])  # the members come last in hash order, after rounds without a pivot


def test_small_clusters_in_a_wide_background(spark):
    r = np.random.default_rng(5)
    unit = lambda e: e / np.linalg.norm(e, axis=1, keepdims=True)
    d = unit(r.standard_normal((20, 64)))
    x = np.sqrt(0.55) * np.repeat(d, 40, 0) + np.sqrt(0.45) * unit(r.standard_normal((800, 64)))
    rows = [(f"k{i:03}", e, None) for i, e in enumerate(x)] + [(f"z{i}", e, None) for i, e in enumerate(unit(r.standard_normal((20_000, 64))))]
    by = {g.id: g.cluster for g in similarity_clusters(table(spark, rows), "id", "embedding", 64, copies=0.8).collect()}
    for k in range(20):
        own = [by.get(f"k{i:03}") for i in range(40 * k, 40 * k + 40)]
        assert max(map(own.count, set(own) - {None})) >= 38
    assert len(set(by.values())) == 20


def test_pivots_are_never_close(spark, monkeypatch):
    monkeypatch.setattr("lorekiln.llm.clustering.BLOCK", 40)  # several blocks of directions
    r = np.random.default_rng(8)
    d = r.standard_normal((6, 64))
    m = np.repeat(d / np.linalg.norm(d, axis=1, keepdims=True), 40, 0) + 0.08 * r.standard_normal((240, 64))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("<f4")
    q = r.permutation(240)
    rows = spark.createDataFrame([(int(i), 8, e.tobytes()) for i, e in zip(q, m)], "q bigint, n bigint, m binary")
    got = {x.q for x in _pivots(write_stage(rows, F.lit(True)), 64, 0.75).df.collect()}
    want, by = [], dict(zip(q.tolist(), m))
    for i in range(240):  # one by one in hash order gives what rounds of local minima give
        if all(by[i] @ by[j] < 0.75 for j in want):
            want.append(i)
    assert got == set(want) and len(got) >= 6


def test_a_cluster_of_many_cells_is_not_divided(spark, monkeypatch):
    monkeypatch.setattr("lorekiln.llm.clustering.CELL", 24)
    r = np.random.default_rng(12)
    unit = lambda e: e / np.linalg.norm(e, axis=1, keepdims=True)
    d = unit(r.standard_normal((2, 64)))
    x = np.sqrt(0.55) * np.repeat(d, (1200, 300), 0) + np.sqrt(0.45) * unit(r.standard_normal((1500, 64)))
    by = {g.id: g.cluster for g in similarity_clusters(table(spark, [(f"k{i:04}", e, None) for i, e in enumerate(x)]), "id", "embedding", 64, copies=0.9).collect()}
    assert len(set(by.values())) == 2 and len({by[f"k{i:04}"] for i in range(1200) if f"k{i:04}" in by}) == 1 and len(by) >= 1480


def test_a_small_cluster_beside_a_large_one(spark):
    r = np.random.default_rng(1)
    unit = lambda e: e / np.linalg.norm(e, axis=-1, keepdims=True)
    a, b = unit(r.standard_normal((2, 64)))
    b = 0.62 * a + np.sqrt(1 - 0.62**2) * unit(b - (a @ b) * a)  # members of the two have a mean cosine of 0.34
    x = np.sqrt(0.55) * np.repeat([a, b], (250, 2500), 0) + np.sqrt(0.45) * unit(r.standard_normal((2750, 64)))
    by = {g.id: g.cluster for g in similarity_clusters(table(spark, [(f"k{i:04}", e, None) for i, e in enumerate(x)]), "id", "embedding", 64).collect()}
    small, large = ([by.get(f"k{i:04}") for i in part] for part in (range(250), range(250, 2750)))
    best = lambda own: max(set(own), key=own.count)
    assert best(small) != best(large) and small.count(best(small)) >= 235 and large.count(best(large)) >= 2450


def test_members_close_by_chance_all_keep_a_weight(spark):
    r = np.random.default_rng(14)
    x = 1 + 0.35 * r.standard_normal((3000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    df = spark.createDataFrame([(e.tobytes(),) for e in x], "v binary").selectExpr("xxhash64(v) AS u", "v")
    seen, _ = place_in_cells(df, "u", 32, 4000, 4, 3, 256)  # one cell
    k = {g.v: g.k for g in _weights(df, seen, write_stage(_pack(seen.df, "u", "home")), 32, 0.9).collect()}
    h = x.astype("f2").astype("f4")
    n = (h @ h.T >= 0.9).sum(axis=1)
    assert len(k) == 3000 and n.mean() > 5 and np.allclose([k[e.tobytes()] for e in x], 1 / n, rtol=0.4, atol=0.002)
