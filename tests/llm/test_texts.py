import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekiln.llm import near_duplicates as nd
from lorekiln.llm.leakage import find_leaks, plain_words
from lorekiln.llm.packing import TOKEN, pack, plan_bins, token_count
from lorekiln.llm.splitting import split_oversized, split_text
from lorekiln.llm.stuffing import covered, longest_repeats, most_loose, page_scores, stuffed_pages, word_runs

WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    """Rows (id, text, tags) with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, g, 1, "k", "x") for i, t, g in rows], "id string, text string, tags string, u int, key string, class string")


def sets(text, n):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def brute_pairs(rows, similarity, tag_similarity, n, least):
    good = {}
    for i, t, g in rows:
        s, words = sets(t, n)
        tags = nd.tag_set(g)
        if i is not None and words >= least and tags:
            good[i] = (s, tags)
    ids = sorted(good)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            (s, t), (p, q) = good[a], good[b]
            if len(s & p) >= similarity * len(s | p) and len(t & q) >= tag_similarity * len(t | q):
                out.add((a, b))
    return out


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        k = r.randrange(len(w))
        w[k : k + r.randrange(2)] = [r.choice(WORDS)]
    return w


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for d in range(60):
        base = [r.choice(WORDS) for _ in range(r.randrange(25, 90))]
        for c in range(r.randrange(1, 5)):
            rows.append((f"d{d:02}-{c}", " ".join(edited(r, base, c * 2)), r.choice(['["a","b"]', '["A ", "b"]', '["a","c"]', '["q"]'])))
    rows += [(f"copy{i:02}", rows[0][1], rows[0][2]) for i in range(12)] + rows[:7]
    odd = [("null", None, '["a"]'), ("blank", "  ", '["a"]'), ("short", "one two", '["a"]'), ("cut", rows[0][1], '["a"'), ("none", rows[0][1], None), ("emp", rows[0][1], "[]"), ("obj", rows[0][1], '{"a":1}'), (None, rows[0][1], rows[0][2]), ("long", " ".join(WORDS * 60), '["a","b"]')]
    near = nd.near_duplicates(docs(spark, rows + odd), "id", "text", "tags", 0.6, 0.5, 3, 20)
    want = brute_pairs(rows + odd, 0.6, 0.5, 3, 20)
    got = [tuple(x) for x in near.pairs().select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    links = {x.id: (x.class_id, x.copies, x.links) for x in near.degrees().collect()}
    assert links["copy05"][1] == 12 and links["copy05"][0] == min(i for i, v in links.items() if v[0] == links["copy05"][0])
    groups = {}
    for x in nd.link_groups(near.links, "rep_a", "rep_b").collect():
        groups.setdefault(x.group, set()).add(x.node)
    for g, nodes in groups.items():
        assert g == min(nodes)
    assert sum(map(len, groups.values())) == len({n for x in near.links.collect() for n in (x.rep_a, x.rep_b)})


def test_near_duplicates_of_nothing(spark):
    near = nd.near_duplicates(docs(spark, []), "id", "text", "tags")
    assert near.pairs().count() == 0 and near.degrees().count() == 0 and nd.link_groups(near.links, "rep_a", "rep_b").count() == 0
    five = nd.near_duplicates(docs(spark, [("a", " ".join(WORDS[:40]), None), ("b", " ".join(WORDS[:41]), None)]), "id", "text")
    assert five.pairs().first()[:] == ("a", "b")


def test_components(spark):
    r = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(0, 40) if i % 9] + [("hub", f"s{i}") for i in range(30)] + [("x", "x"), ("hub", "s1")]
    r.shuffle(edges)
    got = {x.node: x.group for x in nd.link_groups(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {v: find(v) for v in up}


def test_chains_are_grown_as_the_principle_says(spark):
    r = np.random.default_rng(0)
    n, m = nd.SEGMENTS * nd.WIDTH, nd.SEGMENTS
    a = r.integers(0, 2**16, (150, n)).astype("<u2")
    b = np.where(r.random((150, n)) < r.random((150, 1)), a, r.integers(0, 2**16, (150, n))).astype("<u2")
    budget = nd._budget(n, 0.6, 0.75)
    boxes = ((a & 3) != (b & 3)).reshape(150, m, nd.WIDTH).sum(axis=2)
    holds = np.ones((150, m), dtype=bool)  # the chain from each segment, were that segment equal
    for length in (2, 3, 4, 5, 7, 9, 11, 16, 21):
        sums = np.array([[boxes[i, [(s + j) % m for j in range(1, length)]].sum() for s in range(m)] for i in range(150)])
        holds &= sums <= length * budget // m
    rows = []
    for i in range(150):
        (x, y), (p, q) = nd._ring(a[i : i + 1]), nd._ring(b[i : i + 1])
        rows += [(i, s, 1, 2, int(x[0, s]), int(y[0, s]), int(p[0, s]), int(q[0, s])) for s in range(m)]
    df = spark.createDataFrame(rows, "i int, s int, u bigint, u2 bigint, near bigint, far bigint, near2 bigint, far2 bigint")
    got = np.zeros((150, m), dtype=bool)
    for x in df.filter(nd._chain_holds(budget)).collect():
        got[x.i, x.s] = True
    assert (got == holds).all() and 0.2 < got.mean() < 0.8
    assert got.any(axis=1)[boxes.sum(axis=1) <= budget].all()  # the principle: within the budget some chain holds


def test_hot_segments_classes_and_either_join(spark, monkeypatch):
    r = random.Random(7)
    base = [r.choice(WORDS) for _ in range(60)]
    rows = [(f"v{i:03}", " ".join(edited(r, base, 6)), '["a"]') for i in range(150)] + [(f"copy{i:02}", " ".join(base), '["a"]') for i in range(40)]
    want = brute_pairs(rows, 0.6, 0.5, 3, 20)
    plain = {tuple(x) for x in nd.near_duplicates(docs(spark, rows), "id", "text", "tags", 0.6, 0.5, 3, 20).pairs().select("id_a", "id_b").collect()}
    monkeypatch.setattr(nd, "HOT_SHARE", 1)
    monkeypatch.setattr(nd, "HOT_BLOCK", 20)
    monkeypatch.setattr(nd, "CLASS_BLOCK", 7)
    split = nd.near_duplicates(docs(spark, rows), "id", "text", "tags", 0.6, 0.5, 3, 20, broadcast_ids=0).pairs().select("id_a", "id_b").collect()
    assert len(split) == len(plain) and {tuple(x) for x in split} == plain <= want and len(plain) >= 0.99 * len(want)


def check_split(text, limit, in_bytes=False):
    size = (lambda t: len(t.encode("utf-8", "surrogateescape"))) if in_bytes else len
    at = 0
    for s, c, e, hard in (pieces := split_text(text, limit, in_bytes)):
        assert c == at and s <= c < e and size(text[s:e]) <= limit and size(text[s:c]) <= limit // 10
        at = e
    assert at == len(text)
    assert all(pieces[i + 1][0] >= pieces[i][1] for i in range(len(pieces) - 1))  # shared only with the piece before
    assert any(h for *_, h in pieces) == any(size(w) > limit for w in re.findall(r"\S+", text))
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c\n#.,-`é €😀")), min_size=1, max_size=400), st.sampled_from([10, 23, 60]), st.booleans())
def test_split_any_text(text, limit, in_bytes):
    check_split(text, limit, in_bytes)


def test_split_boundaries(spark):
    text = "# One\n\n" + "A sentence here. " * 20 + "\n\n# Two\n\n" + "Short.\n\n## Sub\n\n" + "word " * 60 + "\n\n```\ncode\n\nmore\n```\n"
    pieces = check_split(text, 200)
    assert any(text[c:].startswith("# Two") for _, c, _, _ in pieces) and all("```" not in text[c:e] or text[c:e].count("```") == 2 for _, c, e, _ in pieces)
    check_split("x" * 1000 + " " + "y" * 150 + " z" * 300, 160)
    check_split("x" * 155 + "   " * 40, 160)
    rows = [("a", "x " * 200, b"\xff\xfe" * 300), ("a", "x " * 200, b"\xff\xfe" * 300), ("n", None, None), ("e", "", b""), ("fit", "y" * 100, b"z" * 100), (None, "q " * 200, b"q " * 300)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "id string, t string, b binary, kind string, piece int")
    got = split_oversized(df, "text", F.col("id"), F.col("t"), 100).collect()
    assert {r.key for r in got} == {"a"} and not any(r.hard for r in got)
    got = sorted(split_oversized(df, "raw", F.col("id"), F.col("b"), 100, F.lit(True)).collect(), key=lambda r: r.piece)
    assert b"".join(bytes(r.bytes)[r.core - r.start :] for r in got) == rows[0][2] and all(r.hard and len(r.bytes) <= 100 for r in got)
    got = sorted(split_oversized(df.filter("id = 'a'"), "raw", F.col("id"), F.col("b"), 100).collect(), key=lambda r: r.piece)
    assert all(len(r.bytes) <= 100 for r in got) and got[0].hard
    assert split_oversized(df.limit(0), "text", F.col("id"), F.col("t"), 100).count() == 0


def test_headings_inside_fences_and_whole_siblings():
    code = "```\n" + "x = 1\n" * 100 + "# a comment\n" + "y = 2\n" * 100 + "```\n"
    text = "# One\n\n" + "Words of the first part. " * 40 + "\n\n" + code + "\n# Two\n\nThe end."
    assert any(text[c:e].strip() == code.strip() for _, c, e, _ in check_split(text, 1400))
    check_split(text, 300)  # the block has to be cut, but not before its comment as if that were a heading
    a, b = "# A\n\n" + "One sentence of A stands here. " * 100, "# B\n\n" + "Short.\n"
    text = a + "\n" + b * 1 + "# C\n\n" + "More of C. " * 20
    pieces = check_split(text, 2000)
    assert all(not ("of A" in text[c:e] and "# B" in text[c:e]) for _, c, e, _ in pieces)  # no piece runs from inside A into B
    assert any("# B" in text[c:e] and "# C" in text[c:e] for _, c, e, _ in pieces)  # whole siblings are merged


def test_lists_are_cut_by_nesting_and_markup_by_elements():
    text = "".join(f"- item {i} has some words\n" + "".join(f"  - detail {i}.{j} of it\n" for j in range(4)) for i in range(12))
    pieces = check_split(text, 300)
    assert all(text[c:e].startswith("- item") for _, c, e, _ in pieces)
    deep = "- top\n" + "".join(f"  - mid {i}\n" + "    - low one two three\n" * 6 for i in range(8))
    assert all(text_.lstrip().startswith(("- top", "- mid")) for text_ in (deep[c:e] for _, c, e, _ in check_split(deep, 260)))
    html = "".join(f"<div><p>First of {i}.</p><p>Second of {i}.</p></div>\n" for i in range(20))
    assert all(html[c:e].startswith("<div>") for _, c, e, _ in check_split(html, 200))


def best_fit_decreasing(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= s]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_is_best_fit_decreasing(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    runs, n = plan_bins(counts, 20)
    fill, seen = {}, {}
    for s, lo, hi, first, q in runs:
        for k in range(lo, hi):
            b = first + (k - lo) // q
            fill[b] = fill.get(b, 0) + s
            seen[s] = seen.get(s, 0) + 1
    assert seen == counts and len(fill) == n and sorted(20 - f for f in fill.values()) == best_fit_decreasing(sizes, 20)


def test_pack(spark):
    texts = ["a b c", "x" * 9, None, "", "  ", "w " * 25, "a-b", "naïve café_1 ?!", "w " * 25, "t " * 10]
    df = spark.createDataFrame([(i, t, 5, 5) for i, t in enumerate(texts)], "id int, text string, size int, bin int")
    counts = {r[0]: r[1] for r in df.select("id", token_count(F.col("text"))).collect()}
    assert counts == {i: len(re.findall(r"\w+|[^\w\s]+", t or "")) for i, t in enumerate(texts)} and TOKEN
    got = pack(df, "id", token_count(F.col("text")), 10).collect()
    fill = {}
    for r in got:
        fill[r.bin] = fill.get(r.bin, 0) + r.size
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(counts.values()) and {r.item for r in got if r.pieces > 1} == {5, 8}
    assert sorted(r.piece for r in got if r.item == 5) == [0, 1, 2] and {r.item for r in got} == {0, 1, 5, 6, 7, 8, 9}
    assert pack(df.limit(0), "id", token_count(F.col("text")), 10).count() == 0


def brute_leaks(rows, items, run):
    out = set()
    for d, t in rows:
        w = plain_words(t)
        own = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for e, p in items:
            v = plain_words(p)
            if any(tuple(v[i : i + run]) in own for i in range(len(v) - run + 1)):
                out.add((d, e))
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_leaks(spark, bound):
    r = random.Random(8)
    text = lambda n: [r.choice(WORDS[:60]) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(12)] + [(12, "too short"), (13, None), (14, "Ä" + " é" * 14)]
    items.append((15, items[0][1]))
    rows = []
    for i in range(60):
        w = text(r.randrange(5, 200))
        p = items[r.randrange(12)][1].split()
        n = r.randrange(9, 16)
        k = r.randrange(0, 30 - n)
        rows.append((i, (" ".join(w[:50]) + " ... " + "-".join(p[k : k + n]).upper() + "\n" + " ".join(w[50:]))))
    rows += [(60, None), (61, ""), (62, "E" * 5), (63, "a " + "É " * 14), (65, "ﷺ" * 12), (64, " ".join(text(30_000)) + " " + items[3][1])]
    df = spark.createDataFrame([(*x, 1, "p") for x in rows + rows[:4] + [(None, rows[0][1])]], "doc int, text string, item int, passage string")
    it = spark.createDataFrame([(*x, "t") for x in items + items[:3] + [(None, items[0][1])]], "item bigint, passage string, text string")
    got = [tuple(x) for x in find_leaks(df, "doc", "text", it, "item", "passage", 12, bound).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(rows, items, 12) and len(got) > 20
    assert find_leaks(df.limit(0), "doc", "text", it, "item", "passage", 12, bound).count() == 0
    assert find_leaks(df, "doc", "text", it.limit(0), "item", "passage", 12, bound).count() == 0


def brute_cover(words, least, times):
    hit = set()
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            if sum(words[k : k + j - i] == words[i:j] for k in range(len(words))) >= times:
                hit.update(range(i, j))
    return [i in hit for i in range(len(words))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.integers(1, 4), st.integers(2, 4))
def test_automaton_coverage(words, least, times):
    assert covered(longest_repeats(words, times), least) == brute_cover(words, least, times)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d-e", ",", ".\n", "|"]), max_size=60))
def test_bound_on_loose_words(parts):
    text = " ".join(parts)
    assert page_scores(text)[0] <= most_loose(word_runs(text)) + 1e-12


POLISH = "Warszawa jest stolicą Polski i największym miastem kraju. Leży nad Wisłą, w środkowej części państwa, a jej historia sięga trzynastego wieku. Miasto zostało niemal całkowicie zniszczone podczas wojny, lecz mieszkańcy odbudowali je w ciągu kilkunastu lat."
ITALIAN = "La città di Firenze fu il centro del Rinascimento e conserva ancora oggi molte opere di quel periodo. Ogni anno milioni di visitatori arrivano per vedere i musei, le chiese e i palazzi che la resero famosa."


def test_prose_of_any_language_is_not_stuffed():
    for text in (POLISH, ITALIAN, POLISH * 9, (POLISH + "\n") * 400):
        assert page_scores(text)[0] < 0.3
    for text in ("tani but czarny but tani but czarny but " * 12, "tani but, czarny but; nowy but | stary but", "najlepszy sklep z butami w Łodzi. " * 12, "\n".join(f"najlepszy sklep z butami w {w}" for w in WORDS[:30])):
        assert page_scores(text)[0] > 0.7
    body = " ".join(WORDS[:150]) * 1
    far = " ".join(f"q{i}" for i in range(30_000))
    assert page_scores(f"{body} {far}")[0] == 0.0 and page_scores(" ".join([body, far] * 3))[0] == 1.0  # repeats far apart count


def test_stuffed_pages(spark):
    prose = "The reviewers of the store have agreed that a merge was not lost, because it had been written before the restart. "
    links = "\n".join(f"https://site{i}.example/page/{w}" for i, w in enumerate(WORDS[:40]))
    rows = [
        (1, "cheap shoes, red shoes, cheap red shoes, shoes online, " * 10), (2, links), (3, prose * 3), (4, None), (5, ""), (6, "... !!!"), (7, prose + links), (8, prose * 30 + links), (9, "best hotel for paris. best hotel for rome. best hotel for oslo. best hotel for bern."),
        (10, "cheap shoes " * 40_000), (11, prose * 800), (1, "buy now " * 30), (12, "| lamp | SKU-1 | $5 |\n| desk | SKU-2 | $7 |\n| sofa | SKU-3 | $9 |"),
    ]
    df = spark.createDataFrame([(*x, "x", 0.5) for x in rows], "doc bigint, text string, loose string, repeated double")
    assert sorted(r.doc for r in stuffed_pages(df, "doc", "text").collect()) == [1, 1, 2, 7, 9, 10, 12]
    assert stuffed_pages(df.limit(0), "doc", "text").count() == 0
