"""Best representative of each duplicate group: whole bundles of fields, chosen by branch and bound.

A *bundle* is a set of fields that depend on each other (the parts of an address) and are therefore always taken from one
record. For each group and bundle the candidates are the records in which none of the bundle's fields is missing or, where
the group has no such record, those with the most of them, of as many those with the fields named first; a missing value takes part in no dependency. Among
the ways to give every bundle a candidate, the one of most total trust is wanted that keeps the functional dependencies:
``(lhs, rhs)`` says that, within a group, a value of ``lhs`` determines ``rhs``, namely the ``rhs`` of the most trusted
record that has both. Bundles joined by a dependency form a tree (checked), so each can be branched on in turn:

* Dominance: of candidates that agree on the fields named in dependencies only the most trusted can be in a best choice.
  This is one aggregation with partial sums before the shuffle; a bundle that no dependency touches keeps one candidate
  and needs no branching: its bound is met at once.
* Branch: a partial choice is joined to the next bundle's candidates on (group, determined values), never crossed.
* Bound: a partial choice is dropped if its trust plus the best trust of each open bundle is below the incumbent, the
  best choice in which all bundles come from one record.

Every bundle may stay empty (trust 0), the first of a tree as well; a neighbour that is empty or determines nothing forbids no
candidate, so a value is lost only to a dependency that forbids it. No step gathers a group in one task.

Nulls, ties and other cases: a record whose key is null belongs to no group; ``order`` columns sort descending with nulls
last, ties go to the smaller record id; repeated records are records; an empty table gives no row; the caller's columns
are renamed inside, so clashing names do no harm; very long values are carried only by dependencies, never otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.plans.stages import write_stage

#: Values that stand for "no value", compared trimmed and in lower case. Fixed values.
PLACEHOLDERS = ("", "-", "?", "??", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "und", "(empty)", "empty", "(none)", "(null)", "[redacted]", "tbd", "--", "---", "???", ".", "missing", "not available", "#n/a", "nan")


def is_missing(col: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """Null, blank or one of the placeholders."""
    bare = F.lower(F.regexp_replace(col.cast("string"), r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", ""))
    return col.isNull() | bare.isin(list(placeholders))


def uuid_key(col: Column) -> Column:
    """The 32 digits of a UUID however spelt (case, braces, urn prefix, hyphens, white space), null if it is none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"[\s{}()\[\]\"'<>-]+", "")), r"^(urn:)?(uuid:|guid:)?(0x)?", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def _tree_order(bundles: dict, fds: Sequence[tuple]) -> dict[str, list[tuple[str, str | None, tuple | None]]]:
    """By first bundle of each connected part: (bundle, bundle it hangs on, the dependency between them) in branching order."""
    home = {f: b for b, fields in bundles.items() for f in fields}
    edges: dict[str, list] = {b: [] for b in bundles}
    for lhs, rhs in fds:
        a, b = {home[f] for f in lhs}, {home[f] for f in rhs}
        if len(a) != 1 or len(b) != 1:
            raise ValueError("each side of a dependency must lie in one bundle")
        (a,), (b,) = a, b
        if a != b:
            edges[a].append((b, (tuple(lhs), tuple(rhs), True)))
            edges[b].append((a, (tuple(lhs), tuple(rhs), False)))
    out, seen = {}, set()
    for start in bundles:
        if start in seen:
            continue
        order, todo = [], [(start, None, None)]
        while todo:
            at, over, fd = todo.pop(0)
            if at in seen:
                raise ValueError("dependencies between bundles must form a tree")
            seen.add(at)
            order.append((at, over, fd))
            todo += [(b, at, e) for b, e in edges[at] if b != over]
            if sum(b == over for b, _ in edges[at]) > 1:
                raise ValueError("dependencies between bundles must form a tree")
        out[start] = order
    return out


def choose_bundles(
    df: DataFrame, key: Column, record_id: Column, order: Sequence[Column], bundles: dict[str, Sequence[str]], fds: Sequence[tuple[Sequence[str], Sequence[str]]] = (),
    trust: Column | None = None, missing=is_missing, least: int = 2,
) -> DataFrame:
    """group_key, first_id, bundle, from_id: the record that each bundle of each group of ``least`` or more records is taken from.

    ``order``: columns, larger is better, null worst. ``trust``: a number >= 0 that is summed over bundles where dependencies
    leave a choice (1 for every record if not given). A bundle without fields is never missing: it gives the best record.
    """
    fields = sorted({f for b in bundles.values() for f in b})
    rows = df.select(key.alias("g"), record_id.cast("long").alias("r"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], (-record_id.cast("long")).alias("z")).alias("t"),
                     (F.lit(1.0) if trust is None else F.coalesce(trust.cast("double"), F.lit(0.0))).alias("w"), *[F.when(~missing(F.col(f)), F.col(f)).alias(f"f_{f}") for f in fields])
    rows = rows.filter(F.col("g").isNotNull())
    held, has = {}, {}  # how many fields of a bundle a record has, and in the lower bits which; whether it is a candidate
    for b, own in bundles.items():
        held[b] = F.lit(0)
        for i, f in enumerate(own):
            held[b] = held[b] + F.col(f"f_{f}").isNotNull().cast("long") * F.lit(2 ** len(own) + 2 ** (len(own) - 1 - i))
        has[b] = F.lit(True) if not own else held[b] > 0
    parts = _tree_order(bundles, fds)
    most = {b: F.max(held[b]).alias(f"most{i}") for i, b in enumerate(bundles) if len(bundles[b]) > 1 and not any(part == [(b, None, None)] for part in parts.values())}
    if most:
        rows = rows.join(rows.groupBy(F.col("g").alias("g_most")).agg(*most.values()), F.col("g") == F.col("g_most"))
        has |= {b: has[b] & (held[b] == F.col(f"most{i}")) for i, b in enumerate(bundles) if b in most}
    if any(len(part) > 1 for part in parts.values()):  # branching reads the rows several times: keys and tests are worked out once
        flags = {b: f"has{i}" for i, b in enumerate(bundles)}
        rows = write_stage(rows.withColumns({flags[b]: has[b] for b in bundles})).df
        has = {b: F.col(flags[b]) for b in bundles}
    free = [b for b, part in parts.items() if len(part) == 1]
    best = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first_id"), *[F.max(F.when(has[b], F.struct(held[b].alias("k"), "t", "r"))).alias(f"b{i}") for i, b in enumerate(free)])
    best = best.filter(F.col("n") >= least)
    pick = [F.struct(F.lit(b).alias("bundle"), F.col(f"b{i}.r").alias("from_id")) for i, b in enumerate(free)]
    out = [best.select(F.col("g").alias("group_key"), "first_id", F.inline(F.array(*pick)))] if free else []
    for part in parts.values():
        if len(part) > 1:
            long = _branch(rows, part, has)
            out.append(best.select("g", "first_id").join(long, "g").select(F.col("g").alias("group_key"), "first_id", "bundle", "from_id"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.filter(F.col("from_id").isNotNull())


def _branch(rows: DataFrame, part: list, has: dict) -> DataFrame:
    """g, bundle, from_id of one connected part of bundles."""

    def vals(fs):
        whole = F.lit(True)
        for f in fs:
            whole = whole & F.col(f"f_{f}").isNotNull()
        return F.when(whole, F.to_json(F.struct(*[F.col(f"f_{f}") for f in fs])))

    sides = {b: [] for b, _, _ in part}
    for b, over, fd in part:
        if over is not None:
            lhs, rhs, down = fd
            sides[b].append(rhs if down else lhs)
            sides[over].append(lhs if down else rhs)
    cands, tops = {}, None
    for b, _, _ in part:
        sig = [vals(fs).alias(f"s{i}") for i, fs in enumerate(sides[b])]
        c = rows.filter(has[b]).select("g", "w", "t", "r", *sig).groupBy("g", *[f"s{i}" for i in range(len(sig))]).agg(F.max(F.struct("w", "t", "r")).alias("m"))
        cands[b] = c
        top = c.groupBy("g").agg(F.max("m.w").alias(f"top_{b}"))
        tops = top if tops is None else tops.join(top, "g", "full_outer")
    every = F.lit(True)
    for b, _, _ in part:
        every = every & has[b]
    det = {}  # of the values of the one side, the values the other side must have
    self_ok = rows.filter(every)
    for b, over, fd in part:
        if over is None:
            continue
        lhs, rhs, down = fd
        both = rows.filter(has[b] & has[over]).select("g", vals(lhs).alias("lhs"), vals(rhs).alias("rhs"), F.struct("w", "t").alias("m")).filter(F.col("lhs").isNotNull() & F.col("rhs").isNotNull())
        det[b] = both.groupBy("g", "lhs").agg(F.max_by("rhs", "m").alias("rhs"))
        agreed = det[b].withColumnsRenamed({"lhs": f"l_{b}", "rhs": f"r_{b}", "g": f"g_{b}"})
        self_ok = self_ok.join(agreed, (F.col("g") == F.col(f"g_{b}")) & (vals(lhs) == F.col(f"l_{b}")) & (vals(rhs) == F.col(f"r_{b}")), "left_semi")
    bound0 = self_ok.groupBy("g").agg((F.max("w") * len(part)).alias("incumbent"))
    limits = tops.join(bound0, "g", "left").fillna(0.0)
    b0 = part[0][0]
    named = lambda df, b: df.withColumnsRenamed({f"s{i}": f"s_{b}_{i}" for i in range(len(sides[b]))})
    front = named(cands[b0], b0).unionByName(tops.select("g"), allowMissingColumns=True)  # or the first bundle left empty
    front = front.withColumn("score", F.coalesce("m.w", F.lit(0.0))).withColumn(f"p_{b0}", F.col("m.r")).withColumn("tie", F.array("m.t")).drop("m")
    left, names = [f"s_{b0}_{i}" for i in range(len(sides[b0]))], [b0]  # values that dependencies still ask for
    for k, (b, over, fd) in enumerate(part):
        if over is not None:
            own = [f"s_{b}_{i}" for i in range(len(sides[b]))]
            ask = next(x for x in left if x.startswith(f"s_{over}_"))
            rule, down = det[b], fd[2]
            side = named(cands[b], b)
            if down:
                front = front.join(rule.withColumnsRenamed({"lhs": ask, "rhs": "near"}), ["g", ask], "left")
                side = side.withColumn("far", F.col(own[0]))
            else:
                front = front.withColumn("near", F.col(ask))
                side = side.join(rule.withColumnsRenamed({"lhs": own[0], "rhs": "far"}), ["g", own[0]], "left")
            # "=v": the value must be v; "?": a candidate that fits every value; "*": any candidate; "0": none
            meet = F.when(F.col("near").isNull(), F.array(F.lit("*"), F.lit("0"))).otherwise(F.array(F.concat(F.lit("="), "near"), F.lit("?"), F.lit("0")))
            side = side.withColumn("tag", F.explode(F.array(F.coalesce(F.concat(F.lit("="), "far"), F.lit("?")), F.lit("*")))).groupBy("g", "tag", *own[1:]).agg(F.max("m").alias("m2"))
            front = front.withColumn("tag", F.explode(meet)).join(side, ["g", "tag"], "left")
            front = front.withColumn("score", F.col("score") + F.coalesce("m2.w", F.lit(0.0))).withColumn(f"p_{b}", F.col("m2.r")).withColumn("tie", F.concat("tie", F.array("m2.t")))
            left = [x for x in left if x != ask] + own[1:]
            names.append(b)
        rest = F.lit(0.0)
        for other, _, _ in part[k + 1 :]:
            rest = rest + F.col(f"top_{other}")
        front = front.join(limits, "g").filter(F.col("score") + rest >= F.col("incumbent"))
        if over is not None:  # dominance among partial choices that ask the same of the rest
            front = front.groupBy("g", *left).agg(F.max(F.struct("score", "tie", *[F.col(f"p_{x}") for x in names])).alias("m")).select("g", *left, "m.*")
        else:
            front = front.drop(*limits.columns[1:])
    return front.select("g", F.inline(F.array(*[F.struct(F.lit(b).alias("bundle"), F.col(f"p_{b}").alias("from_id")) for b in names])))


def build_survivors(df: DataFrame, chosen: DataFrame, record_id: str, bundles: dict[str, Sequence[str]], missing=is_missing) -> DataFrame:
    """group_key, first_id and every field of the bundles: the record built from the choice; missing values are null."""
    fields = [f for b in bundles.values() for f in b]
    source = df.select(F.col(record_id).cast("long").alias("from_id"), *[F.when(~missing(F.col(f)), F.col(f)).alias(f"f_{f}") for f in fields])
    long = chosen.join(source, "from_id")
    aggs = [F.max(F.when(F.col("bundle") == b, F.col(f"f_{f}"))).alias(f) for b, own in bundles.items() for f in own]
    return long.groupBy("group_key", "first_id").agg(*aggs)
