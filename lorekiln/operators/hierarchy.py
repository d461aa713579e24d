"""Parent-child links to full hierarchies by heavy-path decomposition.

``build_hierarchy`` turns (node, parent) links into one row per node with root, depth, chain, position on the chain and
a preorder interval. Steps, each a fixed number of joins on node keys, so no task ever holds a tree:

1. Cycle separation by pointer doubling. The same rounds count descendants: those nearer than 2^(k+1) are those nearer
   than 2^k plus the same count at each node exactly 2^k below. The set of unfinished nodes stops shrinking only when all
   that remain run into a loop, since a depth is never reached without all smaller ones.
2. The child with the largest subtree continues its parent's chain (ties: smallest id); doubling along these links gives
   each node its chain and its position there. A path crosses at most log2(n) chains.
3. Chains are laid out top-down, one level of chains a round: root, depth and preorder start of each chain's head follow
   from the chain above. A chain is an interval of the preorder, and the descendants of a node are exactly the labels
   ``pre + 1 .. pre + size - 1`` of its root, so all descendants take two numbers instead of a list.

Inputs and their results: a null node is ignored; a null, blank or unknown parent makes a root; a node that is its own
parent is a loop of one; repeated (node, parent) rows count once and, if one node has several parents, the smallest
non-null parent is taken (choose earlier by any rule of your own); extra columns are ignored. Nodes on a loop or leading
into one get ``root`` = the smallest id on the loop, ``depth`` = -1 and null chain columns. An empty table gives none.

A parent with very many children is no hot spot: sibling offsets are prefix sums in two steps over 256 hashed slices. The heaviest
child comes first, then the others by slice and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.plans.stages import Scope, Stage, write_stage


def _advance(old: Stage | None, df: DataFrame) -> Stage:
    new = write_stage(df)
    if old is not None:
        old.release()
    return new


def _links(links: DataFrame, node: str, parent: str) -> DataFrame:
    own = links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("up"))
    own = own.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.when(F.trim("up") != "", F.col("up"))).alias("up"))
    known = own.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    return own.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up"))


def _double(base: Stage) -> tuple[Stage, Stage | None]:
    """(node, size of its subtree) and, if any, (node, smallest id of its loop) of the nodes that never reach a root.

    A round writes the nodes that still move, and what it adds to nodes that stand still already; sizes are summed once at the end.
    """
    # jump: the ancestor 2^k above, null once past the root; low: smallest id among the 2^k nodes from here upwards
    still = F.col("jump").isNotNull()
    now = write_stage(base.df.select("node", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size"), F.col("node").alias("low")), still)
    rounds, open_, before = [now], now.counted, -1
    while open_ not in (0, before):
        cur = now.df.filter(still)
        far = cur.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        gained = cur.groupBy("jump").agg(F.sum("size").alias("more")).withColumnRenamed("jump", "node")
        moved = cur.join(far, "jump", "left").select("node", F.col("jump2").alias("jump"), "size", F.least("low", "low2").alias("low"))
        nxt = moved.join(gained, "node", "full_outer").select("node", "jump", (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"), "low")
        now = write_stage(nxt, still)
        rounds.append(now)
        before, open_ = open_, now.counted
    loops = None
    if open_:
        loops = write_stage(now.df.filter(still).select("node", "jump", "low"))
        reach = 2 ** (len(rounds) - 1)
        while reach < open_:  # a path inside this set is no longer than the set
            cur = loops.df
            far = cur.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
            loops = _advance(loops, cur.join(far, "jump").select("node", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low")))
            reach *= 2
        cur = loops.df
        at = cur.select(F.col("node").alias("jump"), F.col("low").alias("loop"))  # the jump ends on the loop, whose window is all of it
        loops = _advance(loops, cur.join(at, "jump").select("node", "loop"))
    parts = rounds[0].df.filter(~still)
    for r in rounds[1:]:
        parts = parts.unionByName(r.df.filter(~still))
    sizes = write_stage(parts.groupBy("node").agg(F.sum("size").alias("size")))
    for r in rounds:
        r.release()
    return sizes, loops


def _chains(tree: DataFrame) -> Stage:
    """(node, up, size, head, pos): head of the node's chain and the steps down from it. A round goes four times as far, over two hops."""
    first = F.struct((-F.col("size")).alias("s"), F.col("node").alias("node"))
    heavy = tree.filter(F.col("up").isNotNull()).groupBy("up").agg(F.min(first).alias("m")).select(F.col("m.node").alias("node"), F.lit(True).alias("heavy"))
    on, open_ = F.coalesce("heavy", F.lit(False)), ~F.col("done")
    start = tree.join(heavy, "node", "left").select("node", "up", "size", F.when(on, F.col("up")).otherwise(F.col("node")).alias("head"), on.cast("long").alias("pos"), (~on).alias("done"))
    now = write_stage(start, open_)
    rounds = [now]
    while now.counted:
        cur = now.df.filter(open_).select("node", "up", "size", "head", "pos")
        every = cur.select("node", "head", "pos", F.lit(False).alias("done"))
        for r in rounds:
            every = every.unionByName(r.df.filter("done").select("node", "head", "pos", "done"))
        to = every.select(F.col("node").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"))
        for hop in (1, 2):
            cur = cur.join(to, "head").select("node", "up", "size", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), *([F.col("done2").alias("done")] if hop == 2 else []))
        now = write_stage(cur, open_)
        rounds.append(now)
    out = rounds[0].df.filter("done")
    for r in rounds[1:]:
        out = out.unionByName(r.df.filter("done"))
    whole = write_stage(out)
    for r in rounds:
        r.release()
    return whole


def _head_offsets(nodes: DataFrame) -> DataFrame:
    """(head, up, shift): preorder distance from the chain's parent to its head, past the heavy child and earlier siblings."""
    light = nodes.filter((F.col("node") == F.col("head")) & F.col("up").isNotNull()).select("node", "up", "size")
    light = light.withColumn("slice", F.substring(F.md5("node"), 1, 2))
    slices = light.groupBy("up", "slice").agg(F.sum("size").alias("total"))
    start = Window.partitionBy("up").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("up", "slice", F.coalesce(F.sum("total").over(start), F.lit(0)).alias("before"))
    inner = Window.partitionBy("up", "slice").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    heavy = nodes.filter(F.col("node") != F.col("head")).select(F.col("up"), F.col("size").alias("skip"))
    return light.join(slices, ["up", "slice"]).join(heavy, "up").select(F.col("node").alias("head"), "up", (1 + F.col("skip") + F.col("before") + F.col("inside")).alias("shift"))


def build_hierarchy(links: DataFrame, node: str, parent: str) -> DataFrame:
    """node, parent, root, depth, size, head, pos, pre, segments, in_cycle: one row per node; see the module's text.

    ``segments`` is the path from the root as chain pieces (head, first position, last position), at most log2(n) of them;
    ``expand_paths`` turns it into ids.
    """
    with Scope() as scope:
        return scope.keep(write_stage(_build(links, node, parent))).df


def _build(links: DataFrame, node: str, parent: str) -> DataFrame:
    base = write_stage(_links(links, node, parent))
    sizes, loops = _double(base)
    nodes = _chains(base.df.join(sizes.df, "node"))
    heads = nodes.df.filter(F.col("node") == F.col("head"))
    seg = "array<struct<head:string,lo:bigint,hi:bigint>>"
    placed = [write_stage(heads.filter(F.col("up").isNull()).select("head", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pre"), F.array().cast(seg).alias("above")))]
    where = nodes.df.select(F.col("node").alias("up"), F.col("head").alias("over"), F.col("pos").alias("at"))
    below = write_stage(_head_offsets(nodes.df).join(where, "up"))
    while True:
        last = placed[-1].df.select(F.col("head").alias("over"), "root", "depth", "pre", "above")
        piece = F.struct(F.col("over").alias("head"), F.lit(0).cast("long").alias("lo"), F.col("at").alias("hi"))
        nxt = below.df.join(last, "over").select(
            "head", "root", (F.col("depth") + F.col("at") + 1).alias("depth"), (F.col("pre") + F.col("at") + F.col("shift")).alias("pre"),
            F.concat("above", F.array(piece)).cast(seg).alias("above"),
        )
        level = write_stage(nxt, F.lit(True))
        if not level.counted:
            break
        placed.append(level)
    below.release()
    chains = placed[0].df
    for level in placed[1:]:
        chains = chains.unionByName(level.df)
    own = F.struct(F.col("head"), F.lit(0).cast("long").alias("lo"), F.col("pos").alias("hi"))
    tree = nodes.df.join(chains, "head").select(
        "node", F.col("up").alias("parent"), "root", (F.col("depth") + F.col("pos")).alias("depth"), "size", "head", "pos", (F.col("pre") + F.col("pos")).alias("pre"),
        F.concat("above", F.array(own)).cast(seg).alias("segments"), F.lit(False).alias("in_cycle"),
    )
    if loops is None:
        return tree
    lost = base.df.join(loops.df, "node").select("node", F.col("up").alias("parent"), F.col("loop").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(True).alias("in_cycle"))
    return tree.unionByName(lost, allowMissingColumns=True)


def expand_paths(tree: DataFrame) -> DataFrame:
    """node, path: the ids from the root down to the node, by putting the pieces of its chains together.

    Each chain's own ids are gathered once, in order; a node takes slices of them. Loops have no path.
    """
    tree = tree.filter(~F.col("in_cycle"))
    chain = tree.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("c")).select("head", F.col("c.node").alias("ids"))
    need = tree.select("head", F.slice("segments", 1, F.size("segments") - 1).alias("above")).dropDuplicates(["head"])
    pieces = need.select(F.col("head").alias("of"), F.posexplode("above").alias("n", "p")).select("of", "n", F.col("p.head").alias("head"), F.col("p.hi").alias("hi"))
    pieces = pieces.join(chain, "head").select("of", "n", F.slice("ids", F.lit(1), (F.col("hi") + 1).cast("int")).alias("ids"))
    above = pieces.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("p")).select(F.col("of").alias("head"), F.flatten("p.ids").alias("above_ids"))
    whole = chain.join(above, "head", "left").select("head", F.coalesce("above_ids", F.array().cast("array<string>")).alias("above_ids"), "ids")
    return tree.select("node", "head", "pos").join(whole, "head").select("node", F.concat("above_ids", F.slice("ids", F.lit(1), (F.col("pos") + 1).cast("int"))).alias("path"))


def expand_descendants(tree: DataFrame) -> DataFrame:
    """ancestor, descendant: every pair, as many rows as the sum of all depths; use ``pre`` and ``size`` to avoid it."""
    paths = expand_paths(tree)
    return paths.select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("ancestor"), F.col("node").alias("descendant"))
