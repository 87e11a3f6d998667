"""Parent-child links to full hierarchies: heavy-path decomposition.

Circles are separated first, then subtree sizes are found by pointer doubling.
Each node's largest child continues its chain; the other children start chains
of their own, so a path crosses at most log2(n) chains.  Root, depth and number
are carried from chain to chain as plain values: a node's depth is its chain's
and its place in it, and a chain's numbers follow each other, so that the
descendants of a node are one interval of numbers.  Chains are only spelt out,
in segments of bounded length, where paths are asked for.

Every loop ends after about log2 of the depth or of the number of nodes, each
round is a few equi-joins on fixed keys, and a parent with most of the children
is summed in two steps.  All work but that for paths and for listed descendants
is in proportion to the nodes (times that log2), however deep they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import Scratch
from .numbering import Numbering

#: Parts into which one parent's children are cut for running totals.
SALTS = 256
#: Nodes of a chain that are held together in one row, and ancestors of one chain that meet their descendants in one group.
SEGMENT = 1024


def _separate(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(node, parent, size)`` of the nodes that reach a root, and ``(node, parent)`` of the others."""
    rooted = F.col("parent").isNull()
    state = scratch.write(
        links.select("node", "parent", F.coalesce("parent", "node").alias("to"), (~rooted).cast("long").alias("hops"), rooted.alias("done"), F.lit(1).cast("long").alias("size"))
    )
    # A link to the root is a finished climb.
    open_before, step = state.where("not done").count(), 1
    while open_before:
        targets = state.select(F.col("node").alias("via"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"))
        gained = state.where(~F.col("done") & (F.col("hops") == step) & (F.col("node") != F.col("to"))).groupBy(F.col("to").alias("top")).agg(F.sum("size").alias("gain"))
        moved = (
            state.where("not done").join(targets, F.col("to") == F.col("via"), "left")
            .select("node", "parent", F.coalesce("to2", "to").alias("to"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.coalesce("done2", F.lit(True)).alias("done"), "size")
        )
        joined = moved.unionByName(state.where("done")).join(gained, F.col("node") == F.col("top"), "left")
        # What has no climb left contributes to its ancestors once, at the step of its length.
        after = scratch.write(joined.withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).select(*state.columns))
        scratch.drop(state)
        state, step = after, step * 2
        open_now = state.where("not done").count()
        if open_now == open_before:
            break
        open_before = open_now
    return state.where("done").select("node", "parent", "size"), state.where("not done").select("node", "parent")


def _circles(rest: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root, on_circle)`` of the nodes on or below circles; root is the smallest name on the circle.

    Doubling ends when neither the nodes arrived at nor the smallest names seen
    on the way change: then all have arrived and every circle is seen whole.
    """
    state = scratch.write(rest.join(names, "node").select("node", F.col("parent").alias("to"), F.col("name").alias("least"), F.lit(True).alias("moved")))
    places = state.select("to").distinct().count()
    while places:
        targets = state.select(F.col("node").alias("via"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        least = F.least("least", "least2")
        after = scratch.write(
            state.join(targets, F.col("to") == F.col("via")).select("node", F.col("to2").alias("to"), least.alias("least"), (least != F.col("least")).alias("moved"))
        )
        scratch.drop(state)
        state = after
        now, moved = state.agg(F.countDistinct("to"), F.count_if("moved")).first()
        if now == places and not moved:
            break
        places = now
    arrived = state.select(F.col("to").alias("place")).distinct()
    least = state.join(arrived, F.col("node") == F.col("place"), "left_semi").select(F.col("node").alias("place"), F.col("least").alias("root"))
    return (
        state.join(least, F.col("to") == F.col("place")).select("node", "root")
        .join(arrived, F.col("node") == F.col("place"), "left").select("node", "root", F.col("place").isNotNull().alias("on_circle"))
    )


def _chains(heavy: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, chain, pos)``: the top of each node's chain and the steps from it; ``up`` is null at a top."""
    state = scratch.write(
        heavy.select("node", F.coalesce("up", "node").alias("chain"), F.col("up").isNotNull().cast("int").alias("pos"), F.col("up").isNull().alias("done"))
    )
    while not state.where("not done").isEmpty():
        targets = state.select(F.col("node").alias("via"), F.col("chain").alias("chain2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(targets, F.col("chain") == F.col("via")).select(
            "node", F.col("chain2").alias("chain"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done")
        )
        after = scratch.write(moved.unionByName(state.where("done")))
        scratch.drop(state)
        state = after
    return state.select("node", "chain", "pos")


def running_total(rows: DataFrame, group: str, order: str, value: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the group's earlier rows.

    Rows are ordered by a salt of ``order`` and then by it.  Each salt of a
    group is summed apart, so no task holds a whole large group.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sums = salted.groupBy(group, "_salt").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(group, "_salt").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_salt", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    return (
        salted.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(sums, [group, "_salt"])
        .withColumn("before", F.col("_ahead") + F.col("_inner"))
        .drop("_salt", "_ahead", "_inner")
    )


class Hierarchy:
    """The forest that ``links`` (a row for each node with its parent, or null) describe.

    A node that is its own parent is a circle of one.  A parent that has no row
    of its own becomes a root without parent.  Of several rows for one node the
    smallest parent counts, null last; rows with a null node are left out.  An
    empty table gives no rows; other columns are not read.
    """

    def __init__(self, links: DataFrame, node: str = "node", parent: str = "parent"):
        self._scratch = scratch = Scratch(links.sparkSession, "hierarchy")
        given = links.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null")
        above = given.where("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast(given.schema["parent"].dataType).alias("parent"))
        known = scratch.write(given.unionByName(above).groupBy("node").agg(F.min("parent").alias("parent")))
        numbers = Numbering(known.select(F.col("node").alias("value")), scratch)
        named = known.select(F.col("node").alias("name"), F.col("parent").alias("above"))
        #: (node, parent, name, above): numbers and names of each node and its parent.
        self._names = numbers.of(numbers.of(named, "name", "node"), "above", "parent")

        trees, self._rest = _separate(self._names.select("node", "parent"), scratch)
        self._circles = _circles(self._rest, self._names.select("node", "name"), scratch)
        self._sizes = trees.select("node", "size")
        best = trees.where("parent is not null").groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("best"))
        best = scratch.write(best.select(F.col("best.node").alias("heavy"), F.col("parent").alias("of"), (-F.col("best.s")).alias("heavy_size")))
        ups = trees.join(best, F.col("node") == F.col("heavy"), "left").select("node", F.col("of").alias("up"))
        #: (node, chain, pos): the first node of each node's chain and the steps from it.
        self._placed = _chains(ups, scratch)

        # Where each chain hangs: below which node of which chain, and how far behind its number.
        light = trees.where("parent is not null").join(best, F.col("node") == F.col("heavy"), "left_anti")
        light = running_total(light, "parent", "node", "size").join(best.select("of", "heavy_size"), F.col("parent") == F.col("of"))
        up = self._placed.select(F.col("node").alias("p"), F.col("chain").alias("above"), F.col("pos").alias("above_pos"))
        self._hangs = scratch.write(
            light.join(up, F.col("parent") == F.col("p")).select(
                F.col("node").alias("chain"), "above", "above_pos", (F.col("above_pos") + 1 + F.col("heavy_size") + F.col("before")).alias("behind")
            )
        )
        roots = self._names.select(F.col("node").alias("chain"), F.col("name").alias("root")).join(trees.where("parent is null").select(F.col("node").alias("chain")), "chain", "left_semi")
        zero = F.lit(0).cast("long")
        level = scratch.write(roots.select("chain", "root", zero.alias("depth"), zero.alias("start"), F.array().cast("array<struct<chain:bigint,upto:bigint>>").alias("over")))
        levels = [level]
        while True:
            over = level.select(F.col("chain").alias("u"), "root", F.col("depth").alias("udepth"), F.col("start").alias("ustart"), F.col("over").alias("uover"))
            below = self._hangs.join(over, F.col("above") == F.col("u")).select(
                "chain", "root", (F.col("udepth") + F.col("above_pos") + 1).alias("depth"), (F.col("ustart") + F.col("behind")).alias("start"),
                F.concat("uover", F.array(F.struct(F.col("above").alias("chain"), F.col("above_pos").cast("long").alias("upto")))).alias("over"),
            )
            level = scratch.write(below)
            if level.isEmpty():
                break
            levels.append(level)
        every = levels[0]
        for more in levels[1:]:
            every = every.unionByName(more)
        #: (chain, root, depth, start, over): of each chain's first node; over are the parts of the chains above it, log2(n) at most.
        self._chains = every

    def nodes(self, intervals: bool = True) -> DataFrame:
        """``node, parent, root, depth, on_circle``, with ``intervals`` also ``first, last`` and ``n_descendants``.

        The descendants of a node are the nodes of the same root whose ``first``
        lies in ``(first, last]``.  Nodes on a circle or below one have depth
        -1, the circle's smallest node as root and null numbers, and
        ``on_circle`` tells which of the two.
        """
        at = self._placed.join(self._chains.select("chain", "root", F.col("depth").alias("from"), "start"), "chain").join(self._names.select("node", "name", "above"), "node")
        shown = [F.col("name").alias("node"), F.col("above").alias("parent"), "root", (F.col("from") + F.col("pos")).cast("int").alias("depth"), F.lit(False).alias("on_circle")]
        if intervals:
            at = at.join(self._sizes, "node")
            first = F.col("start") + F.col("pos")
            shown += [first.alias("first"), (first + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_descendants")]
        looped = self._circles.join(self._names, "node").select(F.col("name").alias("node"), F.col("above").alias("parent"), "root", F.lit(-1).alias("depth"), "on_circle")
        return at.select(*shown).unionByName(looped, allowMissingColumns=True)

    def paths(self) -> DataFrame:
        """``node, path``: an array from the root to the node; null at circles. Its size is the answer's: each node's depth.

        A chain's segments follow each other, and a chain follows the segment that it hangs from.
        """
        seg = F.floor(F.col("pos") / SEGMENT)
        held = self._placed.join(self._names.select("node", "name"), "node").groupBy("chain", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("held"))
        held = self._scratch.write(held.select("chain", "seg", F.transform("held", lambda x: x["name"]).alias("held")))
        earlier = Window.partitionBy("chain").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        heads = self._chains.where("size(over) = 0").select("chain", F.array().cast(held.schema["held"].dataType).alias("prefix"))
        parts = []
        while True:
            part = held.join(heads, "chain").select("chain", "seg", "held", F.concat("prefix", F.flatten(F.collect_list("held").over(earlier))).alias("before"))
            parts.append(part := self._scratch.write(part))
            if part.isEmpty():
                break
            up = part.select(F.col("chain").alias("above"), F.col("seg").alias("above_seg"), "held", "before")
            heads = self._hangs.withColumn("above_seg", F.floor(F.col("above_pos") / SEGMENT)).join(up, ["above", "above_seg"]).select(
                "chain", F.concat("before", F.slice("held", F.lit(1), (F.col("above_pos") % SEGMENT + 1).cast("int"))).alias("prefix")
            )
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        spelt = every.select("held", "before", F.posexplode("held").alias("i", "node")).select("node", F.concat("before", F.slice("held", F.lit(1), F.col("i") + 1)).alias("path"))
        none = F.lit(None).cast(spelt.schema["path"].dataType)
        return spelt.unionByName(self._circles.join(self._names, "node").select(F.col("name").alias("node"), none.alias("path")))

    def descendants(self) -> DataFrame:
        """``(node, descendant, distance)`` of every pair; circles give none.

        A node's ancestors are the first nodes of its own chain and of the
        chains above it; each segment of a chain meets what is below it, so a
        chain with most of the nodes is spread over its segments.
        """
        at = self._placed.join(self._chains.select("chain", F.col("depth").alias("from"), "over"), "chain").join(self._names.select("node", "name"), "node")
        at = at.select("chain", "pos", "name", (F.col("from") + F.col("pos")).alias("depth"), "over")
        own = F.array(F.struct(F.col("chain"), (F.col("pos") - 1).cast("long").alias("upto")))
        below = at.select(F.col("name").alias("descendant"), F.col("depth").alias("below"), F.explode(F.concat("over", own)).alias("x")).where("x.upto >= 0")
        below = below.select("descendant", "below", F.col("x.chain").alias("chain"), F.col("x.upto").alias("upto"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("x.upto") / SEGMENT))).alias("seg"))
        ancestors = at.select("chain", F.floor(F.col("pos") / SEGMENT).alias("seg"), "pos", F.col("name").alias("node"), "depth")
        return below.join(ancestors, ["chain", "seg"]).where("pos <= upto").select("node", "descendant", (F.col("below") - F.col("depth")).cast("int").alias("distance"))


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """:meth:`Hierarchy.nodes` with :meth:`Hierarchy.paths`, a row for each node."""
    tree = Hierarchy(links, node, parent)
    return tree.nodes().join(tree.paths(), "node")
