"""Lookups and traversals over a property graph held as two DataFrames.

``nodes`` has ``label, key, name, path, source, stale`` (and more), ``edges``
``rel, src, dst, source`` (and more), with node keys as ends.  Every operator
takes many seeds at once as a DataFrame, so that it is joins, not calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import Scratch

#: Relations along which a change spreads. Fixed values of the graph's model.
IMPACT_RELATIONS = ("REFERENCES", "DEPENDS_ON", "SCRIPT_OF", "INHERITS", "IMPLEMENTS", "CALLS", "USES_COMPONENT")
#: Labels of types. Fixed values of the graph's model.
TYPE_LABELS = ("Class", "Interface", "Struct", "Enum")


def live(stale: str = "stale"):
    return ~F.coalesce(F.col(stale), F.lit(False))


def find(nodes: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """The nodes whose name or key equals a term, each once for each term. Null terms find nothing."""
    terms = terms.select(F.col(term).alias("term")).where("term is not null").distinct()
    columns = ["label", "name", "key", "path", "source", "stale"]
    by_key = nodes.join(terms, F.col("key") == F.col("term")).select("term", *columns)
    by_name = nodes.join(terms, F.col("name") == F.col("term")).where("not key <=> name").select("term", *columns)
    return by_key.unionByName(by_name).withColumn("stale", F.coalesce("stale", F.lit(False)))


def neighbors(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, live_only: bool = False) -> DataFrame:
    """``(seed, rel, dir, label, name, key, source, confidence)`` along edges in both directions.

    Invalidated edges are shown unless ``live_only``; a loop comes out in both directions.
    """
    seeds = seeds.select(F.col("key").alias("seed")).distinct()
    shown = edges.where("invalid_at is null") if live_only else edges
    out = shown.join(seeds, F.col("src") == F.col("seed")).select("seed", "rel", F.lit("out").alias("dir"), F.col("dst").alias("other"), "source", "confidence")
    into = shown.join(seeds, F.col("dst") == F.col("seed")).select("seed", "rel", F.lit("in").alias("dir"), F.col("src").alias("other"), "source", "confidence")
    named = nodes.select("label", "name", "key")
    return out.unionByName(into).join(named, F.col("other") == F.col("key")).drop("other")


def dependencies(edges: DataFrame, terms: DataFrame, nodes: DataFrame, term: str = "term") -> DataFrame:
    """``(term, guid, rel, label, name, key, path)``: what the assets that a term names, by path, guid or name, directly depend on."""
    terms = terms.select(F.col(term).alias("term")).where("term is not null").distinct()
    assets = nodes.where("label = 'Asset'").select(F.col("key").alias("guid"), F.explode(F.array_distinct(F.array("key", "path", "name"))).alias("called"))
    asked = terms.join(assets, F.col("term") == F.col("called")).select("term", "guid")
    links = edges.where(F.col("rel").isin("DEPENDS_ON", "SCRIPT_OF")).select(F.col("src").alias("guid"), "rel", "dst")
    return asked.join(links, "guid").join(nodes.select("label", "name", "key", "path"), F.col("dst") == F.col("key")).select("term", "guid", "rel", "label", "name", "key", "path")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """``(seed, node, hops)``: what seeds reach along ``src -> dst`` within ``depth`` steps, at the least hops.

    Frontier search for all seeds together: each round joins the last frontier
    only and drops what is already visited.  The seed itself has 0 hops.
    """
    scratch = scratch or Scratch(edges.sparkSession, "reach")
    links = scratch.write(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = scratch.write(seeds.select(F.col("key").alias("seed"), F.col("key").alias("node")).distinct().withColumn("hops", F.lit(0)))
    seen = frontier
    for hop in range(1, depth + 1):
        following = frontier.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = scratch.write(following.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """``(seed, key, hops)``: what depends on the seeds, directly or not, within 1 to 8 steps."""
    depth = min(max(depth, 1), 8)
    spread = edges.where(F.col("rel").isin(*IMPACT_RELATIONS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(spread, seeds, depth).where("node <> seed").select("seed", F.col("node").alias("key"), "hops")


def structural_basis(edges: DataFrame, pairs: DataFrame, max_hops: int = 3) -> DataFrame:
    """``(a, b, hops)``: the least undirected steps between each pair within 1 to 6, null if there is no such path.

    Both ends are searched half the way, so a hub's neighbours are met, not crossed.  A pair of one node has none.
    """
    max_hops = min(max(max_hops, 1), 6)
    pairs = pairs.select("a", "b").distinct()
    ways = edges.where(F.col("rel").isin(*IMPACT_RELATIONS)).select("src", "dst")
    ways = ways.unionByName(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    scratch = Scratch(edges.sparkSession, "basis")
    fore = reach(ways, pairs.select(F.col("a").alias("key")), (max_hops + 1) // 2, scratch).select(F.col("seed").alias("a"), "node", F.col("hops").alias("h1"))
    back = reach(ways, pairs.select(F.col("b").alias("key")), max_hops // 2, scratch).select(F.col("seed").alias("b"), "node", F.col("hops").alias("h2"))
    met = pairs.where("a <> b").join(fore, "a").join(back, ["b", "node"]).groupBy("a", "b").agg(F.min(F.col("h1") + F.col("h2")).alias("hops"))
    return pairs.join(met, ["a", "b"], "left")


def degrees(edges: DataFrame) -> DataFrame:
    """``(key, deg)``: edges at each node in either direction; a loop counts once."""
    ends = F.array_distinct(F.array("src", "dst"))
    return edges.select(F.explode(ends).alias("key")).groupBy("key").agg(F.count("*").alias("deg"))


def uncovered_hubs(nodes: DataFrame, edges: DataFrame, limit: int | None = 20, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Types with most static edges that no human-made semantic edge touches; a limit of 1 to 200, or none."""
    types = nodes.where(F.col("label").isin(*TYPE_LABELS) & live())
    for text in excludes:
        types = types.where(~F.col("key").contains(text))
    by_hand = edges.where("source = 'semantic'").where(F.coalesce("author", F.lit("")) != "community-detection")
    covered = by_hand.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    ranked = types.join(degrees(edges.where("source = 'static'")), "key").join(covered, "key", "left_anti").select("label", "name", "key", "deg")
    return ranked if limit is None else ranked.orderBy(F.desc("deg"), "label", "key").limit(min(max(limit, 1), 200))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 20, min_size: int = 2) -> DataFrame:
    """``(key, community)`` by synchronous label propagation in which a node votes for its own label, too.

    A node takes its neighbours' most frequent label, of equal ones the
    smallest.  Edges are undirected, parallel ones count, loops don't.  Stops
    when no label changes, or after ``rounds``.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    known = nodes.select("key").distinct()
    ends = edges.select("src", "dst").where("src <> dst")
    ends = ends.join(known.withColumnRenamed("key", "src"), "src", "left_semi").join(known.withColumnRenamed("key", "dst"), "dst", "left_semi")
    ways = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    ways = scratch.write(ways.unionByName(ways.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1).cast("long").alias("n"))))
    state = scratch.write(ways.select(F.col("src").alias("key")).distinct().withColumn("community", F.col("key")))
    for _ in range(rounds):
        votes = ways.join(state, F.col("dst") == F.col("key")).groupBy("src", "community").agg(F.sum("n").alias("n"))
        best = votes.groupBy(F.col("src").alias("key")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best")).select("key", F.col("best.community").alias("community"))
        after = scratch.write(best)
        changed = not after.join(state.withColumnRenamed("community", "old"), "key").where("community <> old").isEmpty()
        scratch.drop(state)
        state = after
        if not changed:
            break
    large = state.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("community")
    return state.join(large, "community").select("key", "community")


def community_summaries(membership: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per community: its id, a name, its size and inner edges, and its first members.

    The name is the members' common first camel-case word (three or more
    letters) with ``group``, or else the first two members' names.
    """
    from ..functions.text import head_word

    inside = edges.select("src", "dst").where("src <> dst")
    inside = inside.join(membership.select(F.col("key").alias("src"), F.col("community").alias("c1")), "src").join(membership.select(F.col("key").alias("dst"), F.col("community").alias("c2")), "dst")
    links = inside.where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count("*").alias("inner_edges"))
    held = membership.join(names.select("key", "name"), "key")
    order = Window.partitionBy("community").orderBy("name", "key")
    shape = held.groupBy("community").agg(F.count("*").alias("members"), F.min("key").alias("first_key"), F.min(head_word(F.col("name"))).alias("h1"), F.max(head_word(F.col("name"))).alias("h2"))
    top = held.withColumn("at", F.row_number().over(order)).where("at <= 8").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("top"))
    listed = F.transform("top", lambda x: x["name"])
    return (
        shape.join(top, "community").join(links, "community", "left")
        .select(
            F.concat(F.lit("community:"), "first_key").alias("key"), "members", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"),
            F.when((F.col("h1") == F.col("h2")) & (F.length("h1") >= 3), F.concat("h1", F.lit(" group"))).otherwise(F.array_join(F.slice(listed, 1, 2), "/")).alias("name"),
            F.concat(F.array_join(listed, ", "), F.when(F.col("members") > 8, " …").otherwise("")).alias("listed"),
        )
    )


def uncurated_communities(nodes: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """``(name, members, summary, key)`` of the communities found, which nobody has named; those with an excluded word in name or summary are left out."""
    found = nodes.where("label = 'Concept' and key like 'community:%'")
    for text in excludes:
        found = found.where(~F.col("name").contains(text) & ~F.coalesce("summary", F.lit("")).contains(text))
    return found.select("name", "members", "summary", "key")


def duplicate_concepts(nodes: DataFrame) -> DataFrame:
    """``(name, n, keys)`` of concepts that have one name, apart from case."""
    named = nodes.where("label = 'Concept'").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))
    return named.where("n > 1")
