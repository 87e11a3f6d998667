"""Changes to the graph as pure functions: old tables and a delta give new tables.

Nothing is changed in place; the caller writes the result as a new snapshot.
Times are arguments, never the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTED = "community-detection"


def by_hand(author: str = "author") -> Column:
    return F.coalesce(F.col(author), F.lit("")) != DETECTED


def upsert(old: DataFrame, delta: DataFrame, key: list[str], order: str | None = None, replace: bool = False) -> DataFrame:
    """``old`` with the rows of ``delta`` merged in by ``key``, with the columns of ``old``.

    A value missing from the delta keeps the old one, unless ``replace``.  Of
    several delta rows for a key each column's last value that isn't null in
    ``order`` counts (without ``order`` the largest).  Null keys match null
    keys.  Columns of the delta that ``old`` lacks are left out.
    """
    values = [c for c in old.columns if c not in key]
    given = [c for c in values if c in delta.columns]
    last = [(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)).alias(f"_new_{c}") for c in given]
    new = delta.groupBy(*(F.col(c).alias(f"_key_{c}") for c in key)).agg(F.lit(True).alias("_given"), *last)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key])
    both = old.withColumn("_held", F.lit(True)).join(new, same, "full")
    merged = [F.when(F.col("_given"), F.col(f"_new_{c}") if replace else F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in values]
    return both.select(*(F.when(F.col("_held"), F.col(c)).otherwise(F.col(f"_key_{c}")).alias(c) for c in key), *merged).select(*old.columns)


def store_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each ``(rel, src, dst)`` once, if both ends are nodes; dangling edges fall away."""
    return held_edges(edges, nodes).select("rel", "src", "dst").distinct()


def held_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges, with all their columns, whose ends are both nodes."""
    keys = nodes.select("key").distinct()
    held = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return held.select(*edges.columns)


def low_confidence(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Live semantic edges by hand whose confidence is below ``least``."""
    return edges.where("source = 'semantic' and invalid_at is null").where(by_hand() & (F.col("confidence") < F.lit(float(least))))


def sweep(nodes: DataFrame, extracted: DataFrame, semantic: DataFrame, exempt: tuple[str, ...] = ("Concept",)) -> DataFrame:
    """``nodes`` with ``action``: what happens to each after an extraction.

    ``keep`` if extracted, semantic or exempt; else ``stale`` if a semantic edge
    that people made touches it, ``remove`` if none does.
    """
    present = extracted.select("label", "key").distinct().withColumn("_there", F.lit(True))
    touched = semantic.where(by_hand()).select(F.explode(F.array("src", "dst")).alias("key")).distinct().withColumn("_touched", F.lit(True))
    action = (
        F.when(F.col("_there") | (F.col("source") != "static") | F.col("label").isin(*exempt), "keep")
        .when(F.col("_touched"), "stale").otherwise("remove")
    )
    return nodes.join(present, ["label", "key"], "left").join(touched, "key", "left").withColumn("action", action).drop("_there", "_touched")


def supersede(edges: DataFrame, added: DataFrame) -> DataFrame:
    """Live edges between the ends of an added edge end when it starts; the added edges follow them.

    ``added`` has the columns of ``edges``; its earliest ``valid_from`` for a pair of ends counts.
    """
    starts = added.groupBy(F.col("src").alias("_s"), F.col("dst").alias("_d")).agg(F.min("valid_from").alias("_at"))
    kept = edges.join(starts, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    ended = kept.withColumn("invalid_at", F.coalesce("invalid_at", "_at")).select(*edges.columns)
    return ended.unionByName(added.select(*edges.columns))


def flag_review(edges: DataFrame, changed: DataFrame, reason: str) -> DataFrame:
    """``edges`` with ``needs_review`` and ``review_reason`` set where a live edge by hand touches a changed key."""
    keys = changed.select("key").distinct()
    hit = F.coalesce("_src_hit", "_dst_hit", F.lit(False)) & F.col("invalid_at").isNull() & by_hand()
    marked = edges.join(keys.select(F.col("key").alias("src"), F.lit(True).alias("_src_hit")), "src", "left").join(keys.select(F.col("key").alias("dst"), F.lit(True).alias("_dst_hit")), "dst", "left")
    old_flag = F.col("needs_review") if "needs_review" in edges.columns else F.lit(False)
    old_reason = F.col("review_reason") if "review_reason" in edges.columns else F.lit(None).cast("string")
    return (
        marked.withColumn("_hit", hit)
        .withColumn("needs_review", F.when(F.col("_hit"), True).otherwise(F.coalesce(old_flag, F.lit(False))))
        .withColumn("review_reason", F.when(F.col("_hit"), reason).otherwise(old_reason))
        .drop("_hit", "_src_hit", "_dst_hit").select(*dict.fromkeys([*edges.columns, "needs_review", "review_reason"]))
    )


def confirm(edges: DataFrame, confirmed: DataFrame, now: Column) -> DataFrame:
    """Review flags of the confirmed ``(rel, src, dst)`` go, and ``confirmed_at`` is stamped."""
    these = confirmed.select(*(F.col(c).alias(f"_{c}") for c in ("rel", "src", "dst")), F.lit(True).alias("_yes")).distinct()
    joined = edges.join(these, [edges[c] == F.col(f"_{c}") for c in ("rel", "src", "dst")], "left")
    old = F.col("confirmed_at") if "confirmed_at" in edges.columns else F.lit(None).cast("timestamp")
    return joined.select(
        *(c for c in edges.columns if c not in ("needs_review", "review_reason", "confirmed_at")),
        F.when(F.col("_yes"), False).otherwise(F.col("needs_review")).alias("needs_review"),
        F.when(F.col("_yes"), None).otherwise(F.col("review_reason")).alias("review_reason"),
        F.when(F.col("_yes"), now).otherwise(old).alias("confirmed_at"),
    ).select(*dict.fromkeys([*edges.columns, "needs_review", "review_reason", "confirmed_at"]))


def review_queue(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live semantic edges that need review or have a stale end, with the reason."""
    stale = nodes.where(F.coalesce("stale", F.lit(False))).select("key").distinct()
    sides = edges.where("source = 'semantic' and invalid_at is null").join(stale.select(F.col("key").alias("src"), F.lit(True).alias("_a")), "src", "left").join(stale.select(F.col("key").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    return sides.where(F.coalesce("needs_review", F.lit(False)) | F.coalesce("_a", "_b", F.lit(False))).select(
        "rel", "src", "dst", "confidence", F.coalesce("review_reason", F.lit("endpoint stale")).alias("reason")
    )


def miss_counts(misses: DataFrame) -> DataFrame:
    """``(key, query, n, tier, last_seen, first_seen)`` of logged ``(query, tier, seen_at)``; blank queries don't count."""
    keyed = misses.withColumn("key", F.lower(F.trim("query"))).where("key <> ''")
    order = F.struct("seen_at", "tier", "query")
    return keyed.groupBy("key").agg(
        F.max_by("query", order).alias("query"), F.count("*").alias("n"), F.max_by("tier", order).alias("tier"),
        F.max("seen_at").alias("last_seen"), F.min("seen_at").alias("first_seen"),
    )
