"""Scores of search results against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scorecard(found: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per wanted label: queries, recall at ``k`` and mean reciprocal rank of the first hit among the ``k`` nearest.

    ``found`` has ``query_id, vec_id, label, distance``, ``gold`` one wanted label for each query; a query without results counts as missed.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "label", "vec_id")
    top = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    first = gold.join(top, "query_id", "left").groupBy("query_id", "want").agg(F.min(F.when(F.col("label") == F.col("want"), F.col("at"))).alias("first"))
    return first.groupBy(F.col("want").alias("label")).agg(
        F.count("*").alias("queries"), F.avg(F.col("first").isNotNull().cast("int")).alias("recall_at_5" if k == 5 else f"recall_at_{k}"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def rejections(tiers: DataFrame, expected: DataFrame) -> DataFrame:
    """Per kind of search, how many that should find nothing were answered with high confidence, and how many rejected.

    ``tiers`` has ``query, tier``; ``expected`` has ``query, kind, should_hit``. A low tier counts as neither, except that a semantic search can't reject.
    """
    rows = expected.where("not should_hit").join(tiers, "query", "left")
    return rows.groupBy("kind").agg(
        F.count_if(F.col("tier") == "high").alias("false_high"),
        F.count_if((F.coalesce("tier", F.lit("none")) == "none") | (F.col("kind") == "semantic")).alias("rejected"), F.count("*").alias("queries"),
    )


#: Least recall of a graph without and with what people stated. Fixed values of the evaluation.
COLD_RECALL, CURATED_RECALL = 0.60, 0.85


def gate(lanes: DataFrame, cold: float = COLD_RECALL, curated: float = CURATED_RECALL) -> DataFrame:
    """``(check, passed)`` for ``lanes`` (lane: cold or curated, recall, false_high): no wrong answer with confidence, enough recall, and none lost by curation."""
    of = lambda lane, c: F.max(F.when(F.col("lane") == lane, F.col(c)))
    one = lanes.agg(*(of(lane, c).alias(f"{lane}_{c}") for lane in ("cold", "curated") for c in ("recall", "false_high")))
    checks = {
        "cold: no false high": F.col("cold_false_high") == 0, "curated: no false high": F.col("curated_false_high") == 0,
        "cold: recall": F.col("cold_recall") >= cold, "curated: recall": F.col("curated_recall") >= curated, "curation loses no recall": F.col("curated_recall") >= F.col("cold_recall"),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(x, F.lit(False)).alias("passed")) for name, x in checks.items()))
    return one.select(F.inline(rows))
