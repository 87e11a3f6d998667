"""The queries over the given tables for the problems of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import simple_name
from ..plans.runtime import Scratch
from .clusters import Clusters
from .packing import ALL, NOTHING, TURNS, limits, pack_texts
from .pieces import split_texts
from .tokens import encode_corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(community_id, names)``: the simple names in the keys, or else the type names that the summary lists."""
    rows = _table(spark, sf_dir, "communities").select(
        "community_id", "summary",
        F.array_distinct(F.filter(F.transform(F.coalesce("member_keys", F.array().cast("array<string>")), simple_name), lambda x: x != "")).alias("names"),
    )
    named, bare = rows.where("size(names) > 0").select("community_id", "names"), rows.where("size(names) = 0")
    words = bare.select("community_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("summary"), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))).alias("word"))
    types = _table(spark, sf_dir, "type_nodes").select(F.lower("type_name").alias("word")).distinct()
    listed = words.join(types, "word").groupBy("community_id").agg(F.array_sort(F.collect_set("word")).alias("names"))
    return named.unionByName(listed)


def community_clusters(spark: SparkSession, sf_dir: str) -> Clusters:
    return Clusters(community_members(spark, sf_dir), "community_id", "names")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of community records in one cluster."""
    return community_clusters(spark, sf_dir).pairs().select(F.col("a").alias("community_a"), F.col("b").alias("community_b"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of similar community records with its size and most typical members."""
    return community_clusters(spark, sf_dir).described()


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every community record with members, with the first record of its cluster and the cluster's size."""
    held = community_clusters(spark, sf_dir).membership()
    shape = held.groupBy("cluster").agg(F.min("id").alias("first_id"), F.count("*").alias("n_records"))
    return held.join(shape, "cluster").select(F.col("id").alias("community_id"), "first_id", "n_records")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k, without special tokens."""
    return encode_corpus(_table(spark, sf_dir, "documents"))


def _budgets(spark: SparkSession, sf_dir: str) -> list:
    """The settings in token_budgets, one row for each; all name one tokenizer here."""
    return _table(spark, sf_dir, "token_budgets").where("tokenizer = 'byte_bpe_50k'").orderBy("budget_id").collect()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's container under each budget; agents' turns bear loss, queries don't, other texts do."""
    loss = F.when(F.col("doc_type") == "query", NOTHING).when(F.col("doc_type") == "curation_talk", TURNS).otherwise(ALL)
    budgets = {b.budget_id: limits(b.capacity) for b in _budgets(spark, sf_dir)}
    return pack_texts(_table(spark, sf_dir, "documents"), budgets, loss, whole_texts=True)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each budget's containers are."""
    full = p7_containers(spark, sf_dir).groupBy("budget_id", "container_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss")
    )
    sizes = F.create_map(*(F.lit(x) for b in _budgets(spark, sf_dir) for x in (b.budget_id, b.capacity)))
    return full.groupBy("budget_id").agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("most_tokens"), F.max("segments").alias("most_segments"),
        F.max("loss").alias("most_loss"), F.avg(F.col("n") / sizes[F.col("budget_id")]).alias("mean_fill"),
    )


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each budget: the texts placed, containers above a limit, texts split though they fit, and whether parts are missing."""
    sizes = {b.budget_id: limits(b.capacity) for b in _budgets(spark, sf_dir)}
    of = lambda at: F.create_map(*(F.lit(x) for b, own in sizes.items() for x in (b, own[at])))[F.col("budget_id")]
    parts = Scratch(spark, "kept").write(p7_containers(spark, sf_dir))
    texts = parts.groupBy("budget_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    texts = texts.groupBy("budget_id").agg(
        F.count("*").alias("texts"), F.count_if((F.col("parts") > 1) & (F.col("n") <= of(0))).alias("split_though_fit"), F.count_if(F.col("n") != F.col("end")).alias("with_gaps")
    )
    full = parts.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))
    above = (F.col("n") > of(0)) | (F.col("segments") > of(1)) | ((F.col("loss") > of(2)) & (F.col("segments") > 1))
    return texts.join(full.groupBy("budget_id").agg(F.count_if(above).alias("containers_above")), "budget_id")


def p8_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each budget and text: its length and digest put together again from its pieces, and its pieces above the capacity."""
    budgets = {b.budget_id: b.capacity for b in _budgets(spark, sf_dir)}
    capacity = F.create_map(*(F.lit(x) for pair in budgets.items() for x in pair))[F.col("budget_id")]
    pieces = p8_pieces(spark, sf_dir)
    order = Window.partitionBy("budget_id", "doc_id").orderBy("piece_no")
    fresh = F.expr("substring(piece, cast(before - char_start as int) + 1, cast(char_end - before as int))")
    parts = pieces.withColumn("before", F.coalesce(F.lag("char_end").over(order), F.lit(0).cast("long"))).select("budget_id", "doc_id", "piece_no", fresh.alias("part"), (F.col("n_tokens") > capacity).alias("above"))
    whole = parts.groupBy("budget_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "part"))).alias("parts"), F.count_if("above").alias("pieces_above"))
    whole = whole.select("budget_id", "doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"), "pieces_above")
    every = _table(spark, sf_dir, "documents").where("text is not null").select(F.explode(F.array(*(F.lit(b) for b in budgets))).alias("budget_id"), "doc_id", F.col("text").alias("uncut"))
    text = F.coalesce("text", "uncut")
    return every.join(whole, ["budget_id", "doc_id"], "left").select(
        "budget_id", "doc_id", F.length(text).cast("long").alias("n_chars"), F.sha1(text).alias("digest"), F.coalesce("pieces_above", F.lit(0)).alias("pieces_above")
    )


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document above each budget's capacity."""
    budgets = [(b.budget_id, b.capacity, b.overlap) for b in _budgets(spark, sf_dir)]
    return split_texts(_table(spark, sf_dir, "documents"), budgets)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p1_members": p1_members,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_kept": p7_kept,
    "p8_pieces": p8_pieces,
    "p8_rebuilt": p8_rebuilt,
}

_P1 = r"""
WITH RECURSIVE keyed AS (
  SELECT community_id, any_value(summary) AS summary,
         any_value(list_distinct(list_filter(list_transform(coalesce(member_keys, []), lambda k: lower(trim(regexp_replace(coalesce(k, ''), '^.*(\.|::)', '')))), lambda x: x <> ''))) AS names
  FROM communities GROUP BY community_id),
words AS (SELECT community_id, unnest(regexp_extract_all(lower(summary), '[a-z_][a-z0-9_]*')) AS name FROM keyed WHERE len(names) = 0),
members AS MATERIALIZED (
  SELECT community_id, unnest(names) AS name FROM keyed
  UNION SELECT community_id, name FROM words WHERE name IN (SELECT lower(type_name) FROM type_nodes)),
sizes AS (SELECT community_id, count(*) AS n FROM members GROUP BY 1),
shared AS (SELECT a.community_id AS a, b.community_id AS b, count(*) AS n FROM members a JOIN members b USING (name) WHERE a.community_id <> b.community_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared s JOIN sizes x ON s.a = x.community_id JOIN sizes y ON s.b = y.community_id WHERE 2 * s.n >= x.n + y.n - s.n),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
"""

#: Queries that SQL can express on whole tables; of containers and pieces, what must hold of them.
SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT a AS community_a, b AS community_b FROM reached WHERE a < b",
    "p1_members": _P1 + """SELECT community_id, least(community_id, coalesce(min(b), community_id)) AS first_id, count(b) + 1 AS n_records
FROM sizes LEFT JOIN reached ON a = community_id AND b <> community_id GROUP BY community_id""",
    "p7_kept": """
SELECT budget_id, (SELECT count(*) FROM documents) AS texts, 0 AS split_though_fit, 0 AS with_gaps, 0 AS containers_above FROM token_budgets WHERE tokenizer = 'byte_bpe_50k'""",
    "p8_rebuilt": """
SELECT budget_id, doc_id, length(text) AS n_chars, sha1(text) AS digest, 0 AS pieces_above FROM documents, token_budgets WHERE text IS NOT NULL AND tokenizer = 'byte_bpe_50k'""",
}
