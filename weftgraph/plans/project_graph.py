"""The given tables seen as one property graph.

Nodes are types, namespaces, assets and concepts; static edges are what the
manifests and types state, semantic edges what people asserted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_guid, is_guid, stripped
from ..functions.text import file_stem
from .runtime import Scratch


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type once; stale if none of its rows is still there."""
    return table(spark, sf_dir, "type_nodes").groupBy(F.col("node_label").alias("label"), F.col("node_key").alias("key")).agg(
        F.min("type_name").alias("name"), F.min("ns_name").alias("ns"), F.min("project").alias("project"), F.min("file_path").alias("path"),
        F.min("doc").alias("doc"), F.min("content_hash").alias("content_hash"), F.min(F.col("removed_at").isNotNull()).alias("stale"),
    )


def latest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's record generated last."""
    records = table(spark, sf_dir, "manifest_assets").select(canonical_guid(F.col("guid")).alias("guid"), "generated_at", "record_id", "asset_path", "script_type", "dependencies")
    last = records.where(is_guid(F.col("guid"))).groupBy("guid").agg(F.max(F.struct("generated_at", "record_id", "asset_path", "script_type", "dependencies")).alias("last"))
    return last.select("guid", F.col("last.asset_path").alias("path"), stripped(F.col("last.script_type")).alias("script_type"), F.col("last.dependencies").alias("dependencies"), F.col("last.generated_at").alias("seen_at"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, key, name, path, doc, source, stale``."""
    kinds = types(spark, sf_dir)
    removed = table(spark, sf_dir, "asset_removals").select(canonical_guid(F.col("guid")).alias("guid"), "removed_at").groupBy("guid").agg(F.max("removed_at").alias("removed_at"))
    assets = latest_assets(spark, sf_dir).join(removed, "guid", "left")
    concepts = table(spark, sf_dir, "semantic_edges").where("to_key like 'concept:%'").select("to_key").distinct()
    none = _none("string")
    shape = [
        kinds.select("label", "key", "name", "path", "doc", F.lit("static").alias("source"), "stale"),
        kinds.where("ns is not null").select(F.lit("Namespace").alias("label"), F.col("ns").alias("key"), F.col("ns").alias("name"), none.alias("path"), none.alias("doc"), F.lit("static").alias("source"), F.lit(False).alias("stale")).distinct(),
        assets.select(F.lit("Asset").alias("label"), F.col("guid").alias("key"), file_stem(F.col("path")).alias("name"), "path", none.alias("doc"), F.lit("static").alias("source"), F.coalesce(F.col("removed_at") >= F.col("seen_at"), F.lit(False)).alias("stale")),
        concepts.select(F.lit("Concept").alias("label"), F.col("to_key").alias("key"), F.expr("substring(to_key, 9)").alias("name"), none.alias("path"), none.alias("doc"), F.lit("semantic").alias("source"), F.lit(False).alias("stale")),
    ]
    return shape[0].unionByName(shape[1]).unionByName(shape[2]).unionByName(shape[3])


def searched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with ``summary``, of concepts the last that communities of their name gave, and ``signature``, of types."""
    named = table(spark, sf_dir, "communities").where("community_name is not null and summary is not null").groupBy(F.concat(F.lit("concept:"), "community_name").alias("key"))
    summaries = named.agg(F.max_by("summary", F.struct("created_at", "community_id")).alias("summary")).withColumn("label", F.lit("Concept"))
    held = nodes(spark, sf_dir).join(summaries, ["label", "key"], "left")
    return held.withColumn("signature", F.when(~F.col("label").isin("Namespace", "Asset", "Concept"), F.concat(F.lower("label"), F.lit(" "), F.col("name"))))


def asset_edges(spark: SparkSession, sf_dir: str, assets: DataFrame | None = None) -> DataFrame:
    """``(rel, src, dst)`` as the latest manifests state them, dangling ones included."""
    assets = latest_assets(spark, sf_dir) if assets is None else assets
    named = assets.select(F.col("guid").alias("src"), F.explode(F.array_distinct(F.transform("dependencies", canonical_guid))).alias("dst")).where("dst <> src and dst <> ''")
    scripts = assets.where("script_type <> ''").select(F.lit("SCRIPT_OF").alias("rel"), F.col("guid").alias("src"), F.col("script_type").alias("dst"))
    return named.select(F.lit("DEPENDS_ON").alias("rel"), "src", "dst").unionByName(scripts)


def static_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rel, src, dst)`` with both ends in the graph."""
    kinds = types(spark, sf_dir).select("key", "ns")
    assets = Scratch(spark, "assets").write(latest_assets(spark, sf_dir).select("guid", "script_type", "dependencies"))
    stated = asset_edges(spark, sf_dir, assets)
    depends = stated.where("rel = 'DEPENDS_ON'").join(assets.select(F.col("guid").alias("dst")), "dst", "left_semi")
    scripts = stated.where("rel = 'SCRIPT_OF'").join(kinds.select(F.col("key").alias("dst")), "dst", "left_semi")
    spaces = kinds.where("ns is not null").select(F.lit("IN_NAMESPACE").alias("rel"), F.col("key").alias("src"), F.col("ns").alias("dst")).distinct()
    return depends.select("rel", "src", "dst").unionByName(scripts.select("rel", "src", "dst")).unionByName(spaces)


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each semantic edge in the state written last."""
    rows = table(spark, sf_dir, "semantic_edges").withColumn("rel", F.upper(stripped(F.col("rel"))))
    kept = ("confidence", "rationale", "author", "valid_from", "invalid_at", "commit_sha")
    last = rows.groupBy("rel", F.col("from_key").alias("src"), F.col("to_key").alias("dst")).agg(F.max(F.struct("created_at", "record_id", *kept)).alias("last"))
    return last.select("rel", "src", "dst", F.lit("semantic").alias("source"), F.col("last.record_id").alias("record_id"), F.col("last.created_at").alias("created_at"), *(F.col(f"last.{c}").alias(c) for c in kept))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel, src, dst, source, author, confidence, invalid_at`` of all edges."""
    static = static_edges(spark, sf_dir).select("rel", "src", "dst", F.lit("static").alias("source"), _none("string").alias("author"), _none("double").alias("confidence"), _none("timestamp_ntz").alias("invalid_at"))
    return static.unionByName(semantic_edges(spark, sf_dir).select(*static.columns))


def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)``: a type refers to another where an asset with the one as script depends on an asset with the other."""
    stated = Scratch(spark, "stated").write(static_edges(spark, sf_dir).where("rel <> 'IN_NAMESPACE'"))
    script = stated.where("rel = 'SCRIPT_OF'")
    uses = stated.where("rel = 'DEPENDS_ON'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    one = script.select(F.col("src").alias("a"), F.col("dst").alias("ta"))
    two = script.select(F.col("src").alias("b"), F.col("dst").alias("tb"))
    return uses.join(one, "a").join(two, "b").where("ta <> tb").select(F.col("ta").alias("src"), F.col("tb").alias("dst")).distinct()


#: The same in SQL, as the start of a WITH list.
SQL = r"""
WITH RECURSIVE types AS MATERIALIZED (
  SELECT node_label AS label, node_key AS key, min(type_name) AS name, min(ns_name) AS ns, min(project) AS project, min(file_path) AS path,
         min(doc) AS doc, min(content_hash) AS content_hash, bool_and(removed_at IS NOT NULL) AS stale
  FROM type_nodes GROUP BY 1, 2),
last_assets AS MATERIALIZED (
  SELECT regexp_replace(lower(guid), '[\s{}()\-]', '', 'g') AS guid, arg_max(asset_path, (generated_at, record_id)) AS path,
         arg_max(coalesce(regexp_replace(script_type, '^\s+|\s+$', '', 'g'), ''), (generated_at, record_id)) AS script_type,
         arg_max(coalesce(dependencies, []), (generated_at, record_id)) AS dependencies, max(generated_at) AS seen_at
  FROM manifest_assets WHERE regexp_matches(regexp_replace(lower(guid), '[\s{}()\-]', '', 'g'), '^[0-9a-f]{32}$') GROUP BY 1),
gone AS (SELECT regexp_replace(lower(guid), '[\s{}()\-]', '', 'g') AS guid, max(removed_at) AS removed_at FROM asset_removals GROUP BY 1),
nodes AS MATERIALIZED (
  SELECT label, key, name, path, doc, 'static' AS source, stale FROM types
  UNION ALL SELECT DISTINCT 'Namespace', ns, ns, NULL, NULL, 'static', false FROM types WHERE ns IS NOT NULL
  UNION ALL SELECT 'Asset', a.guid, regexp_extract(path, '([^/\\]*?)(\.[^./\\]*)?$', 1), path, NULL, 'static', coalesce(removed_at >= seen_at, false) FROM last_assets a LEFT JOIN gone USING (guid)
  UNION ALL SELECT DISTINCT 'Concept', to_key, substr(to_key, 9), NULL, NULL, 'semantic', false FROM semantic_edges WHERE to_key LIKE 'concept:%'),
raw_deps AS (SELECT guid AS src, unnest(dependencies) AS d FROM last_assets),
asset_edges AS MATERIALIZED (
  SELECT DISTINCT 'DEPENDS_ON' AS rel, src,
    CASE WHEN regexp_matches(regexp_replace(lower(d), '[\s{}()\-]', '', 'g'), '^[0-9a-f]{32}$') THEN regexp_replace(lower(d), '[\s{}()\-]', '', 'g')
         ELSE regexp_replace(lower(d), '^\s+|\s+$', '', 'g') END AS dst
  FROM raw_deps WHERE d IS NOT NULL
  UNION ALL SELECT 'SCRIPT_OF', guid, script_type FROM last_assets),
static_edges AS MATERIALIZED (
  SELECT rel, src, dst FROM asset_edges WHERE rel = 'DEPENDS_ON' AND dst <> src AND dst IN (SELECT guid FROM last_assets)
  UNION ALL SELECT rel, src, dst FROM asset_edges WHERE rel = 'SCRIPT_OF' AND dst IN (SELECT key FROM types)
  UNION ALL SELECT DISTINCT 'IN_NAMESPACE', key, ns FROM types WHERE ns IS NOT NULL),
sem AS MATERIALIZED (
  SELECT upper(trim(rel)) AS rel, from_key AS src, to_key AS dst, 'semantic' AS source, record_id, created_at, confidence, rationale, author, valid_from, invalid_at, commit_sha
  FROM semantic_edges QUALIFY row_number() OVER (PARTITION BY upper(trim(rel)), from_key, to_key ORDER BY created_at DESC NULLS LAST, record_id DESC) = 1),
edges AS MATERIALIZED (
  SELECT rel, src, dst, 'static' AS source, NULL::VARCHAR AS author, NULL::DOUBLE AS confidence, NULL::TIMESTAMP AS invalid_at FROM static_edges
  UNION ALL SELECT rel, src, dst, source, author, confidence, invalid_at FROM sem),
structural AS MATERIALIZED (
  SELECT DISTINCT x.dst AS src, y.dst AS dst FROM static_edges d JOIN static_edges x ON d.src = x.src AND x.rel = 'SCRIPT_OF'
  JOIN static_edges y ON d.dst = y.src AND y.rel = 'SCRIPT_OF' WHERE d.rel = 'DEPENDS_ON' AND x.dst <> y.dst)
"""
