"""The queries over the given tables for the general data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_guid, is_guid, stripped
from ..operators.hierarchies import Hierarchy
from ..operators.history import attribute_history
from ..operators.orphans import orphan_references, presence_intervals
from ..operators.snapshots import relative_path, snapshot_changes
from .runtime import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each manifest record's references: a guid without type, or a type without guid."""
    records = table(spark, sf_dir, "manifest_assets").select(
        "record_id", canonical_guid(F.col("guid")).alias("own"), "generated_at", "script_type", "dependencies"
    ).where("own <> ''")
    guids = F.array_distinct(F.transform("dependencies", canonical_guid))
    to_assets = records.select(
        "record_id", "generated_at",
        F.explode(F.filter(guids, lambda g: (g != "") & (g != F.col("own")))).alias("ref_guid"), F.lit(None).cast("string").alias("ref_type"),
    )
    to_types = records.select(
        "record_id", "generated_at", F.lit(None).cast("string").alias("ref_guid"), stripped(F.col("script_type")).alias("ref_type")
    ).where("ref_type <> ''")
    return to_assets.unionByName(to_types)


def manifest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be referred to, with its periods: assets, built-in assets and types."""
    guid = canonical_guid(F.col("guid")).alias("guid")
    assets = presence_intervals(
        table(spark, sf_dir, "manifest_assets").select(guid, "generated_at").where(is_guid(F.col("guid"))),
        table(spark, sf_dir, "asset_removals").select(guid, "removed_at").where(is_guid(F.col("guid"))),
        "guid", "generated_at", "removed_at",
    ).withColumnRenamed("guid", "ref_guid")
    always = table(spark, sf_dir, "builtin_assets").select(guid.alias("ref_guid")).where(is_guid(F.col("ref_guid")))
    types = table(spark, sf_dir, "type_nodes").where("created_at is not null").select(
        F.col("node_key").alias("ref_type"), F.col("created_at").alias("valid_from"), F.col("removed_at").alias("valid_to")
    )
    return assets.unionByName(always, allowMissingColumns=True).unionByName(types, allowMissingColumns=True)


def manifest_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphan_references(manifest_references(spark, sf_dir), manifest_targets(spark, sf_dir), ["ref_guid", "ref_type"], "generated_at")
    return found.select(
        "record_id", "generated_at",
        F.when(F.col("ref_guid").isNotNull(), "manifest_assets").otherwise("type_nodes").alias("ref_table"),
        F.coalesce("ref_guid", "ref_type").alias("ref_key"), F.date_format("generated_at", "yyyy-MM").alias("ref_month"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of manifest records to assets and types absent when the manifest was generated."""
    return manifest_orphans(spark, sf_dir).select("record_id", "ref_table", "ref_key", "ref_month").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per referenced table and month."""
    return p2_found(spark, sf_dir).groupBy("ref_table", "ref_month").agg(
        F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("ref_key").alias("n_keys")
    )


def prefab_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, parent)`` of every prefab by its latest record."""
    latest = (
        table(spark, sf_dir, "manifest_assets")
        .select(canonical_guid(F.col("guid")).alias("node"), "generated_at", "record_id", F.lower("asset_path").endswith(".prefab").alias("prefab"), "dependencies")
        .where(is_guid(F.col("node")))
        .groupBy("node").agg(F.max("prefab").alias("prefab"), F.max(F.struct("generated_at", "record_id", "dependencies")).alias("last"))
        .where("prefab").select("node", F.array_distinct(F.transform("last.dependencies", canonical_guid)).alias("named"))
    )
    latest = Scratch(spark, "prefabs").write(latest)
    based = latest.select("node", F.explode("named").alias("parent")).where("parent <> node")
    based = based.join(latest.select(F.col("node").alias("p")), F.col("parent") == F.col("p"), "left_semi")
    return latest.select("node", F.lit(None).cast("string").alias("parent")).unionByName(based)


def prefab_tree(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return Hierarchy(prefab_links(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topmost ancestor and depth of every prefab with a parent; depth -1 at circles."""
    return prefab_tree(spark, sf_dir).nodes(intervals=False).where("parent is not null").select(
        F.col("node").alias("guid"), F.col("root").alias("root_guid"), F.col("depth").cast("int").alias("tree_depth")
    )


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefab's full path, depth, root and number of descendants."""
    tree = prefab_tree(spark, sf_dir)
    return tree.nodes().join(tree.paths(), "node").select(
        F.col("node").alias("guid"), F.col("parent").alias("parent_guid"), F.col("root").alias("root_guid"), F.col("depth").alias("tree_depth"),
        F.array_join("path", "/").alias("full_path"), "n_descendants", "on_circle",
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefab with every prefab that is based on it, directly or not, and the steps between them."""
    return prefab_tree(spark, sf_dir).descendants().select(F.col("node").alias("guid"), F.col("descendant").alias("based_guid"), F.col("distance").alias("steps"))


def edge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every semantic edge's rationale."""
    edges = table(spark, sf_dir, "semantic_edges").select(
        "record_id", "from_key", F.upper(stripped(F.col("rel"))).alias("rel"), "to_key",
        F.coalesce("valid_from", "created_at").alias("held_from"), "invalid_at", "created_at",
        F.regexp_replace(stripped(F.coalesce("rationale", F.lit(""))), r"(?U)\s+", " ").alias("rationale"),
    )
    return attribute_history(edges, ["from_key", "rel", "to_key"], "rationale", "held_from", "invalid_at", "created_at", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version of each semantic edge with its period, as text."""
    shown = "yyyy-MM-dd HH:mm:ss"
    return edge_versions(spark, sf_dir).select(
        "from_key", "rel", "to_key", F.date_format("version_from", shown).alias("version_from"),
        F.coalesce(F.date_format("version_to", shown), F.lit("")).alias("version_to"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added, changed or removed between a project's consecutive snapshots."""
    files = table(spark, sf_dir, "index_files").select(
        "project", "snapshot_no", relative_path(F.col("file_path")).alias("file_path"), F.lower("content_sha1").alias("content_sha1"), "loaded_at"
    )
    return snapshot_changes(files)


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p5_found": p5_found,
}

_P2 = r"""
WITH digits AS (SELECT *, regexp_replace(lower(guid), '[\s{}()\-]', '', 'g') AS d FROM manifest_assets),
recs AS (SELECT record_id, generated_at, script_type, dependencies,
                CASE WHEN regexp_matches(d, '^[0-9a-f]{32}$') THEN d ELSE regexp_replace(lower(guid), '^\s+|\s+$', '', 'g') END AS own FROM digits),
deps AS (SELECT record_id, generated_at, own, unnest(dependencies) AS raw FROM recs WHERE own <> ''),
dep AS (SELECT DISTINCT record_id, generated_at, own,
               CASE WHEN regexp_matches(regexp_replace(lower(raw), '[\s{}()\-]', '', 'g'), '^[0-9a-f]{32}$')
                    THEN regexp_replace(lower(raw), '[\s{}()\-]', '', 'g') ELSE regexp_replace(lower(raw), '^\s+|\s+$', '', 'g') END AS ref_key FROM deps),
gone AS (SELECT DISTINCT regexp_replace(lower(guid), '[\s{}()\-]', '', 'g') AS g, removed_at FROM asset_removals),
seen AS (SELECT DISTINCT own AS g, generated_at FROM recs WHERE regexp_matches(own, '^[0-9a-f]{32}$')),
state AS (SELECT g, generated_at AS t, 1 AS alive FROM seen s WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.g = s.g AND x.removed_at = s.generated_at)
          UNION ALL SELECT g, removed_at, 0 FROM gone),
asset_orphans AS (
  SELECT r.record_id, r.ref_key, r.generated_at FROM
    (SELECT * FROM dep WHERE ref_key <> '' AND ref_key <> own AND ref_key NOT IN (SELECT guid FROM builtin_assets)) r
    ASOF LEFT JOIN state s ON r.ref_key = s.g AND r.generated_at >= s.t
  WHERE coalesce(s.alive, 0) = 0),
typed AS (SELECT DISTINCT record_id, generated_at, regexp_replace(script_type, '^\s+|\s+$', '', 'g') AS ref_key FROM recs WHERE own <> ''),
type_orphans AS (SELECT record_id, ref_key, generated_at FROM typed r WHERE ref_key <> '' AND NOT EXISTS (
  SELECT 1 FROM type_nodes t WHERE t.node_key = r.ref_key AND t.created_at <= r.generated_at AND (t.removed_at IS NULL OR t.removed_at > r.generated_at))),
found AS (
  SELECT DISTINCT record_id, 'manifest_assets' AS ref_table, ref_key, strftime(generated_at, '%Y-%m') AS ref_month FROM asset_orphans
  UNION ALL SELECT DISTINCT record_id, 'type_nodes', ref_key, strftime(generated_at, '%Y-%m') FROM type_orphans)
"""

_P3 = r"""
WITH RECURSIVE recs AS (
  SELECT regexp_replace(lower(guid), '[\s{}()\-]', '', 'g') AS g, generated_at, record_id, asset_path, dependencies FROM manifest_assets),
prefabs AS MATERIALIZED (
  SELECT g, arg_max(dependencies, (generated_at, record_id)) AS named FROM recs WHERE regexp_matches(g, '^[0-9a-f]{32}$')
  GROUP BY g HAVING bool_or(lower(asset_path) LIKE '%.prefab')),
named AS (SELECT g, regexp_replace(lower(unnest(named)), '[\s{}()\-]', '', 'g') AS parent FROM prefabs),
links AS MATERIALIZED (SELECT g, min(parent) AS parent FROM named WHERE parent <> g AND parent IN (SELECT g FROM prefabs) GROUP BY g),
climb(g, top, steps, seen, looped) AS (
  SELECT g, parent, 1, [g, parent], false FROM links
  UNION ALL
  SELECT c.g, l.parent, c.steps + 1, list_append(c.seen, l.parent), list_contains(c.seen, l.parent)
  FROM climb c JOIN links l ON c.top = l.g WHERE NOT c.looped),
placed AS MATERIALIZED (
  SELECT g, top, seen, CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, top), len(seen))) ELSE top END AS root,
         CASE WHEN looped THEN -1 ELSE steps END AS depth
  FROM climb WHERE looped OR top NOT IN (SELECT g FROM links))
"""

SQL = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_report": _P2
    + "SELECT ref_table, ref_month, count(*) AS n_references, count(DISTINCT record_id) AS n_records, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY 1, 2",
    "p3_found": _P3 + """
SELECT g AS guid, root AS root_guid, depth AS tree_depth FROM placed""",
    "p3_paths": _P3 + """,
below AS (SELECT up AS g, count(*) AS n FROM (SELECT unnest(seen[2:]) AS up FROM placed WHERE depth > 0) GROUP BY 1)
SELECT p.g AS guid, l.parent AS parent_guid, coalesce(t.root, p.g) AS root_guid, coalesce(t.depth, 0) AS tree_depth,
       CASE WHEN t.depth = -1 THEN NULL ELSE coalesce(array_to_string(list_reverse(t.seen), '/'), p.g) END AS full_path,
       CASE WHEN t.depth = -1 THEN NULL ELSE coalesce(b.n, 0) END AS n_descendants, coalesce(t.top = p.g, false) AND coalesce(t.depth = -1, false) AS on_circle
FROM prefabs p LEFT JOIN links l USING (g) LEFT JOIN placed t USING (g) LEFT JOIN below b USING (g)""",
    "p3_descendants": _P3 + """
SELECT unnest(seen[2:]) AS guid, g AS based_guid, unnest(range(1, len(seen)))::INT AS steps FROM placed WHERE depth > 0""",
    "p4_found": r"""
WITH held AS (
  SELECT from_key, upper(trim(rel)) AS rel, to_key, coalesce(valid_from, created_at) AS s, invalid_at AS x, created_at, record_id,
         trim(regexp_replace(coalesce(rationale, ''), '\s+', ' ', 'g')) AS a
  FROM semantic_edges),
last AS (
  SELECT * FROM held WHERE s IS NOT NULL AND (x IS NULL OR x > s)
  QUALIFY row_number() OVER (PARTITION BY from_key, rel, to_key, s ORDER BY created_at DESC NULLS LAST, record_id DESC) = 1),
ended AS (SELECT *, least(x, lead(s) OVER w) AS u FROM last WINDOW w AS (PARTITION BY from_key, rel, to_key ORDER BY s)),
marked AS (SELECT *, CASE WHEN lag(u) OVER w = s AND lag(a) OVER w = a THEN 0 ELSE 1 END AS fresh
           FROM ended WINDOW w AS (PARTITION BY from_key, rel, to_key ORDER BY s)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY from_key, rel, to_key ORDER BY s) AS run FROM marked)
SELECT from_key, rel, to_key, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS version_from,
       CASE WHEN bool_or(u IS NULL) THEN '' ELSE strftime(max(u), '%Y-%m-%d %H:%M:%S') END AS version_to
FROM runs GROUP BY from_key, rel, to_key, run""",
    "p5_found": r"""
WITH files AS (
  SELECT project, snapshot_no, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS file_path,
         arg_max(coalesce(lower(content_sha1), ''), loaded_at) AS sha
  FROM index_files GROUP BY 1, 2, 3),
held AS (SELECT * FROM files WHERE sha <> ''),
steps AS (
  SELECT project, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT project, snapshot_no FROM index_files)),
new AS (SELECT h.project, h.snapshot_no, h.file_path, h.sha FROM held h JOIN steps s USING (project, snapshot_no) WHERE s.prev_no IS NOT NULL),
old AS (SELECT h.project, s.snapshot_no, h.file_path, h.sha FROM held h JOIN steps s ON h.project = s.project AND h.snapshot_no = s.prev_no)
SELECT project, snapshot_no, file_path,
       CASE WHEN old.sha IS NULL THEN 'added' WHEN new.sha IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new FULL JOIN old USING (project, snapshot_no, file_path)
WHERE new.sha IS DISTINCT FROM old.sha""",
}
