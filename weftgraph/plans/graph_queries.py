"""Queries for the graph operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import EMBEDDER, hash_vectors, sparse_embedding, vectors
from ..functions.text import embed_text, query_tokens
from ..operators import graph, mutations, search
from . import project_graph as pg
from .runtime import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, graph_sql: bool = True):
    """Registers a query under its function's name, with its SQL (after the graph's own, if it uses that)."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (pg.SQL if graph_sql else "") + sql
        return f

    return register


@_query("SELECT label, source, stale, count(*) AS n FROM nodes GROUP BY ALL")
def graph_nodes_by_label(spark, sf):
    return pg.nodes(spark, sf).groupBy("label", "source", "stale").agg(F.count("*").alias("n"))


@_query("SELECT rel, source, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edges GROUP BY ALL")
def graph_edges_by_type(spark, sf):
    return pg.edges(spark, sf).groupBy("rel", "source").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@_query("""
, terms AS (SELECT DISTINCT to_key AS term FROM semantic_edges UNION SELECT DISTINCT regexp_extract(from_key, '[^.]*$') FROM semantic_edges)
SELECT term, label, name, key, path, source, coalesce(stale, false) AS stale FROM nodes JOIN terms ON key = term OR name = term""")
def find_exact(spark, sf):
    """Every node that a semantic edge's end names, by key or by name."""
    rows = pg.table(spark, sf, "semantic_edges")
    terms = rows.select(F.col("to_key").alias("term")).union(rows.select(F.regexp_extract("from_key", r"[^.]*$", 0)))
    return graph.find(pg.nodes(spark, sf), terms)


@_query("""
, seeds AS (SELECT key AS seed FROM nodes WHERE label = 'Concept')
SELECT seed, rel, 'out' AS dir, label, name, key, e.source, confidence FROM edges e JOIN seeds ON src = seed JOIN nodes n ON dst = n.key
UNION ALL SELECT seed, rel, 'in', label, name, key, e.source, confidence FROM edges e JOIN seeds ON dst = seed JOIN nodes n ON src = n.key""")
def neighbors_both_dirs(spark, sf):
    """All neighbours of every concept."""
    nodes = pg.nodes(spark, sf)
    return graph.neighbors(pg.edges(spark, sf), nodes.where("label = 'Concept'"), nodes)


@_query("SELECT e.src AS guid, rel, label, name, key, n.path FROM static_edges e JOIN nodes n ON e.dst = n.key JOIN last_assets a ON e.src = a.guid WHERE rel IN ('DEPENDS_ON', 'SCRIPT_OF') AND lower(a.path) LIKE '%.prefab'")
def deps_one_hop(spark, sf):
    """What every prefab directly depends on."""
    prefabs = pg.latest_assets(spark, sf).where(F.lower("path").endswith(".prefab")).select(F.col("guid").alias("src"))
    links = pg.static_edges(spark, sf).where("rel in ('DEPENDS_ON', 'SCRIPT_OF')").join(prefabs, "src", "left_semi")
    return links.join(pg.nodes(spark, sf), F.col("dst") == F.col("key")).select(F.col("src").alias("guid"), "rel", "label", "name", "key", "path")


_SEED_GUIDS = """
, seeds AS (SELECT DISTINCT regexp_replace(lower(guid), '[\\s{}()\\-]', '', 'g') AS key FROM manifest_assets WHERE record_id % 100 = 0
            AND regexp_matches(regexp_replace(lower(guid), '[\\s{}()\\-]', '', 'g'), '^[0-9a-f]{32}$'))"""


def _seed_guids(spark, sf):
    from ..functions.keys import canonical_guid, is_guid

    rows = pg.table(spark, sf, "manifest_assets").where("record_id % 100 = 0")
    return rows.select(canonical_guid(F.col("guid")).alias("key")).where(is_guid(F.col("key"))).distinct()


@_query(_SEED_GUIDS + """
, ways AS MATERIALIZED (SELECT DISTINCT dst AS src, src AS dst FROM static_edges WHERE rel IN ('DEPENDS_ON', 'SCRIPT_OF')),
walk(seed, node, hops) AS (SELECT key, key, 0 FROM seeds UNION SELECT seed, dst, hops + 1 FROM walk JOIN ways ON node = src WHERE hops < 4)
SELECT seed, node AS key, min(hops)::INT AS hops FROM walk WHERE node <> seed GROUP BY ALL""")
def impact_depth4(spark, sf):
    """What depends within four steps on the assets of every hundredth record."""
    return graph.impact(pg.static_edges(spark, sf), _seed_guids(spark, sf), 4)


@_query(_SEED_GUIDS + """
, near AS (SELECT key AS a, e.dst AS b FROM seeds JOIN static_edges e ON e.src = key AND e.rel = 'DEPENDS_ON'),
pairs AS (SELECT DISTINCT src AS a, dst AS b FROM sem WHERE record_id % 100 = 0 AND dst IN (SELECT key FROM types)
          UNION SELECT a, b FROM near UNION SELECT a, e.dst FROM near JOIN static_edges e ON e.src = b AND e.rel = 'SCRIPT_OF'),
ways AS MATERIALIZED (SELECT src, dst FROM static_edges WHERE rel <> 'IN_NAMESPACE' UNION SELECT dst, src FROM static_edges WHERE rel <> 'IN_NAMESPACE'),
walk(a, node, hops) AS (SELECT DISTINCT a, a, 0 FROM pairs UNION SELECT a, dst, hops + 1 FROM walk JOIN ways ON node = src WHERE hops < 3)
SELECT a, b, min(hops)::INT AS hops FROM pairs LEFT JOIN walk w USING (a) WHERE w.node = b AND a <> b GROUP BY ALL
UNION ALL SELECT a, b, NULL FROM pairs p WHERE a = b OR NOT EXISTS (SELECT 1 FROM walk w WHERE w.a = p.a AND w.node = p.b)""")
def basis_hops(spark, sf):
    """Least static steps, up to three, between the types of every hundredth semantic edge, and between assets of every hundredth record, what these depend on, and its types."""
    kinds, stated = pg.types(spark, sf).select(F.col("key").alias("b")), pg.static_edges(spark, sf)
    meant = pg.semantic_edges(spark, sf).where("record_id % 100 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(kinds, "b", "left_semi").select("a", "b")
    near = stated.where("rel = 'DEPENDS_ON'").join(_seed_guids(spark, sf).withColumnRenamed("key", "src"), "src").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    scripts = stated.where("rel = 'SCRIPT_OF'").select(F.col("src").alias("b"), F.col("dst").alias("t"))
    return graph.structural_basis(stated, meant.unionByName(near).unionByName(near.join(scripts, "b").select("a", F.col("t").alias("b"))), 3)


@_query("SELECT s.src AS guid, s.dst AS type_key, n.dst AS namespace FROM static_edges s JOIN static_edges n ON s.dst = n.src WHERE s.rel = 'SCRIPT_OF' AND n.rel = 'IN_NAMESPACE'")
def typed_chain(spark, sf):
    """Asset -> type -> namespace."""
    stated = pg.static_edges(spark, sf)
    spaces = stated.where("rel = 'IN_NAMESPACE'").select(F.col("src").alias("type_key"), F.col("dst").alias("namespace"))
    return stated.where("rel = 'SCRIPT_OF'").select(F.col("src").alias("guid"), F.col("dst").alias("type_key")).join(spaces, "type_key")


@_query("""
, ends AS (SELECT src AS key FROM static_edges UNION ALL SELECT dst FROM static_edges WHERE src <> dst),
deg AS (SELECT key, count(*) AS deg FROM ends GROUP BY 1),
covered AS (SELECT src AS key FROM sem WHERE coalesce(author, '') <> 'community-detection' UNION SELECT dst FROM sem WHERE coalesce(author, '') <> 'community-detection')
SELECT label, name, key, deg FROM types JOIN deg USING (key) WHERE NOT stale AND label IN ('Class', 'Interface', 'Struct', 'Enum') AND key NOT IN (SELECT key FROM covered WHERE key IS NOT NULL)
ORDER BY deg DESC, label, key LIMIT 100""")
def uncovered_hubs(spark, sf):
    return graph.uncovered_hubs(pg.nodes(spark, sf), pg.edges(spark, sf), 100)


@_query("SELECT n.label, count(*) AS n_edges, count(DISTINCT src) AS n_types FROM structural s JOIN types n ON s.src = n.key WHERE NOT n.stale GROUP BY 1")
def structural_subgraph(spark, sf):
    kinds = pg.types(spark, sf).where(graph.live()).select("label", F.col("key").alias("src"))
    return pg.structural_edges(spark, sf).join(kinds, "src").groupBy("label").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_types"))


def _round(n: int) -> str:
    return f"""
, votes{n} AS (SELECT w.src, l.community, sum(w.n) AS n FROM ways w JOIN labels{n - 1} l ON w.dst = l.key GROUP BY 1, 2),
labels{n} AS MATERIALIZED (SELECT src AS key, community FROM votes{n} QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, community) = 1)"""


def _lpa_sql(rounds: int) -> str:
    """Communities after so many rounds; once no label changes further rounds change nothing."""
    return (
        """
, live_types AS (SELECT key, name FROM types WHERE NOT stale),
ends AS (SELECT src, dst FROM structural WHERE src IN (SELECT key FROM live_types) AND dst IN (SELECT key FROM live_types)),
ways AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM ends UNION ALL SELECT dst, src FROM ends) GROUP BY 1, 2
  UNION ALL SELECT DISTINCT src, src, 1 FROM (SELECT src FROM ends UNION SELECT dst FROM ends)),
labels0 AS (SELECT DISTINCT src AS key, src AS community FROM ways)"""
        + "".join(_round(n + 1) for n in range(rounds))
        + f"""
, member AS MATERIALIZED (SELECT key, community FROM labels{rounds} WHERE community IN (SELECT community FROM labels{rounds} GROUP BY 1 HAVING count(*) >= 2))"""
    )


_DESCRIBED_SQL = r"""
, named AS (SELECT m.community, m.key, t.name, regexp_extract(t.name, '^.[^A-Z]*') AS head, row_number() OVER (PARTITION BY m.community ORDER BY t.name, m.key) AS pos FROM member m JOIN live_types t USING (key)),
links AS (SELECT a.community, count(*) AS inner_edges FROM ends e JOIN member a ON e.src = a.key JOIN member b ON e.dst = b.key WHERE a.community = b.community GROUP BY 1),
described AS (SELECT 'community:' || min(key) AS key, count(*) AS members, coalesce(any_value(inner_edges), 0) AS inner_edges,
       CASE WHEN min(head) = max(head) AND length(min(head)) >= 3 THEN min(head) || ' group' ELSE string_agg(name, '/' ORDER BY pos) FILTER (WHERE pos <= 2) END AS name,
       string_agg(name, ', ' ORDER BY pos) FILTER (WHERE pos <= 8) || CASE WHEN count(*) > 8 THEN ' …' ELSE '' END AS listed
  FROM named LEFT JOIN links USING (community) GROUP BY community)"""


def _communities(spark, sf, **rounds):
    kinds = pg.types(spark, sf).where(graph.live()).select("key", "name")
    links = pg.structural_edges(spark, sf)
    return kinds, links, graph.label_propagation(kinds, links, **rounds)


@_query(_lpa_sql(3) + " SELECT key, community FROM member")
def communities_lpa3(spark, sf):
    """Communities of types as they are after three rounds of label propagation; :func:`communities` has the final ones."""
    return _communities(spark, sf, rounds=3)[2]


@_query(_lpa_sql(20) + " SELECT key, community FROM member")
def communities(spark, sf):
    """Communities of types by label propagation until no label changes, or for 20 rounds."""
    return _communities(spark, sf)[2]


def _described(spark, sf):
    kinds, links, member = _communities(spark, sf)
    return graph.community_summaries(member, kinds, links)


@_query(_lpa_sql(20) + _DESCRIBED_SQL + " SELECT * FROM described")
def community_summary(spark, sf):
    """Each final community of types with a name, its size, inner edges and first members."""
    return _described(spark, sf)


@_query(_lpa_sql(20) + _DESCRIBED_SQL + " SELECT count(*) AS communities, sum(members)::BIGINT AS members, max(members) AS largest, sum(inner_edges)::BIGINT AS inner_edges FROM described")
def communities_described(spark, sf):
    """How many final communities of types there are, and how large they are."""
    return _described(spark, sf).agg(F.count("*").alias("communities"), F.sum("members").alias("members"), F.max("members").alias("largest"), F.sum("inner_edges").alias("inner_edges"))


@_query(_lpa_sql(20) + _DESCRIBED_SQL + " SELECT name, members, listed AS summary, key FROM described ORDER BY members DESC, key LIMIT 50")
def uncurated_communities(spark, sf):
    """The fifty largest communities found that nobody has named."""
    found = _described(spark, sf).select(F.lit("Concept").alias("label"), "key", "name", "members", F.col("listed").alias("summary"))
    return graph.uncurated_communities(found).orderBy(F.desc("members"), "key").limit(50)


@_query("""
, members AS (SELECT DISTINCT community_name AS name, trim(unnest(member_keys)) AS key FROM communities WHERE community_name IS NOT NULL)
SELECT 'PART_OF' AS rel, t.key AS src, 'concept:' || m.name AS dst FROM members m JOIN (SELECT DISTINCT key FROM types) t USING (key)""")
def concept_members(spark, sf):
    """Each type that a community names as its member, by its key, as a part of the community's concept."""
    named = pg.table(spark, sf, "communities").where("community_name is not null").select(F.explode("member_keys").alias("key"), F.concat(F.lit("concept:"), "community_name").alias("dst"))
    named = named.select(F.trim("key").alias("key"), "dst").distinct()
    return named.join(pg.types(spark, sf).select("key").distinct(), "key").select(F.lit("PART_OF").alias("rel"), F.col("key").alias("src"), "dst")


_LEXICAL = ("event trail sampler", "harbor lattice", "LedgerOverlay", "combat loop", "scene reload on slow devices", "物理 camera", "zqx unknown words")


def _lexical_sql(queries: tuple[str, ...], tokens: dict[str, list[str]], k: int) -> str:
    values = ", ".join(f"('{q}', '{q.strip().lower()}', [{', '.join(repr(t) for t in tokens[q])}])" for q in queries)
    return f"""
, queries(query, q, toks) AS (VALUES {values}),
text AS (SELECT label, name, key, path, lower(coalesce(name, '')) AS lname, lower(coalesce(name, '') || ' ' || coalesce(key, '') || ' ' || coalesce(doc, '')) AS hay FROM nodes WHERE NOT coalesce(stale, false)),
hits AS (SELECT *, len(list_filter(toks, lambda t: contains(hay, t))) AS hit FROM text, queries),
found AS (SELECT query, label, name, key, path, hit::DOUBLE / len(toks) + CASE WHEN lname = q THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lname, q) THEN 0.5 ELSE 0.0 END
                 + CASE WHEN starts_with(lname, q) THEN 0.25 ELSE 0.0 END AS score
          FROM hits WHERE hit > 0 OR contains(lname, q) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, label, key) <= {k})"""


_TOKENS = {
    "event trail sampler": ["event", "trail", "sampler"], "harbor lattice": ["harbor", "lattice"], "LedgerOverlay": ["ledger", "overlay"],
    "combat loop": ["combat", "loop"], "scene reload on slow devices": ["scene", "reload", "on", "slow", "devices"],
    "物理 camera": ["物理", "camera"], "zqx unknown words": ["zqx", "unknown", "words"],
}


@_query(_lexical_sql(_LEXICAL[:1], _TOKENS, 20) + " SELECT * FROM found")
def candidates_type_name(spark, sf):
    """The nodes that fit a search text best, by words found in name, key and doc."""
    return search.candidates(pg.nodes(spark, sf), list(_LEXICAL[:1]), 20)


@_query(_lexical_sql(_LEXICAL, _TOKENS, 10) + """
SELECT query, CASE WHEN max(score) >= 1 THEN 'high' WHEN max(score) IS NULL THEN 'none' ELSE 'low' END AS tier, coalesce(max(score), 0.0)::DOUBLE AS top_score,
       coalesce(max(score) >= 1, false) AS hit, coalesce(max(score) < 1, true) AND regexp_matches(query, '[^\\x00-\\x7F]') AS retry_english
FROM queries LEFT JOIN found USING (query) GROUP BY query""")
def candidates_tier(spark, sf):
    """How far each of several search texts is answered."""
    found = search.candidates(pg.nodes(spark, sf), list(_LEXICAL), 10)
    return search.confidence_tiers(found, spark.createDataFrame([(q,) for q in _LEXICAL], "query string"))


_ASKED_SQL = r"""
, summaries AS (SELECT 'concept:' || community_name AS key, arg_max(summary, (created_at, community_id)) AS summary FROM communities WHERE community_name IS NOT NULL AND summary IS NOT NULL GROUP BY 1),
trimmed AS (SELECT doc_id AS query_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS query FROM documents WHERE doc_type = 'query' AND doc_id % 100 = 0),
worded AS (SELECT *, lower(query) AS q, list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(query, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[\p{L}\p{Nd}]+'), lambda w: lower(w)), lambda w: length(w) > 1)) AS ws FROM trimmed WHERE query <> ''),
queries AS MATERIALIZED (SELECT query_id, q, CASE WHEN len(ws) > 0 THEN ws ELSE [q] END AS toks FROM worded),
text AS (SELECT label, name, key, path, lower(coalesce(name, '')) AS lname, lower(concat_ws(' ', coalesce(name, ''), coalesce(key, ''), coalesce(doc, ''), CASE WHEN label = 'Concept' THEN coalesce(summary, '') ELSE '' END,
           CASE WHEN label NOT IN ('Namespace', 'Asset', 'Concept') THEN coalesce(lower(label) || ' ' || name, '') ELSE '' END)) AS hay FROM nodes LEFT JOIN summaries USING (key) WHERE NOT coalesce(stale, false)),
hits AS (SELECT *, len(list_filter(toks, lambda t: contains(hay, t))) AS hit FROM text, queries),
found AS (SELECT query_id, label, name, key, path, hit::DOUBLE / len(toks) + CASE WHEN lname = q THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lname, q) THEN 0.5 ELSE 0.0 END
                 + CASE WHEN starts_with(lname, q) THEN 0.25 ELSE 0.0 END AS score
          FROM hits WHERE hit > 0 OR contains(lname, q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, key) <= 10)
SELECT * FROM found"""


@_query(_ASKED_SQL)
def candidates_documents(spark, sf):
    """The ten nodes that fit each query among the hundredth documents best, by words found in name, key, doc, summary and signature."""
    asked = pg.table(spark, sf, "documents").where("doc_type = 'query' and doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return search.candidates_of(pg.searched_nodes(spark, sf), asked, 10)


@_query(r"""
WITH names AS (SELECT DISTINCT type_name AS name FROM type_nodes),
words AS (SELECT DISTINCT name, lower(unnest(regexp_extract_all(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) AS token FROM names)
SELECT token, count(*) AS n FROM words WHERE length(token) >= 2 GROUP BY 1""", graph_sql=False)
def tokenize_query(spark, sf):
    """How many type names hold each word."""
    names = pg.table(spark, sf, "type_nodes").select("type_name").distinct()
    return names.select(F.explode(query_tokens(F.col("type_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@_query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, label, 1 - list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q, embeddings),
per AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) <= 10)
SELECT query_id, vec_id, label, round(distance, 6) + 0.0 AS distance FROM per QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, label, vec_id) <= 10""", graph_sql=False)
def vector_search(spark, sf):
    """The ten nearest vectors of every hundredth vector, at most ten of a label."""
    rows = pg.table(spark, sf, "embeddings")
    found = search.nearest(rows.where("vec_id % 100 = 0"), rows, 10)
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@_query("""
WITH q AS (SELECT vec_id AS query_id, label AS want, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, want, vec_id, label, 1 - list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q, embeddings WHERE vec_id <> query_id),
per AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) <= 6),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, label, vec_id) AS pos FROM per QUALIFY pos <= 5),
scored AS (SELECT query_id, want, min(pos) FILTER (WHERE label = want) AS first FROM top GROUP BY ALL)
SELECT want AS label, count(*) AS queries, avg((first IS NOT NULL)::INT)::DOUBLE AS recall_at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM scored GROUP BY 1""", graph_sql=False)
def eval_scorecard(spark, sf):
    """Recall and mean reciprocal rank of vector search at finding a vector of the same label."""
    rows = pg.table(spark, sf, "embeddings")
    gold = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    from .evaluation import scorecard

    # A query finds itself first; six per label leave five others.
    found = search.nearest(rows.where("vec_id % 100 = 0"), rows, 7).where("vec_id <> query_id")
    return scorecard(found, gold, 5)


@_query("""
WITH t AS (SELECT DISTINCT type_name AS name FROM type_nodes),
camel AS (SELECT name, regexp_replace(name, '([A-Za-z0-9][a-z])([A-Z])', '\\1 \\2', 'g') AS spaced FROM t),
toks AS (SELECT name, unnest(list_concat(regexp_extract_all(lower(name), '[a-z0-9]+'),
         list_filter(list_transform(regexp_extract_all(spaced, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1))) AS tok FROM camel),
parts AS (SELECT name, tok AS s, true AS word FROM toks
          UNION ALL SELECT name, unnest(list_transform(range(1, length(tok)), lambda i: substr(tok, i::INT, 2))), false FROM toks),
hashed AS (SELECT name, word, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)),
                  lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM parts),
sums AS (SELECT name, (h % 256)::INT AS dim, sum(CASE WHEN word THEN CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END ELSE CASE WHEN h % 2 = 1 THEN -0.5 ELSE 0.5 END END)::DOUBLE AS w FROM hashed GROUP BY ALL HAVING w <> 0)
SELECT dim, count(*) AS n, round(sum(w / norm), 4) + 0.0 AS total FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY name)) AS norm FROM sums) GROUP BY 1""", graph_sql=False)
def hash_embed_dimensions(spark, sf):
    """Hashing embeddings of all type names, summed up by dimension."""
    names = pg.table(spark, sf, "type_nodes").select("type_name").distinct()
    weights = sparse_embedding(names.withColumn("text", F.col("type_name")), ["type_name"], "text")
    return weights.groupBy("dim").agg(F.count("*").alias("n"), (F.round(F.sum("weight"), 4) + F.lit(0.0)).alias("total"))


@_query(r"""
, texts AS (SELECT key, concat_ws('. ', nullif(trim(name), ''), nullif(trim(ns), ''), nullif(trim(lower(label) || ' ' || name), ''), CASE WHEN trim(doc) <> '' THEN doc END) AS t FROM types)
SELECT key, sha1(t) AS embed_hash, length(t) AS n_chars FROM texts""")
def embed_texts(spark, sf):
    """Each type's text for embedding, by its hash."""
    kinds = pg.types(spark, sf)
    signature = F.concat(F.lower("label"), F.lit(" "), F.col("name"))
    text = embed_text(F.col("name"), F.col("ns"), signature, F.col("doc"))
    return kinds.select("key", text.alias("t")).select("key", F.sha1("t").alias("embed_hash"), F.length("t").cast("long").alias("n_chars"))


_EMBED = "concat_ws('. ', nullif(trim({0}name), ''), nullif(trim({0}ns), ''), nullif(trim(lower({0}label) || ' ' || {0}name), ''), CASE WHEN trim({0}doc) <> '' THEN {0}doc END)"


@_query(f"""
, early AS (SELECT node_label AS label, node_key AS key, min(type_name) AS name, min(ns_name) AS ns, min(doc) AS doc FROM type_nodes
           WHERE created_at < TIMESTAMP '2024-01-01' AND removed_at IS NULL GROUP BY 1, 2),
texts AS (SELECT label, key, sha1({_EMBED.format("")}) AS h FROM types),
stored AS (SELECT key, sha1({_EMBED.format("")}) AS h FROM early)
SELECT t.label, count(s.key) AS skipped, count(*) - count(s.key) AS embedded FROM texts t LEFT JOIN (SELECT DISTINCT key, h FROM stored) s ON t.key = s.key AND t.h = s.h GROUP BY 1""")
def embedding_cache(spark, sf):
    """Vectors of the types known before 2024 are kept where the types' texts are still the same; all others are embedded anew."""
    text = embed_text(F.col("name"), F.col("ns"), F.concat(F.lower("label"), F.lit(" "), F.col("name")), F.col("doc"))
    early = pg.table(spark, sf, "type_nodes").where("created_at < timestamp_ntz'2024-01-01' and removed_at is null").groupBy(F.col("node_label").alias("label"), F.col("node_key").alias("key"))
    early = early.agg(F.min("type_name").alias("name"), F.min("ns_name").alias("ns"), F.min("doc").alias("doc")).select("key", text.alias("text"))
    stored = hash_vectors(early).join(early, "key").select("key", F.lit(EMBEDDER).alias("embedder"), F.sha1("text").alias("embed_hash"), "vector")
    kinds = pg.types(spark, sf).select("label", "key", text.alias("embed_text"))
    kept, fresh = search.cached_vectors(kinds, stored, EMBEDDER)
    new = hash_vectors(fresh.select("key", F.col("embed_text").alias("text")))
    both = kept.select("key", F.lit(1).alias("skipped")).unionByName(new.select("key", F.lit(0).alias("skipped")))
    return kinds.select("label", "key").join(both, "key").groupBy("label").agg(F.sum("skipped").alias("skipped"), F.sum(1 - F.col("skipped")).alias("embedded"))


_SEARCH_SQL = r"""
, asked AS (SELECT 'q' || doc_id AS id, text AS t FROM documents WHERE doc_type = 'query' AND doc_id % 100 = 0 AND text IS NOT NULL),
held AS (SELECT key AS id, EMBED AS t FROM types WHERE NOT stale),
texts AS (SELECT * FROM asked UNION ALL SELECT * FROM held),
words AS (SELECT id, unnest(list_concat(regexp_extract_all(lower(t), '[\p{L}\p{Nd}]+'),
          list_filter(list_transform(regexp_extract_all(regexp_replace(t, '([\p{L}\p{Nd}]\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[\p{L}\p{Nd}]+'), lambda x: lower(x)), lambda x: length(x) > 1))) AS tok FROM texts),
parts AS (SELECT id, tok AS s, true AS word FROM words UNION ALL SELECT id, unnest(list_transform(range(1, length(tok)), lambda i: substr(tok, i::INT, 2))), false FROM words),
hashed AS (SELECT id, word, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM parts),
sums AS MATERIALIZED (SELECT id, h % 256 AS dim, sum(CASE WHEN word THEN CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END ELSE CASE WHEN h % 2 = 1 THEN -0.5 ELSE 0.5 END END)::DOUBLE AS w FROM hashed GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM sums GROUP BY 1),
near AS (SELECT a.id AS q, b.id AS key, sum(x.w * y.w) / (any_value(a.norm) * any_value(b.norm)) AS cosine FROM norms a JOIN sums x ON a.id = x.id JOIN sums y ON x.dim = y.dim JOIN norms b ON y.id = b.id
         WHERE a.id IN (SELECT id FROM asked) AND b.id IN (SELECT id FROM held) GROUP BY 1, 2),
every AS (SELECT a.id AS q, label, name, t.key AS key, path, round(1 - coalesce(n.cosine, 0), 9) + 0.0 AS distance FROM asked a CROSS JOIN types t LEFT JOIN near n ON n.q = a.id AND n.key = t.key WHERE NOT stale AND label IN ('Class', 'Struct'))
SELECT substr(q, 2)::BIGINT AS query_id, label, name, key, path, round(distance, 6) + 0.0 AS distance FROM every QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, label, key) <= 10""".replace("EMBED", _EMBED.format(""))


@_query(_SEARCH_SQL)
def hash_search(spark, sf):
    """The ten classes and structs nearest to each query among the hundredth documents, by vectors of their texts."""
    asked = pg.table(spark, sf, "documents").where("doc_type = 'query' and doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "text")
    kinds = pg.types(spark, sf)
    text = embed_text(F.col("name"), F.col("ns"), F.concat(F.lower("label"), F.lit(" "), F.col("name")), F.col("doc"))
    found = search.search_nodes(vectors(asked, ["query_id"], "text"), hash_vectors(kinds.select("key", text.alias("text"))), kinds, 10, ("class", "STRUCT"))
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@_query("""
WITH base AS (SELECT node_label AS label, node_key AS key, max(file_path) AS path, max(doc) AS doc FROM type_nodes WHERE created_at < TIMESTAMP '2024-01-01' GROUP BY 1, 2),
delta AS (SELECT node_label AS label, node_key AS key, max(file_path) AS path, max(doc) AS doc FROM type_nodes WHERE created_at >= TIMESTAMP '2023-12-01' GROUP BY 1, 2)
SELECT label, key, coalesce(d.path, b.path) AS path, coalesce(d.doc, b.doc) AS doc FROM base b FULL JOIN delta d USING (label, key)""", graph_sql=False)
def node_upsert(spark, sf):
    """Types known before 2024 merged with those seen from December 2023 on; nothing known is lost."""
    rows = pg.table(spark, sf, "type_nodes").select(F.col("node_label").alias("label"), F.col("node_key").alias("key"), F.col("file_path").alias("path"), "doc", "created_at")
    old = rows.where("created_at < timestamp_ntz'2024-01-01'").groupBy("label", "key").agg(F.max("path").alias("path"), F.max("doc").alias("doc"))
    return mutations.upsert(old, rows.where("created_at >= timestamp_ntz'2023-12-01'"), ["label", "key"])


@_query("""
, given AS (SELECT rel, count(*) AS input_edges FROM asset_edges WHERE dst <> src AND dst <> '' GROUP BY 1),
held AS (SELECT rel, count(*) AS stored_edges FROM static_edges WHERE rel <> 'IN_NAMESPACE' GROUP BY 1)
SELECT rel, input_edges, stored_edges FROM given JOIN held USING (rel)""")
def edge_upsert_dangling(spark, sf):
    """Edges given and edges stored: those without both ends fall away."""
    given = pg.asset_edges(spark, sf)
    stored = mutations.store_edges(given, pg.nodes(spark, sf).where("label <> 'Namespace' and label <> 'Concept'"))
    return given.groupBy("rel").agg(F.count("*").alias("input_edges")).join(stored.groupBy("rel").agg(F.count("*").alias("stored_edges")), "rel")


@_query("""
, touched AS (SELECT src AS key FROM sem WHERE coalesce(author, '') <> 'community-detection' UNION SELECT dst FROM sem WHERE coalesce(author, '') <> 'community-detection')
SELECT label, CASE WHEN source <> 'static' OR label <> 'Asset' AND NOT stale OR label = 'Asset' AND NOT stale THEN 'keep' WHEN key IN (SELECT key FROM touched WHERE key IS NOT NULL) THEN 'stale' ELSE 'remove' END AS action, count(*) AS n
FROM nodes GROUP BY 1, 2""")
def lifecycle_sweep(spark, sf):
    """What becomes of the nodes if only those that are still there are extracted."""
    nodes = pg.nodes(spark, sf)
    return mutations.sweep(nodes, nodes.where(graph.live()), pg.semantic_edges(spark, sf)).groupBy("label", "action").agg(F.count("*").alias("n"))


@_query("""
, old AS (SELECT node_label AS label, node_key AS key, max(doc) AS doc FROM type_nodes WHERE created_at < TIMESTAMP '2025-01-01' GROUP BY 1, 2),
extracted AS (SELECT label, key, doc FROM types WHERE NOT stale),
touched AS (SELECT src AS key FROM sem WHERE coalesce(author, '') <> 'community-detection' UNION SELECT dst FROM sem WHERE coalesce(author, '') <> 'community-detection'),
merged AS (SELECT label, key, e.doc IS NULL AND o.doc IS NULL AS bare, e.key IS NULL AS stale FROM old o FULL JOIN (SELECT *, true AS there FROM extracted) e USING (label, key)
           WHERE e.there OR key IN (SELECT key FROM touched WHERE key IS NOT NULL)),
flags AS (SELECT label, count(*) AS flagged FROM (SELECT DISTINCT n.label, s.rel, s.src, s.dst FROM sem s JOIN (SELECT label, key FROM extracted WHERE (label, key) NOT IN (SELECT (label, key) FROM old)) n ON n.key IN (s.src, s.dst)
          WHERE invalid_at IS NULL AND coalesce(author, '') <> 'community-detection') GROUP BY 1)
SELECT label, stale, count(*) AS n, count(*) FILTER (WHERE bare) AS without_doc, coalesce(any_value(flagged), 0) AS flagged FROM merged LEFT JOIN flags USING (label) GROUP BY 1, 2""".replace("e.key IS NULL AS stale", "e.there IS NULL AS stale"))
def reindex_merge(spark, sf):
    """A graph of the types known before 2025 brought in line with those there now: what is kept, stale and to review."""
    rows = pg.table(spark, sf, "type_nodes").where("created_at < timestamp_ntz'2025-01-01'")
    old = rows.groupBy(F.col("node_label").alias("label"), F.col("node_key").alias("key")).agg(F.max("doc").alias("doc")).select("*", F.lit("static").alias("source"), F.lit(False).alias("stale"))
    found = pg.types(spark, sf).where(graph.live()).select("label", "key", "doc", F.lit("static").alias("source"), F.lit(False).alias("stale"))
    semantic = pg.semantic_edges(spark, sf)
    swept = mutations.sweep(old, found, semantic).where("action <> 'remove'")
    merged = mutations.upsert(swept.withColumn("stale", F.col("action") == "stale").drop("action"), found, ["label", "key"])
    new = found.join(old, ["label", "key"], "left_anti").select("label", "key")
    flagged = mutations.flag_review(semantic, new.select("key"), "source changed").where("needs_review").select("rel", "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("key"))
    flags = flagged.join(new, "key").select("label", "rel", "src", "dst").distinct().groupBy("label").agg(F.count("*").alias("flagged"))
    shape = merged.groupBy("label", "stale").agg(F.count("*").alias("n"), F.count_if(F.col("doc").isNull()).alias("without_doc"))
    return shape.join(flags, "label", "left").select("label", "stale", "n", "without_doc", F.coalesce("flagged", F.lit(0)).alias("flagged"))


_STATUS_SQL = r"""
WITH files AS (SELECT project, snapshot_no, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS path, arg_max(coalesce(lower(content_sha1), ''), loaded_at) AS sha FROM index_files GROUP BY 1, 2, 3),
snaps AS (SELECT project, snapshot_no, max(embedder_id) AS embedder, max(indexed_at) AS indexed_at, row_number() OVER (PARTITION BY project ORDER BY snapshot_no DESC) AS back FROM index_files GROUP BY 1, 2),
new AS (SELECT f.* FROM files f JOIN snaps s USING (project, snapshot_no) WHERE back = 1 AND sha <> ''),
old AS (SELECT f.* FROM files f JOIN snaps s USING (project, snapshot_no) WHERE back = 2 AND sha <> ''),
diff AS (SELECT coalesce(n.project, o.project) AS project, coalesce(n.path, o.path) AS path, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' ELSE 'changed' END AS change
         FROM new n FULL JOIN old o ON n.project = o.project AND n.path = o.path WHERE n.sha IS DISTINCT FROM o.sha)"""


def _last_two(spark, sf):
    """``(project, snapshot_no, embedder, back)`` of each project's last two snapshots."""
    from pyspark.sql import Window

    snaps = pg.table(spark, sf, "index_files").groupBy("project", "snapshot_no").agg(F.max("embedder_id").alias("embedder"))
    return snaps.withColumn("back", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("snapshot_no")))).where("back <= 2")


def _last_diff(spark, sf, last):
    """``(project, path, change)`` between each project's last two snapshots; no others are read further."""
    from ..operators.snapshots import relative_path, snapshot_changes

    rows = pg.table(spark, sf, "index_files").join(last.select("project", "snapshot_no"), ["project", "snapshot_no"], "left_semi")
    files = rows.select("project", "snapshot_no", relative_path(F.col("file_path")).alias("path"), F.lower("content_sha1").alias("sha"), "loaded_at")
    return snapshot_changes(files, key="path", value="sha").select("project", "path", F.col("change_kind").alias("change"))


@_query(_STATUS_SQL + """
, state AS (SELECT project, max(snapshot_no) AS snapshot_no, count(DISTINCT embedder) FILTER (WHERE back <= 2) > 1 AS embedder_changed FROM snaps GROUP BY 1)
SELECT project, any_value(snapshot_no) AS snapshot_no, any_value(embedder_changed) AS embedder_changed, count(change) = 0 AND NOT any_value(embedder_changed) AS fresh, count(*) FILTER (WHERE change = 'added') AS added,
       count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'removed') AS removed
FROM state LEFT JOIN diff USING (project) GROUP BY project""", graph_sql=False)
def status_row(spark, sf):
    """How fresh each project's index is: what changed since the snapshot before the last."""
    last = Scratch(spark, "last_two").write(_last_two(spark, sf))
    state = last.groupBy("project").agg(F.max("snapshot_no").alias("snapshot_no"), (F.countDistinct("embedder") > 1).alias("embedder_changed"))
    counts = _last_diff(spark, sf, last).groupBy("project").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")))
    joined = state.join(counts, "project", "left").na.fill(0, ["added", "changed", "removed"])
    return joined.select("project", "snapshot_no", "embedder_changed", ((F.col("added") + F.col("changed") + F.col("removed") == 0) & ~F.col("embedder_changed")).alias("fresh"), "added", "changed", "removed")


@_query("""
, moved AS (SELECT e.dst AS key FROM static_edges e JOIN nodes n ON e.src = n.key WHERE e.rel = 'SCRIPT_OF' AND n.stale)
SELECT rel, src, dst FROM sem WHERE invalid_at IS NULL AND coalesce(author, '') <> 'community-detection' AND (src IN (SELECT key FROM moved) OR dst IN (SELECT key FROM moved))""")
def stale_propagation(spark, sf):
    """Live semantic edges to review because an asset with an end's type as script is gone."""
    gone = pg.nodes(spark, sf).where("stale").select(F.col("key").alias("src"))
    changed = pg.static_edges(spark, sf).where("rel = 'SCRIPT_OF'").join(gone, "src", "left_semi").select(F.col("dst").alias("key"))
    flagged = mutations.flag_review(pg.semantic_edges(spark, sf), changed, "asset removed")
    return flagged.where("needs_review").select("rel", "src", "dst")


@_query("SELECT rel, src, dst, confidence, author, record_id FROM sem WHERE invalid_at IS NULL")
def semantic_list(spark, sf):
    """All live semantic edges."""
    return pg.semantic_edges(spark, sf).where("invalid_at is null").select("rel", "src", "dst", "confidence", "author", "record_id")


@_query("SELECT rel, src, dst, confidence FROM sem WHERE invalid_at IS NULL AND coalesce(author, '') <> 'community-detection' AND confidence < 0.5 ORDER BY confidence, rel, src, dst LIMIT 100")
def low_confidence(spark, sf):
    """The hundred live edges by hand of the least confidence below a half."""
    rows = pg.semantic_edges(spark, sf).where("invalid_at is null and confidence < 0.5D").where(F.coalesce("author", F.lit("")) != "community-detection")
    return rows.orderBy("confidence", "rel", "src", "dst").limit(100).select("rel", "src", "dst", "confidence")


@_query("""
, stale AS (SELECT DISTINCT key FROM nodes WHERE stale)
SELECT rel, src, dst, confidence, 'endpoint stale' AS reason FROM sem WHERE invalid_at IS NULL AND (src IN (SELECT key FROM stale) OR dst IN (SELECT key FROM stale))""")
def review_queue(spark, sf):
    """Live semantic edges with an end that is gone."""
    rows = pg.semantic_edges(spark, sf).withColumn("needs_review", F.lit(False)).withColumn("review_reason", F.lit(None).cast("string"))
    return mutations.review_queue(rows, pg.nodes(spark, sf))


@_query("""
, fresh AS (SELECT src, dst, min(valid_from) AS at FROM sem WHERE record_id % 100 = 0 GROUP BY 1, 2)
SELECT s.rel, s.src, s.dst, CASE WHEN s.record_id % 100 <> 0 THEN coalesce(s.invalid_at, f.at) ELSE s.invalid_at END AS invalid_at FROM sem s LEFT JOIN fresh f USING (src, dst)""")
def supersede(spark, sf):
    """Every hundredth semantic edge as newly added: it ends the live edges between the same ends."""
    rows = pg.semantic_edges(spark, sf)
    return mutations.supersede(rows.where("record_id % 100 <> 0"), rows.where("record_id % 100 = 0")).select("rel", "src", "dst", "invalid_at")


@_query("""
SELECT author, count(*) AS edges, count(*) FILTER (WHERE confidence < 0.4 AND confidence >= 0.3) AS confirmed, count(*) FILTER (WHERE confidence < 0.3) AS to_review FROM sem WHERE invalid_at IS NULL GROUP BY 1""")
def confirm(spark, sf):
    """Edges below 0.4 flagged for review, those from 0.3 on confirmed, counted by author."""
    rows = pg.semantic_edges(spark, sf).where("invalid_at is null")
    flagged = rows.withColumn("needs_review", F.coalesce(F.col("confidence") < F.lit(0.4), F.lit(False))).withColumn("review_reason", F.lit("low confidence"))
    done = mutations.confirm(flagged, rows.where("confidence >= 0.3D and confidence < 0.4D"), F.lit("2025-01-01").cast("timestamp"))
    return done.groupBy("author").agg(F.count("*").alias("edges"), F.count_if(F.col("confirmed_at").isNotNull()).alias("confirmed"), F.count_if(F.col("needs_review")).alias("to_review"))


@_query("""
SELECT lower(trim(community_name)) AS name, count(DISTINCT project) AS n, string_agg(DISTINCT project, ', ' ORDER BY project) AS projects
FROM communities WHERE trim(community_name) <> '' GROUP BY 1 HAVING count(DISTINCT project) > 1""", graph_sql=False)
def duplicate_concepts(spark, sf):
    """Community names that several projects use, apart from case."""
    rows = pg.table(spark, sf, "communities").select(F.lower(F.trim("community_name")).alias("name"), "project").where("name <> ''").distinct()
    return rows.where("project is not null").groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("project")), ", ").alias("projects")).where("n > 1")


@_query("""
SELECT key, name, summary FROM (SELECT 'concept:' || community_name AS key, community_name AS name, arg_max(summary, (created_at, community_id)) FILTER (WHERE summary IS NOT NULL) AS summary
FROM communities WHERE community_name IS NOT NULL GROUP BY 2)""", graph_sql=False)
def concept_upsert(spark, sf):
    """Community names as concepts with their last summary."""
    rows = pg.table(spark, sf, "communities").where("community_name is not null")
    delta = rows.select(F.concat(F.lit("concept:"), "community_name").alias("key"), F.col("community_name").alias("name"), "summary", F.struct("created_at", "community_id").alias("seq"))
    return mutations.upsert(delta.where("false").select("key", "name", "summary"), delta, ["key"], order="seq")


@_query("SELECT label, key, name FROM nodes WHERE stale")
def stale_nodes(spark, sf):
    """All nodes that are gone."""
    return pg.nodes(spark, sf).where("stale").select("label", "key", "name")


_MISS_SQL = """
WITH logged AS (SELECT event_type || ' ' || props AS query, CASE WHEN value < 50 THEN 'none' ELSE 'low' END AS tier, ts FROM events WHERE event_type = 'error'),
misses AS (SELECT lower(trim(query)) AS key, arg_max(query, (ts, tier, query)) AS query, count(*) AS n, arg_max(tier, (ts, tier, query)) AS tier, max(ts) AS last_seen, min(ts) AS first_seen FROM logged GROUP BY 1)"""


def _misses(spark, sf):
    rows = pg.table(spark, sf, "events").where("event_type = 'error'")
    return rows.select(F.concat_ws(" ", "event_type", "props").alias("query"), F.when(F.col("value") < 50, "none").otherwise("low").alias("tier"), F.col("ts").alias("seen_at"))


@_query(_MISS_SQL + " SELECT * FROM misses", graph_sql=False)
def miss_log_counts(spark, sf):
    """Error events as searches that weren't answered, counted."""
    return mutations.miss_counts(_misses(spark, sf))


@_query(_MISS_SQL + " SELECT query, n, tier, last_seen FROM misses ORDER BY n DESC, key LIMIT 15", graph_sql=False)
def missed_queries(spark, sf):
    """The fifteen most frequent of them."""
    return mutations.miss_counts(_misses(spark, sf)).orderBy(F.desc("n"), "key").limit(15).select("query", "n", "tier", "last_seen")


@_query("""
, stale AS (SELECT DISTINCT key FROM nodes WHERE stale)
SELECT (SELECT count(*) FROM sem WHERE invalid_at IS NULL AND (src IN (SELECT key FROM stale) OR dst IN (SELECT key FROM stale))) AS review,
       (SELECT count(*) FROM sem WHERE invalid_at IS NULL AND coalesce(author, '') <> 'community-detection' AND confidence < 0.5) AS low_confidence,
       (SELECT count(*) FROM nodes WHERE stale) AS stale,
       (SELECT count(*) FROM (SELECT lower(name) FROM nodes WHERE label = 'Concept' GROUP BY 1 HAVING count(*) > 1)) AS duplicates""")
def reflect_summary(spark, sf):
    """How much there is to curate, in one row."""
    nodes, rows = pg.nodes(spark, sf), pg.semantic_edges(spark, sf)
    low = rows.where("invalid_at is null and confidence < 0.5D").where(F.coalesce("author", F.lit("")) != "community-detection")
    twice = nodes.where("label = 'Concept'").groupBy(F.lower("name")).count().where("count > 1")
    one = review_queue(spark, sf).agg(F.count("*").alias("review"))
    for name, frame in (("low_confidence", low), ("stale", nodes.where("stale")), ("duplicates", twice)):
        one = one.crossJoin(frame.agg(F.count("*").alias(name)))  # one row each
    return one


@_query(_MISS_SQL.replace("WITH logged", ", logged") + """
, ends AS (SELECT src AS key FROM static_edges UNION SELECT dst FROM static_edges),
covered AS (SELECT src AS key FROM sem WHERE coalesce(author, '') <> 'community-detection' UNION SELECT dst FROM sem WHERE coalesce(author, '') <> 'community-detection')
SELECT (SELECT count(*) FROM misses) AS missed, (SELECT count(*) FROM types WHERE NOT stale AND key IN (SELECT key FROM ends) AND key NOT IN (SELECT key FROM covered WHERE key IS NOT NULL)) AS uncovered""")
def gaps_summary(spark, sf):
    """Where curation is missing, in one row: unanswered searches and types without meaning."""
    missed = mutations.miss_counts(_misses(spark, sf)).agg(F.count("*").alias("missed"))
    return missed.crossJoin(graph.uncovered_hubs(pg.nodes(spark, sf), pg.edges(spark, sf), None).agg(F.count("*").alias("uncovered")))  # one row each


@_query("""
WITH cost AS (SELECT user_id, event_type, value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1.25 WHEN 'error' THEN 0.1 ELSE 5 END AS cost, value, ts FROM events)
SELECT coalesce(user_id, -1) AS user_id, round(sum(cost), 4) AS weighted, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS view_sum, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS purchase_sum,
       count(*) AS n, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS span_s
FROM cost GROUP BY ROLLUP (user_id)""", graph_sql=False)
def cost_tally(spark, sf):
    """Weighted sums per user with a total row (user -1)."""
    rows = pg.table(spark, sf, "events").withColumn("cost", F.col("value") * F.expr("case event_type when 'view' then 1D when 'click' then 1.25D when 'error' then 0.1D else 5D end"))
    part = lambda kind: F.round(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), 4)
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000
    return rows.rollup("user_id").agg(
        F.round(F.sum("cost"), 4).alias("weighted"), part("view").alias("view_sum"), part("purchase").alias("purchase_sum"), F.count("*").alias("n"), F.floor(span).alias("span_s")
    ).withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


@_query("SELECT n.label, e.rel, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.key GROUP BY ALL")
def raw_sql(spark, sf):
    """A free SQL statement over the views nodes and edges."""
    from .session import run_sql

    return run_sql(spark, {"nodes": pg.nodes(spark, sf), "edges": pg.edges(spark, sf)}, "SELECT n.label, e.rel, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.key GROUP BY n.label, e.rel")
