"""One object with a method for each thing a user asks of a graph kept in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.embedding import EMBEDDER, hash_vectors
from ..operators import graph, mutations, search
from ..operators.extraction import project_graph
from ..sources import project_files as sources
from .runtime import Scratch
from .store import Store

#: Relations that people may state. Fixed values of the graph's model.
SEMANTIC_RELATIONS = ("RELATES_TO", "PART_OF", "RESPONSIBLE_FOR", "COLLABORATES_WITH")
#: Labels of nodes that have vectors. Fixed values of the graph's model.
EMBEDDED = ("Class", "Interface", "Struct", "Enum", "Method", "Concept")
#: Relations between types from which communities are found. Fixed values of the graph's model.
STRUCTURAL = ("REFERENCES", "INHERITS", "IMPLEMENTS", "CALLS", "USES_COMPONENT")

#: ``(key, text)`` to ``(key, vector)``.
Embedder = Callable[[DataFrame], DataFrame]


def _reads_only(spark: SparkSession, statement: str) -> bool:
    """Whether the parsed statement only reads: no command in it but those that show and describe."""
    jvm = spark.sparkContext._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{x}") for x in ("Command", "ParsedStatement")]

    def reads(plan) -> bool:
        name = plan.getClass().getSimpleName()
        if name.startswith(("Show", "Describe", "Explain")):
            return True
        if any(kind.isInstance(plan) for kind in kinds):
            return False
        children = plan.children()
        return all(reads(children.apply(i)) for i in range(children.size()))

    return reads(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))


def run_sql(spark: SparkSession, views: dict[str, DataFrame], statement: str, args: dict | None = None, write: bool = False) -> DataFrame:
    """A SQL statement over temporary views. Without ``write`` only reading statements are taken."""
    if not write and not _reads_only(spark, statement):
        raise ValueError("a reading statement is needed; pass write=True to change tables")
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(statement, args=args or {})


class GraphSession:
    """A graph of nodes and edges in a folder (:class:`.Store`)."""

    NODES = "label string, key string, name string, path string, doc string, source string, stale boolean, signature string, summary string, embed_text string, members long"
    EDGES = (
        "rel string, src string, dst string, source string, author string, confidence double, rationale string, valid_from timestamp, invalid_at timestamp, "
        "needs_review boolean, review_reason string, confirmed_at timestamp, commit_sha string"
    )
    STATE = "path string, sha1 string"
    VECTORS = "key string, embedder string, embed_hash string, vector array<double>"
    MISSES = "id string, query string, tier string, seen_at timestamp"

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder = hash_vectors, embedder_id: str = EMBEDDER, summarize: Callable[[DataFrame], DataFrame] | None = None):
        """``embedder`` makes vectors of texts (a pandas UDF, say); ``summarize`` may rename and describe the communities found (:func:`.community_summaries`)."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.embedder, self.embedder_id, self.summarize = embedder, embedder_id, summarize
        schemas = {"nodes": self.NODES, "edges": self.EDGES, "state": self.STATE, "vectors": self.VECTORS, "misses": self.MISSES}
        keys = {"nodes": ["label", "key"], "edges": ["source", "rel", "src", "dst", "valid_from"], "state": ["path"], "vectors": ["key", "embedder"], "misses": ["id"]}
        self.store = Store(spark, folder, schemas, keys)

    # --- what is kept

    def versions(self) -> list[int]:
        return self.store.versions()

    def save(self, **tables: DataFrame) -> int:
        """Write tables as the next snapshot, the others as they are."""
        fitted = {}
        for name, frame in tables.items():
            kind = StructType.fromDDL(self.store.schemas[name])
            fitted[name] = frame.select(*(F.col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind))
        return self.store.save(**fitted)

    @property
    def nodes(self) -> DataFrame:
        return self.store.load("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.load("edges")

    def _terms(self, *terms: str) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in terms], "term string")

    def _keys(self, term: str) -> DataFrame:
        return graph.find(self.nodes, self._terms(term)).select("key")

    def _named(self, edges: DataFrame) -> DataFrame:
        """Edges with the names of their ends."""
        names = self.nodes.groupBy("key").agg(F.min("name").alias("name"))
        return edges.join(names.select(F.col("key").alias("src"), F.col("name").alias("from")), "src").join(names.select(F.col("key").alias("dst"), F.col("name").alias("to")), "dst")

    # --- indexing

    def index(self, project: str, now: str, manifest: str | None = None, communities: bool = True, force: bool = False) -> dict:
        """Bring the graph in line with a project tree; what people stated stays.

        Nothing is done if no file, nor the manifest, nor the embedder has
        changed since the last time, unless ``force``.  Nodes that are no longer
        found go, or become stale where a semantic edge by hand touches them.
        Live semantic edges by hand at types of changed files are flagged for
        review.  Without ``manifest`` the project's own is taken if it is not
        older than its files.
        """
        scratch, seen = Scratch(self.spark, "index"), self.store.seen()
        held = {name: self.store.load(name, seen[name]) for name in self.store.schemas}
        files = scratch.write(sources.project_files(self.spark, project))
        manifest = manifest or sources.discovered_manifest(self.spark, project, files)
        state = scratch.write(sources.index_state(files, sources.file_hash(self.spark, manifest) if manifest else None))
        known = bool(self.versions()) and not held["state"].isEmpty()
        changes = scratch.write(sources.state_diff(state, held["state"] if known else None))
        moved = not held["vectors"].where(F.col("embedder") != self.embedder_id).isEmpty()
        n_changed = changes.count()
        if known and not force and not n_changed and not moved:
            return {"up_to_date": True, "version": self.versions()[-1]}

        found, static = project_graph(files, sources.manifest(self.spark, manifest) if manifest else None)
        found = found.select("label", "key", "name", "path", "doc", "signature", "embed_text", F.lit("static").alias("source"), F.lit(False).alias("stale"))
        semantic = held["edges"].where("source = 'semantic'")
        swept = scratch.write(mutations.sweep(held["nodes"], found, semantic))
        kept = swept.where("action <> 'remove'").withColumn("stale", F.when(F.col("action") == "stale", True).otherwise(F.col("stale"))).drop("action")
        nodes = mutations.upsert(kept, found, ["label", "key"])
        if known:
            changed = changes.where("change <> 'removed'").select("path")
            keys = found.where(F.col("label").isin(*graph.TYPE_LABELS)).join(changed, "path", "left_semi").select("key")
            semantic = mutations.flag_review(semantic, keys, "source changed")
        edges = semantic.unionByName(static.withColumn("source", F.lit("static")), allowMissingColumns=True)
        nodes, edges = scratch.write(nodes), scratch.write(edges)
        if communities:
            nodes, edges = (scratch.write(x) for x in self._with_communities(nodes, edges))
        edges = mutations.held_edges(edges, nodes)
        vectors, embedded = self._embedded(nodes, held["vectors"])
        version = self.store.save(seen, **self._fitted(nodes=nodes, edges=edges, state=state, vectors=vectors, misses=held["misses"]))
        actions = {r.action: r["count"] for r in swept.groupBy("action").count().collect()}  # three rows at most
        flagged = self.edges.where("needs_review and review_reason = 'source changed'").count()
        return {"version": version, "changed": n_changed, "removed": actions.get("remove", 0), "stale": actions.get("stale", 0), "embedded": embedded, "flagged": flagged}

    def _fitted(self, **tables: DataFrame) -> dict[str, DataFrame]:
        kinds = {name: StructType.fromDDL(self.store.schemas[name]) for name in tables}
        return {name: frame.select(*(F.col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds[name])) for name, frame in tables.items()}

    def _with_communities(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with the communities of types found anew, as concepts that their members are part of."""
        types = nodes.where(F.col("label").isin(*graph.TYPE_LABELS) & graph.live()).select("key", "name")
        links = edges.where(F.col("rel").isin(*STRUCTURAL)).select("src", "dst")
        member = Scratch(self.spark, "members").write(graph.label_propagation(types, links))
        described = graph.community_summaries(member, types, links)
        described = (self.summarize or (lambda x: x))(described)
        auto = F.col("key").startswith("community:")
        concepts = described.select(
            F.lit("Concept").alias("label"), "key", "name", F.col("listed").alias("summary"), F.concat_ws(". ", "name", "listed").alias("embed_text"), "members",
            F.lit("semantic").alias("source"), F.lit(False).alias("stale"),
        )
        nodes = nodes.where(~auto).unionByName(concepts, allowMissingColumns=True)
        first = member.groupBy("community").agg(F.concat(F.lit("community:"), F.min("key")).alias("dst"))
        parts = member.join(first, "community").select(F.lit("PART_OF").alias("rel"), F.col("key").alias("src"), "dst", F.lit("semantic").alias("source"), F.lit(mutations.DETECTED).alias("author"))
        kept = edges.where(~F.col("dst").startswith("community:") | (F.col("source") != "semantic") | mutations.by_hand())
        return nodes, kept.unionByName(parts, allowMissingColumns=True)

    def _embedded(self, nodes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, int]:
        """The vectors of all texts, of which only those not yet embedded, by this embedder, are embedded, and how many those are."""
        texts = nodes.where(F.col("label").isin(*EMBEDDED) & F.col("embed_text").isNotNull()).select("key", "embed_text")
        kept, fresh = search.cached_vectors(texts, vectors, self.embedder_id)
        fresh = Scratch(self.spark, "fresh").write(fresh)
        new = self.embedder(fresh.select("key", F.col("embed_text").alias("text"))).join(fresh.select("key", "embed_hash"), "key")
        return kept.unionByName(new.select("key", F.lit(self.embedder_id).alias("embedder"), "embed_hash", "vector")), fresh.count()

    def community(self) -> int:
        """Find the communities anew and save; how many there are."""
        seen = self.store.seen()
        scratch = Scratch(self.spark, "community")
        nodes, edges = (scratch.write(x) for x in self._with_communities(self.store.load("nodes", seen["nodes"]), self.store.load("edges", seen["edges"])))
        edges = mutations.held_edges(edges, nodes)
        vectors, _ = self._embedded(nodes, self.store.load("vectors", seen["vectors"]))
        self.store.save(seen, **self._fitted(nodes=nodes, edges=edges, vectors=vectors))
        return nodes.where("key like 'community:%'").count()

    def status(self, project: str, manifest: str | None = None) -> dict:
        """What an index run would find changed, as lists of paths, and how much there is to review."""
        files = sources.project_files(self.spark, project)
        manifest = manifest or sources.discovered_manifest(self.spark, project, files)
        state = sources.index_state(files, sources.file_hash(self.spark, manifest) if manifest else None)
        indexed = bool(self.versions())
        changes = Scratch(self.spark, "status").write(sources.state_diff(state, self.store.load("state") if indexed else None))
        counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}  # three rows at most
        lists = {kind: [r.path for r in changes.where(F.col("change") == kind).orderBy("path").limit(200).collect()] for kind in ("added", "changed", "removed")}
        moved = not self.store.load("vectors").where(F.col("embedder") != self.embedder_id).isEmpty()
        hint = "index" if not indexed or counts or moved else "fresh"
        return {"indexed": indexed, "embedder_changed": moved, "needs_review": self.review_queue().count(), "counts": counts, **lists, "hint": hint}

    # --- questions

    def find(self, term: str) -> DataFrame:
        return graph.find(self.nodes, self._terms(term)).drop("term").orderBy("label", "key").limit(100)

    def neighbors(self, term: str) -> DataFrame:
        found = graph.neighbors(self.edges, self._keys(term), self.nodes).drop("seed")
        return found.orderBy(F.col("source").asc_nulls_last(), "rel", "dir", "label", "key").limit(200)

    def deps(self, term: str) -> DataFrame:
        """What the assets of a path, guid or name directly depend on."""
        return graph.dependencies(self.edges, self._terms(term), self.nodes).drop("term", "guid").orderBy("rel", "label", "key").limit(200)

    def impact(self, term: str, depth: int = 4) -> DataFrame:
        found = graph.impact(self.edges, self._keys(term), depth).join(self.nodes, "key")
        return found.select("label", "name", "key", F.coalesce("stale", F.lit(False)).alias("stale"), "hops").orderBy("hops", "label", "key").limit(300)

    def basis(self, a: str, b: str, hops: int = 3) -> int | None:
        """Least static steps between two nodes (the first by label and key for each term), or None."""
        ends = [graph.find(self.nodes, self._terms(t)).orderBy("label", "key").limit(1).select(F.col("key").alias(c)) for t, c in ((a, "a"), (b, "b"))]
        row = graph.structural_basis(self.edges, ends[0].crossJoin(ends[1]), hops).first()  # one row each
        return row.hops if row else None

    def candidates(self, text: str, k: int = 10, labels: tuple[str, ...] = ()) -> DataFrame:
        return search.candidates(self.nodes, [text], k, labels).drop("query").orderBy(F.desc("score"), "label", "key")

    def ask(self, text: str, now: str, k: int = 10, labels: tuple[str, ...] = ()) -> tuple[dict, DataFrame]:
        """How far a search text is answered, and its candidates; what isn't answered with confidence is noted as a miss."""
        found = search.candidates(self.nodes, [text], k, labels)
        tier = search.confidence_tiers(found, self._terms(text).select(F.col("term").alias("query"))).first().asDict()
        if not tier["hit"] and text.strip():
            miss = self.spark.createDataFrame([(uuid.uuid4().hex, text, tier["tier"])], "id string, query string, tier string")
            self.store.add("misses", miss.withColumn("seen_at", F.lit(now).cast("timestamp")))
        return tier, found.drop("query").orderBy(F.desc("score"), "label", "key")

    def search(self, text: str, k: int = 10, labels: tuple[str, ...] = ()) -> DataFrame:
        """The nodes nearest to a text by its vector: of each label the nearest, of these the nearest of all; stale nodes are left out."""
        asked = self.embedder(self.spark.createDataFrame([("0", text)], "key string, text string"))
        queries = asked.select(F.lit(0).cast("long").alias("query_id"), "vector")
        vectors = self.store.load("vectors").where(F.col("embedder") == self.embedder_id)
        return search.search_nodes(queries, vectors, self.nodes, k, labels).drop("query_id").orderBy("distance", "label", "key")

    def query(self, statement: str, args: dict | None = None, write: bool = False) -> DataFrame:
        return run_sql(self.spark, {"nodes": self.nodes, "edges": self.edges}, statement, args, write)

    # --- what people state

    def _first(self, term: str):
        found = graph.find(self.nodes, self._terms(term)).orderBy("label", "key").first()
        if found is None:
            raise ValueError(f"no node is called {term}")
        return found

    def add_semantic(
        self, rel: str, a: str, b: str, now: str, confidence: float | None = None, why: str | None = None, author: str = "human", supersede: bool = False, require_basis: bool = False, commit: str | None = None, basis_hops: int = 3
    ) -> None:
        """Add one semantic edge; with ``require_basis`` types must be statically connected, concepts are exempt.

        A live edge of the same relation between the two ends when this one
        starts, with ``supersede`` every live one does.
        """
        rel = rel.upper()
        if rel not in SEMANTIC_RELATIONS:
            raise ValueError(f"{rel} is none of {', '.join(SEMANTIC_RELATIONS)}")
        x, y = self._first(a), self._first(b)
        if require_basis and "Concept" not in (x.label, y.label) and self.basis(a, b, basis_hops) is None:
            raise ValueError("there is no static connection between the two")
        start = F.lit(now).cast("timestamp")
        old = self.edges.where("source = 'semantic' and invalid_at is null").where((F.col("src") == x.key) & (F.col("dst") == y.key))
        ended = (old if supersede else old.where(F.col("rel") == rel)).withColumn("invalid_at", start)
        given = self.spark.createDataFrame([(rel, x.key, y.key, "semantic", author, confidence, why, commit)], "rel string, src string, dst string, source string, author string, confidence double, rationale string, commit_sha string")
        self.store.add("edges", ended.where(F.col("valid_from").isNull() | (F.col("valid_from") != start) | (F.col("rel") != rel)).unionByName(given.withColumn("valid_from", start), allowMissingColumns=True))

    def curate(self, path: str, now: str, author: str = "curation") -> None:
        """State all concepts and edges of a curation file."""
        given = sources.curation(self.spark, path)
        for row in given["concepts"].toLocalIterator():
            self.add_concept(row.name, row.summary)
        for row in given["edges"].toLocalIterator():
            self.add_semantic(row.rel, row["from"], row.to, now, row.confidence, row.why, author)

    def delete(self) -> None:
        """Remove the graph with all its snapshots."""
        self.store.delete()

    def add_concept(self, name: str, summary: str | None = None) -> str:
        """Add or describe a concept; its key. It can be searched for at once."""
        key = f"concept:{name}"
        row = self.spark.createDataFrame([("Concept", key, name, summary or None)], "label string, key string, name string, summary string")
        old = self.nodes.where((F.col("label") == "Concept") & (F.col("key") == key)).select("key", F.col("summary").alias("old"))
        row = row.join(old, "key", "left").withColumn("summary", F.coalesce("summary", "old")).drop("old")
        row = row.select("*", F.concat_ws(". ", "name", "summary").alias("embed_text"), F.lit("semantic").alias("source"), F.lit(False).alias("stale"))
        self.store.add("nodes", row)
        fresh = row.select("key", F.col("embed_text").alias("text"))
        self.store.add("vectors", self.embedder(fresh).join(fresh, "key").select("key", F.lit(self.embedder_id).alias("embedder"), F.sha1("text").alias("embed_hash"), "vector"))
        return key

    def semantic(self, ended: bool = False) -> DataFrame:
        """The semantic edges with the names of their ends, the most confident first."""
        rows = self.edges.where("source = 'semantic'")
        rows = rows if ended else rows.where("invalid_at is null")
        return self._named(rows).select("rel", "from", "to", "confidence", "rationale", "author", "valid_from", "invalid_at").orderBy(F.col("confidence").desc_nulls_first(), "rel", "from", "to")

    def review_queue(self) -> DataFrame:
        return self._named(mutations.review_queue(self.edges, self.nodes)).select("rel", "from", "to", "confidence", "reason").orderBy("rel", "from", "to")

    def confirm(self, rel: str, a: str, b: str, now: str) -> int:
        """Take the review flag off an edge; how many edges that are."""
        here = (F.col("source") == "semantic") & (F.col("rel") == rel.upper())
        ends = self._keys(a).select(F.col("key").alias("src")), self._keys(b).select(F.col("key").alias("dst"))
        rows = self.edges.where(here).join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi")
        rows = Scratch(self.spark, "confirmed").write(rows.select("rel", "src", "dst", *(c for c in rows.columns if c not in ("rel", "src", "dst"))))
        self.store.add("edges", mutations.confirm(rows, rows, F.lit(now).cast("timestamp")))
        return rows.count()

    # --- what there is to do

    def uncurated(self, excludes: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
        return graph.uncurated_communities(self.nodes, excludes).orderBy(F.desc("members"), "key").limit(limit)

    def reflect(self, least: float = 0.5) -> dict[str, DataFrame]:
        """Lists of what to look after: edges to review, of low confidence, stale nodes, concepts of one name, communities without a name by hand."""
        low = self._named(mutations.low_confidence(self.edges, least)).select("rel", "from", "to", "confidence").orderBy("confidence", "rel", "from", "to").limit(100)
        return {
            "needs_review": self.review_queue(), "low_confidence": low,
            "stale_nodes": self.nodes.where("stale").select("label", "name", "key").orderBy("label", "key").limit(100),
            "duplicate_concepts": graph.duplicate_concepts(self.nodes).orderBy("name"), "uncurated_communities": self.uncurated(),
        }

    def gaps(self, limit: int = 15, excludes: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """Lists of where meaning is missing: searches without an answer, types in the middle of things, communities without a name by hand."""
        missed = mutations.miss_counts(self.store.load("misses")).orderBy(F.desc("n"), "key").limit(min(max(limit, 1), 200)).select("query", "n", "tier", "last_seen")
        return {"missed_queries": missed, "uncovered_hubs": graph.uncovered_hubs(self.nodes, self.edges, limit, excludes), "uncurated_communities": self.uncurated(excludes)}
