"""Lookups, traversals, search, mutations, sessions and streams on small graphs."""

import json
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.__main__ import main
from weftgraph.functions.embedding import fnv1a, sparse_embedding
from weftgraph.functions.text import doc_summary, file_stem, head_word, query_tokens
from weftgraph.operators import graph, mutations, search
from weftgraph.plans.evaluation import rejections, scorecard
from weftgraph.plans.session import GraphSession, run_sql
from weftgraph.streaming import watch

from .conftest import rows_of
from .test_extraction import SHARED, write_tree

NODES = GraphSession.NODES
EDGES = GraphSession.EDGES


def node(label, key, name=None, stale=False, doc=None, source="static"):
    return (label, key, name or key, None, doc, source, stale, None, None, None, None)


def edge(rel, src, dst, source="static", author=None, confidence=None, invalid=None):
    return (rel, src, dst, source, author, confidence, None, None, invalid, None, None, None, None)


@pytest.fixture(scope="module")
def nodes(spark):
    trees = ["alder", "birch", "cedar", "dune", "elm", "fen"]
    rows = [node("Class", k) for k in trees] + [node("Class", "Glen.alder", "alder"), node("Class", "bog", stale=True), node("Concept", "concept:woods", "woods", source="semantic")]
    return spark.createDataFrame(rows, NODES).cache()


@pytest.fixture(scope="module")
def edges(spark):
    ways = ["alder>birch", "cedar>birch", "birch>dune", "dune>alder", "cedar>elm", "elm>elm"]
    rows = [edge("REFERENCES", *way.split(">")) for way in ways] + [edge("IN_NAMESPACE", "alder", "fen"), edge("PART_OF", "birch", "concept:woods", "semantic", "ann", 0.9)]
    rows += [edge("RELATES_TO", "bog", "dune", "semantic", "bo", 0.2), edge("RELATES_TO", "dune", "elm", "semantic", "bo", 0.3, datetime(2024, 1, 1))]
    return spark.createDataFrame(rows, EDGES).cache()


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_find_by_name_or_key(spark, nodes):
    terms = spark.createDataFrame([("alder",), ("Glen.alder",), ("alder",), (None,), ("nobody",)], "term string")
    assert rows_of(graph.find(nodes, terms), "term", "key") == [("Glen.alder", "Glen.alder"), ("alder", "Glen.alder"), ("alder", "alder")]


def test_neighbors_show_both_directions_and_ended_edges(spark, nodes, edges):
    found = rows_of(graph.neighbors(edges, keys(spark, "dune", "elm"), nodes), "seed", "rel", "dir", "key")
    assert ("dune", "RELATES_TO", "out", "elm") in found and ("elm", "RELATES_TO", "in", "dune") in found
    assert [r for r in found if r[0] == r[3]] == [("elm", "REFERENCES", "in", "elm"), ("elm", "REFERENCES", "out", "elm")]
    assert ("elm", "RELATES_TO", "in", "dune") not in rows_of(graph.neighbors(edges, keys(spark, "elm"), nodes, live_only=True), "seed", "rel", "dir", "key")


def test_impact_follows_circles_and_leaves_out_namespaces(spark, edges):
    assert rows_of(graph.impact(edges, keys(spark, "alder"), 9)) == [("alder", "birch", 2), ("alder", "cedar", 3), ("alder", "dune", 1)]
    assert rows_of(graph.impact(edges, keys(spark, "alder"), 0)) == [("alder", "dune", 1)]


def test_dependencies_by_path_guid_or_name(spark):
    nodes = spark.createDataFrame([("Asset", "g1", "boat", "Art/boat.prefab"), ("Asset", "g2", "sail", "Art/sail.mat"), ("Class", "N.Hull", "boat", None)], "label string, key string, name string, path string")
    edges = spark.createDataFrame([("DEPENDS_ON", "g1", "g2"), ("SCRIPT_OF", "g1", "N.Hull"), ("HAS_ENTRY", "g1", "g2"), ("REFERENCES", "N.Hull", "g2")], "rel string, src string, dst string")
    terms = spark.createDataFrame([("boat",), ("g1",), ("Art/boat.prefab",), ("sail",), (None,)], "term string")
    found = rows_of(graph.dependencies(edges, terms, nodes), "term", "rel", "key")
    assert found == sorted(((t, *x) for t in ("boat", "g1", "Art/boat.prefab") for x in (("DEPENDS_ON", "g2"), ("SCRIPT_OF", "N.Hull"))), key=repr)


def test_uncovered_hubs(nodes, edges):
    assert rows_of(graph.uncovered_hubs(nodes, edges, 10), "key", "deg") == [("alder", 3), ("cedar", 2), ("fen", 1)]
    assert rows_of(graph.uncovered_hubs(nodes, edges, 0, excludes=("alder",)), "key") == [("cedar",)]


def test_communities_and_their_names(spark, nodes):
    links = spark.createDataFrame([w.split(">") for w in ("alder>birch", "birch>cedar", "alder>cedar", "cedar>alder", "dune>elm", "fen>fen", "elm>gone")], "src string, dst string")
    member = graph.label_propagation(nodes, links)
    assert rows_of(member) == [("alder", "alder"), ("birch", "alder"), ("cedar", "alder"), ("dune", "dune"), ("elm", "dune")]
    names = spark.createDataFrame([("alder", "TideTable"), ("birch", "TideClock"), ("cedar", "Tide"), ("dune", "Ox"), ("elm", "Oxen")], "key string, name string")
    found = rows_of(graph.community_summaries(member, names, links))
    assert found == [("community:alder", 3, 4, "Tide group", "Tide, TideClock, TideTable"), ("community:dune", 2, 1, "Ox/Oxen", "Ox, Oxen")]


def test_lists_of_communities_and_concepts(spark):
    rows = [("Concept", "community:a", "Tide group", "Tide, Tides", 2), ("Concept", "community:b", "Ox/Oxen", None, 5), ("Concept", "concept:tide", "tide", None, None), ("Concept", "concept:Tide", "Tide", None, None), ("Class", "Tide", "tide", None, None)]
    nodes = spark.createDataFrame(rows, "label string, key string, name string, summary string, members long")
    assert rows_of(graph.uncurated_communities(nodes), "name", "members") == [("Ox/Oxen", 5), ("Tide group", 2)]
    assert rows_of(graph.uncurated_communities(nodes, ("Tides",)), "name") == [("Ox/Oxen",)]
    assert rows_of(graph.duplicate_concepts(nodes)) == [("tide", 2, ["concept:Tide", "concept:tide"])]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(query_tokens(F.lit("findTheTideHP x 物理Camera"))) == ["find", "the", "tide", "hp", "物理camera"]
    assert one(query_tokens(F.lit(" ? "))) == ["?"] and one(query_tokens(F.lit("  "))) == []
    assert one(doc_summary(F.lit("/// <summary> a <b>b</b>\n///  c </summary>"))) == "a b c"
    assert one(head_word(F.lit("TideClock"))) == "Tide" and one(file_stem(F.lit("a/b/c.cs.meta"))) == "c.cs"
    assert one(fnv1a(F.lit("a"))) == 0xE40C292C


def test_hash_embedding_has_length_one_and_keeps_similarity(spark):
    rows = spark.createDataFrame([(1, "TideClock"), (2, "tide clock"), (3, "weather"), (4, None), (5, "?!")], "id int, text string")
    vectors = {}
    for r in sparse_embedding(rows, ["id"], "text", 64).collect():
        vectors.setdefault(r.id, np.zeros(64))[r.dim] = r.weight
    assert set(vectors) == {1, 2, 3} and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in vectors.values())
    assert vectors[1] @ vectors[2] > vectors[1] @ vectors[3]


def test_candidates_score_and_tiers(spark):
    rows = spark.createDataFrame([node("Class", "N.FireBall", "FireBall"), node("Class", "N.Ball", "Ball", doc="a fire toy"), node("Asset", "g", "Fireplace"), node("Class", "S", "Fire", stale=True)], NODES)
    found = search.candidates(rows, ["fire ball", "ball", "zzz"], 2)
    assert rows_of(found, "query", "key", "score") == [("ball", "N.Ball", 2.75), ("ball", "N.FireBall", 1.5), ("fire ball", "N.Ball", 1.0), ("fire ball", "N.FireBall", 1.0)]
    assert rows_of(search.candidates(rows, ["fire"], 5, ("asset",)), "key") == [("g",)] and search.candidates(rows, ["fire"], 5, ("nolabel",)).count() == 3
    tiers = search.confidence_tiers(found, spark.createDataFrame([("ball",), ("zzz",), ("火",)], "query string"))
    assert rows_of(tiers, "query", "tier", "retry_english") == [("ball", "high", False), ("zzz", "none", False), ("火", "none", True)]
    with pytest.raises(ValueError):
        search.candidates(rows, [" "])


@pytest.mark.parametrize("block,chunk", [(3, 9), (4096, 8192)])
def test_nearest_equals_brute_force(spark, block, chunk):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=8).astype(float).tolist(), i % 3) for i in range(60)] + [(60, None, 1)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    found = rows_of(search.nearest(rows.where("vec_id % 10 = 0"), rows, 4, block=block, chunk=chunk), "query_id", "vec_id")
    unit = np.array([d[1] for d in data[:60]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = []
    for q in range(0, 60, 10):
        distance = 1 - unit @ unit[q]
        per = [i for lab in range(3) for i in sorted(range(lab, 60, 3), key=lambda i: (distance[i], i))[:4]]
        want += [(q, i) for i in sorted(per, key=lambda i: distance[i])[:4]]
    assert found == sorted(want, key=repr)


def test_scores_of_an_evaluation(spark):
    found = spark.createDataFrame([(1, 10, 0, 0.1), (1, 11, 5, 0.2), (2, 12, 1, 0.1)], "query_id long, vec_id long, label int, distance double")
    gold = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "query_id long, want int")
    assert rows_of(scorecard(found, gold, 5)) == [(5, 3, pytest.approx(1 / 3), pytest.approx(0.166667))]
    tiers = spark.createDataFrame([("a", "high"), ("b", "low")], "query string, tier string")
    expected = spark.createDataFrame([("a", "lexical", False), ("b", "lexical", False), ("c", "lexical", False), ("d", "lexical", True)], "query string, kind string, should_hit boolean")
    assert rows_of(rejections(tiers, expected)) == [("lexical", 1, 1, 3)]


def test_upsert_never_loses_a_value(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "n")], "k int, p string, q string")
    delta = spark.createDataFrame([(1, None, "y", 1, 0), (3, "c", None, 1, 0), (1, "z", None, 2, 0), (None, "m", None, 1, 0)], "k int, p string, q string, o int, extra int")
    assert rows_of(mutations.upsert(old, delta, ["k"], "o")) == [(1, "z", "y"), (2, "b", None), (3, "c", None), (None, "m", "n")]
    assert rows_of(mutations.upsert(old, delta.where("o = 1"), ["k"], "o", replace=True))[0] == (1, None, "y")
    assert rows_of(mutations.upsert(old, delta.where("false"), ["k"])) == rows_of(old)


def test_edges_need_both_ends_and_sweep(spark, nodes, edges):
    given = spark.createDataFrame([("R", "alder", "birch"), ("R", "alder", "birch"), ("R", "alder", "nobody")], "rel string, src string, dst string")
    assert rows_of(mutations.store_edges(given, nodes)) == [("R", "alder", "birch")]
    swept = mutations.sweep(nodes, nodes.where("key in ('alder', 'elm', 'Glen.alder')"), edges.where("source = 'semantic'"))
    want = {"alder": "keep", "elm": "keep", "Glen.alder": "keep", "concept:woods": "keep", "birch": "stale", "dune": "stale", "bog": "stale", "cedar": "remove", "fen": "remove"}
    assert dict(rows_of(swept, "key", "action")) == want


def test_review_flags_and_confirmation(spark, nodes, edges):
    flagged = mutations.flag_review(edges, keys(spark, "alder", "birch"), "changed")
    want = ["IN_NAMESPACE alder fen", "PART_OF birch concept:woods", "REFERENCES alder birch", "REFERENCES birch dune", "REFERENCES cedar birch", "REFERENCES dune alder"]
    assert rows_of(flagged.where("needs_review"), "rel", "src", "dst", "review_reason") == [(*x.split(), "changed") for x in want]
    done = mutations.confirm(flagged, edges.where("rel = 'PART_OF'"), F.lit("2024-05-01").cast("timestamp"))
    assert rows_of(done.where("confirmed_at is not null"), "src", "needs_review") == [("birch", False)] and done.columns == flagged.columns
    assert rows_of(mutations.review_queue(edges, nodes), "src", "dst", "reason") == [("bog", "dune", "endpoint stale")]
    assert rows_of(mutations.low_confidence(edges, 0.5), "src", "dst") == [("bog", "dune")]


def test_session_adds_without_rewriting_and_refuses_what_has_no_basis(spark, nodes, edges, tmp_path):
    session = GraphSession(spark, f"file://{tmp_path}/g")
    assert session.nodes.isEmpty() and session.versions() == []
    assert session.save(nodes=nodes, edges=edges) == 1
    assert session.find("alder").count() == 2 and session.basis("birch", "dune") == 1 and session.basis("cedar", "fen") is None
    assert session.query("SELECT count(*) AS n FROM nodes WHERE key = :k", {"k": "elm"}).first().n == 1
    spark.sql("CREATE OR REPLACE TEMP VIEW readable AS SELECT 1 AS a")
    for statement in ("DROP TABLE nodes", "WITH x AS (SELECT 1 AS a) INSERT INTO readable SELECT * FROM x", "FROM readable INSERT INTO readable SELECT a", "CACHE TABLE readable", "SET a = 1"):
        with pytest.raises(ValueError):
            session.query(statement)
    assert session.query("SHOW TABLES").count() >= 1 and session.query("WITH x AS (SELECT key FROM nodes) SELECT * FROM x").count() == 9
    with pytest.raises(ValueError):
        session.add_semantic("likes", "cedar", "woods", "2024-02-01")
    with pytest.raises(ValueError):
        session.add_semantic("relates_to", "cedar", "fen", "2024-02-01", require_basis=True)
    session.add_semantic("relates_to", "cedar", "woods", "2024-02-01", 0.5, "why", require_basis=True)
    session.add_semantic("relates_to", "cedar", "woods", "2024-02-09", 0.6)  # the first one ends, and is kept
    session.add_semantic("part_of", "cedar", "woods", "2024-03-01", supersede=True)
    found = session.edges.where("src = 'cedar' and dst = 'concept:woods'")
    assert rows_of(found, "rel", "valid_from", "invalid_at") == [("PART_OF", datetime(2024, 3, 1), None), ("RELATES_TO", datetime(2024, 2, 1), datetime(2024, 2, 9)), ("RELATES_TO", datetime(2024, 2, 9), datetime(2024, 3, 1))]
    assert session.versions() == [1] and run_sql(spark, {"one": spark.range(2)}, "SELECT * FROM one").count() == 2


def test_writers_at_one_time_lose_nothing(spark, nodes, edges, tmp_path):
    one, two = (GraphSession(spark, f"file://{tmp_path}/g") for _ in range(2))
    one.save(nodes=nodes, edges=edges)
    seen = two.store.seen()
    held = two.store.load("edges", seen["edges"])
    one.add_semantic("RELATES_TO", "alder", "woods", "2024-02-01")
    two.add_semantic("RELATES_TO", "elm", "woods", "2024-02-01")
    assert two.store.save(seen, edges=held) == 2  # a snapshot of what was there before the two
    assert one.edges.where("dst = 'concept:woods' and rel = 'RELATES_TO'").count() == 2
    assert one.save() == 3 and two.store.seen()["edges"] == [] and two.edges.where("dst = 'concept:woods' and rel = 'RELATES_TO'").count() == 2
    assert one.store._create(f"file://{tmp_path}/g/claims/000009") and not two.store._create(f"file://{tmp_path}/g/claims/000009")


def test_index_keeps_what_people_stated(spark, tmp_path, capsys):
    root = tmp_path / "project"
    project, folder = write_tree(root), f"file://{tmp_path}/graph"

    def run(*arguments):
        assert main([folder, *arguments]) == 0, capsys.readouterr().err
        return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]

    first = run("index", project, "--no-communities")[0]
    assert first["version"] == 1 and first["removed"] == 0 and first["embedded"] >= 18
    assert run("index", project) == [{"up_to_date": True, "version": 1}]
    assert run("concept", "add", "navigation", "--summary", "Where ships go by the moon") == [{"key": "concept:navigation"}]
    run("sem", "add", "responsible_for", "navigation", "Harbor.Tides.Clock", "--confidence", "0.4")
    run("sem", "add", "relates_to", "Loose", "Harbor.Shared.Canvas", "--confidence", "0.9", "--require-basis")
    assert [r["key"] for r in run("search", "ships by the moon", "--k", "1")] == ["concept:navigation"]
    assert run("search", "ships by the moon", "--label", "nolabel") == []
    assert {r["label"] for r in run("search", "clock tides", "--label", "METHOD", "--k", "3")} == {"Method"}

    (root / "Assets/Code/Tides/Clock.cs").write_text((root / "Assets/Code/Tides/Clock.cs").read_text() + "// changed\n")
    for gone in ("Assets/Code/Loose.cs", "Packages/tool/Extra.cs"):
        (root / gone).unlink()
    assert run("status", project)[0]["removed"] == ["Assets/Code/Loose.cs", "Packages/tool/Extra.cs"]
    again = run("index", project)[0]
    assert again["flagged"] == 1 and again["stale"] == 1 and again["removed"] >= 2 and again["embedded"] < first["embedded"]
    assert run("status", project)[0]["hint"] == "fresh"
    session = GraphSession(spark, folder)
    assert rows_of(session.nodes.where("name in ('Loose', 'Pair', 'navigation')"), "key", "stale") == [("Loose", True), ("concept:navigation", False)]
    assert {(r["from"], r["reason"]) for r in run("sem", "review")} == {("navigation", "source changed"), ("Loose", "endpoint stale")}
    assert run("sem", "confirm", "responsible_for", "navigation", "Clock") == [{"confirmed": 1}]
    assert {r["from"] for r in run("sem", "review")} == {"Loose"} and [r["from"] for r in run("sem", "ls") if "confidence" in r] == ["Loose", "navigation"]
    assert all(r["key"] != "Loose" for r in run("search", "Loose", "--k", "50"))

    assert run("candidates", "zeppelin")[0]["tier"] == "none" and run("candidates", " Zeppelin")[0]["tier"] == "none"
    gaps = run("gaps")
    assert gaps[0]["summary"]["missed_queries"] == 1 and gaps[1]["row"]["n"] == 2
    reflect = run("reflect")
    assert reflect[0]["summary"]["needs_review"] == 1 and reflect[0]["summary"]["low_confidence"] == 1 and reflect[0]["summary"]["stale_nodes"] == 1
    assert run("community")[0]["communities"] == session.nodes.where("key like 'community:%'").count() >= 1
    assert session.edges.where("author = 'community-detection' and rel = 'PART_OF'").count() >= 2
    assert {r["key"] for r in run("deps", "Assets/Art/buoy.Prefab")} == {SHARED} and run("find", "Clock")[0]["key"] == "Harbor.Tides.Clock"
    assert {r["key"] for r in run("impact", "Gauge", "--depth", "1")} == {"Harbor.Tides.Clock", SHARED}
    assert run("basis", "Clock", "Gauge") == [{"hops": 1}]
    assert run("watch", project, "--rounds", "1", "--every", "0") == [] and len(run("neighbors", "Clock")) > 5
    assert main([folder, "query", "DROP TABLE x"]) == 1 and run("query", "SELECT count(*) AS n FROM edges WHERE source = 'semantic'")[0]["n"] >= 4


def test_a_custom_embedder_and_summarizer(spark, tmp_path):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def length_only(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [float(len(x)), 1.0])

    project = write_tree(tmp_path / "project")
    session = GraphSession(
        spark, f"file://{tmp_path}/g", lambda rows: rows.select("key", length_only("text").alias("vector")), "length", lambda found: found.withColumn("listed", F.lit("by a model"))
    )
    assert session.index(project, "2024-01-01")["embedded"] >= 18
    assert {r.summary for r in session.nodes.where("key like 'community:%'").collect()} == {"by a model"}
    assert session.search("x", 3).count() == 3
    (tmp_path / "c.json").write_text('{"concepts": [{"name": "weather"}], "edges": [{"from": "weather", "to": "Clock", "rel": "RELATES_TO", "confidence": 0.7}]}')
    session.curate(f"file://{tmp_path}/c.json", "2024-01-01")
    assert rows_of(session.semantic().where("author = 'curation'"), "from", "to") == [("weather", "Clock")]
    assert GraphSession(spark, f"file://{tmp_path}/g").index(project, "2024-01-02", communities=False)["embedded"] >= 18  # another embedder: all anew
    session.delete()
    assert session.versions() == [] and session.nodes.isEmpty()


def test_gate_of_an_evaluation(spark):
    from weftgraph.plans.evaluation import gate

    lanes = spark.createDataFrame([("cold", 0.7, 0), ("curated", 0.9, 1)], "lane string, recall double, false_high int")
    assert rows_of(gate(lanes)) == [("cold: no false high", True), ("cold: recall", True), ("curated: no false high", False), ("curated: recall", True), ("curation loses no recall", True)]
    assert not any(r.passed for r in gate(lanes.where("false")).collect())


def test_vectors_are_kept_by_the_hash_of_their_text(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "new")], "key string, embed_text string")
    stored = texts.select("key", F.lit("e").alias("embedder"), F.sha1(F.expr("if(key = 'c', 'old', embed_text)")).alias("embed_hash"), F.array(F.lit(1.0)).alias("vector"))
    kept, fresh = search.cached_vectors(texts, stored.where("key <> 'b'").unionByName(stored.where("key = 'b'").withColumn("embedder", F.lit("other"))), "e")
    assert rows_of(kept, "key") == [("a",)] and rows_of(fresh, "key") == [("b",), ("c",)]


def test_the_shared_folder_must_be_named_on_a_cluster():
    from weftgraph.plans.runtime import shared_folder

    class Session:
        class sparkContext:  # noqa: N801
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_streams(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([("Where", "none", datetime(2024, 1, 1)), (" where ", "low", datetime(2024, 1, 2)), (" ", "low", datetime(2024, 1, 2))], "query string, tier string, seen_at timestamp").write.parquet(folder)
    stream = spark.readStream.schema("query string, tier string, seen_at timestamp").parquet(folder)
    assert rows_of(watch.run_to_table(watch.count_misses(stream), "misses_test"), "key", "n", "tier") == [("where", 2, "low")]
    batches = []
    watch.watch_files(spark, folder, "query string, tier string, seen_at timestamp", lambda rows, n: batches.append(rows.count()), f"file://{tmp_path}/state").awaitTermination()
    assert sum(batches) == 3


def test_watched_files_keep_their_latest_state_over_all_snapshots_batch_by_batch(spark, tmp_path, monkeypatch):
    from weftgraph.plans import text_queries

    schema = "project string, snapshot_no int, file_path string, content_sha1 string, loaded_at timestamp_ntz"
    rows = [("p", s, f"f{i}", f"{i}-{s}", datetime(2024, 1, s, i % 20)) for s in range(1, 9) for i in range(s, 40)] + [("p", 8, "late", "x", datetime(2024, 2, 1)), ("p", 8, "f39", None, datetime(2024, 3, 1)), ("p", 8, None, "x", datetime(2024, 3, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/index_files.parquet")
    monkeypatch.setattr(text_queries, "FILE_ROWS", 20)
    sizes = []
    monkeypatch.setattr(watch, "latest_state", lambda rows, fold=watch.latest_state: sizes.append(rows) or fold(rows))
    want = {f"p/f{i}": f"{i}-{min(i, 8)}" for i in range(1, 40)} | {"p/late": "x"}
    assert dict(rows_of(text_queries.watch_latest(spark, str(tmp_path)))) == want
    assert len(sizes) >= 4  # several batches, and once over what they left
    counted = dict(rows_of(text_queries.watch_microbatch(spark, str(tmp_path)), "snapshot_no", "files"))
    assert counted == Counter([*(min(i, 8) for i in range(1, 40)), 8])


def test_a_stream_run_to_a_table_holds_no_rows_in_the_driver(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", "none", datetime(2024, 1, 1)), ("b", "low", datetime(2024, 1, 2)), ("a", "low", datetime(2024, 1, 2))], "query string, tier string, seen_at timestamp").repartition(3).write.parquet(folder)
    stream = spark.readStream.schema("query string, tier string, seen_at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    table = watch.run_to_table(watch.count_misses(stream), "misses_on_disk")
    assert rows_of(table, "key", "n") == [("a", 2), ("b", 1)] and len(table.inputFiles()) >= 1
    nothing = f"file://{tmp_path}/none"
    spark.createDataFrame([], "path string, sha1 string, seen_at timestamp").write.parquet(nothing)
    none = spark.readStream.schema("path string, sha1 string, seen_at timestamp").parquet(nothing)
    assert watch.run_to_table(none, "nothing", fold=watch.latest_state).isEmpty()


def test_registered_communities_are_final_as_by_brute_force(spark, monkeypatch):
    from weftgraph.plans import graph_queries, project_graph

    names = [f"k{i:02}" for i in range(24)]
    links = [(names[i], names[i + 1]) for i in range(15)] + [(names[a], names[b]) for a in range(16, 23) for b in range(a + 1, 24) if (a + b) % 3]
    monkeypatch.setattr(project_graph, "types", lambda *_: spark.createDataFrame([(k, k.upper(), False) for k in names], "key string, name string, stale boolean"))
    monkeypatch.setattr(project_graph, "structural_edges", lambda *_: spark.createDataFrame(links, "src string, dst string"))

    def brute(rounds):
        ways = [*links, *((b, a) for a, b in links)]
        label = {k: k for x in links for k in x}
        for done in range(rounds):
            after = {}
            for k, own in label.items():
                votes = Counter([own, *(label[b] for a, b in ways if a == k)])
                after[k] = min(votes, key=lambda c: (-votes[c], c))
            if after == label:
                return label, done
            label = after
        return label, rounds

    final, took = brute(20)
    assert 3 < took and final != brute(3)[0]
    size = Counter(final.values())
    want = sorted((k, c) for k, c in final.items() if size[c] >= 2)
    assert rows_of(graph_queries.communities(spark, "")) == want
    described = rows_of(graph_queries.community_summary(spark, ""), "key", "members")
    assert described == sorted((f"community:{min(k for k, x in want if x == c)}", n) for c, n in size.items() if n >= 2)


@pytest.mark.parametrize("block", [2, 4096])
def test_candidates_of_many_queries_equal_those_of_each(spark, block):
    rows = spark.createDataFrame(
        [node("Class", f"N.T{i}", ["FireBall", "Ball", "Fireplace", "Fire", "物理Camera"][i % 5] + str(i % 3), doc=["a fire toy", None, "on the camera"][i % 3], stale=i == 7) for i in range(60)], NODES
    ).repartition(3)
    texts = ["fire ball", " Ball1 ", "zzz", "物理", "FireBall0", "?", "on the", "fire ball"]
    asked = spark.createDataFrame([*enumerate(texts), (90, " \n"), (91, None)], "query_id long, query string")
    found = rows_of(search.candidates_of(rows, asked, 4, block=block), "query_id", "key", "score")
    each = {t: rows_of(search.candidates(rows, [t], 4), "key", "score") for t in set(texts)}
    assert found == sorted(((i, *r) for i, t in enumerate(texts) for r in each[t]), key=repr)
    assert any(r[0] == 0 for r in found) and not any(r[0] in (2, 90, 91) for r in found)


def test_candidates_are_found_by_summary_and_signature(spark):
    rows = spark.createDataFrame([node("Class", "N.A", "A"), node("Concept", "concept:c", "c")], NODES)
    rows = rows.withColumn("signature", F.when(F.col("label") == "Class", "class A : Vehicle")).withColumn("summary", F.when(F.col("label") == "Concept", "about weather"))
    asked = spark.createDataFrame([(1, "vehicle"), (2, "Weather")], "query_id long, query string")
    assert rows_of(search.candidates_of(rows, asked), "query_id", "key", "score") == [(1, "N.A", 1.0), (2, "concept:c", 1.0)]
    assert rows_of(search.candidates(rows, ["vehicle"]), "key") == [("N.A",)]
