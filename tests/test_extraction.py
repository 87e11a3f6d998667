from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import extraction, graph
from weftgraph.sources import project_files as pf

from .conftest import rows_of

CLOCK = """using System;
using Harbor.Shared;

namespace Harbor.Tides
{
    /* class Hidden in a comment */
    public enum Phase { Ebb, Flood, Slack }

    public partial class Clock
    {
        Phase phase; // struct Nope
        public Ledger<Phase> Seen = new Ledger<Phase>();

        public Phase Read(double hours, bool local)
        {
            Seen.Note("{ not a brace", 2);
            return Read(hours);
        }

        public Phase Read(double hours) { return phase; }

        struct Mark
        {
            public int at;
            public enum Kind { Low, High }
        }
    }
}
"""
DRAWING = """using Harbor.Shared;
namespace Harbor.Tides
{
    public partial class Clock : Gauge, IDrawn
    {
        public void Draw(Canvas on) { on.Line(0, 1); base.Warm(); }
    }
}
"""
BASE = """namespace Harbor.Shared
{
    public interface IDrawn { void Draw(Canvas on); }

    public abstract class Gauge : ScriptableObject
    {
        protected void Warm() { }
    }

    public class Ledger<T> where T : struct
    {
        int count;
        public void Note(string what, int times) { count += times; }
    }

    /// <summary>潮を描く <i>lines</i>
    /// only.</summary>
    public class Canvas : MonoBehaviour
    {
        public void Line(int a, int b) { }
    }
}
"""
LOOSE = """using Harbor.Shared;
[RequireComponent(typeof(Harbor.Shared.Canvas))]
public class Loose : MonoBehaviour { void Awake() { TryGetComponent<Canvas>(out var c); Addressables.InstantiateAsync("buoys/red"); } }
"""
CODE = {"Assets/Code/Tides/Clock.cs": CLOCK, "Assets/Code/Tides/Clock.Drawing.cs": DRAWING, "Assets/Code/Shared/Base.cs": BASE, "Assets/Code/Loose.cs": LOOSE, "Packages/tool/Extra.cs": "record Pair(int Left, int Right);\n"}
IDS = {path: f"{n:x}{'0a' * 15}{n:x}" for n, path in enumerate(["Assets/Code/Tides/Clock.cs", "Assets/Code/Shared/Base.cs", "Assets/Code/Loose.cs", "Assets/Art/buoy.Prefab", "Assets/Art/blob.asset"], 4)}
BUOY, SHARED = IDS["Assets/Art/buoy.Prefab"], IDS["Assets/Code/Shared/Base.cs"]


def write_tree(root):
    texts = dict(CODE)
    texts |= {f"{path}.meta": f"fileFormatVersion: 2\nguid: {guid}\n" for path, guid in IDS.items()}
    texts["Assets/Art/buoy.Prefab"] = f"Float:\n  script: {{guid: {SHARED.upper()}, type: 3}}\n  twice: {{guid: {SHARED}}}\n  self: {{guid: {BUOY}}}\n  lost: {{guid: {'e' * 32}}}\n"
    texts["Assets/Art/gone.mat.meta"] = f"guid: {'7' * 32}\n"
    texts["Assets/Groups/Sea.asset"] = f"Group:\n  m_SerializeEntries:\n  - m_GUID: {BUOY}\n    m_Address: \"buoys/red\"\n  - m_GUID: {'d' * 32}\n    m_Address: buoys/lost\n  - m_GUID: {SHARED}\n    m_ReadOnly: 1\n"
    texts["Assets/OBJ/Gone.cs"] = "class Gone { }"
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "Assets/Art/blob.asset").write_bytes(b"\xff\xfe\x00guid: " + b"\x80" * 40)
    (root / "Assets/Art/huge.png").write_bytes(b"\x89PNG")
    return f"file://{root}"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    return pf.project_files(spark, write_tree(tmp_path_factory.mktemp("project"))).cache()


@pytest.fixture(scope="module")
def whole(files):
    return tuple(x.cache() for x in extraction.project_graph(files))


def test_scan_takes_tracked_files_only_and_gives_relative_paths(files):
    held = {r.path: r for r in files.collect()}
    assert set(held) == {*CODE, *(f"{p}.meta" for p in IDS), "Assets/Art/buoy.Prefab", "Assets/Art/blob.asset", "Assets/Art/gone.mat.meta", "Assets/Groups/Sea.asset"}
    assert held["Assets/Art/blob.asset"].content is None and held["Assets/Code/Loose.cs"].content == LOOSE


def test_a_hash_is_of_the_bytes(files):
    import hashlib

    want = hashlib.sha1(b"\xff\xfe\x00guid: " + b"\x80" * 40).hexdigest()
    assert files.where("path = 'Assets/Art/blob.asset'").first().sha1 == want


def test_whole_project_graph(whole):
    nodes, edges = whole
    assert Counter(r.label for r in nodes.collect()) == {"Class": 6, "Interface": 1, "Enum": 2, "Struct": 1, "Method": 8, "Namespace": 2, "Asset": 5, "AddressableGroup": 1, "AddressableEntry": 2}
    found = {}
    for r in edges.collect():
        found.setdefault(r.rel, set()).add((r.src, r.dst))
    tides, shared = "Harbor.Tides.", "Harbor.Shared."
    assert found["INHERITS"] == {(tides + "Clock", shared + "Gauge")} and found["IMPLEMENTS"] == {(tides + "Clock", shared + "IDrawn")}
    assert found["REFERENCES"] == {(tides + "Clock", tides + "Phase"), (tides + "Clock", shared + "Ledger"), (tides + "Clock", shared + "Canvas"), (shared + "IDrawn", shared + "Canvas")}
    assert found["CALLS"] == {
        (tides + "Clock.Read(Double,Boolean)", tides + "Clock.Read(Double)"), (tides + "Clock.Read(Double,Boolean)", shared + "Ledger.Note(String,Int32)"),
        (tides + "Clock.Draw(Canvas)", shared + "Canvas.Line(Int32,Int32)"), (tides + "Clock.Draw(Canvas)", shared + "Gauge.Warm()"),
    }
    assert found["USES_COMPONENT"] == {("Loose", shared + "Canvas")} and found["LOADS"] == {("Loose", "addr:buoys/red")}
    assert found["SCRIPT_OF"] == {(IDS["Assets/Code/Tides/Clock.cs"], tides + "Clock"), (IDS["Assets/Code/Loose.cs"], "Loose"), *((SHARED, shared + n) for n in ("IDrawn", "Gauge", "Ledger", "Canvas"))}
    assert found["DEPENDS_ON"] == {(BUOY, SHARED)} and found["ADDRESSES"] == {("addr:buoys/red", BUOY)}
    assert {rel: len(x) for rel, x in found.items() if rel in ("IN_NAMESPACE", "DECLARED_IN", "HAS_ENTRY")} == {"IN_NAMESPACE": 8, "DECLARED_IN": 8, "HAS_ENTRY": 2}
    texts = {r.key: r.embed_text for r in nodes.where("label <> 'Asset'").collect()}
    assert texts[tides + "Clock"] == "Clock. Harbor.Tides. class Clock : Gauge, IDrawn. uses Canvas Ledger Phase" and texts[shared + "Gauge.Warm()"] == "Warm. Gauge. void Harbor.Shared.Gauge.Warm()"
    assert found["HAS_ENTRY"] == {("addrgroup:Sea", "addr:buoys/red"), ("addrgroup:Sea", "addr:buoys/lost")}


def test_type_facts(files):
    types = extraction.declared_types(files.where("path like '%.cs'"))
    found = {r.key: r for r in extraction.type_nodes(types).collect()}
    assert set(found) == {"Loose", "Pair"} | {f"Harbor.Tides.{n}" for n in ("Phase", "Clock", "Clock.Mark", "Clock.Mark.Kind")} | {f"Harbor.Shared.{n}" for n in ("IDrawn", "Gauge", "Ledger", "Canvas")}
    canvas = found["Harbor.Shared.Canvas"]
    assert canvas.doc == "潮を描く lines only." and canvas.signature == "class Canvas : MonoBehaviour" and canvas.is_mono and not canvas.is_scriptable
    assert canvas.embed_text == "Canvas. Harbor.Shared. class Canvas : MonoBehaviour. 潮を描く lines only."
    assert found["Harbor.Shared.Gauge"].is_scriptable and found["Harbor.Tides.Clock"].signature == "class Clock : Gauge, IDrawn"
    assert found["Harbor.Shared.Ledger"].signature == "class Ledger"


def test_basis_and_impact_over_the_extracted_graph(spark, whole):
    _, edges = whole
    tides, shared = "Harbor.Tides.", "Harbor.Shared."
    pairs = spark.createDataFrame([(tides + "Phase", shared + "Gauge"), (shared + "Gauge", shared + "Canvas"), ("Loose", "Loose"), ("Loose", "Pair")], "a string, b string")
    assert {r.a + ">" + r.b: r.hops for r in graph.structural_basis(edges, pairs, 3).collect()} == {f"{tides}Phase>{shared}Gauge": 2, f"{shared}Gauge>{shared}Canvas": 2, "Loose>Loose": None, "Loose>Pair": None}
    assert {r.hops for r in graph.structural_basis(edges, pairs.where("b like '%Gauge'"), 1).collect()} == {None}
    seeds = spark.createDataFrame([(shared + "Gauge",)], "key string")
    assert {(r.key, r.hops) for r in graph.impact(edges, seeds, 3).collect()} == {(tides + "Clock", 1), (SHARED, 1), (IDS["Assets/Code/Tides/Clock.cs"], 2), (BUOY, 2)}


def test_manifest_takes_the_place_of_meta_files(spark, files, tmp_path):
    text = f"""{{"Schema": 1, "assets": [
      {{"guid": "{SHARED}", "path": "Assets/Code/Shared/Base.cs", "scriptType": "Harbor.Shared.Gauge", "dependencies": ["{BUOY}", "{SHARED}", "{'c' * 32}"]}},
      {{"guid": "{BUOY}", "path": "Assets/Art/buoy.Prefab", "scriptType": "Harbor.Nobody"}}, {{"guid": "", "path": "x"}}]}}"""
    (tmp_path / "m.json").write_text(text)
    nodes, edges = extraction.project_graph(files, pf.manifest(spark, f"file://{tmp_path}/m.json"))
    assert nodes.where("label = 'Asset'").count() == 2
    assert rows_of(edges.where("rel in ('DEPENDS_ON', 'SCRIPT_OF')")) == [("DEPENDS_ON", SHARED, BUOY), ("SCRIPT_OF", SHARED, "Harbor.Shared.Gauge")]


def test_state_and_diff(spark, files):
    state = pf.index_state(files, "m1")
    assert state.where("path = '::manifest'").count() == 1
    old = state.where("path not like '%Extra.cs'").withColumn("sha1", F.expr("if(path like '%Loose.cs', 'x', sha1)"))
    old = old.unionByName(spark.createDataFrame([("Assets/Was.cs", "y")], "path string, sha1 string"))
    assert rows_of(pf.state_diff(state, old)) == [("Assets/Code/Loose.cs", "changed"), ("Assets/Was.cs", "removed"), ("Packages/tool/Extra.cs", "added")]
    assert pf.state_diff(state, state).isEmpty() and pf.state_diff(state, None).count() == files.count() + 1


def test_curation_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"concepts": [{"name": "weather", "summary": "wind and tide"}], "edges": [{"from": "weather", "to": "Clock", "rel": "RELATES_TO", "confidence": 0.7}]}')
    found = pf.curation(spark, f"file://{tmp_path}/c.json")
    assert rows_of(found["concepts"]) == [("weather", "wind and tide")] and rows_of(found["edges"], "from", "to", "confidence", "why") == [("weather", "Clock", 0.7, None)]


def test_empty_tree_gives_an_empty_graph(spark, files):
    nodes, edges = extraction.project_graph(files.where("false"))
    assert nodes.isEmpty() and edges.isEmpty()


def test_transcripts_and_tally(spark, tmp_path):
    for approach, cost in (("grep", 100), ("tool", 10)):
        (tmp_path / approach).mkdir()
        lines = [
            '{"timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "please look for Clock now"}}', "not json",
            f'{{"timestamp": "2024-01-01T00:00:05Z", "message": {{"role": "assistant", "content": "x", "usage": {{"input_tokens": {cost}, "output_tokens": 2}}}}}}',
        ]
        (tmp_path / approach / "a.jsonl").write_text("\n".join(lines))
    tasks = spark.createDataFrame([("t1", "look for Clock"), ("t2", "absent")], "task string, match string")
    found = pf.token_tally(pf.transcripts(spark, f"file://{tmp_path}/*"), tasks)
    assert rows_of(found, "task", "approach", "new_input", "cost", "seconds") == [("t1", "grep", 100, 110, 5.0), ("t1", "tool", 10, 20, 5.0)]
