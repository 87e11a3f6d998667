"""The operators for the general data problems, against plain Python and at their edges."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions.hashing import hash_longs
from weftgraph.functions.keys import canonical_guid, simple_name
from weftgraph.operators.components import connected_components
from weftgraph.operators import hierarchies, numbering, snapshots
from weftgraph.operators.hierarchies import Hierarchy, hierarchy, running_total
from weftgraph.operators.history import attribute_history
from weftgraph.operators.orphans import orphan_references, presence_intervals
from weftgraph.plans.runtime import Scratch

from .conftest import rows_of

DAY = datetime(2024, 1, 1)


def at(days):
    return None if days is None else DAY + timedelta(days=days)


# --- canonical forms and hashes


def test_guid_forms(spark):
    hexes = "0123456789abcdef" * 2
    given = [hexes, hexes.upper(), "{" + hexes + "}", f"\t{hexes}\n", f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:]}", " Odd Text\n", "", None]
    found = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string").orderBy("i").select(canonical_guid(F.col("g"))).collect()]
    assert found == [hexes] * 5 + ["odd text", "", None]


def test_simple_names(spark):
    given = [("A.B.Cee", "cee"), ("global::X.Yy ", "yy"), ("a::B", "b"), (" Plain\t", "plain"), ("", ""), ("x.", "")]
    found = spark.createDataFrame(given, "k string, want string").select(simple_name(F.col("k")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in found)


def test_hashes_agree_with_spark(spark):
    values = [(0, -1, 5), (2**62, -(2**63), 7), (123456789, 42, -42)]
    found = [r[0] for r in spark.createDataFrame(values, "a long, b long, c long").select(F.xxhash64("a", "b", "c")).collect()]
    assert found == hash_longs(*np.array(values, dtype=np.int64).T).tolist()


# --- what changed between snapshots


SNAPSHOT = "project string, snapshot_no int, file_path string, content_sha1 string, loaded_at timestamp, k1 string"


def brute_changes(rows):
    state, delivered = defaultdict(dict), defaultdict(set)
    for project, no, path, sha, loaded, _ in sorted(rows, key=lambda r: (r[4] or datetime.min, r[3] or "")):
        if no is not None and path is not None:
            delivered[project].add(no)
            state[project, no][path] = sha
    out = set()
    for project, numbers in delivered.items():
        for old, new in zip(sorted(numbers), sorted(numbers)[1:]):
            a, b = ({p: s for p, s in state[project, n].items() if s is not None} for n in (old, new))
            for path in a.keys() | b.keys():
                if a.get(path) != b.get(path):
                    out.add((project, new, path, "added" if path not in a else "removed" if path not in b else "changed"))
    return out


def snapshot_rows(seed, files=120, share=0.2):
    rng = random.Random(seed)
    rows = []
    for project in ("big", "small", None):
        state = {f"Assets/{i}.cs": str(i) for i in range(files if project == "big" else 9)}
        for no in (1, 2, 4, 7):
            for path in list(state):
                if rng.random() < share:
                    state[path] = rng.choice([None, str(rng.random())])
            state[f"Assets/new{no}.cs"] = "n"
            for path, sha in state.items():
                rows.append((project, no, path, sha, at(no), "clash"))
                if rng.random() < 0.1:
                    rows.append((project, no, path, str(rng.random()), at(no - 0.5), None))  # corrected later
                if rng.random() < 0.1:
                    rows.append(rows[-1])
    return rows + [("big", 1, None, "x", at(1), None), ("big", None, "Assets/1.cs", "x", at(1), None)]


@pytest.mark.parametrize("settings", [{}, {"bucket_rows": 16}, {"bucket_rows": 64, "cells_per_row": (0.05, 3.0)}, {"bucket_rows": 64, "cells_per_row": (0.05,)}])
def test_snapshot_changes_equal_brute_force(spark, settings):
    """Also with tables too small to peel: larger ones follow, or a row by row comparison."""
    rows = snapshot_rows(5)
    found = snapshots.snapshot_changes(spark.createDataFrame(rows, SNAPSHOT), **settings)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_changes(rows)


def test_snapshot_changes_of_nothing(spark):
    empty = spark.createDataFrame([], SNAPSHOT)
    assert snapshots.snapshot_changes(empty).isEmpty()
    one = spark.createDataFrame([("p", 1, "a", "x", None, None)], SNAPSHOT)
    assert snapshots.snapshot_changes(one).isEmpty()


def test_a_table_that_is_too_full_is_reported():
    import pandas as pd

    keys = np.arange(1, 200)
    h = hash_longs(keys, keys, keys)
    cells = {c: np.zeros(24, np.int64) for c in ("n", "k1", "k2", "v", "h")}
    for place in snapshots._positions(h, 8):
        np.add.at(cells["n"], place, 1)
        for c, x in zip(("k1", "k2", "v", "h"), (keys, keys, keys, h)):
            np.bitwise_xor.at(cells[c], place, x)
    assert not snapshots.peel(pd.DataFrame({"cell": np.arange(24), **cells}), 8)[1]


def test_relative_paths(spark):
    given = [("./Assets/a.cs", "Assets/a.cs"), ("Assets\\x\\b.cs", "Assets/x/b.cs"), ("Assets//x/./c", "Assets/x/c"), ("C:\\work\\p\\Assets\\d", "Assets/d"), ("/home/p/Packages/e", "Packages/e"), ("Assets/Ü ber/f", "Assets/Ü ber/f"), ("", "")]
    found = spark.createDataFrame(given, "p string, want string").select(snapshots.relative_path(F.col("p")).alias("got"), "want").collect()
    assert [r.got for r in found] == [r.want for r in found]


# --- orphan references


def test_presence_intervals(spark):
    seen = spark.createDataFrame([("a", at(1)), ("a", at(1)), ("a", at(2)), ("a", at(5)), ("b", at(3)), ("c", at(4)), (None, at(1)), ("d", None)], "k string, t timestamp")
    gone = spark.createDataFrame([("a", at(3)), ("a", at(3)), ("b", at(3)), ("z", at(1)), ("c", at(9))], "k string, r timestamp")
    assert rows_of(presence_intervals(seen, gone, "k", "t", "r")) == [("a", at(1), at(3)), ("a", at(5), None), ("c", at(4), at(9))]


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_orphans_follow_the_declared_match(spark, match):
    refs = spark.createDataFrame([(1, "x", "y", at(5)), (2, "x", None, at(5)), (3, None, "q", at(5)), (4, None, None, at(5)), (5, "x", "z", at(5)), (6, "x", "y", None), (7, "x", "y", at(1)), (5, "x", "z", at(5))], "id int, a string, b string, t timestamp")
    targets = spark.createDataFrame([("x", "y", at(2), None), ("x", "y", at(2), None), (None, "q", None, at(4)), ("x", None, None, None)], "a string, b string, valid_from timestamp, valid_to timestamp")
    found = [r.id for r in orphan_references(refs, targets, ["a", "b"], "t", match=match).orderBy("id").collect()]
    whole = [5, 5, 7]
    assert found == sorted(whole + {"simple": [], "partial": [3], "full": [2, 3]}[match])


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_hot_keys_change_no_result(spark, match):
    """One key holds most of the references; cut into parts or whole, the same rows come out, repeated ones too."""
    rows = [("hot" if i % 3 else f"k{i % 7}", None if i % 5 == 0 else "b", at(1 + i % 20), i % 40, [i]) for i in range(400)]
    refs = spark.createDataFrame(rows + rows[:9], "a string, b string, t timestamp, id int, _from array<int>")
    spans = [("hot", "b", at(3), at(9)), ("hot", "b", at(5), at(12)), ("hot", "c", at(15), None), ("k1", "b", None, at(4)), ("k3", None, None, None)]
    targets = spark.createDataFrame(spans, "a string, b string, valid_from timestamp, valid_to timestamp")
    whole, cut = (orphan_references(refs, targets, ["a", "b"], "t", match=match, hot_rows=n) for n in (10_000, 11))
    assert cut.columns == refs.columns and whole.count() > 0
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))


def test_orphans_of_empty_tables(spark):
    schema = "a string, t timestamp, _0 int"
    targets = spark.createDataFrame([], "a string, valid_from timestamp, valid_to timestamp")
    assert orphan_references(spark.createDataFrame([], schema), targets, ["a"], "t").isEmpty()
    assert orphan_references(spark.createDataFrame([("k", at(1), 3)], schema), targets, ["a"], "t").count() == 1
    with pytest.raises(ValueError):
        orphan_references(targets, targets, ["a"], "valid_from", match="some")


# --- hierarchies


def brute_tree(links):
    parent = {}
    for node, up in links:
        if node is not None:
            parent[node] = min([x for x in (parent.get(node), up) if x is not None], default=None)
    for up in [u for n, u in links if n is not None and u is not None]:
        parent.setdefault(up, None)
    out = {}
    for node in parent:
        path, seen = [node], {node}
        while parent[path[-1]] is not None:
            up = parent[path[-1]]
            if up in seen:
                out[node] = (min(path[path.index(up) :]), -1, None)
                break
            path.append(up)
            seen.add(up)
        else:
            out[node] = (path[-1], len(path) - 1, path[::-1])
    return out


def tree_links(kind):
    rng = random.Random(7)
    names = [f"n{i:03}" for i in range(150)]
    if kind == "random":
        links = [(n, rng.choice(names[:i]) if i and rng.random() < 0.9 else None) for i, n in enumerate(names)]
    elif kind == "chain":
        links = [(n, names[i - 1] if i else None) for i, n in enumerate(names[:70])] + [(names[5], names[9]), (None, "n1")]
    elif kind == "star":
        links = [(n, "hub") for n in names] + [("hub", "top")]
    else:
        links = [(n, rng.choice(names)) for n in names] + [("self", "self"), ("below", "self")]
    return links + links[:5]


@pytest.mark.parametrize("kind,segment", [("random", 2), ("chain", 16), ("star", 1024), ("circles", 3)])
def test_hierarchy_equals_brute_force(spark, monkeypatch, kind, segment):
    monkeypatch.setattr(hierarchies, "SEGMENT", segment)
    links = tree_links(kind)
    tree = Hierarchy(spark.createDataFrame([(*x, 1, "p") for x in links], "node string, parent string, size int, path string"))
    found = {r.node: r for r in tree.nodes().join(tree.paths(), "node").collect()}
    want = brute_tree(links)
    assert {n: (r.root, r.depth, r.path) for n, r in found.items()} == want
    assert rows_of(tree.nodes(intervals=False)) == rows_of(tree.nodes().select("node", "parent", "root", "depth", "on_circle"))
    pairs = {(a, n, len(p) - 1 - i) for n, (_, _, p) in want.items() if p for i, a in enumerate(p[:-1])}
    listed = [tuple(r) for r in tree.descendants().collect()]
    assert len(listed) == len(pairs) and set(listed) == pairs
    for n, r in found.items():
        if r.depth >= 0:  # the descendants are exactly the interval
            below = {m for m, (_, _, p) in want.items() if p and n in p[:-1]}
            assert below == {m for m, x in found.items() if x.root == r.root and x.depth >= 0 and r.first < x.first <= r.last}
            assert r.n_descendants == len(below)
        else:
            assert r.on_circle == any(n == c for c in _circle_nodes(links, n))


def test_values_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    """With hashes of a few bits at first, so that exceptions, and exceptions to them, are needed."""
    monkeypatch.setattr(numbering, "hashed", lambda value, seed: F.pmod(F.xxhash64(F.lit(seed), value), F.lit([90, 200, 400][seed] if seed < 3 else 2**62)))
    links = spark.createDataFrame(tree_links("random"), "node string, parent string")
    numbers = numbering.Numbering(links.select(F.col("node").alias("value")).distinct(), Scratch(spark, "numbers"))
    found = numbers.of(numbers.of(links, "node", "n"), "parent", "p").collect()
    own = {r.node: r.n for r in found}
    assert len(set(own.values())) == len(own) == 150
    assert all(r.p == (own[r.parent] if r.parent else None) and r.n == own[r.node] for r in found)


def test_a_chain_of_thousands(spark):
    """Work in proportion to the nodes, whatever the depth."""
    rows = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = Hierarchy(rows).nodes()
    assert found.where("root = 0 and depth = node and first = node and last = 4999").count() == 5000


def _circle_nodes(links, node):
    parent = {}
    for n, up in links:
        if n is not None:
            parent[n] = min([x for x in (parent.get(n), up) if x is not None], default=None)
    at_, path = node, []
    while at_ not in path:
        path.append(at_)
        at_ = parent[at_]
    return path[path.index(at_) :]


def test_hierarchy_of_nothing_and_descendants(spark):
    schema = "node string, parent string"
    assert hierarchy(spark.createDataFrame([], schema)).isEmpty()
    tree = Hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("l", "l")], schema))
    assert rows_of(tree.descendants()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_running_total_of_a_group_that_is_cut(spark):
    rows = spark.range(1000).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).alias("v"))
    found = running_total(rows, "g", "id", "v", salts=16).orderBy("before", "v").collect()
    total = 0
    for r in sorted(found, key=lambda r: (r.before, r.v == 0 and -1)):
        assert r.before <= sum(i % 7 for i in range(1000))
    assert len({r.id for r in found}) == 1000 and max(r.before + r.v for r in found) == sum(i % 7 for i in range(1000))
    by_before = sorted((r.before, r.v) for r in found if r.v)
    for before, v in by_before:
        assert before == total
        total += v


# --- histories


EDGE = "k string, s timestamp, x timestamp, w timestamp, a string, e0 int, slot int"


def brute_history(rows):
    by = defaultdict(dict)
    for k, s, x, w, a, *_ in rows:
        if s is not None and (x is None or x > s):
            held = by[k].get(s)
            rank = (w is not None, w, a is not None, a or "", x is not None, x)
            if held is None or rank > held[0]:
                by[k][s] = (rank, x, a)
    out = []
    for k, states in by.items():
        order, runs = sorted(states), []
        for s, after in zip(order, [*order[1:], None]):
            _, x, a = states[s]
            end = min([t for t in (x, after) if t is not None], default=None)
            if runs and runs[-1][1] == a and runs[-1][3] == s:
                runs[-1][3] = end
            else:
                runs.append([k, a, s, end])
        out += map(tuple, runs)
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [3, 70, 10_000])
def test_history_equals_brute_force(spark, hot_rows):
    """Also where an entity has far more states than a word has bits, and where entities are cut into stretches of time."""
    rng = random.Random(3)
    rows = []
    for k, n in (("long", 400), ("b", 20), ("c", 3), (None, 5)):
        for i in range(n):
            s = at(rng.randrange(2 * n) / 2)
            rows.append((k, s, rng.choice([None, s + timedelta(days=rng.choice([0.5, 1, 2, 0, -1]))]), at(i), rng.choice(["x", "x", "y", None]), 1, 2))
    rows += rows[:30] + [("none", None, None, at(1), "x", 1, 2)]
    frame = attribute_history(spark.createDataFrame(rows, EDGE), ["k"], "a", "s", "x", "w", hot_rows=hot_rows)
    assert rows_of(frame, "k", "a", "version_from", "version_to") == brute_history(rows)


def test_history_of_nothing(spark):
    assert attribute_history(spark.createDataFrame([], EDGE), ["k"], "a", "s", "x", "w").isEmpty()


# --- components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 1)] + [(7000, 7000 + i) for i in range(1, 90)]
    edges += edges[:9]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {v: find(v) for v in list(root)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()
