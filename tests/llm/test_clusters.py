"""Clusters against brute force over all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import clusters as module
from weftgraph.llm.clusters import Clusters, similar_sets
from weftgraph.operators import numbering
from weftgraph.plans.runtime import Scratch

SCHEMA = "community_id long, names array<string>, sid string, cluster int"


def records(seed, n=160, pool=60, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            names = [x for x in (rng.choice(rows)[1] or []) if x is not None and rng.random() > 0.15] + [f"m{rng.randrange(pool)}"] * rng.randrange(3)
        else:
            names = [f"m{rng.randrange(pool)}" for _ in range(rng.randrange(1, 9))]
        if hot and rng.random() < 0.7:
            names.append("everywhere")
        rows.append((i, names, None, 7))
    return rows + [(1000, None, None, 1), (1001, [], None, 1), (1002, [None], None, 1), (None, ["m1"], None, 1)] + rows[:5]


def brute_pairs(rows):
    sets = {}
    for i, names, *_ in rows:
        held = {x for x in names or [] if x is not None}
        if i is not None and held:
            sets.setdefault(i, held)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    return {p for g in groups.values() for p in combinations(sorted(g), 2)}, sets


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_pairs_equal_brute_force(spark, seed, hot):
    rows = records(seed, hot=hot)
    found = [tuple(r) for r in Clusters(spark.createDataFrame(rows, SCHEMA), "community_id", "names").pairs().collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows)[0]


def test_crowded_buckets_lose_no_pair(spark):
    """With buckets of two sets nearly everything is banded again, or takes the exact way on rare members."""
    rows = [(i, sorted({f"m{x}" for x in names} | {"everywhere"}), None, 1) for i, names in enumerate([random.Random(s).sample(range(12), 5) for s in range(80)])]
    held = Clusters(spark.createDataFrame(rows, SCHEMA), "community_id", "names")
    sets = {r.sid: set(r.members) for r in held.sets.collect()}
    for levels in (module.LEVELS, module.LEVELS[:1]):
        links = {tuple(r) for r in similar_sets(held.sets, Scratch(spark, "t"), levels=levels, bucket=2).collect()}
        assert links == {(a, b) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_sets_whose_hashes_meet_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(numbering, "hashed", lambda value, seed: F.pmod(F.xxhash64(F.lit(seed), value), F.lit([60, 90][seed] if seed < 2 else 2**62)))
    rows = records(4)
    held = Clusters(spark.createDataFrame(rows, SCHEMA), "community_id", "names")
    assert held.sets.select("sid").distinct().count() == held.sets.count() == len(set(map(frozenset, brute_pairs(rows)[1].values())))
    assert {tuple(r) for r in held.pairs().collect()} == brute_pairs(rows)[0]


def test_frequent_members_of_small_sets(spark):
    """Sets of one to four members, most with a frequent one, in crowded buckets of two: no link is lost."""
    rng = random.Random(5)
    rows = [(i, [*(["everywhere"] if i % 4 else []), *(f"m{rng.randrange(30)}" for _ in range(rng.randrange(1, 4)))], None, 1) for i in range(150)]
    held = Clusters(spark.createDataFrame([*rows, (500, ["everywhere"], None, 1)], SCHEMA), "community_id", "names")
    links = {tuple(r) for r in similar_sets(held.sets, Scratch(spark, "t"), bucket=2).collect()}
    sets = {r.sid: set(r.members) for r in held.sets.collect()}
    assert links == {(a, b) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_a_large_cluster_is_paired_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(module, "PART", 7)
    rows = [(i, ["a", "b"], None, 1) for i in range(40)] + [(100 + i, ["x", f"y{i % 2}"], None, 1) for i in range(9)]
    found = [tuple(r) for r in Clusters(spark.createDataFrame(rows, SCHEMA), "community_id", "names").pairs().collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows)[0]


def test_loose_clusters_are_divided_around_medoids(spark):
    chain = [(i, [f"m{j}" for j in range(i, i + 6)], None, 1) for i in range(0, 40, 2)]
    held = Clusters(spark.createDataFrame(chain + [(900, ["a", "b"], None, 1), (901, ["b", "a"], None, 1)], SCHEMA), "community_id", "names")
    found = held.described().collect()
    assert len({r.cluster for r in found}) == 2
    loose = [r for r in found if r.n_records < 900 and r.medoid_id < 900]
    assert len(loose) > 1 and sum(r.n_records for r in loose) == len(chain)
    tight = next(r for r in found if r.medoid_id == 900)
    assert (tight.n_records, tight.n_sets, tight.typical_members) == (2, 1, ["a", "b"])


def test_nothing_to_cluster(spark):
    empty = Clusters(spark.createDataFrame([], SCHEMA), "community_id", "names")
    assert empty.pairs().isEmpty() and empty.described().isEmpty()
    for bands, rows in module.LEVELS:
        assert (1 - 0.5**rows) ** bands < 1.1e-6
