"""Containers: every limit kept, every text whole, little room left."""

import random
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm.packing import ALL, NOTHING, TURNS, limits, pack, pack_texts

from .test_merges import LIBRARY, random_texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), max_size=150), st.integers(1, 20))
def test_packing_keeps_all_limits(items, segments):
    tokens, loss = np.array([max(x) for x in items], np.int64), np.array([min(*x, 90) for x in items], np.int64)
    container = pack(tokens, loss, 100, segments, 90)
    assert len(container) == len(items)
    for c in set(container.tolist()):
        own = container == c
        assert tokens[own].sum() <= 100 and loss[own].sum() <= 90 and own.sum() <= segments
    # At most one container is so empty that it could have taken the next one's largest item.
    if segments == 20 and len(items):
        assert len(set(container.tolist())) <= 2 * max(tokens.sum() / 100, loss.sum() / 90, len(items) / 20) + 1


def test_items_of_opposite_shape_meet():
    tokens = np.array([60] * 20 + [40] * 20)
    loss = np.array([60] * 20 + [0] * 20)
    container = pack(tokens, loss, 100, 8, 60)
    assert len(set(container.tolist())) == 20 and all(len({container[i] for i in np.flatnonzero(container == c)}) == 1 for c in range(20))


TALK = "reviewer: look at this one please\nagent: it is done, and more\nstill the agent speaks\ncurator: fine: thanks\nagent: bye"
TEXTS = [(None, ALL), ("", ALL), ("  ", NOTHING), (TALK, TURNS), (TALK * 20, TURNS), ("why?", NOTHING), ("word " * 500, NOTHING), ("word " * 500, ALL), ("x", None)]
TEXTS += [(t, random.Random(i).choice([ALL, NOTHING, TURNS])) for i, t in enumerate(random_texts(400, 9))]
BUDGETS = {1: limits(64), 2: limits(256, segments=10, loss=200)}


@pytest.fixture(scope="module")
def packed(spark):
    rows = spark.createDataFrame([(i, t, m, 0) for i, (t, m) in enumerate(TEXTS)], "doc_id long, text string, mode int, part_no int").repartition(3)
    return pack_texts(rows, BUDGETS, F.col("mode"), block=128).collect()


def test_every_text_is_whole_and_in_one_container_unless_it_alone_exceeds_it(packed):
    parts = defaultdict(list)
    for r in packed:
        parts[r.budget_id, r.doc_id].append(r)
    assert set(parts) == {(b, i) for b in BUDGETS for i in range(len(TEXTS))}
    for (budget, doc), own in parts.items():
        own.sort(key=lambda r: r.token_start)
        total = len(LIBRARY.encode_ordinary(TEXTS[doc][0] or ""))
        assert sum(r.n_tokens for r in own) == total and [r.part_no for r in own] == list(range(len(own)))
        assert [r.token_start for r in own] == np.cumsum([0, *(r.n_tokens for r in own)])[:-1].tolist()
        capacity, _, loss = BUDGETS[budget]
        if len(own) > 1:
            assert total > capacity or sum(r.loss_tokens for r in own) > loss
        if TEXTS[doc][1] in (ALL, None):
            assert all(r.loss_tokens == r.n_tokens for r in own)
        if TEXTS[doc][1] == NOTHING:
            assert all(r.loss_tokens == 0 for r in own)


def test_all_limits_hold_and_little_room_is_left(packed):
    held = defaultdict(list)
    for r in packed:
        held[r.budget_id, r.container_id].append(r)
    fill = defaultdict(list)
    for (budget, _), own in held.items():
        capacity, segments, loss = BUDGETS[budget]
        assert sum(r.n_tokens for r in own) <= capacity and len(own) <= segments and sum(r.loss_tokens for r in own) <= loss
        fill[budget].append(sum(r.n_tokens for r in own) / capacity)
    assert np.mean(fill[1]) > 0.9


def test_loss_is_borne_by_the_agents_turns(packed):
    lines = TALK.split("\n")
    borne = len(LIBRARY.encode_ordinary("\n".join(lines[1:3]) + "\n")) + len(LIBRARY.encode_ordinary(lines[4]))
    own = next(r for r in packed if r.budget_id == 2 and r.doc_id == 3)
    assert own.loss_tokens == borne
    again = [r for r in packed if r.budget_id == 2 and r.doc_id == 4]
    assert len(again) > 1 and Counter(r.n_tokens <= 256 and r.loss_tokens <= 200 for r in again) == {True: len(again)}


def test_edges(spark):
    schema = "doc_id long, text string"
    assert pack_texts(spark.createDataFrame([], schema), BUDGETS).isEmpty()
    same = pack_texts(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], schema), {1: limits(64)}).collect()
    assert len(same) == 3 and len({r.container_id for r in same}) == 1
    with pytest.raises(ValueError):
        pack_texts(spark.createDataFrame([], schema), {1: (0, 1, 1)})


def test_null_and_repeated_keys_crowd_no_block(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 200 + [(i, f"other {i}") for i in range(8, 90)]
    found = pack_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {1: limits(64)}, block=16).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows)
    assert max(Counter(r.container_id >> 24 for r in found).values()) <= 4 * 16
    assert all(n <= 64 for n in Counter({c: sum(r.n_tokens for r in found if r.container_id == c) for c in {r.container_id for r in found}}).values())


def test_only_texts_above_the_capacity_are_split_under_the_production_limits(spark):
    from weftgraph.llm.queries import p7_containers

    folder = tempfile.mkdtemp(prefix="spark-")
    sizes = [1, 60, *range(500, 520), 1024, 1030]
    texts = [("word" + " word" * (n - 1), kind) for n in sizes for kind in ("design_note", "query", "curation_talk")]
    texts += [("agent:" + " word" * n, "curation_talk") for n in range(495, 515)]
    spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, doc_type string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "byte_bpe_50k", 512)], "budget_id int, tokenizer string, capacity int").write.parquet(f"{folder}/token_budgets.parquet")
    parts, held = defaultdict(list), defaultdict(list)
    for r in p7_containers(spark, folder).collect():
        parts[r.doc_id].append(r)
        held[r.container_id].append(r)
    for doc, own in parts.items():
        total = len(LIBRARY.encode_ordinary(texts[doc][0]))
        assert sum(r.n_tokens for r in own) == total and (len(own) > 1) == (total > 512)
    _, segments, loss = limits(512)
    assert any(sum(r.loss_tokens for r in own) > loss for own in held.values())
    for own in held.values():
        assert sum(r.n_tokens for r in own) <= 512 and len(own) <= segments
        assert sum(r.loss_tokens for r in own) <= loss or len(own) == 1


@pytest.mark.parametrize("name", ["AGENT:", "\ufeffagent:", "  agent:", " \ufeffAgent :", "agent\u200b:"])
def test_agents_turns_are_known_in_any_case_and_after_blanks_and_format_characters(spark, name):
    size = lambda text: len(LIBRARY.encode_ordinary(text))
    talk = f"curator: well\n{name} it is done\n  note: still the agent\ncurator: thanks"
    least = size(" it is done\n  note: still the agent\n")
    rows = spark.createDataFrame([(1, talk), (2, talk[talk.index(name):]), (3, "curator: the agent: no\nreviewer: no")], "doc_id long, text string")
    loss = {r.doc_id: r.loss_tokens for r in pack_texts(rows, {1: limits(256)}, F.lit(TURNS)).collect()}
    assert least <= loss[1] <= least + size(name) + 2 and least <= loss[2] <= least + size(name) + 2 and loss[3] == 0
