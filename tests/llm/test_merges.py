"""Encoding against the public libraries, whole and at its edges."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from weftgraph.llm import merges
from weftgraph.llm.tokens import encode_corpus, rank_file

CONTENT = rank_file().read_bytes()
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges.read_ranks(CONTENT), special_tokens={})

TEXTS = [
    None, "", " ", "\n\n \t x", "a", "it's we'll 'S ''s don't", "Hello  world\r\n\r\n  indented()", "<|endoftext|> stays text", "物理の索引。状態！", "ーーー" * 900,
    "ab" * 2000, "0123456789" * 300, "  x　\u0085y z", "🇯🇵👩‍👩‍👧 ²³Ⅷ naïve カﾞ", "\x00\x1f\x1c a", "'" * 50, "a" * 300, " " * 700 + "b", "tab\t\t\tbed", "x y z", "é" * 40,
]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    alphabet = "abcdeXYZ 019'.,;:()\n\t\r  éß物ー。🙂 　"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("short", [2, 16, 256])
def test_words_merge_like_the_library(monkeypatch, short):
    """Whatever length is merged by scanning and whatever by the heap."""
    monkeypatch.setattr(merges, "SHORT", short)
    words = ["", "a", "hello", " world", "ーーーーー", "supercalifragilistic", "é" * 40, "zz" * 30, "0" * 61] + [t.replace(" ", "") for t in random_texts(200)]
    flat, starts = merges.merge_words(pa.array(words), merges.table_of(CONTENT))
    for i, word in enumerate(words):
        assert flat[starts[i] : starts[i + 1]].tolist() == LIBRARY._core_bpe.encode_single_piece(word.encode()) if word else starts[i] == starts[i + 1]


def test_no_words():
    flat, starts = merges.merge_words(pa.array([], pa.string()), merges.table_of(CONTENT))
    assert len(flat) == 0 and starts.tolist() == [0]


def test_pair_ranks_of_a_crowded_table():
    table = merges.table_of(CONTENT)
    ranks = merges.read_ranks(CONTENT)
    rng = random.Random(2)
    tokens = list(ranks)
    left, right = [rng.choice(tokens) for _ in range(5000)], [rng.choice(tokens) for _ in range(5000)]
    found = table.ranks(np.array([ranks[t] for t in left], np.int32), np.array([ranks[t] for t in right], np.int32))
    assert found.tolist() == [ranks.get(a + b, int(merges.NONE)) for a, b in zip(left, right)]


def test_corpus_equals_both_libraries(spark):
    texts = TEXTS + random_texts(300, 1)
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    found = {r.doc_id: r.ids for r in encode_corpus(rows).collect()}
    other = Tokenizer.from_file(path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for i, text in enumerate(texts):
        assert found[i] == LIBRARY.encode_ordinary(text or ""), repr(text)[:60]
        assert found[i] == other.encode(text or "", add_special_tokens=False).ids, repr(text)[:60]


def test_rows_are_neither_merged_nor_dropped(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], schema)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in encode_corpus(rows).collect()) == sorted((k, tuple(LIBRARY.encode_ordinary(t))) for k, t in ((1, "a b"), (1, "a b"), (0, "c"), (2, "")))
    assert encode_corpus(spark.createDataFrame([], schema)).isEmpty()


def test_round_trip_and_another_vocabulary(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(50, 3))], "doc_id long, text string")
    content = rank_file("byte_bpe_multi_50k").read_bytes()
    library = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=merges.read_ranks(content), special_tokens={})
    found = {r.doc_id: r.ids for r in encode_corpus(rows, tokenizer="byte_bpe_multi_50k").collect()}
    assert all(library.decode(found[r.doc_id]) == r.text for r in rows.collect())


def test_a_rank_file_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        merges.MergeTable({b"a": 0})
