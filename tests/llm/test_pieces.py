"""Pieces: exact sizes, whole cover, natural ends."""

import random

import pytest

from weftgraph.llm.pieces import split_texts

from .test_merges import LIBRARY, random_texts

BUDGETS = [(1, 64, 16), (2, 80, 0), (3, 200, 100)]
CODE = "namespace A\n{\n" + "".join(f"    public void M{i}()\n    {{\n        return x{i} + {i};\n    }}\n\n" for i in range(60)) + "}\n"
PROSE = "\n\n".join(" ".join(f"Sentence {j} of part {i} says something." for j in range(9)) for i in range(12))
HEADED = "\n".join(f"# Part {i}\n" + "\n".join(f"Line {j} holds words, and more." for j in range(6)) for i in range(20))
JAPANESE = "".join(f"カメラ装置が保存枠を遅らせるので、製作レシピは{i}件だけ残る。" for i in range(80))
TEXTS = [None, "", "short", CODE, PROSE, HEADED, JAPANESE, "ー" * 3000, "abc" * 2000, "8b24323fa7cf46" * 300, " " * 2500 + "end", "\n" * 400, "'" * 900 + "s", "ー" * 2000 + "ẞ\u1680Ꙁ᳀" * 90, "word " * 700, "🙂" * 500, "a b" * 300] + ["\n".join(random_texts(60, s)) for s in range(6)]


@pytest.fixture(scope="module")
def cut(spark):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int").repartition(2)
    by = {}
    for r in split_texts(rows, BUDGETS).collect():
        by.setdefault((r.budget_id, r.doc_id), []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in by.items()}


def tokens(text):
    return len(LIBRARY.encode_ordinary(text))


def test_exactly_the_texts_above_the_capacity_are_cut(cut):
    assert set(cut) == {(b, i) for b, capacity, _ in BUDGETS for i, t in enumerate(TEXTS) if t and tokens(t) > capacity}


def test_sizes_cover_and_overlap_are_exact(cut):
    for (budget, doc), pieces in cut.items():
        _, capacity, overlap = next(b for b in BUDGETS if b[0] == budget)
        text = TEXTS[doc]
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        assert pieces[0].char_start == 0 and pieces[-1].char_end == len(text) and pieces[-1].ends_at == "text end"
        for before, p in zip([None, *pieces], pieces):
            assert p.piece == text[p.char_start : p.char_end]
            assert p.n_tokens == tokens(p.piece) <= capacity
            if before:
                assert before.char_start < p.char_start <= before.char_end < p.char_end
                assert p.shared_tokens == tokens(text[p.char_start : before.char_end]) <= overlap


def test_pieces_end_at_natural_breaks(cut):
    for doc, allowed in ((TEXTS.index(PROSE), {"paragraph", "sentence"}), (TEXTS.index(HEADED), {"section", "sentence"}), (TEXTS.index(JAPANESE), {"sentence"})):
        for p in cut[3, doc][:-1]:
            assert p.ends_at in allowed, (doc, p)
    for p in cut[3, TEXTS.index(HEADED)][:-1]:
        if p.ends_at == "section":
            assert TEXTS[TEXTS.index(HEADED)][p.char_end :].lstrip().startswith("# Part")
    for p in cut[3, TEXTS.index(JAPANESE)][:-1]:
        assert p.piece.endswith("。")


def test_levels_are_split_in_turn(spark):
    """Sections that fit stay whole; only what doesn't fit is split, and at the next level."""
    fits = "namespace A\n{\n    public sealed class One\n    {\n        int a;\n    }\n\n    internal class Two\n    {\n        int b;\n    }\n}\n"
    large = "# Notes\n" + "\n\n".join(f"Paragraph {i} is short. It has two sentences." for i in range(9)) + "\n"
    talk = "".join(f"{who}: question {i} about the scene, asked at some length\n" for i in range(12) for who in ("user", "agent"))
    rows = spark.createDataFrame([(1, fits + large), (2, talk), (3, "using A;\nusing B;\n" * 40)], "doc_id long, text string")
    found = {}
    for r in split_texts(rows, [(1, 64, 0)]).orderBy("doc_id", "piece_no").collect():
        found.setdefault(r.doc_id, []).append(r)
    for whole in (fits[fits.index("    public sealed") : fits.index("    internal")], fits[fits.index("    internal") :], "Paragraph 4 is short. It has two sentences."):
        assert any(whole.strip() in r.piece for r in found[1])
    assert all(r.ends_at in ("section", "paragraph") for r in found[1][:-1])
    assert all(r.ends_at == "paragraph" and r.piece.startswith(("user:", "agent:")) for r in found[2][:-1])
    assert all(r.ends_at == "sentence" and r.piece.startswith("using") for r in found[3][:-1])


def test_a_part_is_left_out_only_if_it_does_not_fit(cut):
    """Greedy: behind each piece, up to the next break of its level or a higher one, there is more than what was left."""
    for (budget, doc), pieces in cut.items():
        if TEXTS[doc] in (PROSE, HEADED):
            capacity = next(c for b, c, _ in BUDGETS if b == budget)
            for p, after in zip(pieces, pieces[1:]):
                rest = TEXTS[doc][p.char_start : p.char_end] + after.piece[p.char_end - after.char_start :]
                assert tokens(rest) > capacity


def test_overlap_is_near_the_stated_one_in_prose(cut):
    for p in cut[1, TEXTS.index(PROSE)][1:]:
        assert p.shared_tokens >= 12


def test_settings_that_cannot_hold_are_refused(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for budget in ((1, 8, 0), (1, 64, 40), (1, 64, -1)):
        with pytest.raises(ValueError):
            split_texts(rows, [budget])


def test_empty_table_and_repeated_keys(spark):
    schema = "doc_id long, text string"
    assert split_texts(spark.createDataFrame([], schema), BUDGETS).isEmpty()
    rng = random.Random(0)
    text = " ".join(str(rng.random()) for _ in range(40))
    found = split_texts(spark.createDataFrame([(1, text), (1, text), (None, text)], schema).coalesce(1), [(1, 64, 8)]).collect()
    assert len(found) % 3 == 0 and {r.doc_id for r in found} == {1, None}
