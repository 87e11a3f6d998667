"""Cutting texts above a token limit into overlapping pieces at natural breaks.

Separators form a hierarchy: section, paragraph, sentence or line, word, and
character.  A text is split at its sections; a section that is too large at its
paragraphs, such a paragraph at its sentences, and so on down to characters.
The parts are then packed greedily, in order: a piece begins with the overlap,
the tail of the piece before, and takes in whole parts while they fit.  A part
leaves room for the overlap, so none is ever cut for it.

Sizes are exact: within a text, words are tokenized on their own, so a piece's
tokens are the sum of its words', and the few pieces that cut a word are counted
again with the cut word.

Spark scans and splits the texts into words; in each task, all texts of a block
are split together, level by level, and packed together, one piece of each at a
time, by array operations.  The plan has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import ship
from .merges import MergeTable, merge_words, table_of
from .tokens import Words, gather, rank_file, word_batches, words_of

LEVELS = ("text end", "section", "paragraph", "sentence", "word", "character")
#: A word of more tokens may be cut, into parts of about ``PART`` tokens.
LONG_WORD, PART = 32, 8
#: By how much less a text is filled, try by try, whose cut words take more tokens together than apart; then its bytes are counted.
SHORTER = (0, PART, 2 * PART)

# White space, and line ends, in the syntax of Arrow's regular expressions.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]"
_CLOSERS = r"[\"'”’»)\]}」』】）]*$"
# What opens a section at the start of a line: headings and rules, or declarations behind modifiers. Two blank lines do, too.
_RULE = r"^(#+|-{3,}|={3,}|\*{3,})$"
_DECLARES = r"^ ?(namespace|class|interface|struct|enum|record|module|def|function)$"
_MODIFIER = r"^ ?(public|internal|private|protected|sealed|abstract|static|partial|export|final|async)$"


def _matches(words: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(words, pattern).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)


def _features(words: Words, table: MergeTable) -> dict[str, np.ndarray]:
    """Of each distinct word: what it looks like, and the (tokens, chars, bytes) of its units."""
    distinct, n = words.distinct.cast(pa.large_string()), len(words.distinct)
    sizes = np.stack([words.counts, np.asarray(pc.utf8_length(distinct)), np.asarray(pc.binary_length(distinct))]).astype(np.int64)
    starts = np.arange(n + 1)
    long = np.flatnonzero(words.counts > LONG_WORD)
    if len(long):
        parts, part_tokens = _parts([distinct[int(w)].as_py() for w in long], words.counts[long].tolist(), table)
        texts = [x for some in parts for x in some]
        part_sizes = np.stack([part_tokens, [len(x) for x in texts], [len(x.encode()) for x in texts]])
        count = np.ones(n, np.int64)
        count[long] = [len(some) for some in parts]
        starts = np.concatenate(([0], np.cumsum(count)))
        of_long = np.isin(np.repeat(np.arange(n), count), long)
        units = np.empty((3, starts[-1]), np.int64)
        units[:, ~of_long], units[:, of_long] = np.delete(sizes, long, axis=1), part_sizes
        sizes = units
    space = _matches(distinct, f"^{_WS}+$")
    return {
        "units": sizes, "starts": starts, "known": {}, "space": space, "opens": _matches(distinct, f"^{_WS}"),
        "ends": _matches(distinct, r"[.!?…]" + _CLOSERS), "wide_ends": _matches(distinct, r"[。！？]" + _CLOSERS),
        "rule": _matches(distinct, _RULE), "declares": _matches(distinct, _DECLARES), "modifier": _matches(distinct, _MODIFIER),
        "name": _matches(distinct, r"^\pL+$"), "colon": _matches(distinct, "^:"), "lines": np.asarray(pc.count_substring_regex(distinct, _LINE_END)).astype(np.int64) * space,
    }


class Units:
    """What pieces are made of: words, and the parts of long words, of a block of texts."""

    def __init__(self, words: Words, table: MergeTable):
        if not words.derived:
            words.derived.update(_features(words, table))
        flat, starts = words.derived["units"], words.derived["starts"]
        #: Tokens of the cut words and ends that have been counted in this batch.
        self.known: dict[bytes, int] = words.derived["known"]
        unit, self.word_at = gather(np.arange(flat.shape[1]), starts, words.which)
        tokens, unit_chars, unit_bytes = flat[:, unit]
        of_word = np.repeat(np.arange(len(words.which)), np.diff(self.word_at))
        #: The first unit of each unit's word, and one past its last.
        self.word_start, self.word_end = np.append(self.word_at[of_word], len(unit)), np.append(self.word_at[of_word + 1], len(unit))
        total = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.tokens, self.chars, self.bytes = total(tokens), total(unit_chars), total(unit_bytes)
        # What a unit can't exceed in any piece: a part of a word, and white space, may join others in one word.
        joins = words.derived["space"][words.which[of_word]] | (np.diff(self.word_at)[of_word] > 1)
        self.bound = total(np.where(joins, unit_bytes, tokens))
        #: Exact tokens of whole words before each unit that starts a word.
        exact = np.zeros(len(unit), np.int64)
        exact[self.word_at[:-1]] = words.counts[words.which]
        self.exact = total(exact)
        self.rows = self.word_at[words.rows]
        self.level, blank = self._levels(words, len(unit))
        #: Where the run of white space that ends before each unit began; the unit itself if there is none.
        self.blank_from = blank

    def _levels(self, words: Words, units: int) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the break before each unit, and the start of the white space before it."""
        which, m = words.which, len(words.which)
        level, blank = np.full(units + 1, 5, np.int8), np.arange(units + 1)
        if not m:
            return level, blank
        held = {x: words.derived[x][which] for x in ("space", "opens", "ends", "wide_ends", "rule", "declares", "modifier", "name", "colon", "lines")}
        space, opens, ends, wide_ends, lines = (held[x] for x in ("space", "opens", "ends", "wide_ends", "lines"))
        at = np.arange(m)
        first = np.zeros(m, bool)
        first[words.rows[:-1][words.rows[:-1] < m]] = True
        # Line ends in the run of white space before and after each break.
        seen = np.concatenate(([0], np.cumsum(lines)))
        last_solid = np.maximum.accumulate(np.where(~space, at, -1))
        before_start = np.concatenate(([0], last_solid[:-1] + 1))
        row_start = np.maximum.accumulate(np.where(first, at, 0))
        before = seen[at] - seen[np.maximum(before_start, row_start)]
        next_solid = np.minimum.accumulate(np.where(~space, at, m)[::-1])[::-1]
        after = seen[next_solid] - seen[at]
        around = before + after
        rank = np.full(m, 5, np.int8)
        previous = np.concatenate(([0], at[:-1]))
        rank[opens | space[previous]] = 4
        rank[(around > 0) | (ends[previous] & opens) | wide_ends[previous]] = 3
        # A line's first word, a name with a colon, opens a speaker's turn or a top-level entry.
        fresh = first | np.append(False, lines[:-1] > 0)
        rank[(around > 1) | (fresh & held["name"] & np.append(held["colon"][1:], False))] = 2
        # A declaration behind nothing but modifiers makes its line's first word a heading.
        begun = np.maximum.accumulate(np.where(fresh, at, 0))
        other = np.concatenate(([-1], np.maximum.accumulate(np.where(space | held["modifier"], -1, at))[:-1]))
        headed = np.append(held["rule"], False)
        headed[next_solid[begun[held["declares"] & (other < begun)]]] = True
        rank[((around > 0) & headed[next_solid]) | (around > 2)] = 1
        level[self.word_at[:-1]] = rank
        run = np.maximum(before_start, row_start)
        in_blank = np.repeat(space, np.diff(self.word_at))
        of_word = np.repeat(at, np.diff(self.word_at))
        blank[1:][in_blank] = self.word_at[run[of_word[in_blank]]]
        return level, blank


def _halves(part: str, last: bool) -> list[str]:
    """The part in two; a word's last quote stays with what is before it, as it could start a contraction."""
    cut = len(part) // 2
    if last and cut == len(part) - 1 and part[cut] == "'":
        cut -= 1
    return [part[:cut], part[cut:]] if cut else [part]


def _parts(words: list[str], tokens: list[int], table: MergeTable) -> tuple[list[list[str]], np.ndarray]:
    """Each word in parts of about PART tokens and never much more, and the tokens of all parts."""
    steps = [max(1, len(w) * PART // n) for w, n in zip(words, tokens)]
    parts = [[w[i : i + step] for i in range(0, len(w), step)] for w, step in zip(words, steps)]
    for some in parts:
        if len(some) > 1 and some[-1] == "'":
            some[-2:] = [some[-2] + "'"]
    while True:
        counts = np.diff(merge_words(pa.array([x for some in parts for x in some]), table)[1])
        ends = np.cumsum([len(some) for some in parts])
        large = {}
        for at in np.flatnonzero(counts > 2 * PART).tolist():
            of = int(np.searchsorted(ends, at, side="right"))
            k = at - int(ends[of] - len(parts[of]))
            if len(halves := _halves(parts[of][k], k == len(parts[of]) - 1)) > 1:
                large.setdefault(of, {})[k] = halves
        if not large:
            return parts, counts
        for of, cut in large.items():
            parts[of] = [y for k, x in enumerate(parts[of]) for y in cut.get(k, [x])]


def _parts_of(total: np.ndarray, level: np.ndarray, starts: np.ndarray, ends: np.ndarray, room: int) -> np.ndarray:
    """The ends of the parts of some texts, in order: what is larger than ``room`` is split at the breaks of one level after the other."""
    cuts = np.union1d(starts, ends)
    for k in range(1, 6):
        lo, hi = cuts[:-1], cuts[1:]
        large = (lo < ends[np.searchsorted(starts, lo, side="right") - 1]) & (total[hi] - total[lo] > room)
        if not large.any():
            break
        breaks = np.flatnonzero(level[: cuts[-1]] <= k)
        breaks = breaks[breaks > cuts[0]]
        cuts = np.union1d(cuts, breaks[large[np.searchsorted(cuts, breaks, side="right") - 1]])
    return cuts


def cut_texts(units: Units, total: np.ndarray, capacity: int, overlap: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, start, end, level``, in units, of the pieces of the given rows (in order), by the running ``total`` of the units' sizes."""
    level, ends = units.level, units.rows[rows + 1]
    start, reached = units.rows[rows].copy(), units.rows[rows].copy()
    cuts = np.zeros(len(level), np.int64)
    at = _parts_of(total, level, start, ends, capacity - overlap)
    cuts[at] = at
    last = np.maximum.accumulate(cuts)
    fill = lambda start, ends: last[np.minimum(np.searchsorted(total, total[start] + capacity, side="right") - 1, ends)]
    found = []
    while len(rows):
        end = fill(start, ends)
        stuck = end <= reached
        if stuck.any():  # the overlap leaves no room for the next part, which then is one unit
            start = np.where(stuck, reached, start)
            end = np.where(stuck, np.maximum(fill(start, ends), start + 1), end)
        done = end == ends
        found.append((rows, start, end, np.where(done, 0, level[end])))
        on = ~done
        rows, ends, start, end = rows[on], ends[on], start[on], end[on]
        back = np.searchsorted(total, total[end] - overlap, side="left")
        start, reached = np.clip(back, start + 1, end), end
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _exact(units: Units, text: memoryview, start: np.ndarray, end: np.ndarray, table: MergeTable) -> np.ndarray:
    """Tokens of each piece as it is encoded on its own."""
    # White space at a piece's end is one word there, even if it was two before the text that followed.
    blank = np.where(end > start, np.maximum(units.blank_from[end], start), end)
    inner_start = (units.word_start[start] < start) & (start < blank)
    inner_end = (units.word_start[end] < end) & (blank == end) & (end > start)
    lo = np.where(inner_start, np.minimum(units.word_end[start], blank), start)
    hi = np.where(inner_end, np.maximum(units.word_start[end], lo), blank)
    count = units.exact[np.maximum(hi, lo)] - units.exact[lo]
    cut = [(start, lo, np.flatnonzero(inner_start)), (hi, end, np.flatnonzero(hi < end))]
    pieces = [(i, int(f), int(t)) for first, last, of in cut for i, f, t in zip(of.tolist(), units.bytes[first[of]], units.bytes[last[of]])]
    if pieces:
        parts, known = [bytes(text[f:t]) for _, f, t in pieces], units.known
        if new := [x for x in dict.fromkeys(parts) if x not in known]:
            known.update(zip(new, np.diff(merge_words(pa.array(new, pa.binary()), table)[1]).tolist()))
        np.add.at(count, [i for i, _, _ in pieces], [known[x] for x in parts])
    return count


def _shared(units: Units, text: memoryview, row: np.ndarray, start: np.ndarray, end: np.ndarray, overlap: int, table: MergeTable) -> np.ndarray:
    """Tokens that each piece shares with the one before; starts that share too many move on in place."""
    after = np.flatnonzero(np.concatenate(([False], row[1:] == row[:-1])))
    shared = np.zeros(len(row), np.int64)
    rest = after
    while len(rest):
        shared[rest] = _exact(units, text, start[rest], end[rest - 1], table)
        rest = rest[shared[rest] > overlap]
        start[rest] += 1
    return shared


def _piece_batches(batches: Iterator[pa.RecordBatch], content: bytes, budgets: list[tuple[int, int, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = table_of(content)
    least = min(capacity for _, capacity, _ in budgets)
    for block, words in word_batches(batches, content):
        whole = np.concatenate(([0], np.cumsum(words.counts[words.which])))[words.rows]
        if not (np.diff(whole) > least).any():
            continue
        units = Units(words, table)
        lists = block.column(block.num_columns - 1)
        flat = lists.flatten()
        offsets = np.frombuffer(flat.buffers()[1], np.int32)
        text = memoryview(flat.buffers()[2])[offsets[flat.offset] : offsets[flat.offset + len(flat)]]
        for budget, capacity, overlap in budgets:
            pending, kept = np.flatnonzero(np.diff(whole) > capacity), []
            for total, limit in [*((units.tokens, capacity - less) for less in SHORTER), (units.bound, capacity)]:
                row, start, end, rank = cut_texts(units, total, limit, overlap, pending)
                order = np.lexsort((end, row))
                row, start, end, rank = (x[order] for x in (row, start, end, rank))
                shared = _shared(units, text, row, start, end, overlap, table)
                count = _exact(units, text, start, end, table)
                # Parts of a word may take more tokens together than apart: cut such texts again, shorter.
                pending = np.unique(row[count > capacity])
                fine = ~np.isin(row, pending)
                kept.append(tuple(x[fine] for x in (row, start, end, rank, count, shared)))
                if not len(pending):
                    break
            if not kept:
                continue
            row, start, end, rank, count, shared = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((end, row))
            row, start, end, rank, count, shared = (x[order] for x in (row, start, end, rank, count, shared))
            base = np.concatenate(([True], row[1:] != row[:-1]))
            number = np.arange(len(row)) - np.maximum.accumulate(np.where(base, np.arange(len(row)), 0))
            origin = units.chars[units.rows[row]]
            texts = pa.array([bytes(text[a:b]).decode() for a, b in zip(units.bytes[start].tolist(), units.bytes[end].tolist())], pa.string())
            columns = [
                pa.array(np.full(len(row), budget), pa.int32()), block.column(0).take(pa.array(row)), pa.array(number, pa.int32()),
                pa.array(units.chars[start] - origin), pa.array(units.chars[end] - origin), pa.array(count, pa.int32()),
                pa.array(shared, pa.int32()), pa.array(LEVELS).take(pa.array(rank)), texts,
            ]
            for lo in range(0, len(row), 4096):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 4096) for c in columns], schema.names)


def split_texts(
    documents: DataFrame,
    budgets: list[tuple[int, int, int]],
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str | None = None,
) -> DataFrame:
    """The pieces of every text above a capacity, for each ``(budget_id, capacity, overlap)``.

    Columns: ``budget_id, key, piece_no`` (from 0), ``char_start, char_end`` (in
    code points), ``n_tokens`` (of the piece encoded on its own, never above the
    capacity), ``shared_tokens`` (of the piece before, at most the overlap and
    short of it by less than one word or word part), ``ends_at`` (the break's
    rank) and ``piece`` (the text).  Pieces cover the whole text in order; a
    piece leaves out a part only if that doesn't fit.

    Texts within the capacity, null and empty ones give no rows; repeated keys
    are cut each on its own.  A capacity below 64 tokens, or an overlap above
    half of it, is refused.  Other columns are not read.
    """
    for _, capacity, overlap in budgets:
        if capacity < 2 * LONG_WORD or not 0 <= overlap <= capacity // 2:
            raise ValueError(f"capacity {capacity} with overlap {overlap}: at least {2 * LONG_WORD}, and at most half of it")
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(rank_file(tokenizer, folder).read_bytes())
    schema = T.StructType(
        [T.StructField("budget_id", T.IntegerType()), T.StructField(key, documents.schema[key].dataType), T.StructField("piece_no", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("char_start", "char_end")]
        + [T.StructField(c, T.IntegerType()) for c in ("n_tokens", "shared_tokens")]
        + [T.StructField(c, T.StringType()) for c in ("ends_at", "piece")]
    )
    names = pa.schema([(f.name, pa.null()) for f in schema])
    least = min((capacity for _, capacity, _ in budgets), default=0)
    # A text has no more tokens than bytes.
    rows = documents.where(F.octet_length(text) > least).select(F.col(key), words_of(F.col(text)).alias("_words"))
    return rows.mapInArrow(lambda batches: _piece_batches(batches, shared.value, budgets, names), schema)
