"""Encoding a text column with a public byte-level BPE tokenizer.

Spark splits each text into words (a JVM regular expression, inside the scan's
stage) and sends them to Python as Arrow lists.  There the words of a batch are
dictionary-encoded and only the distinct ones are merged (:mod:`.merges`).  The
plan has no shuffle, and its work is in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import ship
from .merges import MergeTable, merge_words, table_of

#: White space as the tokenizers' own libraries define it (Unicode White_Space).
_SPACE = r"\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The pattern of the rank files, letters first: only a quote can start a contraction.
WORDS = (
    rf" ?\p{{L}}+|'(?:[stmd]|re|ve|ll)| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Words handled at once in a task, once the distinct words of its Arrow batch (10,000 texts by Spark's default) are merged.
WORDS_AT_ONCE = 1 << 19


def rank_file(tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> Path:
    """The rank file of a tokenizer in ``folder``, or in the installed collection."""
    name = f"{tokenizer}.tiktoken"
    if folder is not None:
        return Path(folder) / name
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def words_of(text: Column) -> Column:
    """The text's words, in order; joined they are the text. Null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def spans(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``WORDS_AT_ONCE`` words each (a longer row alone)."""
    ends = np.asarray(lists.offsets)
    lo = 0
    while lo < len(lists):
        hi = int(np.searchsorted(ends, ends[lo] + WORDS_AT_ONCE, side="right")) - 1
        hi = min(len(lists), max(lo + 1, hi))
        yield lo, hi
        lo = hi


class Words:
    """The words of some rows: ``which`` of the distinct words each is, and their ids."""

    def __init__(self, lists: pa.ListArray, table: MergeTable):
        encoded = lists.flatten().dictionary_encode()
        #: Distinct words, and for each occurrence its number among them.
        self.distinct, self.which = encoded.dictionary, np.asarray(encoded.indices)
        self.ids, self.starts = merge_words(self.distinct, table)
        #: Tokens of each distinct word.
        self.counts = np.diff(self.starts)
        #: First occurrence of each row, and one past the last.
        self.rows = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        #: What users of the words derive from the distinct ones, once for all rows.
        self.derived: dict = {}

    def of_rows(self, lo: int, hi: int) -> Words:
        """The same for some of the rows; the distinct words stay shared."""
        some = copy(self)
        first, last = self.rows[lo], self.rows[hi]
        some.which, some.rows = self.which[first:last], self.rows[lo : hi + 1] - first
        return some


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[w]:starts[w + 1]]`` of each w, one after the other, and their offsets."""
    counts = np.diff(starts)[which]
    ends = np.concatenate(([0], np.cumsum(counts)))
    return flat[np.repeat(starts[which] - ends[:-1], counts) + np.arange(ends[-1])], ends


def word_batches(batches: Iterator[pa.RecordBatch], content: bytes) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Pieces of the batches of bounded size, each with its words (the last column).

    The distinct words of a whole batch are merged once.
    """
    table = table_of(content)
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        words = Words(lists, table)
        for lo, hi in spans(lists):
            yield batch.slice(lo, hi - lo), words.of_rows(lo, hi)


def _encode_batches(batches: Iterator[pa.RecordBatch], content: bytes) -> Iterator[pa.RecordBatch]:
    for rows, words in word_batches(batches, content):
        ids, ends = gather(words.ids, words.starts, words.which)
        column = pa.ListArray.from_arrays(pa.array(ends[words.rows].astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([rows.column(0), column], [rows.schema.names[0], "ids"])


def encode_corpus(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str | None = None,
) -> DataFrame:
    """One row ``(key, ids)`` for each row of ``documents``.

    ``ids`` are the tokenizer's ids of the whole text without special tokens;
    literals that look like special tokens are ordinary text.  Null, like
    empty, text gives an empty list, never null.  Rows are neither merged nor
    dropped: a repeated or null key comes out as often as it came in.  Other
    columns are left aside, so one named ``ids`` does no harm.
    """
    ship(documents.sparkSession)
    content = rank_file(tokenizer, folder).read_bytes()
    shared = documents.sparkSession.sparkContext.broadcast(content)
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    words = documents.select(F.col(key), words_of(F.col(text)).alias("_words"))
    return words.mapInArrow(lambda batches: _encode_batches(batches, shared.value), schema)
