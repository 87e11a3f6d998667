"""Filling containers with texts under several limits at once: vector bin packing.

A container has room for a number of tokens, of segments and of loss-bearing
tokens (those a model is trained to produce).  In each block a container is
opened with the largest item left and then takes, again and again, the item
that fits all limits and whose demands have the largest dot product with the
room that is left, so that items of opposite shape meet.

Texts are sized where they are scanned (:mod:`.tokens`).  Their sizes, not the
texts, are shuffled into blocks of bounded size by a hash of the key and part,
and each block is packed by one task; at most one container in a block is left
part empty.  A block that null or repeated keys crowd is cut by the rows' places
in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import Scratch, ship
from .tokens import Words, rank_file, word_batches, words_of

#: Texts in a block, about, and how many times as many make a block crowded.
BLOCK, CROWDED = 2048, 4
#: Crowded blocks that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000
#: Which tokens bear loss: all, none (a prompt), or those of some speakers' turns.
ALL, NOTHING, TURNS = 0, 1, 2


def limits(capacity: int, segments: int | None = None, loss: int | None = None) -> tuple[int, int, int]:
    """Tokens, segments (by default one for each 16 tokens, 8 at least) and loss-bearing tokens (63/64 of the tokens)."""
    return capacity, segments or max(8, capacity // 16), loss or capacity - capacity // 64


def _bears_loss(words: Words, mode: np.ndarray, roles: tuple[str, ...]) -> np.ndarray:
    """Whether each word bears loss. A turn begins at ``name:`` at the start of a line and lasts to the next one.

    Case, blanks and format characters make no other name; blanks before a name that isn't a role's begin no turn, though.
    """
    of_row = np.repeat(mode, np.diff(words.rows))
    bears = of_row == ALL
    m = len(words.which)
    if not (of_row == TURNS).any():
        return bears
    if not words.derived:
        strip = pc.utf8_lower(pc.replace_substring_regex(words.distinct, r"[\s\p{Z}\p{Cf}]+", ""))
        matches = lambda values, pattern: np.asarray(pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False), bool)
        words.derived.update(
            name=matches(words.distinct, r"^\pL+$"),
            colon=matches(words.distinct, "^:"),
            after=matches(strip, "^:"),
            line=matches(words.distinct, r"[\n\r]"),
            format=matches(words.distinct, r"^\p{Cf}+$"),
            blank=matches(words.distinct, r"^[\s\p{Z}\p{Cf}]+$"),
            role=np.asarray(pc.is_in(strip, pa.array([r.lower() for r in roles], strip.type)).to_numpy(zero_copy_only=False), bool),
        )
    name, colon, after, line, skipped, blank, role = (words.derived[x][words.which] for x in ("name", "colon", "after", "line", "format", "blank", "role"))
    first = np.zeros(m, bool)
    first[words.rows[:-1][words.rows[:-1] < m]] = True
    at, begins = np.arange(m), first | np.append(False, line[:-1])
    begun = np.maximum.accumulate(np.where(begins, at, -1))

    def starts(skip: np.ndarray) -> np.ndarray:
        """Whether nothing but words to skip lies between the start of its line and each word."""
        return begun > np.append(-1, np.maximum.accumulate(np.where(skip, -1, at))[:-1])

    role &= starts(blank & ~line) & np.append(after[1:], False)
    opens = (role | (starts(skipped) & name & np.append(colon[1:], False))) & ~np.append(first[1:], False)
    at = np.maximum.accumulate(np.where(first | opens, at, 0))
    return np.where(of_row == TURNS, (opens & role)[at], bears)


def _cut(tokens: np.ndarray, loss: np.ndarray, capacity: int, most_loss: int) -> list[tuple[int, int, int]]:
    """``start, tokens, loss-bearing tokens`` of the parts of one text, from running totals at its words."""
    parts, start, total = [], 0, int(tokens[-1])
    while start < total or not parts:
        borne = np.interp(start, tokens, loss)
        end = min(total, start + capacity)
        if np.interp(end, tokens, loss) - borne > most_loss:
            # Within a word all tokens bear loss or none do, so the totals are joined by straight lines.
            k = int(np.searchsorted(loss, borne + most_loss, side="right"))
            end = int(tokens[k - 1] + borne + most_loss - loss[k - 1])
        parts.append((start, end - start, int(round(np.interp(end, tokens, loss) - borne))))
        start = end
    return parts


def _item_batches(batches: Iterator[pa.RecordBatch], content: bytes, budgets: list[tuple[int, int, int, int]], roles: tuple[str, ...], names: list[str], whole_texts: bool) -> Iterator[pa.RecordBatch]:
    seen = TaskContext.get().partitionId() << 40
    for block, words in word_batches(batches, content):
        mode = np.asarray(block.column(1)).astype(np.int64)
        counts = words.counts[words.which]
        bears = _bears_loss(words, mode, roles)
        tokens = np.concatenate(([0], np.cumsum(counts)))
        loss = np.concatenate(([0], np.cumsum(counts * bears)))
        whole, borne = np.diff(tokens[words.rows]), np.diff(loss[words.rows])
        for budget, capacity, _, most_loss in budgets:
            step = np.where(mode == NOTHING, capacity, min(capacity, most_loss))
            above = (whole > capacity) | ((borne > most_loss) & (not whole_texts))
            mixed = np.flatnonzero((mode == TURNS) & above)
            number = np.where(above, np.maximum(1, -(-whole // step)), 1)
            number[(mode == TURNS)] = 1
            number[mixed] = 0
            row = np.repeat(np.arange(len(whole)), number)
            part = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = part * step[row]
            size = np.where(above[row] & (mode[row] != TURNS), np.minimum(whole[row] - start, step[row]), whole[row])
            bearing = np.where(mode[row] == TURNS, borne[row], np.where(mode[row] == ALL, size, 0))
            rows = [row, part, start, size, bearing]
            more = []
            for r in mixed:
                a, b = words.rows[r], words.rows[r + 1] + 1
                more += [(r, i, *x) for i, x in enumerate(_cut(tokens[a:b] - tokens[a], loss[a:b] - loss[a], capacity, most_loss))]
            if more:
                rows = [np.concatenate(x) for x in zip(rows, np.array(more, np.int64).T)]
            columns = [pa.array(np.full(len(rows[0]), budget), pa.int32()), block.column(0).take(pa.array(rows[0]))]
            columns += [pa.array(x, pa.int32()) for x in rows[1:]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seen + rows[0], pa.int64())], names)
        seen += block.num_rows


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, most_loss: int) -> np.ndarray:
    """The container of each item, by the dot-product heuristic. Every item fits an empty container, or bears too much loss and gets one alone."""
    order = np.lexsort((-loss, -tokens))
    t, bear = tokens[order].astype(np.float64), loss[order].astype(np.float64)
    at = np.arange(len(order))
    alive = np.ones(len(order), bool)
    container = np.empty(len(order), np.int64)
    # Each limit counts by how scarce it is over the block.
    scarce_t, scarce_l = t.sum() / capacity**3, bear.sum() / max(1, most_loss) ** 3
    falling = -t
    number, front, left = 0, 0, len(order)
    while left:
        while not alive[front]:
            front += 1
        room_t, room_l, room_s = capacity, most_loss, segments
        pick = front
        while True:
            alive[pick] = False
            container[at[pick]] = number
            left -= 1
            room_t, room_l, room_s = room_t - t[pick], room_l - bear[pick], room_s - 1
            if not left or not room_s:
                break
            lo = max(front, int(np.searchsorted(falling, -room_t, side="left")))
            fits = np.flatnonzero(alive[lo:] & (bear[lo:] <= room_l))
            if not len(fits):
                break
            fits += lo
            pick = fits[np.argmax(t[fits] * (room_t * scarce_t) + bear[fits] * (room_l * scarce_l))]
        number += 1
        if left < len(t) // 2 and len(t) > 64:
            t, bear, at, falling = t[alive], bear[alive], at[alive], falling[alive]
            alive, front = np.ones(left, bool), 0
    out = np.empty(len(order), np.int64)
    out[order] = container
    return out


def _packer(key: str, budgets: dict[int, tuple[int, int, int]]):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values([key, "place", "part_no"], kind="stable", na_position="first")
        number = pack(items["n_tokens"].to_numpy(), items["loss_tokens"].to_numpy(), *budgets[int(items["budget_id"].iat[0])])
        return items.assign(container_id=(items["block"].to_numpy() << 24) | number).drop(columns=["block", "place"])

    return run


def pack_texts(
    documents: DataFrame,
    budgets: dict[int, tuple[int, int, int]],
    loss: Column | None = None,
    roles: tuple[str, ...] = ("agent",),
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str | None = None,
    block: int = BLOCK,
    whole_texts: bool = False,
) -> DataFrame:
    """Each text's container, for each budget id with its :func:`limits`.

    Columns: ``budget_id, container_id, key, part_no, token_start, n_tokens,
    loss_tokens``.  A container keeps all three limits.  A text is one part
    unless it alone exceeds the tokens or loss-bearing tokens of a container;
    then its parts follow each other by ``token_start``.  With ``whole_texts``
    only the tokens split a text: one that fits them, but bears more loss than
    a container takes, stays whole in a container of its own.  ``loss`` says which
    tokens of a row bear loss (``ALL``, the default and for null, ``NOTHING``
    or ``TURNS`` of the ``roles``).

    Null and empty texts are items of no tokens and get a container, too; equal
    texts are packed apart; an empty table gives no rows.  Repeated keys come
    out as often as they came in.  Other columns are not read.
    """
    for tokens, segments, most in budgets.values():
        if tokens < 1 or segments < 1 or most < 1:
            raise ValueError(f"limits must be positive: {budgets}")
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(rank_file(tokenizer, folder).read_bytes())
    kind = documents.schema[key].dataType
    numbers = [T.StructField(c, T.IntegerType()) for c in ("part_no", "token_start", "n_tokens", "loss_tokens")]
    fields = [T.StructField("budget_id", T.IntegerType()), T.StructField(key, kind), *numbers]
    blocks = max(1, -(-documents.count() // block))
    mode = F.coalesce(loss, F.lit(ALL)) if loss is not None else F.lit(ALL)
    rows = documents.select(F.col(key), mode.cast("int").alias("_mode"), words_of(F.col(text)).alias("_words"))
    flat, names = [(b, *x) for b, x in budgets.items()], [*(f.name for f in fields), "place"]
    items = rows.mapInArrow(lambda batches: _item_batches(batches, shared.value, flat, roles, names, whole_texts), T.StructType([*fields, T.StructField("place", T.LongType())]))
    items = Scratch(spark, "items").write(items.withColumn("block", F.pmod(F.xxhash64(key, "part_no"), F.lit(blocks))))
    sizes = items.groupBy("budget_id", "block").agg(F.count("*").alias("n"))
    crowded = Scratch(spark, "crowded").write(sizes.where(F.col("n") > CROWDED * block).select("budget_id", "block", F.ceil(F.col("n") / block).cast("long").alias("parts")))
    if number := crowded.count():
        items = items.join(F.broadcast(crowded) if number <= BROADCAST_ROWS else crowded, ["budget_id", "block"], "left")
        # Blocks beyond the hashed ones: each crowded block has its own range of numbers.
        part = F.pmod(F.xxhash64("place", "part_no"), F.col("parts"))
        items = items.withColumn("block", F.when(F.col("parts").isNull(), F.col("block")).otherwise(F.lit(blocks) + part * blocks + F.col("block"))).drop("parts")
    return items.groupBy("budget_id", "block").applyInPandas(
        _packer(key, budgets), T.StructType([*fields, T.StructField("container_id", T.LongType())])
    ).select("budget_id", "container_id", key, *(f.name for f in numbers))
