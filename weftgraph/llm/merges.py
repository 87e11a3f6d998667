"""Byte-pair merging of distinct words with a contiguous rank array.

A word is held as the ids of its parts and, beside them, the rank of every
adjacent pair.  The smallest rank is found by a scan, its boundary is deleted
and the two neighbouring ranks are refreshed, until no pair has a rank.  Words
of near byte lengths share one matrix, the shorter ones filled up with ``PAD``,
which pairs with nothing: each step deletes one boundary of each row, so the
rows stay aligned and every step is a few array operations.

Words longer than ``SHORT`` bytes would make the repeated scan quadratic; they
keep the same ranks in a heap over a linked list, which gives the same merges.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Longest word, in bytes, that is merged by scanning.
SHORT = 256
#: Longest words, in bytes, of each matrix of words: any length up to 16, then in growing steps.
WIDTHS = (*range(1, 17), 20, 24, 32, 48, 64, 96, 128, 192, SHORT)
#: Fills up rows behind a word's end; no token has this id.
PAD = np.int32(2**31 - 2)
#: Cells of one matrix of words; bounds the memory of a step.
CELLS = 1 << 18
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Ranks of adjacent pairs of token ids, in one open-addressing table."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks single bytes: {missing[:5]}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        bits = max(self.BITS, int(len(keys) * 4).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self._values = np.full(1 << bits, NONE, dtype=np.int32)
        self._place(keys, np.array(merged, dtype=np.int32))
        #: Ranks of two single bytes, at 256 * left + right.
        self.byte_pairs = self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self._shift).astype(np.int64)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        empty, slot = self._keys[0], self._slot(keys)
        while len(keys):
            free = self._keys[slot] == empty
            _, first = np.unique(slot, return_index=True)
            now = first[free[first]]
            self._keys[slot[now]], self._values[slot[now]] = keys[now], values[now]
            rest = np.ones(len(keys), dtype=bool)
            rest[now] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self._mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where the pair isn't a token."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        seen = self._keys[slot]
        out = self._values[slot]
        empty = np.uint64(2**64 - 1)
        other = np.flatnonzero((seen != keys) & (seen != empty))
        out[seen != keys] = NONE
        while len(other):
            slot = (slot if len(slot) == len(other) else slot[other]) + 1 & self._mask
            wanted, seen = keys[other], self._keys[slot]
            hit = seen == wanted
            out[other[hit]] = self._values[slot[hit]]
            on = ~hit & (seen != empty)
            other, slot = other[on], slot[on]
        return out.reshape(shape)


def _merge_rows(words: np.ndarray, sizes: np.ndarray, table: MergeTable):
    """Merge short words, a row of bytes each of which the first ``sizes`` count; yields (row numbers, their final parts, how many count)."""
    rows, sizes = np.arange(len(words)), sizes.copy()
    ids = table.byte_ids[words]
    ranks = table.byte_pairs[words[:, :-1].astype(np.uint16) << 8 | words[:, 1:]]
    behind = np.arange(words.shape[1]) >= sizes[:, None]
    ids[behind], ranks[behind[:, 1:]] = PAD, NONE
    while ids.shape[1] > 1:
        at = ranks.argmin(axis=1)
        least = ranks[np.arange(len(rows)), at]
        done = least == NONE
        if done.any():
            yield rows[done], ids[done], sizes[done]
            on = ~done
            rows, ids, ranks, at, least, sizes = rows[on], ids[on], ranks[on], at[on], least[on], sizes[on]
            if not len(rows):
                return
        n, every = ids.shape[1], np.arange(len(rows))
        keep = np.ones(ids.shape, dtype=bool)
        keep[every, at + 1] = False
        ids = ids[keep].reshape(len(rows), n - 1)
        ids[every, at] = least
        sizes -= 1
        if n == 2:
            break
        keep = np.ones(ranks.shape, dtype=bool)
        keep[every, at] = False
        ranks = ranks[keep].reshape(len(rows), n - 2)
        before = np.flatnonzero(at > 0)
        ranks[before, at[before] - 1] = table.ranks(ids[before, at[before] - 1], ids[before, at[before]])
        after = np.flatnonzero(at < n - 2)
        ranks[after, at[after]] = table.ranks(ids[after, at[after]], ids[after, at[after] + 1])
    yield rows, ids, sizes


def _merge_long(data: np.ndarray, table: MergeTable) -> np.ndarray:
    ids = table.byte_ids[data]
    first = table.ranks(ids[:-1], ids[1:])
    ids = ids.tolist()
    n = len(ids)
    following, previous, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
    current = first.tolist() + [int(NONE)]
    heapq.heapify(heap)
    keys, values, mask, shift = table._keys, table._values, table._mask, int(table._shift)

    def rank(a: int, b: int) -> int:
        key = (a << 32) | b
        slot = ((key * int(_MIX)) & (2**64 - 1)) >> shift
        while (seen := int(keys[slot])) != key:
            if seen == 2**64 - 1:
                return int(NONE)
            slot = (slot + 1) & mask
        return int(values[slot])

    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or current[i] != r:
            continue
        j = following[i]
        ids[i], alive[j] = r, False
        following[i] = k = following[j]
        if k < n:
            previous[k] = i
            current[i] = rank(r, ids[k])
            if current[i] != NONE:
                heapq.heappush(heap, (current[i], i))
        else:
            current[i] = int(NONE)
        if (h := previous[i]) >= 0:
            current[h] = rank(ids[h], r)
            if current[h] != NONE:
                heapq.heappush(heap, (current[h], h))
    return np.array([x for x, on in zip(ids, alive) if on], dtype=np.int32)


def merge_words(words: pa.Array, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each word: all ids one after the other, and n + 1 offsets."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(lengths, kind="stable")
    widths = [w for w in WIDTHS if w < SHORT] + [SHORT]
    cuts = np.searchsorted(lengths[order], [0, *widths], side="right")
    for width, first, last in zip(widths, cuts, cuts[1:]):
        step = max(1, CELLS // width)
        for lo in range(first, last, step):
            some = order[lo : min(lo + step, last)]
            place = np.arange(width)
            spelt = data[np.minimum(offsets[some][:, None] + place, len(data) - 1)]
            found += [(some[r], parts, sizes) for r, parts, sizes in _merge_rows(spelt, lengths[some], table)]
    for row in order[cuts[-1] :]:
        parts = _merge_long(data[offsets[row] : offsets[row + 1]], table)
        found.append((np.array([row]), parts[None, :], np.array([len(parts)])))
    counts = np.zeros(n, np.int64)
    for rows, _, sizes in found:
        counts[rows] = sizes
    starts = np.concatenate(([0], np.cumsum(counts)))
    flat = np.empty(starts[-1], np.int32)
    for rows, parts, sizes in found:
        place = np.arange(parts.shape[1])
        held = place < sizes[:, None]
        flat[(starts[rows][:, None] + place)[held]] = parts[held]
    return flat, starts


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


@lru_cache(maxsize=4)
def table_of(content: bytes) -> MergeTable:
    """The table of a rank file, built once in each Python worker."""
    return MergeTable(read_ranks(content))
