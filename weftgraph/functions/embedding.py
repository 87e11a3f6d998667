"""A deterministic hashing embedder as Column expressions and relational steps.

Words and their character pairs are hashed into dimensions; a text's vector is
the sum of signed weights, scaled to length one.  All weights are multiples of a
half, so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import ship

# Fixed values of the public 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
DIMENSION = 256
#: The default embedder's name.
EMBEDDER = f"hash{DIMENSION}"


def fnv1a(text: Column) -> Column:
    """FNV-1a over the characters' codes, modulo 2**32."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    mask = F.lit(4294967295).cast("bigint")
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(mask))


def embedding_tokens(text: Column) -> Column:
    """Lower-case words, and again the words split at camel case of two or more characters."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    split = F.regexp_replace(text, r"(?<=[\p{L}\p{Nd}]\p{Ll})(?=\p{Lu})", " ")
    camel = F.filter(F.transform(F.regexp_extract_all(split, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), F.lower), lambda w: F.length(w) > 1)
    return F.concat(plain, camel)


def weighted_parts(text: Column, dimension: int = DIMENSION) -> Column:
    """``array<(dim, w)>``: each word, and each pair of characters of it, with its dimension and signed weight."""
    words = embedding_tokens(text)
    pairs = F.flatten(
        F.transform(F.filter(words, lambda t: F.length(t) > 1), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
    )
    of = lambda h, w: F.struct((h % dimension).cast("int").alias("dim"), w.alias("w"))
    whole = F.transform(F.transform(words, fnv1a), lambda h: of(h, F.when(h >= 2147483648, -1.0).otherwise(1.0)))
    return F.concat(whole, F.transform(F.transform(pairs, fnv1a), lambda h: of(h, F.when(h % 2 == 1, -0.5).otherwise(0.5))))


def _vector_batches(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        rows = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        parts = lists.flatten()
        dense = np.zeros((len(lists), dimension))
        np.add.at(dense, (rows, np.asarray(parts.field(0))), np.asarray(parts.field(1)))
        norms = np.sqrt((dense * dense).sum(axis=1))
        dense /= np.where(norms > 0, norms, 1)[:, None]
        column = pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, dimension, dtype=np.int32)), pa.array(dense.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], "vector"])


def vectors(rows: DataFrame, keys: list[str], text: str, dimension: int = DIMENSION) -> DataFrame:
    """``(*keys, vector)``: each row's text as a vector of length one, zero for a wordless text; null texts have none.

    All is folded within the row, so nothing is shuffled.
    """
    ship(rows.sparkSession)
    parts = rows.where(F.col(text).isNotNull()).select(*keys, weighted_parts(F.col(text), dimension).alias("_parts"))
    schema = T.StructType([*(parts.schema[k] for k in keys), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return parts.mapInArrow(lambda batches: _vector_batches(batches, dimension), schema)


def hash_vectors(rows: DataFrame) -> DataFrame:
    """``(key, text)`` to ``(key, vector)``: the default embedder."""
    return vectors(rows, ["key"], "text")


def sparse_embedding(rows: DataFrame, keys: list[str], text: str, dimension: int = DIMENSION) -> DataFrame:
    """``(*keys, dim, weight)``: the dimensions of :func:`vectors` that aren't zero.

    Null and wordless texts have no rows. Keys are one text each.
    """
    return vectors(rows, keys, text, dimension).select(*keys, F.posexplode("vector").alias("dim", "weight")).where("weight <> 0")
