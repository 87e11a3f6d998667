"""Lexical and vector search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import stripped
from ..functions.text import query_tokens
from ..plans.runtime import ship

#: Queries, and searched rows, that meet in one group, about.
QUERY_BLOCK, CHUNK = 4096, 8192
#: Bonuses for names equal to, containing and starting with the query, and the least score of high confidence. Fixed values of the graph's model.
EQUAL, INSIDE, PREFIX, HIGH = 1.0, 0.5, 0.25, 1.0


def lexical_score(query: Column, tokens: Column, name: Column, haystack: Column) -> Column:
    """Share of the query's words found, plus bonuses for the name: equal 1, containing 0.5, prefix 0.25. Null: no hit."""
    hits = F.size(F.filter(tokens, lambda t: F.contains(haystack, t)))
    inside = F.contains(name, query)
    bonus = F.when(name == query, EQUAL).otherwise(0.0) + F.when(inside, INSIDE).otherwise(0.0) + F.when(F.startswith(name, query), PREFIX).otherwise(0.0)
    return F.when((hits > 0) | inside, hits.cast("double") / F.size(tokens) + bonus)


def _searched(nodes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """The nodes that aren't stale with ``_name`` and ``_text``, what is searched, in lower case; summary and signature where the nodes have them."""
    rows = nodes.where(~F.coalesce("stale", F.lit(False)))
    if labels and not rows.where(F.lower("label").isin(*(x.lower() for x in labels))).isEmpty():
        rows = rows.where(F.lower("label").isin(*(x.lower() for x in labels)))
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("name", "key", "doc", "summary", "signature") if c in nodes.columns)))
    return rows.select("label", "name", "key", "path", F.lower(F.coalesce("name", F.lit(""))).alias("_name"), text.alias("_text"))


def candidates(nodes: DataFrame, queries: list[str], k: int = 10, labels: tuple[str, ...] = ()) -> DataFrame:
    """``(query, label, name, key, path, score)``: each query's best ``k`` nodes by words found.

    One scan serves all queries: each node is scored for every query inside the
    scan's stage, and only hits are ranked.  Stale nodes are left out; labels
    that match none of the nodes' labels count as no filter.  A blank query
    finds nothing.  Many queries go into :func:`candidates_of`.
    """
    if not (queries := [q for q in dict.fromkeys(queries) if q.strip()]):
        raise ValueError("no query")
    rows = _searched(nodes, labels)
    scored = F.array(*(F.struct(F.lit(q).alias("query"), lexical_score(F.lit(q.strip().lower()), query_tokens(F.lit(q)), F.col("_name"), F.col("_text")).alias("score")) for q in queries))
    hits = rows.select("label", "name", "key", "path", F.explode(F.filter(scored, lambda x: x["score"].isNotNull())).alias("_hit")).select("_hit.query", "label", "name", "key", "path", "_hit.score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "label", "key")
    return hits.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")


def _meet(rows: DataFrame, key: list[str], queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, block: int, chunk: int) -> DataFrame:
    """``run`` over every chunk of rows with every block of queries (id, ...).

    Both are cut by hashes of their keys into parts of bounded size; rows are
    shuffled once for each block and queries once for each chunk.
    """
    ship(rows.sparkSession)
    blocks = max(1, -(-queries.count() // block))
    chunks = max(rows.sparkSession.sparkContext.defaultParallelism // blocks, -(-rows.count() // chunk), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_c", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int")).withColumn("_b", every(blocks))
    right = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_c", every(chunks))
    return left.groupBy("_c", "_b").cogroup(right.groupBy("_c", "_b")).applyInArrow(run, schema)


def _candidates_in(rows: pa.Table, queries: pa.Table, k: int, names: list[str]) -> pa.Table:
    """The best ``k`` of some rows (label, name, key, path, lower-case name and text) for each query (id, text, words)."""
    ids, texts, tokens = (queries.column(c).to_pylist() for c in ("id", "q", "t"))
    shown = [rows.column(c).combine_chunks() for c in ("label", "name", "key", "path")]
    name, text = rows.column("_name").combine_chunks(), rows.column("_text").combine_chunks()
    words: dict[str, list[int]] = {}
    for q, own in enumerate(tokens):
        for t in own:
            words.setdefault(t, []).append(q)
    # The rank of each row among the chunk's by label and key; null first.
    order = np.asarray(pc.sort_indices(pa.table({"l": shown[0], "k": shown[2]}), [("l", "ascending"), ("k", "ascending")], null_placement="at_start"))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    where = lambda x: np.flatnonzero(np.asarray(x.to_numpy(zero_copy_only=False), bool))
    hits: dict[int, list[np.ndarray]] = {}
    for t, own in words.items():
        found = where(pc.match_substring(text, t))
        if len(found):
            for q in own:
                hits.setdefault(q, []).append(found)
    longest = (pc.max(pc.binary_length(name)).as_py() or 0) if rows.num_rows else 0
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, query in enumerate(texts):
        score = np.zeros(rows.num_rows)
        if q in hits:
            score = np.bincount(np.concatenate(hits[q]), minlength=rows.num_rows) / len(tokens[q])
        if len(query.encode()) <= longest:
            inside = where(pc.match_substring(name, query))
            own = name.take(pa.array(inside))
            score[inside] += EQUAL * np.asarray(pc.equal(own, query).to_numpy(zero_copy_only=False), float) + INSIDE + PREFIX * np.asarray(pc.starts_with(own, query).to_numpy(zero_copy_only=False), float)
        picked = np.flatnonzero(score)
        if len(picked) > k:
            picked = picked[score[picked] >= np.partition(score[picked], len(picked) - k)[len(picked) - k]]
        picked = picked[np.lexsort((rank[picked], -score[picked]))[:k]]
        out.append((np.full(len(picked), ids[q]), picked, score[picked]))
    asked, at, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(asked, pa.int64()), *(c.take(pa.array(at, pa.int64())) for c in shown), pa.array(score)], names)


def candidates_of(
    nodes: DataFrame, queries: DataFrame, k: int = 10, labels: tuple[str, ...] = (), key: str = "query_id", text: str = "query", block: int = QUERY_BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """``(query_id, label, name, key, path, score)`` as by :func:`candidates`, for the queries of a DataFrame.

    Every chunk of nodes meets every block of queries; in a group each word is
    looked for once for all queries that hold it, and only its best ``k`` of a
    query are shuffled.  Null and blank queries find nothing; keys are unique
    numbers.
    """
    rows = _searched(nodes, labels)
    schema = T.StructType([T.StructField("query_id", T.LongType()), *(T.StructField(c, rows.schema[c].dataType) for c in ("label", "name", "key", "path")), T.StructField("score", T.DoubleType())])
    plain = stripped(F.col(text))
    held = queries.where(F.coalesce(plain, F.lit("")) != "").select(F.col(key).cast("long").alias("id"), F.lower(plain).alias("q"), query_tokens(plain).alias("t"))
    names = schema.names
    found = _meet(rows, ["label", "key"], held, lambda some, asked: _candidates_in(some, asked, k, names), schema, block, chunk)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "key")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")


def confidence_tiers(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, tier, top_score, hit, retry_english)`` of every query: high from a score of 1, else low, or none."""
    top = found.groupBy("query").agg(F.max("score").alias("top_score"))
    tier = F.when(F.col("top_score") >= HIGH, "high").when(F.col("top_score").isNotNull(), "low").otherwise("none")
    return queries.select("query").distinct().join(top, "query", "left").select(
        "query", tier.alias("tier"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), (tier == "high").alias("hit"),
        ((tier != "high") & F.col("query").rlike(r"[^\x00-\x7F]")).alias("retry_english"),
    )


def _unit(vectors: pa.Array, at: np.ndarray) -> np.ndarray:
    """The vectors at some places, scaled to length one."""
    some = vectors.take(pa.array(at))
    rows = np.asarray(some.flatten(), dtype=np.float64).reshape(len(at), -1)
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.where(norms > 1e-9, norms, 1)[:, None]


def _nearest_in(rows: pa.Table, queries: pa.Table, k: int, names: list[str]) -> pa.Table:
    """Of some rows (key, label, vector) the nearest ``k`` of each label to each query (id, v), and ties of the last place."""
    keys, labels, vectors = (rows.column(i).combine_chunks() for i in range(3))
    held = np.flatnonzero(np.asarray(vectors.is_valid()))
    ids = np.asarray(queries.column("id"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(held) and len(ids):
        # Rounded, so that equal vectors are equally far whatever the order of the products' sums.
        near = np.round(_unit(vectors, held) @ _unit(queries.column("v").combine_chunks(), np.arange(len(ids))).T, 9)
        group = np.asarray(labels.take(pa.array(held)).dictionary_encode().indices.fill_null(-1))
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            some = near[own]
            least = np.partition(some, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(len(ids), -np.inf)
            row, query = np.nonzero(some >= least)
            out.append((ids[query], held[own[row]], 1.0 - some[row, query]))
    asked, at, distance = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(asked, pa.int64()), keys.take(pa.array(at)), labels.take(pa.array(at)), pa.array(distance)], names)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    block: int = QUERY_BLOCK, chunk: int = CHUNK, query_id: str | None = None,
) -> DataFrame:
    """``(query_id, key, label, distance)``: exact cosine search, the best ``k`` per label, then the best ``k`` of all.

    Every chunk of vectors meets every block of queries as one product of
    matrices, and only a group's best are shuffled.  Vectors and queries that
    are null are left out; distances are rounded to nine places, and equal ones
    ranked by label and key.  Query
    ids (``query_id``, or else the key) are unique numbers.
    """
    schema = T.StructType([T.StructField("query_id", T.LongType()), vectors.schema[key], vectors.schema[label], T.StructField("distance", T.DoubleType())])
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id or key).cast("long").alias("id"), F.col(vector).alias("v"))
    names = schema.names
    found = _meet(vectors.select(key, label, vector), [key], asked, lambda some, own: _nearest_in(some, own, k, names), schema, block, chunk)
    per_label = Window.partitionBy("query_id", label).orderBy("distance", key)
    overall = Window.partitionBy("query_id").orderBy("distance", label, key)
    found = found.withColumn("_at", F.row_number().over(per_label)).where(F.col("_at") <= k)
    return found.withColumn("_at", F.row_number().over(overall)).where(F.col("_at") <= k).drop("_at")


def search_nodes(queries: DataFrame, vectors: DataFrame, nodes: DataFrame, k: int = 10, labels: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, label, name, key, path, distance)``: for queries (query_id, vector) the nearest nodes that aren't stale.

    ``vectors`` has ``key, vector``; labels match in any case, and unknown ones find nothing.
    """
    live = nodes.where(~F.coalesce("stale", F.lit(False)))
    if labels:
        live = live.where(F.lower("label").isin(*(x.lower() for x in labels)))
    live = live.select("label", "name", "key", "path")
    held = vectors.select("key", "vector").join(live.select("label", "key"), "key")
    found = nearest(queries, held, k, vector="vector", key="key", query_id="query_id")
    return found.join(live, ["label", "key"]).select("query_id", "label", "name", "key", "path", "distance")


def cached_vectors(texts: DataFrame, vectors: DataFrame, embedder: str) -> tuple[DataFrame, DataFrame]:
    """Of stored ``vectors`` (key, embedder, embed_hash, vector) those that still hold for ``texts`` (key, embed_text), and the texts to embed, with ``embed_hash``.

    A vector holds if this embedder made it of this text; vectors of other texts and embedders are dropped.
    """
    hashed = texts.groupBy("key").agg(F.min("embed_text").alias("embed_text")).withColumn("embed_hash", F.sha1("embed_text"))
    own = vectors.where(F.col("embedder") == embedder)
    return own.join(hashed.select("key", "embed_hash"), ["key", "embed_hash"], "left_semi").select("key", "embedder", "embed_hash", "vector"), hashed.join(own.select("key", "embed_hash"), ["key", "embed_hash"], "left_anti")
