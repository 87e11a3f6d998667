"""What changed between full snapshots: invertible Bloom lookup tables.

Keys are hashed into buckets of bounded size.  Each bucket of each snapshot is
summed into a small table of cells (count and XORs of key, value and digest);
the table of the snapshot before is subtracted, so that only differing
(key, value) pairs are left, and these are peeled out.  A bucket whose table is
too small to peel is tried again with larger tables, and what then still fails
is compared row by row, so the result is always whole.

The rows are shuffled once, by bucket, as fixed-width numbers.  A project that
holds most of the rows spreads over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_longs, key_pair
from ..plans.runtime import Scratch, ship

#: Rows of one snapshot in a bucket, about, and of how many such snapshots in all, at most.
BUCKET_ROWS, BUCKET_SNAPSHOTS = 8192, 32
#: Cells for each row of a bucket, round by round; a table peels up to about 0.8 differing pairs a cell.
CELLS_PER_ROW = (0.6, 1.5, 3.0)
#: Delivered snapshots that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def relative_path(path: Column) -> Column:
    """A path as stored: forward slashes, relative to the project, case kept.

    ``./`` at the start and doubled slashes go; of an absolute path only what
    follows the project's folder stays (from the first ``Assets/`` or
    ``Packages/``).  Null stays null.
    """
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), r"/(\./)*/+|/(\./)+", "/")
    bare = F.regexp_replace(slashed, r"^(\./)+", "")
    inside = F.regexp_extract(bare, r"^(?:[A-Za-z]:)?/.*?((?:Assets|Packages)/.*)$", 1)
    plain = path.startswith("Assets/") & ~path.contains("\\") & ~path.contains("//") & ~path.contains("/./")
    return F.when(plain, path).when(F.length(inside) > 0, inside).otherwise(bare)


def _positions(h: np.ndarray, third: int) -> list[np.ndarray]:
    u = h.view(np.uint64)
    part = np.uint64((1 << 21) - 1)
    return [((u >> np.uint64(21 * j) & part) % np.uint64(third)).astype(np.int64) + j * third for j in range(3)]


def _position_columns(h: Column, third: int) -> Column:
    part = (1 << 21) - 1
    return F.array(*((F.shiftrightunsigned(h, 21 * j).bitwiseAND(F.lit(part)) % third + j * third).cast("int") for j in range(3)))


def peel(cells: pd.DataFrame, third: int) -> tuple[dict[str, np.ndarray], bool]:
    """The pairs left in a subtracted table with their signs, and whether the table came out empty.

    ``cells`` has ``cell, n, k1, k2, v, h``.  The three thirds of the table sum
    the same pairs, so their XORs must agree with each other and with the
    recovered pairs; else the table counts as failed.
    """
    table = {c: np.zeros(3 * third, np.int64) for c in ("n", "k1", "k2", "v", "h")}
    at = cells["cell"].to_numpy(np.int64)
    for c, into in table.items():
        into[at] = cells[c].to_numpy(np.int64)
    digests = [int(np.bitwise_xor.reduce(table["h"][j * third : (j + 1) * third])) for j in range(3)]
    found: list[list[np.ndarray]] = []
    for _ in range(3 * third + 1):
        pure = np.flatnonzero(np.abs(table["n"]) == 1)
        pure = pure[hash_longs(table["k1"][pure], table["k2"][pure], table["v"][pure]) == table["h"][pure]]
        if not len(pure):
            break
        _, once = np.unique(table["h"][pure], return_index=True)
        pure = pure[once]
        sign, *rest = (table[c][pure].copy() for c in ("n", "k1", "k2", "v", "h"))
        for place in _positions(rest[-1], third):
            np.subtract.at(table["n"], place, sign)
            for c, values in zip(("k1", "k2", "v", "h"), rest):
                np.bitwise_xor.at(table[c], place, values)
        found.append([sign, *rest])
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
    out = dict(zip(("sign", "k1", "k2", "v", "h"), columns))
    digest = int(np.bitwise_xor.reduce(out["h"])) if len(out["h"]) else 0
    whole = not any(x.any() for x in table.values()) and all(d == digest for d in digests)
    return out, whole


_RESULT = "bucket long, target int, k1 long, k2 long, kind string"


def _peeler(third: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        bucket, target = int(cells["bucket"].iat[0]), int(cells["target"].iat[0])
        out, whole = peel(cells, third)
        if not whole:
            return pd.DataFrame({"bucket": [bucket], "target": [target], "k1": [0], "k2": [0], "kind": ["failed"]})
        pairs = pd.DataFrame({"k1": out["k1"], "k2": out["k2"], "sign": out["sign"]})
        both = pairs.groupby(["k1", "k2"], sort=False)["sign"].agg(["min", "max"]).reset_index()
        kind = np.where(both["min"] == both["max"], np.where(both["max"] > 0, "added", "removed"), "changed")
        return pd.DataFrame({"bucket": bucket, "target": target, "k1": both["k1"], "k2": both["k2"], "kind": kind})

    return run


def _signed(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row or cell counted for its own snapshot and against the next one."""
    sides = F.array(
        F.when(F.col("has_prev"), F.struct(F.col("version").alias("target"), F.lit(1).alias("sign"))),
        F.when(F.col("next_no").isNotNull(), F.struct(F.col("next_no").alias("target"), F.lit(-1).alias("sign"))),
    )
    return rows.select("bucket", *columns, F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("_side")).select(
        "bucket", *columns, "_side.target", "_side.sign"
    )


def snapshot_changes(
    rows: DataFrame,
    group: str = "project",
    version: str = "snapshot_no",
    key: str = "file_path",
    value: str = "content_sha1",
    loaded: str = "loaded_at",
    bucket_rows: int = BUCKET_ROWS,
    cells_per_row: Iterable[float] = CELLS_PER_ROW,
) -> DataFrame:
    """``(group, version, key, change_kind)`` between consecutive delivered snapshots.

    A group's snapshot is delivered if it has any row; each is compared with the
    group's delivered snapshot of the next lower number, and the first gives no
    rows.  Of several rows for a key in a snapshot the one loaded last counts
    (null loads first; of equal times the one with a value and the larger hash);
    if it has no value, the key isn't in the snapshot.  Rows without key or
    version name nothing and are left out; a null group is a group of its own.
    Repeated rows change nothing, an empty table gives no rows, and other
    columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "snapshots")
    raw = rows.select(
        F.col(group).alias("g"), F.col(version).cast("int").alias("version"), F.col(key).alias("path"),
        F.col(value).alias("value"), F.col(loaded).alias("loaded"),
    ).where("version is not null and path is not null")

    order = Window.partitionBy("g").orderBy("version")
    delivered = scratch.write(
        raw.groupBy("g", "version").agg(F.count("*").alias("n")).select(
            "g", "version", "n", F.lag("version").over(order).isNotNull().alias("has_prev"), F.lead("version").over(order).alias("next_no")
        )
    )
    most, number, total = delivered.groupBy("version").agg(F.sum("n").alias("n"), F.count("*").alias("c")).agg(F.max("n"), F.sum("c"), F.sum("n")).first()
    # Many snapshots make smaller buckets, so that no task grows with their number.
    buckets = max(1, -(-(most or 0) // bucket_rows), -(-(total or 0) // (bucket_rows * BUCKET_SNAPSHOTS)))
    bucket_rows = min(bucket_rows, max(16, -(-(most or 0) // buckets)))

    steps = delivered.where("has_prev or next_no is not null").select(F.col("g").alias("sg"), F.col("version").alias("sv"), "has_prev", "next_no")
    if (number or 0) <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    k1, k2 = key_pair(F.col("g"), F.col("path"))
    keyed = (
        raw.join(steps, F.col("g").eqNullSafe(F.col("sg")) & (F.col("version") == F.col("sv")))
        .select("version", "has_prev", "next_no", k1.alias("k1"), k2.alias("k2"), F.xxhash64("value").alias("v"), F.col("value").isNotNull().alias("held"), "loaded")
        .withColumn("bucket", F.pmod(F.col("k1"), F.lit(buckets)))
    )

    def current(some: DataFrame) -> DataFrame:
        """One row for each key of a snapshot: its last state, if that has a value."""
        parts = ["bucket", "version", "has_prev", "next_no", "k1", "k2"]
        return (
            some.repartition("bucket")
            .groupBy(*parts, "loaded").agg(F.max(F.when(F.col("held"), F.col("v"))).alias("v"))
            .groupBy(*parts).agg(F.max_by("v", F.coalesce(F.unix_micros(F.col("loaded").cast("timestamp")), F.lit(-(2**63)))).alias("v"))
            .where("v is not null")
        )

    results: list[DataFrame] = []
    rest, failed = keyed, None
    for share in cells_per_row:
        third = max(8, int(bucket_rows * share / 3))
        h = F.xxhash64("k1", "k2", "v")
        cells = (
            current(rest).withColumn("h", h).withColumn("cell", F.explode(_position_columns(F.col("h"), third)))
            .groupBy("bucket", "version", "has_prev", "next_no", "cell")
            .agg(F.count("*").alias("n"), *(F.bit_xor(c).alias(c) for c in ("k1", "k2", "v", "h")))
        )
        left = (
            _signed(cells, "cell", "n", "k1", "k2", "v", "h")
            .groupBy("bucket", "target", "cell")
            .agg(F.sum(F.col("n") * F.col("sign")).alias("n"), *(F.bit_xor(c).alias(c) for c in ("k1", "k2", "v", "h")))
            .where("n <> 0 or k1 <> 0 or k2 <> 0 or v <> 0 or h <> 0")
        )
        if failed is not None:
            left = left.join(failed, ["bucket", "target"], "left_semi")
        found = scratch.write(left.groupBy("bucket", "target").applyInPandas(_peeler(third), _RESULT))
        results.append(found.where("kind <> 'failed'"))
        failed = found.where("kind = 'failed'").select("bucket", "target")
        if not (number := failed.count()):
            break
        again = failed.select("bucket").distinct()
        rest = keyed.join(F.broadcast(again) if number <= BROADCAST_ROWS else again, "bucket", "left_semi")
    else:
        # Tables that never peeled: compare their rows one by one.
        plain = (
            _signed(current(rest), "k1", "k2", "v")
            .groupBy("bucket", "target", "k1", "k2")
            .agg(F.max(F.when(F.col("sign") > 0, F.col("v"))).alias("new"), F.max(F.when(F.col("sign") < 0, F.col("v"))).alias("old"))
            .where("not new <=> old")
            .withColumn("kind", F.expr("case when old is null then 'added' when new is null then 'removed' else 'changed' end"))
        )
        results.append(plain.join(failed, ["bucket", "target"], "left_semi").select(*(x.split()[0] for x in _RESULT.split(", "))))

    changes = results[0]
    for more in results[1:]:
        changes = changes.unionByName(more)
    names = raw.select("g", "path").distinct().select("g", "path", k1.alias("k1"), k2.alias("k2"))
    return changes.select("target", "k1", "k2", "kind").join(names, ["k1", "k2"]).select(
        F.col("g").alias(group), F.col("target").alias(version), F.col("path").alias(key), F.col("kind").alias("change_kind")
    )
