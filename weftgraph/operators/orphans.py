"""References to records that don't exist at the time of the reference.

A reference has a composite key of which any part may be null.  References are
grouped by their null mask; each mask is anti-joined with the targets on its
non-null columns and on the targets' period, so every join is a plain equi-join
with one range condition.  Of a key with very many references the repeated ones
count as one, and the others meet its targets part by part, in as many tasks.
Presence intervals come from hash aggregations.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import Scratch

MATCHES = ("simple", "partial", "full")
#: References to one key that meet its targets in one task, about.
HOT_ROWS = 1 << 16
#: Hot keys that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def _hot_keys(rows: DataFrame, on: list[str], own: str, hot_rows: int) -> DataFrame | None:
    """The keys, partly null ones too, with more than ``hot_rows`` rows and the parts they are cut into; None if there is none."""
    counted = rows.groupBy(*(F.col(c).alias(f"{own}h{i}") for i, c in enumerate(on))).agg(F.ceil(F.count("*") / hot_rows).cast("int").alias(f"{own}parts"))
    hot = Scratch(rows.sparkSession, "hot_keys").write(counted.where(F.col(f"{own}parts") > 1))
    number = hot.count()
    return None if not number else F.broadcast(hot) if number <= BROADCAST_ROWS else hot


def _groupable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_groupable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _groupable(kind.elementType)
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def presence_intervals(seen: DataFrame, gone: DataFrame, key: str, seen_at: str, gone_at: str) -> DataFrame:
    """``(key, valid_from, valid_to)``: from a sighting up to the next removal.

    A key is present at a time if its last sighting at or before that time is
    later than its last removal at or before it, so a sighting at the moment of
    a removal doesn't count.  Null keys and times are left out; repeated rows
    change nothing.
    """
    seen = seen.select(F.col(key).alias("k"), F.col(seen_at).alias("t")).dropna()
    gone = gone.select(F.col(key).alias("k"), F.col(gone_at).alias("r")).dropna().distinct()
    order = Window.partitionBy("k").orderBy("r")
    after = gone.select("k", F.col("r").alias("lo"), F.lead("r").over(order).alias("hi"))
    before = gone.groupBy("k").agg(F.min("r").alias("hi")).select("k", F.lit(None).cast(gone.schema["r"].dataType).alias("lo"), "hi")
    eras = before.unionByName(after).withColumnRenamed("k", "ek")
    held = (F.col("k") == F.col("ek")) & (F.col("lo").isNull() | (F.col("t") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("t") < F.col("hi")))
    # Each (key, time) once: sightings are repeated far more often than keys are removed.
    return (
        seen.distinct().join(eras, held, "left")
        .where("lo is null or t > lo")
        .groupBy("k", "lo", "hi").agg(F.min("t").alias("valid_from"))
        .select(F.col("k").alias(key), "valid_from", F.col("hi").alias("valid_to"))
    )


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    on: list[str],
    at: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    match: str = "partial",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of ``references`` whose composite key ``on`` has no target at time ``at``.

    ``targets`` has the columns ``on`` and a half-open period; a null
    ``valid_from`` means always before, a null ``valid_to`` no end.  ``match``
    is the semantics for partly null keys: *simple* never reports them,
    *partial* looks for a target that equals the non-null columns, *full*
    reports every one of them.  A wholly null key refers to nothing and is never
    reported, nor is a reference without a time.  Repeated references come out
    as often as they came in, with all their columns; targets may repeat.
    Keys of more than ``hot_rows`` references are cut into parts by the other
    columns, after repeated rows have become one with a count (unless a column,
    a map for instance, can't be compared); this changes no result.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    references = references.where(F.col(at).isNotNull())
    own = "_"
    while any(c.startswith(own) for c in references.columns):  # names that clash with none of the references' own
        own += "_"
    period = [F.col(valid_from).alias(f"{own}from"), F.col(valid_to).alias(f"{own}to")]

    masks = [m for m in product((False, True), repeat=len(on)) if not all(m) and (match != "simple" or not any(m))]
    some_null = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    asked = references.where(~some_null) if match != "partial" else references.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in on]))
    hot = _hot_keys(asked, on, own, hot_rows)
    part, of, copies = f"{own}part", f"{own}of", f"{own}copies"
    comparable = [f.name for f in references.schema if _groupable(f.dataType)]
    columns = [F.col(f"`{c}`") for c in references.columns]
    both = lambda sides: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{own}h{i}")) for i, c in sides])
    absent = lambda rows, keys, same: rows.join(keys, reduce(Column.__and__, [*same, F.col(f"{own}from").isNull() | (F.col(f"{own}from") <= F.col(at)), F.col(f"{own}to").isNull() | (F.col(f"{own}to") > F.col(at))]), "left_anti")

    def masked(mask: tuple[bool, ...]) -> DataFrame:
        held = [(i, c) for i, (c, null) in enumerate(zip(on, mask)) if not null]
        rows = references.where(reduce(Column.__and__, [F.col(c).isNull() if null else F.col(c).isNotNull() for c, null in zip(on, mask)]))
        if any(mask) and match == "full":
            return rows
        keys = targets.select(*(F.col(c).alias(f"{own}{i}") for i, c in held), *period).dropna(subset=[f"{own}{i}" for i, _ in held])
        same = [F.col(c) == F.col(f"{own}{i}") for i, c in held]
        if hot is None:
            return absent(rows, keys, same)
        crowds = hot.where(reduce(Column.__and__, [F.col(f"{own}h{i}").isNull() if null else F.col(f"{own}h{i}").isNotNull() for i, null in enumerate(mask)]))
        few = absent(rows.join(crowds, both(enumerate(on)), "left_anti"), keys, same)
        many = rows.join(crowds, both(enumerate(on)))
        many = many.drop(*(f"{own}h{i}" for i in range(len(on))))
        once = len(comparable) == len(references.columns)
        if once:
            many = many.groupBy(*columns, f"{own}parts").agg(F.count("*").alias(copies))
        many = many.withColumn(part, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in comparable)), F.col(f"{own}parts")).cast("int"))
        wide = keys.join(crowds, both([(i, f"{own}{i}") for i, _ in held])).withColumn(of, F.explode(F.sequence(F.lit(0), F.col(f"{own}parts") - 1)))
        many = absent(many, wide.drop(f"{own}parts", *(f"{own}h{i}" for i in range(len(on)))), [*same, F.col(part) == F.col(of)])
        if once:
            many = many.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        return few.unionByName(many.select(*columns))

    return reduce(DataFrame.unionByName, map(masked, masks))
