"""History of a changing attribute: versions with the period each was valid.

Every instant at which an entity's state changes, or ends with nothing to
follow, is a snapshot of the entity and has a slot number.  For each entity and
attribute value (by its 128-bit hash) the slots where it held are one presence
bitmap, in words of 64; runs of set bits are its versions, and a gap is simply
an unset slot.

The rows are shuffled once, by entity; ordering, slots, bitmaps and runs all
follow in that partitioning.  Only an entity of very many rows is cut into
stretches of time, in as many tasks, and only runs at the edge of a stretch are
moved again to be stitched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_pair
from ..plans.runtime import Scratch

#: Rows of one entity that stay together, about.
HOT_ROWS = 1 << 16
#: Stretches that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def _stretched(rows: DataFrame, names: list[str], hot_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``hot`` and ``stretch``, and where each stretch of a hot entity begins after the one before; None if no entity is hot.

    A hot entity's time is cut evenly into one stretch for each ``hot_rows`` of its rows.
    """
    entity = F.xxhash64(*(x for n in names for x in (F.col(n).isNull(), F.col(n))))
    counted = rows.groupBy(entity.alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = scratch.write(counted)
    if not (number := hot.count()):
        return rows.select("*", F.lit(False).alias("hot"), F.lit(0).cast("long").alias("stretch")), None
    small = number <= BROADCAST_ROWS
    micros: Column = F.unix_micros(F.col("s").cast("timestamp"))
    marked = rows.withColumn("h", entity)
    spans = marked.join(F.broadcast(hot) if small else hot, "h").groupBy("h").agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"), F.ceil(F.first("n") / hot_rows).alias("parts"))
    spans = scratch.write(spans.select("h", "lo", (F.floor((F.col("hi") - F.col("lo")) / F.col("parts")) + 1).alias("width")))
    placed = marked.join(F.broadcast(spans) if small else spans, "h", "left")
    stretch = F.coalesce(F.floor((micros - F.col("lo")) / F.col("width")), F.lit(0)).cast("long")
    placed = placed.select(*rows.columns, F.col("lo").isNotNull().alias("hot"), stretch.alias("stretch"))
    heads = placed.where("hot").groupBy(*names, "stretch").agg(F.min("s").alias("head"))
    across = Window.partitionBy(*names).orderBy("stretch")
    heads = scratch.write(heads.select(*(F.col(n).alias(f"h{n}") for n in names), F.col("stretch").alias("hs"), F.lead("head").over(across).alias("next_head")))
    return placed, F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads


def attribute_history(
    rows: DataFrame,
    entity: list[str],
    attribute: str,
    start: str,
    end: str,
    written: str,
    tie: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(*entity, attribute, version_from, version_to)``, one row per version.

    A row says that ``attribute`` held from ``start`` to ``end`` (null: no end).
    Rows without a start, and rows whose end isn't after it, count as absent.
    Of an entity's rows with one start the one written last counts (null first;
    then the larger ``tie``, or without one the larger value, and the later
    end, null first).  A state ends at its end or at the entity's next start.
    States that touch and have the same value are one version.  Null is a value
    of its own, and so is a null entity column.  Repeated rows change nothing;
    other columns are not read.  ``hot_rows`` changes no result.
    """
    scratch = Scratch(rows.sparkSession, "history")
    names = [f"e{i}" for i in range(len(entity))]
    v1, v2 = key_pair(F.col(attribute))
    given = rows.select(
        *(F.col(c).alias(n) for c, n in zip(entity, names)),
        F.col(start).alias("s"), F.col(end).alias("x"), F.col(written).alias("w"), F.col(attribute).alias("a"),
        v1.alias("v1"), v2.alias("v2"), *([F.col(tie).alias("t")] if tie else []),
    ).where("s is not null and (x is null or x > s)")
    placed, heads = _stretched(given, names, hot_rows, scratch)

    within = Window.partitionBy(*names, "stretch").orderBy("s", "w", *(["t"] if tie else ["a"]), "v1", "v2", "x")
    # The last of the rows with one start is followed by a later start, or by nothing.
    states = placed.withColumn("next", F.lead("s").over(within)).where("next is null or next > s")
    follows = F.col("next")
    if heads is not None:
        same = (F.col("stretch") == F.col("hs")) & F.col("hot")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"h{n}"))
        states = states.join(heads, same, "left")
        follows = F.coalesce("next", "next_head")
    slotted = (
        states.withColumn("until", F.least("x", follows))
        .withColumn("gap", F.coalesce(F.lag("until").over(within) < F.col("s"), F.lit(False)).cast("int"))
        .withColumn("slot", F.row_number().over(within) - 1 + F.sum("gap").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("tail", F.col("hot") & F.col("next").isNull())
        .withColumn("word", F.floor(F.col("slot") / 64))
        .withColumn("bit", (F.col("slot") % 64).cast("int"))
    )
    words = slotted.groupBy(*names, "stretch", "v1", "v2", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"),
        F.sort_array(F.collect_list(F.struct("bit", "s", "until", "tail"))).alias("slots"),  # 64 at most
        F.max("a").alias("a"), F.first("hot").alias("hot"),
    )
    runs = words.select(
        *names, "stretch", "v1", "v2", "a", "word", "hot",
        F.explode(F.expr("""arrays_zip(
            filter(slots, x -> x.bit = 0 or (shiftright(bits, x.bit - 1) & 1L) = 0),
            filter(slots, x -> x.bit = 63 or (shiftright(bits, x.bit + 1) & 1L) = 0))""")).alias("run"),
    ).select(
        *names, "stretch", "v1", "v2", "a", F.col("run.0.s").alias("f"), F.col("run.1.until").alias("u"),
        # A run may go on before a cut entity's stretch, and behind it.
        ((F.col("run.0.bit") == 0) & (F.col("word") == 0) & F.col("hot")).alias("opens"), F.col("run.1.tail").alias("closes"),
    )

    def stitched(some: DataFrame, *group: str) -> DataFrame:
        """Runs of one value that touch as one."""
        order = Window.partitionBy(*group).orderBy("f")
        rest = [c for c in some.columns if c not in (*group, "a", "f", "u", "opens", "closes")]
        return (
            some.withColumn("starts", (~F.col("f").eqNullSafe(F.lag("u").over(order))).cast("int"))
            .withColumn("run", F.sum("starts").over(order))
            .groupBy(*group, "run")
            .agg(*(F.first(c).alias(c) for c in rest), F.max("a").alias("a"), F.min("f").alias("f"), F.max(F.struct("f", "u")).alias("last"), F.max("opens").alias("opens"), F.max("closes").alias("closes"))
            .withColumn("u", F.col("last.u")).drop("run", "last")
        )

    whole = stitched(runs, *names, "stretch", "v1", "v2")
    if heads is not None:
        edge = F.col("opens") | F.col("closes")
        whole = whole.where(~edge).unionByName(stitched(whole.where(edge), *names, "v1", "v2"))
    return whole.select(
        *(F.col(n).alias(c) for n, c in zip(names, entity)), F.col("a").alias(attribute),
        F.col("f").alias("version_from"), F.col("u").alias("version_to"),
    )
