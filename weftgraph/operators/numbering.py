"""Numbers in place of long values: 64-bit hashes that no two values share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Scratch


def hashed(value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), value)


class Numbering:
    """A number for each distinct ``value`` of a table.

    Numbers are hashes.  The few values whose hashes meet (some n * n / 2**65
    of n values) get others, in a small table of exceptions; where there is no
    exception, as nearly always, :meth:`of` is a plain expression.
    """

    def __init__(self, values: DataFrame, scratch: Scratch):
        """``values`` has the distinct values, none of them null, in its column ``value``."""
        seed, self._others = 0, None
        while True:
            numbers = values.select("value", hashed(F.col("value"), 0).alias("number"))
            if self._others is not None:
                numbers = self._apply(numbers.select("value"), "value", "number")
            twice = numbers.groupBy("number").agg(F.count("*").alias("n")).where("n > 1").select("number")
            met = scratch.write(numbers.join(twice, "number", "left_semi").select("value"))
            if met.isEmpty():
                return
            seed += 1
            given = met.select(F.col("value").alias("_value"), hashed(F.col("value"), seed).alias("_other"))
            if self._others is not None:
                given = self._others.join(given, "_value", "left_anti").unionByName(given)
            self._others = scratch.write(given)

    def _apply(self, rows: DataFrame, column: str, number: str) -> DataFrame:
        own = self._others.withColumnRenamed("_value", f"_value_{number}").withColumnRenamed("_other", f"_other_{number}")
        joined = rows.join(own, F.col(column) == F.col(f"_value_{number}"), "left")
        plain = F.when(F.col(column).isNotNull(), hashed(F.col(column), 0))
        return joined.withColumn(number, F.coalesce(f"_other_{number}", plain)).drop(f"_value_{number}", f"_other_{number}")

    def of(self, rows: DataFrame, column: str, number: str) -> DataFrame:
        """``rows`` with the number of ``column`` as ``number``; null has none."""
        if self._others is not None:
            return self._apply(rows, column, number)
        return rows.withColumn(number, F.when(F.col(column).isNotNull(), hashed(F.col(column), 0)))
