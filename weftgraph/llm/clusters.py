"""Clusters of records with similar member sets.

Equal sets are one before anything else.  MinHash banding proposes pairs of
sets, exact Jaccard similarity over whole sets verifies them, and connected
components are the clusters.  A loose component is also divided into groups
around its medoids, the sets with the most similar neighbours.

Buckets of a band that grow beyond ``BUCKET`` sets (a member that most sets
hold) aren't paired; the sets in them are banded again with more rows, which
divides them, in as many bands as keep every pair as likely to meet.  What is
still crowded then is joined on the rarest part of its members, which finds
every similar pair among them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_longs
from ..operators.components import connected_components
from ..operators.numbering import Numbering
from ..plans.runtime import Scratch, ship

#: Least Jaccard similarity, as a fraction: one half.
SIMILAR = (1, 2)
#: Bands and rows, level by level. At similarity 1/2 a pair shares no bucket with probability 0.75 ** 48 = (15 / 16) ** 216 = 1e-6.
LEVELS = ((48, 2), (216, 4))
#: Largest bucket whose sets are paired with each other.
BUCKET = 64
#: Records of one cluster, or sets with one member, that meet all others of it in one task, about.
PART = 2048
#: Crowded buckets that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000
#: A component with fewer than this share of its possible pairs is loose.
DENSE = 0.5
#: Members named for a cluster.
TYPICAL = 5


def _band_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    seeds = hash_longs(np.arange(bands * rows, dtype=np.int64)).view(np.uint64)
    for batch in batches:
        sets, members = batch.column(0), batch.column(1)
        flat, ends = np.asarray(members.flatten()).view(np.uint64), np.asarray(members.offsets)
        if not len(sets):
            continue
        starts = (ends[:-1] - ends[0]).astype(np.int64)
        keys = np.empty((len(sets), bands), np.int64)
        for band in range(bands):
            least = []
            for row in range(rows):
                with np.errstate(over="ignore"):
                    mixed = (flat ^ seeds[band * rows + row]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(32)
                least.append(np.minimum.reduceat(mixed, starts).view(np.int64))
            keys[:, band] = hash_longs(np.full(len(sets), band, np.int64), *least)
        column = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([sets, column], ["sid", "keys"])


def _pairs_of(groups: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of the ids in ``ids`` (a bounded array)."""
    return groups.select(F.array_sort("ids").alias("ids")).select(F.posexplode("ids").alias("i", "a"), "ids").select(
        "a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b")
    )


def _rare_pairs(crowded: DataFrame, similar: tuple[int, int], part: int) -> DataFrame:
    """``(a, b)``: every pair of ``crowded`` (sid, members) that can be similar, by the rarest members of the two.

    Of two similar sets the larger shares a member of its first size - ceil(size * p / q) + 1, in any common order, with
    the smaller one's first size - ceil(size * 2p / (p + q)) + 1; a frequent member is seldom among the latter.
    A member that is among many sets' first meets them part by part.
    """
    p, q = similar
    held = crowded.select("sid", F.size("members").alias("size"), F.explode("members").alias("member"))
    rare = held.groupBy("member").agg(F.count("*").alias("held_by"))
    ranked = held.join(rare, "member").withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("held_by", "member")))
    ranked = ranked.withColumn("parts", F.ceil(F.col("held_by") / part).cast("int"))
    probe = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * p / q) + 1)
    probe = probe.select("member", F.pmod(F.xxhash64("sid"), "parts").cast("int").alias("part"), "sid", "size", "rank")
    index = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * 2 * p / (p + q)) + 1)
    index = index.select("member", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("sid").alias("other"), F.col("size").alias("small"), F.col("rank").alias("at"))
    # What two sets can still share after the first member they share.
    reach = 1 + F.least(F.col("size") - F.col("rank"), F.col("small") - F.col("at"))
    return (
        probe.join(index, ["member", "part"])
        .where("size > small or (size = small and sid < other)")
        .where((F.col("small") * q >= F.col("size") * p) & (reach * (p + q) >= (F.col("size") + F.col("small")) * p))
        .select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
    )


def similar_sets(
    sets: DataFrame, scratch: Scratch, similar: tuple[int, int] = SIMILAR, levels: tuple[tuple[int, int], ...] = LEVELS, bucket: int = BUCKET
) -> DataFrame:
    """``(a, b)``, a < b: the pairs of ``sets`` (sid, members, seconds) whose Jaccard similarity is at least ``similar``.

    ``members`` and ``seconds`` are two independent 64-bit hashes of each name; a pair must be similar by both.
    """
    p, q = similar
    rest, found = sets.select("sid", "members"), []
    for bands, rows in levels:
        banded = rest.mapInArrow(lambda batches, n=bands, m=rows: _band_batches(batches, n, m), "sid long, keys array<long>")
        banded = banded.select("sid", F.explode("keys").alias("key"))
        sizes = banded.groupBy("key").agg(F.count("*").alias("n"))
        large = scratch.write(sizes.where(F.col("n") > bucket).select("key"))
        number = large.count()
        hint = F.broadcast(large) if number <= BROADCAST_ROWS else large
        small = banded.join(hint, "key", "left_anti") if number else banded
        found.append(_pairs_of(small.groupBy("key").agg(F.collect_list("sid").alias("ids")).where("size(ids) > 1")))
        if not number:
            break
        rest = scratch.write(rest.join(banded.join(hint, "key", "left_semi").select("sid").distinct(), "sid", "left_semi"))
    else:
        found.append(_rare_pairs(rest, similar, PART))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    left = sets.select(F.col("sid").alias("a"), F.col("members").alias("ma"), F.col("seconds").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("members").alias("mb"), F.col("seconds").alias("sb"))
    close = lambda x, y: F.size(F.array_intersect(x, y)) * (p + q) >= (F.size(x) + F.size(y)) * p
    return candidates.distinct().join(left, "a").join(right, "b").where(close("ma", "mb")).where(close("sa", "sb")).select("a", "b")


class Clusters:
    """The clusters of ``records`` (id, array of distinct member names).

    A record without members is similar to nothing and forms no cluster; null
    names, repeated names and repeated rows of one id don't count twice (the
    first in order of the arrays counts), and null ids are left out.  Other
    columns are not read.
    """

    def __init__(self, records: DataFrame, key: str, members: str, similar: tuple[int, int] = SIMILAR):
        spark = records.sparkSession
        ship(spark)
        self.scratch = Scratch(spark, "clusters")
        clean = F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull())))
        rows = records.select(F.col(key).alias("id"), clean.alias("names")).where("id is not null and size(names) > 0")
        rows = self.scratch.write(rows.groupBy("id").agg(F.min("names").alias("names")))
        distinct = self.scratch.write(rows.groupBy("names").agg(F.count("*").alias("copies")))
        numbers = Numbering(distinct.select(F.col("names").alias("value")), self.scratch)
        #: (id, names, sid) of every record with members; sid is the number of its set.
        self.records = numbers.of(rows, "names", "sid")
        hashed = lambda *seed: F.transform("names", lambda x: F.xxhash64(*seed, x))
        #: (sid, members, seconds, copies): the distinct sets, by two hashes of each name.
        self.sets = self.scratch.write(numbers.of(distinct, "names", "sid").select("sid", hashed().alias("members"), hashed(F.lit(7)).alias("seconds"), "copies"))
        #: (a, b): similar pairs of distinct sets.
        self.links = self.scratch.write(similar_sets(self.sets, self.scratch, similar))
        self._components: DataFrame | None = None

    def components(self) -> DataFrame:
        """``(sid, cluster)`` of every distinct set, alone or with others."""
        if self._components is None:
            joined = connected_components(self.links, "a", "b", self.scratch).withColumnRenamed("node", "sid")
            self._components = self.sets.select("sid").join(joined, "sid", "left").select("sid", F.coalesce("component", "sid").alias("cluster"))
        return self._components

    def membership(self) -> DataFrame:
        """``(id, cluster)`` of every record with members."""
        return self.records.select("id", "sid").join(self.components(), "sid").select("id", "cluster")

    def pairs(self) -> DataFrame:
        """``(a, b)``, a < b: all pairs of records in one cluster.

        A cluster of more than ``PART`` records meets itself part by part, so a
        hot one is spread over as many tasks as it has parts.
        """
        placed = self.components().join(self.sets.select("sid", "copies"), "sid")
        sizes = placed.groupBy("cluster").agg(F.ceil(F.sum("copies") / PART).cast("int").alias("parts"))
        parted = self.components().join(sizes, "cluster")
        one = self.scratch.write(self.records.select("id", "sid").join(parted, "sid").select("id", "cluster", "parts"))
        left = one.select("cluster", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("a"))
        right = one.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"))
        return left.join(right, ["cluster", "part"]).where("a < b").select("a", "b")

    def groups(self, dense: float = DENSE) -> DataFrame:
        """``(sid, cluster, medoid)``: in loose clusters sets follow the neighbour with the highest degree up to a medoid."""
        ends = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = self.sets.select("sid").join(ends.groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("degree")), "sid", "left").na.fill(0, ["degree"])
        nodes = self.scratch.write(degree.join(self.components(), "sid"))
        shape = nodes.groupBy("cluster").agg(F.count("*").alias("n"), (F.sum("degree") / 2).alias("m"), F.min(F.struct(-F.col("degree"), "sid")).alias("best"))
        shape = shape.select("cluster", (F.col("m") < dense * F.col("n") * (F.col("n") - 1) / 2).alias("loose"), F.col("best.sid").alias("centre"))
        near = ends.join(nodes.select(F.col("sid").alias("b"), "degree"), "b").select(F.col("a").alias("sid"), F.struct(-F.col("degree"), F.col("b")).alias("to"))
        own = nodes.select("sid", F.struct(-F.col("degree"), F.col("sid").alias("b")).alias("to"))
        best = near.unionByName(own).groupBy("sid").agg(F.min("to").alias("to")).select("sid", F.col("to.b").alias("up"))
        state = self.scratch.write(best)
        while True:
            above = state.select(F.col("sid").alias("up"), F.col("up").alias("up2"))
            after = self.scratch.write(state.join(above, "up").select("sid", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved")))
            self.scratch.drop(state)
            state = after.select("sid", "up")
            if after.where("moved").isEmpty():
                break
        return nodes.select("sid", "cluster").join(state, "sid").join(shape, "cluster").select(
            "sid", "cluster", F.when(F.col("loose"), F.col("up")).otherwise(F.col("centre")).alias("medoid")
        )

    def described(self, typical: int = TYPICAL) -> DataFrame:
        """One row per group: its cluster, medoid, sizes and the members most of its records hold."""
        groups = self.scratch.write(self.groups())
        held = self.records.join(groups, "sid")
        sizes = held.groupBy("cluster", "medoid").agg(F.count("*").alias("n_records"), F.countDistinct("sid").alias("n_sets"), F.min(F.when(F.col("sid") == F.col("medoid"), F.col("id"))).alias("medoid_id"))
        order = Window.partitionBy("medoid").orderBy(F.desc("n"), "name")
        top = (
            held.select("medoid", F.explode("names").alias("name")).groupBy("medoid", "name").agg(F.count("*").alias("n"))
            .withColumn("at", F.row_number().over(order)).where(F.col("at") <= typical)
            .groupBy("medoid").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("top"))
            .select("medoid", F.transform("top", lambda x: x["name"]).alias("typical_members"))
        )
        return sizes.join(top, "medoid")
