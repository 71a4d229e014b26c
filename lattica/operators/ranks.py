"""Running totals over a global order without one task that holds all rows.

The rows are dealt by Spark's range partitioning into as many ranges of the order as their number asks for
(``PER_RANGE`` rows each). A total within the range plus the totals of all ranges before it is the running total; only the
ranges' totals, one row each, meet in one task. Rows and ranges are checkpointed, so that all steps see the same ones.
"""

from __future__ import annotations

import atexit
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_RANGE, MOST_RANGES = 50_000, 100_000


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` with their lineage cut, in the session's checkpoint folder (a temporary one in local mode without it)."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        holder = tempfile.TemporaryDirectory(prefix="lattica-", ignore_cleanup_errors=True)
        atexit.register(holder.cleanup)
        spark.sparkContext.setCheckpointDir(holder.name)
    return rows.checkpoint()


def _ranged(rows: DataFrame, order: list[Column], per_range: int) -> DataFrame:
    """Adds ``_b``: the number of the row's range of the order. Rows equal in the order share a range."""
    n = rows.count()
    if n <= per_range:
        return rows.withColumn("_b", F.lit(0))
    ranges = min(MOST_RANGES, -(-n // per_range))
    return settled(rows.repartitionByRange(ranges, *order).withColumn("_b", F.spark_partition_id()))


def running(rows: DataFrame, order: list[Column], value: Column, name: str, how: str = "sum", per_range: int | None = None) -> DataFrame:
    """Adds ``name``: the sum (or ``min``) of ``value`` over all rows up to this one in ascending ``order``.

    The order must be total; negate a number for a descending one.
    """
    total = {"sum": F.sum, "min": F.min}[how]
    placed = _ranged(settled(rows), order, per_range or PER_RANGE).withColumn("_v", value)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_b").agg(total("_v").alias("_t")).select("_b", total("_t").over(before).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = total("_v").over(inside)
    join = F.coalesce(F.col("_before"), F.lit(0)) + own if how == "sum" else F.least(F.col("_before"), own)
    return placed.join(F.broadcast(totals), "_b").withColumn(name, join).drop("_b", "_v", "_before")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in a total ascending ``order``, from 1."""
    return running(rows, order, F.lit(1).cast("long"), name)


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: average rank over the non-null values divided by their number; null stays null.

    Equal values are counted before they are ordered.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running(counts, [F.col("_value")], F.col("_n"), "_upto")
    all_ = rows.agg(F.count(column).alias("_all"))
    ranked = ranked.join(all_).select("_value", ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all")).alias(name))
    # nulls stay out of the join, where they would be one key
    there = rows.where(F.col(column).isNotNull())
    found = there.join(ranked, there[column] == ranked["_value"]).drop("_value")
    return found.unionByName(rows.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast(found.schema[name].dataType)))


def quantiles(rows: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """(by, share, value): quantiles between neighbouring ranks of the non-null values of each group, exact.

    Equal values are counted first; the order (group, value) of the counts is walked by ranges, so no group's values are one task or map.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    key = [*(F.col(b) for b in by), F.col("_value")]
    run = settled(running(counts, key, F.col("_n"), "_upto"))
    groups = run.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    each = groups.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_at", F.col("share") * (F.col("_all") - 1))
    wanted = each.select(*by, "share", "_start", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"))
    same = reduce(lambda x, y: x & y, (F.col(f"r.{b}").eqNullSafe(F.col(f"w.{b}")) for b in by), F.lit(True))
    place = F.col("w._start") + F.col("w._rank")
    # each wanted rank lies in the count of one value; a group has two rows per share on this side
    side = F.broadcast(wanted) if wanted.count() <= 100_000 else wanted
    met = run.alias("r").join(side.alias("w"), same & (place >= F.col("r._upto") - F.col("r._n")) & (place < F.col("r._upto")))
    sides = met.select(*(F.col(f"w.{b}").alias(b) for b in by), "w.share", "w._at", F.col("w._rank").alias("_rank"), F.col("r._value").alias("_value"))
    low, high = F.min("_value"), F.max("_value")
    return sides.groupBy(*by, "share", "_at").agg((low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("value")).select(*by, "share", "value")


def equal_bins(rows: DataFrame, bins: int, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: bins 1 to ``bins`` of like size in a total ascending ``order``; the first ones take one row more."""
    placed = numbered(rows, order, "_r").join(rows.agg(F.count("*").alias("_all")))
    size, rest = F.floor(F.col("_all") / bins), F.col("_all") % bins
    r = F.col("_r") - 1
    long = r < rest * (size + 1)
    return placed.withColumn(name, (F.when(long, F.floor(r / (size + 1))).otherwise(rest + F.floor((r - rest * (size + 1)) / F.greatest(size, F.lit(1)))) + 1).cast("int")).drop("_r", "_all")
