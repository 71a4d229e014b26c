"""Filters, joins with asserted keys, funnels, samples and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged if ``keys`` are unique in it; else an error. Runs one aggregation."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"keys {keys} repeat, e.g. {bad[0].asDict()}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), keys)


def enrich(left: DataFrame, right: DataFrame, keys: list[str], required: str | None = None) -> DataFrame:
    """Many-to-one left join; with ``required`` an error if that column stays null for a row."""
    out = left.join(assert_unique(right, keys), keys, "left")
    if required and not out.where(F.col(required).isNull()).isEmpty():
        raise ValueError(f"rows without {required}")
    return out


def closed_window(df: DataFrame, ts: str, lo, hi) -> DataFrame:
    return df.where(F.col(ts).between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))


def half_open_window(df: DataFrame, ts: str, lo, hi) -> DataFrame:
    return df.where((F.col(ts) > F.lit(lo).cast("timestamp")) & (F.col(ts) <= F.lit(hi).cast("timestamp")))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative step, in one pass."""
    passed, counts = F.lit(True), []
    for _, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed))
    row = df.agg(F.count("*").alias("c0"), *(c.alias(f"c{i}") for i, c in enumerate(counts, 1)))
    names = ["all", *(n for n, _ in steps)]
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)))).alias("r")).select("r.*")


def first_failure(reasons: list[tuple[str, Column]], default: str = "kept") -> Column:
    """The first reason whose condition holds."""
    out = F.lit(default)
    for name, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def seeded_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """``n`` rows without replacement in the order of a seeded hash of their keys: the same everywhere."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def stratified_sample(df: DataFrame, stratum: str, group: str, n: int, seed: int, keys: list[str]) -> DataFrame:
    """At most ``n`` rows per stratum and one per (stratum, group)."""
    h = F.xxhash64(F.lit(seed), *keys)
    one = df.withColumn("_g", F.row_number().over(Window.partitionBy(stratum, group).orderBy(h, *keys))).where("_g = 1").drop("_g")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(h, *keys))).where(F.col("_r") <= n).drop("_r")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def zero_filled(dimension: DataFrame, counts: DataFrame, keys: list[str], column: str) -> DataFrame:
    return dimension.join(counts, keys, "left").fillna(0, [column])


def until_first_hit(df: DataFrame, group: list[str], order: list[Column], hit: Column) -> DataFrame:
    """Rows of each group up to and including its first hit: a classifier that stops early asks these."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_h", F.coalesce(F.sum(F.when(hit, 1).otherwise(0)).over(before), F.lit(0))).where("_h = 0").drop("_h")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: rows and the sum of row hashes."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("fingerprint"))


def pairs_within(rows: DataFrame, keys: list[str], value: str, block: int = 1024, per_task: int = 4_000_000) -> DataFrame:
    """(one, two): the pairs one < two of ``value`` among rows equal in ``keys``; null keys and values match nothing.

    A group is cut into blocks of about ``block`` rows by a hash of the value, and pairs come from two blocks at a time, so that no task
    holds a group; the pairs of blocks are dealt to as many tasks as the pairs ask for.
    """
    rows = rows.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*keys, value))))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    n = groups.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("n")).first().n or 0
    count = F.ceil(F.col("_n") / block).cast("int")
    placed = rows.join(groups.select(*keys, count.alias("_m")), keys).withColumn("_i", F.pmod(F.xxhash64(value), F.col("_m")).cast("int"))
    blocks = placed.groupBy(*keys, "_m", "_i").agg(F.array_sort(F.collect_list(value)).alias("_x"))
    met = blocks.withColumn("_j", F.explode(F.sequence("_i", F.col("_m") - 1))).join(blocks.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_y")), [*keys, "_j"])
    met = met.repartition(max(1, -int(-n // per_task)), *keys, "_i", "_j")
    each = met.select(F.posexplode("_x").alias("_at", "x"), "_y", (F.col("_i") == F.col("_j")).alias("_same"))
    pairs = each.select("x", F.explode(F.when(F.col("_same"), F.slice("_y", F.col("_at") + 2, F.size("_y"))).otherwise(F.col("_y"))).alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two"))
