"""A rebuilt stage against the committed one, cell by cell, without joining what is equal.

A committed stage is stored by buckets of its key's hash, beside a small table of the buckets' digests. A rebuild is
reduced to digests of the same buckets first; only buckets whose digest differs are read from the committed files (the others are pruned
as partitions) and joined, so an almost equal rebuild of a large stage costs one aggregation and a small join.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import get, put

BUCKETS = 256
MOST_BUCKETS = 4096


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(buckets)).cast("int"))


def _cell(df: DataFrame, c: str):
    """A column as text: what two versions are compared by. Null stays null."""
    simple = not any(x in df.schema[c].dataType.simpleString() for x in ("array", "struct", "map"))
    return (F.col(c).cast("string") if simple else F.to_json(c)).alias(c)


def digests(df: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, d1, d2): rows and two order-free digests of every bucket of ``df``."""
    cells = [F.coalesce(F.concat(F.lit("="), _cell(df, c)), F.lit("")) for c in sorted(df.columns)]
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    rows = _bucketed(df, key, buckets)
    return rows.groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"), total(F.xxhash64(*cells)).alias("d1"), total(F.hash(*cells)).alias("d2"))


def commit_stage(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Write ``df`` by buckets, and its schema and the digests beside it."""
    rows = _bucketed(df, key, buckets)
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows")
    put(f"{path}/schema.json", json.dumps(rows.schema.jsonValue()).encode())
    digests(df, key, buckets).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, path: str, rebuilt: DataFrame, key: list[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets (at most ``buckets`` numbers) in which the committed stage and the rebuild differ."""
    old, new = spark.read.parquet(f"{path}/digests"), digests(rebuilt, key, buckets)
    met = old.alias("x").join(new.alias("y"), "bucket", "full")
    differ = ~(F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.d1").eqNullSafe(F.col("y.d1")) & F.col("x.d2").eqNullSafe(F.col("y.d2")))
    return sorted(r.bucket for r in met.where(differ).select("bucket").collect())


def cell_differences(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change, column, old, new) of every cell that differs between two tables whose rows the key names (nulls equal).

    ``change`` is added or removed for rows that only one has (all their cells are listed) and changed for others. Cells are compared
    as text, structured ones as JSON. A column that only one has counts as null in the other. A key that a table holds twice is an error.
    """
    for name, df in (("old", old), ("new", new)):
        twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
        if twice:
            raise ValueError(f"keys that the {name} table holds twice: {[tuple(r)[:-1] for r in twice]}")
    columns = sorted((set(old.columns) | set(new.columns)) - set(key))

    def packed(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*((_cell(df, c) if c in df.columns else F.lit(None).cast("string")) for c in columns)) if columns else F.array().cast("array<string>")
        return df.select(*key, cells.alias(name))

    left, right = packed(old, "_old"), packed(new, "_new").withColumnsRenamed({k: f"_n_{k}" for k in key})
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    met = left.join(right, same, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    names = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    nothing = F.array_repeat(F.lit(None).cast("string"), len(columns))
    zipped = F.arrays_zip(names.alias("column"), F.coalesce("_old", nothing).alias("old"), F.coalesce("_new", nothing).alias("new"))
    found = met.select(*(F.when(F.col("_old").isNull(), F.col(f"_n_{k}")).otherwise(F.col(k)).alias(k) for k in key), change.alias("change"), F.explode(zipped).alias("x"))
    found = found.select(*key, "change", "x.column", "x.old", "x.new")
    return found.where((F.col("change") != "changed") | ~F.col("old").eqNullSafe(F.col("new")))


def compare_with_committed(spark: SparkSession, path: str, rebuilt: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``cell_differences`` of the stage committed at ``path`` and its rebuild; equal buckets are neither read nor joined."""
    changed = changed_buckets(spark, path, rebuilt, key, buckets)
    kind = StructType.fromJson(json.loads(get(f"{path}/schema.json")))
    old = spark.read.schema(kind).parquet(f"{path}/rows").where(F.col("_bucket").isin(changed) if changed else F.lit(False)).drop("_bucket")
    new = _bucketed(rebuilt, key, buckets).where(F.col("_bucket").isin(changed) if changed else F.lit(False)).drop("_bucket")
    return cell_differences(old, new, key)
