"""Helpers the training-data operators share.

Names that begin with ``_lt_`` are given to columns in between; a table may have columns of these names, and where a
function returns its input's columns they keep their values.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_local_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, notebooks in local mode) a temporary folder of this
    process stands in for it; on a cluster the setting is required.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        holder = tempfile.TemporaryDirectory(prefix="lattica-")
        atexit.register(holder.cleanup)
        _local_root = f"file://{holder.name}"
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, not by rows alone, unless the session says how large they may be.

    It changes no result; without it ten thousand long texts travel at once.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    bounded_batches(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles of a written table are of no further use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table of ``written`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/lattica-" in folder:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant that clashes with no column of ``df`` (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(big: DataFrame, small: DataFrame, key: str, rows: int = 1 << 18, salts: int = 64) -> DataFrame:
    """``big`` left-joined with ``small`` (unique ``key``; nulls equal) when a key may hold much of ``big``.

    Up to ``rows`` keys (and 64 MB of them) are broadcast. More are written ``salts`` times, and each row of ``big``
    meets one of the copies, so that no task gets more than that share of a key.
    """
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("b")).first()
    same, others = small.withColumnRenamed(key, "_lt_key"), [c for c in small.columns if c != key]
    if size.n <= rows and size.b <= 64 << 20:
        return big.join(F.broadcast(same), F.col(key).eqNullSafe(F.col("_lt_key")), "left").select(*big.columns, *others)
    dealt = big.withColumn("_lt_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = same.withColumn("_lt_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = F.col(key).eqNullSafe(F.col("_lt_key")) & (F.col("_lt_salt") == F.col("_lt_part"))
    return dealt.join(copies, met, "left").select(*big.columns, *others)


def utf8_buffer(column: pa.Array | pa.ChunkedArray):
    """(bytes as uint8 array, offsets as int64 array) of an Arrow string column; nulls are empty."""
    import numpy as np
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slabs(offsets, target: int):
    """Row ranges (lo, hi) of about ``target`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= target:
            hi += 1
        yield lo, hi
        lo = hi
