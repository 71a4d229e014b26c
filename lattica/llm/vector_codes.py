"""Product quantisation of vectors in integers, by weighted Lloyd rounds over distinct parts.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. Equal parts of one
position are one row of a weight, so a value shared by a third of all vectors is assigned once a round. A round
is one Spark pass over the distinct parts: tasks assign them to the nearest entry of the (small) codebooks and
hand over sums per entry. Codes and errors of the distinct parts are then joined back to the vectors: values that hold
over a thousandth of the rows (at most a thousand a position) by broadcast, the others by a shuffle on the value.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter ones count as padded
with zeros to the longest, and all to a multiple of the number of parts; the codebooks start from the rows of the
smallest ids, rows that repeat an id in the order of their vectors, null ids last; with fewer rows than entries the codebooks have
fewer; repeated rows stay repeated; no row gives no row. Components beyond 2**28 in size raise an error. Columns other
than those named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, written
from .topk import usable

LIMIT = 1 << 28
HOT_SHARE = 1000


def integer_rows(df: DataFrame, id_col: str, vector: str, group_col: str | None, scale: float) -> DataFrame:
    """(row, id, grp, v array<int>) of the usable rows, written, so that ``row`` names a row for good."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    bounded = lambda x: F.when(x.between(-LIMIT, LIMIT), x.cast("int")).otherwise(F.raise_error(F.lit("component too large for integer codes")).cast("int"))
    found = df.where(usable(vector)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (F.col(group_col) if group_col else F.lit(None).cast("int")).alias("grp"),
        F.transform(F.transform(F.col(vector), whole), bounded).alias("v"),
    )
    return written(found, "codes-rows")


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, width)


def nearest(parts: np.ndarray, entries: np.ndarray):
    """Index of each part's nearest entry (ties to the lower) and the squared distance."""
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * top * top * max(1, parts.shape[1])
    if bound >= 2**63:
        raise OverflowError("squared distances beyond 64 bits")
    kind = np.float64 if bound < 2**53 else np.int64  # both exact
    p, e = parts.astype(kind), entries.astype(kind)
    d = (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]
    code = d.argmin(1)
    return code, d[np.arange(len(p)), code].astype(np.int64)


def _assigned(batch: pa.RecordBatch, books: np.ndarray):
    """Codes and errors of a batch of (j, part, ...)."""
    j = np.asarray(batch.column(0))
    parts = _lists(batch.column(1), books.shape[2])
    code, error = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
    for position in np.unique(j):
        at = np.flatnonzero(j == position)
        code[at], error[at] = nearest(parts[at], books[position])
    return j, parts, code, error


def _round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one weighted Lloyd round."""
    entries, width = books.shape[1:]

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            j, parts, code, _ = _assigned(batch, books)
            n = np.asarray(batch.column(2))
            if int(np.abs(parts).max(initial=0)) * int(n.sum()) >= 2**62:
                raise OverflowError("sums of a batch beyond 64 bits")
            slot = j * entries + code
            held, at = np.unique(slot, return_inverse=True)
            sums, count = np.zeros((len(held), width), np.int64), np.zeros(len(held), np.int64)
            np.add.at(sums, at, parts * n[:, None])
            np.add.at(count, at, n)
            whole = np.column_stack([count, sums])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(held, width + 1)), pa.array(np.tile(np.arange(width + 1), len(held))), pa.array(whole.ravel())],
                names=["slot", "at", "s"],
            )

    found = distinct.mapInArrow(work, "slot long, at long, s long").groupBy("slot", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total: dict[int, dict[int, int]] = {}
    for r in found.collect():  # at most one row per codebook component
        total.setdefault(r.slot, {})[r["at"]] = int(r.s)
    books = books.copy()
    for slot, sums in total.items():
        books[slot // entries, slot % entries] = [sums[k + 1] // sums[0] for k in range(width)]
    return books


def compress(
    df: DataFrame, id_col: str, vector: str, group_col: str | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0
) -> tuple[DataFrame, np.ndarray]:
    """(id, grp, codes array<int>, error long) of every usable vector, and the codebooks as (parts, entries, width)."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = integer_rows(df, id_col, vector, group_col, scale)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    width = max(1, -(-size.d // parts))
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for k, r in enumerate(first):
        padded = np.zeros(parts * width, np.int64)
        padded[: len(r.v)] = r.v
        books[:, k] = padded.reshape(parts, width)
    padded = F.when(F.size("v") == parts * width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("v"))))
    cut = F.array(*(F.slice("w", j * width + 1, width) for j in range(parts)))
    pieces = rows.withColumn("w", padded).select("row", "id", "grp", F.posexplode(cut).alias("j", "part"))
    distinct = written(pieces.groupBy("j", "part").agg(F.count("*").alias("n")), "codes-distinct")
    if not first:
        return rows.select("id", "grp", F.col("v").alias("codes"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        books = _round(distinct, books)

    def assign(batches, books=books):
        for batch in batches:
            _, _, code, error = _assigned(batch, books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32)), pa.array(error)], names=["j", "part", "n", "code", "error"])

    known = written(distinct.mapInArrow(assign, "j int, part array<int>, n long, code int, error long"), "codes-known")
    hot = F.broadcast(known.where(F.col("n") > size.n // HOT_SHARE).drop("n"))
    by = ["j", "part"]
    found = pieces.join(hot, by).unionByName(pieces.join(hot, by, "left_anti").join(known.where(F.col("n") <= size.n // HOT_SHARE).drop("n"), by))
    coded = found.groupBy("row", "id", "grp").agg(F.array_sort(F.collect_list(F.struct("j", "code"))).alias("c"), F.sum("error").alias("error"))
    out = written(coded.select("id", "grp", F.col("c.code").alias("codes"), "error"), "codes")
    for finished in (rows, distinct, known):
        drop(finished)
    return out, books


def codebook_text(books: np.ndarray) -> str:
    """All entries' components as decimals, by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))
