"""Exact top-k search by exhaustive term-at-a-time accumulation.

Each query row is a sparse list of (dimension, weight). For a block of candidates the
postings of every dimension are laid out once; queries then scatter weight * posting into
dense score arrays, one dimension after the other, a partition selection keeps the k best of
the block, and the lists of all blocks are merged by a window that Spark limits per task.

Queries are dealt into groups of at most ``MAX_QUERIES`` rows (the only thing broadcast, and
its size is checked). Each group passes over all candidates, so neither side is capped; where there are
several, one after the other is broadcast, answered into the shared folder and released.

Defined results: vectors that are null or hold null or non-finite components take no part;
a shorter vector counts as padded with zeros; an empty vector scores 0 with every other;
rows that repeat an id are separate candidates, but none with the query's own id counts;
rows that repeat a query id give one list; ties go to the smaller id. Scores beyond 64 bits, which
no column could hold, raise an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

MAX_QUERIES = 32_768
MAX_QUERY_BYTES = 64 << 20


def usable(vector: str):
    """Vector present, with finite components only."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def quantised(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """(id long, v array<long>) of the usable rows, floor(scale * x) in each component."""
    return df.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )


def _matrix(batch: pa.RecordBatch, dims: int):
    """ids and a (dims, rows) matrix of a batch of (id, v)."""
    lists = batch.column(1)
    offsets = np.asarray(lists.offsets)
    lengths = np.diff(offsets)
    values = np.asarray(lists.values)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(lists), max(dims, int(lengths.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return np.asarray(batch.column(0)), np.ascontiguousarray(out.T)


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Positions of the k best by (score down, id up)."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        pos = np.flatnonzero(scores >= edge)
        if len(pos) > 4 * k:  # many ties at the edge: all above it, then the smallest ids of those on it
            above, tied = pos[scores[pos] > edge], pos[scores[pos] == edge]
            need = k - len(above)
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
            pos = np.concatenate([above, tied])
    else:
        pos = np.arange(len(scores))
    return pos[np.lexsort((ids[pos], -scores[pos]))][:k]


def _accumulate(postings, query: np.ndarray, out: np.ndarray) -> None:
    """Term at a time: out[query, row] += weight * posting value, over the postings of each dimension."""
    out[:] = 0
    for t, (rows, values) in enumerate(postings):
        if t >= query.shape[1] or not len(values):
            continue
        have = np.flatnonzero(query[:, t])
        for q in have:
            if rows is None:
                out[q] += query[q, t] * values
            else:
                out[q, rows] += query[q, t] * values


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def _scan(queries, k: int, block: int = 4096, q_block: int = 32):
    q_ids, q_vecs = queries

    def work(batches):
        n_q = len(q_ids)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_q
        seen = False
        for whole in batches:
            for lo in range(0, whole.num_rows, block):
                seen = True
                ids, cols = _matrix(whole.slice(lo, block), q_vecs.shape[1])
                bound = _largest(cols) * _largest(q_vecs) * max(1, cols.shape[0])
                if bound >= 2**63:
                    raise OverflowError("components too large for 64-bit scores")
                kind = np.int32 if bound < 2**31 - 1 else np.int64
                cols, weights = cols.astype(kind), q_vecs.astype(kind)
                postings = []
                for col in cols:
                    rows = np.flatnonzero(col)
                    postings.append((None, col) if 2 * len(rows) > len(col) else (rows, col[rows]))
                scores = np.empty((q_block, len(ids)), kind)
                for q0 in range(0, n_q, q_block):
                    part = weights[q0 : q0 + q_block]
                    _accumulate(postings, part, scores[: len(part)])
                    for j in range(len(part)):
                        row, own = scores[j], ids == q_ids[q0 + j]
                        usable_ids = ids
                        if own.any():
                            row, usable_ids = row[~own], ids[~own]
                        pos = _best(row, usable_ids, k)
                        old_s, old_i = best[q0 + j]
                        s, i = np.concatenate([old_s, row[pos].astype(np.int64)]), np.concatenate([old_i, usable_ids[pos]])
                        top = _best(s, i, k)
                        best[q0 + j] = (s[top], i[top])
        if seen:
            for q0 in range(0, n_q, 2048):
                part = best[q0 : q0 + 2048]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids[q0 : q0 + 2048], [len(s) for s, _ in part])),
                        pa.array(np.concatenate([i for _, i in part])),
                        pa.array(np.concatenate([s for s, _ in part])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return work


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query (id, v) its k best candidates: query_id, rank (from 1), vec_id, score."""
    spark = candidates.sparkSession
    queries = queries.dropDuplicates(["id"])
    sized = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    per_group = max(1, min(MAX_QUERIES, MAX_QUERY_BYTES // (8 * max(1, sized.d))))
    # twice the needed groups, so that a hash-dealt group stays below the bound
    n_groups = 1 if sized.n <= per_group else -(-2 * sized.n // per_group)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def best(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    parts = []
    for g in range(n_groups):
        mine = queries if n_groups == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(n_groups)) == g)
        rows = mine.toArrow()
        if rows.num_rows > per_group:
            raise RuntimeError(f"query group of {rows.num_rows} rows exceeds {per_group}")
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks().sort_by("id").to_batches()[0]
        ids, cols = _matrix(rows, sized.d)
        held = spark.sparkContext.broadcast((ids, np.ascontiguousarray(cols.T)))

        def work(batches, held=held):
            return _scan(held.value, k)(batches)

        part = best(candidates.select("id", "v").mapInArrow(work, "query_id long, vec_id long, score long"))
        if n_groups > 1:
            part = written(part, "topk")
            held.destroy()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionAll, parts)
