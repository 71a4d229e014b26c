"""Substring removal by a depth-limited radix sort of suffixes.

Only suffixes that share an anchor with another one (see ``anchors``) are sorted, copies of a run of
suffixes as one run of a weight. The sort never looks past ``length`` bytes. It starts from the
buckets (anchor, offset to it) and refines them by most-significant-digit passes. A digit is up to
``DIGIT`` bytes of the text; its value is the exact rank of these bytes among all of the task, found by
doubling from eight bytes on, so the order of digits is the order of the bytes. After each pass suffixes
alone in their bucket, with a weight of one, leave; buckets that survive the last pass hold exactly
the windows that occur more than once. A run that is the only one of its anchor is a bucket of its own and needs no pass.

Anchors with too many distinct runs for one task go through the same passes as DataFrame steps: rows of
suffixes with ``PASSES`` digits (64-bit names of a ``PASSES``-th of the window each), of which every pass counts the buckets.

Defined results: a null text is the empty text; a text shorter than ``length`` loses nothing;
windows may overlap and may repeat inside one text; rows that repeat an id or a text are
texts of their own and so copies of each other; an empty table gives no rows; extra columns
are ignored. Texts of any length are handled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import U64, Bytes, by_anchor, cut, cutter, gathered, keyed, prefix, remove_spans, shared_runs, stretch
from .common import written

DIGIT, PASSES = 64, 4


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct ones, and their number."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, int(new.sum())


def digit_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of the ``width`` bytes (a power of two) from each position among all; beyond the end count zeros."""
    step = min(width, 8)
    padded = np.concatenate([data, np.zeros(step, np.uint8)]).astype(U64)
    packed = np.zeros(len(data), U64)
    for i in range(step):
        packed = (packed << U64(8)) | padded[i : i + len(data)]
    rank = dense(packed)[0]
    while step < width:
        follows = np.zeros(len(rank), np.int64)
        follows[: max(len(rank) - step, 0)] = rank[step:]
        rank = dense(rank * (len(rank) + 1) + follows)[0]
        step *= 2
    return rank


def radix_groups(data: np.ndarray, suffix: np.ndarray, bucket: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes share their first ``depth`` bytes with another one of the same bucket (numbered from 0).

    ``weight`` counts a suffix as so many occurrences.
    """
    out = np.zeros(len(suffix), bool)
    if not len(suffix):
        return out
    width = min(DIGIT, 1 << (depth.bit_length() - 1))
    ranks = digit_ranks(data, width)
    alive, group = np.arange(len(suffix)), bucket.astype(np.int64)
    for at in [*range(0, depth - width, width), depth - width]:  # the last digit may overlap the one before
        group, n = dense(group * (len(data) + 1) + ranks[suffix[alive] + at])
        weights = np.bincount(group, weights=weight[alive], minlength=n)
        stay = weights[group] > 1
        alive, group = alive[stay], group[stay]
    out[alive] = True
    return out


def _sort(depth: int):
    """Decides whole anchors: columns k, c, m, n, o, t -> k, c and stretches [a, b) of repeated windows."""

    def decide(col):
        raw, offsets = col["t"]
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = col["n"].astype(np.int64)
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        anchor, _ = dense(col["k"])
        bucket, _ = dense(anchor[run] * np.int64(1 << 24) + (col["o"][run] - step))
        twice = radix_groups(raw, offsets[run] + step, bucket, col["m"][run], depth)
        begin, end = twice.copy(), twice.copy()
        begin[1:] &= ~(twice[:-1] & (run[1:] == run[:-1]))
        end[:-1] &= ~(twice[1:] & (run[1:] == run[:-1]))
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        return col["k"][run[a]], col["c"][run[a]], step[a].astype(np.int32), (step[b] + 1).astype(np.int32)

    return decide


def _sort_rows(suffixes: DataFrame, tag: str) -> DataFrame:
    """The passes as DataFrame steps: k, o (place to the anchor), d0..., m, c, i -> k, c, a, b."""
    left = written(suffixes, f"{tag}-suffixes")
    for p in range(PASSES):
        key = ["k", "o", *(f"d{i}" for i in range(p + 1))]
        often = left.groupBy(*key).agg(F.sum("m").alias("t")).where("t > 1").select(*key)
        left = written(left.join(often, key, "left_semi"), f"{tag}-suffixes")
    island = F.col("i") - F.row_number().over(Window.partitionBy("k", "c").orderBy("i"))
    return left.withColumn("g", island).groupBy("k", "c", "g").agg(F.min("i").alias("a"), (F.max("i") + 1).cast("int").alias("b")).drop("g")


def repeated_stretches(texts: DataFrame, contents: DataFrame, unit: Bytes, tag: str) -> DataFrame:
    """k, c, a, b: stretches [a, b) of the windows of distinct runs that occur more than once."""
    length = unit.length
    edges = np.linspace(0, length, PASSES + 1).astype(int)
    alone = contents.where("d = 1 AND m > 1").select("k", "c", F.lit(0).alias("a"), F.col("n").alias("b"))
    unsure = contents.where("d > 1").withColumn("hot", F.col("d") > gathered(contents))
    one = lambda x, kind: np.asarray([x], kind)

    def whole(tokens, run):
        return one(run["k"], np.int64), one(run["c"], np.int64), one(min(run["m"], 2), np.int32), one(run["n"], np.int32), one(run["o"], np.int32), tokens

    def single(tokens, run):
        n, sums = run["n"], prefix(unit.hashed(tokens))
        i = np.arange(n)
        digits = [stretch(sums, i + lo, hi - lo).view(np.int64) for lo, hi in zip(edges[:-1], edges[1:])]
        return np.full(n, run["k"]), np.full(n, run["c"]), np.full(n, min(run["m"], 2), np.int32), i.astype(np.int32), (run["o"] - i).astype(np.int32), *digits

    few = ["k", "c", "m", "n", "o", "t"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    pieces = cut(texts, unsure.where("NOT hot"), cutter(unit, few, kinds, whole), "k long, c long, m int, n int, o int, t binary")
    decided = alone.unionAll(written(by_anchor(pieces, _sort(length), "k long, c long, a int, b int"), f"{tag}-sorted"))
    if unsure.where("hot").isEmpty():
        return decided
    digits = [f"d{i}" for i in range(PASSES)]
    schema = "k long, c long, m int, i int, o int, " + ", ".join(f"{d} long" for d in digits)
    rows = cut(texts, unsure.where("hot"), cutter(unit, ["k", "c", "m", "i", "o", *digits], [*kinds[:5], *[pa.int64()] * PASSES], single), schema)
    return decided.unionAll(_sort_rows(rows, tag))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 96) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts anywhere else.

    Per row: the id, n_tokens (bytes), n_removed, spans (maximal removed byte ranges), kept (binary).
    """
    unit, tag = Bytes(length, gram), "suffix"
    texts = keyed(docs, id_col, text_col)
    occurrences, contents = shared_runs(texts, unit, tag)
    decided = repeated_stretches(texts, contents, unit, tag)
    found = occurrences.join(decided, ["k", "c"]).select(F.explode("at").alias("p"), "a", "b")
    found = found.select("p.u", "p.v", (F.col("p.s") + F.col("a")).alias("s"), (F.col("b") - F.col("a")).alias("n"))
    return remove_spans(docs, texts, found, unit, id_col)
