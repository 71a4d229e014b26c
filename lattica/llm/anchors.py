"""Finding repeated token windows without a row per position.

Every window of ``length`` consecutive tokens is represented by its anchor: the ``gram``-token
string inside it with the smallest hash (leftmost on ties). Equal windows have equal anchors at
equal offsets, and consecutive windows mostly share theirs, so a text becomes *runs* of windows
(one row per about ``(length - gram) / 2`` tokens). A run whose anchor occurs nowhere else holds
no repeated window and is dropped. Equal runs of the others are counted, so that copies enter the
operator's own method as one run of a weight, however many there are; what the method decides for the
distinct runs then goes to all occurrences.

Distinct runs of one anchor meet in one task, unless there are more than ``gathered`` allows (a quarter of a
task's mean share, within ``HOT`` and ``MOST``): windows of such anchors are rows of their own, which the
operators count with sums before every shuffle.

All windows are judged on the input. No run, window or text is dropped or capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slabs, utf8_buffer, written

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_INDEX = U64((1 << 28) - 1)
SLAB = 1 << 19
HOT, MOST = 256, 2048

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE):
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U64))
        _powers[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums whose differences hash any stretch (see ``stretch``)."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values), base)[0], out=out[1:])
    return out


def stretch(sums: np.ndarray, at, length, base: int = _BASE) -> np.ndarray:
    """Hash of ``length`` tokens from each of ``at``, the same wherever they stand."""
    return mix((sums[at + length] - sums[at]) * powers(len(sums), base)[1][at])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by block-wise prefix and suffix minima."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, U64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Bytes:
    """Tokens are the UTF-8 bytes of the text."""

    _table = mix(np.arange(1, 257, dtype=U64) * U64(_BASE2))

    def __init__(self, length: int = 400, gram: int = 96):
        self.length, self.gram = length, gram

    def tokens(self, raw: np.ndarray, offsets: np.ndarray):
        """(tokens, token offsets of the rows, byte start and byte end of each token)."""
        return raw[offsets[0] : offsets[-1]], offsets - offsets[0], None, None

    def hashed(self, tokens: np.ndarray) -> np.ndarray:
        return self._table[tokens]

    def cut(self, text: bytes, spans) -> bytes:
        kept, at = [], 0
        for s, e in spans:
            kept.append(text[at:s])
            at = e
        kept.append(text[at:])
        return b"".join(kept)

    def size(self, text: bytes) -> int:
        return len(text)


class Words:
    """Tokens are the maximal runs of characters other than space and U+0009 to U+000D."""

    _table = Bytes._table

    def __init__(self, length: int = 35, gram: int = 6):
        self.length, self.gram = length, gram

    def tokens(self, raw: np.ndarray, offsets: np.ndarray):
        """As of ``Bytes``; a token is the hash of a word. More than a slab of bytes goes in stretches that end between words."""
        found, at, hi = [], int(offsets[0]), int(offsets[-1])
        while at < hi or not found:
            end = at + SLAB
            if end < hi:
                row = int(offsets[np.searchsorted(offsets, end)])
                while end < row and not _SPACE[raw[end : end + 4096]].any():
                    end += 4096
                end = min(row, end + int(np.argmax(_SPACE[raw[end : end + 4096]])) if end < row else row)
            end = min(end, hi)
            found.append(self._words(raw[at:end], offsets - at, at - int(offsets[0])))
            at = end
        values, start, stop = (np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]
        return values, np.searchsorted(start, offsets - offsets[0]), start, stop

    def _words(self, data: np.ndarray, rows: np.ndarray, shift: int):
        n = len(data)
        inner = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[rows[(rows >= 0) & (rows < n)]] = True  # rows begin new words
        begins, ends = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1] | first[1:n]
        ends[:-1] &= ~inner[1:] | first[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = prefix(self._table[data], _BASE2)
        values = stretch(sums, start, end - start, _BASE2) if len(start) else np.zeros(0, U64)
        return values, start + shift, end + shift

    def hashed(self, tokens: np.ndarray) -> np.ndarray:
        return tokens

    def cut(self, text: bytes, spans) -> bytes:
        words = text.split()
        kept, at = [], 0
        for s, e in spans:
            kept += words[at:s]
            at = e
        return b" ".join(kept + words[at:])

    def size(self, text: bytes) -> int:
        return len(text.split())


def find_runs(unit, values: np.ndarray, rows: np.ndarray):
    """Runs of windows with one anchor: (row, first window in row, windows, anchor offset, key, content).

    ``rows`` are the token offsets of the texts. A text longer than a slab is handled in
    overlapping stretches, so that no step holds more than a slab.
    """
    length, gram = unit.length, unit.gram
    w = length - gram + 1
    lens = np.diff(rows)
    pieces = []
    for lo, hi in slabs(rows, SLAB):
        first, last = int(rows[lo]), int(rows[hi])
        if int(lens[lo:hi].max(initial=0)) < length:
            continue
        for a in range(first, last - length + 1, SLAB) if hi == lo + 1 else (first,):
            b = min(last, a + SLAB + length - 1) if hi == lo + 1 else last
            n = b - a
            sums = prefix(unit.hashed(values[a:b]))
            grams = mix((sums[gram:] - sums[:-gram]) * powers(n)[1][: n - gram + 1])
            best = sliding_min((grams & ~_INDEX) | np.arange(len(grams), dtype=U64), w) & _INDEX
            best = best.astype(np.int64)
            row = np.repeat(np.arange(lo, hi), np.minimum(np.maximum(rows[lo + 1 : hi + 1] - a, 0), n) - np.minimum(np.maximum(rows[lo:hi] - a, 0), n))[: len(best)]
            ok = np.arange(a, a + len(best)) + length <= rows[row + 1]
            turn = np.ones(len(best), bool)
            turn[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
            begin = np.flatnonzero(turn & ok)
            if not len(begin):
                continue
            stop = np.append(np.flatnonzero(turn | ~ok), len(best))
            count = stop[np.searchsorted(stop, begin, side="right")] - begin
            content = stretch(sums, begin, count + (length - 1)) + count.astype(U64)
            pieces.append((row[begin], begin + a - rows[row[begin]], count, best[begin] - begin, grams[best[begin]], content))
    if not pieces:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    return tuple(np.concatenate(c) for c in zip(*pieces))


def merged(start: np.ndarray, end: np.ndarray):
    """Union of half-open intervals, sorted."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


_PLACES = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int32()), ("s", pa.int32())]))


def runs_of(docs: DataFrame, unit) -> DataFrame:
    """Rows of runs, equal ones of a slab in one: k anchor, c content, n windows, o anchor offset, at: text (u, v) and first window s of each."""

    def work(batches):
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(0))
            u, v = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for lo, hi in slabs(offsets, SLAB):
                values, rows, _, _ = unit.tokens(raw, offsets[lo : hi + 1])
                row, s, n, o, k, c = find_runs(unit, values, rows)
                if not len(row):
                    continue
                order = np.lexsort((c, k))
                lead = np.ones(len(order), bool)
                lead[1:] = (k[order][1:] != k[order][:-1]) | (c[order][1:] != c[order][:-1])
                first, cuts = order[lead], np.append(np.flatnonzero(lead), len(order)).astype(np.int32)
                places = [u[lo + row[order]], v[lo + row[order]], s[order].astype(np.int32)]
                at = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x) for x in places], fields=list(_PLACES.value_type)))
                cols = [k[first].view(np.int64), c[first].view(np.int64), n[first].astype(np.int32), o[first].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), at], names=["k", "c", "n", "o", "at"])

    return docs.select("_lt_text", "_lt_u", "_lt_v").mapInArrow(work, "k long, c long, n int, o int, at array<struct<u:long,v:int,s:int>>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and two hashes of both that name the text in what follows.

    Rows that repeat id and text share their name: each is an occurrence, and each gets the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_lt_id"),
        text.alias("_lt_text"),
        F.xxhash64(F.col(id_col), text).alias("_lt_u"),
        F.hash(F.col(id_col), text).alias("_lt_v"),
    )


def gathered(contents: DataFrame) -> int:
    """Distinct runs of one anchor that may meet in one task: what neither tilts nor fills it."""
    tasks = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(HOT, MOST), max(HOT, contents.count() // (4 * tasks)))


def shared_runs(docs: DataFrame, unit, tag: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, contents) of the runs whose anchor occurs more than once.

    Occurrences: k, c, at (places). Contents, one row per distinct run, copies counted before they are
    shuffled: k, c, m occurrences, u, v, s, n, o of one of them, d distinct runs of the anchor.
    """
    runs = written(runs_of(docs, unit), f"{tag}-runs")
    repeated = runs.groupBy("k").agg(F.sum(F.size("at")).alias("t")).where("t > 1").select("k")
    shared = written(runs.join(repeated, "k", "left_semi"), f"{tag}-shared")
    drop(runs)
    one = F.col("at")[0]
    contents = shared.groupBy("k", "c").agg(F.sum(F.size("at")).alias("m"), F.min(F.struct(one["u"].alias("u"), one["v"].alias("v"), one["s"].alias("s"), "n", "o")).alias("x"))
    contents = contents.select("k", "c", F.least("m", F.lit(1 << 30)).cast("int").alias("m"), "x.*")
    d = contents.groupBy("k").agg(F.count("*").alias("d"))
    contents = written(contents.join(d, "k"), f"{tag}-contents")
    return shared.select("k", "c", "at"), contents


def cut(docs: DataFrame, contents: DataFrame, work, schema: str) -> DataFrame:
    """Rows that ``work(tokens, run)`` makes of the text of each content's run (k, c, m, n, o, hot)."""
    wanted = contents.groupBy("u", "v").agg(F.collect_list(F.struct("k", "c", "m", "s", "n", "o", "hot")).alias("w"))
    held = docs.join(wanted, (F.col("_lt_u") == F.col("u")) & (F.col("_lt_v") == F.col("v")))
    # rows that repeat id and text share their name; one of them stands for all
    held = held.groupBy("u", "v").agg(F.first("_lt_text").alias("_lt_text"), F.first("w").alias("w"))
    return held.select("_lt_text", "w").mapInArrow(work, schema)


def cutter(unit, names: list[str], kinds: list[pa.DataType], rows_of):
    """Feeds the tokens of one run after the other to ``rows_of`` (tokens, run) and collects its columns in batches."""

    def work(batches):
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                raw, offsets = utf8_buffer(batch.column(0).slice(i, 1))
                values, _, _, _ = unit.tokens(raw, offsets)
                for run in batch.column(1)[i].as_py():
                    held.append(rows_of(values[run["s"] : run["s"] + run["n"] + unit.length - 1], run))
                    size += sum(x.nbytes for x in held[-1])
                    if size > 2 * SLAB:
                        yield _joined(held, names, kinds)
                        held, size = [], 0
            if held:
                yield _joined(held, names, kinds)

    return work


def _joined(held, names, kinds) -> pa.RecordBatch:
    cols = []
    for i, kind in enumerate(kinds):
        if kind == pa.binary():
            cols.append(pa.array([x[i].tobytes() for x in held], kind))
        else:
            cols.append(pa.array(np.concatenate([x[i] for x in held])).cast(kind))
    return pa.RecordBatch.from_arrays(cols, names=names)


def by_anchor(pieces: DataFrame, decide, schema: str) -> DataFrame:
    """Feeds whole anchors (k) of ``pieces``, about a slab of ``t`` at a time, to ``decide`` (a dict of columns, t as
    raw bytes with offsets), which returns the columns of ``schema``."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def flush(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        cols = {x: np.asarray(table.column(x)) for x in table.column_names if x != "t"}
        cols["t"] = utf8_buffer(table.column("t"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in decide(cols)], names=names)

    def work(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, offsets = np.asarray(batch.column("k")), utf8_buffer(batch.column("t"))[1]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
            at = 0
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if keys[lo] != last and size >= SLAB:
                    if lo > at:
                        held.append(batch.slice(at, lo - at))
                    yield flush(held)
                    held, size, at = [], 0, lo
                size += int(offsets[hi] - offsets[lo])
                last = keys[lo]
            held.append(batch.slice(at))
        if held:
            yield flush(held)

    # a fixed number of tasks: their work lies in the pieces' tokens, not in the bytes that adaptive execution sees
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(work, schema)


def remove_spans(docs: DataFrame, texts: DataFrame, found: DataFrame, unit, id_col: str) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_removed, spans (maximal removed token ranges), kept binary.

    ``found``: u, v, s, n stretches of repeated windows.
    """
    # a set: rows that repeat id and text share their name, and each gives the same stretches
    per_text = found.groupBy("u", "v").agg(F.collect_set(F.struct("s", "n")).alias("w"))
    joined = texts.join(per_text, (F.col("_lt_u") == F.col("u")) & (F.col("_lt_v") == F.col("v")), "left").select("_lt_id", "_lt_text", "w")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"

    def work(batches):
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            at = 0
            while at < batch.num_rows:
                held, size, begin = [], 0, at
                while at < batch.num_rows and size < 4 * SLAB:
                    text, spans = texts[at].as_py().encode(), []
                    size += len(text)
                    if lists[at].is_valid:
                        values = lists[at].values
                        s, n = (np.asarray(values.field(x)).astype(np.int64) for x in ("s", "n"))
                        a, b = merged(s, s + n - 1 + unit.length)
                        spans = list(zip(a.tolist(), b.tolist()))
                    held.append((unit.size(text), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], unit.cut(text, spans)))
                    at += 1
                n, removed, spans, kept = zip(*held)
                cols = [batch.column(0).slice(begin, at - begin), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "n_removed", "spans", "kept"])

    return joined.mapInArrow(work, schema)
