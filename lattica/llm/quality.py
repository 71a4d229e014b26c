"""Quality classifier by positive-unlabelled learning.

A logistic model minimises the non-negative unbiased risk: with prior p, positives P and
unlabelled U,

    p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)])

Positives are the trusted rows (label 1 of the training fold), the unlabelled set is every text outside
the held-out fold; label 0 is not used. With the logistic loss the risk is the larger of two convex functions, the
unbiased risk and its first part. If the second part is below zero at the minimum of the unbiased risk, the model has
fitted the positives among the unlabelled too closely: it then climbs back by lowering the weight of that
part, by bisection, until the part is zero, where the minimum of the larger one lies.

The prior is estimated from positives and unlabelled texts. A first model tells the two apart; above any
threshold of its score the share of unlabelled is at least the prior times that of positives, and where
only positives are left the two are equal. The prior is the ratio at the threshold with the smallest
ratio plus its confidence bound (the best bin of ``BINS``).

Means, deviations, histograms and every Newton step are sums over all rows, taken on the executors; the
driver sees one gradient and one curvature matrix per step.

Scores use the text only (``FEATURES``); ids, labels, language and source play no part.

Defined results: null counts as empty, the empty text gets the score of its (zero) features;
without positives the score is 0.5; repeated rows get equal
scores; rows of ``labels`` that repeat an id count once, the smallest label wins; a row without id is not held out
and has no label; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SLAB, U64, Words, mix
from .common import fresh, slabs, utf8_buffer, written

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeats_next", "distinct_pairs", "top_word", "upper", "digits",
    "bangs", "symbols", "pipes", "newlines", "stops", "non_ascii", "brackets", "all_caps", "marked_words",
)
STEPS, RIDGE, BISECTIONS = 12, 1e-3, 12
#: Score bins of the prior's estimate, its confidence (one minus) and slack.
BINS, DELTA, GAMMA = 1000, 0.1, 0.01

#: Byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 '!', 5 symbol, 6 pipe, 7 newline, 8 sentence mark, 9 non-ASCII, 10 bracket or quote.
_CLASS = np.zeros(256, np.uint8)
for _chars, _c in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"!", 4), (b"#$%&*+/<=>@^_~\\", 5), (b"|", 6), (b"\n", 7), (b".,;:?", 8), (b"()[]{}\"'`", 10)):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 9
_KINDS = 11


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) as float32."""
    n = len(offsets) - 1
    data = raw[offsets[0] : offsets[-1]]
    kind = _CLASS[data]
    text_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    c = np.bincount(text_of_byte * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    values, rows, start, end = Words(1).tokens(data, offsets - offsets[0])
    words = np.diff(rows).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(rows))
    per_word, size = np.maximum(words, 1), np.maximum(c.sum(axis=1), 1)

    def distinct(values, owner):
        """Distinct values and the largest count of one, per text."""
        if not len(values):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(v)))
        top = np.zeros(n)
        np.maximum.at(top, o[at], counts)
        return np.bincount(o[at], minlength=n).astype(np.float64), top

    kinds, top = distinct(values, owner)
    follows = owner[1:] == owner[:-1]
    again = np.bincount(owner[1:][follows & (values[1:] == values[:-1])], minlength=n)
    doubles, _ = distinct(mix(values[:-1][follows] * U64(3) + values[1:][follows]), owner[1:][follows])
    letters = np.maximum(c[:, 1] + c[:, 2], 1)
    upper_at = np.concatenate([[0], np.cumsum(kind == 1)])
    lower_at = np.concatenate([[0], np.cumsum(kind == 2)])
    mark_at = np.concatenate([[0], np.cumsum((kind == 4) | (kind == 5) | (kind == 6))])
    caps = (upper_at[end] - upper_at[start] > 1) & (lower_at[end] == lower_at[start]) if len(start) else np.zeros(0, bool)
    marked = mark_at[end] > mark_at[start] if len(start) else np.zeros(0, bool)
    squash = lambda x: np.log1p(20 * x)
    cols = [
        np.log1p(c.sum(axis=1)),
        np.log1p(words),
        np.log1p((c[:, 1] + c[:, 2] + c[:, 9]) / per_word),
        np.log((kinds + 1) / (words + 1)),
        squash(again / per_word),
        np.log((doubles + 1) / np.maximum(words, 1)),
        squash(top / per_word),
        c[:, 1] / letters,
        squash(c[:, 3] / size),
        squash(c[:, 4] / per_word),
        squash(c[:, 5] / per_word),
        squash(c[:, 6] / per_word),
        squash(c[:, 7] / per_word),
        squash(c[:, 8] / per_word),
        c[:, 9] / size,
        squash(c[:, 10] / per_word),
        squash(np.bincount(owner[caps], minlength=n) / per_word),
        squash(np.bincount(owner[marked], minlength=n) / per_word),
    ]
    return np.column_stack(cols).astype(np.float32)


def _featurise(df: DataFrame, text: str) -> DataFrame:
    """Replaces ``text``, the last column, by ``x`` array<float>."""
    schema = df.drop(text).withColumn("x", F.lit(None).cast("array<float>")).schema

    def work(batches):
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(batch.num_columns - 1))
            for lo, hi in slabs(offsets, SLAB):
                x = features(raw, offsets[lo : hi + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*arrays, lists], names=schema.names)

    return df.mapInArrow(work, schema)


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _summed(df: DataFrame, total, width: int) -> np.ndarray:
    """Sum over all batches of the vectors ``total(x, positive)``, by a Spark aggregation."""

    def work(batches):
        acc = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                acc += total(_matrix(batch.column(0)), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(acc)], names=["i", "s"])

    rows = df.select("x", "positive").mapInArrow(work, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.i] = r.s
    return out


def moments(train: DataFrame):
    """(texts, positives, mean, deviation) of rows of (x, positive)."""
    d = len(FEATURES)
    sums = _summed(train, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    mean = sums[2 : 2 + d] / max(sums[0], 1)
    dev = np.sqrt(np.maximum(sums[2 + d :] / max(sums[0], 1) - mean**2, 0))
    dev[dev < 1e-6] = 1
    return sums[0], sums[1], mean, dev


def fit(train: DataFrame, known, plus: float, minus: float) -> np.ndarray:
    """Weights, the constant last, that minimise plus * E_P[l(+)] + max(0, E_U[l(-)] - minus * E_P[l(-)])."""
    w, second, risk = newton(train, known, plus, minus, 1.0, np.zeros(len(FEATURES) + 1))
    low, high, best, least = 0.0, 1.0, w, risk
    for _ in range(BISECTIONS):
        if second >= 0 and high == 1 or abs(second) < 1e-3:
            break
        share = (low + high) / 2
        w, second, risk = newton(train, known, plus, minus, share, w)
        low, high = (low, share) if second < 0 else (share, high)
        if risk < least:
            best, least = w, risk
    return best


def newton(train: DataFrame, known, plus: float, minus: float, share: float, start: np.ndarray):
    """(weights, second part, clipped risk) at the minimum of plus * E_P[l(+)] + share * (E_U[l(-)] - minus * E_P[l(-)]), from ``start``."""
    n_u, n_p, mean, dev = known
    k = len(FEATURES) + 1
    penalty = RIDGE * np.append(np.ones(k - 1), 0)
    w = start
    best, best_risk, clipped, scale, step = start, np.inf, (0.0, np.inf), 1.0, np.zeros(k)
    for _ in range(STEPS):

        def total(x, positive, w=w):
            z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
            f = z @ w
            s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            good, bad, p = np.logaddexp(0, -f), np.logaddexp(0, f), positive
            curves = [((z[rows] * (s[rows] * (1 - s[rows]))[:, None]).T @ z[rows]).ravel() for rows in (slice(None), p)]
            return np.concatenate([[good[p].sum(), bad[p].sum(), bad.sum()], z[p].T @ (s[p] - 1), z[p].T @ s[p], z.T @ s, *curves])

        t = _summed(train, total, 3 + 3 * k + 2 * k * k)
        second = t[2] / n_u - minus * t[1] / n_p
        risk = plus * t[0] / n_p + share * second + 0.5 * (penalty * w * w).sum()
        if risk > best_risk + 1e-12:  # too long a step: half of it
            scale /= 2
            w = best + scale * step
            continue
        gain, best, best_risk, scale = best_risk - risk, w, risk, 1.0
        clipped = second, risk + max(second, 0.0) - share * second
        if gain < 1e-7:
            break
        g_good, g_bad, g_u = t[3 : 3 + k] / n_p, t[3 + k : 3 + 2 * k] / n_p, t[3 + 2 * k : 3 + 3 * k] / n_u
        curve_u, curve_p = (t[3 + 3 * k :].reshape(2, k, k) / np.array([n_u, n_p])[:, None, None])
        curve = share * curve_u + max(plus - share * minus, 0.0) * curve_p + np.diag(penalty + 1e-6)
        step = -np.linalg.solve(curve, plus * g_good + share * (g_u - minus * g_bad) + penalty * w)
        w = best + step
    return best, *clipped


def best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the counts of both by rising score."""
    n_p, n_u = p.sum(), u.sum()
    above_p, above_u = np.cumsum(p[::-1])[::-1] / n_p, np.cumsum(u[::-1])[::-1] / n_u
    above_p, above_u = above_p[above_p > 0], above_u[above_p > 0]
    bound = (1 + GAMMA) / above_p * (np.sqrt(np.log(4 / DELTA) / (2 * n_u)) + np.sqrt(np.log(4 / DELTA) / (2 * n_p)))
    at = np.argmin(above_u / above_p + bound)
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def estimate_prior(train: DataFrame, known) -> float:
    _, _, mean, dev = known
    w = fit(train, known, 1.0, 0.0)

    def total(x, positive):
        f = ((x - mean) / dev) @ w[:-1] + w[-1]
        at = np.minimum((BINS / (1 + np.exp(-np.clip(f, -30, 30)))).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at[positive], minlength=BINS), np.bincount(at, minlength=BINS)])

    counts = _summed(train, total, 2 * BINS)
    return best_bin(counts[:BINS], counts[BINS:])


def is_held_out(id_column):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(rows: DataFrame, labels: DataFrame):
    """The model (prior, mean, deviation, weights) from a table with id, held_out, x; None without positives."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))
    positives = known.where(~is_held_out(F.col("id"))).where("label = 1").select("id", F.lit(True).alias("positive"))
    train = rows.where(~F.col("held_out")).select("id", "x").join(positives, "id", "left")
    train = written(train.select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "train")
    known = moments(train)
    if not known[1]:
        return None
    prior = estimate_prior(train, known)
    return prior, *known[2:], fit(train, known, prior, prior)


def scores(x: np.ndarray, model) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    _, mean, dev, w = model
    f = ((x - mean) / dev) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The id, held_out, score and predicted of every row."""
    base = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_lt_text"))
    rows = written(_featurise(base, "_lt_text"), "features")
    model = learn(rows, labels)
    schema = rows.select("id", "held_out").withColumn("score", F.lit(0.0)).schema

    def work(batches):
        for batch in batches:
            score = scores(_matrix(batch.column(2)).reshape(-1, len(FEATURES)), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=schema.names)

    scored = rows.select("id", "held_out", "x").mapInArrow(work, schema)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged."""
    x = fresh(docs, "_lt_x")
    schema = docs.withColumn(x, F.lit(None).cast("array<float>")).schema
    at = docs.columns.index(text_col)

    def add(batches):
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(at))
            for lo, hi in slabs(offsets, SLAB):
                values = features(raw, offsets[lo : hi + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    rows = written(docs.mapInArrow(add, schema), "scored")
    model = learn(rows.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(x).alias("x")), labels)
    if model is None:
        score = F.lit(0.5)
    else:
        _, mean, dev, w = model
        slope = w[:-1] / dev
        terms = F.zip_with(F.col(x), F.array(*map(F.lit, slope.tolist())), lambda v, a: v.cast("double") * a)
        score = 1 / (1 + F.exp(-F.aggregate(terms, F.lit(float(w[-1] - mean @ slope)), lambda s, v: s + v)))
    return rows.where(score >= threshold).select(*docs.columns)
