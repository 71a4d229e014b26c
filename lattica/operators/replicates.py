"""Bootstrap intervals and nested power of rankings, for many replicates at once.

Two schemes draw replicates: ``candidate`` draws candidates with replacement, ``term_block`` draws terms, and a candidate
weighs the product of its three terms' counts. Nested runs redraw the terms first (an outer, pseudo replication) and draw within that.

Most candidates matter to a replicate only by sums: the weight of each subset and of its positives. So every candidate gets a
category (its subsets and label), and one pass over blocks of candidates, a matrix product per block, gives the weights of
all categories in all replicates; draws are made anew from their seed wherever they are needed. The precision at k needs
the order, but only as far as k units of weight reach: the head of each ranking, of a length set by the largest k and made longer
while a replicate is left open. Under the ``candidate`` scheme candidates outside the heads are drawn as whole categories, which is the
same multinomial distribution. No row per candidate and replicate exists anywhere; what is broadcast or collected (heads, categories,
terms) is bounded by parameters or by the vocabulary.

The precision at k is that of the first k units of weight; the candidate that crosses counts in part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import kept
from .hypergraph import TRIAD
from .ranks import numbered

BLOCK, CHUNK, HEAD = 16_384, 125, 64
SCHEMES = ("candidate", "term_block")


@dataclass
class Study:
    """What is drawn and ranked.

    ``pool``: a, b, c, y and what the columns below read, a row per candidate; ``subsets``: name -> condition on the pool;
    ``rankings``: name -> (condition, total order); ``positives``: a, b, c of what should be found, ``marks``: name -> condition on them.
    """

    pool: DataFrame
    rankings: dict[str, tuple[Column, list[Column]]]
    subsets: dict[str, Column]
    positives: DataFrame | None = None
    marks: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Lift:
    """Precision at k of a ranking over the share of positives in a subset."""

    ranking: str
    subset: str


@dataclass(frozen=True)
class Difference:
    """Precision at k of one ranking less that of another, which may order other candidates."""

    one: str
    two: str


@dataclass(frozen=True)
class RecallDifference:
    """Share of the positives under one mark less that under another."""

    one: str
    two: str


def _conditions(conditions: dict[str, Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))


def outer_counts(seed: int, outer: int, terms: int, redraw: bool) -> np.ndarray:
    """How often each term stands in a pseudo replication; once without redrawing."""
    return np.random.default_rng([seed, outer]).multinomial(terms, np.full(terms, 1 / terms)) if redraw else np.ones(terms, np.int64)


def term_draws(seed: int, outer: int, chunk: int, counts: np.ndarray, size: int) -> np.ndarray:
    """(terms, size): counts of the terms in ``size`` inner replicates."""
    return np.random.default_rng([seed, outer, chunk, 1]).multinomial(len(counts), counts / counts.sum(), size=size).T.astype(np.float32)


def stays(seed: int, outer: int, triads: np.ndarray, keep: float) -> np.ndarray:
    """Which triads a pseudo replication keeps as positives, by a hash of their terms' numbers."""
    if keep >= 1:
        return np.ones(len(triads), bool)
    h = np.full(len(triads), (seed * 0x9E3779B97F4A7C15 + outer * 0xBF58476D1CE4E5B9) % 2**64, np.uint64)
    for t in triads.T:
        h ^= t.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53 < keep


def _chunks(inner: int) -> list[int]:
    return [min(CHUNK, inner - lo) for lo in range(0, inner, CHUNK)]


def category_weights(triads: np.ndarray, cats: np.ndarray, n_cats: int, draws: np.ndarray) -> np.ndarray:
    """(categories, replicates): total product of the three terms' counts of the rows of each category."""
    out = np.zeros((n_cats, draws.shape[1]))
    for lo in range(0, len(triads), 512):
        t = triads[lo : lo + 512]
        w = draws[t[:, 0]] * draws[t[:, 1]]
        w *= draws[t[:, 2]]
        member = np.zeros((n_cats, len(t)), np.float32)
        member[cats[lo : lo + 512], np.arange(len(t))] = 1
        out += member @ w
    return out


def precisions(w: np.ndarray, y: np.ndarray, ks: list[int], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ks, replicates) precision at each k of rows in order with weights (rows, replicates), and which replicates need more rows than these."""
    out, still = np.full((len(ks), w.shape[1]), np.nan), np.zeros(w.shape[1], bool)
    if not len(w):
        return out, still | (not whole)
    cum, hits, at = np.cumsum(w, 0), np.cumsum(w * y[:, None], 0), np.arange(w.shape[1])
    for n, k in enumerate(ks):
        reached = cum[-1] >= k
        i = (cum >= k).argmax(0)
        before, found = cum[i, at] - w[i, at], hits[i, at] - w[i, at] * y[i]
        out[n] = (found + (k - before) * y[i]) / k
        rest = np.divide(hits[-1], cum[-1], out=np.full(w.shape[1], np.nan), where=cum[-1] > 0)
        out[n, ~reached] = rest[~reached]
        still |= ~reached & (not whole)
    return out, still


def along(weight, head: np.ndarray, y: np.ndarray, ks: list[int], whole: bool, size: int) -> tuple[np.ndarray, bool]:
    """``precisions`` of ``size`` replicates over a head, a few rows first, then more for those replicates that need them.

    ``weight`` (rows, replicates) gives a part of the weights; ``whole`` says that nothing comes behind the head."""
    out, left, end = np.full((len(ks), size), np.nan), np.arange(size), min(len(head), 2 * max(ks))
    while True:
        rows = head[:end]
        out[:, left], still = precisions(weight(rows, left), y[rows], ks, whole and end == len(head))
        if end == len(head) or not still.any():
            return out, bool(still.any())
        left, end = left[still], min(len(head), 4 * end)


def _bounds(values: np.ndarray, tail: float) -> tuple[float | None, float | None, int]:
    good = values[~np.isnan(values)]
    if not len(good):
        return None, None, 0
    lower, upper = np.percentile(good, [100 * tail, 100 * (1 - tail)])
    return float(lower), float(upper), len(good)


def _prepared(study: Study):
    """(indexed rows a, b, c, cat, pool as numbers, named pool, terms, masks of the categories)."""
    pool = study.pool.withColumn("_mask", _conditions(study.subsets)).withColumn("_y", F.col("y").cast("int"))
    named = [pool.select(*TRIAD, "_mask", "_y", F.lit(0).alias("_side"))]
    if study.positives is not None:
        named.append(study.positives.select(*TRIAD, _conditions(study.marks).alias("_mask"), F.lit(1).alias("_y"), F.lit(1).alias("_side")))
    rows = kept(reduce(DataFrame.unionAll, named), "study")
    terms = numbered(rows.select(F.explode(F.array(*TRIAD)).alias("term")).distinct(), [F.col("term")], "t")
    terms = kept(terms.select("term", (F.col("t") - 1).cast("int").alias("t")), "study-terms")
    met = sorted({(r["_side"], r["_mask"]) for r in rows.select("_side", "_mask").distinct().collect()})  # at most two to the number of conditions
    # of each (side, mask) first the rows that are no positives, then those that are
    cats = {key: 2 * i for i, key in enumerate(met)}
    number = F.coalesce(*(F.when((F.col("_side") == s) & (F.col("_mask") == m), F.lit(c)) for (s, m), c in cats.items()), F.lit(0)) + F.col("_y")

    def indexed(df: DataFrame) -> DataFrame:
        for t in TRIAD:
            df = df.join(terms.select(F.col("term").alias(t), F.col("t").alias(f"i_{t}")), t)
        return df

    return rows, indexed, pool, number, terms.count(), cats


def _sums(rows: DataFrame, indexed, number: Column, n_terms: int, n_cats: int, outer: int, inner: int, seed: int, redraw: bool, keep: float) -> DataFrame:
    """(outer, chunk, w): weights of the categories in the replicates of a chunk, flat; chunk -1 has those of the pseudo replication itself."""
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // BLOCK))
    cells = indexed(rows.withColumn("cat", number)).withColumn("block", F.pmod(F.xxhash64(*TRIAD), F.lit(blocks)))
    packed = cells.groupBy("block").agg(F.collect_list(F.struct("i_a", "i_b", "i_c", "cat")).alias("x"))
    tasks = max(1, spark.sparkContext.defaultParallelism)
    splits = max(1, blocks // 8)
    ranges = min(outer, max(1, -(-2 * tasks // splits)))
    cuts = F.array(*(F.struct(F.lit(outer * i // ranges).alias("lo"), F.lit(outer * (i + 1) // ranges).alias("hi")) for i in range(ranges)))
    work_rows = packed.withColumn("r", F.explode(cuts)).select("r.lo", "r.hi", "block", "x")
    work_rows = work_rows.repartition(ranges * splits, "lo", F.col("block") % splits)

    def work(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lo, hi, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                x = lists.values
                triads = np.column_stack([np.asarray(x.field(i)) for i in range(3)])
                cat = np.asarray(x.field(3)).astype(np.int64)
                for o in range(lo, hi):
                    counts = outer_counts(seed, o, n_terms, redraw)
                    lost = (cat % 2 == 1) & ~stays(seed, o, triads, keep)
                    own = np.where(lost, cat - 1, cat)
                    parts = [(-1, counts[:, None].astype(np.float32))] + [(c, term_draws(seed, o, c, counts, n)) for c, n in enumerate(_chunks(inner))]
                    for c, draws in parts:
                        w = category_weights(triads, own, n_cats, draws)
                        total[o, c] = total[o, c] + w if (o, c) in total else w
        for (o, c), w in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([o]), pa.array([c]), pa.array([w.ravel()], pa.list_(pa.float64()))], names=["outer", "chunk", "w"])

    return work_rows.mapInArrow(work, "outer long, chunk long, w array<double>")


def bounds(study: Study, measures: dict[str, Lift | Difference | RecallDifference], ks: list[int], outer: int = 1, inner: int = 1000, seed: int = 0, redraw: bool = False, keep: float = 1.0, level: float = 0.95) -> DataFrame:
    """(outer, scheme, measure, k, lower, upper, valid): percentile bounds of every measure over the inner replicates of each outer one.

    Measures without k have it null; ``valid`` counts replicates in which the measure is defined. An outer replicate in which no candidate is left gives no rows.
    """
    rows, indexed, pool, number, n_terms, cats = _prepared(study)
    schema = "outer long, scheme string, measure string, k int, lower double, upper double, valid long"
    if not n_terms:
        return rows.sparkSession.createDataFrame([], schema)
    n_cats = 2 * len(cats)
    sums = kept(_sums(rows, indexed, number, n_terms, n_cats, outer, inner, seed, redraw, keep), "study-sums")
    n_rows = {r["_side"]: r.n for r in rows.groupBy("_side").agg(F.count("*").alias("n")).collect()}
    names = list(study.rankings)
    sizes = {name: pool.where(where).count() for name, (where, _) in study.rankings.items()}
    side = {s: np.array([c + y for (t, _), c in cats.items() if t == s for y in (0, 1)], np.int64) for s in (0, 1)}

    def of(conditions: dict[str, Column], s: int) -> dict[str, np.ndarray]:
        """Categories (those of positives: the odd ones) under each condition."""
        return {name: np.array([c + y for (t, m), c in cats.items() if t == s and m >> i & 1 for y in (0, 1)], np.int64) for i, name in enumerate(conditions)}

    subset, mark = of(study.subsets, 0), of(study.marks, 1)
    tail = (1 - level) / 2
    length = HEAD * max(ks)
    while True:
        heads, found = {}, {}
        for name, (where, order) in study.rankings.items():
            top = pool.where(where).orderBy(*order).limit(length).select(*TRIAD, "_mask", "_y", F.lit(0).alias("_side"), F.monotonically_increasing_id().alias("_at"))
            got = indexed(top.withColumn("cat", number)).orderBy("_at").select("i_a", "i_b", "i_c", "cat").collect()  # at most ``length`` rows
            heads[name] = [found.setdefault(tuple(r)[:3], (len(found), r.cat))[0] for r in got]
        triads = np.array(list(found), np.int64).reshape(-1, 3)
        head_cat = np.array([c for _, c in found.values()], np.int64)
        held = rows.sparkSession.sparkContext.broadcast((triads, head_cat, {n: np.array(v, np.int64) for n, v in heads.items()}))

        def evaluate(batches, held=held, length=length):
            triads, head_cat, heads = held.value
            for batch in batches:
                for o, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts: dict[int, np.ndarray] = {}
                    for x in lists:
                        w = np.array(x["w"]).reshape(n_cats, -1)
                        parts[x["chunk"]] = parts[x["chunk"]] + w if x["chunk"] in parts else w
                    base = parts.pop(-1)[:, 0]
                    if base[side[0]].sum() <= 0 or (1 in n_rows and base[side[1]].sum() <= 0):
                        continue
                    counts = outer_counts(seed, o, n_terms, redraw)
                    own = np.where((head_cat % 2 == 1) & ~stays(seed, o, triads, keep), head_cat - 1, head_cat)
                    y = (own % 2).astype(np.float64)
                    pseudo = counts[triads].prod(1).astype(np.float64)
                    rest = np.maximum(base - np.bincount(own, weights=pseudo, minlength=n_cats), 0)[side[0]]
                    # the candidate scheme draws one by one what k draws can reach in a ranking, all else by category
                    share, most = n_rows[0] / base[side[0]].sum(), max(ks) + 10 * max(ks) ** 0.5 + 30
                    reach = {n: int(np.searchsorted(np.cumsum(pseudo[h]) * share, most)) + 1 for n, h in heads.items()}
                    single = np.unique(np.concatenate([h[: reach[n]] for n, h in heads.items()]))
                    place = np.full(len(triads), -1, np.int64)
                    place[single] = np.arange(len(single))
                    behind = np.delete(np.arange(len(triads)), single)
                    rest = rest + np.bincount(own[behind], weights=pseudo[behind], minlength=n_cats)[side[0]]
                    cells = np.concatenate([pseudo[single], rest])
                    values = {s: ({n: [] for n in names}, []) for s in SCHEMES}
                    still = False
                    for c, size in enumerate(_chunks(inner)):
                        draws = term_draws(seed, o, c, counts, size).astype(np.float64)
                        rng = np.random.default_rng([seed, o, c, 2])
                        drawn = rng.multinomial(n_rows[0], cells / cells.sum(), size=size).T.astype(np.float64)
                        total = np.zeros((n_cats, size))
                        np.add.at(total, own[single], drawn[: len(single)])
                        np.add.at(total, side[0], drawn[len(single) :])
                        if 1 in n_rows:
                            p = base[side[1]]
                            total[side[1]] = rng.multinomial(n_rows[1], p / p.sum(), size=size).T
                        block = lambda rows, left, draws=draws: draws[triads[rows, 0][:, None], left] * draws[triads[rows, 1][:, None], left] * draws[triads[rows, 2][:, None], left]
                        one = lambda rows, left, drawn=drawn: drawn[place[rows][:, None], left]
                        for n, h in heads.items():
                            for s, weight, head in (("term_block", block, h), ("candidate", one, h[: reach[n]])):
                                got, more = along(weight, head, y, ks, sizes[n] <= length and len(head) == len(h), size)
                                still |= more
                                values[s][0][n].append(got)
                        values["term_block"][1].append(parts[c])
                        values["candidate"][1].append(total)
                    out = []
                    for s in SCHEMES:
                        p, w = {n: np.concatenate(v, 1) for n, v in values[s][0].items()}, np.concatenate(values[s][1], 1)
                        for name, m in measures.items():
                            with np.errstate(divide="ignore", invalid="ignore"):
                                if isinstance(m, RecallDifference):
                                    good = side[1][side[1] % 2 == 1]
                                    gap = w[mark[m.one][mark[m.one] % 2 == 1]].sum(0) - w[mark[m.two][mark[m.two] % 2 == 1]].sum(0)
                                    whole = w[good].sum(0)
                                    rows_of = [(None, np.where(whole > 0, gap / whole, np.nan))]
                                elif isinstance(m, Difference):
                                    rows_of = [(k, p[m.one][i] - p[m.two][i]) for i, k in enumerate(ks)]
                                else:
                                    cats_of = subset[m.subset]
                                    share = w[cats_of[cats_of % 2 == 1]].sum(0) / w[cats_of].sum(0)
                                    rows_of = [(k, np.where(share > 0, p[m.ranking][i] / share, np.nan)) for i, k in enumerate(ks)]
                            out += [(o, s, name, k, *_bounds(v, tail)) for k, v in rows_of]
                    if still:
                        out = [(o, "open", "", None, None, None, 0)]
                    yield pa.RecordBatch.from_pylist([dict(zip(("outer", "scheme", "measure", "k", "lower", "upper", "valid"), r)) for r in out], schema=_RESULT)

        per_outer = sums.groupBy("outer").agg(F.collect_list(F.struct("chunk", "w")).alias("x"))
        done = kept(per_outer.mapInArrow(evaluate, schema), "study-bounds")
        held.destroy()
        if done.where("scheme = 'open'").isEmpty():
            return done
        length *= 8


_RESULT = pa.schema([("outer", pa.int64()), ("scheme", pa.string()), ("measure", pa.string()), ("k", pa.int32()), ("lower", pa.float64()), ("upper", pa.float64()), ("valid", pa.int64())])


def passed(found: DataFrame, steps: dict[str, tuple[str, int, float]], ks: list[int]) -> DataFrame:
    """(outer, budget, k, one boolean a step): a step passes where the lower bounds of both schemes exceed its threshold.

    ``steps``: measure -> (step, budget, threshold); a measure without k counts for every k.
    """
    rule = found.sparkSession.createDataFrame([(m, s, b, float(t)) for m, (s, b, t) in steps.items()], "measure string, step string, budget long, threshold double")
    rows = found.join(F.broadcast(rule), "measure").withColumn("k", F.explode(F.when(F.col("k").isNull(), F.array(*map(F.lit, ks))).otherwise(F.array("k"))))
    both = rows.groupBy("outer", "budget", "k", "step").agg((F.count_if(F.coalesce(F.col("lower") > F.col("threshold"), F.lit(False))) == len(SCHEMES)).alias("ok"))
    names = list(dict.fromkeys(s for s, _, _ in steps.values()))
    return both.groupBy("outer", "budget", "k").agg(*(F.coalesce(F.max(F.when(F.col("step") == n, F.col("ok"))), F.lit(False)).alias(n) for n in names))


def power(found: DataFrame, steps: dict[str, tuple[str, int, float]], ks: list[int], outer: int) -> DataFrame:
    """(budget, k, share of outer replicates that pass each step, and share that passes it and all before it (``upto_<step>``))."""
    names = list(dict.fromkeys(s for s, _, _ in steps.values()))
    rows, share, upto = passed(found, steps, ks), [], F.lit(True)
    for n in names:
        upto = upto & F.col(n)
        share += [(F.count_if(F.col(n)) / F.lit(outer)).alias(n), (F.count_if(upto) / F.lit(outer)).alias(f"upto_{n}")]
    return rows.groupBy("budget", "k").agg(*share)


def chosen(powers: DataFrame, by: str, minimum: float) -> DataFrame:
    """Adds ``chosen`` (the budget and k of most power ``by``, ties to the smaller budget, then k) and ``meets_minimum``."""
    best = powers.agg(F.min_by(F.struct("budget", "k"), F.struct(-F.col(by), "budget", "k")).alias("_b"))
    out = powers.join(F.broadcast(best))
    return out.withColumns({"chosen": (F.col("budget") == F.col("_b.budget")) & (F.col("k") == F.col("_b.k")), "meets_minimum": F.col(by) >= minimum}).drop("_b")
