"""Bootstrap bounds, nested power and the choice of a budget against plain replicates of all candidates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import replicates as B

TERMS = [f"t{i:02d}" for i in range(22)]


def toy(n=120, seed=1):
    rng = random.Random(seed)
    rows, seen = [], set()
    while len(rows) < n:
        tri = tuple(sorted(rng.sample(TERMS, 3)))
        if tri not in seen:
            seen.add(tri)
            rows.append((*tri, int(rng.random() < 0.4), rng.random(), rng.random(), len(rows) + 1))
    extra = [t for t in (tuple(sorted(rng.sample(TERMS, 3))) for _ in range(40)) if t not in seen]
    return rows, sorted({r[:3] for r in rows if r[3]} | set(extra))


def as_study(spark, rows, positives):
    pool = spark.createDataFrame(rows, "a string, b string, c string, y int, s double, t double, g int")
    keys = [F.col(x) for x in "abc"]
    rankings = {"e_60": (F.col("g") <= 60, [-F.col("s"), *keys]), "b_60": (F.col("g") <= 60, [-F.col("t"), *keys]), "e": (F.lit(True), [-F.col("s"), *keys])}
    found = spark.createDataFrame(positives, "a string, b string, c string").join(pool.select(*"abc", "g"), list("abc"), "left")
    marks = {"pool": F.coalesce(F.col("g") <= 60, F.lit(False)), "first": F.coalesce(F.col("g") <= 20, F.lit(False))}
    return B.Study(pool, rankings, {"in_60": F.col("g") <= 60, "all": F.lit(True)}, found, marks)


MEASURES = {"lift": B.Lift("e_60", "in_60"), "lift_all": B.Lift("e", "all"), "gain": B.Difference("e_60", "b_60"), "union": B.Difference("e_60", "e"), "recall": B.RecallDifference("pool", "first")}


def precision(order, w, y, k):
    """The first k units of weight, one candidate after the other."""
    left, hit, whole = float(k), 0.0, 0.0
    for i in order:
        take = min(left, w[i])
        hit, left, whole = hit + take * y[i], left - take, whole + w[i]
        if left <= 0:
            return hit / k
    return hit / whole if whole else float("nan")


def plain_term_block(rows, positives, ks, outer, inner, seed, redraw, keep):
    """All measures of all replicates from whole weight vectors; the draws are the operator's own."""
    number = {t: i for i, t in enumerate(sorted({t for r in rows for t in r[:3]} | {t for p in positives for t in p}))}
    idx = lambda xs: np.array([[number[t] for t in x[:3]] for x in xs])
    pool, pos, g = idx(rows), idx(positives), np.array([r[6] for r in rows])
    place = {r[:3]: r[6] for r in rows}
    pos_g = np.array([place.get(p, 10**9) for p in positives])
    orders = {"e_60": sorted(np.flatnonzero(g <= 60), key=lambda i: (-rows[i][4], rows[i][:3])), "b_60": sorted(np.flatnonzero(g <= 60), key=lambda i: (-rows[i][5], rows[i][:3])), "e": sorted(range(len(rows)), key=lambda i: (-rows[i][4], rows[i][:3]))}
    out = {}
    for o in range(outer):
        counts = B.outer_counts(seed, o, len(number), redraw)
        y = np.array([r[3] for r in rows]) * B.stays(seed, o, pool, keep)
        stay = B.stays(seed, o, pos, keep)
        values = {}
        for c, size in enumerate(B._chunks(inner)):
            for d in B.term_draws(seed, o, c, counts, size).T.astype(float):
                w, wp = d[pool].prod(1), d[pos].prod(1) * stay
                for k in ks:
                    p = {n: precision(order, w, y, k) for n, order in orders.items()}
                    for name, num, base in (("lift", "e_60", g <= 60), ("lift_all", "e", g > 0)):
                        share = (w * y)[base].sum() / w[base].sum() if w[base].sum() else float("nan")
                        values.setdefault((name, k), []).append(p[num] / share if share > 0 else float("nan"))
                    values.setdefault(("gain", k), []).append(p["e_60"] - p["b_60"])
                    values.setdefault(("union", k), []).append(p["e_60"] - p["e"])
                values.setdefault(("recall", None), []).append((wp[pos_g <= 60].sum() - wp[pos_g <= 20].sum()) / wp.sum() if wp.sum() else float("nan"))
        for (name, k), v in values.items():
            v = np.array(v)[~np.isnan(v)]
            out[o, name, k] = (*np.percentile(v, [2.5, 97.5]), len(v)) if len(v) else (None, None, 0)
    return out


@pytest.mark.parametrize("outer,inner,redraw,keep,block", [(1, 130, False, 1.0, 16_384), (3, 40, True, 0.7, 10)])
def test_term_block_bounds_equal_whole_weight_vectors(spark, monkeypatch, outer, inner, redraw, keep, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rows, positives = toy()
    got = B.bounds(as_study(spark, rows, positives), MEASURES, [5, 20], outer, inner, 9, redraw, keep).where("scheme = 'term_block'").collect()
    want = plain_term_block(rows, positives, [5, 20], outer, inner, 9, redraw, keep)
    assert len(got) == len(want)
    for r in got:
        lower, upper, n = want[r.outer, r.measure, r.k]
        assert r.valid == n and (r.lower, r.upper) == pytest.approx((lower, upper), abs=1e-9), r


def test_candidate_scheme_matches_plain_draws(spark):
    """Heads of one candidate in k, so most are drawn as categories: the bounds are those of drawing every candidate."""
    rows, positives = toy(400, 3)
    found = {(r.measure, r.k): r for r in B.bounds(as_study(spark, rows, positives), MEASURES, [2], 1, 2000, 5).where("scheme = 'candidate'").collect()}
    rng, n = np.random.default_rng(0), len(rows)
    y = np.array([r[3] for r in rows])
    order = sorted(range(n), key=lambda i: (-rows[i][4], rows[i][:3]))
    lifts = []
    for _ in range(2000):
        w = rng.multinomial(n, np.full(n, 1 / n)).astype(float)
        lifts.append(precision(order, w, y, 2) / ((w * y).sum() / w.sum()))
    lower, upper = np.percentile(lifts, [2.5, 97.5])
    r = found["lift_all", 2]
    assert r.lower == pytest.approx(lower, abs=0.12) and r.upper == pytest.approx(upper, abs=0.12)
    m, p = len(positives), np.mean([any(x[:3] == t and 20 < x[6] <= 60 for x in rows) for t in positives])
    r = found["recall", None]
    spread = 1.96 * (p * (1 - p) / m) ** 0.5
    assert r.lower == pytest.approx(p - spread, abs=0.03) and r.upper == pytest.approx(p + spread, abs=0.03)


def test_open_replicates_get_longer_heads(spark, monkeypatch):
    """Heads of five candidates leave replicates open; longer ones give what whole rankings give."""
    rows, positives = toy(300, 4)
    bounds = lambda: {(r.measure, r.k): (r.lower, r.upper) for r in B.bounds(as_study(spark, rows, positives), MEASURES, [5], 1, 60, 2).where("scheme = 'term_block'").collect()}
    whole = bounds()
    monkeypatch.setattr(B, "HEAD", 1)
    again = bounds()
    assert whole and again.keys() == whole.keys() and all(again[m] == pytest.approx(whole[m]) for m in whole)
    out, still = B.precisions(np.zeros((3, 4)), np.zeros(3), [5], False)
    assert still.all() and np.isnan(out).all()
    out, still = B.precisions(np.ones((3, 4)), np.array([1.0, 0.0, 1.0]), [2, 9], True)
    assert not still.any() and out[0, 0] == 0.5 and out[1, 0] == pytest.approx(2 / 3)


def test_power_and_choice(spark):
    rows = [(o, s, m, k, lo, 9.0, 1) for o in range(4) for s in B.SCHEMES for m, k, lo in (("r10", None, 0.1 if o < 3 else -0.1), ("l10", 5, 1.2), ("l10", 7, 1.2 if o < 2 or s == "candidate" else 0.9), ("r20", None, 0.1), ("l20", 5, 1.2 if o else None), ("l20", 7, 1.2 if o else 0.0))]
    found = spark.createDataFrame(rows, "outer long, scheme string, measure string, k int, lower double, upper double, valid long")
    steps = {"r10": ("s1", 10, 0.0), "l10": ("s2", 10, 1.0), "r20": ("s1", 20, 0.0), "l20": ("s2", 20, 1.0)}
    got = {(r.budget, r.k): r for r in B.chosen(B.power(found, steps, [5, 7], 5), "upto_s2", 0.5).collect()}
    assert {k: (r.s1, r.s2, r.upto_s2) for k, r in got.items()} == {(10, 5): (0.6, 0.8, 0.6), (10, 7): (0.6, 0.4, 0.4), (20, 5): (0.8, 0.6, 0.6), (20, 7): (0.8, 0.6, 0.6)}
    assert [k for k, r in got.items() if r.chosen] == [(10, 5)] and got[10, 5].meets_minimum and not got[10, 7].meets_minimum


def test_empty_pool(spark):
    rows, _ = toy(5)
    pool = spark.createDataFrame(rows, "a string, b string, c string, y int, s double, t double, g int").where("false")
    none = B.Study(pool, {"e": (F.lit(True), [F.col("a")])}, {"all": F.lit(True)})
    assert B.bounds(none, {"lift": B.Lift("e", "all")}, [5]).count() == 0
