"""Quality classifier (held-out accuracy, invariants) and benchmark decontamination (brute force)."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality, queries, simhash_decontam as S


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op2_pu_quality(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    import zlib

    assert (rows.held_out == rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    test = rows[rows.held_out & rows.quality.notna()]
    assert (test.predicted == test.quality).mean() > 0.93


def test_quality_ignores_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in quality.score_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 5), (2, None, 5), (3, "", 5), (None, "x " * 3000, 5)], "doc_id long, text string, score int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert quality.score_documents(docs.where("false"), labels).count() == 0
    assert [r.score for r in quality.score_documents(docs, labels.where("false")).collect()] == [0.5] * 5


def test_features_by_hand():
    text = "Ab cd cd!! |x\n".encode()
    raw = np.frombuffer(text + text, np.uint8)
    x = quality.features(raw, np.array([0, len(text), len(text), 2 * len(text)]))
    names = dict(zip(quality.FEATURES, x[0]))
    assert np.allclose(x[0], x[2])
    assert names["log_words"] == pytest.approx(np.log(5))
    assert names["upper"] == pytest.approx(1 / 7)
    assert names["distinct_words"] == pytest.approx(np.log(5 / 5))
    assert names["marked_words"] == pytest.approx(np.log1p(20 * 2 / 4))


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def grams(ws, width=5):
    if not ws:
        return []
    return [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]


def brute(docs, items):
    out = {}
    for d, text in docs:
        have = grams(words(text))
        for i, it in items:
            want = Counter(grams(words(it)))
            m = sum(want.values())
            for s in range(max(1, len(have) - m + 1)):
                window = Counter(have[s : s + m])
                both = sum((window & want).values())
                union = sum((window | want).values())
                if both and 100 * both >= 80 * union and both / union > out.get((d, i), (0, 1))[0] / out.get((d, i), (0, 1))[1]:
                    out[d, i] = (both, union)
    return {(*k, *v) for k, v in out.items()}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([14, 20, 36, 59, 5, 4, 100])] + [(7, "la la la la la la la la la la la"), (8, None), (9, ""), (None, " ".join(make(25)))]
    docs = []
    for k in range(120):
        body = make(rng.randint(0, 80))
        source = rng.choice(items)[1] or ""
        copy = source.split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            if copy:
                at = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
                copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], "new"]])
        at = rng.randint(0, len(body))
        text = rng.choice([" ", "*** ", ", "]).join(body[:at] + copy + body[at:])
        docs.append((k, text.upper() if k % 3 == 0 else text))
    docs += [(200, None), (201, ""), (202, items[2][1]), (202, items[2][1]), (None, items[3][1]), (203, items[5][1])]
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, i int").repartition(3)
    b = spark.createDataFrame([(*x, "q") for x in items] + [(*items[0], "q")], "item_id long, text string, hs string")
    got = {tuple(r) for r in S.pairs(d, b).collect()}
    want = brute(docs, items)
    assert len(want) > 30
    assert got == want
    clean = {(r.doc_id, r.text) for r in S.decontaminate(d, b).collect()}
    dirty = {x[0] for x in want}
    assert clean == {x for x in docs if x[0] not in dirty}
    assert S.decontaminate(d, b).columns == d.columns


def test_decontamination_paths_and_empty(spark, sf, monkeypatch, duck):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in S.pairs(docs, items).collect())
    assert want == sorted(duck.execute(queries.SQL_OP6).fetchall()) and want
    monkeypatch.setattr(S, "MAX_BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(S, "MAX_BROADCAST_HITS", 0)
    monkeypatch.setattr(S, "MAX_INDEX_ROWS", 0)
    assert sorted(tuple(r) for r in S.pairs(docs, items).collect()) == want
    assert S.pairs(docs.where("false"), items).count() == 0
    assert S.pairs(docs, items.where("false")).count() == 0
    assert S.decontaminate(docs, items.where("false")).count() == docs.count()


def test_large_index_is_not_broadcast(spark, sf, monkeypatch):
    """An index of 200 items (1.1 million rows) took 134 MB of the driver; it meets the fingerprints in a shuffle, with the same rows."""
    assert 200 * S.PRINTS * S.BLOCKS * len(S.CHANGES) > S.MAX_INDEX_ROWS
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    more = items.crossJoin(spark.range(50).withColumnRenamed("id", "copy"))
    more = more.select((F.col("item_id") + 1_000_000 * F.col("copy")).alias("item_id"), "text")
    assert items.count() * 50 * S.PRINTS * S.BLOCKS * len(S.CHANGES) > S.MAX_INDEX_ROWS
    want = {(d, i + 1_000_000 * c, *n) for d, i, *n in (tuple(r) for r in S.pairs(docs, items).collect()) for c in range(50)}
    joins = []
    real = S.written
    monkeypatch.setattr(S, "written", lambda df, name: joins.append((name, df._jdf.queryExecution().sparkPlan().toString())) or real(df, name))
    assert want and {tuple(r) for r in S.pairs(docs, more).collect()} == want
    assert "SortMergeJoin [key" in dict(joins)["close"]


def test_index_finds_all_within_the_radius_and_few_others(spark):
    """The blocks of random fingerprints against all pairs: none within the radius is missed, and few random pairs meet."""
    rng = random.Random(8)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    flipped = []
    for p in prints:
        for bit in rng.sample(range(64), rng.randint(0, 20)):
            p ^= 1 << bit if bit < 63 else -(1 << 63)
        flipped.append(p)
    rows = spark.createDataFrame(list(zip(prints, flipped)), "x long, y long")
    a, b = (rows.select(F.col(c).alias(c), F.posexplode(F.expr(S.blocks(f"array({c})"))).alias("i", "value")) for c in "xy")
    b = b.select("y", "i", F.col("value"), F.explode(F.array(*map(F.lit, S.CHANGES))).alias("change")).select("y", "i", F.expr("value ^ change").alias("value"))
    met = {(r.x, r.y) for r in a.join(b, ["i", "value"]).select("x", "y").distinct().collect()}
    apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    close = {(x, y) for x, y in zip(prints, flipped) if apart(x, y) <= S.RADIUS}
    assert len(close) > 150 and close <= met
    assert len(met) / len(prints) ** 2 < 0.06


def risk_of(w, x, positive, plus, minus, ridge):
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    f = z @ w
    good, bad = np.logaddexp(0, -f), np.logaddexp(0, f)
    second = bad.mean() - minus * bad[positive].mean()
    return plus * good[positive].mean() + max(0.0, second) + 0.5 * ridge * (w[:-1] ** 2).sum(), second


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_non_negative_risk_against_search(spark, monkeypatch, prior):
    """With a prior far above the true share the second part goes below zero; the fit must come back to the clipped minimum."""
    monkeypatch.setattr(quality, "FEATURES", ("one",))
    rng = np.random.default_rng(1)
    n = 600
    truth = rng.random(n) < 0.4
    x = (rng.normal(0, 1, n) + np.where(truth, 2.0, -1.0)).reshape(-1, 1)
    positive = truth & (rng.random(n) < 0.5)
    rows = spark.createDataFrame([([float(v[0])], bool(p)) for v, p in zip(x, positive)], "x array<float>, positive boolean")
    known = quality.moments(rows)
    w = quality.fit(rows, known, prior, prior)
    grid = [(risk_of(np.array([a, b]), x, positive, prior, prior, quality.RIDGE), a, b) for a in np.linspace(-2, 12, 141) for b in np.linspace(-6, 14, 201)]
    got, _ = risk_of(w, x, positive, prior, prior, quality.RIDGE)
    assert got <= min(g[0][0] for g in grid) + 0.01
    _, below, _ = quality.newton(rows, known, prior, prior, 1.0, np.zeros(2))
    assert (below < 0) == (prior == 0.9)


def test_prior_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(2)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 6000), rng.normal(-2, 1, 4000)])
    bins = np.linspace(-8, 8, 200)
    assert quality.best_bin(np.histogram(p, bins)[0], np.histogram(u, bins)[0]) == pytest.approx(0.6, abs=0.04)
