"""The choice of rounds is that of the whole number of rounds, and the engine's query asks for all of it."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import boosting as G
from lattica.operators import features as X
from lattica.plans import extras


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(4)
    rows = [(i, x := rng.random(), rng.random(), int(x + rng.random() > 1.1)) for i in range(300)]
    return G.settled(spark.createDataFrame(rows, "key long, x double, z double, label int").repartition(2))


def test_engine_chooses_among_all_rounds_folds_seeds_and_columns(spark, sf, monkeypatch):
    asked, shape = {}, inspect.signature(G.choose_rounds)

    def choose(*args, **kw):
        found = shape.bind(*args, **kw)
        found.apply_defaults()
        asked.update(found.arguments)
        return 7, [0.0]

    def seeds(rows, columns, rounds, seeds, **kw):
        asked.update(seeds=seeds, trained=(rounds, columns))
        raise StopIteration

    monkeypatch.setattr(G, "choose_rounds", choose)
    monkeypatch.setattr(G, "train_seeds", seeds)
    with pytest.raises(StopIteration):
        extras.m12(spark, sf)
    assert (asked["folds"], asked["most"], asked["patience"], len(set(asked["seeds"]))) == (5, 2000, 100, 5)
    assert asked["columns"] == X.columns(list(X.SETS)) and asked["trained"] == (7, asked["columns"])


@pytest.mark.parametrize("patience", [2, 5])
def test_rounds_chosen_in_stages_are_those_of_all_rounds(noisy, monkeypatch, patience):
    ask = lambda: G.choose_rounds(noisy, ["x", "z"], ["key"], folds=2, most=16, patience=patience)
    rounds, curve = ask()
    assert len(curve) == 16 and (rounds - 1, True) == G._best(curve, patience)
    monkeypatch.setattr(G, "FIRST_ROUNDS", 3)
    monkeypatch.setattr(G, "ROUNDS_AT_ONCE", 2)
    sooner, means = ask()
    assert sooner == rounds and rounds + patience <= len(means) < 16 and means == pytest.approx(curve[: len(means)])


def test_best_round():
    assert G._best([1, 3, 2, 2, 4], 2) == (1, True) and G._best([1, 3, 2, 4, 4], 3) == (3, False) and G._best([0.0], 1) == (0, False)


def test_margins_add_the_trees_own_predictions(noisy):
    model = G.train(noisy, ["x", "z"], 6, 1)
    out, want = G._assembled(noisy, ["x", "z"]), {}
    for i, (tree, w) in enumerate(zip(model.trees, model.treeWeights)):
        for r in tree.setFeaturesCol("_x").setPredictionCol("_t").transform(out).collect():
            want.setdefault(r.key, []).append((want[r.key][-1] if i else 0.0) + r._t * w)
    for after in (0, 4):
        got = {r.key: r.ms for r in G._margins(model, noisy, ["x", "z"], ["key"], after).collect()}
        assert len(got) == 300 and all(got[k] == pytest.approx(want[k][after:], rel=1e-12) for k in want)
    assert G._margins(model, noisy.where("key < 0"), ["x", "z"], ["key"]).collect() == []
    assert noisy.agg(F.count_distinct("label")).first()[0] == 2
