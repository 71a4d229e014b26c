"""The ranking model: gradient-boosted trees, rounds chosen by stratified cross-validation, seeds averaged.

Rows have the feature columns, ``label`` 0 or 1 and a key; trees are Spark's own.
"""

from __future__ import annotations

import re
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered, running, settled

#: Rounds of the first training of a fold, and rounds whose precisions are taken at once.
FIRST_ROUNDS, ROUNDS_AT_ONCE = 200, 100


def pooled(frames: list[DataFrame], allowed: list[str], names: list[str]) -> DataFrame:
    """The rows of the timepoints ``names``, whose label windows must all have ended (be in ``allowed``)."""
    late = [n for n in names if n not in allowed]
    if late:
        raise ValueError(f"labels of {late} are not open yet")
    return reduce(DataFrame.unionByName, [f.withColumn("timepoint", F.lit(n)) for n, f in zip(names, frames)])


def _assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    wide = rows.withColumns({c: F.col(c).cast("double") for c in columns}).fillna(0.0, columns)
    return VectorAssembler(inputCols=columns, outputCol="_x").transform(wide)


def stratified_folds(rows: DataFrame, key: list[str], label: str, folds: int, seed: int) -> DataFrame:
    """Adds ``fold``: within each label the rows in a seeded order are dealt out one by one."""
    order = Window.partitionBy(label, "_bucket").orderBy("_h", *key)
    # a bucket of the hash holds a share of the rows, so no label is one task; each starts at a fold of its own
    mixed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_bucket", F.pmod("_h", F.lit(64)))
    return mixed.withColumn("fold", F.pmod(F.row_number().over(order) + F.col("_bucket"), F.lit(folds)).cast("int")).drop("_h", "_bucket")


def train(rows: DataFrame, columns: list[str], rounds: int, seed: int, depth: int = 3, step: float = 0.1, label: str = "label"):
    """The fitted trees; None without rows."""
    if rows.isEmpty():
        return None
    from pyspark.ml.classification import GBTClassifier

    trees = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=0.8)
    return trees.fit(_assembled(rows, columns))


def _together(rows: DataFrame, work, items: list) -> list:
    """``work`` of every item, as Spark jobs side by side: a tree is many short jobs."""
    if not items:
        return []
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(work), items)


def _leaf_values(model):
    """A row per tree: the values of its leaves from left to right, times the tree's weight."""
    import numpy as np

    trees = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):", model.toDebugString)[1:]
    values = [[float(v) for v in re.findall(r"Predict: (\S+)", t)] for t in trees]
    table = np.zeros((len(values), max(map(len, values))))
    for i, (v, w) in enumerate(zip(values, model.treeWeights, strict=True)):
        table[i, : len(v)] = np.array(v) * w
    return table


def _margins(model, rows: DataFrame, columns: list[str], keep: list[str], after: int = 0) -> DataFrame:
    """``keep`` and ``ms``: the running margin after each tree, without the first ``after`` ones."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    values = _leaf_values(model)

    def work(batches):
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            leaves = np.asarray(batch.column(len(keep)).flatten()).reshape(batch.num_rows, len(values))
            steps = np.cumsum(values[np.arange(len(values)), leaves], axis=1)[:, after:]
            ends = pa.array(np.arange(batch.num_rows + 1) * steps.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(steps.ravel()))], names=[*keep, "ms"])

    only = {model.leafCol: "_leaf", model.predictionCol: "", model.rawPredictionCol: "", model.probabilityCol: ""}
    out = model.transform(_assembled(rows, columns), only).select(*keep, vector_to_array("_leaf").cast("array<smallint>").alias("_leaf"))
    return out.mapInArrow(work, StructType([*out.select(*keep).schema.fields]).add("ms", ArrayType(DoubleType())))


def round_precisions(staged: DataFrame, label: str = "label") -> DataFrame:
    """(fold, round, average_precision): ``staged`` has fold, label and ``ms``, the running margin after each round (from 0).

    All folds and rounds share one global order, (fold, round, falling score), whose running totals less those before the round's
    first score are the round's own; so no fold or round is one task. Tied scores are one step. Null for a round without positives.
    """
    each = staged.select("fold", F.col(label).cast("double").alias("y"), F.posexplode("ms").alias("round", "score"))
    steps = each.groupBy("fold", "round", "score").agg(F.sum("y").alias("p"), F.count("*").cast("double").alias("n"))
    order = [F.col("fold"), F.col("round"), -F.col("score")]
    run = settled(running(running(steps, order, F.col("p"), "_tp"), order, F.col("n"), "_all"))
    start = run.groupBy("fold", "round").agg(F.min("_tp").alias("_tp0"), F.min_by("p", "_all").alias("_p0"), F.min("_all").alias("_all0"), F.min_by("n", "_all").alias("_n0"))
    met = run.join(F.broadcast(start), ["fold", "round"])  # one row per fold and round
    tp, seen = F.col("_tp") - F.col("_tp0") + F.col("_p0"), F.col("_all") - F.col("_all0") + F.col("_n0")
    return met.groupBy("fold", "round").agg((F.sum(F.col("p") * tp / seen) / F.nullif(F.sum("p"), F.lit(0.0))).alias("average_precision"))


def _best(mean: list[float], patience: int) -> tuple[int, bool]:
    """(place of the first value that none of the next ``patience`` beats, whether so many follow it)."""
    best = 0
    for i in range(1, len(mean)):
        if mean[i] > mean[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def choose_rounds(rows: DataFrame, columns: list[str], key: list[str], folds: int = 5, most: int = 2000, patience: int = 100, seed: int = 1, label: str = "label") -> tuple[int, list[float]]:
    """(rounds, mean average precision after each round): the first round that none of the next ``patience`` beats.

    Folds train side by side, first ``FIRST_ROUNDS`` rounds, then twice as many and so on up to ``most`` until the choice is made; the
    same seed grows the same first trees, so the choice is that of ``most`` rounds. The means end where it is made. Beside the training it is
    one pass over the held-out rows of all folds for every ``ROUNDS_AT_ONCE`` rounds. A fold without training rows has no curve.
    """
    dealt = settled(stratified_folds(rows, key, label, folds, seed))
    mean, upto = [], min(most, max(FIRST_ROUNDS, patience + 1))
    while True:
        done = len(mean)

        def held_out(fold: int, done: int = done, upto: int = upto) -> DataFrame | None:
            model = train(dealt.where(F.col("fold") != fold), columns, upto, seed, label=label)
            return None if model is None else _margins(model, dealt.where(F.col("fold") == fold), columns, ["fold", label], done)

        staged = [x for x in _together(rows, held_out, list(range(folds))) if x is not None]
        if not staged:
            return 1, [0.0] * most
        margins = settled(reduce(DataFrame.unionAll, staged))
        for start in range(done, upto, ROUNDS_AT_ONCE):
            size = min(ROUNDS_AT_ONCE, upto - start)
            found = round_precisions(margins.withColumn("ms", F.slice("ms", start - done + 1, size)), label)
            means = found.groupBy("round").agg((F.sum(F.coalesce("average_precision", F.lit(0.0))) / folds).alias("m"))
            curve = {r["round"]: r.m for r in means.collect()}  # one row a round
            mean += [curve.get(i, 0.0) for i in range(size)]
            best, made = _best(mean, patience)
            if made or len(mean) == most:
                return best + 1, mean
        upto = min(most, 2 * upto)


def train_seeds(rows: DataFrame, columns: list[str], rounds: int, seeds: list[int], label: str = "label") -> list:
    models = _together(rows, lambda s: train(rows, columns, rounds, s, label=label), seeds)
    return [m for m in models if m is not None]


def importances(models: list, columns: list[str]) -> dict[str, float]:
    """Mean gain share of each column over the models, largest first."""
    total = [sum(float(m.featureImportances[i]) for m in models) / max(1, len(models)) for i in range(len(columns))]
    return dict(sorted(zip(columns, total), key=lambda x: (-x[1], x[0])))


def seed_scores(models: list, rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Key, a probability per model (score_0, ...) and their mean ``score``; null without models."""
    if not models:
        return rows.select(*key, F.lit(None).cast("double").alias("score"))
    out = rows
    for i, m in enumerate(models):
        margin = _margins(m, rows, columns, key, len(m.treeWeights) - 1).select(*key, (1 / (1 + F.exp(-2 * F.element_at("ms", -1)))).alias(f"score_{i}"))
        out = margin if i == 0 else out.join(margin, key)
    return out.withColumn("score", sum((F.col(f"score_{i}") for i in range(len(models))), F.lit(0.0)) / len(models))


def prescription_ranks(scored: DataFrame, key: list[str], redundant: str = "redundant", score: str = "score") -> DataFrame:
    """Adds rank_engine (all rows by score, ties by key) and rank_prescription (rows without a reason in ``redundant``; else null)."""
    order = [-F.col(score), *map(F.col, key)]
    ranked = numbered(scored, order, "rank_engine")
    kept = numbered(ranked.where(F.coalesce(F.col(redundant), F.lit("")) == ""), [F.col("rank_engine")], "rank_prescription")
    return ranked.join(kept.select(*key, "rank_prescription"), key, "left")


def platt(rows: DataFrame, score: str = "score", label: str = "label") -> tuple[float, float]:
    """(slope, constant) of the logistic calibration of out-of-fold scores."""
    from pyspark.ml.classification import LogisticRegression

    m = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=100, tol=1e-9).fit(_assembled(rows, [score]))
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(rows: DataFrame, model: tuple[float, float], score: str = "score") -> DataFrame:
    return rows.withColumn("probability", 1 / (1 + F.exp(-(F.lit(model[0]) * F.col(score) + F.lit(model[1])))))


def brier(rows: DataFrame, probability: str = "probability", label: str = "label") -> DataFrame:
    gap = F.col(probability) - F.col(label)
    return rows.agg(F.avg(gap * gap).alias("brier"), F.avg(label).alias("base_rate"), F.count("*").alias("n"))
