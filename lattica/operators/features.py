"""Features of triads from pair measures, and the vectors of terms.

Every measure belongs to a pair and is taken over a triad's three pairs by minimum, mean, maximum or the
geometric mean of log1p; the order of the terms plays no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import growth
from ..sources.folders import kept
from . import hypergraph as H
from .ranks import settled

# The feature columns by their published names.
#: Columns by set: P pairs, H hypergraph, T text, R recency.
SETS = {
    "P": ["P_aa_min", "P_aa_mean", "P_aa_gmean", "P_cn_min", "P_cn_mean", "P_cn_gmean", "P_npmi_min", "P_npmi_mean", "P_npmi_max", "P_logfreq_min", "P_logfreq_mean"],
    "H": ["H_pairedges_min", "H_pairedges_mean", "H_pairedges_gmean", "H_triad_cn", "H_size_weighted_aa", "H_related_edge_size_mean", "H_open_triangle"],
    "T": ["T_cos_mean", "T_cos_min", "T_volume"],
    "R": ["R_growth_min", "R_growth_mean"],
}


def columns(sets: list[str]) -> list[str]:
    """The feature columns of some sets, in order."""
    return [c for s in sets for c in SETS[s]]


def _gmean(c: str) -> Column:
    return F.expm1(F.avg(F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))))


def pair_measures(inc: DataFrame, stable: DataFrame, recent_start: str) -> DataFrame:
    """x, y, cnt, npmi, recent, growth, aa, cn of every pair x < y that meets in a paper or has a common neighbour."""
    edges = H.hyperedges(inc)
    n = edges.agg(F.count("*").cast("double").alias("n"))
    pairs = H.pair_npmi(H.pair_counts(edges).join(n), H.term_counts(inc), F.col("n")).select("a", "b", "cnt", "npmi")
    late = H.pair_counts(edges.where(F.col("first_date") >= F.lit(recent_start).cast("timestamp"))).withColumnRenamed("cnt", "recent")
    near = H.adamic_adar(stable).withColumnRenamed("common", "cn")
    out = pairs.join(late, ["a", "b"], "left").join(near, ["a", "b"], "full").fillna(0, ["cnt", "recent", "cn"]).fillna(0.0, ["aa"]).fillna(-1.0, ["npmi"])
    return out.withColumn("growth", growth(F.col("recent"), F.col("cnt"))).withColumnsRenamed({"a": "x", "b": "y"})


def triad_features(candidates: DataFrame, inc: DataFrame, stable: DataFrame, vectors: DataFrame, recent_start: str) -> DataFrame:
    """All columns of ``SETS`` for candidates (a, b, c, kind); ``vectors`` are (term_id, v), of unit length or zero."""
    candidates = settled(candidates)  # every group of columns reads them
    triads = candidates.select(*H.TRIAD)
    sides = H.triad_pairs(triads).join(pair_measures(inc, stable, recent_start), ["x", "y"], "left")
    sides = sides.fillna(0, ["cnt", "cn"]).fillna(0.0, ["aa"]).fillna(-1.0, ["npmi"]).fillna(1.0, ["growth"])
    of_pairs = sides.groupBy(*H.TRIAD).agg(
        *(f.alias(f"P_{m}_{n}") for m in ("aa", "cn") for n, f in (("min", F.min(m)), ("mean", F.avg(m)), ("gmean", _gmean(m)))),
        F.min("npmi").alias("P_npmi_min"), F.avg("npmi").alias("P_npmi_mean"), F.max("npmi").alias("P_npmi_max"),
        F.min("cnt").alias("H_pairedges_min"), F.avg("cnt").alias("H_pairedges_mean"), _gmean("cnt").alias("H_pairedges_gmean"),
        F.min("growth").alias("R_growth_min"), F.avg("growth").alias("R_growth_mean"),
    )
    each = triads.select(*H.TRIAD, F.explode(F.array(*H.TRIAD)).alias("term_id"))
    freq = each.join(H.term_counts(inc), "term_id").groupBy(*H.TRIAD).agg(F.min(F.log("docs")).alias("P_logfreq_min"), F.avg(F.log("docs")).alias("P_logfreq_mean"))
    around = each.join(H.adjacency(stable).withColumnRenamed("src", "term_id"), "term_id").groupBy(*H.TRIAD, "dst").agg(F.count("*").alias("n")).where("n = 3")
    common = around.groupBy(*H.TRIAD).agg(F.count("*").alias("H_triad_cn"))
    related = H.related_hyperedges(triads, H.hyperedges(inc))
    related = related.select(*H.TRIAD, F.col("related_weight").alias("H_size_weighted_aa"), F.col("mean_size").alias("H_related_edge_size_mean"))
    kind = candidates.select(*H.TRIAD, (F.col("kind") == "open_triangle").cast("int").alias("H_open_triangle"))
    parts = [of_pairs, freq, common, related, vector_features(triads, vectors), kind]
    joined = reduce(lambda x, y: x.join(y, H.TRIAD, "left"), parts, triads)
    return joined.fillna(0, ["H_triad_cn"]).fillna(0.0, ["H_size_weighted_aa", "H_related_edge_size_mean"]).select(*H.TRIAD, *columns(list(SETS)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)


def vector_features(triads: DataFrame, vectors: DataFrame) -> DataFrame:
    """T_cos_mean, T_cos_min and T_volume (Gram determinant, not below zero) of the three terms' vectors."""
    out = triads
    for t in H.TRIAD:
        out = out.join(vectors.select(F.col("term_id").alias(t), F.col("v").alias(f"v_{t}")), t)
    g = lambda i, j: dot(F.col(f"v_{i}"), F.col(f"v_{j}"))
    out = out.select(*H.TRIAD, *(g(i, j).alias(i + j) for i, j in ("ab", "ac", "bc", "aa", "bb", "cc")))
    ab, ac, bc, aa, bb, cc = (F.col(n) for n in ("ab", "ac", "bc", "aa", "bb", "cc"))
    volume = aa * bb * cc + 2 * ab * ac * bc - aa * bc * bc - bb * ac * ac - cc * ab * ab
    return out.select(*H.TRIAD, ((ab + ac + bc) / 3).alias("T_cos_mean"), F.least(ab, ac, bc).alias("T_cos_min"), F.greatest(volume, F.lit(0.0)).alias("T_volume"))


def _weighted(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, q): the sum over ``rows`` of w times the vector q."""
    return rows.groupBy(key).agg(F.array(*(F.sum(F.col("q")[c] * F.col("w")) for c in range(width))).alias("q"))


def _matrix(column):
    import numpy as np

    return np.asarray(column.flatten()).reshape(len(column), -1)


def _gram(vectors: DataFrame, width: int):
    """The width x width matrix of products of the columns of ``vectors`` (q), summed on the executors."""
    import numpy as np
    import pyarrow as pa

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            q = _matrix(batch.column(0))
            if len(q):
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "q"])

    parts = vectors.select("q").mapInArrow(partial, "i long, q array<double>").withColumn("w", F.lit(1.0))
    out = np.zeros((width, width))
    for r in _weighted(parts, "i", width).collect():
        out[r.i] = r.q
    return out


def _turned(vectors: DataFrame, key: str, turn) -> DataFrame:
    """(key, q): every q times the small matrix ``turn``."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            q = _matrix(batch.column(1)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x @ turn) for x in q], pa.list_(pa.float64()))], names=[key, "q"])

    return vectors.select(key, "q").mapInArrow(work, f"{key} {vectors.schema[key].dataType.simpleString()}, q array<double>")


def singular_basis(cells: DataFrame, dims: int, rounds: int = 40, more: int = 8, seed: int = 7) -> tuple[DataFrame, list[float]]:
    """(word, q) with the ``dims`` leading right singular vectors of the sparse matrix ``cells`` (term_id, word, w), and the singular values.

    A subspace iteration with ``more`` spare columns. The basis is a table by word: a round joins it to the cells, sums by term,
    joins that and sums by word. The driver sees only the Gram matrix of the columns, whose eigenvectors make them orthonormal and put them in
    order; columns without weight become zero.
    """
    import numpy as np

    words = cells.select("word").distinct()
    width = min(dims + more, words.count())
    if not width:
        return words.select("word", F.array().cast("array<double>").alias("q")), []
    spread = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "word"), F.lit(1 << 20)) / float(1 << 19) - 1.0
    basis, before = words.select("word", F.array(*map(spread, range(width))).alias("q")), None
    for _ in range(rounds):
        by_term = _weighted(cells.join(basis, "word"), "term_id", width)
        image = kept(_weighted(cells.join(by_term, "term_id"), "word", width), "svd")
        values, vectors = np.linalg.eigh(_gram(image, width))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        good = values > values[0] * 1e-24 if values[0] > 0 else np.zeros(width, bool)
        basis = _turned(image, "word", np.where(good, vectors / np.sqrt(np.where(good, values, 1)), 0))
        lead = np.sqrt(np.sqrt(values[:dims]))
        if before is not None and np.abs(lead - before).max() <= 1e-12 * max(1e-300, lead[0]):
            break
        before = lead
    short = F.slice("q", 1, dims)
    return kept(basis.select("word", short.alias("q")), "svd-basis"), [float(x) for x in lead]


def term_vectors(weights: DataFrame, links: DataFrame, dims: int, most_words: int = 20_000) -> DataFrame:
    """(term_id, v): mean of the papers' word weights, reduced to ``dims`` by singular values, of unit length (or zero).

    ``weights``: paper_id, word, weight (see ``models.tfidf``); ``links``: paper_id, term_id. The ``most_words`` words
    of the largest total count are kept.
    """
    weights = kept(weights, "weights")
    top = weights.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most_words).select("word")
    size = links.groupBy("term_id").agg(F.count_distinct("paper_id").alias("n"))
    sums = links.join(weights.join(top, "word"), "paper_id").groupBy("term_id", "word").agg(F.sum("weight").alias("w"))
    cells = kept(sums.join(size, "term_id").select("term_id", "word", (F.col("w") / F.col("n")).alias("w")), "svd-cells")
    basis, values = singular_basis(cells, dims)
    if not values:
        return cells.select("term_id", F.array().cast("array<double>").alias("v"))
    out = _weighted(cells.join(basis, "word"), "term_id", len(values)).withColumnRenamed("q", "v")
    length = F.sqrt(dot(F.col("v"), F.col("v")))
    return out.select("term_id", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("v"))


def symmetric_features(triads: DataFrame, measures: DataFrame, names: list[str], terms: DataFrame) -> DataFrame:
    """Minimum, mean and maximum of each pair measure (0 where a pair has none) and of the terms' log count, per triad with ``gen_score``."""
    sides = H.triad_pairs(triads.select(*H.TRIAD)).join(measures.select(F.col("a").alias("x"), F.col("b").alias("y"), *names), ["x", "y"], "left").fillna(0, names)
    three = lambda c, n: [F.min(c).alias(f"{n}_min"), F.avg(c).alias(f"{n}_mean"), F.max(c).alias(f"{n}_max")]
    of_pairs = sides.groupBy(*H.TRIAD).agg(*(f for n in names for f in three(n, n)))
    each = triads.select(*H.TRIAD, F.explode(F.array(*H.TRIAD)).alias("term_id")).join(terms, "term_id", "left")
    of_terms = each.groupBy(*H.TRIAD).agg(*three(F.log(F.greatest(F.coalesce("docs", F.lit(1)), F.lit(1))), "log_docs"))
    return triads.select(*H.TRIAD, "gen_score").join(of_pairs, H.TRIAD).join(of_terms, H.TRIAD)
