"""Null models, multiple testing, ranking metrics, bootstraps and agreement as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import upper_tail
from .ranks import average_ranks, equal_bins, numbered, running, settled

TRIAD = ["a", "b", "c"]


def null_model(triads: DataFrame, docs: DataFrame, degrees: DataFrame) -> DataFrame:
    """Adds expected, p_one (exact P of at least one paper) and groups (array of n, q) to triads.

    A paper of d terms holds a triad with q_d = product of min(1, d * docs / links); ``docs`` is (term_id,
    docs), ``degrees`` (degree, papers). The degree table is one row per paper size.
    """
    out = triads
    for t in TRIAD:
        out = out.join(docs.select(F.col("term_id").alias(t), F.col("docs").alias(f"w_{t}")), t, "left").fillna(0, [f"w_{t}"])
    links = degrees.agg(F.sum(F.col("degree") * F.col("papers")).cast("double").alias("links"))
    groups = degrees.agg(F.array_sort(F.collect_list(F.struct(F.col("degree").cast("long").alias("d"), F.col("papers").cast("long").alias("n")))).alias("g"))
    out = out.join(links).join(groups)
    chance = lambda g: F.least(F.lit(1.0), g["d"] * F.col("w_a") / F.col("links")) * F.least(F.lit(1.0), g["d"] * F.col("w_b") / F.col("links")) * F.least(F.lit(1.0), g["d"] * F.col("w_c") / F.col("links"))
    out = out.withColumn("groups", F.transform("g", lambda g: F.struct(g["n"].alias("n"), chance(g).alias("q"))))
    out = out.withColumn("expected", F.aggregate("groups", F.lit(0.0), lambda s, g: s + g["n"] * g["q"]))
    none = F.aggregate("groups", F.lit(0.0), lambda s, g: s + g["n"] * F.log1p(-F.least(g["q"], F.lit(1 - 1e-16))))
    return out.withColumn("p_one", -F.expm1(none)).drop("g", "links", "w_a", "w_b", "w_c")


def tail_probability(rows: DataFrame) -> DataFrame:
    """Adds p_value = P(X >= observed) from groups and observed. For at least one paper it is the product form, ``p_one`` of the null
    model; only more papers are worth the inversion."""
    none = F.aggregate("groups", F.lit(0.0), lambda s, g: s + g["n"] * F.log1p(-F.least(g["q"], F.lit(1 - 1e-16))))
    once = F.col("p_one") if "p_one" in rows.columns else -F.expm1(none)
    return rows.withColumn("p_value", F.when(F.col("observed") == 1, once).otherwise(upper_tail(F.col("groups"), F.col("observed"))))


def benjamini_hochberg(rows: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds q_value: p * m / rank, made monotone from the largest p down, at most 1."""
    keys = [c for c, kind in rows.dtypes if c != p and kind in ("string", "int", "bigint", "double")]
    order = [F.col(p), *map(F.col, keys)]
    # p-values are dear: filter, count and order read them from one settled table
    rows = settled(rows)
    ranked = numbered(rows.where(F.col(p).isNotNull()), order, "_r").join(rows.agg(F.count(p).alias("_m")))
    raw = F.col(p) * F.col("_m") / F.col("_r")
    return running(ranked, [-F.col("_r")], raw, "_q", how="min").withColumn("q_value", F.least(F.lit(1.0), F.col("_q"))).drop("_r", "_m", "_q")


def generic_terms(incidence: DataFrame, degrees: DataFrame, q: float, scale: float = 1.0) -> DataFrame:
    """Terms in more than N / (w* scale) papers, w* the ``q`` quantile (upper neighbour) of the paper degrees."""
    # papers are counted per degree: the quantile is the first degree that so many papers reach
    sizes = running(degrees.groupBy("degree").agg(F.count("*").alias("n")), [F.col("degree")], F.col("n"), "upto")
    sums = degrees.agg(F.count("*").alias("papers"), F.sum("degree").alias("total"))
    limit = sizes.join(sums).where(F.col("upto") > F.ceil(F.lit(q) * (F.col("papers") - 1))).agg((F.max("total") / F.min("degree") / scale).alias("limit"))
    counts = incidence.groupBy("term_id").agg(F.count("*").alias("docs"))
    return counts.join(limit).where("docs > limit").select("term_id", "docs")


def percentile_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: average rank over the non-null values divided by their number; null stays null."""
    return average_ranks(rows, column, name)


def weighted_precision(ranked: DataFrame, k: float, order: list[Column], y: str = "y", w: str = "w") -> DataFrame:
    """precision over the first ``k`` units of weight; the row that crosses counts in part."""
    upto = running(ranked, order, F.col(w).cast("double"), "_upto")
    taken = upto.withColumn("_take", F.greatest(F.lit(0.0), F.least(F.col(w).cast("double"), F.lit(float(k)) - (F.col("_upto") - F.col(w)))))
    total = F.sum("_take")
    return taken.agg((F.sum(F.col("_take") * F.col(y)) / F.when(total > 0, total)).alias("precision"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("base_rate")).withColumn("lift", F.col("precision") / F.when(F.col("base_rate") > 0, F.col("base_rate")))


def average_precision(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Average precision with tied scores as one step, and ROC area with half credit for ties."""
    steps = scored.groupBy(score).agg(F.sum(y).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    run = running(running(steps, [-F.col(score)], F.col("p"), "tp"), [-F.col(score)], F.col("n"), "all")
    neg = F.col("n") - F.col("p")
    sums = run.agg(F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"), F.sum("p").alias("pos"), F.sum(neg).alias("neg"), F.sum(neg * (F.col("tp") - F.col("p") / 2)).alias("area"))
    return sums.select((F.col("ap") / F.when(F.col("pos") > 0, F.col("pos"))).alias("average_precision"), (F.col("area") / F.when(F.col("pos") * F.col("neg") > 0, F.col("pos") * F.col("neg"))).alias("roc_auc"))


def poisson_weight(seed: int, *keys: Column) -> Column:
    """Poisson(1) weight from a hash of the keys: the same for a key on every run and executor."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    edges, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        edges.append(total)
        term /= k + 1
    return sum((F.when(u > e, 1).otherwise(0) for e in edges[1:]), F.when(u > edges[0], 1).otherwise(0))


def draws(spark, n: int, replicates: int, seed: int) -> DataFrame:
    """(rep, i, w): how often each of ``n`` places, from 0, comes up in ``n`` draws with replacement, per replicate; places never drawn are absent."""
    cells = spark.range(n * replicates)
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))
    return cells.groupBy(F.floor(F.col("id") / n).alias("rep"), place.alias("i")).agg(F.count("*").cast("double").alias("w"))


def candidate_bootstrap(ranked: DataFrame, k: int, replicates: int, seed: int, order: list[Column]) -> DataFrame:
    """Per replicate the lift at ``k`` when as many candidates as there are get drawn with replacement."""
    placed = settled(numbered(ranked, order, "r"))
    weights = draws(ranked.sparkSession, placed.count(), replicates, seed)
    return _lift_per_rep(placed.join(weights, F.col("r") - 1 == F.col("i")), k)


def block_bootstrap(ranked: DataFrame, k: int, replicates: int, seed: int, order: list[Column]) -> DataFrame:
    """The same when terms are drawn; a candidate weighs the product of its three terms' counts, so those that share a term move together."""
    placed = settled(numbered(ranked, order, "r"))
    terms = settled(numbered(placed.select(F.explode(F.array(*TRIAD)).alias("term")).distinct(), [F.col("term")], "t"))
    weights = draws(ranked.sparkSession, terms.count(), replicates, seed).join(terms, F.col("t") - 1 == F.col("i"))
    out = placed
    for t in TRIAD:
        own = weights.select(*(["rep"] if t == "a" else [F.col("rep")]), F.col("term").alias(t), F.col("w").alias(f"w_{t}"))
        out = out.join(own, [t] if t == "a" else ["rep", t])
    return _lift_per_rep(out.withColumn("w", F.col("w_a") * F.col("w_b") * F.col("w_c")), k)


def redrawn(ranked: DataFrame, seed: int) -> DataFrame:
    """One pseudo replication: terms are drawn with replacement, a candidate comes up as often as the product of its terms' draws."""
    placed = settled(numbered(ranked.select(F.explode(F.array(*TRIAD)).alias("term")).distinct(), [F.col("term")], "t"))
    weights = draws(ranked.sparkSession, placed.count(), 1, seed).join(placed, F.col("t") - 1 == F.col("i"))
    out = ranked
    for t in TRIAD:
        out = out.join(weights.select(F.col("term").alias(t), F.col("w").alias(f"w_{t}")), t)
    times = (F.col("w_a") * F.col("w_b") * F.col("w_c")).cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*ranked.columns)


def _lift_per_rep(rows: DataFrame, k: int) -> DataFrame:
    run = Window.partitionBy("rep").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    take = F.greatest(F.lit(0.0), F.least(F.col("w"), F.lit(float(k)) - (F.sum("w").over(run) - F.col("w"))))
    sums = rows.withColumn("take", take).groupBy("rep").agg(F.sum(F.col("take") * F.col("y")).alias("hit"), F.sum("take").alias("t"), F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("all"))
    return sums.select("rep", ((F.col("hit") / F.col("t")) / F.nullif(F.col("pos") / F.col("all"), F.lit(0.0))).alias("lift")).where("lift IS NOT NULL")


def paired_difference(ranked: DataFrame, k: int, replicates: int, seed: int, one: list[Column], two: list[Column]) -> DataFrame:
    """Per replicate the difference of the precision at ``k`` of two orders of the same candidates, under the same draws."""
    placed = settled(numbered(numbered(ranked, two, "r2"), one, "r"))
    weights = draws(ranked.sparkSession, placed.count(), replicates, seed)
    rows = placed.join(weights, F.col("r") - 1 == F.col("i"))
    parts = []
    for c in ("r", "r2"):
        run = Window.partitionBy("rep").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        take = F.greatest(F.lit(0.0), F.least(F.col("w"), F.lit(float(k)) - (F.sum("w").over(run) - F.col("w"))))
        parts.append(rows.withColumn("take", take).groupBy("rep").agg((F.sum(F.col("take") * F.col("y")) / F.sum("take")).alias(f"p_{c}")))
    return parts[0].join(parts[1], "rep").select("rep", (F.col("p_r") - F.col("p_r2")).alias("difference"))


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias("lower"), F.percentile(column, F.lit(1 - tail)).alias("upper"), F.count("*").alias("replicates"))


def unit_weights(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(unit, rep, w): a Poisson(1) weight of each distinct unit in each replicate, whatever candidate it stands in."""
    return reweighted(units.select("unit").distinct(), replicates, seed)


def reweighted(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Every row of ``units`` in each replicate, with the weight that ``unit_weights`` gives its unit: made at the row, without a join."""
    each = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return each.withColumn("w", poisson_weight(seed, F.col("rep"), F.col("unit")))


def unit_bootstrap(units: DataFrame, key: list[str], axes: list[str], replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """Per candidate and axis: interval (lower, upper) of the weighted mean over its units, the share of replicates in which no
    unit of the axis is left (missing_share), and the share in which the axis is the riskiest: the first missing one in the
    order of ``axes``, else the smallest mean.

    ``units``: key, axis, unit, value. Weights are those of ``unit_weights``, so candidates that share units move together.
    """
    means = reweighted(units.where(F.col("unit").isNotNull()), replicates, seed)
    means = means.groupBy(*key, "axis", "rep").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    place = F.array_position(F.array(*map(F.lit, axes)), F.col("axis"))
    every = units.select(*key).distinct().select(*key, F.explode(F.array(*map(F.lit, axes))).alias("axis"), F.lit(replicates).alias("n"))
    grid = every.withColumn("rep", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(means, [*key, "axis", "rep"], "left")
    rank = F.struct(F.col("mean").isNotNull().alias("there"), F.when(F.col("mean").isNotNull(), F.col("mean")).otherwise(0.0).alias("m"), place.alias("i"))
    worst = grid.groupBy(*key, "rep").agg(F.min_by("axis", rank).alias("worst"))
    tail = (1 - level) / 2
    return grid.join(worst, [*key, "rep"]).groupBy(*key, "axis").agg(
        F.percentile("mean", F.lit(tail)).alias("lower"),
        F.percentile("mean", F.lit(1 - tail)).alias("upper"),
        F.avg(F.col("mean").isNull().cast("int")).alias("missing_share"),
        F.avg((F.col("axis") == F.col("worst")).cast("int")).alias("riskiest_share"),
    )


def concentration(top: DataFrame) -> DataFrame:
    """Per term of the ranked triads the slots it holds and their share."""
    slots = top.select(F.explode(F.array(*TRIAD)).alias("term_id"))
    n = slots.agg(F.count("*").alias("all"))
    return slots.groupBy("term_id").agg(F.count("*").alias("slots")).join(n).select("term_id", "slots", (F.col("slots") / F.col("all")).alias("share"))


def kappa(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Observed and expected agreement of two labellings and Cohen's kappa."""
    cells = rows.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("x"), F.col(two).alias("y")).agg(F.count("*").cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0.0)).alias("same"))
    left, right = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, "x").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0.0)).alias("e"))
    out = total.join(chance).select((F.col("same") / F.col("t")).alias("agreement"), (F.col("e") / (F.col("t") * F.col("t"))).alias("expected"), F.col("t").cast("long").alias("n"))
    return out.withColumn("kappa", (F.col("agreement") - F.col("expected")) / F.when(F.col("expected") < 1, 1 - F.col("expected")))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of the average ranks of complete rows."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(full, x, "_x"), y, "_y")
    return ranked.agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def reliability(rows: DataFrame, score: str, y: str, bins: int, keys: list[str]) -> DataFrame:
    """Equal-count bins by score: mean score, share of positives, size."""
    binned = equal_bins(rows, bins, [F.col(score), *map(F.col, keys)], "bin")
    return binned.groupBy("bin").agg(F.avg(score).alias("mean_score"), F.avg(y).alias("share"), F.count("*").alias("n"))


def power_of_test(n: int, p0: float, p1: float, alpha: float) -> float:
    """Power of the exact one-sided binomial test of p0 at p1 with ``n`` trials."""
    import math

    def tail(c: int, p: float) -> float:
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(c, n + 1))

    critical = next((c for c in range(n + 1) if tail(c, p0) <= alpha), n + 1)
    return tail(critical, p1)


def sample_size(p0: float, p1: float, alpha: float, power: float, step: int = 5, most: int = 2000) -> int | None:
    return next((n for n in range(step, most + 1, step) if power_of_test(n, p0, p1, alpha) >= power), None)


def run_sequence(results: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    """Ordered tests: after the first failure nothing else is tested."""
    out, going = [], True
    for name, passed in results:
        out.append((name, ("pass" if passed else "fail") if going else "not tested"))
        going = going and passed
    return out


def diversified(order: list, terms, cap: int) -> list[int]:
    """Greedy order in which no term stands more than ``cap`` times before those put off, which follow in order."""
    used, first, later = {}, [], []
    for i in order:
        own = terms[i]
        if all(used.get(t, 0) < cap for t in own):
            first.append(i)
            for t in own:
                used[t] = used.get(t, 0) + 1
        else:
            later.append(i)
    return first + later


def diversified_rows(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """``rank`` of every row of a, b, c in the order ``diversified`` gives it.

    The cap is sequential, so the sorted rows stream through one task, which holds a counter a term.
    """
    import pyarrow as pa

    def work(batches):
        used, n = {}, 0
        for batch in batches:
            later = []
            for own in zip(*(c.to_pylist() for c in batch.columns)):
                fits = all(used.get(t, 0) < cap for t in own)
                for t in own if fits else ():
                    used[t] = used.get(t, 0) + 1
                later.append(not fits)
            places = pa.array(range(n, n + len(later)), pa.int64())
            n += len(later)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(later, pa.bool_()), places], names=[*TRIAD, "_later", "_n"])

    one = rows.repartition(1).sortWithinPartitions(*order).select(*TRIAD)
    kinds = ", ".join(f"{t} {rows.schema[t].dataType.simpleString()}" for t in TRIAD)
    marked = one.mapInArrow(work, f"{kinds}, _later boolean, _n long")
    return marked.select(F.row_number().over(Window.orderBy("_later", "_n")).alias("rank"), *TRIAD)


def axis_value(*indicators: Column) -> Column:
    """Mean of the percentiles that are there; null where none is."""
    there = F.array_compact(F.array(*indicators))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def riskiest_axis(axes: dict[str, tuple[Column, Column]]) -> Column:
    """The first axis, in the order given, whose score is missing; else the one with the smallest (score, value)."""
    missing = F.coalesce(*(F.when(score.isNull(), F.lit(name)) for name, (score, _) in axes.items()))
    lowest = F.least(*(F.struct(score.alias("s"), value.alias("v"), F.lit(i).alias("i"), F.lit(name).alias("axis")) for i, (name, (score, value)) in enumerate(axes.items())))
    return F.coalesce(missing, lowest["axis"])


def indicators(units: DataFrame, pairs: DataFrame, assignees: DataFrame, key: list[str]) -> DataFrame:
    """Per candidate: stars (largest of a distinct repository) and their growth, fewest papers of its pairs, whether it is an
    open triangle, terms with a repository, distinct company assignees and their share of the classified ones.

    ``units``: key, term_id, repo, stars, recent, before; ``pairs``: key, cnt, stable; ``assignees``: key, name, class.
    """
    repos = units.where(F.col("repo").isNotNull()).groupBy(*key, "repo").agg(F.max("stars").alias("stars"), F.max("recent").alias("recent"), F.max("before").alias("before"))
    d = repos.groupBy(*key).agg(F.sum("stars").alias("d_stars"), ((F.sum("recent") + 1) / (F.sum("before") + 1)).alias("d_growth"))
    terms = units.where(F.col("repo").isNotNull()).groupBy(*key).agg(F.count_distinct("term_id").alias("f_implemented"))
    f = pairs.groupBy(*key).agg(F.min("cnt").alias("f_pair_papers"), (F.count_if("stable") == 3).alias("f_open"))
    named = assignees.select(*key, "name", "class").distinct().groupBy(*key).agg(F.count_if(F.col("class") == "company").alias("v_companies"), F.count_if(~F.col("class").isin("unknown", "individual")).alias("classified"))
    v = named.select(*key, "v_companies", (F.col("v_companies") / F.when(F.col("classified") > 0, F.col("classified"))).alias("v_share"))
    return f.join(d, key, "left").join(terms, key, "left").join(v, key, "left").fillna(0, ["f_implemented", "v_companies"])


def realised_by_score(rows: DataFrame, axes: list[str], realised: str) -> DataFrame:
    """(axis, score, n, realised): candidates by axis score, missing ones under "missing", and how many came true."""
    each = F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("missing")).alias("score")) for a in axes))
    return rows.select(F.explode(each).alias("x"), F.col(realised).cast("int").alias("y")).groupBy("x.axis", "x.score").agg(F.count("*").alias("n"), F.sum("y").alias("realised"))


def adopted(rows: DataFrame, target: float) -> DataFrame:
    """Adds rule: ``separated`` where the interval (lower, upper) of one side lies above the other's, ``target`` where its lower
    end reaches the target, else null. ``rows``: lower, upper, other_lower, other_upper."""
    return rows.withColumn("rule", F.when(F.col("lower") > F.col("other_upper"), "separated").when(F.col("lower") >= target, "target"))
