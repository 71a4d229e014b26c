"""Quality rules by host: rule failures are counted per host, their rates shrunk, and the verdicts joined back.

Every document is held against fixed rules (``RULES``, integer comparisons of counts of its whole text). Failures are
summed per host, with partial sums before the shuffle, so that a host with a third of all documents is no hot key. Per
rule a beta prior is fitted to the hosts by moments (the variance between hosts beyond what binomial draws explain), a host's
rate is the posterior mean under it, and a host is rejected when a rule's rate lies above ``limit`` by ``deviations``
posterior deviations. So a host of few documents is judged by the others, and none by chance. A document is kept if it
passes the base rules itself and its host is not rejected.

Only DataFrame functions are used. Windows of a text are compared inside its row, by 128 bits of hashes: nothing but counts is shuffled.

Defined results: a null text is empty; a null host is no host, so its documents meet the base rules alone and count for no host;
repeated rows count as often as they stand; texts of any length are judged whole; an empty table gives no rows; columns of
``keep`` that bear an output's name are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
LIMIT, DEVIATIONS = 0.5, 2.0


def rules() -> dict[str, Column]:
    """Rule -> whether a document fails it. The first two are the base rules."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repetition": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
    }


BASE = ("few_words", "repetition")


def _long(c: Column) -> Column:
    return c.cast("long")


def counts(df: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """``df`` (without column ``text``) and the counts of each whole text; ``df`` has no columns of these names."""
    words = F.filter(F.split(F.col("t"), "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    df = df.withColumn("t", F.coalesce(F.col(text), F.lit(""))).drop(*([text] if text != "t" else []))
    df = df.withColumn("w", words).withColumn("l", lines)
    at = lambda i: F.slice("w", i, window)
    starts = F.sequence(F.lit(1), F.size("w") - (window - 1))
    df = df.withColumn("u", F.when(F.size("w") >= window, F.transform(starts, lambda i: F.xxhash64(at(i)))).otherwise(F.array().cast("array<long>")))
    named = F.transform("u", lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.lit(window), at(i + 1)).alias("g"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,g:bigint,i:int>>")
    df = df.withColumn("s", F.when(F.size(F.array_distinct("u")) < F.size("u"), F.sort_array(named)).otherwise(none))
    same = lambda x, y: F.when((x["h"] == y["h"]) & (x["g"] == y["g"]), F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>"))
    pairs = F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), same)
    df = df.withColumn("p", F.sort_array(F.array_distinct(F.flatten(pairs))))
    steps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.when(F.size("p") == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(window), lambda a, x: a + x))
    return df.select(
        *(c for c in df.columns if c not in ("t", "w", "l", "u", "s", "p")),
        _long(F.size("w")).alias("n_words"),
        _long(F.char_length(F.translate("t", SPACE, ""))).alias("word_chars"),
        _long(F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size("l")).alias("n_lines"),
        _long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        _long(covered).alias("n_repeat_words"),
    )


def prior(hosts: int, rows: int, squares: float, failed: int, ratio: float) -> tuple[float, float]:
    """(mean, strength) of the beta prior from the moments over hosts.

    ``squares`` is the sum of n*n, ``failed`` of k, ``ratio`` of k*k/n. A strength of infinity says that the hosts differ by no
    more than chance, so that all have the mean. A single host meets the uniform prior.
    """
    mean = failed / rows if rows else 0.0
    spread = mean * (1 - mean)
    if hosts < 2:
        return 0.5, 2.0
    free = rows - squares / rows
    if spread == 0:
        return mean, math.inf
    between = (ratio - failed * failed / rows - (hosts - 1) * spread) / free
    return (mean, math.inf) if between <= 0 else (mean, max(spread / between - 1, 0.0))


def host_rates(facts: DataFrame, names: list[str]) -> DataFrame:
    """(host, n, rate_<rule>, low_<rule>) of every host: shrunk rates and their lower bounds; ``facts`` holds host and one boolean a rule."""
    hosts = written(
        facts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *(F.sum(_long(F.col(r))).alias(r) for r in names)), "hosts"
    )
    n = F.col("n").cast("double")
    sums = [f(r) for r in names for f in (lambda r: F.sum(r).alias(f"k_{r}"), lambda r: F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"q_{r}"))]
    m = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum(n * n).alias("s"), *sums).first()
    out = ["host", "n"]
    for r in names:
        mean, strength = prior(m.h, m.n or 0, m.s or 0.0, m[f"k_{r}"] or 0, m[f"q_{r}"] or 0.0)
        if math.isinf(strength):
            rate, weight = F.lit(mean), F.lit(float(m.n or 0) + 1.0)
        else:
            rate = (F.col(r) + F.lit(strength * mean)) / (n + F.lit(strength))
            weight = n + F.lit(strength + 1.0)
        low = rate - F.lit(DEVIATIONS) * F.sqrt(rate * (1 - rate) / weight)
        out += [rate.alias(f"rate_{r}"), low.alias(f"low_{r}")]
    return hosts.select(*out)


def judge(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source", limit: float = LIMIT) -> DataFrame:
    """``keep`` columns, host, the counts, failed (rules), base_failed, host_failed (rules of the host) and kept."""
    outputs = {*COUNTS, "host", "failed", "base_failed", "host_failed", "kept"}
    kept = [c for c in keep if c.lower() not in outputs]
    key = F.struct(*kept) if kept else F.struct(F.lit(0))
    facts = counts(docs.select(key.alias("key"), F.col(host).cast("string").alias("host"), F.col(text).alias("t")), "t")
    names = list(rules())
    facts = written(facts.select("*", *(c.alias(r) for r, c in rules().items())), "facts")
    rates = host_rates(facts, names)
    bad = F.filter(F.array(*(F.when(F.col(f"low_{r}") > limit, F.lit(r)) for r in names)), lambda x: x.isNotNull())
    verdicts = rates.select("host", bad.alias("host_failed")).where(F.size("host_failed") > 0)
    met = attach(facts, verdicts, "host")
    failed = F.filter(F.array(*(F.when(F.col(r), F.lit(r)) for r in names)), lambda x: x.isNotNull())
    base = F.lit(False)
    for r in BASE:
        base = base | F.col(r)
    return met.select(
        *(F.col("key")[c].alias(c) for c in kept),
        "host",
        *COUNTS,
        failed.alias("failed"),
        base.alias("base_failed"),
        F.coalesce("host_failed", F.array().cast("array<string>")).alias("host_failed"),
        (~base & F.col("host_failed").isNull()).alias("kept"),
    )
