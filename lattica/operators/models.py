"""Term vectors, boosted ranking with out-of-fold prediction, redundancy rules and vocabulary repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import kept

#: Weights of at most so many words go to the tasks; more meet the counts in a shuffle.
SMALL_VOCABULARY = 500_000


def tfidf(texts: DataFrame, id_col: str, words: str, min_df: int, max_share: float, stop: list[str] = ()) -> DataFrame:
    """id, word, weight: sublinear term frequency times smoothed inverse document frequency, rows of unit length.

    ``words`` is an array column. Words in fewer than ``min_df`` texts or more than ``max_share`` of them, and those of ``stop``, are left out.
    """
    each = texts.select(id_col, F.explode(words).alias("word"))
    each = each.where(~F.col("word").isin(*stop)) if stop else each
    # counts are read for the document frequencies and for the weights, the texts once
    tf = kept(each.groupBy(id_col, "word").agg(F.count("*").alias("tf")), "word-counts")
    n = texts.agg(F.count("*").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df")).join(n).where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    idf = kept(df.select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "word-weights")
    small = F.broadcast if idf.count() <= SMALL_VOCABULARY else lambda w: w
    raw = tf.join(small(idf), "word").select(id_col, "word", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.where(F.col(id_col).isNotNull()).select(id_col, "word", (F.col("w") / norm).alias("weight"))


def mean_vectors(rows: DataFrame, members: DataFrame, id_col: str, group: str) -> DataFrame:
    """group, word, weight: mean of the members' sparse rows."""
    size = members.groupBy(group).agg(F.count("*").alias("n"))
    return rows.join(members, id_col).groupBy(group, "word").agg(F.sum("weight").alias("s")).join(size, group).select(group, "word", (F.col("s") / F.col("n")).alias("weight"))


def out_of_fold(rows: DataFrame, features: list[str], label: str, keys: list[str], folds: int = 3, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Boosted trees trained without each fold and applied to it; folds by a hash of the keys."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds))))
    out = None
    for f in range(folds):
        model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=3, seed=seed).fit(data.where(F.col("_fold") != f))
        part = model.transform(data.where(F.col("_fold") == f)).select(*keys, label, F.lit(f).alias("fold"), vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionAll(part)
    return out


def redundant_pairs(pairs: DataFrame, names: DataFrame, cosines: DataFrame, threshold: float) -> DataFrame:
    """a, b, reason: D1 same words run together, D2 a method's words all in a task's, D3 same type and close vectors; the first rule wins.

    ``names``: term_id, words (array); ``cosines``: a, b, cos.
    """
    one, two = (names.select(F.col("term_id").alias(x), F.col("words").alias(f"w_{x}")) for x in "ab")
    rows = pairs.join(one, "a").join(two, "b").join(cosines, ["a", "b"], "left")
    kind = lambda x: F.substring(x, 1, 1)
    within = lambda x, y: F.size(F.array_except(f"w_{x}", f"w_{y}")) == 0
    d1 = F.array_join("w_a", "") == F.array_join("w_b", "")
    d2 = ((kind("a") == "M") & (kind("b") == "T") & within("a", "b")) | ((kind("a") == "T") & (kind("b") == "M") & within("b", "a"))
    d3 = (kind("a") == kind("b")) & (F.col("cos") >= threshold)
    return rows.select("a", "b", F.when(d1, "D1").when(d2, "D2").when(d3, "D3").alias("reason")).where("reason IS NOT NULL")


def merge_terms(surfaces: DataFrame, heads: DataFrame) -> DataFrame:
    """term_id, surfaces: those of all members under their head, distinct, the head's own first.

    ``surfaces``: term_id, pos, text; ``heads``: term, head.
    """
    named = surfaces.join(heads.select(F.col("term").alias("term_id"), "head"), "term_id", "left").withColumn("head", F.coalesce("head", "term_id"))
    first = named.groupBy("head", "text").agg(F.min(F.struct((F.col("term_id") != F.col("head")).alias("o"), "term_id", "pos")).alias("k"))
    ordered = first.groupBy(F.col("head").alias("term_id")).agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("s"))
    return ordered.select("term_id", F.transform("s", lambda s: s["text"]).alias("surfaces"))


def remapped_phrases(excluded: DataFrame, heads: DataFrame) -> DataFrame:
    """Excluded phrases (term_id, text) of merged terms under their heads."""
    named = excluded.join(heads.select(F.col("term").alias("term_id"), "head"), "term_id", "left")
    return named.select(F.coalesce("head", "term_id").alias("term_id"), "text").distinct()


def letter_variants(phrase: Column, most: int = 2) -> Column:
    """Sorted acronyms of a phrase of two words or more when each word gives its first letter, or up to its first ``most``."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(phrase, F.lit("")), "-", " "), "\\s+"), lambda w: w != "")
    first = lambda w: F.array_distinct(F.array(*(F.upper(w.substr(1, n)) for n in range(1, most + 1))))
    longer = lambda made, w: F.flatten(F.transform(made, lambda m: F.transform(first(w), lambda o: F.concat(m, o))))
    return F.when(F.size(words) >= 2, F.array_sort(F.array_distinct(F.aggregate(words, F.array(F.lit("")), longer)))).otherwise(F.array().cast("array<string>"))


def restore_acronyms(composites: DataFrame, expansions: DataFrame, minimum: int) -> DataFrame:
    """acronym, expansion, support: expansions whose words stand before a suffix that follows the acronym elsewhere.

    ``composites``: text of the form "ACRONYM suffix"; ``expansions``: text "expansion suffix". Support is
    the number of distinct suffixes; of several expansions the best supported wins, ties by text.
    """
    from pyspark.sql.window import Window

    short = composites.select(F.regexp_extract("text", "^([A-Z]{2,}) (.+)$", 1).alias("acronym"), F.regexp_extract("text", "^([A-Z]{2,}) (.+)$", 2).alias("suffix")).where("acronym <> ''")
    words = F.split("text", " ")
    cuts = expansions.select("text", words.alias("w"), F.explode(F.sequence(F.lit(2), F.greatest(F.size(words) - 1, F.lit(2)))).alias("n")).where("n < size(w)")
    long = cuts.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("expansion"), F.expr("array_join(slice(w, n + 1, size(w)), ' ')").alias("suffix"), F.expr("upper(array_join(transform(slice(w, 1, n), x -> substring(x, 1, 1)), ''))").alias("acronym"))
    found = short.join(long, ["acronym", "suffix"]).groupBy("acronym", "expansion").agg(F.count_distinct("suffix").alias("support")).where(F.col("support") >= minimum)
    best = Window.partitionBy("acronym").orderBy(F.desc("support"), "expansion")
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def pair_evidence(rows: DataFrame, id_col: str, size: int, cue: str) -> DataFrame:
    """x, y, n_cooc, n_evidence: texts that hold both terms, and those where a window of ``size`` sentences without a cue does.

    ``rows``: id, idx, sentence, terms.
    """
    from pyspark.sql.window import Window

    from .hypergraph import pairs_of

    text = rows.groupBy(F.col(id_col).alias("paper_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    w = Window.partitionBy(id_col).orderBy("idx").rowsBetween(0, size - 1)
    near = rows.select(F.col(id_col).alias("paper_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms").over(w)))).alias("terms"), F.max(F.col("sentence").rlike(cue)).over(w).alias("cue")).where("NOT cue")
    seen = pairs_of(text).distinct()
    evidence = pairs_of(near).distinct().withColumn("e", F.lit(1))
    return seen.join(evidence, ["paper_id", "a", "b"], "left").groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count("*").alias("n_cooc"), F.count("e").alias("n_evidence"))
