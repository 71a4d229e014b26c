"""Vectors, ranking model, vocabulary repair and evidence indicators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as fn
from ..operators import features as X
from ..operators import hypergraph as H
from ..operators import matching as M
from ..operators import models as L
from ..operators import statistics as S
from ..operators.ranks import numbered, running, settled
from .bindings import table, with_
from .graph import GRAPH, Graph
from .registry import query
from .statistics import Null, ascending

WORDS = "w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), tf AS (SELECT item_id, u AS word, count(*) AS tf FROM (SELECT item_id, unnest(ws) AS u FROM w) GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL), r AS (SELECT item_id, word, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word), n WHERE df >= 2 AND df <= 0.5 * n)"


@query("m04_tfidf", f"WITH {WORDS} SELECT item_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM r")
def m04(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("ws"))
    return L.tfidf(items, "item_id", "ws", 2, 0.5).withColumn("weight", F.round("weight", 6))


@query("m04_term_vectors", f"WITH {WORDS}, v AS (SELECT item_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM r), k AS (SELECT item_id % 7 AS g, count(*) AS n FROM benchmark GROUP BY ALL) SELECT item_id % 7 AS g, word, round(sum(weight) / max(n), 6) AS weight FROM v JOIN k ON k.g = item_id % 7 GROUP BY ALL")
def m04v(spark, sf):
    b = table(spark, sf, "benchmark")
    items = b.select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("ws"))
    return L.mean_vectors(L.tfidf(items, "item_id", "ws", 2, 0.5), b.select("item_id", (F.col("item_id") % 7).alias("g")), "item_id", "g").withColumn("weight", F.round("weight", 6))


def document_vectors(spark, sf):
    """(weights, links): word weights of all documents, and each document's source and language as its terms."""
    d = table(spark, sf, "documents")
    words = d.select(F.col("doc_id").alias("paper_id"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1)).alias("ws"))
    links = d.select(F.col("doc_id").alias("paper_id"), F.explode(F.array("source", F.concat(F.lit("lang "), "lang"))).alias("term_id"))
    return L.tfidf(words, "paper_id", "ws", 5, 0.5, ["the", "and", "que", "les"]), links


@query("m04_svd_similarity")
def m04s(spark, sf):
    """Cosines of every source and language with the languages (the query set) by their mean document, reduced to eight dimensions."""
    v = X.term_vectors(*document_vectors(spark, sf), 8, 2_000)
    asked = v.where(F.col("term_id").startswith("lang ")).agg(F.collect_list(F.struct("term_id", "v")).alias("qs"))
    rows = v.join(F.broadcast(asked)).select(F.col("term_id").alias("a"), "v", F.explode("qs").alias("x"))
    return rows.select("a", F.col("x.term_id").alias("b"), F.round(X.dot(F.col("v"), F.col("x.v")), 5).alias("cos"))


@query("m10_out_of_fold")
def m10(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t = F.col("text")
    share = lambda p: F.length(F.regexp_replace(t, f"[^{p}]", "")) / F.greatest(F.length(t), F.lit(1))
    data = rows.select("doc_id", F.col("quality").cast("double").alias("y"), F.length(t).cast("double").alias("n"), share("A-Z").alias("upper"), share("!#$%&*|").alias("marks"), share("0-9").alias("digits"))
    return L.out_of_fold(settled(data), ["n", "upper", "marks", "digits"], "y", ["doc_id"])


@query("m06_evidence_features", "WITH p AS (SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS e FROM lineitem GROUP BY ALL) SELECT a.k AS k, CAST((coalesce(a.e, 0) > 0)::INT + (coalesce(b.e, 0) > 0)::INT AS INTEGER) AS e_pairs, round((a.e / a.n + coalesce(b.e / b.n, 0)) / 2, 8) AS e_mean, round(least(a.e / a.n, coalesce(b.e / b.n, 0)), 8) AS e_min FROM p a LEFT JOIN p b ON b.k = a.k + 1")
def m06(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("e"))
    a = p.select("k", F.col("e").alias("e1"), (F.col("e") / F.col("n")).alias("s1"))
    b = p.select((F.col("k") - 1).alias("k"), F.col("e").alias("e2"), (F.col("e") / F.col("n")).alias("s2"))
    r = a.join(b, "k", "left").fillna(0, ["e2", "s2"])
    return r.select("k", ((F.col("e1") > 0).cast("int") + (F.col("e2") > 0).cast("int")).alias("e_pairs"), F.round((F.col("s1") + F.col("s2")) / 2, 8).alias("e_mean"), F.round(F.least("s1", "s2"), 8).alias("e_min"))


@query("x13_lift_at_cutoffs", with_(*GRAPH) + "SELECT CAST(k AS INTEGER) AS k, round(avg(y) FILTER (r <= k) / avg(y), 8) AS lift FROM (SELECT row_number() OVER (ORDER BY weakest_pair_count DESC, a, b, c) AS r, (a[1] = 'M')::INT AS y FROM ot), (VALUES (10), (50), (200)) v(k) GROUP BY ALL")
def x13(spark, sf):
    rows = numbered(Graph(spark, sf).open(), [-F.col("weakest_pair_count"), *map(F.col, H.TRIAD)], "r").withColumn("y", F.col("a").startswith("M").cast("int"))
    cuts = F.array(*map(F.lit, (10, 50, 200)))
    long = rows.withColumn("k", F.explode(cuts))
    return long.groupBy("k").agg(F.round(F.avg(F.when(F.col("r") <= F.col("k"), F.col("y"))) / F.avg("y"), 8).alias("lift"))


@query("x17_paired_difference")
def x17(spark, sf):
    """Interval of the difference in precision of two orders under the same draws."""
    rows = Null(spark, sf).ranked()
    return S.interval(S.paired_difference(rows, 100, 300, 7, ascending("score"), [F.col("a"), F.col("b"), F.col("c")]), "difference")


@query("x19_nested_power")
def x19(spark, sf):
    """Share of pseudo replications (terms drawn anew) whose inner bootstrap bound clears lift 1."""
    rows = settled(Null(spark, sf).ranked())  # every replication reads the candidates, the graph is built once
    clear = None
    for outer in range(4):
        bound = S.interval(S.block_bootstrap(S.redrawn(rows, 11 + outer), 100, 50, 12, ascending("score")), "lift").select((F.col("lower") > 1).cast("int").alias("clears"))
        clear = bound if clear is None else clear.unionAll(bound)
    return clear.agg(F.avg("clears").alias("power"), F.count("*").alias("replications"))


@query("x27_indicators", """WITH c AS (SELECT n_nationkey AS cand, o_orderkey, o_custkey, o_orderdate, l_suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)
SELECT cand, count(DISTINCT o_custkey) AS d1, round((count(DISTINCT o_orderkey) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') / 2.0::DOUBLE + 1) / (count(DISTINCT o_orderkey) FILTER (o_orderdate < TIMESTAMP '2000-01-01') / 3.0::DOUBLE + 1), 8) AS d2, count(DISTINCT l_suppkey) AS v1, round(count(DISTINCT CASE WHEN s_acctbal > 0 THEN l_suppkey END) / count(DISTINCT l_suppkey), 8) AS v2 FROM c JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def x27(spark, sf):
    """Units reached per candidate, smoothed growth, and the share of reached suppliers of one class."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cand"))
    o = table(spark, sf, "orders").join(c, "o_custkey").select("cand", "o_orderkey", "o_custkey", "o_orderdate")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(s, "l_suppkey").join(o, "o_orderkey")
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")
    n = lambda when: F.count_distinct(F.when(when, F.col("o_orderkey")))
    return rows.groupBy("cand").agg(
        F.count_distinct("o_custkey").alias("d1"),
        F.round((n(late) / 2.0 + 1) / (n(~late) / 3.0 + 1), 8).alias("d2"),
        F.count_distinct("l_suppkey").alias("v1"),
        F.round(F.count_distinct(F.when(F.col("s_acctbal") > 0, F.col("l_suppkey"))) / F.count_distinct("l_suppkey"), 8).alias("v2"),
    )


@query("x29_adoption_rule", "WITH g AS (SELECT o_orderpriority AS s, count(*) FILTER (o_totalprice > 100000) AS k, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT s, k, n, (k / n + 3.8414588206941/(2*n) - 1.959963984540054*sqrt((k/n)*(1-k/n)/n + 3.8414588206941/(4*n*n))) / (1 + 3.8414588206941/n) AS lo FROM g) SELECT s AS stratum, k, n, lo >= 0.5 AS adopted FROM b")
def x29(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count_if(F.col("o_totalprice") > 100000).alias("k"), F.count("*").alias("n"))
    return g.withColumn("adopted", fn.wilson(F.col("k"), F.col("n"))[0] >= 0.5)


@query("g19_pair_evidence")
def g19(spark, sf):
    s = M.sentences(table(spark, sf, "documents"), "doc_id", "text")
    wanted = F.array(*map(F.lit, ("the", "of", "with", "and", "from")))
    s = s.withColumn("terms", F.array_intersect(F.array_distinct(fn.tokens(F.col("sentence"))), wanted))
    return L.pair_evidence(s, "doc_id", 2, M.cue_pattern(["compared with", "versus"]))


@query("g22_merge_terms", "WITH s AS (SELECT p_brand AS t, p_type AS x, min(p_partkey) AS pos FROM part GROUP BY ALL), h AS (SELECT t, CASE WHEN t IN ('Brand#12', 'Brand#13') THEN 'Brand#11' ELSE t END AS head, x FROM s) SELECT head AS term_id, count(DISTINCT x) AS n FROM h GROUP BY ALL")
def g22(spark, sf):
    surfaces = table(spark, sf, "part").groupBy(F.col("p_brand").alias("term_id"), F.col("p_type").alias("text")).agg(F.min("p_partkey").alias("pos"))
    heads = spark.createDataFrame([("Brand#12", "Brand#11"), ("Brand#13", "Brand#11"), ("Brand#11", "Brand#11")], "term string, head string")
    return L.merge_terms(surfaces, heads).select("term_id", F.size("surfaces").cast("long").alias("n"))


@query("t17_common_words", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), c AS (SELECT u AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS u, doc_id FROM documents) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 50) SELECT w FROM w WHERE w IN (SELECT w FROM c) OR (w LIKE '%s' AND left(w, -1) IN (SELECT w FROM c)) OR (w LIKE '%ed' AND left(w, -2) IN (SELECT w FROM c))")
def t17(spark, sf):
    words = lambda df: F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")
    w = table(spark, sf, "benchmark").select(words(0)).distinct()
    common = table(spark, sf, "documents").select("doc_id", words(0)).groupBy("w").agg(F.count_distinct("doc_id").alias("n")).where("n >= 50").select(F.col("w").alias("form"))
    forms = w.withColumn("form", F.explode(F.array_compact(F.array("w", F.when(F.col("w").endswith("s"), F.expr("substring(w, 1, length(w) - 1)")), F.when(F.col("w").endswith("ed"), F.expr("substring(w, 1, length(w) - 2)"))))))
    return forms.join(common, "form", "left_semi").select("w").distinct()


@query("t19_example_sentences")
def t19(spark, sf):
    s = M.sentences(table(spark, sf, "documents"), "doc_id", "text").where(F.col("sentence").rlike("(?i)\\bwith\\b"))
    return s.orderBy(F.length("sentence"), "doc_id", "idx").limit(5).select("doc_id", "idx", "sentence")


@query("f07_drop_modes", "SELECT p_brand, count(*) AS kept FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_type NOT LIKE '%STEEL') GROUP BY ALL")
def f07(spark, sf):
    terms = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.struct(F.col("p_type").alias("text"), F.when(F.col("p_type").endswith("STEEL"), "cs").otherwise("ci").alias("match"))).alias("surfaces"))
    return terms.withColumn("surfaces", F.filter("surfaces", lambda s: s["match"] != "cs")).where(F.size("surfaces") > 0).select("p_brand", F.size("surfaces").cast("long").alias("kept"))


@query("f08_case_only_terms", "SELECT p_brand, bool_and(p_type LIKE '%STEEL' OR p_type LIKE '%BRASS') AS cs_only FROM part GROUP BY ALL")
def f08(spark, sf):
    terms = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("s"))
    return terms.select("p_brand", F.forall("s", lambda s: s.endswith("STEEL") | s.endswith("BRASS")).alias("cs_only"))


@query("f16_used_triads", with_(*GRAPH, "u AS (SELECT a, b, c FROM ot WHERE weakest_pair_count >= 12)") + "SELECT a, b, c FROM ot EXCEPT SELECT a, b, c FROM u")
def f16(spark, sf):
    """Triads already used, in whatever order their terms were written down, are left out."""
    rows = Graph(spark, sf).open()
    used = rows.where("weakest_pair_count >= 12").select(F.array_sort(F.array("c", "a", "b")).alias("k"))
    return rows.withColumn("k", F.array_sort(F.array(*H.TRIAD))).join(used, "k", "left_anti").select(*H.TRIAD)


@query("o02_baseline_order", with_(*GRAPH) + "SELECT a, b, c, CAST(row_number() OVER (ORDER BY c DESC, a, b) AS INTEGER) AS place FROM ot")
def o02(spark, sf):
    rows = Graph(spark, sf).open().select(*H.TRIAD)
    blocks = running(rows.groupBy("c").agg(F.count("*").alias("n")), [F.col("c")], F.col("n"), "upto").select("c", "upto")
    placed = rows.join(blocks, "c").join(rows.agg(F.count("*").alias("n")))
    own = F.row_number().over(Window.partitionBy("c").orderBy("a", "b"))
    return placed.select(*H.TRIAD, (F.col("n") - F.col("upto") + own).cast("int").alias("place"))


@query("r04_prospective_terms", "SELECT DISTINCT l_suppkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > TIMESTAMP '1999-12-31' AND o_orderdate <= TIMESTAMP '2000-12-31'")
def r04p(spark, sf):
    o = table(spark, sf, "orders").where((F.col("o_orderdate") > F.lit("1999-12-31").cast("timestamp")) & (F.col("o_orderdate") <= F.lit("2000-12-31").cast("timestamp"))).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(o, "l_orderkey", "left_semi").select(F.col("l_suppkey").alias("k")).distinct()
