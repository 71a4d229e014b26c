"""Hypergraph queries over the supplier graph of the build window (parts where the graph must be sparse)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.scalar import gmean, growth
from ..operators import hypergraph as H
from ..operators.ranks import numbered, settled
from .bindings import NOT_ALL_TASKS, incidence, precisions, sql_incidence, sql_open, sql_pairs, sql_pi, sql_triples, table, with_
from .registry import query

SUPPORT = 10
BASE = (sql_incidence(), sql_pairs())
STABLE = f"st AS (SELECT a, b, cnt FROM pc WHERE cnt >= {SUPPORT})"
GRAPH = (*BASE, STABLE, sql_triples(), sql_open("ot0"), f"ot AS (SELECT * FROM ot0 WHERE {NOT_ALL_TASKS})")
ADJ = "adj AS (SELECT a AS src, b AS dst FROM st UNION ALL SELECT b, a FROM st)"
DEG = "deg AS (SELECT src AS z, count(*) AS d FROM adj GROUP BY ALL)"
AA = "aa AS (SELECT l.dst AS a, r.dst AS b, sum(1 / ln(d)) AS aa, count(*) AS common FROM adj l JOIN adj r ON l.src = r.src AND l.dst < r.dst JOIN deg ON z = l.src WHERE d > 1 GROUP BY ALL)"
DOCS = "docs AS (SELECT term_id, count(DISTINCT paper_id) AS docs FROM inc GROUP BY ALL)"
NPMI = (
    "np AS (SELECT p.a, p.b, cnt, x.docs AS n_a, y.docs AS n_b, n, CASE WHEN cnt = 0 THEN -1.0 WHEN cnt >= n THEN 1.0 "
    "ELSE ln((cnt / n) / ((x.docs / n) * (y.docs / n))) / -ln(cnt / n) END AS npmi FROM pc p JOIN docs x ON x.term_id = p.a JOIN docs y ON y.term_id = p.b, "
    "(SELECT CAST(count(DISTINCT paper_id) AS DOUBLE) AS n FROM inc))"
)


class Graph:
    """The pieces the queries of this module share. ``support`` and ``seeds`` suit the tables the SQL is held against;
    denser or sparser ones need others (see bench.py)."""

    support, seeds = SUPPORT, 14

    def __init__(self, spark, sf, term="supplier", window="build", support=None):
        self.inc = incidence(spark, sf, term, window)
        self.edges = H.hyperedges(self.inc)
        self.pairs = H.pair_counts(self.edges)
        self.closed = H.closed_triads(self.edges)
        self.least = support or self.support

    @cached_property
    def stable(self):
        """Few pairs, read several times by every query on the graph; their counts are made once."""
        return settled(H.supported_pairs(self.pairs, self.least))

    def open(self):
        return H.open_triangles(self.stable, H.closed_triads(self.edges, self.stable))

    def npmi(self):
        n = self.edges.agg(F.count("*").alias("n")).first().n
        return H.pair_npmi(self.pairs, H.term_counts(self.inc), F.lit(float(n)))


@query("g01_hyperedges", with_(sql_incidence()) + "SELECT paper_id, min(first_date) AS first_date, array_to_string(list_sort(list(term_id)), ',') AS terms FROM inc GROUP BY ALL")
def g01(spark, sf):
    return H.hyperedges(incidence(spark, sf)).withColumn("terms", F.array_join("terms", ","))


@query("g02_summary", with_(sql_incidence(), "s AS (SELECT paper_id, count(*) AS n FROM inc GROUP BY ALL)") + "SELECT count(*) AS papers, count(*) FILTER (n >= 2) AS papers_2, count(*) FILTER (n >= 3) AS papers_3, avg(n) AS mean_size, CAST(sum(n) AS BIGINT) AS links, (SELECT count(DISTINCT term_id) FROM inc) AS nodes FROM s")
def g02(spark, sf):
    return H.summary(H.hyperedges(incidence(spark, sf)))


@query("g03_pair_counts", with_(*BASE) + "SELECT * FROM pc")
def g03(spark, sf):
    return Graph(spark, sf).pairs


@query("g04_closed_triads", with_(sql_incidence(), sql_triples()) + "SELECT a, b, c FROM tc")
def g04(spark, sf):
    return Graph(spark, sf).closed


@query("g05_degree_distribution", with_(sql_incidence(), "s AS (SELECT paper_id, count(*) AS degree FROM inc GROUP BY ALL)") + "SELECT CAST(degree AS INTEGER) AS degree, count(*) AS papers FROM s GROUP BY ALL")
def g05(spark, sf):
    return H.degree_distribution(H.hyperedges(incidence(spark, sf)))


@query("g06_stable_pairs", with_(*BASE, sql_pi()) + "SELECT a, b, cnt, CAST(ceil(-ln(1 - 0.95::DOUBLE) / (x.pi * y.pi)) AS BIGINT) AS k FROM pc JOIN pi x ON x.term_id = a JOIN pi y ON y.term_id = b WHERE cnt >= ceil(-ln(1 - 0.95::DOUBLE) / (x.pi * y.pi))")
def g06(spark, sf):
    g = Graph(spark, sf)
    return H.stable_pairs(g.pairs, precisions(g.inc))


@query("g07_term_precision", with_(sql_incidence()) + "SELECT term_id, min(CASE s WHEN 0 THEN 0.745::DOUBLE WHEN 1 THEN 0.863::DOUBLE ELSE 0.826::DOUBLE END) AS pi FROM (SELECT DISTINCT term_id, (CAST(substr(term_id, 3) AS BIGINT) + k) % 3 AS s FROM inc, (VALUES (0), (1)) v(k)) GROUP BY ALL")
def g07(spark, sf):
    terms = incidence(spark, sf).select("term_id").distinct()
    surfaces = terms.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("term_id", ((F.substring("term_id", 3, 20).cast("long") + F.col("k")) % 3).alias("stratum"))
    strata = spark.createDataFrame([(0, 0.745), (1, 0.863), (2, 0.826)], "stratum long, lower double")
    return H.term_precision(surfaces, strata)


@query("g08_open_triangles", with_(*GRAPH) + "SELECT a, b, c, weakest_pair_count FROM ot")
def g08(spark, sf):
    return Graph(spark, sf).open()


@query("g08_open_triangles_by_precision", with_(*BASE, sql_pi(), "st AS (SELECT a, b, cnt FROM pc JOIN pi x ON x.term_id = a JOIN pi y ON y.term_id = b WHERE cnt >= ceil(-ln(1 - 0.95::DOUBLE) / (x.pi * y.pi)))", sql_triples(), sql_open()) + f"SELECT * FROM ot WHERE {NOT_ALL_TASKS}")
def g08p(spark, sf):
    g = Graph(spark, sf)
    stable = H.stable_pairs(g.pairs, precisions(g.inc))
    return H.open_triangles(stable, H.closed_triads(g.edges, stable))


TWO_HOP = (
    *GRAPH, ADJ, DEG, AA, "adjc AS (SELECT a AS src, b AS dst, cnt FROM st UNION ALL SELECT b, a, cnt FROM st)",
    "w AS (SELECT l.dst AS x, l.src AS z, r.dst AS y, least(l.cnt, r.cnt) AS weakest_pair_count FROM adjc l JOIN adjc r ON l.src = r.src AND l.dst < r.dst WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.a = l.dst AND st.b = r.dst))",
    "t0 AS (SELECT list_sort([x, z, y]) AS t, aa.aa AS missing_pair_aa, weakest_pair_count FROM w JOIN aa ON aa.a = x AND aa.b = y)",
    f"th AS (SELECT * FROM (SELECT t[1] AS a, t[2] AS b, t[3] AS c, missing_pair_aa, weakest_pair_count FROM t0) u WHERE {NOT_ALL_TASKS} AND NOT EXISTS (SELECT 1 FROM tc WHERE tc.a = u.a AND tc.b = u.b AND tc.c = u.c))",
)


@query("g09_two_hop", with_(*TWO_HOP) + "SELECT a, b, c, round(missing_pair_aa, 6) AS missing_pair_aa, weakest_pair_count FROM th")
def g09(spark, sf):
    g = Graph(spark, sf)
    return H.two_hop(g.stable, g.pairs, g.closed).withColumn("missing_pair_aa", F.round("missing_pair_aa", 6))


@query("g10_candidate_types", with_(*TWO_HOP, "al AS (SELECT 'open_triangle' AS kind, a, b, c FROM ot UNION ALL SELECT 'two_hop', a, b, c FROM th)") + "SELECT kind, array_to_string(list_sort([a[1], b[1], c[1]]), '') AS mix, count(*) AS n FROM al GROUP BY ALL")
def g10(spark, sf):
    g = Graph(spark, sf)
    kinds = [g.open().select(*H.TRIAD, F.lit("open_triangle").alias("kind")), H.two_hop(g.stable, g.pairs, g.closed).select(*H.TRIAD, F.lit("two_hop").alias("kind"))]
    return H.candidate_statistics(kinds[0].unionAll(kinds[1]))


def _scale_sql(k: int) -> str:
    return (
        f"SELECT {k} AS support, (SELECT count(*) FROM (SELECT a FROM pc WHERE cnt >= {k} UNION SELECT b FROM pc WHERE cnt >= {k})) AS nodes, "
        f"(SELECT count(*) FROM pc WHERE cnt >= {k}) AS edges, "
        f"CAST((SELECT coalesce(sum(d * (d - 1) / 2), 0) FROM (SELECT v, count(*) AS d FROM (SELECT a AS v FROM pc WHERE cnt >= {k} UNION ALL SELECT b FROM pc WHERE cnt >= {k}) GROUP BY ALL)) AS BIGINT) AS wedges, "
        "count(*) AS triangles, count(*) FILTER (c2 IS NULL) AS open_triangles, count(*) FILTER (c2 IS NULL AND (a LIKE 'T:%' OR b LIKE 'T:%' OR c LIKE 'T:%')) AS open_with_task "
        f"FROM (SELECT e.a, e.b, f.b AS c, t.c AS c2 FROM pc e JOIN pc f ON f.a = e.b AND f.cnt >= {k} JOIN pc g ON g.a = e.a AND g.b = f.b AND g.cnt >= {k} LEFT JOIN tc t ON t.a = e.a AND t.b = e.b AND t.c = f.b WHERE e.cnt >= {k})"
    )


@query("g11_scale_study", with_(*BASE, sql_triples()) + " UNION ALL ".join(map(_scale_sql, (8, 10, 12))))
def g11(spark, sf):
    g = Graph(spark, sf)
    return H.scale_study(g.pairs, g.closed, [8, 10, 12])


def _counted_sql(name: str, edges: str, limit: int) -> str:
    shown = lambda c: f"CASE WHEN t <= {limit} THEN {c} END"
    return (
        f"SELECT '{name}' AS rule, (SELECT count(*) FROM pc) AS pairs, (SELECT count(*) FROM (SELECT a FROM {edges} UNION SELECT b FROM {edges})) AS nodes, (SELECT count(*) FROM {edges}) AS edges, "
        f"CAST((SELECT coalesce(sum(d * (d - 1) / 2), 0) FROM (SELECT v, count(*) AS d FROM (SELECT a AS v FROM {edges} UNION ALL SELECT b FROM {edges}) GROUP BY ALL)) AS BIGINT) AS wedges, "
        f"{shown('t')} AS triangles, {shown('o')} AS open_triangles, {shown('w')} AS open_with_task, t <= {limit} AS counted "
        "FROM (SELECT count(*) AS t, count(*) FILTER (c2 IS NULL) AS o, count(*) FILTER (c2 IS NULL AND (a LIKE 'T:%' OR b LIKE 'T:%' OR c LIKE 'T:%')) AS w "
        f"FROM (SELECT e.a, e.b, f.b AS c, t.c AS c2 FROM {edges} e JOIN {edges} f ON f.a = e.b JOIN {edges} g ON g.a = e.a AND g.b = f.b LEFT JOIN tc t ON t.a = e.a AND t.b = e.b AND t.c = f.b))"
    )


@query("g11_counted_scale", with_(*BASE, STABLE, sql_triples(), "p8 AS (SELECT a, b FROM pc WHERE cnt >= 8)", "p1 AS (SELECT a, b FROM pc)") + " UNION ALL ".join((_counted_sql("stability", "st", 100_000), _counted_sql("support 8", "p8", 100_000), _counted_sql("support 1", "p1", 100_000))))
def g11c(spark, sf):
    """Sizes by support and by the stability rule; beyond 100,000 triangles they are not counted."""
    g = Graph(spark, sf)
    pairs = settled(g.pairs)
    rules = {"stability": H.supported_pairs(pairs, g.support).select("a", "b"), "support 8": H.supported_pairs(pairs, 8), "support 1": H.supported_pairs(pairs, 1)}
    return H.counted_scale_study(pairs, g.closed, rules, 100_000)


@query("g12_adamic_adar", with_(*BASE, STABLE, ADJ, DEG, AA) + "SELECT a, b, round(aa, 6) AS aa, common FROM aa")
def g12(spark, sf):
    return H.adamic_adar(Graph(spark, sf).stable).withColumn("aa", F.round("aa", 6))


@query("g13_common_neighbours", with_(*GRAPH, ADJ) + "SELECT o.a, o.b, o.c, count(x.dst) AS common FROM ot o LEFT JOIN (SELECT p.src AS a, q.src AS b, r.src AS c, p.dst FROM adj p JOIN adj q ON p.dst = q.dst JOIN adj r ON p.dst = r.dst WHERE p.src < q.src AND q.src < r.src) x ON x.a = o.a AND x.b = o.b AND x.c = o.c GROUP BY ALL")
def g13(spark, sf):
    g = Graph(spark, sf)
    adj = H.adjacency(g.stable)
    found = g.open().select(*H.TRIAD)
    one, two, three = (adj.select(F.col("src").alias(t), F.col("dst").alias("z")) for t in H.TRIAD)
    n = found.join(one, "a").join(two, ["b", "z"]).join(three, ["c", "z"]).groupBy(*H.TRIAD).agg(F.count("*").alias("common"))
    return found.join(n, H.TRIAD, "left").fillna(0, ["common"])


@query("g14_npmi", with_(*BASE, DOCS, NPMI) + "SELECT a, b, cnt, round(npmi, 6) AS npmi FROM np")
def g14(spark, sf):
    return Graph(spark, sf).npmi().select("a", "b", "cnt", F.round("npmi", 6).alias("npmi"))


SEEDS = "seeds AS (SELECT a, b FROM st WHERE cnt >= 14)"
COMPLETE = (
    *GRAPH, DOCS, SEEDS, "sym AS (SELECT a AS p, b AS w, cnt FROM pc UNION ALL SELECT b, a, cnt FROM pc)",
    "sp AS (SELECT s.a AS u, s.b AS v, d.term_id AS w FROM seeds s, docs d WHERE d.term_id <> s.a AND d.term_id <> s.b)",
    "rt AS (SELECT list_sort([sp.u, sp.v, sp.w]) AS t, least(coalesce(m.cnt, 0), coalesce(n.cnt, 0)) AS score FROM sp LEFT JOIN sym m ON m.p = sp.u AND m.w = sp.w LEFT JOIN sym n ON n.p = sp.v AND n.w = sp.w)",
    "r1 AS (SELECT t[1] AS a, t[2] AS b, t[3] AS c, max(score) AS score FROM rt GROUP BY ALL)",
    f"cp AS (SELECT * FROM r1 WHERE {NOT_ALL_TASKS} AND NOT EXISTS (SELECT 1 FROM tc WHERE tc.a = r1.a AND tc.b = r1.b AND tc.c = r1.c))",
)


def _completions(g):
    seeds = g.stable.where(F.col("cnt") >= g.seeds)
    return H.completions(seeds, H.term_counts(g.inc), g.pairs.select("a", "b", F.col("cnt").cast("double").alias("value")), g.closed, "min")


@query("g15_completions", with_(*COMPLETE) + "SELECT a, b, c, CAST(score AS DOUBLE) AS score FROM cp")
def g15(spark, sf):
    return _completions(Graph(spark, sf))


TOP = "top AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b, c) AS gen_rank FROM cp QUALIFY gen_rank <= 500)"


@query("g16_top_completions", with_(*COMPLETE, TOP) + "SELECT t.a, t.b, t.c, CASE WHEN x.cnt IS NOT NULL AND y.cnt IS NOT NULL AND z.cnt IS NOT NULL THEN 'open_triangle' ELSE 'completion' END AS kind, CAST(score AS DOUBLE) AS gen_score, CAST(gen_rank AS INTEGER) AS gen_rank FROM top t LEFT JOIN st x ON x.a = t.a AND x.b = t.b LEFT JOIN st y ON y.a = t.a AND y.b = t.c LEFT JOIN st z ON z.a = t.b AND z.b = t.c")
def g16(spark, sf):
    g = Graph(spark, sf)
    return H.top_completions(_completions(g), g.stable, 500)


@query("g17_coverage", with_(*GRAPH) + "SELECT o.a, o.b, o.c, CAST((p.cnt >= 12)::INT + (q.cnt >= 12)::INT + (r.cnt >= 12)::INT AS BIGINT) AS n_pairs FROM ot o JOIN pc p ON p.a = o.a AND p.b = o.b JOIN pc q ON q.a = o.a AND q.b = o.c JOIN pc r ON r.a = o.b AND r.b = o.c")
def g17(spark, sf):
    g = Graph(spark, sf)
    return H.coverage(g.open(), g.pairs.where("cnt >= 12"))


LABELS = (sql_incidence("linc", window="label"), sql_triples("ltc", "linc"))


@query("g18_recall_of_new_triads", with_(*COMPLETE, *LABELS, f"nw AS (SELECT a, b, c FROM ltc WHERE {NOT_ALL_TASKS} AND NOT EXISTS (SELECT 1 FROM tc WHERE tc.a = ltc.a AND tc.b = ltc.b AND tc.c = ltc.c))", "tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b, c) AS gen_rank FROM cp QUALIFY gen_rank <= 1000)", "hit AS (SELECT gen_rank FROM tp JOIN nw USING (a, b, c))") + "SELECT CAST(b AS INTEGER) AS budget, h AS hits, h / (SELECT count(*) FROM nw) AS recall, h / least(b, n) AS precision, b > n AS capped FROM (SELECT b, (SELECT count(*) FROM hit WHERE gen_rank <= b) AS h, (SELECT count(*) FROM tp) AS n FROM (VALUES (10), (100), (1000)) v(b))")
def g18n(spark, sf):
    """All of survey item G18: the total is counted, all new triads of the label window, and the list reaches the largest budget."""
    g, budgets = Graph(spark, sf), [10, 100, 1000]
    new = Graph(spark, sf, window="label").closed.join(g.closed, H.TRIAD, "left_anti").where(~H.all_tasks())
    ranked = H.top_completions(_completions(g), g.stable, max(budgets))
    return H.recall_at(ranked, new, new.count() or float("nan"), budgets)


@query("g20_context_overlap")
def g20(spark, sf):
    g = Graph(spark, sf)
    return H.context_overlap(g.open(), g.edges).select(*H.TRIAD, F.round("s_max", 6).alias("s_max"), F.round("s_mean", 6).alias("s_mean"))


@query("g21_merge_groups", "WITH RECURSIVE " + ", ".join((sql_incidence(), sql_pairs(), "l AS (SELECT a, b FROM pc WHERE cnt >= 15 UNION SELECT b, a FROM pc WHERE cnt >= 15)", "r AS (SELECT a AS term, a AS seen FROM l UNION SELECT r.term, l.b FROM r JOIN l ON l.a = r.seen)")) + " SELECT term, min(seen) AS head FROM r GROUP BY term")
def g21(spark, sf):
    return H.connected_groups(Graph(spark, sf).pairs.where("cnt >= 15"))


@query("g23_neighbourhood", with_(sql_incidence(), "e AS (SELECT paper_id, list(term_id) AS terms FROM inc GROUP BY ALL)", "p AS (SELECT * FROM (VALUES ('M:10', 'M:2'), ('M:10', 'T:1'), ('M:2', 'T:1')) v(x, y))") + "SELECT x, y, paper_id, CAST(len(list_filter(terms, lambda t: t NOT IN ('M:10', 'M:2', 'T:1'))) AS INTEGER) AS n_other FROM p JOIN e ON list_contains(terms, x) AND list_contains(terms, y) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY (n_other = 0)::INT, paper_id) <= 3")
def g23(spark, sf):
    return H.neighbourhood(H.hyperedges(incidence(spark, sf)), ("M:10", "M:2", "T:1"))


@query("g24_hypergraph_equality", "SELECT true AS same, false AS other")
def g24(spark, sf):
    one, two = H.hyperedges(incidence(spark, sf)), H.hyperedges(incidence(spark, sf).repartition(3))
    cut = one.limit(5)
    return spark.createDataFrame([(H.same_hypergraph(one, two), H.same_hypergraph(one, cut))], "same boolean, other boolean")


@query("g25_greedy_cover")
def g25(spark, sf):
    rows = H.greedy_cover(settled(Graph(spark, sf).open()), 5)
    return spark.createDataFrame(rows, "term string, covered long")


@query("g27_network", with_(*BASE, DOCS, NPMI, "k AS (SELECT * FROM np WHERE cnt >= 8 AND npmi >= 0.0)") + "SELECT term_id, CAST(sum(cnt) AS BIGINT) AS strength, count(*) AS degree FROM (SELECT a AS term_id, cnt FROM k UNION ALL SELECT b, cnt FROM k) GROUP BY ALL")
def g27(spark, sf):
    return H.network(Graph(spark, sf).npmi(), 8, 0.0)


@query("f10_drop_excluded_pairs", with_(*GRAPH, "x AS (SELECT a, b FROM st WHERE cnt >= 13)") + "SELECT a, b, c, weakest_pair_count FROM ot o WHERE NOT EXISTS (SELECT 1 FROM x WHERE (x.a = o.a AND x.b = o.b) OR (x.a = o.a AND x.b = o.c) OR (x.a = o.b AND x.b = o.c))")
def f10(spark, sf):
    g = Graph(spark, sf)
    return H.drop_excluded(g.open(), g.stable.where("cnt >= 13").select(F.col("b").alias("a"), F.col("a").alias("b")))


@query("j08_joint_papers", with_(*GRAPH, *LABELS) + "SELECT a, b, c, coalesce(ltc.cnt, 0) AS n_papers FROM ot LEFT JOIN ltc USING (a, b, c)")
def j08(spark, sf):
    return H.joint_papers(Graph(spark, sf).open(), incidence(spark, sf, window="label").select("paper_id", "term_id"))


@query("m01_pair_features", with_(*GRAPH, DOCS, NPMI, ADJ, DEG, AA, "sides AS (SELECT a, b, c, a AS x, b AS y FROM ot UNION ALL SELECT a, b, c, a, c FROM ot UNION ALL SELECT a, b, c, b, c FROM ot)") + "SELECT s.a, s.b, s.c, min(n.cnt) AS count_min, round(avg(n.cnt), 6) AS count_mean, max(n.cnt) AS count_max, round(exp(avg(ln(1 + n.cnt))) - 1, 6) AS count_gmean, round(min(npmi), 6) AS npmi_min, round(avg(npmi), 6) AS npmi_mean, round(min(coalesce(aa.aa, 0)), 6) AS aa_min, round(avg(coalesce(aa.aa, 0)), 6) AS aa_mean FROM sides s JOIN np n ON n.a = x AND n.b = y LEFT JOIN aa ON aa.a = x AND aa.b = y GROUP BY ALL")
def m01(spark, sf):
    g = Graph(spark, sf)
    pairs = g.npmi().select(F.col("a").alias("x"), F.col("b").alias("y"), "cnt", "npmi")
    aa = H.adamic_adar(g.stable).select(F.col("a").alias("x"), F.col("b").alias("y"), "aa")
    rows = H.triad_pairs(g.open().select(*H.TRIAD)).join(pairs, ["x", "y"]).join(aa, ["x", "y"], "left").fillna(0.0, ["aa"])
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.groupBy(*H.TRIAD).agg(
        F.min("cnt").alias("count_min"), r(F.avg("cnt"), "count_mean"), F.max("cnt").alias("count_max"), r(F.expm1(F.avg(F.log1p("cnt"))), "count_gmean"),
        r(F.min("npmi"), "npmi_min"), r(F.avg("npmi"), "npmi_mean"), r(F.min("aa"), "aa_min"), r(F.avg("aa"), "aa_mean"),
    )


@query("m02_related_hyperedges", with_(*GRAPH, "sz AS (SELECT paper_id, count(*) AS size FROM inc GROUP BY ALL)", "rel AS (SELECT o.a, o.b, o.c, i.paper_id FROM ot o JOIN inc i ON i.term_id IN (o.a, o.b, o.c) GROUP BY ALL HAVING count(*) >= 2)") + "SELECT a, b, c, count(*) AS n_related, round(sum(CASE WHEN size > 1 THEN 1 / ln(size) ELSE 0 END), 6) AS related_weight, round(avg(size), 6) AS mean_size FROM rel JOIN sz USING (paper_id) GROUP BY ALL")
def m02(spark, sf):
    g = Graph(spark, sf)
    out = H.related_hyperedges(g.open(), g.edges)
    return out.withColumns({c: F.round(c, 6) for c in ("related_weight", "mean_size")})


@query("m03_growth", with_(sql_incidence(), "r AS (SELECT term_id, count(*) AS total, count(*) FILTER (first_date >= TIMESTAMP '1996-01-01') AS recent FROM inc GROUP BY ALL)") + "SELECT term_id, round((recent / 2.0::DOUBLE + 1) / ((total - recent) / 3.0::DOUBLE + 1), 6) AS growth FROM r")
def m03(spark, sf):
    r = incidence(spark, sf).groupBy("term_id").agg(F.count("*").alias("total"), F.count_if(F.col("first_date") >= F.lit("1996-01-01").cast("timestamp")).alias("recent"))
    return r.select("term_id", F.round(growth(F.col("recent"), F.col("total")), 6).alias("growth"))


@query("m07_gmean_of_three", with_(*GRAPH) + "SELECT o.a, o.b, o.c, round(exp((ln(1 + p.cnt) + ln(1 + q.cnt) + ln(1 + r.cnt)) / 3) - 1, 6) AS g FROM ot o JOIN pc p ON p.a = o.a AND p.b = o.b JOIN pc q ON q.a = o.a AND q.b = o.c JOIN pc r ON r.a = o.b AND r.b = o.c")
def m07(spark, sf):
    g = Graph(spark, sf)
    out = g.open().select(*H.TRIAD)
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        out = out.join(g.pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("cnt").alias(x + y)), [x, y])
    return out.select(*H.TRIAD, F.round(gmean(F.col("ab"), F.col("ac"), F.col("bc")), 6).alias("g"))


@query("m05_vector_geometry", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), t AS (SELECT x.vec_id AS i, list_cosine_similarity(x.e, y.e) AS xy, list_cosine_similarity(x.e, z.e) AS xz, list_cosine_similarity(y.e, z.e) AS yz FROM v x JOIN v y ON y.vec_id = x.vec_id + 1 JOIN v z ON z.vec_id = x.vec_id + 2) SELECT i, round(least(xy, xz, yz), 6) AS cos_min, round((xy + xz + yz) / 3, 6) AS cos_mean, round(1 + 2 * xy * xz * yz - xy * xy - xz * xz - yz * yz, 6) AS gram FROM t")
def m05(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    x, y, z = (v.select((F.col("vec_id") - k).alias("i"), F.col("e").alias(n)) for k, n in enumerate("xyz"))
    t = x.join(y, "i").join(z, "i")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, r: s * r), F.lit(0.0), lambda s, r: s + r)
    cos = lambda p, q: dot(p, q) / F.sqrt(dot(p, p) * dot(q, q))
    t = t.select("i", cos("x", "y").alias("xy"), cos("x", "z").alias("xz"), cos("y", "z").alias("yz"))
    gram = 1 + 2 * F.col("xy") * F.col("xz") * F.col("yz") - F.col("xy") ** 2 - F.col("xz") ** 2 - F.col("yz") ** 2
    return t.select("i", F.round(F.least("xy", "xz", "yz"), 6).alias("cos_min"), F.round((F.col("xy") + F.col("xz") + F.col("yz")) / 3, 6).alias("cos_mean"), F.round(gram, 6).alias("gram"))


@query("w01_ranking", with_(*GRAPH) + "SELECT a, b, c, weakest_pair_count, CAST(row_number() OVER (ORDER BY weakest_pair_count DESC, a, b, c) AS INTEGER) AS rank FROM ot")
def w01(spark, sf):
    rows = numbered(Graph(spark, sf).open(), [-F.col("weakest_pair_count"), *map(F.col, H.TRIAD)], "rank")
    return rows.withColumn("rank", F.col("rank").cast("int"))
