"""Item-record hypergraphs: projections, motifs and pair measures as DataFrame plans.

An incidence table has one row per (paper_id, term_id); a hyperedge table one row per paper with the
sorted array ``terms``. Pairs are kept in canonical order a < b, triads a < b < c. Term ids start
with ``M:`` (method) or ``T:`` (task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import npmi, pair_threshold
from .ranks import numbered, settled

TRIAD = ["a", "b", "c"]
BLOCK = 1024
FIRST_WEDGES, SMALL_GRAPH = 20_000_000, 200_000


def hyperedges(incidence: DataFrame) -> DataFrame:
    """paper_id, first_date (if there), terms (sorted, distinct); papers without a term are absent."""
    extra = [F.min("first_date").alias("first_date")] if "first_date" in incidence.columns else []
    return incidence.groupBy("paper_id").agg(*extra, F.array_sort(F.collect_set("term_id")).alias("terms"))


def incidence_of(edges: DataFrame) -> DataFrame:
    return edges.select("paper_id", F.explode("terms").alias("term_id"))


def summary(edges: DataFrame) -> DataFrame:
    """Papers, papers with at least 2 and 3 terms, mean size, links, matched nodes: one row."""
    size = F.size("terms")
    nodes = edges.select(F.explode("terms").alias("t")).agg(F.count_distinct("t").alias("nodes"))
    return edges.agg(
        F.count("*").alias("papers"),
        F.count_if(size >= 2).alias("papers_2"),
        F.count_if(size >= 3).alias("papers_3"),
        F.avg(size).alias("mean_size"),
        F.sum(size).cast("long").alias("links"),
    ).join(nodes)


def pairs_of(edges: DataFrame) -> DataFrame:
    """paper_id, a, b for every pair of a paper: per-row arrays, no shuffle."""
    first = edges.select("paper_id", "terms", F.posexplode("terms").alias("i", "a"))
    return first.select("paper_id", "a", F.explode(F.slice("terms", F.col("i") + 2, F.size("terms"))).alias("b"))


def triples_of(edges: DataFrame) -> DataFrame:
    first = edges.where(F.size("terms") >= 3).select("paper_id", "terms", F.posexplode("terms").alias("i", "a"))
    rest = first.select("paper_id", "a", F.slice("terms", F.col("i") + 2, F.size("terms")).alias("rest"))
    second = rest.select("paper_id", "a", "rest", F.posexplode("rest").alias("j", "b"))
    return second.select("paper_id", "a", "b", F.explode(F.slice("rest", F.col("j") + 2, F.size("rest"))).alias("c"))


def pair_counts(edges: DataFrame) -> DataFrame:
    return pairs_of(edges).groupBy("a", "b").agg(F.count("*").alias("cnt"))


def triple_counts(edges: DataFrame) -> DataFrame:
    return triples_of(edges).groupBy("a", "b", "c").agg(F.count("*").alias("cnt"))


def closed_triads(edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Triads some paper holds. With ``within`` (pairs a, b) only those whose pairs (a, b) and (a, c) are among
    these: all that a triangle of these pairs can meet, without the triples of long papers."""
    if within is None:
        return triples_of(edges).select("a", "b", "c").distinct()
    met = pairs_of(edges).join(within.select("a", "b"), ["a", "b"], "left_semi")
    other = met.select("paper_id", "a", F.col("b").alias("c"))
    return met.join(other, ["paper_id", "a"]).where("b < c").select("a", "b", "c").distinct()


def term_counts(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("term_id").agg(F.count_distinct("paper_id").alias("docs"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.size("terms").alias("degree")).agg(F.count("*").alias("papers"))


def term_precision(surfaces: DataFrame, strata: DataFrame) -> DataFrame:
    """term_id, pi: the lowest precision among the strata of a term's surfaces."""
    return surfaces.join(strata, "stratum").groupBy("term_id").agg(F.min("lower").alias("pi"))


def stable_pairs(pairs: DataFrame, pi: DataFrame, s: float = 0.95) -> DataFrame:
    """a, b, cnt, k of the pairs that reach their threshold."""
    one, two = (pi.select(F.col("term_id").alias(x), F.col("pi").alias(f"pi_{x}")) for x in "ab")
    rated = pairs.join(one, "a").join(two, "b").withColumn("k", pair_threshold(F.col("pi_a"), F.col("pi_b"), s))
    return rated.where("cnt >= k").select("a", "b", "cnt", "k")


def supported_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.where(F.col("cnt") >= k).select("a", "b", "cnt")


def all_tasks() -> Column:
    return F.col("a").startswith("T:") & F.col("b").startswith("T:") & F.col("c").startswith("T:")


def type_mix() -> Column:
    """Sorted initials of the three terms, e.g. MMT."""
    return F.array_join(F.array_sort(F.transform(F.array(*TRIAD), lambda t: t.substr(1, 1))), "")


def triangles(stable: DataFrame) -> DataFrame:
    """Triads whose three pairs are all edges, with the smallest of their counts.

    Edges point from the end of lower degree to the other, so that a hub opens few pairs of neighbours.
    """
    edges = stable.select("a", "b", "cnt")
    degree = degrees(edges)
    one, two = (degree.select(F.col("term_id").alias(x), F.col("degree").alias(f"d_{x}")) for x in "ab")
    low = F.least(F.struct("d_a", F.col("a").alias("t")), F.struct(F.col("d_b").alias("d_a"), F.col("b").alias("t")))["t"]
    out = edges.join(one, "a").join(two, "b").select(low.alias("u"), F.when(low == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v"), "cnt")
    pairs = out.join(out.select("u", F.col("v").alias("w"), F.col("cnt").alias("cnt2")), "u").where("v < w")
    closing = edges.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("cnt").alias("cnt3"))
    found = pairs.join(closing, ["v", "w"])
    return found.select(*canonical_triad(F.col("u"), F.col("v"), F.col("w")), F.least("cnt", "cnt2", "cnt3").alias("weakest_pair_count"))


def open_triangles(stable: DataFrame, closed: DataFrame, keep_all_tasks: bool = False) -> DataFrame:
    """Triangles of stable pairs that no paper closes."""
    found = triangles(stable).join(closed, TRIAD, "left_anti")
    return found if keep_all_tasks else found.where(~all_tasks())


def adjacency(stable: DataFrame) -> DataFrame:
    """Both directions of every edge: src, dst."""
    return stable.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(stable.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(stable: DataFrame) -> DataFrame:
    return adjacency(stable).groupBy(F.col("src").alias("term_id")).agg(F.count("*").alias("degree"))


def wedges(stable: DataFrame) -> DataFrame:
    """a, z, c: pairs a < c of neighbours of z. The degree of z is squared here by definition."""
    adj = adjacency(stable)
    left, right = adj.select(F.col("src").alias("z"), F.col("dst").alias("a")), adj.select(F.col("src").alias("z"), F.col("dst").alias("c"))
    return left.join(right, "z").where("a < c")


def adamic_adar(stable: DataFrame) -> DataFrame:
    """a, b, aa, common: sum of 1 / ln(degree) over common neighbours of degree over one."""
    weight = degrees(stable).where("degree > 1").select(F.col("term_id").alias("z"), (1 / F.log("degree")).alias("w"))
    return wedges(stable).join(weight, "z").groupBy("a", F.col("c").alias("b")).agg(F.sum("w").alias("aa"), F.count("*").alias("common"))


def canonical_triad(x: Column, y: Column, z: Column) -> list[Column]:
    ordered = F.array_sort(F.array(x, y, z))
    return [F.get(ordered, i).alias(n) for i, n in enumerate(TRIAD)]


def two_hop(stable: DataFrame, pairs: DataFrame, closed: DataFrame, limit: int | None = None) -> DataFrame:
    """Triads with exactly two stable pairs that meet in a centre, not closed and not all tasks.

    ``missing_pair_aa`` is the Adamic-Adar score of the unstable pair, ``weakest_pair_count`` the
    smaller count of the two stable ones. With ``limit`` the best by (score, count, ids).
    """
    counted = stable.select("a", "b", "cnt")
    both = counted.unionAll(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "cnt"))
    left = both.select(F.col("a").alias("z"), F.col("b").alias("x"), F.col("cnt").alias("n1"))
    right = both.select(F.col("a").alias("z"), F.col("b").alias("y"), F.col("cnt").alias("n2"))
    open_pairs = left.join(right, "z").where("x < y").join(stable.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    scored = open_pairs.join(adamic_adar(stable).select(F.col("a").alias("x"), F.col("b").alias("y"), "aa"), ["x", "y"])
    triads = scored.select(*canonical_triad(F.col("x"), F.col("z"), F.col("y")), F.col("aa").alias("missing_pair_aa"), F.least("n1", "n2").alias("weakest_pair_count"))
    triads = triads.where(~all_tasks()).join(closed, TRIAD, "left_anti")
    if limit is None:
        return triads
    return triads.orderBy(F.desc("missing_pair_aa"), F.desc("weakest_pair_count"), *TRIAD).limit(limit)


def candidate_statistics(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("kind", type_mix().alias("mix")).agg(F.count("*").alias("n"))


def scale_study(pairs: DataFrame, closed: DataFrame, supports: list[int]) -> DataFrame:
    """Per support: nodes, edges, wedges, triangles, open triangles, open ones with a task."""
    out = None
    for k in supports:
        stable = supported_pairs(pairs, k)
        deg = degrees(stable).agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0)).cast("long").alias("wedges"))
        tri = triangles(stable)
        marked = tri.join(closed.withColumn("closed", F.lit(True)), TRIAD, "left")
        is_open = F.col("closed").isNull()
        with_task = F.col("a").startswith("T:") | F.col("b").startswith("T:") | F.col("c").startswith("T:")
        counts = marked.agg(F.count("*").alias("triangles"), F.count_if(is_open).alias("open_triangles"), F.count_if(is_open & with_task).alias("open_with_task"))
        row = deg.join(stable.agg(F.count("*").alias("edges"))).join(counts).select(F.lit(k).alias("support"), "nodes", "edges", "wedges", "triangles", "open_triangles", "open_with_task")
        out = row if out is None else out.unionAll(row)
    return out


def triangle_counts(stable: DataFrame, closed: DataFrame, limit: int | None = None) -> DataFrame:
    """One row (triangles, open_triangles, open_with_task, counted) without a row per triangle.

    Edges point to the end of higher degree, and each node has the sorted array of those it points to: the triangles over an edge are
    the common part of two arrays, of which only sizes are kept. ``closed`` triads that are triangles are taken off. Where the
    triangles exceed ``limit``, all counts are null and ``counted`` is false; ``more_triangles`` decides that before any array is made.
    """
    edges = settled(stable.select("a", "b"))
    degree = degrees(edges)
    one, two = (degree.select(F.col("term_id").alias(x), F.col("degree").alias(f"d_{x}")) for x in "ab")
    low = F.least(F.struct("d_a", F.col("a").alias("t")), F.struct(F.col("d_b").alias("d_a"), F.col("b").alias("t")))["t"]
    out = settled(edges.join(one, "a").join(two, "b").select(low.alias("u"), F.when(low == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v")))
    names = ["triangles", "open_triangles", "open_with_task"]
    if limit is not None and more_triangles(edges, out, limit):
        return edges.sparkSession.range(1).select(*(F.lit(None).cast("long").alias(n) for n in names), F.lit(False).alias("counted"))
    # an oriented node points to at most the root of twice the number of edges
    near = out.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.array_sort(F.collect_list(F.when(F.col("v").startswith("T:"), F.col("v")))).alias("ts"))
    met = out.join(near, "u").join(near.select(F.col("u").alias("v"), F.col("vs").alias("ws"), F.col("ts").alias("us")), "v")
    common = F.size(F.array_intersect("vs", "ws"))
    sums = met.agg(F.coalesce(F.sum(common), F.lit(0)).alias("triangles"), F.coalesce(F.sum(F.when(~F.col("u").startswith("T:") & ~F.col("v").startswith("T:"), common - F.size(F.array_intersect("ts", "us"))).otherwise(0)), F.lit(0)).alias("none_task"))
    # a closed triad is a triangle if its three pairs are edges; each is met by semi joins, not listed with others
    inside = closed
    small = F.broadcast if edges.count() <= SMALL_GRAPH else lambda e: e
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        inside = inside.join(small(edges.select(F.col("a").alias(x), F.col("b").alias(y))), [x, y], "left_semi")
    with_task = F.col("a").startswith("T:") | F.col("b").startswith("T:") | F.col("c").startswith("T:")
    shut = inside.agg(F.count("*").alias("closed"), F.count_if(with_task).alias("closed_task"))
    numbers = (F.col("triangles"), F.col("triangles") - F.col("closed"), F.col("triangles") - F.col("none_task") - F.col("closed_task"))
    return sums.join(shut).select(*(c.cast("long").alias(n) for n, c in zip(names, numbers)), F.lit(True).alias("counted"))


def more_triangles(edges: DataFrame, out: DataFrame, limit: int, first_wedges: int = FIRST_WEDGES) -> bool:
    """Whether the graph has more than ``limit`` triangles, exactly.

    ``out``: every edge from its end of lower degree, u, to the other, v. The nodes u are taken in shares by hash, the first of about
    ``first_wedges`` wedges and each of the others as large as all before it, until the triangles found exceed the limit or no node is left.
    """
    wedges = out.groupBy("u").agg(F.count("*").alias("d")).agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("n")).first().n
    if wedges <= limit:
        return False
    shares = max(1, -int(-wedges // first_wedges))
    place = F.pmod(F.xxhash64(F.lit(shares), "u"), F.lit(shares))
    closing = edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
    found, done, upto = 0, 0, 1
    while done < shares:
        part = out.where((place >= done) & (place < upto))
        pairs = part.join(part.select("u", F.col("v").alias("w")), "u").where("v < w").select("v", "w")
        found += pairs.join(closing, ["v", "w"]).count()
        if found > limit:
            return True
        done, upto = upto, min(shares, 2 * upto)
    return False


def counted_scale_study(pairs: DataFrame, closed: DataFrame, rules: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Per rule (name -> its stable pairs): nodes, edges, wedges and ``triangle_counts``. ``pairs`` are all pairs, which rules choose from."""
    out = None
    for name, stable in rules.items():
        deg = degrees(stable).agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0)).cast("long").alias("wedges"))
        row = deg.join(stable.agg(F.count("*").alias("edges"))).join(triangle_counts(stable, closed, limit)).join(pairs.agg(F.count("*").alias("pairs")))
        row = row.select(F.lit(name).alias("rule"), "pairs", "nodes", "edges", "wedges", "triangles", "open_triangles", "open_with_task", "counted")
        out = row if out is None else out.unionAll(row)
    return out


def pair_npmi(pairs: DataFrame, terms: DataFrame, n_papers: Column) -> DataFrame:
    one, two = (terms.select(F.col("term_id").alias(x), F.col("docs").alias(f"n_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").withColumn("npmi", npmi(F.col("cnt"), F.col("n_a"), F.col("n_b"), n_papers))


def completions(seeds: DataFrame, terms: DataFrame, scores: DataFrame, closed: DataFrame, combine: str = "mean", default: float = 0.0) -> DataFrame:
    """a, b, c, score: every seed pair (u, v) completed by every other term w.

    The score combines M[u, w] and M[v, w] (``default`` for pairs not in ``scores``: a, b, value) by mean,
    min or sum; a triad keeps the largest over its seeds. Closed and all-task triads are dropped.
    """
    sym = scores.select(F.col("a").alias("p"), F.col("b").alias("w"), "value").unionAll(scores.select(F.col("b").alias("p"), F.col("a").alias("w"), "value"))
    # seeds meet the vocabulary block by block: an equal join on the block's number
    blocks = -(-terms.count() // BLOCK) or 1
    vocabulary = terms.groupBy(F.pmod(F.xxhash64("term_id"), F.lit(blocks)).cast("int").alias("blk")).agg(F.collect_list("term_id").alias("ws"))
    spread = seeds.select(F.col("a").alias("u"), F.col("b").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    spaces = spread.join(vocabulary, "blk").select("u", "v", F.explode("ws").alias("w")).where("w <> u AND w <> v")
    one = sym.select(F.col("p").alias("u"), "w", F.col("value").alias("m1"))
    two = sym.select(F.col("p").alias("v"), "w", F.col("value").alias("m2"))
    rated = spaces.join(one, ["u", "w"], "left").join(two, ["v", "w"], "left").fillna(default, ["m1", "m2"])
    how = {"mean": (F.col("m1") + F.col("m2")) / 2, "min": F.least("m1", "m2"), "sum": F.col("m1") + F.col("m2")}[combine]
    triads = rated.select(*canonical_triad(F.col("u"), F.col("v"), F.col("w")), how.alias("score"))
    return triads.where(~all_tasks()).groupBy(*TRIAD).agg(F.max("score").alias("score")).join(closed, TRIAD, "left_anti")


def top_completions(found: DataFrame, stable: DataFrame, budget: int) -> DataFrame:
    """The best ``budget`` with gen_rank and kind; ties by ids."""
    best = found.orderBy(F.desc("score"), *TRIAD).limit(budget)
    ranked = numbered(best, [-F.col("score"), *map(F.col, TRIAD)], "gen_rank").withColumn("gen_rank", F.col("gen_rank").cast("int"))
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        edge = stable.select(F.col("a").alias(x), F.col("b").alias(y), F.lit(1).alias(f"s_{x}{y}"))
        ranked = ranked.join(edge, [x, y], "left")
    kind = F.when(F.col("s_ab").isNotNull() & F.col("s_ac").isNotNull() & F.col("s_bc").isNotNull(), "open_triangle").otherwise("completion")
    return ranked.select(*TRIAD, kind.alias("kind"), F.col("score").alias("gen_score"), "gen_rank")


def triad_pairs(triads: DataFrame) -> DataFrame:
    """The three pairs (x, y) of every triad, x < y."""
    sides = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))
    return triads.select("*", F.explode(sides).alias("_p")).select("*", "_p.x", "_p.y").drop("_p")


def coverage(triads: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Per triad the number (0 to 3) of its pairs that qualify."""
    marked = triad_pairs(triads.select(*TRIAD)).join(qualifying.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).alias("q")), ["x", "y"], "left")
    return marked.groupBy(*TRIAD).agg(F.count("q").alias("n_pairs"))


def recall_at(ranked: DataFrame, hits: DataFrame, total: int, budgets: list[int]) -> DataFrame:
    """Per budget: hits, recall (of ``total``, unreachable ones included), precision (NaN for an empty list), whether it exceeds the list."""
    marked = ranked.join(hits.select(*TRIAD, F.lit(1).alias("hit")), TRIAD, "left")
    n = ranked.agg(F.count("*").alias("n"))
    sums = marked.agg(*(F.coalesce(F.sum(F.when(F.col("gen_rank") <= b, F.col("hit"))), F.lit(0)).alias(f"h{b}") for b in budgets))
    flat = sums.join(n).select("n", F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.col(f"h{b}").cast("long").alias("hits")) for b in budgets))).alias("r")).select("n", "r.*")
    return flat.select("budget", "hits", (F.col("hits") / total).alias("recall"), F.when(F.col("n") > 0, F.col("hits") / F.greatest(F.least("budget", "n"), F.lit(1))).otherwise(float("nan")).alias("precision"), (F.col("budget") > F.col("n")).alias("capped"))


def drop_excluded(triads: DataFrame, excluded: DataFrame) -> DataFrame:
    """Triads that hold none of the excluded pairs, in whatever order those are given."""
    pairs = excluded.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    bad = triad_pairs(triads.select(*TRIAD)).join(pairs, ["x", "y"], "left_semi").select(*TRIAD).distinct()
    return triads.join(bad, TRIAD, "left_anti")


def joint_papers(triads: DataFrame, incidence: DataFrame) -> DataFrame:
    """Papers that hold all three terms: a, b, c, n_papers (0 if none)."""
    found = triads.select(*TRIAD)
    for t in TRIAD:
        side = incidence.select("paper_id", F.col("term_id").alias(t))
        found = found.join(side, t) if t == "a" else found.join(side, ["paper_id", t])
    counted = found.groupBy(*TRIAD).agg(F.count("*").alias("n_papers"))
    return triads.select(*TRIAD).join(counted, TRIAD, "left").fillna(0, ["n_papers"])


def related_hyperedges(triads: DataFrame, edges: DataFrame) -> DataFrame:
    """Per triad over papers with at least two of its terms: their number, sum of 1/ln(size) and mean size."""
    # a paper with two of the terms holds one of the pairs: pairs have few papers, terms may have very many
    met = pairs_of(edges).select("paper_id", F.col("a").alias("x"), F.col("b").alias("y"))
    near = triad_pairs(triads.select(*TRIAD)).join(met, ["x", "y"]).select(*TRIAD, "paper_id").distinct()
    sized = near.join(edges.select("paper_id", F.size("terms").alias("size")), "paper_id")
    return sized.groupBy(*TRIAD).agg(
        F.count("*").alias("n_related"), F.sum(F.when(F.col("size") > 1, 1 / F.log("size")).otherwise(0.0)).alias("related_weight"), F.avg("size").alias("mean_size")
    )


def context_overlap(triads: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest and mean cosine, over the three pivots, of the co-term counts of the pivot's two pairs.

    The triad's own terms do not count; a pair that never meets gives 0.
    """
    pivots = F.array(*(F.struct(F.col(p).alias("p"), F.least(p, q).alias("x1"), F.greatest(p, q).alias("y1"), F.least(p, r).alias("x2"), F.greatest(p, r).alias("y2")) for p, q, r in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))))
    rows = triads.select(*TRIAD, F.explode(pivots).alias("v")).select(*TRIAD, "v.*")
    wanted = rows.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionAll(rows.select("x2", "y2")).distinct()
    meets = pairs_of(edges).select("paper_id", F.col("a").alias("x"), F.col("b").alias("y")).join(wanted, ["x", "y"])
    context = meets.join(incidence_of(edges), "paper_id").groupBy("x", "y", "term_id").agg(F.count("*").alias("n"))
    one = rows.join(context.select(F.col("x").alias("x1"), F.col("y").alias("y1"), "term_id", F.col("n").alias("n1")), ["x1", "y1"]).where("term_id NOT IN (a, b, c)")
    two = rows.join(context.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "term_id", F.col("n").alias("n2")), ["x2", "y2"]).where("term_id NOT IN (a, b, c)")
    key = [*TRIAD, "p"]
    dot = one.select(*key, "term_id", "n1").join(two.select(*key, "term_id", "n2"), [*key, "term_id"]).groupBy(*key).agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    norm1 = one.groupBy(*key).agg(F.sqrt(F.sum(F.col("n1") * F.col("n1"))).alias("l1"))
    norm2 = two.groupBy(*key).agg(F.sqrt(F.sum(F.col("n2") * F.col("n2"))).alias("l2"))
    cosine = dot.join(norm1, key).join(norm2, key).select(*key, (F.col("dot") / (F.col("l1") * F.col("l2"))).alias("cos"))
    full = rows.select(*key).join(cosine, key, "left").fillna(0.0, ["cos"])
    return full.groupBy(*TRIAD).agg(F.max("cos").alias("s_max"), F.avg("cos").alias("s_mean"))


def neighbourhood(edges: DataFrame, triad: tuple[str, str, str], examples: int = 3) -> DataFrame:
    """Example papers of each pair of one triad: those with further terms first, then by id."""
    a, b, c = triad
    out = None
    for x, y in ((a, b), (a, c), (b, c)):
        rows = edges.where(F.array_contains("terms", x) & F.array_contains("terms", y))
        others = F.size(F.array_except("terms", F.array(F.lit(a), F.lit(b), F.lit(c))))
        top = rows.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "paper_id", others.alias("n_other")).orderBy((F.col("n_other") == 0), "paper_id").limit(examples)
        out = top if out is None else out.unionAll(top)
    return out


def same_hypergraph(one: DataFrame, two: DataFrame) -> bool:
    cols = ["paper_id", "terms"]
    one, two = one.select(*cols), two.select(*cols)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def network(pairs: DataFrame, min_count: int, min_npmi: float) -> DataFrame:
    """Node strength (sum of counts) in the graph of frequent, associated pairs."""
    kept = pairs.where((F.col("cnt") >= min_count) & (F.col("npmi") >= min_npmi))
    both = kept.select(F.col("a").alias("term_id"), "cnt").unionAll(kept.select(F.col("b").alias("term_id"), "cnt"))
    return both.groupBy("term_id").agg(F.sum("cnt").alias("strength"), F.count("*").alias("degree"))


def connected_groups(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(term, head): components of links (a, b); the head is the smallest id. Lineage is cut by checkpoints."""
    nodes = links.select(F.col("a").alias("n")).union(links.select("b")).distinct()
    both = settled(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(nodes.select("n", F.col("n").alias("head")))
    for _ in range(max_rounds):
        seen = both.join(label.select(F.col("n").alias("b"), "head"), "b").groupBy("a").agg(F.min("head").alias("low"))
        step = label.join(seen, label["n"] == seen["a"], "left").select("n", F.least("head", F.coalesce("low", "head")).alias("head"))
        # follow the head's own head: chains halve
        jump = step.select(F.col("n").alias("head"), F.col("head").alias("up"))
        step = settled(step.join(jump, "head").select("n", "up").withColumnRenamed("up", "head"))
        if step.exceptAll(label).isEmpty():
            return label.select(F.col("n").alias("term"), "head")
        label = step
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def named_groups(links: DataFrame, names: DataFrame) -> DataFrame:
    """(term, head): components of links (a, b); the head is the member with the smallest (name, id) of ``names`` (term, name)."""
    groups = connected_groups(links).join(names, "term")
    best = groups.groupBy("head").agg(F.min_by("term", F.struct("name", "term")).alias("best"))
    return groups.join(best, "head").select("term", F.col("best").alias("head"))


def greedy_cover(triads: DataFrame, limit: int) -> list[tuple[str, int]]:
    """Terms that cover the triads greedily: (term, newly covered); one aggregation per chosen term."""
    left, out = triads.select(*TRIAD), []
    for _ in range(limit):
        best = left.select(F.explode(F.array(*TRIAD)).alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").first()
        if best is None:
            break
        out.append((best.t, best.n))
        left = left.where(~F.array_contains(F.array(*TRIAD), best.t))
    return out
