"""Faults that showed on larger tables: plans that shuffled or broadcast too much, and tables that leave a step no rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import scalar as fn
from lattica.operators import boosting as G
from lattica.operators import hypergraph as H
from lattica.operators import matching as M
from lattica.operators import models as L
from lattica.operators import relational as R
from lattica.operators import statistics as S
from lattica.plans import bindings, extras, graph, models, recovery, statistics, vocabulary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first", [1, 50, 10**6])
def test_more_triangles_than_a_limit(spark, first):
    rng = random.Random(5)
    nodes = [f"M:{i:02}" for i in range(20)]
    pairs = [p for p in itertools.combinations(nodes, 2) if rng.random() < 0.5]
    n = sum({p, q, r} <= set(pairs) for p, q, r in (((a, b), (a, c), (b, c)) for a, b, c in itertools.combinations(nodes, 3)))
    edges = spark.createDataFrame(pairs, "a string, b string")
    out = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    assert H.more_triangles(edges, out, n - 1, first) and not H.more_triangles(edges, out, n, first)


def test_triads_are_not_read_where_triangles_are_not_counted(spark):
    pairs = list(itertools.combinations([f"M:{i}" for i in range(6)], 2))
    never = spark.range(1).select(*(F.raise_error(F.lit("read")).cast("string").alias(t) for t in H.TRIAD))
    assert tuple(H.triangle_counts(spark.createDataFrame(pairs, "a string, b string"), never, 19).first()) == (None, None, None, False)


def test_recall_of_an_empty_list(spark):
    ranked = spark.createDataFrame([], "a string, b string, c string, gen_rank int")
    hits = spark.createDataFrame([("M:1", "M:2", "M:3")], "a string, b string, c string")
    rows = H.recall_at(ranked, hits, 1, [10, 100]).collect()
    assert {(r.budget, r.hits, r.recall, str(r.precision), r.capped) for r in rows} == {(10, 0, 0.0, "nan", True), (100, 0, 0.0, "nan", True)}


def test_boosting_without_rows(spark):
    rows = spark.createDataFrame([], "key long, x double, label int")
    assert G.choose_rounds(rows, ["x"], ["key"], folds=2, most=4) == (1, [0.0] * 4)
    models = G.train_seeds(rows, ["x"], 1, [1, 2])
    scored = G.seed_scores(models, rows, ["x"], ["key"]).withColumn("redundant", F.lit(""))
    ranked = G.prescription_ranks(scored, ["key"])
    assert models == [] and ranked.collect() == [] and {"score", "rank_engine", "rank_prescription"} <= set(ranked.columns)


def test_unit_weights_are_made_at_the_row(spark):
    units = spark.createDataFrame([(n, axis, f"u{i}", float(i)) for n in (1, 2) for axis in "DF" for i in range(9)], "nation int, axis string, unit string, value double")
    drawn = S.reweighted(units, 20, 3)
    assert "Join" not in plan(drawn)
    want = {(r.unit, r.rep): r.w for r in S.unit_weights(units, 20, 3).collect()}
    assert drawn.count() == 36 * 20 and all(want[r.unit, r.rep] == r.w for r in drawn.collect())


def test_word_sequences_of_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "of the GNU General Public License"), (2, "La la"), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([("M:ofthe", "of the", "ci"), ("T:the", "the", "ci"), ("M:gnu", "GNU General Public License", "cs")], "term_id string, text string, mode string")
    wanted = M.surfaces(words).select("mode", "gram", "size")
    found = M.hits(texts, wanted, ["doc_id"], "text")
    assert "SortMergeJoin" not in plan(found) and {(r.doc_id, r.gram) for r in found.collect()} == {(1, "of the"), (1, "the"), (1, "GNU General Public License")}


def test_tail_of_one_paper_keeps_its_small_digits(spark):
    groups = [(2, 1e-9), (1000, 1e-12)]
    rows = spark.createDataFrame([(1, groups), (2, groups)], "observed long, groups array<struct<n: long, q: double>>")
    p = {r.observed: r.p_value for r in S.tail_probability(rows).collect()}
    assert p[1] == pytest.approx(3e-9, rel=1e-8) and p[2] == pytest.approx(0, abs=1e-12)


def test_many_lines_are_dealt_by_number(spark, sf, monkeypatch):
    whole = bindings.incidence(spark, sf)
    monkeypatch.setattr(bindings, "LINES_PER_TASK", 100)
    dealt = bindings.incidence(spark, sf)
    assert "REPARTITION_BY_NUM" in plan(dealt) and dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()


@pytest.mark.parametrize("block", [2, 3, 100])
def test_pairs_of_a_group_come_from_blocks(spark, block):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([*range(40), None])) for _ in range(60)]
    rows = spark.createDataFrame(data, "k string, s int, v long")
    want = sorted((x[2], y[2]) for x in data for y in data if None not in x + y and x[:2] == y[:2] and x[2] < y[2])
    found = R.pairs_within(rows, ["k", "s"], "v", block, per_task=20)
    assert sorted(map(tuple, found.collect())) == want and "REPARTITION_BY_NUM" in plan(found)
    assert R.pairs_within(rows.where("v > 99"), ["k", "s"], "v").collect() == []


def test_suppliers_of_an_order_are_counted_before_the_shuffle(spark, sf, monkeypatch):
    whole = recovery._stage(spark, sf)
    monkeypatch.setattr(bindings, "LINES_PER_TASK", 100)
    dealt = recovery._stage(spark, sf)
    shuffled = [line for line in plan(dealt).splitlines() if "hashpartitioning" in line]
    assert "REPARTITION_BY_NUM" in plan(dealt) and not any("l_suppkey" in line and "o_orderkey" in line for line in (x.split("hashpartitioning(")[1].split(")")[0] for x in shuffled))
    assert dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()


def test_terms_of_parts_are_dealt_by_lines(spark, sf, monkeypatch):
    whole = vocabulary.part_terms(spark, sf)[2]
    monkeypatch.setattr(bindings, "LINES_PER_TASK", 100)
    dealt = vocabulary.part_terms(spark, sf)[2]
    assert "REPARTITION_BY_NUM" in plan(dealt) and dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()


def test_only_texts_beyond_ascii_reach_python(spark):
    texts = ["plain", "\ufb01n \uff21", "e\u0301", "", None]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.compatible(F.col("t")).alias("t"))
    assert "RLIKE" in plan(made) and {r.i: r.t for r in made.collect()} == {0: "plain", 1: "fin A", 2: "\u00e9", 3: "", 4: None}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None


def test_example_sentences_are_matched_once(spark):
    texts = spark.createDataFrame([(1, "The cat. A dog. The end."), (1, "The cat. A dog. The end."), (2, "No cat here. The cat."), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([("T:the", "the", "ci"), ("T:cat", "cat", "ci")], "term_id string, text string, mode string")
    found = M.example_sentences(texts, words, "doc_id", "text", 5, 1)
    assert "ArrowEvalPython" not in plan(found)
    want = {("the", 3, 1, 0, "The cat."), ("the", 3, 1, 2, "The end."), ("the", 3, 2, 1, "The cat."), ("cat", 3, 1, 0, "The cat."), ("cat", 3, 2, 0, "No cat here."), ("cat", 3, 2, 1, "The cat.")}
    rows = [(r.gram, r.n, r.doc_id, r.idx, r.sentence) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("small", [0, 100])
def test_word_weights_shuffle_the_counts_once(spark, monkeypatch, small):
    monkeypatch.setattr(L, "SMALL_VOCABULARY", small)
    texts = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["b", "c", "c"]), (3, ["b"]), (4, ["d"])], "id long, ws array<string>")
    found = L.tfidf(texts, "id", "ws", 2, 0.9)
    shape = plan(found)
    rows = {(r.id, r.word): r.weight for r in found.collect()}
    assert set(rows) == {(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "b"), (3, "c")}
    assert all(sum(w * w for (i, _), w in rows.items() if i == n) == pytest.approx(1) for n in (1, 2, 3))
    assert not small or ("SortMergeJoin" not in shape and shape.count("hashpartitioning") == 1)


def reads_files(df):
    return "FileScan" in plan(df)


def test_trainings_do_not_read_texts_again(spark, monkeypatch):
    seen = []

    def capture(*args, **kw):
        seen.append(args[0])
        raise StopIteration

    monkeypatch.setattr(G, "choose_rounds", capture)
    monkeypatch.setattr(L, "out_of_fold", capture)
    for asked in (extras.m09, models.m10):
        with pytest.raises(StopIteration):
            asked(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any(map(reads_files, seen))


def test_replications_do_not_build_the_graph_again(spark, sf, monkeypatch):
    seen = []
    drawn = S.redrawn
    monkeypatch.setattr(S, "redrawn", lambda rows, seed: seen.append(rows) or drawn(rows, seed))
    models.x19(spark, sf)
    assert len(seen) == 4 and not any(map(reads_files, seen))


def test_stable_pairs_and_open_triangles_are_made_once(spark, sf):
    g = graph.Graph(spark, sf)
    assert not reads_files(g.stable) and g.stable is g.stable and not reads_files(statistics.x32(spark, sf))


def test_degrees_of_papers_are_counted_without_lists(spark, sf):
    assert "collect_set" not in plan(statistics.x09(spark, sf))
