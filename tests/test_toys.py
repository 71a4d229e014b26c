"""Small inputs with known results for operators, sources and the stream."""

import gzip
import itertools
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import scalar as fn
from lattica.operators import hypergraph as H
from lattica.operators import matching as M
from lattica.operators import relational as R
from lattica.operators import statistics as S
from lattica.sources import files


def graph(spark, papers):
    return spark.createDataFrame(list(enumerate(papers)), "paper_id long, terms array<string>")


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_pair_threshold_and_growth(spark):
    r = one(spark, a=fn.pair_threshold(F.lit(0.5), F.lit(0.8), 0.9), b=fn.pair_threshold(F.lit(1.0), F.lit(0.1), 0.99), g=fn.growth(F.lit(8), F.lit(10)))
    # ln(10) / 0.4 = 5.76, ln(100) / 0.1 = 46.05
    assert (r.a, r.b) == (6, 47) and r.g == pytest.approx(5 / (5 / 3))


def test_npmi_and_gmean(spark):
    r = one(spark, a=fn.npmi(F.lit(0), F.lit(7), F.lit(2), F.lit(40.0)), b=fn.npmi(F.lit(64), F.lit(64), F.lit(64), F.lit(64.0)), c=fn.npmi(F.lit(4), F.lit(8), F.lit(8), F.lit(64.0)), z=fn.gmean(F.lit(-2), F.lit(0), F.lit(0)), g=fn.gmean(F.lit(1), F.lit(3), F.lit(7)))
    # p = 1/16 against 1/8 * 1/8: ln 4 / ln 16
    assert (r.a, r.b, r.z) == (-1, 1, 0) and r.c == pytest.approx(0.5) and r.g == pytest.approx(3)


def random_papers(seed, n=160, terms=14):
    rng = random.Random(seed)
    names = [f"{'MT'[i % 3 == 0]}:{i:02d}" for i in range(terms)]
    weights = [1 / (i + 1) for i in range(terms)]
    return [sorted(set(rng.choices(names, weights, k=rng.randint(1, 5)))) for _ in range(n)]


def counted_pairs(papers):
    return Counter(p for t in papers for p in itertools.combinations(t, 2))


def test_triads_against_enumeration(spark):
    papers, k = random_papers(3), 3
    e = graph(spark, papers)
    counts = counted_pairs(papers)
    stable = {p: n for p, n in counts.items() if n >= k}
    closed = {t for paper in papers for t in itertools.combinations(paper, 3)}
    tasks = lambda t: all(x.startswith("T:") for x in t)
    names = sorted({x for p in papers for x in p})
    edge = lambda x, y: tuple(sorted((x, y))) in stable
    want = {t: min(stable[p] for p in itertools.combinations(t, 2)) for t in itertools.combinations(names, 3) if all(p in stable for p in itertools.combinations(t, 2)) and t not in closed and not tasks(t)}
    table = H.supported_pairs(H.pair_counts(e), k)
    for known in (H.closed_triads(e), H.closed_triads(e, table)):
        assert {(r.a, r.b, r.c): r.weakest_pair_count for r in H.open_triangles(table, known).collect()} == want
    assert want and {tuple(r) for r in H.closed_triads(e).collect()} == closed
    degree = Counter(x for p in stable for x in p)
    aa = {(x, y): sum(1 / math.log(degree[z]) for z in names if edge(x, z) and edge(y, z) and degree[z] > 1) for x, y in itertools.combinations(names, 2)}
    got = {(r.a, r.b): r.aa for r in H.adamic_adar(table).collect()}
    assert got == pytest.approx({p: v for p, v in aa.items() if v})
    hops = {t for t in itertools.combinations(names, 3) if sum(p in stable for p in itertools.combinations(t, 2)) == 2 and t not in closed and not tasks(t)}
    assert {(r.a, r.b, r.c) for r in H.two_hop(table, H.pair_counts(e), H.closed_triads(e)).collect()} == hops
    assert H.two_hop(table, H.pair_counts(e), H.closed_triads(e), limit=2).count() == min(2, len(hops))


@pytest.mark.parametrize("how", ["mean", "min", "sum"])
def test_completions_against_enumeration(spark, monkeypatch, how):
    monkeypatch.setattr(H, "BLOCK", 4)
    papers = random_papers(5, 60, 9)
    e, counts = graph(spark, papers), counted_pairs(random_papers(5, 60, 9))
    names = sorted({x for p in papers for x in p})
    seeds = [p for p, n in counts.items() if n >= 6]
    value = lambda x, y: counts[tuple(sorted((x, y)))]
    join = {"mean": lambda x, y: (x + y) / 2, "min": min, "sum": lambda x, y: x + y}[how]
    want = {}
    for u, v in seeds:
        for w in names:
            t = tuple(sorted((u, v, w)))
            if w not in (u, v) and not all(x.startswith("T:") for x in t) and not any(set(t) <= set(p) for p in papers):
                want[t] = max(want.get(t, 0), join(value(u, w), value(v, w)))
    pairs = H.pair_counts(e)
    got = H.completions(pairs.where("cnt >= 6"), H.term_counts(H.incidence_of(e)), pairs.select("a", "b", F.col("cnt").cast("double").alias("value")), H.closed_triads(e), how)
    assert {(r.a, r.b, r.c): r.score for r in got.collect()} == want and want


def test_context_overlap(spark):
    # contexts of the pairs of (p, q, r): pq {s: 2, t: 1}, pr {s: 1}, qr {} as they never meet
    e = graph(spark, [["p", "q", "s"], ["p", "q", "s", "t"], ["p", "r", "s"], ["q", "t"]])
    rows = spark.createDataFrame([("p", "q", "r")], "a string, b string, c string")
    r = H.context_overlap(rows, e).first()
    assert (r.s_max, r.s_mean) == pytest.approx((2 / math.sqrt(5), 2 / math.sqrt(5) / 3))


def test_components_and_cover(spark):
    links = spark.createDataFrame([(9, 4), (4, 6), (6, 8), (1, 3), (20, 21), (21, 20)], "a long, b long")
    assert {r.term: r.head for r in H.connected_groups(links).collect()} == {9: 4, 4: 4, 6: 4, 8: 4, 1: 1, 3: 1, 20: 20, 21: 20}
    names = spark.createDataFrame([(9, "ant"), (4, "bee"), (6, "ant"), (8, "cow"), (1, "x"), (3, "w"), (20, "z"), (21, "z")], "term long, name string")
    assert {r.term: r.head for r in H.named_groups(links, names).collect()} == {9: 6, 4: 6, 6: 6, 8: 6, 1: 3, 3: 3, 20: 20, 21: 20}
    rows = [("k", "l", "m"), ("k", "n", "o"), ("l", "n", "p"), ("q", "r", "s"), ("k", "x", "y")]
    t = spark.createDataFrame(rows, "a string, b string, c string")
    assert H.greedy_cover(t, 9) == [("k", 3), ("l", 1), ("q", 1)]


def test_upper_tail_against_enumeration(spark):
    rng = random.Random(8)
    cases = [[(rng.randint(0, 6), rng.choice([0.0, 1e-5, 0.02, 0.4, 0.5, 0.77, 1.0])) for _ in range(rng.randint(0, 4))] for _ in range(25)] + [[(300, 0.02), (40, 0.3)]]

    def tail(groups, o):
        mass = [1.0]
        for q in (q for n, q in groups for _ in range(n)):
            mass = [(mass[i] if i < len(mass) else 0) * (1 - q) + (mass[i - 1] if i else 0) * q for i in range(len(mass) + 1)]
        return sum(mass[o:])

    rows = [(i, [{"n": n, "q": q} for n, q in g], o) for i, g in enumerate(cases) for o in (0, 1, 2, 5, 13, 30)]
    df = spark.createDataFrame(rows, "i int, groups array<struct<n:long,q:double>>, observed long")
    for r in S.tail_probability(df).collect():
        assert r.p_value == pytest.approx(tail(cases[r.i], r.observed), abs=1e-12), (cases[r.i], r.observed)


def test_benjamini_hochberg_with_ties(spark):
    rng = random.Random(4)
    p = [rng.choice([0.001, 0.02, 0.02, 0.3, rng.random(), 1.0]) for _ in range(700)]
    rows = spark.createDataFrame(list(enumerate(p)), "i int, p_value double")
    order = sorted(range(len(p)), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, p[order[rank - 1]] * len(p) / rank)
        want[order[rank - 1]] = low
    assert {r.i: r.q_value for r in S.benjamini_hochberg(rows).collect()} == pytest.approx(want)


@pytest.mark.parametrize("per_range", [50_000, 100])
def test_running_totals_and_ranks(spark, monkeypatch, per_range):
    from lattica.operators import ranks

    monkeypatch.setattr(ranks, "PER_RANGE", per_range)

    rng = random.Random(6)
    rows = [(i, rng.choice([None, 1, 2, 2, 7, rng.randint(0, 900)]), rng.choice("abc")) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, v int, s string").repartition(5)
    placed = ranks.numbered(df, [F.col("s"), -F.col("v"), F.col("i")], "place")
    order = sorted(rows, key=lambda r: (r[2], r[1] is not None, -(r[1] or 0), r[0]))
    assert {r.i: r.place for r in placed.collect()} == {r[0]: n for n, r in enumerate(order, 1)}
    values = [r[1] for r in rows if r[1] is not None]
    got = {r.i: r.p for r in ranks.average_ranks(df, "v", "p").collect()}
    share = {v: (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2) / len(values) for v in set(values)}
    assert all(got[i] == (None if v is None else pytest.approx(share[v])) for i, v, _ in rows)
    bins = Counter(r.bin for r in ranks.equal_bins(df, 8, [F.col("i")], "bin").collect())
    assert bins == {b: 188 if b <= 4 else 187 for b in range(1, 9)}
    assert ranks.numbered(df.where("false"), [F.col("i")], "place").count() == 0
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    for by in ([], ["s"]):
        got = {(*(r[b] for b in by), r.share): r.value for r in ranks.quantiles(df, by, "v", shares).collect()}
        groups = {(): values} if not by else {(s,): [r[1] for r in rows if r[2] == s and r[1] is not None] for s in "abc"}
        assert got == pytest.approx({(*g, q): float(np.percentile(v, 100 * q)) for g, v in groups.items() for q in shares})
    assert ranks.quantiles(df.where("false"), ["s"], "v", shares).count() == 0


def test_wilson(spark):
    lo, hi = fn.wilson(F.lit(3), F.lit(12))
    r = one(spark, lo=lo, hi=hi, none=fn.wilson(F.lit(0), F.lit(0))[0])
    # the ends are where (p - 1/4)^2 = z^2 p (1 - p) / 12
    for end in (r.lo, r.hi):
        assert (end - 0.25) ** 2 == pytest.approx(1.959963984540054**2 * end * (1 - end) / 12)
    assert r.lo < 0.25 < r.hi and r.none is None


def test_weighted_precision(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 1), rng.choice([0.0, 0.5, 1.0, 3.0])) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, y int, w double")
    for k in (1, 4.5, 20, 500):
        left, hit = k, 0.0
        for _, y, w in rows:
            take = min(w, left)
            left, hit = left - take, hit + take * y
        assert S.weighted_precision(df, k, [F.col("i")]).first().precision == pytest.approx(hit / (k - left))


def test_diversified_order_and_sequence():
    terms = [("p", "q"), ("p", "r"), ("p", "s"), ("q", "r"), ("s", "t"), ("r", "t")]
    # cap 1: pq first, then st; the others share a term with these
    assert S.diversified([0, 1, 2, 3, 4, 5], terms, 1) == [0, 4, 1, 2, 3, 5]
    # cap 2: after rt, st, qr and ps the term r is full, so pr waits for pq
    assert S.diversified([5, 4, 3, 2, 1, 0], terms, 2) == [5, 4, 3, 2, 0, 1]
    assert S.run_sequence([("one", True), ("two", True), ("three", False), ("four", True)]) == [("one", "pass"), ("two", "pass"), ("three", "fail"), ("four", "not tested")]
    assert S.power_of_test(S.sample_size(0.5, 0.7, 0.05, 0.8), 0.5, 0.7, 0.05) >= 0.8


def test_recall_at_budgets(spark):
    rng = random.Random(1)
    listed = [("x", "y", f"z{i}") for i in range(30)]
    real = set(rng.sample(listed, 9)) | {("x", "y", "far"), ("x", "y", "farther")}
    ranked = spark.createDataFrame([(*t, r) for r, t in enumerate(listed, 1)], "a string, b string, c string, gen_rank int")
    hits = spark.createDataFrame(sorted(real), "a string, b string, c string")
    got = {r.budget: (r.hits, r.recall, r.precision, r.capped) for r in H.recall_at(ranked, hits, len(real), [3, 12, 30, 99]).collect()}
    for b in (3, 12, 30, 99):
        found = len(real & set(listed[:b]))
        assert got[b] == (found, found / len(real), found / min(b, 30), b > 30)


SURFACES = [("M:qp", "Q-Path", "cs"), ("M:p", "Path", "cs"), ("T:wf", "water flow", "ci"), ("T:w", "water", "ci"), ("M:one", "twin", "ci"), ("M:two", "Twin", "ci"), ("T:fl", "ﬂow rate", "ci")]


def test_matcher_rules(spark):
    texts = ["A Q-Path, one Path and no path", "WATER-Flow of water; twin", None, "Ｑ_Ｐａｔｈ water flow rate", "water", ""]
    d = spark.createDataFrame(SURFACES, "term_id string, text string, mode string")
    spans = M.match(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), d, "id", "text")
    want = [(0, "M:qp", "cs", 1, 3), (0, "M:p", "cs", 4, 5), (1, "T:wf", "ci", 0, 2), (1, "T:w", "ci", 3, 4), (3, "M:qp", "cs", 0, 2), (3, "T:wf", "ci", 2, 4), (4, "T:w", "ci", 0, 1)]
    assert sorted(tuple(r) for r in spans.collect()) == sorted(want)
    assert [tuple(r) for r in M.ambiguous(d).collect()] == [("ci", "twin", ["M:one", "M:two"])]
    assert M.match(spark.createDataFrame([(1, "x")], "id long, text string"), d.where("false"), "id", "text").count() == 0


def test_refined_spans(spark):
    texts = [(1, "Path of the water flow"), (2, "the water path, as Path goes"), (3, "Path"), (4, "hot water flow"), (5, "hot water and water")]
    rows = [("M:p", "Path", "cs"), ("M:p", "water path", "ci"), ("T:w", "water", "ci"), ("T:wf", "water flow", "ci"), ("M:c", "Path", "cs2")][:4]
    t, d = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rows, "term_id string, text string, mode string")
    spans = M.match(t, d, "id", "text")
    none = spark.createDataFrame([], "term_id string")
    plain = {(r.id, r.term_id, r.mode, r.first) for r in M.refine(spans, "id", none).collect()}
    # a Path counts only beside the full name; "water" in "water path" is nested in nothing of its own pass
    assert plain == {(1, "T:wf", "ci", 3), (2, "M:p", "ci", 1), (2, "M:p", "cs", 4), (4, "T:wf", "ci", 1), (5, "T:w", "ci", 1), (5, "T:w", "ci", 3)}
    lone = {(r.id, r.term_id) for r in M.refine(spans, "id", spark.createDataFrame([("M:p",)], "term_id string")).collect()}
    assert {(1, "M:p"), (3, "M:p")} <= lone
    out = M.phrases(t, spark.createDataFrame([("T:w", "hot water"), ("T:x", "water")], "term_id string, text string"), "id", "text")
    kept = {(r.id, r.term_id, r.first) for r in M.refine(spans, "id", none, out).collect()}
    assert kept == {(i, term, f) for i, term, _, f in plain} - {(5, "T:w", 1)}


def test_window_evidence(spark):
    rows = [(7, 0, "P.", ["P"]), (7, 1, "Q and R.", ["Q", "R"]), (7, 2, "S.", ["S"]), (8, 0, "P Q, unlike others", ["P", "Q"]), (8, 1, "R.", ["R"]), (8, 2, "P Q.", ["P", "Q"]), (9, 0, "P Q R", ["P", "Q", "R"])]
    df = spark.createDataFrame(rows, "id long, idx int, sentence string, terms array<string>")
    ids = lambda terms, size: {r.id for r in M.window_evidence(df, "id", terms, size, M.cue_pattern(["unlike", "in contrast"])).collect()}
    assert ids(["P", "Q", "R"], 1) == {9} and ids(["P", "Q", "R"], 2) == {7, 8, 9} and ids(["P", "S"], 2) == set() and ids(["P", "S"], 3) == {7}


def test_unique_keys_are_asserted(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(ValueError):
        R.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        R.enrich(df, spark.createDataFrame([(5, 6)], "k long, w long"), ["k"], "w")


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.jsonl", '{"id": "1", "n": 2}\nbroken\n{"id": "2", "n": 3}\n')
    good, bad = files.json_lines(files.packed_lines(spark, str(tmp_path / "a.zip")), "id string, n long")
    assert sorted(tuple(r) for r in good.collect()) == [("1", 2), ("2", 3)] and [r.line for r in bad.collect()] == ["broken"]
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t\n"))
    assert files.string_table(spark, str(tmp_path / "t.tsv.gz"), ["a", "b"]).first().asDict() == {"a": "1", "b": ""}
    (tmp_path / "s.csv").write_bytes("﻿id,note\n1,\n".encode())
    sheet = files.review_sheet(spark, str(tmp_path / "s.csv"))
    assert sheet.columns == ["id", "note"] and sheet.first().note == ""
    files.write_metrics(str(tmp_path / "m.json"), "s", {"n": 1}, {"t": str(tmp_path / "s.csv")})
    files.update_metrics(str(tmp_path / "m.json"), "k", 2)
    digest = files.sha256_of(str(tmp_path / "s.csv"))
    assert files.check_inventory({"s.csv": ((tmp_path / "s.csv").stat().st_size, digest), "none": (1, "")}, str(tmp_path)) == ["none"]


def test_review_rules(spark):
    from lattica.operators import models as L
    from lattica.operators import review as V

    sheet = spark.createDataFrame([(1, "yes", ""), (2, "no", ""), (3, "no", "why")], "id int, correct string, note string")
    rules = {"no without a note": (F.col("correct") == "yes") | (F.col("note") != "")}
    assert [tuple(r) for r in V.validate_sheet(sheet, sheet, "id", ["note"], {"correct": ["yes", "no"]}, rules).collect()] == [(2, "no without a note")]
    texts = ['I say {"roles": ["used"], "sure": true}.', "nothing", None, "{broken", 'x {"other": 1}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(V.parsed_answer(F.col("t"), "roles array<string>, sure boolean").alias("p")).collect()
    assert [r.p and tuple(r.p) for r in got] == [(["used"], True), None, None, None, None]
    phrases = spark.createDataFrame([("M:a", "p"), ("M:b", "p"), ("M:c", "q")], "term_id string, text string")
    heads = spark.createDataFrame([("M:a", "M:a"), ("M:b", "M:a")], "term string, head string")
    assert {tuple(r) for r in L.remapped_phrases(phrases, heads).collect()} == {("M:a", "p"), ("M:c", "q")}


def test_more_sources_and_sinks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.tsv", "id\tname\n1\tx\n2\t\n")
        z.writestr("b.tsv", "id\tname\n3\ty z\n")
    rows = files.packed_table(spark, str(tmp_path / "t.zip"))
    assert sorted((r.id, r.name) for r in rows.collect()) == [("1", "x"), ("2", ""), ("3", "y z")]
    (tmp_path / "v.json").write_text('{"terms": [\n {"id": "M:a", "n": 1},\n {"id": "T:b"}], "other": 3}')
    assert [tuple(r) for r in files.json_table(spark, str(tmp_path / "v.json"), "terms", "id string, n int").collect()] == [(0, "M:a", 1), (1, "T:b", None)]
    (tmp_path / "w.txt").write_text("Apple\n\n apple \nPear\n")
    assert {r.word for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"apple", "pear"}
    files.write_rows(spark.range(25, numPartitions=1), str(tmp_path / "rows"), 10)
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "rows")).count() == 25
    files.write_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    links = spark.createDataFrame([("p", ["p", "q"]), ("p", ["q"]), ("p", ["p", "q", "r"]), ("p", ["p", "p", "q"])], "id string, ids array<string>")
    assert files.verified_links(links, "ids", 2).count() == 2
    files.require_known({"rule": "a"}, {"rule": {"a", "b"}})
    with pytest.raises(ValueError):
        files.require_known({"rule": "c"}, {"rule": {"a", "b"}})
    assert files.estimated_bytes(spark.range(1000)) >= 8000 > files.estimated_bytes(spark.range(10))


def test_report_numbers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"share": 0.12345, "list": [3, 4000]}}')
    report = files.Report(str(tmp_path))
    assert (report.text("m", "a.share", "d3"), report.text("m", "a.share", "pct"), report.text("m", "a.list.1", "int")) == ("0.123", "12.3%", "4,000")
    assert [tuple(r) for r in report.table(spark).collect()][2] == ("m", "a.list.1", "4000", "4,000")


def test_stream_equals_batch(spark, sf, tmp_path):
    from lattica.streaming.halves import windowed_counts

    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("halves").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type): r.n for r in windowed_counts(batch).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("halves").collect()} == want


def test_entry_without_optional_parts():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unicode_names_of_whole_texts(spark, sf):
    import re
    import unicodedata

    from lattica.plans import texts

    def plain(text):
        spaced = re.sub("[ \t\n\x0b\f\r]+", " ", re.sub("[-_/]+", " ", unicodedata.normalize("NFKC", text).lower()))
        return spaced.strip(" .,;:")

    want = {r.doc_id: r.text and plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.name for r in texts.t01u(spark, sf).collect()} == want


def test_diversified_order_keeps_every_candidate(spark):
    from lattica.plans import statistics as P

    sf = "/root/testdata/sf0.01"
    rows = P.Null(spark, sf).ranked().orderBy(*P.by_rank()).collect()
    want = S.diversified(list(range(len(rows))), [(r.a, r.b, r.c) for r in rows], 20)
    got = sorted(P.o06(spark, sf).collect(), key=lambda r: r.rank)
    assert len(rows) > 500 and [r.rank for r in got] == list(range(1, len(rows) + 1))
    assert [(r.a, r.b, r.c) for r in got] == [(rows[i].a, rows[i].b, rows[i].c) for i in want]


def test_evidence_reads_every_language(spark, tmp_path):
    from lattica.plans import models, texts

    rows = [(1, "The end of it with us and. More from", "fr"), (2, "The top of the hill. With Ann", "de"), (3, "We go with it", "es"), (4, "Nothing", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in texts.t08(spark, str(tmp_path)).collect()} == {1, 2}
    pairs = {(r.x, r.y): (r.n_cooc, r.n_evidence) for r in models.g19(spark, str(tmp_path)).collect()}
    assert pairs["of", "the"] == (2, 2) and pairs["from", "with"] == (1, 1)
    assert [(r.doc_id, r.idx) for r in models.t19(spark, str(tmp_path)).collect()] == [(2, 1), (3, 0), (1, 0)]


def test_recall_counts_the_new_triads(spark):
    from lattica.plans import graph as G
    from lattica.plans import statistics as P

    sf = "/root/testdata/sf0.01"
    g = G.Graph(spark, sf)
    total = P.x06(spark, sf).count()
    listed = G._completions(g).count()
    rows = {r.budget: r for r in G.g18n(spark, sf).collect()}
    assert all(r.recall == r.hits / total for r in rows.values())
    assert listed > 1000 and not rows[1000].capped and rows[1000].precision == rows[1000].hits / 1000


def test_significant_new_triads(spark):
    from types import SimpleNamespace

    from lattica.plans import statistics as P

    label = [*[["M:a", "M:b", "M:c"]] * 3, ["M:x", "M:y", "M:z"], *[["M:a", "M:b", "M:d"]] * 5, *[["M:e", "M:f"]] * 20, ["T:1", "T:2", "T:3"]]
    edges = graph(spark, label)
    g = SimpleNamespace(label=edges.select("paper_id", F.explode("terms").alias("term_id")), label_edges=edges, closed=spark.createDataFrame([("M:a", "M:b", "M:c")], "a string, b string, c string"))
    degrees = H.degree_distribution(edges).collect()
    docs = {t: sum(t in p for p in label) for p in label for t in p}
    links = sum(r.degree * r.papers for r in degrees)
    want = {}
    for tri, o in ((("M:a", "M:b", "M:d"), 5), (("M:x", "M:y", "M:z"), 1)):
        chances = [math.prod(min(1, r.degree * docs[t] / links) for t in tri) for r in degrees for _ in range(r.papers)]
        p = [1.0]
        for q in chances:
            p = [(p[i] if i < len(p) else 0) * (1 - q) + (p[i - 1] * q if i else 0) for i in range(len(p) + 1)]
        want[tri] = sum(p[o:])
    rows = {(r.a, r.b, r.c): r for r in P.significant_new_triads(g, 1.0).collect()}
    assert set(rows) == set(want)
    assert all(abs(rows[t].p_value - p) < 1e-9 for t, p in want.items())
    low, high = sorted(want.values())
    assert sorted(r.q_value for r in rows.values()) == pytest.approx([min(2 * low, high), high])
    assert rows["M:a", "M:b", "M:d"].papers == [4, 5, 6, 7, 8]
    cut = (min(2 * low, high) + high) / 2
    assert len(P.significant_new_triads(g, cut).collect()) == 1
