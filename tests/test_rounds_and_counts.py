"""Rounds by cross-validation, triangle counts without a list, groups asked over a stream."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import boosting as G
from lattica.operators import hypergraph as H
from lattica.operators.relational import until_first_hit
from lattica.operators.statistics import average_precision
from lattica.streaming.rounds import ask_open_groups


def test_precisions_of_all_rounds_at_once(spark):
    rng = random.Random(2)
    rows = [(f, int(rng.random() < 0.3), [rng.choice([0.1, 0.2, 0.5, 0.5, 0.9]) + r * rng.random() for r in range(4)]) for f in range(3) for _ in range(200)]
    rows += [(7, 0, [0.5] * 4), (7, 0, [0.1] * 4)]
    df = spark.createDataFrame(rows, "fold int, label int, ms array<double>").repartition(4)
    got = {(r.fold, r["round"]): r.average_precision for r in G.round_precisions(df).collect()}
    assert len(got) == 16 and all(got[7, r] is None for r in range(4))
    for f, r in itertools.product(range(3), range(4)):
        one = df.where(F.col("fold") == f).select(F.col("ms")[r].alias("score"), F.col("label").alias("y"))
        assert got[f, r] == pytest.approx(average_precision(one).first().average_precision)


def test_rounds_cost_no_job_each(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.random(), int(rng.random() < 0.4)) for i in range(120)], "key int, x double, label int")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    counts = []
    staged = df.select((F.col("key") % 2).alias("fold"), "label", "x")
    for most in (2, 12):
        before = jobs()
        spark.sparkContext.setJobGroup("rounds", "rounds")
        ms = F.array(*(F.col("x") * (i + 1) for i in range(most)))
        assert G.round_precisions(staged.select("fold", "label", ms.alias("ms"))).count() == 2 * most
        counts.append(jobs() - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(counts) - min(counts) <= 4, counts


def plain_counts(edges, closed):
    have = {tuple(sorted(e)) for e in edges}
    nodes = sorted({t for e in have for t in e})
    found = [t for t in itertools.combinations(nodes, 3) if all(p in have for p in itertools.combinations(t, 2))]
    left = [t for t in found if t not in closed]
    return len(found), len(left), sum(any(x.startswith("T:") for x in t) for t in left)


@pytest.mark.parametrize("density", [0.0, 0.2, 0.9])
def test_triangle_counts_without_a_list(spark, density):
    rng = random.Random(3)
    nodes = [f"{rng.choice('MT')}:{i}" for i in range(24)]
    edges = [tuple(sorted(p)) for p in itertools.combinations(nodes, 2) if rng.random() < density]
    edges += [tuple(sorted((nodes[0], n))) for n in nodes[1:] if density and tuple(sorted((nodes[0], n))) not in edges]  # a hub
    closed = {tuple(sorted(rng.sample(nodes, 3))) for _ in range(300)}
    stable = spark.createDataFrame(edges, "a string, b string")
    shut = spark.createDataFrame(sorted(closed), "a string, b string, c string")
    r = H.triangle_counts(stable, shut).first()
    want = plain_counts(edges, closed)
    assert (r.triangles, r.open_triangles, r.open_with_task, r.counted) == (*want, True)
    if want[0]:
        assert H.triangle_counts(stable, shut, want[0]).first().counted
        assert tuple(H.triangle_counts(stable, shut, want[0] - 1).first()) == (None, None, None, False)


def test_stream_of_groups_asks_what_the_batch_keeps(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").dropDuplicates(["l_orderkey", "l_linenumber"])
    source, asked = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], lines.schema).write.parquet(source)
    stream = spark.readStream.schema(lines.schema).parquet(source)
    found = ask_open_groups(stream, ["l_orderkey"], ["l_linenumber"], lambda r: r["l_returnflag"] == "R")
    begin = lambda: found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start(asked)
    for low, high in ((1, 2), (3, 3), (4, 99)):  # the query is stopped and begun anew between the rounds
        lines.where(F.col("l_linenumber").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        q = begin()
        q.processAllAvailable()
        q.stop()
    got = {(r.l_orderkey, r.l_linenumber): r.hit for r in spark.read.parquet(asked).collect()}
    kept = until_first_hit(lines, ["l_orderkey"], [F.asc("l_linenumber")], F.col("l_returnflag") == "R").collect()
    assert got == {(r.l_orderkey, r.l_linenumber): r.l_returnflag == "R" for r in kept} and len(got) < lines.count()
