"""Intervals and power of rankings of the open triangles, over a thousand replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypergraph as H
from ..operators import replicates as B
from ..operators.ranks import numbered
from .registry import query
from .statistics import Null, ascending

KS = [50, 100, 200]


def study(spark, sf):
    """The open triangles with two orders (weakest pair, and terms backwards), budgets of half and all of them by a third; positives are
    the triples of two label papers and more, marked by whether a budget or the first third of the generator's order has them."""
    g = Null(spark, sf)
    rows = numbered(g.ranked(), [F.hash(F.lit(3), *H.TRIAD), *map(F.col, H.TRIAD)], "gen_rank")
    n = rows.count()
    half, first = n // 2, n // 3
    engine, baseline = ascending("score"), [F.desc("c"), F.desc("b"), F.desc("a")]
    inside = {half: F.col("gen_rank") <= half, n: F.lit(True)}
    orders = {f"{name}_{b}": (where, order) for b, where in inside.items() for name, order in (("engine", engine), ("baseline", baseline))}
    found = H.triple_counts(g.label_edges).where("cnt >= 2").select(*H.TRIAD).join(rows.select(*H.TRIAD, "gen_rank"), H.TRIAD, "left")
    marks = {f"pool_{half}": F.coalesce(F.col("gen_rank") <= half, F.lit(False)), f"pool_{n}": F.col("gen_rank").isNotNull(), "first": F.coalesce(F.col("gen_rank") <= first, F.lit(False))}
    return B.Study(rows, orders, {f"all_{b}": where for b, where in inside.items()}, found, marks), half, n


def measures(*budgets):
    return {k: m for b in budgets for k, m in ((f"recall_{b}", B.RecallDifference(f"pool_{b}", "first")), (f"lift_{b}", B.Lift(f"engine_{b}", f"all_{b}")), (f"gain_{b}", B.Difference(f"engine_{b}", f"baseline_{b}")))}


@query("x17_all_intervals")
def x17(spark, sf):
    """Bounds of lift, precision differences (of one pool and of two) and recall differences under both schemes, 1,000 replicates."""
    s, half, n = study(spark, sf)
    wanted = measures(half, n) | {"union": B.Difference(f"engine_{half}", f"engine_{n}")}
    return B.bounds(s, wanted, KS, inner=1000, seed=7).withColumn("measure", F.regexp_replace("measure", f"_{n}$", "_all")).withColumn("measure", F.regexp_replace("measure", f"_{half}$", "_half")).drop("outer")


@query("x19_nested_choice")
def x19(spark, sf):
    """Power of the three steps by budget and k over 1,000 pseudo replications of 1,000 replicates each, and the pair that is chosen."""
    s, half, n = study(spark, sf)
    steps = {k: (step, b, t) for b in (half, n) for k, step, t in ((f"recall_{b}", "s1", 0.0), (f"lift_{b}", "s2", 1.0), (f"gain_{b}", "s3", 0.0))}
    found = B.bounds(s, measures(half, n), KS, outer=1000, inner=1000, seed=11, redraw=True, keep=0.9)
    return B.chosen(B.power(found, steps, KS, 1000), "upto_s2", 0.8)
