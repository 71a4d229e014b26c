"""Queries whose point is what survives: resumed answers, merged parts, rebuilt stages, capped plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rebuild as R
from ..sources import guard, parts
from ..sources.folders import kept, new_folder
from ..sources.responses import Later, Missing, ask_all
from .bindings import BUILD_END, dealt, table, with_
from .registry import query

RECORDED = 8


def recorded_orders(spark, sf):
    """A service that knows customers' orders: recorded responses by part, and ``connect`` to them. It asks callers to come back once for every 50th customer."""
    folder = new_folder(spark, "recorded")
    value = F.to_json(F.struct(F.count("*").alias("orders"), F.max("o_orderkey").alias("last")))
    recorded = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(value.alias("value"))
    placed = recorded.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RECORDED)).cast("int"))
    placed.repartition(RECORDED, "part").write.partitionBy("part").parquet(folder)

    def connect(part):
        from lattica.sources.responses import _table

        found = _table(f"{folder}/part={part}")
        known = {} if found is None else dict(zip(found.column("key").to_pylist(), found.column("value").to_pylist()))
        put_off = set()

        def ask(key):
            if int(key) % 50 == 0 and key not in put_off:
                put_off.add(key)
                raise Later(0.0)
            if key not in known:
                raise Missing
            return known[key]

        return ask

    return connect


@query("s10_resumed_answers", "SELECT c_custkey, any_value(c_nationkey) AS c_nationkey, count(o_orderkey) AS n_orders, max(o_orderkey) AS last, CASE WHEN c_custkey % 50 = 0 THEN 2 ELSE 1 END AS tries FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def s10(spark, sf):
    """All customers asked for their orders, and what comes back joined to them."""
    customers = table(spark, sf, "customer")
    answers = ask_all(customers, "c_custkey", new_folder(spark, "answers"), recorded_orders(spark, sf), RECORDED, every=50)
    parsed = answers.select(F.col("key").cast("long").alias("c_custkey"), F.from_json("value", "orders long, last long").alias("v"), "tries")
    return customers.select("c_custkey", "c_nationkey").join(parsed, "c_custkey").select("c_custkey", "c_nationkey", F.coalesce("v.orders", F.lit(0)).alias("n_orders"), F.col("v.last").alias("last"), "tries")


STAGE = "SELECT l_suppkey, count(DISTINCT o_orderkey) AS papers, max(o_orderdate) AS last, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey {} GROUP BY l_suppkey"


def _stage(spark, sf, until=None):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    orders = orders if until is None else orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity")
    # an order is whole in its task, so its suppliers are distinct there and only sums are shuffled
    lines, orders = dealt(lines, orders, "o_orderkey")
    own = lines.join(orders, "o_orderkey").groupBy("o_orderkey", "l_suppkey").agg(F.max("o_orderdate").alias("last"), F.sum("l_quantity").alias("quantity"))
    return own.groupBy("l_suppkey").agg(F.count("*").alias("papers"), F.max("last").alias("last"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query(
    "r12_rebuild_differences",
    with_(f"o AS ({STAGE.format('')})", "n AS (SELECT * FROM (" + STAGE.format("") + f") WHERE l_suppkey % 7 <> 0 OR l_suppkey IN (SELECT l_suppkey FROM ({STAGE.format(chr(87) + 'HERE o_orderdate < TIMESTAMP ' + chr(39) + BUILD_END + chr(39))}) WHERE papers > 20))", "m AS (SELECT l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN papers + 1 ELSE papers END AS papers, last, quantity FROM n WHERE l_suppkey % 11 <> 0)", "j AS (SELECT coalesce(o.l_suppkey, m.l_suppkey) AS l_suppkey, CASE WHEN o.l_suppkey IS NULL THEN 'added' WHEN m.l_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change, o.papers AS po, m.papers AS pn, o.last AS lo, m.last AS ln, o.quantity AS qo, m.quantity AS qn FROM o FULL JOIN m ON o.l_suppkey = m.l_suppkey)", "c AS (SELECT l_suppkey, change, 'papers' AS \"column\", CAST(po AS VARCHAR) AS old, CAST(pn AS VARCHAR) AS new FROM j UNION ALL SELECT l_suppkey, change, 'last', CAST(lo AS VARCHAR), CAST(ln AS VARCHAR) FROM j UNION ALL SELECT l_suppkey, change, 'quantity', CAST(qo AS VARCHAR), CAST(qn AS VARCHAR) FROM j)")
    + "SELECT * FROM c WHERE change <> 'changed' OR old IS DISTINCT FROM new",
)
def r12(spark, sf):
    """The suppliers' stage committed as it is, and rebuilt under a rule that counts one paper more for some and loses others."""
    path = new_folder(spark, "stage")
    # the stage is read five times: its rows, digests and the rebuild
    stage = kept(_stage(spark, sf), "stage-rows")
    R.commit_stage(stage, path, ["l_suppkey"], 64)
    used = _stage(spark, sf, BUILD_END).where("papers > 20").select("l_suppkey")
    rebuilt = stage.where("l_suppkey % 7 <> 0").unionByName(stage.where("l_suppkey % 7 = 0").join(used, "l_suppkey", "left_semi")).where("l_suppkey % 11 <> 0")
    rebuilt = rebuilt.withColumn("papers", F.when(F.col("l_suppkey") % 5 == 0, F.col("papers") + 1).otherwise(F.col("papers")))
    return R.compare_with_committed(spark, path, rebuilt, ["l_suppkey"], 64)


@query("k09_merged_labels", "WITH o AS (SELECT o_orderkey, o_custkey, (o_orderkey * 7 + o_custkey) % 5 = 0 AS hit FROM orders) SELECT o_custkey, count(*) AS n_papers, count(*) AS n_classified, count(*) FILTER (hit) AS n_positive, count(*) FILTER (hit) >= 2 AS label FROM o GROUP BY o_custkey")
def k09(spark, sf):
    """Orders classified in four parts, each committed with its manifest, merged after all checks, and labelled by customer."""
    folder, of = new_folder(spark, "parts"), 4
    frame = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    relation = F.when((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5 == 0, "combination").otherwise("other")
    dealt = frame.select("o_orderkey", relation.alias("relation"), parts.part_of(of, F.col("o_orderkey")).alias("_p"))
    for part in range(of):
        parts.commit_part(dealt.where(F.col("_p") == part).drop("_p"), folder, part, of, {"model": "rule", "threshold": 5})
    outputs = parts.merged(spark, folder, ["o_orderkey"])
    return parts.label_table(frame, outputs, ["o_orderkey"], ["o_custkey"], F.col("relation") == "combination", 2)


@query("s12_capped_plan", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey")
def s12(spark, sf):
    """One year of orders by customer, run only since its plan filters at the reader and reads no more than the three columns' share of the table."""
    orders = table(spark, sf, "orders")
    day = lambda d: F.lit(d).cast("timestamp")
    year = orders.where((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1997-01-01")))
    out = year.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return guard.capped(out, int(guard.expected_bytes(orders) * 0.7), {"orders.parquet": ["o_orderdate"]})
