"""Scans, filters, joins, aggregations, windows, set operations and samples over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from ..operators.ranks import equal_bins, quantiles
from .bindings import table
from .registry import query


def ts(s: str):
    return F.lit(s).cast("timestamp")


@query("s02_projected_scan", "SELECT o_orderkey, o_orderdate FROM orders")
def s02(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate")


@query("s04_pushed_id_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def s04(spark, sf):
    ids = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(ids, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("s06_multi_file_union", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region")
def s06(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("id")))


@query("s13_fingerprint")
def s13(spark, sf):
    return R.fingerprint(table(spark, sf, "orders"))


@query("f01_closed_window", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31 23:59:59'")
def f01(spark, sf):
    return R.closed_window(table(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1997-12-31 23:59:59").select("o_orderkey")


@query("f02_half_open_window", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'")
def f02(spark, sf):
    return R.half_open_window(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id")


@query("f03_code_membership", "SELECT p_partkey FROM part WHERE list_has_any(regexp_split_to_array(p_type, '\\s+'), ['BRASS', 'STEEL', 'SMALL'])")
def f03(spark, sf):
    wanted = F.array(*map(F.lit, ("BRASS", "STEEL", "SMALL")))
    return table(spark, sf, "part").where(F.arrays_overlap(F.split("p_type", "\\s+"), wanted)).select("p_partkey")


@query("f04_reject_reasons", "SELECT CASE WHEN value IS NULL THEN 'no value' WHEN event_type = 'error' THEN 'error' WHEN user_id % 10 = 3 THEN 'user' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def f04(spark, sf):
    reason = R.first_failure([("no value", F.col("value").isNull()), ("error", F.col("event_type") == "error"), ("user", F.col("user_id") % 10 == 3)])
    return table(spark, sf, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f05_status_or_allowed", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f05(spark, sf):
    allowed = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("ok"))
    return table(spark, sf, "orders").join(allowed, "o_custkey", "left").where((F.col("o_orderstatus") == "F") | F.coalesce("ok", F.lit(False))).select("o_orderkey")


@query("f06_surface_filter", "WITH s AS (SELECT p_brand, p_type FROM part WHERE NOT regexp_matches(p_type, 'BRASS$') AND NOT (p_brand = 'Brand#11' AND p_type LIKE 'S%')) SELECT p_brand, count(DISTINCT p_type) AS surfaces FROM s GROUP BY ALL")
def f06(spark, sf):
    terms = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("surfaces"))
    junk = lambda s: ~s.rlike("BRASS$") & ~((F.col("p_brand") == "Brand#11") & s.startswith("S"))
    return terms.withColumn("surfaces", F.filter("surfaces", junk)).where(F.size("surfaces") > 0).select("p_brand", F.size("surfaces").cast("long").alias("surfaces"))


@query("f11_funnel", "SELECT * FROM (SELECT 0 AS step, 'all' AS name, count(*) AS n FROM orders UNION ALL SELECT 1, 'final', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 2, 'large', count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 1000) FROM orders UNION ALL SELECT 3, 'window', count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderdate < TIMESTAMP '1998-01-01') FROM orders)")
def f11(spark, sf):
    return R.funnel(table(spark, sf, "orders"), [("final", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 1000), ("window", F.col("o_orderdate") < ts("1998-01-01"))])


@query("f15_new_ids", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')")
def f15(spark, sf):
    lines = table(spark, sf, "lineitem")
    old = lines.where(F.col("l_shipdate") < ts("1996-01-01")).select("l_partkey")
    return lines.where(F.col("l_shipdate") >= ts("2000-01-01")).select("l_partkey").distinct().join(old, "l_partkey", "left_anti")


@query("f17_field_groups", "SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'SMALL%' THEN 'small' ELSE 'others' END AS field, count(*) AS n FROM part GROUP BY ALL")
def f17(spark, sf):
    field = F.when(F.col("p_type").startswith("STANDARD"), "standard").when(F.col("p_type").startswith("SMALL"), "small").otherwise("others")
    return table(spark, sf, "part").groupBy(field.alias("field")).agg(F.count("*").alias("n"))


@query("j01_one_to_one", "SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)")
def j01(spark, sf):
    return R.one_to_one(table(spark, sf, "labels"), table(spark, sf, "documents"), ["doc_id"]).select("doc_id", "quality", "n_chars")


@query("j02_label_attach", "SELECT doc_id, coalesce(toxic = 1, false) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def j02(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("label"))


@query("j03_enrich", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j03(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.enrich(table(spark, sf, "customer"), nation, ["c_nationkey"], "n_name").select("c_custkey", "n_name")


@query("j04_existence_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer")
def j04(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    return table(spark, sf, "customer").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("j05_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01')")
def j05(spark, sf):
    late = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= ts("2000-01-01")))
    return table(spark, sf, "customer").join(late.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j10_bridge_hops", "SELECT r_name, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def j10(spark, sf):
    """Each hop keeps distinct pairs of what follows, so counts are of units and not of paths."""
    where = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    buyers = table(spark, sf, "customer").join(where, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "r_name")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(buyers, "o_custkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(orders, "l_orderkey")
    return rows.groupBy("r_name").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("o_custkey").alias("customers"))


@query("j11_contains_both", "SELECT DISTINCT x.l_orderkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE (x.l_suppkey, y.l_suppkey) IN ((1, 2), (3, 4), (5, 9))")
def j11(spark, sf):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 9)], "p long, q long")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    one = lines.join(F.broadcast(pairs), F.col("l_suppkey") == F.col("p")).select("l_orderkey", "q")
    return one.join(lines.withColumnRenamed("l_suppkey", "q"), ["l_orderkey", "q"]).select("l_orderkey").distinct()


@query("j13_derived_key", "SELECT x.p_partkey AS one, y.p_partkey AS two FROM part x JOIN part y ON array_to_string(list_sort(string_split(lower(x.p_name), ' ')), ' ') = array_to_string(list_sort(string_split(lower(y.p_name), ' ')), ' ') AND x.p_partkey < y.p_partkey WHERE x.p_size = y.p_size")
def j13(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", F.array_join(F.array_sort(F.split(F.lower("p_name"), " ")), " ").alias("key"))
    return R.pairs_within(part, ["key", "p_size"], "p_partkey")


@query("j14_smallest_match", "SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY ALL")
def j14(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))


@query("j15_aligned_frames", "WITH a AS (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (k)")
def j15(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    a, b = (o.where(F.col("o_orderstatus") == s).groupBy("k").agg(F.count("*").alias(n)) for s, n in (("F", "x"), ("O", "y")))
    index = a.select("k").union(b.select("k")).distinct()
    return index.join(a, "k", "left").join(b, "k", "left").fillna(0)


@query("a02_zero_filled_counts", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def a02(spark, sf):
    counts = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return R.zero_filled(table(spark, sf, "nation").select("n_nationkey", "n_name"), counts, ["n_nationkey"], "n").select("n_name", "n")


@query("a03_sorted_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY ALL")
def a03(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("a04_named_aggregates", "SELECT event_type, count(*) AS n, count(value) AS with_value, count(*) FILTER (value > 50) AS large FROM events GROUP BY ALL")
def a04(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count_if(F.col("value") > 50).alias("large"))


@query("a06_having_distinct", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 4")
def a06(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n > 4")


@query("a07_composite_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a07(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("a09_first_row_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def a09(spark, sf):
    return R.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("a10_describe", "SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem")
def a10(spark, sf):
    c = "l_quantity"
    lines = table(spark, sf, "lineitem")
    q = quantiles(lines, [], c, [0.25, 0.5, 0.75]).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))
    rest = lines.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    return rest.join(q)


@query("a11_share_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(avg((o_orderstatus = 'F')::INT), 8) AS share FROM orders GROUP BY ALL")
def a11(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 8).alias("share"))


@query("a12_last_before", "SELECT l_partkey, max(l_shipdate) AS last, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag <> 'R' GROUP BY ALL")
def a12(spark, sf):
    rows = table(spark, sf, "lineitem").where((F.col("l_shipdate") < ts("1998-01-01")) & (F.col("l_returnflag") != "R"))
    return rows.groupBy("l_partkey").agg(F.max("l_shipdate").alias("last"), F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("l_orderkey"))


@query("a13_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1")
def a13(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return R.top_per_group(c, ["user_id"], [F.desc("n"), F.asc("seen")], 1).select("user_id", "event_type", "n")


@query("a14_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY ALL")
def a14(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.fillna(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("a15_nested_weeks", "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM d WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-22' GROUP BY ALL")
def a15(spark, sf):
    """Weekly arrays of seven day counts, summed over a range of days."""
    days = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    weeks = days.withColumn("week", F.date_trunc("week", "day").cast("date")).groupBy("event_type", "week").agg(F.map_from_entries(F.collect_list(F.struct(F.datediff("day", "week").alias("i"), "n"))).alias("m"))
    arrays = weeks.select("event_type", "week", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("days"))
    long = arrays.select("event_type", "week", F.posexplode("days").alias("i", "n")).withColumn("day", F.expr("date_add(week, i)"))
    return long.where((F.col("day") >= "2024-01-08") & (F.col("day") < "2024-01-22")).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("a16_half_over_half", "WITH b AS (SELECT CAST(max(ts) AS DATE) AS e, least(14, CAST((date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1) // 2 AS INTEGER)) AS k FROM events) SELECT event_type, count(*) FILTER (CAST(ts AS DATE) > e - k) AS recent, count(*) FILTER (CAST(ts AS DATE) <= e - k AND CAST(ts AS DATE) > e - 2 * k) AS before FROM events, b GROUP BY ALL")
def a16(spark, sf):
    """Counts of two windows of the largest length, up to 14 days, that the data can fill twice."""
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    b = e.agg(F.max("day").alias("e"), F.least(F.lit(14), F.floor((F.datediff(F.max("day"), F.min("day")) + 1) / 2).cast("int")).alias("k"))
    r = e.join(b)
    recent = F.expr("day > date_sub(e, k)")
    return r.groupBy("event_type").agg(F.count_if(recent).alias("recent"), F.count_if(~recent & F.expr("day > date_sub(e, 2 * k)")).alias("before"))


@query("a17_total_and_strata", "SELECT coalesce(l_returnflag, 'all') AS stratum, count(*) AS n, round(avg(l_discount), 8) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a17(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("mean")).select(F.coalesce("l_returnflag", F.lit("all")).alias("stratum"), "n", "mean")


@query("w02_cumulative_sum", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders")
def w02(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("run"))


@query("w07_equal_bins", "SELECT p_partkey, CAST(ntile(8) OVER (ORDER BY p_retailprice, p_partkey) AS INTEGER) AS bin FROM part")
def w07(spark, sf):
    return equal_bins(table(spark, sf, "part").select("p_partkey", "p_retailprice"), 8, [F.col("p_retailprice"), F.col("p_partkey")], "bin").select("p_partkey", "bin")


@query("o03_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o03(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("o04_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def o04(spark, sf):
    return R.top_per_group(table(spark, sf, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("u02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("u03_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u03(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("u04_except", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40")
def u04(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 40")
    return lines.where("l_returnflag = 'R'").select("l_partkey").subtract(lines.where("l_returnflag = 'A'").select("l_partkey"))


@query("n01_seeded_sample")
def n01(spark, sf):
    return R.seeded_sample(table(spark, sf, "orders"), 100, 42, ["o_orderkey"]).select("o_orderkey")


@query("n02_stratified_sample")
def n02(spark, sf):
    return R.stratified_sample(table(spark, sf, "orders"), "o_orderpriority", "o_custkey", 20, 42, ["o_orderkey"]).select("o_orderpriority", "o_custkey", "o_orderkey")


@query("n03_blind_shuffle")
def n03(spark, sf):
    """Rows under neutral numbers in a seeded order; the key column stays apart in use."""
    rows = R.seeded_sample(table(spark, sf, "labels"), 200, 5, ["doc_id"])
    return rows.select(F.row_number().over(Window.orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id")).alias("item"), "doc_id")


@query("n04_positive_negative_groups", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') > 0 AS positive, count(*) AS n FROM lineitem GROUP BY ALL")
def n04(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.bool_or(F.col("l_returnflag") == "R"), F.lit(False)).alias("positive"), F.count("*").alias("n"))
