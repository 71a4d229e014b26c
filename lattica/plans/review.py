"""Review, classification and linking queries, and the two SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as V
from ..operators.relational import until_first_hit
from .bindings import table
from .registry import query


@query("q01_package_linking_sql", "WITH x AS (SELECT p_partkey, unnest([lower(p_brand), 'https://x.org/' || lower(p_type)]) AS url FROM part) SELECT regexp_extract(url, '([a-z]+)', 1) AS name, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS n FROM x WHERE url NOT LIKE '%#1%' GROUP BY ALL")
def q01(spark, sf):
    """UNNEST of a built array with extraction and bounds, as parameterised SQL."""
    text = """
        SELECT regexp_extract(url, '([a-z]+)', 1) AS name, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS n
        FROM {part} LATERAL VIEW explode(concat(array(lower(p_brand)), array(concat('https://x.org/', lower(p_type))))) AS url
        WHERE NOT contains(url, :skip) GROUP BY 1
    """
    return spark.sql(text, args={"skip": "#1"}, part=table(spark, sf, "part"))


@query("q02_half_windows_sql", "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before FROM events GROUP BY ALL")
def q02(spark, sf):
    text = "SELECT event_type, count_if(ts >= :middle) AS recent, count_if(ts < :middle) AS before FROM {events} GROUP BY event_type"
    import datetime

    return spark.sql(text, args={"middle": datetime.datetime(2024, 1, 16, tzinfo=datetime.timezone.utc)}, events=table(spark, sf, "events"))


@query("r01_sheet_validation", "SELECT doc_id, 'value of lang' AS problem FROM documents WHERE doc_id % 3 = 0 AND lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'changed source' FROM documents WHERE doc_id % 9 = 0 AND source <> 'src0'")
def r01(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    sheet = docs.where("doc_id % 3 = 0").withColumn("source", F.when(F.col("doc_id") % 9 == 0, "src0").otherwise(F.col("source")))
    return V.validate_sheet(sheet, docs, "doc_id", ["source"], {"lang": ["en", "de"]})


@query("r02_classifier_labels", "WITH o AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_returnflag = 'R' THEN 'combination' ELSE 'other' END AS r FROM lineitem) SELECT l_orderkey, count(r) AS n_classified, count(*) FILTER (r = 'combination') AS n_combination, CASE WHEN count(*) FILTER (r = 'combination') >= 1 THEN true WHEN count(r) = count(*) THEN false END AS label FROM o GROUP BY ALL")
def r02(spark, sf):
    relation = F.when(F.col("l_linenumber") % 4 != 3, F.when(F.col("l_returnflag") == "R", "combination").otherwise("other"))
    return V.label_table(table(spark, sf, "lineitem").withColumn("relation", relation), ["l_orderkey"], 1)


@query("r03_roles_to_relation", "WITH r AS (SELECT l_orderkey, list(CASE WHEN l_returnflag = 'R' THEN 'used' WHEN l_returnflag = 'A' THEN 'baseline' ELSE 'mentioned' END) AS roles FROM lineitem GROUP BY ALL) SELECT l_orderkey, CASE WHEN len(list_filter(roles, lambda x: x = 'used')) >= 2 THEN 'combination' WHEN len(list_filter(roles, lambda x: x <> 'baseline')) = 0 THEN 'comparison' ELSE 'other' END AS relation FROM r")
def r03(spark, sf):
    role = F.when(F.col("l_returnflag") == "R", "used").when(F.col("l_returnflag") == "A", "baseline").otherwise("mentioned")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(role).alias("roles")).select("l_orderkey", V.relation_of_roles(F.col("roles")).alias("relation"))


@query("r04_early_stop", "WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM lineitem) SELECT l_orderkey, count(*) AS asked FROM h WHERE h = 0 GROUP BY ALL")
def r04(spark, sf):
    order = [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    kept = until_first_hit(table(spark, sf, "lineitem"), ["l_orderkey"], order, F.col("l_returnflag") == "R")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("asked"))


@query("r06_bundles", "WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders QUALIFY i <= 3) SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY i), ',') AS orders FROM t GROUP BY ALL")
def r06(spark, sf):
    b = V.bundle(table(spark, sf, "orders"), ["o_custkey"], "orders", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, ["o_orderkey", "o_totalprice"])
    return b.select("o_custkey", F.array_join(F.transform("orders", lambda s: s["o_orderkey"].cast("string")), ",").alias("orders"))


@query("r07_allowed_ids", "WITH o AS (SELECT l_orderkey, list(l_suppkey) AS ids FROM lineitem GROUP BY ALL) SELECT l_orderkey, len(list_filter(ids, lambda x: x > 50)) = 0 AS valid FROM o")
def r07(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))
    return o.select("l_orderkey", F.forall("ids", lambda x: x <= 50).alias("valid"))


@query("r09_rule_flags", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN 'late' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END) AS flags FROM orders")
def r09(spark, sf):
    rules = {"large": F.col("o_totalprice") > 200000, "late": F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp"), "open": F.col("o_orderstatus") == "P"}
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(V.flags(rules), ",").alias("flags"))


@query("r10_agreement_by_field", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER ((quality = 1) = (n_chars > 600)) AS agree FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def r10(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) == (F.col("n_chars") > 600)).alias("agree"))


@query("r10_agreement_table", "WITH j AS (SELECT lang, quality = 1 AS h, n_chars > 600 AS r FROM labels JOIN documents USING (doc_id)), g AS (SELECT lang, count(*) AS n, count(*) FILTER (h AND r) AS both_yes, count(*) FILTER (h AND NOT r) AS human_only, count(*) FILTER (NOT h AND r) AS rule_only, count(*) FILTER (NOT h AND NOT r) AS neither FROM j GROUP BY ALL), w AS (SELECT *, (both_yes + human_only) / n AS p, 1.959963984540054::DOUBLE AS z FROM g) SELECT lang, n, both_yes, human_only, rule_only, neither, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 8) AS lower, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) >= 0.8 AS passes FROM w")
def r10t(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("lang", (F.col("quality") == 1).alias("h"), (F.col("n_chars") > 600).alias("r"))
    return V.agreement(rows, "h", "r", ["lang"], 0.8).select("lang", "n", "both_yes", "human_only", "rule_only", "neither", F.round("lower", 8).alias("lower"), "passes")


@query("r05_classifier_inputs", "SELECT l_orderkey, any_value(o_orderpriority) AS priority, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS terms FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def r05(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    out = V.records(lines, ["l_orderkey"], ["l_suppkey"], ["o_orderpriority"])
    return out.select("l_orderkey", F.col("text.o_orderpriority").alias("priority"), F.array_join(F.transform("terms", lambda t: t["l_suppkey"].cast("string")), ",").alias("terms"))


@query("r06_bundles_of_sources", "WITH t AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3), s AS (SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey) <= 2), a AS (SELECT o_custkey, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT c_custkey, count(*) AS n, min(s_suppkey) AS low FROM s GROUP BY ALL) SELECT customer.c_custkey, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS suppliers, low FROM customer LEFT JOIN a ON a.o_custkey = customer.c_custkey LEFT JOIN b ON b.c_custkey = customer.c_custkey")
def r06s(spark, sf):
    """Each customer with their largest orders and the richest suppliers of their nation."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    best = V.bundle(orders, ["c_custkey"], "orders", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, ["o_orderkey"])
    suppliers = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    near = V.bundle(suppliers, ["c_nationkey"], "suppliers", [F.desc("s_acctbal"), F.asc("s_suppkey")], 2, ["s_suppkey"])
    near = customers.join(near, "c_nationkey").select("c_custkey", "suppliers")
    out = V.bundles(customers, [best, near], ["c_custkey"])
    low = F.array_min(F.transform("suppliers", lambda s: s["s_suppkey"]))
    return out.select("c_custkey", F.size("orders").cast("long").alias("orders"), F.size("suppliers").cast("long").alias("suppliers"), low.alias("low"))
