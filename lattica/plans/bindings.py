"""How the operators' roles are played by the driver's tables: papers are orders, terms suppliers or parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Precision per stratum (key modulo 3).
STRATA = ((0, 0.745), (1, 0.863), (2, 0.826))
LINES_PER_TASK = 250_000
BUILD_END, LABEL_START = "1998-01-01", "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(lines: DataFrame, orders: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by ``key``: tasks get a number of lines and are not merged. Small tables stay as they are."""
    n = -(-lines.count() // LINES_PER_TASK)
    if n <= lines.sparkSession.sparkContext.defaultParallelism:
        return lines, orders
    return lines.repartition(n, key), orders.repartition(n, key)


def incidence(spark: SparkSession, sf_dir: str, term: str = "supplier", window: str | None = "build") -> DataFrame:
    """paper_id, term_id, first_date: distinct (order, term) of a window (build, label, or all)."""
    key = {"supplier": "l_suppkey", "part": "l_partkey"}[term]
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("first_date"))
    if window == "build":
        orders = orders.where(F.col("first_date") < F.lit(BUILD_END).cast("timestamp"))
    elif window == "label":
        orders = orders.where(F.col("first_date") >= F.lit(LABEL_START).cast("timestamp"))
    kind = F.when(F.col(key) % 2 == 0, "M:").otherwise("T:")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat(kind, F.col(key).cast("string")).alias("term_id"))
    # pairs and triples grow from a paper's terms within its task
    lines, orders = dealt(lines, orders, "paper_id")
    return lines.join(orders, "paper_id").distinct()


def precisions(terms: DataFrame) -> DataFrame:
    """term_id, pi by the fixed strata."""
    number = F.substring("term_id", 3, 20).cast("long") % 3
    pi = F.lit(None).cast("double")
    for r, v in STRATA:
        pi = F.when(number == r, F.lit(v)).otherwise(pi)
    return terms.select("term_id").distinct().withColumn("pi", pi)


def sql_incidence(name: str = "inc", term: str = "supplier", window: str | None = "build") -> str:
    """The same table as a DuckDB common table expression."""
    key = {"supplier": "l_suppkey", "part": "l_partkey"}[term]
    where = {"build": f"WHERE o_orderdate < TIMESTAMP '{BUILD_END}'", "label": f"WHERE o_orderdate >= TIMESTAMP '{LABEL_START}'", None: ""}[window]
    return (
        f"{name} AS (SELECT DISTINCT l_orderkey AS paper_id, CASE WHEN {key} % 2 = 0 THEN 'M:' ELSE 'T:' END || CAST({key} AS VARCHAR) AS term_id, "
        f"o_orderdate AS first_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey {where})"
    )


def sql_pairs(name: str = "pc", source: str = "inc") -> str:
    return (
        f"{name} AS (SELECT x.term_id AS a, y.term_id AS b, count(*) AS cnt FROM {source} x JOIN {source} y "
        "ON x.paper_id = y.paper_id AND x.term_id < y.term_id GROUP BY ALL)"
    )


def sql_triples(name: str = "tc", source: str = "inc") -> str:
    return (
        f"{name} AS (SELECT x.term_id AS a, y.term_id AS b, z.term_id AS c, count(*) AS cnt FROM {source} x "
        f"JOIN {source} y ON x.paper_id = y.paper_id AND x.term_id < y.term_id "
        f"JOIN {source} z ON x.paper_id = z.paper_id AND y.term_id < z.term_id GROUP BY ALL)"
    )


def sql_pi(name: str = "pi", source: str = "inc") -> str:
    cases = " ".join(f"WHEN {r} THEN CAST({v} AS DOUBLE)" for r, v in STRATA)
    return f"{name} AS (SELECT DISTINCT term_id, CASE CAST(substr(term_id, 3) AS BIGINT) % 3 {cases} END AS pi FROM {source})"


NOT_ALL_TASKS = "NOT (a LIKE 'T:%' AND b LIKE 'T:%' AND c LIKE 'T:%')"


def sql_open(name: str = "ot", stable: str = "st", closed: str = "tc") -> str:
    return (
        f"{name} AS (SELECT e.a, e.b, f.b AS c, least(e.cnt, f.cnt, g.cnt) AS weakest_pair_count FROM {stable} e "
        f"JOIN {stable} f ON f.a = e.b JOIN {stable} g ON g.a = e.a AND g.b = f.b "
        f"WHERE NOT EXISTS (SELECT 1 FROM {closed} t WHERE t.a = e.a AND t.b = e.b AND t.c = f.b))"
    )


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
