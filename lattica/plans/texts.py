"""Text, dictionary and name queries over documents, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import matching as M
from .bindings import table
from .registry import query


def vocabulary(spark):
    """Frequent function words of the corpus and two phrases, as a dictionary."""
    rows = [("T:the", "the", "ci"), ("T:of", "of", "ci"), ("M:ofthe", "of the", "ci"), ("M:and", "and", "ci"), ("M:gnu", "GNU General Public License", "cs"), ("T:la", "la", "ci"), ("T:la2", "La", "ci"), ("M:in", "In", "cs")]
    return spark.createDataFrame(rows, "term_id string, text string, mode string")


@query("t01_normalise", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' - ' || p_brand || '.'), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .,;:') AS name FROM part")
def t01(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.normalised(F.concat("p_type", F.lit(" - "), "p_brand", F.lit("."))).alias("name"))


@query("t01_normalise_unicode")
def t01u(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.normalised(F.col("text"), unicode_form=True).alias("name"))


@query("t02_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS n, list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: length(t)), 'sum') AS chars FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]')")
def t02(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike("[A-Za-z0-9]"))
    length = F.aggregate(F.transform(fn.tokens(F.col("text"), False), lambda t: F.length(t)), F.lit(0), lambda s, x: s + x)
    return d.select("doc_id", F.size(fn.tokens(F.col("text"))).cast("long").alias("n"), length.cast("long").alias("chars"))


@query("t03_matcher")
def t03(spark, sf):
    return M.match(table(spark, sf, "documents"), vocabulary(spark), "doc_id", "text").groupBy("term_id", "mode").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("t04_unigram_matches", "SELECT DISTINCT doc_id, t AS term_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) WHERE t IN ('the', 'of', 'and', 'la', 'der')")
def t04(spark, sf):
    rows = [(w, w, "ci") for w in ("the", "of", "and", "la", "der")]
    d = spark.createDataFrame(rows, "term_id string, text string, mode string")
    return M.match(table(spark, sf, "documents"), d, "doc_id", "text").select("doc_id", "term_id").distinct()


@query("t05_refined_spans")
def t05(spark, sf):
    spans = M.match(table(spark, sf, "documents"), vocabulary(spark), "doc_id", "text")
    only = spark.createDataFrame([("M:gnu",)], "term_id string")
    return M.refine(spans, "doc_id", only).groupBy("term_id").agg(F.count("*").alias("n"))


@query("t06_sentences", "SELECT doc_id, len(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0b\\f\\r]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentences FROM documents")
def t06(spark, sf):
    return M.sentences(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query("t08_window_evidence")
def t08(spark, sf):
    s = M.sentences(table(spark, sf, "documents"), "doc_id", "text")
    s = s.withColumn("terms", F.array_distinct(fn.tokens(F.col("sentence"))))
    return M.window_evidence(s, "doc_id", ["the", "of", "with"], 2, M.cue_pattern(["compared with", "versus"]))


@query("t09_label_table", "SELECT l_suppkey, count(*) AS n_papers, count(*) FILTER (l_returnflag = 'R') AS n_evidence, count(*) FILTER (l_returnflag = 'R') >= 5 AS label FROM lineitem GROUP BY ALL")
def t09(spark, sf):
    e = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_papers"), e.alias("n_evidence"), (e >= 5).alias("label"))


@query("t10_numbers_in_text")
def t10(spark, sf):
    found = F.regexp_extract_all("text", F.lit("(?<![\\w.])(\\d+(?:\\.\\d+)?)(?![\\w]|\\.\\d)"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.transform(found, lambda x: x.cast("double")).alias("numbers")).where(F.size("numbers") > 0).select("doc_id", F.size("numbers").alias("n"), F.array_max("numbers").alias("largest"))


@query("t11_spam", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(!!.*){3}') OR regexp_matches(text, '(?i)licensed under')")
def t11(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").where(t.rlike("(!!.*){3}") | t.rlike("(?i)licensed under")).select("doc_id")


@query("t12_letters_and_brackets", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS code, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS letters FROM part")
def t12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("code"), F.regexp_replace("p_brand", "[^A-Za-z]", "").alias("letters"))


@query("t15_plural_merge", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), e AS (SELECT w, left(w, -2) AS k FROM w WHERE w LIKE '%es'), s AS (SELECT w, left(w, -1) AS k FROM w WHERE w LIKE '%s'), m AS (SELECT e.w AS plural, e.k AS singular, 1 AS rank FROM e JOIN w ON w.w = e.k UNION ALL SELECT s.w, s.k, 2 FROM s JOIN w ON w.w = s.k) SELECT plural, arg_min(singular, rank) AS singular FROM m GROUP BY plural")
def t15(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("plural")).distinct()
    stems = words.select(F.col("plural").alias("s"))
    cut = lambda n: F.expr(f"substring(plural, 1, length(plural) - {n})")
    es = words.where(F.col("plural").endswith("es")).withColumn("s", cut(2)).join(stems, "s").select("plural", F.col("s").alias("x"))
    s = words.where(F.col("plural").endswith("s")).withColumn("s", cut(1)).join(stems, "s").select("plural", F.col("s").alias("y"))
    return words.join(es, "plural", "left").join(s, "plural", "left").select("plural", F.coalesce("x", "y").alias("singular")).where("singular IS NOT NULL")


@query("t18_stems", "SELECT DISTINCT w, CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, -3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, -2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)")
def t18(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    return w.select("w", fn.stem(F.col("w")).alias("stem"))


@query("t20_repository", "WITH u AS (SELECT page_id, 'https://github.com/Own' || (page_id % 7) || '/Repo.' || (page_id % 3) || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '/tree/main' END AS url FROM pages) SELECT page_id, regexp_replace(regexp_extract(lower(url), 'github\\.com/([^/\\s?#]+/[^/\\s?#]+)', 1), '\\.git$', '') AS repo FROM u")
def t20(spark, sf):
    i = F.col("page_id")
    url = F.concat(F.lit("https://github.com/Own"), (i % 7).cast("string"), F.lit("/Repo."), (i % 3).cast("string"), F.when(i % 2 == 0, ".git").otherwise("/tree/main"))
    return table(spark, sf, "pages").select("page_id", fn.repository(url).alias("repo"))


@query("t21_package_names", "SELECT DISTINCT regexp_replace(lower(p_brand || '_.' || p_type), '[-_.]+', '-', 'g') AS name FROM part")
def t21(spark, sf):
    return table(spark, sf, "part").select(fn.package_name(F.concat("p_brand", F.lit("_."), "p_type")).alias("name")).distinct()


@query("t22_rule_classifier", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)\\b(brass|copper)\\b') THEN 'metal-a' WHEN regexp_matches(p_type, '(?i)\\bsteel\\b') THEN 'metal-b' WHEN regexp_matches(p_type, '(?i)\\b(small|medium)\\b') THEN 'size' ELSE 'other' END AS class FROM part")
def t22(spark, sf):
    whole = lambda words: F.col("p_type").rlike(f"(?i)(?<!\\w)(?:{'|'.join(words)})(?!\\w)")
    c = F.when(whole(["brass", "copper"]), "metal-a").when(whole(["steel"]), "metal-b").when(whole(["small", "medium"]), "size").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", c.alias("class"))


@query("t23_display_name", "WITH c AS (SELECT o_custkey, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, name FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, name) = 1")
def t23(spark, sf):
    from ..operators.relational import top_per_group

    c = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    return top_per_group(c, ["o_custkey"], [F.desc("n"), F.asc("name")], 1).select("o_custkey", "name")


@query("t25_shards")
def t25(spark, sf):
    return table(spark, sf, "orders").groupBy(fn.shard(F.col("o_orderkey"), 8, "salt:").alias("part")).agg(F.count("*").alias("n"))
