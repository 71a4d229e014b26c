"""Acronyms, synonym candidates, guarded sentences and example sentences over the driver's names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acronyms as R
from ..operators import matching as M
from ..operators import vocabulary as V
from .bindings import dealt, table, with_
from .registry import query

#: Part records: full names with a hyphen, a small word or a plural, names whose tokens end in some of their initials.
_FULL = "CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END || CASE WHEN p_partkey % 2 = 0 THEN ' of ' ELSE ' ' END || CASE WHEN p_size % 7 = 0 THEN upper(p_type) ELSE left(p_type, 1) || lower(substr(p_type, 2)) END || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END"
_CAPITALS = "upper(CASE WHEN p_size % 5 = 0 THEN '' ELSE left(p_name, 1) END || left(string_split(p_name, ' ')[2], 1) || CASE WHEN p_partkey % 4 < 2 THEN left(p_type, 1) ELSE '' END)"
RECORDS = f"rec AS (SELECT DISTINCT 'b' || substr(p_brand, 7) || CASE WHEN p_size % 4 = 0 THEN 'X' ELSE '-' END || {_CAPITALS} || ' ' || string_split(p_name, ' ')[1] AS name, {_FULL} AS full_name FROM part)"
_CHOICES = "CASE WHEN contains(w, '-') THEN [upper(w[1]), upper(w[1] || string_split(w, '-')[2][1])] WHEN w = 'of' THEN ['O', ''] ELSE [upper(w[1])] END"


def _records(spark, sf):
    part = table(spark, sf, "part")
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    words = F.split("p_name", " ")
    typed = F.when(size % 7 == 0, F.upper(kind)).otherwise(F.concat(F.substring(kind, 1, 1), F.lower(F.substring("p_type", 2, 100))))
    full = F.concat(F.when(key % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name")), F.when(key % 2 == 0, " of ").otherwise(" "), typed, F.when(size % 2 == 0, "s").otherwise(""))
    capitals = F.upper(F.concat(F.when(size % 5 == 0, "").otherwise(F.substring("p_name", 1, 1)), F.substring(F.get(words, 1), 1, 1), F.when(key % 4 < 2, F.substring("p_type", 1, 1)).otherwise("")))
    name = F.concat(F.lit("b"), F.substring("p_brand", 7, 10), F.when(size % 4 == 0, "X").otherwise("-"), capitals, F.lit(" "), F.get(words, 0))
    return part.select(name.alias("name"), full.alias("full_name")).distinct()


@query("t13_initial_variants", f"WITH RECURSIVE {RECORDS}, f AS (SELECT DISTINCT full_name, string_split(full_name, ' ') AS ws FROM rec), o AS (SELECT full_name, i, unnest({_CHOICES}) AS c FROM (SELECT full_name, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM f)), v AS (SELECT full_name, 1 AS i, c AS a FROM o WHERE i = 1 UNION SELECT v.full_name, o.i, a || c FROM v JOIN o ON o.full_name = v.full_name AND o.i = v.i + 1) SELECT DISTINCT v.full_name, a AS variant FROM v JOIN f ON f.full_name = v.full_name WHERE v.i = len(ws) AND a <> ''")
def t13(spark, sf):
    names = _records(spark, sf).select("full_name").distinct()
    return names.select("full_name", F.explode(R.initial_variants(F.col("full_name"))).alias("variant"))


@query(
    "t14_restored_composites",
    f"WITH RECURSIVE {RECORDS}, f AS (SELECT DISTINCT full_name, string_split(full_name, ' ') AS ws FROM rec), w AS (SELECT full_name, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM f), o AS (SELECT full_name, i, w, unnest({_CHOICES}) AS c FROM w), "
    "v AS (SELECT full_name, i AS b, i AS e, c AS a FROM o WHERE w <> 'of' UNION SELECT v.full_name, v.b, o.i, a || c FROM v JOIN o ON o.full_name = v.full_name AND o.i = v.e + 1 WHERE o.i - v.b < 8), "
    "s AS (SELECT DISTINCT v.full_name, b, e, a, array_to_string(ws[b:e], ' ') AS span FROM v JOIN f ON f.full_name = v.full_name WHERE ws[e] <> 'of'), "
    "t AS (SELECT DISTINCT full_name, token, regexp_extract(token, '[A-Z]+$') AS tail FROM (SELECT full_name, unnest(string_split(name, ' ')) AS token FROM rec) WHERE regexp_matches(token, '[A-Z]$')), "
    "m AS (SELECT t.full_name, token, a, e, span FROM t JOIN s ON s.full_name = t.full_name AND length(a) >= 2 AND ends_with(tail, a) WHERE upper(span) <> span), "
    "k AS (SELECT DISTINCT token, a AS acronym, replace(lower(span), '-', ' ') AS x FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.full_name = m.full_name AND n.token = m.token AND n.e = m.e AND length(n.a) > length(m.a))), "
    "z AS (SELECT DISTINCT token, acronym, CASE WHEN ends_with(x, 's') AND length(string_split(x, ' ')[-1]) > 4 THEN left(x, -1) ELSE x END AS expansion FROM k) "
    "SELECT acronym, expansion, count(*) AS support FROM z WHERE acronym NOT IN ('RR', 'BB') AND expansion NOT IN (SELECT p_name FROM part WHERE p_size = 1) GROUP BY ALL HAVING count(*) >= 3",
)
def t14(spark, sf):
    """Acronyms of part records of at least three tokens; two are surfaces already, as are the names of the smallest parts."""
    surfaces = spark.createDataFrame([("RR",), ("BB",)], "text string").unionAll(table(spark, sf, "part").where("p_size = 1").select("p_name"))
    return R.restored(_records(spark, sf), surfaces, 2, 3).drop("tokens")


def part_terms(spark, sf):
    """(names, words, inc): part names and their words as terms, and the orders that hold them."""
    part = table(spark, sf, "part")
    names = part.groupBy(F.col("p_name").alias("key")).agg(F.concat(F.lit("M:"), F.min("p_partkey").cast("string")).alias("term_id")).select("term_id", "key")
    words = names.select(F.explode(F.split("key", " ")).alias("key")).distinct().select(F.concat(F.lit("W:"), "key").alias("term_id"), "key")
    # a part gets its two terms before it meets its lines: names are few and common, so lines are not dealt by them
    of_part = part.select("p_partkey", F.col("p_name").alias("key")).join(names, "key").select("p_partkey", F.array("term_id", F.concat(F.lit("W:"), F.get(F.split("key", " "), 0))).alias("ts"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey")).join(of_part, "p_partkey").select("paper_id", "ts")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("first_date"))
    lines, orders = dealt(lines, orders, "paper_id")
    inc = lines.join(orders, "paper_id").select("paper_id", "first_date", F.explode("ts").alias("term_id")).distinct()
    return names, words, inc


_TERMS = "nm AS (SELECT 'M:' || min(p_partkey) AS id, p_name AS key, string_split(p_name, ' ') AS w FROM part GROUP BY p_name), wd AS (SELECT DISTINCT 'W:' || u AS id, u AS key, [u] AS w FROM (SELECT unnest(w) AS u FROM nm)), tm AS (SELECT * FROM nm UNION ALL SELECT * FROM wd)"


@query(
    "j13_candidate_pairs",
    with_(_TERMS, "ip AS (SELECT DISTINCT l_orderkey AS p, id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN nm ON key = p_name UNION SELECT DISTINCT l_orderkey, 'W:' || string_split(p_name, ' ')[1] FROM lineitem JOIN part ON p_partkey = l_partkey)", "n AS (SELECT CAST(count(DISTINCT p) AS DOUBLE) AS n FROM ip)", "dc AS (SELECT id, count(*) AS d FROM ip GROUP BY id)", "mt AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM ip x JOIN ip y ON x.p = y.p AND x.id < y.id GROUP BY ALL)", "np AS (SELECT a, b, c, CASE WHEN c >= n THEN 1.0 ELSE ln((c / n) / ((x.d / n) * (y.d / n))) / -ln(c / n) END AS npmi FROM mt JOIN dc x ON x.id = a JOIN dc y ON y.id = b, n)", "fd AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, 'initials' AS rule FROM nm x JOIN nm y ON x.w[1][1] || x.w[2][1] = y.w[1][1] || y.w[2][1] AND x.id <> y.id UNION SELECT a, b, 'cooccurrence' FROM np WHERE c >= 10 AND npmi >= 0.02)")
    + "SELECT fd.a, fd.b, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules, coalesce(any_value(c), 0) AS meetings, round(any_value(npmi), 8) AS npmi FROM fd LEFT JOIN np ON np.a = fd.a AND np.b = fd.b WHERE NOT EXISTS (SELECT 1 FROM tm s JOIN tm l ON list_has_all(l.w, s.w) AND len(list_distinct(s.w)) < len(list_distinct(l.w)) WHERE least(s.id, l.id) = fd.a AND greatest(s.id, l.id) = fd.b) GROUP BY ALL",
)
def j13(spark, sf):
    """Part names and their words as terms that meet in orders; a name and a word of it meet often, but are no candidates."""
    names, words, inc = part_terms(spark, sf)
    initials = F.upper(F.concat(F.substring("key", 1, 1), F.substring(F.get(F.split("key", " "), 1), 1, 1)))
    surfaces = names.select("term_id", F.col("key").alias("text"), F.lit("ci").alias("mode")).unionAll(names.select("term_id", initials, F.lit("cs"))).unionAll(words.select("term_id", "key", F.lit("ci")))
    found = V.candidate_pairs(names.unionAll(words), surfaces, inc, [], 3, 1, 10, 0.02)
    return found.select("a", "b", F.array_join("rules", ",").alias("rules"), "meetings", F.round("npmi", 8).alias("npmi"))


#: Words that end sentences of the corpus, taken as abbreviations, so that the guard has something to do.
ABBREVIATIONS = ["the.", "la.", "al.", "In an. E."]


@query("t06_guarded_sentences", "SELECT doc_id, len(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(the|la|al)\\.', '\\1' || chr(2), 'g'), '([.!?])[ \\t\\n\\x0b\\f\\r]+([A-Z0-9\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentences FROM documents")
def t06(spark, sf):
    return M.sentences(table(spark, sf, "documents"), "doc_id", "text", ABBREVIATIONS, "A-Z0-9\"'(").groupBy("doc_id").agg(F.count("*").alias("sentences"))


def dictionary(spark, sf):
    """Words of at least three benchmark items as surfaces, with their capitalised forms compared by case."""
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("w"))
    known = words.groupBy("w").agg(F.count_distinct("item_id").alias("n")).where("n >= 3")
    ci = known.select(F.concat(F.lit("T:"), "w").alias("term_id"), F.col("w").alias("text"), F.lit("ci").alias("mode"))
    return ci.unionAll(known.where("n >= 6").select(F.concat(F.lit("M:"), "w"), F.initcap("w"), F.lit("cs")))


@query("t19_surface_examples")
def t19(spark, sf):
    """Three sentences of every surface of the dictionary that stands in a document, with how many there are."""
    return M.example_sentences(table(spark, sf, "documents"), dictionary(spark, sf), "doc_id", "text", 3, 5, ABBREVIATIONS)
