"""Vocabulary rules: junk names, acronyms, plurals, shared surfaces, synonym pairs, common words.

Terms are rows of (term_id, key, type), surfaces rows of (term_id, text, mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hypergraph import connected_groups, hyperedges, pair_counts, pair_npmi, term_counts
from .matching import mode_tokens

# Signs of advertising in names.
STRUCTURE = (
    "(?i)[?¿{}【】〗™®☎]|\\[\\[|\\d{6,}|\\d{3}\\D{1,3}\\d{3}\\D{1,3}\\d{4}"
    "|^[^A-Za-z]*(?:how|what|who|does|do|can|is|are|why|where|when)\\b|[\\x{10000}-\\x{10FFFF}]"
)


# A name with something in parentheses at its end, and an acronym.
PARENTHESIS = "^(.+?)\\s*\\(([^()]*)\\)\\s*$"
ACRONYM = "^[A-Z][A-Z0-9\\-.]*$"


def is_spam(text: Column, keywords: list[str] | None = None) -> Column:
    """Structural signs, a symbol of the Unicode class So, or (for names that may be overwritten) a keyword as a word."""
    bad = text.rlike(STRUCTURE) | text.rlike("\\p{So}")
    return bad | text.rlike(f"(?i)\\b(?:{'|'.join(keywords)})\\b") if keywords else bad


def split_parenthesis(text: Column) -> tuple[Column, Column]:
    """(name before a closing parenthesis, what it holds); the text itself and null where there is none."""
    inside = F.trim(text).rlike(PARENTHESIS)
    return F.when(inside, F.regexp_extract(F.trim(text), PARENTHESIS, 1)).otherwise(text), F.when(inside, F.trim(F.regexp_extract(F.trim(text), PARENTHESIS, 2)))


def is_acronym(text: Column) -> Column:
    return text.rlike(ACRONYM)


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def plural_targets(terms: DataFrame) -> DataFrame:
    """(term_id, target): terms whose key without es, else without s, is the key of another term of the same type."""
    own = terms.select(F.col("term_id").alias("target"), F.col("key").alias("stem"), "type")
    cuts = F.array(*(F.when(F.col("key").endswith(c) & (F.length("key") > len(c) + 3), F.struct(F.lit(i).alias("i"), F.col("key").substr(F.lit(1), F.length("key") - len(c)).alias("stem"))) for i, c in enumerate(("es", "s"))))
    tried = terms.select("term_id", "type", F.explode(F.array_compact(cuts)).alias("t")).select("term_id", "type", "t.*")
    return tried.join(own, ["stem", "type"]).groupBy("term_id").agg(F.min_by("target", "i").alias("target"))


def resolve_shared(surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surfaces under their heads, merges): a ``cs`` surface of several terms is dropped, terms that share a ``ci`` one
    are merged; the head is the smallest task id, else the smallest id. Merges are rows (term_id, head)."""
    owners = surfaces.groupBy("text", "mode").agg(F.array_sort(F.collect_set("term_id")).alias("ts"))
    links = owners.where("mode = 'ci' AND size(ts) > 1").select(F.col("ts")[0].alias("a"), F.explode(F.slice("ts", 2, 2**30)).alias("b"))
    groups = connected_groups(links).withColumnsRenamed({"term": "term_id", "head": "group"})
    rank = F.struct((~F.col("term_id").startswith("T:")).alias("method"), F.col("term_id").alias("id"))
    heads = groups.groupBy("group").agg(F.min(rank).alias("m")).select("group", F.col("m.id").alias("head"))
    merges = groups.join(heads, "group").select("term_id", "head")
    kept = surfaces.join(owners.where("mode = 'cs' AND size(ts) > 1").select("text", "mode"), ["text", "mode"], "left_anti")
    named = kept.join(merges, "term_id", "left").select(F.coalesce("head", "term_id").alias("term_id"), "text", "mode").distinct()
    return named, merges.where("term_id <> head")


def word_set(name: Column, suffixes: list[str], least: int) -> Column:
    """Sorted distinct words without the first of ``suffixes`` that leaves at least ``least`` letters."""

    def stem(w: Column) -> Column:
        out = w
        for s in reversed(suffixes):
            out = F.when(w.endswith(s) & (F.length(w) - len(s) >= least), w.substr(F.lit(1), F.length(w) - len(s))).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.transform(mode_tokens(name, "ci"), stem)))


def _pairs(rows: DataFrame, rule: str) -> DataFrame:
    """Pairs a < b of the terms that share ``k``."""
    x, y = (rows.select("k", F.col("term_id").alias(n)).distinct() for n in "ab")
    return x.join(y, "k").where("a < b").select("a", "b", F.lit(rule).alias("rule"))


def synonym_pairs(terms: DataFrame, surfaces: DataFrame, suffixes: list[str], least: int, longest_acronym: int) -> DataFrame:
    """(a, b, rules): pairs by one form without spaces and hyphens, by one set of words, or by an acronym that has the
    initials of the other's name. All joins are on a derived key."""
    ci = surfaces.where("mode = 'ci'").select("term_id", mode_tokens(F.col("text"), "ci").alias("ws"), F.regexp_replace(F.lower("text"), "[\\s\\-_/]+", "").alias("form"))
    forms = _pairs(ci.select("term_id", F.col("form").alias("k")), "form")
    words = _pairs(terms.select("term_id", F.concat_ws(" ", word_set(F.col("key"), suffixes, least)).alias("k")), "same_words")
    initials = ci.where(F.size("ws") >= 2).select("term_id", F.array_join(F.transform("ws", lambda w: w.substr(1, 1)), "").alias("k"))
    name = F.lower(F.col("key"))
    short = surfaces.where("mode = 'cs'").select("term_id", F.lower("text").alias("k"))
    short = short.unionAll(terms.where(name.rlike("^\\p{L}+$") & (F.length("key") <= longest_acronym)).select("term_id", name.alias("k")))
    met = short.select("k", F.col("term_id").alias("x")).join(initials.select("k", F.col("term_id").alias("y")), "k").where("x <> y")
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("initials").alias("rule"))
    return forms.unionAll(words).unionAll(met).groupBy("a", "b").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def contained_names(terms: DataFrame, suffixes: list[str], least: int) -> DataFrame:
    """(small, large): terms whose words are a proper subset of the other's. Terms meet at the smaller one's rarest word,
    which the larger one must hold, so no pair without a common word is looked at."""
    sets = terms.select("term_id", word_set(F.col("key"), suffixes, least).alias("ws")).where(F.size("ws") > 0)
    each = sets.select("term_id", "ws", F.explode("ws").alias("w"))
    rare = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy(F.col("term_id").alias("small"), F.col("ws").alias("few")).agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    met = rare.join(each.withColumnsRenamed({"term_id": "large", "ws": "many"}), "w")
    return met.where((F.size("few") < F.size("many")) & (F.size(F.array_except("few", "many")) == 0)).select("small", "large")


def candidate_pairs(terms: DataFrame, surfaces: DataFrame, inc: DataFrame, suffixes: list[str], least: int, longest_acronym: int, meetings: int, npmi_min: float) -> DataFrame:
    """(a, b, rules, meetings, npmi): ``synonym_pairs`` and pairs that meet in at least ``meetings`` papers at ``npmi_min`` or more,
    without those of which one name holds all words of the other. ``inc``: paper_id, term_id; pairs that never meet have 0 and null.
    """
    edges = hyperedges(inc)
    counts = pair_counts(edges).join(edges.agg(F.count("*").cast("double").alias("_n")))
    met = pair_npmi(counts, term_counts(inc), F.col("_n")).select("a", "b", F.col("cnt").alias("meetings"), "npmi")
    often = met.where((F.col("meetings") >= meetings) & (F.col("npmi") >= npmi_min)).select("a", "b", F.array(F.lit("cooccurrence")).alias("rules"))
    found = synonym_pairs(terms, surfaces, suffixes, least, longest_acronym).unionByName(often)
    found = found.groupBy("a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))
    held = contained_names(terms, suffixes, least).select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"))
    return found.join(held, ["a", "b"], "left_anti").join(met, ["a", "b"], "left").fillna(0, ["meetings"])


# Endings that turn a word into its base, with what replaces them.
INFLECTIONS = (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("er", ""), ("est", ""))


def common_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``words`` (word) that stand in ``known`` (word) themselves or in a base form."""
    base = F.array(F.col("word"), *(F.when(F.col("word").endswith(e) & (F.length("word") > len(e) + 2), F.concat(F.col("word").substr(F.lit(1), F.length("word") - len(e)), F.lit(r))) for e, r in INFLECTIONS))
    forms = words.select("word", F.explode(F.array_compact(base)).alias("form"))
    return forms.join(known.select(F.col("word").alias("form")), "form", "left_semi").select("word").distinct()


def coverage_by_year(texts: DataFrame, patterns: dict[str, str], text: str, date: str) -> DataFrame:
    """(year, topic, n, papers): how many texts of a year match each pattern."""
    marks = F.array(*(F.struct(F.lit(k).alias("topic"), F.col(text).rlike(p).cast("int").alias("hit")) for k, p in patterns.items()))
    return texts.select(F.year(date).alias("year"), F.explode(marks).alias("m")).groupBy("year", "m.topic").agg(F.sum("m.hit").alias("n"), F.count("*").alias("papers"))
