"""Acronyms of phrases, and acronyms restored from names that are composed of them.

A name such as ``MiniWidgetGAN`` ends in capitals, and its full name may spell some of them out. All word spans of the full
name are indexed by the acronyms they can give; the suffixes of the capitals are looked up there. Both sides stem from one
record, so the index is an array of its row and nothing is shuffled before the evidence is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normalised

LONGEST, SPAN = 12, 8
# Words an acronym may pass over.
SMALL_WORDS = ("a", "an", "and", "by", "for", "in", "of", "on", "the", "to", "via", "with")


def _texts() -> Column:
    return F.array().cast("array<string>")


def _choices(word: Column) -> Column:
    """What a word may give: the first letter or digit of its first part, those of all parts between hyphens or slashes, or
    (a small word) nothing. Empty where the word has no letter or digit."""
    bare = F.filter(F.transform(F.split(word, "[-/]"), lambda p: F.regexp_replace(p, "[^A-Za-z0-9]", "")), lambda p: p != "")
    initials = F.transform(bare, lambda p: F.upper(p.substr(1, 1)))
    told = F.array(F.try_element_at(initials, F.lit(1)), F.array_join(initials, ""))
    whole = F.when(F.lower(word).isin(*SMALL_WORDS), F.array_append(told, F.lit(""))).otherwise(told)
    return F.when(F.size(initials) > 0, F.array_distinct(whole)).otherwise(_texts())


def _spelled(choices: Column, longest: int) -> Column:
    """Every way to take one choice of each array, in order, up to ``longest`` letters."""

    def further(made: Column, own: Column) -> Column:
        longer = F.flatten(F.transform(made, lambda m: F.transform(own, lambda o: F.concat(m, o))))
        return F.when(F.size(own) == 0, made).otherwise(F.array_distinct(F.filter(longer, lambda x: F.length(x) <= longest)))

    return F.aggregate(choices, F.array(F.lit("")), further)


def words_of(phrase: Column) -> Column:
    return F.filter(F.split(F.coalesce(phrase, F.lit("")), "\\s+"), lambda w: w != "")


def initial_variants(phrase: Column, longest: int = LONGEST) -> Column:
    """Sorted acronyms of a phrase of any number of words, none of more than ``longest`` letters."""
    made = _spelled(F.transform(words_of(phrase), _choices), longest)
    return F.array_sort(F.filter(made, lambda v: v != ""))


def _small(word: Column) -> Column:
    return F.lower(word).isin(*SMALL_WORDS)


def composite_evidence(records: DataFrame, least: int, span: int = SPAN) -> DataFrame:
    """(token, acronym, expansion): capitals at the end of a token of a record's ``name`` that a span of its ``full_name`` spells out.

    A suffix counts only if no longer suffix of the same token is spelled by a span that ends at the same word. Spans neither
    begin nor end with a small word and are not all capitals. Of expansions that end in s (and a last word of over four letters) the s goes.
    """
    rows = records.select("name", "full_name").where("name IS NOT NULL AND full_name IS NOT NULL").distinct()
    tokens = F.filter(words_of(F.col("name")), lambda t: t.rlike("[A-Z]$"))
    rows = rows.select(F.explode(F.array_distinct(tokens)).alias("token"), words_of(F.col("full_name")).alias("ws"))
    rows = rows.withColumn("tail", F.regexp_extract("token", "([A-Z]+)$", 1)).where(F.length("tail") >= least)
    rows = rows.withColumn("cs", F.transform("ws", _choices))
    size = F.size("ws")

    def spans(i: Column) -> Column:
        ends = F.sequence(i, F.least(i + (span - 1), size))
        return F.transform(ends, lambda j: F.struct(j.alias("end"), F.array_join(F.slice("ws", i, j - i + 1), " ").alias("text"), F.slice("cs", i, j - i + 1).alias("cs"), F.element_at("ws", i).alias("first"), F.element_at("ws", j).alias("last")))

    every = F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), size), spans)))
    shouted = lambda x: (F.upper(x["text"]) == x["text"]) & (F.lower(x["text"]) != x["text"])
    fit = F.filter(every, lambda x: ~_small(x["first"]) & ~_small(x["last"]) & ~shouted(x))
    known = F.transform(fit, lambda x: F.struct(x["end"].alias("end"), x["text"].alias("text"), _spelled(x["cs"], LONGEST).alias("variants")))
    rows = rows.select("token", "tail", known.alias("index"))
    hit = lambda x: F.transform(F.filter(x["variants"], lambda v: (F.length(v) >= least) & F.endswith(F.col("tail"), v)), lambda v: F.struct(v.alias("acronym"), x["end"].alias("end"), x["text"].alias("text")))
    rows = rows.select("token", F.flatten(F.transform("index", hit)).alias("found")).where(F.size("found") > 0)
    whole = F.filter("found", lambda x: ~F.exists("found", lambda y: (y["end"] == x["end"]) & (F.length(y["acronym"]) > F.length(x["acronym"]))))
    out = rows.select("token", F.explode(whole).alias("x")).select("token", "x.acronym", normalised(F.col("x.text")).alias("e"))
    last = F.element_at(F.split("e", " "), -1)
    one = F.when(F.col("e").endswith("s") & (F.length(last) > 4), F.col("e").substr(F.lit(1), F.length("e") - 1)).otherwise(F.col("e"))
    return out.select("token", "acronym", one.alias("expansion")).distinct()


def restored(records: DataFrame, surfaces: DataFrame, least: int = 2, support: int = 2) -> DataFrame:
    """(acronym, expansion, support, tokens) of the evidence of at least ``support`` distinct tokens, where neither is among ``surfaces`` (text).

    Repeated records add nothing, since tokens are counted, not rows.
    """
    found = composite_evidence(records, least)
    known = surfaces.select("text").distinct()
    for side in ("acronym", "expansion"):
        found = found.join(known.withColumnRenamed("text", side), side, "left_anti")
    grouped = found.groupBy("acronym", "expansion").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return grouped.where(F.size("tokens") >= support).select("acronym", "expansion", F.size("tokens").cast("long").alias("support"), "tokens")
