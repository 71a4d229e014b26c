"""Dictionary matching in text, and sentence-window evidence.

A dictionary has one row per surface: term_id, text, mode (``ci`` or ``cs``). A token sequence that two terms own is
ambiguous and skipped. Matches are greedy from the left, longest first, without overlap, one pass
per mode. Texts and surfaces go through the same normalisation (compatibility forms, and for ``ci`` lower case).

The plan: every text is cut into the word n-grams of the lengths the dictionary has, these are joined to its
surfaces, and a fold over the sorted hits of a text and mode chooses among them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import compatible, normalised, tokens
from ..sources.folders import kept
from .ranks import settled

MODES = ("ci", "cs")
#: A dictionary of at most so many sequences goes to the tasks; a larger one meets the n-grams in a shuffle.
SMALL_DICTIONARY = 100_000


def mode_tokens(text: Column, mode: str) -> Column:
    """The tokens that ``mode`` compares."""
    return tokens(normalised(text, unicode_form=True)) if mode == "ci" else tokens(compatible(text), fold=False)


def surfaces(dictionary: DataFrame) -> DataFrame:
    """mode, gram (tokens joined by a space), size, terms (the sorted owners) of the distinct token sequences."""
    words = F.when(F.col("mode") == "ci", mode_tokens(F.col("text"), "ci")).otherwise(mode_tokens(F.col("text"), "cs"))
    rows = dictionary.select("mode", "term_id", words.alias("ws")).where(F.size("ws") > 0)
    return rows.groupBy("mode", F.array_join("ws", " ").alias("gram"), F.size("ws").alias("size")).agg(F.array_sort(F.collect_set("term_id")).alias("terms"))


def ambiguous(dictionary: DataFrame) -> DataFrame:
    """mode, gram, terms of the sequences that several terms own."""
    return surfaces(dictionary).where(F.size("terms") > 1).select("mode", "gram", "terms")


def ngrams(words: str, n: int) -> Column:
    """Structs (first, size, gram) of the ``n`` tokens from every place of the array ``words``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(i.alias("first"), F.lit(n).alias("size"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))


def hits(texts: DataFrame, wanted: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys``, the columns of ``wanted`` (mode, gram, size, ...), first: every place where a gram of ``wanted`` stands."""
    sizes = {m: sorted(r["size"] for r in wanted.where(F.col("mode") == m).select("size").distinct().collect()) for m in MODES}  # a few small numbers
    small = F.broadcast if wanted.count() <= SMALL_DICTIONARY else lambda w: w
    out = None
    for mode in MODES:
        if not sizes[mode]:
            continue
        words = texts.select(*keys, mode_tokens(F.coalesce(F.col(text_col), F.lit("")), mode).alias("_ws"))
        grams = F.flatten(F.array(*(ngrams("_ws", n) for n in sizes[mode])))
        found = words.select(*keys, F.explode(grams).alias("g")).select(*keys, "g.first", "g.size", "g.gram").join(small(wanted.where(F.col("mode") == mode)), ["gram", "size"])
        out = found if out is None else out.unionByName(found)
    return out


def match(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, grams: bool = False) -> DataFrame:
    """id_col, term_id, mode, first, last (tokens; end exclusive) and, if wanted, gram of every match; rows that repeat id and text count once."""
    schema = f"{id_col} {texts.schema[id_col].dataType.simpleString()}, term_id string, mode string, first int, last int" + ", gram string" * grams
    own = surfaces(dictionary).where(F.size("terms") == 1).select("mode", "gram", "size", F.col("terms")[0].alias("term_id"))
    named = texts.select(id_col, F.xxhash64(F.col(text_col)).alias("_lt_name"), F.col(text_col).alias("_lt_text"))
    found = hits(named, own, [id_col, "_lt_name"], "_lt_text")
    if found is None:
        return texts.sparkSession.createDataFrame([], schema)
    # of the hits that begin at one token the longest; then from the left whatever starts where the last one ended or later
    longest = found.groupBy(id_col, "_lt_name", "mode", "first").agg(F.max(F.struct("size", "term_id", "gram")).alias("h"))
    rows = longest.groupBy(id_col, "_lt_name", "mode").agg(F.array_sort(F.collect_list(F.struct("first", (F.col("first") + F.col("h.size")).alias("last"), "h.term_id", "h.gram"))).alias("hs"))
    none = F.expr("cast(array() as array<struct<first:int,last:int,term_id:string,gram:string>>)")
    end = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["last"], F.lit(0))
    chosen = F.aggregate("hs", none, lambda kept, h: F.when(h["first"] >= end(kept), F.array_append(kept, h)).otherwise(kept))
    return rows.select(id_col, "mode", F.explode(chosen).alias("m")).select(id_col, "m.term_id", "mode", "m.first", "m.last", *["m.gram"] * grams)


def phrases(texts: DataFrame, excluded: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, term_id, first, last of every place where an excluded phrase (term_id, text) of a term stands, case ignored."""
    rows = excluded.select("term_id", F.lit("ci").alias("mode"), mode_tokens(F.col("text"), "ci").alias("ws")).where(F.size("ws") > 0)
    wanted = rows.select("term_id", "mode", F.array_join("ws", " ").alias("gram"), F.size("ws").alias("size")).distinct()
    found = hits(texts, wanted, [id_col], text_col)
    if found is None:
        return texts.sparkSession.createDataFrame([], f"{id_col} {texts.schema[id_col].dataType.simpleString()}, term_id string, first int, last int")
    return found.select(id_col, "term_id", "first", (F.col("first") + F.col("size")).alias("last")).distinct()


def refine(spans: DataFrame, id_col: str, cs_only: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Spans not nested in a strictly longer one of either pass and, of a term with excluded ``phrases``, not covered by one;
    a ``cs`` match stays only with a ``ci`` match of its term in the same text, unless the term is in ``cs_only``."""
    # the spans are read several times, the texts only once
    spans = settled(spans)
    # containment within a text, through the tokens a span covers
    cover = spans.select(id_col, F.col("first").alias("x"), F.col("last").alias("y"), F.explode(F.sequence("first", F.col("last") - 1)).alias("first"))
    nested = spans.join(cover, [id_col, "first"]).where("x <= first AND y >= last AND (y - x) > (last - first)")
    nested = nested.select(id_col, "first", "last").distinct()
    flat = spans.join(nested, [id_col, "first", "last"], "left_anti")
    if excluded is not None:
        over = excluded.select(id_col, "term_id", F.col("last").alias("y"), F.explode(F.sequence("first", F.col("last") - 1)).alias("first"), F.col("first").alias("x"))
        covered = flat.join(over, [id_col, "term_id", "first"]).where("y >= last").select(id_col, "term_id", "first", "last").distinct()
        flat = flat.join(covered, [id_col, "term_id", "first", "last"], "left_anti")
    flat = settled(flat)
    backed = flat.where("mode = 'ci'").select(id_col, "term_id").union(flat.select(id_col, "term_id").join(cs_only, "term_id", "left_semi").select(id_col, "term_id")).distinct()
    return flat.where("mode = 'ci'").unionByName(flat.where("mode = 'cs'").join(backed, [id_col, "term_id"], "left_semi").select(flat.columns))


def sentence_ends(abbreviations: list[str] | None = None, openers: str = "A-Z0-9") -> str:
    """Pattern of the white space between two sentences: after . ! ? and before one of ``openers``, but neither behind an
    abbreviation nor inside one."""
    names = sorted(abbreviations or [], key=lambda a: (-len(a), a))
    behind = f"(?<!{'|'.join(map(re.escape, names))})" if names else ""
    inner = [(a[: m.end()], a[m.end() :].lstrip()) for a in names for m in re.finditer(r"[.!?](?=\s)", a)]
    inside = "".join(f"(?!(?<={re.escape(left)})\\s+{re.escape(right)})" for left, right in inner)
    return f"(?<=[.!?]){behind}{inside}\\s+(?=[{openers}])"


def sentences(texts: DataFrame, id_col: str, text_col: str, abbreviations: list[str] | None = None, openers: str = "A-Z0-9") -> DataFrame:
    """id_col, idx, sentence: split at ``sentence_ends``."""
    return texts.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), sentence_ends(abbreviations, openers))).alias("idx", "sentence"))


def example_sentences(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, per: int, seed: int, abbreviations: list[str] | None = None) -> DataFrame:
    """(term_id, mode, gram, n, id_col, idx, sentence): of every surface of ``dictionary`` that the matcher finds, ``per`` of its ``n``
    sentences, drawn by a seeded hash.

    The draw is a bottom-k per surface: tasks hand on no more than ``per`` rows of a surface, so one that stands everywhere is no hot key.
    """
    cut = sentences(texts, id_col, text_col, abbreviations).withColumn("sid", F.struct(F.col(id_col).alias("id"), "idx"))
    # counts and draw read the matches from one table, and only texts of drawn sentences are cut again
    found = kept(match(cut, dictionary, "sid", "sentence", grams=True).select("term_id", "mode", "gram", "sid").distinct(), "matches")
    drawn = Window.partitionBy("term_id", "mode", "gram").orderBy(F.xxhash64(F.lit(seed), "gram", "sid"), "sid")
    picked = kept(found.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= per).drop("_r"), "drawn")
    small = F.broadcast if picked.count() <= SMALL_DICTIONARY else lambda p: p
    again = sentences(texts.join(small(picked.select(F.col("sid.id").alias(id_col)).distinct()), id_col, "left_semi"), id_col, text_col, abbreviations)
    again = again.select(F.struct(F.col(id_col).alias("id"), "idx").alias("sid"), "sentence").join(small(picked.select("sid").distinct()), "sid", "left_semi").distinct()
    counts = found.groupBy("term_id", "mode", "gram").agg(F.count("*").alias("n"))
    shown = picked.join(counts, ["term_id", "mode", "gram"]).join(again, "sid")
    return shown.select("term_id", "mode", "gram", "n", F.col("sid.id").alias(id_col), F.col("sid.idx").alias("idx"), "sentence")


def cue_pattern(cues: list[str]) -> str:
    """Longest cue first, at word and hyphen boundaries, case ignored."""
    return "(?i)(?<![\\w-])(?:" + "|".join(re.escape(c) for c in sorted(cues, key=lambda c: (-len(c), c))) + ")(?![\\w-])"


def window_evidence(rows: DataFrame, id_col: str, terms: list[str], size: int, cue: str) -> DataFrame:
    """Ids of texts in which ``size`` consecutive sentences, none with a cue, hold all ``terms``.

    ``rows``: id, idx, sentence, terms (array) per sentence.
    """
    w = Window.partitionBy(id_col).orderBy("idx").rowsBetween(0, size - 1)
    marked = rows.withColumn("_all", F.array_distinct(F.flatten(F.collect_list("terms").over(w)))).withColumn("_cue", F.max(F.col("sentence").rlike(cue)).over(w))
    return marked.where(~F.col("_cue") & (F.size(F.array_intersect("_all", F.array(*map(F.lit, terms)))) == len(terms))).select(id_col).distinct()
