"""Personal data by base patterns and bootstrapped contexts.

Base kinds (email, ip, card, phone) are found by fixed patterns with their checks and seed the
bootstrap. The words before an instance are its lexical pattern. In every round a pattern that introduces
at least ``MIN_SEEDS`` different instances scored ``ACCEPT`` or more, seeds or found ones, is counted in
the whole corpus, and Spark scores the graph of patterns and instances:

    confidence(pattern, kind) = sum of its instances' scores / all it introduces, instance or not
    score(instance, kind)     = 1 for a seed, else 1 - product of (1 - confidence) of its patterns

so a pattern such as "of the", which mostly introduces ordinary words, gets next to nothing. Where a base
match begins at a token, the whole match is the instance, spaces included. Else a token is one if it has a
digit or an at sign; a token written in digits takes the groups of digits after it along, up to 19 digits
in all (as many as a card has) and up to the next base match. Patterns over ``ACCEPT`` mark the unseen
identifiers they introduce, with the kind they were learnt from; those instances bring their other
patterns into the next round, until the accepted patterns and the scores settle. Base spans always stay.

A fifth kind, secret, has seeds but no base spans: words in the shape of keys and digests. Such a word alone is
nobody's secret (it may name a commit or a file); it becomes a span where an accepted pattern introduces it.

Positions are code points, ends exclusive. Defined results: a null text is empty and has no
span; base spans of one kind never overlap, spans of different kinds may; a found token that
overlaps a base span is not added again; rows that repeat an id or a text give equal
results; an empty table gives no rows; extra columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SLAB, U64, Words, mix
from .common import fresh, slabs, utf8_buffer, written

KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE, SECRET = 4, 4
MIN_SEEDS, ACCEPT, CONTEXT = 3, 0.5, 2
#: Rounds end when the accepted patterns stay and the scores, which only grow, have grown by less than this in sum.
SETTLED = 1e-4
MAX_BROADCAST_SPANS = 1_000_000
#: Patterns are broadcast in groups of at most this many; each group is a pass of its own.
MAX_PATTERNS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs and look-behind only spare retries that must fail
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word in digits, and a further group of digits after spaces.
_DIGITS = re.compile(r"\+?[0-9](?:[().-]{0,2}[0-9])*+")
_GROUP = re.compile(r"\)?\x20+\(?([0-9](?:[().-]{0,2}[0-9])*+)(?=[\"'()\[\]{}<>.,;:!?|*#$%&=]*(?:[\x20\t-\r]|\Z))")
_OTHER_DIGIT = re.compile("[%s]" % "".join(c for c in map(chr, range(128, 0x110000)) if c.isdigit()))
# Shapes of digests of 128 bits and more and of common access keys.
_SECRET = re.compile(
    r"(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
)
_EDGE = "\"'()[]{}<>.,;:!?|*#$%&="
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, at sign, domain. The local part ends at the sign and starts where its
    characters do, but not before the previous match ends."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, s, e) for s, e in emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def _contexts(raw: np.ndarray, offsets: np.ndarray):
    """Tokens of the texts: (rows, byte starts, byte ends, pattern hash of the ``CONTEXT`` words before each, has pattern)."""
    data = _LOWER[raw[offsets[0] : offsets[-1]]]
    values, rows, start, end = Words(1).tokens(data, offsets - offsets[0])
    pattern = np.zeros(len(values), U64)
    for i in range(CONTEXT, 0, -1):
        shifted = np.zeros(len(values), U64)
        shifted[i:] = values[: len(values) - i] if len(values) > i else shifted[i:]
        pattern = mix(pattern * U64(0x9E3779B97F4A7C15) + shifted)
    place = np.arange(len(values)) - np.repeat(rows[:-1], np.diff(rows))
    return rows, start, end, pattern, place >= CONTEXT


def _instance(token: str) -> str:
    return token.strip(_EDGE).lower()


def _hash(text: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _by_row(rows: np.ndarray, hits: np.ndarray):
    """(row, its tokens) of the tokens ``hits``."""
    of = np.searchsorted(rows, hits, side="right") - 1
    cuts = np.flatnonzero(np.diff(of)) + 1
    for part in np.split(hits, cuts) if len(hits) else ():
        yield int(np.searchsorted(rows, part[0], side="right")) - 1, part


def _tokens(text: bytes, start: np.ndarray, end: np.ndarray, which):
    """(index, token text, code-point start) of some tokens, in order."""
    at = chars = 0
    for i in which:
        chars += len(text[at : start[i]].decode())
        at = int(start[i])
        yield i, text[at : end[i]].decode(), chars


def _identifiers(text: str, token: str, at: int, base) -> list[tuple[int | None, int, int]]:
    """(kind, start, end) of what the token at ``at`` introduces: the base matches that begin there, else
    the identifier of no kind, else nothing."""
    inner = token.strip(_EDGE)
    s = at + len(token) - len(token.lstrip(_EDGE))
    begun = [(k, x, y) for k, x, y in base if at <= x < at + len(token) and not text[at:x].strip(_EDGE)]
    if begun:
        return begun
    if not any(c.isdigit() or c == "@" for c in inner):
        return []
    e = s + len(inner)
    if _DIGITS.fullmatch(inner):
        stop = min((x for _, x, _ in base if x >= e), default=len(text))
        digits = sum(c.isdigit() for c in inner)
        while (m := _GROUP.match(text, e)) and m.end(1) <= stop and (digits := digits + sum(c.isdigit() for c in m[1])) <= 19:
            e = m.end(1)
    return [(None, s, e)]


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("_lt_text")).select("id", F.xxhash64("id", "_lt_text").alias("u"), F.hash("id", "_lt_text").alias("v"), "_lt_text")


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SEED_TYPE = pa.list_(pa.struct([("p", pa.int64()), ("kind", pa.int32()), ("x", pa.int64())]))


def _as_spans(found) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in found]


def base_table(named: DataFrame, kind: str) -> DataFrame:
    """id, u, v, base spans, and the seeds (pattern, kind, instance) of every text; the kind is null where neither a base match nor a secret begins."""

    def work(batches):
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(3))
            for lo, hi in slabs(offsets, SLAB):
                data = raw[offsets[lo] : offsets[hi]]
                rows, start, end, pattern, ok = _contexts(raw, offsets[lo : hi + 1])
                marked = np.zeros(len(start), bool)
                marks = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
                marked[np.searchsorted(start, marks, side="right") - 1] = True
                spans, cuts, patterns, kinds, names = [], [0], [], [], []
                for i in range(lo, hi):
                    text = batch.column(3)[i].as_py()
                    base = base_spans(text)
                    spans.append(_as_spans(base))
                    first, last = rows[i - lo], rows[i - lo + 1]
                    mine = marked[first:last]
                    if not text.isascii() and _OTHER_DIGIT.search(text):
                        mine = np.ones(last - first, bool)
                    shift = offsets[i] - offsets[lo]
                    which = first + np.flatnonzero(mine & ok[first:last])
                    for t, token, at in _tokens(raw[offsets[i] : offsets[i + 1]].tobytes(), start - shift, end - shift, which) if len(which) else ():
                        for k, s, e in _identifiers(text, token, at, base):
                            patterns.append(int(pattern[t].view(np.int64)))
                            kinds.append(SECRET if k is None and _SECRET.fullmatch(text, s, e) else k)
                            names.append(_hash(_instance(text[s:e])))
                    cuts.append(len(names))
                fields = [pa.array(patterns, pa.int64()), pa.array(kinds, pa.int32()), pa.array(names, pa.int64())]
                seeds = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_SEED_TYPE.value_type)))
                arrays = [batch.column(c).slice(lo, hi - lo) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, _SPAN_TYPE), seeds], names=["id", "u", "v", "spans", "seeds"])

    return named.mapInArrow(work, f"id {kind}, u long, v int, spans {_SPANS}, seeds array<struct<p:long,kind:int,x:long>>")


def _by_group(patterns: DataFrame, make, schema: str, tag: str) -> DataFrame:
    """Union of ``make(broadcast of (sorted patterns, kinds))`` over groups of ``patterns`` small enough to broadcast.

    Where there are several, one after the other is written and its broadcast released.
    """
    spark, n = patterns.sparkSession, patterns.count()
    groups = 1 if n <= MAX_PATTERNS else -(-2 * n // MAX_PATTERNS)
    out = spark.createDataFrame([], schema)
    for g in range(groups if n else 0):
        part = patterns if groups == 1 else patterns.where(F.pmod(F.xxhash64("p"), F.lit(groups)) == g)
        table = part.select("p", "kind").toArrow()
        p, kind = np.asarray(table.column("p").to_numpy()).view(U64), np.asarray(table.column("kind").to_numpy())
        if not len(p):
            continue
        order = np.argsort(p)
        held = spark.sparkContext.broadcast((p[order], kind[order]))
        found = make(held)
        if groups > 1:
            found = written(found, tag)
            held.destroy()
        out = out.unionAll(found)
    return out


def occurrences(named: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, total): how many tokens each pattern introduces, ordinary words included."""
    schema = "p long, total long"

    def make(held):
        def work(batches):
            known, _ = held.value
            for batch in batches:
                raw, offsets = utf8_buffer(batch.column(0))
                for lo, hi in slabs(offsets, SLAB):
                    _, _, _, pattern, ok = _contexts(raw, offsets[lo : hi + 1])
                    at = np.minimum(np.searchsorted(known, pattern), len(known) - 1)
                    p, n = np.unique(pattern[ok & (known[at] == pattern)], return_counts=True)
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n, pa.int64())], names=["p", "total"])

        return named.select("_lt_text").mapInArrow(work, schema)

    found = _by_group(patterns.select("p", F.lit(0).alias("kind")), make, schema, "pii-counts")
    return found.groupBy("p").agg(F.sum("total").alias("total"))


def bootstrap(named: DataFrame, table: DataFrame) -> DataFrame:
    """Accepted patterns (p, kind, confidence)."""
    introduced = table.select(F.explode("seeds").alias("s")).select("s.p", "s.kind", "s.x")
    scores = written(introduced.where("kind IS NOT NULL").select("kind", "x").distinct().withColumn("score", F.lit(1.0)), "pii-scores")
    accepted = named.sparkSession.createDataFrame([], "p long, kind int, confidence double")
    if scores.isEmpty():
        return accepted
    graph = written(introduced.groupBy("p", "x").agg(F.count("*").alias("found")), "pii-graph")
    totals = named.sparkSession.createDataFrame([], "p long, total long")
    before = None
    while True:
        trusted = scores.where(F.col("score") >= ACCEPT).select("x").distinct()
        patterns = graph.join(trusted, "x").groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS).select("p")
        new = written(patterns.join(totals, "p", "left_anti"), "pii-new")
        if not new.isEmpty():
            totals = written(totals.unionAll(occurrences(named, new)), "pii-totals")
        part = graph.join(scores, "x").groupBy("p", "kind").agg(F.sum(F.col("score") * F.col("found")).alias("s"))
        rated = part.join(totals, "p").select("p", "kind", (F.col("s") / F.col("total")).alias("confidence")).where(F.col("confidence") >= ACCEPT)
        best = F.max(F.struct("confidence", -F.col("kind"))).alias("b")  # of equals the first kind
        best = rated.groupBy("p").agg(best).select("p", (-F.col("b")["col2"]).alias("kind"), "b.confidence")
        accepted = written(best, "pii-patterns")
        if accepted.isEmpty():
            break
        unseen = graph.join(accepted, "p").groupBy("kind", "x")
        unseen = unseen.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        scores = written(scores.unionAll(unseen).groupBy("kind", "x").agg(F.max("score").alias("score")), "pii-scores")
        now = accepted.agg(F.count("*"), F.bit_xor(F.xxhash64("p", "kind"))).first(), scores.where("score < 1").agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if before and now[0] == before[0] and now[1][0] == before[1][0] and abs(now[1][1] - before[1][1]) < SETTLED:
            break
        before = now
    return accepted


def contextual_spans(named: DataFrame, accepted: DataFrame) -> DataFrame:
    """(u, v, kind, start, end) of the tokens accepted patterns introduce, without those that meet base spans."""
    schema = "u long, v int, kind int, start int, end int"

    def make(held):
        def work(batches):
            known, kinds = held.value
            for batch in batches:
                raw, offsets = utf8_buffer(batch.column(2))
                for lo, hi in slabs(offsets, SLAB):
                    rows, start, end, pattern, ok = _contexts(raw, offsets[lo : hi + 1])
                    at = np.minimum(np.searchsorted(known, pattern), len(known) - 1)
                    hits = np.flatnonzero(ok & (known[at] == pattern))
                    found = []
                    for row, mine in _by_row(rows, hits):
                        a, b = offsets[lo + row], offsets[lo + row + 1]
                        raw_text = raw[a:b].tobytes()
                        text, shift = raw_text.decode(), a - offsets[lo]
                        base = base_spans(text)
                        for i, token, start_at in _tokens(raw_text, start - shift, end - shift, mine):
                            for k, s, e in _identifiers(text, token, start_at, base):
                                if k is None and all(e <= x or s >= y for _, x, y in base):
                                    found.append((batch.column(0)[int(lo + row)].as_py(), batch.column(1)[int(lo + row)].as_py(), int(kinds[at[i]]), s, e))
                    if found:
                        kinds_of = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds_of)], names=["u", "v", "kind", "start", "end"])

        return named.select("u", "v", "_lt_text").mapInArrow(work, schema)

    return _by_group(accepted, make, schema, "pii-contexts").distinct()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, u, v (the text's name), base and spans (arrays of kind, start, end in order)."""
    named = _named(docs, id_col, text_col)
    table = written(base_table(named, docs.schema[id_col].dataType.simpleString()), "pii-base")
    accepted = bootstrap(named, table)
    table = table.select("id", "u", "v", F.col("spans").alias("base"))
    if accepted.isEmpty():
        return table.withColumn("spans", F.col("base"))
    extra = contextual_spans(named, accepted).groupBy("u", "v").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    return table.join(extra, ["u", "v"], "left").select("id", "u", "v", "base", F.array_sort(F.array_union("base", F.coalesce("extra", F.array().cast(_SPANS)))).alias("spans"))


def joined(spans: str):
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[KIND]`` (of overlapping spans the first's)."""
    found = written(find_pii(docs, id_col, text_col).where(F.size("spans") > 0).select("u", "v", "spans").dropDuplicates(["u", "v"]), "pii-found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    u, v, all_spans = (fresh(docs, n) for n in ("_lt_u", "_lt_v", "_lt_spans"))
    match = (F.xxhash64(F.col(id_col), text) == F.col(u)) & (F.hash(F.col(id_col), text) == F.col(v))
    found = found.select(F.col("u").alias(u), F.col("v").alias(v), F.col("spans").alias(all_spans))
    few = found.agg(F.coalesce(F.sum(F.size(all_spans)), F.lit(0))).first()[0] <= MAX_BROADCAST_SPANS
    joined_docs = docs.join(F.broadcast(found) if few else found, match, "left").drop(u, v)
    at = joined_docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            texts = batch.column(at)
            if spans.null_count < len(spans):
                values = texts.to_pylist()
                for i in np.flatnonzero(np.asarray(spans.is_valid())):
                    values[i] = _replace(values[i], sorted((s["start"], s["end"], s["kind"]) for s in spans[int(i)].as_py()))
                texts = pa.array(values, texts.type)
            arrays = [texts if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return joined_docs.mapInArrow(work, docs.schema)


def _replace(text: str, spans) -> str:
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
