"""Alignment of two tokenizers over the same texts through bitsets of token ends.

Each text is encoded by both tokenizers; the byte lengths of the tokens set one bit per token end in two packed
bitsets. Their AND holds the shared cuts, which part a text into groups of tokens that cover the same bytes, and
popcounts up to a cut (rank) turn its byte into the number of tokens of either side before it. Tasks do this for
slabs of texts at once. The tokens of a group are linked with each other; a document's links travel as distinct id
pairs with multiplicities, and Spark counts in how many documents each pair occurs.

The counts then go back to the links: the ``most`` commonest pairs (a checked bound) are broadcast and looked up in sorted arrays;
links of rarer pairs, none of which is a hot key any more, meet their counts in a shuffle. The best count of
each id of the first side is bounded by its vocabulary and broadcast.

Defined results: texts that are null or empty, or that either side's tokens do not spell out byte by byte, have no tokens, groups
or links; every row is a document, also when rows repeat; an empty table gives no rows; columns of ``keep`` that bear an output's
name are left out. Texts of any length are aligned whole. A group without a shared cut inside is linked through its distinct ids with
their numbers, so a long run of repeated tokens costs no product of its length.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, slabs, utf8_buffer, written
from .sentencepieces import MARKER

MOST = 1 << 20
WIDE = 4096
# Fixed value: the pattern by which byte-level BPE of this kind parts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class no library disputes.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u024f]*")


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; encodes a space and the text, special strings as plain text.

    Texts of ``_PLAIN`` characters alone go to the tiktoken library, which merges the pair whose joint entry has the lowest id
    and is several times as fast. That is the same encoding if entries are numbered in the order of their merges and each entry's own bytes encode to it
    alone: a pair that joins to an entry can then stand side by side only as that entry's own merge, since the merges inside its
    bytes run as they do when it stands alone. Both are checked when the file is loaded; where one fails, or for other
    characters, on whose classes the libraries' patterns might differ, the tokenizers library encodes itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # printable bytes stand for themselves, the others for the code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        entries = self.library.get_vocab(with_added_tokens=True)
        self.table = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.table[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary in tiktoken, or None where the two might encode differently."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"] or {}
        vocab, special = model["vocab"], {t["content"] for t in told["added_tokens"]}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        own = {e: i for e, i in vocab.items() if e not in special}
        ordered = [own.get(m, -1) for m in merges]
        usual = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"]
        if not usual or ordered != sorted(set(ordered)) or len(own) != 256 + len(merges) or max(own[e] for e in own.keys() - set(merges)) >= ordered[0]:
            return None
        if any([t.id for t in self.library.model.tokenize(e)] != [i] for e, i in own.items()):
            return None
        return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={self.table[i]: i for i in own.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        others = [" " + t for t, p in zip(texts, plain) if not p]
        rest = iter(self.library.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) if p else np.array(next(rest).ids, np.int64) for t, p in zip(texts, plain)]


class Pieces:
    """A SentencePiece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


class _Spelling:
    """Byte lengths and bytes of a vocabulary's tokens."""

    def __init__(self, table: list[bytes]):
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _flat(encoded) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the tokens of each text."""
    counts = np.array([len(e) for e in encoded], np.int64)
    if encoded and isinstance(encoded[0], np.ndarray):
        return np.concatenate(encoded, dtype=np.int64, casting="unsafe"), counts
    return np.fromiter(chain.from_iterable(encoded), np.int64, int(counts.sum())), counts


def _spelled(ids, counts, spelling: _Spelling, want: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' bytes are those of ``want[at[i]:at[i + 1]]``."""
    tokens = _offsets(counts)
    sums = _offsets(spelling.lengths[ids])[tokens]
    good = np.diff(sums) == np.diff(at)
    for i in np.flatnonzero(good) if not good.all() else ():
        got = spelling.spell(ids[tokens[i] : tokens[i + 1]])
        good[i] = np.array_equal(got, want[at[i] : at[i + 1]])
    if good.all() and len(good):
        wrong = np.flatnonzero(spelling.spell(ids) != want)
        good[np.unique(np.searchsorted(at, wrong, "right") - 1)] = False
    return good


def _bits(ends: np.ndarray, n: int) -> np.ndarray:
    """Packed bitset (64-bit words) with the bits before ``ends`` set: one per token end."""
    marks = np.zeros(-(-n // 64) * 64, np.uint8)
    marks[ends - 1] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def _rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits up to and with each bit of ``at``."""
    before = _offsets(np.bitwise_count(words))[at >> 6]
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
    return before + np.bitwise_count(words[at >> 6] & upto)


def _links(a, b, a_ends, b_ends, doc, span: int):
    """Distinct (document, id pair) as one number each, ascending, with their numbers of links."""
    na, nb = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    n = na * nb
    small = np.flatnonzero(n <= WIDE)
    m = n[small]
    g = np.repeat(small, m)
    k = np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m)
    ai, bi = (a_ends - na)[g] + k // nb[g], (b_ends - nb)[g] + k % nb[g]
    keys = [(doc[g] * span + a[ai]) * span + b[bi]]
    times = [np.ones(len(g), np.int64)]
    for g in np.flatnonzero(n > WIDE):
        left, x = np.unique(a[a_ends[g] - na[g] : a_ends[g]], return_counts=True)
        right, y = np.unique(b[b_ends[g] - nb[g] : b_ends[g]], return_counts=True)
        keys.append(((doc[g] * span + left)[:, None] * span + right[None, :]).ravel())
        times.append((x[:, None] * y[None, :]).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(times))
    return found, total


def _ragged(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(counts).astype(np.int32)), pa.array(values.astype(kind)))


def _align(texts: list[str], raw: np.ndarray, ends: np.ndarray, left, right, spell_a: _Spelling, spell_b: _Spelling, span: int) -> list[pa.Array]:
    """The output columns of texts whose UTF-8 bytes are ``raw[ends[i]:ends[i + 1]]``."""
    full = np.array([bool(t) for t in texts], bool)
    rows = np.flatnonzero(full)
    lengths = np.diff(ends)[rows] + 1
    at = _offsets(lengths)
    want = np.full(at[-1], 32, np.uint8)
    body = np.ones(at[-1], bool)
    body[at[:-1]] = False
    want[body] = raw[ends[0] : ends[-1]]
    a, b = ([], []) if not len(rows) else (e.encode([texts[i] for i in rows]) for e in (left, right))
    (a, count_a), (b, count_b) = _flat(a), _flat(b)
    good = _spelled(a, count_a, spell_a, want, at) & _spelled(b, count_b, spell_b, want, at) if len(rows) else np.zeros(0, bool)
    if not good.all():
        a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
        rows, count_a, count_b, lengths = rows[good], count_a[good], count_b[good], lengths[good]
        at = _offsets(lengths)
    n, docs = int(at[-1]), len(texts)

    def per_row(counts):
        out = np.zeros(docs, np.int64)
        out[rows] = counts
        return out

    bits_a, bits_b = _bits(np.cumsum(spell_a.lengths[a]), n), _bits(np.cumsum(spell_b.lengths[b]), n)
    cuts = np.flatnonzero(np.unpackbits((bits_a & bits_b).view(np.uint8), bitorder="little"))
    a_ends, b_ends = _rank(bits_a, cuts), _rank(bits_b, cuts)
    doc = np.searchsorted(at, cuts, "right") - 1
    groups = np.bincount(doc, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
    keys, times = _links(a, b, a_ends, b_ends, doc, span)
    pairs = np.bincount(keys // (span * span), minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
    first_a, first_b = _offsets(count_a)[doc], _offsets(count_b)[doc]
    return [
        _ragged(a, per_row(count_a), np.int32),
        _ragged(b, per_row(count_b), np.int32),
        _ragged(a_ends - first_a, per_row(groups), np.int32),
        _ragged(b_ends - first_b, per_row(groups), np.int32),
        _ragged(keys % (span * span), per_row(pairs), np.int64),
        _ragged(times, per_row(pairs), np.int64),
    ]


OUTPUTS = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, pairs array<bigint>, times array<bigint>, groups string"
NAMES = ["a_ids", "b_ids", "a_ends", "b_ends", "pairs", "times", "groups"]


def align(docs: DataFrame, left, right, keep: list[str], text: str = "text", span: int = 1 << 17, slab: int = 1 << 18) -> DataFrame:
    """``keep`` columns, token ids of both sides, and per group how many tokens of either side end with it (running).

    ``left`` and ``right`` make an encoder each, called once a task. ``pairs`` are the distinct linked ids of the
    document as a * span + b, ``times`` their numbers of links, ``groups`` all groups as ``a1,a2|b1;a3|b2,b3``. ``span`` must exceed every id.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*(k for k in keep if k.lower() not in NAMES))
    source = docs.select(*kept.columns, F.coalesce(F.col(text), F.lit("")).alias(fresh(kept, "_lt_text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    names = [*kept.columns, *NAMES]

    def work(batches):
        a, b = left(), right()
        if max(len(a.table), len(b.table)) > span:
            raise ValueError("ids beyond the span of a pair")
        spell_a, spell_b = _Spelling(a.table), _Spelling(b.table)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            raw, ends = utf8_buffer(column)
            for lo, hi in slabs(ends, slab):
                piece = batch.slice(lo, hi - lo)
                found = _align(column.slice(lo, hi - lo).to_pylist(), raw, ends[lo : hi + 1], a, b, spell_a, spell_b, span)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *found, group_texts(*found[:4])], names=names)

    return source.mapInArrow(work, ", ".join([*fields, OUTPUTS]))


def group_texts(a_ids, b_ids, a_ends, b_ends) -> pa.Array:
    """Each row's groups as ``a1,a2|b1;a3|b2,b3``."""
    flat = lambda c: np.asarray(c.flatten()).astype(np.int64)
    sizes = lambda c: np.asarray(c.value_lengths()).astype(np.int64)
    a, b, count_a, count_b, groups = flat(a_ids), flat(b_ids), sizes(a_ids), sizes(b_ids), sizes(a_ends)
    row = np.repeat(np.arange(len(groups)), groups)
    a_end, b_end = flat(a_ends) + _offsets(count_a)[row], flat(b_ends) + _offsets(count_b)[row]
    ids, ends = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    # a token of the left side stands after the right tokens of earlier groups, one of the right side after its group's left ones
    g_a, g_b = np.repeat(np.arange(len(a_end)), np.diff(a_end, prepend=0)), np.repeat(np.arange(len(b_end)), np.diff(b_end, prepend=0))
    ids[np.arange(len(a)) + (b_end - np.diff(b_end, prepend=0))[g_a]] = a
    ids[np.arange(len(b)) + a_end[g_b]] = b
    ends[a_end + b_end - np.diff(b_end, prepend=0) - 1] = ord("|")
    ends[a_end + b_end - 1] = ord(";")
    rows = _offsets(count_a + count_b)
    ids = ids.astype(np.int32)
    digits = np.ones(len(ids), np.int64)
    for d in range(1, len(str(int(ids.max(initial=0))))):
        digits += ids >= 10**d
    width = digits + 1
    width[rows[1:][count_a > 0] - 1] -= 1  # no separator after a row's last group
    after = np.cumsum(width)
    text = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
    text[(after - 1)[width > digits]] = ends[width > digits]
    last = after - 1 - (width - digits)
    for d in range(int(digits.max(initial=0))):
        text[last - d] = ids % 10 + 48
        more = digits > d + 1
        ids, last, digits = ids[more] // 10, last[more], digits[more]
    return pa.LargeStringArray.from_buffers(len(groups), pa.py_buffer(_offsets(width)[rows]), pa.py_buffer(text)).cast(pa.string())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs): in how many rows each id pair is linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))


def with_counts(aligned: DataFrame, span: int = 1 << 17, most: int = MOST) -> DataFrame:
    """``aligned`` (written; without the token lists, if they are not needed) and n_links, n_best, count_sum.

    ``n_best`` counts links whose pair has the highest count of all pairs of its left id, ``count_sum`` sums the counts over all links.
    """
    spark = aligned.sparkSession
    counts = written(pair_counts(aligned), "pair-counts")
    bins = {r.b: r.n for r in counts.groupBy(F.floor(F.log2("docs")).alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    least, held = 64, 0
    for b in sorted(bins, reverse=True):
        if held + bins[b] > most:
            break
        least, held = b, held + bins[b]
    rare = held < sum(bins.values())
    best = counts.groupBy(F.floor(F.col("pair") / F.lit(span)).alias("a")).agg(F.max("docs").alias("docs")).toArrow()  # one row per id of the vocabulary at most
    top = np.zeros(span, np.int64)
    top[np.asarray(best["a"])] = np.asarray(best["docs"])
    common = counts.where(F.floor(F.log2("docs")) >= least).toArrow()
    keys, values = np.asarray(common["pair"]), np.asarray(common["docs"])
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], values[order], top))

    kept = [c for c in aligned.columns if c not in ("pairs", "times", "n_links", "n_best", "count_sum")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name in kept]
    extra = ["n_links", "n_best", "count_sum", "rare", "rare_times"]

    def work(batches):
        keys, values, top = shared.value
        for batch in batches:
            pairs, lists = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            n = np.asarray(pairs.value_lengths()).astype(np.int64)
            pair, times = np.asarray(pairs.flatten()), np.asarray(lists.flatten())
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            count = np.where(known, values[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
            is_best = known & (count == top[pair // span])
            cuts = _offsets(n)
            total = lambda x: pa.array(np.diff(_offsets(x)[cuts]))
            missing = np.diff(_offsets(~known)[cuts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], total(times), total(times * is_best), total(times * count), _ragged(pair[~known], missing, np.int64), _ragged(times[~known], missing, np.int64)],
                names=[*kept, *extra],
            )

    schema = ", ".join([*fields, "n_links bigint, n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<bigint>"])
    met = aligned.select(*kept, "pairs", "times").mapInArrow(work, schema)
    if not rare:
        return met.drop("rare", "rare_times")
    row = fresh(aligned, "_lt_row")
    met = written(met.withColumn(row, F.monotonically_increasing_id()), "aligned-rare")
    few = counts.where(F.floor(F.log2("docs")) < least)
    tops = F.broadcast(spark.createDataFrame(best.rename_columns(["_lt_a", "_lt_top"])))
    links = met.select(row, F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(row, F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    counted = links.join(few, "pair").withColumn("_lt_a", F.floor(F.col("pair") / F.lit(span))).join(tops, "_lt_a")
    sums = counted.groupBy(row).agg(
        F.sum(F.when(F.col("docs") == F.col("_lt_top"), F.col("times")).otherwise(0)).alias("_lt_best"), F.sum(F.col("docs") * F.col("times")).alias("_lt_sum")
    )
    out = met.join(sums, row, "left")
    return out.select(
        *kept,
        "n_links",
        (F.col("n_best") + F.coalesce("_lt_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_lt_sum", F.lit(0))).alias("count_sum"),
    )
