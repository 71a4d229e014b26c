"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Texts and items become lists of hashed word shingles (lower-cased runs of letters and digits). Windows of
the items' sizes get ``PRINTS`` independent 64-bit SimHashes each, their shingles weighted by how often they occur, and so do the items.
A multi-index finds the candidates: a fingerprint is cut into ``BLOCKS`` blocks, and an item stands in the index under every value
within ``NEAR`` bits of each of its blocks. Of two fingerprints within ``RADIUS`` bits one block differs in ``NEAR`` bits at most, so
none within the radius is missed, whichever item it belongs to; two random ones meet in about 4 of 100 cases a fingerprint. Distinct
fingerprints meet the index without their windows; candidates within the radius under either fingerprint go back to the windows and are verified by exact weighted-shingle similarity (sum of smaller over sum of larger weights).

Not every window of a text is fingerprinted. One that is similar to an item holds some of its shingles, and
moving it to the right until it starts with one never lowers their similarity. So windows of a size open at
the shingles that the text shares with any item of that size (moved left where the text ends),
unless so few such shingles follow within the window that the threshold is out of reach: 80 of 100
shingles in common need at least as many shared positions. Common phrases thus open no window.

At a similarity of 0.8 the expected distance is 10 bits (deviation 3): one fingerprint misses about 1 window in 100 there, both
about 1 in 10,000, and a similar text mostly has several such windows.

Defined results: null or blank texts and items match nothing; an item of fewer words than a
shingle is one shingle, as is such a text, so they match only as a whole; a text shorter than an item is one
window; rows that repeat an id count once (the best window); an empty table gives no rows; extra
columns are ignored. A null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

PRINTS, BLOCKS, RADIUS = 2, 4, 15
NEAR = RADIUS // BLOCKS
WIDTH = 64 // BLOCKS
#: All changes of a block in up to ``NEAR`` bits.
CHANGES = [x for x in range(1 << WIDTH) if x.bit_count() <= NEAR]
#: Rows of the index (two numbers each, some 120 bytes in the driver) up to which it is broadcast: 30 MB.
MAX_INDEX_ROWS = 250_000
#: Above these sizes a table is shuffled instead of broadcast. A hit that opens a window, or a text name, takes 40 bytes at most, so at most 40 MB.
MAX_BROADCAST_SHINGLES = 500_000
MAX_BROADCAST_HITS = 1_000_000


def shingles(df: DataFrame, text: str, width: int) -> DataFrame:
    """Adds ``hs``: the shingle hashes of ``text`` in order."""
    words = f"array_remove(split(lower(coalesce(`{text}`, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"
    gram = ", ".join(f"get(ws, i + {k})" for k in range(width))
    grams = (
        f"CASE WHEN size(ws) >= {width} THEN transform(sequence(0, size(ws) - {width}), i -> xxhash64({gram})) "
        "WHEN size(ws) > 0 THEN array(xxhash64(concat_ws(' ', ws))) ELSE array() END"
    )
    return df.withColumn("hs", F.expr(let("ws", words, grams)))


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once however often it is used."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fingerprint(hashes: str) -> str:
    """SimHash of an array<long>: 64 counters in 32 lanes of two, then a majority per bit."""
    lanes = f"aggregate({hashes}, array_repeat(0L, 32), (acc, h) -> transform(acc, (a, i) -> a + (shiftrightunsigned(h, i) & 4294967297L)))"
    low = f"if(2 * (c & 4294967295L) > n, shiftleft(1L, i), 0L)"
    high = f"if(2 * shiftrightunsigned(c, 32) > n, shiftleft(1L, i + 32), 0L)"
    bits = f"aggregate(transform({lanes}, (c, i) -> {low} | {high}), 0L, (x, y) -> x | y)"
    return let("n", f"size({hashes})", bits)


def fingerprints(hashes: str) -> str:
    """Array of ``PRINTS`` SimHashes; all but the first from hashes of the hashes."""
    return "array(" + ", ".join([fingerprint(hashes), *(fingerprint(f"transform({hashes}, h -> xxhash64(h, {i}))") for i in range(1, PRINTS))]) + ")"


def blocks(fps: str) -> str:
    """Array of the blocks of all fingerprints of an array, in order."""
    one = f"transform(sequence(0, {BLOCKS - 1}), b -> shiftrightunsigned(f, b * {WIDTH}) & {(1 << WIDTH) - 1}L)"
    return f"flatten(transform({fps}, f -> {one}))"


def key(size: str, place: str, value: str) -> str:
    """One number of a window's or item's size, the place of a block among all and its value."""
    return f"(({size}) * {PRINTS * BLOCKS}L + ({place})) * {1 << WIDTH}L + ({value})"


def _weighted(x: str, y: str) -> str:
    """Sum over shingles of the smaller of their two counts."""
    plain = f"size(array_intersect({x}, {y}))"
    counted = f"aggregate(array_intersect({x}, {y}), 0, (s, h) -> s + least(size(filter({x}, a -> a = h)), size(filter({y}, a -> a = h))))"
    return f"if(size(array_distinct({x})) = size({x}) AND size(array_distinct({y})) = size({y}), {plain}, {counted})"


def _starts(percent: int) -> str:
    """Window starts of one text and size ``m``, from the sorted positions ``ps`` of what it shares with items of that size.

    A window of ``m`` shingles that holds fewer than ``percent`` of ``m`` shared positions cannot reach the
    threshold; whether the window at a position holds enough is told by the position that many further on.
    """
    enough = f"greatest(cast(ceil({percent} * m / 100) AS INT), 1)"
    start = f"CASE WHEN p > n - m THEN greatest(n - m, 0) WHEN get(ps, j + {enough} - 1) < p + m THEN p END"
    return f"array_distinct(filter(transform(ps, (p, j) -> {start}), s -> s IS NOT NULL))"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per text and item that are similar: id, item id, n_common, n_union (weights), _lt_u, _lt_v (the text's name)."""
    item = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).distinct()
    item = shingles(item, "t", width).where("size(hs) > 0")
    item = item.select(F.monotonically_increasing_id().alias("row"), "item", F.col("hs").alias("ih"), F.expr(fingerprints("hs")).alias("ifp"), F.size("hs").alias("m"))
    item = written(item, "items")
    n_items, n_shingles = item.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    small = n_shingles <= MAX_BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda df: df)

    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_lt_text"),
    ).withColumn("u", F.xxhash64("id", "_lt_text")).withColumn("v", F.hash("id", "_lt_text"))
    grams = item.select("m", F.explode("ih").alias("h")).distinct()
    places = shingles(base, "_lt_text", width).select("u", "v", F.size("hs").alias("n"), F.posexplode("hs").alias("p", "h"))
    hits = places.join(hint(grams), "h").select("u", "v", "m", "n", "p").distinct()
    hits = hits.groupBy("u", "v", "m", "n").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    opened = written(hits.select("u", "v", "m", F.expr(_starts(percent)).alias("starts")).where("size(starts) > 0"), "starts")

    per_text = opened.groupBy("u", "v").agg(F.collect_list(F.struct("m", "starts")).alias("found"))
    few = opened.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0] <= MAX_BROADCAST_HITS
    held = base.join(F.broadcast(per_text) if few else per_text, ["u", "v"])
    flat = "flatten(transform(found, f -> transform(f.starts, s -> struct(f.m AS m, s AS s))))"
    windows = (
        shingles(held, "_lt_text", width)
        .select("id", "u", "v", "hs", F.explode(F.expr(flat)).alias("f"))
        .select("id", "u", "v", F.col("f.m").alias("m"), F.expr(let("w", "slice(hs, f.s + 1, f.m)", f"struct(w AS wh, {fingerprints('w')} AS fp)")).alias("w"))
    )
    windows = written(windows.select("id", "u", "v", "m", "w.wh", "w.fp"), "windows")
    changed = F.explode(F.array(*map(F.lit, CHANGES))).alias("change")
    index = item.select("row", "m", F.posexplode(F.expr(blocks("ifp"))).alias("b", "value")).select("row", "m", "b", "value", changed)
    index = index.select("row", F.expr(key("m", "b", "value ^ change")).alias("key"))
    light = n_items * PRINTS * BLOCKS * len(CHANGES) <= MAX_INDEX_ROWS
    prints = windows.select("m", "fp").distinct().select("m", "fp", F.posexplode(F.expr(blocks("fp"))).alias("b", "value"))
    prints = prints.select("m", "fp", "b", F.expr(key("m", "b", "value")).alias("key"))
    # sizes are estimated without the rows that explode adds: only a hint keeps a large index out of the driver
    met = prints.join(F.broadcast(index) if light else index.hint("merge"), "key")
    apart = f"transform(zip_with({blocks('fp')}, {blocks('ifp')}, (x, y) -> bit_count(x ^ y)), (d, i) -> if(d <= {NEAR} AND bit_count(get(fp, cast(i div {BLOCKS} AS INT)) ^ get(ifp, cast(i div {BLOCKS} AS INT))) <= {RADIUS}, i, NULL))"
    # within the radius, and of the blocks that bring two together the first, so that a candidate stays once
    close = met.join(hint(item.select("row", "ifp")), "row").where(F.expr(f"array_min({apart})") == F.col("b"))
    close = written(close.select("m", "fp", "row"), "close")
    near = (
        windows.join(close, ["m", "fp"])
        .join(hint(item.select("row", "item", "ih")), "row")
        .withColumn("n_common", F.expr(_weighted("wh", "ih")).cast("long"))
        .withColumn("n_union", (F.size("wh") + F.size("ih") - F.col("n_common")).cast("long"))
        .where(f"100 * n_common >= {percent} * n_union")
    )
    ranked = F.struct((F.col("n_common") / F.col("n_union")).alias("r"), "n_common", "n_union")
    best = near.groupBy("u", "v", "id", "item").agg(F.max(ranked).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "x.n_common", "x.n_union", F.col("u").alias("_lt_u"), F.col("v").alias("_lt_v"))


def pairs(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """One row per id and item id that are similar: the ids, n_common, n_union of the best window."""
    found = contaminated(docs, items, **names)
    keys = found.columns[:2]
    best = found.groupBy(*keys).agg(F.max(F.struct((F.col("n_common") / F.col("n_union")).alias("r"), "n_common", "n_union")).alias("x"))
    return best.select(*keys, "x.n_common", "x.n_union")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    u, v = fresh(docs, "_lt_u"), fresh(docs, "_lt_v")
    found = contaminated(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, id_col="id", text_col="text", **names)
    dirty = written(found.select(F.col("_lt_u").alias(u), F.col("_lt_v").alias(v)).distinct(), "dirty")
    few = dirty.count() <= MAX_BROADCAST_HITS
    text = F.coalesce(F.col(text_col), F.lit(""))
    match = (F.xxhash64(F.col(id_col), text) == F.col(u)) & (F.hash(F.col(id_col), text) == F.col(v))
    return docs.join(F.broadcast(dirty) if few else dirty, match, "left_anti")
