"""Near-duplicate groups by HyperMinHash.

A text's set of hashed word shingles is dealt into ``REGISTERS`` buckets; each bucket keeps its
smallest hash as a register of leading-zero count and mantissa bits. Empty registers borrow
from others by a fixed random walk, so short texts use all bands. Bands of
``BAND`` compressed registers make candidates; two texts with a similarity of 0.8 share none
of the 32 bands with a probability of 5e-8.

Texts with equal sets are one class from the start. Classes that share a band are linked in three
steps, each confirmed on full sets:

1. every class with the smallest pivot it meets in a band, then with the other pivots it is
   not yet joined to;
2. what is left: bands of three or more classes that lie in different components of the first links. Members
   outside the band's largest component are compared with all of the band, block by block (a
   band of any size is cut into blocks of about ``BLOCK`` classes and ``BLOCK_BYTES`` of sets), first by the collision-corrected
   estimate from the registers, then exactly; pairs already joined are passed over, and a pair of several
   common bands is compared in the first of them only;
3. components of all links.

So every two classes that share a band end in one component or are compared; no band is capped.

Defined results: null, empty and blank texts have no set, are linked with nothing and are their
own component; a text of fewer words than a shingle has the whole sequence as its only
one; rows that repeat an id or a text are rows of their own; a row without id belongs to
no component (null) and is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SLAB, U64, Words, mix
from .common import fresh, slabs, utf8_buffer, written
from .components import components

REGISTERS, BAND, MANTISSA = 128, 4, 10
BLOCK, BLOCK_BYTES = 2048, 8 << 20
MAX_BROADCAST_IDS = 1_000_000
#: Estimates this far below the threshold (over five standard deviations of 128 registers) are passed over.
SLACK = 0.2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int):
    """(hashes, set offsets): the sorted distinct shingle hashes of each text."""
    data = _LOWER[raw[offsets[0] : offsets[-1]]]
    values, rows, _, _ = Words(width).tokens(data, offsets - offsets[0])
    counts = np.diff(rows)
    n = len(values)
    hashed = values.copy()
    for i in range(1, width):
        hashed[: n - i] = mix(hashed[: n - i] * U64(0x9E3779B97F4A7C15) + values[i:]) if n > i else hashed[: n - i]
    last = np.repeat(rows[1:], counts) - width  # last shingle start of each word's text
    ok = np.arange(n) <= last
    text = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = []
    for t in short:  # fewer words than a shingle: all of them as one
        h = U64(int(counts[t]))
        for v in values[rows[t] : rows[t + 1]]:
            h = mix(np.array([h * U64(31) + v], U64))[0]
        extra.append(h)
    owner = np.concatenate([text[ok], short]).astype(np.int64)
    hashes = np.concatenate([hashed[ok], np.array(extra, U64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 registers of each set (all zero for an empty one): leading zeros, then mantissa bits."""
    n = len(offsets) - 1
    spread = mix(hashes ^ U64(0xA0761D6478BD642F))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    slot = owner * REGISTERS + (spread & U64(REGISTERS - 1)).astype(np.int64)
    value = spread >> U64(7)
    low = np.full(n * REGISTERS, U64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, slot, value)
    filled = (low != U64(0xFFFFFFFFFFFFFFFF)).reshape(n, REGISTERS)
    low = low.reshape(n, REGISTERS)
    # leading zeros of the 57 bits by the exponent of the value, mantissa by the bits below the leading one
    top = np.frexp(np.maximum(low, U64(1)).astype(np.float64))[1].astype(np.int64) - 1  # may round up at the edge, alike for equal values
    zeros = 56 - np.clip(top, 0, 56)
    shift = np.maximum(np.clip(top, 0, 56) - MANTISSA, 0).astype(U64)
    packed = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((low >> shift) & U64((1 << MANTISSA) - 1)).astype(np.uint16)
    some = filled.any(axis=1)
    empty = ~filled & some[:, None]
    attempt = 0
    out = packed.copy()
    while empty.any():  # borrow: a fixed walk over the buckets until one is filled
        attempt += 1
        walk = (mix(np.arange(REGISTERS, dtype=U64) * U64(1 << 20) + U64(attempt)) % U64(REGISTERS)).astype(np.int64)
        take = empty & filled[:, walk]
        out[take] = packed[:, walk][take]
        empty &= ~take
    out[~some] = 0
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(rows, bands) keys of the bands."""
    parts = sketches.reshape(len(sketches), -1, BAND).astype(U64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=U64) + U64(1), parts.shape[:2]).copy()
    for i in range(BAND):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one sketch with many: share of equal registers, less what collisions add.

    Registers of different minima agree in zeros with 1/3 and in a mantissa with 2**-MANTISSA.
    """
    hit = (many == one).mean(axis=1)
    chance = 2.0**-MANTISSA / 3
    return (hit - chance) / (1 - chance)


def _signatures(source: DataFrame, kind: str, width: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(1))
            for lo, hi in slabs(offsets, SLAB):
                hashes, at = shingle_sets(raw, offsets[lo : hi + 1], width)
                sizes = np.diff(at)
                sums = np.zeros(len(hashes) + 1, U64)
                np.cumsum(mix(hashes), out=sums[1:])
                again = np.zeros(len(hashes) + 1, U64)
                np.cumsum(mix(hashes + U64(0x1234567)), out=again[1:])
                e1, e2 = mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(U64)), again[at[1:]] - again[at[:-1]]
                sketch = np.ascontiguousarray(registers(hashes, at))
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), hi - lo, [None, pa.py_buffer(sketch)]).cast(pa.binary())
                own = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(e1.view(np.int64)), pa.array(e2.view(np.int64)), pa.array(sizes.astype(np.int64)), binary], names=["id", "u", "v", "e1", "e2", "n", "sketch"])

    return source.mapInArrow(work, f"id {kind}, u long, v int, e1 long, e2 long, n long, sketch binary")


def _sketch_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys = band_keys(_sketch_rows(part.column(1)))
                ids, sizes = (np.repeat(np.asarray(part.column(i)), keys.shape[1]) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel().view(np.int64), ids, sizes)], names=["key", "c", "n"])

    return classes.select("c", "sketch", "n").mapInArrow(work, "key long, c long, n long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(c, hashes binary) of the texts' classes."""

    def work(batches):
        for batch in batches:
            raw, offsets = utf8_buffer(batch.column(0))
            for lo, hi in slabs(offsets, SLAB):
                hashes, at = shingle_sets(raw, offsets[lo : hi + 1], width)
                sums = np.zeros(len(hashes) + 1, U64)
                np.cumsum(mix(hashes), out=sums[1:])
                e1 = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64))
                binary = pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(e1.view(np.int64)), binary], names=["c", "hashes"])

    return docs.mapInArrow(work, "c long, hashes binary")


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common_size(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("hashes").alias("x")), "a")
    joined = joined.join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def work(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(work, "a long, b long")


def similar_ones(one: np.ndarray, many: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``many`` sets, none of them empty, are similar enough to ``one``."""
    sizes = np.array([len(x) for x in many])
    values = np.concatenate(many)
    at = np.searchsorted(one, values)
    at[at == len(one)] = 0
    both = np.add.reduceat((one[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(one) + sizes - both)


def block_links(ids, comps, sizes, sketches, sets, left, right, percent: int, band: int | None = None, twice=None):
    """Confirmed links between the rows ``left`` and ``right`` that lie in different components.

    With ``band``, pairs that share an earlier band are left to it. ``twice`` marks rows that stand in ``left``
    as well, of this or another block: a pair of these is compared once, from its smaller id.
    """
    root = {c: c for c in comps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in left:
        ratio = 100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i])
        ratio &= comps[right] != comps[i]
        if twice is not None:
            ratio &= ~twice[right] | (ids[right] > ids[i])
        other = right[ratio]
        if len(other) and band is not None:
            shared = (sketches[other, : BAND * (band + 1)] == sketches[i, : BAND * (band + 1)]).reshape(len(other), -1, BAND).all(axis=2)
            other = other[shared.argmax(axis=1) == band]
        if len(other):
            other = other[estimate(sketches[i], sketches[other]) >= percent / 100 - SLACK]
        other = [j for j in other if find(comps[j]) != find(comps[i])]
        if not other:
            continue
        for j in np.asarray(other)[similar_ones(sets[i], [sets[j] for j in other], percent)]:
            a, b = find(comps[i]), find(comps[j])
            if a != b:
                root[a] = b
                out.append((ids[i], ids[j]))
    return out


def _residual(rows: DataFrame, percent: int) -> DataFrame:
    """rows: key, bi, bj, side, c, comp, n, sketch, hashes -> confirmed links (a, b).

    Side 0 is compared with the others: 1 lies in the band's largest component, 2 outside (and stands on side 0 too),
    3 outside in a band of one block (and stands for side 0 itself).
    """

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comps, sizes, side = (np.asarray(table.column(x)) for x in ("c", "comp", "n", "side"))
        sketches = _sketch_rows(table.column("sketch"))
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("hashes")]
        band = int(np.argmax(band_keys(sketches[:1])[0].view(np.int64) == table.column("key")[0].as_py()))
        found = block_links(ids, comps, sizes, sketches, sets, np.flatnonzero((side == 0) | (side == 3)), np.flatnonzero(side > 0), percent, band, side >= 2)
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return rows.groupBy("key", "bi", "bj").applyInArrow(group, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, tag: str = "near") -> DataFrame:
    """Per row of ``docs``: id_col, n_shingles, component_id (smallest id of the group), kept, and u, v (hashes of id and text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("_lt_id"), text.alias("_lt_text"), F.xxhash64(id_col, text).alias("u"), F.hash(id_col, text).alias("v"))
    signs = written(_signatures(source, kind, width), f"{tag}-signs")
    classes = (
        signs.where("n > 0 AND id IS NOT NULL")
        .groupBy("e1", "e2")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumnRenamed("e1", "c")
    )
    classes = written(classes, f"{tag}-classes")
    bands = _bands(classes)
    groups = bands.groupBy("key").agg(F.min("c").alias("p"), F.count("*").alias("k")).where("k > 1")
    members = written(bands.join(groups, "key").select("key", "c", "n", "p", "k"), f"{tag}-members")

    wanted = members.select("c").distinct().join(classes, "c").select(F.col("id").alias("_lt_id")).distinct()
    wanted = written(wanted, f"{tag}-wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS
    chosen = source.join(F.broadcast(wanted) if few else wanted, "_lt_id", "left_semi").select("_lt_text")
    sets = written(_sets(chosen, width).groupBy("c").agg(F.first("hashes").alias("hashes")), f"{tag}-sets")

    pairs = members.where("c <> p").select(F.col("c").alias("a"), F.col("p").alias("b"))
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = written(_confirm(first, sets, percent), f"{tag}-links")
    comps = written(components(links, tag), f"{tag}-comps")
    left = pairs.distinct().join(first, ["a", "b"], "left_anti")
    left = _label(_label(left, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")
    more = written(_confirm(left, sets, percent), f"{tag}-links")

    placed = _label(members.where("k > 2").select("key", "c", "n"), comps, "c", "comp")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    most = F.max_by(F.struct("comp", "rows", "size"), F.struct("rows", "comp"))
    parts = parts.groupBy("key").agg(most.alias("most"), F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, 8 * size / BLOCK_BYTES)).cast("int")
    rest = blocks(F.col("rows") - F.col("most.rows"), F.col("size") - F.col("most.size"))
    parts = parts.select("key", F.col("most.comp").alias("most"), blocks(F.col("rows"), F.col("size")).alias("nj"), rest.alias("ni"))
    open_rows = placed.drop("n").join(parts, "key")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    # members outside the largest component meet every block; every member meets their few blocks
    fewer = open_rows.where("comp <> most AND (ni > 1 OR nj > 1)").select("key", "c", "comp", block("ni").alias("bi"), each("nj").alias("bj"), F.lit(0).alias("side"))
    side = F.when(F.col("comp") == F.col("most"), 1).when((F.col("ni") > 1) | (F.col("nj") > 1), 2).otherwise(3).alias("side")
    every = open_rows.select("key", "c", "comp", each("ni").alias("bi"), block("nj").alias("bj"), side)
    open_rows = fewer.unionAll(every)
    full = open_rows.join(classes.select("c", "n", "sketch"), "c").join(sets, "c")
    rest = written(_residual(full, percent), f"{tag}-links")
    later = more.unionAll(rest)
    if not later.isEmpty():
        known = comps.select(F.col("node").alias("a"), F.col("root").alias("b"))
        comps = written(components(known.unionAll(later), tag), f"{tag}-comps")

    named = _label(classes.select("c", "e2", "id"), comps, "c", "comp")
    lowest = named.groupBy("comp").agg(F.min("id").alias("component"))
    result = named.join(lowest, "comp").select(F.col("c").alias("e1"), "e2", "component")
    return (
        signs.select("id", "u", "v", "e1", "e2", "n")
        .join(written(result, f"{tag}-result"), ["e1", "e2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
            F.when((F.col("n") == 0) | F.col("id").isNull(), True).otherwise(F.col("id") == F.col("component")).alias("kept"),
            "u",
            "v",
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows that repeat both id and text count as one row; of rows with the smallest id and different texts one stays.
    """
    found = near_duplicates(docs, id_col, text_col, **names)
    alone = found.where("kept AND (component_id IS NULL OR n_shingles = 0)").select("u", "v")
    chosen = found.where("kept AND component_id IS NOT NULL AND n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("u", "v")).alias("x"))
    u, v = fresh(docs, "_lt_u"), fresh(docs, "_lt_v")
    stay = written(alone.unionAll(chosen.select("x.u", "x.v")).distinct().select(F.col("u").alias(u), F.col("v").alias(v)), "stay")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumns({u: F.xxhash64(id_col, text), v: F.hash(id_col, text)})
    return named.join(stay, [u, v]).dropDuplicates([u, v]).select(*docs.columns)


def _label(rows: DataFrame, comps: DataFrame, on: str, name: str) -> DataFrame:
    """Adds the component of ``on``; a node without links is its own."""
    found = comps.select(F.col("node").alias(on), F.col("root").alias("_root"))
    return rows.join(found, on, "left").withColumn(name, F.coalesce("_root", on)).drop("_root")
