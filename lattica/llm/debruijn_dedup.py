"""Removal of repeated word windows by compaction of a de Bruijn graph.

Edges are the ``length``-word windows of the corpus, nodes the ``length - 1`` words that two
consecutive ones share. Only windows whose anchor occurs more than once (see ``anchors``) become edges,
and copies of a run of windows are one run of a weight. The graph is built and compacted in these steps:

1. edges are counted, by two independent hashes of their words, and those of multiplicity one are cut;
2. consecutive edges of one multiplicity inside a run are one stretch: an edge of the compacted graph
   between two nodes, with the words between as its length;
3. Spark joins stretches at nodes that one stretch enters and one leaves, both of one multiplicity, and
   follows these links by pointer doubling to the head of each nonbranching path (a cycle stays in stretches);
4. source coordinates verify the paths: the stretches of an occurrence must stand one after the other, with no gap
   from the path's first word to its last, in at least two places. Such an occurrence is one long
   repeated span; stretches of a path that is not found whole twice stand for themselves.

Steps 1 and 2 run in one task per anchor; anchors with too many distinct runs for one task (see
``anchors``) give a row per edge, which Spark counts and glues.

Defined results: a null text has no words; a text of fewer than ``length`` words loses
nothing; windows may overlap and repeat inside one text; rows that repeat an id or a text are texts of
their own and so copies of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import _BASE2, U64, Words, by_anchor, cut, cutter, gathered, keyed, mix, prefix, remove_spans, shared_runs, stretch
from .common import drop, written

_STRETCHES = "k long, c long, a int, b int, m int, t int, x long, y long, e long"


def multiplicity(key: np.ndarray, check: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Total weight of the entries with the same key and check, for each entry."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(key), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=weight[order]) if len(key) else np.zeros(0)
    out = np.empty(len(key), np.int64)
    out[order] = total[group]
    return out


def stretches(tokens: np.ndarray, start: np.ndarray, run: np.ndarray, weight: np.ndarray, length: int):
    """Stretches of repeated windows: (first, last + 1: places in ``start``; multiplicity, node before, node after, name).

    ``start`` are the windows' places in ``tokens``, ``run`` the run each belongs to, ``weight`` how
    often it stands for itself.
    """
    sums, check = prefix(tokens), prefix(tokens, _BASE2)
    times = multiplicity(stretch(sums, start, length), stretch(check, start, length, _BASE2), weight)
    live = times > 1
    joined = live[1:] & live[:-1] & (run[1:] == run[:-1]) & (times[1:] == times[:-1])
    a = np.flatnonzero(live & ~np.concatenate([[False], joined])) if len(live) else np.zeros(0, np.int64)
    b = np.flatnonzero(live & ~np.concatenate([joined, [False]])) + 1 if len(live) else np.zeros(0, np.int64)
    n = b - a
    node = lambda at: stretch(sums, at, length - 1)
    name = mix(stretch(sums, start[a], n + length - 1) ^ mix(stretch(check, start[a], n + length - 1, _BASE2) + n.astype(U64)))
    return a, b, times[a], node(start[a]), node(start[b - 1] + 1), name


def _edges(length: int):
    """Decides whole anchors: columns k, c, m, n, t -> stretches."""

    def decide(col):
        raw, offsets = col["t"]
        tokens, at = raw[offsets[0] : offsets[-1]].copy().view(U64), (offsets[:-1] - offsets[0]) // 8
        n = col["n"].astype(np.int64)
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        a, b, t, x, y, e = stretches(tokens, at[run] + step, run, col["m"][run], length)
        r = run[a]
        return col["k"][r], col["c"][r], step[a].astype(np.int32), (step[b - 1] + 1).astype(np.int32), col["m"][r], np.minimum(t, 1 << 30).astype(np.int32), x.view(np.int64), y.view(np.int64), e.view(np.int64)

    return decide


def repeated_stretches(texts: DataFrame, contents: DataFrame, unit: Words, tag: str) -> DataFrame:
    """Steps 1 and 2: k, c, a, b (windows of the run), m, t (multiplicity), x, y (nodes), e (name)."""
    wanted = contents.where("d > 1 OR m > 1").withColumn("hot", F.col("d") > gathered(contents))
    one = lambda x, kind: np.asarray([x], kind)

    def whole(tokens, run):
        return one(run["k"], np.int64), one(run["c"], np.int64), one(run["m"], np.int32), one(run["n"], np.int32), tokens

    def single(tokens, run):
        n, sums, check = run["n"], prefix(tokens), prefix(tokens, _BASE2)
        i = np.arange(n)
        h, g = stretch(sums, i, unit.length).view(np.int64), stretch(check, i, unit.length, _BASE2).view(np.int64)
        x = stretch(sums, np.arange(n + 1), unit.length - 1).view(np.int64)
        return np.full(n, run["k"]), np.full(n, run["c"]), np.full(n, run["m"], np.int32), i.astype(np.int32), h, g, x[:-1], x[1:]

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    pieces = cut(texts, wanted.where("NOT hot"), cutter(unit, ["k", "c", "m", "n", "t"], [*kinds, pa.binary()], whole), "k long, c long, m int, n int, t binary")
    found = by_anchor(pieces, _edges(unit.length), _STRETCHES)
    if wanted.where("hot").isEmpty():
        return written(found, f"{tag}-found")
    rows = cut(texts, wanted.where("hot"), cutter(unit, ["k", "c", "m", "i", "h", "g", "x", "y"], [*kinds, *[pa.int64()] * 4], single), "k long, c long, m int, i int, h long, g long, x long, y long")
    rows = written(rows, f"{tag}-edges")
    often = rows.groupBy("h", "g").agg(F.least(F.sum("m"), F.lit(1 << 30)).cast("int").alias("t")).where("t > 1")
    island = F.col("i") - F.row_number().over(Window.partitionBy("k", "c", "t").orderBy("i"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", "h", "g"))), lambda w: F.struct(w["h"], w["g"]))
    glued = rows.join(often, ["h", "g"]).withColumn("z", island).groupBy("k", "c", "t", "z").agg(
        F.min("i").alias("a"), (F.max("i") + 1).cast("int").alias("b"), F.first("m").alias("m"), F.min_by("x", "i").alias("x"), F.max_by("y", "i").alias("y"), F.xxhash64(words).alias("e")
    )
    found = written(found.unionAll(glued.select("k", "c", "a", "b", "m", "t", "x", "y", "e")), f"{tag}-found")
    drop(rows)
    return found


def nonbranching_paths(edges: DataFrame, tag: str) -> DataFrame:
    """Step 3: (e, head, off, size) of the edges (e, x, y, t, n): the first edge of its path, how far from it, the length of the path.

    A node joins its edges if one enters and one leaves, both of one multiplicity. Every round doubles the
    reach of all pointers; edges still under way when any path would be done lie on a cycle.
    """
    ends = edges.select(F.col("x").alias("z"), F.lit(1).alias("leaves"), F.lit(0).alias("enters"), "e", "t", "n").unionAll(edges.select("y", F.lit(0), F.lit(1), "e", "t", "n"))
    nodes = ends.groupBy("z").agg(
        F.sum("leaves").alias("leaves"),
        F.sum("enters").alias("enters"),
        F.max(F.when(F.col("leaves") == 1, F.col("e"))).alias("e"),
        F.max(F.when(F.col("enters") == 1, F.struct("e", "n"))).alias("before"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
    )
    links = nodes.where("leaves = 1 AND enters = 1 AND t0 = t1 AND e <> before.e")
    state = written(links.select("e", F.col("before.e").alias("p"), F.col("before.n").cast("long").alias("off"), F.lit(False).alias("done")), f"{tag}-pointers")
    rounds = int(state.count()).bit_length() + 1
    for _ in range(rounds):
        if state.where("NOT done").isEmpty():
            break
        ahead = state.select(F.col("e").alias("p"), F.col("p").alias("pp"), F.col("off").alias("more"), F.col("done").alias("end"))
        step = state.where("NOT done").join(ahead, "p", "left").select(
            "e", F.coalesce("pp", "p").alias("p"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.coalesce("end", F.lit(True)).alias("done")
        )
        after = written(state.where("done").unionAll(step), f"{tag}-pointers")
        drop(state)
        state = after
    placed = edges.join(state.where("done").select("e", "p", "off"), "e", "left")
    placed = written(placed.select("e", F.coalesce("p", "e").alias("head"), F.coalesce("off", F.lit(0).cast("long")).alias("off"), "n"), f"{tag}-placed")
    drop(state)
    sizes = placed.groupBy("head").agg(F.max(F.col("off") + F.col("n")).alias("size"))
    return placed.join(sizes, "head").select("e", "head", "off", "size")


def long_spans(occurrences: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """Steps 3 and 4: (u, v, s, n) of the repeated spans, in windows, of occurrences (k, c, at)."""
    edges = found.groupBy("e").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max("t").alias("t"), F.first(F.col("b") - F.col("a")).alias("n"))
    edges = written(edges, f"{tag}-graph")
    paths = nonbranching_paths(edges, tag)
    placed = found.select("k", "c", "a", "b", "e").join(paths, "e").select("k", "c", "a", "b", "head", "off", "size")
    parts = occurrences.join(placed, ["k", "c"]).select(F.explode("at").alias("p"), "a", "b", "head", "size", "off")
    parts = parts.select("p.u", "p.v", "head", "size", (F.col("p.s") + F.col("a")).alias("s"), (F.col("b") - F.col("a")).alias("n"), "off")
    # rows that repeat id and text share their name, so each stretch of a place counts once
    parts = parts.distinct().withColumn("start", F.col("s") - F.col("off"))
    whole = parts.groupBy("u", "v", "head", "size", "start").agg(F.sum("n").alias("covered"), F.collect_list(F.struct("s", "n")).alias("parts"))
    whole = written(whole, f"{tag}-spans")
    for spent in (occurrences, found, edges, paths):  # what follows reads the spans alone
        drop(spent)
    twice = whole.where("covered = size").groupBy("head").agg(F.count("*").alias("places")).where("places > 1").select("head", F.lit(True).alias("verified"))
    judged = whole.join(twice, "head", "left")
    spans = judged.where("verified AND covered = size").select("u", "v", F.col("start").cast("int").alias("s"), F.col("size").cast("int").alias("n"))
    rest = judged.where("verified IS NULL OR covered <> size").select("u", "v", F.explode("parts").alias("p")).select("u", "v", "p.s", "p.n")
    return spans.unionAll(rest)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, gram: int = 6) -> DataFrame:
    """Removes every word covered by a ``length``-word window whose sequence also starts anywhere else.

    Per row: the id, n_tokens (words), n_removed, spans (maximal removed word ranges), kept
    (remaining words joined by one space, binary).
    """
    unit, tag = Words(length, gram), "debruijn"
    texts = keyed(docs, id_col, text_col)
    occurrences, contents = shared_runs(texts, unit, tag)
    found = repeated_stretches(texts, contents, unit, tag)
    drop(contents)
    return remove_spans(docs, texts, long_spans(occurrences, found, tag), unit, id_col)
