"""Repeated-window removal (bytes and words) against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lattica.llm import anchors, queries
from lattica.llm.debruijn_dedup import nonbranching_paths, remove_repeated_words, stretches
from lattica.llm.suffix_dedup import digit_ranks, radix_groups, remove_repeated_bytes


def brute(tokens: list, length: int):
    """Removed positions of each token list."""
    seen = Counter(tuple(t[i : i + length]) for t in tokens for i in range(len(t) - length + 1))
    out = []
    for t in tokens:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append(gone)
    return out


def runs(gone: set) -> list[tuple[int, int]]:
    spans = []
    for x in sorted(gone):
        if spans and spans[-1][1] == x:
            spans[-1][1] = x + 1
        else:
            spans.append([x, x + 1])
    return [tuple(s) for s in spans]


def corpus(seed: int, unit: str) -> list[str | None]:
    rng = random.Random(seed)
    atom = (lambda: rng.choice("abcé ")) if unit == "bytes" else (lambda: rng.choice(["x", "yy", "zé", "w.", "q"]) + rng.choice([" ", " ", "\n", "\t\t", "  "]))
    make = lambda n: "".join(atom() for _ in range(n))
    passage = make(40)
    texts = [make(rng.randint(0, 60)) for _ in range(40)]
    texts += [make(rng.randint(0, 30)) + passage + make(rng.randint(0, 30)) for _ in range(25)]
    texts += [passage * 2, passage, passage, "a" * 90, "x " * 70, make(400), "", None, "abc"]
    texts += [texts[0]] * 3
    return texts


def check(spark, texts, remove, split, join, length):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, k string, u int").repartition(3)
    got = {r.doc_id: r for r in remove(docs).collect()}
    tokens = [split(t or "") for t in texts]
    assert len(got) == len(texts)
    removed = 0
    for i, gone in enumerate(brute(tokens, length)):
        r = got[i]
        assert [(s.start, s.end) for s in r.spans] == runs(gone), (i, texts[i])
        assert (r.n_tokens, r.n_removed) == (len(tokens[i]), len(gone))
        assert bytes(r.kept) == join([x for j, x in enumerate(tokens[i]) if j not in gone])
        removed += len(gone)
    assert removed


as_bytes = (lambda t: [bytes([b]) for b in t.encode()], b"".join)


@pytest.mark.parametrize(("seed", "length", "gram", "hot", "slab"), [(1, 12, 4, 256, 1 << 19), (2, 12, 4, 1, 1 << 19), (3, 20, 3, 4, 128), (4, 9, 9, 256, 64)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, length, gram, hot, slab):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "SLAB", slab)
    check(spark, corpus(seed, "bytes"), lambda d: remove_repeated_bytes(d, length=length, gram=gram), *as_bytes, length)


def ascii_words(text: str) -> list[bytes]:
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


@pytest.mark.parametrize(("seed", "length", "gram", "hot", "slab"), [(1, 8, 3, 256, 1 << 19), (5, 6, 6, 1, 1 << 19), (6, 9, 2, 4, 64)])
def test_words_against_brute_force(spark, monkeypatch, seed, length, gram, hot, slab):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "SLAB", slab)
    texts = [*corpus(seed, "words"), "a\u00a0b c\x1cd\u2003e " * 12, "\x0b\x0c\r\n\t "]
    check(spark, texts, lambda d: remove_repeated_words(d, length=length, gram=gram), ascii_words, b" ".join, length)


def test_stretches():
    values = anchors.mix(np.array([ord(c) for c in "abcdefgh--abcdefgh--abcdXfgh"], np.uint64))
    start = np.concatenate([np.arange(0, 5), np.arange(10, 15), np.arange(20, 25)])
    run = np.repeat([0, 1, 2], 5)
    a, b, t, x, y, e = stretches(values, start, run, np.ones(15, np.int64), 4)
    assert list(zip(a, b, t)) == [(0, 1, 3), (1, 5, 2), (5, 6, 3), (6, 10, 2), (10, 11, 3)]
    assert e[0] == e[2] == e[4] != e[1] == e[3] and y[0] == x[1] and y[1] == y[3] and x[0] == x[4]


def test_nonbranching_paths(spark):
    # 1 -> 2 -> 3 -> ... -> 9 by nodes, a branch at node 30, a cycle of 50 and 51, a change of multiplicity
    rows = [(i, i, i + 1, 2, 10 + i) for i in range(1, 10)] + [(30, 29, 30, 2, 1), (31, 30, 32, 2, 1), (32, 30, 33, 2, 1)]
    rows += [(50, 60, 61, 2, 3), (51, 61, 60, 2, 3), (70, 80, 81, 3, 4), (71, 81, 82, 2, 4), (90, 95, 95, 2, 1)]
    edges = spark.createDataFrame(rows, "e long, x long, y long, t int, n int")
    got = {r.e: (r.head, r.off, r.size) for r in nonbranching_paths(edges, "test").collect()}
    assert got.pop(9) == (1, sum(range(11, 19)), sum(range(11, 20)))
    assert got.pop(1) == (1, 0, sum(range(11, 20))) and all(got.pop(i)[0] == 1 for i in range(2, 9))
    assert got == {e: (e, 0, n) for e, _, _, _, n in rows[9:]}


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_removed int")
    assert remove_repeated_bytes(docs).count() == 0
    assert remove_repeated_words(docs).count() == 0
    docs = spark.createDataFrame([(None, "q" * 500), (7, None), (7, "q" * 400)], "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens, r.n_removed) for r in remove_repeated_bytes(docs).collect()}
    assert got == {(None, 500, 500), (7, 0, 0), (7, 400, 400)}


def test_radix_groups():
    data = np.frombuffer(b"abcdefgh--abcdefgh--abcdefgx", np.uint8)
    got = radix_groups(data, np.array([0, 10, 20]), np.zeros(3, np.int64), np.ones(3), 8)
    assert got.tolist() == [True, True, False]
    assert radix_groups(data, np.array([0, 10, 20]), np.array([0, 1, 0]), np.ones(3), 7).tolist() == [True, False, True]
    assert radix_groups(data, np.array([20]), np.zeros(1, np.int64), np.array([2]), 8).tolist() == [True]


@pytest.mark.parametrize("width", [1, 4, 8, 32])
def test_digit_ranks_follow_the_bytes(width):
    data = np.frombuffer(bytes(random.Random(width).choices(b"ab\xff\x00", k=400)), np.uint8)
    raw = data.tobytes()
    places = list(range(len(raw) - width + 1))
    ranks = digit_ranks(data, width)
    by_rank, by_bytes = sorted(places, key=lambda p: ranks[p]), sorted(places, key=lambda p: raw[p : p + width])
    assert [raw[p : p + width] for p in by_rank] == [raw[p : p + width] for p in by_bytes]
    assert len({raw[p : p + width] for p in places}) == len({int(ranks[p]) for p in places})


def brute_digests(texts, length, split, join):
    """n, n_removed, spans and digest of every text, from 64-bit rolling names of all windows."""
    import hashlib

    tokens = [split(t or "") for t in texts]
    seen = Counter(hash(b"\x00".join(t[i : i + length]) if join is None else t[i : i + length]) for t in tokens for i in range(len(t) - length + 1))
    for t in tokens:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[hash(b"\x00".join(t[i : i + length]) if join is None else t[i : i + length])] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = b" ".join(x for x, g in zip(t, gone) if not g) if join is None else bytes(b for b, g in zip(t, gone) if not g)
        edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        yield len(t), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()


@pytest.fixture(scope="module")
def repeated_documents(spark, sf, tmp_path_factory):
    """sf0.001 documents with identical rows, copies, a null and a long text added, as a folder of tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.limit(3).unionByName(docs.where("doc_id >= 0").limit(6).withColumn("doc_id", docs.doc_id + 100_000))
    long = docs.limit(2).withColumn("doc_id", docs.doc_id + 200_000).withColumn("text", F.repeat("text", 3))
    none = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    folder = str(tmp_path_factory.mktemp("repeated"))
    docs.unionByName(rows).unionByName(long).unionByName(none).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_queries_against_brute_force(spark, repeated_documents):
    rows = spark.read.parquet(f"{repeated_documents}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = [r.doc_id for r in rows], [r.text for r in rows]
    want = list(brute_digests(texts, 400, lambda t: t.encode(), b""))
    got = queries.op1_suffix_dedup(spark, repeated_documents).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, w in zip(ids, want))
    assert sum(w[1] for w in want) > 0
    want = list(brute_digests(texts, 35, ascii_words, None))
    got = queries.op7_debruijn_dedup(spark, repeated_documents).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, w[0], w[1], w[3]) for i, w in zip(ids, want))


def test_texts_over_a_slab(spark):
    """Two texts of over 1 MB that share a stretch across a slab's edge, one with a word longer than a slab."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    shared = words(3000)
    texts = [words(74_000) + " " + shared + " " + words(90_000), words(20) + " " + shared + " " + "z" * 700_000 + " " + words(40), words(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_removed) for r in remove_repeated_words(docs).collect()}
    assert got == {0: (167_000, 3000), 1: (3061, 3000), 2: (50, 0)}
    got = {r.doc_id: (r.n_tokens, r.n_removed) for r in remove_repeated_bytes(docs).collect()}
    # the blanks at both ends of the stretch are equal too
    assert got == {0: (len(texts[0]), len(shared) + 2), 1: (len(texts[1]), len(shared) + 2 + 700_000), 2: (len(texts[2]), 0)}


@pytest.mark.parametrize("remove", [remove_repeated_bytes, remove_repeated_words])
def test_many_identical_rows(spark, remove):
    """20,000 rows of one id and text, among others that share a passage with them."""
    rng = random.Random(2)
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (120, 120, 90, 40)]
    same = f"{words[0]} {words[1]}"
    others = [f"{words[2]} {words[0]}", words[3]]
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(same).alias("text"))
    docs = docs.unionAll(spark.createDataFrame(list(enumerate(others)), "doc_id long, text string"))
    got = remove(docs).groupBy("doc_id", "n_tokens", "n_removed").count().collect()
    unit = (lambda t: len(t)) if remove is remove_repeated_bytes else (lambda t: len(t.split()))
    removed = {7: unit(same), 0: unit(words[0]), 1: 0}
    counts = {7: 20_000, 0: 1, 1: 1}
    assert {r.doc_id: (r.n_tokens, r.n_removed, r["count"]) for r in got} == {i: (unit(t), removed[i], counts[i]) for i, t in ((7, same), (0, others[0]), (1, others[1]))}


def test_planted_passages_of_over_50_words(spark, tmp_path):
    """Passages of 51 to 200 words, each in three texts: those of 400 bytes go from all three, shorter ones and clean texts stay; n_bytes knows of neither."""
    rng = random.Random(8)
    words = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
    planted = [words(n, letters) for letters in ("abcdefgh", "abcdéßñh") for n in (51, 55, 60, 80, 120, 200)]
    rows = [f"{words(rng.randint(1, 300), 'rstuvwxy')}\n{p}\n{words(rng.randint(1, 300), 'rstuvwxy')}" for p in planted for _ in range(3)]
    held = [len(p.encode()) + 2 for p in planted for _ in range(3)]  # the line ends around it are equal too
    rows += [words(400, "rstuvwéy") for _ in range(30)]
    held += [0] * 30
    assert min(x for x in held if x) < 400 < max(held)
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (text, n) in enumerate(zip(rows, held)):
        assert got[i].n_bytes == len(text.encode())
        assert (got[i].n_spans, got[i].n_removed >= n) == (1, True) if n >= 400 else (got[i].n_spans, got[i].n_removed) == (0, 0), (i, n)
        assert got[i].n_removed <= n + 4  # equal letters by chance at the edges
