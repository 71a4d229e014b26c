"""HyperMinHash near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest

from lattica.llm import components as H_components
from lattica.llm import hyperminhash as H
from lattica.llm.components import components


def shingles(text: str | None, width: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(texts, width, percent=80):
    """(set size, component as smallest index) of each text."""
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed: int):
    rng = random.Random(seed)
    words = ["the", "of", "And", "x.", "é", "Éa"] * 3 + [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [make(rng.choice([1, 2, 3, 5, 8, 20, 60, 200])) for _ in range(60)]
    for base in [make(40), make(150), make(12), *texts[:20]]:
        for _ in range(rng.choice([1, 2, 15])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 9))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    chain = make(100)
    for i in range(12):  # a long chain of small steps
        texts.append(list(chain))
        for _ in range(5):
            chain[rng.randrange(100)] = f"c{rng.random()}"
    return [" ".join(t) for t in texts] + ["", None, " \n", "THE", "the", "the of", "The\tOF ", "the of", "É", "é"]


@pytest.mark.parametrize(("seed", "width", "block", "ids"), [(1, 2, 512, 10**6), (2, 5, 2, 0)])
def test_groups_against_brute_force(spark, monkeypatch, seed, width, block, ids):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "MAX_BROADCAST_IDS", ids)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)], "doc_id long, text string, c string, n int").repartition(3)
    got = {r.doc_id: r for r in H.near_duplicates(docs, width=width).collect()}
    assert len(got) == len(texts)
    for i, (n, root) in enumerate(brute(texts, width)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, root == i), (i, texts[i])


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "A B c"), (2, "A B c"), (1, None), (1, " ")], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in H.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (1, 0, 1, True), (1, 0, 1, True)], key=str)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            n = 2000
            both = int(2 * n * share / (1 + share))
            pool = np.unique(rng.integers(0, 2**63, 2 * n + 10, dtype=np.uint64))
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            s = H.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            errors.append(H.estimate(s[0], s[1:])[0] - share)
        assert abs(np.mean(errors)) < 0.03


def test_residual_blocks_link_what_pivots_miss():
    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    at = np.cumsum([0] + [len(s) for s in sets])
    sk = H.registers(np.concatenate(sets), at)
    left = np.arange(3)
    assert H.block_links(np.array([7, 8, 9]), left, np.diff(at), sk, sets, left, left, 80) == [(7, 8)]
    assert H.block_links(np.array([7, 8, 9]), np.array([1, 1, 2]), np.diff(at), sk, sets, left, left, 80) == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (9, 9)]
    rows = spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long")
    got = {r.node: r.root for r in components(rows, "t").collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


def test_query_against_all_pairs_of_documents(spark):
    """Recall 1 on the 1,000 documents of sf0.01: every link of the exact join is inside a group."""
    from lattica.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r) for r in queries.op8_hyperminhash(spark, sf).collect()}
    want = brute([t for _, t in rows], 2)
    assert got == {d: (d, n, rows[root][0], rows[root][0] == d) for (d, _), (n, root) in zip(rows, want)}
    assert sum(d != c for d, _, c, _ in got.values()) > 50


def test_rows_of_one_block_travel_once(spark, monkeypatch):
    """A band of one block sends each member to the comparison once, whichever component it lies in."""
    sent = []
    real = H._residual
    monkeypatch.setattr(H, "_residual", lambda rows, percent: sent.append(rows.groupBy("key", "c").count().where("count > 1").count()) or real(rows, percent))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(1))], "doc_id long, text string")
    assert H.near_duplicates(docs).count() == docs.count()
    assert sent == [0]


def test_settled_links_need_no_round(spark, monkeypatch):
    """Links within one batch are contracted before any shuffle; a star is its own answer."""
    from lattica.llm import components as C

    names = []
    monkeypatch.setattr(C, "written", lambda df, name, real=C.written: names.append(name) or real(df, name))
    rows = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(50, 41), (60, 50)], "a long, b long").coalesce(1)
    got = {r.node: r.root for r in C.components(rows, "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 41: 41, 50: 41, 60: 41}
    assert names == ["t-edges"]


def test_forest_keeps_components():
    rng = random.Random(5)
    for n, m in ((2, 1), (30, 20), (200, 150), (200, 600)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 3)]
        root = {x: x for pair in links for x in pair}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        a, b = (np.array(x) for x in zip(*links))
        assert dict(zip(*(x.tolist() for x in H_components.forest(a, b)))) == {k: v for k, v in root.items() if k != v}


def test_pairs_of_several_bands_are_compared_once(monkeypatch):
    """In all common bands together every pair meets the exact comparison once, and all links are found."""
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(0, 2**63, 900, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, 780, replace=False)) for _ in range(30)]
    at = np.cumsum([0] + [len(s) for s in sets])
    sketches, ids = H.registers(np.concatenate(sets), at), np.arange(30)
    seen = []
    exact = H.similar_ones
    monkeypatch.setattr(H, "similar_ones", lambda one, many, percent: seen.extend((one.tobytes(), x.tobytes()) for x in many) or exact(one, many, percent))
    keys = H.band_keys(sketches)
    for band in range(keys.shape[1]):
        for key in np.unique(keys[:, band]):
            rows = np.flatnonzero(keys[:, band] == key)
            if len(rows) > 1:
                take = [x[rows] for x in (ids, ids, np.diff(at), sketches)]
                inside = np.arange(len(rows))
                H.block_links(*take, [sets[i] for i in rows], inside, inside, 80, band, np.ones(len(rows), bool))
    pairs = {frozenset(p) for p in seen}
    shared = {frozenset((sets[i].tobytes(), sets[j].tobytes())) for i in range(30) for j in range(i) if (keys[i] == keys[j]).any()}
    assert shared and len(seen) == len(pairs) and pairs <= shared and len(pairs) > 0.9 * len(shared)
