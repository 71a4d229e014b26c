"""Registered queries without SQL against plain Python over whole tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import pytest

from lattica.plans import graph, registry, relational, statistics, texts

SF = "/root/testdata/sf0.01"


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def found(text, names, fold):
    """Leftmost-longest matches of word sequences, by one alternation; words are runs of ASCII letters and digits."""
    words = {tuple(re.findall("[a-z0-9]+" if fold else "[A-Za-z0-9]+", n.lower() if fold else n)): t for t, n in names}
    pattern = "|".join("[^A-Za-z0-9]+".join(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    for m in re.finditer(f"(?<![A-Za-z0-9])(?:{pattern})(?![A-Za-z0-9])", text.lower() if fold else text):
        yield words[tuple(re.findall("[A-Za-z0-9]+", m[0]))]


def test_matcher_over_documents(spark):
    n, docs = Counter(), Counter()
    for text in documents(spark).values():
        assert text == __import__("unicodedata").normalize("NFKC", text)
        hits = [(t, "ci") for t in found(text, [("T:the", "the"), ("T:of", "of"), ("M:ofthe", "of the"), ("M:and", "and"), ("T:la", "la")], True)]
        hits += [(t, "cs") for t in found(text, [("M:gnu", "GNU General Public License"), ("T:la2", "La"), ("M:in", "In")], False)]
        hits = [h for h in hits if h[0] != "T:la2"]
        n.update(hits)
        docs.update(set(hits))
    # "la" and "La" of mode ci are one sequence of two terms, so neither counts
    want = {k: (v, docs[k]) for k, v in n.items() if k != ("T:la", "ci")}
    assert {(r.term_id, r["mode"]): (r.n, r.docs) for r in texts.t03(spark, SF).collect()} == want


def test_numbers_over_documents(spark):
    want = {}
    for d, text in documents(spark).items():
        values = [float(x) for x in re.findall(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w]|\.\d)", text, re.ASCII)]
        if values:
            want[d] = (len(values), max(values))
    assert {r.doc_id: (r.n, r.largest) for r in texts.t10(spark, SF).collect()} == want


def test_shards_and_samples(spark):
    orders = [(r.o_orderkey, r.o_orderpriority, r.o_custkey) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_custkey").collect()]
    want = Counter(zlib.crc32(f"salt:{k}".encode()) % 8 for k, _, _ in orders)
    assert {r.part: r.n for r in texts.t25(spark, SF).collect()} == want
    one = sorted(r.o_orderkey for r in relational.n01(spark, SF).collect())
    assert len(one) == 100 and one == sorted(r.o_orderkey for r in relational.n01(spark, SF).collect()) and set(one) <= {k for k, _, _ in orders}
    rows = relational.n02(spark, SF).collect()
    assert len({r.o_orderkey for r in rows}) == len(rows) and max(Counter(r.o_orderpriority for r in rows).values()) <= 20
    items = relational.n03(spark, SF).collect()
    assert sorted(r.item for r in items) == list(range(1, len(items) + 1)) and len({r.doc_id for r in items}) == len(items) == 200


def open_triangles(spark):
    return [(r.a, r.b, r.c) for r in graph.Graph(spark, SF).open().collect()]


def test_greedy_cover_of_all_triangles(spark):
    left, want = open_triangles(spark), []
    for _ in range(5):
        best = min(Counter(t for tri in left for t in tri).items(), key=lambda x: (-x[1], x[0]))
        want.append(best)
        left = [tri for tri in left if best[0] not in tri]
    assert [(r.term, r.covered) for r in graph.g25(spark, SF).collect()] == want


def test_context_overlap_of_all_triangles(spark):
    papers = [set(r.terms) for r in graph.Graph(spark, SF).edges.collect()]
    contexts = {}
    for p in papers:
        for pair in itertools.combinations(sorted(p), 2):
            contexts.setdefault(pair, Counter()).update(p - set(pair))
    want = {}
    for tri in open_triangles(spark):
        cos = []
        for pivot in tri:
            x, y = (contexts[tuple(sorted((pivot, o)))] for o in tri if o != pivot)
            x, y = ({t: n for t, n in c.items() if t not in tri} for c in (x, y))
            dot = sum(n * y.get(t, 0) for t, n in x.items())
            cos.append(dot / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5 if dot else 0.0)
        want[tri] = (max(cos), sum(cos) / 3)
    got = {(r.a, r.b, r.c): (r.s_max, r.s_mean) for r in graph.g20(spark, SF).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[t] == pytest.approx(want[t], abs=2e-6) for t in want)


def test_tails_of_the_null_model(spark):
    rows = statistics.Null(spark, SF).rows().where("observed > 0").limit(60).collect()
    got = {(r.a, r.b, r.c): r.p_value for r in statistics.x02(spark, SF).where("observed > 0").collect()}
    for r in rows:
        mass = [1.0] + [0.0] * r.observed
        for g in r.groups:
            for _ in range(g.n):
                for k in range(r.observed - 1, -1, -1):
                    mass[k] = mass[k] * (1 - g.q) + (mass[k - 1] * g.q if k else 0.0)
        assert got[r.a, r.b, r.c] == pytest.approx(1 - sum(mass[: r.observed]), abs=2e-9)
    labels = {(r.a, r.b, r.c): r for r in statistics.x05(spark, SF).collect()}
    ordered = sorted(labels.values(), key=lambda r: r.p_value)
    low = 1.0
    for rank, r in reversed(list(enumerate(ordered, 1))):
        low = min(low, r.p_value * len(ordered) / rank)
        assert r.q_value == pytest.approx(low, abs=1e-5) and r.label == (r.q_value <= 0.05)


def test_every_query_has_sql_or_a_test():
    tested = "t03_matcher t05_refined_spans t10_numbers_in_text t25_shards n01_seeded_sample n02_stratified_sample n03_blind_shuffle g20_context_overlap g25_greedy_cover x02_upper_tail x05_labels t01_normalise_unicode o06_diversified_order t08_window_evidence t19_example_sentences t19_surface_examples g19_pair_evidence x06_significant_new_triads g18_recall_of_new_triads x15_candidate_bootstrap x16_block_bootstrap x17_paired_difference x19_nested_power x17_all_intervals x19_nested_choice x20_sample_size x28_unit_bootstrap m10_out_of_fold m01_triad_features m12_engine_ranks m09_round_curve m04_svd_similarity x06_significant_part_triads s13_fingerprint".split()
    assert set(registry.queries()) - set(registry.oracle_sql()) <= set(tested)


def test_similarity_by_singular_values(spark):
    """The query against a plain decomposition of the whole matrix of terms and words."""
    import numpy as np

    from lattica.plans import models

    weights, links = models.document_vectors(spark, SF)
    counts, rows = Counter(), {}
    for r in weights.collect():
        counts[r.word] += 1
        rows.setdefault(r.paper_id, {})[r.word] = r.weight
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2_000]]
    place = {w: j for j, w in enumerate(words)}
    of = {}
    for r in links.collect():
        of.setdefault(r.term_id, set()).add(r.paper_id)
    names = sorted(of)
    means = np.zeros((len(names), len(words)))
    for i, t in enumerate(names):
        for p in of[t]:
            for w, x in rows.get(p, {}).items():
                if w in place:
                    means[i, place[w]] += x / len(of[t])
    u, s, vt = np.linalg.svd(means, full_matrices=False)
    low = means @ vt[:8].T
    low /= np.linalg.norm(low, axis=1, keepdims=True)
    got = {(r.a, r.b): r.cos for r in models.m04s(spark, SF).collect()}
    languages = [(j, b) for j, b in enumerate(names) if b.startswith("lang ")]
    assert len(languages) >= 4 and len(got) == len(names) * len(languages)
    assert all(got[a, b] == pytest.approx(float(low[i] @ low[j]), abs=2e-5) for i, a in enumerate(names) for j, b in languages)


def test_significant_triads_of_parts(spark):
    """All new triads of label papers with their exact tails and adjusted values, in plain Python."""
    g = statistics.Null(spark, SF, "part")
    built = [set(r.terms) for r in g.edges.collect()]
    seen = {t for p in built for t in itertools.combinations(sorted(p), 3)}
    papers = {r.paper_id: sorted(r.terms) for r in g.label_edges.collect()}
    docs, found = Counter(), {}
    for p, terms in papers.items():
        docs.update(terms)
        for t in itertools.combinations(terms, 3):
            if t not in seen and not all(x.startswith("T:") for x in t):
                found.setdefault(t, []).append(p)
    sizes = Counter(len(t) for t in papers.values())
    links = sum(d * n for d, n in sizes.items())
    tails = {}
    for t, ps in found.items():
        mass = [1.0] + [0.0] * (len(ps) - 1)  # below the observed number
        for d, n in sizes.items():
            q = 1.0
            for x in t:
                q *= min(1.0, d * docs[x] / links)
            for k in range(len(mass) - 1, -1, -1):  # n binomial trials at once, as few papers are below
                mass[k] = sum(mass[k - i] * math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(min(k, n) + 1))
        tails[t] = 1 - sum(mass)
    order, low, want = sorted(found, key=lambda t: tails[t]), 1.0, {}
    for rank in range(len(order), 0, -1):
        t = order[rank - 1]
        low = min(low, tails[t] * len(order) / rank)
        want[t] = low
    got = {(r.a, r.b, r.c): r for r in statistics.x06p(spark, SF).collect()}
    assert got and len(got) < len(found)
    assert all(r.papers == sorted(found[t]) and r.n_papers == len(found[t]) and r.p_value == pytest.approx(tails[t], abs=2e-9) and r.q_value == pytest.approx(want[t], abs=3e-7) for t, r in got.items())
    assert {t for t, q in want.items() if q <= 0.999e-4} <= got.keys() <= {t for t, q in want.items() if q <= 1.001e-4}
