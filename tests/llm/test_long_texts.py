"""Texts over a slab (524,288 bytes), large payloads, and extra columns whose names clash."""

import hashlib
import random

import numpy as np
import pytest
from test_near import shingles
from test_pii import brute as pii_brute

from lattica.llm import hyperminhash, pii, quality, warc
from lattica.llm.html_text import extract_pages
from lattica.llm.simhash_decontam import pairs


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000)]
    body = rng.choices(words, k=150_000)
    for at in (3, 60_000, 149_990):
        body[at] = f"mail{at}@host.example.org"
    one = " ".join(body)
    two = " ".join([*body[:140_000], *rng.choices(words, k=2000)])
    return [one, two, " ".join(body[70_000:70_060])]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(long_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _lt_text string, u int, hashes string")


def test_near_duplicates(long_docs, long_texts):
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(long_docs).collect()}
    sets = [shingles(t, 2) for t in long_texts]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    assert [(got[i].n_shingles, got[i].component_id) for i in range(3)] == [(len(sets[0]), 0), (len(sets[1]), 0), (len(sets[2]), 2)]


def test_personal_data(long_docs, long_texts):
    got = {r.id: [tuple(s) for s in r.spans] for r in pii.find_pii(long_docs).collect()}
    assert all(got[i] == pii_brute(t) for i, t in enumerate(long_texts)) and len(got[0]) == 3


def test_features_do_not_depend_on_the_slab(long_texts, monkeypatch):
    raw = np.frombuffer(long_texts[0].encode(), np.uint8)
    want = quality.features(raw, np.array([0, len(raw)]))
    monkeypatch.setattr("lattica.llm.anchors.SLAB", 4096)
    assert np.allclose(want, quality.features(raw, np.array([0, len(raw)])))


def test_contaminated_passage(spark, long_docs, long_texts):
    items = spark.createDataFrame([(9, long_texts[2], 1), (8, "none of these words", 1)], "item_id long, text string, m int")
    assert {tuple(r)[:2] for r in pairs(long_docs, items).collect()} == {(0, 9), (1, 9), (2, 9)}


def test_large_payloads(spark):
    rng = random.Random(3)
    big = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz <>/é", k=3_000_000))
    rows = [(1, "u", big, "x"), (2, "u", big, "x"), (3, "u", "a" * 5_000_000, "x")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")).collect()}
    for i, _, html, _ in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3)] == [("revisit", 2), ("response", None), ("response", None)]


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "<article>a</article>", "keep", "b")], "page_id long, html string, text string, _lt_html string")
    assert [tuple(r) for r in extract_pages(pages, ["page_id", "_lt_html"]).collect()] == [(1, "b", "a")]
