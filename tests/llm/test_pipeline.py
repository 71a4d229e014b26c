"""The pipeline stage by stage against brute force, and its edges."""

import public_tokenizers
import sentencepiece
from test_near import brute as near_brute
from test_pii import brute as pii_brute
from test_pii import secrets
from test_quality_decontam import brute as leak_brute

import corpus_pipeline as C
from lattica.llm import pii
from lattica.llm.common import written
from lattica.llm.quality import score_documents


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r.doc_id for r in score_documents(docs, labels).where("predicted = 1").collect()}
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, sf), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count()
        ids = sorted(before)
        if name == "quality_classifier":
            assert set(after) == good & set(before)
        elif name == "minhash_near_dedup":
            found = near_brute([before[i].text for i in ids], 5)
            assert set(after) == {ids[root] for _, root in found}
            assert len(after) < len(before)
        elif name == "benchmark_decontamination":
            dirty = {d for d, *_ in leak_brute([(i, before[i].text) for i in ids], items)}
            assert set(after) == set(before) - dirty
        elif name == "pii_redaction":
            assert set(after) == set(before)
            for i, hidden in zip(ids, secrets([before[i].text for i in ids])):
                spans = sorted((s, e, k) for k, s, e in pii_brute(before[i].text) + hidden)
                assert after[i].text == pii._replace(before[i].text, spans) and after[i].n_chars == len(after[i].text)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(after[i].ids == sp.encode(before[i].text, add_eos=True) for i in ids) and set(after) == set(before)
            continue
        assert out.columns == docs.columns
        docs = out
    assert C.run(spark, sf).count() == len(after)


def test_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = "la casa de papel es muy bonita y grande hoy " * 3
    rows = [(None, None, None, None, None, 1), (5, long, "es", "s", 3, 1), (5, long, "es", "s", 3, 1), (6, "", None, "s", None, 1), (7, long, "es", "s", 1, 1)]
    odd = spark.createDataFrame(rows, docs.withColumn("u", docs.doc_id).schema)
    for name, stage in C.STAGES:
        out = stage(spark, odd, sf)
        got = out.collect()
        if name == "minhash_near_dedup":
            assert sorted(str(r.doc_id) for r in got) == ["5", "6", "None"]
        elif name != "quality_classifier":
            assert len(got) == 5
        if name != "sentencepiece_ids":
            assert out.columns == odd.columns
        assert stage(spark, odd.where("false"), sf).count() == 0
