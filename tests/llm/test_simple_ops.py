"""SentencePiece, top-k, WARC and HTML operators against brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import html_text, queries, warc
from lattica.llm.sentencepieces import encode_decode
from lattica.llm.topk import quantised, top_k

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_pieces_equal_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    odd = ["", " ", "  ", "a ", " a", "a  b   c", "▁x▁▁y", "\x00\n\t", "<s></s><unk>", "é　x", "日本 語", "🙂 🙂🙂", "x" * 5000, "  \n  "]
    odd += ["".join(rng.choice(" ab▁é\n0.🙂") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    odd += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*odd, None])], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in encode_decode(docs, MODEL, ["doc_id"], slab_bytes=500).collect()}
    for i, t in enumerate([*odd, None]):
        want = sp.encode(t or "", add_eos=True)
        assert got[i].ids == want, (t, got[i].ids, want)
        assert got[i].decoded == sp.decode(want), t
    assert encode_decode(docs.where("false"), MODEL, ["doc_id"]).count() == 0


def test_pieces_query_against_library(spark, sf):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids)))


def test_piece_table_generations():
    from lattica.llm.sentencepieces import ChunkTable

    small, whole = ChunkTable(MODEL, max_entries=6), ChunkTable(MODEL)
    rng = random.Random(9)
    for _ in range(200):
        texts = [" ".join(rng.choice(["the", "of", "Haus", "x1", "été", "a" * 60, "q"]) for _ in range(rng.randint(0, 6))) for _ in range(3)]
        assert small.run(texts, 2) == whole.run(texts, 2)
        assert len(small.young[0]) + len(small.old[0]) <= 6 + 21


def test_topk_matches_sql(spark, sf, duck):
    got = plain(queries.op4_exact_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain(duck.execute(queries.SQL_OP4).fetchall())


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = quantised(df, "vec_id", "embedding", 64.0)
    got = top_k(v, v.where("id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 20, 4096), (20, 1, 0, 4096), (20, 2, 1, 4096), (20, 3, 1, 4096)]
    assert top_k(v.where("false"), v.where("false"), 3).count() == 0
    few = top_k(v, v.where("id = 0"), 50)
    assert few.count() == 5


def test_topk_many_ties_and_overflow(spark):
    rows = [(i, [1.0]) for i in range(400)] + [(1000, [2.0]), (1001, [0.5])]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 64.0)
    got = top_k(v, v.where("id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1000, 8192), (1, 4096), (2, 4096), (3, 4096), (4, 4096)]
    huge = quantised(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 64.0)
    with pytest.raises(Exception, match="too large"):
        top_k(huge, huge.where("id = 0"), 5).collect()


def test_topk_query_groups(spark, sf, monkeypatch):
    from lattica.llm import topk

    want = plain(queries.op4_exact_topk(spark, sf).collect())
    monkeypatch.setattr(topk, "MAX_QUERIES", 12)
    assert plain(queries.op4_exact_topk(spark, sf).collect()) == want


def test_warc_matches_sql(spark, sf, duck):
    got = queries.op10_warc(spark, sf)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert plain(got.collect()) == plain(duck.execute(queries.SQL_OP10).fetchall())


@pytest.mark.parametrize("most", [0, 500_000])
def test_warc_edges(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST_DIGESTS", most)
    big, small = "é" * 600, "a" * 999
    rows = [(1, "u", big), (5, "u\r\nX: y", big), (5, None, big), (None, "u", big), (2, "v", small), (3, "v", small), (4, None, None), (6, "w", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = plain(warc.round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    want = [(1, 1200, "revisit", 5), (5, 1200, "response", None), (5, 1200, "response", None), (None, 1200, "revisit", 5), (2, 999, "response", None), (3, 999, "response", None), (4, 0, "response", None), (6, 0, "response", None)]
    assert got == plain(want)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_members_are_independent(tmp_path):
    import gzip
    import zlib

    records = [warc.record_bytes(i, "http://x/", (b"\r\n\r\n" * i) + b"body", "d", "response", None) for i in range(5)]
    for joined in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        (tmp_path / "a.warc.gz").write_bytes(joined)
        warc.normalise_one(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz"))
        data = (tmp_path / "b.warc.gz").read_bytes()
        at = [tuple(map(int, x.split("\t")[:2])) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
        assert [zlib.decompress(data[o : o + n], wbits=31) for o, n in at] == records
        assert sum(n for _, n in at) == len(data)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records))[:-40])
    with pytest.raises(ValueError):
        warc.normalise_one(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz"))


LONG = "It was the best of times and it was the worst of times for all of us in the town, as it is now. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("<p>", []),
        ("<article><h1>T &amp; U</h1><p>a\n  b<br>c<p><b>d &eacute;</article><footer>f</footer>", ["T & U", "a b c", "d é"]),
        ("<nav><a href=x>m</a></nav><article><p>x<div class='ad'>buy</div><p>y<aside>z</aside><script>var a='</p>';</script><style>p{}</style></article>", ["x", "y"]),
        ("<article><p>x</p><section id='comments'><p>nice</p></section><form><input>send</form><div class='cookie-notice'>ok</div></article>", ["x"]),
        ("<main><div><div class=ad>no</div>yes</div></main>", ["yes"]),
        (f"<body><ul><li><a href=/>home</a></ul><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div>© 2020</div>", [LONG.strip(), "Short one.", LONG.strip()]),
        ("<article><p>x<p>see <a href=y>a longer linked phrase</a></p><figure><figcaption>cap</figcaption></figure></article>", ["x", "see a longer linked phrase", "cap"]),
        ("<article><p>open text &am", ["open text &am"]),
        ("<!-- <article>no</article> --><article><!-- x --><p>&lt;b&gt; 1 < 2</article>", ["<b> 1 < 2"]),
    ],
)
def test_html_rules(page, want):
    assert html_text.extract(page) == want


def test_html_query(spark, sf):
    out = queries.op3_html_extraction(spark, sf)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "©" not in r.text for r in rows)
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<article>a</article>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract_pages(pages, ["page_id", "url"]).collect()) == ["", "a"]
    assert html_text.extract_pages(pages.where(F.lit(False)), ["page_id"]).count() == 0


def test_archive_cut_off_anywhere_is_an_error():
    import gzip
    import io

    body = b"WARC/1.0\r\n" * 5000
    whole = gzip.compress(body) + gzip.compress(b"second")
    assert b"".join(warc.inflate(io.BytesIO(whole))) == body + b"second"
    first = len(gzip.compress(body))
    assert b"".join(warc.inflate(io.BytesIO(whole[:first]))) == body  # a member's end is an end
    for size in (first - 1, first - 8, first // 2, 5, first + 12, len(whole) - 3):
        with pytest.raises(ValueError, match="truncated"):
            b"".join(warc.inflate(io.BytesIO(whole[:size])))
    assert b"".join(warc.inflate(io.BytesIO(b""))) == b""


def test_columns_with_names_of_the_operators_keep_their_values(spark):
    from lattica.llm.hyperminhash import keep_one
    from lattica.llm.pii import redact
    from lattica.llm.simhash_decontam import decontaminate

    text = "please write to someone at a.b@example.com or wait here for the next train home today"
    names = ["_lt_u", "_LT_V", "_lt_spans", "u", "v", "_lt_text", "id", "item", "key", "row", "b"]
    rows = [(1, text, *range(len(names))), (2, text, *range(1, len(names) + 1)), (3, "nothing of the kind stands in this text of some more words", *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = {r.doc_id: tuple(r)[2:] for r in keep_one(docs, width=5, percent=80, tag="names").collect()}
    assert kept == {1: tuple(range(len(names))), 3: tuple(range(len(names)))}
    redacted = redact(docs)
    assert redacted.columns == docs.columns
    assert {r.doc_id: tuple(r)[2:] for r in redacted.collect()} == {r[0]: r[2:] for r in rows}
    assert "[EMAIL]" in redacted.where("doc_id = 1").first().text
    clean = decontaminate(docs, spark.createDataFrame([(9, text)], "item_id long, text string"))
    assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [rows[2]]
