"""Vector codes, host rules and token alignment against brute force and edge cases."""

import hashlib
import random
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import host_rules, queries
from lattica.llm.common import attach, written
from lattica.llm.vector_codes import codebook_text, compress

P = pytest.importorskip("public_tokenizers")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows of (id, label, integer vector) -> ((id, codes, error, label error) list, all entries' components)."""
    width = len(rows[0][2]) // parts
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[r[2][j * width : (j + 1) * width] for r in order[:entries]] for j in range(parts)]

    def best(j, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[j]))

    for _ in range(rounds):
        new = []
        for j in range(parts):
            member = {}
            for _, _, v in rows:
                part = v[j * width : (j + 1) * width]
                member.setdefault(best(j, part)[1], []).append(part)
            new.append([[sum(c) // len(c) for c in zip(*member[k])] if k in member else e for k, e in enumerate(books[j])])
        books = new
    out, sums = [], Counter()
    for i, label, v in rows:
        found = [best(j, v[j * width : (j + 1) * width]) for j in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] += error
        out.append((i, label, [k for _, k in found], error))
    return [(*r, sums[r[1]]) for r in out], [x for book in books for e in book for x in e]


def test_codes_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2]), [rng.choice([-3, -1, 0, 1, 2, 5]) / 64 for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, 7, [0.5] * 16) for i in range(200)] + [(3, 1, rows[3][2]), (3, 1, rows[4][2]), (None, 2, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit(1)).withColumn("CODES", F.lit(2))
    whole = [(i, g, [int(x * 4096 // 1) for x in v]) for i, g, v in rows]
    out, books = compress(df, "vec_id", "embedding", "label")
    got = attach(out, out.groupBy("grp").agg(F.sum("error").alias("label_error")), "grp")
    want, entries = brute_codes(whole)
    assert plain(got.collect()) == plain(want)
    assert codebook_text(books) == ",".join(map(str, entries))


def test_codes_shuffled_and_broadcast_parts_agree(spark, monkeypatch):
    from lattica.llm import vector_codes

    rng = random.Random(8)
    rows = [(i, [rng.choice([0, 0, 0, 1, 2]) / 8 for _ in range(16)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain(compress(df, "vec_id", "embedding")[0].collect())
    for share in (1, 10**9):
        monkeypatch.setattr(vector_codes, "HOT_SHARE", share)
        assert plain(compress(df, "vec_id", "embedding")[0].collect()) == want


def test_codes_edges(spark):
    schema = "vec_id long, label string, embedding array<float>"
    rows = [(1, None, [1.0] * 9), (2, "a", None), (3, "a", [float("nan")]), (4, "a", [None]), (5, "a", [float("-inf")]), (6, None, []), (6, None, [])]
    out, books = compress(spark.createDataFrame(rows, schema), "vec_id", "embedding", "label")
    assert books.shape == (8, 3, 2)  # nine components count as sixteen; three rows give three entries
    assert plain(out.select("id", "grp", "error").collect()) == [(1, None, 0), (6, None, 0), (6, None, 0)]
    none, books = compress(spark.createDataFrame([], schema), "vec_id", "embedding", "label")
    assert none.count() == 0 and books.size == 0
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, "a", [1e30])], schema), "vec_id", "embedding", "label")


def test_codes_query_matches_sql(spark, sf, duck):
    rel = duck.execute(queries.SQL_OP11)
    names = [d[0] for d in rel.description]
    assert plain(queries.op11_vector_codes(spark, sf).select(*names).collect()) == plain(rel.fetchall())


def test_attach_salted_equals_broadcast(spark):
    big = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 7}") for i in range(200)], "i int, k string")
    small = spark.createDataFrame([(None, 1), ("k1", 2), ("k2", 3)], "k string, v int")
    assert plain(attach(big, small, "k").collect()) == plain(attach(big, small, "k", rows=0, salts=5).collect())


def test_host_rules_match_sql(spark, sf, duck):
    names = queries.op12_host_rules(spark, sf).columns
    got = plain(queries.op12_host_rules(spark, sf).collect())
    assert got == plain(duck.sql(queries.SQL_OP12).select(*names).fetchall())


def brute_counts(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for s in at.values() if len(s) > 1 for i in s for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["", " \n\t", None, "a " * 40, "x y\x85z \x1c", "中文 \U0001f642\n\n\U0001f642\r\n\U0001f642\r", "#a *b\n#a *b\n \n \n"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "# ", "\x0b"]) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    texts += [" ".join(f"w{i % 997}" for i in range(20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: tuple(r[c] for c in host_rules.COUNTS) for r in host_rules.counts(df, "t").collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_host_verdicts(spark):
    fine = " ".join(f"word{i}" for i in range(40))
    rows = [(i, fine if i % 10 else "short", f"good{i % 7}") for i in range(700)]
    rows += [(1000 + i, "short" if i % 10 else fine, "bad") for i in range(100)]
    rows += [(2000, "short", "tiny"), (2001, fine, "tiny2"), (3000, fine, None), (3001, None, None), (3001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Kept", F.lit(1)).withColumn("n", F.lit(2))
    got = host_rules.judge(docs, ["doc_id", "Kept", "n"]).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "n", "kept", "failed", "host_failed"}
    for r in got:
        if r.host == "bad":
            assert r.host_failed == ["few_words"] and not r.kept
        else:
            assert r.host_failed == [] and r.kept == (r.n_words >= 20), r
    assert host_rules.judge(docs.where("false"), ["doc_id"]).count() == 0
    alone = host_rules.judge(docs.where("doc_id = 2000"), ["doc_id"]).first()
    assert (alone.base_failed, alone.host_failed, alone.kept) == (True, [], False)


def test_prior_recovers_a_beta():
    rng = np.random.default_rng(1)
    n = rng.integers(20, 400, 3000)
    k = rng.binomial(n, rng.beta(2.0, 6.0, 3000))
    mean, strength = host_rules.prior(3000, int(n.sum()), float((n * n).sum()), int(k.sum()), float((k * k / n).sum()))
    assert abs(mean - 0.25) < 0.02 and abs(strength - 8) < 1
    assert host_rules.prior(2, 20, 200.0, 10, 5.0)[1] == float("inf")


def toy_side(vocabulary):
    """A side whose tokens are those of a greedy vocabulary, for texts that it spells; a local class, so that tasks need not import the test."""

    class Side:
        table = vocabulary

        def encode(self, texts):
            out = []
            for t in texts:
                left, ids = (" " + t).encode(), []
                while left:
                    i = max((i for i, b in enumerate(self.table) if left.startswith(b)), key=lambda i: len(self.table[i]), default=None)
                    if i is None:
                        break
                    ids.append(i)
                    left = left[len(self.table[i]) :]
                out.append(ids)
            return out

    return Side()


LEFT = [b" ", b"a", b"b", b"ab", b" a", b"aaa", b"\xc3", b"\xa9", b"bb"]
RIGHT = [b"c", b" ", b"a", b"b", b"ba", b" ab", b"aaaa", b"\xc3\xa9", b"aab"]


def brute_alignment(texts, left, right):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups text)."""
    docs = []
    for text in texts:
        want = (" " + text).encode() if text else b""
        a, b = (side.encode([text])[0] if text else [] for side in (left, right))
        a, b = [int(i) for i in a], [int(i) for i in b]
        if not text or b"".join(left.table[i] for i in a) != want or b"".join(right.table[i] for i in b) != want:
            docs.append(([], Counter()))
            continue
        groups, i, j = [], 0, 0
        while i < len(a):
            x, y, na, nb = [a[i]], [b[j]], len(left.table[a[i]]), len(right.table[b[j]])
            i, j = i + 1, j + 1
            while na != nb:
                if na < nb:
                    x.append(a[i])
                    na, i = na + len(left.table[a[i]]), i + 1
                else:
                    y.append(b[j])
                    nb, j = nb + len(right.table[b[j]]), j + 1
            groups.append((x, y))
        docs.append((groups, Counter((p, q) for x, y in groups for p in x for q in y)))
    count = Counter(pair for _, links in docs for pair in links)
    top = {}
    for (p, _), n in count.items():
        top[p] = max(top.get(p, 0), n)
    return [
        (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(k.values()),
            sum(m for pair, m in k.items() if count[pair] == top[pair[0]]), sum(m * count[pair] for pair, m in k.items()),
            ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g),
        )
        for g, k in docs
    ]


def aligned_rows(spark, docs, left, right, slab=1 << 20, most=1 << 20, keep=("i",)):
    from lattica.llm.alignment import align, with_counts

    found = align(docs, left, right, list(keep), slab=slab)
    slim = found.select(keep[0], F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), F.size("a_ends").alias("n_groups"), F.col("groups").alias("g"), "pairs", "times")
    rows = with_counts(written(slim, "t"), most=most).collect()
    return {r[keep[0]]: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.g) for r in rows}


@pytest.mark.parametrize("slab,most", [(1 << 20, 1 << 20), (40, 8), (1, 0)])
def test_alignment_against_brute_force(spark, slab, most):
    rng = random.Random(6)
    texts = [None, "", "a", "z", "aé", "ab ba", "a" * 300, "ab" * 40 + " " + "b" * 90]
    texts += ["".join(rng.choice("aabb é") for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["aab", "aab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("PAIRS", F.lit(1)).withColumn("_lt_text", F.lit("q"))
    left, right = toy_side(LEFT), toy_side(RIGHT)
    got = aligned_rows(spark, docs, lambda: left, lambda: right, slab, most, keep=("i", "PAIRS", "_lt_text"))
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts, left, right)


def test_alignment_wide_groups_and_empty_table(spark, monkeypatch):
    from lattica.llm import alignment

    left, right = toy_side(LEFT), toy_side(RIGHT)
    texts = ["aab" * 30, "b" * 7, "a" * 50]
    want = brute_alignment(texts, left, right)
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    monkeypatch.setattr(alignment, "WIDE", 0)
    raw = "".join(texts).encode()
    ends = np.cumsum([0, *map(len, texts)])
    spell = alignment._Spelling
    found = alignment._align(texts, np.frombuffer(raw, np.uint8), ends, left, right, spell(LEFT), spell(RIGHT), 1 << 17)
    assert [sum(x) for x in found[5].to_pylist()] == [w[3] for w in want]
    monkeypatch.undo()
    assert aligned_rows(spark, docs.where("false"), lambda: left, lambda: right) == {}


def test_alignment_query_against_libraries(spark, sf):
    import sentencepiece
    import tokenizers

    from lattica.llm.alignment import ByteLevel, Pieces

    class Right:
        table = Pieces(P.path("piece_bpe_32k.model")).table
        sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

        def encode(self, texts):
            return [self.sp.encode(t) for t in texts]

    left = ByteLevel(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in docs), brute_alignment([r.text for r in docs], left, Right())))
    for r in queries.op13_token_alignment(spark, sf).collect():
        *numbers, text = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    odd = ["<|endoftext|> x", "</s><unk>", "▁x", "a　b", "\x00", "中文\U0001f642", " lead", "tail  ", "\n\n\t", "é", "<0x41>"]
    table = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    sides = partial(ByteLevel, P.path("byte_bpe_50k.json")), partial(Pieces, P.path("piece_bpe_32k.model"))
    got = aligned_rows(spark, table, *sides)
    assert [got[i] for i in range(len(odd))] == brute_alignment(odd, left, Right())
    raw = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode("<|endoftext|>", add_special_tokens=False)
    assert raw.ids == [50256] and left.encode(["<|endoftext|>"])[0][-1] != 50256


def test_byte_level_equals_the_library():
    """Both ways of encoding against the library, for every character of the plain alphabet beside others, and for invented words."""
    import tokenizers

    from lattica.llm import alignment

    side = alignment.ByteLevel(P.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert side.fast is not None
    rng = random.Random(12)
    plain = [chr(c) for c in range(0x300) if alignment._PLAIN.fullmatch(chr(c))]
    texts = [t for c in plain for t in (c, f"a {c}b{c} {c}{c} \n {c}", f"1{c}2 .{c}.{c}a", c * 7)]
    texts += ["", " ", "<|endoftext|> x <|endoftext|>", "it's  we'll\t\t don't", "\x85", "a\u3000 b", "中文 \U0001f642\xa0x"]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "b1", "'s", "é", rng.choice(plain)]) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    texts += ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", weights=range(26, 0, -1), k=rng.randint(1, 14))) for _ in range(20_000)]
    assert sum(alignment._PLAIN.fullmatch(t) is None for t in texts) == 3
    want = [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in side.encode(texts)] == want
    side.fast = None
    assert [x.tolist() for x in side.encode(texts[:500])] == want[:500]
