"""Personal data: base patterns against the plain regular expressions, and the bootstrap."""

import hashlib
import random
import re

from lattica.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text: str):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 8 <= len(digits) <= 15}
            if good[name]:
                out.append((kind, m.start(), m.end()))
    return out


def secrets(texts):
    """Per text the spans of hexadecimal words after "token =", if at least three different ones follow it."""
    found = [[(4, m.start(1), m.end(1)) for m in re.finditer(r'\b[tT][oO][kK][eE][nN]\s+=\s+"([0-9A-Fa-f]{32,})"', t or "")] for t in texts]
    words = {t[s:e].lower() for t, spans in zip(texts, found) for _, s, e in spans}
    return found if len(words) >= 3 else [[] for _ in texts]


def test_base_spans_equal_plain_patterns(spark, sf):
    rng = random.Random(2)
    odd = ["a@b.c@d.e", "@b.c@d.e", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.00.0.0001", "4111 1111 1111 1111", "4111-1111  1111", "+1 (234) 555-6789)", "é1.2.3.4é", "٣.1.2.3.4", "+٣1234567", "a" * 3000 + "@b", "1" * 3000]
    odd += ["".join(rng.choice("a1.@+- ()9é") for _ in range(rng.randint(1, 50))) for _ in range(4000)]
    odd += ["".join(rng.choice(["4111111111111111", "1.", "2.3.4", "@", "a.b", " ", "+12", "(3)", "-45678"]) for _ in range(9)) for _ in range(2000)]
    odd += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in odd:
        assert pii.base_spans(t) == brute(t), t


def rows_for_bootstrap():
    texts = [f"we wrote to Contact address: user{i}@mail.org today and the of end {i}" for i in range(8)]
    texts += [f"so Contact address: user{i}(at)mail9 é" for i in range(3)]
    texts += ["é Contact address: <id77x>. and Contact Address: nothing"]
    texts += [f"{w} of the {i}.1.1.1 here" for i, w in enumerate("abcde")]
    texts += ["one of the many, part of the 55 things, some of the old, end of the day"] * 9
    return texts


def test_bootstrap_finds_unseen(spark):
    texts = rows_for_bootstrap()
    docs = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (99, None, 1)], "doc_id long, text string, u int").repartition(2)
    got = {r.id: r for r in pii.find_pii(docs).collect()}
    text = lambda i: [(pii.KINDS[s.kind], texts[i][s.start : s.end]) for s in got[i].spans]
    assert text(0) == [("email", "user0@mail.org")]
    assert text(8) == [("email", "user0(at)mail9")]
    assert text(11) == [("email", "id77x")]
    assert text(17) == [] and got[99].spans == []
    assert all([tuple(s) for s in got[i].base] == brute(t) for i, t in enumerate(texts))
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[8].text == "so Contact address: [EMAIL] é" and out[0].text.startswith("we wrote to Contact address: [EMAIL] today")
    assert out[99].text is None and out[17].text == texts[17]
    assert pii.redact(docs).columns == docs.columns


def test_pattern_groups(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(rows_for_bootstrap())), "doc_id long, text string")
    want = sorted((r.id, str(r.spans)) for r in pii.find_pii(docs).collect())
    monkeypatch.setattr(pii, "MAX_PATTERNS", 1)
    assert sorted((r.id, str(r.spans)) for r in pii.find_pii(docs).collect()) == want


def test_query_digests(spark, sf):
    rows = {r.doc_id: r for r in queries.op9_bootstrap_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        found = brute(d.text or "")
        r = rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in found) for i in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    for d, hidden in zip(docs, secrets([d.text for d in docs])):
        want = sorted(brute(d.text or "") + hidden)
        assert rows[d.doc_id].spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
    assert queries.op9_bootstrap_pii(spark, sf).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(docs).count() == 0 and pii.redact(docs).count() == 0
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, ""), (1, None), (2, "x 1.2.3.4"), (2, "x 1.2.3.4")], "doc_id long, text string")
    assert sorted(len(r.spans) for r in pii.find_pii(docs).collect()) == [0, 0, 1, 1, 1]
    assert pii.redact(docs).count() == 5


def spaced_rows():
    def card(n):
        body = f"4111 1111 1111 {n:03d}"
        return next(body + str(d) for d in range(10) if luhn(f"{body}{d}".replace(" ", "")))

    texts = [f"please ring phone desk: +1 (0{i}7) 555-77{i}3 today" for i in range(10, 16)]
    texts += [f"paid with card number: {card(i)} today" for i in range(6)]
    return texts + ["please ring phone desk: (017) 555 7713, or not", "paid with card number: 4999 12 345678 today", "please ring phone desk: 5551 +1 (017) 555-7713"]


def test_spaced_instances_support_their_pattern(spark):
    texts = spaced_rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.id: [(pii.KINDS[s.kind], texts[r.id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert got[0] == [("phone", "+1 (0107) 555-77103")] and got[6] == [("card", texts[6][23:42])]
    assert got[12] == [("phone", "017) 555 7713")]
    assert got[13] == [("card", "4999 12 345678")]
    assert got[14] == [("phone", "5551"), ("phone", "+1 (017) 555-7713")]


def test_chain_of_contexts(spark):
    chain = [f"desk address: u{i}@mail.org" for i in range(150)]
    for n, seen, here in ((36, "desk address:", "box name:"), (12, "box name:", "room label:"), (4, "room label:", "door plate:")):
        chain += [f"{lead} id{n}x{i}" for lead in (seen, here) for i in range(n)]
    chain += ["door plate: last77 é"]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string").repartition(2)
    got = {r.id: [(pii.KINDS[s.kind], chain[r.id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert all(got[i] == [("email", chain[i].split(" ")[2])] for i in range(len(chain)))


def test_secrets_need_a_context(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [f'and then Token = "{key()}" ended' for _ in range(5)] + [f"a note on {w} {key()} there" for w in "abcdef"]
    texts += ['so the token = "zq81-unseen_shape7", it said', "token = nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: [(pii.KINDS[s.kind], texts[r.id][s.start : s.end]) for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert all(got[i] == [("secret", texts[i].split('"')[1])] for i in range(5))
    assert all(got[i] == [] for i in (*range(5, 11), 12))
    assert got[11] == [("secret", "zq81-unseen_shape7")]
