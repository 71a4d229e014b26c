"""Acronyms, synonym candidates, sentence ends and example sentences against plain Python."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.operators import acronyms as R
from lattica.operators import matching as M
from lattica.operators import vocabulary as V
from lattica.plans import vocabulary as plans
from lattica.plans.bindings import table

SF = "/root/testdata/sf0.001"
SMALL = set(R.SMALL_WORDS)


def ways(phrase):
    """All acronyms of a phrase, word by word through the product of the words' choices."""
    options = []
    for word in phrase.split():
        parts = ["".join(c for c in p if c.isascii() and c.isalnum()) for p in re.split("[-/]", word)]
        parts = [p[0].upper() for p in parts if p]
        if parts:
            options.append({parts[0], "".join(parts)} | ({""} if word.lower() in SMALL else set()))
    return sorted({a for a in map("".join, itertools.product(*options)) if a and len(a) <= 12})


def test_initial_variants_of_phrases_of_any_length(spark):
    rng = random.Random(1)
    words = ["deep", "Q-learning", "of", "the", "x/y/z", "A", "--", "3D", "and", "net's", "é"]
    phrases = ["", " ", "of", "state-of-the-art model", "one two three four five six seven eight nine ten"] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(p,) for p in [*phrases, None]], "p string")
    got = {r.p: r.v for r in df.select("p", R.initial_variants(F.col("p")).alias("v")).collect()}
    assert got.pop(None) == [] and got == {p: ways(p) for p in phrases}
    assert got["one two three four five six seven eight nine ten"] == ["OTTFFSSENT"]


def plain_restoration(records, surfaces, least, support):
    tokens = defaultdict(set)
    for name, full in set(records):
        if name is None or full is None:
            continue
        words = full.split()
        spans = [(j, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, min(i + 8, len(words)) + 1) if words[i].lower() not in SMALL and words[j - 1].lower() not in SMALL]
        spans = [(j, s) for j, s in spans if not (s.upper() == s and s.lower() != s)]
        for token in name.split():
            tail = re.search("[A-Z]*$", token).group()
            found = {(tail[k:], j, s) for k in range(len(tail) - least + 1) for j, s in spans if tail[k:] in ways(s)} if len(tail) >= least else set()
            for acronym, j, s in found:
                if not any(e == j and len(a) > len(acronym) for a, e, _ in found) and acronym not in surfaces:
                    expansion = re.sub(r"\s+", " ", re.sub("[-_/]+", " ", s.lower())).strip(" .,;:")
                    tokens[acronym, expansion[:-1] if expansion.endswith("s") and len(expansion.split()[-1]) > 4 else expansion].add(token)
    return {k: sorted(v) for k, v in tokens.items() if len(v) >= support and k[1] not in surfaces}


def test_restoration_against_plain_python(spark):
    rng = random.Random(7)
    words = ["Generative", "adversarial", "Networks", "of", "Trees", "Contrastive", "language-image", "PRE", "training", "the", "gas"]
    records = [("MSGAN", "Mode seeking Generative adversarial Networks"), ("U-Net GAN", "A Generative adversarial Network of sorts"), ("GAN", "Generative adversarial Networks"), ("GAN", "Generative adversarial Networks"), ("xCLIP", "Contrastive language-image PRE"), (None, "x y"), ("AB", None), ("AB", ""), ("ab", "a b")]
    for _ in range(150):
        full = rng.choices(words, k=rng.randint(1, 6))
        capitals = "".join(w[0].upper() for w in full[rng.randint(0, 2) :] if rng.random() < 0.9)
        records.append((rng.choice(["x", "My", "Q", ""]) + capitals + rng.choice(["", " two", " 2"]), " ".join(full)))
    df = spark.createDataFrame(records, "name string, full_name string")
    for least, support, surfaces in ((2, 2, {"GT"}), (3, 1, {"generative adversarial network"})):
        got = R.restored(df, spark.createDataFrame([(s,) for s in surfaces], "text string"), least, support).collect()
        want = plain_restoration(records, surfaces, least, support)
        assert want and {(r.acronym, r.expansion): r.tokens for r in got} == want
        assert all(r.support == len(r.tokens) for r in got)


def test_a_fragment_yields_to_the_longer_suffix(spark):
    df = spark.createDataFrame([("aCLIP", "contrastive language image pretraining"), ("bCLIP", "contrastive language image pretraining")], "name string, full_name string")
    got = R.restored(df, spark.createDataFrame([], "text string"), 2, 2).select("acronym", "expansion").collect()
    assert [tuple(r) for r in got] == [("CLIP", "contrastive language image pretraining")]


def test_candidate_pairs_leave_containment_out(spark):
    terms = [("M:1", "graph network"), ("M:2", "network"), ("M:3", "tree"), ("M:4", "graph-network"), ("M:5", "gn")]
    papers = [(p, t) for p in range(6) for t in ("M:1", "M:2")] + [(p, t) for p in range(4) for t in ("M:3", "M:5")] + [(p, "M:3") for p in range(4, 20)]
    rows = spark.createDataFrame(terms, "term_id string, key string")
    inc = spark.createDataFrame(papers, "paper_id long, term_id string").withColumn("first_date", F.lit("1997-01-01").cast("timestamp"))
    got = {(r.a, r.b): (r.rules, r.meetings, r.npmi) for r in V.candidate_pairs(rows, rows.select("term_id", F.col("key").alias("text"), F.lit("ci").alias("mode")), inc, [], 3, 4, 4, 0.05).collect()}
    assert set(got) == {("M:1", "M:4"), ("M:1", "M:5"), ("M:4", "M:5"), ("M:2", "M:5")}  # M:2 is a word of M:1 and M:4
    assert got["M:1", "M:4"][:2] == (["form", "same_words"], 0) and got["M:1", "M:4"][2] is None
    npmi = math.log((4 / 20) / ((6 / 20) * (4 / 20))) / -math.log(4 / 20)
    assert got["M:1", "M:5"][:2] == (["cooccurrence", "initials"], 4) and got["M:1", "M:5"][2] == pytest.approx(npmi)


def cut_plain(text, abbreviations, openers='A-Z0-9"\'('):
    """Sentences by looking at every gap: no cut behind or inside an abbreviation."""
    out, begin = [], 0
    for gap in re.finditer(rf"(?<=[.!?])\s+(?=[{openers}])", text):
        held = any(text[: gap.start()].endswith(a) for a in abbreviations)
        for a in abbreviations:
            for m in re.finditer(r"\s+", a):
                left, right = a[: m.start()], a[m.end() :]
                held |= text[: gap.start()].endswith(left) and text[gap.end() :].startswith(right) and left[-1] in ".!?"
        if not held:
            out.append(text[begin : gap.start()])
            begin = gap.end()
    return [*out, text[begin:]]


def test_sentences_do_not_break_behind_abbreviations(spark):
    names = ["et al.", "Fig.", "e.g.", "U. S.", "vs."]
    rng = random.Random(3)
    texts = ['We follow Ho et al. (2020). See Fig. 3. "Good"! It is.', "The U. S. Army. The U. S. (old).", "", "No end", "a vs. B vs. C. D", "revs. X. Fig. Fig. 2"]
    texts += [" ".join(rng.choices(["et al.", "Fig.", "U.", "S.", "Then", "x.", "(y)", "3!", "e.g.", "no"], k=12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = defaultdict(dict)
    for r in M.sentences(df, "i", "t", names, "A-Z0-9\"'(").collect():
        got[r.i][r.idx] = r.sentence
    assert {i: [s for _, s in sorted(g.items())] for i, g in got.items()} == {i: cut_plain(t, names) for i, t in enumerate(texts)}


def test_examples_of_every_surface(spark):
    """The query against all sentences cut and matched in plain Python."""
    docs = table(spark, SF, "documents").collect()
    ci, cs = {}, {}
    for r in plans.dictionary(spark, SF).collect():
        (ci if r["mode"] == "ci" else cs)[r.text] = r.term_id
    assert len(ci) > 20 and cs
    held = defaultdict(set)
    for d in docs:
        for i, sentence in enumerate(cut_plain(d.text or "", plans.ABBREVIATIONS, "A-Z0-9")):
            words = re.findall("[A-Za-z0-9]+", sentence)
            for w in {x.lower() for x in words} & ci.keys():
                held[ci[w], "ci", w].add((d.doc_id, i, sentence))
            for w in set(words) & cs.keys():
                held[cs[w], "cs", w].add((d.doc_id, i, sentence))
    got = defaultdict(list)
    for r in plans.t19(spark, SF).collect():
        assert r.n == len(held[r.term_id, r["mode"], r.gram]) and (r.doc_id, r.idx, r.sentence) in held[r.term_id, r["mode"], r.gram]
        got[r.term_id, r["mode"], r.gram].append((r.doc_id, r.idx))
    assert got.keys() == held.keys()
    assert all(len(set(v)) == len(v) == min(3, len(held[k])) for k, v in got.items())


def test_example_draw_is_seeded_and_limits_before_the_shuffle(spark):
    texts = spark.createDataFrame([(i, f"The cat sat {i}. The cat ran. No more {i}.") for i in range(50)], "i int, t string")
    words = spark.createDataFrame([("T:cat", "cat", "ci"), ("T:more", "more", "ci")], "term_id string, text string, mode string")
    draw = lambda seed: Counter((r.gram, r.i, r.idx) for r in M.example_sentences(texts, words, "i", "t", 4, seed).collect())
    assert draw(1) == draw(1) != draw(2) and len(draw(1)) == 8
    assert "WindowGroupLimit" in M.example_sentences(texts, words, "i", "t", 4, 1)._jdf.queryExecution().toString()
