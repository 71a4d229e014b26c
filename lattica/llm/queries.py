"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("n_tokens").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    out = extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return top_k(rows, rows.where(F.col("id") % 20 == 0), 20)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_decontam import pairs

    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn_dedup import remove_repeated_words

    return remove_repeated_words(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("u", "v")


def op9_bootstrap_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, N_BASE, find_pii, joined

    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS LONG) AS n_{name}") for k, name in enumerate(KINDS[:N_BASE])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from .common import attach
    from .vector_codes import codebook_text, compress

    out, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    sums = out.groupBy("grp").agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return attach(out, sums, "grp").select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_rules import judge

    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import partial

    import public_tokenizers

    from .alignment import ByteLevel, Pieces, align, with_counts
    from .common import written

    left = partial(ByteLevel, public_tokenizers.path("byte_bpe_50k.json"))
    right = partial(Pieces, public_tokenizers.path("piece_bpe_32k.model"))
    aligned = align(table(spark, sf_dir, "documents"), left, right, ["doc_id"])
    size = lambda c: F.size(c).cast("long")
    slim = aligned.select(
        "doc_id",
        size("a_ids").alias("n_a"),
        size("b_ids").alias("n_b"),
        size("a_ends").alias("n_groups"),
        F.when(F.size("a_ids") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
        "pairs",
        "times",
    )
    return with_counts(written(slim, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SQL_OP4 = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""

SQL_OP6 = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents
), iw AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark
), ds AS (
  SELECT row_number() OVER () AS r, doc_id,
         CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END AS hs
  FROM dw WHERE len(ws) > 0
), it AS (
  SELECT row_number() OVER () AS q, item_id,
         CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END AS ih
  FROM iw WHERE len(ws) > 0
), dp AS (
  SELECT r, doc_id, len(hs) AS n, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM ds
), ip AS (
  SELECT q, item_id, len(ih) AS m, unnest(ih) AS h FROM it
), touched AS (
  SELECT DISTINCT r, n, q, m FROM dp JOIN (SELECT DISTINCT q, m, h FROM ip) USING (h)
), starts AS (
  SELECT r, q, m, unnest(range(1, greatest(n - m, 0) + 2)) AS s FROM touched
), wc AS (
  SELECT starts.r, starts.q, starts.m, s, h, count(*) AS k
  FROM starts JOIN dp ON dp.r = starts.r AND p >= s AND p < s + m GROUP BY ALL
), ic AS (
  SELECT q, item_id, h, count(*) AS k FROM ip GROUP BY ALL
), size AS (
  SELECT r, q, m, s, sum(k) AS n FROM wc GROUP BY ALL
), both_ AS (
  SELECT wc.r, wc.q, wc.s, sum(least(wc.k, ic.k)) AS c FROM wc JOIN ic ON ic.q = wc.q AND ic.h = wc.h GROUP BY ALL
), scored AS (
  SELECT ds.doc_id, it.item_id, c AS n_common, n + m - c AS n_union
  FROM both_ JOIN size USING (r, q, s) JOIN ds USING (r) JOIN it USING (q) WHERE 100 * c >= 80 * (n + m - c)
)
SELECT doc_id, item_id, CAST(x[2] AS BIGINT) AS n_common, CAST(x[3] AS BIGINT) AS n_union FROM (
  SELECT doc_id, item_id, max([CAST(n_common AS DOUBLE) / CAST(n_union AS DOUBLE), n_common, n_union]) AS x FROM scored GROUP BY ALL
)
"""

SQL_OP10 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


def _rounds(n: int) -> str:
    """The assignments and codebooks of n Lloyd rounds and the last assignment, as common table expressions."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, j, part, min([list_inner_product(part, part) - 2 * list_inner_product(part, entry) + list_inner_product(entry, entry), CAST(k AS DOUBLE)]) AS best
  FROM p JOIN c{r} USING (j) GROUP BY vec_id, j, part
)""")
        if r < n:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.j, c{r}.k, coalesce(m.entry, c{r}.entry) AS entry FROM c{r} LEFT JOIN (
    SELECT j, k, list(x ORDER BY i) AS entry FROM (
      SELECT j, CAST(best[2] AS BIGINT) AS k, i, floor(sum(part[i]) / count(*)) AS x FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(part)) + 1 FROM p))) AS i) GROUP BY ALL
    ) GROUP BY ALL
  ) AS m ON m.j = c{r}.j AND m.k = c{r}.k
)""")
    return ",\n".join(steps)


SQL_OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, j, v[j * (len(v) // 8) + 1 : (j + 1) * (len(v) // 8)] AS part FROM v, (SELECT unnest(range(8)) AS j)
), c0 AS (
  SELECT j, k, part AS entry FROM (SELECT j, part, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k FROM p) WHERE k < 16
), {_rounds(6)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best[2] AS BIGINT)), '' ORDER BY j) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a6 GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j, k, i)) AS digest
  FROM (SELECT j, k, unnest(entry) AS x, generate_subscripts(entry, 1) AS i FROM c6)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM books) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)
"""

SQL_OP12 = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (
  SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (
    SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8
  ), LATERAL (SELECT array_to_string(ws[i : i + 7], ' ') AS k)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM g WHERE c > 1) GROUP BY r
), f AS MATERIALIZED (
  SELECT r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), x AS (
  SELECT r, host, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines,
                          word_chars < 3 * n_words OR word_chars > 12 * n_words]) AS bad, unnest(range(5)) AS rule FROM f WHERE host IS NOT NULL
), h AS (
  SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS k FROM x GROUP BY ALL
), s AS (
  SELECT rule, count(*) AS hs, sum(n) AS big, sum(n * n) AS sq, sum(k) AS ks, sum(k * k / n) AS q, sum(k) / sum(n) AS m FROM h GROUP BY rule
), b AS (
  SELECT rule, hs, big, m, (q - ks * ks / big - (hs - 1) * m * (1 - m)) / nullif(big - sq / big, 0) AS between_ FROM s
), z AS (
  SELECT rule, big, CASE WHEN hs < 2 THEN 0.5 ELSE m END AS m, CASE WHEN hs < 2 THEN 2.0 WHEN m * (1 - m) = 0 OR between_ <= 0 THEN NULL ELSE greatest(m * (1 - m) / between_ - 1, 0) END AS strength FROM b
), y AS (
  SELECT host, CASE WHEN strength IS NULL THEN m ELSE (k + strength * m) / (n + strength) END AS rate,
         CASE WHEN strength IS NULL THEN big + 1 ELSE n + strength + 1 END AS weight FROM h JOIN z USING (rule)
), bad AS (
  SELECT DISTINCT host FROM y WHERE rate - 2.0 * sqrt(rate * (1 - rate) / weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.host IS NULL AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f) AS f LEFT JOIN bad ON bad.host = f.host
"""


def queries():
    found = [op1_suffix_dedup, op2_pu_quality, op3_html_extraction, op4_exact_topk, op5_sentencepiece, op6_simhash_decontamination, op7_debruijn_dedup, op8_hyperminhash, op9_bootstrap_pii, op10_warc]
    found += [op11_vector_codes, op12_host_rules, op13_token_alignment]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": SQL_OP4, "op6_simhash_decontamination": SQL_OP6, "op10_warc": SQL_OP10, "op11_vector_codes": SQL_OP11, "op12_host_rules": SQL_OP12}
