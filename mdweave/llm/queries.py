"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_table
from . import bpe_codec, divergence, embedding_join, exact_dedup, packing, pii, quality, secret_crf, simhash, spelling
from . import token_counts, token_files, warc_zip


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(load_table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(load_table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.embedding_components(load_table(spark, sf_dir, "embeddings"), least_cosine=0.98)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"), length=2048)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load_table(spark, sf_dir, "documents")).drop("row_key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, load_table(spark, sf_dir, "labels")), threshold=0.7)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load_table(spark, sf_dir, "documents"), words_per_shingle=3,
                                      radius=3).drop("row_key", "kept")


def op8_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return secret_crf.scan(docs, secret_crf.fit(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(load_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load_table(spark, sf_dir, "documents"), least_length=7, least_count=2, times=10, one_in=31)


def op12_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load_table(spark, sf_dir, "documents"), least_documents=3, top=200)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_token_files, op3_embedding_dedup, op4_best_fit_packing,
                                   op5_exact_dedup, op6_quality, op7_simhash_dedup, op8_secret_crf,
                                   op9_token_counts, op10_warc_zip, op11_spelling_variants, op12_pii_crf, op13_divergence_audit)}

#: The others need a tokenizer, xxHash, a trained model or files, which SQL doesn't have;
#: tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id""",
    "op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS size
  FROM documents),
g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
    "op10_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string([
        ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
        [strpos('0123456789abcdef', h[k])] FOR k IN range(1, 41)], '') AS bits, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT
         + bits[5 * k + 5]::INT] FOR k IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM b""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], repeat([0], 8)), lambda c, x:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', run), ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM own),
h AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)])), 4294967295) AS h
  FROM bytes, crc_table),
spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
edits AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
shorter AS (SELECT DISTINCT word, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS near FROM edits),
holes AS (SELECT word, left(word, (i - 1)::INT) || '_' || substr(word, (i + 1)::INT) AS hole FROM edits),
pairs AS (
  SELECT s.word AS a, w.word AS b FROM shorter s JOIN w ON w.word = s.near
  UNION SELECT w.word, s.word FROM shorter s JOIN w ON w.word = s.near
  UNION SELECT x.word, y.word FROM holes x JOIN holes y ON x.hole = y.hole AND x.word <> y.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS near, max(w.n) AS near_n FROM pairs JOIN w ON w.word = b GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN path p USING (word) JOIN forms last ON last.word = p.at WHERE last.form IS NULL""",
    "op13_divergence_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(own.total, 0) + v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN own ON own.lang = g.lang AND own.source = g.source),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 1)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM c JOIN sizes USING (lang) GROUP BY lang, term, v),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
