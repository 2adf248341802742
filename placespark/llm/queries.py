"""The registered queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placespark.llm import alignment, decontaminate, knn, merkle, ngram_lm, packing, pii, quality, secrets, simhash, token_count, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return ngram_lm.lm_scores(documents, ~ngram_lm.is_held_out(documents["doc_id"]))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_count.with_token_count(documents, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.hex_digits(found["fingerprint"]))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors["vec_id"] % 50 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(len(w), 10) AS t, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, t, array_to_string(w[i:i + t - 1], ' ') AS g FROM bi
), di AS (
  SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM d, (SELECT DISTINCT t FROM win) WHERE len(w) >= t
), hit AS (
  SELECT p.doc_id, p.i, p.t, win.item_id
  FROM (SELECT doc_id, i, t, array_to_string(w[i:i + t - 1], ' ') AS g FROM di) p JOIN win USING (g, t)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS k FROM (SELECT DISTINCT doc_id, i, t FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

OP12_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}")) + ")"
#: The CRC-32 of a text of digits and signs, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_LEAF.format(LOWER.format("text"))} ELSE {_LEAF.format("text")} END AS tampered FROM documents
), l AS (
  SELECT *, coalesce('+' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), up AS (
  SELECT 0 AS level, g, pos, n, leaf AS hash FROM l
  UNION ALL
  SELECT level + 1, g, pos, n, sha256(string_agg(hash, '' ORDER BY own)) FROM (SELECT level, g, pos // 8 AS pos, (n + 7) // 8 AS n, hash, pos AS own FROM up WHERE n > 1) GROUP BY level, g, pos, n
), subs AS (
  SELECT g, hash AS subroot, row_number() OVER (ORDER BY g <> '-', encode(g)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, subroot AS hash FROM subs
  UNION ALL
  SELECT level + 1, pos, n, sha256(string_agg(hash, '' ORDER BY own)) FROM (SELECT level, pos // 8 AS pos, (n + 7) // 8 AS n, hash, pos AS own FROM top WHERE n > 1) GROUP BY level, pos, n
), runs AS (
  SELECT level, g, pos // 8 AS run, list(hash ORDER BY pos) AS members FROM (SELECT level, g, pos, hash FROM up WHERE n > 1 UNION ALL SELECT 1000 + level, '', pos, hash FROM top WHERE n > 1) GROUP BY ALL
), climb AS (
  SELECT l.doc_id, l.g, l.leaf, CASE WHEN l.n > 1 THEN 0 ELSE 1000 END AS level, CASE WHEN l.n > 1 THEN l.pos ELSE s.pos END AS pos, CASE WHEN l.n > 1 THEN l.n ELSE s.n END AS n, l.n = 1 AS is_top, s.pos AS top_pos, s.n AS top_n, s.subroot, '' AS proof, l.tampered AS folded, l.pos AS own
  FROM l JOIN subs s USING (g)
  UNION ALL
  SELECT doc_id, g, leaf, CASE WHEN done THEN 1000 ELSE level + 1 END, CASE WHEN done THEN top_pos ELSE pos // 8 END, CASE WHEN done THEN top_n ELSE (n + 7) // 8 END, is_top OR done, top_pos, top_n, subroot,
    proof || array_to_string(lefts, '') || array_to_string(rights, ''), sha256(array_to_string(lefts, '') || folded || array_to_string(rights, '')), own
  FROM (
    SELECT c.*, NOT c.is_top AND c.n <= 8 AS done, r.members[1:c.pos % 8] AS lefts, r.members[c.pos % 8 + 2:] AS rights
    FROM climb c JOIN runs r ON r.level = c.level AND r.g = CASE WHEN c.is_top THEN '' ELSE c.g END AND r.run = c.pos // 8 WHERE c.n > 1
  )
)
SELECT doc_id, leaf, subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT hash FROM top WHERE n = 1) AS verified
FROM climb WHERE is_top AND n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_pack, op4_ngram_lm, op5_secrets, op6_token_counts, op7_simhash, op8_pii, op9_knn, op10_toxicity, op11_alignment, op12_warc, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op9_knn": OP9_SQL, "op12_warc": OP12_SQL, "op13_merkle": OP13_SQL}
