"""The registered queries opN_<name> and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, byte_bpe, line_crf, mpegts, order_minhash, packing, pii_surrogates, superkmer_dedup, url_filter, warc_index
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_next(read_table(spark, sf_dir, "documents"))


@query
def op3_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(mpegts.read(mpegts.store(read_table(spark, sf_dir, "documents"))))


@query
def op2_host_word_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


@query
def op8_external_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_index.archive_and_index(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "position")


ORACLES["op8_external_index_merge"] = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, url, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), k AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
         regexp_extract(url, '^.*?://([^#]*)', 1) AS rest
  FROM d
), h AS (
  SELECT *, lower(regexp_extract(rest, '^[^/?]*')) AS host, regexp_replace(rest, '^[^/?]*', '') AS tail FROM k
), c AS (
  SELECT page_id, payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to,
         CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
              CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END ELSE url END AS urlkey,
         strftime(TIMESTAMP '2024-01-01' + to_microseconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%S.%fZ') AS captured
  FROM h
)
SELECT *, row_number() OVER (ORDER BY urlkey, captured, page_id NULLS FIRST, payload_digest, record_type) - 1 AS position FROM c
"""


@query
def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup.kept_words(read_table(spark, sf_dir, "documents"))


ORACLES["op6_superkmer_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20
), t AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS words FROM g
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS place FROM t
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE place > 1
), a AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w
), k AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.j) AS kept, count(*) AS n_kept
  FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY a.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.train(docs, read_table(spark, sf_dir, "labels")))


@query
def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.report(read_table(spark, sf_dir, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
