"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import embedding_dedup, exact_dedup, license_scan, near_dedup, packing, quality, sampling, suffix_dedup, toxicity, warc
from .tables import table


def op1_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), "spans")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024)


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_pieces(table(spark, sf_dir, "documents"), with_ids=False)


def op5_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=4, threshold=80)


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_near_vectors": op1_pivot_near_vectors,
    "op2_crf_toxicity": op2_crf_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sampled_pieces": op4_sampled_pieces,
    "op5_cnn_quality": op5_cnn_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_license_dice": op10_license_dice,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_pivot_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), lowest AS (
            SELECT id, min(other) AS component_id FROM reach GROUP BY id
        ), counted AS (
            SELECT a, count(*) AS n FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN lowest ON id = vec_id LEFT JOIN counted ON a = vec_id
    """,
    "op6_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ), g AS (
            SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
    """,
    "op7_warc_revisits": """
        WITH t AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), g AS (
            SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
                   min(page_id) OVER (PARTITION BY body) AS first_id
            FROM t
        ), r AS (
            SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM g
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to
        FROM r
    """,
    "op8_suffix_dedup": """
        WITH body AS MATERIALIZED (
            SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), passage AS MATERIALIZED (
            SELECT doc_id, i, hash(b[i + 1:i + 100]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM body WHERE n >= 100)
        ), earliest AS (
            SELECT h, min({'doc': doc_id, 'at': i}) AS f FROM passage GROUP BY h HAVING count(*) > 1
        ), again AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last
            FROM passage JOIN earliest USING (h) WHERE doc_id <> f.doc OR i <> f.at
        ), run AS (
            SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM again
        ), span AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM run GROUP BY doc_id, k
        ), piece AS (
            SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span
            UNION ALL SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(hex(b[a + 1:coalesce(z, n)]), '' ORDER BY a) AS rest FROM piece JOIN body USING (doc_id) GROUP BY doc_id
        ), counted AS (
            SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(CASE WHEN n_removed > 0 THEN unhex(rest) ELSE b END) AS kept_sha256
        FROM body LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS w
            FROM documents
        ), shingle AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                ELSE [] END) AS s
            FROM words
        ), sizes AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
            FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS MATERIALIZED (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * overlap >= 80 * (x.n + y.n - overlap)
        ), reach(id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.other IN (l.a, l.b)
        ), lowest AS (
            SELECT id, min(other) AS component_id FROM reach GROUP BY id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN lowest ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
    "op10_license_dice": license_scan.oracle_sql(),
}
