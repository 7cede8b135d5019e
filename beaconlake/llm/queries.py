"""The operators' named queries over whole tables, and their SQL equivalents where there is one."""

from pyspark.sql import DataFrame, SparkSession

from beaconlake.llm.common import table
from beaconlake.llm.decontaminate import contamination
from beaconlake.llm.fingerprint import document_fingerprints
from beaconlake.llm.hardneg import hard_negatives
from beaconlake.llm.language import identify_documents, identify_pages
from beaconlake.llm.mixing import language_scores
from beaconlake.llm.packing import pack
from beaconlake.llm.pii import pseudonymise
from beaconlake.llm.sharding import byte_shards
from beaconlake.llm.simhash import near_duplicates
from beaconlake.llm.spelling import spelling_variants
from beaconlake.llm.topk import exact_topk
from beaconlake.llm.toxicity import toxicity
from beaconlake.llm.transducer import token_counts

#: Key of the surrogates in the query; users bring their own secret.
PII_KEY = b"key of the named query"


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(documents, PII_KEY)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("root")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    pages = identify_pages(table(spark, sf_dir, "pages"), documents)
    found = identify_documents(documents, ["doc_id"])
    return found.unionByName(pages, allowMissingColumns=True)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "embedding", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label"
    )
    return hard_negatives(vectors, "vec_id % 100 = 0")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_shards": op1_shards,
    "op2_pii": op2_pii,
    "op3_language_model": op3_language_model,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_topk": op8_topk,
    "op9_language": op9_language,
    "op10_pack": op10_pack,
    "op11_spelling": op11_spelling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES = {
    "op6_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), b AS (
          SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE item_id IS NOT NULL
        ), bw AS (
          SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS grams FROM (
            SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i
            FROM b WHERE len(w) > 0)
        ), dw AS (
          SELECT uid, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS grams FROM (
            SELECT uid, w, size, unnest(range(1, len(w) - size + 2)) AS i
            FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size) s
        ), h AS (SELECT uid, i, dw.size, item_id FROM dw JOIN bw USING (grams, size)
        ), p AS (SELECT uid, count(DISTINCT k) AS n_hit FROM (
          SELECT uid, unnest(range(i, i + size)) AS k FROM h) GROUP BY uid
        ), t AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT uid, item_id FROM h) GROUP BY uid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
          coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
          n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN p USING (uid) LEFT JOIN t USING (uid)
    """,
    "op8_topk": """
        WITH v AS (
          SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0), s AS (
          SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
          FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), a AS (SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id % 100 = 0), s AS (
          SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same,
            CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
          FROM a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e)
        ), p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score, n AS number FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same)
          WHERE n <= 5
        ), r AS (
          SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, number ORDER BY s.score DESC, s.vec_id) AS n
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        )
        SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM r WHERE n <= 5
    """,
}
