"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.secrets import find_secrets, secret_digest

    return secret_digest(find_secrets(_table(spark, sf_dir, "documents")))


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.image_copies import image_copies, rendered

    return image_copies(rendered(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(docs, train(docs.where(~held_out).select("doc_id", "text", "lang")))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.line_dedup import duplicate_lines

    return duplicate_lines(_table(spark, sf_dir, "documents"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.quality import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sylvan.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_join, op2_secret_scan, op3_image_copies, op4_source_mixing, op5_language_id, op6_line_dedup, op7_quality_resampling, op8_substring_dedup, op9_best_fit_packing, op10_embedding_dedup)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least id reached from each vertex of ``links`` (a, b, both ways) over the vertices ``v``.
_REACHED = """reach(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
v AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.id = s.doc_id""",
    "op10_embedding_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9),
v AS (SELECT vec_id AS id FROM e),
{_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, component_id = id AS kept FROM c""",
}
