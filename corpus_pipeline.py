"""The training-data pipeline: quality, lines, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm.common import forget, made_tables, stored
from sylvan.llm.line_dedup import dedup_lines
from sylvan.llm.mixing import mix
from sylvan.llm.ngram_join import jaccard_components
from sylvan.llm.packing import pack_documents
from sylvan.llm.quality import resample


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the last stage that ran over a folder; its result is written before the next one begins.
_left: dict[str, list[DataFrame]] = {}


def _stage(f: Stage) -> Stage:
    """A stage that deletes, as it begins, what the one before left in the shared folder."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for table in _left.pop(sf_dir, []):
            forget(table)
        with made_tables() as made:
            out = f(spark, docs, sf_dir)
        _left[sf_dir] = made
        return out

    return run


def _kept(docs: DataFrame, ids: DataFrame, once: bool = False) -> DataFrame:
    """The rows of the documents whose ids are in ``ids``; rows without an id, on which no stage decides, stay. With ``once``, of
    rows that repeat an id and a text only one."""
    named = docs.where("doc_id is not null").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    named = named.dropDuplicates(["doc_id", "text"]) if once else named
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled good."""
    return _kept(docs, resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier line; documents of nothing else go."""
    return dedup_lines(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; rows that repeat an id and a text are one document."""
    return _kept(docs, jaccard_components(docs).where("doc_id = component_id"), once=True)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target shares of source, language and topic, four fifths of all tokens."""
    return _kept(docs, mix(docs, budget=0.8).where("sampled"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2,048."""
    import public_tokenizers

    for table in _left.pop(sf_dir, []):
        forget(table)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mixing", mixture), ("best-fit packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests hold line dedup and the n-gram join against brute force, the pipeline against planted ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each result written before the next stage reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
            if before is not None:
                forget(before)
            before = docs
    return docs
