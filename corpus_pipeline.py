"""A corpus pipeline in five stages, each an operator of morae.llm over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes each stage's result as Parquet in the shared folder and reads it again as the next one's docs.

Null text: as empty; such documents and others under 50 words go in the first stage. Very long texts are taken whole. Repeated rows
of a doc_id are told by their texts; equal ones are treated alike until the third stage, which keeps one of them. Ties: the least
doc_id, then line or position, stays. Extra columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morae.llm import common as c
from morae.llm import jaccard, line_dedup, packing, quality, substrings


def _replaced(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The documents with new texts (doc_id, ver, text, changed), n_chars with them."""
    key, new_text, is_new = (c.fresh(x, docs.columns) for x in ("ver", "new_text", "is_new"))
    # equal rows have equal new texts
    new = texts.where("changed").groupBy("doc_id", F.col("ver").alias(key)).agg(F.first("text").alias(new_text), F.lit(True).alias(is_new))
    out = docs.withColumn(key, c.version()).join(new, ["doc_id", key], "left").withColumn("text", F.when(F.col(is_new), F.col(new_text)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(is_new), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _inked(docs: DataFrame) -> DataFrame:
    """Documents that have a word left."""
    return docs.where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that stand in too many documents of a host are taken out of the others."""
    return quality.clean(docs)


def near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier within the edit distance go; a document without any text left goes too."""
    texts = line_dedup.dedup(docs, least=1).withColumn("changed", F.col("n_removed") > 0)
    return _inked(_replaced(docs, texts))


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, of repeated rows one."""
    key = c.fresh("ver", docs.columns)
    rows = c.checkpoint(jaccard.join(docs).where("doc_id = component_id").select("doc_id", F.col("ver").alias(key), "component"))
    first = rows.groupBy("doc_id", "component").agg(F.min(key).alias(key)).select("doc_id", key)
    out = docs.withColumn(key, c.version()).join(first, ["doc_id", key], "left_semi")
    if not rows.groupBy("doc_id", key).count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", key])
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that an earlier document holds go; a document without any text left goes too."""
    found = substrings.remove(docs).withColumn("changed", F.col("n_removed") > 0)
    return _inked(_replaced(docs, found))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed."""
    return packing.query(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", near_lines),
    ("ngram_jaccard", near_documents),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed_sequences),
]

#: Edit joins, removal of spans and packing can't be written in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs, before = c.table(spark, sf_dir, "documents"), ""
    for _, stage in STAGES[:-1]:
        path = c.place(spark)
        docs = c.written(stage(spark, docs, sf_dir), path)
        if before:  # used up
            c.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
