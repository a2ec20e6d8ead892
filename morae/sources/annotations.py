"""A store of annotations by content: one row a text, under the key of its cleaned text.

The store is a Parquet table in buckets of keys. Adding texts rewrites the buckets that get a new key, and only those, by dynamic
partition overwrite: a run that is repeated, or broken off and begun again, leaves every key once. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cascade import EngineConfig
from ..operators.macronize import prepared
from ..storage import kept
from .readers import content_key

BUCKETS = 64
TOKENS = "array<struct<sent_id:int,tok_id:int,text:string,lemma:string,pos:string,morph:map<string,array<string>>>>"
SCHEMA = f"key string, tokens {TOKENS}, bucket int"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """key, tokens, bucket; empty where there is no store yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def add(new: DataFrame, path: str, replace: bool = False, buckets: int = BUCKETS) -> int:
    """Put texts (key, tokens) into the store, each key once; replace: also those that are there already. How many were put."""
    spark = new.sparkSession
    store = read_store(spark, path)
    own = new.groupBy("key").agg(F.min_by("tokens", F.to_json("tokens")).alias("tokens")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    own = kept(own if replace else own.join(store.select("key"), "key", "left_anti"))
    n = own.count()
    if n:
        touched = own.select("bucket").distinct()
        stay = store.join(touched, "bucket", "left_semi").join(own.select("key"), "key", "left_anti")
        # stored beside the table first: a table can't be overwritten while it is read
        whole = kept(stay.select("key", "tokens", "bucket").unionByName(own.select("key", F.col("tokens").cast(TOKENS).alias("tokens"), "bucket")))
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return n


def grouped(annotations: DataFrame, keys: DataFrame) -> DataFrame:
    """Annotations (doc_id, sent_id, tok_id, text, lemma, pos, morph) as rows of the store, for documents (doc_id, key); one without any gets an empty list."""
    token = F.struct(F.col("sent_id").cast("int").alias("sent_id"), F.col("tok_id").cast("int").alias("tok_id"), "text", "lemma", "pos", "morph")
    lists = annotations.groupBy("doc_id").agg(F.collect_list(token).alias("tokens"))
    ordered = F.array_sort("tokens", lambda a, b: F.when(a["sent_id"] == b["sent_id"], a["tok_id"] - b["tok_id"]).otherwise(a["sent_id"] - b["sent_id"]))
    own = keys.join(lists, "doc_id", "left")
    return own.select("key", F.coalesce(ordered, F.array().cast(TOKENS)).cast(TOKENS).alias("tokens"))


def annotated(documents: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, config: EngineConfig = EngineConfig(), reuse: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, sent_id, tok_id, text, lemma, pos, morph of documents (doc_id, text). Texts that the store knows aren't annotated again (reuse=False: they
    are, and replaced); `annotate` gets one document (doc_id, text) for each of the other texts, and the store its answers. Null text: no
    annotations."""
    spark = documents.sparkSession
    clean = prepared(F.col("text"), config)
    keyed = kept(documents.where("text IS NOT NULL").select("doc_id", clean.alias("text")).withColumn("key", content_key(F.col("text"))))
    wanted = keyed if not reuse else keyed.join(read_store(spark, path).select("key"), "key", "left_anti")
    asked = kept(wanted.groupBy("key").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("key", "first.*"))
    if not asked.isEmpty():
        add(grouped(annotate(asked.select("doc_id", "text")), asked.select("doc_id", "key")), path, not reuse, buckets)
    return keyed.select("doc_id", "key").join(read_store(spark, path), "key").select("doc_id", F.inline("tokens"))
