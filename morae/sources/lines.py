"""Lines of text files that may be larger than a split, numbered without reading a file in one task, and resumed where a run stopped.

Spark cuts a file into blocks, and a task reads the lines that begin in its blocks, in order. A block's lines are counted; the counts of
the blocks before it, added up over the file, and a line's place in its block make its number: one pass for the counts, one for the lines,
and no shuffle of lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """file (its path), line_no (from 0), line. Lines end as Python's universal newlines do; the end of a last line may be missing."""
    read = spark.read.option("pathGlobFilter", pattern).text(path)
    # the same relation is scanned twice, so both scans cut it into the same tasks: a line's id minus its block's least id is its place
    own = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    counts = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return own.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("id") - F.col("least")).alias("line_no"), "line")


def mark_done(done: DataFrame, store: str) -> None:
    """Remember the lines (file, line_no) that are done: for each file the next one, and whether it is `finished` if there is such a column. Marks are
    added, never changed, and the greatest counts, so a run that is repeated does no harm."""
    finished = F.max("finished") if "finished" in done.columns else F.lit(False)
    marks = done.groupBy("file").agg((F.max("line_no") + 1).alias("next"), finished.alias("finished"))
    marks.withColumn("mark", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(store)


def marks(spark: SparkSession, store: str) -> DataFrame:
    """file, next, finished: how far each file is done."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "file string, next long, finished boolean")
    return spark.read.parquet(store).groupBy("file").agg(F.max("next").alias("next"), F.max("finished").alias("finished"))


def resumed(spark: SparkSession, path: str, store: str, pattern: str = "*") -> DataFrame:
    """The numbered lines that aren't done. Finished files aren't opened at all."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"))
    done = marks(spark, store)
    key = F.regexp_replace("file", "^file:/+", "file:/")  # the two readers spell local paths in two ways
    open_ = listing.withColumn("_key", key).join(done.where("finished").select(key.alias("_key")), "_key", "left_anti").select("file")
    paths = [r["file"] for r in open_.collect()]  # names of files
    if not paths:
        return spark.createDataFrame([], "file string, line_no long, line string")
    own = numbered(spark, paths).withColumn("_key", key)
    return own.join(done.select(key.alias("_key"), "next"), "_key", "left").where("next IS NULL OR line_no >= next").select("file", "line_no", "line")
