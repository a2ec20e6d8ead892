"""Sources and sinks."""

from __future__ import annotations

import struct
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import lines


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """file, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def text_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """file, line_no, line of all files of a folder."""
    return lines.numbered(spark, path, pattern).withColumn("file", F.substring_index("file", "/", -1))


def lines_from(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Lines from a line number on: where a run was broken off."""
    return text_folder(spark, path, "*").where(F.col("line_no") >= start)


def spans(html: Column, name: str = "span") -> Column:
    """Texts of an element's plain occurrences in a page."""
    return F.regexp_extract_all(html, F.lit(rf"<{name}\b[^>]*>([^<]*)</{name}>"), F.lit(1))


def first_bracket(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"\[([^\]]+)\]", 1), F.lit(""))


def first_definition(json: Column, field: str = "definition") -> Column:
    """A field of the first entry of a JSON list."""
    return F.get_json_object(json, f"$[0].{field}")


def stardict_index(spark: SparkSession, path: str) -> DataFrame:
    """word, offset, size of each entry of a dictionary index file: a terminated key, then two 32-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows, at = [], 0
                while (end := raw.find(b"\0", at)) >= 0 and end + 9 <= len(raw):
                    rows.append((raw[at:end].decode("utf-8", "replace"), *struct.unpack(">II", raw[end + 1 : end + 9])))
                    at = end + 9
                yield pd.DataFrame(rows, columns=["word", "offset", "size"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, offset long, size long")


def content_key(clean: Column) -> Column:
    """The key that cached annotations of a text are kept under."""
    head = F.array_join(F.slice(F.split(clean, " "), 1, 2), "-")
    return F.concat(head, F.lit("-"), F.sha2(clean.cast("binary"), 256))


def uncached(docs: DataFrame, cache: DataFrame | None, clean: str = "clean_text") -> DataFrame:
    """Documents whose annotations aren't in the cache (key)."""
    keyed = docs.withColumn("key", content_key(F.col(clean)))
    return keyed if cache is None else keyed.join(cache.select("key").distinct(), "key", "left_anti")


def write_text(df: DataFrame, path: str, col: str = "text") -> None:
    df.select(col).write.mode("overwrite").text(path)


#: Tab-separated values as they are: Spark would trim them by default.
TSV = {"sep": "\t", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_pairs(df: DataFrame, path: str, perfect: str | None = None, mode: str = "append") -> None:
    """unmarked, marked as TSV; perfect: a column that must be 0."""
    df = df if perfect is None else df.where(F.col(perfect) == 0)
    df.select("unmarked", "marked").write.mode(mode).csv(path, quote="", escape="", **TSV)


class Unequal(ValueError):
    """A sink got another number of rows than its input has."""


def write_reconciled(before: DataFrame, change: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], strict: bool = True) -> tuple[int, int]:
    """Write what `change` makes of the input, and compare the numbers of rows that went in and came out: both are counted while the rows pass by in the
    one job, nothing is read again. Unequal: an error (strict) or a warning. The counts, in and out."""
    given, made = Observation(), Observation()
    write(change(before.observe(given, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n")))
    n, m = int(given.get["n"]), int(made.get["n"])
    if n != m:
        if strict:
            raise Unequal(f"{n} rows in, {m} rows out")
        warnings.warn(f"{n} rows in, {m} rows out", stacklevel=2)
    return n, m


def write_batches(df: DataFrame, path: str) -> None:
    df.select("batch", "unmarked", "marked").write.mode("overwrite").partitionBy("batch").csv(path, quote="", escape="", **TSV)


def write_stats(df: DataFrame, path: str) -> None:
    """numerator and denominator of each batch."""
    df.select("batch", "numerator", "denominator").write.mode("overwrite").csv(path, **TSV)


def write_residue(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").csv(path, **TSV)


def write_hits(df: DataFrame, path: str) -> None:
    """One folder for each module."""
    df.select("module", "token").write.mode("overwrite").partitionBy("module").text(path)
