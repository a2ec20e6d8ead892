"""The engine on streams of lines: chunks, running totals and appended pairs, restartable by Spark's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import phonology
from ..functions import text as t
from ..sources.readers import TSV


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """line of every new file of a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("value").alias("line"))


def prepared(lines: DataFrame) -> DataFrame:
    """The cleaning of corpus lines: digits, lunate sigma, first word, comparison form, vowels, last space."""
    out = lines.withColumn("unmarked", t.space_before_end_fixed(t.comparable(t.first_word_lowered(t.lunate_resolved(t.without_digits(F.col("line")))))))
    return out.where(t.has_vowel(F.col("unmarked")))


def annotated(lines: DataFrame) -> DataFrame:
    """unmarked, marked: the accent rules on every word of a line, without lexica."""
    words = F.split("unmarked", " ")
    return lines.withColumn("marked", F.array_join(F.transform(words, lambda w: phonology.accent_rules(w)), " "))


def totals(pairs: DataFrame) -> DataFrame:
    """Running numerator and denominator of the coverage."""
    before, after = phonology.open_dichrona(F.col("unmarked")), phonology.open_dichrona(F.col("marked"))
    return pairs.agg(F.sum(before - after).alias("numerator"), F.sum(before).alias("denominator"))


def append_pairs(pairs: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append unmarked, marked as TSV; a batch that is run again overwrites its own part only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("unmarked", "marked").write.mode("overwrite").csv(f"{path}/batch={number}", quote="", escape="", **TSV)
        if then:
            then(batch, number)

    return pairs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
