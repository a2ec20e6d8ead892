"""Lexica as relations (form, marked, ...), validated, widened by case variants, and joined to tokens.

Lexica are joined without hints: Spark broadcasts one whose measured size is under its threshold and shuffles a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import marks, phonology


def read(spark, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A lexicon from a caller's path."""
    return spark.read.format(fmt).options(**options).load(path)


def validate(lexicon: DataFrame) -> DataFrame:
    """Entries (ord, form, marked) with what is wrong with them, if anything."""
    rivals = Window.partitionBy("form")
    problem = (
        F.when(F.col("form").rlike("[_^]"), "mark_in_key")
        .when(F.col("form").rlike("[A-Za-z]") | F.col("marked").rlike("[A-Za-z]"), "latin_letter")
        .when(marks.stripped(F.col("marked")) != F.col("form"), "other_word")
        .when(~F.col("marked").rlike("[_^]"), "no_mark")
        .when((F.count("*").over(rivals) > 1), "duplicate_key")
    )
    return lexicon.withColumn("problem", problem)


def capitalized(col: Column) -> Column:
    return F.concat(marks.upper(F.substr(col, F.lit(1), F.lit(1))), F.substr(col, F.lit(2)))


def decapitalized(col: Column) -> Column:
    return F.concat(F.lower(F.substr(col, F.lit(1), F.lit(1))), F.substr(col, F.lit(2)))


def variants(lexicon: DataFrame) -> DataFrame:
    """One entry for each spelling: exact keys first, then, by their order, lower-case and capitalised ones."""
    exact = lexicon.select("form", "marked", F.lit(0).alias("kind"), "ord")
    low = lexicon.select(F.lower("form").alias("form"), F.lower("marked").alias("marked"), F.lit(1).alias("kind"), "ord")
    cap = lexicon.select(capitalized(F.col("form")).alias("form"), capitalized(F.col("marked")).alias("marked"), F.lit(1).alias("kind"), "ord")
    best = F.min(F.struct("kind", F.when(F.col("kind") == 0, -F.col("ord")).otherwise(F.col("ord")).alias("o"), "marked")).alias("best")
    return exact.unionByName(low).unionByName(cap).groupBy("form").agg(best).select("form", "best.marked")


def lookup(tokens: DataFrame, lexicon: DataFrame, key: Column, name: str) -> DataFrame:
    """Left join of a lexicon on a key: the found spelling as column `name`. Of equal forms the last entry (ord) wins; without an
    order the alphabetically least."""
    best = F.max_by("marked", "ord") if "ord" in lexicon.columns else F.min("marked")
    found = lexicon.groupBy("form").agg(best.alias(name)).withColumnRenamed("form", "_form")
    return tokens.join(found, key == F.col("_form"), "left").drop("_form")


def two_key(tokens: DataFrame, lexicon: DataFrame, key: str, name: str) -> DataFrame:
    """Exact form, then the form with a lower first letter; that answer gets its capital again."""
    out = lookup(tokens, lexicon, F.col(key), "_exact")
    out = lookup(out, lexicon, F.when(decapitalized(F.col(key)) != F.col(key), decapitalized(F.col(key))), "_low")
    return out.withColumn(name, F.coalesce("_exact", capitalized(F.col("_low")))).drop("_exact", "_low")


def disambiguated(tokens: DataFrame, alternatives: DataFrame, key: str, case: Column, name: str) -> DataFrame:
    """The first alternative (form, alt_id, marked, grammatical case) of the token's case, if it is the same word."""
    first = alternatives.groupBy("form", "case").agg(F.min_by("marked", "alt_id").alias(name)).withColumnsRenamed({"form": "_form", "case": "_case"})
    out = tokens.join(first, (F.col(key) == F.col("_form")) & (case == F.col("_case")), "left").drop("_form", "_case")
    return out.withColumn(name, F.when(marks.stripped(F.col(name)) == F.col(key), F.col(name)))


def generated(lines: DataFrame) -> DataFrame:
    """A lexicon from marked words (line_no, marked): of equal forms the last wins."""
    return lines.groupBy(marks.stripped(F.col("marked")).alias("form")).agg(F.max_by("marked", "line_no").alias("marked"))


def headwords(lsj: DataFrame) -> DataFrame:
    return lsj.select(phonology.bare_letters(F.lower("form")).alias("base")).distinct()


def ends_in_eta(tokens: DataFrame, ionic: DataFrame, col: str) -> DataFrame:
    """Tokens whose form, with its last letter as eta, is an Ionic form (stem = the form without its last letter)."""
    stems = ionic.select("stem").distinct()
    return tokens.join(stems, F.expr(f"substring({col}, 1, char_length({col}) - 1)") == F.col("stem"), "left_semi")

