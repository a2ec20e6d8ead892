"""Coverage, residue and totals."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import phonology
from ..functions.text import once
from ..storage import kept


def ratio(difference: Column, before: Column) -> Column:
    return F.coalesce(F.try_divide(difference.cast("double"), before.cast("double")), F.lit(0.0))


#: what names are made of: runs of letters, digits and low lines, and what stands between them
NAME_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
NAME_RUN = r"[\p{L}\p{N}_]+"
NAME_WORD = r"^[\p{L}\p{N}_]"


def name_places(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, places: array of struct(at, n), the places (from 0) of names among a text's pieces, as a pattern of alternatives between word borders
    finds them: from left to right, without overlap, of several names at a place the one with the least `ord` (without one: the longest, then
    the least).

    names: name[, ord]; one of several words stands in the text with the same signs between them. Names that don't begin and end in a word
    are never found. A text's distinct words meet the names' first words by an equi-join, whose names' size is known, and the names that may stand in it
    go back to the text as one row; neither its pieces nor their places are shuffled.
    """
    pieces = F.regexp_extract_all("name", F.lit(NAME_PIECE), F.lit(0))
    order = F.col("ord").cast("long") if "ord" in names.columns else -F.char_length("name").cast("long")
    own = names.where(F.col("name").rlike(NAME_WORD) & F.col("name").rlike(r"[\p{L}\p{N}_]$")).groupBy("name").agg(F.min(order).alias("order"))
    own = kept(own.select("name", "order", pieces.alias("own")).withColumn("word", F.get("own", F.lit(0))))
    words = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(0)))).alias("word"))
    met = words.join(own, "word").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("order", "name", "own"))).alias("_names"))
    asked = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(met, "_key")
    at = F.pandas_udf(_places, "at array<int>, n array<int>")(F.regexp_extract_all("_text", F.lit(NAME_PIECE), F.lit(0)), F.col("_names.own"))
    return asked.select(F.col("_key").alias(key), once(at).alias("_at")).select(key, F.arrays_zip(F.col("_at.at").alias("at"), F.col("_at.n").alias("n")).alias("places")).where(F.size("places") > 0)


def _places(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
    """names: each as its pieces, in the order in which they are tried."""
    out: list[tuple[list[int], list[int]]] = []
    for pieces, all_ in zip(texts, names, strict=True):
        own, by_first = pieces.tolist(), {}
        for name in all_:
            by_first.setdefault(name[0], []).append(name.tolist())
        at, n, end = [], [], 0
        for k in [k for k, piece in enumerate(own) if piece in by_first]:
            found = k >= end and next((len(name) for name in by_first[own[k]] if own[k : k + len(name)] == name), 0)
            if found:
                at.append(k)
                n.append(found)
                end = k + found
        out.append((at, n))
    return pd.DataFrame(out, columns=["at", "n"])


def _cut(pieces: Column, places: Column) -> Column:
    """What is left of the pieces, as text, with single spaces and trimmed."""
    begin = F.concat(F.array(F.lit(0)), F.transform(places, lambda x: x["at"] + x["n"]))
    end = F.concat(F.transform(places, lambda x: x["at"]), F.array(F.size(pieces)))
    stay = F.flatten(F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda g: F.slice(pieces, g["a"] + 1, g["b"] - g["a"])))
    return F.regexp_replace(F.regexp_replace(F.array_join(stay, ""), r"(?U)\s+", " "), "^ | $", "")


def without_names(texts: DataFrame, names: DataFrame, key: str, text: str, marked: str | None = None) -> DataFrame:
    """The texts without names (see `name_places`), with single spaces where one went, as they stand elsewhere. marked: the same text with marks, which
    loses the same words, if it has as many."""
    found = name_places(texts, names, key, text)
    out = texts.join(found, key, "left").withColumn("_pieces", once(F.when(F.col("places").isNotNull(), F.regexp_extract_all(text, F.lit(NAME_PIECE), F.lit(0)))))
    cut = {text: F.when(F.col("places").isNotNull(), _cut(F.col("_pieces"), F.col("places"))).otherwise(F.col(text))}
    if marked:
        out = out.withColumn("_marked", once(F.when(F.col("places").isNotNull(), F.regexp_extract_all(marked, F.lit(NAME_PIECE.replace("_", "_^")), F.lit(0)))))
        cut[marked] = F.when(F.size("_marked") == F.size("_pieces"), _cut(F.col("_marked"), F.col("places"))).otherwise(F.col(marked))
    return out.withColumns(cut).select(*texts.columns)


def coverage(df: DataFrame, before: str, after: str, *by: str, rollup: bool = False, names: DataFrame | None = None, ambiguous: bool = False, literal: bool = False) -> DataFrame:
    """before, after, difference, ratio of open doubtful vowels. names: words or rows of words (name) that are left out, of both texts by what
    stands in the first without marks (literal: of the first only); ambiguous: only those that the accent rules leave open."""
    if ambiguous:
        from .macronize import ambiguous_dichrona as count
    else:
        count = phonology.open_dichrona
    if names is not None:
        df = without_names(kept(df.withColumn("_row", F.monotonically_increasing_id())), names, "_row", before, None if literal else after)
    counted = df.select(*by, count(F.col(before)).alias("_b"), count(F.col(after)).alias("_a"))
    grouped = counted.rollup(*by) if rollup else counted.groupBy(*by)
    out = grouped.agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("before"), F.coalesce(F.sum("_a"), F.lit(0)).alias("after"))
    return out.withColumn("difference", F.col("before") - F.col("after")).withColumn("ratio", ratio(F.col("difference"), F.col("before")))


def residue(tokens: DataFrame, token: str = "token", keep: Callable[[DataFrame], DataFrame] = lambda counted: counted) -> DataFrame:
    """Tokens by falling count, then by code points; keep: a filter of the distinct tokens."""
    return keep(tokens.groupBy(token).agg(F.count("*").alias("n"))).orderBy(F.desc("n"), token)


def keep_first(tokens: DataFrame, token: str, *order: str) -> DataFrame:
    """The first row of each token: a least struct, combined on the map side, so a frequent token costs a row a task."""
    rest = [x for x in tokens.columns if x != token and x not in order]
    return tokens.groupBy(token).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(token, "_first.*").select(*tokens.columns)


def shares(hits: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Groups of at least so many rows, with their share of the total in per cent."""
    own = hits.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = own.agg(F.sum("n").alias("_total"))
    return own.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("_total"), 6)).drop("_total")


def merged_runs(lines: DataFrame) -> DataFrame:
    """word, count lines of several runs: rows whose count is a number, summed."""
    return lines.where(F.col("count").rlike("^[0-9]+$")).groupBy("word").agg(F.sum(F.col("count").cast("long")).alias("n")).orderBy(F.desc("n"), "word")


def top(df: DataFrame, by: str, value: str, n: int = 20) -> DataFrame:
    return df.groupBy(by).agg(F.sum(value).alias("n")).orderBy(F.desc("n"), by).limit(n)


def pivoted(stats: DataFrame, key: str = "key", value: str = "value", keys: tuple[str, ...] = ("numerator", "denominator")) -> DataFrame:
    """Key and value rows of all batches as one row of sums."""
    return stats.groupBy().pivot(key, list(keys)).agg(F.sum(value))


def reconciled(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Lines on one side only."""
    a, b = before.select(key, F.lit(1).alias("_a")), after.select(key, F.lit(1).alias("_b"))
    return a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key, F.col("_a").isNotNull().alias("in_input"), F.col("_b").isNotNull().alias("in_output"))


def even_batches(df: DataFrame, order: str, n: int = 4) -> DataFrame:
    """Contiguous batches of equal size; the remainder goes to the last; rows of equal order share a batch. The bounds are the
    rows' ranks in a table of counts by value, added up over ranges of values, not a window over all rows in one task."""
    values = df.groupBy(order).agg(F.count("*").alias("_n"))
    total = df.count()
    size = max(1, total // n)
    low, high = values.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.select(order, F.lit(0).alias("batch"))
    width = max(1, -(-(int(high) - int(low) + 1) // 1024))
    ranges = values.withColumn("_range", F.floor((F.col(order) - F.lit(int(low))) / width))
    sums = ranges.groupBy("_range").agg(F.sum("_n").alias("_all"))  # 1024 rows at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranges.join(F.broadcast(offsets), "_range").withColumn("_rank", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    named = ranked.select(order, F.least(F.floor(F.col("_rank") / size), F.lit(n - 1)).cast("int").alias("batch"))
    return df.select(order).join(named, order)


def chunk(order: Column, size: int = 1000) -> Column:
    return F.floor(order / size).cast("long")
