"""Text preparation as column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile as p

SENTENCE = "[^.\\n;\u037e]+[.\\n;\u037e]?"
ENDS = ".\n;\u037e"
#: a letter, whatever it is, up to the next end; at a text's end what has none, so that no tail is tried again from each of its letters
TERMINATED = "(?s).[^.\\n;\u037e]*+[.\\n;\u037e]?+"


BREAKS = sorted({*map(ord, p.WORD_BREAKS), *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000})
#: all that is neither a break nor white space, spelled as ranges, Greek letters first
_BETWEEN = [(low + 1, high - 1) for low, high in zip([-1, *BREAKS], [*BREAKS, 0x110000], strict=True) if high - low > 1]
WORD = "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in sorted(_BETWEEN, key=lambda x: (x[0] < 0x370, x))) + "]++"


def once(value: Column) -> Column:
    """A value that the optimiser can't copy into every expression that uses it."""
    return F.explode(F.array(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced(col: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, col)


def deleted(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def mapped(col: Column, pairs: dict[str, str]) -> Column:
    return F.translate(col, "".join(pairs), "".join(pairs.values()))


def transliterated(col: Column) -> Column:
    return F.translate(F.lower(col), p.LATIN, p.GREEK)


def without_editorial(col: Column) -> Column:
    return deleted(col, p.EDITORIAL)


def without_noise(col: Column) -> Column:
    return deleted(col, p.NOISE[1:-1])


def unified_apostrophes(col: Column) -> Column:
    return F.translate(col, p.APOSTROPHES, "'" * len(p.APOSTROPHES))


def premarked(col: Column, glue: bool = False) -> Column:
    """Marks of two words that taggers get wrong; glue: also eat the spaces around them."""
    if glue:
        return replaced(col, [(r"\sτἄλλα\s", "τἄλλα^"), (r"\sἁ\s", "ἁ_")])
    return replaced(col, [(r"(\s)τἄλλα(?=\s)", "$1τἄλλα^"), (r"(\s)ἁ(?=\s)", "$1ἁ_")])


def word_list(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def words(col: Column) -> Column:
    """Maximal runs of letters, marks and digits."""
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{M}\p{N}_^']+"), F.lit(0))


def sentences(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(SENTENCE), F.lit(0))


def terminated_sentences(col: Column) -> Column:
    """Sentences with their end; a tail without one is dropped."""
    ended = lambda s: (F.char_length(s) > 1) & F.right(s, F.lit(1)).isin(*ENDS)
    return F.filter(F.regexp_extract_all(col, F.lit(TERMINATED), F.lit(0)), ended)


def without_digits(col: Column) -> Column:
    return F.regexp_replace(col, "[0-9]", "")


def lunate_resolved(col: Column) -> Column:
    return F.translate(F.regexp_replace(col, r"ϲ(\s|$)", "ς$1"), "ϲ", "σ")


def first_word_lowered(col: Column) -> Column:
    """The first word in lower case if it holds a vowel; single spaces between words."""
    own = F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")
    first = F.coalesce(F.get(own, F.lit(0)), F.lit(""))
    rest = F.slice(own, 2, F.greatest(F.size(own), F.lit(1)))
    return F.concat_ws(" ", F.array(F.when(first.rlike(p.ranged(f"[{p.VOWELS}]")), F.lower(first)).otherwise(first)), rest)


def comparable(col: Column) -> Column:
    return F.trim(F.translate(deleted(col, p.NORMAL_DROP), "\u00b4", "'"))


def has_vowel(col: Column) -> Column:
    return col.rlike(p.ranged(f"[{p.VOWELS}]"))


def space_before_end_fixed(col: Column) -> Column:
    return F.regexp_replace(col, " (.)$", "$1")


def is_numeral(col: Column) -> Column:
    """An alphabetic numeral: letters, then a keraia or what stands for it."""
    return col.rlike("^[α-ωΑ-Ωϛϟϡ]{1,4}[\u02b9\u0384\u00b4\u0374']$") | col.rlike("^\u0375[α-ωϛϟϡ]+$")


def mid_final_sigma(col: Column) -> Column:
    return col.rlike("ς.")


def bad_accents(col: Column) -> Column:
    n = lambda chars: F.regexp_count(col, F.lit(p.ranged(f"[{chars}]")))
    return (n(p.GRAVES) > 1) | ((n(p.GRAVES) > 0) & (n(p.ACUTES) > 0)) | (n(p.ACCENTS) > 2) | (n(p.ROUGHS) > 2)


def token_clean(col: Column) -> Column:
    return deleted(col, p.ANO_TELEIA + p.QUESTION)


def context_particle(tokens: DataFrame, *by: str) -> DataFrame:
    """Mark the particle an: long where its sentence has a subjunctive and no ei, short elsewhere."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    subjunctive = F.max(F.array_contains(F.coalesce(F.col("morph")["Mood"], F.array().cast("array<string>")), "Sub")).over(w)
    conditional = F.max(F.col("text").isin("εἰ", "εἴ")).over(w)
    tokens = tokens.withColumns({"_sub": subjunctive, "_ei": conditional})
    particle = F.col("text").isin("ἄν", "ἂν")
    mark = F.when(F.col("_sub") & ~F.col("_ei"), F.regexp_replace("text", "ν$", "_ν")).otherwise(F.regexp_replace("text", "ν$", "^ν"))
    return tokens.withColumn("marked", F.when(particle, mark)).drop("_sub", "_ei")


def drop_reason(token: Column, stop: list[str] | None = None, odd: Column | None = None, exempt: tuple[str, ...] = ("ἄν", "ἂν")) -> Column:
    """Why a token isn't worked on, or null: numerals, stop words, misspellings, tokens in `odd`, which aren't in the word list of
    their text (but for the particle, which taggers cut off), and those that leave nothing open."""
    from .phonology import open_dichrona

    reasons = F.when(is_numeral(token), "numeral")
    if stop:
        reasons = reasons.when(token.isin(list(stop)), "stop_word")
    reasons = reasons.when(mid_final_sigma(token), "mid_sigma").when(bad_accents(token), "accents")
    if odd is not None:
        reasons = reasons.when(F.array_contains(odd, token) & ~token.isin(*exempt), "divergence")
    return reasons.when(open_dichrona(token) == 0, "nothing_to_do")


def agreeing(runs: Column, words: Column) -> Column:
    """The runs that are words of a list too, both of one text."""
    return F.pandas_udf(_agreeing, "array<string>")(runs, words)


def _agreeing(runs: pd.Series, words: pd.Series) -> pd.Series:
    """By a set of the list, so a text costs its length."""
    known = (None if own is None else set(own) for own in words)
    return pd.Series([None if all_ is None or own is None else [x for x in all_ if x in own] for all_, own in zip(runs, known, strict=True)], dtype=object)


def even_chunks(col: Column, n: int) -> Column:
    """The text in n chunks of even length, each drawn out to the end of its last word."""
    size = F.floor(F.char_length(col) / n)
    letter = r"^[\p{L}]*"

    def step(acc: Column, k: Column) -> Column:
        rest = F.substr(col, (acc["at"] + 1).cast("int"))
        plain = size
        tail = F.regexp_extract(F.substr(rest, (plain + 1).cast("int")), letter, 0)
        own = F.when(k == n - 1, rest).otherwise(F.concat(F.substr(rest, F.lit(1), plain.cast("int")), tail))
        return F.struct((acc["at"] + F.char_length(own)).cast("long").alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, step, lambda acc: acc["out"])


def first_column(col: Column) -> Column:
    return F.get(F.split(col, "\t"), F.lit(0))


def residual_characters(df: DataFrame, col: str) -> DataFrame:
    """The characters that are neither Greek, Latin, digits nor space, sorted, as one string."""
    # runs of plain characters go first, so a text costs two scans, and only the odd characters of a text, each once, are rows
    odd = F.regexp_replace(F.regexp_replace(col, p.ranged(f"[{p.LETTERS}A-Za-z0-9]+"), ""), r"(?U)[\s\p{Cntrl}]+", "")
    chars = df.select(F.explode(F.array_distinct(F.split(odd, ""))).alias("ch")).where("ch <> ''").distinct()
    return chars.agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("chars"))
