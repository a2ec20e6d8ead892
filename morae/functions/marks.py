"""Length marks: `_` and `^` behind a vowel, combining marks, and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal
from . import profile as p
from .text import deleted, let, mapped


def stripped(col: Column) -> Column:
    return F.translate(col, p.MARKS, "")


def cells(col: Column) -> Column:
    """Characters with their marks."""
    return F.regexp_extract_all(col, F.lit("[^_^][_^]?"), F.lit(0))


def merged(new: Column, old: Column, precedence: str = "new") -> Column:
    """Union of the marks of two spellings of a word; where both mark a letter, precedence decides. Another word: old stays."""
    first, second = ("n", "o") if precedence == "new" else ("o", "n")

    def cell(n: Column, o: Column) -> Column:
        pick = {"n": n, "o": o}
        return F.when(F.length(pick[first]) > 1, pick[first]).otherwise(pick[second])

    def union(n: Column, o: Column) -> Column:
        both = F.array_join(F.zip_with(cells(n), cells(o), cell), "")
        return F.when(F.coalesce(n, F.lit("")) == "", o).when(F.coalesce(o, F.lit("")) == "", n).when(stripped(n) != stripped(o), o).otherwise(both)

    return let(new, lambda n: let(old, lambda o: union(n, o)))


def placed(word: Column, spec: Column) -> Column:
    """Marks from a list like `_3,^5`: behind the letter of that number; of several for one letter the first."""
    own = F.filter(F.split(spec, ","), lambda x: x.rlike("^[_^][0-9]+$"))
    letters = F.regexp_extract_all(stripped(word), F.lit(r"\p{L}\p{M}*|[^\p{L}]"), F.lit(0))

    def mark(letter: Column, i: Column) -> Column:
        hit = F.filter(own, lambda x: F.substr(x, F.lit(2)).cast("int") == i + 1)
        return F.concat(letter, F.coalesce(F.substr(F.get(hit, F.lit(0)), F.lit(1), F.lit(1)), F.lit("")))

    return F.array_join(F.transform(letters, mark), "")


def acuted(col: Column) -> Column:
    return mapped(col, p.GRAVE_TO_ACUTE)


def graved(col: Column) -> Column:
    return mapped(col, p.ACUTE_TO_GRAVE)


def normalized(col: Column) -> Column:
    """Canonical composition that keeps the Greek question mark and the ano teleia."""
    return normal.nfc(col)


def to_markup(col: Column) -> Column:
    return normal.to_markup(col)


def to_unicode(col: Column) -> Column:
    return normal.to_unicode(col)


def unlengthened(col: Column) -> Column:
    """Without combining length marks."""
    return normal.unlengthened(col)


def upper(col: Column) -> Column:
    return mapped(F.translate(col, "ς", "σ"), p.UPPER)


def lower(col: Column) -> Column:
    return F.lower(col)


def coloured(col: Column, before: str = "<d>", after: str = "</d>") -> Column:
    """Tags around unmarked vowels of doubtful length that stand in open syllables and in no diphthong, for display."""
    found = F.regexp_replace(col, p.ranged(f"({p.DIPHTHONG})|([{p.DICHRONA}])(?![_^])(?![{p.CONSONANTS}{p.DOUBLE}]{{2}}|[{p.DOUBLE}])"), f"$1{before}$2{after}")
    return F.replace(found, F.lit(before + after), F.lit(""))


__all__ = ["acuted", "cells", "coloured", "deleted", "graved", "lower", "merged", "normalized", "placed", "stripped", "to_markup", "to_unicode", "unlengthened", "upper"]
