"""Syllables, accents and the count of vowels of doubtful length."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import profile as p
from .text import deleted, let, mapped, replaced

C = f"[{p.CONSONANTS}{p.DOUBLE}]"
#: one consonant of several closes a syllable; what follows the last vowel stays with it
SYLLABLE = f"[^{p.VOWELS}]*{p.NUCLEUS}[_^]*(?:[^{p.VOWELS}]+$|{C}(?={C}))?"


def classes(col: Column) -> Column:
    return replaced(mapped(col, p.CODES), p.CLASSES)


def open_dichrona(col: Column) -> Column:
    """The number of unmarked vowels of doubtful length in open syllables: the objective of the engine."""
    return (F.regexp_count(F.concat(mapped(col, p.CODES), F.lit(p.LAST)), F.lit(p.OPEN)) - 1).cast("long")


def syllables(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(p.ranged(SYLLABLE)), F.lit(0))


def accent_class(word: Column) -> Column:
    return let(syllables(word), _accent_class)


def _accent_class(own: Column) -> Column:
    at = lambda k, chars: F.coalesce(F.get(own, F.size(own) - k).rlike(f"[{chars}]"), F.lit(False))
    return (
        F.when(at(1, p.ACUTES + p.GRAVES), "oxytone")
        .when(at(1, p.CIRCUMFLEXES), "perispomenon")
        .when(at(2, p.ACUTES), "paroxytone")
        .when(at(2, p.CIRCUMFLEXES), "properispomenon")
        .when(at(3, p.ACUTES), "proparoxytone")
    )


def short_vowel(syllable: Column) -> Column:
    return ~syllable.rlike(p.ranged(p.DIPHTHONG)) & syllable.rlike(p.ranged(f"[{p.SHORT_VOWELS}]|[{p.DICHRONA}]\\^"))


def long_acute(syllable: Column) -> Column:
    long_ = syllable.rlike(p.ranged(p.DIPHTHONG)) | syllable.rlike(p.ranged(f"[{p.LONG_VOWELS}{p.SUBSCRIPTS}]|[{p.DICHRONA}]_"))
    return syllable.rlike(p.ranged(f"[{p.ACUTES}]")) & long_


def true_dichronon(syllable: Column) -> Column:
    return ~syllable.rlike(p.ranged(p.DIPHTHONG)) & syllable.rlike(p.ranged(f"[{p.DICHRONA}]"))


def marks_diphthong(word: Column, any_subscript: bool = False) -> Column:
    """Whether a diphthong or a vowel with subscript is marked, or a diphthong split; any_subscript: also an unmarked subscript."""
    found = word.rlike(p.ranged(f"(?:{p.DIPHTHONG}|{p.ADSCRIPT}|[{p.SUBSCRIPTS}])[_^]")) | word.rlike(p.ranged(p.SPLIT_DIPHTHONG))
    return found | word.rlike(p.ranged(f"[{p.SUBSCRIPTS}]")) if any_subscript else found


def unmark_diphthongs(word: Column) -> Column:
    clean = lambda own: F.array_join(F.transform(own, lambda s: F.when(marks_diphthong(s), deleted(s, p.MARKS)).otherwise(s)), "")
    return let(syllables(word), lambda own: F.when(F.array_join(own, "") == word, clean(own)).otherwise(word))


def marked_syllable(syllable: Column, mark: str) -> Column:
    """The mark behind the last vowel, if that is of doubtful length and unmarked."""
    return F.when(true_dichronon(syllable), F.regexp_replace(syllable, p.ranged(f"([{p.DICHRONA}])([^{p.VOWELS}_^]*)$"), f"$1{mark}$2")).otherwise(syllable)


def accent_rules(word: Column, any_subscript: bool = False) -> Column:
    """Lengths that the place of the accent decides."""

    def ruled(own: Column, kind: Column) -> Column:
        n = F.size(own)
        last, before = F.get(own, n - 1), F.get(own, n - 2)
        start = F.array_join(F.slice(own, 1, F.greatest(n - 2, F.lit(0))), "")
        a = F.when((kind == "paroxytone") & short_vowel(last), F.concat(start, marked_syllable(before, p.SHORT), last))
        b = F.when((kind == "paroxytone") & long_acute(before) & true_dichronon(last), F.concat(start, before, marked_syllable(last, p.LONG)))
        c = F.when(kind.isin("properispomenon", "proparoxytone") & true_dichronon(last), F.concat(start, before, marked_syllable(last, p.SHORT)))
        return F.when((n >= 2) & (F.array_join(own, "") == word), F.coalesce(a, b, c))

    found = let(syllables(word), lambda own: let(_accent_class(F.transform(own, lambda s: deleted(s, p.MARKS))), lambda kind: ruled(own, kind)))
    answer = let(found, lambda x: F.when(~marks_diphthong(x, any_subscript), x))
    return F.when((word == "") | word.contains("'"), word).otherwise(F.coalesce(answer, word))


def open_in_synapheia(syllable: Column, is_last: Column, following: Column) -> Column:
    """Openness with an eye on the next word: a last consonant goes over to a following vowel; two consonants close."""
    bare = deleted(syllable, p.MARKS + "'")
    vowel_end = bare.rlike(p.ranged(f"[{p.VOWELS}]$"))
    next_vowel = following.isNull() | following.rlike(p.ranged(f"^[{p.VOWELS}]"))
    next_cluster = following.rlike(p.ranged(f"^(?:{C}{C}|[{p.DOUBLE}])"))
    one_consonant = bare.rlike(p.ranged(f"[{p.VOWELS}][{p.CONSONANTS}]$"))
    return F.when(~is_last, vowel_end).otherwise((vowel_end & ~F.coalesce(next_cluster, F.lit(False))) | (one_consonant & next_vowel))


def openness(words: Column) -> Column:
    """Whether each syllable of the words, end to end, is open: a word's last one looks at the first of the next word."""
    return F.transform(F.filter(F.split(openness_signs(words), ""), lambda x: x != ""), lambda x: x == "o")


def openness_signs(words: Column) -> Column:
    """`openness` as a string: o for an open syllable, c for a closed one. Words are cut to syllables once a task."""
    return F.pandas_udf(_openness, "string")(words)


_SYLLABLE, _VOWEL, _CLUSTER = re.compile(SYLLABLE), re.compile(f"[{p.VOWELS}]"), re.compile(f"{C}{C}|[{p.DOUBLE}]")
_VOWEL_END, _ONE_CONSONANT = re.compile(f"[{p.VOWELS}]$"), re.compile(f"[{p.VOWELS}][{p.CONSONANTS}]$")
_UNMARKED = str.maketrans("", "", p.MARKS + "'")
WORDS_AT_ONCE = 1 << 18


def _spoken(word: str) -> tuple[str, str, int] | None:
    """The signs of a word's syllables but the last; that of the last one before a vowel or nothing, before consonants that close, and before another
    beginning; which of these the word itself begins with."""
    own = _SYLLABLE.findall(word)
    if not own:
        return None
    bare = [s.translate(_UNMARKED) for s in own]
    vowel, one = bool(_VOWEL_END.search(bare[-1])), bool(_ONE_CONSONANT.search(bare[-1]))
    first = 0 if _VOWEL.match(own[0]) else 1 if _CLUSTER.match(own[0]) else 2
    return "".join("o" if _VOWEL_END.search(s) else "c" for s in bare[:-1]), "".join("o" if x else "c" for x in (vowel or one, False, vowel)), first


def _openness(texts: pd.Series) -> pd.Series:
    known: dict[str, tuple[str, str, int] | None] = {}
    out: list[str | None] = []
    for words in texts:
        if words is None:
            out.append(None)
            continue
        if len(known) > WORDS_AT_ONCE:
            known.clear()
        signs: list[str] = []
        last = ""
        for word in words:
            if word not in known:
                known[word] = _spoken(word)
            own = known[word]
            if own is not None:
                if last:
                    signs.append(last[own[2]])
                signs.append(own[0])
                last = own[1]
        out.append("".join(signs) + last[:1])
    return pd.Series(out, dtype=object)


def bare_letters(col: Column) -> Column:
    return mapped(col, p.BARE)
