"""Evaluation against gold lines of bracketed syllables: [heavy] and {light}, with marks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks
from ..functions import profile as p
from . import alignment as alignment_of


def brackets_filled(line: Column) -> Column:
    """Text between brackets goes into the bracket on its left. Matches never overlap, so one pass settles it."""
    inner = F.regexp_replace(line, r"([\]}])([^\[\]{}]+)([\[{])", "$2$1$3")
    return F.regexp_replace(inner, r"([\]}])([^\[\]{}]+)$", "$2$1")


def plain(line: Column) -> Column:
    return F.translate(line, "[]{}#€_^", "")


def syllables(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"[\{\[]([^\}\]]+)[\}\]]"), F.lit(1))


SIGN = rf"[_^#€\s'.,;:!?{p.ANO_TELEIA}{p.QUESTION}]"


def is_closed(syllable: Column) -> Column:
    """Whether the last letter but signs and blanks isn't a vowel."""
    return ~syllable.rlike(p.ranged(f"[{p.VOWELS}]") + SIGN + r"*\z")


def closed_unmarked(all_: Column) -> Column:
    """Marks in closed syllables are removed."""
    return F.transform(all_, lambda s: F.when(is_closed(s), marks.stripped(s)).otherwise(s))


def stop_words_unmarked(words: Column, stop: list[str]) -> Column:
    return F.transform(words, lambda w: F.when(marks.stripped(w).isin(stop), marks.stripped(w)).otherwise(w))


def all_short(all_: Column) -> Column:
    """Every open syllable short: the baseline."""
    return F.transform(all_, lambda s: F.when(is_closed(s), marks.stripped(s)).otherwise(F.concat(marks.stripped(s), F.lit("^"))))


def open_count(all_: Column) -> Column:
    """How many syllables the baseline marks."""
    return F.size(F.filter(all_, lambda s: ~is_closed(s))).cast("long")


def open_in_line(line: Column) -> Column:
    """The `open_count` of a line's syllables, by one scan: brackets whose last letter but signs and blanks is a vowel."""
    return F.regexp_count(line, F.lit(p.ranged(rf"[{{\[][^}}\]]*[{p.VOWELS}]") + rf"{SIGN}*[}}\]]")).cast("long")


def stripped_gold(line: Column) -> Column:
    """Without marks and brackets."""
    return F.translate(line, "^_[]{}", "")


def traffic_light(value: Column) -> Column:
    return F.when(value > 0.95, "green").when(value > 0.85, "yellow").otherwise("red")


def line_match(a: Column, b: Column) -> Column:
    """Equality without marks."""
    return marks.stripped(a) == marks.stripped(b)


VOWELS = "short_right long, short_total long, long_right long, long_total long"


def vowel_scores(df: DataFrame, output: str, gold: str, *by: str) -> DataFrame:
    """Success rates of short, long and both marks, by group and overall (rollup): marks letter by letter where bases agree. output, gold: lines, or
    whole texts."""
    return success(df.select(*by, F.pandas_udf(vowel_marks, VOWELS)(output, gold).alias("x")), "x", *by)


def success(df: DataFrame, counts: str, *by: str) -> DataFrame:
    """`vowel_scores` of what `vowel_marks` counts (VOWELS). Groups without marks are left out after they are summed: a condition on what Python returns is asked
    where the table is read, a second time, and before its rows are dealt."""
    kinds = ["short_right", "short_total", "long_right", "long_total"]
    out = df.rollup(*by).agg(*(F.sum(f"{counts}.{k}").alias(k) for k in kinds)).where("short_total + long_total > 0")
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return out.withColumns({"short_rate": rate(c("short_right"), c("short_total")), "long_rate": rate(c("long_right"), c("long_total")), "both_rate": rate(c("short_right") + c("long_right"), c("short_total") + c("long_total"))})


_UNMARKED = str.maketrans("", "", p.MARKS)


def vowel_marks(output: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Of texts that are equal but for marks: of both, the first mark behind every letter, compared for many texts at once. Others count nothing, nor does
    a mark at the beginning of a line."""
    counts = np.zeros((len(gold), 4), np.int64)
    known = np.flatnonzero((output.notna() & gold.notna()).to_numpy())
    output, gold = output.to_numpy()[known].tolist(), gold.to_numpy()[known].tolist()
    size = np.cumsum([len(x) + 1 for x in gold])
    cut = [0, *(np.flatnonzero(np.diff(size // LETTERS_AT_ONCE)) + 1).tolist(), len(gold)]
    for low, high in zip(cut, cut[1:], strict=False):
        if low == high:
            continue
        rows = known[low:high]
        of_output, of_gold = _letters_and_marks(output[low:high]), _letters_and_marks(gold[low:high])
        if not all(map(np.array_equal, of_output[:2], of_gold[:2])):
            same = [k for k in range(low, high) if output[k].translate(_UNMARKED) == gold[k].translate(_UNMARKED)]
            if not same:
                continue
            rows = known[same]
            of_output, of_gold = _letters_and_marks([output[k] for k in same]), _letters_and_marks([gold[k] for k in same])
        ends, letters, real = of_gold
        own = of_output[2]
        real[letters == ord("\n")] = 0
        begins = np.concatenate([[0], ends[:-1] + 1])
        for kind, mark in ((0, p.SHORT), (2, p.LONG)):
            wanted = real == ord(mark)
            counts[rows, kind] = np.add.reduceat(wanted & (own == ord(mark)), begins, dtype=np.int64)
            counts[rows, kind + 1] = np.add.reduceat(wanted, begins, dtype=np.int64)
    return pd.DataFrame(counts, columns=["short_right", "short_total", "long_right", "long_total"])


def _letters_and_marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the letters that end texts, line feeds of our own, all letters, and the mark behind each, or another number."""
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.ones(len(code), bool)
    for mark in p.MARKS:
        letters &= code != ord(mark)
    at = np.flatnonzero(letters)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    return np.cumsum(letters)[ends] - 1, code[at], np.append(code, np.uint32(0))[at + 1]


SCORE = "expected long, correct long"
POINTED = "expected long, correct long, short_total long, short_right long, long_total long, long_right long"


def alignment(output: Column, gold: Column) -> Column:
    """Marks in the gold line (expected), and those of them inside blocks that the output matches (correct)."""
    return F.pandas_udf(aligned, SCORE)(output, gold)


def backward(output: Column, gold: Column, literal: bool = False) -> Column:
    """Both lines read from their ends: a short mark fails only on an explicit long one, a long mark on anything else; gold marks
    that the output has no letters left for count too. literal: at a short mark without its counterpart a letter is passed over."""
    return F.pandas_udf(lambda a, b: _backward(a, b, literal), POINTED)(output, gold)


LETTERS_AT_ONCE, SHORT = 1 << 18, 24


def aligned(output: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Lines are compared together, as many as have about so many letters."""
    output, gold = output.fillna("").tolist(), gold.fillna("").tolist()
    size = np.cumsum([len(a) + len(b) for a, b in zip(output, gold, strict=True)])
    cut = [0, *(np.flatnonzero(np.diff(size // LETTERS_AT_ONCE)) + 1).tolist(), len(gold)]
    expected = np.array([sum(b.count(m) for m in p.MARKS) for b in gold], np.int64)
    correct = np.zeros(len(gold), np.int64)
    for low, high in zip(cut, cut[1:], strict=False):
        line, _, begin, n = alignment_of.blocks(output[low:high], gold[low:high], SHORT)
        own = alignment_of.Letters(gold[low:high])
        marks_before = np.concatenate([[0], np.cumsum(np.isin(own.letters, [ord(m) for m in p.MARKS]))])
        np.add.at(correct, low + line, marks_before[own.at[line] + begin + n] - marks_before[own.at[line] + begin])
    return pd.DataFrame({"expected": expected, "correct": correct})


def _backward(output: pd.Series, gold: pd.Series, literal: bool) -> pd.DataFrame:
    rows = []
    for a, b in zip(output.fillna(""), gold.fillna(""), strict=True):
        i, total, right = len(a) - 1, {p.SHORT: 0, p.LONG: 0}, {p.SHORT: 0, p.LONG: 0}
        for want in reversed(b):
            have = a[i] if i >= 0 else ""
            if want in p.MARKS:
                total[want] += 1
                right[want] += have == p.LONG if want == p.LONG else have != p.LONG
                i -= (have == p.LONG) if want == p.LONG else (have != "" and (literal or have in p.MARKS))
            else:
                while not literal and i >= 0 and a[i] in p.MARKS:
                    i -= 1  # a mark that gold doesn't have
                i -= 1
        rows.append((sum(total.values()), sum(right.values()), total[p.SHORT], right[p.SHORT], total[p.LONG], right[p.LONG]))
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in POINTED.split(", ")])
