"""Canonical forms and codecs in built-in functions against Python's Unicode data."""

import random
import unicodedata

from pyspark.sql import functions as F

from morae.functions import marks, normal
from morae.functions import profile as p

#: stand-ins for signs that a canonical form would change
HELD = {p.QUESTION: "\ue000", p.ANO_TELEIA: "\ue001"}


def _held(s: str) -> str:
    return s.translate(str.maketrans(HELD))


def _released(s: str) -> str:
    return s.translate(str.maketrans({b: a for a, b in HELD.items()}))


def plain_nfc(s: str | None) -> str | None:
    """NFC that keeps the Greek question mark and the ano teleia."""
    return None if s is None else _released(unicodedata.normalize("NFC", _held(s)))


def plain_markup(s: str | None) -> str | None:
    """Combining length marks become signs behind their letter; a middle dot and a semicolon become the Greek ones."""
    if s is None:
        return None
    out, mark = [], ""
    for ch in unicodedata.normalize("NFD", _held(s)):
        if ch in (p.MACRON, p.BREVE):
            mark = p.LONG if ch == p.MACRON else p.SHORT
            continue
        if not unicodedata.combining(ch) and mark:
            out.append(mark)
            mark = ""
        out.append(ch)
    text = "".join([*out, mark]).replace("\u00b7", HELD[p.ANO_TELEIA]).replace(";", HELD[p.QUESTION])
    return _released(unicodedata.normalize("NFC", text))


def plain_unicode(s: str | None) -> str | None:
    if s is None or not any(m in s for m in p.MARKS):
        return s
    out: list[str] = []
    for ch in s:
        if ch in p.MARKS and out:
            nfd = unicodedata.normalize("NFD", out.pop())
            out.append(unicodedata.normalize("NFC", nfd[0] + (p.MACRON if ch == p.LONG else p.BREVE) + nfd[1:]))
        else:
            out.append(ch)
    return "".join(out)


def plain_unlengthened(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFC", "".join(ch for ch in unicodedata.normalize("NFD", s) if ch not in (p.MACRON, p.BREVE)))



LETTERS = [*"αιυάίύᾱᾰῑῠέὲῆᾳᾴώὧᾧΐΰ;· abéñāǖḗ_^'Ωά", p.QUESTION, p.ANO_TELEIA, *"\u0301\u0300\u0342\u0313\u0314\u0308\u0345\u0304\u0306\u0323\u0327"]


def texts() -> list[str | None]:
    rng = random.Random(1)
    plane = [chr(k) for k in range(0x80, 0x10000, 3) if not 0xD800 <= k < 0xF900 and not 0xAC00 <= k < 0xD7A4]
    own = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    return own + plane + ["", None, "α" * 500, "ά́" * 200, "__a", "νεᾱνῐ́ᾱς", "νεα_νί^α_ς"]


def test_forms_and_codecs(spark):
    own = spark.createDataFrame([(t,) for t in texts()], "w string").repartition(4)
    c = F.col("w")
    built = own.select("w", marks.normalized(c).alias("nfc"), marks.unlengthened(c).alias("bare"), marks.to_markup(c).alias("markup"), marks.to_unicode(c).alias("unicode"))
    assert not any(x in built._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))
    # held signs stay here too, and a sign behind a single combining mark stays behind it
    odd = lambda s: s is not None and (any(ch in s for ch in normal.HELD) or any(unicodedata.combining(a) and b in "_^" for a, b in zip(s, s[1:])))
    for r in built.collect():
        w = r["w"]
        assert (r["nfc"], r["bare"], r["markup"]) == (plain_nfc(w), plain_unlengthened(w), plain_markup(w)), ascii(w)
        assert odd(w) or r["unicode"] == plain_unicode(w), ascii(w)


def test_codecs_are_inverse(spark):
    rng = random.Random(2)
    words = ["".join(ch + (rng.choice(["", "_", "^"]) if ch in "αιυάίύὰὶὺ" else "") for ch in (rng.choice("αιυάίύὰὶὺβγδλέ") for _ in range(8))) for _ in range(300)]
    own = spark.createDataFrame([(w,) for w in words], "w string").withColumn("u", marks.to_unicode(F.col("w"))).withColumn("back", marks.to_markup(F.col("u")))
    for r in own.collect():
        assert r["back"] == r["w"] and unicodedata.normalize("NFC", r["u"]) == r["u"] and not set(r["u"]) & set("_^")
