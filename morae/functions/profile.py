"""The polytonic alphabet, derived from Unicode decompositions rather than listed.

Every letter of the Greek blocks is classed by its base letter and its marks. Classes are strings of characters that go into
regular expressions; they mean the same in Java's and in RE2's syntax.
"""

from __future__ import annotations

import re
import unicodedata

ACUTE, GRAVE, CIRCUMFLEX = "\u0301", "\u0300", "\u0342"
ROUGH, SMOOTH, DIAERESIS, SUBSCRIPT = "\u0314", "\u0313", "\u0308", "\u0345"
MACRON, BREVE = "\u0304", "\u0306"
LONG, SHORT = "_", "^"
MARKS = LONG + SHORT

_LETTERS: dict[str, tuple[str, str]] = {}  # letter -> base (lower case), marks
for _code in (*range(0x370, 0x400), *range(0x1F00, 0x2000)):
    _ch = chr(_code)
    if unicodedata.category(_ch) in ("Lu", "Ll", "Lt"):
        _nfd = unicodedata.normalize("NFD", _ch)
        if unicodedata.normalize("NFC", _nfd) == _ch or len(_nfd) == 1 or _code >= 0x1F00:
            _LETTERS[_ch] = (_nfd[0].lower(), _nfd[1:])


def _letters(bases: str, having: str = "", lacking: str = "") -> str:
    return "".join(ch for ch, (base, marks) in _LETTERS.items() if base in bases and all(m in marks for m in having) and not any(m in marks for m in lacking))


#: vowels whose length the spelling leaves open: alpha, iota, upsilon without circumflex, subscript or length mark
DICHRONA = _letters("αιυ", lacking=CIRCUMFLEX + SUBSCRIPT + MACRON + BREVE)
VOWELS = _letters("αεηιουω")
SURE_VOWELS = "".join(ch for ch in VOWELS if ch not in DICHRONA)
DOUBLE = _letters("ζξψ")
CONSONANTS = _letters("βγδθκλμνπρστφχςϲϝ")
LETTERS = VOWELS + DOUBLE + CONSONANTS
ACUTES, GRAVES, CIRCUMFLEXES = _letters("αεηιουω", ACUTE), _letters("αεηιουω", GRAVE), _letters("αιυηω", CIRCUMFLEX)
ACCENTS = ACUTES + GRAVES + CIRCUMFLEXES
ROUGHS = _letters("αεηιουωρ", ROUGH)
SUBSCRIPTS = _letters("αηω", SUBSCRIPT)
LONG_VOWELS, SHORT_VOWELS = _letters("ηω"), _letters("εο")

#: second parts of diphthongs: iota and upsilon without diaeresis; first parts carry no accent or breathing
_I, _Y = _letters("ι", lacking=DIAERESIS), _letters("υ", lacking=DIAERESIS)
DIPHTHONG = f"(?:[αεουΑΕΟΥ][{_I}]|[αεηοωΑΕΗΟΩ][{_Y}])"
SPLIT_DIPHTHONG = f"(?:[αεουΑΕΟΥ][_^][{_I}]|[αεηοωΑΕΗΟΩ][_^][{_Y}])"
ADSCRIPT = "(?:[ηωΗΩ]ι)"
NUCLEUS = f"(?:{DIPHTHONG}|[{VOWELS}])"

TONOS = {ch: unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch).replace(GRAVE, ACUTE)) for ch in GRAVES}
#: grave -> acute for lower-case letters; one to one
GRAVE_TO_ACUTE = {a: b for a, b in TONOS.items() if a.islower() and len(b) == 1}
ACUTE_TO_GRAVE = {b: a for a, b in GRAVE_TO_ACUTE.items()}
#: letter -> its bare letter, case kept
BARE = {ch: unicodedata.normalize("NFD", ch)[0] for ch in _LETTERS if unicodedata.normalize("NFD", ch)[0] != ch}
#: letter -> the letter without its accent, breathings kept
UNACCENTED = {ch: unicodedata.normalize("NFC", "".join(m for m in unicodedata.normalize("NFD", ch) if m not in ACUTE + GRAVE + CIRCUMFLEX)) for ch in ACCENTS}
UNACCENTED = {a: b for a, b in UNACCENTED.items() if len(b) == 1 and a != b}
UPPER = {ch: ch.upper() for ch in LETTERS if ch.islower() and len(ch.upper()) == 1 and ch != "ς"}
LOWER = {b: a for a, b in UPPER.items() if a != "ς"}

# fixed values: signs and spellings
ANO_TELEIA, QUESTION = "\u0387", "\u037e"
APOSTROPHES = "\u2019\u2018\u02bc\u00b4\u0384\u1fbf"
EDITORIAL = "^_()[]{}<>⟨⟩⎡⎤\"«»-—…|⏑⏓†×"
WORD_BREAKS = "\u0387\u037e\u00b7.,!?;:\"()[]{}<>«»-—…|⏑⏓†×"
NORMAL_DROP = "^_[]{}()<>\"«»’‘ʼ`-—–"
STOP_WORDS_EPIC = ("ἀνήρ", "καλός", "καλὸς", "καλά", "καλὰ", "Κύπριδος", "Κύπριδι", "Κύπριδα", "Κύπριν", "ἀνιαρός")
# fixed values: verbal prefixes with their marks, whole and elided
PREFIXES = {
    "ἀνα": "ἀ^να^", "ἀντι": "ἀντι^", "ἀπο": "ἀ^πο", "ἀφ": "ἀ^φ", "δια": "δι^α^", "ἐπι": "ἐπι^", "κατα": "κα^τα^", "καθ": "κα^θ", "μετα": "μετα^",
    "παρα": "πα^ρα^", "περι": "περι^", "συν": "συ^ν", "ξυν": "ξυ^ν", "συμ": "συ^μ", "ὑπερ": "ὑ^περ", "ὑπο": "ὑ^πο", "ὑφ": "ὑ^φ",
}
ELIDED_PREFIXES = {"ἀν": "ἀ^ν", "ἀπ": "ἀ^π", "δι": "δι^", "κατ": "κα^τ", "παρ": "πα^ρ", "ὑπ": "ὑ^π"}

# fixed values: the pattern of characters that are taken for OCR noise
NOISE = r"[#$%&*+/=@~£¦§¨ª¬¯°±²³¶¸¹½¿ÁÄÆÈÉÌÍÒÓÖÚÜßàáâäæçèéëìíïòóôö÷ùúüýÿĀāćĎďĹŒœŕźƑǁȳɛʰʳ˘˙˝ˡˢˣ̠̣͎̀́̄̅̆̇̈̊̔͂͞ͅ΅ЗСҀҁҏӄӔӕֹלݲតហឲាិេᵃᵅᵇᵈᵉᵊᵍᵏᵐᵒᵖᵗᵘᵛᵝᶜᶠᶦᶹḍḿṃẂẃẉạụỳ‐‒–―‖✶❮❯⟦⟧⥼⥽⦵⨆⩚⩹⫯⸕⸢⸣⸤⸥⸨〈〉ﬀﬁ＊－｢�𐅵𝒢𝒮𝔮𝕷‹›※‾⁄⁎⁑⁰ⁱ⁴⁵⁶⁷⁸⁹ⁿ€™ℵ∗√∠∴∼∾⊏⊔⊙⊢⊣⊤⊻⋃⋆⋇⋖⌈⌉⌊⌋⌞⌟⏒⏔⏕─═║△○◻★☼☾☿♀♂♃♄]"

#: one translation of Latin letters to Greek ones, to run Greek rules on Latin corpora
LATIN = "abgdezhiklmnopcrstufxywéèêóíñçäöüß"
GREEK = "αβγδεζηικλμνοπξρστυφχψωέὲῆόίνσάώύσ"


def escaped(chars: str) -> str:
    """Characters for the inside of a bracket expression."""
    return "".join("\\" + ch if ch in "\\]^-[&~|" else ch for ch in chars)


BLOCKS = ((0x370, 0x3FF), (0x1F00, 0x1FFF))


def ranged(pattern: str) -> str:
    """The pattern with the Greek letters of its bracket expressions as ranges, block by block. Java asks the members of a class one after another,
    so a list of two hundred letters costs a letter two hundred questions."""

    def spelled(match: re.Match) -> str:
        sign, body = match[1], match[2]
        greek = [[k for k in sorted(set(map(ord, body))) if low <= k <= high] for low, high in BLOCKS]
        if "-" in re.sub("[A-Za-z0-9]-[A-Za-z0-9]", "", body) or sum(map(len, greek)) < 4:
            return match[0]
        out = ""
        for (low, high), codes in zip(BLOCKS, greek, strict=True):
            spans = "".join(f"{chr(run[0])}-{chr(run[-1])}" if len(run) > 1 else chr(run[0]) for run in _runs(codes))
            out += f"[{chr(low)}-{chr(high)}&&[{spans}]]" if codes else ""
        rest = "".join(ch for ch in body if not any(low <= ord(ch) <= high for low, high in BLOCKS))
        return f"[{sign}{out}{rest}]"

    return re.sub(r"\[(\^?)([^\[\]]+)\]", spelled, pattern)


def _runs(codes: list[int]) -> list[list[int]]:
    """Sorted numbers as runs of neighbours."""
    out: list[list[int]] = []
    for k in codes:
        if out and out[-1][-1] == k - 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


#: One code for each kind of letter, by rule: control characters, one byte each, which a text loses on the way.
_KINDS = {
    "A": _letters("α", lacking="".join(map(chr, range(0x300, 0x346)))),
    "E": "εΕ",
    "H": "ηΗ",
    "O": "οΟ",
    "W": "ωΩ",
    "U": "υΥ",
    "I": _letters("ι", lacking=DIAERESIS + CIRCUMFLEX + MACRON + BREVE),
    "J": "".join(ch for ch in _letters("ι", CIRCUMFLEX) if ch in _I),
    "Y": "".join(ch for ch in _letters("υ", lacking=DIAERESIS + CIRCUMFLEX + MACRON + BREVE) if ch not in "υΥ"),
    "Q": "".join(ch for ch in _letters("υ", CIRCUMFLEX) if ch in _Y),
    "C": CONSONANTS,
    "Z": DOUBLE,
}
_used = "".join(_KINDS.values())
_KINDS |= {"D": "".join(ch for ch in DICHRONA if ch not in _used), "V": "".join(ch for ch in SURE_VOWELS if ch not in _used)}
FIRST_CODE = 0x0E
CODE = {kind: chr(FIRST_CODE + k) for k, kind in enumerate(_KINDS)}
CODES = {ch: CODE[kind] for kind, chars in _KINDS.items() for ch in chars} | dict.fromkeys(CODE.values(), " ")


def coded(pattern: str) -> str:
    return "".join(CODE.get(ch, ch) for ch in pattern)


#: Steps, after the letters' translation to codes, that class every character: D open vowel of doubtful length, V other
#: vowels, C consonants. A doubtful vowel is in a closed syllable exactly if two consonants follow; a last single
#: consonant leaves it open.
CLASSES: list[tuple[str, str]] = [
    (f"[^\\x{{{FIRST_CODE:X}}}-\\x{{{FIRST_CODE + len(CODE) - 1:X}}}_^]+", " "),
    (coded("[AEHOWUIJYQDV]") + "[_^]+", coded("V")),
    ("[_^]", ""),
    (coded("[AEOU][IJ]|[AEHOW][UYQ]"), coded("V")),
    (coded("Z"), coded("CC")),
    (coded("[AUIYD]"), coded("D")),
    (coded("[EHOWJQ]"), coded("V")),
]

#: One scan of the codes that says what CLASSES and a count of D(?!CC) say: a match is what lies before an open vowel of doubtful length, and the
#: vowel. A text gets LAST behind it, one match more, so that no try ends without one and begins again within a diphthong. Passed over are what begins no diphthong, marked vowels, diphthongs without marks, and doubtful vowels before two consonants.
LAST = coded(" D")
OPEN = coded("(?:[^AEHOWUIYD]++|[AEHOWUIYD][_^]|(?:[AEOU][IJ]|[AEHOW][UYQ])(?![_^])|[EHOW]|[AUIYD](?=Z|C[_^]*[CZ]))*+[AUIYD]")
