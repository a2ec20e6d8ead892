"""The engine's cascade in plain Python, one token at a time and by recursion: what the Spark plans are compared with."""

from __future__ import annotations

import re

from morae.functions import phonology
from morae.functions import profile as p
from morae.operators import rewrite

CLASSES = [(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), a), b) for a, b in p.CLASSES]
SYLLABLE = re.compile(phonology.SYLLABLE)
bare = lambda s: "".join(p.BARE.get(ch, ch) for ch in s)
strip = lambda s: s.replace("_", "").replace("^", "")
cells = lambda s: re.findall("[^_^][_^]?", s)
upper = lambda ch: p.UPPER.get("σ" if ch == "ς" else ch, ch)


def count(text: str) -> int:
    text = "".join(p.CODES.get(ch, ch) for ch in text)
    for pattern, new in CLASSES:
        text = re.sub(pattern, new, text)
    return len(re.findall(p.coded("D(?!CC)"), text))


def merge(new: str | None, old: str, precedence: str = "new") -> str:
    if not new or strip(new) != strip(old):
        return old
    pairs = zip(cells(new), cells(old), strict=True)
    return "".join((n if len(n) > 1 else o) if precedence == "new" else (o if len(o) > 1 else n) for n, o in pairs)


def any_of(s: str, chars: str) -> bool:
    return bool(re.search(f"[{chars}]", s))


def split_mark(word: str) -> bool:
    return bool(re.search(f"(?:{p.DIPHTHONG}|{p.ADSCRIPT}|[{p.SUBSCRIPTS}])[_^]", word) or re.search(p.SPLIT_DIPHTHONG, word))


def unmarked(word: str) -> str:
    own = SYLLABLE.findall(word)
    return "".join(strip(s) if split_mark(s) else s for s in own) if "".join(own) == word else word


def accents(word: str) -> str:
    own = SYLLABLE.findall(word)
    if not word or "'" in word or "".join(own) != word or len(own) < 2:
        return word
    plain = [strip(s) for s in own]
    last, before, third = plain[-1], plain[-2], plain[-3] if len(plain) > 2 else ""
    kind = ""
    if any_of(last, p.ACUTES + p.GRAVES):
        kind = "oxytone"
    elif any_of(last, p.CIRCUMFLEXES):
        kind = "perispomenon"
    elif any_of(before, p.ACUTES):
        kind = "paroxytone"
    elif any_of(before, p.CIRCUMFLEXES):
        kind = "properispomenon"
    elif third and any_of(third, p.ACUTES):
        kind = "proparoxytone"
    doubtful = lambda s: not re.search(p.DIPHTHONG, s) and any_of(s, p.DICHRONA)
    mark = lambda s, m: re.sub(f"([{p.DICHRONA}])([^{p.VOWELS}_^]*)$", rf"\1{m}\2", s) if doubtful(s) else s
    z, y, start = own[-1], own[-2], "".join(own[:-2])
    short = not re.search(p.DIPHTHONG, z) and re.search(f"[{p.SHORT_VOWELS}]|[{p.DICHRONA}]\\^", z)
    long = any_of(y, p.ACUTES) and (re.search(p.DIPHTHONG, y) or re.search(f"[{p.LONG_VOWELS}{p.SUBSCRIPTS}]|[{p.DICHRONA}]_", y))
    out = None
    if kind == "paroxytone" and short:
        out = start + mark(y, "^") + z
    elif kind == "paroxytone" and long and doubtful(z):
        out = start + y + mark(z, "_")
    elif kind in ("properispomenon", "proparoxytone") and doubtful(z):
        out = start + y + mark(z, "^")
    return word if out is None or split_mark(out) else out


class Cascade:
    """lexica: custom [(form, marked, ord)], singletons and verse and lsj {form: marked}, ambiguous [(form, alt, marked, case)], ionic {stem}."""

    def __init__(self, custom=(), singletons=None, ambiguous=(), lsj=None, ionic=(), verse=None, literal: bool = False):
        self.custom, self.singletons, self.ambiguous, self.lsj, self.ionic, self.verse, self.literal = list(custom), singletons or {}, {}, lsj or {}, set(ionic), verse or {}, literal
        for f, alt, m, k in ambiguous:
            self.ambiguous[f, k] = min(self.ambiguous.get((f, k), (alt, m)), (alt, m))
        self.heads = {bare(w.lower()) for w in self.lsj}
        self.known: dict[tuple, tuple[str, list[str]]] = {}
        self.exact: dict[str, tuple] = {}
        self.near: dict[str, tuple] = {}
        for f, m, o in self.custom:
            self.exact[f] = max(self.exact.get(f, (o, m)), (o, m))
            for form, marked in ((f.lower(), m.lower()), (upper(f[0]) + f[1:], upper(m[0]) + m[1:])):
                self.near[form] = min(self.near.get(form, (o, marked)), (o, marked))

    def by_custom(self, token):
        found = self.exact.get(token) or self.near.get(token)
        return found and found[1]

    def by_singletons(self, token):
        if token in self.singletons:
            return self.singletons[token]
        low = token[:1].lower() + token[1:]
        if low != token and low in self.singletons:
            return upper(self.singletons[low][0]) + self.singletons[low][1:]
        return None

    def by_ambiguous(self, token, morph):
        found = self.ambiguous.get((token, morph.get("Case", [None])[0]))
        return found[1] if found and strip(found[1]) == token else None

    def by_nominal(self, token, lemma, pos, morph):
        if not (token and lemma and pos and morph) or "Dual" in morph.get("Number", []):
            return None
        has = lambda k, *v: bool(set(morph.get(k, [])) & set(v))
        alpha, iota = ("".join(ch for ch, b in p.BARE.items() if b == base) + base for base in "αι")
        end = lambda pattern, new: re.sub(pattern, new, token) if re.search(pattern, token) else None
        sing, fem, stem = has("Number", "Sing"), has("Gender", "Fem"), bare(lemma)[-1:] in ("α", "η")
        options = [
            end(f"([{alpha}])$", r"\1_") if token == lemma and has("Case", "Nom", "Voc") and sing and fem and token[:-1] in self.ionic else None,
            end(f"([{alpha}])ν$", r"\1_ν") if has("Case", "Acc") and sing and fem and stem and lemma[:-1] in self.ionic else None,
            end(f"([{alpha}])ς$", r"\1_ς") if has("Case", "Gen") and sing and fem else None,
            end(f"([{alpha}])ς$", r"\1_ς") if has("Case", "Acc") and has("Number", "Plur") and fem and (pos in ("NOUN", "PROPN") and stem or pos in ("ADJ", "NUM", "PRON")) else None,
            end(f"([{alpha}])$", r"\1^") if has("Gender", "Masc", "Neut") else None,
            end(f"([{iota}])(ν?)$", r"\1^\2") if has("Case", "Dat") else None,
            end(f"([{iota}])(κ.[ςν])$", r"\1^\2") if bare(lemma).endswith("ικος") and re.search("ικο[ςν]$", bare(token)) else None,
        ]
        return next((x for x in options if x is not None), None)

    def by_verbal(self, token, lemma, pos, morph):
        iota = "".join(ch for ch, b in p.BARE.items() if b == "ι") + "ι"
        return token + "^" if lemma and pos and morph and re.search(f"μ[{iota}]$", token) else None

    def by_prefix(self, token, lemma):
        best = None
        for prefix, marked in [*p.PREFIXES.items(), *p.ELIDED_PREFIXES.items()]:
            rest = bare((lemma or "")[len(prefix) :])
            if token.startswith(prefix) and (lemma or "").startswith(prefix) and rest and rest in self.heads and (best is None or len(prefix) > len(best[0])):
                best = prefix, marked
        return best and best[1] + token[len(best[0]) :]

    def ending(self, token, lemma, pos, morph):
        has = lambda k, v: v in morph.get(k, [])
        for decl, ending, loose, case, cut, add, restore in rewrite.ENDINGS:
            fits = re.search(ending, bare(token) if loose else token) and has("Case", case) and len(token) > 2
            fits = fits and (bare(lemma or "").endswith("ος") if decl == 2 else bare(lemma or "")[-1:] in ("α", "η") and has("Gender", "Fem"))
            if fits and (add != "=" or pos == "NOUN"):
                return token[: max(len(token) - cut, 0)] + (lemma[-1:] if add == "=" else add), restore
        return None

    def resolve(self, token: str, lemma: str | None, pos: str | None, morph: dict) -> tuple[str, list[str]]:
        key = token, lemma, pos, repr(sorted(morph.items()))
        if key not in self.known:
            self.known[key] = self._resolve(token, lemma, pos, morph)
        return self.known[key]

    def _resolve(self, token, lemma, pos, morph):
        word, hits = token, []

        def put(name, candidate, precedence="new"):
            nonlocal word
            if count(word) > 0 and candidate:
                new = merge(candidate, word, precedence)
                if count(new) < count(word):
                    hits.append(name)
                word = new

        if token == "ἄλλα":
            put("minimal_pair", "ἄλλα_" if "Fem" in morph.get("Gender", []) else "ἄλλα^")
        put("custom", self.by_custom(token))
        put("singletons", self.by_singletons(token))
        put("ambiguous", self.by_ambiguous(token, morph))
        put("lsj", self.lsj.get(token))
        put("nominal", self.by_nominal(token, lemma, pos, morph))
        put("verbal", self.by_verbal(token, lemma, pos, morph))
        put("accents", accents(word))
        put("prefix", self.by_prefix(token, lemma))

        def helps(kind, candidate):
            """Whether a restored word leaves less open; it is taken then."""
            nonlocal word
            if count(word) == 0:
                return True
            new = merge(candidate, word)
            if count(new) < count(word):
                hits.append(kind)
                word = new
                return True
            if self.literal:
                word = new
            return False

        def asked(variant):
            return cells(self.resolve(variant, lemma, pos, morph)[0])

        letters = list(token)
        spelled = lambda answer: "".join(ch + cell[1:] for ch, cell in zip(letters, answer, strict=True))
        # two accents: the last letter's, or the last but one's, goes; a long vowel there is refused
        if sum(ch in p.ACCENTS for ch in token) > 1:
            for kind, at in (("double_accent_before", -2), ("double_accent_last", -1)):
                if len(token) > 1 and token[at] in p.ACCENTS and count(word) > 0:
                    answer = asked(token[:at] + bare(token[at:]))
                    refused = answer[at].endswith("_")
                    if helps(kind, token if refused else spelled(answer)) or self.literal:
                        break
        # elision: the first vowel that helps
        if token.endswith("'"):
            for vowel in "ει":
                if count(word) > 0 and helps(f"elision_{vowel}", "".join(asked(token[:-1] + vowel)[:-1]) + "'"):
                    break
        if count(word) > 0 and (found := self.ending(token, lemma, pos, morph)) and found[0] != token:
            keep = len(token) - found[1]
            helps("ending", "".join(asked(found[0])[:keep]) + token[keep:])
        acute = token[:-2] + "".join(p.GRAVE_TO_ACUTE.get(ch, ch) for ch in token[-2:])
        if count(word) > 0 and acute != token:
            helps("oxytone", spelled(asked(acute)))
        low = token[:1].lower() + token[1:]
        if count(word) > 0 and low != token:
            helps("capital", spelled(asked(low)))
        verse = self.verse.get(token)
        put("verse", unmarked(verse) if verse else None, "old")
        put("accents_again", accents(word))
        if strip(word) != token:
            word = token
        return (unmarked(word) if split_mark(word) else word), hits
