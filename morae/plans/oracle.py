"""DuckDB SQL for the engine's queries, from the same tables of characters and patterns."""

from __future__ import annotations

import re

from ..functions import profile as p
from . import fixtures as x


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, new: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(new.replace('$', chr(92)))}, 'g')"


def steps(expr: str, all_: list[tuple[str, str]]) -> str:
    for pattern, new in all_:
        expr = sub(expr, pattern, new)
    return expr


def mapped(expr: str, pairs: dict[str, str]) -> str:
    return f"translate({expr}, {q(''.join(pairs))}, {q(''.join(pairs.values()))})"


def deleted(expr: str, chars: str) -> str:
    return f"translate({expr}, {q(chars)}, '')"


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def classes(expr: str) -> str:
    return steps(mapped(expr, p.CODES), p.CLASSES)


def open_dichrona(expr: str) -> str:
    own = classes(expr)
    return f"({count(own, p.coded('D'))} - {count(own, p.coded('DCC'))})::BIGINT"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    cells = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {cells})"


def alternatives(words: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


STRIP = "translate({}, '_^', '')"
SENTENCE, TERMINATED = r"[^.\n;\x{037e}]+[.\n;\x{037e}]?", r"(?s).+?[.\n;\x{037e}]"
GREEK = f"translate(lower(text), {q(p.LATIN)}, {q(p.GREEK)})"
G = f"g AS (SELECT doc_id, lang, source, {GREEK} AS text FROM documents)"
SPACES = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def word_list(expr: str) -> str:
    return f"list_filter(string_split_regex({sub(expr, f'[{p.escaped(p.WORD_BREAKS)}]', ' ')}, {q(SPACES)}), lambda w: w <> '')"


W = f"""{G}, ww AS (SELECT doc_id, lang, {word_list('text')} AS l FROM g), w AS (SELECT doc_id, lang, unnest(range(len(l))) AS pos, unnest(l) AS word FROM ww)"""
L = f"{G}, ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM g), lines AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS line FROM ls)"
UP = lambda e: mapped(f"translate({e}, 'ς', 'σ')", p.UPPER)
CAP = lambda e: f"{UP(f'substr({e}, 1, 1)')} || substr({e}, 2)"
DECAP = lambda e: f"lower(substr({e}, 1, 1)) || substr({e}, 2)"
LEX = values("lex", "form, marked, ord", x.LEXICON)
VOWEL = f"[{p.VOWELS}]"


def on_text(expr: str) -> str:
    return f"WITH {G} SELECT doc_id, {expr} AS out FROM g"


def on_lines(expr: str) -> str:
    return f"WITH {L} SELECT doc_id, line_no, {expr} AS out FROM lines"


def on_words(rows: list[tuple], expr: str, steps: str = "", source: str = "v") -> str:
    """Over fixtures and all distinct words; steps: further tables, from v(word)."""
    return f"WITH {W}, {values('r', 'word', rows)}, v AS (SELECT word FROM r UNION SELECT word FROM w){steps} SELECT word, {expr} AS out FROM {source}"


def sized(list_: str, source: str, key: str) -> str:
    return f"SELECT {key}, sum(len({list_}))::BIGINT AS n, sum(length(array_to_string({list_}, '')))::BIGINT AS n_chars FROM {source} GROUP BY {key}"


CELL = "regexp_extract_all({}, '[^_^][_^]?')"


SPELLED = f"""{W}, k AS (SELECT DISTINCT word FROM w), v AS (SELECT word,
CASE WHEN length(word) % 7 = 0 THEN '' WHEN length(word) % 5 = 0 THEN word || 'ν^' WHEN length(word) % 2 = 0 THEN {sub('word', '([αυ])', '$1^')} ELSE {sub('word', '([αι])', '$1_')} END AS new,
CASE WHEN length(word) % 11 = 0 THEN '' WHEN length(word) % 3 = 0 THEN {sub('word', '([ιυ])', '$1_')} WHEN length(word) % 3 = 1 THEN {sub('word', '([αιυ])', '$1^')} ELSE word END AS old FROM k)"""


def merge(how: str) -> str:
    first, second = ("n", "o") if how == "new" else ("o", "n")
    zipped = f"list_zip({CELL.format('new')}, {CELL.format('old')})"
    at = {"n": "z[1]", "o": "z[2]"}
    union = f"array_to_string(list_transform({zipped}, lambda z: CASE WHEN length({at[first]}) > 1 THEN {at[first]} ELSE {at[second]} END), '')"
    return f"""WITH {SPELLED} SELECT word, CASE WHEN new = '' THEN old WHEN old = '' THEN new WHEN {STRIP.format('new')} <> {STRIP.format('old')} THEN old ELSE {union} END AS out FROM v"""


KNOT = "[βγδζθκλμνξπρσςτφχψ]*"
GOLD = f"""{G}, gl AS (SELECT doc_id, lang AS file, string_split(text, chr(10)) AS l FROM g), g0 AS (SELECT doc_id, file, unnest(range(len(l)))::BIGINT AS line_no, translate(unnest(l), '[]{{}}', '') AS line FROM gl),
g1 AS (SELECT doc_id, file, line_no, {sub(sub('line', f'({KNOT})([αιυ])', '{$1$2^}'), f'({KNOT})([εηοω])', '[$1$2_]')} AS line FROM g0), gold AS (SELECT doc_id, file, line_no, {sub('line', 'α\\^[}]([ .,])', 'α_}#$1')} || '€' AS line FROM g1)"""
FILLED = r"regexp_replace(regexp_replace(line, '([\]}])([^\[\]{}]+)([\[{])', '\2\1\3', 'g'), '([\]}])([^\[\]{}]+)$', '\2\1', 'g')"
SYLL = r"regexp_extract_all(line, '[\{\[]([^\}\]]+)[\}\]]', 1)"
CORE = "regexp_replace(s, " + q(rf"[_^#€\s'.,;:!?{p.ANO_TELEIA}{p.QUESTION}]") + ", '', 'g')"
OPEN = f"regexp_matches({CORE}, {q(VOWEL + '$')})"


def on_gold(expr: str) -> str:
    return f"WITH {GOLD} SELECT doc_id, line_no, {expr} AS out FROM gold"


def each(body: str) -> str:
    return f"array_to_string(list_transform({SYLL}, lambda s: {body}), '|')"


def coverage(cte: str, before: str, after: str, source: str, by: str, group: str) -> str:
    return f"""WITH {cte}, n AS (SELECT {by}{', ' if by else ''}{open_dichrona(before)} AS b, {open_dichrona(after)} AS a FROM {source})
SELECT {by}{', ' if by else ''}sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, (sum(b) - sum(a))::BIGINT AS difference,
round(CASE WHEN sum(b) = 0 THEN 0 ELSE (sum(b) - sum(a))::DOUBLE / sum(b)::DOUBLE END, 9) AS ratio FROM n {group}"""


def bad_accents(w: str) -> str:
    n = lambda chars: count(w, f"[{chars}]")
    return f"({n(p.GRAVES)} > 1 OR ({n(p.GRAVES)} > 0 AND {n(p.ACUTES)} > 0) OR {n(p.ACCENTS)} > 2 OR {n(p.ROUGHS)} > 2)"


NUMERAL = "(regexp_matches({0}, " + q("^[α-ωΑ-Ωϛϟϡ]{1,4}[ʹ΄´ʹ']$").replace("{", "{{").replace("}", "}}") + ") OR regexp_matches({0}, " + q("^͵[α-ωϛϟϡ]+$") + "))"
COUNTED = f"SELECT word, count(*) AS n FROM w GROUP BY word"
ANY = f"[{p.CONSONANTS}{p.DOUBLE}]"
OPEN_WORD = f"""(regexp_matches(bare, {q(VOWEL + '$')}) AND NOT coalesce(regexp_matches(following, {q(f'^(?:{ANY}{ANY}|[{p.DOUBLE}])')}), false))
OR (regexp_matches(bare, {q(f'{VOWEL}[{p.CONSONANTS}]$')}) AND (following IS NULL OR regexp_matches(following, {q('^' + VOWEL)})))"""
SEAM, SHUT, OPEN_SIGN = "\ue100", "\ue101", "\ue102"  # between two consonants; behind a vowel that isn't counted, and one that is


def syllables(expr: str) -> str:
    """A syllable takes what stands before its vowel, and a consonant behind it if another one follows."""
    parted = sub(sub(expr, f"({ANY})({ANY})", f"$1{SEAM}$2"), f"({ANY})({ANY})", f"$1{SEAM}$2")
    found = f"regexp_extract_all({parted}, {q(f'[^{p.VOWELS}]*{p.NUCLEUS}[_^]*(?:[^{p.VOWELS}]+$|{ANY}{SEAM})?')})"
    return f"list_transform({found}, lambda s: replace(s, {q(SEAM)}, ''))"


def like(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def accent_class(own: str) -> str:
    at = lambda k, chars: f"coalesce(regexp_matches({own}[-{k}], {q(f'[{chars}]')}), false)"
    return f"""CASE WHEN {at(1, p.ACUTES + p.GRAVES)} THEN 'oxytone' WHEN {at(1, p.CIRCUMFLEXES)} THEN 'perispomenon' WHEN {at(2, p.ACUTES)} THEN 'paroxytone'
WHEN {at(2, p.CIRCUMFLEXES)} THEN 'properispomenon' WHEN {at(3, p.ACUTES)} THEN 'proparoxytone' END"""


def short_vowel(s: str) -> str:
    return f"(NOT {like(s, p.DIPHTHONG)} AND {like(s, f'[{p.SHORT_VOWELS}]|[{p.DICHRONA}][\\^]')})"


def long_acute(s: str) -> str:
    return f"({like(s, f'[{p.ACUTES}]')} AND ({like(s, p.DIPHTHONG)} OR {like(s, f'[{p.LONG_VOWELS}{p.SUBSCRIPTS}]|[{p.DICHRONA}]_')}))"


def doubtful(s: str) -> str:
    return f"(NOT {like(s, p.DIPHTHONG)} AND {like(s, f'[{p.DICHRONA}]')})"


def last_marked(s: str, mark: str) -> str:
    return f"(CASE WHEN {doubtful(s)} THEN {sub(s, f'([{p.DICHRONA}])([^{p.VOWELS}_^]*)$', f'$1{mark}$2')} ELSE {s} END)"


def marked_diphthong(w: str) -> str:
    return f"({like(w, f'(?:{p.DIPHTHONG}|{p.ADSCRIPT}|[{p.SUBSCRIPTS}])[_^]')} OR {like(w, p.SPLIT_DIPHTHONG)})"


def accent_steps(source: str) -> str:
    start = "array_to_string(l[1:greatest(len(l) - 2, 0)], '')"
    bare = "list_transform(l, lambda s: translate(s, '_^', ''))"
    return f""", s1 AS (SELECT word, {syllables('word')} AS l FROM {source}), s2 AS (SELECT word, l, {bare} AS b FROM s1), s3 AS (SELECT word, l, l[-1] AS z, l[-2] AS y, {accent_class('b')} AS kind FROM s2),
s4 AS (SELECT word, CASE WHEN len(l) >= 2 AND array_to_string(l, '') = word THEN CASE WHEN kind = 'paroxytone' AND {short_vowel('z')} THEN {start} || {last_marked('y', p.SHORT)} || z
WHEN kind = 'paroxytone' AND {long_acute('y')} AND {doubtful('z')} THEN {start} || y || {last_marked('z', p.LONG)}
WHEN kind IN ('properispomenon', 'proparoxytone') AND {doubtful('z')} THEN {start} || y || {last_marked('z', p.SHORT)} END END AS x FROM s3),
ruled AS (SELECT word, CASE WHEN word = '' OR contains(word, chr(39)) THEN word WHEN x IS NULL OR {marked_diphthong('x')} THEN word ELSE x END AS ruled FROM s4)"""


def has(key: str, *all_: str) -> str:
    return like("morph", f"(^|[|]){key}=([^|]*,)?({'|'.join(all_)})(,[^|]*)?([|]|$)")


def ended(pattern: str, new: str, when: str = "true") -> str:
    return f"CASE WHEN {when} AND {like('token', pattern)} THEN {sub('token', pattern, new)} END"


def pick(all_: list[str], of: str) -> str:
    return f"([{', '.join(map(q, all_))}])[({of}) % {len(all_)} + 1]"


COUNT_A = "length(token) + length(replace(token, 'α', ''))"
TAGGED = f"""{W}, k AS (SELECT DISTINCT word AS token FROM w), {values('r', 'token, lemma, pos, morph', x.TAGGED)},
t AS (SELECT token, CASE WHEN length(token) % 2 = 0 THEN token ELSE token || 'ος' END AS lemma, {pick(x.TAG_POS, 'length(token)')} AS pos, {pick(x.TAG_MORPH, COUNT_A)} AS morph FROM k UNION ALL SELECT * FROM r)"""
A, I = (f"[{''.join(ch for ch, b in p.BARE.items() if b == base) + base}]" for base in "αι")
FEM, SING = has("Gender", "Fem"), has("Number", "Sing")
STEM = like(mapped("lemma", p.BARE), "[αη]$")
GIVEN = "(lemma <> '' AND pos <> '' AND morph <> '')"
NOMINAL = ", ".join(
    [
        ended(f"({A})$", "$1_", f"token = lemma AND {has('Case', 'Nom', 'Voc')} AND {SING} AND {FEM}"),
        ended(f"({A})ν$", "$1_ν", f"{has('Case', 'Acc')} AND {SING} AND {FEM} AND {STEM}"),
        ended(f"({A})ς$", "$1_ς", f"{has('Case', 'Gen')} AND {SING} AND {FEM}"),
        ended(f"({A})ς$", "$1_ς", f"{has('Case', 'Acc')} AND {has('Number', 'Plur')} AND {FEM} AND ((pos IN ('NOUN', 'PROPN') AND {STEM}) OR pos IN ('ADJ', 'NUM', 'PRON'))"),
        ended(f"({A})$", "$1^", has("Gender", "Masc", "Neut")),
        ended(f"({I})(ν?)$", "$1^$2", has("Case", "Dat")),
        ended(f"({I})(κ.[ςν])$", "$1^$2", f"{like(mapped('lemma', p.BARE), 'ικος$')} AND {like(mapped('token', p.BARE), 'ικο[ςν]$')}"),
    ]
)
NOMINAL = f"CASE WHEN token <> '' AND {GIVEN} AND NOT {has('Number', 'Dual')} THEN coalesce({NOMINAL}) END"
PRESENT = f"{GIVEN} AND {like(mapped('lemma', p.BARE), 'νυμι$')} AND {has('Tense', 'Pres')} AND {has('Mood', 'Ind')} AND {has('Voice', 'Act')}"
VERBAL = ", ".join([ended("νυ(μι|ς|σι|σιν)$", "νυ_$1", f"{PRESENT} AND {SING}"), ended("νυ(μεν|τε)$", "νυ^$1", f"{PRESENT} AND {has('Number', 'Plur')}"), f"CASE WHEN {GIVEN} AND {like('token', f'μ{I}$')} THEN token || '^' END"])


def on_tagged(expr: str) -> str:
    return f"WITH {TAGGED} SELECT token, morph, {expr} AS out FROM t"


def endings() -> str:
    from ..operators.rewrite import ENDINGS

    cases = []
    for decl, ending, bare, case, n, add, restore in ENDINGS:
        when = [like(mapped("token", p.BARE) if bare else "token", ending), has("Case", case), "length(token) > 2"]
        when += [like(mapped("lemma", p.BARE), "ος$")] if decl == 2 else [STEM, FEM]
        when += ["pos = 'NOUN'"] if add == "=" else []
        new = f"substr(token, 1, greatest(length(token) - {n}, 0)) || " + ("right(lemma, 1)" if add == "=" else q(add))
        cases.append((" AND ".join(when), new, restore))
    variant, restored = (" ".join(f"WHEN {x[0]} THEN {x[k]}" for x in cases) for k in (1, 2))
    return f"WITH {TAGGED} SELECT token, morph, CASE {variant} END AS variant, (CASE {restored} END)::BIGINT AS restored FROM t"


def coloured(expr: str) -> str:
    """Letters of diphthongs and closed vowels get a sign, then others without a mark get another, in two passes for neighbours."""
    i, y = p.DIPHTHONG.split("|")[0].split("][")[1].rstrip("])"), p.DIPHTHONG.split("|")[1].split("][")[1].rstrip("])")
    expr = sub(expr, f"([αεουΑΕΟΥ])([{i}])|([αεηοωΑΕΗΟΩ])([{y}])", f"$1$3{SHUT}$2$4{SHUT}")
    expr = sub(expr, f"([{p.DICHRONA}])({ANY}{ANY}|[{p.DOUBLE}])", f"$1{SHUT}$2")
    for _ in range(2):
        expr = sub(expr, f"([{p.DICHRONA}])([^_^{SHUT}{OPEN_SIGN}]|$)", f"$1{OPEN_SIGN}$2")
    expr = sub(expr, f"([{p.DICHRONA}]){OPEN_SIGN}", "<d>$1</d>")
    return f"replace({expr}, {q(SHUT)}, '')"


PLACED = r"""array_to_string(list_transform(regexp_extract_all(translate(word, '_^', ''), '\p{L}\p{M}*|[^\p{L}]'), lambda l, i: l || coalesce(list_filter(string_split(spec, ','), lambda m: regexp_matches(m, '^[_^][0-9]+$') AND TRY_CAST(substr(m, 2) AS INT) = i)[1][1], '')), '')"""
CHUNK = r"""substr(text, 1, k) || regexp_extract(substr(text, k + 1), '^\p{L}*')"""

def cleaned(word: str) -> str:
    """Without marks in diphthongs."""
    own = syllables(word)
    clean = f"array_to_string(list_transform({own}, lambda s: CASE WHEN {marked_diphthong('s')} THEN translate(s, '_^', '') ELSE s END), '')"
    return f"(CASE WHEN {marked_diphthong(word)} AND array_to_string({own}, '') = {word} THEN {clean} ELSE {word} END)"


def rivals() -> str:
    """One step for each kind of rewriting: its word is taken if it leaves less open than what there is."""
    cut, last = "substr(word, 1, length(word) - 1)", "right(word, 1)"
    graved, acute = f"{cut} || translate({last}, 'αειουηω', 'ὰὲὶὸὺὴὼ')", f"{cut} || translate({last}, 'αειουηω', 'άέίόύήώ')"
    n = "length(word) % 4"
    first, all_ = sub("form", "^([^αιυάίύ]*)([αιυάίύ])", "$1$2@"), sub("form", "([αιυάίύ])", "$1@")
    left = open_dichrona
    known = f"(CASE WHEN {left('token')} > 0 THEN coalesce(marked, token) ELSE token END)"  # what leaves nothing open isn't looked up
    sql = f"""WITH {W}, k AS MATERIALIZED (SELECT DISTINCT word FROM w WHERE {like('word', '^[α-ω]{4,}$')}),
t AS (SELECT DISTINCT CASE {n} WHEN 0 THEN {cut} || chr(39) WHEN 1 THEN {CAP(f'({cut})')} || chr(39) WHEN 2 THEN {CAP(f'({graved})')} ELSE {CAP('word')} || 'ου' END AS token, {n} = 3 AS genitive FROM k),
f AS (SELECT DISTINCT unnest(CASE {n} WHEN 0 THEN [{cut} || 'ε', {cut} || 'ι'] WHEN 1 THEN [{CAP(f'({cut})')} || 'ε', {CAP(f'({cut})')} || 'ι', {cut} || chr(39)] WHEN 2 THEN [{CAP(f'({acute})')}, {graved}] ELSE [{CAP('word')} || 'ος', word || 'ου'] END) AS form FROM k),
lex AS MATERIALIZED (SELECT form, replace(CASE WHEN length(form) % 3 = 0 THEN {first} ELSE {all_} END, '@', CASE WHEN length(form) % 2 = 0 THEN '^' ELSE '_' END) AS marked FROM f
WHERE (length(form) + length(replace(form, 'α', '')) + length(replace(form, 'ε', ''))) % 3 <> 0),
s0 AS MATERIALIZED (SELECT token, genitive, {known} AS marked, {left(known)} AS o, CASE WHEN {left(known)} < {left('token')} THEN ['lsj'] ELSE []::VARCHAR[] END AS hits FROM t LEFT JOIN lex ON token = form)"""
    shorter = "regexp_replace(a, '[^_^][_^]?$', '')"
    carried = f"array_to_string(list_transform(list_zip({CELL.format('a')}, string_split(token, '')), lambda z: z[2] || substr(z[1], 2)), '')"
    elided, stem = "right(token, 1) = chr(39)", "left(token, length(token) - 1)"
    kinds = [
        ("elision_ε", elided, f"{stem} || 'ε'", f"{shorter} || chr(39)"),
        ("elision_ι", f"{elided} AND NOT list_contains(hits, 'elision_ε')", f"{stem} || 'ι'", f"{shorter} || chr(39)"),
        ("ending", "genitive", f"{stem} || 'ς'", f"{shorter} || 'υ'"),
        ("oxytone", like("right(token, 2)", f"[{p.GRAVES}]"), f"left(token, length(token) - 2) || {mapped('right(token, 2)', p.GRAVE_TO_ACUTE)}", carried),
        ("capital", f"{DECAP('token')} <> token", DECAP("token"), carried),
    ]
    union = f"array_to_string(list_transform(list_zip({CELL.format('r')}, {CELL.format('marked')}), lambda z: CASE WHEN length(z[1]) > 1 THEN z[1] ELSE z[2] END), '')"
    for k, (kind, when, variant, restored) in enumerate(kinds):
        sql += f""", v{k} AS (SELECT *, CASE WHEN o > 0 AND {when} THEN {variant} END AS v FROM s{k}),
a{k} AS (SELECT v{k}.* EXCLUDE (v), CASE WHEN {left('v')} > 0 THEN {cleaned('coalesce(lex.marked, v)')} ELSE v END AS a FROM v{k} LEFT JOIN lex ON v = form),
r{k} AS (SELECT * EXCLUDE (a), CASE WHEN a IS NOT NULL THEN {restored} END AS r FROM a{k}),
m{k} AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL OR {STRIP.format('r')} <> {STRIP.format('marked')} THEN marked ELSE {union} END AS x FROM r{k}),
s{k + 1} AS MATERIALIZED (SELECT token, genitive, CASE WHEN {left('x')} < o THEN x ELSE marked END AS marked, least(o, {left('x')}) AS o, CASE WHEN {left('x')} < o THEN list_append(hits, {q(kind)}) ELSE hits END AS hits FROM m{k})"""
    return sql + f", z AS (SELECT token, {cleaned('marked')} AS marked, hits FROM s{len(kinds)}) SELECT token, marked, array_to_string(hits, ',') AS hits, {left('token')} AS open_before, {left('marked')} AS open_after FROM z"


TRIMMED = lambda e: sub(e, f"^{SPACES}|{SPACES}$", "")
TEI = f"""WITH a AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[\\x00-\\x09\\x0b-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g'), chr(10)), lambda s, i: {{'s': s, 'k': (i - 1) % 6}}) AS l FROM documents),
b AS (SELECT doc_id, flatten(list_transform(list_filter(l, lambda e: e.k NOT IN (3, 5)), lambda e: CASE WHEN e.k = 1 THEN [{TRIMMED("(e.s || 'x')")}, 'x'] ELSE [{TRIMMED('e.s')}] END)) AS p, list_transform(list_filter(l, lambda e: e.k = 5), lambda e: {TRIMMED('e.s')}) AS v FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(list_concat(p, v), lambda s: s <> ''), ' ') AS text FROM b) SELECT doc_id, length(text) AS n, md5(text) AS digest, NULL::VARCHAR AS problem FROM c"""


def marked_words(select: str) -> str:
    marked = f"CASE length(word) % 3 WHEN 0 THEN {sub('word', '([αίύ])', '$1_')} WHEN 1 THEN {sub('word', '([ιυά])', '$1^')} ELSE {sub('word', '([αιυάίύ])', '$1^')} END"
    return f"WITH {W}, v AS (SELECT word, {marked} AS marked FROM (SELECT DISTINCT word FROM w WHERE {like('word', '^[α-ωά-ώ]+$')})) SELECT word, {select} AS out FROM v"


def combining(expr: str) -> str:
    for letter, bare, accent in (("α", "α", ""), ("ι", "ι", ""), ("υ", "υ", ""), ("ά", "α", "\u0301"), ("ί", "ι", "\u0301"), ("ύ", "υ", "\u0301")):
        for sign, mark in (("_", p.MACRON), ("^", p.BREVE)):
            expr = f"replace({expr}, {q(letter + sign)}, {q(bare + mark + accent)})"
    return f"nfc_normalize({expr})"


# names as a pattern between word borders, which words get here as a sign before and behind them
EDGE = "\ue110"


def bordered(name: str) -> str:
    return re.sub(r"([^\W]+)", rf"{EDGE}\1{EDGE}", name)


NAMED = f"{G}, named AS (SELECT doc_id, lang, text, {sub('text', '([' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+)', EDGE + '$1' + EDGE)} AS bounded FROM g)"
CUT = f"regexp_replace(bounded, {q('|'.join(map(bordered, x.NAMES)))}, '', 'g')"
GAPPED = f"(CASE WHEN bounded <> {CUT} THEN trim({sub(f'replace({CUT}, {q(EDGE)}, {q("")})', SPACES, ' ')}, ' ') ELSE text END)"


MARKED_ALPHA = "replace(unmarked, 'α', 'α_')"
BATCHED = f"{L}, b0 AS (SELECT doc_id // 300 AS batch, regexp_replace(line, '[\\t\\r\"]', ' ', 'g') AS unmarked FROM lines WHERE trim(line, ' ') <> ''), b AS (SELECT *, replace(unmarked, 'α', 'α_') AS marked, {open_dichrona('unmarked')} AS o, {open_dichrona(MARKED_ALPHA)} AS a FROM b0)"
SINKS = {
    "pairs_round_trip": f"WITH {BATCHED} SELECT unmarked, marked, count(*) AS n FROM b WHERE a = 0 GROUP BY ALL",
    "batches_round_trip": f"WITH {BATCHED} SELECT batch, count(*) AS n, sum(length(marked))::BIGINT AS n_chars FROM b GROUP BY batch",
    "stats_round_trip": f"WITH {BATCHED} SELECT batch, sum(o - a)::BIGINT AS numerator, sum(o)::BIGINT AS denominator FROM b GROUP BY batch",
    "residue_round_trip": f"WITH {W}, n AS ({COUNTED}) SELECT n AS count, word AS token, 'first' AS run_id FROM n WHERE {open_dichrona('word')} > 0 AND NOT contains(word, chr(92))",
    "hits_round_trip": f"WITH {W} SELECT 'm' || least(length(word), 9) AS module, count(*) AS n, count(DISTINCT word) AS n_words FROM w GROUP BY 1",
    "lines_round_trip": f"WITH {L}, n AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS line_no, replace(line, chr(13), ' ') AS line FROM lines JOIN (SELECT doc_id, lang FROM g) USING (doc_id)) SELECT lang, line_no, md5(line) AS digest FROM n WHERE line_no >= 100",
    "texts_round_trip": f"WITH {G} SELECT source, sum(length(text) + 1)::BIGINT AS n_chars FROM g GROUP BY source",
    "lexicon_round_trip": f"WITH {W}, k AS (SELECT DISTINCT word FROM w), t AS (SELECT unnest({word_list(f'translate(lower(text), {q(p.LATIN)}, {q(p.GREEK)})')}) AS word FROM conversations), n AS (SELECT word, count(*) AS n FROM t GROUP BY word) SELECT n.word, n.n, CASE WHEN k.word IS NOT NULL THEN {sub('n.word', '([αιυ])', '$1^')} END AS marked FROM n LEFT JOIN k ON n.word = k.word",
}


CLASS_SENT = f"([{p.DICHRONA}])([{p.CONSONANTS}]?[.])$"
FIRST_DIFF = "coalesce(list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0)"
DEFECT = f"""CASE WHEN regexp_matches(form, '[_^]') THEN 'mark_in_key' WHEN regexp_matches(form, '[A-Za-z]') OR regexp_matches(marked, '[A-Za-z]') THEN 'latin_letter'
WHEN {STRIP.format('marked')} <> form THEN 'other_word' WHEN NOT regexp_matches(marked, '[_^]') THEN 'no_mark' WHEN count(*) OVER (PARTITION BY form) > 1 THEN 'duplicate_key' END"""
PIECE = r"[\p{L}\p{M}\p{Nd}\p{Pc}'^]+|[^\p{L}\p{M}\p{Nd}\p{Pc}'^]+"
BARE_LOWER_FIRST = r"string_split_regex(line, '[\s\x{0085}\x{00A0}]+')"

SQL: dict[str, str] = SINKS | {
    "clean_editorial": on_text(deleted("text", p.EDITORIAL)),
    "clean_noise": on_text(sub("text", p.NOISE, "")),
    "unify_apostrophes": on_text(mapped("text", dict.fromkeys(p.APOSTROPHES, "'"))),
    "strip_digits": on_text("regexp_replace(text, '[0-9]', '', 'g')"),
    "premark": on_text(steps("text", [(r"\sτἄλλα\s", "τἄλλα^"), (r"\sἁ\s", "ἁ_")])),
    "strip_marks": on_text(STRIP.format("text")),
    "grave_to_acute": on_text(mapped("text", p.GRAVE_TO_ACUTE)),
    "acute_to_grave": on_text(mapped("text", p.ACUTE_TO_GRAVE)),
    "lower_text": on_text("lower(text)"),
    "upper_text": on_text(UP("text")),
    "token_clean": on_text(deleted("text", p.ANO_TELEIA + p.QUESTION)),
    "only_bases": on_text(mapped("text", p.BARE)),
    "open_dichrona": on_text(open_dichrona("text")),
    "lunate_sigma": on_lines("translate(regexp_replace(translate(line, 'ς', 'ϲ'), 'ϲ(\\s|$)', 'ς\\1', 'g'), 'ϲ', 'σ')"),
    "lower_first_word": f"""WITH {L}, s AS (SELECT doc_id, line_no, list_filter({BARE_LOWER_FIRST}, lambda w: w <> '') AS l FROM lines)
SELECT doc_id, line_no, array_to_string(list_concat([CASE WHEN regexp_matches(coalesce(l[1], ''), {q(VOWEL)}) THEN lower(l[1]) ELSE coalesce(l[1], '') END], l[2:]), ' ') AS out FROM s""",
    "comparison_normalize": on_lines(f"trim(translate({deleted('line', p.NORMAL_DROP)}, chr(180), ''''), ' ')"),
    "fix_trailing_space": on_lines("regexp_replace(line || ' ·', ' (.)$', '\\1', 'g')"),
    "vowel_lines": on_lines(f"regexp_matches(line, {q(VOWEL)})"),
    "sentence_split": sized(f"regexp_extract_all(text, {q(SENTENCE)})", "documents", "doc_id"),
    "sentence_split_turns": sized(f"regexp_extract_all(text, {q(SENTENCE)})", "conversations", "conv_id"),
    "terminated_sentences": sized(f"regexp_extract_all(text, {q(TERMINATED)})", "documents", "doc_id"),
    "word_list": sized(word_list("text"), "documents", "doc_id"),
    "merge_new_wins": merge("new"),
    "merge_old_wins": merge("old"),
    "count_fixtures": on_words(x.COUNTS, open_dichrona("word")),
    "numeral_filter": on_words(x.NUMERALS, NUMERAL.format("word")),
    "pathology_filter": on_words(x.PATHOLOGIES, f"{bad_accents('word')} OR regexp_matches(word, 'ς.')"),
    "nfc": on_words(x.UNICODE, f"replace(replace(nfc_normalize(replace(replace(word, chr(894), chr(57344)), chr(903), chr(57345))), chr(57344), chr(894)), chr(57345), chr(903))"),
    "no_macrons": on_words(x.UNICODE, "nfc_normalize(translate(nfc_normalize(word), 'ᾱᾰῑῐῡῠᾹᾸῙῘῩῨāēīōūăĕĭŏŭ' || chr(772) || chr(774), 'ααιιυυΑΑΙΙΥΥaeiouaeiou'))"),
    "diphthong_marked": on_words(x.DIPHTHONGS, marked_diphthong("word")),
    "diphthong_unmark": on_words(x.DIPHTHONGS, f"CASE WHEN array_to_string(l, '') = word THEN array_to_string(list_transform(l, lambda s: CASE WHEN {marked_diphthong('s')} THEN translate(s, '_^', '') ELSE s END), '') ELSE word END", f", s AS (SELECT word, {syllables('word')} AS l FROM v)", "s"),
    "syllabify": on_words(x.COUNTS, f"array_to_string({syllables('word')}, '|')"),
    "syllable_lengths": on_words(x.COUNTS + x.DIPHTHONGS, f"array_to_string(list_transform({syllables('word')}, lambda s: CASE WHEN {short_vowel('s')} THEN 's' ELSE '-' END || CASE WHEN {long_acute('s')} THEN 'a' ELSE '-' END || CASE WHEN {doubtful('s')} THEN 'd' ELSE '-' END), '|')"),
    "accent_class": on_words(x.COUNTS, accent_class("l"), f", s AS (SELECT word, {syllables('word')} AS l FROM v)", "s"),
    "accent_rules": on_words(x.COUNTS, "ruled", accent_steps("v"), "ruled"),
    "colour": on_words(x.COUNTS, coloured("word")),
    "place_marks": f"WITH {W}, {values('r', 'word, spec', x.PLACES)}, v AS (SELECT DISTINCT word, CASE WHEN length(word) % 2 = 0 THEN '_2,^3' ELSE '^1' END AS spec FROM w UNION ALL SELECT * FROM r) SELECT word, spec, {PLACED} AS out FROM v",
    "minimal_pair": on_tagged(f"CASE WHEN token = 'ἄλλα' THEN CASE WHEN {FEM} THEN 'ἄλλα_' ELSE 'ἄλλα^' END END"),
    "nominal_rules": on_tagged(NOMINAL),
    "verbal_rules": on_tagged(f"coalesce({VERBAL})"),
    "ending_rewrite": endings(),
    "ambiguous_coverage": f"WITH {W}, v AS (SELECT DISTINCT word FROM w){accent_steps('v')}, n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL) SELECT lang, sum(n * {open_dichrona('n.word')})::BIGINT AS n_open, sum(n * {open_dichrona('ruled')})::BIGINT AS n_ambiguous FROM n JOIN ruled USING (word) GROUP BY lang",
    "even_chunks": f"""WITH a AS (SELECT doc_id, text, length(text) // 3 AS k FROM documents), b AS (SELECT doc_id, k, length({CHUNK}) AS n0, text FROM a), c AS (SELECT doc_id, n0, k, substr(text, n0 + 1) AS text FROM b), d AS (SELECT doc_id, n0, length({CHUNK}) AS n1, length(text) AS n FROM c)
SELECT doc_id, n0, n1, n - n1 AS n2 FROM d""",
    "first_column": "SELECT doc_id, string_split(replace(text, ' ', chr(9)), chr(9))[1] AS out FROM documents",
    "success_rates": f"""WITH {GOLD}, o0 AS (SELECT file, translate(line, '[]{{}}#€', '') AS g FROM gold), o AS (SELECT file, g, {sub(STRIP.format('g'), '([αι])', '$1^')} AS o FROM o0), c AS (SELECT file, unnest(list_zip({CELL.format('o')}, {CELL.format('g')})) AS z FROM o WHERE {STRIP.format('o')} = {STRIP.format('g')}),
m AS (SELECT file, coalesce(substr(z[1], 2), '') AS o, coalesce(substr(z[2], 2), '') AS g FROM c), n AS (SELECT file, count(*) FILTER (g = '^' AND o = '^') AS short_right, count(*) FILTER (g = '^') AS short_total, count(*) FILTER (g = '_' AND o = '_') AS long_right, count(*) FILTER (g = '_') AS long_total FROM m WHERE g <> '' GROUP BY ROLLUP (file))
SELECT file, short_right, short_total, long_right, long_total, round(coalesce((short_right + long_right)::DOUBLE / nullif(short_total + long_total, 0), 0), 9) AS both_rate FROM n""",
    "all_short_count": on_gold(f"len(list_filter({SYLL}, lambda s: {OPEN}))::BIGINT"),
    "gold_stripped": on_gold("translate(line, '^_[]{}', '')"),
    "lexicon_validate": f"""WITH {W}, k AS (SELECT DISTINCT word, length(word) AS n, {sub('word', '([αιυ])', '$1^')} AS m FROM w), e AS (SELECT CASE WHEN n % 13 = 0 THEN m WHEN n % 11 = 0 THEN replace(word, 'ο', 'o') ELSE word END AS form,
CASE WHEN n % 7 = 0 THEN m || 'ν' WHEN n % 11 = 0 THEN replace(m, 'ο', 'o') WHEN n % 5 = 0 THEN word ELSE m END AS value, n, word FROM k), v AS (SELECT form, unnest(CASE WHEN n % 9 = 0 THEN [value, {sub('word', '([αιυ])', '$1_')}] ELSE [value] END) AS marked FROM e) SELECT form, marked, {DEFECT} AS problem FROM v""",
    "bracket_move": on_gold(FILLED),
    "gold_plain": on_gold("translate(line, '[]{}#€_^', '')"),
    "syllable_extract": on_gold(f"array_to_string({SYLL}, '|')"),
    "closed_syllable_clean": on_gold(each(f"CASE WHEN {OPEN} THEN s ELSE {STRIP.format('s')} END")),
    "all_short_baseline": on_gold(each(f"{STRIP.format('s')} || CASE WHEN {OPEN} THEN '^' ELSE '' END")),
    "stop_word_unmark": on_gold(f"array_to_string(list_transform(string_split(translate(line, '[]{{}}#€', ''), ' '), lambda w: CASE WHEN {STRIP.format('w')} IN {alternatives(x.STOP_MARKED)} THEN {STRIP.format('w')} ELSE w END), ' ')"),
    "coverage_by_lang": coverage(f"{G}, s AS (SELECT lang, unnest(regexp_extract_all({deleted('text', p.EDITORIAL)}, {q(SENTENCE)})) AS s FROM g)", "s", sub("s", CLASS_SENT, "$1^$2"), "s", "lang", "GROUP BY lang"),
    "corpus_rollup": coverage(G, "text", sub("text", f"([{p.DICHRONA}])([.])", "$1^$2"), "g", "lang, source", "GROUP BY ROLLUP (lang, source)"),
    "coverage_without_names": f"""WITH {NAMED}, n AS (SELECT lang, text, {GAPPED} AS kept FROM named)
SELECT lang, sum({open_dichrona('kept')})::BIGINT AS before, sum({open_dichrona("replace(kept, 'α', 'α_')")})::BIGINT AS after FROM n GROUP BY lang""",
    "text_without_names": f"""WITH {NAMED}, n AS (SELECT doc_id, {GAPPED} AS kept FROM named) SELECT doc_id, length(kept) AS n, md5(kept) AS digest FROM n""",
    "synapheia": f"""WITH {W}, s AS (SELECT doc_id, pos, {syllables('word')} AS l FROM w), u AS (SELECT doc_id, pos, unnest(range(len(l))) AS i, unnest(l) AS syl, len(l) AS n FROM s), f AS (SELECT *, lead(syl) OVER (PARTITION BY doc_id ORDER BY pos, i) AS following, translate(syl, '_^' || chr(39), '') AS bare FROM u),
o AS (SELECT doc_id, pos, i, CASE WHEN i < n - 1 THEN {like('bare', VOWEL + '$')} ELSE ({OPEN_WORD}) END AS o FROM f), a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (o) AS n_open, md5(string_agg(CASE WHEN o THEN 'o' ELSE 'c' END, '' ORDER BY pos, i)) AS digest FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, coalesce(n_open, 0) AS n_open, coalesce(digest, md5('')) AS digest FROM g LEFT JOIN a USING (doc_id)""",
    "sentence_filter": f"""WITH {G}, l AS (SELECT doc_id, regexp_extract_all(text, {q(SENTENCE)}) AS l FROM g), s AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS sent_id, unnest(l) AS s FROM l),
n AS (SELECT doc_id, sent_id, {open_dichrona('s')} AS n FROM s) SELECT * FROM n WHERE n > 0""",
    "drop_reason_counts": f"""WITH {W} SELECT CASE WHEN {NUMERAL.format('word')} THEN 'numeral' WHEN regexp_matches(word, 'ς.') THEN 'mid_sigma' WHEN {bad_accents('word')} THEN 'accents' WHEN {open_dichrona('word')} = 0 THEN 'nothing_to_do' END AS reason, count(*) AS n FROM w GROUP BY 1""",
    "stopword_anti_join": f"WITH {W} SELECT lang, count(*) AS n FROM w WHERE word NOT IN {alternatives(x.STOP)} GROUP BY lang",
    "tokenizer_semi_join": f"WITH {W}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM g) SELECT doc_id, count(*) AS n FROM r SEMI JOIN w USING (doc_id, word) GROUP BY doc_id",
    "ionic_semi_join": f"WITH {W} SELECT word, count(*) AS n FROM w WHERE word LIKE '%ε' AND substr(word, 1, length(word) - 1) IN {alternatives([i[:-1] for i in x.IONIC])} GROUP BY word",
    "lexicon_left_join": f"WITH {W}, {LEX}, n AS ({COUNTED}), m AS (SELECT form, arg_max(marked, ord) AS marked FROM lex GROUP BY form) SELECT word, n, marked FROM n LEFT JOIN m ON word = form",
    "lexicon_case_variants": f"""WITH {W}, {LEX}, v AS (SELECT form, marked, 0 AS kind, -ord AS o FROM lex UNION ALL SELECT lower(form), lower(marked), 1, ord FROM lex UNION ALL SELECT {CAP('form')}, {CAP('marked')}, 1, ord FROM lex),
best AS (SELECT form, marked FROM v QUALIFY row_number() OVER (PARTITION BY form ORDER BY kind, o, marked) = 1), n AS ({COUNTED}), c AS (SELECT CASE WHEN length(word) % 2 = 0 THEN {CAP('word')} ELSE word END AS word, n FROM n)
SELECT word, n, marked FROM c JOIN best ON word = form""",
    "lexicon_two_key": f"""WITH {W}, {LEX}, n AS (SELECT {CAP('word')} AS word, n FROM ({COUNTED})), m AS (SELECT form, arg_max(marked, ord) AS marked FROM lex GROUP BY form),
j AS (SELECT n.word, n, coalesce(a.marked, {CAP('b.marked')}) AS marked FROM n LEFT JOIN m a ON n.word = a.form LEFT JOIN m b ON {DECAP('n.word')} <> n.word AND {DECAP('n.word')} = b.form) SELECT * FROM j WHERE marked IS NOT NULL""",
    "lexicon_disambiguate_first": f"""WITH {W}, {values('alt', 'form, alt_id, marked, "case"', x.ALTERNATIVES)}, n AS (SELECT word, lang, count(*) AS n, CASE lang WHEN 'en' THEN 'Nom' WHEN 'de' THEN 'Dat' ELSE 'Acc' END AS k FROM w GROUP BY word, lang),
m AS (SELECT form, "case" AS k, arg_min(marked, alt_id) AS marked FROM alt GROUP BY ALL) SELECT word, lang, n, marked FROM n JOIN m ON word = form AND n.k = m.k WHERE {STRIP.format('marked')} = word""",
    "lexicon_build_last_wins": f"""WITH {W}, m AS (SELECT doc_id * 1000000 + pos AS line_no, CASE WHEN pos % 2 = 0 THEN {sub('word', f'([{p.DICHRONA}])', '$1^')} ELSE {sub('word', f'([{p.DICHRONA}])', '$1_')} END AS marked FROM w)
SELECT {STRIP.format('marked')} AS form, arg_max(marked, line_no) AS marked FROM m GROUP BY 1""",
    "prefix_longest_match": f"""WITH {W}, {values('pre', 'prefix, marked', [*p.PREFIXES.items(), *p.ELIDED_PREFIXES.items()])}, k AS (SELECT DISTINCT word FROM w), h AS (SELECT DISTINCT {mapped('lower(word)', p.BARE)} AS base FROM k),
t AS (SELECT translate(substr(word, 1, 1), 'αευ', 'ἀἐὑ') || substr(word, 2) AS token FROM k), c AS (SELECT token, prefix, marked, substr(token, length(prefix) + 1) AS rest FROM t JOIN pre ON starts_with(token, prefix))
SELECT token, arg_max(marked || rest, length(prefix)) AS prefix_marked FROM c JOIN h ON {mapped('rest', p.BARE)} = base WHERE rest <> '' GROUP BY token""",
    "elision_variants": f"""WITH {W}, k AS (SELECT DISTINCT word FROM w), t AS (SELECT DISTINCT substr(word, 1, length(word) - 1) AS stem FROM k WHERE length(word) > 2),
v AS (SELECT stem, 0 AS rank, stem || 'ε' AS word FROM t UNION ALL SELECT stem, 1, stem || 'ι' FROM t) SELECT stem || '''' AS token, arg_min(word, rank) AS word FROM v SEMI JOIN k USING (word) GROUP BY stem""",
    "decapitalize_lookup": f"""WITH {W}, k AS (SELECT DISTINCT word FROM w), t AS (SELECT translate(x, {q(x.LATIN_BOTH)}, {q(x.GREEK_BOTH)}) AS token FROM (SELECT unnest(string_split_regex(text, '[\\s\\x{{0b}}]+')) AS x FROM conversations) WHERE x <> '')
SELECT token, {DECAP('token')} AS word, count(*) AS n FROM t WHERE {DECAP('token')} IN (SELECT word FROM k) GROUP BY 1, 2""",
    "oxytone_lookup": f"""WITH {W}, k AS MATERIALIZED (SELECT DISTINCT word FROM w), a AS MATERIALIZED (SELECT word, left(word, greatest(length(word) - 2, 0)) || {mapped('right(word, 2)', p.GRAVE_TO_ACUTE)} AS acute FROM k WHERE regexp_matches(right(word, 2), {q(f'[{p.GRAVES}]')}))
SELECT a.word, a.acute FROM a JOIN k ON a.acute = k.word""",
    "context_particle": r"""WITH t AS (SELECT conv_id, lower(unnest(string_split_regex(text, '[\s\x{0b}]+'))) AS w FROM conversations), f AS (SELECT conv_id, coalesce(bool_or(w LIKE '%ing') AND NOT bool_or(w = 'of'), false) AS s, count(*) FILTER (w = 'the') AS n FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN s THEN n ELSE 0 END AS n_long, CASE WHEN s THEN 0 ELSE n END AS n_short FROM f""",
    "next_word_openness": f"WITH {W}, f AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS following, translate(word, '_^' || chr(39), '') AS bare FROM w) SELECT lang, sum(({OPEN_WORD})::INT)::BIGINT AS n_open, count(*) AS n FROM f GROUP BY lang",
    "occurrence_align": f"WITH {W}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS k FROM w) SELECT doc_id, max(k) AS most, sum(k)::BIGINT AS total, count(*) AS n FROM k GROUP BY doc_id",
    "integrate_text": f"""WITH {G}, l AS (SELECT doc_id, regexp_extract_all(text, {q(PIECE)}) AS l FROM g), m AS (SELECT doc_id, array_to_string(list_transform(l, lambda s: CASE WHEN contains(s, 'α') THEN replace(s, 'α', 'α^') ELSE s END), '') AS text FROM l)
SELECT doc_id, length(text) AS n, md5(text) AS digest FROM m""",
    "integrity_check": f"""WITH {G}, c AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN replace(text, 'β', 'γ') ELSE replace(text, 'α', 'α_') END AS after FROM g), s AS (SELECT doc_id, text, after, {STRIP.format('text')} AS a, {STRIP.format('after')} AS b FROM c)
SELECT doc_id, a = b AS intact, {FIRST_DIFF}::BIGINT AS first_diff, length(b) - length(a) AS length_diff FROM s""",
    "residue_rank": f"WITH {W}, n AS ({COUNTED}) SELECT word, n FROM n WHERE {open_dichrona('word')} > 0",
    "residue_keep_first": f"WITH {W} SELECT word, doc_id, pos::BIGINT AS pos FROM w QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) = 1",
    "module_share": "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 2) SELECT event_type, n, round(100 * n::DOUBLE / (SELECT sum(n) FROM n)::DOUBLE, 6) AS percent FROM n",
    "residue_merge_runs": f"WITH {W} SELECT word, sum(pos)::BIGINT AS n FROM w WHERE pos % 5 <> 0 GROUP BY word",
    "top_pos": f"WITH {W} SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "pos_baseline": f"WITH {G}, t AS (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}\\s]')) AS w FROM g) SELECT CASE WHEN length(w) < 4 THEN 'short' ELSE 'long' END AS pos, count(*) AS n FROM t WHERE regexp_matches(w, '^\\p{{L}}') GROUP BY 1",
    "stats_pivot": f"WITH {G} SELECT sum({count('text', 'α')})::BIGINT AS numerator, sum({open_dichrona('text')})::BIGINT AS denominator FROM g",
    "reconcile": f"WITH {L}, n AS (SELECT doc_id * 100000 + line_no AS id, length(line) AS n FROM lines) SELECT id, n > 50 AS in_input, n < 200 AS in_output FROM n WHERE (n > 50) <> (n < 200)",
    "even_batches": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS t FROM documents) SELECT least(k // greatest(1, t // 4), 3)::INTEGER AS batch, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1",
    "chunk_ids": "SELECT doc_id // 300 AS chunk, count(*) AS n FROM documents GROUP BY 1",
    "char_inventory": f"WITH ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) SELECT string_agg(ch, '' ORDER BY ch) AS chars FROM ch WHERE NOT regexp_matches(ch, {q(f'[{p.LETTERS}A-Za-z0-9]')}) AND NOT regexp_matches(ch, '[\\s\\x00-\\x1f\\x7f-\\x9f\\xa0]') AND ch <> ''",
    "line_match_rate": f"WITH {G} SELECT lang, round(avg(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END), 9) AS rate FROM g GROUP BY lang",
    "traffic_light": "WITH r AS (SELECT event_type, count(*) FILTER (event_id % 10 < 9)::DOUBLE / count(*) AS r FROM events GROUP BY 1) SELECT event_type, CASE WHEN r > 0.95 THEN 'green' WHEN r > 0.85 THEN 'yellow' ELSE 'red' END AS light FROM r",
    "html_span_extract": "WITH s AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*>([^<]*)</a>', 1) AS s FROM pages) SELECT page_id, len(s) AS n, coalesce(s[1], '') AS first FROM s",
    "json_definition": "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events",
    "bracket_extract": "WITH s AS (SELECT doc_id, translate(text, ',.', '[]') AS s FROM documents) SELECT doc_id, nullif(regexp_extract(s, '\\[([^\\]]+)\\]', 1), '') AS out FROM s",
    "guarded_rewriting": rivals(),
    "codec_to_unicode": marked_words(combining("marked")),
    "codec_to_markup": marked_words("marked"),
    "tei_extract": TEI,
    "cached_annotations": f"""WITH {G}, k AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:2], '-') || '-' || sha256(text) AS key FROM g) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 4 = 0)""",
}
