"""Functions, stages and streams of the engine, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from morae.functions import marks, phonology, text
from morae.functions import profile
from morae.operators import assemble, cascade, evaluate, lexicon, macronize, report, rewrite, rules
from morae.plans import fixtures, queries
from morae.sources import readers
from morae.streaming import engine

from .test_normal import plain_unicode


def one(spark, build, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(build(*map(F.col, names)).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "word, n",
    [("νεανίας", 3), ("νεα_νί^α_ς", 0), ("πολλάκις", 2), ("κάλλος", 0), ("παῖδες", 0), ("παῖς", 0), ("ὕλῃ", 1), ("ἄν", 1), ("", 0), ("vdc", 0)],
)
def test_open_dichrona(spark, word, n):
    assert one(spark, phonology.open_dichrona, word) == n


@pytest.mark.parametrize("word, parts", [("νεανίας", "νε|α|νί|ας"), ("ἄνθρωπος", "ἄν|θρω|πος"), ("χίλιοι^", "χί|λι|οι^"), ("πράγματα", "πράγ|μα|τα")])
def test_syllables(spark, word, parts):
    assert one(spark, lambda w: F.array_join(phonology.syllables(w), "|"), word) == parts


@pytest.mark.parametrize(
    "word, out",
    [("ἀξία", "ἀξία"), ("δῶρα", "δῶρα^"), ("πράγματα", "πράγματα^"), ("χώρα", "χώρα_"), ("παρ'", "παρ'"), ("", ""), ("καί", "καί"), ("φύλλον", "φύ^λλον"), ("φίλος", "φί^λος"), ("λόγῳ", "λόγῳ")],
)
def test_accent_rules(spark, word, out):
    assert one(spark, phonology.accent_rules, word) == out


def test_merge(spark):
    assert one(spark, marks.merged, "st_ring^", "s_t^ring^") == "s_t_ring^"
    assert one(spark, lambda a, b: marks.merged(a, b, "old"), "st_ring^", "s_t^ring^") == "s_t^ring^"
    assert one(spark, marks.merged, "xyz", "a_b") == "a_b"
    assert one(spark, marks.merged, None, "a_b") == "a_b"


def test_codecs(spark):
    plain, marked = "νεᾱνῐ́ᾱς", "νεα_νί^α_ς"
    assert one(spark, marks.to_markup, plain) == marked
    assert one(spark, lambda w: marks.to_markup(marks.to_unicode(w)), marked) == marked
    assert one(spark, marks.unlengthened, plain) == "νεανίας"
    assert one(spark, marks.placed, "νεανίας", "_3,^5,_6") == marked
    assert one(spark, marks.normalized, ";·") == ";·"
    assert one(spark, lambda w: marks.graved(marks.acuted(w)), "ὰὲὶὸὺὴὼ") == "ὰὲὶὸὺὴὼ"


def test_diphthongs(spark):
    for word, found in (("χίλι^οι", False), ("χίλιοι^", True), ("δα^ίμων", True), ("δα^ϊμων", False), ("δαίμων", False)):
        assert one(spark, phonology.marks_diphthong, word) is found
    assert one(spark, phonology.unmark_diphthongs, "χίλιοι^") == "χίλιοι"


def test_rules(spark):
    df = spark.createDataFrame(fixtures.TAGGED, "token string, lemma string, pos string, morph string")
    morph = rules.parse_morph(F.col("morph"))
    got = [r["out"] for r in df.select(rules.nominal(F.col("token"), F.col("lemma"), F.col("pos"), morph, F.lit(True), F.lit(True)).alias("out")).collect()]
    assert got[2:10] == ["χώρα_", "χώρα_ν", "χώρα_ς", "χώρα_ς", "δῶρα^", "γυναιξί^ν", None, "λογι^κος"]
    assert got[-1] is None


def test_particle(spark):
    rows = [(1, "ἄν", {"Mood": ["Sub"]}), (1, "λέγω", {}), (2, "ἄν", {"Mood": ["Sub"]}), (2, "εἰ", {}), (3, "ἄν", {}), (4, "λόγος", {})]
    df = spark.createDataFrame(rows, "s int, text string, morph map<string,array<string>>")
    got = {(r["s"], r["text"]): r["marked"] for r in text.context_particle(df, "s").collect()}
    assert got[1, "ἄν"] == "ἄ_ν" and got[2, "ἄν"] == "ἄ^ν" and got[3, "ἄν"] == "ἄ^ν" and got[4, "λόγος"] is None


def test_endings_table(spark):
    df = spark.createDataFrame([("φίλοις", "φίλος", "NOUN", "Case=Dat|Gender=Masc")], "token string, lemma string, pos string, morph string")
    v = df.select(rewrite.ending_variants(F.col("token"), F.col("lemma"), F.col("pos"), rules.parse_morph(F.col("morph"))).alias("v")).first()["v"]
    assert (v["variant"], v["restored"]) == ("φίλος", 3)


def test_cascade(spark):
    got = {(r["token"], r["lemma"]): r for r in queries.resolved_tokens(spark, "").collect()}
    assert got["χώραν", "χώρα"]["marked"] == "χώρα_ν"
    assert got["κακὸς", "κακός"]["marked"] == "κα^κὸς"
    assert got["Φύσις", "φύσις"]["marked"] == "Φύ^σι^ς"
    for r in got.values():
        assert r["marked"].replace("_", "").replace("^", "") == r["token"] and r["open_after"] <= r["open_before"]
    assert cascade.STAGES[0].name == "minimal_pair"


def test_integration_by_occurrence(spark):
    docs = spark.createDataFrame([(1, "ab cd ab. ab"), (2, "")], "doc_id long, text string")
    marked = spark.createDataFrame([(1, 0, "a^b"), (1, 4, "a_b")], "doc_id long, pos int, marked string")
    got = {r["doc_id"]: r["text"] for r in assemble.integrated(docs, marked).collect()}
    assert got == {1: "a^b cd a_b. ab"}


def test_scores(spark):
    assert one(spark, lambda a, b: evaluate.alignment(a, b)["correct"], "α^β", "α^β") == 1
    assert one(spark, lambda a, b: evaluate.backward(a, b)["correct"], "αβ", "α^β_") == 1


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, lines in enumerate((["Δῶρα φίλος 12", "xyz"], ["πράγματα ."])):
        (folder / f"{k}.txt").write_text("\n".join(lines))
    pairs = engine.annotated(engine.prepared(engine.read_lines(spark, str(folder))))
    engine.append_pairs(pairs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t").select("_c0", "_c1").collect())
    batch = engine.annotated(engine.prepared(spark.read.text(str(folder)).select(F.col("value").alias("line"))))
    assert got == sorted(tuple(r) for r in batch.select("unmarked", "marked").collect())
    assert engine.totals(batch).first()["denominator"] > 0


ANNOTATIONS = "doc_id long, sent_id int, tok_id int, text string, lemma string, pos string, morph map<string,array<string>>"


def annotated(spark, text, tokens, config=cascade.EngineConfig(), lexica=None, **more):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    own = spark.createDataFrame([(1, 0, k, *x) for k, x in enumerate(tokens)], ANNOTATIONS)
    lex = spark.createDataFrame([("καλός", "κα_λός", 1), ("ἀνήρ", "ἀ^νήρ", 2)], "form string, marked string, ord int")
    got = {r["doc_id"]: r["text"] for r in macronize.annotate(docs, own, lexica or cascade.Lexica(custom=lex), config, **more).collect()}
    assert got[2] is None
    return got[1]


def test_annotate(spark):
    tokens = [("καλός", "καλός", "ADJ", {"Case": ["Nom"]}), ("ἂν", "ἄν", "PART", {}), ("ἴῃ", "εἶμι", "VERB", {"Mood": ["Sub"]}), ("δῶρα", "δῶρον", "NOUN", {"Case": ["Acc"]}), ("φύλλον", "", "", {}), ("φίλος", "φίλος", "X", {})]
    text = "«Καλός» καλός ἂν ἴῃ δῶρα, φύλλον μίν"
    # a token without a part of speech is left alone, and so is one that isn't in the text
    assert annotated(spark, text, tokens) == "Καλός κα_λός ἂ_ν ἴῃ δῶρα^, φύλλον μίν"
    assert annotated(spark, text, tokens, cascade.EngineConfig(lowercase=True)) == "κα_λός καλός ἂ_ν ἴῃ δῶρα^, φύλλον μίν"
    assert annotated(spark, text, tokens, cascade.EngineConfig(output_format="unicode", rounds=0)) == "Καλός κᾱλός ἂ_ν ἴῃ δῶρᾰ, φύλλον μίν".replace("ἂ_", plain_unicode("ἂ_"))
    assert annotated(spark, text, tokens, cascade.EngineConfig(genre="epic", rounds=0)) == "Καλός καλός ἂ_ν ἴῃ δῶρα^, φύλλον μίν"
    assert annotated(spark, text, tokens, stop_words=("δῶρα",)) == "Καλός κα_λός ἂ_ν ἴῃ δῶρα, φύλλον μίν"


def test_stages_can_be_reordered_and_extended(spark):
    extra = cascade.Stage("mine", lambda df, lexica, config: df.withColumn("candidate", F.when(F.col("token") == "ξυλα", "ξυ_λα_")))
    tokens = spark.createDataFrame([("ξυλα", "x", "X", {"a": ["b"]})], "token string, lemma string, pos string, morph map<string,array<string>>")
    got = cascade.resolve(tokens, stages=[extra, *cascade.STAGES[::-1]], config=cascade.EngineConfig(rounds=0)).first()
    assert got["marked"] == "ξυ_λα_" and got["hits"] == ["mine"]


@pytest.mark.parametrize("token, lemma, head, out", [("διαφέρω", "διαφέρω", "φέρω", "δι^α^φέρω"), ("ἀντιλέγω", "ἀντιλέγω", "λέγω", "ἀντι^λέγω"), ("ἀναβαίνω", "ἀναβαίνω", "βαίνω", "ἀ^να^βαίνω"), ("ἀφίκοντο", "ἀφικνέομαι", "ἱκνέομαι", "ἀ^φίκοντο"), ("λέγω", "λέγω", "λέγω", None)])
def test_prefixes(spark, token, lemma, head, out):
    own = spark.createDataFrame([(token, lemma)], "token string, lemma string")
    heads = lexicon.headwords(spark.createDataFrame([(head,)], "form string"))
    assert rewrite.prefixed(own, heads, "token", "lemma").first()["prefix_marked"] == out
    if token == "ἀναβαίνω":  # the last elided form that fits hides the whole one
        assert rewrite.prefixed(own, heads, "token", "lemma", literal=True).first()["prefix_marked"] is None


def test_every_prefix_keeps_its_letters():
    for plain, marked in {**profile.PREFIXES, **profile.ELIDED_PREFIXES}.items():
        assert marked.replace("^", "") == plain and len(marked) > len(plain)


def test_double_accents(spark):
    none = F.create_map().cast("map<string,array<string>>")
    kinds = lambda word: {x["kind"]: x["variant"] for x in one(spark, lambda w: rewrite.variants(w, F.lit(""), F.lit(""), none), word)}
    assert kinds("πράγματά") == {"double_accent_last": "πράγματα"}
    assert kinds("Καλλίμαχός")["double_accent_before"] == "Καλλίμαχος"
    back = lambda answer, token, kind: one(spark, lambda a, t: rewrite.restored(a, t, F.lit(kind), F.lit(1)), answer, token)
    assert back("πρά_γμα^τα^", "πράγματά", "double_accent_last") == "πρά_γμα^τά^"
    assert back("πράγματα_", "πράγματά", "double_accent_last") == "πράγματά"


def test_pointer_scores(spark):
    got = one(spark, lambda a, b: evaluate.backward(a, b), "α", "α^βα")
    assert (got["expected"], got["short_total"], got["short_right"]) == (1, 1, 1)
    got = one(spark, lambda a, b: evaluate.backward(a, b), "α", "α_βα")
    assert (got["expected"], got["correct"], got["long_total"], got["long_right"]) == (1, 0, 1, 0)
    got = one(spark, lambda a, b: evaluate.backward(a, b), "α_β", "α^β")
    assert (got["expected"], got["correct"]) == (1, 0)
    got = one(spark, lambda a, b: evaluate.backward(a, b), "α_β^", "αβ")
    assert got["expected"] == 0


def test_verbal_rules(spark):
    rule = lambda word, lemma, pos, morph, on: one(spark, lambda w: rules.verbal(w, F.lit(lemma), F.lit(pos), rules.parse_morph(F.lit(morph)), on), word)
    present = "Mood=Ind|Number=Sing|Tense=Pres|Voice=Act"
    assert rule("εἰμι", "εἰμί", "NOUN", "Case=Nom", False) == "εἰμι^"
    assert rule("δείκνυς", "δείκνυμι", "VERB", present, True) == "δείκνυ_ς" and rule("δείκνυς", "δείκνυμι", "VERB", present, False) is None
    assert rule("δείκνυς", "δεικνύω", "VERB", present, True) is None and rule("εἰμι", "", "", "", False) is None


def test_the_last_entry_wins(spark):
    lex = spark.createDataFrame([("ab", "a^b", 2), ("ab", "a_b", 1)], "form string, marked string, ord int")
    own = spark.createDataFrame([("ab",), ("c",)], "w string")
    assert {r["w"]: r["m"] for r in lexicon.lookup(own, lex, F.col("w"), "m").collect()} == {"ab": "a^b", "c": None}


def test_noise(spark):
    assert one(spark, text.without_noise, "λό#γοςé§ ñêå Ж①") == "λόγος ñêå Ж①"


def test_text_helpers(spark):
    chunks = one(spark, lambda s: text.even_chunks(s, 3), "αβγ δεζ ηθι κλ")
    assert "".join(chunks) == "αβγ δεζ ηθι κλ" and chunks == ["αβγ δεζ", " ηθι", " κλ"]
    assert one(spark, text.first_column, "a\tb") == "a" and one(spark, text.first_column, "") == ""
    assert one(spark, lambda s: evaluate.open_count(evaluate.syllables(s)), "[κα_]{λός} [τὸ]") == 2


def test_ambiguous_coverage(spark):
    own = spark.createDataFrame([("δῶρα ἀξία", "δῶρα^ ἀξία")], "a string, b string")
    every = report.coverage(own, "a", "b").first()
    left = report.coverage(own, "a", "b", ambiguous=True).first()
    assert every["before"] > left["before"] >= 1 and left["difference"] == 0
    names = spark.createDataFrame([("ἀξία",)], "name string")
    assert report.coverage(own, "a", "b", names=names).first()["ratio"] == 1


def test_even_batches(spark):
    df = spark.createDataFrame([(3 * k,) for k in range(103)], "doc_id long").repartition(5)
    got = {r["batch"]: r["n"] for r in report.even_batches(df, "doc_id").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 25, 1: 25, 2: 25, 3: 28}
    assert report.even_batches(df.limit(0), "doc_id").count() == 0


def test_cached_annotations(spark):
    docs = spark.createDataFrame([(1, "α β"), (2, "γ δ")], "doc_id long, text string")
    _, missing = macronize.cached(docs, None)
    store = missing.where("doc_id = 1").select("key", F.lit("x").alias("tag"))
    kept, left = macronize.cached(docs, store.withColumn("doc_id", F.lit(9)))
    assert [(r["doc_id"], r["tag"]) for r in kept.collect()] == [(1, "x")] and [r["doc_id"] for r in left.collect()] == [2]


def test_blocks_are_those_of_the_longest_matches():
    from difflib import SequenceMatcher

    from morae.operators import alignment

    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("αβ^_ ") for _ in range(n))
    first = [line(rng.randint(0, 60)) for _ in range(300)] + ["", "α", "αβ" * 20]
    second = [x[: rng.randint(0, 60)] + line(rng.randint(0, 20)) + x[rng.randint(0, 60) :] for x in first[:-3]] + ["α", "", "βα" * 20]
    got = [[] for _ in first]
    for k, i, j, n in zip(*alignment.blocks(first, second), strict=True):
        got[k].append((int(i), int(j), int(n)))
    for a, b, own in zip(first, second, got, strict=True):
        want = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]
        merged = []  # neighbours are joined there
        for i, j, n in sorted(own):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert merged == [tuple(x) for x in want]


def test_alignment_of_long_and_empty_lines(spark):
    from difflib import SequenceMatcher

    rng = random.Random(10)
    text = "".join(rng.choice("αβγδειο ") for _ in range(1500))
    gold = "".join(ch + (rng.choice(["", "^", "_"]) if ch in "αι" else "") for ch in text)
    output = "".join(ch + ("^" if ch == "α" else "") for ch in text)
    rows = [(output, gold), ("", gold), (output, ""), (None, None), (output * 60, gold * 60)]
    got = [tuple(r["s"]) for r in spark.createDataFrame(rows, "o string, g string").select(evaluate.alignment(F.col("o"), F.col("g")).alias("s")).collect()]
    marks_in = lambda s: sum(s.count(m) for m in "_^")
    blocks = SequenceMatcher(None, output, gold, autojunk=False).get_matching_blocks()
    assert got[0] == (marks_in(gold), sum(marks_in(gold[x.b : x.b + x.size]) for x in blocks))
    assert got[1] == (marks_in(gold), 0) and got[2] == (0, 0) and got[3] == (0, 0) and got[4][0] == 60 * marks_in(gold) and got[4][1] > 0


def test_names_are_found_as_a_pattern_finds_them(spark):
    import re

    rng = random.Random(11)
    names = ["α β", "α", "β γ δ", "γ", "α, β", "δ δ", "αβ", "γ-δ", "ε", ".", "δ ", "β β β"]
    texts = ["".join(rng.choice(["α", "β", "γ", "δ", "ε", "αβ", "ζ"]) + rng.choice([" ", " ", ", ", "-", "  ", "\n", "1", ""]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", "α", "α β"]
    known = [n for n in names if re.fullmatch(r"\w(.*\w)?", n)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, t string").repartition(3)
    for order in (known, sorted(known, key=lambda n: (-len(n), n))):
        pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, order)) + r")\b")
        table = spark.createDataFrame([(n, order.index(n) if n in order else 0) for n in names], "name string, ord int")
        got = {r["id"]: r["t"] for r in report.without_names(df, table if order is known else table.drop("ord"), "id", "t").collect()}
        for k, t in enumerate(texts):
            want = re.sub(r"\s+", " ", pattern.sub("", t)).strip() if pattern.search(t) else t
            assert got[k] == want, (t, order)
        assert got[99] is None


def test_names_of_marked_texts(spark):
    own = spark.createDataFrame([("ἀξία, δῶρα καὶ Λυδία", "ἀξία, δῶρα^ καὶ Λυ_δί^α")], "a string, b string")
    names = spark.createDataFrame([("Λυδία",), ("ἀξία",)], "name string")
    both = report.coverage(own, "a", "b", names=names).first()
    assert both["before"] == report.coverage(spark.createDataFrame([("δῶρα καὶ", "")], "a string, b string"), "a", "b").first()["before"] and both["after"] == 0
    first = report.coverage(own, "a", "b", names=names, literal=True).first()
    assert first["before"] == both["before"] and first["after"] > 0


def test_openness_looks_over_borders(spark):
    of = lambda *words: spark.createDataFrame([(list(words),)], "w array<string>").select(phonology.openness(F.col("w")).alias("o")).first()["o"]
    assert of("λόγος", "ἄγει") == [True, True, True, True] and of("λόγος", "καὶ") == [True, False, True]
    assert of("τὰ", "στέρνα") == [False, False, True] and of("τὰ", "ζῷα") == [False, True, True] and of() == []
