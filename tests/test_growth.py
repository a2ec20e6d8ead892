"""Work that grows with the input: shapes of plans and of patterns that keep it in proportion, and results that are the same."""

import inspect
import itertools
import re

import pandas as pd
from pyspark.sql import functions as F

from morae.functions import phonology
from morae.functions import profile as p
from morae.functions import text as t
from morae.operators import alignment, evaluate
from morae.plans import gold_text

c = F.col


def test_ranged_classes_match_the_same(spark):
    letters = "".join(chr(k) for k in range(1, 0x2100))
    df = spark.createDataFrame([(letters,), ("αἴῳ_ξαι^ νβ ᾁ.",)], "s string")
    for chars in (p.VOWELS, p.DICHRONA, p.ACCENTS, p.CONSONANTS, p.LETTERS + "A-Za-z0-9", p.VOWELS + "_^"):
        for sign in ("", "^"):
            plain = f"[{sign}{chars}]"
            assert plain != p.ranged(plain)
            found = [F.regexp_extract_all("s", F.lit(x), F.lit(0)) for x in (plain, p.ranged(plain))]
            assert all(r["same"] for r in df.select((found[0] == found[1]).alias("same")).collect())


def test_char_inventory_asks_for_runs_not_for_each_character(spark):
    df = spark.createDataFrame([("αb1 ☃☃·\n☃\u0085",), (None,), ("",)], "text string")
    out = t.residual_characters(df, "text")
    assert out.first()["chars"] == "·☃"
    exploded = re.search(r"Generate explode\((.*)", out._jdf.queryExecution().executedPlan().toString())[1]
    assert exploded.startswith("array_distinct(split(regexp_replace(")


def test_pairs_and_batches_keep_blanks_at_the_ends_of_lines(spark, tmp_path):
    from morae.plans.queries import tsv
    from morae.sources import readers

    rows = [(0, " αβ ", " α^β "), (0, "γ\u000b", "\u000bγ"), (1, "δε", "δε ")]
    df = spark.createDataFrame(rows, "batch long, unmarked string, marked string")
    readers.write_pairs(df, str(tmp_path / "pairs"))
    assert sorted(map(tuple, tsv(spark, str(tmp_path / "pairs"), "unmarked string, marked string").collect())) == sorted((a, b) for _, a, b in rows)
    readers.write_batches(df, str(tmp_path / "batches"))
    got = tsv(spark, str(tmp_path / "batches"), "unmarked string, marked string, batch long").select("batch", "unmarked", "marked").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_marked_words_go_back_without_a_shuffle_of_pieces(spark):
    from morae.operators import assemble

    docs = spark.createDataFrame([(1, "αβ, γα αβ\nαβ"), (2, "δ"), (3, ""), (4, None)], "doc_id long, text string")
    marked = spark.createDataFrame([(1, 5, "α^β"), (1, 2, "α_β"), (1, 9, "γα^"), (1, 10, "ζα^"), (1, 11, None)], "doc_id long, pos int, marked string")
    out = assemble.integrated(docs, marked)
    assert dict(map(tuple, out.collect())) == {1: "α_β, γα^ α^β\nαβ", 2: "δ"}
    assert "explode" not in out._jdf.queryExecution().executedPlan().toString()
    known = spark.createDataFrame([("αβ", "α^β"), ("γα", "γα"), ("δ", "δ_")], "token string, marked string")
    out = assemble.annotated(docs, known)
    assert dict(map(tuple, out.collect())) == {1: "α^β, γα α^β\nα^β", 2: "δ_"}
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()


def test_terminated_sentences_of_a_long_tail(spark):
    tail = "a" * 300_000  # letter by letter, each up to the text's end, this took hours
    rows = {"..a.": ["..", "a."], f"a.{tail}": ["a."], tail: [], ".": [], "b\n;c": ["b\n"], "": [], "ab.c;": ["ab.", "c;"]}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    for s, out in df.select("s", t.terminated_sentences(F.col("s"))).collect():
        assert out == rows[s]


def test_open_syllables_of_a_line_by_one_scan(spark):
    from morae.operators import evaluate

    df = spark.createDataFrame([("[να_]{τα^ ν}{ξα^.'}[]{^}[κ{α]{αν}β[ ᾳ_#€·}",), ("[α",), ("",), (None,)], "s string")
    out = df.select(evaluate.open_in_line(F.col("s")).alias("a"), F.coalesce(evaluate.open_count(evaluate.syllables(F.col("s"))), F.lit(-1)).alias("b")).collect()
    assert [r["a"] for r in out[:3]] == [r["b"] for r in out[:3]] == [4, 0, 0]
    from morae.plans.queries import queries

    assert "transform" not in queries()["all_short_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_before_they_are_asked(spark):
    from morae.plans.queries import queries

    for name in ("drop_reason_counts", "lexicon_build_last_wins"):
        assert "hashpartitioning(word" in queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_language_lie_in_several_files(spark, tmp_path, monkeypatch):
    from morae.plans import queries as q

    whole = sorted(map(tuple, q.lines_round_trip(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(q, "scratch", lambda _: str(tmp_path / "out"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, q.lines_round_trip(spark, "/root/testdata/sf0.001").collect())) == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("lang=en/*.txt"))) > 1


def test_next_words_are_found_in_their_row(spark):
    from morae.plans.queries import queries

    assert "Window" not in queries()["next_word_openness"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_open_dichrona_is_one_scan(spark):
    """Counted by one regular expression over the codes, not by rewriting the text class by class."""
    kinds = [chars[0] for chars in p._KINDS.values()] + ["_", "^", " ", "\x0f", "x"]
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product(kinds, repeat=n)] + ["ευ", "κ", "ααιυα_ι", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    steps = F.regexp_count(phonology.classes(c("w")), F.lit(p.coded("D(?!CC)"))).cast("long")
    assert df.where(steps != phonology.open_dichrona(c("w"))).isEmpty()
    plan = df.select(phonology.open_dichrona(c("w")))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan


def test_gold_lines_without_regular_expressions(spark):
    """Brackets are set at once over the letters of many texts, as the patterns would line by line."""
    texts = ["Strata, a b.\nla [x] αβγ", "", None, "aa\n\nα.\n", "th𝔸e b\rα", "\n", "a", "αβ", "ςα ςε jq"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.posexplode(F.split(t.transliterated(c("text")), "\n")).alias("n", "line"))
    line = F.regexp_replace(F.regexp_replace(F.translate("line", "[]{}", ""), "([βγδζθκλμνξπρσςτφχψ]*)([αιυ])", "{$1$2^}"), "([βγδζθκλμνξπρσςτφχψ]*)([εηοω])", "[$1$2_]")
    want = df.select("k", "n", F.concat(F.regexp_replace(line, "α\\^[}]([ .,])", "α_}#$1"), F.lit("€")))
    own = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.posexplode(F.split(gold_text.bracketed(F.lower("text")), "\n")))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))


def test_vowel_scores_make_no_row_of_each_letter(spark):
    df = spark.createDataFrame([("f", "α^β_ι", "α^β^ι_"), ("f", "_αυ", "α__υ^"), ("f", "αβ", "α^γ"), ("f", None, "α^"), ("g", "", ""), ("f", "ι_", "ι_")], "f string, o string, g string")
    out = evaluate.vowel_scores(df, "o", "g", "f")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    kinds = ["short_right", "short_total", "long_right", "long_total"]
    assert {(r["f"], *(r[k] for k in kinds)) for r in out.collect()} == {("f", 1, 3, 1, 3), (None, 1, 3, 1, 3)}


def test_alignment_tries_no_size_beyond_the_block_beside(monkeypatch):
    tried, keys = [], alignment._keys
    monkeypatch.setattr(alignment, "_keys", lambda own, low, high, size: tried.append(int(size.max())) or keys(own, low, high, size))
    line = "".join(f"αβ{chr(0x4E00 + k)}" for k in range(300))
    found = alignment.blocks([line], [line.replace("β", "γ")])
    assert int(found[3].sum()) == 600 and max(tried[20:]) <= 2


def test_words_by_one_scan_and_runs_by_a_set(spark):
    texts = ["".join(chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000), "", None, "a b  a-c 𝔸.d", " . "]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    broken = F.filter(F.split(F.regexp_replace("s", f"[{p.escaped(p.WORD_BREAKS)}]", " "), r"(?U)\s+"), lambda w: w != "")
    assert all(r["a"] == r["b"] for r in df.select(broken.alias("a"), t.word_list(c("s")).alias("b")).collect())
    own = df.select(t.agreeing(F.split("s", "[ -]"), t.word_list(c("s"))).alias("x"))
    assert "array_contains" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.collect()[3]["x"] == ["a", "b", "a", "c"] and own.collect()[2]["x"] is None


def test_syllables_of_a_word_are_asked_once(spark):
    """F16: signs of whole texts, without a row or a lambda a syllable; as the columns say."""
    words = [("λόγος ἄγει κρ τὰ στέρνα ζῷα λό^γο_ς 'αἰ' ξ ἀβγ α β γδ ὦ 1 καὶ".split(" ") * 2,), ([],), (None,), (["κ", "β"],)]
    df = spark.createDataFrame(words, "w array<string>")
    parts = F.flatten(F.transform("w", lambda w: t.let(phonology.syllables(w), lambda own: F.transform(own, lambda s, i: F.struct(s.alias("s"), (i == F.size(own) - 1).alias("last"))))))
    want = t.let(parts, lambda own: F.transform(own, lambda x, i: phonology.open_in_synapheia(x["s"], x["last"], F.get(own, i + 1)["s"])))
    assert all(r["a"] == r["b"] for r in df.select(want.alias("a"), phonology.openness(c("w")).alias("b")).collect())
    from morae.plans.queries import queries

    assert "transform" not in queries()["synapheia"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_texts_are_not_shuffled_for_names(spark):
    """only names that may stand in a text are."""
    from morae.operators import report

    docs = spark.createDataFrame([(1, "α β, α γ"), (2, "β"), (3, None), (4, "α α β")], "k int, t string")
    names = spark.createDataFrame([("α β", 0), ("α", 1)], "name string, ord int")
    out = report.name_places(docs, names, "k", "t")
    assert {r["k"]: [tuple(x) for x in r["places"]] for r in out.collect()} == {1: [(0, 3), (4, 1)], 4: [(0, 1), (2, 3)]}
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()


def test_words_are_dealt_to_all_tasks(spark):
    """adaptive execution counts bytes; a word's work is more than its bytes."""
    from morae.operators import cascade
    from morae.plans import queries

    asked = spark.createDataFrame([("δωρα", "", "X", {})], "token string, lemma string, pos string, morph map<string,array<string>>")
    assert "REPARTITION_BY_NUM" in cascade._dealt(asked.withColumn("id", cascade.key()))._jdf.queryExecution().executedPlan().toString()
    tokens, lex = queries.rival_tokens(spark, "/root/testdata/sf0.001")
    assert all("documents.parquet" not in df._jdf.queryExecution().executedPlan().toString() for df in (tokens, lex))


def test_tokens_are_not_shuffled_and_answers_go_back_a_row_a_document(spark):
    """a document keeps its words as numbers; only its distinct ones meet the answers."""
    from morae.operators import cascade, macronize

    texts = {1: "δῶρα μίν. δῶρα; ἂν ἴῃ δῶρα\nἂν εἰ ἴῃ. ἂν", 2: None, 3: "", 4: "κρ ..", 5: " ".join(f"κ{chr(0x4E00 + k % 300)}{chr(0x4E00 + k // 300)}" for k in range(70_000)) + " δῶρα"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    own = macronize.worded(docs)
    assert {r["doc_id"]: (len(r["words"]), len(r["index"]), r["sizes"]) for r in own.where("doc_id < 5").collect()} == {1: (5, 20, [2, 1, 3, 3, 1]), 2: (0, 0, []), 3: (0, 0, []), 4: (1, 2, [1])}
    tags = macronize.vocabulary(own).select("text", F.lit("x").alias("lemma"), F.lit("X").alias("pos"), F.when(c("text") == "ἴῃ", F.create_map(F.lit("Mood"), F.array(F.lit("Sub")))).otherwise(F.create_map(F.lit("Case"), F.array(F.lit("Acc")))).alias("morph"))
    lexica = cascade.Lexica(custom=spark.createDataFrame([("δῶρα", "δῶρα^", 1)], "form string, marked string, ord int"))
    out = macronize.annotate_words(own, tags, lexica)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    want = {**texts, 1: "δῶρα^ μίν. δῶρα^; ἂ_ν ἴῃ δῶρα^\nἂ^ν εἰ ἴῃ. ἂ^ν", 5: texts[5] + "^"}
    assert got == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    long = macronize.word_tokens(own, tags)
    assert {r["doc_id"]: r["text"] for r in macronize.annotate(docs, long, lexica).collect()} == want


def test_short_blocks_are_found_by_length():
    """in as many steps as there are lengths, however many blocks a line has; the same blocks, ties included."""
    import random

    dice = random.Random(5)
    text = lambda letters, n: "".join(dice.choice(letters) for _ in range(n))
    first = [text("αβ^_ "[: 2 + k % 4], dice.randrange(70)) for k in range(200)] + ["", "α", "αβ" * 200]
    second = [x[: len(x) // 2] + text("α^", k % 3) + x[len(x) // 2 + k % 5 :] if k % 4 else text("αβ_", 50) for k, x in enumerate(first)]
    want = sorted(zip(*(x.tolist() for x in alignment.blocks(first, second)), strict=True))
    for short in (1, 3, 4, 24):
        assert sorted(zip(*(x.tolist() for x in alignment.blocks(first, second, short)), strict=True)) == want


def test_long_lines_of_short_blocks_take_few_steps(monkeypatch):
    """blocks of equal length were one round each."""
    asked, shared = [], alignment._shared
    monkeypatch.setattr(alignment, "_shared", lambda keys, others: asked.append(1) or shared(keys, others))
    gold = "".join(f"{x}ο_" for x in itertools.islice(map("".join, itertools.product("βγδζθκλμν", repeat=3)), 400))
    evaluated = evaluate.aligned(pd.Series([gold.replace("_", "")]), pd.Series([gold]))
    assert evaluated.values.tolist() == [[400, 0]] and len(asked) < 10


def test_lines_and_their_output_are_spelled_at_once(spark):
    """as the columns spell them, out of lines with brackets."""
    texts = ["Strata, a b.\nla [x]# αβγ_", "", None, "aa\n\n_α.^€\n", "th𝔸e b\rα"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    g = F.translate(gold_text.bracketed(F.lower("text")), "[]{}#€", "")
    o = F.regexp_replace(F.translate(g, "_^", ""), "([αι])", "$1^")
    got = df.select(g.eqNullSafe(gold_text.marked(F.lower("text"))).alias("g"), o.eqNullSafe(gold_text.alpha_iota_short(F.lower("text"))).alias("o"))
    assert all(r["g"] and r["o"] for r in got.collect())


def test_success_rates_read_texts_once(spark, tmp_path):
    """no line leaves Python, and texts are dealt before they are asked; a mark at the beginning of a line stands behind no letter."""
    texts = ["β\n_βα. υ\n^ι_", "ε^\n_", "κρ", None, "_ω"]
    rows = [(k, "el" if k < 4 else "la", x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from morae.plans import queries

    out = queries.success_rates(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Generate" not in plan
    kinds = ["short_right", "short_total", "long_right", "long_total"]
    got = {(r["file"], *(r[k] for k in kinds)) for r in out.collect()}
    own = queries.scored_lines(spark, str(tmp_path))
    assert got == {(r["file"], *(r[k] for k in kinds)) for r in evaluate.vowel_scores(own, "o", "g", "file").collect()} == {("el", 1, 2, 0, 2), ("la", 0, 0, 0, 1), (None, 1, 2, 0, 3)}


def test_lines_are_aligned_where_they_are_spelled(spark):
    """neither lines nor outputs leave the worker."""
    from morae.plans import queries

    out = queries.alignment_score(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "split" not in plan
    want = queries.scored(evaluate.alignment, spark, "/root/testdata/sf0.001")
    assert out.columns == want.columns and out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_common_letters_are_refused_before_marks_are_asked():
    """a text's letters were asked one by one for each letter that has no canonical composition."""
    import unicodedata

    from morae.functions import normal

    for also in (normal.unmade(), normal.unmade() + normal.LONG_LETTERS):
        free = [(low, high) for low, high in normal._COMMON if f"[^\\x{{{low:x}}}-\\x{{{high:x}}}]&&" in normal._rare(also)]
        assert normal._rare(also).endswith(rf"[\p{{M}}{also}]]") and (free or also != normal.unmade())
        refused = {ch for low, high in free for ch in map(chr, range(low, high + 1))}
        assert not refused & set(also) and not any(unicodedata.category(ch).startswith("M") for ch in refused)


def test_rules_of_letters_ask_for_the_letter_first(spark):
    """borders of words were asked at every letter."""
    from morae.plans import queries

    df = spark.createDataFrame([("of OF to. is,ko οφ_ aοφ οφ́ ́οφ 'το' sko ab cab us as s a la b e a kilon amon",)], "s string")
    out = df.select(queries.polytonic(c("s")).alias("o"))
    assert "(?U)\\b" not in out._jdf.queryExecution().optimizedPlan().toString()
    old = [(r"(?U)\bοφ\b", "ἄλλα"), (r"(?U)\bτο\b", "ἄν"), (r"(?U)\bισ\b", "εἰ")]
    new = [(r"(?U)οφ(?<=\bοφ)\b", "ἄλλα"), (r"(?U)το(?<=\bτο)\b", "ἄν"), (r"(?U)ισ(?<=\bισ)\b", "εἰ")]
    greek = df.select(F.translate("s", queries.x.LATIN_BOTH, queries.x.GREEK_BOTH).alias("s"))
    assert greek.select((t.replaced(c("s"), old) == t.replaced(c("s"), new)).alias("same")).first()["same"]


def test_module_totals_store_no_texts(spark, monkeypatch):
    """they need the words only, each once."""
    from morae.operators import macronize
    from morae.plans import queries

    docs = queries.polytonic_docs(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([(-1, None), (-2, "..;"), (-3, "")], "doc_id long, text string"))
    want = sorted(r["text"] for r in macronize.vocabulary(macronize.worded(docs)).collect())
    for known in (macronize.KNOWN, 3):
        monkeypatch.setattr(macronize, "KNOWN", known)
        assert sorted(r["text"] for r in macronize.words_of(docs).collect()) == want
    assert "macronize.words_of" in inspect.getsource(queries.module_totals)
