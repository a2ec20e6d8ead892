"""Sources and sinks, each written and read again."""

import struct
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from morae.functions import text
from morae.operators import lexicon
from morae.sources import annotations, lines, readers, tei


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("α\nβ\n\nγ")
    (tmp_path / "b.txt").write_text("δ")
    (tmp_path / "c.md").write_text("no")
    assert {r["file"]: r["text"] for r in readers.text_file(spark, str(tmp_path / "a.txt")).collect()} == {"a.txt": "α\nβ\n\nγ"}
    got = sorted(tuple(r) for r in readers.text_folder(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 0, "α"), ("a.txt", 1, "β"), ("a.txt", 2, ""), ("a.txt", 3, "γ"), ("b.txt", 0, "δ")]
    assert sorted(r["line"] for r in readers.lines_from(spark, str(tmp_path / "a.txt"), 2).collect()) == ["", "γ"]


def test_stardict(spark, tmp_path):
    words = [("λόγος", 0, 7), ("φύσις", 7, 300)]
    (tmp_path / "x.idx").write_bytes(b"".join(w.encode() + b"\0" + struct.pack(">II", a, b) for w, a, b in words))
    assert sorted(tuple(r) for r in readers.stardict_index(spark, str(tmp_path / "x.idx")).collect()) == words


def test_lexicon_from_a_path(spark, tmp_path):
    spark.createDataFrame([("ab", "a^b")], "form string, marked string").write.parquet(str(tmp_path / "lex"))
    assert lexicon.read(spark, str(tmp_path / "lex")).first()["marked"] == "a^b"


def test_sinks(spark, tmp_path):
    rows = [(0, "αβ", "α^β", 0, 3, 4, "custom", "αβ"), (1, "γι", "γι", 1, 5, 6, "lsj", "γι")]
    df = spark.createDataFrame(rows, "batch int, unmarked string, marked string, left int, numerator int, denominator int, module string, token string")
    at = lambda name: str(tmp_path / name)
    tsv = lambda name: sorted(tuple(r) for r in spark.read.csv(at(name), sep="\t").collect())
    readers.write_text(df, at("text"), "marked")
    assert sorted(r["value"] for r in spark.read.text(at("text")).collect()) == ["α^β", "γι"]
    readers.write_pairs(df, at("pairs"))
    readers.write_pairs(df.limit(0), at("pairs"))
    assert tsv("pairs") == [("αβ", "α^β"), ("γι", "γι")]
    readers.write_pairs(df, at("perfect"), perfect="left")
    assert tsv("perfect") == [("αβ", "α^β")]
    readers.write_batches(df, at("batches"))
    assert tsv("batches") == [("αβ", "α^β", 0), ("γι", "γι", 1)]
    readers.write_stats(df, at("stats"))
    assert tsv("stats") == [("0", "3", "4"), ("1", "5", "6")]
    for run in ("r1", "r2"):
        readers.write_residue(df.select("token", "left"), at("residue"), run)
    assert sorted(x[2] for x in tsv("residue")) == ["r1", "r1", "r2", "r2"]
    readers.write_hits(df, at("hits"))
    assert sorted((r["module"], r["value"]) for r in spark.read.text(at("hits")).collect()) == [("custom", "αβ"), ("lsj", "γι")]


def test_definitions(spark):
    df = spark.createDataFrame([('[{"definition": "x [y] z"}, {"definition": "no"}]',), ("[]",)], "j string")
    own = df.select(readers.first_definition(F.col("j")).alias("d"))
    assert [(r["d"], r["b"]) for r in own.select("d", readers.first_bracket(F.col("d")).alias("b")).collect()] == [("x [y] z", "y"), (None, None)]


def test_tokens_that_both_sides_know(spark):
    df = spark.createDataFrame([("α β α γ", "α γ")], "a string, b string")
    assert df.select(text.agreeing(F.split("a", " "), F.split("b", " ")).alias("x")).first()["x"] == ["α", "α", "γ"]


# ------------------------------------------------------------------------------------------------------------------ TEI

EDITIONS = {
    "plain": ("<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body><p>α<hi>β</hi> γ</p><p><label type='head'>no</label>δ</p><lg><l>ε ζ </l><l> η</l></lg></body></text></TEI>", "αβ γ ε ζ η"),
    "references": ("<TEI><text><body><p>a &#945;&#x3b2; &lt;b&gt; &amp; c</p></body></text></TEI>", "a αβ <b> & c"),
    "comments": ("<TEI><text><body><p>a <!-- c <p> --> b</p></body></text></TEI>", "a  b"),
    "cdata": ("<TEI><text><body><p>a<![CDATA[x & <y>]]>b</p></body></text></TEI>", "ax & <y>b"),
    "nested": ("<TEI><text><body><p><hi><p>in</p></hi> out</p></body></text></TEI>", "in out in"),
    "labels deeper down": ("<TEI><text><body><p><hi><label type='head'>yes</label></hi> a</p><p><label type='other'>b</label></p></body></text></TEI>", "yes a b"),
    "verse after prose": ("<TEI><text><body><l>v</l><p>p</p></body></text></TEI>", "p v"),
    "only the body": ("<TEI><teiHeader><p>no</p></teiHeader><text><front><p>no</p></front><body><head>no</head><p>yes</p></body><back><l>no</l></back></text></TEI>", "yes"),
    "entity": ("<!DOCTYPE TEI [<!ENTITY who 'αὐτός'>]><TEI><text><body><p>&who;</p></body></text></TEI>", "αὐτός"),
    "prefixes": ("<t:TEI xmlns:t='http://www.tei-c.org/ns/1.0'><t:text><t:body><t:p>a</t:p></t:body></t:text></t:TEI>", "a"),
    "empty": ("<TEI><text><body><p> \n </p></body></text></TEI>", ""),
    "no body": ("<TEI/>", ""),
    "broken": ("<TEI><text><body><p>a</body></text></TEI>", None),
    "not XML": ("α < β", None),
    "null": (None, None),
}


def test_editions(spark):
    rows = [(name, xml) for name, (xml, _) in EDITIONS.items()]
    got = {r["name"]: (r["text"], r["problem"]) for r in spark.createDataFrame(rows, "name string, xml string").select("name", tei.tei_text(F.col("xml")).alias("t")).select("name", "t.*").collect()}
    for name, (xml, want) in EDITIONS.items():
        assert got[name][0] == want, name
        assert (got[name][1] is not None) == (name in ("broken", "not XML")), name


def test_folder_of_editions_in_their_encodings(spark, tmp_path):
    own = "<TEI><text><body><p>é{}</p></body></text></TEI>"
    for k, encoding in enumerate(("utf-8", "iso-8859-1", "utf-16")):
        (tmp_path / f"{k}.xml").write_bytes(f"<?xml version='1.0' encoding='{encoding}'?>{own.format(k)}".encode(encoding))
    (tmp_path / "3.xml").write_text("<?xml version='1.0' encoding='klingon'?><TEI/>")
    (tmp_path / "4.txt").write_text("no")
    got = {r["file"].rpartition("/")[2]: r["text"] for r in tei.read_tei(spark, str(tmp_path)).collect()}
    assert got == {"0.xml": "é0", "1.xml": "é1", "2.xml": "é2", "3.xml": None}


def test_wrapped_documents_against_another_parser(spark):
    from morae.plans import queries

    def texts(node):
        return node.data if node.nodeType in (node.TEXT_NODE, node.CDATA_SECTION_NODE) else "".join(map(texts, node.childNodes))

    rows = queries.tei_documents(spark, "/root/testdata/sf0.001").select("doc_id", "xml", tei.tei_text(F.col("xml")).alias("t")).select("doc_id", "xml", "t.*").collect()
    assert len(rows) == 200
    for r in rows:
        body = minidom.parseString(r["xml"].encode()).getElementsByTagName("body")[0]
        own = [p for p in body.getElementsByTagName("p") if not any(x.nodeName == "label" for x in p.childNodes)] + body.getElementsByTagName("l")
        assert r["text"] == " ".join(x for x in (texts(p).strip() for p in own) if x) and r["problem"] is None


# ---------------------------------------------------------------------------------------------------------------- lines


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def folder(tmp_path):
    """A file of many splits with all kinds of line ends, and small ones."""
    body = "".join(f"line {k} {'α' * (k % 90)}{end}" for k, end in zip(range(1500), ["\n", "\r\n", "\n", "\n\n", "\r"] * 300, strict=True))
    (tmp_path / "large.txt").write_bytes(body.encode())
    (tmp_path / "tail.txt").write_bytes(b"a\nb")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "one.txt").write_bytes(b"\n")
    want = []
    for path in sorted(tmp_path.glob("*.txt")):
        with path.open(encoding="utf-8") as file:
            want += [(path.name, k, x.rstrip("\n")) for k, x in enumerate(file.readlines())]
    return want


def test_lines_over_several_splits(spark, tmp_path, small_splits):
    want = folder(tmp_path)
    own = lines.numbered(spark, str(tmp_path), "*.txt")
    assert spark.read.text(str(tmp_path / "large.txt")).rdd.getNumPartitions() > 10
    name = F.substring_index("file", "/", -1).alias("file")
    assert sorted(tuple(r) for r in own.select(name, "line_no", "line").collect()) == sorted(want)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "RepartitionByExpression" not in plan
    assert sorted(tuple(r) for r in readers.lines_from(spark, str(tmp_path / "large.txt"), 1400).collect()) == sorted(x for x in want if x[0] == "large.txt" and x[1] >= 1400)


def test_resumed_lines(spark, tmp_path, small_splits):
    want, store, path = folder(tmp_path), str(tmp_path / "marks"), str(tmp_path)
    name = F.substring_index("file", "/", -1).alias("file")
    left = lambda: sorted(tuple(r) for r in lines.resumed(spark, path, store, "*.txt").select(name, "line_no", "line").collect())
    assert left() == sorted(want)
    first = lines.resumed(spark, path, store, "*.txt").where("line_no < 700")
    for _ in range(2):  # a mark that is made twice does no harm
        lines.mark_done(first, store)
    assert left() == sorted(x for x in want if x[1] >= 700)
    lines.mark_done(lines.resumed(spark, path, store, "large.txt").withColumn("finished", F.lit(True)), store)
    (tmp_path / "tail.txt").write_bytes(b"a\nb\nc")
    assert left() == [("tail.txt", 2, "c")]


# ---------------------------------------------------------------------------------------------------------------- store


def tagger(asked):
    def tagged(docs):
        asked.append(docs.count())
        own = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("tok_id", "text")).where("text <> ''")
        return own.select("doc_id", F.lit(0).alias("sent_id"), "tok_id", "text", F.upper("text").alias("lemma"), F.lit("X").alias("pos"), F.create_map(F.lit("Case"), F.array(F.lit("Nom"))).alias("morph"))

    return tagged


def stored(spark, path):
    return [r["key"] for r in annotations.read_store(spark, path).collect()]


def test_annotations_are_stored_once(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []
    docs = spark.createDataFrame([(1, "λόγος καὶ φύσις"), (2, "ἀνήρ"), (3, "λόγος καὶ φύσις"), (4, ""), (5, None)], "doc_id long, text string")
    first = annotations.annotated(docs, tagger(asked), path, buckets=4)
    want = {(1, "λόγος"), (1, "καὶ"), (1, "φύσις"), (3, "λόγος"), (3, "καὶ"), (3, "φύσις"), (2, "ἀνήρ")}
    assert {(r["doc_id"], r["text"]) for r in first.collect()} == want and [r["tok_id"] for r in first.where("doc_id = 1").orderBy("tok_id").collect()] == [0, 1, 2]
    assert asked == [3] and len(stored(spark, path)) == len(set(stored(spark, path))) == 3
    files = sorted(tmp_path.glob("store/*/*.parquet"))
    again = annotations.annotated(docs, tagger(asked), path, buckets=4)
    assert {(r["doc_id"], r["text"]) for r in again.collect()} == want
    assert asked == [3] and sorted(tmp_path.glob("store/*/*.parquet")) == files  # nothing annotated, nothing written
    annotations.annotated(docs.limit(2), tagger(asked), path, reuse=False, buckets=4).collect()
    assert asked == [3, 2] and len(stored(spark, path)) == len(set(stored(spark, path))) == 3


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda keys: spark.createDataFrame([(k, []) for k in keys], f"key string, tokens {annotations.TOKENS}")
    assert annotations.add(rows([f"k{i}" for i in range(40)]), path, buckets=8) == 40
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("store/bucket=*/*.parquet")}
    assert annotations.add(rows(["new", "new", "k3"]), path, buckets=8) == 1
    after = {f: f.stat().st_mtime_ns for f in tmp_path.glob("store/bucket=*/*.parquet")}
    assert len({f.parent for f in after} - {f.parent for f in after if f in before}) == 1 and sum(f in before for f in after) == 7
    assert sorted(stored(spark, path)) == sorted([*(f"k{i}" for i in range(40)), "new"])


def test_a_run_that_breaks_off_leaves_the_store_whole(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []
    docs = spark.createDataFrame([(k, f"λόγος {'α' * k}") for k in range(1, 20)], "doc_id long, text string").repartition(4)
    annotations.annotated(docs.where("doc_id < 5"), tagger(asked), path, buckets=4).collect()

    def lost(own):
        return tagger(asked)(own).withColumn("lemma", F.when(F.length("text") == 12, F.raise_error(F.lit("lost"))).otherwise(F.col("lemma")))

    with pytest.raises(Exception, match="lost"):
        annotations.annotated(docs, lost, path, buckets=4).collect()
    assert len(stored(spark, path)) == 4
    out = annotations.annotated(docs, tagger(asked), path, buckets=4)
    assert out.count() == 38 and len(stored(spark, path)) == len(set(stored(spark, path))) == 19
    assert asked == [4, 15, 15]


def test_reconciled_sinks(spark, tmp_path):
    own = spark.range(100).selectExpr("id", "CAST(id AS STRING) AS unmarked", "CAST(id AS STRING) AS marked").repartition(5)
    at = lambda name: lambda df: readers.write_pairs(df, str(tmp_path / name))
    assert readers.write_reconciled(own, lambda df: df.withColumn("marked", F.lit("x")), at("a")) == (100, 100)
    with pytest.raises(readers.Unequal, match="100 rows in, 90 rows out"):
        readers.write_reconciled(own, lambda df: df.where("id >= 10"), at("b"))
    with pytest.warns(UserWarning, match="100 rows in, 200 rows out"):
        assert readers.write_reconciled(own, lambda df: df.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), at("c"), strict=False) == (100, 200)
    assert spark.read.csv(str(tmp_path / "a"), sep="\t").count() == 100
