"""Spelling variants, centroid clustering and the quality classifier against brute force, with nulls, ties and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morae.llm import centroids, quality_net, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n string, `key` string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, "x", "y", "z") for d, t in rows], DOCS).repartition(3)


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


# ----------------------------------------------------------------------------------------------------------- spelling


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    bag = [w for k, w in enumerate(stems) for _ in range(1 + 60 // (k + 1))]
    for w in stems[:40]:
        for _ in range(4):
            k = rng.randrange(len(w))
            bag += [rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ×") + w[k:], w[:k] + "e" + w[k + 1 :], w.upper(), w.capitalize()])] * rng.randint(1, 4)
    long = "".join(rng.choice("xyz") for _ in range(400))
    rows: list[tuple[int | None, str | None]] = [(k, rng.choice([" ", ", ", "1", "\n", "日"]).join(rng.choice(bag) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "  "), (903, "Ā Ă"), (None, "gleich gleich gleich"), (904, f"{long} {long} {long}"), (905, f"{long}a {long}a {long}a {long[1:]} {long[1:]} {long[1:]}")]
    rows += [(950, "abcdefgh " * 24 + "abcdefg " * 8 + "abcdef " * 3)]  # a path of two steps
    return rows + rows[:5]  # repeated rows


def spelled(rows) -> list[tuple]:
    count: Counter[str] = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                count[word] += 1
    words = {w: n for w, n in count.items() if n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        if own and words[best := min(own, key=lambda v: (-words[v], v))] >= 2 * words[w]:
            form[w] = best

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


@pytest.mark.parametrize(("shard", "round_"), [(spelling.SHARD, spelling.ROUND), (60, 4000)])
def test_spelling_variants(spark, shard, round_):
    rows = texts()
    got = spelling.grouped(frame(spark, rows), shard, round_)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = spelled(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[2] not in (x[0], x[1]) for x in want)


def test_tries_hold_all_neighbours_once():
    rng = random.Random(5)
    for _ in range(40):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 90))})
        asked = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(40)})
        trie = spelling.Trie.unpacked(spelling.Trie.of(spelling.Letters.of(words, np.ones(len(words), int))).packed())
        pairs = [(asked[a], words[b]) for w, t in spelling.near(trie, spelling.Letters.of(asked, np.ones(len(asked), int))) for a, b in zip(w, t, strict=True)]
        assert sorted(pairs) == sorted((a, b) for a in asked for b in words if one_edit(a, b))


def test_checksums_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3500, 200)
    ends = starts + rng.integers(0, 200, 200)
    before = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    assert spelling.checksums(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(x)) for a, b, x in zip(starts, ends, before, strict=True)]


def test_long_paths_lead_to_their_root(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(21)], "word string, form string")
    assert {tuple(r) for r in spelling.rooted(links).collect()} == {(f"w{k}", "w21") for k in range(21)}


# ---------------------------------------------------------------------------------------------------------- centroids


def lloyd(rows, clusters=16, dimensions=64, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in order[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, m), k) for k, m in enumerate(middle))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        middle = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else m for k, m in enumerate(middle)]
    total = Counter()
    for _, v in kept:
        total[nearest(v)[1]] += nearest(v)[0]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, nearest(v)[1], long(nearest(v)[0]), long(total[nearest(v)[1]]), long(total.total()), digest[nearest(v)[1]]) for i, v in kept), key=repr)


def vectors(scale: float) -> list[tuple[int | None, list | None]]:
    rng = random.Random(8)
    rows: list[tuple[int | None, list | None]] = [(k, [scale * rng.gauss(0, 1) for _ in range(64)]) for k in range(60)]
    rows += [(100 + k, list(rows[7][1])) for k in range(120)]  # one vector in many rows
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [math.nan] * 64), (306, [math.inf] + [0.0] * 63), (None, [0.25] * 64)]
    return rows + rows[:4]


@pytest.mark.parametrize("scale", [0.2, 3e4, 1e9])
def test_centroid_clustering(spark, scale):
    rows = vectors(scale)
    table = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(3)
    for hot in (centroids.HOT, 3):
        got = centroids.clustered(table, hot=hot)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows)


def test_few_or_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>"
    assert centroids.query(spark.createDataFrame([], ddl)).collect() == []
    assert centroids.query(spark.createDataFrame([(1, [1.0])], ddl)).collect() == []
    rows = [(k, [float(k % 3)] * 64) for k in range(7)]
    assert sorted((tuple(r) for r in centroids.query(spark.createDataFrame(rows, ddl)).collect()), key=repr) == lloyd(rows)


def test_components_beyond_64_bits_are_held(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    got = {r["vec_id"]: r for r in centroids.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 3 and len({r["cluster"] for r in got.values()}) == 3 and {r["distance"] for r in got.values()} == {0}


# --------------------------------------------------------------------------------------------------------- classifier


def read(text: str | None) -> list[str]:
    return re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\u0080-\U0010ffff\x20\x09-\x0D]+", text or "")


def test_vectors_and_pooling_by_hand(spark):
    rng = random.Random(6)
    words = ["the", "The", "é1", "***", "mot", "a"]
    rows = [(k, rng.choice([" ", "\n", ""]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(20)] + [(50, None), (51, ""), (None, "the the"), (3, "the mot"), (3, "the mot")]
    own = {}

    def hashed(word):
        if word not in own:
            h, _ = quality_net.tokens(pa.array([word]))
            assert len(h) == 1
            own[word] = (int(h[0]) % quality_net.ROWS, quality_net.places(h)[0].tolist())
        return own[word]

    table = np.zeros((quality_net.ROWS, quality_net.DIMENSIONS))
    for _, text in rows:
        w = read(text)
        for i in range(len(w)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    for k, place in enumerate(hashed(w[j])[1]):
                        table[hashed(w[i])[0], place] += 1 if k < 2 else -1
    norm = np.sqrt((table**2).sum(1, keepdims=True))
    table = table / np.maximum(norm, 1)
    docs = frame(spark, rows)
    got = quality_net.word_vectors(docs)
    assert np.allclose(got, table, atol=1e-6) and np.abs(got).sum() > 0
    features = quality_net.pooled(got, pa.array([t or "" for _, t in rows]))
    for (_, text), x in zip(rows, features, strict=True):
        v = np.array([table[hashed(w)[0]] for w in read(text)]).reshape(-1, quality_net.DIMENSIONS)
        n = max(len(v), 1)
        want = np.concatenate([v.sum(0) / n, (v * v).sum(0) / n, (v[1:] * v[:-1]).sum(0) / max(len(v) - 1, 1)])
        assert np.allclose(x, want, atol=1e-5)


def test_long_texts_are_pooled_in_blocks(monkeypatch):
    table = np.random.default_rng(2).normal(size=(quality_net.ROWS, quality_net.DIMENSIONS)).astype(np.float32)
    own = pa.array(["a b c d e f g", "", "x", "a b " * 20])
    want = quality_net.pooled(table, own)
    monkeypatch.setattr(quality_net, "BLOCK", 3)
    assert np.allclose(quality_net.pooled(table, own), want, atol=1e-5)


def test_classifier_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality_net.query(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    own = [(r["score"], mark[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in mark]
    good, bad = [s for s, y in own if y], [s for s, y in own if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    entropy = -np.mean([math.log(s if y else 1 - s) for s, y in own])
    share = len(good) / len(own)
    assert entropy < -(share * math.log(share) + (1 - share) * math.log(1 - share)) / 2


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    scores = [sorted((r["doc_id"], r["score"]) for r in quality_net.query(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_labels_and_texts(spark):
    rows = [(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "x"), (4, "BAD!! BAD!!")]
    docs = frame(spark, rows)
    ddl = "doc_id long, quality int, toxic int, text string"
    for labels in ([], [(1, None, 0, ""), (None, 1, 0, ""), (4, 7, 0, "")], [(k, 1, 0, "") for k in range(9)], [(1, 1, 0, ""), (1, 0, 0, ""), (1, 1, 1, ""), (4, 0, 0, ""), (3, 0, 0, ""), (2, 1, 0, "")]):
        got = quality_net.query(docs, spark.createDataFrame(labels, ddl)).collect()
        assert len(got) == 6 and all(0 < r["score"] < 1 for r in got) and sum(r["doc_id"] == 1 for r in got) == 2
    assert quality_net.query(docs.limit(0), spark.createDataFrame([], ddl)).collect() == []
