"""The operators against brute force, exact round trips and held-out accuracy, with nulls, ties and odd texts."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morae.llm import common as c
from morae.llm import html_crf, jaccard, jpeg, licenses, line_dedup, mixing_lm, packing, quality, sentencepiece_codec, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_rank` string, bucket string"


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))

    base = prose(160)
    texts = [None, "", " \n\t", "one", "a b c d e", "A b C d e", base, base, base.replace(" ", "  ", 3), prose(3000)]
    for _ in range(12):
        own = base.split(" ")
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    passage = prose(60)
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(8)]
    texts += ["spam " * 200, "x" * 3000, "日本 語 ꙮ é ́x", "a\nb\na\nb\n\n", "The quick brown fox jumps over the lazy dog tonight", "The quick brown fox jumps over the lazy dig tonight", "the quick brown fox jumps over the lazy dogs tonight!"]
    return list(enumerate(texts))


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", None if d % 5 == 0 else f"s{d % 2}", None if t is None else len(t), "x", "y") for d, t in CORPUS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("module", [licenses, quality, mixing_lm, line_dedup, jpeg, packing, substrings, jaccard])
def test_empty_table(empty, module):
    assert module.query(empty).collect() == []


def test_sentencepiece(docs):
    got = by_id(sentencepiece_codec.digests(docs))
    library = sentencepiece_codec._codec(None).library
    for d, text in CORPUS:
        ids = library.encode(text or "", add_eos=True)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_packing(docs):
    got = packing.query(docs).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {}
    for d, text in CORPUS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[d, k] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_plan_replaces_the_smallest_by_a_tighter_pair():
    # greedily 60 + 30 leaves 10; 30 gives way to 22 + 18, which fill the bin
    plan = packing.plan({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    assert plan[0] == (1, [60, 22, 18])
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 2048) for _ in range(5000))
    bins = packing.plan(histogram)
    used = Counter()
    for n, own in bins:
        assert sum(own) <= 2048
        for x in own:
            used[x] += n
    assert used == histogram and sum(n for n, _ in bins) <= 1.02 * sum(k * v for k, v in histogram.items()) / 2048 + 1


def test_jpeg_round_trip(docs):
    got = by_id(jpeg.query(docs))
    streams = {r["doc_id"]: bytes(r["media"]) for r in jpeg.images(docs).collect()}
    for d, text in CORPUS:
        payload = (text or "").encode()
        n = len(payload)
        payload += bytes(max(64, -(-n // 64) * 64) - n)
        assert (got[d]["n_bytes"], got[d]["payload_bytes"]) == (n, len(payload))
        assert got[d]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[d]["tail_crc32"] == zlib.crc32(payload[-64:])
        assert got[d]["media_sha256"] == hashlib.sha256(streams[d]).hexdigest() and streams[d][:2] == b"\xff\xd8"
    assert got[6]["feature"] == got[7]["feature"]
    long = pa.array(["é\x00" * 320_000])
    assert jpeg.media(long)["payload_sha256"][0] == hashlib.sha256(long[0].as_py().encode()).hexdigest()
    with pytest.raises(ValueError):
        jpeg.read([b"\xff\xd8\xff\xc2\x00\x04\x00\x00"])


#: Fixed value: a 16x16 colour image of an outside encoder (python.jpg of CPython's test data), colour halved both ways.
OUTSIDE = base64.b64decode(
    "/9j/4AAQSkZJRgABAQEAAQABAAD/2wBDAAMCAgICAgMCAgIDAwMDBAYEBAQEBAgGBgUGCQgKCgkICQkKDA8MCgsOCwkJDRENDg8QEBEQCgwSExIQEw8QEBD/2wBDAQMDAwQDBAgEBAgQ"
    "CwkLEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBAQEBD/wAARCAAQABADASIAAhEBAxEB/8QAFgABAQEAAAAAAAAAAAAAAAAABwQF/8QAJBAAAQQB"
    "BAICAwAAAAAAAAAAAQIDBAYFBwgSExEiABQJMTL/xAAVAQEBAAAAAAAAAAAAAAAAAAAABv/EACMRAAECBQMFAAAAAAAAAAAAAAECEQMEBQYhABIxFRZhgeH/2gAMAwEAAhEDEQA/ABSm"
    "0mobc8HmExLUlRzzEWPkJWW+ulrsaUVAseUgslSlH9LKuPryIKuWPZdskzXmm3fX5m2nF4GlVxx/HOpx4ks51+MiU/Iaad7UcUo4tILoS4kqcWkezS0hO/HvuRp0rO6hWnWO1UisZVuF"
    "i4GFeyEpmGepa5S5SWVPuciFKRFLgSrwetnyPIB+Vb4N9mKhQMzo5po9XLdDs9d6ZVix2VEhiL9kuNPxw2gEKcDQ/rs8AuA8VAe0vdl7VOYn+27flGAUgmITjbhSmCg3BYlyeWDkMolv"
    "w4KOp1KM6iCNvngZHwetf//Z"
)


def test_jpeg_reads_an_outside_encoder():
    # mean luminance of the four blocks of the same picture in python.png: 87.83, 78.70, 108.12, 111.88
    assert [(w, h, x.tolist()) for w, h, x in jpeg.read([OUTSIDE])] == [(16, 16, [88, 79, 108, 112])]


def encoded(rng: random.Random, width: int, height: int, factors: list[tuple[int, int]], interval: int, apart: bool = False) -> tuple[bytes, list[int]]:
    """A baseline stream with random DC and AC values, written bit by bit, and the samples that its luminance must give."""
    dc, ac = list(range(12)), [0, 0xF0, 0x01, 0x12, 0x23, 0x35, 0x61, 0xA4]
    counts = {0: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 1: [0, 1, 2, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]}
    codes = {k: jpeg._codes(counts[k], x) for k, x in ((0, dc), (1, ac))}
    most = (max(h for h, _ in factors), max(v for _, v in factors))
    full = (-(-width // (8 * most[0])), -(-height // (8 * most[1])))
    seen: dict[tuple[int, int], int] = {}

    def block(part: int, x: int, y: int, before: list[int]) -> str:
        value = rng.randint(-200, 200)
        if part == 0:
            seen[y, x] = value
        d = value - before[part]
        before[part] = value
        size = abs(d).bit_length()
        out = [format(codes[0][size][0], f"0{codes[0][size][1]}b"), format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else ""]
        left = 63
        while left > 0:
            symbol = rng.choice([x for x in ac if x == 0 or (x >> 4) < left])
            code, n = codes[1][symbol]
            out.append(format(code, f"0{n}b") + "".join(rng.choice("01") for _ in range(symbol & 15)))
            left -= 64 if symbol == 0 else (symbol >> 4) + 1
        return "".join(out)

    def scan(parts: list[int]) -> bytes:
        if len(parts) == 1:
            h, v = factors[parts[0]]
            units = (-(-(-(-width * h // most[0])) // 8), -(-(-(-height * v // most[1])) // 8))
            places = [(0, 0, 0)]
        else:
            units, places = full, [(k, x, y) for k in range(len(parts)) for y in range(factors[k][1]) for x in range(factors[k][0])]
        out, bits, before = b"", "", [0] * len(factors)
        for n in range(units[0] * units[1]):
            for k, x, y in places:
                h, v = factors[k] if len(parts) > 1 else (1, 1)
                bits += block(parts[k], n % units[0] * h + x, n // units[0] * v + y, before)
            last = n + 1 == units[0] * units[1]
            if last or interval and (n + 1) % interval == 0:
                bits += "1" * (-len(bits) % 8)
                out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
                if not last:
                    out += bytes([0xFF, 0xD0 + (n + 1) // interval % 8 - 1 if (n + 1) // interval % 8 else 0xD7])
                bits, before = "", [0] * len(factors)
        return jpeg._segment(0xDA, bytes([len(parts), *(x for k in parts for x in (k + 1, 0)), 0, 63, 0])) + out

    head = b"\xff\xd8" + jpeg._segment(0xFE, b"a comment") + jpeg._segment(0xDB, b"\0" + bytes([4] * 64))
    frame = struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors))
    tables = b"".join(jpeg._segment(0xC4, bytes([k << 4, *counts[k], *x])) for k, x in ((0, dc), (1, ac)))
    everyone = list(range(len(factors)))
    data = head + jpeg._segment(0xC0, frame) + tables + (jpeg._segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    data += b"".join(scan([k]) for k in everyone) if apart else scan(everyone)
    samples = [seen[y, x] for y in range(-(-height // 8)) for x in range(-(-width // 8))]
    return data + b"\xff\xff\xd9", [min(255, max(0, round(x * 4 / 8) + 128)) for x in samples]


def test_jpeg_reads_colour_and_ac_codes(spark):
    rng = random.Random(11)
    shapes = [([(1, 1)], False), ([(2, 2)], False), ([(1, 1)] * 3, False), ([(2, 1), (1, 1), (1, 1)], False), ([(2, 2), (1, 1), (1, 1)], False), ([(2, 2), (1, 1), (1, 1)], True), ([(1, 2), (1, 1), (1, 2)], False)]
    images = [(w, h, *encoded(rng, w, h, factors, interval, apart)) for factors, apart in shapes for w, h in ((1, 1), (33, 17), (40, 56)) for interval in (0, 2)]
    got = jpeg.read([x for _, _, x, _ in images])
    assert [(w, h, x.tolist()) for w, h, x in got] == [(w, h, x) for w, h, _, x in images]
    broken = [images[4][2][:-9], images[4][2].replace(b"\xff\xc0", b"\xff\xc2"), b"", b"text", OUTSIDE[:300], OUTSIDE.replace(bytes([1, 0x22, 0, 2]), bytes([82, 0x22, 0, 71]))]
    for data in broken:
        with pytest.raises(ValueError):
            jpeg.read([data])
    streams = [*enumerate(x for _, _, x, _ in images), (100, None), *enumerate(broken, 101), (5, images[5][2])]
    rows = jpeg.described(spark.createDataFrame([(d, x, "x") for d, x in streams], "doc_id long, media binary, width string").repartition(3)).collect()
    assert len(rows) == len(streams) and sum(r["doc_id"] == 5 for r in rows) == 2
    for r in rows:
        if r["doc_id"] >= 100:
            assert tuple(r)[1:] == (None,) * 4
        else:
            w, h, _, x = images[r["doc_id"]]
            assert (r["width"], r["height"], list(r["thumbnail"]), r["feature"]) == (w, h, x, jpeg.feature(w, h, np.array(x, np.uint8)))
    own = np.frombuffer(rng.randbytes(64 * 21), np.uint8)
    assert jpeg.features(own, np.array([21])) == [jpeg.feature(512, 168, own)]
    assert not jpeg.described(spark.createDataFrame([], "doc_id long, media binary")).collect()


def test_quality(docs):
    got = by_id(quality.query(docs))
    lines_of = lambda text: {" ".join(WORD.findall(x.translate(LOWER))) for x in (text or "").split("\n")} - {""}
    host = {d: "" if d % 5 == 0 else f"s{d % 2}" for d, _ in CORPUS}
    one, often_held = {}, {}
    for d, text in CORPUS:
        one.setdefault((host[d], frozenset(lines_of(text))), d)
    docs_of = Counter(h for h, _ in one)
    holders = defaultdict(list)
    for (h, own), d in one.items():
        for x in own:
            holders[h, x].append(d)
    for (h, x), own in holders.items():
        if len(own) >= 5 and len(own) > 0.05 * docs_of[h]:
            often_held[h, x] = min(own)
    assert often_held
    for d, text in CORPUS:
        text = text or ""
        own = WORD.findall(text)
        windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert r["n_words"] == len(own) and r["word_chars"] == sum(map(len, own)) and r["n_repeat_words"] == len(covered)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == sum(ch in "#*$%&|<>" for ch in text)
        assert r["base_failed"] == (len(own) < 50 or 100 * len(covered) > 50 * len(own))
        bare = [(" ".join(WORD.findall(x.translate(LOWER))), len(WORD.findall(x))) for x in text.split("\n")]
        gone = sum(n for x, n in bare if d != often_held.get((host[d], x), d))
        assert r["n_boilerplate_words"] == gone and r["kept"] == (not r["base_failed"] and len(own) - gone >= max(50, 0.1 * len(own)))


def test_quality_line_frequency(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, "Same LINE here\n" + prose(60) if k < 30 else prose(70), "en", "h", 0) for k in range(100)]
    rows += [(200, " ".join(["same line here"] * 1) + "\n" + "same  Line\there " * 1 + "\n", "en", "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(quality.judge(df, min_docs=10, max_share=0.2))
    assert got[0]["n_boilerplate_words"] == 0 and got[1]["n_boilerplate_words"] == 3 and got[50]["n_boilerplate_words"] == 0 and got[200]["n_boilerplate_words"] == 6
    clean = by_id(quality.clean(df, min_docs=10, max_share=0.2))
    assert set(clean) == set(range(100)) and "LINE" in clean[0]["text"] and "LINE" not in clean[1]["text"] and clean[1]["n_chars"] == len(clean[1]["text"])


def test_depleted_documents_are_rejected(spark):
    """A banner of twenty words on half a host's documents: who has fewer than fifty words besides goes, but not its first holder."""
    rng = random.Random(5)
    banner = " ".join(f"banner{k}" for k in range(20))
    prose = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{banner}\n{prose(40 if k % 2 else 90)}" for k in range(10)] + [prose(70) for _ in range(10)] + [f"{banner}\n{banner}\n{banner}"] + [prose(55) + " " + banner]
    texts[0] = f"{banner}\n{prose(40)}"
    df = spark.createDataFrame([(k, t, "en", "host", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(quality.query(df))
    assert {d for d, r in got.items() if not r["kept"]} == {1, 3, 5, 7, 9, 20} and {d for d, r in got.items() if r["base_failed"]} == {20}
    assert set(by_id(quality.clean(df))) == set(range(22)) - {1, 3, 5, 7, 9, 20}


def test_hot_boilerplate_is_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, f"line {k % 3}\nhot\n" + " ".join(f"p{rng.randrange(10**6)}" for _ in range(60)), "en", f"h{k % 2}", 0) for k in range(60)] + [(k, "hot\nx", "en", "h0", 0) for k in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = sorted(map(tuple, quality.query(df).collect()))
    monkeypatch.setattr(quality, "HOT", 4)
    assert sorted(map(tuple, quality.query(df).collect())) == whole and sum(r[-1] for r in whole) > 200


@pytest.fixture(scope="module")
def clash(spark):
    """Two texts of one doc_id that a 32-bit hash doesn't tell apart, and a bystander that holds the longer one's words."""
    words = F.concat_ws(" ", *(F.lit(f"w{k}") for k in range(72)))
    short, long = (spark.range(150_000).select(F.concat(before, F.col("id").cast("string")).alias(name)) for name, before in (("a", F.lit("short text number ")), ("b", F.concat(words, F.lit(" number")))))
    found = short.join(long, F.hash("a") == F.hash("b")).orderBy("a").first()
    assert found is not None
    return [(1, found["a"]), (1, found["b"]), (0, found["b"].rsplit(" ", 1)[0]), (2, found["b"])]


def test_texts_that_clash_in_32_bits(spark, clash):
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in clash], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.query(df).collect()) == [(0, 72, 0), (1, 4, 0), (1, 73, 72), (2, 73, 73)]
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.every_line(df).collect()) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 1)]
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.query(df).collect()) == [(0, 0), (1, 0), (1, 1), (2, 0)]


def test_a_clash_of_versions_does_not_crash(spark, clash, monkeypatch):
    """Even rows whose versions are equal: no span leaves its row."""
    monkeypatch.setattr(c, "version", lambda: F.lit(7).cast("long"))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in clash] + [(1, "a\nb\nc " + "d " * 40, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for query in (substrings.query, line_dedup.every_line, jaccard.query, quality.query):
        assert {r["doc_id"] for r in query(df).collect()} == {0, 1, 2}


def test_pipeline_line_frequency(spark):
    """Production limits of the pipeline: a small host, a large one, and a line of many documents but a small share."""
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    rows = [(k, ("Small host footer\n" if k < 10 else "") + prose(60), "en", "small", 0) for k in range(40)]
    rows += [(40 + k, ("Rare line of four\n" if k < 4 else "") + prose(60), "en", "other", 0) for k in range(40)]
    rows += [(1000 + k, ("Hot host footer\n" if k < 1000 else "Line of few\n" if k < 1200 else "") + prose(60), "en", "hot", 0) for k in range(21000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(corpus_pipeline.quality_rules(spark, df, ""))
    assert len(got) == len(rows)
    text = "\n".join(r["text"] for r in got.values())
    assert text.count("Small host footer") == text.count("Hot host footer") == 1  # the first document keeps it
    assert text.count("Rare line of four") == 4 and text.count("Line of few") == 200


def test_substrings(docs):
    own = {d: WORD.findall(t or "") for d, t in CORPUS}
    first: dict[tuple, int] = {}
    for d in sorted(own):
        for i in range(len(own[d]) - 12):
            first.setdefault(tuple(own[d][i : i + 13]), d)
    got = by_id(substrings.query(docs))
    for d, words in own.items():
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(words), sum(gone))
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def shingles(text):
    own = WORD.findall((text or "").translate(LOWER))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or ({tuple(own)} if own else set())


def components(links, ids):
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {d: find(d) for d in ids}


def test_jaccard(docs):
    sets = {d: shingles(t) for d, t in CORPUS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = by_id(jaccard.query(docs))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(sets[d]), want[d]) for d in sets}


def test_jaccard_large_groups(spark):
    """A family whose members aren't all similar to each other, beside many sets that share a passage."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**7)}"
    base = [word() for _ in range(120)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    passage = [word() for _ in range(60)]
    rows += [(100 + k, " ".join(passage + [word() for _ in range(rng.randint(20, 60))])) for k in range(60)]
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = by_id(jaccard.query(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: r["component_id"] for d, r in got.items()} == want


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances():
    rng = random.Random(4)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    assert line_dedup.distances(pairs).tolist() == [min(edit(a, b), 3) for a, b in pairs]


def test_line_dedup(docs, spark):
    first: dict[str, tuple[int, int]] = {}
    for d, text in CORPUS:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\v\f\r")
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (d, k))
    lines = list(first)
    links = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2]
    assert links
    lost = {a if first[a] > first[b] else b for a, b in links}
    keep = {first[x] for x in lines if x not in lost}
    got = by_id(line_dedup.query(docs))
    degree = Counter(x for pair in links for x in pair)
    for d, text in CORPUS:
        own, removed, linked = [], 0, set()
        for k, line in enumerate((text or "").split("\n")):
            bare = line.strip(" \t\n\v\f\r")
            if len(bare) < line_dedup.MIN_CHARS or (d, k) in keep:
                own.append(line)
            else:
                removed += 1
            if len(bare) >= line_dedup.MIN_CHARS:
                linked.add(bare)
        assert (got[d]["n_removed"], got[d]["kept_sha256"]) == (removed, hashlib.sha256("\n".join(own).encode()).hexdigest())
        assert got[d]["n_links"] == sum(degree[x] for x in linked)


def test_line_dedup_short_lines(spark, tmp_path):
    """The registered query and the pipeline's stage remove exact repeats of lines under MIN_CHARS, and only those."""
    import corpus_pipeline
    from morae.llm import catalog

    rows = [(1, "Released under the MIT License.\n\nx\n"), (2, "a line of text that is long enough to be indexed\n Released under the MIT License. \n \nx"), (3, "Released under the MIT License!\nx\nx\ny"), (4, "x")]
    rows = [(d, t, "en", "s", len(t)) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(catalog.queries()["op4_line_dedup"](spark, str(tmp_path)))
    want = {1: rows[0][1], 2: rows[1][1].split("\n")[0] + "\n ", 3: "Released under the MIT License!\ny", 4: ""}
    assert {d: r["n_removed"] for d, r in got.items()} == {1: 0, 2: 2, 3: 2, 4: 1}
    assert all(got[d]["kept_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in want.items())
    assert {d: r["text"] for d, r in by_id(corpus_pipeline.near_lines(spark, df, "")).items()} == {d: t for d, t in want.items() if t}


def test_line_dedup_classes(docs):
    """Linked lines, and equal ones, carry the class of their first occurrence; a chain of links is one class."""
    first: dict[str, tuple[int, int]] = {}
    at = defaultdict(list)
    for d, text in CORPUS:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\v\f\r")
            if line:
                first.setdefault(line, (d, k))
                at[line].append((d, k))
    lines = [x for x in first if len(x) >= line_dedup.MIN_CHARS]
    links = [(first[a], first[b]) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2]
    of = components(links, first.values())
    size = Counter()
    for line, own in at.items():
        size[of[first[line]]] += len(own)
    want = {(*x, *of[first[line]]) for line, own in at.items() for x in own if size[of[first[line]]] > 1}
    got = [(r["doc_id"], x["line_no"], x["class_doc_id"], x["class_line_no"]) for r in line_dedup.every_line(docs).collect() for x in r["line_classes"]]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(first[a] != of[first[a]] for a in lines)


def test_lm(docs):
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in CORPUS}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    counts = Counter(x for d, own in tokens.items() if not out[d] for x in own)
    total, distinct = sum(counts.values()), len(counts)
    got = by_id(mixing_lm.query(docs))
    for d, own in tokens.items():
        base = sum(np.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in own)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(own), sum(counts[x] > 0 for x in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and np.isfinite(r["score"]) and r["score"] < 0


def test_lm_beats_base_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    every = mixing_lm.query(df).collect()
    for held_out in (True, False):
        rows = [r for r in every if r["held_out"] is held_out]
        assert rows and sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)


def test_lm_reads_running_text(spark):
    """Held-out texts of the same words: the order that training texts have is likelier, and beats the base."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**5)}" for _ in range(60)]
    phrases = [[rng.choice(words) for _ in range(8)] for _ in range(12)]
    ids = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:20]
    rows = [(d, [x for _ in range(6) for x in rng.choice(phrases)]) for d in range(400) if d not in ids]
    own = [[x for _ in range(6) for x in rng.choice(phrases)] for _ in range(10)]
    rows += [(d, rng.sample(x, len(x)) if k else x) for k in (0, 1) for d, x in zip(ids[10 * k :], own, strict=False)]
    got = by_id(mixing_lm.query(spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")))
    assert all(got[d]["held_out"] for d in ids)
    for a, b in zip(ids, ids[10:], strict=False):
        assert got[a]["base_score"] == pytest.approx(got[b]["base_score"])
        assert got[a]["score"] > got[b]["score"] + 5 and got[a]["score"] > got[a]["base_score"]


def test_licenses_inside_texts(spark):
    """Notices in comments of nine words a line, with code behind them, in the midst of a line, and whole texts of licences."""
    rng = random.Random(5)
    code = "\n".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(8)) for _ in range(60))

    def wrapped(name: str) -> str:
        words = licenses.TEMPLATES[name].split()
        return "\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))

    names = ["MIT/grant", "GPL-3.0/header", "Apache-2.0/header", "BSD-3-Clause/full", "ISC/full", "MIT/full"]
    rows = [(k, wrapped(x) + "\n" + code) for k, x in enumerate(names)]
    rows += [(10, f"{code} and it was Released under the MIT License. {code}"), (11, code), (12, "see the rights reserved here " + code), (13, wrapped("MIT/full").replace("software", "program", 2) + "\n" + code)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(licenses.query(df))
    assert [got[k]["license"] for k in range(6)] == names and all(got[k]["unit"] == -2 and got[k]["n_hits"] == 1 for k in range(6))
    assert got[10]["license"] == "MIT/notice" and got[11]["license"] is None and got[12]["license"] is None and got[13]["license"] == "MIT/full"
    import duckdb

    con = duckdb.connect()
    con.register("documents", df.toPandas())
    columns = ["doc_id", "n_hits", "license", "dice", "unit"]
    assert sorted(tuple(r[x] for x in columns) for r in got.values()) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({licenses.sql()})").fetchall())


def test_licenses(spark):
    rows = [(1, "Some prose.\nReleased under the MIT License."), (2, licenses.TEMPLATES["MIT/grant"].upper()), (3, licenses.TEMPLATES["GPL-3.0/header"].replace(". ", ".\n")), (4, None), (5, "All rights"), (6, "all RIGHTS  reserved!"), (7, "prose " * 300)]
    got = by_id(licenses.query(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["license"] for k in range(1, 8)] == ["MIT/notice", "MIT/grant", "GPL-3.0/header", None, None, "Proprietary/rights", None]
    assert got[2]["dice"] == 1.0 and got[3]["unit"] == -1
    for n in range(1, 60):
        low, high = licenses.bounds(n)
        for a in range(1, 150):
            assert (low <= a <= high) == (2 * min(a, n) * 5 >= 4 * (a + n))


def test_html(spark):
    model = html_crf.train(html_crf.labelled_pages(200))
    wrong = total = 0
    for own, labels in html_crf.labelled_pages(60, seed=91):
        wrong += sum(a != b for a, b in zip(labels, html_crf.decode(model, own), strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/x'>Menu</a></nav><article><h1>Head &amp; more</h1><p>First  part <b>bold</b>text.<p>Second part of it, long enough.</article><div class='comments'><p>Nice post</p></div><footer>&copy; me</footer>"
    assert html_crf.extract(model, page) == "Head & more First part boldtext. Second part of it, long enough."
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_crf.query(df, 200).collect()}
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[1]["n_chars"] == len(got[1]["text"])


def test_components(spark):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    ids = sorted({x for pair in links for x in pair} | {999})
    got = c.components(spark.createDataFrame([(x,) for x in ids], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == components(links, ids)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**7)}"
    prose = [" ".join(word() for _ in range(90)) for _ in range(6)]
    texts = [*prose, prose[0], prose[1].replace("w", "v", 1), None, "", "short", prose[2] + " " + " ".join(word() for _ in range(90)), "a b " * 100]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 4, 5, 11}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    kept = corpus_pipeline.repeated_passages(spark, docs.where("doc_id IN (2, 11)"), "").where("doc_id = 11").first()
    assert kept["n_chars"] == len(kept["text"]) and len(kept["text"].split()) == 90


REPEATED = [(1, "alpha beta gamma\nsecond line of the first text that is long enough to be joined"), (1, "other words here"), (1, "other words here"), (2, "alpha beta gamma\nsecond line of the first text that is long enough to be joinde\n" + " ".join(f"w{k}" for k in range(40))), (3, " ".join(f"w{k}" for k in range(40)) + " end"), (3, " ".join(f"w{k}" for k in range(60))), (3, None), (4, "x " * 60), (4, "x " * 60)]


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows that share a doc_id, equal and different, and extra columns named as the operators' own."""
    names = ("ver", "row", "boilerplate", "line", "kept", "is_new", "new_text", "n", "node", "component", "block", "bucket", "own", "lent", "__ver")
    rows = [(d, t, "en", "s", None if t is None else len(t), *(["x"] * len(names))) for d, t in REPEATED]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in names)).repartition(3)


@pytest.mark.parametrize("module", [licenses, quality, mixing_lm, line_dedup, jpeg, packing, sentencepiece_codec, substrings, jaccard])
def test_repeated_rows_and_clashing_names(repeated, module):
    query = {line_dedup: line_dedup.every_line, sentencepiece_codec: sentencepiece_codec.digests}.get(module) or module.query
    got = Counter(r["doc_id"] for r in query(repeated).collect())
    if module is licenses:
        assert got == {1: 1, 2: 1, 3: 1, 4: 1}
    elif module is packing:
        assert set(got) == {1, 2, 3, 4}
    else:
        assert got == {1: 3, 2: 1, 3: 3, 4: 2}


def test_repeated_rows_are_cut_by_their_own_texts(repeated):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.query(repeated).collect())
    assert got == [(1, 3, 0), (1, 3, 0), (1, 16, 0), (2, 56, 15), (3, 0, 0), (3, 41, 40), (3, 60, 40), (4, 60, 0), (4, 60, 0)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["n_links"]) for r in line_dedup.every_line(repeated).collect())
    assert got == [(1, 1, 0, 0), (1, 1, 0, 0), (1, 2, 0, 1), (2, 3, 2, 1), (3, 1, 0, 0), (3, 1, 0, 0), (3, 1, 0, 0), (4, 1, 0, 0), (4, 1, 0, 0)]


def test_pipeline_takes_repeated_rows_extra_columns_and_empty_tables(repeated, spark, tmp_path):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, repeated, "")
        assert out.count() <= len(REPEATED) + 1 and (stage is corpus_pipeline.packed_sequences or out.columns == repeated.columns)
        empty = stage(spark, repeated.limit(0), "")
        assert empty.count() == 0
    kept = corpus_pipeline.near_documents(spark, repeated, "").collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 2, 2: 1, 3: 3, 4: 1}
    repeated.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {2, 3}


@pytest.mark.parametrize("function", [lambda df: sentencepiece_codec.digests(df), lambda df: html_crf.query(df.selectExpr("doc_id AS page_id", "text AS url", "text AS html"), 200)])
def test_empty_tables_of_the_others(empty, function):
    assert function(empty).collect() == []


def test_jaccard_splits_large_groups_and_families(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {d: r["component_id"] for d, r in by_id(jaccard.query(df)).items()}
    monkeypatch.setattr(jaccard, "GROUP", 10)
    monkeypatch.setattr(jaccard, "FAMILY", 8 * 56 * 9)
    assert {d: r["component_id"] for d, r in by_id(jaccard.query(df)).items()} == whole
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(56)} for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert whole == components(links, sorted(sets))


def test_boilerplate_with_the_production_limits(spark):
    """Six of eighty documents of a host share a line, and four another; sixty copies of one text count as one document."""
    rng = random.Random(4)
    prose = lambda: " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    copy = "A line of copies\n" + prose()
    texts = [("Subscribe to our letter\n" if k < 6 else "Rare line\n" if k < 10 else "") + prose() for k in range(80)] + [copy] * 60
    df = spark.createDataFrame([(k, t, "en", "host", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(quality.query(df))
    assert [got[k]["n_boilerplate_words"] for k in (0, 1, 5, 6, 9, 20, 90)] == [0, 4, 4, 0, 0, 0, 0] and all(r["kept"] for r in got.values())
    clean = by_id(quality.clean(df))
    assert len(clean) == 140 and clean[1]["text"] == texts[1].split("\n")[1] and clean[0]["text"] == texts[0] and clean[7]["text"] == texts[7]


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert line_dedup.query(df).first()["n_lines"] == 1
    assert substrings.query(df).first()["n_words"] == 0
    assert jaccard.query(df).first()["component_id"] == 1
    assert quality.query(df).where(F.col("base_failed")).count() == 1
