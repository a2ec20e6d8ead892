"""Line deduplication by a segment-partition edit join.

Lines of at least `MIN_CHARS` code points, trimmed of white space, are joined within an edit distance of T. A line is cut
into T + 1 segments; two lines within T edits share a segment. Every distinct line is entered in the index under (its
length, segment number, segment), and probes, for each length from its own down to T less, the substrings at the places
where that segment can stand (the multi-match-aware range of positions). Hashes of substrings come from prefix sums over
the slice. Entries and probes meet in buckets; a parity sketch of a line's characters, of which an edit flips two bits at most,
drops most pairs there. The rest are verified on their texts by a banded bit-parallel edit distance, in numpy over many
pairs at once. Every link between different lines is found; equal lines are one line from the start.

Links make classes of lines (components); a class is named by its first occurrence, and the query lists every document's
lines in classes of several occurrences with their class, so that partners can be looked up.

An occurrence is kept if it is the first of its line (least doc_id, then line number) and no linked line occurs earlier
than it. Shorter lines are joined by equality alone from `least` code points on; those below, and blank ones, are kept. The
registered query and the pipeline take every line with a word (least=1).

Null text: as empty, one blank line. Very long lines and texts are taken whole. Repeated rows of one doc_id: each is a row of its
own text, equal ones are cut alike, and of a line that both hold the one with the lesser line number, then version, stays. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

T = 2
MIN_CHARS = 32
SLICE = 2 << 20
HOT = 1000
KEYS = pa.schema([("bucket", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("ver", pa.list_(pa.int64())), ("line_no", pa.list_(pa.int64())), ("line", pa.list_(pa.int64()))])
KEYS_DDL = "bucket long, payload binary, doc_id array<long>, ver array<long>, line_no array<long>, line array<long>"
MET = pa.schema([("doc_id", pa.int64()), ("ver", pa.int64()), ("line_no", pa.int64()), ("line", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
MET_DDL = "doc_id long, ver long, line_no long, line long, a long, b long"
ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("sketch", "<u4"), ("probe", "u1")])


class Lines:
    """The lines of a slice: code points end to end, and where each trimmed line begins and ends."""

    def __init__(self, texts: pa.Array):
        data, at = c.string_bytes(texts)
        self.points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[at]
        stops = np.flatnonzero(self.points == 10)
        begin = np.sort(np.concatenate([at[:-1], stops + 1]))
        end = np.sort(np.concatenate([at[1:], stops]))
        self.row = np.repeat(np.arange(len(at) - 1), 1 + np.diff(np.searchsorted(stops, at)))
        self.no = np.arange(len(begin)) - np.searchsorted(self.row, self.row)
        ink = np.flatnonzero((self.points > 32) | (self.points < 9) | ((self.points > 13) & (self.points < 32)))
        first, last = np.searchsorted(ink, begin), np.searchsorted(ink, end)
        some = last > first
        self.begin, self.end = begin.copy(), begin.copy()
        self.begin[some], self.end[some] = ink[first[some]], ink[last[some] - 1] + 1

    @property
    def size(self) -> np.ndarray:
        return self.end - self.begin


def segments(size: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the i-th of T + 1 segments of a line; the last ones take the remainder."""
    short = size // (T + 1)
    longer = size - short * (T + 1)  # so many segments, the last ones, are one longer
    from_ = T + 1 - longer
    return i * short + np.maximum(0, i - from_), short + (i >= from_)


def entries(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line (index), key and whether it is a probe, of all index entries and probes of the lines."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    everyone = np.arange(len(size))
    base = c.BASE
    total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * c.powers(base, len(points)))])
    inverse = c.powers(pow(base, -1, 1 << 64), len(points) + 1)

    def add(i: int, length: np.ndarray, at: np.ndarray, wide: np.ndarray, ok: np.ndarray, probe: bool) -> None:
        own = everyone[ok]
        a = (begin + at)[ok]
        h = c.mix((total[a + wide[ok]] - total[a]) * inverse[a], 20)
        label = (length[ok] * (T + 1) + i).astype(np.uint64)
        out.append((own, c.mix(h ^ c.mix(label, 21), 22), np.full(len(own), probe)))

    for i in range(T + 1):
        at, wide = segments(size, i)
        add(i, size, at, wide, np.ones(len(size), bool), False)
        for less in range(T + 1):
            other = size - less  # the length of the indexed line
            at, wide = segments(other, i)
            for shift in range(max(-i, less - (T - i)), min(i, less + (T - i)) + 1):
                place = at + shift
                add(i, other, place, wide, (other > 0) & (place >= 0) & (place + wide <= size), True)
    own, key, probe = map(np.concatenate, zip(*out, strict=True))
    return own, key, probe


def sketches(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32 parities of the characters of each line; an edit changes two of them at most."""
    flip = np.uint32(1) << (c.mix(points.astype(np.uint64), 23) >> np.uint64(59)).astype(np.uint32)
    total = np.concatenate([[np.uint32(0)], np.bitwise_xor.accumulate(flip)]) if len(flip) else np.zeros(1, np.uint32)
    return total[begin + size] ^ total[begin]


def _keys(batches: Iterator[pa.RecordBatch], buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            lines = Lines(c.column(part, "text"))
            some = np.flatnonzero(lines.size >= least)
            begin, size = lines.begin[some], lines.size[some]
            name = c.signed(c.span_hash(lines.points, begin, begin + size, 8))
            ids = c.numbers(part, "doc_id")[lines.row[some]]
            yield c.named(KEYS, bucket=[-1 - int(len(some) + (ids[0] if len(ids) else 0)) % buckets], payload=c.binary([None]), doc_id=[ids], ver=[c.numbers(part, "ver")[lines.row[some]]], line_no=[lines.no[some]], line=[name])
            long = size >= MIN_CHARS
            begin, size, name = begin[long], size[long], name[long]
            name, one = np.unique(name, return_index=True)
            begin, size = begin[one], size[one]
            own, key, probe = entries(lines.points, begin, size)
            out = np.zeros(len(own), ENTRY)
            out["key"], out["line"], out["sketch"], out["probe"] = key, name[own], sketches(lines.points, begin, size)[own], probe
            to = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to = to[order]
            cut = np.append(np.flatnonzero(c.first_of_group(to)), len(to)).tolist() if len(to) else []
            if cut:
                out = out[order]
                nothing = [None] * (len(cut) - 1)
                yield c.named(KEYS, bucket=to[cut[:-1]], payload=c.binary([_packed(out[a:b]) for a, b in zip(cut, cut[1:], strict=False)]), doc_id=nothing, ver=nothing, line_no=nothing, line=nothing)


def _packed(own: np.ndarray) -> bytes:
    """Entries of a bucket: each of their lines once, then 6 bytes of the key and the line's place for each entry."""
    line, first, place = np.unique(own["line"], return_index=True, return_inverse=True)
    key = np.ascontiguousarray((own["key"] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
    return b"".join([np.array([len(line), len(own)], "<i8").tobytes(), line.astype("<i8").tobytes(), own["sketch"][first].tobytes(), (place * 2 + own["probe"]).astype("<i4").tobytes(), key.tobytes()])


def _unpacked(raw: bytes) -> np.ndarray:
    n, m = np.frombuffer(raw, "<i8", 2)
    place = np.frombuffer(raw, "<i4", m, 16 + 12 * n)
    out = np.zeros(m, ENTRY)
    out["line"] = np.frombuffer(raw, "<i8", n, 16)[place >> 1]
    out["sketch"] = np.frombuffer(raw, "<u4", n, 16 + 8 * n)[place >> 1]
    out["probe"] = place & 1
    key = np.zeros((m, 8), np.uint8)
    key[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, 16 + 12 * n + 4 * m).reshape(m, 6)
    out["key"] = key.view("<u8").ravel()
    return out


def _pairs(payloads: list[bytes], block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a > b) of lines that a probe and an entry of the bucket bring together and whose sketches allow a link."""
    own = np.concatenate(list(map(_unpacked, payloads)))
    own = own[np.lexsort((own["line"], own["probe"], own["key"]))]
    own = own[c.first_of_group(own["key"], own["probe"], own["line"])]
    head = np.flatnonzero(c.first_of_group(own["key"]))
    stop = np.append(head[1:], len(own))
    probes = np.add.reduceat(own["probe"].astype(np.int64), head) if len(own) else np.zeros(0, np.int64)
    entered = stop - head - probes
    live = np.flatnonzero((probes > 0) & (entered > 0) & (stop - head > 2))  # a line meets itself always
    # every probe of a group with every entry of it, a block of pairs at a time
    probe_at = c.runs((head + entered)[live], probes[live])
    from_, n = np.repeat(head[live], probes[live]), np.repeat(entered[live], probes[live])
    ends = np.cumsum(n)
    seen = np.zeros(0, np.dtype([("a", "<i8"), ("b", "<i8")]))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        x, y = np.repeat(probe_at[at:to], n[at:to]), c.runs(from_[at:to], n[at:to])
        ok = (np.bitwise_count(own["sketch"][x] ^ own["sketch"][y]) <= 2 * T) & (own["line"][x] != own["line"][y])
        found = np.zeros(int(ok.sum()), seen.dtype)
        found["a"], found["b"] = np.maximum(own["line"][x[ok]], own["line"][y[ok]]), np.minimum(own["line"][x[ok]], own["line"][y[ok]])
        found = np.setdiff1d(found, seen)
        seen = np.union1d(seen, found)
        yield found["a"], found["b"]
        at = to


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for k, (bucket, payload) in enumerate(zip(c.column(batch, "bucket").to_pylist(), c.column(batch, "payload").to_pylist(), strict=True)):
            if bucket >= 0:
                own[bucket].append(payload)
                continue
            rows = {x: c.column(batch, x).slice(k, 1).flatten() for x in ("doc_id", "ver", "line_no", "line")}
            nothing = pa.nulls(len(rows["line"]), pa.int64())
            yield c.named(MET, **rows, a=nothing, b=nothing)
    while own:
        for a, b in _pairs(own.popitem()[1]):
            nothing = pa.nulls(len(a), pa.int64())
            yield c.named(MET, doc_id=nothing, ver=pa.nulls(len(a), pa.int64()), line_no=nothing, line=nothing, a=a, b=b)


def distances(pairs: list[tuple[str, str]], t: int = T) -> np.ndarray:
    """The edit distance of each pair, or more than t where it is more than t.

    Vertical differences of a band of 2t + 1 rows are bits of a word, and a column is a few word operations; the band
    moves down a row with each column. The distance on the main diagonal is counted, and the last rows are added.
    """
    out = np.full(len(pairs), t + 1, np.int64)
    near = [k for k, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= t]
    near.sort(key=lambda k: max(map(len, pairs[k])))
    at = 0
    while at < len(near):
        # so many pairs, fewer of long lines
        own = near[at : at + max(1, min(1024, (1 << 21) // (max(map(len, pairs[near[at]])) + 1)))]
        own = own[: max(1, (1 << 22) // (max(map(len, pairs[own[-1]])) + 1))]
        at += len(own)
        long, short = zip(*(sorted(pairs[k], key=len, reverse=True) for k in own), strict=True)
        m, n = np.array(list(map(len, long))), np.array(list(map(len, short)))
        rows = np.zeros((int(n.max()) + 2 * t + 1, len(own)), np.uint32)  # row i of the longer line at i + t - 1
        columns = np.full((int(n.max()) + 1, len(own)), 0xFFFFFFFF, np.uint32)
        for k, (x, y) in enumerate(zip(long, short, strict=True)):
            x, y = np.frombuffer(x.encode("utf-32-le"), np.uint32) + 1, np.frombuffer(y.encode("utf-32-le"), np.uint32) + 1
            x = x[: len(rows) - t]
            rows[t : t + len(x), k] = x
            columns[: len(y), k] = y
        one, all_ = np.uint64(1), np.uint64((1 << 64) - 1)
        vp = np.full(len(own), (all_ << np.uint64(t)) & all_)
        vn = np.zeros(len(own), np.uint64)
        d, result = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        ends = defaultdict(list)
        for k, x in enumerate(n.tolist()):
            ends[x].append(k)
        for j in range(int(n.max()) + 1):
            for k in ends.get(j, ()):
                more = [(int(vp[k]) >> (t + x) & 1) - (int(vn[k]) >> (t + x) & 1) for x in range(m[k] - n[k])]
                result[k] = d[k] + sum(more)
            if j == n.max():
                break
            match = np.zeros(len(own), np.uint64)
            for k in range(2 * t + 1):
                match |= (rows[j + k] == columns[j]).astype(np.uint64) << np.uint64(k)
            d0 = (((match & vp) + vp) ^ vp) | match | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            d += 1 - ((d0 >> np.uint64(t)) & one).astype(np.int64)
            moved = d0 >> one
            vp, vn = hn | ~(moved | hp), moved & hp
        out[own] = np.minimum(result, t + 1)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(c.column(batch, "x").to_pylist(), c.column(batch, "y").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([c.column(batch, "a"), c.column(batch, "b"), pa.array(distances(pairs) <= T)], ["a", "b", "linked"])


TEXTS = pa.schema([("line", pa.int64()), ("text", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trimmed texts of the wanted line numbers of each document."""
    for batch in batches:
        names, texts = [], []
        for text, wanted in zip(c.column(batch, "text").to_pylist(), c.column(batch, "wanted").to_pylist(), strict=True):
            own = text.split("\n")
            for x in wanted:
                if x["line_no"] >= len(own):  # of another text, whose version is the same
                    continue
                names.append(x["line"])
                texts.append(own[x["line_no"]].strip(" \t\n\v\f\r"))
        yield c.named(TEXTS, line=names, text=texts)


def firsts(occurrences: DataFrame) -> DataFrame:
    """line, at (its first occurrence), n: combined on the map side, so a line of many documents costs a row a task."""
    return c.checkpoint(occurrences.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "ver")).alias("at"), F.count("*").alias("n")))


def by_line(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """Occurrences joined with lines (line, n, ...). Lines that hold over a HOTth of all occurrences, so HOT lines at most, are
    broadcast: no task gets all occurrences of one."""
    most = occurrences.count() // HOT
    hot = F.broadcast(lines.where(F.col("n") > most))
    rest = occurrences.join(hot.select("line"), "line", "left_anti").join(lines.where(F.col("n") <= most), "line")
    return rest.unionByName(occurrences.join(hot, "line"))


def links(df: DataFrame, bucket_mb: float = 8, least: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences (doc_id, ver, line_no, line) of lines of at least `least` code points, their firsts, and links (a, b) between
    different long lines within T edits."""
    docs = c.documents(df, c.version().alias("ver"))
    buckets = c.buckets(docs, bucket_mb)
    dealt = docs.mapInArrow(c.lean(lambda batches: _keys(batches, buckets, least)), KEYS_DDL).repartition(buckets, "bucket")
    met = c.checkpoint(dealt.mapInArrow(c.lean(_meet), MET_DDL))
    occurrences = met.where("line is not null").select("doc_id", "ver", "line_no", "line")
    pairs = c.checkpoint(met.where("a is not null").select("a", "b").distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    first = firsts(occurrences)
    where = first.join(asked, "line", "left_semi")
    wanted = where.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.ver").alias("ver")).agg(F.collect_list(F.struct("line", F.col("at.line_no").alias("line_no"))).alias("wanted"))
    texts = c.checkpoint(docs.join(wanted, ["doc_id", "ver"]).select("text", "wanted").mapInArrow(c.lean(_texts), "line long, text string").dropDuplicates(["line"]))
    shipped = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("y")), "b")
    checked = shipped.mapInArrow(c.lean(_verify), "a long, b long, linked boolean")
    return occurrences, first, c.checkpoint(checked.where("linked").select("a", "b").distinct())


CLASS = pa.list_(pa.struct([("line_no", pa.int64()), ("class_doc_id", pa.int64()), ("class_line_no", pa.int64())]))
CLASS_DDL = "array<struct<line_no: long, class_doc_id: long, class_line_no: long>>"
CUT = pa.schema([("doc_id", pa.int64()), ("ver", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_long_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_links", pa.int64()), ("line_classes", CLASS)])
CUT_DDL = "doc_id long, ver long, text string, n_lines long, n_long_lines long, n_removed long, kept_sha256 string, n_links long, line_classes " + CLASS_DDL


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            texts = c.column(part, "text")
            lines = Lines(texts)
            long, judged = lines.size >= MIN_CHARS, lines.size >= least
            edge = np.searchsorted(lines.row, np.arange(part.num_rows + 1)).tolist()
            out: dict[str, list] = {x: [] for x in ("text", "n_lines", "n_long_lines", "n_removed", "kept_sha256")}
            for text, kept, a, b in zip(texts.to_pylist(), c.column(part, "kept").to_pylist(), edge, edge[1:], strict=False):
                keep = ~judged[a:b]
                keep[[] if kept is None else [x for x in kept if x < b - a]] = True
                if not keep.all():
                    text = "\n".join([x for x, y in zip(text.split("\n"), keep.tolist(), strict=True) if y])
                out["text"].append(text)
                out["n_lines"].append(b - a)
                out["n_long_lines"].append(int(long[a:b].sum()))
                out["n_removed"].append(int((~keep).sum()))
                out["kept_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            yield c.named(CUT, doc_id=c.column(part, "doc_id"), ver=c.column(part, "ver"), n_links=c.column(part, "n_links"), line_classes=c.column(part, "line_classes").cast(CLASS), **out)


def classes(occurrences: DataFrame, first: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, ver and line_classes: its lines in classes of several occurrences, each with the class's first occurrence."""
    joined = linked.select(F.col("a").alias("node")).union(linked.select("b")).distinct()
    of = c.checkpoint(c.components(joined, linked)).withColumnRenamed("node", "line")
    named = c.checkpoint(first.join(of, "line", "left").select("line", F.coalesce("component", "line").alias("class"), "at", "n"))
    roots = named.groupBy("class").agg(F.min("at").alias("root"), F.sum("n").alias("n")).where("n > 1").drop("n")
    roots = c.checkpoint(named.join(roots, "class").select("line", "root", "n"))
    # equal rows bring each of their lines once
    entry = F.struct("line_no", F.col("root.doc_id").alias("class_doc_id"), F.col("root.line_no").alias("class_line_no"))
    return by_line(occurrences, roots).groupBy("doc_id", "ver").agg(F.array_distinct(F.sort_array(F.collect_list(entry))).alias("line_classes"))


def dedup(df: DataFrame, least: int = MIN_CHARS, classed: bool = False) -> DataFrame:
    """doc_id, ver, text without removed lines, n_lines, n_long_lines, n_removed, kept_sha256, n_links (other lines within T edits of
    the document's lines), line_classes (null unless `classed`, where none: empty)."""
    occurrences, first, linked = links(df, least=least)
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = first.join(both.select("a").distinct().withColumnRenamed("a", "line"), "line", "left_semi")
    near = c.checkpoint(near)
    lost = both.join(near.select(F.col("line").alias("a"), F.col("at").alias("at_a")), "a").join(near.select(F.col("line").alias("b"), F.col("at").alias("at_b")), "b").where("at_b < at_a").select(F.col("a").alias("line")).distinct()
    kept = first.join(lost, "line", "left_anti").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.ver").alias("ver")).agg(F.collect_list(F.col("at.line_no").cast("int")).alias("kept"))
    counts = both.groupBy(F.col("a").alias("line")).agg(F.count("*").alias("n_near")).join(first.select("line", "n"), "line")
    # each of a document's lines counts once
    n_links = by_line(occurrences.select("doc_id", "ver", "line"), c.checkpoint(counts)).distinct().groupBy("doc_id", "ver").agg(F.sum("n_near").alias("n_links"))
    found = kept.join(n_links, ["doc_id", "ver"], "full_outer")
    none = F.lit(None).cast(CLASS_DDL)
    if classed:
        found, none = found.join(classes(occurrences, first, linked), ["doc_id", "ver"], "full_outer"), F.array().cast(CLASS_DDL)
    else:
        found = found.withColumn("line_classes", none)
    given = c.documents(df, c.version().alias("ver")).join(found, ["doc_id", "ver"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))).withColumn("line_classes", F.coalesce("line_classes", none))
    return given.select("doc_id", "ver", "text", "kept", "n_links", "line_classes").mapInArrow(c.lean(lambda batches: _cut(batches, least)), CUT_DDL)


def query(df: DataFrame) -> DataFrame:
    """Every document's lines, what is left of them, and its number of links; lines under MIN_CHARS are left alone."""
    return dedup(df, classed=True).drop("text", "ver")


def every_line(df: DataFrame) -> DataFrame:
    """The same for every line with a word: those under MIN_CHARS are joined by equality."""
    return dedup(df, least=1, classed=True).drop("text", "ver")
