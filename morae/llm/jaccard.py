"""N-gram Jaccard join by parity sketches.

A document's set of distinct word shingles is hashed into m parts; a part's sketch is the XOR of its shingles' hashes.
A shingle that only one of two sets holds changes one part at most, so the number of differing parts (the Hamming
distance of the sketches, part by part) is at most the size of the symmetric difference. For similarity p/q and sizes
a <= b that is at most D = (a + b)(q - p)/(q + p) <= 2b(q - p)/(q + p). Sizes are banded and a band has one m; a set is entered
under the keys (band, part, sketch) of its parts in its own band, and in the next one where a larger partner may lie. Empty
parts are left out: as soon as the larger set has more than D parts that are not empty, one of them is equal in both
(pigeonhole). m is chosen so that a set practically always has; sets that don't are counted, and their bands are entered
again with other hashes until every set has been safe once.

A set stands for all documents that have it (a hash of the set names it), so copies never multiply. Sets that meet under a
key are a group. Small groups give their pairs, of which bit sketches (parity again) leave those that may be linked. In a large
group a component grows over all sets that the sketches allow before the next one begins, and only the pairs that connect
sets come out, at most one a set. Sets that such pairs connect, over any others, are a family; every link lies inside one. A
family's whole sets are shipped once and compared exactly, again growing components, and each set comes out with the least
of its component. So no link is lost, and copies cost their links, not their pairs. Groups and families over a bound are
cut into blocks, every two of which meet in a task.

Null or blank text: an empty set, linked with nothing, a component of its own. Fewer words than a shingle: the whole
sequence is the only shingle. Very long texts are taken whole. Repeated rows of one doc_id give a row each. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE = 5
P, Q = 75, 100  # similarity
RATIO = 1.7  # between the bands' bounds
LEVELS = 64  # more sets of hashes than this are never needed
KEYS = pa.schema([("bucket", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("ver", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("node", pa.list_(pa.int64())), ("unsafe", pa.list_(pa.bool_())), ("sketch", pa.list_(pa.binary()))])
KEYS_DDL = "bucket long, payload binary, doc_id array<long>, ver array<long>, n array<long>, node array<long>, unsafe array<boolean>, sketch array<binary>"
MET = pa.schema([("doc_id", pa.int64()), ("ver", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("unsafe", pa.bool_()), ("sketch", pa.binary()), ("members", pa.list_(pa.int64())), ("a", pa.int64()), ("b", pa.int64())])
MET_DDL = "doc_id long, ver long, n long, node long, unsafe boolean, sketch binary, members array<long>, a long, b long"
SMALL = 3  # a group of so many sets gives its pairs
FILTER = 1 << 27  # flags, at most, of the filter that texts pass whose sets are asked for
GROUP, FAMILY = 100_000, 64 << 20  # sets of a group, bytes of a family's sets, that one task compares
CELLS = 1 << 22  # of a matrix
SLICE = 2 << 20


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of similar sets of these sizes."""
    return (a + b) * (Q - P) // (Q + P)


def _tops() -> np.ndarray:
    """The largest size of each band."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, int(tops[-1] * RATIO)))
    return np.array(tops)


TOPS = _tops()


def parts_of(band: np.ndarray) -> np.ndarray:
    top = TOPS[band]
    return np.ceil(1.1 * differing(top, top) + 0.6 * np.sqrt(top) + 6).astype(np.int64)


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, end to end; and where each row's begin."""
    w = c.words(texts, lower=True)
    at, row = c.window_rows(w.first, k)
    own = c.window_hash(w.hashes, k)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        own = np.concatenate([own, c.span_hash(w.hashes, w.first[short], w.first[short + 1], 5)])
        row = np.concatenate([row, short])
    order = np.argsort(own)
    order = order[np.argsort(row[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    own, row = own[order], row[order]
    new = c.first_of_group(row, own)
    own, row = own[new], row[new]
    return own, np.searchsorted(row, np.arange(len(texts) + 1))


def set_names(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return c.signed(c.span_hash(own, at[:-1], at[1:], 6))


def part_keys(own: np.ndarray, at: np.ndarray, rows: np.ndarray, level: int, bands: set[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of every part that the sets of these rows are entered under, and which rows are unsafe at this level."""
    n = np.diff(at)[rows]
    band = np.searchsorted(TOPS, n)
    wide = n * Q // P > TOPS[band]  # a similar set may lie in the next band
    who = np.concatenate([np.arange(len(rows)), np.flatnonzero(wide)])
    into = np.concatenate([band, band[wide] + 1])
    home = np.arange(len(who)) < len(rows)
    if bands is not None:
        keep = np.isin(into, list(bands))
        who, into, home = who[keep], into[keep], home[keep]
    parts = parts_of(into)
    base = np.concatenate([[0], np.cumsum(parts)])
    flat = np.zeros(base[-1], np.uint64)
    size = n[who]
    h = own[c.runs(at[:-1][rows[who]], size)]
    owner = np.repeat(np.arange(len(who)), size)
    place = base[owner] + ((c.mix(h, 10 + level) >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    np.bitwise_xor.at(flat, place, h)
    filled = np.flatnonzero(flat)
    entry = np.searchsorted(base, filled, "right") - 1
    label = (into[entry] * LEVELS + level) << 40 | (filled - base[entry])
    key = c.mix(flat[filled] ^ c.mix(label.astype(np.uint64), 41), 42)
    safe = np.bincount(entry, minlength=len(who)) > differing(size, size)
    return rows[who[entry]], key, np.isin(rows, rows[who[home & ~safe]])


def _keys(batches: Iterator[pa.RecordBatch], buckets: int, level: int, bands: set[int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            own, at = shingles(c.column(part, "text"))
            n = np.diff(at)
            node = set_names(own, at)
            _, one = np.unique(node, return_index=True)
            one = one[n[one] > 0]
            row, key, bad = part_keys(own, at, one, level, bands)
            unsafe = np.isin(node, node[one[bad]])
            sketch = np.array(sketches(own, at), object)
            sketch[np.setdiff1d(np.arange(len(n)), one)] = None  # one of equal sets brings it
            rows = {"doc_id": [c.numbers(part, "doc_id")], "ver": [c.numbers(part, "ver")], "n": [n], "node": [node], "unsafe": [unsafe], "sketch": [sketch.tolist()]}
            yield c.named(KEYS, bucket=[-1 - int(node[0]) % buckets], payload=c.binary([None]), **rows)
            to = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to.astype(np.uint16) if buckets < 65536 else to, kind="stable")
            to, row = to[order], row[order]
            six = np.ascontiguousarray((key[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
            cut = np.append(np.flatnonzero(c.first_of_group(to)), len(to)).tolist() if len(to) else []
            payloads = []
            for a, b in zip(cut, cut[1:], strict=False):
                used, index = np.unique(row[a:b], return_inverse=True)
                payloads.append(b"".join([np.array([len(used), b - a], "<i8").tobytes(), node[used].astype("<i8").tobytes(), index.astype("<u2" if len(used) < 65536 else "<u4").tobytes(), six[a:b].tobytes()]))
            if payloads:
                nothing = [None] * len(payloads)
                yield c.named(KEYS, bucket=to[cut[:-1]], payload=c.binary(payloads), doc_id=nothing, ver=nothing, n=nothing, node=nothing, unsafe=nothing, sketch=nothing)


def _groups(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the nodes that share a key of the bucket: the distinct pairs (a > b) of small groups, and the distinct large groups."""
    nodes, keys = [], []
    for raw in payloads:
        n, m = np.frombuffer(raw, "<i8", 2)
        wide = 2 if n < 65536 else 4
        nodes.append(np.frombuffer(raw, "<i8", n, 16)[np.frombuffer(raw, f"<u{wide}", m, 16 + 8 * n)])
        key = np.zeros((m, 8), np.uint8)
        key[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, 16 + 8 * n + wide * m).reshape(m, 6)
        keys.append(key.view("<u8").ravel())
    node, key = np.concatenate(nodes), np.concatenate(keys)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(key), bool)
    twin[1:] = same
    twin[:-1] |= same
    own = order[twin]
    own = own[np.lexsort((node[own], key[own]))]
    own = own[c.first_of_group(key[own], node[own])]
    head = np.append(np.flatnonzero(c.first_of_group(key[own])), len(own))
    size = np.diff(head)
    node = node[own]
    at = np.arange(len(node))
    last = np.repeat(head[1:], size)
    small = np.repeat(size <= SMALL, size)
    pairs = np.zeros(0, np.dtype([("a", "<i8"), ("b", "<i8")]))
    for step in range(1, SMALL):
        low = at[small & (at + step < last)]
        found = np.zeros(len(low), pairs.dtype)
        found["a"], found["b"] = node[low + step], node[low]
        pairs = np.union1d(pairs, found)
    name = c.span_hash(node.view(np.uint64), head[:-1], head[1:], 7)
    large = np.flatnonzero(size > SMALL)
    _, first = np.unique(name[large], return_index=True)
    first = large[first]
    groups = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size[first])]).astype(np.int32), pa.array(node[c.runs(head[:-1][first], size[first])]))
    return pairs["a"], pairs["b"], groups


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[int, list[bytes]] = defaultdict(list)

    def rows(size: int, **columns) -> pa.RecordBatch:
        return c.named(MET, **{f.name: pa.nulls(size, f.type) for f in MET} | columns)

    for batch in batches:
        for k, (bucket, payload) in enumerate(zip(c.column(batch, "bucket").to_pylist(), c.column(batch, "payload").to_pylist(), strict=True)):
            if bucket >= 0:
                own[bucket].append(payload)
                continue
            found = {x: c.column(batch, x).slice(k, 1).flatten() for x in ("doc_id", "ver", "n", "node", "unsafe", "sketch")}
            yield rows(len(found["n"]), **found)
    while own:
        a, b, groups = _groups(own.popitem()[1])
        yield rows(len(a), a=a, b=b)
        yield rows(len(groups), members=groups)


def _width(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n."""
    return 1 << np.ceil(np.log2(np.maximum(256, 2 * n))).astype(np.int64)


def sketches(own: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The bit sketch of each set: every shingle flips one bit."""
    n = np.diff(at)
    bits = _width(n)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    flips = np.bincount(base[owner] + (c.mix(own, 50) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=base[-1])
    packed = np.packbits(flips.astype(np.uint8) & np.uint8(1), bitorder="little").tobytes()
    edge = (base // 8).tolist()
    return [packed[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _bits(ids: np.ndarray, flags: int) -> np.ndarray:
    return (c.mix(ids.astype(np.int64).view(np.uint64), 60) >> np.uint64(64 - flags.bit_length() + 1)).astype(np.int64)


def _filter(wanted: DataFrame, flags: int) -> np.ndarray:
    """So many flags: which hashes of doc_id are wanted. Collected from a few tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(flags, bool)
        for batch in batches:
            own[_bits(c.numbers(batch, "doc_id"), flags)] = True
        yield pa.RecordBatch.from_arrays([c.binary([np.packbits(own).tobytes()])], ["flags"])

    parts = wanted.select("doc_id").coalesce(8).mapInArrow(c.lean(run), "flags binary").collect()
    return reduce(np.bitwise_or, [np.frombuffer(x["flags"], np.uint8) for x in parts], np.zeros(flags // 8, np.uint8))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set of the wanted (node, doc_id): a map over the texts that a filter of doc_ids passes; where too many are wanted
    for a filter of bounded size, over those that a join leaves."""
    flags = max(1 << 16, 1 << (8 * wanted.count()).bit_length())
    shared = None
    if flags <= FILTER:
        shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted, flags))
    else:
        docs = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            some = batch if all_ is None else batch.filter(pa.array(all_[_bits(c.numbers(batch, "doc_id"), flags)]))
            for part in c.slices(some, limit=SLICE) if some.num_rows else ():
                own, at = shingles(c.column(part, "text"))
                raw, cut = own.tobytes(), (8 * at).tolist()
                yield pa.RecordBatch.from_arrays([c.column(part, "doc_id"), c.binary([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]), pa.array(set_names(own, at))], ["doc_id", "data", "name"])

    found = docs.mapInArrow(c.lean(run), "doc_id long, data binary, name long").join(wanted, "doc_id").where("name = node")
    return found.select("node", "data").dropDuplicates(["node"])


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of at least so many bits, folded to it."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 64), axis=0) for x in sketches])


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sizes and bit sketches allow a link."""
    for batch in batches:
        n, m = c.numbers(batch, "n_a"), c.numbers(batch, "n_b")
        good = (n * P <= m * Q) & (m * P <= n * Q)
        width = np.minimum(_width(n), _width(m))
        x, y = c.column(batch, "x").to_pylist(), c.column(batch, "y").to_pylist()
        for w in np.unique(width[good]).tolist():
            own = np.flatnonzero(good & (width == w))
            d = np.bitwise_count(_folded([x[i] for i in own], w) ^ _folded([y[i] for i in own], w)).sum(1, dtype=np.int64)
            good[own] = d <= differing(n[own], m[own])
        yield pa.RecordBatch.from_arrays([c.column(batch, "a"), c.column(batch, "b")], ["a", "b"]).filter(pa.array(good))


class Sketches:
    """Bit sketches of sets, and which pairs of them allow a link."""

    def __init__(self, n: np.ndarray, data: list[bytes]):
        self.n, self.width, self.at = n, _width(n), np.zeros(len(n), np.int64)
        self.full: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}  # folded to the next narrower width
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.full[w] = np.frombuffer(b"".join([data[i] for i in own.tolist()]), np.uint64).reshape(len(own), w // 64)
            self.half[w] = self.full[w][:, : w // 128] ^ self.full[w][:, w // 128 :]

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), bool)
        for w in np.unique(self.width[a]).tolist():
            i = np.flatnonzero(self.width[a] == w)
            # similar sets have equal widths, or one twice the other
            for v, left, right in ((w, self.full, self.full), (w // 2, self.half, self.full), (2 * w, self.full, self.half)):
                for j in _cut(np.flatnonzero(self.width[b] == v), 1 << 12):
                    x, y = self.n[a[i]][:, None], self.n[b[j]][None]
                    ok = (x * P <= y * Q) & (y * P <= x * Q)
                    if ok.any():
                        d = _distance(left[w][self.at[a[i]]], right[v][self.at[b[j]]])
                        out[np.ix_(i, j)] = ok & (d <= differing(x, y))
        return out


def _cut(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for k in range(0, len(rows), size):
        yield rows[k : k + size]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a and each row of b."""
    if len(a) * len(b) * a.shape[1] <= 1 << 18:
        return np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=np.int64)
    d = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        d += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return d


class Sets:
    """Whole sets, and which pairs of them are linked: intersections are products of rows over the shingles of several sets."""

    def __init__(self, n: np.ndarray, data: list[bytes]):
        self.n = n
        _, column, times = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True, return_counts=True)
        shared = times > 1
        keep = shared[column]
        self.column = (np.cumsum(shared) - 1)[column[keep]]
        self.at = np.searchsorted(np.repeat(np.arange(len(n)), n)[keep], np.arange(len(n) + 1))
        self.wide = max(1, int(shared.sum()))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.wide), np.float32 if self.wide < 1 << 24 else np.float64)
        size = self.at[rows + 1] - self.at[rows]
        out[np.repeat(np.arange(len(rows)), size), self.column[c.runs(self.at[rows], size)]] = 1
        return out

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), bool)
        step = max(1, CELLS // self.wide)
        for i in range(0, len(a), step):
            left = self.dense(a[i : i + step])
            for j in range(0, len(b), step):
                both = (left @ self.dense(b[j : j + step]).T).astype(np.int64)
                total = self.n[a[i : i + step]][:, None] + self.n[b[j : j + step]][None]
                out[i : i + step, j : j + step] = Q * both >= P * (total - both)
        return out


def spanning(comp: np.ndarray, match: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all that `match` (rows, rows: which pairs) connects, besides what is in one component already.

    A component grows over all rows that are left before the next one begins, so a row is compared with what is outside its
    component only, and there is at most a pair a row.
    """
    _, comp, size = np.unique(comp, return_inverse=True, return_counts=True)
    left, found = np.ones(len(comp), bool), []
    order = np.lexsort((comp, -size[comp]))
    while True:
        order = order[left[order]]
        if not len(order) or comp[order[0]] == comp[order[-1]]:
            break
        if size[comp[order[0]]] > 1:
            queue = order[comp[order] == comp[order[0]]]
        else:  # of several single rows, that with most partners; those without any are done
            seeds, rest = order[:block], np.sort(order)
            hit = match(seeds, rest)
            hit[np.arange(len(seeds)), np.searchsorted(rest, seeds)] = False
            partners = hit.sum(1)
            left[seeds[partners == 0]] = False
            if not partners.any():
                continue
            queue = seeds[[partners.argmax()]]
        left[queue] = False
        while len(queue):
            from_, queue = queue[:block], queue[block:]
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            hit = match(from_, rest)
            reached = hit.any(0)
            if reached.any():
                child, parent = rest[reached], from_[hit[:, reached].argmax(0)]
                kinds, one = np.unique(comp[child], return_index=True)
                found.append((child[one], parent[one]))
                new = rest[np.isin(comp[rest], kinds)]
                left[new] = False
                queue = np.concatenate([queue, new])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _connected(kind: type, per_group: bool):
    """From rows (group, i, j, node, n, data) sorted by group, i, j: sets that connect, each with the least of its component, in
    each group, or over all groups of a task, which then bring out hardly more pairs than sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        def least() -> Iterator[pa.RecordBatch]:
            node = np.unique(np.array([*root, *root.values()], np.int64))
            yield c.named(LINKS, a=node, b=[find(x) for x in node.tolist()])
            root.clear()

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            node = c.numbers(whole, "node")
            comp = np.array([find(x) for x in node.tolist()], np.int64)
            if (comp == comp[0]).all():
                return
            a, b = spanning(comp, kind(c.numbers(whole, "n"), c.column(whole, "data").to_pylist()).match)
            for x, y in zip(node[a].tolist(), node[b].tolist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            if per_group:
                yield from least()

        now = None
        for batch in batches:
            key = [c.numbers(batch, x) for x in ("group", "i", "j")]
            edge = np.append(np.flatnonzero(c.first_of_group(*key)), batch.num_rows).tolist() if batch.num_rows else []
            for at, to in zip(edge, edge[1:], strict=False):
                name = tuple(int(k[at]) for k in key)
                if name != now:
                    yield from done()
                    now = name
                held.append(batch.slice(at, to - at))
        yield from done()
        yield from least()

    return run


def _dealt(rows: DataFrame, weight: Column, limit: int) -> tuple[DataFrame, bool]:
    """Rows (group, node, ...) with i, j, and whether a group was split: one over the limit is cut into blocks of sets, and every
    two blocks meet in a group of their own."""
    large = rows.groupBy("group").agg(F.sum(weight).alias("all")).where(F.col("all") > limit)
    large = c.checkpoint(large.select("group", F.ceil(2 * F.col("all") / limit).cast("int").alias("blocks")))
    if large.isEmpty():
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0)}), False
    rows = rows.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    return rows.withColumn("block", F.explode(pairs)).withColumns({"i": F.col("block.i"), "j": F.col("block.j")}).drop("block", "blocks"), True


def _links(rows: DataFrame, data: DataFrame, kind: type, per_group: bool) -> DataFrame:
    own = rows.join(data, "node").select("group", "i", "j", "node", "n", "data")
    return own.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(c.lean(_connected(kind, per_group)), "a long, b long")


def join(df: DataFrame, bucket_mb: float = 8) -> DataFrame:
    """doc_id, ver, n_shingles, component_id and component (the set that names it) of every row."""
    docs = c.documents(df, c.version().alias("ver"))
    buckets = c.buckets(docs, bucket_mb)

    def met(level: int, bands: set[int] | None) -> DataFrame:
        dealt = docs.mapInArrow(c.lean(lambda batches: _keys(batches, buckets, level, bands)), KEYS_DDL).repartition(buckets, "bucket")
        return c.written(dealt.mapInArrow(c.lean(_meet), MET_DDL))

    found = met(0, None)
    every = [found]
    unsafe = found.where("unsafe").select("node", "n").distinct()
    level = 0
    while not unsafe.isEmpty():  # their bands once more, with other hashes
        level += 1
        if level == LEVELS:
            raise RuntimeError(f"sets without enough parts after {LEVELS} sets of hashes")
        bands = {int(np.searchsorted(TOPS, r["n"])) for r in unsafe.select("n").distinct().collect()}  # a few sizes
        every.append(met(level, bands))
        unsafe = c.checkpoint(unsafe.join(every[-1].where("unsafe").select("node").distinct(), "node", "left_semi"))
    rows = found.where("doc_id is not null").select("doc_id", "ver", "n", "node", "sketch")
    names = c.written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("data")))
    met_pairs, groups = [reduce(DataFrame.unionByName, [x.where(f"{k} is not null").select(*columns) for x in every]) for k, columns in (("a", ("a", "b")), ("members", ("members",)))]
    side = lambda x, y: names.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("data").alias(y))
    small = met_pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(c.lean(_allowed), "a long, b long")
    groups = groups.groupBy(F.xxhash64("members").alias("group")).agg(F.first("members").alias("members"))
    members, _ = _dealt(groups.select("group", F.explode("members").alias("node")), F.lit(1), GROUP)
    large = _links(members, names.select("node", "n", "data"), Sketches, False)
    # families: sets that may be linked, over any others; each set is in one, and there compared with the others as a whole
    allowed = c.written(small.unionByName(large).where("a <> b").distinct())
    families = c.components(allowed.select(F.explode(F.array("a", "b")).alias("node")).distinct(), allowed)
    families = c.written(families.join(names.select("node", "doc_id", "n"), "node").select(F.col("component").alias("group"), "node", "doc_id", "n"))
    dealt, split = _dealt(families.select("group", "node", "n"), 8 * F.col("n"), FAMILY)
    linked = c.checkpoint(_links(dealt, _sets(docs, families.select("node", "doc_id")), Sets, True))
    nodes = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    components = c.components(nodes, linked) if split else linked.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = families.select("node", "doc_id").join(components, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = components.join(least, "component").select("node", "component_id", "component")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "least"))
    rows = rows.drop("sketch").join(names.select("node", F.col("doc_id").alias("least")), "node").join(label, "node", "left")
    return rows.select("doc_id", "ver", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce("component", "node").alias("component"))


def query(df: DataFrame) -> DataFrame:
    """Every document's set size and component."""
    return join(df).drop("ver", "component")
