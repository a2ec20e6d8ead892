"""Spelling variants: words one inserted, deleted or replaced code point apart, by tries and Levenshtein automata.

Words are runs of `[A-Za-z\\u00C0-\\u00FF]`, so a code point is a byte of Latin-1. Counted words of at least `MIN_LENGTH` code points
and `MIN_COUNT` occurrences are sorted by range and cut into shards of at most `SHARD` letters; each becomes a compact trie of flat
arrays, in which a word that shares its prefix with no other one ends in a leaf. Shards are broadcast in rounds of at most `ROUND` bytes (a
longer word is a shard, and may be a round, of its own), so the vocabulary may grow: more rounds, not more memory. A task
walks its words down every shard of the round depth-first: the exact path of a word, and from each of its nodes the branches
where the word's automaton spends its one edit, which is always at the first letter that differs, so that every neighbour is found once.
A block of words walks together, as arrays of states. Neighbours aren't shipped: a task sends a word's count and its best
neighbour for each shard, combined before the shuffle. Forms are followed to their roots by pointer doubling; counts at least double along
a path, so a few rounds do.

Null text: no words; null doc_id: as the empty text in the hash. Very long texts are cut into words whole; very long words are words
like others. Ties between forms: the least in code-point order. Repeated rows count each. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
DAMAGE = 97
SHARD = 1 << 20
ROUND = 32 << 20
BLOCK = 2048  # words that walk together
SLICE = 4 << 20
VECTOR_BYTES = 64  # longer words are hashed one by one

LEAD = 0xC3
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), LEAD]] = True
_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1).astype(np.uint32)  # the polynomial of crc32

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


# --------------------------------------------------------------------------------------------------------------- words


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], going on from the checksums `before`."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    short = np.flatnonzero(size <= VECTOR_BYTES)
    order = short[np.argsort(-size[short], kind="stable")]
    lasting = np.searchsorted(-size[order], -np.arange(VECTOR_BYTES), "left")  # how many have a byte at each place
    for k in range(VECTOR_BYTES):
        own = order[: lasting[k]]
        if not len(own):
            break
        state[own] = _crc[(state[own] ^ data[starts[own] + k]) & np.uint32(255)] ^ (state[own] >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > VECTOR_BYTES):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def counted(part: pa.RecordBatch, damage: int = DAMAGE, least: int = MIN_LENGTH) -> tuple[list[bytes], list[int]]:
    """The distinct words of a slice (doc_id, text), in UTF-8, and how often they occur."""
    data, at = c.string_bytes(c.column(part, "text"))
    data = c.LOWER[data]
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = _letter[data]
    ink[1:-1] |= data[:-1] == LEAD
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[at[:-1]] = True  # a row begins
    starts, ends = np.flatnonzero(ink & (~before | cut)), np.flatnonzero(before & (~ink | cut))
    if not len(starts):
        return [], []
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == LEAD, out=wide[1:])
    length = (ends - starts) - (wide[ends] - wide[starts])
    ids = c.column(part, "doc_id").to_pylist()
    head = np.array([zlib.crc32(b"%s:" % (b"" if d is None else str(d).encode())) for d in ids], np.uint32)
    row = np.searchsorted(at, starts, "right") - 1
    h = checksums(data, starts, ends, head[row])
    hit = h % np.uint32(damage) == 0
    whole = np.flatnonzero(~hit & (length >= least))
    hashes = c.span_hash(data, starts[whole], ends[whole])
    _, first, n = np.unique(hashes, return_index=True, return_counts=True)
    own, raw = whole[first], data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
    hurt = Counter()
    for i in np.flatnonzero(hit & (length > least)).tolist():
        word = raw[starts[i] : ends[i]].decode()
        k = int(h[i]) % len(word)
        hurt[(word[:k] + word[k + 1 :]).encode()] += 1
    return words + list(hurt), n.tolist() + list(hurt.values())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            words, n = counted(part)
            if words:
                yield c.named(COUNTS, word=pa.array(words, pa.binary()).cast(pa.string()), n=np.array(n, np.int64))


# ---------------------------------------------------------------------------------------------------------------- tries


@dataclass
class Letters:
    """Words in Latin-1, end to end, and prefix sums for hashes of their parts."""

    data: np.ndarray
    at: np.ndarray
    n: np.ndarray

    def __post_init__(self) -> None:
        self.size = np.diff(self.at)
        self.sums = np.zeros(len(self.data) + 1, c.U)
        np.cumsum((self.data.astype(c.U) + c.U(1)) * c.powers(c.BASE, len(self.data)), out=self.sums[1:])
        self.inverse = c.powers(pow(c.BASE, -1, 1 << 64), len(self.data) + 1)

    @classmethod
    def of(cls, words: list[str], n: np.ndarray) -> Letters:
        raw = [w.encode("latin-1") for w in words]
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(w) for w in raw], out=at[1:])
        return cls(np.frombuffer(b"".join(raw), np.uint8), at, n)

    def hashes(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        a = self.at[word] + begin
        return (self.sums[self.at[word] + end] - self.sums[a]) * self.inverse[a]

    def letter(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.data[self.at[word] + k]

    def text(self, word: int) -> str:
        return self.data[self.at[word] : self.at[word + 1]].tobytes().decode("latin-1")


def equal_parts(a: Letters, u: np.ndarray, i: np.ndarray, b: Letters, v: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a's word u from i on and b's word v from j on agree for `size` letters: by hash, then letter by letter."""
    same = a.hashes(u, i, i + size) == b.hashes(v, j, j + size)
    own = np.flatnonzero(same & (size > 0))
    if len(own):
        n = size[own]
        differ = a.data[c.runs(a.at[u[own]] + i[own], n)] != b.data[c.runs(b.at[v[own]] + j[own], n)]
        same[own] = c.row_sums(differ, np.concatenate([[0], np.cumsum(n)])) == 0
    return same


class Trie:
    """A compact trie over sorted distinct words. Nodes are numbered level by level, so the children of a node are neighbours.

    parent, byte: of each node but the root's. word: the word that ends at an inner node, or -1; of a leaf its only word, whose rest isn't
    spelled out. leaf: whether a node is one.
    """

    def __init__(self, words: Letters, parent: np.ndarray, byte: np.ndarray, word: np.ndarray, leaf: np.ndarray):
        self.words, self.parent, self.byte, self.word, self.leaf = words, parent, byte, word, leaf
        self.keys = parent.astype(np.int64) * 256 + byte
        self.keys[0] = -1
        self.first = np.searchsorted(self.keys, np.arange(len(parent), dtype=np.int64) * 256)
        self.children = np.searchsorted(self.keys, (np.arange(len(parent), dtype=np.int64) + 1) * 256) - self.first

    @classmethod
    def of(cls, words: Letters) -> Trie:
        parent, byte, word, leaf = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], [np.full(1, -1)], [np.zeros(1, bool)]
        node, low, high = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(words.size))
        total, depth = 1, 0
        while len(node):
            own = c.runs(low, high - low)
            group = np.repeat(np.arange(len(node)), high - low)
            ended = words.size[own] == depth
            ends = np.full(len(node), -1)
            ends[group[ended]] = own[ended]
            own, group = own[~ended], group[~ended]
            # the inner nodes of this level lie in the last table of nodes
            word[-1][node - (total - len(word[-1]))] = ends
            letter = words.letter(own, np.full(len(own), depth))
            new = np.flatnonzero(c.first_of_group(group, letter)) if len(own) else np.zeros(0, np.int64)
            if not len(new):
                break
            sizes = np.diff(np.append(new, len(own)))
            parent.append(node[group[new]])
            byte.append(letter[new])
            leaf.append(sizes == 1)
            word.append(np.where(sizes == 1, own[new], -1))
            inner = np.flatnonzero(sizes > 1)
            node, low = total + inner, own[new][inner]
            high = low + sizes[inner]
            total += len(new)
            depth += 1
        return cls(words, *(np.concatenate(x) for x in (parent, byte, word, leaf)))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, or -1."""
        key = node * 256 + letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def packed(self) -> bytes:
        w = self.words
        head = np.array([len(w.size), len(w.data), len(self.parent)], np.int64)
        arrays = (head, w.size.astype(np.int32), w.n.astype(np.int64), w.data, self.parent.astype(np.int32), self.byte.astype(np.uint8), self.word.astype(np.int32), self.leaf)
        return b"".join(x.tobytes() for x in arrays)

    @classmethod
    def unpacked(cls, raw: bytes) -> Trie:
        n, letters, nodes = np.frombuffer(raw, np.int64, 3)
        at, out = 24, []
        for kind, size in ((np.int32, n), (np.int64, n), (np.uint8, letters), (np.int32, nodes), (np.uint8, nodes), (np.int32, nodes), (bool, nodes)):
            out.append(np.frombuffer(raw, kind, int(size), at))
            at += int(size) * np.dtype(kind).itemsize
        size, count, data, parent, byte, word, leaf = out
        starts = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=starts[1:])
        return cls(Letters(data, starts, count), parent.astype(np.int64), byte, word.astype(np.int64), leaf)


def _shards(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words to packed tries."""
    words: list[str] = []
    n: list[int] = []
    held = 0

    def row() -> pa.RecordBatch:
        raw = Trie.of(Letters.of(words, np.array(n, np.int64))).packed()
        return pa.RecordBatch.from_arrays([pa.array([words[0]]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], ["first", "size", "trie"])

    for batch in batches:
        for word, count in zip(c.column(batch, "word").to_pylist(), c.numbers(batch, "n").tolist(), strict=True):
            if words and held + len(word) > limit:
                yield row()
                words, n, held = [], [], 0
            words.append(word)
            n.append(count)
            held += len(word)
    if words:
        yield row()


# --------------------------------------------------------------------------------------------------------------- search


def _edited(trie: Trie, own: Letters, w: np.ndarray, node: np.ndarray, i: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words w that have spent their edit and have to follow the trie exactly from letter i on: (w, found word)."""
    words = trie.words
    while len(w):
        leaf = trie.leaf[node]
        at = np.flatnonzero(leaf)
        if len(at):
            u, t, k, d = w[at], trie.word[node[at]], i[at], depth[at]
            fits = np.flatnonzero(words.size[t] - d == own.size[u] - k)
            u, t, k, d = u[fits], t[fits], k[fits], d[fits]
            same = equal_parts(own, u, k, words, t, d, own.size[u] - k)
            yield u[same], t[same]
        at = np.flatnonzero(~leaf & (i == own.size[w]) & (trie.word[node] >= 0))
        yield w[at], trie.word[node[at]]
        at = np.flatnonzero(~leaf & (i < own.size[w]))
        w, node, i, depth = w[at], node[at], i[at], depth[at]
        node = trie.child(node, own.letter(w, i))
        at = np.flatnonzero(node >= 0)
        w, node, i, depth = w[at], node[at], i[at] + 1, depth[at] + 1


def _ended(trie: Trie, own: Letters, w: np.ndarray, t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose exact path of `depth` letters has come to a leaf: those one edit from the leaf's word."""
    words = trie.words
    fits = np.flatnonzero(np.abs(own.size[w] - words.size[t]) <= 1)
    w, t = w[fits], t[fits]
    n, m = own.size[w], words.size[t]
    low, high = np.full(len(w), depth), np.minimum(n, m)  # the first letters that differ, by halving
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = own.hashes(w, low, middle) == words.hashes(t, low, middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    i, j = low + (n >= m), low + (m >= n)
    good = np.flatnonzero((n != m) | (low < n))
    w, t, i, j = w[good], t[good], i[good], j[good]
    same = equal_parts(own, w, i, words, t, j, own.size[w] - i)
    same &= equal_parts(own, w, np.zeros_like(i), words, t, np.zeros_like(i), low[good])
    return w[same], t[same]


def near(trie: Trie, own: Letters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (word of own, word of the trie) exactly one edit apart, each once."""
    w = np.arange(len(own.size))
    node = np.zeros(len(w), np.int64)
    depth = 0
    while len(w):
        rest = own.size[w] - depth
        next_ = np.full(len(w), -1)  # the letter at this depth
        has = np.flatnonzero(rest > 0)
        next_[has] = own.letter(w[has], np.full(len(has), depth))
        # branches by another letter: put in before the word's own one, or instead of it
        n = trie.children[node]
        child, who = c.runs(trie.first[node], n), np.repeat(np.arange(len(w)), n)
        other = np.flatnonzero(trie.byte[child] != next_[who])
        child, who = child[other], who[other]
        yield from _edited(trie, own, w[who], child, np.full(len(who), depth), np.full(len(who), depth + 1))
        instead = np.flatnonzero(rest[who] > 0)
        child, who = child[instead], who[instead]
        yield from _edited(trie, own, w[who], child, np.full(len(who), depth + 1), np.full(len(who), depth + 1))
        # without the word's letter: its last one, or one that the next letter differs from
        last = np.flatnonzero((rest == 1) & (trie.word[node] >= 0))
        yield w[last], trie.word[node[last]]
        two = np.flatnonzero(rest > 1)
        after = own.letter(w[two], np.full(len(two), depth + 1))
        two, after = two[after != next_[two]], after[after != next_[two]]
        child = trie.child(node[two], after)
        two, child = two[child >= 0], child[child >= 0]
        yield from _edited(trie, own, w[two], child, np.full(len(two), depth + 2), np.full(len(two), depth + 1))
        # the exact path
        w, next_, node = w[has], next_[has], node[has]
        node = trie.child(node, next_)
        w, node = w[node >= 0], node[node >= 0]
        leaf = trie.leaf[node]
        depth += 1
        yield _ended(trie, own, w[leaf], trie.word[node[leaf]], depth)
        w, node = w[~leaf], node[~leaf]


def reduced(trie: Trie, own: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word with neighbours in the trie: the word, their number, and the most frequent one (ties: the least)."""
    pairs = [x for x in near(trie, own) if len(x[0])]
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    w, t = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((t, -trie.words.n[t], w))
    w, t = w[order], t[order]
    first = np.flatnonzero(c.first_of_group(w))
    return w[first], np.diff(np.append(first, len(w))), t[first]


def _search(shards, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries = [Trie.unpacked(raw) for raw in shards.value]
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            texts = c.column(part, "word").to_pylist()
            own = Letters.of(texts, c.numbers(part, "n"))
            for trie in tries:
                w, n, t = reduced(trie, own)
                if len(w):
                    yield c.named(FOUND, word=pa.array([texts[i] for i in w.tolist()]), n_near=n.astype(np.int64), best_n=trie.words.n[t], best=pa.array([trie.words.text(i) for i in t.tolist()]))


# ---------------------------------------------------------------------------------------------------------------- query


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n."""
    own = c.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), _count, "word string, n long")
    return own.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _best() -> Column:
    """Of the greatest best_n the least best."""
    return F.min(F.struct((-F.col("best_n")).alias("less"), "best"))


def neighbours(words: DataFrame, shard: int = SHARD, round_: int = ROUND) -> DataFrame:
    """word, n_near, best (its most frequent neighbour), best_n; words without neighbours are left out. words is read in every round."""
    spark = words.sparkSession
    letters, n = words.agg(F.sum(F.char_length("word")), F.count("*")).first()
    parts = max(1, -(-(letters or 0) // shard))
    shards = c.written(c.mapped(words.repartitionByRange(parts, "word").sortWithinPartitions("word"), partial(_shards, shard), "first string, size long, trie binary"))
    sizes = shards.orderBy("first").select("first", "size").collect()  # a short row a shard
    rounds: list[list] = []
    for row in sizes:
        if not rounds or sum(x["size"] for x in rounds[-1]) + row["size"] > round_:
            rounds.append([])
        rounds[-1].append(row)
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, -(-n // (8 * BLOCK))))
    path = f"{c.shared(spark)}/near-{uuid.uuid4().hex}"
    for k, own in enumerate(rounds):
        tries = [bytes(r["trie"]) for r in shards.where(F.col("first").between(own[0]["first"], own[-1]["first"])).orderBy("first").select("trie").collect()]
        sent = spark.sparkContext.broadcast(tries)  # at most round_ bytes
        found = c.mapped(spread, partial(_search, sent), "word string, n_near long, best_n long, best string")
        found.groupBy("word").agg(F.sum("n_near").alias("n_near"), _best().alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best").write.parquet(f"{path}/round={k}")
        sent.destroy()
    if not rounds:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    return spark.read.parquet(path).groupBy("word").agg(F.sum("n_near").alias("n_near"), _best().alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def rooted(links: DataFrame) -> DataFrame:
    """word, root of each link (word, form): the end of its path. Paths double their length in a round."""
    own = c.checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        step = own.select(F.col("word").alias("root"), F.col("root").alias("next"))
        own = c.checkpoint(own.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if own.where("moved").isEmpty():
            return own.select("word", "root")
        own = own.select("word", "root")


def grouped(docs: DataFrame, shard: int = SHARD, round_: int = ROUND) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = c.written(vocabulary(docs))
    found = neighbours(words, shard, round_)
    fits = F.col("best_n") >= FACTOR * F.col("n")
    out = c.written(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    roots = rooted(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return grouped(docs)
