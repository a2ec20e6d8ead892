"""Language-model scoring by online logistic context mixing over bits.

The text's tokens are its words, lower-cased, and one end token. A token is written in bits: those of its bin's Huffman code (a
hash deals tokens to LEAVES bins), then its share of the bin, which is exact for tokens with counts; a token without any is
spelled, in the bits of its bytes. Every bit of a bin's code is predicted from several contexts: the kind that the text's words
so far speak for, the preceding word, and the two preceding words. Each is hashed, together with the code's bits so far, to
a slot that holds how often a 0 and a 1 came. The predictions are stretched to log odds and combined by the weights of a gate,
the longest context that has been seen; an adaptive table, indexed by gate and the mixer's output, refines the result. Bits of
spelled bytes are predicted and mixed likewise, from the last bytes and the word's beginning. Before all of these stands one
more bit: whether the token is the one that followed the last two words where the text had them before.

A token's probability is a mixture of this and of the corpus counts of whole tokens in the text's kind so far (absolute
discounting; what the discount frees goes to the spelling), in one of the proportions SHARES. A text's probability is the mixture
over the proportions: every token read adapts their weights.

Learning takes the running text of all training documents and no sample. Each partition learns online: a slice is predicted from
what the partition has counted before it, moves the weights, and is counted. Slot counts and the refining tables are added up
over partitions (a tree of sums with bounded fan-in), weights averaged by mass. The mixer has a fixed size, so it may be collected
and sent to the tasks; token counts grow with the corpus. The spelling learns the same way from each distinct token. Kinds
come from the common words (hashed to BINS) and how often they share documents: two sums of fixed size, clustered on the driver.
Tokens are counted by kind (a shuffle in proportion to the input). Scoring needs each token's own counts: blocks of the input
(what one scan reads of one file) ask the vocabulary for their distinct tokens and get the counts back by a join, so that no
task holds the vocabulary.

Null text: as empty, hence the end token alone. An empty training set: counts of zero and a model of even odds. Very long texts
are modelled whole, in one slice. Repeated rows are scored each, and learned each. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .chunk_table import ChunkTable

CLASSES, BINS, COMMON = 4, 1 << 14, 256
LEAVES = 1 << 10  # bins of the code: so many bins of words, and one of the end token
WORDS = 2  # hashed contexts of a code's bit: so many words before it
BYTES = (1, 3)  # contexts of a spelled bit: so many bytes, and the word's beginning
SLOTS, SPELLED = 1 << 20, 1 << 18  # of a hashed context
RATE, BATCH = 0.02, 1 << 13
STEPS = 33  # of the refining table, over log odds from -8 to 8
MATCHES = 3  # states of what followed before: the last one failed, held, the last two held
DISCOUNT, SHARED = 0.5, 0.03
SHARES = (0.1, 0.5, 0.9)  # of the mixer in a token's probability
SLICE = 1 << 18
STREAM = 1 << 18  # bytes of running text that are modelled at once
EVENTS = 1 << 13  # tokens whose bits are spread out at once: what stays in a core's cache
LEARN = 4  # weights and refining tables learn from every so manieth of these (counts take in all)
HELD_OUT = 10  # crc32(doc_id as text) modulo this
END = np.uint64(c.MIX[1])  # hash of the end token
LOG10 = np.float32(np.log10(np.e))


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"%d" % x) % HELD_OUT == 0 for x in ids.tolist()], bool)


# ------------------------------------------------------------------------------------------------------------- the mixer


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.1)) / (n0 + np.float32(0.1)))


def mixed(inputs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gate (the last context seen, shortest first) and the mixer's log odds."""
    gate = np.zeros(inputs.shape[1], np.int64)
    for k in range(1, len(inputs)):
        np.copyto(gate, k, where=inputs[k] != 0)
    odds = np.zeros(inputs.shape[1], np.float32)
    for k, own in enumerate(inputs):
        odds += own * weights[:, k].take(gate)
    return gate, odds


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


class Online:
    """One online pass over events (place: inputs x events, the slots; bit: events): mixing weights, slot counts, and how often
    each bit came where the mixer said what."""

    def __init__(self, slots: int, inputs: int, dense: int = 0):
        self.dense = dense  # slots that the first input has to itself
        self.counts = np.zeros(slots, np.int64)  # a 0's count in the low half, a 1's in the high
        self.weights = np.full((inputs, inputs), 0.4, np.float32)
        self.refined = np.zeros((2, inputs, STEPS), np.int64)
        self.mass = self.turn = 0

    def __call__(self, place: np.ndarray, bit: np.ndarray) -> None:
        if self.turn % LEARN == 0:
            for a in range(0, len(bit), BATCH):
                self._learn(place[:, a : a + BATCH], bit[a : a + BATCH])
            self.mass += len(bit)
        self.turn += 1
        counts, hashed = self.counts.view(np.int32), place
        if self.dense:  # few slots are counted, many sorted
            counts[: 2 * self.dense] += np.bincount(place[0] * 2 + bit, minlength=2 * self.dense).astype(np.int32)
            hashed = place[1:]
        key = np.empty(hashed.shape, np.int32)
        np.multiply(hashed, 2, out=key, casting="unsafe")
        key += bit
        key = key.ravel()
        key.sort()
        at = np.flatnonzero(c.first_of_group(key)) if len(key) else np.zeros(0, np.int64)
        counts[key[at]] += np.diff(np.append(at, len(key))).astype(np.int32)

    def _learn(self, place: np.ndarray, y: np.ndarray) -> None:
        n = self.counts.take(place)
        inputs = stretched((n & 0xFFFFFFFF).astype(np.float32), (n >> 32).astype(np.float32))
        gate, odds = mixed(inputs, self.weights)
        error = y - squash(odds)
        size = len(self.weights)
        scale = (RATE * 8 / np.maximum(np.bincount(gate, minlength=size), 1)).astype(np.float32)
        for k in range(size):
            self.weights[:, k] += scale * np.bincount(gate, error * inputs[k], size).astype(np.float32)
        cell = (y * size + gate) * STEPS + np.rint((np.clip(odds, -8, 8) + 8) * 2).astype(np.int64)
        self.refined += np.bincount(cell, minlength=self.refined.size).reshape(self.refined.shape)

    def rows(self, extra: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Numbers that may be added up, in chunks: the counts, the weights by mass in fixed point, the refining table, extra."""
        weights = np.rint(self.weights.astype(float).ravel() * self.mass * 1024).astype(np.int64)
        flat = np.concatenate([self.counts.view(np.int32).astype(np.int64), weights, [self.mass], self.refined.ravel(), extra.ravel()])
        for k in range(0, len(flat), CHUNK):
            part = flat[k : k + CHUNK]
            if part.any():
                yield k, _planes(part)


class Mixer:
    """What the online passes have learned: log10 probability of bits."""

    def __init__(self, flat: np.ndarray, slots: int, inputs: int):
        counts, rest = flat[: 2 * slots].reshape(-1, 2).astype(np.float32), flat[2 * slots :]
        self.odds = stretched(counts[:, 0], counts[:, 1])
        mass = int(rest[inputs * inputs])
        self.weights = (rest[: inputs * inputs] / 1024 / mass if mass else np.full(inputs * inputs, 0.4)).reshape(inputs, inputs).astype(np.float32)
        refined = rest[inputs * inputs + 1 :][: 2 * inputs * STEPS].reshape(2, inputs, STEPS)
        middle = squash(np.linspace(-8, 8, STEPS))
        # 20 observations' worth of trust in the mixer
        self.refined = ((refined[1] + 20 * middle) / (refined.sum(0) + 20)).astype(np.float32)

    def __call__(self, place: np.ndarray, bit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bit), np.float32)
        for a in range(0, len(bit), BATCH):
            y = bit[a : a + BATCH]
            gate, odds = mixed(self.odds.take(place[:, a : a + BATCH]), self.weights)
            where = (np.clip(odds, -8, 8) + 8) * 2
            low = np.minimum(where.astype(np.int64), STEPS - 2)
            part, cell = (where - low).astype(np.float32), gate * STEPS + low
            table = self.refined.take(cell) * (1 - part) + self.refined.take(cell + 1) * part
            p = np.clip((squash(odds) + table) / 2, 1e-5, 1 - 1e-5)
            out[a : a + BATCH] = np.log(np.where(y == 1, p, 1 - p)) * LOG10
        return out


# ------------------------------------------------------------------------------------------------------------- the events


class Code:
    """The Huffman code of leaves by how often they came."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * len(counts), np.int64), np.zeros(2 * len(counts), np.uint8)
        free = len(counts)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], side[y] = free, free, 1
            heapq.heappush(heap, (a + b, free))
            free += 1
        leaf, now = np.arange(len(counts)), np.arange(len(counts))
        steps = []
        while len(leaf):
            steps.append((leaf, parent[now] - len(counts), side[now]))
            go = parent[now] != free - 1
            leaf, now = leaf[go], parent[now][go]
        leaf, node, bit = (np.concatenate([x[k] for x in steps]) for k in range(3))
        depth = np.repeat(-np.arange(len(steps)), [len(x[0]) for x in steps])
        order = np.lexsort((depth, leaf))  # from the root to the leaf
        self.nodes, self.bits = node[order], bit[order]
        self.size = np.bincount(leaf, minlength=len(counts))
        self.at = np.cumsum(self.size) - self.size


class Tokens:
    """The tokens of a slice's texts, one after another, each text's end token last."""

    def __init__(self, w: c.Words, common: np.ndarray, kind: np.ndarray):
        self.words = w
        n = w.counts + 1
        self.last = np.cumsum(n) - 1
        own = np.arange(len(w.starts)) + w.rows
        self.hash = np.full(int(n.sum()), END)
        self.hash[own] = w.hashes
        self.first = np.repeat(self.last - w.counts, n)
        self.row = np.repeat(np.arange(len(n)), n)
        bins = _bins(self.hash)
        bins[self.last] = BINS
        self.bin = bins // (BINS // LEAVES)
        at = np.arange(len(self.hash))
        one = np.where(at > self.first, np.roll(self.hash, 1), np.uint64(1))
        two = np.where(at > self.first + 1, np.roll(self.hash, 2), np.uint64(1))
        self.contexts = [c.mix(one, 81), c.mix(one, 82) * np.uint64(3) ^ c.mix(two, 83)][:WORDS]
        # the kind that most words so far speak for
        place = np.full(BINS + 1, -1)
        place[common] = kind
        vote = place[bins]
        votes = np.zeros((len(at) + 1, CLASSES), np.int32)
        votes[1 + np.flatnonzero(vote >= 0), vote[vote >= 0]] = 1
        votes = np.cumsum(votes, axis=0)
        self.kind = (votes[:-1] - votes[self.first]).argmax(1)
        # what followed the two words before, where the text had them last
        key = self.contexts[-1] ^ c.mix(self.row.astype(np.uint64), 84)
        low = np.uint64(len(at).bit_length())  # a place's bits, under as many of the key as are left
        key = np.sort((key >> low << low) | at.view(np.uint64))
        order = (key & np.uint64((1 << int(low)) - 1)).view(np.int64)
        key >>= low
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        before = np.full(len(at), -1)
        before[order[again]] = order[again - 1]
        self.hit = (before >= 0) & (self.hash[before] == self.hash)
        was, earlier = np.roll(self.hit, 1) & (at > self.first), np.roll(self.hit, 2) & (at > self.first + 1)
        self.match = np.where(before >= 0, 1 + was + (was & earlier), 0)


def events(code: Code, t: Tokens, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and bits of the codes of some tokens, and where each one's begin."""
    bins = t.bin[own]
    size = code.size[bins]
    flat = c.runs(code.at[bins], size)
    node, which = code.nodes[flat], np.repeat(own, size)
    place = np.empty((1 + WORDS, len(flat)), np.int64)
    place[0] = t.kind[which] * LEAVES + node
    spread = node.astype(np.uint64) * np.uint64(c.MIX[0])
    for k, context in enumerate(t.contexts):
        slot = ((context[which] ^ spread) * np.uint64(c.MIX[1])) >> np.uint64(64 - SLOTS.bit_length() + 1)
        place[1 + k] = slot.view(np.int64) + (CLASSES * LEAVES + k * SLOTS)
    return place, code.bits[flat], np.cumsum(size) - size


def spelling(code: Code, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and bits of the bytes of tokens data[at[i]:at[i+1]], each with a space behind it, and where each token's begin."""
    k = np.arange(len(data))
    letters = c.mix(np.arange(256, dtype=np.uint64), 130)[data]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * c.powers(c.BASE, len(data)))])
    inverse = c.powers(pow(c.BASE, -1, 1 << 64), len(data) + 1)
    top = np.repeat(at[:-1], np.diff(at))
    begins = [*(np.maximum(top, k - n) for n in BYTES), top]
    size = code.size[data]
    flat = c.runs(code.at[data], size)
    which = np.repeat(k, size)
    spread = code.nodes[flat].astype(np.uint64) * np.uint64(c.MIX[0])
    place = np.empty((len(begins), len(flat)), np.int64)
    for i, x in enumerate(begins):
        context = c.mix((total[k] - total[x]) * inverse[x] + (k - x).astype(np.uint64) * np.uint64(c.MIX[0]), 30 + i)
        slot = ((context[which] ^ spread) * np.uint64(c.MIX[1])) >> np.uint64(64 - SPELLED.bit_length() + 1)
        place[i] = slot.view(np.int64) + i * SPELLED
    return place, code.bits[flat], (np.cumsum(size) - size)[at[:-1]]


def spaced(w_data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans end to end, each with a space behind it, and where each begins."""
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    data = np.full(at[-1], 32, np.uint8)
    data[c.runs(at[:-1], ends - starts)] = w_data[c.runs(starts, ends - starts)]
    return data, at


MIXED, SPELT = (CLASSES * LEAVES + WORDS * SLOTS, 1 + WORDS), ((len(BYTES) + 1) * SPELLED, len(BYTES) + 1)  # slots, inputs


# ------------------------------------------------------------------------------------------------------------ on a cluster

KINDS = [f"n{k}" for k in range(CLASSES)]
SUMS = "chunk long, part long, counts binary"
VOCABULARY = pa.schema([("block", pa.int64()), ("hash", pa.int64()), ("token", pa.binary()), *((k, pa.int64()) for k in KINDS)])
VOCABULARY_DDL = "block long, hash long, token binary, " + ", ".join(f"{k} long" for k in KINDS)
CHUNK = 1 << 15
FAN = 64  # rows of a chunk that one sum takes


def _planes(part: np.ndarray) -> bytes:
    """64-bit numbers, bytes of the same weight together: compression takes out the high ones."""
    return part.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by chunk and part: the sum of each."""
    now, total = None, np.zeros(0, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), c.binary([_planes(total)])], ["chunk", "part", "counts"])

    for batch in batches:
        for chunk, part, raw in zip(*(c.column(batch, x) for x in ("chunk", "part", "counts")), strict=True):
            if now != (chunk.as_py(), part.as_py()):
                if now is not None:
                    yield row()
                now, total = (chunk.as_py(), part.as_py()), _numbers(raw.as_py())
            else:
                total = total + _numbers(raw.as_py())
    if now is not None:
        yield row()


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all parts (SUMS) of an array of fixed size: a tree of sums over FAN parts each, then a collection."""
    with c.stored(rows) as now:
        found = now.agg(F.max("part").alias("parts"), F.count("*").alias("n")).first()
        parts, n = found["parts"] or 0, found["n"]
        while True:
            # a task takes a few MB, before compression
            dealt = now.withColumn("part", F.expr(f"part div {FAN}")).repartition(max(1, n // 64), "chunk", "part")
            now = c.mapped(dealt.sortWithinPartitions("chunk", "part"), _sum_rows, SUMS)
            parts, n = parts // FAN, n // FAN
            if not parts:
                break
            now = c.checkpoint(now)
        out = np.zeros(size, np.int64)
        for x in now.collect():  # of fixed size
            part = _numbers(x["counts"])
            out[x["chunk"] : x["chunk"] + len(part)] = part
    return out


def _sent(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, raw in rows:
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part]), c.binary([raw])], ["chunk", "part", "counts"])


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (c.mix(hashes, 70) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def kinds_of(texts: c.Words, common: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The kind of each text: that of most of its common words; the first where there are none."""
    place = np.full(BINS, -1)
    place[common] = kind
    own = place[_bins(texts.hashes)]
    rows = texts.rows[own >= 0]
    n = len(texts.at) - 1
    votes = np.bincount(rows * CLASSES + own[own >= 0], minlength=n * CLASSES).reshape(n, CLASSES)
    return votes.argmax(1)


def cluster(together: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The kind of each common word, from how many documents each two of them share."""
    total = max(together.sum(), 1.0)
    own = together.sum(1)
    x = np.log(np.maximum(together * total / np.maximum(np.outer(own, own), 1.0), 1.0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[0]]
    while len(centres) < CLASSES:
        centres.append(x[np.min([((x - m) ** 2).sum(1) for m in centres], axis=0).argmax()])
    for _ in range(rounds):
        kind = np.stack([((x - m) ** 2).sum(1) for m in centres]).argmin(0)
        centres = [x[kind == k].mean(0) if (kind == k).any() else centres[k] for k in range(CLASSES)]
    return kind


def _added(docs: DataFrame, shape: tuple[int, ...], of) -> np.ndarray:
    """The sum over all training texts of an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for part in c.slices(batch.filter(pa.array(~held_out(c.numbers(batch, "doc_id")))), limit=SLICE):
                total += of(c.words(c.column(part, "text"), lower=True))
        flat = total.ravel()
        yield from _sent((k, _planes(flat[k : k + CHUNK])) for k in range(0, len(flat), CHUNK))

    return summed(c.mapped(docs.select("doc_id", "text"), run, SUMS), int(np.prod(shape))).reshape(shape)


def common_kinds(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often the bins came, and then the bytes; the bins of the common words, and their kinds."""
    every = _added(docs, (BINS + 256,), lambda w: np.concatenate([np.bincount(_bins(w.hashes), minlength=BINS), np.bincount(w.data, minlength=256)]))
    counts = every[:BINS]
    common = np.argsort(-counts, kind="stable")[:COMMON]
    place = np.full(BINS, -1)
    place[common] = np.arange(COMMON)

    def together(w: c.Words) -> np.ndarray:
        own = place[_bins(w.hashes)]
        held = np.zeros((len(w.at) - 1, COMMON), np.float32)
        held[w.rows[own >= 0], own[own >= 0]] = 1
        return np.rint(held.T @ held).astype(np.int64)

    return every, common, cluster(_added(docs, (COMMON, COMMON), together).astype(float))


def _distinct(batches: Iterator[pa.RecordBatch], common: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each block's slices, with their number in training documents of each kind."""
    held: dict[int, list] = {}

    def flush(block: int) -> Iterator[pa.RecordBatch]:
        table, counts = held.pop(block)
        for a in range(0, table.n, 100_000):
            b = min(table.n, a + 100_000)
            at = table.at[0][a : b + 1]
            raw = table.bytes[0][at[0] : at[-1]].tobytes()
            tokens = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(raw)])
            yield c.named(VOCABULARY, block=np.full(b - a, block), hash=c.signed(table.keys[a:b]), token=tokens, **{k: counts[a:b, i] for i, k in enumerate(KINDS)})

    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            blocks, which = np.unique(c.numbers(part, "block"), return_inverse=True)
            w = c.words(c.column(part, "text"), lower=True)
            train = np.repeat(~held_out(c.numbers(part, "doc_id")), w.counts)
            of = np.repeat(kinds_of(w, common, kind), w.counts)
            rows = np.repeat(which, w.counts)
            for k, block in enumerate(blocks.tolist()):
                own = np.flatnonzero(rows == k)
                pair = held.setdefault(block, [ChunkTable(1), np.zeros((1 << 16, CLASSES), np.int64)])
                table = pair[0]
                entry = table.entries(w.data, w.starts[own], w.ends[own], w.hashes[own], lambda x: (x,))
                if table.n > len(pair[1]):
                    pair[1] = np.concatenate([pair[1], np.zeros((2 * table.n, CLASSES), np.int64)])
                learnt = train[own]
                key, n = np.unique(entry[learnt] * CLASSES + of[own][learnt], return_counts=True)
                pair[1].reshape(-1)[key] += n
                if table.n > 500_000:
                    yield from flush(block)
    for block in list(held):
        yield from flush(block)


def fit(docs: DataFrame, code: Code, common: np.ndarray, kind: np.ndarray) -> tuple[Mixer, np.ndarray]:
    """The mixer, trained on the running text of all documents (doc_id, text) that aren't held out, and how likely it is that what
    followed before follows again, by state."""
    extra = 2 * (MATCHES + 1)

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, matches = Online(*MIXED, dense=CLASSES * LEAVES), np.zeros(extra, np.int64)
        for batch in batches:
            for part in c.slices(batch.filter(pa.array(~held_out(c.numbers(batch, "doc_id")))), limit=STREAM):
                t = Tokens(c.words(c.column(part, "text"), lower=True), common, kind)
                matches += np.bincount(t.match * 2 + t.hit, minlength=extra)
                own = np.flatnonzero(~t.hit)
                for a in range(0, len(own), EVENTS):
                    learner(*events(code, t, own[a : a + EVENTS])[:2])
        yield from _sent(learner.rows(matches))

    slots, inputs = MIXED
    size = 2 * slots + inputs * inputs + 1 + 2 * inputs * STEPS
    flat = summed(c.mapped(docs.select("doc_id", "text"), online, SUMS), size + extra)
    matches = flat[size:].reshape(-1, 2)
    return Mixer(flat[:size], slots, inputs), (matches[:, 1] + 0.5) / (matches.sum(1) + 1)


def fit_spelling(tokens: DataFrame, code: Code) -> Mixer:
    """Trained on each distinct token (token)."""

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Online(*SPELT)
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 12):
                data, at = c.string_bytes(c.column(batch, "token").slice(a, 1 << 12))
                learner(*spelling(code, *spaced(data, at[:-1], at[1:]))[:2])
        yield from _sent(learner.rows(np.zeros(0, np.int64)))

    slots, inputs = SPELT
    return Mixer(summed(c.mapped(tokens.select("token"), online, SUMS), 2 * slots + inputs * inputs + 1 + 2 * inputs * STEPS), slots, inputs)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


PACKED = np.dtype([("hash", "<i8"), ("n", "<i8"), ("kinds", "<f4", CLASSES)])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens, in all and by kind, as one row a block and batch."""
    for batch in batches:
        block = c.numbers(batch, "block")
        order = np.argsort(block, kind="stable")
        counts = np.stack([c.numbers(batch, k) for k in KINDS], axis=1)[order]
        out = np.zeros(len(order), PACKED)
        out["hash"], out["n"], out["kinds"] = c.numbers(batch, "hash")[order], counts.sum(1), counts
        cut = np.append(np.flatnonzero(c.first_of_group(block[order])), len(order)).tolist() if len(order) else [0]
        yield pa.RecordBatch.from_arrays([pa.array(block[order][cut[:-1]]), c.binary([out[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)])], ["block", "counts"])


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block in compressed slices, so that tasks hold a slice of running text and not a batch."""
    for batch in batches:
        for part in c.slices(batch, limit=STREAM):
            block = c.numbers(part, "block")
            for k in np.unique(block).tolist():
                own = part.select(["doc_id", "text"]).filter(pa.array(block == k))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([k]), c.binary([sink.getvalue().to_pybytes()])], ["block", "texts"])


class Scorer:
    """log10 probabilities of running texts, from the mixers and the corpus counts."""

    def __init__(self, mixer: Mixer, spelt: Mixer, again: np.ndarray, codes: tuple[Code, Code], kinds: tuple[np.ndarray, np.ndarray], bins: np.ndarray, distinct: np.ndarray, totals: np.ndarray, ends: int):
        self.mixer, self.spelt, self.again, self.kinds = mixer, spelt, again, kinds
        self.code, self.letters = codes
        self.bins, self.in_bin, self.distinct = bins, distinct, int(distinct.sum())
        self.totals, self.ends = totals, ends

    def spell(self, w: c.Words, mine: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """log10 probability of each word's spelling, of those without counts."""
        out = np.zeros(len(mine))
        first = np.zeros(len(mine), np.int64)
        first[inverse] = np.arange(len(inverse))
        new = np.flatnonzero(mine["n"] == 0)
        for a in range(0, len(new), 1 << 12):
            own = first[new[a : a + (1 << 12)]]
            data, at = spaced(w.data, w.starts[own], w.ends[own])
            place, bit, begin = spelling(self.letters, data, at)
            out[new[a : a + (1 << 12)]] = np.add.reduceat(self.spelt(place, bit), begin)
        return out[inverse]

    def __call__(self, w: c.Words, mine: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """Of each text: mine holds the counts of its distinct words, inverse each word's place there."""
        t = Tokens(w, *self.kinds)
        words = np.delete(np.arange(len(t.hash)), t.last)
        spelled = 10.0 ** self.spell(w, mine, inverse)
        known = mine["n"] > 0
        n = np.where(known, mine["n"] - DISCOUNT, 0.0)[inverse]
        n += np.where(known[inverse], 0, spelled * DISCOUNT * self.distinct)
        # the code of the bin, then the word's share of it
        model = np.zeros(len(t.hash))
        own = np.flatnonzero(~t.hit)
        for a in range(0, len(own), EVENTS):
            place, bit, at = events(self.code, t, own[a : a + EVENTS])
            model[own[a : a + EVENTS]] = np.add.reduceat(self.mixer(place, bit), at)
        bins = t.bin[words]
        free = DISCOUNT * self.in_bin[bins] * spelled * LEAVES
        share = np.where(known[inverse], mine["n"][inverse] - DISCOUNT, free) / np.maximum(self.bins[bins], 1)
        share = np.where(self.bins[bins] > 0, share, spelled * LEAVES)
        model[words] += np.where(t.hit[words], 0, np.log10(np.maximum(np.minimum(share, 1), 1e-300)))
        model += np.log10(np.where(t.match > 0, np.where(t.hit, self.again[t.match], 1 - self.again[t.match]), 1.0))
        # whole tokens by kind
        total, ends = max(self.totals.sum(), 1), self.ends
        kind = t.kind[words]
        here = mine["kinds"][inverse, kind] / np.maximum(self.totals, 1)[kind]
        counted = np.full(len(t.hash), max(ends, 0.1) / max(total + ends, 1))
        counted[words] = ((1 - SHARED) * here + SHARED * n / total) * (total / max(total + ends, 1))
        model = 10.0**model
        out = []
        for share in SHARES:
            tokens = np.log10(np.maximum((1 - share) * counted + share * model, 1e-300))
            out.append(np.bincount(t.row, tokens, len(t.last)) - np.log10(len(SHARES)))
        out = np.stack(out, axis=1)
        top = out.max(1)
        return top + np.log10((10.0 ** (out - top[:, None])).sum(1))


def score(df: DataFrame) -> DataFrame:
    """Every document's base score and model score."""
    file = F.input_file_name()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(c.buckets(df, 16)))
    block = F.when(file == "", spread).otherwise(F.xxhash64(file, F.input_file_block_start()))
    docs = c.documents(df, block.alias("block"))
    bins, common, kind = common_kinds(docs)
    every = sum(map(F.col, KINDS), F.lit(0))
    with c.stored(c.mapped(docs, lambda batches: _distinct(batches, common, kind), VOCABULARY_DDL)) as asked:
        counted = asked.groupBy("hash").agg(*(F.sum(k).alias(k) for k in KINDS), F.first("token").alias("token")).where(every > 0)
        with c.stored(counted) as counted:
            ends = docs.select("doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT)) != 0).count()
            sums = counted.agg(*(F.sum(k).alias(k) for k in KINDS), F.count("*").alias("v")).first()
            totals = np.array([sums[k] or 0 for k in KINDS], float)
            total, distinct = int(totals.sum()) + ends, sums["v"] + (ends > 0)
            bins, letters = bins[:BINS].reshape(LEAVES, -1).sum(1), Code(bins[BINS:])
            code = Code(np.append(bins, ends))
            spelt = fit_spelling(counted, letters)

            def in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = np.zeros(LEAVES, np.int64)
                for batch in batches:
                    own += np.bincount(_bins(c.numbers(batch, "hash").view(np.uint64)) // (BINS // LEAVES), minlength=LEAVES)
                yield from _sent([(0, _planes(own))])

            in_bin = summed(c.mapped(counted.select("hash"), in_bins, SUMS), LEAVES)
            mixer, again = fit(docs, code, common, kind)
            scorer = Scorer(mixer, spelt, again, (code, letters), (common, kind), bins, in_bin, totals, ends)
            packed = c.checkpoint(c.mapped(asked.select("block", "hash").join(counted.drop("token"), "hash"), _pack, "block long, counts binary"))
    model = df.sparkSession.sparkContext.broadcast(scorer)  # fixed size

    both = c.mapped(docs, _sealed, "block long, texts binary").unionByName(packed, allowMissingColumns=True)
    # few blocks share a task
    sorted_ = both.repartition(c.buckets(df, 4), "block").sortWithinPartitions("block", F.col("texts").isNotNull())
    scale = np.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model: Scorer = model.value
        lists: dict[int, list[bytes]] = {}
        now, known = None, np.zeros(0, PACKED)

        for batch in batches:
            for block, texts, counts in zip(*(c.column(batch, x) for x in ("block", "texts", "counts")), strict=True):
                if not texts.is_valid:
                    lists.setdefault(block.as_py(), []).append(counts.as_py())
                    continue
                if now != block.as_py():
                    now = block.as_py()
                    known = np.frombuffer(b"".join(lists.pop(now, [])), PACKED)
                    known = known[np.argsort(known["hash"])]
                for part in pa.ipc.open_stream(texts.as_buffer()):
                    w = c.words(c.column(part, "text"), lower=True)
                    distinct_, inverse = np.unique(c.signed(w.hashes), return_inverse=True)
                    mine = np.zeros(len(distinct_), PACKED)
                    if len(known):
                        place = np.minimum(np.searchsorted(known["hash"], distinct_), len(known) - 1)
                        found = known["hash"][place] == distinct_
                        mine[found] = known[place[found]]
                    rows, size = w.rows, part.num_rows
                    n = mine["n"].astype(float)
                    model_score = own_model(w, mine, inverse)
                    # one byte follows every word, and the end
                    lengths = np.bincount(rows, w.ends - w.starts + 1, size) + 1
                    yield c.named(
                        SCORES,
                        doc_id=c.column(part, "doc_id"),
                        held_out=held_out(c.numbers(part, "doc_id")),
                        n_tokens=w.counts + 1,
                        n_known=np.bincount(rows[n[inverse] > 0], minlength=size) + (ends > 0),
                        train_tokens=np.full(size, total),
                        base_score=np.bincount(rows, (np.log10(n + 0.1) - scale)[inverse], size) + np.log10(ends + 0.1) - scale,
                        score=model_score,
                        bits_per_byte=-model_score / np.log10(2) / lengths,
                    )

    return c.mapped(sorted_.select("block", "texts", "counts"), run, SCORES_DDL)


def query(df: DataFrame) -> DataFrame:
    """All documents, learning from those that are not held out."""
    return score(df)
