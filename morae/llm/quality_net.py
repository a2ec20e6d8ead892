"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Tokens are maximal runs of letters (ASCII letters and all bytes above them), of digits, or of other signs; spaces part them. Every
token has a sparse random index vector that its hash fixes: +1 in two of `DIMENSIONS` places, -1 in two. The vector of a word is the sum
of the index vectors of its neighbours, up to `REACH` places away, over all documents. Words share `ROWS` rows by their hash:
no word is left out, and the table has a proven size, so tasks get it by broadcast. A task adds up its own table and
sends it once, in chunks that are summed in two steps. A document's features are the means over its tokens of the (normalised) vectors, of
their squares, and of the products of neighbouring ones.

The network learns from the documents of at most `SAMPLE` labelled ids (the bound: those of least hash) whose crc32(doc_id) mod 3
isn't 1; a fifth of them doesn't move weights and sets the temperature of the probabilities instead. Labels, language, source and
doc_id are no features; everything is deterministic.

Null or empty text: features 0, and a score like any text. Null doc_id: not held out, and without label. Very long texts are pooled in blocks of tokens. Labels that contradict each
other: the more frequent, ties 1; others than 0 and 1 are ignored. Without both labels the score is the
smoothed share of ones. Repeated rows come back one by one and count each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

DIMENSIONS, ROWS, REACH = 32, 1 << 16, 2
CHUNKS = 128
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 2e-3, 1e-3
FEATURES = 3 * DIMENSIONS
SLICE, BLOCK = 1 << 20, 1 << 16
POOLED = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])

_kind = np.full(256, 3, np.uint8)
_kind[128:] = 1
_kind[[*range(65, 91), *range(97, 123)]] = 1
_kind[48:58] = 2
_kind[c.SPACE] = 0


# --------------------------------------------------------------------------------------------------------- word vectors


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and its row."""
    data, at = c.string_bytes(texts)
    if not len(data):
        return np.zeros(0, c.U), np.zeros(0, np.int64)
    kind = _kind[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    ink = kind[starts] > 0
    starts, ends = starts[ink], ends[ink]
    return c.span_hash(data, starts, ends), np.searchsorted(at, starts, "right") - 1


def places(hashes: np.ndarray) -> np.ndarray:
    """The places of each token's index vector: of +1 the first two, of -1 the others."""
    mixed = c.mix(hashes, 7)
    return np.stack([(mixed >> c.U(8 * k)) % c.U(DIMENSIONS) for k in range(4)], 1).astype(np.int64)


def accumulate(table: np.ndarray, texts: pa.Array) -> None:
    """Add the index vectors of the neighbours of every token to its word's row; table: ROWS * DIMENSIONS, flat."""
    hashes, row = tokens(texts)
    word, index = (hashes % c.U(ROWS)).astype(np.int64) * DIMENSIONS, places(hashes)
    for k in range(1, REACH + 1):
        a = np.flatnonzero(row[k:] == row[:-k])
        for own, other in ((a, a + k), (a + k, a)):
            at = word[own, None] + index[other]
            np.add.at(table, at[:, :2].ravel(), 1)
            np.subtract.at(table, at[:, 2:].ravel(), 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(ROWS * DIMENSIONS, np.int64)
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            accumulate(table, c.column(part, "text"))
    chunks = table.reshape(CHUNKS, -1)
    for k in np.flatnonzero(chunks.any(1)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), c.binary([chunks[k].tobytes()])], ["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(c.numbers(batch, "chunk").tolist(), c.column(batch, "sums"), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.int64)
            totals[k] = totals[k] + own if k in totals else own.copy()
    for k, own in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), c.binary([own.tobytes()])], ["chunk", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised table of word vectors, ROWS x DIMENSIONS, of all texts."""
    ddl = "chunk int, sums binary"
    sums = c.mapped(docs.select("text"), _gathered, ddl)
    fan = round((c.buckets(docs, 128) / 16) ** 0.5)
    if fan > 1:  # many tasks: their tables meet in groups first
        sums = c.mapped(sums.withColumn("part", F.spark_partition_id() % fan).repartition(CHUNKS * min(fan, 64), "part", "chunk").select("chunk", "sums"), _added, ddl)
    found = c.mapped(sums.repartition(CHUNKS, "chunk"), _added, ddl).collect()  # CHUNKS rows
    table = np.zeros((CHUNKS, ROWS // CHUNKS * DIMENSIONS))
    for r in found:
        table[r["chunk"]] += np.frombuffer(r["sums"], np.int64)
    table = table.reshape(ROWS, DIMENSIONS)
    return (table / np.maximum(1, np.sqrt((table * table).sum(1, keepdims=True)))).astype(np.float32)


# -------------------------------------------------------------------------------------------------------------- pooling


def pooled(table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The features of each text: means over tokens of vectors, squares, and products of neighbours."""
    hashes, row = tokens(texts)
    word = (hashes % c.U(ROWS)).astype(np.int64)
    out = np.zeros((len(texts), FEATURES))
    count = np.bincount(row, minlength=len(texts))
    for at in range(0, len(word), BLOCK):
        own, more = row[at : at + BLOCK], row[at : at + BLOCK + 1]
        vectors = table[word[at : at + BLOCK + 1]]
        first = np.flatnonzero(c.first_of_group(own))
        product = vectors[: len(own)].copy()
        product[: len(more) - 1] *= vectors[1:]
        product[np.flatnonzero(np.append(more[1:] != more[:-1], np.ones(len(own) - len(more) + 1, bool)))] = 0
        vectors = vectors[: len(own)]
        for k, values in enumerate((vectors, vectors * vectors, product)):
            out[own[first], k * DIMENSIONS : (k + 1) * DIMENSIONS] += np.add.reduceat(values.astype(np.float64), first)
    out[:, : 2 * DIMENSIONS] /= np.maximum(count, 1)[:, None]
    out[:, 2 * DIMENSIONS :] /= np.maximum(count - 1, 1)[:, None]
    return out.astype(np.float32)


def _pooled(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            rows = pooled(sent.value, c.column(part, "text"))
            yield c.named(POOLED, doc_id=c.column(part, "doc_id"), features=c.binary([x.tobytes() for x in rows]))


# -------------------------------------------------------------------------------------------------------------- network


@dataclass
class Network:
    """Standardised features -> tanh layer -> logit / temperature."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    outer: np.ndarray
    last: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.inner + self.bias) @ self.outer + self.last

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def prior(share: float) -> Network:
    """Gives every text the same probability."""
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def loss(network: Network, x: np.ndarray, y: np.ndarray, temperature: float) -> float:
    """Mean cross entropy against smoothed targets: rows that are told apart without fault don't ask for certainty."""
    z = network.logits(x) / temperature
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    return float(np.mean(target * np.logaddexp(0, -z) + (1 - target) * np.logaddexp(0, z)))


def trained(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """By Adam on four fifths of the rows; the others set the temperature."""
    if len(np.unique(y)) < 2:
        return prior((y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    aside = np.arange(len(y)) % 5 == 4
    own, target = x[~aside], y[~aside].astype(np.float64)
    mean, scale = own.mean(0), own.std(0) + 1e-6
    z = (own - mean) / scale
    w = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in w]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            hidden = np.tanh(z[pick] @ w[0] + w[1])
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -500, 500))) - target[pick]) / len(pick)
            back = wrong[:, None] * w[2] * (1 - hidden * hidden)
            slopes = [z[pick].T @ back + DECAY * w[0], back.sum(0), hidden.T @ wrong + DECAY * w[2], wrong.sum(keepdims=True)]
            step += 1
            for p, g, (m, v) in zip(w, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))
    if aside.any():
        grid = np.exp(np.linspace(-2, 3, 101))
        network.temperature = float(min(grid, key=lambda t: loss(network, x[aside], y[aside], t)))
    return network


def _scored(network: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            data, _ = c.string_bytes(c.column(batch, "features"))
            score = network.score(data.view(np.float32).reshape(batch.num_rows, FEATURES).astype(np.float64))
            yield pa.RecordBatch.from_arrays([c.column(batch, "doc_id"), pa.array(score)], ["doc_id", "score"])


# ---------------------------------------------------------------------------------------------------------------- query


def third(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def sampled(features: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most so many labelled ids that aren't held out, in an order of their own."""
    mark = F.avg(F.col("quality").cast("double"))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.where(third(F.col("doc_id")) != 1).groupBy("doc_id").agg((mark >= 0.5).cast("int").alias("y"))
    there = features.select("doc_id").distinct()
    chosen = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")).collect()  # at most `most` rows
    rows.sort(key=lambda r: ((r["doc_id"] * c.BASE) % (1 << 64), r["doc_id"]))
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(len(rows), FEATURES)
    return x, np.array([r["y"] for r in rows], np.int64)


def classified(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    own = c.documents(docs)
    sent = own.sparkSession.sparkContext.broadcast(word_vectors(own))  # ROWS x DIMENSIONS numbers
    features = c.written(c.mapped(own, partial(_pooled, sent), "doc_id long, features binary"))
    network = trained(*sampled(features, labels, most))
    out = c.mapped(features, partial(_scored, network), "doc_id long, score double")
    return out.select("doc_id", (third(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classified(docs, labels)
