"""Best-two-fit packing of token sequences.

Documents become pieces of at most `capacity` tokens; the plan of the bins is made from the histogram of piece lengths
alone, which has at most `capacity` entries whatever the table's size. A bin is filled greedily with the largest length
that still fits; then its smallest document is taken out and, where two unpacked documents fit the expanded gap more
tightly, they take its place. As many equal bins as the histogram still allows are opened at once, so that each step
uses up a length and the plan stays small. Pieces find their places by their rank within their length, which is
counted in hashed groups, so that one length with a third of all rows is still dealt over many tasks.

Null text: as empty, hence the end id alone. Empty table: no rows. Repeated rows of one doc_id are packed each.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c
from .chunk_table import ChunkTable, kept

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """The library's tokenizer and a table of the distinct words met: word -> its ids as little-endian bytes.

    The tokenizer drops white space, so no token crosses a word's end, and each distinct word is encoded once.
    """

    def __init__(self, model: str | None):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(model or public_tokenizers.path(TOKENIZER))
        self.table = ChunkTable(1)

    def make(self, words: list[bytes]) -> tuple[list[bytes]]:
        found = self.library.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)
        return ([struct.pack(f"<{len(x)}I", *x.ids) for x in found],)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin."""
        w = c.words(texts)
        entries = self.table.entries(w.data, w.starts, w.ends, w.hashes, self.make)
        ends = np.concatenate([[0], np.cumsum(self.table.lengths(0, entries))])
        return self.table.gather(0, entries).view("<u4"), ends[w.first] // 4


def pieces(df: DataFrame, model: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut only where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("tokenizer", model), lambda: Encoder(model))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in c.slices(batch):
                ids, at = encoder.of(c.column(part, "text"))
                raw, at = ids.tobytes(), (4 * at).tolist()
                rows: list[tuple] = []
                for doc, a, b in zip(c.column(part, "doc_id").to_pylist(), at, at[1:], strict=False):
                    own = raw[a:b] + end
                    for k, x in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[x : x + 4 * capacity]
                        rows.append((doc, k, x // 4, len(piece) // 4, zlib.crc32(piece)))
                yield c.named(PIECES, **dict(zip(PIECES.names, map(list, zip(*rows, strict=True)), strict=True)))

    return c.documents(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of equal bins, lengths in one bin, largest first), covering the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    bins = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return bins
        own: list[int] = []
        gap = capacity
        free = left.copy()
        while gap:
            fits = have[: np.searchsorted(have, gap, "right")]
            fits = fits[free[fits] > 0]
            if not len(fits):
                break
            take = int(fits[-1])
            n = min(int(free[take]), gap // take)
            own += [take] * n
            free[take] -= n
            gap -= take * n
        if gap and len(own) > 1 and (pair := _two(free, own[-1], gap)):
            own[-1:] = pair
        lengths, needs = np.unique(own, return_counts=True)
        times = int((left[lengths] // needs).min())
        left[lengths] -= times * needs
        bins.append((times, sorted(own, reverse=True)))


def _two(free: np.ndarray, smallest: int, gap: int) -> list[int]:
    """The two unpacked lengths that fill gap + smallest most tightly, if more tightly than the smallest document does."""
    room = gap + smallest
    lengths = np.flatnonzero(free[: room + 1])
    if not len(lengths):
        return []
    other = np.searchsorted(lengths, room - lengths, "right") - 1  # the largest partner of each
    ok = (other >= 0) & (lengths >= lengths[other])
    ok &= (lengths != lengths[other]) | (free[lengths] > 1)
    # a length that would be its own partner but exists once takes the next smaller one
    lone = (other > 0) & (lengths == lengths[other]) & (free[lengths] == 1)
    other, ok = np.where(lone, other - 1, other), ok | lone
    sums = np.where(ok, lengths + lengths[other], 0)
    best = int(sums.argmax())
    return [int(lengths[best]), int(lengths[other[best]])] if sums[best] > smallest else []


def pack(found: DataFrame, capacity: int = CAPACITY, group_rows: int = 200_000) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    found = c.checkpoint(found)
    groups = F.lit(max(1, -(-found.count() // group_rows)) * 16)
    found = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), groups))
    counts = c.checkpoint(found.groupBy("length", "_group").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0))).drop("_group", "_before")

    # per length, its places in plan order: first rank, first sequence, offset, how many of the length stand side by side
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = dict.fromkeys(histogram, 0)
    sequence = 0
    for times, lengths in plan(histogram, capacity):
        at = 0
        for length, n in sorted({x: lengths.count(x) for x in lengths}.items(), reverse=True):
            slots.setdefault(length, []).append((taken[length], sequence, at, n))
            taken[length] += times * n
            at += length * n
        sequence += times
    places = {length: np.array(x, np.int64).T for length, x in slots.items()}
    names = [x for x in ranked.columns if x != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = c.numbers(batch, "length"), c.numbers(batch, "_rank")
            ids, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, sequences, at, n = places[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], "right") - 1
                within = rank[own] - first[k]
                ids[own] = sequences[k] + within // n[k]
                offsets[own] = at[k] + within % n[k] * length[own]
            yield pa.RecordBatch.from_arrays([*(c.column(batch, x) for x in names), pa.array(ids), pa.array(offsets)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def query(df: DataFrame) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    return pack(pieces(df)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
