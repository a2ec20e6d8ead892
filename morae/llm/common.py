"""What the operators of this subpackage share: tables, vectorised words and hashes, shuffle buckets, components.

Texts are handled as the byte buffers of Arrow columns. A batch is cut into slices of a few MB, and words, lines and
windows of a slice are numpy arrays of offsets and 64-bit hashes, so that memory depends on the slice (or on one very
long text) and not on the table.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *keep: str | Column) -> DataFrame:
    """doc_id and text (null: empty) of a documents table, and further columns; a clashing extra column is left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def version() -> Column:
    """Tells rows of one doc_id by 64 bits of their texts (null: empty) and lengths. With doc_id it names a row wherever it is read; rows that are equal in
    both share it, and their results."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text, F.length(text))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that checkpoints go to. Where it is unset, a local session gets a folder of its own; a
    cluster has to name one that all its nodes share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint()


def place(spark: SparkSession) -> str:
    """A path for a table in the shared folder."""
    return f"{shared(spark)}/stage-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str = "") -> DataFrame:
    """A table written as Parquet in the shared folder, which the caller of the result goes on reading."""
    path = path or place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """A table written in the shared folder for as long as the block needs it: columnar, so smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        delete(spark, path)


def buckets(df: DataFrame, mb: float) -> int:
    """How many buckets hold about so many MB of this input each: grows in proportion with the input.

    Sizes are those of the files that are read; where a source doesn't know its size, the texts are measured.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= 1 << 50:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(12, min(1 << 30, round(size / (mb * 1e6))))


# ---------------------------------------------------------------------------------------------------------------- bytes


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about `limit` bytes of text or of a single longer row."""
    offsets = string_offsets(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def string_offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and where each row begins (and the last ends)."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = string_offsets(array)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


# --------------------------------------------------------------------------------------------------------------- hashes

#: An odd base for polynomials modulo 2^64 and the multipliers of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.ones(size, U)
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * U(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x + U((seed * BASE + BASE) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(MIX[0])
    x = (x ^ (x >> U(27))) * U(MIX[1])
    return x ^ (x >> U(31))


def _letters(values: np.ndarray, seed: int) -> np.ndarray:
    """The values as letters of the polynomials of a seed; all seeds share the powers of one base."""
    if seed == 0:
        return values.astype(U) + U(1)
    if values.dtype == np.uint8:
        return mix(np.arange(256, dtype=U), 100 + seed)[values]
    return mix(values.astype(U), 100 + seed)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal spans have equal hashes, wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(_letters(values, seed) * powers(BASE, n), out=total[1:])
    inverse = powers(pow(BASE, -1, 1 << 64), n + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(MIX[0]), seed)


# ---------------------------------------------------------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows of a slice."""

    data: np.ndarray  # bytes of all rows
    at: np.ndarray  # begin of each row in data, and the end of the last
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # of each row: index of its first word; and the number of words
    hashes: np.ndarray  # of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def words(array: pa.Array, lower: bool = False, seed: int = 0) -> Words:
    data, at = string_bytes(array)
    if lower:
        data = LOWER[data]
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink[:-1]
    edge = at[:-1][at[:-1] < len(data)]  # a row begins: no word goes on from the row before
    cut = np.zeros(len(data) + 1, bool)
    cut[edge] = True
    starts = np.flatnonzero(ink & (~before | cut))
    ends = np.flatnonzero(before & (~ink | cut))
    first = np.searchsorted(starts, at)
    return Words(data, at, starts, ends, first, span_hash(data, starts, ends, seed))


def window_hash(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of hashes[i:i+k] for every i that has k values; the caller drops windows over the end of a row."""
    if len(hashes) < k:
        return np.zeros(0, U)
    power = pow(BASE, 2 * seed + 3, 1 << 64)
    out, width, done = None, 0, 0
    block, size = hashes, 1
    while True:
        if k & size:
            n = len(hashes) - (done + size) + 1
            part = block[done : done + n]
            out = part.copy() if out is None else out[:n] * U(pow(power, size, 1 << 64)) + part
            done += size
            if done == k:
                return mix(out[: len(hashes) - k + 1], seed)
        block = block[:-size] * U(pow(power, size, 1 << 64)) + block[size:]
        size *= 2


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of k words within a row, and its row."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    rows = np.repeat(np.arange(len(n)), n)
    return runs(first[:-1], n), rows


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values[at[i]:at[i+1]] of each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def first_of_group(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: whether a row begins a group of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


# -------------------------------------------------------------------------------------------------------------- columns


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which the worker, kept for later tasks, gives back the memory that it no longer uses."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return of


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(lean(run), schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def named(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# ----------------------------------------------------------------------------------------------------------- components


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over links (a, b).

    Rounds over a table of labels: a node takes the least label among its own and its neighbours' (a hub's neighbours are
    aggregated on the map side, not paired), and so does the node that its label names, so that whole trees move at once; then
    every label is replaced by the label of the node it names, which halves chains. A round is cut
    by a checkpoint; the driver sees only a sum of the labels, which falls until nothing changes. Nodes without links are their
    own component.
    """
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpoint(both)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = checkpoint(labels)
    before = None
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        own = labels.join(seen, labels["node"] == seen["a"]).select("node", "label", F.least("label", "least").alias("least"))
        hooks = own.select(F.explode(F.array(F.struct("node", "least"), F.struct(F.col("label").alias("node"), "least"))).alias("x")).select("x.*")
        hooked = checkpoint(hooks.groupBy("node").agg(F.min("least").alias("label")))
        name = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = checkpoint(hooked.join(name, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    return nodes.join(labels.withColumnRenamed("label", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
