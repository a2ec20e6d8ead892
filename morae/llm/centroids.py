"""Centroid clustering with weighted deduplication: Lloyd's rounds on distinct quantised vectors.

Kept vectors have exactly `DIMENSIONS` components, none null or not finite; a component x becomes the integer floor(64 x). A
vector travels as a short binary key (the narrowest signed integers that hold its components), so equal vectors are equal keys;
they are grouped, with their multiplicity, on the map side first, and a vector that a third of all rows share costs a row a
task. Each round assigns the distinct vectors to the nearest centroid, and adds up multiplicity times vector for every cluster as
exact integers; the driver sees the sums of 16 clusters only. At the end the assignments go back to the rows by a join on
the key: vectors of many rows (at most `HOT` distinct ones, bounded) are joined by broadcast, the others by shuffle.

Null vec_id: clustered like others, never a seed. Repeated rows count and come back one by one; those of one vec_id tie as seeds
by their components. Fewer than 16 kept vectors: as many centroids. Components beyond 64 bits are held at the bound; a distance
or an inertia beyond 64 bits is null. Extra columns are ignored; a table without kept vectors gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CLUSTERS, DIMENSIONS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
HOT = 1000
ROWS = 8192  # vectors that are worked on at a time
WIDTHS = ("<i1", "<i2", "<i4", "<i8")
LONG = np.iinfo(np.int64)
EXACT = 1 << 20  # components up to here give exact products and sums as doubles


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, held at their bounds."""
    wide = np.floor(scale * values)
    low, high = wide < LONG.min, wide >= 2.0**63
    out = np.where(low | high, 0, wide).astype(np.int64)
    out[low], out[high] = LONG.min, LONG.max
    return out


def encoded(vectors: np.ndarray) -> list[bytes]:
    """The key of each vector: its components in the narrowest of four widths."""
    low, high = vectors.min(1), vectors.max(1)
    width = np.zeros(len(vectors), int)
    for k in range(3):
        bound = np.iinfo(WIDTHS[k])
        width[(low < bound.min) | (high > bound.max)] = k + 1
    out: list[bytes] = [b""] * len(vectors)
    for k in np.unique(width):
        own = np.flatnonzero(width == k)
        raw, size = vectors[own].astype(WIDTHS[k]).tobytes(), vectors.shape[1] << int(k)
        for i, row in enumerate(own):
            out[row] = raw[i * size : (i + 1) * size]
    return out


def decoded(keys: pa.Array, dimensions: int) -> np.ndarray:
    data, at = c.string_bytes(keys)
    out = np.zeros((len(keys), dimensions), np.int64)
    size = np.diff(at)
    for k, kind in enumerate(WIDTHS):
        own = np.flatnonzero(size == dimensions << k)
        if len(own):
            out[own] = data[c.runs(at[:-1][own], size[own])].view(kind).reshape(len(own), dimensions)
    return out


def _kept(dimensions: int, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = c.column(part, "embedding")
            sized = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == dimensions)
            part = part.take(pa.array(sized))
            flat = c.column(part, "embedding").flatten()
            values = np.asarray(flat.fill_null(np.nan), np.float64).reshape(-1, dimensions)
            good = np.flatnonzero(np.isfinite(values).all(1))
            if len(good):
                yield c.named(schema, vec_id=c.column(part, "vec_id").take(pa.array(good)), key=c.binary(encoded(quantised(values[good], scale))))


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The number of the nearest centroid (ties: the smaller) and the squared distance, exactly."""
    most = max(int(np.abs(vectors.astype(np.float64)).max(initial=0)), max(abs(x) for row in centroids for x in row))
    if most <= EXACT:
        own, other = vectors.astype(np.float64), np.array(centroids, np.float64)
        squared = (own * own).sum(1)[:, None] - 2 * (own @ other.T) + (other * other).sum(1)
        best = squared.argmin(1)
        return best, [int(x) for x in squared[np.arange(len(best)), best]]
    squared = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in centroids] for x in vectors.tolist()]
    best = np.array([min(range(len(row)), key=row.__getitem__) for row in squared], np.int64)
    return best, [row[k] for row, k in zip(squared, best.tolist(), strict=True)]


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return c.numbers(batch, "n")


def _summed(centroids: list[list[int]], dimensions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cluster: the number of its vectors and the sums of their components, over the task's rows."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vectors, n = decoded(c.column(part, "key"), dimensions), _weights(part)
            cluster, _ = nearest(vectors, centroids)
            fits = float(np.abs(vectors.astype(np.float64)).max()) * float(n.sum()) < 2.0**62
            weighted = (vectors if fits else vectors.astype(object)) * (n if fits else n.astype(object))[:, None]
            for k in np.unique(cluster):
                own = cluster == k
                new = [int(n[own].sum()), *(int(x) for x in weighted[own].sum(0))]
                totals[int(k)] = [a + b for a, b in zip(totals.get(int(k), [0] * len(new)), new, strict=True)]
    if totals:
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(kind))], ["cluster", "sums"])


def _assigned(centroids: list[list[int]], dimensions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("cluster", pa.int32()), ("squared", pa.decimal128(38, 0)), ("distance", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            cluster, squared = nearest(decoded(c.column(part, "key"), dimensions), centroids)
            held = [min(x, 10**38 - 1) for x in squared]
            yield c.named(schema, key=c.column(part, "key"), n=c.column(part, "n"), cluster=cluster.astype(np.int32), squared=pa.array(held, pa.decimal128(38, 0)), distance=pa.array([x if x <= LONG.max else None for x in squared], pa.int64()))


def seeds(rows: DataFrame, clusters: int, dimensions: int) -> list[list[int]]:
    """The vectors of the least hashes of their ids, in that order."""
    own = rows.where("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    found = own.orderBy("hash", F.hex("key")).limit(clusters).collect()
    return decoded(pa.array([bytes(r["key"]) for r in found], pa.binary()), dimensions).tolist()


def lloyd(distinct: DataFrame, centroids: list[list[int]], dimensions: int, rounds: int) -> list[list[int]]:
    """distinct: key, n. The centroids after so many rounds; one that gets no vector stays."""
    for _ in range(rounds):
        sums = c.mapped(distinct, partial(_summed, centroids, dimensions), "cluster int, sums array<decimal(38,0)>")
        added = sums.groupBy("cluster").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dimensions + 1)))
        for row in added.collect():  # a row a centroid
            total = [int(row[f"s{k}"]) for k in range(dimensions + 1)]
            centroids = [[x // total[0] for x in total[1:]] if k == row["cluster"] else own for k, own in enumerate(centroids)]
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS, scale: int = SCALE, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = c.written(c.mapped(own, partial(_kept, dimensions, scale), "vec_id long, key binary"))
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = seeds(rows, clusters, dimensions)
    if not first:
        return rows.sparkSession.createDataFrame([], empty)
    distinct = c.checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")))
    final = lloyd(distinct, first, dimensions, rounds)
    assigned = c.written(c.mapped(distinct, partial(_assigned, final, dimensions), "key binary, n long, cluster int, squared decimal(38,0), distance long"))
    added = assigned.groupBy("cluster").agg(F.try_sum(F.try_multiply("squared", F.col("n").cast("decimal(20,0)"))).alias("total")).collect()
    inertia = {r["cluster"]: LONG.max + 1 if r["total"] is None else int(r["total"]) for r in added}
    long = lambda x: x if x <= LONG.max else None
    named = [(k, long(inertia.get(k, 0)), long(sum(inertia.values())), digest(x)) for k, x in enumerate(final)]
    centroids = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # over 1/hot of all rows: fewer than `hot` vectors
    least = assigned.agg(F.sum("n")).first()[0] // hot
    often = assigned.where(F.col("n") > least).select("key", F.col("cluster").alias("_cluster"), F.col("distance").alias("_distance"))
    met = rows.join(F.broadcast(often), "key", "left")
    found = met.where("_cluster IS NOT NULL").select("vec_id", F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance"))
    rest = met.where("_cluster IS NULL").select("vec_id", "key").join(assigned.where(F.col("n") <= least).select("key", "cluster", "distance"), "key").select("vec_id", "cluster", "distance")
    out = found.unionByName(rest).join(F.broadcast(centroids), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(embeddings: DataFrame) -> DataFrame:
    return clustered(embeddings)


def sql() -> str:
    """The same with recursion unrolled: one row a component."""
    value = f"CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)"
    ctes = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: {value}) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT v, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS + 1):
        distance = "list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        ctes.append(f"a{r} AS (SELECT vec_id, any_value(kept.v) AS v, min(struct_pack(d := CAST({distance} AS BIGINT), k := c.k)) AS best FROM kept, c{r} AS c GROUP BY vec_id)")
        if r < ROUNDS:
            floor = "CAST(CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS BIGINT)"
            ctes.append(f"s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i)")
            ctes.append(f"m{r} AS (SELECT k, list({floor} ORDER BY i) AS v FROM s{r} GROUP BY k)")
            ctes.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (k))")
    a, last = f"a{ROUNDS}", f"c{ROUNDS}"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string({last}.v, ',')) AS centroid_sha256
FROM {a} JOIN {last} ON best.k = {last}.k"""
