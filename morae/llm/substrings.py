"""Substring deduplication on a de Bruijn graph of word k-mers.

Every window of k words is an edge between its first and last k - 1 words. Edges are dealt by minimiser (the smallest
hash of a shorter word sequence inside), so that equal edges meet and consecutive ones mostly stay together; they travel
as packed runs in numpy buffers, a few bytes an edge. A slice of the input first joins its own equal edges: of those only the
smallest document's are sent on, so a passage that a third of all documents hold costs a row a slice, not a row a document.
In its bucket, an edge that begins in several documents gets source coordinates: the smallest document and its first
position. Edges that follow each other in a document and in its source are one nonbranching run; runs of different
buckets are joined at their common node by Spark and make up repeated paths. Last, one pass over the texts takes an independent
hash of each path and of its source span; a path whose hashes differ is not removed.

Null or short texts: no windows, nothing removed. Very long texts are taken whole. Repeated rows of one doc_id: each is cut by its
own text, and none is a source of another, since the rule asks for a smaller doc_id. Ties: none, the rule is strict. Extra
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
from pyspark.sql.window import Window

from . import common as c

K = 13
SUB = 6  # words of a minimiser
EDGES = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
RUNS = pa.schema([(x, pa.int64()) for x in ("doc", "ver", "start", "n", "src", "src_ver", "src_start")])
RUNS_DDL = "doc long, ver long, start long, n long, src long, src_ver long, src_start long"
SLICE = 2 << 20


def _minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i+width] for every i."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _runs(doc: np.ndarray, ver: np.ndarray, pos: np.ndarray, gone: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Removed edges (gone) as runs that follow each other in the document and in its source (first)."""
    order = np.lexsort((pos[gone], ver[gone], doc[gone]))
    gone, first = gone[order], first[order]
    step = np.arange(len(gone))
    own, src = (doc[gone], ver[gone], pos[gone]), (doc[first], ver[first], pos[first])
    new = np.flatnonzero(c.first_of_group(own[0], own[1], own[2] - step, src[0], src[1], src[2] - step))
    n = np.diff(np.append(new, len(gone)))
    return {"doc": own[0][new], "ver": own[1][new], "start": own[2][new], "n": n, "src": src[0][new], "src_ver": src[1][new], "src_start": src[2][new]}


def _sources(doc: np.ndarray, ver: np.ndarray, pos: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges in several places: the removed ones, and the first of each (indices)."""
    order = np.argsort(edge, kind="stable")
    twin = np.zeros(len(edge), bool)
    same = edge[order][1:] == edge[order][:-1]
    twin[1:] = same
    twin[:-1] |= same
    own = order[twin]
    own = own[np.lexsort((pos[own], ver[own], doc[own], edge[own]))]
    head = np.flatnonzero(c.first_of_group(edge[own]))
    first = own[np.repeat(head, np.diff(np.append(head, len(own))))]
    gone = doc[own] > doc[first]
    return own[gone], first[gone]


def _edges(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs of edges for each bucket; a payload holds the slice's own document ids, then run heads, then 6 bytes an edge."""
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            ids, vers = c.numbers(part, "doc_id"), c.numbers(part, "ver")
            w = c.words(c.column(part, "text"))
            at, row = c.window_rows(w.first, k)
            if not len(at):
                continue
            edge = c.window_hash(w.hashes, k)[at]
            least = _minimum(c.window_hash(w.hashes, SUB, 1), k - SUB + 1)[at]
            doc, ver, pos = ids[row], vers[row].astype(np.int64), at - w.first[row]
            gone, first = _sources(doc, ver, pos, edge)
            if len(gone):
                found = _runs(doc, ver, pos, gone, first)
                payload = np.stack([found[x] for x in RUNS.names]).astype("<i8").tobytes()
                yield c.named(EDGES, bucket=[-1 - int(doc[gone[0]]) % buckets], payload=c.binary([payload]))
            stay = np.ones(len(edge), bool)
            stay[gone] = False
            stay = np.flatnonzero(stay)
            to = (c.mix(least[stay], 2) % np.uint64(buckets)).astype(np.int64)
            head = np.flatnonzero(c.first_of_group(to, at[stay] - np.arange(len(stay)), row[stay]))
            n = np.diff(np.append(head, len(stay)))
            order = np.argsort(to[head], kind="stable")  # runs by bucket
            head, n = head[order], n[order]
            six = np.ascontiguousarray((edge[stay] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])[c.runs(head, n)]
            begin = np.concatenate([[0], np.cumsum(n)])
            cut = np.append(np.flatnonzero(c.first_of_group(to[head])), len(head)).tolist()
            whole = row[stay][head], pos[stay][head], n
            names, payloads = [], []
            for a, b in zip(cut, cut[1:], strict=False):
                rows, start, size = (x[a:b] for x in whole)
                docs, rows = np.unique(rows, return_inverse=True)
                payloads.append(b"".join([np.array([len(docs), b - a], "<i8").tobytes(), ids[docs].astype("<i8").tobytes(), vers[docs].astype("<i8").tobytes(), rows.astype("<i4").tobytes(), start.astype("<i4").tobytes(), size.astype("<i4").tobytes(), six[begin[a] : begin[b]].tobytes()]))
                names.append(int(to[head[a]]))
            yield c.named(EDGES, bucket=names, payload=c.binary(payloads))


def _bucket(payloads: list[bytes]) -> dict[str, np.ndarray] | None:
    doc, ver, pos, edge = [], [], [], []
    for raw in payloads:
        n, m = np.frombuffer(raw, "<i8", 2)
        ids = np.frombuffer(raw, "<i8", n, 16)
        vers = np.frombuffer(raw, "<i8", n, 16 + 8 * n)
        rows, start, size = np.frombuffer(raw, "<i4", 3 * m, 16 + 16 * n).reshape(3, m)
        total = int(size.sum())
        doc.append(np.repeat(ids[rows], size))
        ver.append(np.repeat(vers[rows], size))
        pos.append(c.runs(start.astype(np.int64), size.astype(np.int64)))
        wide = np.zeros((total, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * total, 16 + 16 * n + 12 * m).reshape(total, 6)
        edge.append(wide.view("<u8").ravel())
    doc, ver, pos, edge = map(np.concatenate, (doc, ver, pos, edge))
    gone, first = _sources(doc, ver, pos, edge)
    return _runs(doc, ver, pos, gone, first) if len(gone) else None


def repeated_paths(docs: DataFrame, k: int = K, bucket_mb: float = 8) -> DataFrame:
    """doc, ver, start, n, src, src_ver, src_start: maximal runs of n windows of a document that its source holds in the same order."""
    buckets = c.buckets(docs, bucket_mb)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for bucket, payload in zip(c.column(batch, "bucket").to_pylist(), c.column(batch, "payload").to_pylist(), strict=True):
                if bucket < 0:
                    flat = np.frombuffer(payload, "<i8").reshape(len(RUNS), -1)
                    yield c.named(RUNS, **dict(zip(RUNS.names, flat, strict=True)))
                else:
                    own[bucket].append(payload)
        while own:
            if found := _bucket(own.popitem()[1]):
                yield c.named(RUNS, **found)

    dealt = docs.mapInArrow(c.lean(lambda batches: _edges(batches, k, buckets)), "bucket long, payload binary").repartition(buckets, "bucket")
    with c.stored(dealt.mapInArrow(c.lean(meet), RUNS_DDL)) as runs:
        # a run goes on with another where both end at the same node, in the document and in the source
        ends = runs.select("doc", "ver", "src", "src_ver", (F.col("start") + F.col("n")).alias("start"), (F.col("src_start") + F.col("n")).alias("src_start"), F.lit(0).alias("head"))
        linked = runs.join(ends.distinct(), ["doc", "ver", "src", "src_ver", "start", "src_start"], "left").withColumn("diagonal", F.col("start") - F.col("src_start"))
        line = Window.partitionBy("doc", "ver", "src", "src_ver", "diagonal").orderBy("start")
        numbered = linked.withColumn("path", F.sum(F.coalesce("head", F.lit(1))).over(line))
        # equal rows bring equal runs, so lengths come from the ends
        length = F.max(F.col("start") + F.col("n")) - F.min("start")
        paths = numbered.groupBy("doc", "ver", "src", "src_ver", "diagonal", "path").agg(F.min("start").alias("start"), length.alias("n"), F.min("src_start").alias("src_start"))
        return c.checkpoint(paths.select(*RUNS.names))


CUT = pa.schema([("doc_id", pa.int64()), ("ver", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("own", pa.list_(pa.int64())), ("lent", pa.list_(pa.int64()))])
CUT_DDL = "doc_id long, ver long, text string, n_words long, n_removed long, kept_sha256 string, own array<long>, lent array<long>"


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a list column (null: no elements)."""
    n = np.array(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.repeat(np.arange(len(array)), n), np.asarray(array.flatten().to_numpy(zero_copy_only=False), np.int64)


def _cut(batches: Iterator[pa.RecordBatch], k: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Take the covered words out of each text, and hash the document's paths and the spans it lends as a source."""
    for batch in batches:
        for part in c.slices(batch, limit=SLICE):
            w = c.words(c.column(part, "text"), seed=3)
            total = np.zeros(len(w.hashes) + 1, np.int64)
            hashes = []
            for name in ("own", "lent"):
                row, value = _flat(c.column(part, name))
                row, start, n = row[::2], value[::2], value[1::2]
                a = w.first[row] + start
                b = np.minimum(a + n + k - 1, w.first[row + 1])  # no span leaves its row
                a = np.minimum(a, b)
                found = c.signed(c.span_hash(w.hashes, a, b, 4)) if len(a) else np.zeros(0, np.int64)
                hashes.append(pa.ListArray.from_arrays(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32), pa.array(found)))
                if name == "own":
                    np.add.at(total, a, 1)
                    np.add.at(total, b, -1)
            gone = np.cumsum(total)[:-1] > 0
            raw = w.data.tobytes()
            stay = np.flatnonzero(~gone)
            edge = np.searchsorted(stay, w.first).tolist()
            parts = [raw[a:b] for a, b in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]
            kept = [b" ".join(parts[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
            removed = w.counts - np.diff(edge)
            out = c.column(part, "text")
            if texts:
                out = [x.decode() if r else t for x, r, t in zip(kept, removed, out.to_pylist(), strict=True)]
            else:
                out = pa.nulls(part.num_rows, pa.string())
            yield c.named(CUT, doc_id=c.column(part, "doc_id"), ver=c.column(part, "ver"), text=out, n_words=w.counts, n_removed=removed, kept_sha256=[hashlib.sha256(x).hexdigest() for x in kept], own=hashes[0], lent=hashes[1])


def _spans(paths: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents with their paths (own) and the spans that others have in them (lent), flat: start, n, start, n, ..."""
    flat = lambda name: F.flatten(F.transform(name, lambda x: F.array(x["start"], x["n"])))
    own = paths.select("doc", "ver", "start", "n", F.lit(True).alias("mine"))
    lent = paths.select(F.col("src").alias("doc"), F.col("src_ver").alias("ver"), F.col("src_start").alias("start"), "n", F.lit(False).alias("mine"))
    span = F.struct("start", "n")
    lists = own.union(lent).groupBy("doc", "ver").agg(F.array_sort(F.collect_set(F.when(F.col("mine"), span))).alias("own"), F.array_sort(F.collect_set(F.when(~F.col("mine"), span))).alias("lent"))
    return docs.join(lists.withColumnRenamed("doc", "doc_id"), ["doc_id", "ver"], "left").withColumns({"own": flat("own"), "lent": flat("lent"), "own_spans": F.col("own"), "lent_spans": F.col("lent")})


def remove(df: DataFrame, k: int = K, texts: bool = True) -> DataFrame:
    """doc_id, ver, text (kept words joined by one space; unchanged where nothing goes), n_words, n_removed, kept_sha256."""
    docs = c.documents(df, c.version().alias("ver"))
    paths = repeated_paths(docs, k)

    def cut(paths: DataFrame) -> DataFrame:
        given = _spans(paths, docs)
        return given.select("doc_id", "ver", "text", "own", "lent").mapInArrow(c.lean(lambda batches: _cut(batches, k, texts)), CUT_DDL)

    done = c.checkpoint(cut(paths))
    lists = _spans(paths, docs.select("doc_id", "ver")).select("doc_id", "ver", "own_spans", "lent_spans").distinct()
    hashed = done.select("doc_id", "ver", "own", "lent").join(lists, ["doc_id", "ver"])
    one = lambda spans, hashes: hashed.select("doc_id", "ver", F.explode(F.arrays_zip(F.col(spans).alias("span"), F.col(hashes).alias("hash"))).alias("x")).select("doc_id", "ver", "x.span.start", "x.span.n", "x.hash")
    own = one("own_spans", "own").withColumnsRenamed({"doc_id": "doc", "hash": "own"}).distinct()
    lent = one("lent_spans", "lent").withColumnsRenamed({"doc_id": "src", "ver": "src_ver", "start": "src_start", "hash": "lent"}).distinct()
    # what the borrowers of a span read there, combined on the map side: a passage of many documents costs a row a task
    span = ["src", "src_ver", "src_start", "n"]
    claims = paths.join(own, ["doc", "ver", "start", "n"])
    wrong = c.checkpoint(claims.select(*span, "own").distinct().join(lent, span).where("own <> lent").select(*span, "own").distinct())
    if not wrong.isEmpty():  # a hash of 48 bits and a bucket met another window: its path goes back
        false = c.checkpoint(claims.join(wrong, [*span, "own"], "left_semi").select("doc", "ver", "start", "n").distinct())
        done = c.checkpoint(cut(paths.join(false, ["doc", "ver", "start", "n"], "left_anti")))
    return done.drop("own", "lent")


def query(df: DataFrame) -> DataFrame:
    """Every document's words and what is left of them."""
    return remove(df, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
