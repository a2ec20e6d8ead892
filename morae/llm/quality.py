"""Quality rules: base counts of each text, and the cross-document frequency of its lines.

Lines are normalised (A-Z lower-cased, words joined by one space) and hashed to 64 bits; a line's frequency on a host
(`source`) is the number of the host's distinct documents that hold it; documents with the same set of lines, copies, count as
one. A line is boilerplate where its frequency reaches `min_docs` and more than `max_share` of the host's documents, or `always`
at any share. A few documents over the share are enough, so the limits act alike on hosts of every size. The host's first
document that holds a boilerplate line (the least doc_id) keeps it, so that a group of near copies leaves one whole. A document is
rejected if it fails the base rules, or if it is depleted: fewer words than the base rules ask for, or than `min_left` of its own, stand
outside boilerplate lines.
Frequencies count whole tables; a distinct document sends one row for each distinct line, and counts are combined on the map
side, so a line that a third of all documents hold costs a row a task.

Null text: no words, base_failed. Null source: a host of its own. Very long texts are counted whole. Repeated rows of a doc_id are
judged each, and equal ones alike. Extra columns are ignored, or kept by `clean`, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
MIN_DOCS, MAX_SHARE, MIN_LEFT, ALWAYS = 5, 0.05, 0.1, 1000
HOT = 1000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ver", pa.int64()), ("source", pa.string()), *((x, pa.int64()) for x in COUNTS), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
DDL = "row long, doc_id long, ver long, source string, " + ", ".join(f"{x} long" for x in COUNTS) + ", lines array<long>, sizes array<long>"
SLICE = 2 << 20


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), pa.array(values))


def _lines(w: c.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each line in the slice's bytes, and its row."""
    stops = np.flatnonzero(w.data == 10)
    begin = np.sort(np.concatenate([w.at[:-1], stops + 1]))
    end = np.sort(np.concatenate([w.at[1:], stops]))
    # the k-th begin belongs to the k-th end; a row of no bytes is one empty line
    row = np.repeat(np.arange(len(w.at) - 1), 1 + np.diff(np.searchsorted(stops, w.at)))
    return begin, end, row


def measure(texts: pa.Array) -> dict[str, object]:
    """The base counts of each text, and its distinct normalised lines with their words."""
    w = c.words(texts)
    n = len(texts)
    rows = w.rows
    inside = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    out: dict[str, object] = {"n_words": w.counts, "word_chars": c.row_sums(inside & ((w.data & 0xC0) != 0x80), w.at), "n_symbols": c.row_sums(SYMBOLS[w.data], w.at)}

    begin, end, line_row = _lines(w)
    first = np.searchsorted(w.starts, begin)
    words = np.searchsorted(w.starts, end) - first
    inked = np.flatnonzero(words > 0)
    exact = c.span_hash(w.data, begin[inked], end[inked], 1)
    order = np.lexsort((exact, line_row[inked]))
    again = ~c.first_of_group(line_row[inked][order], exact[order])
    out["n_dup_lines"] = np.bincount(line_row[inked][order][again], minlength=n)

    at, row = c.window_rows(w.first, 3)
    window = c.window_hash(w.hashes, 3)[at]
    order = np.argsort(window, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    same = ~c.first_of_group(row[order], window[order]) if len(order) else np.zeros(0, bool)
    twice = same.copy()
    twice[:-1] |= same[1:]
    own = at[order[twice]]
    covered = np.zeros(len(w.hashes) + 3, bool)
    for k in range(3):
        covered[own + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered[: len(rows)]], minlength=n)

    low = c.words(texts, lower=True)
    normal = c.span_hash(low.hashes, first[inked], first[inked] + words[inked], 2)
    order = np.lexsort((normal, line_row[inked]))
    normal, owner, size = normal[order], line_row[inked][order], words[inked][order]
    new = np.flatnonzero(c.first_of_group(owner, normal)) if len(owner) else np.zeros(0, np.int64)
    sizes = np.add.reduceat(size, new) if len(new) else size
    out["lines"], out["sizes"] = _lists(owner[new], c.signed(normal[new]), n), _lists(owner[new], sizes, n)
    return out


def _measured(df: DataFrame) -> DataFrame:
    docs = c.documents(df, c.version().alias("ver"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, limit=SLICE):
                yield c.named(SCHEMA, row=c.column(part, "row"), doc_id=c.column(part, "doc_id"), ver=c.column(part, "ver"), source=c.column(part, "source"), **measure(c.column(part, "text")))

    return c.checkpoint(docs.mapInArrow(c.lean(run), DDL))


def judge(df: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, always: float = ALWAYS) -> DataFrame:
    """row, doc_id, ver, source, the counts, base_failed, n_boilerplate_words, kept, and the hashes of boilerplate lines."""
    rows = _measured(df)
    copies = F.xxhash64("lines", F.size("lines"))  # lines are sorted
    one = rows.groupBy("source", copies.alias("copies")).agg(F.min(F.struct("doc_id", "row")).alias("least")).select("source", F.col("least.row").alias("row"))
    hosts = one.groupBy("source").agg(F.count("*").alias("host_docs"))
    lines = rows.select("row", "doc_id", "source", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("row", "doc_id", "source", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    counted = lines.join(one.select("row", F.lit(True).alias("counts")), "row", "left")
    often = counted.groupBy("source", "line").agg(F.count("counts").alias("n"), F.min(F.when(F.col("counts"), F.col("doc_id"))).alias("first"), F.count("*").alias("n_rows")).where(F.col("n") >= min(min_docs, always))
    share = (F.col("n") >= min_docs) & (F.col("n") > max_share * F.col("host_docs"))
    often = often.join(hosts, "source").where(share | (F.col("n") >= F.lit(float(always)))).select("source", "line", "first", "n_rows")
    hit = _meeting(lines, c.checkpoint(often)).where("doc_id <> first").groupBy("row").agg(F.sum("size").alias("n_boilerplate_words"), F.collect_list("line").alias("boilerplate"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = rows.drop("lines", "sizes").join(hit, "row", "left").withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)).cast("long")).withColumn("base_failed", base)
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")))


def _meeting(lines: DataFrame, often: DataFrame) -> DataFrame:
    """Lines joined with boilerplate. Lines that hold over a HOTth of all rows, so HOT at most, are broadcast: no task gets all rows of one."""
    most = lines.count() // HOT
    hot = F.broadcast(often.where(F.col("n_rows") > most).select("source", "line", "first"))
    rest = lines.join(hot.select("source", "line"), ["source", "line"], "left_anti").join(often.where(F.col("n_rows") <= most).select("source", "line", "first"), ["source", "line"])
    return rest.unionByName(lines.join(hot, ["source", "line"]))


def query(df: DataFrame) -> DataFrame:
    """Every document's counts and verdict."""
    return judge(df).select("doc_id", *COUNTS, "base_failed", "kept", "n_boilerplate_words")


def sql() -> str:
    """The same as DuckDB SQL."""
    space = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{space}') AS w FROM d),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
inked AS (SELECT doc_id, source, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{space}'), ' ') AS normal, len(regexp_extract_all(line, '{space}')) AS n FROM l WHERE regexp_matches(line, '{space}')),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM inked GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) AS t FROM w WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
own AS (SELECT doc_id, source, normal, sum(n) AS n FROM inked GROUP BY ALL),
sets AS (SELECT doc_id, source, coalesce(list(normal ORDER BY normal) FILTER (normal IS NOT NULL), []) AS s FROM d LEFT JOIN own USING (doc_id, source) GROUP BY ALL),
one AS (SELECT source, s, min(doc_id) AS doc_id FROM sets GROUP BY ALL),
hosts AS (SELECT source, count(*) AS docs FROM one GROUP BY source),
often AS (SELECT source, normal, first FROM (SELECT source, normal, count(*) AS n, min(doc_id) AS first FROM own SEMI JOIN one USING (doc_id, source) GROUP BY ALL) JOIN hosts USING (source) WHERE (n >= {MIN_DOCS} AND n > {MAX_SHARE}::DOUBLE * docs) OR n >= {ALWAYS}),
hit AS (SELECT doc_id, sum(n)::BIGINT AS n_boilerplate_words FROM own JOIN often USING (source, normal) WHERE doc_id <> first GROUP BY doc_id),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_boilerplate_words, 0) AS n_boilerplate_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN hit USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_words - n_boilerplate_words >= greatest({MIN_WORDS}, {MIN_LEFT}::DOUBLE * n_words) AS kept FROM j
"""


def clean(df: DataFrame, **limits: float) -> DataFrame:
    """The documents that are kept, without their boilerplate lines, with the columns of the input."""
    names = df.columns
    key, gone_in = c.fresh("ver", names), c.fresh("boilerplate", names)
    # rows that are equal in doc_id and text are judged alike
    verdict = judge(df, **limits).where("kept").groupBy("doc_id", "ver").agg(F.first("boilerplate").alias(gone_in)).withColumnRenamed("ver", key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, limit=SLICE):
                texts, gone = c.column(part, "text"), c.column(part, gone_in)
                w = c.words(texts, lower=True)
                begin, end, row = _lines(w)
                first, last = np.searchsorted(w.starts, begin), np.searchsorted(w.starts, end)
                normal = c.signed(c.span_hash(w.hashes, first, last, 2))
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                out = texts.to_pylist()
                for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    a, b = edge[k], edge[k + 1]
                    drop = np.isin(normal[a:b], np.asarray(gone[k].values)) & (last[a:b] > first[a:b])
                    out[k] = "\n".join([x for x, y in zip(out[k].split("\n"), drop, strict=True) if not y])
                columns = {x: c.column(part, x) for x in names}
                columns["text"] = pa.array(out, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if x is None else len(x) for x in out]).cast(columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return df.withColumn(key, c.version()).join(verdict, ["doc_id", key]).select(*names, gone_in).mapInArrow(c.lean(run), schema)
