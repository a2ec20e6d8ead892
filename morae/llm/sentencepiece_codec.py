"""SentencePiece encoding and decoding by a table of distinct chunks.

A piece of the model may hold several whitespace markers in front, but none behind another character; so no merge
crosses from a character to a marker, and a text, with the one marker that the library puts in front, is the sequence of
its chunks ` *[^ ]+` (and a last run of markers). Each worker keeps a table of the distinct chunks it has met: a
chunk is segmented and decoded once, by the library, and the texts of a slice take ids and decoded strings from the table
by position. No shuffle; memory is one slice of a batch and the bounded table.

Null text: as empty (no pieces, only the end id). Long texts are never cut. Ties and repeated rows give equal results.
Extra columns of the input are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as c
from .chunk_table import ChunkTable, kept

MODEL = "piece_bpe_32k.model"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
MARK = "▁"


class Codec:
    """The library's model and the table: chunk -> its ids as text with a space behind each, and its decoded text."""

    def __init__(self, model: str | None):
        import public_tokenizers
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path(MODEL))
        crossing = [p for p in map(self.library.id_to_piece, range(self.library.vocab_size())) if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing or self.library.encode("a") == self.library.encode(" a"):
            raise ValueError(f"texts can't be taken apart: pieces {crossing[:3]} cross, or spaces are normalised")
        self.line = self.library.encode("\n")[-1]
        self.end = self.library.eos_id()
        self.table = ChunkTable(2)

    def make(self, chunks: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Segment and decode chunks. They go to the library as lines of one text: no piece holds a line's end."""
        texts = [x.decode() for x in chunks]
        plain = [x for x in texts if "\n" not in x and x != " "]
        ids: dict[str, list[int]] = {}
        decoded: dict[str, str] = {}
        for k in range(0, len(plain), 200):
            own = plain[k : k + 200]
            flat = self.library.encode("\n" + "\n".join(own))[2:]  # without the marker and the first line's end
            at = 0
            for chunk in own:
                to = flat.index(self.line, at) if at + 1 < len(flat) and self.line in flat[at:] else len(flat)
                ids[chunk] = flat[at:to]
                at = to + 1
            whole = self.library.decode(flat).split("\n")
            # the library drops one marker at the very start of what it decodes
            decoded |= dict(zip(own, [" " + whole[0], *whole[1:]], strict=True))
        for chunk in texts:
            if chunk not in ids:
                ids[chunk] = self.library.encode(chunk[1:]) if chunk != " " else [self.library.piece_to_id(MARK)]
                decoded[chunk] = " " + self.library.decode(ids[chunk])
        return [b"".join(b"%d " % i for i in ids[x]) for x in texts], [decoded[x].encode() for x in texts]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The table's entries of all chunks of the texts, and where each text's begin."""
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")))
        data, at = c.string_bytes(texts)
        space = data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        entries = self.table.entries(data, starts, ends, c.span_hash(data, starts, ends), self.make)
        return entries, np.searchsorted(starts, at)


def _codec(model: str | None) -> Codec:
    return kept(("sentencepiece", model), lambda: Codec(model))


def _parts(codec: Codec, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Of each text: its ids as text, with a space behind each, and its decoded text."""
    entries, first = codec.of(texts)
    out = []
    for k in (0, 1):
        flat = codec.table.gather(k, entries).tobytes()
        ends = np.concatenate([[0], np.cumsum(codec.table.lengths(k, entries))])[first].tolist()
        out.append([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])
    return zip(*out, strict=True)


def digests(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, with an end id and no sampling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        end = str(codec.end).encode()
        for batch in batches:
            for part in c.slices(batch):
                found = [(ids.count(b" ") + 1, hashlib.sha256(ids + end).hexdigest(), hashlib.sha256(text[1:]).hexdigest()) for ids, text in _parts(codec, c.column(part, "text"))]
                n, ids, texts = map(list, zip(*found, strict=True))
                yield c.named(SCHEMA, doc_id=c.column(part, "doc_id"), n_tokens=n, ids_sha256=ids, decoded_sha256=texts)

    return c.documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id), decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for part in c.slices(batch):
                ids, texts = map(list, zip(*_parts(codec, c.column(part, "text")), strict=True))
                yield c.named(ENCODED, doc_id=c.column(part, "doc_id"), ids=[[*map(int, x.split()), codec.end] for x in ids], decoded=[x[1:].decode() for x in texts])

    return c.documents(df).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
