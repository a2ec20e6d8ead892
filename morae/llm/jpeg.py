"""Media columns: baseline JPEG of DC-only luminance blocks.

A payload is stored as grey baseline JPEG: each 8x8 block is flat, its quantised DC coefficient is one payload byte
minus 128 (quantiser 8, so the block's mean is the byte) and its AC part is the end-of-block code alone. The DC-only
thumbnail, one sample per block, is the payload. An image is 64 blocks wide and has a restart interval of one
block row, so that the Huffman scan is decoded for all rows of all images of a slice at once in numpy: step k decodes
block k of every interval. Payloads over MAX_ROWS rows go on in further images of the same stream.

The reader takes baseline streams of any encoder apart by their markers (SOI, APPn, COM, DQT, DHT, SOF0, DRI, SOS, RSTn, EOI), with
the tables that the stream itself brings: grey images, and the luminance of colour images with any sampling of the colour
differences; AC codes are passed over. Images without restart intervals are decoded side by side with others of the same
layout, but each from front to back. `described` gives their dimensions, thumbnails and hashes. Null text: as empty, hence one row of zero bytes. Equal texts give equal values. Extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WIDTH = 64  # blocks in a row, and bytes that a payload is a multiple of
MAX_ROWS = 8191  # 8 * 8191 lines fit the 16-bit height
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int64())])
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height long"

# fixed values: DC size categories by code length (a difference of two bytes has at most 8 bits; 9 is not needed), and
# the AC table, which holds the end-of-block symbol alone
DC_COUNTS = [0, 0, 7, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [4, 5, 6, 7, 3, 2, 1, 0, 8]
AC_COUNTS = [1, *[0] * 15]
AC_SYMBOLS = [0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8]) + bytes([1] * 63))
TABLES = _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the canonical table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code *= 2
    return out


def _words() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: the bits of the whole block (size, difference, end of block), and their number."""
    dc, (eob, eob_bits) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    word, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        value = (code << size) | (d if d >= 0 else d + (1 << size) - 1)
        word[d + 255], bits[d + 255] = (value << eob_bits) | eob, length + size + eob_bits
    return word, bits


WORD, BITS = _words()


def write(payload: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """The streams of payloads that stand end to end, of so many rows of 64 bytes each."""
    n = len(payload) // WIDTH
    value = payload.reshape(n, WIDTH).astype(np.int64)
    diff = np.diff(value, axis=1, prepend=128) + 255  # the predictor is 0 where an interval begins
    bits = BITS[diff]
    own = bits.sum(1)
    size = (own + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    at = (np.cumsum(bits, axis=1) - bits) + 8 * first[:-1, None]
    # every block lies in the 32 bits from its first byte on; bits of blocks don't overlap, so sums are unions
    shifted = (WORD[diff] << (32 - bits - at % 8).astype(np.uint64)).ravel()
    byte = (at >> 3).ravel()
    scan = np.zeros(int(first[-1]) + 4, np.uint8)
    # blocks that begin in the same byte stand side by side: unite them first, then each shift meets a byte once
    new = np.flatnonzero(np.diff(byte, prepend=-1))
    shifted, byte = np.bitwise_or.reduceat(shifted, new) if len(new) else shifted, byte[new]
    for k in range(4):
        scan[byte + k] |= ((shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    scan = scan[:-4]
    scan[first[1:] - 1] |= ((1 << (8 * size - own)) - 1).astype(np.uint8)  # filled up with ones
    # stuffing, and a restart marker behind every interval but an image's last
    stuffed = scan == 0xFF
    wide = 1 + stuffed.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(wide)])[first]
    images = [min(MAX_ROWS, r - k) for r in rows.tolist() for k in range(0, r, MAX_ROWS)]
    stop = np.cumsum(images)
    within = np.arange(n) - np.repeat(stop - images, images)
    mark = np.ones(n, np.int64)
    mark[stop - 1] = 0
    shift = np.concatenate([[0], np.cumsum(2 * mark)])
    out = np.zeros(int(ends[-1] + shift[-1]), np.uint8)
    place = np.concatenate([[0], np.cumsum(wide)])[:-1] + np.repeat(shift[:-1], size)
    out[place] = scan
    where = np.flatnonzero(mark)
    out[ends[where + 1] + shift[where]] = 0xFF
    out[ends[where + 1] + shift[where] + 1] = 0xD0 + within[where] % 8
    edge = (ends + shift)[np.concatenate([[0], stop])].tolist()
    raw, streams, k = out.tobytes(), [], 0
    for r in rows.tolist():
        parts = []
        for _ in range(0, r, MAX_ROWS):
            parts += [HEAD, _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * images[k], 8 * WIDTH, 1, 1, 0x11, 0)), TABLES, raw[edge[k] : edge[k + 1]], b"\xff\xd9"]
            k += 1
        streams.append(b"".join(parts))
    return streams


class Scan:
    """An image's frame, tables and entropy-coded bytes, found by its markers.

    Grey images have one component; colour ones have three, luminance first and sampled as densely as any. Their blocks are
    interleaved in units by the sampling factors, or stand in scans of their own, of which the luminance's must be the first.
    """

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quant: dict[int, int] = {}
        tables: dict[int, tuple] = {}
        parts: list[tuple[int, int, int]] = []  # name, sampling factors, quantiser
        mixed = True  # luminance and colour differences, not red, green and blue
        self.interval = 0
        while True:
            if data[at : at + 1] != b"\xff":
                raise ValueError("no marker where one must be")
            if data[at + 1] == 0xFF:  # a fill byte
                at += 1
                continue
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    tables[body[0]] = (counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xEE and body[:5] == b"Adobe":
                mixed = body[11] == 1
            elif marker == 0xC0:
                precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                parts = [(body[k], body[k + 1], body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
                if precision != 8 or n not in (1, 3) or not self.width or not self.height:
                    raise ValueError("only grey and colour baseline images of a stated size are read")
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                break
        if len(parts) == 3 and (not mixed or bytes(x for x, _, _ in parts) == b"RGB"):
            raise ValueError("no luminance in red, green and blue")
        own = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
        if list(own) not in ([parts[0][0]], [x for x, _, _ in parts]):
            raise ValueError("luminance isn't in the first scan")
        factors = [(x >> 4, x & 15) for _, x, _ in parts]
        across, down = map(max, zip(*factors, strict=True))
        if factors[0] != (across, down):
            raise ValueError("luminance is sampled less than colour")
        if len(own) == 1:
            factors, across, down = [(1, 1)], 1, 1
        self.unit = (down, across)  # luminance blocks of a unit
        self.units = (-(-self.height // (8 * down)), -(-self.width // (8 * across)))
        self.quant = quant[parts[0][2]]
        used = [(tables[x >> 4], tables[0x10 | x & 15]) for x in own.values()]
        self.layout = tuple((k, *used[k]) for k, (h, v) in enumerate(factors) for _ in range(h * v))  # a unit's blocks: component and tables
        self.begin = at
        self.end = _stop(data, at)
        at = self.end
        while data[at + 1] != 0xD9:  # scans of the other components
            other = data[at + 1]
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            if other == 0xDA:
                at = _stop(data, at)
        self.after = at + 2

    def grid(self, samples: np.ndarray) -> np.ndarray:
        """Samples, in the order of their units, as rows from left to right, without the blocks that fill up the last units."""
        if self.unit == (1, 1):
            return samples
        placed = samples.reshape(*self.units, *self.unit).swapaxes(1, 2).reshape(self.units[0] * self.unit[0], -1)
        return placed[: -(-self.height // 8), : -(-self.width // 8)].ravel()


#: A marker that ends entropy-coded bytes: no stuffing, restart or fill byte.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _stop(data: bytes, at: int) -> int:
    found = MARKER.search(data, at)
    if found is None:
        raise ValueError("no end of image")
    return found.start()


def _lookup(table: tuple) -> np.ndarray:
    """For the next 16 bits: length * 256 + symbol of the code that they begin with, or 0."""
    out = np.zeros(1 << 16, np.int64)
    code = at = k = 0
    counts, symbols = table
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code *= 2
    return out


def thumbnails(scans: list[tuple[Scan, np.ndarray]]) -> list[np.ndarray]:
    """The DC-only luminance of images (scan, entropy-coded bytes) with the same layout of a unit and the same interval."""
    one = scans[0][0]
    lookup = {x: _lookup(x) for _, *own in one.layout for x in own}
    wide = one.unit[0] * one.unit[1]
    raw = np.concatenate([x for _, x in scans])
    origin = np.concatenate([[0], np.cumsum([len(x) for _, x in scans])])
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    second = raw[escape + 1]
    restart = escape[(second >= 0xD0) & (second <= 0xD7)]
    begin = np.sort(np.concatenate([origin[:-1], restart + 2]))
    drop = np.zeros(len(raw), bool)
    drop[escape[second == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    keep = ~drop
    begin = np.concatenate([[0], np.cumsum(keep)])[begin]
    bits = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    # the 32 bits from every byte on
    word = (bits[:-4] << np.uint64(32)) | (bits[1:-3] << np.uint64(24)) | (bits[2:-2] << np.uint64(16)) | (bits[3:-1] << np.uint64(8)) | bits[4:]
    counts = np.array([s.units[0] * s.units[1] for s, _ in scans])
    interval = one.interval or int(counts.max())
    per = -(-counts // interval)
    if len(begin) != per.sum():
        raise ValueError("restart markers are missing")
    full = np.full(len(begin), interval)
    full[np.cumsum(per) - 1] = counts - (per - 1) * interval
    at = begin * 8
    value = np.zeros((len(one.layout), len(begin)), np.int64)  # of each component, as far as it is read
    out = np.zeros((len(begin), interval, wide), np.int64)

    def peek(at: np.ndarray, n: int) -> np.ndarray:
        return ((word.take(at >> 3, mode="clip") >> (40 - n - (at & 7)).astype(np.uint64)) & np.uint64((1 << n) - 1)).astype(np.int64)

    def symbol_at(table: tuple, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = lookup[table][peek(pos, 16)]
        if len(found) and found.min() < 256:
            raise ValueError("bits that are no code")
        return found & 255, found >> 8

    for k in range(interval):
        live = slice(None) if k < full.min() else np.flatnonzero(full > k)
        pos = at[live]
        for j, (part, dc, ac) in enumerate(one.layout):
            size, length = symbol_at(dc, pos)
            pos = pos + length
            extra = peek(pos, 16) >> (16 - size)
            value[part, live] += np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            if part == 0:
                out[live, k, j] = value[0, live]
            pos = pos + size
            left = np.full(len(pos), 63)
            open_ = np.arange(len(pos))  # blocks whose AC symbols go on; only their lengths matter here
            while len(open_):
                symbol, length = symbol_at(ac, pos[open_])
                pos[open_] += length + (symbol & 15)
                left[open_] -= (symbol >> 4) + 1
                open_ = open_[(symbol != 0) & (left[open_] > 0)]
        at[live] = pos
    if (at > 8 * np.append(begin[1:], keep.sum())).any():
        raise ValueError("an interval's codes go on behind its end")
    flat = out.reshape(-1, wide) if full.min() == interval else out[np.arange(interval) < full[:, None]]
    ends = np.cumsum(counts)[:-1]
    return [np.clip(np.round(s.grid(x.ravel()) * s.quant / 8) + 128, 0, 255).astype(np.uint8) for (s, _), x in zip(scans, np.split(flat, ends), strict=True)]


def read(streams: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Width, total height and all DC samples of each stream of images; a stream that can't be read raises ValueError."""
    scans: list[tuple[Scan, np.ndarray]] = []
    owner: list[int] = []
    try:
        for k, data in enumerate(streams):
            at = 0
            while at == 0 or data[at : at + 2] == b"\xff\xd8":
                scan = Scan(data, at)
                scans.append((scan, np.frombuffer(data, np.uint8, scan.end - scan.begin, scan.begin)))
                owner.append(k)
                at = scan.after
        groups: dict[tuple, list[int]] = {}
        for k, (s, _) in enumerate(scans):
            groups.setdefault((s.layout, s.interval), []).append(k)
        samples: dict[int, np.ndarray] = {}
        for own in groups.values():
            samples |= dict(zip(own, thumbnails([scans[k] for k in own]), strict=True))
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("a broken stream") from e
    out: list[list] = [[0, 0, []] for _ in streams]
    for k, (s, _) in enumerate(scans):
        o = out[owner[k]]
        o[0], o[1] = s.width, o[1] + s.height
        o[2].append(samples[k])
    return [(w, h, x[0] if len(x) == 1 else np.concatenate(x)) for w, h, x in out]


def features(samples: np.ndarray, rows: np.ndarray) -> list[str]:
    """Of each thumbnail: dimensions, and a difference hash of its means over 8 by 9 fields."""
    n = len(rows)
    first = np.concatenate([[0], np.cumsum(rows)])
    columns = np.add.reduceat(samples.reshape(-1, WIDTH).astype(np.int64), np.arange(9) * WIDTH // 9, axis=1)  # sums over 9 strips
    total = np.concatenate([np.zeros((1, 9), np.int64), np.cumsum(columns, axis=0)])
    k = np.arange(8)
    low = first[:-1, None] + k * rows[:, None] // 8
    high = np.maximum(first[:-1, None] + (k + 1) * rows[:, None] // 8, low + 1)
    sums = total[high] - total[low]
    wide = np.diff(np.append(np.arange(9) * WIDTH // 9, WIDTH))
    bits = sums[:, :, 1:] * wide[:-1] > sums[:, :, :-1] * wide[1:]  # means of the same rows, compared without division
    hashes = np.packbits(bits.reshape(n, 64), axis=1)
    return [f"{8 * WIDTH}x{8 * r}:{bytes(h).hex()}" for r, h in zip(rows.tolist(), hashes, strict=True)]


def feature(width: int, height: int, samples: np.ndarray) -> str:
    """The same of one thumbnail of any width."""
    grid = samples.reshape(-1, -(-width // 8)).astype(np.int64)
    total = np.pad(grid.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    edges = []
    for n, fields in zip(grid.shape, (8, 9), strict=True):
        low = np.arange(fields) * n // fields
        edges.append((low, np.maximum((np.arange(fields) + 1) * n // fields, low + 1)))
    (top, bottom), (left, right) = edges
    sums = total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]
    wide = right - left
    bits = sums[:, 1:] * wide[:-1] > sums[:, :-1] * wide[1:]
    return f"{width}x{height}:{np.packbits(bits.ravel()).tobytes().hex()}"


def media(texts: pa.Array) -> dict[str, list]:
    """Store the texts of a slice, read the stored bytes back, and describe both."""
    data, at = c.string_bytes(texts)
    size = np.diff(at)
    rows = np.maximum(1, -(-size // WIDTH))
    begin = np.concatenate([[0], np.cumsum(rows)]) * WIDTH
    payload = np.zeros(int(begin[-1]), np.uint8)
    payload[c.runs(begin[:-1], size)] = data
    streams = write(payload, rows)
    back = read(streams)
    stored = np.concatenate([x for _, _, x in back])
    raw, ends = stored.tobytes(), begin.tolist()
    if any(len(x) != b - a for (_, _, x), a, b in zip(back, ends, ends[1:], strict=False)):
        raise ValueError("a stored image has other dimensions than its payload")
    own = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return {
        "n_bytes": size,
        "payload_bytes": np.diff(begin),
        "payload_sha256": [hashlib.sha256(x).hexdigest() for x in own],
        "tail_crc32": [zlib.crc32(x[-64:]) for x in own],
        "media_bytes": [len(x) for x in streams],
        "media_sha256": [hashlib.sha256(x).hexdigest() for x in streams],
        "feature": features(stored, rows),
        "width": [w for w, _, _ in back],
        "height": [h for _, h, _ in back],
    }


def query(df: DataFrame, slice_bytes: int = 1 << 20) -> DataFrame:
    """Every document's payload stored as JPEG and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, limit=slice_bytes):
                yield c.named(SCHEMA, doc_id=c.column(part, "doc_id"), **media(c.column(part, "text")))

    return c.documents(df).mapInArrow(run, DDL)


def images(df: DataFrame, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and the stored stream itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, limit=slice_bytes):
                data, at = c.string_bytes(c.column(part, "text"))
                rows = np.maximum(1, -(-np.diff(at) // WIDTH))
                begin = np.concatenate([[0], np.cumsum(rows)]) * WIDTH
                payload = np.zeros(int(begin[-1]), np.uint8)
                payload[c.runs(begin[:-1], np.diff(at))] = data
                yield pa.RecordBatch.from_arrays([c.column(part, "doc_id"), c.binary(write(payload, rows))], ["doc_id", "media"])

    return c.documents(df).mapInArrow(run, "doc_id long, media binary")


THUMBNAILS = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("height", pa.int64()), ("thumbnail", pa.binary()), ("feature", pa.string())])


def described(df: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, width, height, thumbnail (its luminance samples) and feature of stored images of any baseline encoder; null where there
    is no stream or one that can't be read."""

    def one(data: bytes | None) -> tuple[int, int, np.ndarray] | None:
        try:
            return None if data is None else read([data])[0]
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = c.column(batch, "media").to_pylist()
            try:
                found = read(streams) if None not in streams else list(map(one, streams))
            except ValueError:
                found = list(map(one, streams))
            rows = [(None,) * 4 if x is None else (x[0], x[1], x[2].tobytes(), feature(*x)) for x in found]
            yield c.named(THUMBNAILS, doc_id=c.column(batch, "doc_id"), **{name: [x[k] for x in rows] for k, name in enumerate(THUMBNAILS.names[1:])})

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("media")).mapInArrow(c.lean(run), "doc_id long, width int, height long, thumbnail binary, feature string")
