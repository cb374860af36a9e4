"""Media columns: animated GIF.

``encode_gif`` stores bytes as the palette indices of an animation 64 pixels wide; ``decode_gif``
reads any GIF: it decodes the LZW code streams of the frames, applies palettes, interlacing,
disposal and transparency, and gives the timed frames as shown.

A damaged file raises ValueError, and TooLarge if its canvas or a frame has more pixels than the
parameter ``most_pixels`` allows, as a header of few bytes can ask for gigabytes; None allows all.
Tables of media tell either in a column ``error``.

LZW code widths follow from how many codes came since the last clear code, so both directions pack
and unpack the codes of such a segment at once with NumPy; only the dictionary is a Python loop.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.session import ship, stash

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
MOST_CODES = 4096
#: Grey levels: the index is the colour.
GREYS = bytes(v for k in range(256) for v in (k, k, k))
BINS = 8
#: The largest canvas and the largest frame that are decoded by default.
MOST_PIXELS = 1 << 24


class TooLarge(ValueError):
    """A canvas or frame beyond ``most_pixels``."""


@dataclass
class Frame:
    """A frame as shown: canvas (rows x columns x RGBA), the stored indices, and its time."""

    canvas: np.ndarray
    indices: np.ndarray
    start_cs: int
    delay_cs: int


def _widths(n: int, bits: int) -> np.ndarray:
    """Code widths of the first n codes after a clear code, at a least code size of so many bits.

    The k-th code after the clear (from 0) is read when the table has 2**bits + 2 + max(k - 1, 0)
    entries and the decoder is about to add one, so it is as wide as that number of entries needs.
    """
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    entries[1:] += 1
    # a code is widened once the table is full at its width
    return np.minimum(np.floor(np.log2(np.maximum(entries - 1, 1))).astype(np.int64) + 1, 12).clip(bits + 1)


_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the longest segment: as many codes as fill the table, and as many more at 12 bits."""
    if bits not in _WIDTHS:
        w = _widths(MOST_CODES, bits)
        _WIDTHS[bits] = w, np.concatenate(([0], np.cumsum(w)))
    return _WIDTHS[bits]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of indices, least significant bit first. It starts with a clear code; full tables are cleared."""
    clear, stop = 1 << bits, (1 << bits) + 1
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    put, free = codes.append, stop + 1
    if data:
        stream = iter(data)
        prefix = next(stream)
        for c in stream:
            key = prefix << 8 | c
            if key in table:
                prefix = table[key]
                continue
            put(prefix)
            prefix = c
            if free < MOST_CODES:
                table[key] = free
                free += 1
            else:
                segments.append(codes)
                codes = []
                put, free = codes.append, stop + 1
                table.clear()
        put(prefix)
    segments.append(codes)
    widths, _ = _layout(bits)
    values, sizes = [np.array([clear])], [np.array([bits + 1])]
    for k, codes in enumerate(segments):
        closing = clear if k + 1 < len(segments) else stop
        values.append(np.array([*codes, closing], np.int64))
        sizes.append(widths[: len(codes) + 1])
    return _pack(np.concatenate(values), np.concatenate(sizes))


def _pack(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of the given widths as bytes, least significant bit first."""
    at = np.cumsum(sizes) - sizes
    total = int(at[-1] + sizes[-1])
    out = np.zeros(total + 16, np.uint8)
    for k in range(12):
        chosen = k < sizes
        out[at[chosen] + k] = values[chosen] >> k & 1
    return np.packbits(out[: (total + 7) // 8 * 8], bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The indices of an LZW code stream, at most so many. Ends at the stop code or where the data end; ValueError on a bad code."""
    clear, stop = 1 << bits, (1 << bits) + 1
    widths, offsets = _layout(bits)
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits = len(data) * 8
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = at = 0
    while made < most and at + bits + 1 <= n_bits:
        n = int(np.searchsorted(offsets, n_bits - at, side="right")) - 1
        where = at + offsets[: min(n, MOST_CODES)]
        first = where >> 3
        codes = (raw[first] | raw[first + 1] << 8 | raw[first + 2] << 16) >> (where & 7) & ((1 << widths[: len(where)]) - 1)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(ends[0]) if len(ends) else len(codes)
        own = codes[:end].tolist()
        if not len(ends) and end == MOST_CODES:  # a table that stays full: go on at 12 bits
            tail, where = [], at + int(offsets[end])
            while where + 12 <= n_bits:
                k = where >> 3
                code = int(raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (where & 7) & 4095
                where += 12
                if code in (clear, stop):
                    break
                tail.append(code)
            else:
                code = stop
            own += tail
            at, last = where, code == stop
        else:
            at += int(offsets[min(end + 1, len(offsets) - 1)])
            last = not len(ends) or codes[end] == stop
        if own:
            table = base.copy()
            add = table.append
            try:
                previous = table[own[0]]
                parts, size = [previous], len(table)
                put = parts.append
                for code in own[1 : MOST_CODES - stop]:
                    if code < size:
                        entry = table[code]
                    elif code == size:
                        entry = previous + previous[:1]
                    else:
                        raise ValueError("bad LZW code")
                    add(previous + entry[:1])
                    size += 1
                    put(entry)
                    previous = entry
                parts += [table[code] for code in own[MOST_CODES - stop :]]
            except IndexError:
                raise ValueError("bad LZW code") from None
            block = b"".join(parts)
            out.append(block)
            made += len(block)
        if last:
            break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes and an empty one."""
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Bytes as a GIF89a animation. Their number is a positive multiple of the width; a frame takes up to ``frame_rows`` rows of them."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GREYS, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, rows, frame_rows):
        part = payload[top * width : (top + frame_rows) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes, most_pixels: int | None = MOST_PIXELS) -> Iterator[Frame]:
    """The frames of a GIF one by one, as shown: each on what the ones before have left of the canvas. ValueError where the file is damaged, TooLarge beyond ``most_pixels``."""
    try:
        yield from _frames(data, most_pixels)
    except (struct.error, IndexError) as error:
        raise ValueError("damaged GIF") from error


def _opaque(colours: np.ndarray) -> np.ndarray:
    """A palette of 256 opaque colours; what the file leaves out is black."""
    out = np.zeros((256, 4), np.uint8)
    out[: len(colours) // 3, :3] = colours.reshape(-1, 3)
    out[:, 3] = 255
    return out


def _frames(data: bytes, most_pixels: int | None) -> Iterator[Frame]:
    if data[:3] != b"GIF" or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if most_pixels is not None and width * height > most_pixels:
        raise TooLarge("the canvas is too large")
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise ValueError("damaged GIF")
        found = _opaque(np.frombuffer(data, np.uint8, 3 * n, at))
        at += 3 * n
        return found

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = palette(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    clock = delay = disposal = 0
    transparent: int | None = None
    while at < len(data) and (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear_index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, clear_index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("damaged GIF")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        own = palette(packed)
        colours = own if own is not None else common if common is not None else _opaque(np.frombuffer(GREYS, np.uint8))
        bits = data[at]
        at += 1
        if not 1 <= bits <= 8:
            raise ValueError("bad code size")
        if most_pixels is not None and w * h > most_pixels:
            raise TooLarge("a frame is too large")
        stored = lzw_decode(blocks(), bits, w * h)
        flat = np.zeros(w * h, np.uint8)
        flat[: len(stored)] = np.frombuffer(stored, np.uint8)
        seen = np.zeros(w * h, bool)
        seen[: len(stored)] = True
        indices, seen = flat.reshape(h, w), seen.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            mixed, seen_mixed = np.empty_like(indices), np.empty_like(seen)
            mixed[order], seen_mixed[order] = indices, seen
            indices, seen = mixed, seen_mixed
        before = canvas.copy() if disposal == 3 else None
        shown_h, shown_w = min(h, max(0, height - top)), min(w, max(0, width - left))
        area = canvas[top : top + shown_h, left : left + shown_w]
        shown = indices[:shown_h, :shown_w]
        if transparent is None and len(stored) == w * h:
            area[:] = colours[shown]
        else:
            drawn = seen[:shown_h, :shown_w] & (transparent is None or shown != transparent)
            area[drawn] = colours[shown[drawn]]
        yield Frame(canvas.copy(), indices, clock, delay)
        clock += delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length of a text, and its bytes filled up with zeros to a positive multiple of the width."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """How many visible pixels fall into each of the bins of red, green and blue."""
    flat = canvas.reshape(-1, 4)
    shown = flat if flat[:, 3].all() else flat[flat[:, 3] > 0]
    return np.stack([np.bincount(shown[:, c], minlength=256).reshape(BINS, -1).sum(1) for c in range(3)])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): every whole text, of any length, stored as a GIF. A null text counts as empty; other columns are ignored, whatever their names."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                stored = [(n, encode_gif(payload)) for n, payload in map(payload_of, rows.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([n for n, _ in stored], pa.int64()), pa.array([m for _, m in stored], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: A timed frame with its colour histograms.
FRAME = "start_cs: int, delay_cs: int, width: int, height: int, red: array<long>, green: array<long>, blue: array<long>"
FRAME_COLUMNS = [x.split(":")[0] for x in FRAME.split(", ")]


def _described(f: Frame) -> tuple:
    """What FRAME names of a frame."""
    return f.start_cs, f.delay_cs, f.canvas.shape[1], f.canvas.shape[0], *histogram(f.canvas).tolist()


def error_of(data: bytes | None, error: ValueError) -> str:
    """What a table of media says of media that is not decoded whole."""
    return "missing" if data is None else "too large" if isinstance(error, TooLarge) else "damaged"


def media_frames(media: DataFrame, with_pixels: bool = False, most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """A row for each timed frame: doc_id, frame, start_cs, delay_cs, width, height, red, green, blue (histograms), error and, where asked for, rgba (binary).

    Media that is null, damaged or too large gives the frames before that, and a row with ``missing``,
    ``damaged`` or ``too large`` as its error, whose other columns are null. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pa.list_(pa.int64())
        kinds = [pa.int32()] * 5 + [counts] * 3 + [pa.string()] + [pa.binary()] * with_pixels
        names = ["frame", *FRAME_COLUMNS, "error", *["rgba"] * with_pixels]
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for k, f in enumerate(decode_gif(data or b"", most_pixels)):
                        values = [k, *_described(f), None, *[f.canvas.tobytes()] * with_pixels]
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.array([v], kind) for v, kind in zip(values, kinds, strict=True))], names=["doc_id", *names])
                except ValueError as error:
                    told = {"error": error_of(data, error)}
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.array([told.get(c)], kind) for c, kind in zip(names, kinds, strict=True))], names=["doc_id", *names])

    schema = "doc_id long, frame int, " + FRAME.replace(":", "") + ", error string" + ", rgba binary" * with_pixels
    return media.select("doc_id", "media").mapInArrow(run, schema)


def media_digests(media: DataFrame, most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """What is read back of stored texts: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, frames, error.

    frames holds every timed frame with its colour histograms. feature tells how many there are, the
    time they take, their size and the histogram of shown grey levels over all frames. Equal texts
    have equal values. Media that is null, damaged or too large has null for what would come from it,
    and says so in error. Media of any length is decoded frame by frame. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    ship(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "error"]

    def read(data: bytes | None) -> tuple:
        if data is None:
            return (*(None,) * 7, "missing")
        stored = len(data), hashlib.sha256(data).hexdigest()
        digest, size, tail, levels, frames, shape = hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), [], (0, 0)
        try:
            for f in decode_gif(data, most_pixels):
                part = f.indices.tobytes()
                digest.update(part)
                size += len(part)
                tail = (tail + part)[-WIDTH:]
                shown = f.canvas[: len(f.indices), :, 0]  # grey: red is the level
                levels += np.bincount(shown.ravel(), minlength=256).reshape(BINS, -1).sum(1)
                frames.append(_described(f))
                shape = f.canvas.shape
        except ValueError as error:
            return (None, None, None, *stored, None, None, error_of(data, error))
        time_cs = sum(frames[-1][:2]) if frames else 0
        feature = f"frames={len(frames)};cs={time_cs};size={shape[1]}x{shape[0]};levels={','.join(map(str, levels.tolist()))}"
        return size, digest.hexdigest(), zlib.crc32(tail), *stored, feature, [dict(zip(FRAME_COLUMNS, f, strict=True)) for f in frames], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pa.list_(pa.int64())
        frame = pa.struct([(c, counts if c in ("red", "green", "blue") else pa.int32()) for c in FRAME_COLUMNS])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(frame), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = [(doc_id, n_bytes, *read(data)) for doc_id, n_bytes, data in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<{FRAME}>>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read the stored table and decode it: media_digests of all documents."""
    return media_digests(stash(text_media(docs), "media"))
