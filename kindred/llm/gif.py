"""GIF: LZW code streams, palettes, disposal and transparency, timed frames.

``decode`` reads any GIF87a or GIF89a: global and local palettes, interlacing,
clear codes wherever they stand, tables that are full, the four disposal methods
and transparent colours. Each frame comes with its rectangle, its delay and the
canvas as a viewer would show it. ``encode`` writes frames losslessly with a
256-colour palette. ``frame_table`` stores the timed frames of a column of GIFs with
colour histograms; null and malformed media, and canvases or frames of over ``MOST_PIXELS``
(a header of a few bytes can claim 4 thousand million), give no rows there and are listed by
``media_errors``.

``store_texts`` keeps texts as 8-bit samples: the UTF-8 bytes, padded with spaces to a
positive multiple of 192, are rows of 192 grey pixels in frames of at most 512 rows;
a longer text has more frames, 40 ms apart. Null counts as empty, which is one row of
spaces. Memory is bounded by the longest single text, about ten times its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, id_and_text

WIDTH, FRAME_ROWS, FULL = 192, 512, 4096
MOST_PIXELS = 1 << 26  # 256 MiB of RGBA
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    canvas: np.ndarray  # height x width x RGBA, as shown while the frame lasts


# -- LZW -----------------------------------------------------------------------
@functools.cache
def _bit_starts(first: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and where each begins, in bits. The
    reader's table lags a code behind, so only their number decides the width."""
    known = first + 2 + np.maximum(np.arange(3 * FULL) - 1, 0)
    widths = np.minimum(12, np.maximum(int(first).bit_length(), np.ceil(np.log2(known + 1)).astype(np.int64)))
    return widths, np.concatenate([[0], np.cumsum(widths)])


_SLOTS: list[int] = []


def lzw_codes(data: bytes, first: int = 256) -> list[np.ndarray]:
    """Codes between clear codes. ``first`` is the clear code; first + 1 ends the stream."""
    if not data:
        return [np.empty(0, np.uint16)]
    if not _SLOTS:
        _SLOTS.extend([0] * (FULL << 8))  # by string and next byte: the longer string's code
    slots, out, codes, keys, free = _SLOTS, [], [], [], (first + 2) << 8
    symbols = iter(data)
    held = next(symbols) << 8  # codes are kept shifted by a byte, ready to be keys
    for c in symbols:
        key = held | c
        if code := slots[key]:
            held = code
            continue
        codes.append(held)
        held = c << 8
        slots[key] = free
        keys.append(key)
        free += 256
        if free == FULL << 8:
            out.append(codes)
            for key in keys:
                slots[key] = 0
            codes, keys, free = [], [], (first + 2) << 8
    codes.append(held)
    out.append(codes)
    for key in keys:
        slots[key] = 0
    return [(np.array(part, np.int64) >> 8).astype(np.uint16) for part in out]


def lzw_pack(parts: list[np.ndarray], first: int = 256) -> bytes:
    widths, _ = _bit_starts(first)
    codes, sizes = [np.array([first], np.uint16)], [widths[:1]]
    for k, part in enumerate(parts):
        codes += [part, np.array([first if k + 1 < len(parts) else first + 1], np.uint16)]
        sizes.append(widths[: len(part) + 1])
    code, size = np.concatenate(codes), np.concatenate(sizes).astype(np.uint8)
    bits = np.unpackbits(code.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12, dtype=np.uint8) < size[:, None]], bitorder="little").tobytes()


def lzw_unpack(stream: bytes, first: int = 256) -> bytes:
    """The symbols of a code stream; stops at the end code or where the stream ends."""
    widths, starts = _bit_starts(first)
    late = 12 * np.arange(len(widths) + 1)  # a block later on in a run: the table is full
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    ready = [bytes([i]) for i in range(first)] + [b"", b""]
    out: list[bytes] = []
    bit, end, table, before = 0, 8 * len(stream), ready.copy(), b""
    size, begin = widths, starts
    while bit < end:
        n = min(len(widths), int(np.searchsorted(begin, end - bit, "right")) - 1)
        if n <= 0:
            break
        at = bit + begin[:n]
        byte = at >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << size[:n]) - 1)
        stops = np.flatnonzero((codes == first) | (codes == first + 1))
        stop = int(stops[0]) if len(stops) else n
        if stop:
            run = codes[:stop].tolist()
            if not before:
                before = table[run[0]]
                out.append(before)
                run = run[1:]
            for code in run:
                entry = table[code] if code < len(table) else before + before[:1]
                if len(table) < FULL:
                    table.append(before + entry[:1])
                out.append(entry)
                before = entry
        if not len(stops):
            if n < len(widths):
                break
            bit, size, begin = bit + int(begin[n]), np.full(len(widths), 12), late
            continue
        if codes[stop] == first + 1:
            break
        bit += int(begin[stop + 1])
        table, before, size, begin = ready.copy(), b"", widths, starts
    return b"".join(out)


# -- the container --------------------------------------------------------------
def encode(frames: list[np.ndarray], delay_ms: int = 40, palette: np.ndarray = GREY) -> bytes:
    """Frames (2-d uint8 indices, of one width) as a looping GIF89a."""
    width, height = frames[0].shape[1], max(f.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), np.asarray(palette, np.uint8).tobytes()]
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_ms // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, f.shape[0], 0) + b"\x08")
        packed = lzw_pack(lzw_codes(f.tobytes()))
        for k in range(0, len(packed), 255):
            part = packed[k : k + 255]
            out += [bytes([len(part)]), part]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """Frames in order. Raises ValueError for what is not a GIF or is cut off."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        if width * height > MOST_PIXELS:
            raise ValueError("too large")
        canvas = np.zeros((height, width, 4), np.uint8)
        delay, disposal, clear = 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9:
                    packed, ticks, index = struct.unpack("<BHB", body[:4])
                    delay, disposal, clear = 10 * ticks, packed >> 2 & 7, index if packed & 1 else None
                continue
            if data[at] != 0x2C:
                raise ValueError("unknown block")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            if w * h > MOST_PIXELS:
                raise ValueError("too large")
            at, palette = at + 10, shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            first = 1 << data[at]
            stream, at = _blocks(data, at + 1)
            symbols = lzw_unpack(stream, first)
            if palette is None or len(symbols) < w * h:
                raise ValueError("no palette" if palette is None else "the code stream is too short")
            indices = np.frombuffer(symbols, np.uint8, w * h).reshape(h, w)
            if flags & 0x40:  # four passes of rows
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(indices)
                straight[rows] = indices
                indices = straight
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            seen = indices[: part.shape[0], : part.shape[1]]
            colour = np.full((*seen.shape, 4), 255, np.uint8)
            colour[..., :3] = palette[np.minimum(seen, len(palette) - 1)]
            if clear is None:
                part[:] = colour
            else:
                part[seen != clear] = colour[seen != clear]
            yield Frame(left, top, w, h, delay, disposal, clear, indices, canvas.copy())
            if disposal == 2:
                canvas[top : top + h, left : left + w] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
    except (IndexError, struct.error) as error:
        raise ValueError("cut off") from error


def histogram(rgba: np.ndarray, bins: int = 8) -> np.ndarray:
    """Counts by channel and level, 3 x bins, of the pixels that are not clear."""
    flat = rgba.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    return np.stack([np.bincount(flat[:, k] // (256 // bins), minlength=bins) for k in range(3)])


# -- columns ----------------------------------------------------------------------
FRAMES = "media_id bigint, frame int, start_ms bigint, delay_ms int, width int, height int, disposal int, red array<bigint>, green array<bigint>, blue array<bigint>, rgba binary"


def unreadable(media: bytes | None) -> str | None:
    """Why ``decode`` can't read a medium to its end; None if it can."""
    try:
        return "null" if media is None else (sum(1 for _ in decode(media)), None)[1]
    except ValueError as error:
        return str(error)


def frame_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row a frame: when it starts, how long it lasts, its pixels and histograms."""
    bounded_batches(df.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("red", "green", "blue")), ("rgba", pa.binary())])
        for batch in batches:
            for key, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unreadable(media):  # read to its end first, so that a cut-off one gives no frame
                    continue
                start = 0
                for k, f in enumerate(decode(media)):
                    bins = histogram(f.canvas).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([key, k, start, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.disposal, *bins, f.canvas.tobytes()], schema.types, strict=True)], schema=schema)
                    start += f.delay_ms

    return df.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media")).mapInArrow(explode, FRAMES)


def media_errors(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """media_id and error of the media that ``decode`` can't read to the end; null media are ``null``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unreadable(m) for m in batch.column(1).to_pylist()], pa.string())], ["media_id", "error"])

    return df.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media")).mapInArrow(explode, "media_id bigint, error string").filter("error is not null")


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def text_to_gif(raw: bytes) -> bytes:
    pixels = np.frombuffer(payload_of(raw), np.uint8).reshape(-1, WIDTH)
    return encode([pixels[k : k + FRAME_ROWS] for k in range(0, len(pixels), FRAME_ROWS)])


def gif_to_payload(media: bytes) -> tuple[bytes, int, int, np.ndarray]:
    """The stored bytes, read off the red channel; frames, their time and their histogram."""
    parts, frames, ms, bins = [], 0, 0, np.zeros((3, 8), np.int64)
    for f in decode(media):
        shown = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        parts.append(shown[..., 0].tobytes())
        frames, ms, bins = frames + 1, ms + f.delay_ms, bins + histogram(shown)
    return b"".join(parts), frames, ms, bins


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as a GIF, reads the GIF back and describes what was read. With
    ``keep_media`` the GIF itself is a column."""
    bounded_batches(df.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames int" + ", media binary" * keep_media

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("text").to_pylist():
                media = text_to_gif(raw or b"")
                payload, frames, ms, bins = gif_to_payload(media)
                share = np.round(1000 * bins / len(payload)).astype(int)
                feature = f"frames={frames};ms={ms};" + ";".join(f"{c}={','.join(map(str, b))}" for c, b in zip("rgb", share.tolist(), strict=True))
                row = [len(raw or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames]
                rows.append(row + [media] * keep_media)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()] + [pa.binary()] * keep_media
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"] + ["media"] * keep_media
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names)

    return id_and_text(df, id_col, text_col, binary=True).mapInArrow(store, schema)
