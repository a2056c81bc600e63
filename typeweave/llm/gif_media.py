"""Operator 3: GIF media columns.

Writing lays bytes as 8-bit palette indices into the frames of an animated GIF (LZW code
streams, a grey palette of 256 entries). Reading is general: it decodes the LZW streams of
any GIF87a or GIF89a file, applies global and local palettes, interlacing, transparency and
disposal, and gives timed frames with their colours counted in bins.

Cases: a null or empty text is stored as one block of 64 zero bytes; equal texts give equal
files and features; an empty table gives an empty result; other columns are not read. A file
that is no GIF, or one cut short, raises ValueError in the reader, or gives a null result
where the reader is told to skip errors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.common import slices

WIDTH = 64
#: Rows of a frame at most; longer payloads take more frames.
FRAME_ROWS = 4096
DELAY_CS = 4
#: Fixed values of the format: codes of at most 12 bits, end and clear codes behind the palette.
MAX_CODES = 4096
TRAILER, EXTENSION, IMAGE = 0x3B, 0x21, 0x2C


# writing


def _pack_codes(codes: list[int], bits: int) -> bytes:
    """Variable-width codes as bytes, low bits first; widths follow from the place after a clear."""
    clear = 1 << bits
    all_codes = np.asarray(codes, np.int64)
    cleared = np.flatnonzero(all_codes == clear)
    since = np.arange(len(all_codes)) - cleared[np.searchsorted(cleared, np.arange(len(all_codes)), "right") - 1]
    widths = _widths(bits)[np.minimum(since, MAX_CODES)]
    widths[cleared[1:]] = _widths(bits)[np.minimum(np.diff(cleared), MAX_CODES)]
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 4, np.uint8)
    shifted = all_codes << (starts & 7)
    for k in range(3):
        np.add.at(out, (starts >> 3) + k, ((shifted >> (8 * k)) & 0xFF).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


_WIDTH_TABLES: dict[int, np.ndarray] = {}


def _widths(bits: int) -> np.ndarray:
    """Width of the code k places behind a clear code; the clear code before all has place 0."""
    if bits not in _WIDTH_TABLES:
        # the code at place k is written when the table has clear + 2 + max(0, k - 2) entries and gets one more
        entries = (1 << bits) + 2 + np.maximum(np.arange(MAX_CODES + 1) - 1, 0)
        _WIDTH_TABLES[bits] = np.clip(np.ceil(np.log2(entries)), bits + 1, 12).astype(np.int64)
    return _WIDTH_TABLES[bits]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """One LZW code stream of values under 2**bits."""
    clear, stop = 1 << bits, (1 << bits) + 1
    codes, table, following = [clear], {}, stop + 1
    get, append = table.get, codes.append
    if data:
        prefix = data[0]
        for value in data[1:]:
            key = prefix << 8 | value
            code = get(key)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            prefix = value
            if following < MAX_CODES:
                table[key] = following
                following += 1
            else:
                append(clear)
                table.clear()
                following = stop + 1
        append(prefix)
    append(stop)
    return _pack_codes(codes, bits)


def _blocks(data: bytes) -> bytes:
    parts = []
    for at in range(0, len(data), 255):
        part = data[at : at + 255]
        parts += [bytes([len(part)]), part]
    return b"".join(parts) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def write_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """payload, whole rows of width bytes, as grey samples of an animated GIF."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    height = min(frame_rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY]
    for at in range(0, len(payload), width * frame_rows):
        part = payload[at : at + width * frame_rows]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay_cs, 0, 0)]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


# reading


def _read_codes(data: np.ndarray, bit: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes from a bit on as if no clear code came, and the bit behind each."""
    table = _widths(bits)
    places = np.arange(1, most + 1)
    widths = table[np.minimum(places, MAX_CODES)]
    ends = bit + np.cumsum(widths)
    ends = ends[ends <= 8 * (len(data) - 4)]
    starts = ends - widths[: len(ends)]
    at = starts >> 3
    word = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8 | data[at + 2].astype(np.int64) << 16
    return word >> (starts & 7) & (1 << widths[: len(ends)]) - 1, ends


def lzw_decode(data: bytes, bits: int, n: int) -> bytes:
    """The first n values of a code stream; ValueError where it ends before."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + bytes(4), np.uint8)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, size, bit, ended = [], 0, 0, False
    table, old = list(roots), b""
    place = 0  # codes since the last clear
    # a stream should begin with a clear code; one that doesn't is read as if it did
    first, ends = _read_codes(raw, 0, bits, 1)
    if len(first) and first[0] == clear:
        bit = int(ends[0])
    while size < n and not ended:
        codes, ends = _read_codes(raw, bit, bits, MAX_CODES)
        if place:  # the table is full: 12 bits until the next clear
            starts = bit + 12 * np.arange(MAX_CODES)
            starts = starts[starts + 12 <= 8 * (len(raw) - 4)]
            at = starts >> 3
            codes = (raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8 | raw[at + 2].astype(np.int64) << 16) >> (starts & 7) & 4095
            ends = starts + 12
        if not len(codes):
            break
        special = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(special[0]) if len(special) else len(codes)
        for code in codes[:upto].tolist():
            if code < len(table):
                entry = table[code]
                if old and len(table) < MAX_CODES:
                    table.append(old + entry[:1])
            elif code == len(table) and old:
                entry = old + old[:1]
                table.append(entry)
            else:
                raise ValueError("an LZW code stands before its entry")
            out.append(entry)
            size += len(entry)
            old = entry
        if upto < len(codes):
            ended = bool(codes[upto] == stop)
            bit, place = int(ends[upto]), 0
            table, old = list(roots), b""
        else:
            bit, place = int(ends[-1]), place + upto
    if size < n:
        raise ValueError("an LZW stream ends early")
    return b"".join(out)[:n]


@dataclass
class Frame:
    """One composed picture of an animation."""

    number: int
    start_cs: int
    delay_cs: int
    box: tuple[int, int, int, int]  # left, top, width, height of what this frame drew
    canvas: np.ndarray  # height x width x 4, RGBA


def _interlaced_rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def read_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as shown, in order; the canvas may be changed by the next one."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, transparent, number, clock = 0, 0, None, 0, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while True:
        kind = data[at]
        at += 1
        if kind == TRAILER:
            return
        if kind == EXTENSION:
            label = data[at]
            body, at = blocks(at + 1)
            if label == 0xF9:
                packed, delay = struct.unpack_from("<BH", body)
                disposal, transparent = packed >> 2 & 7, body[3] if packed & 1 else None
            continue
        if kind != IMAGE:
            raise ValueError("an unknown block in a GIF")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("a GIF frame without palette")
        bits = data[at]
        body, at = blocks(at + 1)
        samples = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            drawn = np.empty_like(samples)
            drawn[_interlaced_rows(h)] = samples
            samples = drawn
        rows, columns = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        area = canvas[rows, columns]
        samples = samples[: area.shape[0], : area.shape[1]]
        before = area.copy() if disposal == 3 else None
        shown = np.concatenate([palette[np.minimum(samples, len(palette) - 1)], np.full((*samples.shape, 1), 255, np.uint8)], axis=2)
        if transparent is None:
            area[:] = shown
        else:
            mask = samples != transparent
            area[mask] = shown[mask]
        yield Frame(number, clock, delay, (left, top, w, h), canvas)
        number, clock = number + 1, clock + delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            area[:] = before
        disposal, delay, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray, levels: int = 4) -> np.ndarray:
    """Counts of the visible pixels in levels**3 bins of red, green and blue."""
    seen = canvas[canvas[..., 3] > 0].astype(np.int64)
    step = 256 // levels
    bins = (seen[:, 0] // step * levels + seen[:, 1] // step) * levels + seen[:, 2] // step
    return np.bincount(bins, minlength=levels**3)


# operators


def padded(text: str | None) -> tuple[int, bytes]:
    """The length of a text in UTF-8, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each text as a GIF."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            made = [padded(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_gif(p) for _, p in made], pa.binary())], ["id", "n_bytes", "media"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")


def frames(df: DataFrame, id_col: str = "id", media_col: str = "media", skip_errors: bool = False) -> DataFrame:
    """Timed frames of GIF files: (id, frame, start_cs, delay_cs, width, height, colours).

    colours counts visible pixels in 64 bins. A null file has no frames.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "frame", "start_cs", "delay_cs", "width", "height", "colours"]

    def run(batches):
        for part in slices(batches, 16):
            for row, media in enumerate(part.column(1).to_pylist()):
                found = []
                try:
                    for x in read_gif(media) if media is not None else ():
                        found.append((x.number, x.start_cs, x.delay_cs, x.canvas.shape[1], x.canvas.shape[0], colour_histogram(x.canvas).tolist()))
                except ValueError:
                    if not skip_errors:
                        raise
                    found = []
                if found:
                    keys = part.column(0).take(pa.array([row] * len(found), pa.int32()))
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names)

    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, frame int, start_cs int, delay_cs int, width int, height int, colours array<bigint>")


def read_payload(media: bytes) -> tuple[bytes, str]:
    """The grey samples of all frames in order, and the grey levels counted in 16 bins."""
    parts, counts = [], np.zeros(16, np.int64)
    for frame in read_gif(media):
        left, top, w, h = frame.box
        drawn = frame.canvas[top : top + h, left : left + w]
        parts.append(np.ascontiguousarray(drawn[..., 0]).tobytes())
        counts += np.bincount(drawn[..., 0].ravel() >> 4, minlength=16)
    return b"".join(parts), f"frames={len(parts)};grey16=" + ",".join(map(str, counts.tolist()))


def digests(stored: DataFrame) -> DataFrame:
    """What the stored files give when they are read back: digests and features."""
    kind = stored.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for part in slices(batches):
            rows = []
            for media in part.column(2).to_pylist():
                payload, feature = read_payload(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return stored.select("id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a GIF and read back."""
    return digests(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op3_gif_media": query}
