"""GIF: LZW code streams, palettes, disposal and transparency, timed frames with colour-histogram columns.

``decode`` reads any GIF87a or GIF89a into composed frames; ``encode_samples`` stores 8-bit samples losslessly as the
palette indices of a GIF. Code streams are unpacked in numpy: between two clear codes the width of each code depends
only on its position, so a whole table's codes are read at once, and their strings are followed back all at once.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import struct_of, table

WIDTH = 192
#: Rows of a frame; longer payloads go on in further frames.
ROWS = 4096
DELAY = 10
_FULL = 4096
#: Samples that the frames of one file may have when composed, four bytes each.
MAX_SAMPLES = 1 << 27


@functools.lru_cache(16)
def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of each code after a clear, and the bit it starts at, up to the full table."""
    # The decoder adds an entry with every code but the first and widens once the next entry needs it.
    entries = (1 << bits) + 2 + np.maximum(0, np.arange(_FULL - (1 << bits)) - 1)
    width = np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1))
    return width, np.concatenate(([0], np.cumsum(width)))


def _codes_at(raw: np.ndarray, start: int, offsets: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The codes whose bits begin at ``start + offsets``; ``raw`` has four bytes of padding."""
    at = start + offsets
    byte = at >> 3
    word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
    return (word >> (at & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)


def _strings(codes: np.ndarray, own: int, clear: int, limit: int) -> tuple[bool, bytes]:
    """Samples of codes that follow a clear, of which the first ``own`` make entries, and whether all can be explained:
    what comes after one that cannot, or after ``limit`` samples, is left out.

    Entry k is the string of code k and the first sample of code k + 1. So a code's string is as long as its chain of
    entries, and its samples from the last to the first are the last samples of the entries on the chain; all codes
    walk their chains at once.
    """
    entry = codes - (clear + 2)
    leaf = codes < clear
    n = len(codes)
    wrong = np.flatnonzero(~leaf & (entry >= np.minimum(np.arange(n), own - 1)))
    sound = not len(wrong)
    if not sound:
        n = int(wrong[0])
        codes, entry, leaf = codes[:n], entry[:n], leaf[:n]
    if not n:
        return sound, b""
    top, depth = np.where(leaf, np.arange(n), entry), (~leaf).astype(np.int64)
    while not leaf[top].all():
        depth += depth[top]
        top = top[top]
    first = codes[top].astype(np.uint8)
    ends = np.cumsum(depth + 1)
    n = int(np.searchsorted(ends, limit)) + 1
    last = np.where(leaf, codes, first[np.where(leaf, 0, entry + 1)]).astype(np.uint8)[:n]
    flat = np.empty(int(ends[:n][-1]), np.uint8)
    at, up = ends[:n] - 1, np.arange(len(last))
    while len(up):
        flat[at] = last[up]
        more = ~leaf[up]
        at, up = at[more] - 1, entry[up[more]]
    return sound, flat.tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """Samples of a code stream with ``bits`` per sample; padded or cut to ``size``.

    A missing end code, codes after the table is full and a damaged tail are tolerated: decoding stops at the first
    code that no table can explain, and what is missing is 0.
    """
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    total, at, got = len(data) * 8, 0, 0
    width, offset = _schedule(bits)
    out: list[bytes] = []
    ended = False
    while not ended and at < total and got < size:
        n = int(np.searchsorted(offset, total - at, side="right")) - 1
        codes = _codes_at(raw, at, offset[:n], width[:n])
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        used = int(marks[0]) if len(marks) else n
        rest = np.empty(0, np.uint32)
        if len(marks):
            ended = bool(codes[used] == stop)
            at += int(offset[used + 1])
        else:
            at += int(offset[n])
            if n == len(width):  # the table is full: codes of 12 bits up to the next clear
                m = (total - at) // 12
                rest = _codes_at(raw, at, np.arange(m) * 12, np.full(m, 12))
                marks = np.flatnonzero((rest == clear) | (rest == stop))
                ended = not len(marks) or bool(rest[marks[0]] == stop)
                at += 12 * (int(marks[0]) + 1 if len(marks) else m)
                rest = rest[: marks[0]] if len(marks) else rest
            else:
                ended = True
        sound, part = _strings(np.concatenate([codes[:used], rest]).astype(np.int64), used, clear, size - got)
        ended = ended or not sound
        out.append(part)
        got += len(part)
    flat = b"".join(out)[:size]
    return flat + bytes(size - len(flat))


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as a bit stream, least bit first."""
    ends = np.cumsum(widths)
    at = ends - widths
    out = np.zeros((int(ends[-1]) + 7) // 8 + 3, np.uint8) if len(codes) else np.zeros(3, np.uint8)
    word = codes.astype(np.uint32) << (at & 7).astype(np.uint32)
    byte = at >> 3
    for k in range(3):  # neighbours share bytes, their bits differ: sums are ors
        part = ((word >> np.uint32(8 * k)) & np.uint32(255)).astype(np.float64)
        out += np.bincount(byte + k, part, len(out)).astype(np.uint8)
    return out[: (int(ends[-1]) + 7) // 8].tobytes() if len(codes) else b""


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """Code stream of samples below ``1 << bits``; the table is cleared when it is full."""
    clear, stop = 1 << bits, (1 << bits) + 1
    codes: list[int] = [clear]
    put = codes.append
    turns = [0]
    # The table maps a string's code and the sample after it, as one number, to the longer string's code.
    table: dict[int, int] = {}
    find = table.get
    steps = iter(samples)
    top, node = stop, next(steps, None)
    for b in steps:
        longer = find(node << 8 | b)
        if longer is not None:
            node = longer
            continue
        put(node)
        top += 1
        table[node << 8 | b] = top
        node = b
        if top == _FULL - 1:
            put(b)
            put(clear)
            turns.append(len(codes) - 1)
            table.clear()
            top, node = stop, next(steps, None)
    if node is not None:
        put(node)
    put(stop)
    width, _ = _schedule(bits)
    widths = np.empty(len(codes), np.int64)
    widths[0] = bits + 1
    for a, b in zip(turns, [*turns[1:], len(codes) - 1]):  # codes after the clear at a, up to the one at b
        widths[a + 1 : b + 1] = width[: b - a]
    return _packed(np.array(codes, np.uint32), widths)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _u16(n: int) -> bytes:
    return n.to_bytes(2, "little")


@functools.lru_cache(1)
def spread_palette() -> bytes:
    """256 different colours: the upper three bits of a sample are its red, the next three green, the last two blue."""
    return bytes(x for i in range(256) for x in (i & 0xE0, i << 3 & 0xE0, i << 6 & 0xC0))


def encode_samples(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames' palette indices, in order, are ``samples``; their number is a positive multiple of width.

    Each frame is cleared after its time, so that the next one shows its own samples only.
    """
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", _u16(width), _u16(height), b"\xf7\0\0", spread_palette()]
    for a in range(0, len(samples), width * rows):
        part = samples[a : a + width * rows]
        out += [b"\x21\xf9\x04\x08", _u16(delay), b"\0\0", b"\x2c\0\0\0\0", _u16(width), _u16(len(part) // width), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """``indices`` as stored, row by row; ``pixels`` the composed canvas, height x width x RGBA, where asked for."""

    start_cs: int
    delay_cs: int
    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: np.ndarray
    transparent: int | None
    disposal: int
    pixels: np.ndarray | None = None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 * (2 << (flags & 7))
    flat = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8)
    return flat.reshape(-1, 3), at + n


def _deinterlaced(indices: bytes, width: int, height: int) -> bytes:
    stored = np.frombuffer(indices, np.uint8).reshape(height, width)
    out = np.empty_like(stored)
    out[np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])] = stored
    return out.tobytes()


def _check_area(area: int, stored: int, limit: int) -> None:
    """A code has three bits at least and stands for no more samples than the table is long: larger areas are no image."""
    if area > limit or area > _FULL * (stored * 8 // 3 + 1):
        raise ValueError("the file declares more samples than it can hold")


def decode(data: bytes, compose: bool = True, limit: int = MAX_SAMPLES) -> list[Frame]:
    """All frames of a GIF at once: more than ``limit`` samples over all composed frames raise ValueError before memory
    is taken. Else as ``decoded``."""
    return list(decoded(data, compose, limit))


def decoded(data: bytes, compose: bool = True, limit: int | None = None) -> Iterator[Frame]:
    """Frames of a GIF in order, one at a time; what is no GIF raises ValueError, a cut file gives the frames it has.

    A canvas or a frame that is larger than the stored bytes can fill, or than ``MAX_SAMPLES``, raises ValueError
    before memory is taken, and so do more than ``limit`` samples over the composed frames where it is given. Without,
    a caller that lets go of frames holds one of them, however many a file has.

    Disposal 2 clears a frame's area to transparent before the next one, disposal 3 restores what was there before;
    transparent indices leave the canvas as it is. A frame without any palette is drawn in greys.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, shared = 13, None
    _check_area(wide * high, len(data), MAX_SAMPLES if limit is None else limit)
    if flags & 128:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((high, wide, 4), np.uint8) if compose else None
    made = 0
    clock, delay, disposal, transparent = 0, 0, 0, None
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 9 <= len(data):
            left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
            local, at = data[at + 8], at + 9
            palette = shared
            if local & 128:
                palette, at = _palette(data, at, local)
            bits = data[at] if at < len(data) else 8
            stream, at = _sub_blocks(data, at + 1)
            _check_area(w * h, len(stream), MAX_SAMPLES if limit is None else limit)
            if compose and limit is not None and (made + 1) * wide * high > limit:
                raise ValueError("the composed frames are too large")
            indices = lzw_decode(stream, bits, w * h) if 1 <= bits <= 8 else bytes(w * h)
            if local & 64:
                indices = _deinterlaced(indices, w, h)
            colours = palette if palette is not None else np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(-1, 3)
            f = Frame(clock, delay, left, top, w, h, indices, colours, transparent, disposal)
            if compose:
                f.pixels, canvas = _drawn(canvas, f)
            made += 1
            yield f
            clock += delay
            delay, disposal, transparent = 0, 0, None
        elif kind:
            break


def _drawn(canvas: np.ndarray, f: Frame) -> tuple[np.ndarray, np.ndarray]:
    """The canvas with the frame, and the canvas the next frame begins with."""
    shown = canvas.copy()
    area = shown[f.top : f.top + f.height, f.left : f.left + f.width]
    index = np.frombuffer(f.indices, np.uint8).reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
    # A pixel is moved as one number of four bytes; indices beyond the palette take its last colour.
    rgba = np.full((256, 4), 255, np.uint8)
    rgba[:, :3] = f.palette[np.minimum(np.arange(256), len(f.palette) - 1)]
    pixel = rgba.view(np.uint32)[:, 0][index]
    solid = True if f.transparent is None else index != f.transparent
    np.copyto(area.view(np.uint32)[..., 0], pixel, where=solid)
    if f.disposal == 3:
        return shown, canvas
    after = shown
    if f.disposal == 2:
        after = shown.copy()
        after[f.top : f.top + f.height, f.left : f.left + f.width] = 0
    return shown, after


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of the opaque pixels in 64 colours, two bits a channel, red first."""
    red, green, blue = (pixels[..., i] >> 6 << s for i, s in ((0, 4), (1, 2), (2, 0)))
    colour, opaque = (red | green | blue), pixels[..., 3] > 0
    return np.bincount((colour if opaque.all() else colour[opaque]).ravel(), minlength=64)


FRAME = struct_of("frame int, start_cs long, delay_cs int, width int, height int, colour_histogram long[], pixels binary")


def frames(df: DataFrame, data_col: str = "data", out: str = "frames") -> DataFrame:
    """``df`` with an array of timed frames: composed RGBA pixels and their colour histogram.

    Null data, data that are no GIF and files that declare more than they can hold or than ``MAX_SAMPLES`` give null;
    a GIF without frames gives an empty array. An existing column named ``out`` is replaced.
    """

    @F.pandas_udf(T.ArrayType(FRAME))
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in parts:
            rows = []
            for d in data:
                try:
                    got = decode(bytes(d)) if d is not None else None
                except (ValueError, MemoryError):
                    got = None
                rows.append(None if got is None else [(k, f.start_cs, f.delay_cs, f.pixels.shape[1], f.pixels.shape[0], histogram(f.pixels).tolist(), f.pixels.tobytes()) for k, f in enumerate(got)])
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, split.asNondeterministic()(data_col))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these filled up with spaces to a positive multiple of the width."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + b" " * ((-len(b)) % WIDTH if b else WIDTH)


def stored_row(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = encode_samples(payload)
    back, size, tail, made, lasts, colours = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, np.int64)
    for f in decoded(media):
        back.update(f.indices)
        size += len(f.indices)
        tail = (tail + f.indices[-16:])[-16:]
        made += 1
        lasts += f.delay_cs
        colours += histogram(f.pixels)
    feature = f"frames={made};duration_cs={lasts};colours=" + ",".join(map(str, colours.tolist()))
    return n, size, back.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


@F.pandas_udf(struct_of("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))
def stored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Texts kept as GIF samples, read back and measured."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for text in parts:
        yield pd.DataFrame([stored_row(t) for t in text], columns=names)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of documents as GIF media, by way of the decoder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("m", stored.asNondeterministic()("text")).select("doc_id", "m.*")
