"""Media columns: GIF files in binary columns, decoded to timed frames with colour histograms.

The reader decodes LZW code streams (any code size, with or without dictionary codes), applies global and local
palettes, interlacing, transparency and the disposal rules, and gives every frame as the canvas that a viewer shows.
The writer stores 8-bit samples losslessly as frames of a grey palette, with dictionary codes and a clear code whenever
the table is full; what it wrote is read by the same decoder as any other file.

Null and empty payloads are 64 zero bytes: one row of samples. Very long ones take several frames, which are decoded one
at a time. Repeated rows give repeated rows, empty tables none. What isn't a GIF, a code size beyond 8 bits and a canvas
of over MAX_PIXELS have no frames; a file that breaks off has those before the break. Other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch_of, id_and_text, sliced, written

#: Samples of a row, and rows of a frame at most: longer payloads take more frames.
WIDTH, ROWS, DELAY = 64, 4096, 10
#: Pixels of a canvas at most: headers can claim 65,535 x 65,535 and hold nothing.
MAX_PIXELS = 1 << 25
_GREY = bytes(x for i in range(256) for x in (i, i, i))


# ---------------------------------------------------------------- code streams


def lzw(data: bytes) -> bytes:
    """The code stream of bytes at minimum code size 8: each code the longest string that the table has."""
    clear, codes, widths = 256, [np.array([256])], [np.array([9])]
    table: dict[int, int] = {}
    run: list[int] = []
    after, prefix = clear + 2, -1
    known, put = table.get, run.append
    for byte in data:
        if prefix < 0:
            prefix = byte
        elif (code := known(pair := prefix << 8 | byte)) is not None:
            prefix = code
        else:
            put(prefix)
            table[pair] = after
            after, prefix = after + 1, byte
            if after == 4096:
                codes.append(np.array([*run, clear]))
                widths.append(_widths(8)[: len(run) + 1])
                table.clear()
                run.clear()
                after = clear + 2
    codes.append(np.array([*run, *([prefix] if prefix >= 0 else []), clear + 1]))
    widths.append(_widths(8)[: len(codes[-1])])
    return _packed(np.concatenate(codes), np.concatenate(widths))


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths one behind the other, lowest bits first: each lies in three bytes, whose bits don't overlap."""
    ends = np.cumsum(widths)
    at = ends - widths
    byte, value, size = at >> 3, codes << (at & 7), int(ends[-1] + 7 >> 3) + 2
    out = sum(np.bincount(byte + k, value >> 8 * k & 255, size) for k in range(3))
    return out[:-2].astype("u1").tobytes()


def _codes(data: np.ndarray, start: int, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths from a bit position; bits beyond the data are zeros."""
    at = start + np.concatenate([[0], np.cumsum(widths[:-1])])
    byte = np.minimum(at >> 3, len(data) - 3)
    value = data[byte].astype("i8") | data[byte + 1].astype("i8") << 8 | data[byte + 2].astype("i8") << 16
    return value >> (at & 7) & (1 << widths) - 1


@functools.cache
def _widths(size: int) -> np.ndarray:
    """Widths of the codes after a clear code, until the table is full."""
    count = 4096 - (1 << size) + 1024
    next_code = (1 << size) + 1 + np.arange(count)
    return np.clip(np.floor(np.log2(next_code)).astype("i8") + 1, size + 1, 12)


def unlzw(data: bytes, size: int, n: int) -> bytes:
    """The first ``n`` indices of a code stream of minimum code size ``size``; missing ones are 0."""
    clear, bits = 1 << size, 8 * len(data)
    padded = np.frombuffer(data + b"\0\0\0\0", "u1")
    out, at = bytearray(), 0
    while at < bits and len(out) < n:
        all_widths = _widths(size)
        widths = all_widths[: (bits - at) // (size + 1) + 1]
        codes = _codes(padded, at, widths)
        ends = at + np.cumsum(widths)
        codes = codes[: np.searchsorted(ends, bits, side="right")]
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else None
        run = [codes[:stop]]
        if stop is None and len(codes) == len(all_widths):  # the table is full and stays so until a clear code
            at_full = int(ends[-1])
            while stop is None and at_full + 12 <= bits:
                part = _codes(padded, at_full, np.full(min(4096, (bits - at_full) // 12), 12))
                found = np.flatnonzero((part == clear) | (part == clear + 1))
                run.append(part[: found[0]] if len(found) else part)
                at_full += 12 * (int(found[0]) + 1 if len(found) else len(part))
                stop = int(part[found[0]]) if len(found) else None
            last, following = stop, at_full
        else:
            last, following = (int(codes[stop]), int(ends[stop])) if stop is not None else (None, bits)
        _expand(np.concatenate(run), clear, out, n)
        if last != clear:
            break
        at = following
    return bytes(out[:n]) + bytes(max(0, n - len(out)))


def _expand(codes: np.ndarray, clear: int, out: bytearray, n: int) -> None:
    """Appends what the codes between two clear codes stand for, until ``out`` has ``n`` bytes.

    The entry that code ``k`` and its successor make is what is put out from the place of code ``k`` on, a byte longer than
    that code's string. So a code that names it takes its bytes from there, and they from an earlier place, down to
    single bytes: chains that are halved in each step, for lengths and for bytes.
    """
    codes = codes.astype("i4")
    own = codes - (clear + 2)  # which code made the entry; below 0 for single bytes
    wrong = np.flatnonzero(own >= np.arange(len(codes)))  # not a code that a writer may give here
    codes, own = (x[: wrong[0] if len(wrong) else None] for x in (codes, own))
    full = 4096 - (clear + 2)  # later codes make no entries
    first = own[: full + 1]
    named = first >= 0
    length, up = named.astype("i4"), np.where(named, first, np.arange(len(first), dtype="i4"))
    while length[up].any():
        length, up = length + length[up], up[up]
    length += 1
    ends = np.cumsum(length, dtype="i4")
    starts = ends - length
    some = int(np.searchsorted(starts, n - len(out)))
    total = int(ends[some - 1]) if some else 0
    source = np.arange(total, dtype="i4") + np.repeat(np.where(named, starts[np.maximum(first, 0)], starts)[:some] - starts[:some], length[:some])
    while not np.array_equal(again := source[source], source):
        source = again
    single = np.zeros(total, "u1")
    single[starts[:some][~named[:some]]] = codes[: len(first)][:some][~named[:some]]
    body = single[source].tobytes()
    out += body
    if some < len(first) or len(out) >= n:
        return
    for code, k in zip(codes[len(first) :].tolist(), own[len(first) :].tolist(), strict=True):
        if len(out) >= n:
            break
        out += bytes([code]) if k < 0 else body[starts[k] : starts[k] + length[k] + 1]


# ---------------------------------------------------------------- files


@dataclass
class Frame:
    """A shown frame: the whole canvas, when it is shown and the rectangle that the file's frame covers."""

    canvas: np.ndarray
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int
    left: int
    top: int
    width: int
    height: int


def read_gif(data: bytes) -> Iterator[Frame]:
    """All frames of a file; nothing for what isn't a GIF, and the whole frames before a cut-off end or a bad code size."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MAX_PIXELS:
        return
    at, clock = 13, 0
    palette = None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        palette, at = data[at : at + n], at + n
    canvas = np.zeros((height, width, 3), "u1")
    delay, disposal, transparent = 0, 0, -1
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                if data[at + 1] == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
                at = _skip(data, at + 2)[1]
                continue
            if data[at] != 0x2C:
                break
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, palette
            if flags & 128:
                n = 3 << (flags & 7) + 1
                colours, at = data[at : at + n], at + n
            body, after = _skip(data, at + 1)
            if not 1 <= data[at] <= 8 or w * h > MAX_PIXELS:
                break
            index = np.frombuffer(unlzw(body, data[at], w * h), "u1").reshape(h, w)
            at = after
            if flags & 64:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(index)
                plain[order] = index
                index = plain
            table = np.zeros((256, 3), "u1")
            given = np.frombuffer(colours or b"", "u1").reshape(-1, 3)
            table[: len(given)] = given
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            index = index[: part.shape[0], : part.shape[1]]
            if transparent < 0:
                part[:] = table[index]
            else:
                seen = index != transparent
                part[seen] = table[index[seen]]
            yield Frame(canvas.copy(), clock, 10 * delay, disposal, transparent, left, top, w, h)
            clock += 10 * delay
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, -1
    except (IndexError, struct.error):
        return


def _skip(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks that begin at a place, and the place after them."""
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def write_samples(payload: bytes) -> bytes:
    """8-bit samples in rows of WIDTH (its length a multiple of that) as a GIF of grey frames."""
    step = WIDTH * ROWS
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(payload) // WIDTH, ROWS), 0xF7, 0, 0), _GREY]
    for part in parts:
        n = len(part)
        stream = lzw(part)
        whole = len(stream) // 255
        blocks = np.full((whole, 256), 255, "u1")
        blocks[:, 1:] = np.frombuffer(stream, "u1")[: 255 * whole].reshape(-1, 255)
        rest = stream[255 * whole :]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, n // WIDTH, 0), b"\x08", blocks.tobytes(), bytes([len(rest)]) + rest if rest else b"", b"\0"]
    return b"".join([*out, b"\x3b"])


def read_samples(frames: Iterable[Frame]) -> bytes:
    """The samples of a written file, from the shown canvases."""
    return b"".join(np.ascontiguousarray(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0]).tobytes() for f in frames)


def histogram(pixels: np.ndarray) -> list[int]:
    """64 counts of colours, two bits of red, green and blue each."""
    top = pixels.reshape(-1, 3) >> 6
    return np.bincount(top[:, 0] * 16 + top[:, 1] * 4 + top[:, 2], minlength=64).tolist()


# ---------------------------------------------------------------- columns

_FRAMES = "id long, frame int, start_ms long, delay_ms long, disposal int, width int, height int, canvas_sha256 string, histogram array<long>"
_STORED = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, histogram array<long>"


def frames(df: DataFrame, id_column: str, media: str) -> DataFrame:
    """A row for each shown frame of the GIFs in a binary column: its time, what its canvas shows (a digest and a colour
    histogram). Null and broken media have none; repeated rows have theirs each."""

    def run(batches):
        for batch in sliced(batches, 16):  # media are decoded frame by frame
            yield batch_of(_FRAMES, [(i, k, f.start_ms, f.delay_ms, f.disposal, f.canvas.shape[1], f.canvas.shape[0], hashlib.sha256(np.ascontiguousarray(f.canvas).tobytes()).hexdigest(), histogram(f.canvas)) for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, f in enumerate(read_gif(data or b""))])

    return df.select(F.col(id_column).cast("long"), F.col(media)).mapInArrow(run, _FRAMES)


def store_frames(df: DataFrame, id_column: str, media: str, path: str | None = None) -> DataFrame:
    """``frames`` as a stored table, read back: timed frames with their histograms, which later jobs read without decoding.

    ``path`` is where it stays; without one it lies in the shared folder until the application ends.
    """
    found = frames(df, id_column, media)
    if path is None:
        return written(found, "frames")
    found.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(found.schema).parquet(path)


def _store(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rows.append((doc_id, len(data), write_samples(data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)))))
        yield batch_of(_STORED, rows)


def _read(batches):
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            parts, counts = [], [0] * 64
            for f in read_gif(media):
                parts.append(read_samples([f]))
                counts = [a + b for a, b in zip(counts, histogram(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]), strict=True)]
            payload = b"".join(parts)
            feature = f"{len(parts)}x{WIDTH}x{len(payload) // WIDTH}:" + ",".join(f"{i}={c}" for i, c in enumerate(counts) if c)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, counts))
        yield batch_of(_READ, rows)


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text's padded bytes as a GIF."""
    return id_and_text(docs).mapInArrow(_store, _STORED)


def read_texts(stored: DataFrame) -> DataFrame:
    """Digests and features of what the stored media show when they are read back."""
    return stored.mapInArrow(_read, _READ)
