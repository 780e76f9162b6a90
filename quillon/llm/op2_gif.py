"""GIF columns: an encoder for byte payloads and a general decoder.

The decoder reads LZW code streams, applies palettes, transparency and disposal, and gives timed frames
with colour histograms. LZW is decoded in numpy: between two clear codes the width of every code is known
from its place, each code's string is an earlier stretch of the output, and both the strings' lengths and the
output's bytes follow from pointers that are halved until they end at literals.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import keep_columns, materialise, small_batches, table

BLOCK = 576
WIDTH = 24
#: Rows of a frame; a longer payload has more frames.
ROWS = 960
DELAY_CS = 10
#: A screen or frame of more pixels counts as damage: its header alone would fill memory.
MOST_PIXELS = 1 << 26


# --- encoding


def lzw_codes(data: bytes) -> list[int]:
    """LZW with 8-bit literals: begins with a clear code (256), ends with 257, clears again when the table is full."""
    out, strings, free = [256], {}, 258
    add, get = out.append, strings.get
    held = data[0]
    for b in memoryview(data)[1:]:
        key = held << 8 | b
        code = get(key)
        if code is not None:
            held = code
            continue
        add(held)
        held = b
        if free < 4096:
            strings[key] = free
            free += 1
        else:
            add(256)
            strings.clear()
            free = 258
    add(held)
    add(257)
    return out


def _widths(place: np.ndarray, literal_bits: int) -> np.ndarray:
    """Bits of the code at a place after a clear code: as many as the next free entry needs."""
    free = np.minimum((1 << literal_bits) + 2 + np.maximum(place - 1, 0), 4095)
    return np.maximum(np.frexp(free.astype(float))[1], literal_bits + 1).astype(np.int64)


def pack_codes(codes: list[int], literal_bits: int = 8) -> bytes:
    c = np.array(codes, np.int64)
    at = np.arange(len(c))
    clear = np.flatnonzero(c == 1 << literal_bits)
    last = np.zeros(len(c), np.int64)
    last[clear[clear + 1 < len(c)] + 1] = clear[clear + 1 < len(c)]
    place = at - 1 - np.maximum.accumulate(last)
    width = _widths(np.maximum(place, 0), literal_bits)
    bits = (c[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


_GREYS = bytes(v for g in range(256) for v in (g, g, g))


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """The payload (a positive multiple of `width` bytes) as grey samples, a frame for each `rows` rows."""
    total = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(total, rows), 0xF7, 0, 0), _GREYS]
    for top in range(0, total, rows):
        data = payload[top * width : (top + rows) * width]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(data) // width, 0) + b"\x08")
        out.append(_sub_blocks(pack_codes(lzw_codes(data))))
    return b"".join(out) + b"\x3b"


# --- decoding


def _follow(pointer: np.ndarray) -> np.ndarray:
    """Where chains of pointers to earlier places end; an end points to itself."""
    todo = np.flatnonzero(pointer != np.arange(len(pointer)))
    while len(todo):
        step = pointer[pointer[todo]]
        moved = step != pointer[todo]
        pointer[todo] = step
        todo = todo[moved]
    return pointer


def _expand(codes: np.ndarray, literal_bits: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    n = len(codes)
    first = (1 << literal_bits) + 2
    at = np.arange(n)
    literal = codes < 1 << literal_bits
    source = np.where(literal, at, codes - first)
    if n and ((source[~literal] >= at[~literal]) | (source[~literal] < 0)).any():
        raise ValueError("a code names no entry yet")
    length, pointer = (~literal).astype(np.int64), source.copy()
    while True:  # length of a code: one more than that of the code its entry grew from
        step = pointer[pointer]
        if (step == pointer).all():
            break
        length += length[pointer]
        pointer = step
    length += length[pointer] * 0 + 1
    end = np.cumsum(length)
    start = end - length
    back = np.repeat(start - start[source], length)
    where = _follow((np.arange(int(end[-1]) if n else 0) - back).astype(np.int32))
    value = np.zeros(len(where), np.uint8)
    value[start[literal]] = codes[literal]
    return value[where]


def lzw_decode(data: bytes, literal_bits: int, expected: int) -> np.ndarray:
    """Samples of a code stream; reading stops at the end code, at `expected` samples, or where bits run out."""
    a = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    clear, stop = 1 << literal_bits, (1 << literal_bits) + 1
    bits, at, done, out = 8 * len(data), 0, 0, []
    while done < expected and at < bits:
        span = 4600
        while True:
            width = _widths(np.arange(span), literal_bits)
            begin = at + np.concatenate([[0], np.cumsum(width)])
            fit = int(np.searchsorted(begin[1:], bits, side="right"))
            byte = begin[:fit] >> 3
            word = a[byte] | a[byte + 1] << 8 | a[byte + 2] << 16
            codes = (word >> (begin[:fit] & 7).astype(np.uint32)).astype(np.int64) & ((1 << width[:fit]) - 1)
            halt = np.flatnonzero((codes == clear) | (codes == stop))
            if len(halt) or fit < span:
                break
            span *= 4  # a full table that is used on without a clear code
        n = int(halt[0]) if len(halt) else fit
        if n:
            out.append(_expand(codes[:n], literal_bits))
            done += len(out[-1])
        if not len(halt) or codes[n] == stop:
            break
        at = int(begin[n + 1])
    got = np.concatenate(out)[:expected] if out else np.zeros(0, np.uint8)
    return np.concatenate([got, np.zeros(expected - len(got), np.uint8)]) if len(got) < expected else got


@dataclass
class Frame:
    delay_ms: int
    left: int
    top: int
    #: Palette indices of the frame's own rectangle.
    indices: np.ndarray
    #: Colours 0xRRGGBB of that rectangle, whatever is transparent.
    colours: np.ndarray
    #: The whole screen as shown, 0xAARRGGBB.
    screen: np.ndarray

    def histogram(self) -> np.ndarray:
        """Pixels of the screen in 64 colour bins (two high bits of red, green and blue); unset ones are left out."""
        c = self.screen[self.screen >> 24 > 0]
        return np.bincount((c >> 22 & 3) << 4 | (c >> 14 & 3) << 2 | c >> 6 & 3, minlength=64)


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    rgb = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3).astype(np.uint32)
    return np.concatenate([rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], np.zeros(256 - n, np.uint32)]), at + 3 * n


def _collect(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order. Disposal 2 clears the frame's rectangle after it was shown, 3 puts back what was there;
    interlaced rows are put in order; a transparent index leaves the screen as it is."""
    if data[:4] != b"GIF8":
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("too large a screen")
    at, shared = 13, np.zeros(256, np.uint32)
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    screen = np.zeros((height, width), np.uint32)
    disposal, delay, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _collect(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * struct.unpack_from("<H", body, 1)[0]
                clear_index = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError("too large a frame")
        at += 10
        palette = shared
        if local & 0x80:
            palette, at = _palette(data, at, local)
        literal_bits = data[at]
        if not 1 <= literal_bits <= 8:
            raise ValueError("no code size")
        stream, at = _collect(data, at + 1)
        indices = lzw_decode(stream, literal_bits, w * h).reshape(h, w)
        if local & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(indices)
            plain[rows] = indices
            indices = plain
        colours = palette[indices]
        before = screen.copy() if disposal == 3 else None
        view = screen[top : top + h, left : left + w]
        inside = slice(0, view.shape[0]), slice(0, view.shape[1])
        shown = colours[inside] | np.uint32(0xFF000000)
        if clear_index is None:
            view[:] = shown
        else:
            np.copyto(view, shown, where=indices[inside] != clear_index)
        yield Frame(delay, left, top, indices, colours, screen)
        if disposal == 2:
            view[:] = 0
        elif disposal == 3:
            screen[:] = before
        disposal, delay, clear_index = 0, 0, None


#: What decode_gif raises at damaged files.
DAMAGE = (ValueError, IndexError, struct.error)


# --- columns


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text's UTF-8 bytes, filled with 255 to a positive multiple of 576,
    as a GIF. Null text: as empty. Empty table: empty. Each row is alone in its work: copies and hot keys cost
    nothing extra; a very long text is one file of many frames."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf[id_col], pdf[text_col], strict=True):
                raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
                rows.append((i, len(raw), encode_gif(raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK))))
            yield pd.DataFrame(rows, columns=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keep_columns(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def frames(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each frame: (id, frame, start_ms, delay_ms, width, height, screen binary of RGBA, histogram, error).
    Null media has no rows. A damaged file has the frames before the damage, then a row whose error says what it
    is and whose other columns are null but id and frame."""
    small_batches(media.sparkSession, 200)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, data in zip(pdf[id_col], pdf["media"], strict=True):
                begin = 0
                k = 0
                try:
                    for f in decode_gif(data) if data is not None else ():
                        rgba = (f.screen << np.uint32(8) | f.screen >> np.uint32(24)).astype(">u4").tobytes()
                        rows.append((i, k, begin, f.delay_ms, f.screen.shape[1], f.screen.shape[0], rgba, f.histogram().tolist(), None))
                        begin += f.delay_ms
                        k += 1
                except DAMAGE as error:
                    rows.append((i, k, None, None, None, None, None, None, str(error) or type(error).__name__))
            made = pd.DataFrame(rows, columns=[id_col, "frame", "start_ms", "delay_ms", "width", "height", "screen", "histogram", "error"], dtype=object)
            yield made.astype({"start_ms": "Int64", "delay_ms": "Int64", "width": "Int64", "height": "Int64"})

    kind = media.schema[id_col].dataType.simpleString()
    return keep_columns(media, id_col, "media").mapInPandas(run, f"`{id_col}` {kind}, frame int, start_ms bigint, delay_ms bigint, width int, height int, screen binary, histogram array<bigint>, error string")


def _bins(histogram: np.ndarray) -> str:
    return ",".join(f"{b}:{v}" for b, v in enumerate(histogram) if v)


def read_payloads(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the payload read back from each GIF, of the GIF, and a feature: frames, length in ms and the
    colour histogram added up over the frames; frames: of each frame its start and delay in ms and its own colour
    histogram; error. Null media: all null but the id, n_bytes and error. A damaged file: no payload and no
    feature, digest and size of the file itself, and error says what is wrong. Empty table: empty. Rows that repeat:
    one result each. A file is read frame by frame, so its length costs no memory beyond its bytes and a screen."""
    small_batches(media.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, n, data in zip(pdf[id_col], pdf["n_bytes"], pdf["media"], strict=True):
                if data is None:
                    rows.append((i, n, None, None, None, None, None, None, None, "no media"))
                    continue
                digest, size, tail, ms, hist, timed = hashlib.sha256(), 0, b"", 0, np.zeros(64, np.int64), []
                stored = len(data), hashlib.sha256(data).hexdigest()
                try:
                    for f in decode_gif(data):
                        part = f.colours.astype(np.uint8).tobytes()  # the low byte of a grey is its sample
                        digest.update(part)
                        size += len(part)
                        tail = (tail + part)[-32:]
                        own = f.histogram()
                        timed.append(f"{ms}+{f.delay_ms}={_bins(own)}")
                        hist += own
                        ms += f.delay_ms
                except DAMAGE as error:
                    rows.append((i, n, None, None, None, *stored, None, None, str(error) or type(error).__name__))
                    continue
                feature = f"frames={len(timed)};ms={ms};hist={_bins(hist)}"
                rows.append((i, n, size, digest.hexdigest(), zlib.crc32(tail), *stored, feature, ";".join(timed), None))
            made = pd.DataFrame(rows, columns=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "error"], dtype=object)
            yield made.astype({"n_bytes": "Int64", "payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    kind = media.schema[id_col].dataType.simpleString()
    return keep_columns(media, id_col, "n_bytes", "media").mapInPandas(
        run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames string, error string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(materialise(store_payloads(table(spark, sf_dir, "documents")), "gif"))
