"""GIF media columns: timed frames with colour histograms.

``decode_gif`` reads any GIF87a/89a stream: LZW code streams with early, late,
deferred or no clear codes, global and local palettes, interlacing, transparency,
the disposal rules (keep, to background, to previous) and delays.
``encode_gif`` writes grey samples losslessly as dictionary codes, each frame by
a table of its own that is cleared when it is full.

Decoding is vectorised where it can be: a code's width depends only on its place
after the last clear code, so stretches of codes are cut out of the bit stream at
once; they are expanded code by code through the table.

Cases: null media give null frames' columns; null and empty texts are stored
as 64 zero samples; broken streams give the frames before the break; an empty
table gives an empty result; repeated rows are stored alike; texts of any size
are stored whole; other columns stay, and a new one whose name is taken gets
underscores.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, sliced, table

#: Samples in a row and rows in a frame of stored payloads; hundredths of a second that a frame is shown.
WIDTH, HEIGHT, DELAY = 64, 64, 4
#: Payloads are padded to a multiple of this.
BLOCK = 64
#: Bins of a colour histogram, for each of red, green and blue.
BINS = 8
#: Bytes of texts or media that a worker turns into rows at once.
SLICE = 2 << 20
#: Codes have twelve bits at most; codes cut out of a stream at once, at first.
TABLE, STRETCH = 4096, 512


@dataclass
class Frame:
    """``pixels``: the composed canvas as height x width x 4 (red, green, blue, alpha); ``box``: left, top, width, height of what was drawn; ``delay`` in hundredths of a second."""

    pixels: np.ndarray
    box: tuple[int, int, int, int]
    delay: int


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, with the closing empty one."""
    full, rest = divmod(len(data), 255)
    whole = np.empty((full, 256), np.uint8)
    whole[:, 0] = 255
    whole[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    tail = bytes([rest]) + data[full * 255 :] if rest else b""
    return whole.tobytes() + tail + b"\0"


def _widths(entries: np.ndarray) -> np.ndarray:
    """Bits of a code when the table has so many entries."""
    return np.frexp(np.minimum(entries, TABLE - 1).astype(float))[1]


def lzw_encode(samples: bytes, least: int = 8, defer: bool = False) -> bytes:
    """The code stream of some samples of ``least`` bits; a full table is cleared at once or, if ``defer``, kept to the end."""
    clear = 1 << least
    codes, runs = [], []  # codes after a clear code, the clear code that ends them included
    known: dict[int, int] = {}
    free = clear + 2
    emit, find = codes.append, known.get
    at = iter(samples)
    word = next(at, None)
    for c in at:
        key = word << 8 | c
        entry = find(key)
        if entry is not None:
            word = entry
            continue
        emit(word)
        word = c
        if free < TABLE:
            known[key] = free
            free += 1
        elif not defer:
            emit(clear)
            runs.append(len(codes))
            known.clear()
            free = clear + 2
    if word is not None:
        emit(word)
    emit(clear + 1)
    bounds = [0, *runs, len(codes)]
    # code k after a clear code was written when the table had clear + 2 + k entries
    place = np.concatenate([np.arange(b - a) for a, b in zip(bounds, bounds[1:], strict=False)])
    widths = np.append(least + 1, _widths(clear + 1 + place))
    widths = np.maximum(widths, least + 1)
    return _pack(np.append(clear, codes).astype(np.uint16), widths)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as a bit stream, least significant bit first."""
    bits = ((codes[:, None] >> np.arange(12, dtype=np.uint16)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def encode_gif(samples: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """Eight-bit grey samples, a multiple of ``width``, as frames of at most ``height`` rows."""
    rows = len(samples) // width
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), grey]
    for top in range(0, rows, height):
        part = samples[top * width : (top + height) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 0, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@functools.cache
def _places(least: int) -> np.ndarray:
    """Bits before each of the first codes after a clear code; later ones have twelve bits."""
    # a decoder's table has one entry less than the encoder's
    entries = (1 << (least - 1)) + 1 + np.arange(TABLE)
    return np.concatenate([[0], np.cumsum(np.maximum(least, _widths(entries)))])


def _stretch(data: np.ndarray, at: int, least: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``first`` to ``first + count`` after a clear code, from bit ``at`` of ``data`` (three bytes longer than the stream), as if none of them were one, and where each ends."""
    known = _places(least)
    place = known[first : first + count + 1]
    if len(place) <= count:
        late = np.arange(max(first, TABLE + 1), first + count + 1)
        place = np.concatenate([place, known[-1] + 12 * (late - TABLE)])
    place = place - place[0] + at
    n = int(np.searchsorted(place, 8 * (len(data) - 3), "right")) - 1
    start, ends = place[:n], place[1 : n + 1]
    byte = start >> 3
    codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (start & 7)
    return codes & ((1 << (ends - start)) - 1), ends


def lzw_decode(data: bytes, least: int, size: int) -> np.ndarray:
    """Up to ``size`` colour indexes of a GIF code stream whose samples have ``least`` bits."""
    clear, stop = 1 << least, (1 << least) + 1
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    samples = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table = list(samples)
    at, place, done = 0, 0, 0
    while done < size:
        # longer stretches the longer no clear code came, so that little is cut out in vain
        codes, ends = _stretch(stream, at, least + 1, place, max(STRETCH, place))
        if not len(codes):
            break
        special = np.flatnonzero((codes == clear) | (codes == stop))
        k = special[0] if len(special) else len(codes)
        before = len(out)
        whole = _expand(codes[:k].tolist(), table, out, place == 0)
        done += sum(map(len, out[before:]))
        if not whole or len(special) and codes[k] == stop:
            break
        if len(special):
            at, place, table = int(ends[k]), 0, list(samples)
        else:
            at, place = int(ends[-1]), place + len(codes)
    return np.frombuffer(b"".join(out)[:size], np.uint8)


def _expand(codes: list[int], table: list[bytes], out: list[bytes], fresh_table: bool) -> bool:
    """Appends what codes stand for, which adds to ``table``; ``fresh_table``: they are the first since a clear code. Whether all were known."""
    if not codes:
        return True
    at = iter(codes)
    if fresh_table:
        first = next(at)
        if first >= len(table) - 2:
            return False
        last = table[first]
        out.append(last)
    else:
        last = out[-1]
    n, emit, add = len(table), out.append, table.append
    for code in at:
        if code < n:
            entry = table[code]
        elif code == n < TABLE:
            entry = last + last[:1]
        else:
            return False
        emit(entry)
        if n < TABLE:
            add(last + entry[:1])
            n += 1
        last = entry
    return True


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composed; stops where the stream is broken."""
    try:
        yield from _frames(data)
    except (IndexError, struct.error, ValueError):
        return


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while (mark := data[at]) != 0x3B:
        if mark == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = (packed >> 2) & 7, index if packed & 1 else None
            continue
        if mark != 0x2C:
            return
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, colours = at + 10, common
        if flags & 0x80:
            colours, at = _palette(data, at, flags)
        least = data[at]
        body, at = _sub_blocks(data, at + 1)
        index = np.zeros(w * h, np.uint8)
        got = lzw_decode(body, least, w * h)
        index[: len(got)] = got
        index = index.reshape(h, w)
        if flags & 0x40:
            order = np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]
            index = index[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        full = np.zeros((256, 4), np.uint8)
        if colours is not None:
            full[: len(colours), :3] = colours
        full[:, 3] = 255
        target = canvas[top : top + h, left : left + w]
        drawn = full[index[: target.shape[0], : target.shape[1]]]
        if clear_index is None:
            target[:] = drawn
        else:
            seen = index[: target.shape[0], : target.shape[1]] != clear_index
            target[seen] = drawn[seen]
        yield Frame(canvas.copy(), (left, top, w, h), delay)
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Visible pixels by value, for each of red, green and blue; ``bins`` divides 256."""
    alpha = pixels[..., 3].ravel()
    seen = pixels.reshape(-1, 4) if alpha.all() else pixels.reshape(-1, 4)[alpha > 0]
    return [np.bincount(seen[:, c], minlength=256).reshape(bins, -1).sum(1).tolist() for c in range(3)]


FRAME_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("at", T.IntegerType()),
            T.StructField("delay", T.IntegerType()),
            T.StructField("left", T.IntegerType()),
            T.StructField("top", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("red", T.ArrayType(T.LongType())),
            T.StructField("green", T.ArrayType(T.LongType())),
            T.StructField("blue", T.ArrayType(T.LongType())),
        ]
    )
)


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    at = df.columns.index(column)
    (out,) = fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at, SLICE):
            made = pa.array([make(x) for x in batch.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def store_texts(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with ``out``: the text's bytes, padded, as a GIF of grey frames."""

    def make(t: str | None) -> bytes:
        raw = (t or "").encode()
        return encode_gif(raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)))

    return _mapped(df, text, out, T.BinaryType(), pa.binary(), make)


def with_frames(df: DataFrame, media: str = "media", out: str = "pictures") -> DataFrame:
    """``df`` with struct ``out``: ``frames``, the timed frames of the GIF in ``media`` with colour histograms of the composed picture, and ``samples``, the red samples of what they drew, end to end."""

    def make(data: bytes | None) -> dict | None:
        if data is None:
            return None
        found, samples, at = [], [], 0
        for frame in decode_gif(data):
            left, top, w, h = frame.box
            red, green, blue = histogram(frame.pixels)
            samples.append(frame.pixels[top : top + h, left : left + w, 0].tobytes())
            found.append({"at": at, "delay": frame.delay, "left": left, "top": top, "width": w, "height": h, "red": red, "green": green, "blue": blue})
            at += frame.delay
        return {"frames": found, "samples": b"".join(samples)}

    ints = pa.list_(pa.int64())
    frame = pa.struct([(n, pa.int32()) for n in ("at", "delay", "left", "top", "width", "height")] + [(n, ints) for n in ("red", "green", "blue")])
    arrow = pa.struct([("frames", pa.list_(frame)), ("samples", pa.binary())])
    return _mapped(df, media, out, T.StructType([T.StructField("frames", FRAME_TYPE), T.StructField("samples", T.BinaryType())]), arrow, make)


def op4_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a GIF and read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_texts(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    read = with_frames(stored)
    listed = F.array_join(F.transform("pictures.frames", lambda f: F.concat_ws(":", f["at"], F.array_join(f["red"].cast("array<string>"), "."))), ",")
    return read.select("doc_id", "n_bytes", "media", F.col("pictures.samples").alias("payload"), listed.alias("feature")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{BLOCK}, {BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
