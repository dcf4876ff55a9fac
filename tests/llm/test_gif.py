import hashlib
import random
import struct
import zlib

import numpy as np

from lodestone.llm import gif


def lzw_encode(samples, least):
    """A plain encoder with a growing table, cleared only when full."""
    clear = 1 << least
    bits, width, known, word = [], least + 1, {}, ()
    put = lambda code: bits.extend((code >> j) & 1 for j in range(width))
    put(clear)
    nxt = clear + 2
    for c in samples:
        if len(word) == 0 or word + (c,) in known:
            word += (c,)
            continue
        put(known[word] if len(word) > 1 else word[0])
        known[word + (c,)] = nxt
        nxt += 1
        if nxt > (1 << width) and width < 12:
            width += 1
        if nxt == 4096:
            put(clear)
            width, known, nxt = least + 1, {}, clear + 2
        word = (c,)
    put(known[word] if len(word) > 1 else word[0])
    put(clear + 1)
    return np.packbits(bits, bitorder="little").tobytes()


def test_growing_tables():
    random.seed(1)
    for least in (2, 3, 8):
        for n in (1, 5, 300, 9000, 60000):
            for top in (1, 2, 1 << least):
                samples = [random.randrange(top) for _ in range(n)]
                assert gif.lzw_decode(lzw_encode(samples, least), least, n).tolist() == samples, (least, n, top)


def test_deferred_and_missing_clear_codes():
    random.seed(2)
    for n in (4097, 20_000, 60_000, 200_000):
        for top in (2, 256):
            samples = bytes(random.randrange(top) for _ in range(n))
            for defer in (False, True):
                made = gif.lzw_encode(samples, defer=defer)
                assert gif.lzw_decode(made, 8, n).tobytes() == samples, (n, top, defer)
    # the table of both encoders is the same while it is not full, and it compresses
    samples = bytes(b"some words of a text " * 150)
    assert gif.lzw_encode(samples) == lzw_encode(list(samples), 8) and len(gif.lzw_encode(samples)) < len(samples) / 3
    # without a first clear code, cut off, or with a code that is not yet known
    bits = np.unpackbits(np.frombuffer(gif.lzw_encode(b"abcabcabc"), np.uint8), bitorder="little")
    assert gif.lzw_decode(np.packbits(bits[9:], bitorder="little").tobytes(), 8, 9).tobytes() == b"abcabcabc"
    assert gif.lzw_decode(gif.lzw_encode(bytes(5000))[:20], 8, 5000).tobytes() == bytes(gif.lzw_decode(gif.lzw_encode(bytes(5000))[:20], 8, 5000).size)
    assert gif.lzw_decode(b"\xff\xff", 8, 9).size == 0


def test_round_trip():
    for n in (1, 63, 64, 65, 254, 1000):
        raw = random.randbytes(64 * n)
        frames = list(gif.decode_gif(gif.encode_gif(raw)))
        assert b"".join(f.pixels[: f.box[3], : f.box[2], 0].tobytes() for f in frames) == raw
        assert all(f.delay == gif.DELAY for f in frames)


def picture(frames, size=(4, 4)):
    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + colours
    for (left, top, w, h), index, disposal, clear, flags, local in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags | (0x81 if local else 0)) + (local or b"") + b"\x02" + gif._blocks(lzw_encode(index, 2))
    return out + b"\x3b"


def test_disposal_transparency_palettes_interlace():
    back = [1] * 16
    local = bytes([9, 9, 9] * 4)
    rows = [r for r in (0, 2, 1, 3) for _ in range(4)]
    made = picture([((0, 0, 4, 4), back, 1, None, 0, None), ((1, 1, 2, 2), [2, 0, 0, 2], 2, 0, 0, None), ((0, 0, 2, 2), [3] * 4, 3, None, 0, None), ((3, 3, 1, 1), [3], 0, None, 0, local), ((0, 0, 4, 4), rows, 0, None, 0x40, None)])
    f = [x.pixels for x in gif.decode_gif(made)]
    assert len(f) == 5
    assert f[1][1, 1].tolist() == [0, 255, 0, 255] and f[1][1, 2].tolist() == [255, 0, 0, 255]
    assert f[2][1, 1].tolist() == [0, 0, 255, 255] and f[2][2, 2].tolist() == [0, 0, 0, 0]
    assert f[3][0, 0].tolist() == [255, 0, 0, 255] and f[3][1, 1].tolist() == [0, 0, 0, 0] and f[3][3, 3].tolist() == [9, 9, 9, 255]
    assert [f[4][y, 0, :3].tolist() for y in range(4)] == [[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 64, "long 😀 " * 5000, "a"]
    spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, media int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in gif.op4_gif_frames(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.encode_gif(pay)).hexdigest() and r.feature
        assert r.feature == feature(pay)
    assert got[2].feature == got[6].feature


def feature(pay):
    """The red histograms of frames of 64 rows of 64, each drawn over the one before, by counting."""
    out, canvas = [], b""
    for i in range(0, len(pay), 4096):
        canvas = pay[i : i + 4096] + canvas[len(pay[i : i + 4096]) :]
        counts = [0] * 8
        for x in canvas:
            counts[x // 32] += 1
        out.append(f"{i // 4096 * gif.DELAY}:" + ".".join(map(str, counts)))
    return ",".join(out)


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 5, 6)] * 3, "i int, text string, media int, pictures int")
    stored = gif.store_texts(df)
    assert stored.columns == ["i", "text", "media", "pictures", "_media"]
    read = gif.with_frames(stored, "_media")
    assert read.columns[-1] == "_pictures" and [bytes(r._pictures.samples) for r in read.collect()] == [b"a" + bytes(63)] * 3
    assert [r.pictures for r in read.collect()] == [6] * 3
    assert gif.with_frames(gif.store_texts(df.limit(0)), "_media").count() == 0


def test_broken_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"no gif")), (3, bytearray(gif.encode_gif(bytes(64))[:-20]))], "i int, media binary")
    assert [None if r.pictures is None else len(r.pictures.frames) for r in gif.with_frames(df).orderBy("i").collect()] == [None, 0, 0]
