"""Exact removal of repeated byte strings by a sparse, distributed suffix array.

Every byte is removed that lies in a ``length``-byte string (a window) which
also starts earlier, in a smaller document or at an earlier place of the same.
Sorting all suffixes by their first ``length`` bytes would show which windows
have an equal before them, but would shuffle every byte a hundred times.  So
suffixes are first sampled:

1. A window's leading token is the least hash of its 32-byte grams.  Equal
   windows have equal leading tokens, and consecutive windows mostly share one;
   a document falls into segments of windows with one token, about 35 each.
   Only a segment's token and the hash of all its bytes are shuffled.  A segment
   equal to an earlier one is repeated as a whole; a token that occurs once
   belongs to windows that occur once; only segments that share a token but not
   all bytes go on.
2. Their bytes are range-partitioned by (token, document, place) between
   splitters that Spark samples, so that a token which a third of all documents
   share is dealt over many buckets.  Each bucket sorts its suffixes by
   multikey quicksort, eight bytes being one key, and compares neighbours.
   Tokens at a bucket's ends may go on in the next one: the first of their equal
   suffixes are compared across boundaries, by hash, in a last exchange.

Segments that repeat within a block of documents are settled before the first
shuffle, and tokens that are common within a block skip it.

The hashes have 64 bits; two windows are taken for equal in step 1 only if two
independent hashes agree.

Cases: null and empty texts, and those shorter than ``length``, keep all they
have; texts of any size are read in slices; of equal texts the one with the
smallest id stays; different texts that share an id, or have none, are different
documents, in the order of their hashes; rows that share id and text are one
document and get one result; null ids come before all others; an empty table
gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, materialize, sliced, table

LENGTH = 100
GRAM = 32
#: Bytes hashed at once; longer texts are cut into slices of this size.
BLOCK = 1 << 20
#: Segments of one token in a block from which the token counts as common.
COMMON = 16
#: Bytes of texts for which there is a task of their own in each shuffle.
TASK_BYTES = 64 << 20
#: Windows of one row in step 2, and suffixes sorted at once.
ROW_WINDOWS, SORT_WINDOWS = 256, 200_000
#: Documents whose numbers are broadcast, if ids don't tell them apart; beyond it the texts are shuffled to them.
BROADCAST_IDS = 200_000

U = np.uint64
_STEPS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray, m: np.uint64) -> np.ndarray:
    x = a * m
    x += b
    x ^= x >> U(31)
    return x


def window_hashes(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``data``: the hash of its bytes and its leading token; and the hashes of all grams."""
    n = len(data) - length + 1
    h, size, grams, wide = _BYTES[data], 1, None, None
    for m in _STEPS:
        if 2 * size > length:
            break
        h = _mix(h[:-size], h[size:], m)
        size *= 2
        if size == GRAM:
            grams = h
    wide = _mix(h[:n], h[length - size : length - size + n], U(0xA0761D6478BD642F))
    return wide, _sliding(np.minimum, grams, length - GRAM + 1)[:n], grams


def _sliding(pick, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` over all runs of ``width`` values."""
    m, size = values, 1
    while 2 * size <= width:
        m = pick(m[:-size], m[size:])
        size *= 2
    return pick(m[: len(values) - width + 1], m[width - size :]) if size < width else m


#: A segment: token, hash of all its bytes, document, place of its first window, windows, and what is known of it.
SEGMENT = pa.schema([("v", pa.int64()), ("g", pa.int64()), ("k", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("route", pa.int32())])
#: Routes: to be compared; the same, token known to repeat; repeats, to step 2; repeated as a whole.
OPEN, MANY, PART, WHOLE = range(4)


def segments_of(slices: list[tuple[int, int, np.ndarray]], length: int = LENGTH) -> list[np.ndarray]:
    """Segments of some slices of documents (id, place, bytes, all of ``length`` at least), as the columns of SEGMENT."""
    data = np.concatenate([x[2] for x in slices])
    sizes = np.array([len(x[2]) for x in slices])
    begin = np.cumsum(sizes) - sizes
    wide, token, grams = window_hashes(data, length)
    n = len(wide)
    inside = np.zeros(n, bool)
    first = np.zeros(n + 1, bool)
    for a, size in zip(begin.tolist(), sizes.tolist(), strict=True):
        inside[a : a + size - length + 1] = True
        first[a] = True
    cut = first[:n]
    cut[1:] |= token[1:] != token[:-1]
    cut |= ~inside
    bounds = np.flatnonzero(cut)
    ends = np.append(bounds[1:], n)
    good = inside[bounds]
    a, b = bounds[good], ends[good]
    count = b - a
    # all bytes of a segment: its first and last window meet unless it is long
    g = _mix(_mix(wide[a], wide[b - 1], _STEPS[0]), count.astype(U), _STEPS[1])
    for i in np.flatnonzero(count > length):
        g[i] = _mix(g[i : i + 1], (wide[a[i] : b[i]] * (np.arange(count[i]).astype(U) * U(2) + U(1))).sum(keepdims=True), _STEPS[2])[0]
    v = token[a]
    # a token twice in a segment: its windows may repeat within it
    width = length - GRAM + 1
    top = _sliding(np.maximum, np.concatenate([np.zeros(width - 1, U), token, np.zeros(width - 1, U)]), width)
    at = np.flatnonzero(grams[: len(top)] == top[: len(grams)])
    close = (grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] < width)
    many = np.isin(v, grams[at[1:][close]]) | (count > width)
    owner = np.searchsorted(begin, a, "right") - 1
    k = np.array([x[0] for x in slices], np.int64)[owner]
    s = np.array([x[1] for x in slices], np.int64)[owner] + a - begin[owner]

    order = np.lexsort((s, k, g, v))
    v, g, k, s, count, many = v[order], g[order], k[order], s[order], count[order], many[order]
    new_v = np.append(True, v[1:] != v[:-1])
    new_g = new_v | np.append(True, g[1:] != g[:-1])
    same = ~new_g & np.append(False, (k[1:] == k[:-1]) & (s[1:] == s[:-1]))
    route = np.where(many, MANY, OPEN)
    group = np.cumsum(new_v) - 1
    common = np.bincount(group, new_g)[group] > COMMON
    route[common] = PART
    route[common & new_v] = MANY
    route[~new_g] = WHOLE
    keep = ~same
    return [v[keep].view(np.int64), g[keep].view(np.int64), k[keep], s[keep], count[keep].astype(np.int32), route[keep].astype(np.int32)]


def _slices(keys: list[int], texts: list[str | None], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Documents in blocks of about BLOCK bytes, long ones cut so that every window lies in one slice."""
    block, size = [], 0
    for k, t in zip(keys, texts, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8) if t else np.zeros(0, np.uint8)
        for a in range(0, max(0, len(raw) - length + 1), BLOCK):
            part = raw[a : a + BLOCK + length - 1]
            block.append((k, a, part))
            size += len(part)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for block in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in segments_of(block, length)], schema=SEGMENT)

    return run


JUDGED = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("v", pa.int64()), ("part", pa.bool_())])


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by token, bytes, document and place: those that are repeated as a whole, and those that may be in part."""
    last = None  # the row before: v, g, k, s
    held, known = None, False  # the first segment of the token reached while it is alone; whether the token repeats
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        route = cols[5]
        sent = route >= PART
        out = [(x[2][sent], x[3][sent], x[4][sent], x[0][sent], x[5][sent] == PART) for x in [cols]]
        v, g, k, s, n, route = (c[~sent] for c in cols)
        if len(v):
            before = [np.empty_like(c) for c in (v, g, k, s)]
            for b, c, x in zip(before, (v, g, k, s), last or (~v[0], 0, 0, 0), strict=True):
                b[0], b[1:] = x, c[:-1]
            new_v = v != before[0]
            new_g = new_v | (g != before[1])
            whole = ~new_g & ~((k == before[2]) & (s == before[3]))
            group = np.cumsum(new_v)  # 0: goes on from the last batch
            firsts = np.bincount(group, new_g).astype(int)
            repeats = (firsts > 1) | (np.bincount(group, route == MANY) > 0)
            size = len(firsts)
            if not new_v[0]:
                repeats[0] |= known or (held is not None and firsts[0] > 0)
                if repeats[0] and held is not None:
                    out.append(tuple(np.array([x]) for x in held) + (np.array([True]),))
            part = new_g & repeats[group]
            out += [(k[whole], s[whole], n[whole], v[whole], np.zeros(whole.sum(), bool)), (k[part], s[part], n[part], v[part], np.ones(part.sum(), bool))]
            if new_v.any():
                i = np.flatnonzero(new_v)[-1]
                known = bool(repeats[size - 1])
                held = None if known else (k[i], s[i], n[i], v[i])
            else:
                known = bool(repeats[0])
                held = None if known else held
            last = (v[-1], g[-1], k[-1], s[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=JUDGED)


def multikey_groups(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``words`` in an order in which equal ones are neighbours, and the number of each one's group.

    Multikey quicksort: rows are split by one key at a time, and only those still
    tied go on to the next.  Rows with different ``first`` are never tied.
    Equal rows keep their order.
    """
    order = np.argsort(first, kind="stable")
    start = np.append(True, first[order][1:] != first[order][:-1])
    for column in range(words.shape[1]):
        group = np.cumsum(start)
        tied = np.bincount(group)[group] > 1
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key, own = words[order[at], column], group[at]
        sub = np.lexsort((key, own))
        order[at] = order[at][sub]
        key, own = key[sub], own[sub]
        start[at[1:]] |= (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return order, np.cumsum(start) - 1


#: Runs of repeated windows (slot -1), or windows that other buckets may have too: their tokens, hashes, documents and places, end to end.
FOUND = pa.schema([("slot", pa.int64()), ("k", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("raw", pa.binary())])


def _suffixes(v: np.ndarray, k: np.ndarray, s: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Token, document, place and hash of all windows of some rows; which of them repeat an earlier one."""
    count = np.array([len(x) - length + 1 for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum([0, *map(len, raw[:-1])])
    at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    pad = -length % 8
    grid = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(pad, np.uint8)]), length + pad)[at].copy()
    if pad:
        grid[:, length:] = 0
    words = grid.view(np.uint64)
    row = np.repeat(np.arange(len(raw)), count)
    v, k, s = v[row], k[row], s[row] + at - begin[row]
    order, group = multikey_groups(words, v)
    lead = np.append(True, group[1:] != group[:-1])
    first = order[np.flatnonzero(lead)][group]
    repeated = np.zeros(len(v), bool)
    repeated[order] = (k[order] != k[first]) | (s[order] != s[first])
    leads = np.zeros(len(v), bool)
    leads[order] = lead
    h = np.zeros(len(v), U)
    for column in range(words.shape[1]):
        h = _mix(h, words[:, column], _STEPS[column % 6])
    return v, k, s, h.view(np.int64), repeated, leads


def _runs(k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs of consecutive ones: document, first place, how many."""
    if not len(k):
        return k, s, np.zeros(0, np.int32)
    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    new = np.append(True, (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1))
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(k)) - 1
    return k[at], s[at], (s[end] - s[at] + 1).astype(np.int32)


def _found(k: np.ndarray, s: np.ndarray, n: np.ndarray, slots: list[int] = [], raw: list[bytes] = []) -> pa.RecordBatch:  # noqa: B006
    more = len(slots)
    columns = [[-1] * len(k) + slots, np.append(k, [0] * more), np.append(s, [0] * more), np.append(n, [0] * more), [b""] * len(k) + raw]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _bucket(length: int, slots: int):
    """Sorts the suffixes of a bucket, whose rows come by token, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], []]
        opening = None

        def settle(upto: int, last: bool) -> pa.RecordBatch:
            v, k, s = (np.array(c[:upto], np.int64) for c in rows[:3])
            v, k, s, h, repeated, leads = _suffixes(v, k, s, rows[3][:upto], length)
            over = np.flatnonzero(leads & ((v == opening) | (last & (v == v[-1]))))
            for c in rows:
                del c[:upto]
            slot = (h[over].view(U) % U(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            over, slot = over[order], slot[order]
            used, first = np.unique(slot, return_index=True)
            grid = np.stack([v[over], h[over], k[over], s[over]], 1)
            raw = [part.tobytes() for part in np.split(grid, first[1:])] if len(used) else []
            return _found(*_runs(k[repeated], s[repeated]), used.tolist(), raw)

        held = 0
        for batch in batches:
            for c, x in zip(rows, batch.columns, strict=True):
                c.extend(x.to_pylist())
            held += sum(len(x) - length + 1 for x in rows[3][-batch.num_rows :])
            if opening is None and rows[0]:
                opening = rows[0][0]
            if held > SORT_WINDOWS:
                upto = len(rows[0])
                while upto and rows[0][upto - 1] == rows[0][-1]:
                    upto -= 1
                if upto:
                    yield settle(upto, False)
                    held = sum(len(x) - length + 1 for x in rows[3])
        if rows[0]:
            yield settle(len(rows[0]), True)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the windows that several buckets have; runs pass. Rows come by slot."""
    slot, held = None, []

    def settle() -> pa.RecordBatch:
        v, h, k, s = np.frombuffer(b"".join(held), np.int64).reshape(-1, 4).T
        order = np.lexsort((s, k, h, v))
        v, h, k, s = v[order], h[order], k[order], s[order]
        lead = np.append(True, (v[1:] != v[:-1]) | (h[1:] != h[:-1]))
        first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        repeated = (k != k[first]) | (s != s[first])
        return _found(*_runs(k[repeated], s[repeated]))

    for batch in batches:
        own = batch.column(0).to_numpy() < 0
        yield batch.filter(pa.array(own))
        rest = batch.filter(pa.array(~own))
        for at, raw in zip(rest.column(0).to_pylist(), rest.column(4).to_pylist(), strict=True):
            if at != slot and held:
                yield settle()
                held = []
            slot = at
            held.append(raw)
    if held:
        yield settle()


def _spark_type(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.bool_(): T.BooleanType(), pa.binary(): T.BinaryType()}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


CONTEXT = pa.schema([("v", pa.int64()), ("k", pa.int64()), ("s", pa.int64()), ("raw", pa.binary())])


def _contexts(length: int):
    """The bytes of the segments in a document's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            out: list[list] = [[], [], [], []]
            for k, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                for p in parts:
                    for a in range(p["s"], p["s"] + p["n"], ROW_WINDOWS):
                        end = min(a + ROW_WINDOWS, p["s"] + p["n"]) + length - 1
                        if end <= len(raw):
                            for c, x in zip(out, (p["v"], k, a, raw[a:end]), strict=True):
                                c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CONTEXT, strict=True)], schema=CONTEXT)

    return run


def _numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with a long ``_k`` for each document, in their order: its id if ids tell all texts apart, else the number of its id and text."""
    keyed = df.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    words = F.coalesce(F.col(text), F.lit(""))
    hashes = {"_a": F.xxhash64(words), "_b": F.xxhash64(F.lit(1), words)}
    ends = [f(h).alias(n + h) for h in hashes for n, f in (("least", F.min), ("most", F.max))]
    if keyed.select("_k", *(c.alias(h) for h, c in hashes.items())).groupBy("_k").agg(*ends).where("least_a <> most_a OR least_b <> most_b").isEmpty():
        return keyed
    named = keyed.withColumnRenamed("_k", "_id").withColumns(hashes)
    name = ["_id", *hashes]
    # partitions come in the order of the sort, and so do the numbers
    numbers = materialize(named.select(*name).distinct().sort(*name).withColumn("_k", F.monotonically_increasing_id()), "numbers")
    if numbers.count() <= BROADCAST_IDS:
        return named.join(F.broadcast(numbers), name).select(*df.columns, "_k")
    return materialize(named.join(numbers.hint("shuffle_hash"), name).select(*df.columns, "_k"), "numbered")


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt by document, with the document's number in ``_k``, and for each ``_k`` the list ``_runs`` of (s, n): n windows from place s repeat earlier ones."""
    spark = df.sparkSession
    keyed = _numbered(df, key, text)
    segments = keyed.select("_k", text).mapInArrow(_segments(length), _spark_type(SEGMENT))
    slot = F.when(F.col("route") < PART, F.col("v")).otherwise(F.xxhash64("k", "s"))
    # as many tasks as the texts need, whatever the session's number is
    size = keyed.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    judged = segments.repartition(tasks, slot).sortWithinPartitions("v", "g", "k", "s").mapInArrow(judge, _spark_type(JUDGED))
    judged = materialize(judged, "segments")

    dealt = keyed.repartition(tasks, "_k")
    parts = judged.where("part").groupBy("k").agg(F.collect_list(F.struct("s", "n", "v")).alias("parts")).withColumnRenamed("k", "_k")
    with_parts = dealt.join(parts.hint("shuffle_hash"), "_k").select("_k", text, "parts")
    contexts = with_parts.mapInArrow(_contexts(length), _spark_type(CONTEXT))
    buckets = contexts.repartitionByRange(tasks, "v", "k", "s").sortWithinPartitions("v", "k", "s")
    found = buckets.mapInArrow(_bucket(length, tasks), _spark_type(FOUND))
    spread = F.when(F.col("slot") < 0, F.xxhash64("k", "s")).otherwise(F.col("slot"))
    found = found.repartition(tasks, spread).sortWithinPartitions("slot").mapInArrow(_across, _spark_type(FOUND))
    runs = judged.where("NOT part").select("k", "s", "n").unionByName(found.select("k", "s", "n"))
    lists = runs.groupBy("k").agg(F.collect_list(F.struct("s", "n")).alias("_runs")).withColumnRenamed("k", "_k")
    return dealt, lists


def _remove(columns: list[str], text: str, out: str, length: int, binary: bool):
    at, runs_at = columns.index(text), columns.index("_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            made = []
            for t, runs in zip(batch.column(at).to_pylist(), batch.column(runs_at).to_pylist(), strict=True):
                raw = (t or "").encode()
                spans: list[list[int]] = []
                for a, b in sorted((r["s"], min(len(raw), r["s"] + r["n"] + length - 1)) for r in runs or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    elif a < b:
                        spans.append([a, b])
                ends = [0, *(x for span in spans for x in span), len(raw)]
                parts = [raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
                kept = b"".join(parts) if binary else "".join(x.decode(errors="ignore") for x in parts)
                made.append({"kept": kept, "spans": [{"start": a, "end": b} for a, b in spans]})
            arrow = pa.struct([("kept", pa.binary() if binary else pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            rest = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if i != runs_at]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(made, arrow)], names=[*(n for n, _ in rest), out])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, out: str = "deduplicated", binary: bool = True) -> DataFrame:
    """``df`` with struct ``out``: ``kept``, the bytes left of ``text``, and ``spans``, the removed (start, end).

    If not ``binary``, ``kept`` is text, without characters of which only a part was
    removed.  Where ``df`` has a column of that name, the new one gets underscores.
    """
    (out,) = fresh(df, out)
    names = [f"c{i}" for i in range(len(df.columns))]  # no name of the input can clash
    plain = df.toDF(*names)
    key, text = names[df.columns.index(key)], names[df.columns.index(text)]
    dealt, lists = repeated_windows(plain, key, text, length)
    joined = dealt.join(lists.hint("shuffle_hash"), "_k", "left").select(*names, "_runs")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = T.StructType([T.StructField("kept", T.BinaryType() if binary else T.StringType()), T.StructField("spans", T.ArrayType(span))])
    done = joined.mapInArrow(_remove(joined.columns, text, out, length, binary), T.StructType([*plain.schema.fields, T.StructField(out, kind)]))
    return done.toDF(*df.columns, out)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier too."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.octet_length("deduplicated.kept").cast("long")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), (n - left).alias("n_removed"), F.size("deduplicated.spans").cast("long").alias("n_spans"), F.sha2("deduplicated.kept", 256).alias("kept_sha256"))
