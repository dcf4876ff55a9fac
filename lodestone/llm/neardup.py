"""Near-duplicates by improved consistent weighted sampling.

A document is the weighted set of its shingles of five words; a shingle weighs
its count times an inverse document frequency, which is counted over all
documents in 2^20 hash buckets (as hashed TF-IDF usually is), so what tasks
share has one size however large the corpus.  The idf is scaled to 1..2:
1 + log((1 + N) / (1 + df)) / log(1 + N).

1. Equal texts form one group, which goes on under a name of its own, a hash of
   the text: ids only choose and name the document of a class that stays.
2. Consistent weighted sampling draws ``BANDS * ROWS`` samples a document; two
   documents agree on one with the probability of their weighted Jaccard
   similarity.  Documents that agree on all samples of a band share a bucket.
3. In each bucket all members meet one leader, not each other.  Pairs that agree
   on half of all samples (by eight bits of each) are verified: links are those
   whose weighted Jaccard similarity reaches the threshold.  Members that are not
   yet in the leader's class meet other leaders in further rounds.
4. What is still apart then is compared without leaders: the samples of members
   outside a bucket's largest class with those of all, dealt in blocks of bounded
   size.  Of documents with a partner there, shingles are counted: one that has
   less than the threshold of its weight in shingles that another has too is in
   no link and goes.  The rest meet in their blocks with their shingles: pairs
   that agree often enough are verified there, until their classes are linked,
   and only links leave the block.
5. Linked documents form classes: connected components by alternating stars.

A pair at the threshold shares no bucket with a probability under 5e-5, and
agrees on fewer than half of all samples with one under 1e-5.

Cases: null texts count as empty; texts of fewer than five words have no
shingles and match equal texts only; different texts that share an id, or have
none, are different documents; repeated rows get one class; null ids come before
all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import HOT_ROWS, drop, materialize, salted_join, sliced, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 3
#: Buckets of document frequencies, and how many of them one row of counts has; how many rows are summed at a time.
FEATURES, CHUNK, MERGE = 1 << 20, 1 << 14, 64
#: Bytes of text hashed at once.
BLOCK = 1 << 18
#: Shingles of leaders, 12 bytes each, that a task keeps.
KEPT_SHINGLES = 1 << 19
#: Rounds with leaders; members in a block of step 4; samples of BANDS * ROWS that must agree there.
ROUNDS, MEMBERS, AGREE = 3, 512, 21
#: Ids of eight bytes that are broadcast to pick texts where they are read; beyond it the texts are shuffled to them.
BROADCAST_IDS = 200_000
NULL_KEY = -(1 << 63)

U = np.uint64
_HASH_BITS = U(44)
_MASK = (U(1) << _HASH_BITS) - U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(42)
_PLACES = _RNG.integers(0, 2**64, SHINGLE, dtype=np.uint64) | U(1)
_SEEDS = _RNG.integers(0, 2**64, (BANDS * ROWS, 2), dtype=np.uint64) | U(1)
#: Exponential variates by twelve bits.
_EXP = (-np.log((np.arange(4096) + 0.5) / 4096)).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 2 * BLOCK), base, U)]))
        if n <= 2 * BLOCK:
            _powers[str(base)] = known
    return known[:n]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of some texts: hashes of 44 bits, how often each occurs in its text, and where each text's begin."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(x) + 1 for x in raw])
    begin = np.cumsum(sizes) - sizes
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.view(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if space[0] and len(end) > len(start):
        end = end[1:]
    sums = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * _power(_BASE, len(data)))])
    word = _mix((sums[end] - sums[start]) * _power(_INVERSE, len(data))[start])
    owner = np.searchsorted(begin, start, "right") - 1
    n = max(0, len(word) - SHINGLE + 1)
    h = np.zeros(n, U)
    for k in range(SHINGLE):
        h += word[k : k + n] * _PLACES[k]
    inside = owner[:n] == owner[SHINGLE - 1 :] if n else np.zeros(0, bool)
    keys = (owner[:n][inside].astype(U) << _HASH_BITS) | (_mix(h[inside]) & _MASK)
    keys, count = np.unique(keys, return_counts=True)
    first = np.searchsorted(keys, np.arange(len(texts) + 1).astype(U) << _HASH_BITS)
    return keys & _MASK, count, first


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK characters."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count.astype(np.float32) * idf[(h & U(FEATURES - 1)).astype(np.int64)]


def signatures(h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: a row of 32-bit values for each text, zeros for those without shingles."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((len(first) - 1, len(_SEEDS)), np.uint32)
    if not len(full):
        return out
    log_w = np.log(weight)
    at = first[:-1][full]
    twelve, low, sign = U(4095), U(0xFFFFFFFF), np.uint32(1 << 31)
    z, y = np.empty_like(h), np.empty_like(h)

    def variate(shift: int) -> np.ndarray:
        """Gamma variates of shape two, from twice twelve bits."""
        np.right_shift(z, U(shift), out=y)
        return _EXP[(y & twelve).view(np.int64)] + _EXP[((y >> U(12)) & twelve).view(np.int64)]

    for j, (a, b) in enumerate(_SEEDS):
        np.multiply(h, a, out=z)
        z += b
        np.right_shift(z, U(32), out=y)
        z ^= y
        z *= U(0xD6E8FEB86659FD93)
        np.right_shift(z, U(29), out=y)
        z ^= y
        r = variate(0)
        rank = np.log(variate(24))
        np.right_shift(z, U(48), out=y)
        beta = y.astype(np.float32)
        beta += np.float32(0.5)
        beta *= np.float32(1 / 65536)
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        # the name of a sample: its shingle and the step of its weight
        np.multiply(t.astype(np.int64).view(U), _BASE, out=y)
        y ^= z
        y *= U(0xFF51AFD7ED558CCD)
        y >>= U(32)
        t -= beta
        t += np.float32(1)
        t *= r
        rank -= t
        bits = rank.view(np.uint32)
        bits ^= np.where(bits & sign, ~np.uint32(0), sign)
        key = bits.astype(U)
        key <<= U(32)
        key |= y
        out[full, j] = (np.minimum.reduceat(key, at) & low).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = (b[0][at] == a[0]) if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = float(np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / total if total else 1.0


# ---- corpus statistics ---------------------------------------------------------------------


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and for each bucket how many shingles of all documents fall into it; ``docs`` has (k, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int32), 0
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            rows += len(texts)
            for a, b in _blocks(texts):
                np.add.at(total, (shingles(texts[a:b])[0] & U(FEATURES - 1)).astype(np.int64), 1)
        chunks = [(i, total[i * CHUNK : (i + 1) * CHUNK].astype(np.int64)) for i in range(FEATURES // CHUNK)]
        chunks = [(i, c.tobytes(), 0) for i, c in chunks if c.any()] + [(-1, b"", rows)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int32()), pa.array([c[1] for c in chunks], pa.binary()), pa.array([c[2] for c in chunks], pa.int64())], ["chunk", "data", "docs"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32()]
        row = lambda at, total, n: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((at[0], total.tobytes(), n, at[1]), kinds, strict=True)], ["chunk", "data", "docs", "part"])
        at, total, docs = None, np.zeros(0, np.int64), 0
        for batch in batches:
            for chunk, data, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (chunk, part // MERGE):
                    if at:
                        yield row(at, total, docs)
                    at, total, docs = (chunk, part // MERGE), np.zeros(CHUNK if chunk >= 0 else 0, np.int64), 0
                total += np.frombuffer(data, np.int64)
                docs += n
        if at:
            yield row(at, total, docs)

    schema = "chunk int, data binary, docs long"
    parts = materialize(docs.select("k", "text").mapInArrow(count, schema).withColumn("part", F.spark_partition_id()), "counts")
    # a tree: MERGE tasks' counts meet in one, then those of MERGE such tasks, so no task ever reads more however many there are
    groups = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while groups > 1:
        groups = -(-groups // MERGE)
        summed = parts.repartition("chunk", F.expr(f"part div {MERGE}")).sortWithinPartitions("chunk", "part").mapInArrow(add, schema + ", part int")
        parts, merged = materialize(summed, "counts"), parts
        drop(merged)
    # one row of sums for each chunk: 8 MB in all
    found = parts.drop("part").collect()
    drop(parts)
    total = np.zeros(FEATURES, np.int64)
    for r in found:
        if r.chunk >= 0:
            total[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(bytes(r.data), np.int64)
    return sum(r.docs for r in found), total


def idf_of(docs: int, frequencies: np.ndarray) -> np.ndarray:
    return (1 + np.log((1 + docs) / (1 + np.minimum(frequencies, docs))) / np.log(1 + max(1, docs))).astype(np.float32)


# ---- stages --------------------------------------------------------------------------------


def _sign(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts = batch.column(2).to_pylist()
            digests = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
            bands, raw = [], []
            for a, b in _blocks(texts):
                h, count, first = shingles(texts[a:b])
                sig = signatures(h, weights(h, count, idf.value), first)
                for row, full in zip(sig, first[1:] > first[:-1], strict=True):
                    if not full:
                        bands.append([])
                        raw.append(b"")
                        continue
                    keys = np.zeros(BANDS, U)
                    for j in range(ROWS):
                        keys = _mix(keys * _BASE + row[j::ROWS][:BANDS].astype(U))
                    bands.append(keys.view(np.int64))
                    raw.append(row.astype(np.uint8).tobytes())
            text_hash = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text_hash[:, 0]), pa.array(text_hash[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(raw, pa.binary())], ["k", "u", "t1", "t2", "bands", "sig"])

    return run


def _verify(idf, threshold: float):
    """Of rows (u, text, v, other): the pairs whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(sliced(batches, 1), 3):
            us, texts, vs, others = (c.to_pylist() for c in batch.columns)
            links: tuple[list[int], list[int], list[float]] = ([], [], [])
            sets: dict[int, tuple] = {}
            for a, b in _blocks(texts):
                # the leader of many pairs is hashed once
                new = {v: o for v, o in zip(vs[a:b], others[a:b], strict=True) if v not in sets}
                if sum(len(h) for h, _ in sets.values()) > KEPT_SHINGLES:
                    sets, new = {}, dict(zip(vs[a:b], others[a:b], strict=True))
                h, count, first = shingles([*texts[a:b], *new.values()])
                w = weights(h, count, idf.value)
                made = [(h[x:y], w[x:y]) for x, y in zip(first, first[1:], strict=False)]
                sets.update(zip(new, made[b - a :], strict=True))
                for u, v, own in zip(us[a:b], vs[a:b], made, strict=False):
                    s = similarity(own, sets[v])
                    if s >= threshold:
                        for c, x in zip(links, (u, v, s), strict=True):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64()), pa.array(links[2], pa.float64())], ["u", "v", "similarity"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``pairs`` (u, v) that are links, with their similarity; ``docs`` has (k, text)."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.col("u").alias("k")).union(pairs.select("v")).distinct(), "ids")
    texts = materialize(_texts_of(ids, docs), "texts")
    # a leader may have any number of pairs
    joined = salted_join(pairs, texts.select(F.col("k").alias("v"), F.col("text").alias("other")), ["v"], "u").join(texts.withColumnRenamed("k", "u"), "u")
    # a task that gets the pairs of one leader end to end hashes it once
    joined = joined.select("u", "text", "v", "other")
    found = materialize(joined.mapInArrow(_verify(idf, threshold), "u long, v long, similarity double"), "links")
    drop(pairs, ids, texts)
    return found


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, sig, v, other): the pairs whose samples agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (1, 3))
        yield batch.select([0, 2]).filter(pa.array((a == b).sum(1) >= AGREE))


def components(links: DataFrame) -> DataFrame:
    """(u, class) for all ends of the links (u, v) but the smallest of each component, which is the class: alternating large and small stars."""
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "stars")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node may have any number of neighbours; where no node can be hot, nothing need be written to find out
        kept, join = (lambda df: df, lambda a, b: a.join(b.drop("n"), "u")) if edges.count() <= HOT_ROWS else (lambda df: materialize(df, "stars"), lambda a, b: salted_join(a, b, ["u"], "v", "n"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # every larger neighbour of a node, to the node's least neighbour
        large = kept(join(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join(large, low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        read = [edges, *(t for t in (least, large, low) if hasattr(t, "_written_to"))]
        edges = materialize(small, "stars")
        drop(*read)
        # done when no class is itself in another
        if edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return edges.select("u", F.col("v").alias("class"))


def _by_cell(make, columns: list[str], kinds: list[pa.DataType]):
    """Runs ``make(rows, split)`` on the rows of each cell, a list for each column behind the cell's name, of which the first ``split`` are of side 0; rows come by cell and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def settle() -> pa.RecordBatch:
            rows = list(map(list, zip(*held, strict=True)))
            made = make(rows[1:], int(np.searchsorted(rows[0], 1)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], columns)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != cell and held:
                    yield settle()
                    held = []
                cell = row[0]
                held.append(row[1:])
        if held:
            yield settle()

    return run


def _near(c: np.ndarray, sig: np.ndarray, split: int, i: int) -> np.ndarray:
    """Members of side 1 that are of another class than member i of side 0 and agree with it often enough."""
    return split + np.flatnonzero(((sig[split:] == sig[i]).sum(1) >= AGREE) & (c[split:] != c[i]))


def _partnered(rows: list[list], split: int) -> tuple:
    """The members (u, class, sig) of a cell that have a partner in it."""
    u, c = np.array(rows[0]), np.array(rows[1])
    sig = np.frombuffer(b"".join(rows[2]), np.uint8).reshape(len(u), -1)
    has = np.zeros(len(u), bool)
    for i in range(split):
        near = _near(c, sig, split, i)
        has[near] = True
        has[i] |= len(near) > 0
    return (np.unique(u[has]),)


def _linked(threshold: float):
    """Links that join the classes of a cell's members (u, class, sig, band, bands, hashes, weights)."""

    def make(rows: list[list], split: int) -> tuple:
        u, c = np.array(rows[0]), np.array(rows[1])
        sig = np.frombuffer(b"".join(rows[2]), np.uint8).reshape(len(u), -1)
        band, bands = rows[3][0], np.array(rows[4], np.int64)
        sets = [(np.frombuffer(h, U), np.frombuffer(w, np.float32)) for h, w in zip(rows[5], rows[6], strict=True)]
        total = np.array([float(w.sum(dtype=np.float64)) for _, w in sets])
        out: tuple[list, list, list] = ([], [], [])
        for i in range(split):
            # a pair that shares an earlier band is compared there
            first = (bands[split:] == bands[i]).argmax(1) == band
            ratio = np.minimum(total[split:], total[i]) >= threshold * np.maximum(total[split:], total[i])
            near = _near(c, sig, split, i)
            for j in near[(first & ratio)[near - split]]:
                if c[j] == c[i]:
                    continue
                s = similarity(sets[i], sets[j])
                if s >= threshold:
                    for o, x in zip(out, (max(u[i], u[j]), min(u[i], u[j]), s), strict=True):
                        o.append(x)
                    c[c == c[j]] = c[i]
        return out

    return make


def _weighed(idf):
    """A row (k, h, w) for each shingle of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                h, count, first = shingles(texts[a:b])
                k = np.repeat(keys[a:b], np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h.view(np.int64)), pa.array(weights(h, count, idf.value).astype(float))], ["k", "h", "w"])

    return run


def _packed(idf):
    """A row (u, hashes, weights) for each document: its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            made: tuple[list, list] = ([], [])
            for a, b in _blocks(texts):
                h, count, first = shingles(texts[a:b])
                w = weights(h, count, idf.value)
                for x, y in zip(first, first[1:], strict=False):
                    made[0].append(h[x:y].tobytes())
                    made[1].append(w[x:y].tobytes())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(m, pa.binary()) for m in made)], ["u", "hashes", "weights"])

    return run


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts (k, text) of some names (k), each once: picked where they are read if the names are few enough to be broadcast."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "k", "left_semi").dropDuplicates(["k"])


def linkable(ids: DataFrame, docs: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """Those of ``ids`` (k) that have at least the threshold of their weight in shingles that another of them has.

    A document's similarity with any other is at most that share, so no link is lost.
    """
    rows = materialize(_texts_of(ids, docs).mapInArrow(_weighed(idf), "k long, h long, w double"), "shingles")
    several = rows.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b")
    several = materialize(several.select("h", F.lit(1).alias("several"), "n"), "shared")
    # a shingle may be in any number of documents
    shared = salted_join(rows, several, ["h"], "k", "n", "left").groupBy("k").agg(F.sum(F.when(F.col("several") == 1, F.col("w"))).alias("shared"), F.sum("w").alias("all"))
    return shared.where(F.col("shared") >= F.col("all") * (threshold - 1e-6)).select("k")


def _cells(members: DataFrame) -> DataFrame:
    """Members (band, bucket, u, class, sig) of buckets that hold several classes, dealt into cells of bounded size: (cell, side, u, class, sig, band).

    Side 0 has those outside the bucket's largest class, side 1 all.
    """
    key = ["band", "bucket"]
    classes = members.groupBy(*key, "class").agg(F.count(F.lit(1)).alias("n"))
    largest = classes.groupBy(*key).agg(F.max(F.struct("n", F.col("class").alias("c"))).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    several = largest.select(*key, F.col("top.c").alias("c"), F.ceil(F.col("all") / MEMBERS).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / MEMBERS).cast("int").alias("rests"), F.col("all").alias("n"))
    wide = salted_join(members, materialize(several, "mixed"), key, "u", "n")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    left = wide.where("class <> c").withColumn("j", F.explode(numbers("blocks"))).withColumn("i", own("rests")).withColumn("side", F.lit(0))
    right = wide.withColumn("i", F.explode(numbers("rests"))).withColumn("j", own("blocks")).withColumn("side", F.lit(1))
    return left.unionByName(right).select(F.concat_ws(":", *key, "i", "j").alias("cell"), "side", "u", "class", "sig", "band")


def _classed(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "u", "left").withColumn("class", F.coalesce("class", "u"))


def _name(text: Column, salt: int) -> Column:
    """What a text is called in pairs and classes."""
    return F.xxhash64(F.lit(salt), F.coalesce(text, F.lit("")))


def _id(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(NULL_KEY))


def _classes(df: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """The rows (k, u, r) of ``df`` with their texts' names and numbers of their own; for each name u: ``label``, the name of its class, and ``stays``, the row (k, u, r) of the class that stays and how often (n) its id has that text; the salt of the names."""
    spark = df.sparkSession
    idf = spark.sparkContext.broadcast(idf_of(*document_frequencies(df.select(F.lit(0).cast("long").alias("k"), F.col(text).alias("text")))))
    for salt in count():
        read = df.select(_id(F.col(key)).alias("k"), _name(F.col(text), salt).alias("u"), F.col(text).alias("text"))
        signed = read.mapInArrow(_sign(idf), "k long, u long, t1 long, t2 long, bands array<long>, sig binary")
        signed = materialize(signed.withColumn("r", F.monotonically_increasing_id()), "signatures")
        # names are taken anew if two texts, by 128 bits, share one
        ends = [f(t).alias(f"{n}{t}") for t in ("t1", "t2") for n, f in (("a", F.min), ("b", F.max))]
        if signed.groupBy("u").agg(*ends).where("at1 <> bt1 OR at2 <> bt2").isEmpty():
            break
    docs = read.select(F.col("u").alias("k"), "text")
    labels = _labels(signed.select("u", "bands", "sig").dropDuplicates(["u"]), docs, idf, threshold)
    rows = signed.select("k", "u", "r")
    ids = rows.groupBy("u", "k").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("n"))
    texts = ids.groupBy("u").agg(F.min(F.struct("k", "u", "r", "n")).alias("least"))
    texts = materialize(texts.join(labels, "u", "left").select("u", "least", F.coalesce("class", "u").alias("label")), "texts")
    return rows, texts.join(texts.groupBy("label").agg(F.min("least").alias("stays")), "label").select("u", "label", "stays"), salt


def _labels(first: DataFrame, docs: DataFrame, idf, threshold: float) -> DataFrame:
    """(u, class) of the texts (u, bands, sig) that are linked to one of a smaller name; ``docs`` has (k, text), k being the name."""
    spark = first.sparkSession
    banded = first.select("u", "sig", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.min("u").alias("v"), F.max("u").alias("w"), F.count(F.lit(1)).alias("n")).where("v != w").select("band", "bucket", "n")
    shared = materialize(shared, "shared")
    members = materialize(salted_join(banded, shared, ["band", "bucket"], "u", "n"), "buckets")
    drop(shared)

    links, labels = None, spark.createDataFrame([], "u long, class long")
    for number in range(ROUNDS):
        classed = materialize(_classed(members, labels), "classed")
        order = F.col("u") if number == 0 else F.xxhash64("u", F.lit(number), "band")
        lead = F.min(F.struct(order.alias("r"), F.col("u").alias("v"), F.col("class").alias("c"), F.col("sig").alias("other")))
        chosen = classed.groupBy("band", "bucket").agg(F.min("class").alias("a"), F.max("class").alias("b"), lead.alias("lead"), F.count(F.lit(1)).alias("n")).where("a != b")
        chosen = materialize(chosen.select("band", "bucket", "lead.v", "lead.c", "lead.other", "n"), "leaders")
        met = salted_join(classed, chosen, ["band", "bucket"], "u", "n").where("class != c")
        found = verify(met.select("u", "sig", "v", "other").mapInArrow(_agreeing, "u long, v long").distinct(), docs, idf, threshold)
        drop(classed, chosen)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    # the rest without leaders
    classed = materialize(_classed(members, labels), "classed")
    dealt = lambda rows: rows.repartition("cell").sortWithinPartitions("cell", "side", "u")
    partnered = dealt(_cells(classed).drop("band")).mapInArrow(_by_cell(_partnered, ["k"], [pa.int64()]), "k long")
    ids = materialize(partnered.distinct(), "partnered")
    if not ids.isEmpty():
        left = materialize(linkable(ids, docs, idf, threshold), "linkable")
        sets = _texts_of(left, docs).mapInArrow(_packed(idf), "u long, hashes binary, weights binary")
        sets = materialize(sets.join(first.select("u", "bands"), "u"), "sets")
        cells = _cells(classed.join(left.withColumnRenamed("k", "u"), "u", "left_semi")).join(sets, "u")
        cells = dealt(cells.select("cell", "side", "u", "class", "sig", "band", "bands", "hashes", "weights"))
        found = cells.mapInArrow(_by_cell(_linked(threshold), ["u", "v", "similarity"], [pa.int64(), pa.int64(), pa.float64()]), "u long, v long, similarity double")
        found = materialize(found, "links")
        if not found.isEmpty():
            labels = components(found if links is None else links.unionByName(found))
    return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``df``: long ``k`` (its key, NULL_KEY for null), long ``class`` (the smallest key of its class), long ``label`` (the class's own: keys may be null or shared by several classes), ``kept`` (true for one row of each class)."""
    rows, classes, _ = _classes(df, key, text, threshold)
    return rows.join(classes, "u").select("k", F.col("stays.k").alias("class"), "label", (F.col("r") == F.col("stays.r")).alias("kept"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` but one document of each class stays, the one with the smallest key."""
    _, classes, salt = _classes(df, key, text, threshold)
    kept = materialize(classes.where("u = stays.u").select("stays.k", "u", "stays.n"), "kept")
    names = [f"c{i}" for i in range(len(df.columns))]  # no name of the input can clash
    own, words = names[df.columns.index(key)], names[df.columns.index(text)]
    rows = df.toDF(*names).withColumn("k", _id(F.col(own))).withColumn("u", _name(F.col(words), salt))
    stay = rows.join(kept, ["k", "u"])
    if not kept.where("n > 1").isEmpty():  # repeated rows
        stay = stay.dropDuplicates(["k", "u"])
    return stay.select(*names).toDF(*df.columns)


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, by its smallest id and by a label of its own, and whether it is the one of its class that stays."""
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    own = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return classes.select(own("k").alias("doc_id"), own("class").alias("class_id"), "kept", F.col("label").alias("class_label"))
