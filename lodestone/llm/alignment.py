"""Alignment of the tokens that two tokenizers make of the same texts.

Both token sequences cut one byte string.  The union of their end offsets cuts
it into elementary intervals; ``searchsorted`` finds the token of either side
that owns an interval, so each interval is one overlap of two tokens.  Offsets
where both sides end close a group, and within a group every token of one side
is linked with every token of the other.

A text falls apart before every space that follows a character other than white
space: neither the byte-level pattern of the first tokenizer nor the word
markers of the second join what stands on both sides of such a place.  So the
arithmetic runs once over the distinct chunks of a task, all new ones at a time,
and a document is the sequence of its chunks.  Repeated ids of a group are
counted before the group's product is expanded, so a long group costs what its
distinct ids do.

How many documents of the corpus hold a pair of linked ids is counted by blocks
of documents: a block lists each of its pairs once with its number of
documents, the lists are summed by pair, and the sums come back to the blocks by
a join on the pair.  What is shuffled is pairs by block, not pairs by document;
no pair has more than one row in a block, no first id more pairs than the second
vocabulary has ids.

Cases: null and empty texts, and texts that either side doesn't give back byte
for byte, have no tokens: zeros, and an empty string instead of a digest.  The
strings of special tokens are plain text.  A very long text is a block of its
own.  Equal rows are separate documents.  An empty table gives an empty result.
All columns but the text stay as they are; new columns take free names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import drop, fresh, materialize, sliced, table, tokenizer_path
from lodestone.llm.pieces import MARK, MODEL, processor

#: The byte-level vocabulary, as .json and as .tiktoken: the ranks of the second are the tokens and merges of the first and give the same ids faster.
FIRST_MODEL = "byte_bpe_50k"
#: Aligned chunks from which a task starts anew.
TABLE_ROWS = 200_000
#: Characters of the new chunks that are encoded as one text.
PIECE_CHARS = 8 << 10
#: Bytes of text from which a block of documents is full.
BLOCK_BYTES = 2 << 20
#: Blocks of a file: a writer holds a file's last rows, and a reader decodes up to thousands of rows at once, whatever their size.
FILE_BLOCKS = 4

#: Runs of white space so long are left to the .json: the pattern engine of the other gives up on longer ones.
_LONG_SPACE = re.compile(r"\s{300}")
_CHUNK_START = re.compile(r"(?<=\S)(?= )")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Sides:
    """Both tokenizers of a worker with the bytes of every id."""

    def __init__(self, first: str, second: str) -> None:
        import public_tokenizers
        import tiktoken

        self.first, self.exact = first, None
        with open(f"{first}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, at in ranks.items():
            self.a_bytes[at] = token
        self.b = processor(second)
        self.mark_id = self.b.piece_to_id(MARK)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts, each of which begins with a space."""
        a = [self._exact(t) if _LONG_SPACE.search(t) else self.a.encode_ordinary(t) for t in texts]
        return a, [ids or [self.mark_id] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _exact(self, text: str) -> list[int]:
        if self.exact is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(f"{self.first}.json")
            self.exact.encode_special_tokens = True
        return self.exact.encode(text, add_special_tokens=False).ids

    def faithful(self, chunk: str, a: list[int], b: list[int]) -> bool:
        raw = chunk.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw


def chunks_of(text: str) -> list[str]:
    """``text`` behind a space, cut where neither tokenizer joins."""
    return _CHUNK_START.split(" " + text)


def elementary(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals of two token sequences over the same bytes, the token of either side that owns each, and the group of each."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # union1d of two sorted arrays
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])]
    a_owner, b_owner = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    closes = (a_ends[a_owner] == ends) & (b_ends[b_owner] == ends)
    return ends, a_owner, b_owner, np.cumsum(closes) - closes


def _counted(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group with their numbers, ordered by group."""
    keys, times = np.unique((groups << 32) | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, times


def products(a_groups: np.ndarray, a_ids: np.ndarray, b_groups: np.ndarray, b_ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct pair of ids that share a group: its group, the pair (first id in the upper 32 bits) and the links it stands for."""
    ag, ai, an = _counted(a_groups, a_ids)
    bg, bi, bn = _counted(b_groups, b_ids)
    per = np.bincount(bg, minlength=groups)
    starts, times = np.cumsum(per) - per, per[ag]
    at = np.repeat(np.arange(len(ag)), times)
    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + starts[ag][at]
    return ag[at], (ai[at] << 32) | bi[other], an[at] * bn[other]


class Aligner:
    """Aligned chunks of a task, numbered: for each its groups as text, its four counts, its pairs and their links.

    Chunks whose bytes differ are ``bad`` and have none of it.
    """

    def __init__(self, sides: Sides) -> None:
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.bad: set[int] = set()
        self._parts: list[tuple[np.ndarray, ...]] = []

    def full(self) -> bool:
        return len(self.texts) > TABLE_ROWS

    def add(self, chunks: set[str]) -> None:
        """Aligns those that are new, many of them encoded as one text: no token reaches over their ends."""
        new = [c for c in chunks if c not in self.number]
        if new:
            for piece, a, b in self._encoded(new):
                self._cut(piece, a, b)

    def columns(self) -> tuple[np.ndarray, ...]:
        """Of all chunks by number: counts (n_a, n_b, n_groups, n_links) and numbers of pairs; then all their pairs and links in order."""
        if len(self._parts) > 1:
            self._parts = [tuple(np.concatenate(x) for x in zip(*self._parts, strict=True))]
        return self._parts[0] if self._parts else (np.zeros((0, 4), np.int64), *[np.zeros(0, np.int64)] * 3)

    def _encoded(self, chunks: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Lists of chunks with their ids; chunks whose bytes don't come back are put among the bad."""
        pieces: list[list[str]] = []
        size = PIECE_CHARS
        for c in chunks:
            # what ends in white space is another thing before another chunk
            if c[-1].isspace():
                pieces.insert(0, [c])
                continue
            if size >= PIECE_CHARS:
                pieces.append([])
                size = 0
            pieces[-1].append(c)
            size += len(c)
        while pieces:
            again, good = [], ([], [], [])
            texts = ["".join(p) for p in pieces]
            for piece, text, a, b in zip(pieces, texts, *self.sides.encode(texts), strict=True):
                if self.sides.faithful(text, a, b):
                    for into, what in zip(good, (piece, a, b), strict=True):
                        into += what
                elif len(piece) > 1:
                    again += [[c] for c in piece]
                else:
                    self.bad.add(len(self.texts))
                    self.number[piece[0]] = len(self.texts)
                    self.texts.append("")
                    self._parts.append((np.zeros((1, 4), np.int64), *(np.zeros(n, np.int64) for n in (1, 0, 0))))
            if good[0]:
                yield good
            pieces = again

    def _cut(self, chunks: list[str], a: list[int], b: list[int]) -> None:
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.sides.a_size[a_ids]), np.cumsum(self.sides.b_size[b_ids])
        ends, _, _, group = elementary(a_ends, b_ends)
        a_groups, b_groups = group[np.searchsorted(ends, a_ends)], group[np.searchsorted(ends, b_ends)]
        total = int(group[-1]) + 1
        pair_group, pairs, links = products(a_groups, a_ids, b_groups, b_ids, total)

        # a chunk ends where both sides do, so its groups are the next ones
        stops = np.cumsum([len(c.encode()) for c in chunks])
        last = group[np.searchsorted(ends, stops)] + 1
        pair_to = np.searchsorted(pair_group, last)
        link_sums = np.concatenate([[0], np.cumsum(links)])[pair_to]
        counts = [np.diff(x, prepend=0) for x in (np.searchsorted(a_ends, stops) + 1, np.searchsorted(b_ends, stops) + 1, last, link_sums)]
        self._parts.append((np.stack(counts, 1), np.diff(pair_to, prepend=0), pairs, links))
        texts = [f"{x}|{y}" for x, y in zip(_by_group(self.sides.a_text, a, a_groups, total), _by_group(self.sides.b_text, b, b_groups, total), strict=True)]
        self.number.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks)), strict=True))
        cuts = last.tolist()
        self.texts += [texts[x] if y == x + 1 else ";".join(texts[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)]


def _by_group(names: list[str], ids: list[int], of: np.ndarray, groups: int) -> list[str]:
    """The ids of every group, joined by commas."""
    text, cuts = [names[i] for i in ids], np.searchsorted(of, np.arange(groups + 1)).tolist()
    return [text[x] if y == x + 1 else ",".join(text[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


class Block:
    """Documents of a task whose pairs are counted together."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.size, self.records, self.hashes = aligner, 0, [], []
        self.chunks: list[np.ndarray] = []

    def add(self, cut: list[list[str]]) -> None:
        """Documents as lists of chunks that the aligner has."""
        number, texts, bad = self.aligner.number, self.aligner.texts, self.aligner.bad
        for chunks in cut:
            at = [number[c] for c in chunks]
            if bad and not bad.isdisjoint(at):
                at = []
            self.hashes.append(hashlib.sha256(";".join([texts[i] for i in at]).encode()).hexdigest() if at else "")
            self.chunks.append(np.array(at, np.int32))

    def row(self, number: int, names: list[str]) -> pa.RecordBatch:
        """The block as one row: documents, what they count, and the pairs with their documents."""
        all_counts, all_sizes, all_pairs, all_links = self.aligner.columns()
        words = np.array([len(x) for x in self.chunks], np.int64)
        keys = np.sort(np.repeat(np.arange(len(words)), words) * max(len(all_sizes), 1) + np.concatenate(self.chunks))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times, keys = np.diff(np.append(first, len(keys))), keys[first]
        doc_of, held = keys // max(len(all_sizes), 1), keys % max(len(all_sizes), 1)
        per_doc = np.bincount(doc_of, minlength=len(words))
        # the block's own chunks, numbered anew
        used = np.zeros(len(all_sizes), bool)
        used[held] = True
        own, chunk = np.flatnonzero(used), (np.cumsum(used) - 1)[held]
        counts, per_chunk = all_counts[own], all_sizes[own]
        sums = [np.bincount(doc_of, weights=counts[chunk, k] * times, minlength=len(per_doc)).astype(np.int64) for k in range(4)]
        where = _ranges((np.cumsum(all_sizes) - all_sizes)[own], per_chunk)
        links = all_links[where]
        pairs, pair_at = np.unique(all_pairs[where], return_inverse=True)
        docs = _documents(doc_of, chunk, per_chunk, pair_at, len(pairs))
        structs = [pa.StructArray.from_arrays(r.columns, names=names) if names else _fillers(r.num_rows) for r in self.records]
        lists = [pa.concat_arrays(structs), pa.array(self.hashes), *map(pa.array, sums), pa.array(pairs), pa.array(docs)]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        raws = [x.astype(np.int32).tobytes() for x in (per_doc, chunk, times, per_chunk, pair_at, links)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays, *[pa.array([x], pa.binary()) for x in raws]], names=_BLOCK)


def _fillers(rows: int) -> pa.StructArray:
    """Stands for the other columns where there are none: Parquet has no empty structs."""
    return pa.StructArray.from_arrays([pa.nulls(rows, pa.bool_())], names=["_"])


_BLOCK = ["block", "docs", "hashes", "n_a", "n_b", "n_groups", "n_links", "pairs", "pair_docs", "per_doc", "chunk", "times", "per_chunk", "pair_at", "links"]
#: (document, pair) keys that are made distinct at a time.
_AT_ONCE = 4_000_000


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _documents(doc_of: np.ndarray, chunk: np.ndarray, per_chunk: np.ndarray, pair_at: np.ndarray, pairs: int) -> np.ndarray:
    """In how many documents each pair of a block stands."""
    out = np.zeros(pairs, np.int64)
    starts, size = np.cumsum(per_chunk) - per_chunk, per_chunk[chunk]
    cuts = np.flatnonzero(np.diff(doc_of, prepend=-1))
    done = np.cumsum(size) - size
    begin = 0
    for at in [*range(1, len(cuts)), len(cuts)]:
        stop = cuts[at] if at < len(cuts) else len(chunk)
        if at < len(cuts) and done[stop] - done[begin] < _AT_ONCE:
            continue
        n = size[begin:stop]
        keys = np.sort(np.repeat(doc_of[begin:stop], n) * pairs + pair_at[_ranges(starts[chunk[begin:stop]], n)])
        keys = keys[np.concatenate([keys[1:] != keys[:-1], [True]])] if len(keys) else keys
        out += np.bincount(keys % pairs, minlength=pairs)
        begin = stop
    return out


def _blocks(df: DataFrame, text: str, first: str | None, second: str | None) -> DataFrame:
    """One row for each block of documents, see ``Block.row``."""
    at = df.columns.index(text)
    names = [c for c in df.columns if c != text]
    fields = [f for f in df.schema.fields if f.name != text]
    spark_docs = T.ArrayType(T.StructType(fields or [T.StructField("_", T.BooleanType())]))
    longs, raw = T.ArrayType(T.LongType()), T.BinaryType()
    kinds = [T.LongType(), spark_docs, T.ArrayType(T.StringType()), *[longs] * 6, *[raw] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Sides(first or tokenizer_path(FIRST_MODEL), second or tokenizer_path(MODEL)))
        base, made, block = TaskContext.get().partitionId() << 33, 0, Block(aligner)
        for batch in sliced(batches, at, BLOCK_BYTES // 2):
            cut = [chunks_of(t) if t else [] for t in batch.column(at).to_pylist()]
            aligner.add({c for cs in cut for c in cs})
            block.add(cut)
            block.size += batch.column(at).nbytes
            block.records.append(batch.select([c for c in range(batch.num_columns) if c != at]))
            if block.size >= BLOCK_BYTES or aligner.full():
                yield block.row(base + made, names)
                made, block = made + 1, Block(aligner)
                if aligner.full():
                    aligner.clear()
        if block.records:
            yield block.row(base + made, names)

    return df.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(_BLOCK, kinds, strict=True)]))


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """Every pair of every block: block, place, pair and its documents in the block."""
    return blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.pair_docs").alias("docs"))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair").agg(F.sum("docs").alias("documents"))


def pair_counts(df: DataFrame, text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """In how many documents each pair of ids is linked: a_id, b_id, documents."""
    totals = _totals(_pair_rows(_blocks(df, text, first, second)))
    return totals.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "documents")


def align_texts(df: DataFrame, text: str = "text", first: str | None = None, second: str | None = None, out: str = "groups") -> DataFrame:
    """``df`` with ``out``: the aligned groups of ``text`` behind a space, as array<struct<end,a,b>> of the end offset in bytes and both sides' ids."""
    at = df.columns.index(text)
    (out,) = fresh(df, out)
    ids = T.ArrayType(T.IntegerType())
    kind = T.ArrayType(T.StructType([T.StructField("end", T.LongType()), T.StructField("a", ids), T.StructField("b", ids)]))
    arrow = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(first or tokenizer_path(FIRST_MODEL), second or tokenizer_path(MODEL))
        aligner = Aligner(sides)
        for batch in sliced(batches, at):
            cut = [chunks_of(t) if t else [] for t in batch.column(at).to_pylist()]
            if aligner.full():
                aligner.clear()
            aligner.add({c for cs in cut for c in cs})
            made = []
            for cs in cut:
                groups, end, numbers = [], 0, [aligner.number[c] for c in cs]
                for i in numbers if aligner.bad.isdisjoint(numbers) else []:
                    for group in aligner.texts[i].split(";"):
                        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                        end += sum(len(sides.a_bytes[i]) for i in a)
                        groups.append({"end": end, "a": a, "b": b})
                made.append(groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


_RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def link_statistics(df: DataFrame, text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with what its alignment counts.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links`` of the document, ``n_best`` links
    whose pair stands in as many documents as any pair of its first id does,
    ``count_sum`` of the documents of all links' pairs, and ``groups_sha256``.
    The blocks are written to the shared folder, and so is the result, so that
    blocks go to the workers in bounded batches.
    """
    blocks = materialize(_blocks(df, text, first, second), "aligned-blocks", FILE_BLOCKS)
    rows = _pair_rows(blocks)
    totals = _totals(rows).withColumn("best", F.col("documents") == F.max("documents").over(W.partitionBy(F.shiftright("pair", 32))))
    looked_up = rows.join(totals, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "documents", "best")).alias("found"))
    kept = df.drop(text)
    names = fresh(kept, *_RESULTS)
    fields = [T.StructField(n, T.LongType()) for n in names[:-1]] + [T.StructField(names[-1], T.StringType())]
    columns = [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _finished(batch.slice(at, 1), columns)

    done = materialize(blocks.join(looked_up, "block", "left").mapInArrow(run, T.StructType([*kept.schema.fields, *fields])), "aligned")
    drop(blocks)
    return done


def _finished(block: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """The documents of a block, whose pairs have been looked up, with their other columns and _RESULTS by ``names``."""
    flat = {c: block.column(c).flatten() for c in _BLOCK[1:9]}
    per_doc, chunk, times, per_chunk, pair_at, links = (np.frombuffer(block.column(c)[0].as_py(), np.int32).astype(np.int64) for c in _BLOCK[9:])
    count, best = np.zeros(len(flat["pairs"]), np.int64), np.zeros(len(flat["pairs"]), np.int64)
    found = block.column("found").flatten()
    if len(found):
        place = found.field("place").to_numpy(zero_copy_only=False)
        count[place] = found.field("documents").to_numpy(zero_copy_only=False)
        best[place] = found.field("best").to_numpy(zero_copy_only=False)
    sums = []
    for value in (best, count):
        chunk_sum = _by_owner(value[pair_at] * links, per_chunk)
        sums.append(pa.array(_by_owner(chunk_sum[chunk] * times, per_doc)))
    others = flat["docs"].flatten()[: len(names) - len(_RESULTS)]
    return pa.RecordBatch.from_arrays([*others, *[flat[c] for c in _BLOCK[3:7]], *sums, flat["hashes"]], names=names)


def _by_owner(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``per`` of them for each owner."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per)
    return upto[ends] - upto[ends - per]


def op11_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned between the byte-level and the piece vocabulary."""
    return link_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
