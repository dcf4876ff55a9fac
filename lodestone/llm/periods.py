"""Periodic runs of words: stretches that repeat a shorter stretch.

The words of a text become numbers, and the array of numbers is compared with
itself at every lag q up to n / min_exp.  Stretches of equal words at lag q that
are long enough for ``min_exp`` repetitions and ``min_length`` words are runs.  A
stretch of m or more equal words meets three places in a row that are m // 4
apart, so a lag is compared at such places first and word by word around those
that agree; no run is lost by it, and all lags together cost about n log n
comparisons instead of n squared.  The texts of a block are scanned as one array,
longest first, with numbers between them that equal nothing.

Two lags give the same stretch only if one divides the other: the smallest is the
period.

A text with more lags than ``range_lags`` is dealt out as several (text, range of
lags) rows over the cluster; what they find is joined by text, so one very long
text is not one task's.  The ranges follow from the text's number of words alone.

Cases: null, empty and blank texts have no words and no runs; repeated rows, and
rows that share an id, keep their own results; an empty table gives an empty
result; all columns stay, new ones take free names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, let, materialize, sliced, table

WORD = r"[^\x20\x09-\x0D]+"
#: Lags of one text that one row scans; a text with more of them is dealt out.
RANGE_LAGS = 100_000
_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def scan_lags(words: np.ndarray, lengths: np.ndarray, low: int, high: int | None, min_length: int, min_exp: int) -> np.ndarray:
    """Stretches (start, end, lag) of texts that lie one behind the other in ``words``, longest first, for lags from ``low`` up to but not ``high`` (None: all).

    ``lengths`` are the texts' words; each text is followed by one number that
    stands nowhere else.
    """
    found, ends = [], np.cumsum(lengths + 1)
    for lag in range(low, high) if high else itertools.count(low):
        texts = int(np.searchsorted(-lengths, -max(min_exp * lag, min_length), side="right"))
        if not texts:
            break
        least = max((min_exp - 1) * lag, min_length - lag)
        size = int(ends[texts - 1]) - lag
        step = max(1, least // 4)
        row = min(3, least // step)
        agree = words[:size:step] == words[lag : size + lag : step]
        hit = np.flatnonzero(np.logical_and.reduce([agree[k : len(agree) - row + 1 + k] for k in range(row)]))
        if len(hit):
            found.extend(_stretches(words, hit, step, row, size, lag, least))
    return np.array(found, np.int64).reshape(-1, 3)


def _stretches(words: np.ndarray, hit: np.ndarray, step: int, row: int, size: int, lag: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of ``least`` or more equal words around ``row`` places from a ``hit`` on, ``step`` apart, that agree."""
    cuts = np.flatnonzero(np.diff(hit) > 1)
    for first, last in zip(hit[np.concatenate([[0], cuts + 1])].tolist(), hit[np.concatenate([cuts, [len(hit) - 1]])].tolist(), strict=True):
        begin, stop = max(0, (first - 1) * step), min(size, (last + row) * step + 1)
        equal = np.concatenate([[False], words[begin:stop] == words[begin + lag : stop + lag], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                yield begin + a, begin + b + lag, lag


def smallest_periods(stretches: np.ndarray) -> np.ndarray:
    """Each (start, end) once, with its smallest lag, by start and period."""
    if not len(stretches):
        return stretches
    s = stretches[np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))]
    s = s[np.concatenate([[True], np.any(s[1:, :2] != s[:-1, :2], axis=1)])]
    return s[np.lexsort((s[:, 2], s[:, 0]))]


def runs_of(texts: list[list[bytes]], ranges: list[tuple[int, int | None]], min_length: int, min_exp: int) -> list[np.ndarray]:
    """The runs (start, end, period) of each text's words, for lags in its range."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    for low, high in set(ranges):
        chosen = sorted((i for i, r in enumerate(ranges) if r == (low, high)), key=lambda i: -len(texts[i]))
        ids: dict[bytes, int] = {}
        numbers: list[int] = []
        for at, i in enumerate(chosen):
            numbers.extend([ids.setdefault(w, len(ids)) for w in texts[i]])
            numbers.append(-1 - at)
        lengths = np.array([len(texts[i]) for i in chosen], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        runs = scan_lags(np.array(numbers, np.int32), lengths, low, high, min_length, min_exp)
        owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(chosen) + 1))
        for at, i in enumerate(chosen):
            own = runs[order[cuts[at] : cuts[at + 1]]]
            out[i] = smallest_periods(own - [starts[at], starts[at], 0])
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """``words`` without those that any run repeats, joined by one space."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words)


def _runs_array(found: list[np.ndarray]) -> pa.Array:
    """Runs as lists of (start, length, period)."""
    flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(_ARROW_RUNS.value_type))
    return pa.ListArray.from_arrays(offsets, values)


def _words(column: pa.Array) -> list[list[bytes]]:
    """Words by ASCII white space, which is what ``bytes.split`` parts at."""
    return [(t or "").encode().split() for t in column.to_pylist()]


def _collapsed(words: list[list[bytes]], runs: list[np.ndarray]) -> pa.Array:
    return pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())


def _scanned(df: DataFrame, text: str, min_length: int, min_exp: int, names: list[str]) -> DataFrame:
    """Runs and what is left of texts that are scanned whole."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            words = _words(batch.column(at))
            runs = runs_of(words, [(1, None)] * len(words), min_length, min_exp)
            yield pa.RecordBatch.from_arrays([*batch.columns, _runs_array(runs), _collapsed(words, runs)], names=[*batch.schema.names, *names])

    fields = [T.StructField(names[0], _RUNS), T.StructField(names[1], T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def _in_ranges(df: DataFrame, text: str, lags: str, range_lags: int, min_length: int, min_exp: int, names: list[str]) -> DataFrame:
    """The same for texts whose lags are dealt out; ``lags`` is their number."""
    spark = df.sparkSession
    key, low, runs_name, left_name = fresh(df, "key", "low", "runs", "left")
    keyed = df.withColumn(key, F.sha2(F.col(text), 256))
    dealt = keyed.select(key, text, lags).dropDuplicates([key]).select(key, text, lags, F.explode(F.sequence(F.lit(1).cast("long"), F.col(lags), F.lit(range_lags).cast("long"))).alias(low))
    dealt = dealt.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), key, low).select(key, text, low, lags)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            lows, tops = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ranges = [(a, min(a + range_lags, top + 1)) for a, top in zip(lows, tops, strict=True)]
            runs = runs_of(_words(batch.column(1)), ranges, min_length, min_exp)
            yield pa.RecordBatch.from_arrays([batch.column(0), _runs_array(runs)], names=["key", "runs"])

    found = dealt.mapInArrow(scan, T.StructType([T.StructField("key", T.StringType()), T.StructField("runs", _RUNS)]))
    found = materialize(found, "periodic-runs").select(F.col("key").alias(key), F.inline("runs"))
    found = found.groupBy(key, "start", "length").agg(F.min("period").alias("period"))
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias(runs_name))
    joined = keyed.join(found, key, "left").drop(key, lags)
    at, seen = joined.columns.index(text), joined.columns.index(runs_name)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            words = _words(batch.column(at))
            runs = [np.array([[r["start"], r["start"] + r["length"], r["period"]] for r in rs or []], np.int64).reshape(-1, 3) for rs in batch.column(seen).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != seen]
            yield pa.RecordBatch.from_arrays([*columns, _runs_array(runs), _collapsed(words, runs)], names=[*[c for c in batch.schema.names if c != runs_name], *names])

    fields = [f for f in joined.schema.fields if f.name != runs_name] + [T.StructField(names[0], _RUNS), T.StructField(names[1], T.StringType())]
    return joined.mapInArrow(finish, T.StructType(fields))


def periodic_runs(df: DataFrame, text: str = "text", min_length: int = 12, min_exp: int = 2, range_lags: int = RANGE_LAGS) -> DataFrame:
    """``df`` with its runs and its texts without the repetitions.

    Adds ``runs``, array<struct<start,length,period>> in words by start, then
    period, and ``collapsed``, the words that stand in no run behind its first
    period, joined by one space.
    """
    names = fresh(df, "runs", "collapsed")
    (lags,) = fresh(df, "lags")
    # a word and its gap take two bytes, so shorter texts need not be counted
    words = F.when(F.octet_length(text) >= 2 * min_exp * range_lags - 1, F.regexp_count(F.col(text), F.lit(WORD))).otherwise(F.lit(0))
    counted = df.withColumn(lags, F.floor(F.coalesce(words, F.lit(0)) / min_exp).cast("long"))
    whole = _scanned(counted.where(F.col(lags) <= range_lags).drop(lags), text, min_length, min_exp, names)
    return whole.unionByName(_in_ranges(counted.where(F.col(lags) > range_lags), text, lags, range_lags, min_length, min_exp, names))


def planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` in which every tenth text, by the checksum of its id, repeats one of its stretches to its end.

    With h the CRC-32 of the decimal id and g = h div 10: where h is divisible by
    10 and the text has n > 0 words, word i >= a becomes word a + (i - a) mod p,
    with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  Texts without an id
    stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.nullif(n, F.lit(0).cast("long"))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(F.struct(n.alias("n"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(_source(x), lambda i: F.get(w, i.cast("int"))), " "))

    def _source(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))

    # the words are bound once: named in two places they would be split again for each word
    made = let(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.when(F.size(w) > 0, repeated(w)))
    return df.withColumn(text, F.coalesce(F.when(h % 10 == 0, made), F.col(text)))


def op13_all_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of which get a planted one."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best, line = (F.when(F.size("runs") > 0, x) for x in (best, F.concat(line, F.lit("\n"))))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), F.coalesce(line, F.lit("")).alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
