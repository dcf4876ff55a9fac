"""Following a source tree with state: what was added, changed or deleted since the last listing.

A tick lists the tree by tasks (names with a leading underscore included), hashes
the files and puts the listing into a folder of its own, all at once; the folders
are the stream.  State is kept by path: the hash seen last, and a timer just behind
the tick that has seen it.  A listed path gives a row if it is new or its hash
changed; a path that the next listing doesn't have runs into its timer when the
watermark passes, and gives a deletion.  Files as they are give no row and no work.

A batch of changes that is run again is written once more under its number, so no
row appears twice.  ``compact`` folds batches into one, which stands for all up to
its number from the moment it is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.maintenance import latest_per_key
from lodestone.sources.chunking import with_source_chunks
from lodestone.sources.scan import scan_tree

LISTING = "path string, content string, content_hash string, seconds long, tick timestamp"
CHANGE = "path string, status string, content string, content_hash string, seconds long"
_NAMES = [c.split()[0] for c in CHANGE.split(", ")]


def _fs(spark: SparkSession, path: str):
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    fs, kind = _fs(spark, new)
    fs.mkdirs(kind(new).getParent())
    if not fs.rename(kind(old), kind(new)):
        raise OSError(f"{old} can't become {new}")


def write_listing(spark: SparkSession, root: str, listings: str, seconds: int, extra_excluded: Sequence[str] = (), forced: Sequence[str] = ()) -> None:
    """One tick: the tree as it is now.  ``seconds`` grows from one listing to the next.

    A row without a path says that the listing took place, even of an empty tree.
    """
    found = scan_tree(spark, root, extra_excluded, forced)
    mark = spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in found.columns])
    stamped = found.unionByName(mark).withColumn("seconds", F.lit(seconds).cast("long")).withColumn("tick", F.timestamp_seconds("seconds"))
    staged = f"{listings}/_staged-{uuid.uuid4().hex}"
    stamped.write.parquet(staged)
    # a part of a listing would look as if the rest were deleted
    _renamed(spark, staged, f"{listings}/tick_{seconds:012d}")


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one path in a batch, or its timer."""
    if key[0] is None:
        return
    known = state.get if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], "deleted", None, known[0], known[1] + 1)], columns=_NAMES)
        return
    last = pd.concat(list(parts)).sort_values("seconds").iloc[-1]
    seconds = int(last.seconds)
    if known is None or known[0] != last.content_hash:
        yield pd.DataFrame([(key[0], "new" if known is None else "changed", last.content, last.content_hash, seconds)], columns=_NAMES)
    state.update((last.content_hash, seconds))
    # due when a later listing has moved the watermark
    state.setTimeoutTimestamp(1000 * seconds + 1)


def changes(spark: SparkSession, listings: str) -> DataFrame:
    """The stream of changes of a folder of listings, one row a change; a deletion bears the second behind the last listing that had the file."""
    listed = spark.readStream.schema(LISTING).parquet(f"{listings}/tick_*").withWatermark("tick", "0 seconds")
    return listed.groupBy("path").applyInPandasWithState(_changes, CHANGE, "content_hash string, seconds long", "append", GroupStateTimeout.EventTimeTimeout)


def follow_listings(spark: SparkSession, listings: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the chunks of every change below ``out``, one folder a batch; ``current`` reads what is there.

    With ``once`` the stream ends when it has caught up.
    """

    def write(batch: DataFrame, number: int) -> None:
        # state is advanced once, whatever reads the batch
        held = batch.persist()
        there = held.where("status <> 'deleted'").select("path", "content")
        numbered = lambda df: df.withColumn("batch", F.lit(number).cast("long"))
        numbered(with_source_chunks(there)).write.mode("overwrite").parquet(f"{out}/batch_{number}/chunks")
        # written last: a folder counts when it has this; a file without chunks, or a deleted one, still replaces what was there
        numbered(held.select("path", "status", "seconds")).write.mode("overwrite").parquet(f"{out}/batch_{number}/changes")
        held.unpersist()

    query = changes(spark, listings).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def _folders(spark: SparkSession, out: str) -> tuple[list[str], list[str]]:
    """The folders that count, the one that others were folded into first, and those that no longer do."""
    fs, kind = _fs(spark, out)
    found = [s.getPath() for s in fs.listStatus(kind(out)) if fs.exists(kind(f"{s.getPath()}/changes/_SUCCESS"))] if fs.exists(kind(out)) else []
    number = {p.toString(): int(p.getName().split("_")[1]) for p in found if p.getName().startswith(("batch_", "folded_"))}
    folded = max((p for p in number if "/folded_" in p), key=number.get, default=None)
    later = sorted((p for p in number if "/batch_" in p and (folded is None or number[p] > number[folded])), key=number.get)
    live = ([folded] if folded else []) + later
    return live, [p for p in number if p not in live]


def _last(spark: SparkSession, live: list[str]) -> DataFrame:
    made = spark.read.schema("path string, status string, seconds long, batch long").parquet(*[f"{p}/changes" for p in live])
    return latest_per_key(made, ["path"], ["batch", "seconds"]).where("status <> 'deleted'")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of every file that is there, from its last change."""
    live, _ = _folders(spark, out)
    chunks = spark.read.parquet(*[f"{p}/chunks" for p in live])
    return chunks.join(_last(spark, live).select("path", "batch"), ["path", "batch"], "left_semi")


def compact(spark: SparkSession, out: str) -> None:
    """Folds all batches into one folder.

    It counts when it is renamed; what it stands for then goes, and doesn't count
    if that is not reached, nor if a batch that was folded is run again.
    """
    live, _ = _folders(spark, out)
    if not live:
        return
    staged, last = f"{out}/_staged-{uuid.uuid4().hex}", live[-1].rsplit("_", 1)[1]
    current(spark, out).write.parquet(f"{staged}/chunks")
    _last(spark, live).write.parquet(f"{staged}/changes")
    if f"/folded_{last}" not in live[-1]:
        _renamed(spark, staged, f"{out}/folded_{last}")
    fs, kind = _fs(spark, out)
    fs.delete(kind(staged), True)
    for old in _folders(spark, out)[1]:
        fs.delete(kind(old), True)
