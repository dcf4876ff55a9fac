"""Scanning a source tree into a table of files.

Spark's own readers pass over names with a leading underscore, such as
``__init__.py``, and can't leave whole directories out.  So the tree is listed
by tasks that walk a directory each, and what is kept of it is read by others.
The driver only looks for directories to deal out, a bounded number of them.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import EXCLUDED_DIRS, EXTENSIONS, MAX_FILE_BYTES, is_source

#: Directories that are never entered: a repository's own records, and the index.
UNSEEN = frozenset({".git", ".lodestone"})
#: Directories that are dealt out to tasks; bytes of files read by one task, and by one batch of it.
FOLDERS, TASK_BYTES, BATCH_BYTES = 256, 64 << 20, 8 << 20
#: Bytes of the largest file that is read if it is asked for by name.
LARGEST = 1 << 31


def _opened(uri: str) -> tuple[arrow_fs.FileSystem | None, str]:
    """The file system and the folder of a URI; None stands for the machine's own or a mounted one."""
    if uri.startswith("file:"):
        return None, "/" + uri.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _children(fs: arrow_fs.FileSystem | None, folder: str) -> Iterator[tuple[str, int]]:
    """Names and sizes in a folder, -1 for a folder; none if it can't be read.  Links to folders aren't followed, and names that are no text left out."""
    if fs is not None:
        for x in fs.get_file_info(arrow_fs.FileSelector(folder)):
            if x.type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory):
                yield x.base_name, x.size if x.type == arrow_fs.FileType.File else -1
        return
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return
    for x in entries:
        try:
            x.name.encode()
            if x.is_dir(follow_symlinks=False):
                yield x.name, -1
            elif x.is_file():
                yield x.name, x.stat().st_size
        except (OSError, UnicodeEncodeError):
            continue


def _below(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def _dealt(uri: str, pruned: Collection[str]) -> list[tuple[str, bool]]:
    """Folders that together hold the tree: those to be listed alone, and those to be walked whole."""
    fs, base = _opened(uri)
    alone, whole = [], deque([""])
    while whole and len(whole) < FOLDERS and len(alone) < FOLDERS:
        folder = whole.popleft()
        alone.append(folder)
        whole.extend(_below(folder, n) for n, size in _children(fs, _below(base, folder)) if size < 0 and n not in pruned)
    return [(f, False) for f in alone] + [(f, True) for f in whole]


def _walked(uri: str, pruned: Collection[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(uri)
        for batch in batches:
            for start, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                todo = [start]
                while todo:
                    folder = todo.pop()
                    found = list(_children(fs, _below(base, folder)))
                    files = [(_below(folder, n), size) for n, size in found if size >= 0]
                    if whole:
                        todo += [_below(folder, n) for n, size in found if size < 0 and n not in pruned]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in files], pa.string()), pa.array([s for _, s in files], pa.int64())], names=["path", "length"])

    return run


def _contents(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(uri)

        def read(path: str) -> bytes:
            if fs is None:
                with open(_below(base, path), "rb") as f:
                    return f.read()
            with fs.open_input_stream(_below(base, path)) as f:
                return f.read()

        rows: list[tuple[str, int, bytes]] = []

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "length", "content"])

        size = 0
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and size + length > BATCH_BYTES:
                    yield made()
                    rows, size = [], 0
                try:
                    rows.append((path, length, read(path)))
                except FileNotFoundError:  # gone since it was listed
                    continue
                size += length
        if rows:
            yield made()

    return run


def _uri(spark: SparkSession, root: str) -> str:
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        raise FileNotFoundError(root)
    return fs.makeQualified(top).toString().rstrip("/")


def list_files(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, pruned: Collection[str] = ()) -> DataFrame:
    """(path, length) of all files under ``root`` of at most ``max_bytes``, paths relative to it; directories named in ``pruned`` aren't entered."""
    uri, unseen = _uri(spark, root), frozenset(pruned) | UNSEEN
    folders = _dealt(uri, unseen)
    dealt = spark.createDataFrame(folders, "folder string, whole boolean").repartition(min(len(folders), 2 * spark.sparkContext.defaultParallelism), "folder")
    return dealt.mapInArrow(_walked(uri, unseen), "path string, length long").where(F.col("length") <= max_bytes)


def with_content(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, length, content) of listed files (path, length)."""
    size = files.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // BATCH_BYTES), -(-size // TASK_BYTES))
    return files.select("path", "length").repartition(tasks, "path").mapInArrow(_contents(_uri(spark, root)), "path string, length long, content binary")


def scan_tree(spark: SparkSession, root: str, extra_excluded: Sequence[str] = (), forced: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS, max_bytes: int = MAX_FILE_BYTES, also: Column | None = None) -> DataFrame:
    """(path, content, content_hash) of the source files under ``root``, and of those up to LARGEST that ``also``, a condition on the path, names; paths are relative to it.

    Excluded directories are never entered, and other files never read.
    """
    pruned = (EXCLUDED_DIRS | {e for e in extra_excluded if "/" not in e}) - set(forced)
    files = list_files(spark, root, max_bytes if also is None else LARGEST, pruned)
    wanted = is_source(F.col("path"), F.col("length"), extra_excluded, forced, extensions, max_bytes)
    kept = with_content(spark, root, files.where(wanted if also is None else wanted | also))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"))


def write_files(files: DataFrame, root: str) -> int:
    """Writes (path, content) rows as files under ``root``, which may be new, by the tasks that have them; null content takes a file away.  Returns their number."""
    spark = files.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(uri)
        fs = fs or arrow_fs.LocalFileSystem()
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = _below(base, path)
                if content is not None:
                    fs.create_dir(whole.rpartition("/")[0], recursive=True)
                    with fs.open_output_stream(whole) as out:
                        out.write(content.encode())
                elif fs.get_file_info(whole).type == arrow_fs.FileType.File:
                    fs.delete_file(whole)
            yield batch.select([0])

    return files.select("path", "content").mapInArrow(run, "path string").count()
