"""Source files to chunks: the Spark side of the chunkers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import scan_braces, scan_python
from lodestone.sources.items import Chunk, chunks

LANGUAGES = {
    ".py": "python",
    **dict.fromkeys((".js", ".jsx", ".ts", ".tsx"), scan_braces.JS),
    ".rs": scan_braces.RUST,
    ".c": scan_braces.C,
    **dict.fromkeys((".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"), scan_braces.CPP),
}


def chunk_text(path: str, text: str) -> list[Chunk]:
    """The chunks of one file; ValueError for an extension no scanner knows."""
    m = re.search(r"([^/]+?)(\.[^./]+)?$", path)
    stem, suffix = m[1], (m[2] or "").lower()
    language = LANGUAGES.get(suffix)
    if language is None:
        raise ValueError(f"unsupported file extension: {suffix or path}")
    text = text.removeprefix("\ufeff")
    if language == "python":
        text = text.replace("\r\n", "\n")
        return chunks(text, scan_python.items_of(text), stem)
    scanned, items = scan_braces.items_of(text, language)
    return chunks(scanned, items, stem)


@F.udtf(returnType="start_line int, end_line int, node_type string, name string, text string, chunk_source_kind string, error string")
class SourceChunks:
    """The chunks of one file, or one row with the error that kept it from being read."""

    def eval(self, path: str, content: str):
        try:
            found = chunk_text(path, content or "")
        except Exception as e:  # noqa: BLE001 - one bad file must not end the run
            yield None, None, None, None, None, None, repr(e)
            return
        for c in found:
            yield c.start_line, c.end_line, c.node_type, c.name, c.text, c.chunk_source_kind, None


def with_source_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk columns, error) for files of (path, content)."""
    return files.select("path", "content").lateralJoin(SourceChunks(F.col("path").outer(), F.col("content").outer())).drop("content")
