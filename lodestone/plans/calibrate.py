"""The calibration report of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import ProjectConfig
from lodestone.functions.text import chunk_literals
from lodestone.operators.calibration import format_report, import_target_counts, summarized
from lodestone.operators.retrieval import literal_counts
from lodestone.store import Index

#: Fixed defaults: distinct literals in the sample, literals taken of a chunk.
SAMPLE, EACH = 500, 8


def report(index: Index, config: ProjectConfig, sample: int = SAMPLE) -> str:
    """Both distributions.

    Literals are sampled chunk by chunk, in the order of files and lines, until there
    are ``sample`` different ones: all of the last chunk's count.
    """
    tables = index.open(config)
    chunks = tables["chunks"]
    found = chunks.select("file_path", "start_line", F.posexplode(chunk_literals(F.col("text"), EACH)).alias("pos", "literal"))
    first = found.groupBy("literal").agg(F.min(F.struct("file_path", "start_line", "pos")).alias("at"))
    place = F.struct("at.file_path", "at.start_line")
    last = first.orderBy("at").limit(sample).agg(F.max(place).alias("last"))
    literals = first.join(F.broadcast(last), place <= F.col("last")).select("literal")
    counts = [(r.literal, r.n) for r in literal_counts(chunks, literals).orderBy(F.desc("n"), "literal").collect()]
    targets = import_target_counts(tables["imports"]).persist()
    try:
        imports = summarized(targets, "target_file", config.import_noise_threshold)
    finally:
        targets.unpersist()
    return format_report(counts, imports, config.literal_noise_threshold, config.import_noise_threshold)
