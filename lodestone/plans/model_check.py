"""Trying an embedding model: how it ranks chunks of a project's own files for one question in two wordings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import HASH_MODEL, embed, load_embedder, prefixes
from lodestone.operators.retrieval import RANKED, similarity_ranking
from lodestone.sources.chunking import with_source_chunks
from lodestone.sources.scan import LARGEST, list_files, with_content


def ranked_chunks(spark: SparkSession, root: str, files: Sequence[str], questions: Sequence[str], model: str = HASH_MODEL, top: int = RANKED, load: Callable = load_embedder) -> DataFrame:
    """(question, rank, similarity, node_type, name, file_path): the ``top`` chunks of some files under ``root`` for each question, by its number."""
    named = list_files(spark, root, LARGEST).where(F.col("path").isin(list(files)))
    content = with_content(spark, root, named).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    chunks = with_source_chunks(content).where("error IS NULL").withColumnRenamed("path", "file_path")
    # numbers from 0 on are chunks, those below are questions
    vectors = embed(chunks.withColumn("vec_id", F.abs(F.xxhash64("file_path", "start_line", "node_type", "name"))), "text", model, "embedding", load)
    encoded = load(model)([prefixes(model)[0] + q for q in questions])
    found = similarity_ranking(vectors.select("vec_id", "embedding"), [(-1 - i, v.tolist()) for i, v in enumerate(encoded)], top=top)
    return found.join(vectors.drop("embedding", "text"), "vec_id").select((-1 - F.col("query_id")).cast("int").alias("question"), "rank", (1 - F.col("distance")).alias("similarity"), "node_type", "name", "file_path").orderBy("question", "rank")


def report(rows: Sequence, questions: dict[str, str], model: str) -> str:
    """What the command prints of ``ranked_chunks`` for questions by what they are called."""
    out = [f"Model: {model}", "", "Cosine similarity to each query:"]
    for number, (label, text) in enumerate(questions.items()):
        out += ["", f"=== {label}: {text!r} ==="] + [f"  {r.similarity:.4f}  {r.node_type}:{r.name}" for r in rows if r.question == number]
    return "\n".join(out)
