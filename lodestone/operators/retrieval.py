"""Literal search, nearest neighbours, grouped top-k, import expansion, literal links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower, chunk_literals, contains_folded
from lodestone.functions.vectors import cosine_distance
from lodestone.operators.ranking import ranked
from lodestone.operators.resolution import path_filter, perhaps_existing
from lodestone.shared import written

#: Fixed defaults of a search.
POOL, PER_MODULE, MARGIN = 600, 3, 0.15
LITERAL_LIMIT, LINKS_PER_LITERAL = 15, 3
LITERAL_NOISE, IMPORT_NOISE = 30, 15
#: Up to this many literals, all are tested against a text where it is read; beyond it they are joined by trigrams.
SCANNED_LITERALS = 512
#: Up to this size in bytes, with so many for a row, literals are handed to all tasks.
HANDED_BYTES, ROW_BYTES = 8 << 20, 64
#: Characters of the runs that literals go by: the first that isn't longer; still shorter ones go by themselves.
RUNS = (8, 3)
#: Imports and chunks that a task sorts in the expansion of imports.
TASK_ROWS = 500_000
#: Rows of a similarity ranking that are shown for each query.
RANKED = 20


# ---- nearest neighbours --------------------------------------------------------------------


def nearest(vectors: DataFrame, query: Sequence[float], k: int = POOL, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one query vector, with double ``distance``, not rounded; ties by key.

    The query is a literal, so there is no join: a scan, a projection and one
    top-k per task, merged.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", cosine_distance(F.col(embedding), q)).orderBy("distance", key).limit(k)


def grouped_top_k(rows: DataFrame, k: int = PER_MODULE, margin: float = MARGIN, layers: Sequence[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """Of rows with (layer, module, distance): the best ``k`` of each module whose best is near the layer's best.

    Both windows share one shuffle by layer; rows of unknown layers are dropped.
    """
    if layers is not None:
        rows = rows.where(F.col("layer").isin(list(layers)))
    best = F.min("distance").over(W.partitionBy("layer"))
    own = F.min("distance").over(W.partitionBy("layer", "module"))
    near = rows.withColumn("_best", best).withColumn("_own", own).where(F.col("_own") <= F.col("_best") * F.lit(1.0 + margin))
    rank = F.row_number().over(W.partitionBy("layer", "module").orderBy("distance", key))
    return near.withColumn("rn", rank).where(F.col("rn") <= k).drop("_best", "_own")


def with_empty_layers(rows: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Every layer of the list in its order (``layer_ord``), with its rows or with nulls."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(layers)], "layer string, layer_ord int")
    return listed.join(rows, "layer", "left")


def search_by_layers(vectors: DataFrame, query: Sequence[float], layers: Sequence[str], k: int = PER_MODULE, margin: float = MARGIN, pool: int = POOL, key: str = "chunk_id") -> DataFrame:
    """Nearest rows grouped by layer and module; layers without any are there too."""
    return with_empty_layers(grouped_top_k(nearest(vectors, query, pool, key), k, margin, layers, key), layers)


# ---- literals ------------------------------------------------------------------------------


def literal_search(chunks: DataFrame, tokens: Sequence[str], limit: int = LITERAL_LIMIT, key: str = "chunk_id") -> DataFrame:
    """Chunks that name, or contain, one of the tokens, which come longest first.

    ``chunks`` has (key, name, text, file_path).  Rank 0: the name itself; 1: in
    name or path; 2: in the text.  A chunk counts for the first token that finds
    it within that token's ``limit``.  One scan serves all tokens.
    """
    if not tokens:
        return chunks.limit(0).withColumns({"token": F.lit(""), "token_ord": F.lit(0), "rank": F.lit(0)})
    listed = F.array(*[F.struct(F.lit(i).alias("token_ord"), F.lit(t).alias("token")) for i, t in enumerate(tokens)])
    rows = chunks.withColumn("_hit", F.explode(listed)).select("*", "_hit.*").drop("_hit")
    token = F.col("token")
    in_name = contains_folded(F.col("name"), token) | contains_folded(F.col("file_path"), token)
    rows = rows.where(in_name | contains_folded(F.col("text"), token))
    rows = rows.withColumn("rank", F.when(F.col("name") == token, 0).when(in_name, 1).otherwise(2))
    order = [F.col("rank"), F.length("text"), F.col(key)]
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("token_ord").orderBy(*order))).where(F.col("_n") <= limit)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("token_ord"))).where("_n = 1").drop("_n")
    return rows.orderBy("rank", "token_ord", F.length("text"), key).limit(limit)


def json_literal_search(entries: DataFrame, query: str) -> DataFrame:
    """Entries (key_path, value) whose path or value contains the whole query, shortest values first."""
    hit = contains_folded(F.col("key_path"), F.lit(query)) | contains_folded(F.col("value"), F.lit(query))
    return entries.where(hit).orderBy(F.length("value"), "file_path", "key_path")


def similarity_ranking(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], key: str = "vec_id", embedding: str = "embedding", top: int | None = RANKED) -> DataFrame:
    """(query_id, key, distance, rank): for each query (id, vector) the ``top`` nearest other rows, or all with None; ties by key.

    The nearest are found by a top-k within each task; all of them are ranked in
    blocks of neighbours, so no task holds a query's whole ranking.
    """
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.array(*[F.lit(float(x)) for x in q]).alias("q")) for i, q in queries])
    each = vectors.withColumn("_q", F.explode(listed)).where(F.col(key) != F.col("_q.query_id"))
    each = each.select("_q.query_id", key, cosine_distance(F.col(embedding), F.col("_q.q")).alias("distance"))
    if top is None:
        return ranked(each, ["distance", key], ["query_id"]).withColumn("rank", F.col("rank").cast("int"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= top)


def grams(text: Column, n: int = 3) -> Column:
    """The distinct runs of ``n`` characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def substring_join(texts: DataFrame, literals: DataFrame, text: str = "text", literal: str = "literal", scanned: int = SCANNED_LITERALS, handed: int = HANDED_BYTES) -> DataFrame:
    """Pairs of rows whose ``text`` contains ``literal``, ASCII case aside.

    ``literals`` has distinct ones.  A few are tested in the scan of the texts.
    Many go by one run of characters each, and meet the runs of the texts by an
    equi-join, then the test.  Literals of up to ``handed`` bytes are handed to the
    tasks that read the texts, so that no text is moved; of more, hashes of texts
    meet them, behind a filter of all runs that are asked for, and each text is
    moved once.
    """
    # the few are computed once: what comes to the driver is what is broadcast
    few = literals.limit(scanned + 1).collect()
    folded = texts.withColumn("_folded", ascii_lower(F.col(text)))
    short = ascii_lower(F.col(literal))
    if len(few) <= scanned:
        listed = literals.sparkSession.createDataFrame(few, literals.schema)
        return folded.join(F.broadcast(listed), F.contains("_folded", short)).drop("_folded")
    size = F.length(literal)
    n = F.when(size >= RUNS[0], RUNS[0]).when(size >= RUNS[1], RUNS[1]).otherwise(size)
    least = [F.when(n == r, F.array_min(F.transform(grams(short, r), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]) for r in RUNS]
    known = written(literals.where(size.isNotNull()).withColumns({"_gram": F.coalesce(*least, short), "_n": n}), "literals")
    facts = known.agg(F.sum(F.octet_length(literal) + F.octet_length("_gram") + ROW_BYTES).alias("bytes"), F.collect_set("_n").alias("lengths")).first()
    lengths, keyed = [x for x in facts.lengths if x], known.where("_n > 0").drop("_n")
    out = [c for c in (*texts.columns, *literals.columns)]
    # the empty literal, one row at most
    pairs = folded.where("_folded IS NOT NULL").join(F.broadcast(known.where("_n = 0")), F.lit(True)).select(*out)
    if not lengths:
        return pairs
    runs = F.explode(F.flatten(F.array(*[grams(F.col("_folded"), r) for r in lengths])))
    if facts.bytes <= handed:
        met = folded.withColumn("_gram", runs).join(F.broadcast(keyed), "_gram")
    else:
        # equal texts have one hash; a hash that others share gives candidates too many, which the test drops
        hashed = folded.withColumn("_row", F.xxhash64("_folded"))
        asked = perhaps_existing(hashed.select("_row", runs.alias("path")), path_filter(keyed.select(F.col("_gram").alias("path")))).withColumnRenamed("path", "_gram")
        met = hashed.join(asked.join(keyed, "_gram").select("_row", *literals.columns).distinct(), "_row")
    return pairs.unionByName(met.where(F.contains("_folded", short)).select(*out))


def literal_counts(chunks: DataFrame, literals: DataFrame) -> DataFrame:
    """(literal, n): chunks that contain each literal in name or text; literals in none are left out."""
    both = chunks.select(F.concat_ws("\x00", "name", "text").alias("text"))
    return substring_join(both, literals).groupBy("literal").agg(F.count(F.lit(1)).alias("n"))


def cross_layer_links(found: DataFrame, chunks: DataFrame, per_literal: int = LINKS_PER_LITERAL, noise: int = LITERAL_NOISE, literals_each: int = 4, key: str = "chunk_id", join: Callable[[DataFrame, DataFrame], DataFrame] = substring_join) -> DataFrame:
    """For chunks that were found: chunks of other layers with the same quoted literal.

    Both have (key, layer, name, text); ``join`` finds the literals in (match_id, match_layer, text).  Literals in more than ``noise`` chunks
    say nothing and are dropped; each link keeps its ``per_literal`` shortest.
    """
    sources = found.select(F.col(key).alias("source_id"), F.col("layer").alias("source_layer"), F.posexplode(chunk_literals(F.col("text"), literals_each)).alias("pos", "literal"))
    both = chunks.select(F.col(key).alias("match_id"), F.col("layer").alias("match_layer"), F.length("text").alias("_len"), F.concat_ws("\x00", "name", "text").alias("text"))
    hits = join(both, sources.select("literal").distinct()).select("literal", "match_id", "match_layer", "_len")
    # counted with partial sums first: a literal that all chunks have is dropped before its rows meet
    rare = hits.groupBy("literal").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= noise).select("literal")
    links = sources.join(hits.join(rare, "literal"), "literal").where("source_layer <> match_layer")
    rank = F.row_number().over(W.partitionBy("source_id", "literal").orderBy("_len", "match_id"))
    return links.withColumn("rn", rank).where(F.col("rn") <= per_literal).select("source_id", "pos", "literal", "match_id", "match_layer", "rn")


# ---- imports -------------------------------------------------------------------------------


def forward_imports(imports: DataFrame, seeds: DataFrame) -> DataFrame:
    """What the seed files (source_file) import, one hop: distinct (source_file, target_file, module)."""
    return imports.join(seeds, "source_file", "left_semi").select("source_file", "target_file", "module").distinct()


def expand_imports(imports: DataFrame, seeds: DataFrame, chunks: DataFrame, per_file: int = 1, noise: int = IMPORT_NOISE, key: str = "chunk_id") -> DataFrame:
    """Chunks of the files that seeds import, except files that more than ``noise`` others import.

    ``chunks`` has (file_path, node_type, start_line, key); a file gives its
    ``per_file`` first by kind (classes, functions, others), then line.
    """
    # the number of tasks follows the rows, so that what a task sorts doesn't grow with them
    rows = imports.count() + chunks.count()
    if rows > TASK_ROWS:
        tasks = max(-(-rows // TASK_ROWS), imports.sparkSession.sparkContext.defaultParallelism)
        imports, chunks = imports.repartition(tasks, "target_file"), chunks.repartition(tasks, "file_path")
    edges = forward_imports(imports, seeds)
    # counts and heads of the files that are asked for, not of all
    asked = edges.select("target_file").distinct()
    importers = imports.join(asked, "target_file", "left_semi").groupBy("target_file").agg(F.countDistinct("source_file").alias("_n")).where(F.col("_n") <= noise).select("target_file")
    kind = F.when(F.col("node_type") == "class", 0).when(F.col("node_type") == "function", 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy("file_path").orderBy(kind, "start_line", key))
    there = chunks.join(asked.withColumnRenamed("target_file", "file_path"), "file_path", "left_semi")
    heads = there.withColumn("rn", rank).where(F.col("rn") <= per_file).withColumnRenamed("file_path", "target_file")
    return edges.join(importers, "target_file").join(heads, "target_file")
