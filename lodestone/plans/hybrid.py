"""The hybrid search: literal hits, JSON entries, nearest chunks by layer, imports, literal links."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import functions as F

from lodestone.config import ProjectConfig
from lodestone.functions.text import query_tokens, snippet
from lodestone.functions.vectors import load_embedder, prefixes
from lodestone.operators import gram_index, retrieval
from lodestone.store import Index

#: Entries of catalogs that a search hands over, shortest values first: a short query may match all there are.
JSON_ENTRIES = 1000
_HEAD = ("chunk_id", "file_path", "start_line", "end_line", "node_type", "name", "layer")


def search_hybrid(index: Index, query: str, config: ProjectConfig, k: int = retrieval.PER_MODULE, literal_limit: int = 10, expand: bool = True, load: Callable = load_embedder) -> dict[str, list]:
    """Five sections of rows, each bounded by the search's own limits."""
    spark, tables = index.spark, index.open(config)
    chunks = tables["chunks"]
    vector = load(index.model)([prefixes(index.model)[0] + query])[0].tolist()
    tokens = spark.range(1).select(query_tokens(F.lit(query)).alias("t")).first().t
    # only chunks that hold the rarest run of a token are read for it
    indexed = index.postings() is not None
    held = gram_index.candidates(index.postings, tokens, "chunk_id") if indexed and tokens else None
    literal = retrieval.literal_search(chunks if held is None else chunks.join(held, "chunk_id", "left_semi"), tokens, literal_limit).select(*_HEAD, "token", "rank").collect()
    entries = retrieval.json_literal_search(tables["json_entries"], query).limit(JSON_ENTRIES).collect()
    near = retrieval.search_by_layers(chunks, vector, config.layers, k)
    near = near.withColumn("snippet", snippet(F.col("text"))).orderBy("layer_ord", "module", "rn").drop("embedding").collect()

    seeds = sorted({r.file_path for r in [*literal, *near] if r.file_path})
    expanded: list = []
    if expand and seeds:
        files = spark.createDataFrame([(p,) for p in seeds], "source_file string")
        plain = chunks.select(*[F.col(c).alias("chunk_module" if c == "module" else c) for c in chunks.columns if c not in ("text", "embedding")])
        found = retrieval.expand_imports(tables["imports"], files, plain, 2, config.import_noise_threshold)
        expanded = found.select("source_file", "module", "target_file", "start_line", "end_line", "node_type", "name", "layer").orderBy("source_file", "target_file", "module", "rn").collect()
    links: list = []
    ids = [r.chunk_id for r in near if r.chunk_id is not None]
    if ids:
        text = chunks.select("chunk_id", "layer", "name", "text")
        found = index.postings().withColumnRenamed("chunk_id", "match_id") if indexed else None
        join = partial(gram_index.indexed_join, found, key="match_id") if indexed else retrieval.substring_join
        pairs = retrieval.cross_layer_links(text.where(F.col("chunk_id").isin(ids)), text, noise=config.literal_noise_threshold, join=join)
        there = chunks.select(F.col("chunk_id").alias("match_id"), "file_path", "start_line", "end_line", "node_type", "name")
        links = pairs.join(there, "match_id").orderBy("source_id", "pos", "rn").collect()
    return {"literal": literal, "json_literal": entries, "by_layer": near, "imports": expanded, "links": links}


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def render(query: str, found: dict[str, list]) -> str:
    """A search's sections as text."""
    out = [f"=== literal matches for {query!r} ==="]
    out += [f"  [{r.layer}] [{r.node_type}] {r.name}  ({_base(r.file_path)}:{r.start_line}, ends {r.end_line})  matched {r.token!r}" for r in found["literal"]] or ["  (none)"]
    if found["json_literal"]:
        out += ["", "=== literal matches in translations ==="] + [f"  {r.key_path} = {r.value!r}  ({_base(r.file_path)})" for r in found["json_literal"]]
    out += ["", "=== per-layer vector search ==="]
    layer = module = None
    for r in found["by_layer"]:
        if r.layer != layer:
            layer, module = r.layer, None
            out.append(f"--- {layer} ---")
        if r.chunk_id is None:
            out.append("  (empty)")
            continue
        if r.module != module:
            module = r.module
            out.append(f"  [module: {module}]")
        out += [f"    {r.distance:.4f}  [{r.node_type}] {r.name}  ({_base(r.file_path)}:{r.start_line}, ends {r.end_line})", r.snippet]
    for title, key, group in (("expanded via imports", "imports", "source_file"), ("cross-layer links via shared literal strings", "links", "source_id")):
        rows = found[key]
        if not rows:
            continue
        out += ["", f"=== {title} ==="]
        names = {r.chunk_id: f"{_base(r.file_path)}::{r.name}" for r in found["by_layer"] if r.chunk_id is not None}
        last = None
        for r in rows:
            if r[group] != last:
                last = r[group]
                out.append(f"{_base(last) if key == 'imports' else names[last]}:")
            if key == "imports":
                out.append(f"  -> {r.module}  =>  [{r.layer}] [{r.node_type}] {r.name}  ({_base(r.target_file)})")
            else:
                out.append(f"  {r.literal!r} also in [{r.match_layer}] [{r.node_type}] {r.name}  ({_base(r.file_path)}:{r.start_line}, ends {r.end_line})")
    return "\n".join(out)
