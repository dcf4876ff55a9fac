"""The registered queries of the retrieval engine and their SQL.

The driver's tables stand for the engine's own: ``documents`` and ``pages`` for
chunks, ``embeddings`` for their vectors, ``lineitem`` for import edges,
``events.props`` for JSON files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.text import chunk_literals, contains_folded, query_tokens, snippet
from lodestone.functions.vectors import cosine_distance
from lodestone.operators import buckets, calibration, gram_index, graph, maintenance, pivots, resolution, retrieval
from lodestone.shared import new_path
from lodestone.sources.json_tree import with_chunks, with_leaves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LAYERS = ["layer0", "layer1", "layer2", "layer3"]


def register(sql: str | None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectors -------------------------------------------------------------------------------

_DISTANCES = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, 'layer' || (label % 3) AS layer, 'm' || label AS module, 1 - list_dot_product(embedding::DOUBLE[], q) AS distance FROM embeddings, q WHERE vec_id <> 0)"""
_POOL = f"{_DISTANCES},\npool AS (SELECT * FROM v ORDER BY distance, vec_id LIMIT 600)"
_TOP = f"""{_POOL},
w AS (SELECT *, min(distance) OVER (PARTITION BY layer) AS lb, min(distance) OVER (PARTITION BY layer, module) AS mb FROM pool),
top AS (SELECT layer, module, vec_id, distance, row_number() OVER (PARTITION BY layer, module ORDER BY distance, vec_id) AS rn FROM w WHERE mb <= lb * 1.15::DOUBLE)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.concat(F.lit("layer"), F.col("label") % 3)
    return read(spark, sf_dir, "embeddings").where("vec_id <> 0").select("vec_id", "embedding", layer.alias("layer"), F.concat(F.lit("m"), F.col("label")).alias("module"))


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@register(f"WITH {_POOL} SELECT vec_id, round(distance, 6) AS distance FROM pool")
def knn_topk(spark, sf_dir):
    return retrieval.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@register(ORACLE_SQL["knn_topk"])
def knn_pruned(spark, sf_dir):
    """The same from a table by pivots, of which only ranges that can be near are read."""
    path = new_path(spark, "pivots")
    pivots.write_vectors(_vectors(spark, sf_dir), path, key="vec_id")
    return pivots.nearest_pruned(spark, path, _query(spark, sf_dir), key="vec_id")[0].select("vec_id", F.round("distance", 6).alias("distance"))


@register(f"WITH {_TOP} SELECT layer, module, vec_id, round(distance, 6) AS distance, rn::INT AS rn FROM top WHERE rn <= 3")
def layered_topk(spark, sf_dir):
    pool = retrieval.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), key="vec_id")
    return retrieval.grouped_top_k(pool, key="vec_id").select("layer", "module", "vec_id", F.round("distance", 6).alias("distance"), "rn")


@register(f"WITH {_DISTANCES} SELECT layer, round(min(distance), 6) AS best FROM v GROUP BY layer")
def layer_best_distance(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _query(spark, sf_dir)])
    rows = _vectors(spark, sf_dir).withColumn("distance", cosine_distance(F.col("embedding"), q))
    return rows.groupBy("layer").agg(F.round(F.min("distance"), 6).alias("best"))


@register(f"""WITH {_TOP}, l AS (SELECT unnest(['layer0', 'layer1', 'layer2', 'layer3']) AS layer)
SELECT l.layer, module, vec_id, rn::INT AS rn FROM l LEFT JOIN (SELECT * FROM top WHERE rn <= 3) t ON t.layer = l.layer""")
def layers_with_empty(spark, sf_dir):
    found = retrieval.search_by_layers(_vectors(spark, sf_dir), _query(spark, sf_dir), LAYERS, key="vec_id")
    return found.select("layer", "module", "vec_id", "rn")


@register("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (0, 1)),
d AS (SELECT query_id, vec_id, 1 - list_dot_product(embedding::DOUBLE[], q) AS distance FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d""")
def similarity_ranking(spark, sf_dir):
    found = retrieval.similarity_ranking(read(spark, sf_dir, "embeddings"), [(i, _query(spark, sf_dir, i)) for i in (0, 1)], top=None)
    return found.withColumn("distance", F.round("distance", 6))


# ---- literals ------------------------------------------------------------------------------

_QUOTED = """'["'']([^"'']{2,})["'']'"""


def _literals(table: str, key: str, text: str, limit: int) -> str:
    return f"""SELECT {key}, pos, literal FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY length(literal) DESC, i) - 1 AS pos FROM (
  SELECT {key}, literal, min(i) AS i FROM (SELECT {key}, unnest(ls) AS literal, generate_subscripts(ls, 1) AS i FROM (SELECT {key}, regexp_extract_all({text}, {_QUOTED}, 1) AS ls FROM {table}))
  WHERE length(literal) >= 3 AND NOT regexp_full_match(literal, '\\p{{Nd}}+') AND regexp_matches(literal, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL)) WHERE pos < {limit}"""


@register(rf"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, {_QUOTED}, 1) AS a, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./]*') AS b FROM conversations),
u AS (SELECT conv_id, turn, unnest(a || list_filter(b, lambda w: length(w) >= 3 AND (regexp_matches(w, '[_/.]') OR (regexp_matches(w, '[A-Z]') AND (regexp_matches(w, '[a-z]') OR w = upper(w)))))) AS token,
  generate_subscripts(a || list_filter(b, lambda w: length(w) >= 3 AND (regexp_matches(w, '[_/.]') OR (regexp_matches(w, '[A-Z]') AND (regexp_matches(w, '[a-z]') OR w = upper(w))))), 1) AS i FROM t),
d AS (SELECT conv_id, turn, token, min(i) AS i FROM u GROUP BY ALL)
SELECT conv_id, turn, token, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(token) DESC, i) - 1)::INT AS pos FROM d""")
def token_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.posexplode(query_tokens(F.col("text"))).alias("pos", "token"))


@register(_literals("pages", "page_id", "html", 4).replace("pos, literal FROM", "pos::INT AS pos, literal FROM", 1))
def chunk_literals_of_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(chunk_literals(F.col("html"))).alias("pos", "literal"))


_CHUNKS = """c AS (SELECT doc_id, 'doc_' || doc_id AS name, coalesce(text, '') AS text, source || '/' || lang || '/' || doc_id || '.txt' AS file_path FROM documents)"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), F.coalesce("text", F.lit("")).alias("text"), path.alias("file_path"), F.col("lang").alias("layer"), F.col("source").alias("module"))


QUESTION = 'where is "token = " used, and Thing of src1/EN or doc_17'


@register(f"""WITH {_CHUNKS}, tok AS (SELECT * FROM (VALUES (0, 'token = '), (1, 'src1/EN'), (2, 'doc_17'), (3, 'Thing')) t(token_ord, token)),
h AS (SELECT *, CASE WHEN name = token THEN 0 WHEN contains({_FOLD.format('name')}, {_FOLD.format('token')}) OR contains({_FOLD.format('file_path')}, {_FOLD.format('token')}) THEN 1 ELSE 2 END AS rank
  FROM c, tok WHERE contains({_FOLD.format('name')}, {_FOLD.format('token')}) OR contains({_FOLD.format('file_path')}, {_FOLD.format('token')}) OR contains({_FOLD.format('text')}, {_FOLD.format('token')})),
a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY token_ord ORDER BY rank, length(text), doc_id) <= 15),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY token_ord) = 1)
SELECT doc_id, file_path, token, rank FROM b ORDER BY rank, token_ord, length(text), doc_id LIMIT 15""")
def literal_search_ranked(spark, sf_dir):
    tokens = spark.range(1).select(query_tokens(F.lit(QUESTION)).alias("t")).first().t
    return retrieval.literal_search(_chunks(spark, sf_dir), tokens, key="doc_id").select("doc_id", "file_path", "token", "rank")


@register(ORACLE_SQL["literal_search_ranked"])
def literal_search_indexed(spark, sf_dir):
    """The same by stored postings: only chunks that hold the rarest run of a token are tested."""
    tokens = spark.range(1).select(query_tokens(F.lit(QUESTION)).alias("t")).first().t
    chunks, path = _chunks(spark, sf_dir), new_path(spark, "postings")
    gram_index.write_postings(gram_index.postings(chunks, ("name", "text", "file_path"), "doc_id"), path)
    held = gram_index.candidates(lambda wanted: gram_index.read_postings(spark, path, wanted), tokens, "doc_id")
    return retrieval.literal_search(chunks.join(held, "doc_id", "left_semi"), tokens, key="doc_id").select("doc_id", "file_path", "token", "rank")


NEEDLES = ["%", "_", "TOKEN", "É", "license, VERSION", "\\"]


@register(f"""WITH {_CHUNKS}, n AS (SELECT unnest(['%', '_', 'TOKEN', 'É', 'license, VERSION', chr(92)]) AS needle)
SELECT needle, count(doc_id) AS n FROM n LEFT JOIN c ON contains({_FOLD.format('text')}, {_FOLD.format('needle')}) GROUP BY needle""")
def literal_search_escaped(spark, sf_dir):
    counts = [F.count_if(contains_folded(F.col("text"), F.lit(x))).alias(f"n{i}") for i, x in enumerate(NEEDLES)]
    pairs = F.array(*[F.struct(F.lit(x).alias("needle"), F.col(f"n{i}").alias("n")) for i, x in enumerate(NEEDLES)])
    return _chunks(spark, sf_dir).agg(*counts).select(F.explode(pairs).alias("x")).select("x.*")


_ENTRIES = """e AS (SELECT event_id, key AS key_path, CASE WHEN value IS NULL OR json_type(value) = 'NULL' THEN '' ELSE value->>'$' END AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) k, LATERAL (SELECT json_extract(props, '$."' || key || '"') AS value))"""


@register(f"WITH {_ENTRIES} SELECT event_id, key_path, value FROM e")
def json_flatten(spark, sf_dir):
    return with_leaves(read(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key_path", "value")


@register(f"WITH {_ENTRIES} SELECT event_id, key_path, value FROM e WHERE contains(key_path, '7') OR contains(value, '7')")
def json_literal_search(spark, sf_dir):
    entries = with_leaves(read(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("file_path"), "props"), "props")
    return retrieval.json_literal_search(entries, "7").select("event_id", "key_path", "value")


@register(f"""WITH l AS (SELECT DISTINCT literal FROM ({_literals('pages', 'page_id', 'html', 8)}))
SELECT literal, count(*) AS n FROM l JOIN pages ON contains({_FOLD.format('html')}, {_FOLD.format('literal')}) GROUP BY literal""")
def literal_match_counts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("text"))
    literals = pages.select(F.explode(chunk_literals(F.col("text"), 8)).alias("literal")).distinct()
    both = retrieval.substring_join(pages, literals)
    return both.groupBy("literal").agg(F.count(F.lit(1)).alias("n"))


@register(ORACLE_SQL["literal_match_counts"])
def literal_match_counts_many(spark, sf_dir):
    """The same by trigrams, as for more literals than are tested in a scan."""
    pages = read(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    literals = pages.select(F.explode(chunk_literals(F.col("text"), 8)).alias("literal")).distinct()
    return retrieval.substring_join(pages, literals, scanned=0).groupBy("literal").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z][a-z])/', 1) AS layer, html FROM pages),
s AS ({_literals('pages', 'page_id', 'html', 4)}),
m AS (SELECT l.literal, page_id AS match_id, layer AS match_layer, length(html) AS n FROM (SELECT DISTINCT literal FROM s) l JOIN p ON contains({_FOLD.format('html')}, {_FOLD.format('l.literal')})),
r AS (SELECT literal FROM m GROUP BY literal HAVING count(*) <= 30),
k AS (SELECT s.page_id AS source_id, s.literal, match_id, match_layer, row_number() OVER (PARTITION BY s.page_id, s.literal ORDER BY n, match_id)::INT AS rn
  FROM s JOIN p USING (page_id) JOIN r ON r.literal = s.literal JOIN m ON m.literal = s.literal WHERE match_layer <> layer)
SELECT source_id, literal, match_id, match_layer, rn FROM k WHERE rn <= 3""")
def cross_layer_links(spark, sf_dir):
    layer = F.regexp_extract("url", "/([a-z][a-z])/", 1)
    chunks = read(spark, sf_dir, "pages").select("page_id", layer.alias("layer"), F.lit("").alias("name"), F.col("html").alias("text"))
    return retrieval.cross_layer_links(chunks, chunks, key="page_id").select("source_id", "literal", "match_id", "match_layer", "rn")


@register(ORACLE_SQL["cross_layer_links"])
def cross_layer_links_indexed(spark, sf_dir):
    """The same by stored postings."""
    layer = F.regexp_extract("url", "/([a-z][a-z])/", 1)
    chunks = read(spark, sf_dir, "pages").select("page_id", layer.alias("layer"), F.lit("").alias("name"), F.col("html").alias("text"))
    path = new_path(spark, "postings")
    gram_index.write_postings(gram_index.postings(chunks, ("text",), "page_id"), path)
    found = gram_index.read_postings(spark, path).withColumnRenamed("page_id", "match_id")
    links = retrieval.cross_layer_links(chunks, chunks, key="page_id", join=partial(gram_index.indexed_join, found, key="match_id"))
    return links.select("source_id", "literal", "match_id", "match_layer", "rn")


# ---- graph and calibration -----------------------------------------------------------------


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_file"), F.col("l_partkey").alias("target_file"), F.col("l_returnflag").alias("module"))


_COUNTS = "n AS (SELECT l_partkey AS target_file, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)"


@register(f"WITH {_COUNTS} SELECT target_file, n FROM n")
def import_target_counts(spark, sf_dir):
    return calibration.import_target_counts(_imports(spark, sf_dir))


@register("SELECT DISTINCT l_suppkey AS source_file, l_partkey AS target_file, l_returnflag AS module FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2500)")
def forward_imports(spark, sf_dir):
    seeds = read(spark, sf_dir, "supplier").where("s_acctbal < 2500").select(F.col("s_suppkey").alias("source_file"))
    return retrieval.forward_imports(_imports(spark, sf_dir), seeds)


@register(f"""WITH {_COUNTS}, h AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_orderkey)::INT AS rn FROM lineitem),
e AS (SELECT DISTINCT l_suppkey AS source_file, l_partkey AS target_file, l_returnflag AS module FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2500))
SELECT source_file, e.target_file, module, l_orderkey, l_linenumber, rn FROM e JOIN n ON n.target_file = e.target_file AND n <= 25 JOIN h ON l_partkey = e.target_file AND rn <= 2""")
def expand_imports(spark, sf_dir):
    seeds = read(spark, sf_dir, "supplier").where("s_acctbal < 2500").select(F.col("s_suppkey").alias("source_file"))
    kind = F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "function").otherwise("method")
    chunks = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_path"), kind.alias("node_type"), F.col("l_linenumber").alias("start_line"), "l_orderkey", "l_linenumber")
    found = retrieval.expand_imports(_imports(spark, sf_dir), seeds, chunks, 2, 25, "l_orderkey")
    return found.select("source_file", "target_file", "module", "l_orderkey", "l_linenumber", "rn")


_EDGES = """e AS (SELECT DISTINCT c_nationkey AS source, s_nationkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey < s_nationkey)"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders, customers, suppliers = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    rows = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


@register(f"""WITH {_EDGES}, i AS (SELECT target AS module, count(*) AS n FROM e GROUP BY 1), o AS (SELECT source AS module, count(*) AS n FROM e GROUP BY 1)
SELECT coalesce(i.module, o.module)::VARCHAR AS module, CASE WHEN o.n IS NULL THEN 'foundation' WHEN i.n IS NULL THEN 'extension' ELSE 'application' END AS role, coalesce(i.n, 0)::INT AS n_in, coalesce(o.n, 0)::INT AS n_out FROM i FULL JOIN o USING (module)""")
def module_stats(spark, sf_dir):
    edges = _flow(spark, sf_dir).where("c_nationkey < s_nationkey").select(F.col("c_nationkey").cast("string").alias("source"), F.col("s_nationkey").cast("string").alias("target"))
    return graph.module_stats(edges).select("module", "role", F.size("imported_by").alias("n_in"), F.size("imports_from").alias("n_out"))


@register("""SELECT l_orderkey AS entry, string_agg(DISTINCT n_regionkey::VARCHAR, ',' ORDER BY n_regionkey::VARCHAR) AS modules FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1""")
def entry_unification(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edges = read(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("entry"), F.col("n_regionkey").cast("string").alias("module"))
    return graph.entry_unification(edges).select("entry", F.array_join("modules", ",").alias("modules"))


@register(f"""WITH {_COUNTS}, s AS (SELECT list_sort(list(n)) AS l FROM n)
SELECT p::INT AS p, l[1 + least(len(l) - 1, len(l) * p // 100)] AS value FROM s, (SELECT unnest([50, 75, 90, 95, 99, 100]) AS p)""")
def percentile_nearest_rank(spark, sf_dir):
    return calibration.percentiles(calibration.import_target_counts(_imports(spark, sf_dir)))


@register(f"WITH {_COUNTS} SELECT threshold::INT AS threshold, round(avg(CASE WHEN n <= threshold THEN 1.0::DOUBLE ELSE 0 END), 9) AS fraction FROM n, (SELECT unnest([5, 15, 20, 25, 30]) AS threshold) GROUP BY 1")
def fraction_at_or_below(spark, sf_dir):
    found = calibration.fraction_at_or_below(calibration.import_target_counts(_imports(spark, sf_dir)), [5, 15, 20, 25, 30])
    return found.select("threshold", F.round("fraction", 9).alias("fraction"))


# ---- paths and maintenance -----------------------------------------------------------------

LAYER_RULES = [("german", ["DE"], []), ("news", [], ["7.html"]), ("french", ["fr"], [])]
_PATHS = r"p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, strlen(html) AS size FROM pages)"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").alias("size"))


@register(rf"""WITH {_PATHS}, s AS (SELECT *, string_split(path, '/') AS a FROM p)
SELECT page_id, path, CASE WHEN list_contains(string_split(lower(path), '/'), 'de') THEN 'german' WHEN lower(a[-1]) = '7.html' THEN 'news' WHEN list_contains(string_split(lower(path), '/'), 'fr') THEN 'french' ELSE 'other' END AS layer,
  CASE WHEN len(a) = 1 THEN path ELSE array_to_string(a[1:least(2, len(a) - 1)], '/') END AS module FROM s""")
def classify_layer_module(spark, sf_dir):
    path = F.col("path")
    return _page_paths(spark, sf_dir).select("page_id", "path", paths.classify_layer(path, LAYER_RULES, "other").alias("layer"), paths.classify_module(path, 2).alias("module"))


@register(rf"""WITH {_PATHS} SELECT page_id, path FROM p WHERE lower(regexp_extract(path, '[^./](\.[^./]+)$', 1)) = '.html' AND size <= 20000 AND NOT list_has_any(string_split(path, '/'), ['es', 'node_modules'])""")
def scan_filter(spark, sf_dir):
    rows = _page_paths(spark, sf_dir)
    return rows.where(paths.is_source(F.col("path"), F.col("size"), ["es"], [], [".html"], 20_000)).select("page_id", "path")


@register("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


_SCANS = "old AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE lang <> 'es'), new AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN lang = 'de' THEN lower(text) ELSE text END) AS h FROM documents WHERE lang <> 'fr')"
_DIFF = f"{_SCANS}, d AS (SELECT coalesce(new.path, old.path) AS path, CASE WHEN new.path IS NULL THEN 'deleted' WHEN old.path IS NULL THEN 'new' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS status FROM old FULL JOIN new USING (path))"


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hashed = lambda d, t: d.select(F.col("doc_id").cast("string").alias("path"), F.sha2(t, 256).alias("content_hash"))
    changed = F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text"))
    return maintenance.diff(hashed(docs.where("lang <> 'es'"), F.col("text")), hashed(docs.where("lang <> 'fr'"), changed))


@register(f"WITH {_DIFF} SELECT path, status FROM d")
def incremental_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select("path", "status")


@register(f"WITH {_DIFF} SELECT count(*) FILTER (status IN ('new', 'changed')) AS changed_files, count(*) FILTER (status = 'unchanged') AS unchanged_files, count(*) FILTER (status = 'deleted') AS deleted_files FROM d")
def index_statistics(spark, sf_dir):
    return maintenance.diff_stats(_diff(spark, sf_dir))


@register("""SELECT doc_id::VARCHAR AS path, CASE WHEN toxic = 1 THEN '[toxic] ' || text ELSE text END AS text, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0""")
def bucket_update(spark, sf_dir):
    """A table in buckets after an update: what is labelled as poor goes, what is toxic changes."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "n_chars")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality", "toxic")
    path, schema = new_path(spark, "bucket-update"), "path string, text string, n_chars long"
    count = buckets.bucket_count(docs.count())
    buckets.write_table(docs, path, "path", count)
    gone, changed = labels.where("quality = 0"), labels.where("toxic = 1 AND quality = 1")
    buckets.replace_rows(spark, path, schema, "path", count, gone, docs.join(changed, "path", "left_semi").withColumn("text", F.concat(F.lit("[toxic] "), "text")))
    return buckets.read_table(spark, path, schema, "path")


@register("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return maintenance.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@register(r"""WITH w AS (SELECT doc_id, source || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.rs' WHEN 'fr' THEN '.JS' ELSE '.c' END AS path FROM documents) SELECT doc_id, path FROM w WHERE lower(path[-3:]) NOT IN ('.rs', '.js')""")
def version_wipe(spark, sf_dir):
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".JS").otherwise(".c")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", end).alias("path"))
    return maintenance.without_suffixes(rows, [".rs", ".js"])


@register(rf"WITH {_PATHS}, b AS (SELECT path, string_split(path, '/')[-1] AS name FROM p) SELECT name, min(path) AS path FROM b GROUP BY name HAVING count(*) = 1")
def unique_basename(spark, sf_dir):
    return resolution.unique_by(_page_paths(spark, sf_dir).select("path"), paths.basename(F.col("path")))


@register("""WITH k AS (SELECT DISTINCT string_split(p_type, ' ')[1:2] AS prefix FROM part WHERE p_size > 25 UNION SELECT DISTINCT string_split(p_type, ' ')[1:1] FROM part),
x AS (SELECT p_partkey, string_split(p_type, ' ') AS s FROM part)
SELECT p_partkey, array_to_string(prefix, ' ') AS prefix, len(prefix)::INT AS depth FROM x JOIN k ON s[1:len(prefix)] = prefix QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY len(prefix) DESC) = 1""")
def prefix_longest(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.split("p_type", " ").alias("segments"))
    known = part.where("p_size > 25").select(F.slice("segments", 1, 2).alias("prefix")).union(part.select(F.slice("segments", 1, 1))).distinct()
    found = resolution.longest_prefix(part, known.withColumn("value", F.array_join("prefix", " ")), key="p_partkey")
    return found.select("p_partkey", F.col("value").alias("prefix"), "depth")


@register("""WITH c AS (SELECT DISTINCT l_partkey, l_suppkey, [l_partkey * 10, l_partkey * 3, l_suppkey] AS cs FROM lineitem), f AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 10),
e AS (SELECT l_partkey, l_suppkey, unnest(cs) AS path, generate_subscripts(cs, 1) AS i FROM c)
SELECT l_partkey, l_suppkey, arg_min(path, i) AS target FROM e JOIN f ON p_partkey = path GROUP BY 1, 2""")
def first_existing(spark, sf_dir):
    specs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.array(F.col("l_partkey") * 10, F.col("l_partkey") * 3, F.col("l_suppkey")).alias("candidates"))
    files = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"))
    return resolution.first_existing(specs, files, keys=("l_partkey", "l_suppkey"))


@register(ORACLE_SQL["first_existing"])
def first_existing_filtered(spark, sf_dir):
    """The same behind a filter of the existing paths."""
    specs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.array(F.col("l_partkey") * 10, F.col("l_partkey") * 3, F.col("l_suppkey")).alias("candidates"))
    files = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"))
    return resolution.first_existing(specs, files, keys=("l_partkey", "l_suppkey"), filtered=True)


@register("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/*([?#].*)?$', '') AS path FROM pages)
SELECT page_id, path || '/extra' AS path, string_split(path, '/')[1] || '/x' AS top FROM u""")
def normalized_paths(spark, sf_dir):
    """Paths with detours: what goes up again, empty parts and dots say nothing."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/*([?#].*)?$", "")
    up = F.array_join(F.transform(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")) - 1), lambda _: F.lit("..")), "/")
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", paths.normalize_path(F.concat(F.lit("./no/..//"), path, F.lit("/./extra/"))).alias("path"), paths.normalize_path(F.concat(path, F.lit("/"), up, F.lit("/x/y/.."))).alias("top"))


@register("""WITH g AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) >= 50 THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::INT AS block FROM g)
SELECT user_id, block, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY user_id, block""")
def line_gap_blocks(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id")
    blocks = resolution.line_gap_blocks(rows, "user_id", "event_id", "event_id", 50)
    return blocks.groupBy("user_id", "block").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@register(r"""WITH b AS (SELECT doc_id, text, regexp_replace(substr(text, 1, 800), '\n$', '') AS body FROM documents), s AS (SELECT *, string_split(body, chr(10)) AS ls FROM b)
SELECT doc_id, CASE WHEN body = '' THEN '' ELSE array_to_string(list_transform(ls[1:15], lambda l: '        ' || l), chr(10)) END || CASE WHEN length(text) > 800 OR len(ls) > 15 THEN chr(10) || '        ...' ELSE '' END AS snippet FROM s""")
def snippets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@register(r"""WITH s AS (SELECT doc_id, string_split(lower(source || '/' || lang || '/' || doc_id || '.txt'), '/') AS a, source FROM documents)
SELECT doc_id, CASE WHEN list_contains(a, 'de') THEN 'german' WHEN a[-1] IN ('7.txt', '8.txt') THEN 'some' ELSE 'rest' END AS layer, source || '/' || a[2] AS module FROM s""")
def reclassified_layers(spark, sf_dir):
    """Stored chunks under changed rules: layers and modules follow from the rules, not from what was stored."""
    rules = [("german", ["DE"], []), ("some", [], ["7.txt", "8.txt"])]
    return maintenance.reclassified(_chunks(spark, sf_dir), rules, "rest", 2).select("doc_id", "layer", "module")


@register("SELECT lang AS layer, source AS module, count(*) AS chunks, count(DISTINCT sha256(coalesce(text, ''))) AS texts FROM documents GROUP BY ALL")
def layer_statistics(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("layer", "module").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


@register(None)
def json_budget_batch(spark, sf_dir):
    """Chunks of each conversation as one JSON list: cut by budgets that reset, which SQL can't say."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    files = turns.select("conv_id", F.to_json("turns").alias("content"), F.concat(F.lit("conv"), F.col("conv_id")).alias("stem"))
    return with_chunks(files, "content", "stem").select("conv_id", "ord", "name", "start_line", F.length("text").alias("n_chars"))


@register(f"""WITH {_TOP}, {_COUNTS}
SELECT 'by_layer' AS section, layer || '/' || module AS item, vec_id AS id FROM top WHERE rn <= 3
UNION ALL SELECT 'literal', 'token', doc_id FROM (SELECT doc_id FROM documents WHERE contains({_FOLD.format('text')}, 'token =') ORDER BY length(text), doc_id LIMIT 15)
UNION ALL SELECT DISTINCT 'imports', l_suppkey::VARCHAR, l_partkey FROM lineitem JOIN n ON n.target_file = l_partkey WHERE n <= 25 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2500)""")
def hybrid_flat(spark, sf_dir):
    layered = layered_topk(spark, sf_dir).select(F.lit("by_layer").alias("section"), F.concat_ws("/", "layer", "module").alias("item"), F.col("vec_id").alias("id"))
    literal = retrieval.literal_search(_chunks(spark, sf_dir), ["token ="], key="doc_id").select(F.lit("literal").alias("section"), F.lit("token").alias("item"), F.col("doc_id").alias("id"))
    expanded = expand_imports(spark, sf_dir).select(F.lit("imports").alias("section"), F.col("source_file").cast("string").alias("item"), F.col("target_file").alias("id")).distinct()
    return layered.unionByName(literal).unionByName(expanded)
