"""The engine's inputs, derived from the test tables: chunks, queries, graph, web results and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.operators.chunking import fixed_window_chunks
from evidence_engine.sources import literals


#: Bytes of file for each core up to which an input may be dealt out anew.
SMALL_BYTES = 32 << 20


def spread(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all of them; any other as it is.

    A file of one row group is one task's, however many cores there are. The size comes from the file listing, so no row
    is read for it, and a table of more than SMALL_BYTES a core is never shuffled here.
    """
    cores = spark.sparkContext.defaultParallelism
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(cores) if (1 << 20) < size < SMALL_BYTES * cores and len(frame.inputFiles()) < cores else frame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id, chunk_index, content, token_count (characters) of documents, and their source."""
    return fixed_window_chunks(read(spark, sf_dir, "documents"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: each benchmark text."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Node ids start here, by type.
OFFSETS = {"region": 0, "nation": 1_000, "customer": 1_000_000, "supplier": 2_000_000, "part": 3_000_000}
_KEYS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, name, type, confidence and properties of the star schema's entities."""
    out = None
    for name, start in OFFSETS.items():
        key, title = _KEYS[name]
        part = read(spark, sf_dir, name).select((F.col(key).cast("long") + start).alias("node_id"), F.col(title).alias("name"), F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("confidence", F.lit(0.5) + (F.col("node_id") * 7 % 50) / 100).withColumn("properties", F.create_map().cast("map<string,string>"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, source, target, relation, confidence; edge_id is a number made of the triple, so it is the same in any
    order of the rows."""

    def edges(frame: DataFrame, src: str, src_type: str, dst: str, dst_type: str, relation: str, code: int) -> DataFrame:
        return frame.select((F.col(src).cast("long") + OFFSETS[src_type]).alias("source"), (F.col(dst).cast("long") + OFFSETS[dst_type]).alias("target"), F.lit(relation).alias("relation"), F.lit(code).alias("code"))

    out = edges(read(spark, sf_dir, "nation"), "n_nationkey", "nation", "n_regionkey", "region", "IN_REGION", 1)
    out = out.unionByName(edges(read(spark, sf_dir, "customer"), "c_custkey", "customer", "c_nationkey", "nation", "IN_NATION", 2))
    out = out.unionByName(edges(read(spark, sf_dir, "supplier"), "s_suppkey", "supplier", "s_nationkey", "nation", "IN_NATION", 2))
    pairs = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = out.unionByName(edges(pairs, "l_suppkey", "supplier", "l_partkey", "part", "SUPPLIES", 3))
    return out.select(
        (F.col("source") * 10_000_000 * 10 + F.col("target") * 10 + F.col("code")).alias("edge_id"), "source", "target", "relation",
        (F.lit(0.5) + ((F.col("source") * 31 + F.col("target") * 17) % 50) / 100).alias("confidence"),
    )


def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, title, snippet, provider, rank: pages as results of a search."""
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("rank"), "url", F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1).alias("title"), F.substring(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), 1, 200).alias("snippet"), F.lit("bocha").alias("provider")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, content."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


#: Ids of questions from the tables start here; below are those of the literal ones.
_ITEMS, _TURNS = 1_000_000, 10_000_000


def _table_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select((F.col("item_id").cast("long") + _ITEMS).alias("query_id"), "text")
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id").cast("long") * 1_000_000 + F.col("turn") + _TURNS).alias("query_id"), "text")
    return items.unionByName(turns)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: every benchmark text, every user's turn of the conversations, and the literal questions, which meet
    the routers' rarer branches."""
    return _table_questions(spark, sf_dir).unionByName(literals.queries(spark).withColumn("query_id", F.col("query_id").cast("long")))


def academic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the literal questions about papers."""
    return _table_questions(spark, sf_dir).unionByName(literals.academic(spark).withColumn("query_id", F.col("query_id").cast("long")))


def questions_sql(rows: list[tuple]) -> str:
    """questions, with these literal ones, as a DuckDB table expression."""
    return f"""(SELECT item_id + {_ITEMS} AS query_id, text FROM benchmark UNION ALL SELECT conv_id * 1000000 + turn + {_TURNS}, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT CAST(query_id AS BIGINT), text FROM {literals.values_sql(rows, "query_id, text")})"""


#: The same inputs as DuckDB common table expressions.
CTES = {
    "chunks": r"""chunks AS (
  SELECT doc_id * 100000 + i AS chunk_id, doc_id, i AS chunk_index, content, length(content) AS token_count, source FROM (
    SELECT doc_id, source, i, regexp_replace(substring(text, CAST(i * 880 + 1 AS BIGINT), 1000), '^\s+|\s+$', '', 'g') AS content
    FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 880.0) AS BIGINT) + 1 END)) AS i FROM documents))
  WHERE content <> '')""",
    "qset": "qset AS (SELECT item_id AS query_id, text FROM benchmark)",
    "g_nodes": """g_nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS node_id, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 1000, n_name, 'nation' FROM nation
  UNION ALL SELECT CAST(c_custkey AS BIGINT) + 1000000, c_name, 'customer' FROM customer
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 2000000, s_name, 'supplier' FROM supplier
  UNION ALL SELECT CAST(p_partkey AS BIGINT) + 3000000, p_name, 'part' FROM part)""",
    "g_edges": """g_edges AS (
  SELECT source * 100000000 + target * 10 + code AS edge_id, source, target, relation, 0.5::DOUBLE + ((source * 31 + target * 17) % 50) / 100.0::DOUBLE AS confidence FROM (
    SELECT CAST(n_nationkey AS BIGINT) + 1000 AS source, CAST(n_regionkey AS BIGINT) AS target, 'IN_REGION' AS relation, 1 AS code FROM nation
    UNION ALL SELECT CAST(c_custkey AS BIGINT) + 1000000, CAST(c_nationkey AS BIGINT) + 1000, 'IN_NATION', 2 FROM customer
    UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 2000000, CAST(s_nationkey AS BIGINT) + 1000, 'IN_NATION', 2 FROM supplier
    UNION ALL SELECT DISTINCT CAST(l_suppkey AS BIGINT) + 2000000, CAST(l_partkey AS BIGINT) + 3000000, 'SUPPLIES', 3 FROM lineitem))""",
    "incident": """incident AS (
  SELECT source AS node_id, target AS other_id, edge_id, relation, confidence FROM g_edges
  UNION ALL SELECT target, source, edge_id, relation, confidence FROM g_edges WHERE source <> target)""",
    "web": r"""web AS (
  SELECT page_id AS rank, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
    substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')), 1, 200) AS snippet, 'bocha' AS provider FROM pages)""",
    "msgs": "msgs AS (SELECT conv_id, turn, role, text AS content FROM conversations)",
}


def with_ctes(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names.split()) + "\n" + body
