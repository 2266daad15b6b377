"""Stored tables: rows appended, fetched, listed, changed and deleted; conversations and their messages; JSON and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.operators.chunking import fixed_window_chunks
from evidence_engine.operators.embedding import embed


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Rows put behind those that a table holds."""
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def get(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a table with the given keys, many at once; a key that isn't there has none."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a list, each row with the whole list's length as `total`."""
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("one", F.lit(1)).join(total, "one").drop("one")


def list_documents(docs: DataFrame, words: str = "", source: str = "", offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of docs(doc_id, title, content, source), the newest first, that hold the words in title or content."""
    rows = docs
    if words:
        rows = rows.where(F.col("title").ilike(f"%{words}%") | F.col("content").ilike(f"%{words}%"))
    if source:
        rows = rows.where(F.col("source") == source)
    return page(rows, [F.desc("doc_id")], offset, limit)


def get_documents(docs: DataFrame, keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents of keys(doc_id) with the nodes that name them among their source documents, as sorted names."""
    named = nodes.select("name", F.explode("source_doc_ids").alias("doc_id")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("nodes"))
    return get(docs, keys, "doc_id").join(named, "doc_id", "left").withColumn("nodes", F.coalesce("nodes", F.lit("")))


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the names and descriptions of changes(node_id, name, description) that are not null."""
    rows = nodes.join(changes.select("node_id", F.col("name").alias("c_name"), F.col("description").alias("c_description")), "node_id", "left")
    return rows.select(*(F.coalesce(F.col(f"c_{c}"), F.col(c)).alias(c) if c in ("name", "description") else F.col(c) for c in nodes.columns))


def create_nodes(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """nodes and fresh(seq, name, type, ...) behind them, with ids of their own made of seq, name and type; names may repeat."""
    numbered = fresh.withColumn("node_id", F.xxhash64("type", "name", "seq"))
    return nodes.unionByName(numbered.select(*nodes.columns))


def store_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) of docs(doc_id, source, text) by fixed windows and the default embedder; no graph."""
    chunks = fixed_window_chunks(docs)
    vectors = embed(chunks, "chunk_id", "content").select(F.concat(F.lit("chunk:"), "chunk_id").alias("vec_id"), "embedding")
    return chunks, vectors


def delete_documents(gone: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, chunks and vectors without gone(doc_id); nodes and edges made from them are not touched."""
    left = chunks.join(gone, "doc_id", "left_anti")
    ids = chunks.join(gone, "doc_id", "left_semi").select(F.concat(F.lit("chunk:"), "chunk_id").alias("vec_id"))
    return docs.join(gone, "doc_id", "left_anti"), left, vectors.join(ids, "vec_id", "left_anti")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, "edge_id", "left_anti")


# Conversations


def append_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, content) and behind them a user and an assistant message for each of turns(conv_id,
    question, answer), numbered on; a conversation that isn't there begins."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    rows = turns.join(last, "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(-1)).alias("last"), F.posexplode(pair).alias("k", "m"))
    fresh = rows.select("conv_id", (F.col("last") + 1 + F.col("k")).alias("turn"), "m.role", "m.content")
    return messages.unionByName(fresh.select(*messages.columns))


def conversation_detail(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """conv_id, title (50 characters of the first user message), n, messages (in order, `role: content` of 100 characters)."""
    own = get(messages, keys, "conv_id")
    line = F.struct("turn", "role", F.concat("role", F.lit(": "), F.substring("content", 1, 100)).alias("line"))
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("turn")))
    return own.groupBy("conv_id").agg(F.substring(F.coalesce(first, F.lit("")), 1, 50).alias("title"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("messages"))


def delete_conversations(gone: DataFrame, messages: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages and memory items without gone(conv_id)."""
    return messages.join(gone, "conv_id", "left_anti"), items.join(gone, "conv_id", "left_anti")


def store_items(items: DataFrame, base: DataFrame, most: int = 8, summary_chars: int = 700, content_chars: int = 1200) -> DataFrame:
    """conv_id, message_index, kind, summary, content, importance, focus_id of items(conv_id, pos, kind, summary, content,
    importance, focus_id) to store: the first `most` of a conversation, shortened, each field by the other where it is
    empty; places count on from base(conv_id, start, focus_id), whose focus stands in for an item's own."""
    strip = lambda c, n: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, n)
    rows = items.where(F.col("pos") < most).join(base.withColumnRenamed("focus_id", "active"), "conv_id", "left")
    a, b = F.nullif(strip("summary", summary_chars), F.lit("")), F.nullif(strip("content", content_chars), F.lit(""))
    rows = rows.withColumns({"s": F.coalesce(a, F.substring(b, 1, summary_chars)), "c": F.coalesce(b, a)}).where("s is not null")
    return rows.select("conv_id", (F.coalesce("start", F.lit(0)) + F.col("pos")).alias("message_index"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("fact")).alias("kind"), F.col("s").alias("summary"), F.col("c").alias("content"), F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(0.5)).alias("importance"), F.coalesce("focus_id", "active").alias("focus_id"))


# Scalars


def fenced_json(text: Column) -> Column:
    """The JSON object in a model's reply: without a code fence, from its first brace to its last; null if there is none that
    can be read."""
    bare = F.regexp_replace(F.trim(text), "(?s)^```[a-zA-Z]*\\n|\\n```$", "")
    return F.when(F.get_json_object(F.regexp_extract(bare, "(?s)[{].*[}]", 0), "$").isNotNull(), F.regexp_extract(bare, "(?s)[{].*[}]", 0))


def json_number(document: Column, path: str) -> Column:
    """A whole number at a path of a JSON document, null if there is none."""
    return F.get_json_object(document, path).try_cast("bigint")


def iso(ts: Column) -> Column:
    """A time as its ISO form with seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
