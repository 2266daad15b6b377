"""Conversation memory over messages(conv_id, turn, role, content)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx

# Recent rounds, thresholds of compression, sizes of memory items.
RECENT_ROUNDS = 4
MIN_END, MIN_DELTA, MIN_CHARS = 8, 4, 2500
ITEM_LEAST, ITEMS_MOST, SUMMARY_CHARS, ITEM_SUMMARY_CHARS = 4, 6, 180, 220
KEYWORD = "[一-龥A-Za-z0-9]{2,}"


def shorten(text: Column, chars: int) -> Column:
    return F.substring(tx.strip(F.coalesce(text, F.lit(""))), 1, chars)


def keywords(text: Column, most: int = 12) -> Column:
    """The distinct ones of the first words: cut first, then made distinct."""
    return F.array_distinct(F.slice(tx.all_of(text, KEYWORD), 1, most))


def recent_turns(messages: DataFrame, rounds: int = RECENT_ROUNDS) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role"))
    return messages.withColumn("back", back).where(F.col("back") <= 2 * rounds).drop("back")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, rounds, title (50 characters of the first user message), chars."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("rounds"), F.substring(F.coalesce(first, F.lit("")), 1, 50).alias("title"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))


def due_for_compression(messages: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """conv_id, from_message, to_message, due: whether the messages not yet covered(conv_id, covered) are worth it."""
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    rows = messages.withColumn("no", no)
    rows = rows.join(covered, "conv_id", "left") if covered is not None else rows.withColumn("covered", F.lit(0))
    done = F.coalesce(F.col("covered"), F.lit(0))
    a = rows.groupBy("conv_id").agg(F.max(done).alias("from_message"), F.count("*").alias("to_message"), F.coalesce(F.sum(F.when(F.col("no") > done, F.length("content"))), F.lit(0)).alias("chars"))
    small = (F.col("to_message") < MIN_END) & (F.col("to_message") - F.col("from_message") < MIN_DELTA) & (F.col("chars") < MIN_CHARS)
    return a.select("conv_id", "from_message", "to_message", "chars", (~small).alias("due"))


def fallback_summary(messages: DataFrame, last: int = 8) -> DataFrame:
    """conv_id, summary: the last messages as `role: text` lines."""
    line = F.concat(F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit(": "), shorten(F.col("content"), SUMMARY_CHARS))
    rows = recent_turns(messages, last // 2).select("conv_id", "turn", "role", line.alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def fallback_items(messages: DataFrame) -> DataFrame:
    """conv_id, item_no, turn, summary, keywords, importance of the first user messages that say something."""
    told = messages.where((F.col("role") == "user") & (F.length(tx.strip(F.col("content"))) >= ITEM_LEAST))
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return told.withColumn("item_no", no).where(F.col("item_no") <= ITEMS_MOST).select("conv_id", "item_no", "turn", shorten(F.col("content"), ITEM_SUMMARY_CHARS).alias("summary"), "content", keywords(F.col("content")).alias("keywords"), F.lit(0.5).alias("importance"))


def recall(queries: DataFrame, items: DataFrame, top_k: int = 6) -> DataFrame:
    """query_id, rank, item_no: items of a query's conversation (query_id, conv_id, text) that hold one of its terms, by
    importance, then the newest."""
    asked = queries.select("query_id", "conv_id", keywords(F.col("text")).alias("terms"))
    met = asked.join(items, "conv_id").where(F.exists("terms", lambda t: F.contains(F.lower("content"), F.lower(t))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("importance"), F.desc("turn")))
    return met.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "conv_id", "item_no")


def upsert_topics(topics: DataFrame) -> DataFrame:
    """topics(conv_id, label, turn, content, seq): the longest content of each key stays, the first on ties."""
    best = F.max_by("content", F.struct(F.length("content"), -F.col("seq")))
    return topics.groupBy("conv_id", "label", "turn").agg(best.alias("content"))


# The focus of a conversation.

# Words that go back, compare, or switch.
BACK, COMPARE, SWITCH = ("回到", "前面", "back to", "return to"), ("对比", "比较", "compare", " vs "), ("换", "另外", "switch", "now about", "instead")
STACK = 8


def step_focus(state: dict, content: str) -> tuple[dict, str]:
    """The focus state {active, stack} after a user message, and what the message did."""
    low, title = content.lower(), content.strip()[:40]
    active, stack = state.get("active"), list(state.get("stack", ()))
    if any(w in low for w in BACK) and stack:
        found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] != active and any(k in stack[i].lower() for k in low.split() if len(k) > 3)), None)
        i = found if found is not None else max(0, len(stack) - 2)
        active, kind = stack.pop(i), "back"
    elif any(w in low for w in COMPARE):
        active, kind = title, "compare"
    elif active is None or any(w in low for w in SWITCH):
        active, kind = title, "switch"
    else:
        return {"active": active, "stack": stack}, "continue"
    stack = [s for s in stack if s != active] + [active]
    return {"active": active, "stack": stack[-STACK:]}, kind


FOCUS = "conv_id long, turn long, kind string, active string, depth int"


def focus_fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    state, out = {}, []
    for r in rows.sort_values(["turn", "role"]).itertuples():
        if r.role == "user":
            state, kind = step_focus(state, r.content or "")
            out.append((r.conv_id, r.turn, kind, state["active"], len(state["stack"])))
    return pd.DataFrame(out, columns=["conv_id", "turn", "kind", "active", "depth"])


def focus_states(messages: DataFrame) -> DataFrame:
    """The focus after each user message; a conversation is one ordered fold, so it is one group's work."""
    return messages.groupBy("conv_id").applyInPandas(focus_fold, FOCUS)


def context(messages: DataFrame, items: DataFrame, chars: int = 900) -> DataFrame:
    """conv_id, prompt: summary, memory items and recent turns as one text of `chars` characters at most."""
    summary = fallback_summary(messages)
    facts = items.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "summary"))), lambda x: F.concat(F.lit("- "), x["summary"])), "\n").alias("facts"))
    return summary.join(facts, "conv_id", "left").select("conv_id", F.substring(F.concat_ws("\n\n", F.concat(F.lit("Summary:\n"), "summary"), F.concat(F.lit("Memory:\n"), "facts")), 1, chars).alias("prompt"))



def may_summarise(summaries: DataFrame, seconds: int = 300) -> DataFrame:
    """conv_id, free of summaries(conv_id, status, age_s): a running summary younger than `seconds` keeps its lock."""
    held = (F.col("status") == "running") & (F.coalesce(F.col("age_s"), F.lit(0)) < seconds)
    return summaries.select("conv_id", (~F.coalesce(held, F.lit(False))).alias("free"))


def merge_recall(lists: DataFrame, top_k: int = 6) -> DataFrame:
    """query_id, rank, item_id, score of several recalls' hits(query_id, item_id, score): an item's best score counts."""
    best = lists.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "item_id", "score")


# Headers of topics in an answer, and the digits of their labels.
TOPIC = "^[ \\t]*(?:#{1,6}[ \\t]*)?(?:方向|选题|方案|topic|option)[ \\t]*([0-9一二三四五六七八九十]+)[:：.、 \\t]*(.*)$"
CJK_DIGITS = "一二三四五六七八九"


def topics(messages: DataFrame) -> DataFrame:
    """conv_id, label, turn, content, seq: the numbered topics of assistant messages, each with its lines up to the next
    one; Chinese digits are read as numbers, so both spellings are one label."""
    lines = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    number = F.translate(F.regexp_extract("line", f"(?i){TOPIC}", 1), CJK_DIGITS, "123456789")
    rows = lines.withColumn("label", F.nullif(number, F.lit("")))
    section = Window.partitionBy("conv_id", "turn").orderBy("pos")
    rows = rows.withColumn("section", F.last("label", ignorenulls=True).over(section)).withColumn("no", F.count("label").over(section)).where("section is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id", "turn", "no", F.col("section").alias("label")).agg(tx.strip(text).alias("content"), F.min("pos").alias("seq")).select("conv_id", "label", "turn", "content", "seq")


def referenced_topic(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """query_id, label, content: the stored topic (conv_id, label, content) that a query (query_id, conv_id, text) names by
    its number; the longest if there are several."""
    named = F.regexp_extract("text", "(?i)(?:方向|选题|方案|topic|option|第)[ ]*([0-9一二三四五六七八九]+)", 1)
    asked = queries.withColumn("label", F.translate(named, CJK_DIGITS, "123456789")).where("label <> ''")
    met = asked.join(stored.select("conv_id", "label", "content"), ["conv_id", "label"])
    return met.groupBy("query_id", "label").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"))
