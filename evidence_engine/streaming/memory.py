"""Conversation memory as a stream: keyed state that follows the messages as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidence_engine.operators.memory import FOCUS, step_focus

MESSAGES = "conv_id long, turn long, role string, text string"
STATE = "active string, stack array<string>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One micro-batch of one conversation: its messages in order through the focus state."""
    now = dict(zip(("active", "stack"), state.get, strict=True)) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values(["turn", "role"])
    out = []
    for r in rows.itertuples():
        if r.role == "user":
            now, kind = step_focus({k: v for k, v in now.items() if v is not None}, r.text or "")
            out.append((key[0], r.turn, kind, now["active"], len(now["stack"])))
    if now:
        state.update((now["active"], list(now["stack"])))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "kind", "active", "depth"])


def focus_stream(messages: DataFrame) -> DataFrame:
    """The focus after each user message of a stream (conv_id, turn, role, text); messages of a conversation must
    arrive in order of turns over the micro-batches."""
    return messages.groupBy("conv_id").applyInPandasWithState(_advance, FOCUS, STATE, "append", GroupStateTimeout.NoTimeout)


def run_over(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Drive a folder of Parquet files through focus_stream into a Parquet sink, once over what is there.

    The sink commits a batch's files atomically and the checkpoint holds offsets and state, so a restart goes on exactly
    where the last run ended.
    """
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = focus_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
