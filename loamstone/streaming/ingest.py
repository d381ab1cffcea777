"""Incremental ingestion with Structured Streaming: the checkpoint is the consumer's offset, so nothing is extracted twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType


def message_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def extraction_triggers(messages: DataFrame, every: int = 5, chat: str = "chat_id") -> DataFrame:
    """(chat, last_id, turns): a row whenever a chat has ``every`` user turns since its last one; the state is one counter per chat."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        out = []
        for i in sorted(i for batch in batches for i, role in zip(batch["id"], batch["role"], strict=True) if role == "user"):
            count += 1
            if count >= every:
                out.append((key[0], int(i), count))
                count = 0
        state.update((count,))
        yield pd.DataFrame(out, columns=[chat, "last_id", "turns"])

    kind = messages.schema[chat].dataType.simpleString()
    return messages.groupBy(chat).applyInPandasWithState(run, f"{chat} {kind}, last_id long, turns long", "turns int", "append", GroupStateTimeout.NoTimeout)


class _Extraction(StatefulProcessor):
    """One counter and one timer for each chat."""

    def __init__(self, every: int, silence_ms: int, names: list[str], moment: str) -> None:
        self.every, self.silence_ms, self.names, self.moment = every, silence_ms, names, moment

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "turns int, last_id long, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        turns, last_id, last_ms = self.count.get() if self.count.exists() else (0, None, 0)
        out = []
        new = pd.concat(list(rows))  # what one trigger brings of a chat
        moments = new[self.moment].astype("datetime64[ms]").astype("int64").tolist()
        for ms, i, role in sorted(zip(moments, new["id"].tolist(), new["role"].tolist(), strict=True)):
            last_ms = max(last_ms, ms)
            if role == "user":
                turns, last_id = turns + 1, i
                if turns >= self.every:
                    out.append((*key, last_id, turns, "turns"))
                    turns = 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last_ms + self.silence_ms)
        self.count.update((turns, last_id, last_ms))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.count.exists():
            turns, last_id, _ = self.count.get()
            out = [(*key, last_id, turns, "silence")] if turns else []
            self.count.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def extraction_events(messages: DataFrame, every: int = 5, silence: float = 3600.0, chat: str = "chat_id", moment: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(chat, last_id, turns, reason) of a stream of messages (chat, id, role, moment timestamp): a row whenever a chat has ``every`` user turns since its last one (turns), and one for what
    is left when a chat has been silent for so many seconds of event time (silence). Then its state goes, so only live chats have any.

    Rows that come later than the watermark are left out here; a batch sweep over unextracted rows finds them. The session needs the RocksDB state store.
    """
    own = messages.select(chat, "id", "role", moment).withWatermark(moment, late)
    kind = messages.schema[chat].dataType.simpleString()
    processor = _Extraction(every, int(silence * 1000), [chat, "last_id", "turns", "reason"], moment)
    return own.groupBy(chat).transformWithStateInPandas(processor, f"{chat} {kind}, last_id long, turns long, reason string", "Append", "EventTime")


def windowed_counts(events: DataFrame, moment: str = "ts", length: str = "1 hour", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts per window and kind; events later than the watermark are left out."""
    return events.withWatermark(moment, late).groupBy(F.window(moment, length), by).agg(F.count("*").alias("n")).select("window.start", by, "n")


def foreach_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``apply`` on all that has arrived and ends; a batch seen again has the same number, so an idempotent sink applies it once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_changes(queue: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """The last revision of each key in an outbox: what is left to apply."""
    order = Window.partitionBy(*key).orderBy(F.desc(revision))
    return queue.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def acknowledged(queue: DataFrame, done: DataFrame, key: list[str], revision: str = "revision") -> DataFrame:
    """Without the entries applied, at the very revision that was applied; later ones stay."""
    return queue.join(done.select(*key, revision), [*key, revision], "left_anti")


def tracked_changes(before: DataFrame, after: DataFrame, key: str, ignored: tuple[str, ...] = ("recall_count", "last_recalled", "importance", "updated_at")) -> DataFrame:
    """(key, action) of a change feed; updates of ignored columns alone are none."""
    columns = [c for c in after.columns if c not in (key, *ignored)]
    side = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = side(before, "old").join(side(after, "new"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("new").isNull(), "delete").otherwise("upsert").alias("action"))


def bounded_history(events: DataFrame, key: str = "character", most: int = 25) -> DataFrame:
    """The last events of each key with their sequence numbers."""
    numbered = events.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy("id")))
    return numbered.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))).where(F.col("_n") <= most).drop("_n")
