"""Streaming twins of the dialogue operators: session memory as keyed state, counters with a watermark, token streams."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sutraloom.operators.dialogue import CONDITIONS, REMEMBERED

MEMORY_SCHEMA = "session_id string, seen bigint, remembered array<string>, conditions array<string>"


def session_memory(remembered: int = REMEMBERED) -> StatefulProcessor:
    """The keyed state of a session. The class is made here so that it travels whole: the streaming runner on the driver
    has no other way to find it where the package is not installed."""
    conditions = CONDITIONS

    class SessionMemory(StatefulProcessor):
        """Keeps a session's last messages and the conditions that its user named, in order; gives the state after each batch.

        Messages may come in any order and in any batch: the last ones are those of the highest seq, and a condition counts
        from the lowest seq that names it. Of repeated deliveries the first to arrive counts, however much later the others
        come. State per session: `remembered` messages, and the seqs seen as ranges, which are few where seqs have few gaps."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.messages = handle.getValueState("messages", "seqs array<bigint>, lines array<string>, ranges array<bigint>")
            self.conditions = handle.getValueState("conditions", "names array<string>, seqs array<bigint>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            kept = self.messages.get() if self.messages.exists() else ([], [], [])
            last, ranges = dict(zip(kept[0], kept[1])), list(kept[2])  # ranges: first and last seq of each, in order
            first = dict(zip(*self.conditions.get())) if self.conditions.exists() else {}
            batch = pd.concat(list(rows)).sort_values(["seq", "arrived_at", "content"], kind="stable").drop_duplicates("seq")
            for seq, role, content in zip(batch["seq"], batch["role"], batch["content"]):
                seq = int(seq)
                at = bisect.bisect_left(ranges, seq)
                if at % 2 or at < len(ranges) and ranges[at] == seq:
                    continue  # inside a range, or its first or last
                ranges[at:at] = [seq, seq]
                if at + 2 < len(ranges) and ranges[at + 2] == seq + 1:
                    del ranges[at + 1 : at + 3]
                if at and ranges[at - 1] == seq - 1:
                    del ranges[at - 1 : at + 1]
                text = "" if content is None else content
                last[seq] = f"{(role or '').upper()}: {text}"
                if role == "user":
                    for c in conditions:
                        if c in text.lower():
                            first[c] = min(seq, first.get(c, seq))
            seqs = sorted(last)[-remembered:]
            lines, seen = [last[s] for s in seqs], sum(ranges[1::2]) - sum(ranges[::2]) + len(ranges) // 2
            names = sorted(first, key=lambda c: (first[c], conditions.index(c)))
            self.messages.update((seqs, lines, ranges))
            self.conditions.update((names, [first[c] for c in names]))
            yield pd.DataFrame({"session_id": [key[0]], "seen": [seen], "remembered": [lines], "conditions": [names]})

        def close(self) -> None:
            pass

    return SessionMemory()


def remember(messages: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """The memory of each session after each batch of a message stream (update mode; RocksDB state store)."""
    arrived = F.col("arrived_at") if "arrived_at" in messages.columns else F.lit(None).cast("timestamp")
    rows = messages.select("session_id", "seq", "role", "content", arrived.alias("arrived_at")).where(F.col("session_id").isNotNull() & F.col("seq").isNotNull())
    return rows.groupBy("session_id").transformWithStateInPandas(session_memory(remembered), MEMORY_SCHEMA, "Update", "none")


def counters(messages: DataFrame, event_time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Messages per session and window, repeated deliveries once within the watermark (append mode)."""
    once = messages.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["session_id", "seq"])
    return once.groupBy(F.window(event_time, width), "session_id").agg(F.count("*").alias("message_count"))


def readable_tokens(tokens: DataFrame, token: str) -> DataFrame:
    """A token stream without a model's control marks."""
    return tokens.where(~F.regexp_like(F.col(token), F.lit(r"<\||\|>|eot_id")))


def folder_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a Parquet table, whether the table is a folder or one file."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    folder, _, name = files[0].rpartition("/")
    one = len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rpartition("/")[2])
    return spark.readStream.schema(table.schema).option("pathGlobFilter", name if one else "*.parquet").parquet(folder)


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an update-mode stream over what is there and gives all updates, with their batch: each batch is a folder of
    its own below `folder`, so that one which is repeated after a failure replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
