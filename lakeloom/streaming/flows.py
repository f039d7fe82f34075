"""The stream operators as Structured Streaming queries.

Each takes a streaming (or batch) DataFrame of the event schema and returns one;
``run_once`` drives a bounded source to completion, which is how the tests hold
a stream to its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Event files of a folder as a stream, one file a trigger."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def first_receipts(events: DataFrame, ttl: str = "7 days") -> DataFrame:
    """Exactly-once commands: a key's first event within the receipt's life."""
    return _timed(events, ttl).dropDuplicatesWithinWatermark(["user_id", "event_type", "props"])


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "40 days") -> DataFrame:
    g = _timed(events, delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def ledger(events: DataFrame, limit: int) -> DataFrame:
    """Money permits per job: ``purchase`` reserves ``value``, ``refund`` releases it.

    State is the open amount and the last event seen; an event that arrives again
    (same or older id) changes nothing, a reservation above the limit is refused.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, last = state.get if state.exists else (0, -1)
        granted = refused = 0
        for f in frames:
            for event, kind, micro in f.sort_values("event_id")[["event_id", "event_type", "micro"]].itertuples(index=False):
                if event <= last:
                    continue
                last = event
                if kind == "refund":
                    spent = max(0, spent - micro)
                elif spent + micro <= limit:
                    spent, granted = spent + micro, granted + 1
                else:
                    refused += 1
        state.update((spent, last))
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent], "granted": [granted], "refused": [refused]})

    money = events.filter(F.col("event_type").isin("purchase", "refund")).select("user_id", "event_id", "event_type", F.round(F.col("value") * 1_000_000).cast("long").alias("micro"))
    return money.groupBy("user_id").applyInPandasWithState(fold, "user_id long, spent long, granted long, refused long", "spent long, last long", "update", GroupStateTimeout.NoTimeout)


def leases(events: DataFrame, lease: str = "60 seconds") -> DataFrame:
    """Sessions of a job's heartbeats: a lease ends when none comes for its length."""
    g = _timed(events, lease).groupBy("user_id", F.session_window("ts", lease).alias("w")).agg(F.count("*").alias("beats"))
    return g.select("user_id", F.col("w.start").alias("claimed"), F.col("w.end").alias("expires"), "beats")


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drive a stream over what its source holds; restarts continue from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
