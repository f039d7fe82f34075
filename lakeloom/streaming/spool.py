"""Spooled requests and leases as streams.

Requests are files ``task/fence/request.json``; a file stream reads each once, a
strict reader accepts or refuses it, and the sink commits a (task, fence) once: a
batch that is replayed after a lost driver overwrites its own folder, and what
another batch has committed is left out.

Leases are a keyed state with event-time timers: a lease that nobody renews ends
by itself when the watermark passes it, without any row for its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# fixed values: the keys of a request
KEYS = ("deadline", "fence", "input", "sha256", "task")
REQUEST = "task string, fence long, input string, sha256 string, deadline timestamp"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, body)`` of every request file, one file at a time."""
    text = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "request.json").load(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def validated(files: DataFrame, now: str) -> DataFrame:
    """``(task, fence, input, reason)``: the first reason against a request, null if there is none.

    Its keys are exactly ``KEYS``, its place names its task and fence, its input
    has the digest it is bound to, and its deadline is not over.
    """
    r = F.from_json("body", REQUEST, {"mode": "PERMISSIVE"})
    rows = files.select("path", r.alias("r"), F.json_object_keys("body").alias("keys"))
    part = F.split("path", "/")
    reason = (
        F.when(F.col("r").isNull() | F.col("keys").isNull(), "NOT_JSON")
        .when(F.array_sort("keys") != F.array(*map(F.lit, KEYS)), "KEYS")
        .when(F.exists(F.array(F.col("r.task").isNull(), F.col("r.fence").isNull(), F.col("r.input").isNull(), F.col("r.sha256").isNull(), F.col("r.deadline").isNull()), lambda x: x), "TYPES")
        .when((F.element_at(part, -3) != F.col("r.task")) | (F.element_at(part, -2) != F.col("r.fence").cast("string")), "PLACE")
        .when(F.sha2(F.col("r.input").cast("binary"), 256) != F.col("r.sha256"), "DIGEST")
        .when(F.col("r.deadline") <= F.lit(now).cast("timestamp"), "DEADLINE")
    )
    return rows.select("r.task", "r.fence", "r.input", reason.alias("reason"))


def committing(target: str):
    """A ``foreachBatch`` sink into ``target``: every (task, fence) is committed once, whatever is replayed."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter("reason IS NULL").select("task", "fence", "input").dropDuplicates(["task", "fence"])
        own = f"{target}/batch={number}"
        try:
            done = spark.read.schema("task string, fence long, input string, batch long").parquet(target).filter(F.col("batch") != number)
            rows = rows.join(done, ["task", "fence"], "left_anti")
        except Exception as e:  # the first commit finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(own)

    return sink


def current_results(commits: DataFrame) -> DataFrame:
    """Of each task the commit of its highest fence; earlier fences were superseded."""
    return commits.groupBy("task").agg(F.max_by(F.struct("fence", "input"), "fence").alias("r")).select("task", "r.*")


LEASES = "job long, event string, fence long, at timestamp"


class Leases(StatefulProcessor):
    """Claims, renewals and results of one job; rows ``(job, kind, fence, ts, seconds)``."""

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "fence long, until long")

    def _open(self, now: int) -> tuple[int, int]:
        held = self.lease.get()
        return (held[0], held[1]) if held is not None else (0, -1)

    def _hold(self, fence: int, until: int, old: int) -> None:
        if old >= 0:
            self.handle.deleteTimer(old)
        if until >= 0:
            self.handle.registerTimer(until)
        self.lease.update((fence, until))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for frame in rows:
            for r in frame.sort_values(["ts", "fence"]).itertuples():
                now = int(r.ts.timestamp() * 1000)
                fence, until = self._open(now)
                if r.kind == "claim":
                    if until < now:
                        self._hold(fence + 1, now + int(r.seconds) * 1000, until)
                        out.append((key[0], "claimed", fence + 1, r.ts))
                    else:
                        out.append((key[0], "refused", fence, r.ts))
                elif r.fence != fence or until < now:
                    out.append((key[0], "late", int(r.fence), r.ts))
                elif r.kind == "renew":
                    self._hold(fence, now + int(r.seconds) * 1000, until)
                else:
                    self._hold(fence, -1, until)
                    out.append((key[0], "finished", fence, r.ts))
        yield pd.DataFrame(out, columns=["job", "event", "fence", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = expiredTimerInfo.getExpiryTimeInMs()
        fence, until = self._open(at)
        over = until == at
        if over:
            self.lease.update((fence, -1))
        yield pd.DataFrame([(key[0], "expired", fence, pd.Timestamp(at, unit="ms"))] if over else [], columns=["job", "event", "fence", "at"])

    def close(self) -> None:
        pass


def leases(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """What becomes of leases: ``(job, event, fence, at)``; events within ``delay`` of the latest are in time."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy("job").transformWithStateInPandas(Leases(), LEASES, "Append", "EventTime")
