"""Spooled requests, replays and leases that end by themselves."""

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lakeloom.streaming import spool

NOW = "2024-02-01 00:00:00"


def put(folder, task, fence, body):
    place = folder / task / str(fence)
    place.mkdir(parents=True)
    (place / "request.json").write_text(body if isinstance(body, str) else json.dumps(body))


def request(task, fence, text, **more):
    return {"task": task, "fence": fence, "input": text, "sha256": hashlib.sha256(text.encode()).hexdigest(), "deadline": "2024-03-01 00:00:00"} | more


def drive(spark, tmp_path, sink):
    stream = spool.validated(spool.requests(spark, str(tmp_path / "in")), NOW)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(100)


def test_requests_are_committed_once(spark, tmp_path):
    put(tmp_path / "in", "a", 1, request("a", 1, "first"))
    put(tmp_path / "in", "a", 2, request("a", 2, "second"))
    put(tmp_path / "in", "b", 1, request("b", 1, "é", deadline="2024-01-01 00:00:00"))
    put(tmp_path / "in", "c", 1, request("c", 1, "x", sha256="00"))
    put(tmp_path / "in", "d", 1, request("d", 2, "x"))
    put(tmp_path / "in", "e", 1, request("e", 1, "x", more=1))
    put(tmp_path / "in", "f", 1, "not json")
    put(tmp_path / "in", "g", 1, request("g", 1, "x") | {"fence": "no"})
    seen = []
    commit = spool.committing(str(tmp_path / "out"))

    def sink(df, n):
        seen.extend(df.collect())
        commit(df, n)
        commit(df, n)  # the batch again, as after a lost driver

    drive(spark, tmp_path, sink)
    assert sorted((r["reason"] or "", r["task"] or "") for r in seen) == sorted([("", "a"), ("", "a"), ("DEADLINE", "b"), ("DIGEST", "c"), ("PLACE", "d"), ("KEYS", "e"), ("NOT_JSON", ""), ("TYPES", "g")])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["task"], r["fence"]) for r in out.collect()) == [("a", 1), ("a", 2)]
    assert [tuple(r) for r in spool.current_results(out).collect()] == [("a", 2, "second")]
    # the same requests under another checkpoint make no second commit
    stream = spool.validated(spool.requests(spark, str(tmp_path / "in")), NOW)
    q = stream.writeStream.foreachBatch(lambda df, n: commit(df, n + 100)).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_leases_end_with_the_watermark(spark, tmp_path):
    def ts(second):
        return datetime.fromtimestamp(1000 + second, timezone.utc)

    batches = [
        [(1, "claim", 0, ts(0), 10), (2, "claim", 0, ts(1), 10), (1, "claim", 0, ts(2), 10)],
        [(2, "renew", 1, ts(8), 20), (3, "claim", 0, ts(20), 5)],
        [(1, "finish", 1, ts(21), 0), (1, "claim", 0, ts(22), 50), (2, "finish", 1, ts(23), 0), (9, "claim", 0, ts(60), 1000)],
        [(9, "renew", 1, ts(61), 1000)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "job long, kind string, fence long, ts timestamp, seconds int").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = []
        for n in range(len(batches)):  # a start for each file: the state comes back from the checkpoint
            events = spark.readStream.schema("job long, kind string, fence long, ts timestamp, seconds int").option("pathGlobFilter", "*.parquet").parquet(*[str(tmp_path / "in" / f"n={n}")])
            q = spool.leases(events).writeStream.foreachBatch(lambda df, _: rows.extend(df.select("job", "event", "fence", (F.unix_timestamp("at") - 1000).alias("at")).collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(100)
    finally:
        spark.conf.unset(key)
    got = {tuple(r) for r in rows}
    assert {(1, "claimed", 1, 0), (2, "claimed", 1, 1), (1, "refused", 1, 2), (3, "claimed", 1, 20), (1, "expired", 1, 10), (1, "late", 1, 21), (1, "claimed", 2, 22), (2, "finished", 1, 23), (3, "expired", 1, 25)} <= got
    assert not any(r[:2] == (2, "expired") for r in got)
