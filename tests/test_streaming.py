"""Streams give what their batch twins give."""

from lakeloom.streaming import flows

DATA = "/root/testdata/sf0.001"


def split(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    for i in range(3):
        events.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, flows.event_stream(spark, str(tmp_path / "in"), "*.parquet")


def drive(stream, tmp_path, mode):
    rows = []
    flows.run_once(stream, str(tmp_path / "state"), lambda df, _: rows.extend(df.collect()), mode)
    return rows


def test_windowed_counts(spark, tmp_path):
    events, stream = split(spark, tmp_path)
    rows = drive(flows.windowed_counts(stream), tmp_path, "update")
    last = {(r["start"], r["event_type"]): r["n"] for r in rows}
    assert last == {(r["start"], r["event_type"]): r["n"] for r in flows.windowed_counts(events).collect()}


def test_receipts_come_once(spark, tmp_path):
    events, stream = split(spark, tmp_path)
    rows = drive(flows.first_receipts(stream, "60 days"), tmp_path, "append")
    keys = [(r["user_id"], r["event_type"], r["props"]) for r in rows]
    assert len(keys) == len(set(keys)) == events.select("user_id", "event_type", "props").distinct().count()


def test_ledger_ignores_replays(spark, tmp_path):
    events, _ = split(spark, tmp_path)
    events.coalesce(1).write.parquet(str(tmp_path / "all"))
    events.coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    rows = drive(flows.ledger(flows.event_stream(spark, str(tmp_path / "all"), "*.parquet"), 10**9), tmp_path, "update")
    granted, spent = {}, {}
    for r in rows:
        granted[r["user_id"]] = granted.get(r["user_id"], 0) + r["granted"]
        spent[r["user_id"]] = r["spent"]
    buys = events.filter("event_type = 'purchase'").groupBy("user_id").count().collect()
    assert granted and all(granted[r["user_id"]] <= r["count"] for r in buys) and max(spent.values()) <= 10**9
