"""Work queue, money ledger and event stream in batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.registry import query, shared
from ..sources.views import EVENTS_SQL, TASKS_SQL, stream, tasks


@query(
    "finished_visible_jobs", "FLT-07", "JOIN-04", "JOIN-05", "AGG-04", "STM-23",
    oracle=f"""WITH {TASKS_SQL} SELECT o_orderkey AS job_id FROM orders o WHERE o_orderstatus = 'F' AND o_orderkey IS DISTINCT FROM o_custkey
AND EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = o.o_orderkey) AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = o.o_orderkey AND t.flag = 'N')""",
)
def finished_visible_jobs(t):
    all_tasks = t("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("flag"))
    jobs = t("orders").filter("o_orderstatus = 'F'").filter(~F.col("o_orderkey").eqNullSafe(F.col("o_custkey"))).select(F.col("o_orderkey").alias("job_id"))
    return jobs.join(all_tasks, "job_id", "left_semi").join(all_tasks.filter("flag = 'N'"), "job_id", "left_anti")


@query(
    "fair_claim_order", "SRT-08", "STM-01", "JOIN-03", "AGG-05",
    oracle=f"""WITH {TASKS_SQL}, last AS (SELECT job_id, max(due) AS claimed FROM tasks WHERE flag <> 'N' GROUP BY job_id),
p AS (SELECT t.job_id, t.task_no, row_number() OVER (PARTITION BY t.job_id ORDER BY t.task_no) AS turn, coalesce(l.claimed, o.o_orderdate) AS since, o.o_orderdate AS created
FROM tasks t JOIN orders o ON o.o_orderkey = t.job_id LEFT JOIN last l ON l.job_id = t.job_id WHERE t.flag = 'N')
SELECT job_id, task_no, turn FROM p ORDER BY turn, since, created, job_id, task_no""",
)
def fair_claim_order(t):
    """Pending tasks round robin over jobs, the job claimed longest ago first."""
    all_tasks = tasks(t("lineitem"))
    last = all_tasks.filter("flag <> 'N'").groupBy("job_id").agg(F.max("due").alias("claimed"))
    turn = Window.partitionBy("job_id").orderBy("task_no")
    pending = all_tasks.filter("flag = 'N'").withColumn("turn", F.row_number().over(turn))
    jobs = t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"))
    rows = pending.join(jobs, "job_id").join(last, "job_id", "left").withColumn("since", F.coalesce("claimed", "created"))
    return rows.orderBy("turn", "since", "created", "job_id", "task_no").select("job_id", "task_no", "turn")


@query(
    "budget_totals", "AGG-01", "AGG-02", "STM-06", "STM-19",
    oracle=f"""WITH {TASKS_SQL}, p AS (SELECT job_id, CASE WHEN flag = 'R' AND quantity = 50 THEN NULL WHEN flag IN ('A', 'R') THEN micro WHEN line = 'O' THEN micro ELSE 0 END AS amount, flag, line FROM tasks)
SELECT job_id, count(*) AS permits, count(CASE WHEN flag = 'N' AND line = 'O' THEN 1 END) AS reserved, CASE WHEN count(*) = count(amount) THEN CAST(sum(amount) AS BIGINT) END AS total FROM p GROUP BY job_id""",
)
def budget_totals(t):
    """Settled and reserved money of a job; one unknown amount makes the total unknown."""
    amount = F.when((F.col("flag") == "R") & (F.col("quantity") == 50), None).when(F.col("flag").isin("A", "R") | (F.col("line") == "O"), F.col("micro")).otherwise(0)
    p = tasks(t("lineitem")).withColumn("amount", amount)
    known = F.count("*") == F.count("amount")
    return p.groupBy("job_id").agg(F.count("*").alias("permits"), F.count_if((F.col("flag") == "N") & (F.col("line") == "O")).alias("reserved"), F.when(known, F.sum("amount")).alias("total"))


@query(
    "budget_gate", "STM-07", "VAL-07",
    oracle="""WITH r AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 1000000) AS BIGINT) AS want, o_orderdate FROM orders),
s AS (SELECT *, sum(want) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS upto FROM r)
SELECT o_custkey, o_orderkey, CAST(upto AS BIGINT) AS upto, upto <= 500000000000 AS granted FROM s""",
)
def budget_gate(t):
    run = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    upto = F.sum(F.round(F.col("o_totalprice") * 1000000).cast("long")).over(run)
    return t("orders").select("o_custkey", "o_orderkey", upto.alias("upto")).withColumn("granted", F.col("upto") <= 500000000000)


@query(
    "usage_cost", "AGG-17", "AGG-20", "FN-17",
    oracle=f"""WITH {TASKS_SQL} SELECT job_id, task_no, CASE WHEN quantity % 5 > quantity THEN NULL ELSE ((quantity - quantity % 5) * 1000 * 3 + (quantity % 5) * 1000 + quantity * 100 * 15 + 999999) // 1000000 END AS cost FROM tasks""",
)
def usage_cost(t):
    cost = F.expr("((quantity - quantity % 5) * 1000 * 3 + (quantity % 5) * 1000 + quantity * 100 * 15 + 999999) div 1000000")
    return tasks(t("lineitem")).select("job_id", "task_no", F.when(F.col("quantity") % 5 <= F.col("quantity"), cost).alias("cost"))


@query(
    "expired_lease_decisions", "STM-04", "STM-14", "STM-22", "FN-11",
    oracle=f"""WITH {TASKS_SQL}, a AS (SELECT job_id, task_no, flag, line, due, CAST(quantity % 5 AS INTEGER) AS attempts FROM tasks)
SELECT a.job_id, a.task_no, CASE WHEN flag = 'R' AND line = 'O' THEN 'unknown_money' WHEN o.o_orderstatus = 'F' THEN 'cancelled' WHEN attempts >= 3 THEN 'failed' WHEN flag = 'A' THEN 'checkpoint' ELSE 'retry' END AS decision,
CAST(greatest(quantity_wait, least(power(2, attempts), 30)) AS BIGINT) AS backoff
FROM (SELECT *, CASE WHEN flag = 'A' THEN 7 ELSE 0 END AS quantity_wait FROM a) a JOIN orders o ON o.o_orderkey = a.job_id WHERE a.due <= TIMESTAMP '1997-01-01 00:00:00'""",
)
def expired_lease_decisions(t):
    a = tasks(t("lineitem")).filter(F.col("due") <= F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).withColumn("attempts", F.col("quantity") % 5)
    rows = a.join(t("orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus"), "job_id")
    decision = F.when((F.col("flag") == "R") & (F.col("line") == "O"), "unknown_money").when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("attempts") >= 3, "failed").when(F.col("flag") == "A", "checkpoint").otherwise("retry")
    backoff = F.greatest(F.when(F.col("flag") == "A", 7).otherwise(0).cast("double"), F.least(F.pow(F.lit(2.0), "attempts"), F.lit(30.0))).cast("long")
    return rows.select("job_id", "task_no", decision.alias("decision"), backoff.alias("backoff"))


@query(
    "job_status_from_tasks", "AGG-03", "TRN-08", "TRN-09", "STM-03",
    oracle=f"""WITH {TASKS_SQL}, s AS (SELECT job_id, count(*) AS n, bool_and(flag <> 'N') AS finished, bool_or(flag = 'R') AS returned, min(CASE flag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS priority FROM tasks GROUP BY job_id)
SELECT o_orderkey AS job_id, coalesce(n, 0) AS n, finished, returned, CASE priority WHEN 1 THEN 'failed' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded' ELSE 'empty' END AS status FROM orders LEFT JOIN s ON s.job_id = o_orderkey""",
)
def job_status_from_tasks(t):
    p = F.when(F.col("flag") == "R", 1).when(F.col("flag") == "N", 2).otherwise(3)
    s = t("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("flag")).groupBy("job_id").agg(F.count("*").alias("n"), F.bool_and(F.col("flag") != "N").alias("finished"), F.bool_or(F.col("flag") == "R").alias("returned"), F.min(p).alias("priority"))
    status = F.when(F.col("priority") == 1, "failed").when(F.col("priority") == 2, "running").when(F.col("priority") == 3, "succeeded").otherwise("empty")
    return t("orders").select(F.col("o_orderkey").alias("job_id")).join(s, "job_id", "left").select("job_id", F.coalesce("n", F.lit(0)).alias("n"), "finished", "returned", status.alias("status"))


@query("event_generations", "STM-09", "WIN-16", "SRC-14", oracle=f"WITH {EVENTS_SQL} SELECT job_id, generation, event_id, event_id - lag(event_id) OVER (PARTITION BY job_id ORDER BY generation) AS gap FROM stream QUALIFY generation > 20 AND generation <= 120")
def event_generations(t):
    """Per-job sequence numbers and gaps; a bounded replay after a cursor."""
    rows = stream(t("events"))
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("job_id").orderBy("generation"))
    return rows.select("job_id", "generation", "event_id", gap.alias("gap")).filter("generation > 20 AND generation <= 120")


@query("status_changes", "STM-12", oracle=f"WITH {EVENTS_SQL}, c AS (SELECT *, lag(kind) OVER (PARTITION BY job_id ORDER BY generation) AS before FROM stream) SELECT job_id, generation, before, kind FROM c WHERE before IS DISTINCT FROM kind")
def status_changes(t):
    before = F.lag("kind").over(Window.partitionBy("job_id").orderBy("generation"))
    return stream(t("events")).withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("kind"))).select("job_id", "generation", "before", "kind")


@query(
    "attempt_timeline", "WIN-11", "WIN-12", "STM-20", "STM-15",
    oracle="""SELECT user_id AS job_id, epoch_us(min(CASE WHEN event_type = 'view' THEN ts END)) AS started_us, epoch_us(max(CASE WHEN event_type = 'purchase' THEN ts END)) AS finished_us,
greatest(0, (epoch_us(coalesce(max(CASE WHEN event_type = 'purchase' THEN ts END), TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(min(ts))) // 1000) AS execution_ms, max(ts) < TIMESTAMP '2024-01-29 00:00:00' AS stale FROM events GROUP BY user_id""",
)
def attempt_timeline(t):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    ended = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    g = t("events").groupBy(F.col("user_id").alias("job_id")).agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("s"), ended.alias("e"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    end = F.coalesce("e", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    ms = F.greatest(F.lit(0), F.floor((micros(end) - micros(F.col("first"))) / 1000).cast("long"))
    return g.select("job_id", micros(F.col("s")).alias("started_us"), micros(F.col("e")).alias("finished_us"), ms.alias("execution_ms"), (F.col("last") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).alias("stale"))


@query(
    "late_results", "STM-05", "STM-25", "STM-02",
    oracle=f"""WITH {EVENTS_SQL}, f AS (SELECT job_id, max(generation) AS fence FROM stream GROUP BY job_id)
SELECT s.event_id, s.generation < f.fence AS late, CASE WHEN s.generation = f.fence THEN 'content' WHEN s.kind = 'purchase' THEN 'ledger' ELSE 'rejected' END AS route FROM stream s JOIN f ON f.job_id = s.job_id""",
)
def late_results(t):
    """Only the newest fence may write content; money is settled however late."""
    fence = F.max("generation").over(Window.partitionBy("job_id"))
    rows = stream(t("events")).withColumn("fence", fence)
    route = F.when(F.col("generation") == F.col("fence"), "content").when(F.col("kind") == "purchase", "ledger").otherwise("rejected")
    return rows.select("event_id", (F.col("generation") < F.col("fence")).alias("late"), route.alias("route"))


@query("command_receipts", "STM-10", "STM-28", "JOIN-30", oracle=f"WITH {EVENTS_SQL} SELECT job_id, kind, props AS body, min(event_id) AS receipt, count(*) AS replays FROM stream WHERE ts > TIMESTAMP '2024-01-24 00:00:00' GROUP BY job_id, kind, props")
def command_receipts(t):
    recent = t("events").filter(F.col("ts") > F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"))
    return recent.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("props").alias("body")).agg(F.min("event_id").alias("receipt"), F.count("*").alias("replays"))


shared("current_pointer", "VER-11", "STM-13", "STM-26", sql="SELECT user_id, event_id AS current_event, event_type AS current_kind FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'click')) x WHERE n = 1")
shared("document_job_view", "WIN-09", "VER-17", "VER-18", sql="SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS n FROM orders) x WHERE n = 1")
shared("previous_job_guard", "JOIN-30", "JOIN-31", sql="SELECT o.o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_linestatus = 'O') THEN 'unknown' WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'N') THEN 'active' WHEN o.o_orderstatus = 'O' THEN 'leased' ELSE 'free' END AS code FROM orders o")
shared("retention_plan", "STM-17", "SRT-14", sql="SELECT e.event_id, e.user_id FROM events e WHERE e.ts < TIMESTAMP '2024-01-05 00:00:00' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id AND l.quality = 1) ORDER BY e.event_id LIMIT 1001")
shared("clearable_jobs", "AGG-04", "STM-23", sql="SELECT count(*) AS clearable FROM orders o WHERE o.o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')")
shared("dispatch_overview", "AGG-02", "AGG-26", sql="SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY o_orderstatus")
