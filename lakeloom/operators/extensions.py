"""What users of a Spark engine expect beyond the inventory: analytic SQL over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query, shared

shared(
    "pricing_summary", "EXT-OLAP",
    sql="""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
shared(
    "revenue_by_nation", "EXT-OLAP",
    sql="""SELECT n.n_name, r.r_name, count(DISTINCT o.o_orderkey) AS orders, CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY n.n_name, r.r_name""",
)
shared("status_rollup", "EXT-OLAP", sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
shared("top_customers", "EXT-OLAP", sql="SELECT c.c_custkey, c.c_name, count(*) AS orders FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name ORDER BY orders DESC, c.c_custkey LIMIT 20")


@query("hourly_windows", "EXT-WINDOW", oracle="SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_windows(t):
    g = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query(
    "sessions", "EXT-WINDOW",
    oracle="""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session""",
)
def sessions(t):
    from pyspark.sql import Window

    g = t("events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("session"), "n")
