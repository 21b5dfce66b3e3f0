"""Extensions beyond the operator inventory: event-time windows, cubes, as-of joins, generic joins and aggregates over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.registry import query


@query("x01_tumbling_window", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def x01(v):
    w = v.table("events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.col("w.start").alias("start"), "n")


@query("x02_sliding_window", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 1 DAY AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1")
def x02(v):
    w = v.table("events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


@query("x03_session_window", "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS new FROM events), s AS (SELECT user_id, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s, ts FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s")
def x03(v):
    g = v.table("events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


@query("x04_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x04(v):
    return v.table("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("x05_star_join", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def x05(v):
    o = v.table("orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").select("o_orderkey", "o_custkey")
    j = v.table("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(v.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(v.table("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x06_as_of_join", "SELECT p.event_id, max(c.ts) AS clicked FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1")
def x06(v):
    """The last click before each purchase: one union and one window instead of a range join."""
    e = v.table("events").where("event_type IN ('click', 'purchase')").select("event_id", "user_id", "event_type", "ts")
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    return e.withColumn("clicked", F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(w)).where("event_type = 'purchase'").select("event_id", "clicked")


@query("x07_anti_semi", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def x07(v):
    return v.table("customer").join(v.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("x08_full_outer", "SELECT coalesce(c.nation, s.nation) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) s ON c.nation = s.nation")
def x08(v):
    c = v.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = v.table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").na.fill(0, ["customers", "suppliers"])


@query("x09_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def x09(v):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return v.table("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(charge), 2).alias("charge"), F.count("*").alias("n"))
