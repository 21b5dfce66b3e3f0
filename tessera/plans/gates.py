"""Rate limits, quotas, budgets, caches and request decisions over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import times
from tessera.operators import gates as G
from tessera.plans.registry import query

_MIN = "strftime(ts + INTERVAL 7 HOUR, '%Y%m%d%H%M')"
_DAY = "strftime(ts + INTERVAL 7 HOUR, '%Y%m%d')"
_MONTH = "strftime(ts + INTERVAL 7 HOUR, '%Y%m')"


@query(
    "c01_minute_rate",
    f"""SELECT event_id, user_n, tenant_n, CASE WHEN user_n > 1 THEN 'user_rate' WHEN tenant_n > 1 THEN 'tenant_rate' END AS reason FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY key, user_id, {_MIN} ORDER BY ts, event_id) AS BIGINT) AS user_n,
 CAST(row_number() OVER (PARTITION BY key, {_MIN} ORDER BY ts, event_id) AS BIGINT) AS tenant_n FROM v_requests) x""",
)
def c01(v):
    return G.minute_limits(v.requests, 1, 1).select("event_id", "user_n", "tenant_n", "reason")


@query("c02_daily_counter", f"SELECT event_id, n, n <= 3 AS allowed FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS BIGINT) AS n FROM v_requests) x")
def c02(v):
    return G.fixed_window(v.requests, ["user_id"], times.day_key(F.col("ts")), 3, "ts", "event_id").select("event_id", "n", "allowed")


@query("c02_daily_unlimited", "SELECT event_id, true AS allowed FROM v_requests")
def c02u(v):
    return G.fixed_window(v.requests, ["user_id"], times.day_key(F.col("ts")), 0, "ts", "event_id").select("event_id", "allowed")


@query("c03_monthly_check", f"SELECT event_id, n <= 300 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY key, {_MONTH} ORDER BY ts, event_id) AS n FROM v_requests) x")
def c03(v):
    return G.fixed_window(v.requests, ["key"], times.month_key(F.col("ts")), 300, "ts", "event_id").select("event_id", "allowed")


_DELTA = "SELECT key, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS delta FROM v_requests"


@query("c04_refund_floor", f"WITH d AS ({_DELTA}), r AS (SELECT key, delta, sum(delta) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM d) SELECT key, CAST(sum(delta) - least(0, min(run)) AS BIGINT) AS n FROM r GROUP BY 1")
def c04(v):
    return G.floored_counter(v.requests.withColumn("delta", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)), "key")


_RUN = f"SELECT *, CAST(sum(cost) OVER (PARTITION BY key, {_MONTH} ORDER BY ts, event_id) AS BIGINT) AS spent FROM v_requests"


@query("c05_running_cost", f"SELECT event_id, spent, CAST(spent * 100 // 20000 AS BIGINT) AS pct, CASE WHEN spent * 100 // 20000 >= 100 THEN 'hard_stop' WHEN spent * 100 // 20000 >= 85 THEN 'alert' WHEN spent * 100 // 20000 >= 70 THEN 'warn' ELSE 'ok' END AS state FROM ({_RUN}) r")
def c05(v):
    return G.running_budget(v.requests, 20_000).select("event_id", "spent", "pct", "state")


@query("c06_budget_gate", f"SELECT event_id, (spent - cost) * 100 // 20000 >= 100 AS blocked FROM ({_RUN}) r")
def c06(v):
    return G.running_budget(v.requests, 20_000).select("event_id", "blocked")


def _admitted(key, window, limit, table):
    """The limiter in SQL: a row of each key at a time, with its log of admitted times."""
    log = f"list_filter(r.log, lambda x: x > e.ms - {window})"
    return f"""WITH RECURSIVE e AS (SELECT {key} AS key, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM {table}),
 r(key, event_id, ms, n, allowed, log) AS (SELECT key, event_id, ms, n, {limit} > 0, CASE WHEN {limit} > 0 THEN [ms] ELSE [] END FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.event_id, e.ms, e.n, len({log}) < {limit}, CASE WHEN len({log}) < {limit} AND NOT list_contains({log}, e.ms) THEN list_append({log}, e.ms) ELSE {log} END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)"""


@query("c07_sliding_window", _admitted("key", 3_600_000, 1, "v_requests") + " SELECT key, event_id, ms, allowed FROM r")
def c07(v):
    return G.sliding_window(v.requests, "key", 3_600_000, 1)


@query("c08_global_ip_limiter", _admitted("user_id % 7", 1_800_000, 3, "events") + " SELECT event_id, allowed FROM r")
def c08(v):
    """Requests of all endpoints by address. The limit fits these tables' rates: some are over it."""
    e = v.table("events").select((F.col("user_id") % 7).alias("ip"), "event_id", "ts")
    return G.sliding_window(e, "ip", 1_800_000, 3).select("event_id", "allowed")


_OPS = "SELECT event_id, key, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 4 = 0 THEN 'put' ELSE 'get' END AS op FROM v_requests"


@query(
    "c11_ttl_cache",
    f"""WITH o AS ({_OPS}), g AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY key ORDER BY ms, event_id) > 3600000, true) AS gap FROM o),
 r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, event_id) AS run FROM g),
 h AS (SELECT *, coalesce(max(CASE WHEN op = 'put' THEN 1 ELSE 0 END) OVER (PARTITION BY key, run ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM r)
 SELECT event_id, hit FROM h WHERE op = 'get'""",
)
def c11(v):
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts)")
    ops = v.requests.select("event_id", "key", ms.alias("ms"), F.when(F.col("event_id") % 4 == 0, "put").otherwise("get").alias("op"))
    return G.ttl_lookups(ops, 3_600_000).select("event_id", "hit")


@query("c12_cache_invalidation", "SELECT id FROM v_usage WHERE NOT (tenant_id IN (3, 4)) OR tenant_id IS NULL")
def c12(v):
    gone = v.spark.createDataFrame([(3,), (4,)], "tenant_id long")
    return v.usage.join(F.broadcast(gone), "tenant_id", "left_anti").select("id")


@query("c13_faq_index", "SELECT b.item_id, CAST(count(*) AS BIGINT) AS hits FROM benchmark b JOIN benchmark o ON lower(b.text) = lower(o.text) GROUP BY 1")
def c13(v):
    """The index has a row for each text, so items that share one don't meet in pairs."""
    b = v.table("benchmark").select("item_id", F.sha2(F.lower("text"), 256).alias("h"))
    return b.join(b.groupBy("h").agg(F.count("*").alias("hits")), "h").groupBy("item_id").agg(F.sum("hits").alias("hits"))


@query("c14_tiered_lookup", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'faq' WHEN event_id % 5 = 0 THEN 'exact' WHEN key = 3 THEN 'semantic' ELSE 'miss' END AS tier FROM v_requests")
def c14(v):
    e = v.requests.withColumn("k1", F.col("user_id") % 7).withColumn("k2", F.col("event_id") % 5)
    one = lambda k: v.spark.createDataFrame([(k, f"a{k}")], "key long, answer string")
    return G.tiered(e, ("faq", one(0), "k1"), ("exact", one(0), "k2"), ("semantic", one(3), "key")).select("event_id", "tier")


@query("c15_cache_write_guard", "SELECT conversation_id, turn FROM v_messages WHERE role = 'assistant' AND trim(content) <> '' AND content <> 'Empty Response' AND NOT contains(lower(content), 'thon')")
def c15(v):
    c = F.col("content")
    return v.messages.where((F.col("role") == "assistant") & (F.trim(c) != "") & (c != "Empty Response") & ~T.contains_any(c, ("thon",))).select("conversation_id", "turn")


@query("c16_embedding_cache", "SELECT event_id, hit FROM (SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR, false) AS hit FROM v_requests) x")
def c16(v):
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.requests.select("event_id", F.coalesce(F.col("ts") - before <= F.expr("INTERVAL '4' HOUR"), F.lit(False)).alias("hit"))


@query("c18_conversation_upsert", "SELECT user_id AS conversation_id, min(ts) AS created_at, max(ts) AS last_message_at, max(ts) + INTERVAL 90 DAY AS expires_at, count(*) AS message_count FROM events GROUP BY 1")
def c18(v):
    e = v.table("events").groupBy(F.col("user_id").alias("conversation_id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_message_at"), F.count("*").alias("message_count"))
    return e.withColumn("expires_at", F.col("last_message_at") + F.expr("INTERVAL '90' DAY"))


@query("c19_turn_save", "SELECT event_id, role, len FROM (SELECT event_id, 'user' AS role, length(event_type) AS len FROM events UNION ALL SELECT event_id, 'assistant', length(props) FROM events) x")
def c19(v):
    turn = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.length("event_type").cast("long").alias("len")), F.struct(F.lit("assistant").alias("role"), F.length("props").cast("long").alias("len"))))
    return v.table("events").select("event_id", turn.alias("t")).select("event_id", "t.*")


@query("c19_escalations", "SELECT conversation_id, turn, 'open' AS status FROM v_messages WHERE role = 'assistant' AND contains(lower(content), 'oner')")
def c19e(v):
    return v.messages.where((F.col("role") == "assistant") & T.is_no_answer(F.col("content"), F.lit(False), phrases=("oner",), more=())).select("conversation_id", "turn", F.lit("open").alias("status"))


@query(
    "c22_request_decision",
    f"""WITH a AS (SELECT event_id, key, cost, row_number() OVER (PARTITION BY key, {_MIN} ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS d, row_number() OVER (PARTITION BY key, {_MONTH} ORDER BY ts, event_id) AS q,
 sum(cost) OVER (PARTITION BY key, {_MONTH} ORDER BY ts, event_id) - cost AS before FROM v_requests)
 SELECT event_id, CASE WHEN m > 1 THEN 'rate' WHEN event_id % 5 = 0 THEN 'cache' WHEN d > 3 THEN 'daily' WHEN q > 400 THEN 'monthly' WHEN before * 100 // 20000 >= 100 THEN 'budget' ELSE 'retrieve' END AS decision FROM a""",
)
def c22(v):
    e = G.running_budget(v.requests, 20_000)
    e = G.fixed_window(e, ["key"], times.minute_key(F.col("ts")), 1, "ts", "event_id").withColumnsRenamed({"n": "m", "allowed": "m_ok"})
    e = G.fixed_window(e, ["user_id"], times.day_key(F.col("ts")), 3, "ts", "event_id").withColumnsRenamed({"n": "d", "allowed": "d_ok"})
    e = G.fixed_window(e, ["key"], times.month_key(F.col("ts")), 400, "ts", "event_id").withColumnsRenamed({"n": "q", "allowed": "q_ok"})
    gates = [("rate", ~F.col("m_ok")), ("cache", F.col("event_id") % 5 == 0), ("daily", ~F.col("d_ok")), ("monthly", ~F.col("q_ok")), ("budget", F.col("blocked"))]
    return e.select("event_id", G.first_failing(gates).alias("decision"))


@query("c23_retention_expiry", "SELECT conversation_id FROM (SELECT user_id AS conversation_id, max(ts) + INTERVAL 2 DAY AS expires_at FROM events GROUP BY 1) x WHERE expires_at > TIMESTAMP '2024-01-31 00:00:00'")
def c23(v):
    e = v.table("events").groupBy(F.col("user_id").alias("conversation_id")).agg((F.max("ts") + F.expr("INTERVAL '2' DAY")).alias("expires_at"))
    return e.where(F.col("expires_at") > v.now).select("conversation_id")
