"""Analytics: aggregations, their joins, sorts and row filters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import money, times
from tessera.operators import analytics as A
from tessera.operators.scope import Actor, visible
from tessera.plans.registry import query
from tessera.views import NOW, PRICE_IN, PRICE_OUT

M = """count(*) AS requests, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
 CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(cost_micros_vnd), 0) AS BIGINT) AS cost_micros, CAST(trunc(coalesce(avg(latency_ms), 0)) AS BIGINT) AS avg_latency_ms"""
Z = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("requests", "prompt_tokens", "completion_tokens", "total_tokens", "cost_micros", "avg_latency_ms"))
N = f"TIMESTAMP '{NOW}'"


@query("a01_global_totals", f"SELECT {M} FROM v_usage")
def a01(v):
    return A.totals(v.usage)


@query("a02_model_type_fixed_pivot", f"SELECT t.model_type, {Z} FROM (VALUES ('llm'), ('embedding'), ('reranker')) t(model_type) LEFT JOIN (SELECT model_type, {M} FROM v_usage GROUP BY 1) u USING (model_type)")
def a02(v):
    return A.by_model_type(v.usage)


@query("a02_model_type_zero_fill", f"SELECT t.model_type, {Z} FROM (VALUES ('llm'), ('embedding'), ('reranker')) t(model_type) LEFT JOIN (SELECT model_type, {M} FROM v_usage WHERE model_type = 'llm' GROUP BY 1) u USING (model_type)")
def a02z(v):
    return A.by_model_type(v.usage.where("model_type = 'llm'"))


@query("a03_daily_rollup", f"SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS day, {M} FROM v_usage GROUP BY 1 ORDER BY 1")
def a03(v):
    return A.daily(v.usage).orderBy("day")


_PIVOT = ", ".join(
    f"CAST(coalesce(sum(total_tokens) FILTER (model_type = '{t}'), 0) AS BIGINT) AS {t}_tokens, CAST(coalesce(sum(cost_micros_vnd) FILTER (model_type = '{t}'), 0) AS BIGINT) AS {t}_cost_micros, count(*) FILTER (model_type = '{t}') AS {t}_requests"
    for t in A.MODEL_TYPES
)


@query("a04_daily_model_pivot", f"SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS day, {_PIVOT} FROM v_usage GROUP BY 1")
def a04(v):
    return A.daily_by_model_type(v.usage)


@query("a05_conditional_count", "SELECT tenant_id, CAST(sum(CASE WHEN model_type = 'llm' THEN 1 ELSE 0 END) AS BIGINT) AS questions FROM v_usage GROUP BY 1")
def a05c(v):
    return v.usage.groupBy("tenant_id").agg(F.count_if(F.col("model_type") == "llm").alias("questions"))


_SUMMARY = f"SELECT tenant_id, {M}, count(*) FILTER (model_type = 'llm') AS questions FROM v_usage WHERE tenant_id IS NOT NULL AND created_at >= {N} - INTERVAL 30 DAY GROUP BY 1"


@query("a05_tenant_usage_summary", f"SELECT t.tenant_id, t.slug, t.name, {Z}, coalesce(questions, 0) AS questions FROM v_tenants t LEFT JOIN ({_SUMMARY}) u USING (tenant_id) ORDER BY cost_micros DESC, name")
def a05(v):
    u = v.usage.where(times.since(F.col("created_at"), v.now, 30))
    return A.summary_for(v.tenants, u, "tenant_id").orderBy(F.desc("cost_micros"), "name")


@query("a06_feedback_pivot", "SELECT tenant_id, count(*) FILTER (feedback_type = 'like') AS \"like\", count(*) FILTER (feedback_type = 'dislike') AS dislike FROM v_feedback GROUP BY 1")
def a06(v):
    return A.feedback_by_tenant(v.feedback)


_FB = "SELECT tenant_id, count(*) FILTER (feedback_type = 'like') AS l, count(*) FILTER (feedback_type = 'dislike') AS d FROM v_feedback GROUP BY 1"


@query("a07_dislike_rate", f"SELECT tenant_id, CASE WHEN l + d = 0 THEN 0.0 ELSE round(CAST(d AS DOUBLE) / (l + d), 4) END AS rate FROM ({_FB}) f")
def a07(v):
    f = A.feedback_by_tenant(v.feedback)
    return f.select("tenant_id", A.dislike_rate(F.col("like"), F.col("dislike")).alias("rate"))


def _top(key, k):
    return f"""SELECT {key}, coalesce(title, 'Document ' || {key}) AS title, likes, dislikes, round(CAST(dislikes AS DOUBLE) / (likes + dislikes), 4) AS rate FROM (
 SELECT {key}, count(*) FILTER (feedback_type = 'dislike') AS dislikes, count(*) FILTER (feedback_type = 'like') AS likes,
  first(title ORDER BY created_at DESC, id DESC, pos DESC) FILTER (title IS NOT NULL) AS title FROM v_citations WHERE {key} IS NOT NULL GROUP BY 1) c
 WHERE dislikes > 0 ORDER BY dislikes DESC, {key} LIMIT {k}"""


@query("a08_disliked_documents", _top("document_id", 5))
def a08(v):
    return A.top_disliked(v.citations, "document_id", 5)


@query("a08_disliked_sections", _top("section_id", 5))
def a08s(v):
    return A.top_disliked(v.citations, "section_id", 5)


@query("o05_top5_disliked", "SELECT document_id, count(*) AS dislikes FROM v_citations WHERE feedback_type = 'dislike' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def o05(v):
    return v.citations.where("feedback_type = 'dislike'").groupBy("document_id").agg(F.count("*").alias("dislikes")).orderBy(F.desc("dislikes"), "document_id").limit(5)


@query("a09_daily_cost_desc", "SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS day, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(cost_micros_vnd) AS BIGINT) AS cost_micros, count(*) AS requests FROM v_usage GROUP BY 1 ORDER BY 1 DESC")
def a09(v):
    g = v.usage.groupBy(times.local_day(F.col("created_at")).alias("day"))
    return g.agg(F.sum("total_tokens").alias("tokens"), F.sum("cost_micros_vnd").alias("cost_micros"), F.count("*").alias("requests")).orderBy(F.desc("day"))


@query("a10_endpoint_breakdown", "SELECT endpoint, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS requests FROM v_usage GROUP BY 1 ORDER BY 2 DESC, 1")
def a10(v):
    return v.usage.groupBy("endpoint").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("requests")).orderBy(F.desc("tokens"), "endpoint")


@query("a11_multi_window_usage", f"SELECT d.days, {M} FROM (VALUES (1), (7), (30)) d(days) JOIN v_usage ON created_at >= {N} - d.days * INTERVAL 1 DAY GROUP BY 1")
def a11(v):
    return A.windows(v.usage, v.now)


@query("a12_user_detail", f"SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS day, {_PIVOT} FROM v_usage WHERE user_id = 17 AND created_at >= {N} - INTERVAL 30 DAY GROUP BY 1")
def a12(v):
    return A.daily_by_model_type(v.usage.where(F.col("user_id") == 17).where(times.since(F.col("created_at"), v.now, 30)))


@query("a13_next_version", "SELECT f.file_name, CAST(coalesce(max(version) FILTER (deleted_at IS NULL), 0) + 1 AS BIGINT) AS next_version FROM v_documents f GROUP BY 1")
def a13(v):
    return v.versions.groupBy("file_name").agg((F.coalesce(F.max(F.when(F.col("deleted_at").isNull(), F.col("version"))), F.lit(0)) + 1).alias("next_version"))


@query("a14_document_counts", "SELECT count(*) AS live, count(*) FILTER (status = 'ready') AS ready FROM v_documents WHERE deleted_at IS NULL")
def a14(v):
    return v.documents.where("deleted_at IS NULL").agg(F.count("*").alias("live"), F.count_if(F.col("status") == "ready").alias("ready"))


@query("a15_pagination_total", "SELECT count(*) AS total FROM v_documents WHERE deleted_at IS NULL AND tenant_id = 3 AND status = 'ready'")
def a15(v):
    return v.documents.where("deleted_at IS NULL AND tenant_id = 3 AND status = 'ready'").agg(F.count("*").alias("total"))


@query("a16_distinct_disliked_sections", "SELECT tenant_id, list_sort(list_distinct(list(section_id))) AS section_ids FROM v_citations WHERE feedback_type = 'dislike' AND section_id IS NOT NULL GROUP BY 1")
def a16(v):
    return v.citations.where("feedback_type = 'dislike'").groupBy("tenant_id").agg(F.array_sort(F.collect_set("section_id")).alias("section_ids")).where("size(section_ids) > 0")


@query("a19_parse_totals", "SELECT document_id, count(*) AS nodes, CAST(sum(length(content)) AS BIGINT) AS chars FROM v_sections GROUP BY 1")
def a19(v):
    return v.sections.groupBy("document_id").agg(F.count("*").alias("nodes"), F.sum(F.length("content")).alias("chars"))


@query(
    "a18_parse_quality",
    """SELECT document_id, round(greatest(0.0, least(1.0, 0.5 * least(avg(length(content)) / 500, 1) + 0.25 * count(DISTINCT level) / 7.0 + 0.25 * count(parent_section_id) / CAST(count(*) AS DOUBLE))), 6) AS quality FROM v_sections GROUP BY 1""",
)
def a18(v):
    score = 0.5 * F.least(F.avg(F.length("content")) / 500, F.lit(1.0)) + 0.25 * F.countDistinct("level") / 7.0 + 0.25 * F.count("parent_section_id") / F.count("*")
    return v.sections.groupBy("document_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("quality"))


@query("a20_failure_threshold", "SELECT document_id, count(*) AS nodes, count(*) FILTER (content = '') AS errors, count(*) FILTER (content = '') > greatest(1, 0.5 * count(*)) AS failed FROM v_sections GROUP BY 1")
def a20(v):
    g = v.sections.groupBy("document_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("content") == "").alias("errors"))
    return g.withColumn("failed", F.col("errors") > F.greatest(F.lit(1.0), 0.5 * F.col("nodes")))


@query("a24_metric_averages", "SELECT CAST(sum(coalesce(quality, 0)) AS DOUBLE) / count(*) AS mean_quality, count(*) AS n FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)) x")
def a24(v):
    labels = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return v.table("documents").select("doc_id").join(labels, "doc_id", "left").agg((F.sum(F.coalesce("quality", F.lit(0))) / F.count("*")).alias("mean_quality"), F.count("*").alias("n"))


@query("a25_repriced", f"SELECT model_type, CAST(floor((coalesce(sum(prompt_tokens), 0) * 200 + coalesce(sum(completion_tokens), 0) * 900 + 500000) / 1000000) AS BIGINT) AS vnd FROM v_usage WHERE model_type IN ('llm', 'embedding', 'reranker') GROUP BY 1")
def a25(v):
    u = A.by_model_type(v.usage)
    return u.select("model_type", money.rounded_vnd(money.cost_micros(F.col("prompt_tokens"), F.col("completion_tokens"), 200, 900)).alias("vnd"))


@query(
    "a26_key_counting",
    """SELECT t.tenant_id, CASE WHEN coalesce(n, 0) > 0 THEN n WHEN t.tenant_id % 2 = 0 THEN 1 ELSE 0 END AS keys FROM v_tenants t
 LEFT JOIN (SELECT provider, count(*) AS n FROM v_keys GROUP BY 1) k ON k.provider = t.tenant_id""",
)
def a26(v):
    own = v.keys.groupBy(F.col("provider").alias("tenant_id")).agg(F.count("*").alias("n"))
    return v.tenants.join(own, "tenant_id", "left").select("tenant_id", F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n")).when(F.col("tenant_id") % 2 == 0, 1).otherwise(0).alias("keys"))


@query("a27_keep_min_id", "SELECT id, file_name, sha256 FROM v_documents WHERE id IN (SELECT min(id) FROM v_documents GROUP BY file_name, sha256)")
def a27(v):
    return v.documents.groupBy("file_name", "sha256").agg(F.min("id").alias("id")).select("id", "file_name", "sha256")


# --- row filters


@query("p01_scope_admin", "SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v_usage")
def p01(v):
    return visible(v.usage, Actor(is_admin=True)).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("p01_scope_tenant", "SELECT id, tenant_id FROM v_usage WHERE tenant_id = 7")
def p01t(v):
    return visible(v.usage, Actor(tenant_id=7)).select("id", "tenant_id")


@query("p01_scope_user", "SELECT id, user_id FROM v_usage WHERE user_id = 33")
def p01u(v):
    return visible(v.usage, Actor(user_id=33)).select("id", "user_id")


@query("p04_rolling_window", f"SELECT id, created_at FROM v_usage WHERE created_at >= {N} - INTERVAL 7 DAY")
def p04(v):
    return v.usage.where(times.since(F.col("created_at"), v.now, 7)).select("id", "created_at")


@query("p05_soft_delete", "SELECT id, status FROM v_documents WHERE deleted_at IS NULL")
def p05(v):
    return v.documents.where(F.col("deleted_at").isNull()).select("id", "status")


@query("p06_not_null_key", "SELECT tenant_id, count(*) AS n FROM v_usage WHERE tenant_id IS NOT NULL GROUP BY 1")
def p06(v):
    return v.usage.where(F.col("tenant_id").isNotNull()).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("p07_in_list", "SELECT id, file_name FROM v_documents WHERE id IN (3, 5, 8, 13, 99999)")
def p07(v):
    return v.documents.where(F.col("id").isin(3, 5, 8, 13, 99999)).select("id", "file_name")


@query("p07_in_semi_join", "SELECT id, title FROM (SELECT document_id AS id, title FROM v_sections) s WHERE id IN (SELECT document_id FROM v_access)")
def p07s(v):
    return v.sections.select(F.col("document_id").alias("id"), "title").join(v.access.select(F.col("document_id").alias("id")), "id", "left_semi")


@query("p08_composite_keys", "SELECT document_id, section_id, content FROM v_sections WHERE (document_id = 4 AND section_id = 'sec-0001') OR (document_id = 9 AND section_id = 'sec-0000') OR (document_id = 9 AND section_id = 'sec-0777')")
def p08(v):
    keys = v.spark.createDataFrame([(4, "sec-0001"), (9, "sec-0000"), (9, "sec-0777")], "document_id long, section_id string")
    return v.sections.join(F.broadcast(keys), ["document_id", "section_id"], "left_semi").select("document_id", "section_id", "content")


@query("p10_partial_index", "SELECT id, tenant_id FROM v_documents WHERE tenant_id = 6 AND status = 'ready'")
def p10(v):
    return v.documents.where("tenant_id = 6 AND status = 'ready'").select("id", "tenant_id")


@query("p12_stale", "SELECT id, created_at FROM v_documents WHERE status = 'processing' AND created_at < TIMESTAMP '2024-01-01 06:00:00'")
def p12(v):
    return v.documents.where("status = 'processing' AND created_at < TIMESTAMP_NTZ '2024-01-01 06:00:00'").select("id", "created_at")


@query("p13_valid_keys", f"SELECT key_id, name FROM v_keys WHERE is_active AND (expires_at IS NULL OR expires_at > {N})")
def p13(v):
    return v.keys.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > v.now))).select("key_id", "name")


@query(
    "p14_least_recently_used_key",
    f"""SELECT key_id, name, CASE WHEN free THEN 'free' ELSE 'soonest' END AS tier FROM (
 SELECT *, coalesce(rate_limited_until, TIMESTAMP '1970-01-01') <= {N} AS free, row_number() OVER (ORDER BY CASE WHEN coalesce(rate_limited_until, TIMESTAMP '1970-01-01') <= {N} THEN 0 ELSE 1 END,
  CASE WHEN coalesce(rate_limited_until, TIMESTAMP '1970-01-01') <= {N} THEN last_used_at ELSE rate_limited_until END ASC NULLS FIRST, key_id) AS rn FROM v_keys WHERE is_active) k WHERE rn = 1""",
)
def p14(v):
    free = F.coalesce(F.col("rate_limited_until") <= v.now, F.lit(True))
    k = v.keys.where("is_active").withColumn("free", free)
    return k.orderBy(F.desc("free"), F.when(F.col("free"), F.col("last_used_at")).otherwise(F.col("rate_limited_until")).asc_nulls_first(), "key_id").limit(1).select("key_id", "name", F.when(F.col("free"), "free").otherwise("soonest").alias("tier"))


@query("o04_nulls_first_last", "SELECT key_id, CAST(row_number() OVER (ORDER BY last_used_at ASC NULLS FIRST, key_id) AS BIGINT) AS by_use, CAST(row_number() OVER (ORDER BY rate_limited_until ASC NULLS LAST, key_id) AS BIGINT) AS by_limit FROM v_keys")
def o04(v):
    k = v.keys.select("key_id", "last_used_at", "rate_limited_until")
    by_use = A.numbered(k, "by_use", F.col("last_used_at").asc_nulls_first(), F.col("key_id")).select("key_id", "by_use")
    by_limit = A.numbered(k, "by_limit", F.col("rate_limited_until").asc_nulls_last(), F.col("key_id")).select("key_id", "by_limit")
    return by_use.join(by_limit, "key_id")


# --- joins


@query("j01_user_roles", "SELECT user_id, username, role, r.n AS role_size FROM v_users u JOIN (SELECT role, count(*) AS n FROM v_users GROUP BY 1) r USING (role)")
def j01(v):
    roles = v.users.groupBy("role").agg(F.count("*").alias("role_size"))
    return v.users.join(roles, "role").select("user_id", "username", "role", "role_size")


@query("j02_tenants_of_document", "SELECT t.tenant_id, t.name FROM v_access a JOIN v_tenants t USING (tenant_id) WHERE a.document_id = 8 ORDER BY t.name")
def j02(v):
    return v.access.where("document_id = 8").join(v.tenants, "tenant_id").select("tenant_id", "name").orderBy("name")


@query(
    "j03_tenants_of_documents",
    "SELECT d.id, coalesce(list(t.name ORDER BY t.name) FILTER (t.name IS NOT NULL), []) AS tenants FROM v_documents d LEFT JOIN v_access a ON a.document_id = d.id LEFT JOIN v_tenants t ON t.tenant_id = a.tenant_id GROUP BY 1",
)
def j03(v):
    named = v.access.join(v.tenants, "tenant_id").select(F.col("document_id").alias("id"), "name")
    return v.documents.select("id").join(named, "id", "left").groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("tenants"))


@query("j04_user_usage_zero_filled", f"SELECT u.user_id, u.username, {Z}, coalesce(questions, 0) AS questions FROM v_users u LEFT JOIN (SELECT user_id, {M}, count(*) FILTER (model_type = 'llm') AS questions FROM v_usage WHERE user_id IS NOT NULL GROUP BY 1) x USING (user_id)")
def j04(v):
    return A.summary_for(v.users.select("user_id", "username"), v.usage, "user_id")


@query("j05_tenant_usage_zero_filled", f"SELECT t.tenant_id, t.name, {Z}, coalesce(questions, 0) AS questions FROM v_tenants t LEFT JOIN (SELECT tenant_id, {M}, count(*) FILTER (model_type = 'llm') AS questions FROM v_usage WHERE tenant_id IS NOT NULL GROUP BY 1) x USING (tenant_id)")
def j05(v):
    return A.summary_for(v.tenants.select("tenant_id", "name"), v.usage, "tenant_id")


@query(
    "j09_usage_with_feedback",
    f"""SELECT t.tenant_id, coalesce(requests, 0) AS requests, coalesce(l, 0) AS likes, coalesce(d, 0) AS dislikes, CASE WHEN coalesce(l + d, 0) = 0 THEN 0.0 ELSE round(CAST(d AS DOUBLE) / (l + d), 4) END AS rate
 FROM v_tenants t LEFT JOIN (SELECT tenant_id, count(*) AS requests FROM v_usage GROUP BY 1) u USING (tenant_id) LEFT JOIN ({_FB}) f USING (tenant_id)""",
)
def j09(v):
    f = A.feedback_by_tenant(v.feedback)
    j = A.summary_for(v.tenants, v.usage, "tenant_id").join(f, "tenant_id", "left").na.fill(0, ["like", "dislike"])
    return j.select("tenant_id", "requests", F.col("like").alias("likes"), F.col("dislike").alias("dislikes"), A.dislike_rate(F.col("like"), F.col("dislike")).alias("rate"))


# --- sorts, limits


@query("o01_recent_usage", "SELECT id, created_at, endpoint, total_tokens FROM v_usage ORDER BY created_at DESC, id DESC LIMIT 20")
def o01(v):
    return A.recent(v.usage.select("id", "created_at", "endpoint", "total_tokens"), 20, F.desc("created_at"), F.desc("id"))


@query("o02_offset_page", "SELECT id, file_name, status FROM v_documents WHERE deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 25 OFFSET 50")
def o02(v):
    return A.page(v.documents.where("deleted_at IS NULL"), 50, 25, F.desc("created_at"), F.col("id")).select("id", "file_name", "status")


@query("o03_multi_key_sort", "SELECT tenant_id, CAST(sum(cost_micros_vnd) AS BIGINT) AS cost_micros FROM v_usage WHERE tenant_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def o03(v):
    return v.usage.where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.sum("cost_micros_vnd").alias("cost_micros")).orderBy(F.desc("cost_micros"), "tenant_id").limit(10)


@query("o08_latest_for_hash", "SELECT sha256, max(id) AS id FROM (SELECT sha256, id, row_number() OVER (PARTITION BY sha256 ORDER BY created_at DESC, id DESC) AS rn FROM v_documents WHERE deleted_at IS NULL) x WHERE rn = 1 GROUP BY 1")
def o08(v):
    return v.documents.where("deleted_at IS NULL").groupBy("sha256").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("o09_feedback_list", "SELECT id, feedback_type FROM v_feedback WHERE tenant_id = 4 AND feedback_type = 'dislike' ORDER BY created_at DESC, id DESC LIMIT 200")
def o09(v):
    return A.recent(v.feedback.where("tenant_id = 4 AND feedback_type = 'dislike'"), 200, F.desc("created_at"), F.desc("id")).select("id", "feedback_type")


@query("o10_feedback_window", f"SELECT id, created_at, feedback_type FROM v_feedback WHERE tenant_id = 5 AND created_at >= {N} - INTERVAL 10 DAY ORDER BY created_at DESC, id DESC")
def o10(v):
    return visible(v.feedback, Actor(tenant_id=5)).where(times.since(F.col("created_at"), v.now, 10)).orderBy(F.desc("created_at"), F.desc("id")).select("id", "created_at", "feedback_type")


@query("o11_single_key_list", "SELECT tenant_id, slug, name FROM v_tenants ORDER BY name")
def o11(v):
    return v.tenants.orderBy("name")


@query("o13_section_order", "SELECT document_id, section_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY order_index) AS BIGINT) AS place FROM v_sections")
def o13(v):
    return v.sections.select("document_id", "section_id", F.row_number().over(W.partitionBy("document_id").orderBy("order_index")).cast("long").alias("place"))


@query("k15_money_payload", f"SELECT tenant_id, 'VND' AS currency, micros, CASE WHEN micros % 1000000 = 0 THEN CAST(micros // 1000000 AS VARCHAR) ELSE CAST(micros // 1000000 AS VARCHAR) || '.' || rtrim(lpad(CAST(micros % 1000000 AS VARCHAR), 6, '0'), '0') END AS amount, CAST((micros + 500000) // 1000000 AS BIGINT) AS rounded FROM (SELECT tenant_id, CAST(sum(prompt_tokens * {PRICE_IN} + completion_tokens * {PRICE_OUT}) AS BIGINT) AS micros FROM v_usage GROUP BY 1) u")
def k15(v):
    u = v.usage.groupBy("tenant_id").agg(F.sum("prompt_tokens").alias("i"), F.sum("completion_tokens").alias("o"))
    return u.select("tenant_id", money.payload(money.cost_micros(F.col("i"), F.col("o"), PRICE_IN, PRICE_OUT)).alias("m")).select("tenant_id", "m.*")


@query("f23_injected_now", f"SELECT max({N} - created_at) >= INTERVAL 0 SECOND AS past, count(*) AS n FROM v_usage")
def f23(v):
    """The current time is a parameter, so that results can be repeated."""
    return v.usage.agg((F.max(v.now - F.col("created_at")) >= F.expr("INTERVAL '0' SECOND")).alias("past"), F.count("*").alias("n"))


@query("t37_usage_normalise", f"SELECT id, coalesce(CASE WHEN id % 4 > 0 THEN total_tokens END, prompt_tokens + completion_tokens) AS total, prompt_tokens * {PRICE_IN} + completion_tokens * {PRICE_OUT} AS micros, CAST((prompt_tokens * {PRICE_IN} + completion_tokens * {PRICE_OUT} + 500000) // 1000000 AS BIGINT) AS vnd FROM v_usage")
def t37(v):
    total = F.coalesce(F.when(F.col("id") % 4 > 0, F.col("total_tokens")), F.col("prompt_tokens") + F.col("completion_tokens"))
    micros = money.cost_micros(F.col("prompt_tokens"), F.col("completion_tokens"), PRICE_IN, PRICE_OUT)
    return v.usage.select("id", total.alias("total"), micros.alias("micros"), money.rounded_vnd(micros).alias("vnd"))


@query("c17_expired_tokens", f"SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM v_keys k WHERE k.key_id = e.user_id AND k.expires_at > {N})")
def c17(v):
    """Tokens on a list of revoked ones that hasn't expired are refused."""
    black = v.keys.where(F.col("expires_at") > v.now).select(F.col("key_id").alias("user_id"))
    return v.table("events").join(black, "user_id", "left_anti").select("event_id")
