"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money, times
from tessera.functions import text as T
from tessera.plans.registry import query
from tessera.views import NOW

# DuckDB forms; \p{L}\p{M}\p{N}_ is what a word character is
_NORM = r"""array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce({0}, '')), 'please tell me', ' '), 'could you', ' '), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('the', 'a', 'of', 'and', 'is') AND w <> ''), ' ')"""
_RAW = r"""trim(regexp_replace(regexp_replace(lower({0}), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"""


def _norm(c):
    return _NORM.replace("{0}", c)


def _raw(c):
    return _RAW.replace("{0}", c)


def _hash(c):
    return f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN sha256(coalesce(nullif({_norm(c)}, ''), {_raw(c)})) END"


@query("f01_query_normalise", f"SELECT conversation_id, turn, {_norm('content')} AS q FROM v_messages WHERE role = 'user'")
def f01(v):
    return v.messages.where("role = 'user'").select("conversation_id", "turn", T.normalise_query(F.col("content")).alias("q"))


@query("f02_query_hash", f"SELECT conversation_id, turn, {_hash('content')} AS h FROM v_messages")
def f02(v):
    return v.messages.select("conversation_id", "turn", T.query_hash(F.col("content")).alias("h"))


@query("f03_faq_hashes", f"SELECT item_id, list_distinct([{_hash('text')}, sha256({_raw('text')})]) AS x, len(list_distinct([{_hash('text')}, sha256({_raw('text')})])) AS n FROM benchmark".replace("list_distinct([", "list_sort(list_distinct([").replace("]) AS x", "])) AS x").replace("])) AS n", "]))) AS n"))
def f03(v):
    h = T.faq_hashes(F.array("text"))
    return v.table("benchmark").select("item_id", F.array_sort(h).alias("x"), F.size(h).cast("long").alias("n"))


@query("f04_cache_key", "SELECT conversation_id, turn, 'exact:' || conversation_id % 20 || ':all:' || sha256(content) AS key FROM v_messages")
def f04(v):
    return v.messages.select("conversation_id", "turn", T.cache_key("exact", F.col("conversation_id") % 20, F.lit("all"), F.col("content")).alias("key"))


@query(
    "f05_document_set_key",
    "SELECT t.tenant_id, CASE WHEN count(a.document_id) > 0 THEN substring(sha256(string_agg(CAST(a.document_id AS VARCHAR), ',' ORDER BY CAST(a.document_id AS VARCHAR))), 1, 16) ELSE CAST(t.tenant_id AS VARCHAR) END AS key FROM v_tenants t LEFT JOIN v_access a USING (tenant_id) GROUP BY 1",
)
def f05(v):
    ids = v.access.groupBy("tenant_id").agg(F.collect_set(F.col("document_id").cast("string")).alias("ids"))
    return v.tenants.join(ids, "tenant_id", "left").select("tenant_id", T.document_set_key(F.coalesce("ids", F.array().cast("array<string>")), F.col("tenant_id")).alias("key"))


@query("f06_slug", "SELECT key_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(name || ' & Co. #' || key_id), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '') AS slug FROM v_keys")
def f06(v):
    return v.keys.select("key_id", T.slug(F.concat("name", F.lit(" & Co. #"), F.col("key_id").cast("string"))).alias("slug"))


@query("f07_greeting", r"SELECT conversation_id, turn, length(content) <= 120 AND regexp_matches(content, '(?i)^\s*(hello|hi|good morning|hey there)\b[\s!.,?]*$') AS greets FROM v_messages")
def f07(v):
    return v.messages.select("conversation_id", "turn", T.is_greeting(F.col("content")).alias("greets"))


@query(
    "f08_no_answer",
    "SELECT conversation_id, turn, trim(content) = '' OR trim(content) = 'NO_ANSWER' OR contains(lower(content), 'thent') OR contains(lower(content), 'oner') OR (turn % 2 = 1 AND contains(lower(content), 'the of')) AS refused FROM v_messages",
)
def f08(v):
    return v.messages.select("conversation_id", "turn", T.is_no_answer(F.col("content"), F.col("turn") % 2 == 1, phrases=("thent", "oner"), more=("the of",)).alias("refused"))


@query("f09_never_cache", "SELECT conversation_id, turn, contains(lower(content), 'thon') OR contains(lower(content), 'eau') AS never FROM v_messages")
def f09(v):
    return v.messages.select("conversation_id", "turn", T.contains_any(F.col("content"), ("thon", "eau")).alias("never"))


@query("f10_section_code_test", r"SELECT document_id, order_index, regexp_matches(title || ' ' || section_code, '\b\d+(?:\.\d+)+\b') AS coded FROM v_sections")
def f10(v):
    return v.sections.select("document_id", "order_index", T.has_section_code(F.concat_ws(" ", "title", "section_code")).alias("coded"))


@query("f11_section_code_extract", r"SELECT document_id, order_index, nullif(regexp_extract(section_code || ') ' || title, '^(\d+(?:\.\d+)*)(?:[).:]|\s|$)', 1), '') AS code, nullif(regexp_extract('v' || title, '^(\d+(?:\.\d+)*)(?:[).:]|\s|$)', 1), '') AS none FROM v_sections")
def f11(v):
    return v.sections.select("document_id", "order_index", T.section_code(F.concat("section_code", F.lit(") "), "title")).alias("code"), T.section_code(F.concat(F.lit("v"), "title")).alias("none"))


@query("f12_query_terms", r"SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS terms FROM benchmark")
def f12(v):
    return v.table("benchmark").select("item_id", T.terms(F.col("text")).alias("terms"))


@query("f13_route_decision", r"SELECT item_id, regexp_matches(text, '\b\d+(?:\.\d+)+\b') OR (length(text) <= 96 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 12) AS section_route FROM benchmark")
def f13(v):
    return v.table("benchmark").select("item_id", T.takes_section_route(F.col("text")).alias("section_route"))


@query("f15_preview", r"SELECT doc_id, CASE WHEN length(c) > 240 THEN substring(c, 1, 240) || '...' ELSE c END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) d")
def f15(v):
    return v.table("documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("f16_summary_cut", "SELECT doc_id, substring(text, 1, 400) AS summary FROM documents")
def f16(v):
    return v.table("documents").select("doc_id", F.substring("text", 1, 400).alias("summary"))


@query(
    "f17_page_range",
    "SELECT document_id, order_index, coalesce(CASE WHEN order_index % 5 = 0 THEN 'p' || order_index END, CASE WHEN order_index % 4 > 0 THEN order_index || '-' || order_index + order_index % 4 END, CAST(order_index AS VARCHAR)) AS pages FROM v_sections",
)
def f17(v):
    k = F.col("order_index")
    return v.sections.select("document_id", "order_index", T.page_range(F.when(k % 5 == 0, F.concat(F.lit("p"), k.cast("string"))), k, k + k % 4).alias("pages"))


@query("f18_breadcrumb", "SELECT document_id, string_agg(title, ' > ' ORDER BY order_index) AS crumbs FROM v_sections GROUP BY 1")
def f18(v):
    titles = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "title"))), lambda s: s["title"])
    return v.sections.groupBy("document_id").agg(T.breadcrumb(titles).alias("crumbs"))


@query("f19_section_id_build", "SELECT document_id, order_index, CASE WHEN order_index % 2 = 0 THEN 'sec-' || replace(section_code, '.', '-') || '-' || lpad(CAST(order_index AS VARCHAR), 4, '0') ELSE 'sec-' || lpad(CAST(order_index AS VARCHAR), 4, '0') END AS sid FROM v_sections")
def f19(v):
    return v.sections.select("document_id", "order_index", T.section_id(F.when(F.col("order_index") % 2 == 0, F.col("section_code")), F.col("order_index")).alias("sid"))


_NS = "6ba7b8119dad11d180b400c04fd430c8"


@query(
    "f20_uuid5",
    f"""SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || CASE WHEN substring(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substring(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substring(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid
 FROM (SELECT id, sha1(unhex('{_NS}') || encode('doc/' || id || '/chunk/' || lpad(CAST(id AS VARCHAR), 5, '0'))) AS h FROM v_documents) d""",
)
def f20(v):
    return v.documents.select("id", T.uuid5(F.concat(F.lit("doc/"), F.col("id").cast("string"), F.lit("/chunk/"), F.lpad(F.col("id").cast("string"), 5, "0"))).alias("uuid"))


@query(
    "f21_uuid7",
    "SELECT id, substring(ms, 1, 8) || '-' || substring(ms, 9, 4) || '-7' || substring(e, 1, 3) || '-a' || substring(e, 4, 3) || '-' || substring(e, 7, 12) AS uuid FROM (SELECT id, lpad(lower(to_hex(epoch_us(created_at) // 1000)), 12, '0') AS ms, md5(CAST(id AS VARCHAR)) AS e FROM v_usage) u",
)
def f21(v):
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', created_at)")
    hexed = F.lpad(F.lower(F.hex(ms)), 12, "0")
    e = F.md5(F.col("id").cast("string"))
    return v.usage.select("id", F.concat(F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-7"), F.substring(e, 1, 3), F.lit("-a"), F.substring(e, 4, 3), F.lit("-"), F.substring(e, 7, 12)).alias("uuid"))


@query("f24_local_time", "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS local FROM events")
def f24(v):
    return v.table("events").select("event_id", times.iso_local(F.col("ts")).alias("local"))


@query("f25_window_keys", "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y%m%d%H%M') AS minute, strftime(ts + INTERVAL 7 HOUR, '%Y%m%d') AS day, strftime(ts + INTERVAL 7 HOUR, '%Y%m') AS month FROM events")
def f25(v):
    t = F.col("ts")
    return v.table("events").select("event_id", times.minute_key(t).alias("minute"), times.day_key(t).alias("day"), times.month_key(t).alias("month"))


@query("f26_seconds_to_midnight", "SELECT event_id, CAST(86400 - (hour(t) * 3600 + minute(t) * 60 + second(t)) + 60 AS BIGINT) AS ttl FROM (SELECT event_id, ts + INTERVAL 7 HOUR AS t FROM events) e")
def f26(v):
    return v.table("events").select("event_id", times.seconds_to_midnight(F.col("ts")).alias("ttl"))


@query("f27_cost", "SELECT id, greatest(0, CAST((prompt_tokens - 200) * 100 + completion_tokens * 400 AS BIGINT)) AS micros FROM v_usage")
def f27(v):
    return v.usage.select("id", money.cost_micros(F.col("prompt_tokens") - 200, F.col("completion_tokens"), 100, 400).alias("micros"))


_SIGNED = "SELECT id, (cost_micros_vnd - 20000) * 37 AS m FROM v_usage"


@query("f28_decimal_string", f"SELECT id, CASE WHEN m < 0 THEN '-' ELSE '' END || CAST(abs(m) // 1000000 AS VARCHAR) || CASE WHEN abs(m) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(m) % 1000000 AS VARCHAR), 6, '0'), '0') END AS amount FROM ({_SIGNED}) x")
def f28(v):
    return v.usage.select("id", money.decimal_string((F.col("cost_micros_vnd") - 20000) * 37).alias("amount"))


@query("f29_rounded_vnd", f"SELECT id, CAST(sign(m) * ((abs(m) + 500000) // 1000000) AS BIGINT) AS vnd FROM ({_SIGNED}) x")
def f29(v):
    return v.usage.select("id", money.rounded_vnd((F.col("cost_micros_vnd") - 20000) * 37).alias("vnd"))


@query("f30_truncated_average", "SELECT endpoint, CAST(trunc(avg(latency_ms - 60)) AS BIGINT) AS mean FROM v_usage GROUP BY 1")
def f30(v):
    return v.usage.groupBy("endpoint").agg(F.avg(F.col("latency_ms") - 60).cast("long").alias("mean"))


_PCT = "SELECT tenant_id, CAST(sum(cost_micros_vnd) * 100 // 20000000 AS BIGINT) AS pct FROM v_usage WHERE tenant_id IS NOT NULL GROUP BY 1"


@query("f31_budget_percent", _PCT)
def f31(v):
    g = v.usage.where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.sum("cost_micros_vnd").alias("c"))
    return g.select("tenant_id", money.budget_percent(F.col("c"), F.lit(20_000_000)).alias("pct"))


@query("f32_budget_state", f"SELECT tenant_id, pct, CASE WHEN pct >= 100 THEN 'hard_stop' WHEN pct >= 85 THEN 'alert' WHEN pct >= 70 THEN 'warn' ELSE 'ok' END AS state FROM ({_PCT}) p")
def f32(v):
    p = f31(v)
    return p.withColumn("state", money.budget_state(F.col("pct")))


@query("f33_backoff", "SELECT key_id, least(CAST(2000 * pow(2, least(key_id % 20, 15) - 1) AS BIGINT), 300000) AS delay_ms FROM v_keys WHERE key_id % 20 > 0")
def f33(v):
    level = F.least(F.col("key_id") % 20, F.lit(15))
    return v.keys.where("key_id % 20 > 0").select("key_id", F.least((2000 * F.pow(F.lit(2.0), level - 1)).cast("long"), F.lit(300000)).alias("delay_ms"))


@query("f35_json_default", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.page') AS VARCHAR), CAST(json_extract_string(props, '$.ref') AS VARCHAR), '{}') AS x FROM events")
def f35(v):
    p = F.col("props")
    return v.table("events").select("event_id", F.coalesce(F.get_json_object(p, "$.page"), F.get_json_object(p, "$.ref"), F.lit("{}")).alias("x"))


@query(
    "f36_json_fallback",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 's' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'm' || event_id END, 'n' || event_id) AS section_id FROM events""",
)
def f36(v):
    """section_id, else metadata.section_id, else the one in the JSON text of _node_content."""
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 3
    doc = F.when(k == 0, F.concat(F.lit('{"section_id": "s'), e, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"metadata": {"section_id": "m'), e, F.lit('"}}'))).otherwise(F.concat(F.lit('{"_node_content": "{\\"metadata\\": {\\"section_id\\": \\"n'), e, F.lit('\\"}}"}')))
    found = F.coalesce(F.get_json_object(doc, "$.section_id"), F.get_json_object(doc, "$.metadata.section_id"), F.get_json_object(F.get_json_object(doc, "$._node_content"), "$.metadata.section_id"))
    return v.table("events").select("event_id", found.alias("section_id"))


@query("f37_mask_ip", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.' || user_id || '.7.0' ELSE '2001:db8:' || user_id || '::' END AS masked FROM events")
def f37(v):
    ip = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10."), F.col("user_id").cast("string"), F.lit(".7."), (F.col("event_id") % 256).cast("string"))).otherwise(F.concat(F.lit("2001:db8:"), F.col("user_id").cast("string"), F.lit(":1::"), F.lit("9")))
    return v.table("events").select("event_id", T.mask_ip(ip).alias("masked"))


@query("f38_client_ip", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'real' WHEN event_id % 3 = 1 THEN 'fwd' || user_id ELSE 'peer' END AS ip FROM events")
def f38(v):
    k = F.col("event_id") % 3
    real = F.when(k == 0, " real ").when(k == 1, "  ")
    fwd = F.when(k < 2, F.concat(F.lit(" fwd"), F.col("user_id").cast("string"), F.lit(" , proxy"))).otherwise(" , x")
    return v.table("events").select("event_id", T.client_ip(real, fwd, F.lit("peer")).alias("ip"))


@query("f39_url_suffix", r"SELECT page_id, regexp_replace(regexp_replace(url || '/v1/rerank/', '/+$', ''), '/rerank$', '') AS base FROM pages")
def f39(v):
    return v.table("pages").select("page_id", T.strip_suffix(F.concat("url", F.lit("/v1/rerank/")), "/rerank").alias("base"))


@query("f40_display_formats", "SELECT id, CASE WHEN latency_ms >= 100 THEN CAST(CAST(floor(latency_ms / 100) AS BIGINT) AS VARCHAR) || ' x100 ms' ELSE CAST(CAST(floor(latency_ms) AS BIGINT) AS VARCHAR) || ' ms' END AS latency, strftime(created_at, '%d/%m/%Y %H:%M') AS at FROM v_usage")
def f40(v):
    ms = F.col("latency_ms")
    shown = F.when(ms >= 100, F.concat(F.floor(ms / 100).cast("string"), F.lit(" x100 ms"))).otherwise(F.concat(F.floor(ms).cast("string"), F.lit(" ms")))
    return v.usage.select("id", shown.alias("latency"), F.date_format("created_at", "dd/MM/yyyy HH:mm").alias("at"))


@query("f40_time_ago", f"SELECT id, CASE WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS ago FROM (SELECT id, CAST(date_diff('second', date_trunc('second', created_at), TIMESTAMP '{NOW}') AS BIGINT) AS s FROM v_usage) u")
def f40a(v):
    s = F.expr(f"timestampdiff(SECOND, date_trunc('SECOND', created_at), TIMESTAMP_NTZ '{NOW}')")
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return v.usage.select("id", F.when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d")).alias("ago"))


@query("f41_never_empty", "SELECT document_id, order_index, CASE WHEN trim(content) = '' THEN ' ' ELSE content END AS text FROM v_sections")
def f41(v):
    return v.sections.select("document_id", "order_index", F.when(F.trim("content") == "", " ").otherwise(F.col("content")).alias("text"))


@query("f42_embedding_cache_key", "SELECT item_id, substring(md5('model-1'), 1, 8) || ':' || md5(text) AS key FROM benchmark")
def f42(v):
    return v.table("benchmark").select("item_id", F.concat(F.substring(F.md5(F.lit("model-1")), 1, 8), F.lit(":"), F.md5("text")).alias("key"))


@query("p17_token_estimates", "SELECT doc_id, n // 3 AS embed, greatest(1, n // 4) AS stream, n // 4 AS node FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents) d")
def p17(v):
    n = F.length("text").cast("long")
    return v.table("documents").select("doc_id", F.floor(n / 3).alias("embed"), F.greatest(F.lit(1).cast("long"), F.floor(n / 4)).alias("stream"), F.floor(n / 4).alias("node"))


@query("p18_upload_validation", "SELECT doc_id, regexp_matches(name, '^[A-Za-z0-9._ -]{1,40}$') AS name_ok, fmt IN ('pdf', 'markdown', 'text', 'docx') AS type_ok, n_chars > 0 AND n_chars <= 5000 AS size_ok FROM (SELECT doc_id, n_chars, source || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '?.txt' END AS name, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'exe' ELSE 'text' END AS fmt FROM documents) d")
def p18(v):
    k = F.col("doc_id") % 4
    name = F.concat("source", F.when(k == 0, ".pdf").when(k == 1, ".md").when(k == 2, ".exe").otherwise("?.txt"))
    size = (F.col("n_chars") > 0) & (F.col("n_chars") <= 5000)
    return v.table("documents").select("doc_id", name.rlike("^[A-Za-z0-9._ -]{1,40}$").alias("name_ok"), T.file_format(name).isin("pdf", "markdown", "text", "docx").alias("type_ok"), size.alias("size_ok"))


@query("p20_chat_validation", "SELECT page_id, trim(html) = '' OR length(html) > 5000 OR length(regexp_replace(html, '<[^>]*>', '', 'g')) < 0.8 * length(html) AS rejected FROM pages")
def p20(v):
    h = F.col("html")
    return v.table("pages").select("page_id", ((F.trim(h) == "") | (F.length(h) > 5000) | (F.length(F.regexp_replace(h, "<[^>]*>", "")) < 0.8 * F.length(h))).alias("rejected"))


@query("s06_file_format", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'image' WHEN 3 THEN 'xyz' ELSE 'unknown' END AS fmt FROM documents")
def s06(v):
    k = F.col("doc_id") % 5
    name = F.concat("source", F.when(k == 0, ".PDF").when(k == 1, ".md").when(k == 2, ".jpeg").when(k == 3, ".xyz").otherwise(""))
    return v.table("documents").select("doc_id", T.file_format(name).alias("fmt"))


@query("k24_uuid_guard", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN substring(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-0000-0000-0000-' || substring(md5(CAST(event_id AS VARCHAR)), 1, 12) END AS id FROM events")
def k24(v):
    h = F.md5(F.col("event_id").cast("string"))
    good = F.concat(F.upper(F.substring(h, 1, 8)), F.lit("-0000-0000-0000-"), F.substring(h, 1, 12))
    return v.table("events").select("event_id", T.uuid_or_null(F.when(F.col("event_id") % 2 == 0, good).otherwise(h)).alias("id"))


@query("t30_benchmark_terms", r"SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(replace(lower(text), chr(10), ' '), '[^\p{L}\p{M}\p{N}_\s.,-]', ' ', 'g'), '[.,_-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'of', 'and', 'is')) AS terms FROM documents")
def t30(v):
    return v.table("documents").select("doc_id", T.clean_terms(F.col("text")).alias("terms"))
