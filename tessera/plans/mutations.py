"""Changes to stored state, and point access."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import mutations as U
from tessera.plans.registry import query

_S = "SELECT document_id, section_id, title FROM v_sections"


@query("d01_replace_sections", f"SELECT * FROM ({_S}) s WHERE document_id % 5 <> 0 UNION ALL SELECT document_id, 'new-0', 'New' FROM (SELECT DISTINCT document_id FROM v_sections WHERE document_id % 5 = 0) d")
def d01(v):
    s = v.sections.select("document_id", "section_id", "title")
    new = s.where("document_id % 5 = 0").select("document_id").distinct().select("document_id", F.lit("new-0").alias("section_id"), F.lit("New").alias("title"))
    return U.replace_by_key(s, new, "document_id")


@query("d02_delete_by_key", "SELECT id FROM v_usage WHERE tenant_id IS NULL OR tenant_id <> 9")
def d02(v):
    return U.delete(v.usage, v.usage.where("tenant_id = 9"), "id").select("id")


@query("d03_soft_delete", "SELECT id, CASE WHEN id % 17 = 0 AND deleted_at IS NULL THEN 'deleted' ELSE status END AS stage FROM v_documents")
def d03(v):
    go = (F.col("id") % 17 == 0) & F.col("deleted_at").isNull()
    return v.documents.select("id", F.when(go, "deleted").otherwise(F.col("status")).alias("stage"))


@query("d04_status_transition", "SELECT id, CASE WHEN id % 4 = 0 AND deleted_at IS NULL THEN 'ready' ELSE status END AS status, CASE WHEN id % 4 = 0 AND deleted_at IS NULL THEN least(100, greatest(0, id - 50)) END AS progress, CASE WHEN id % 4 = 0 AND deleted_at IS NULL THEN substring(text, 1, 500) END AS message FROM v_documents")
def d04(v):
    c = v.documents.where("id % 4 = 0").select("id", F.lit("ready").alias("status"), (F.col("id") - 50).alias("progress"), F.col("text").alias("message"))
    return U.transition(v.documents.select("id", "status", "deleted_at"), c)


@query("d05_upsert_setting", "SELECT user_id AS key, last(event_type ORDER BY ts, event_id) AS value, max(ts) AS updated_at FROM events GROUP BY 1")
def d05(v):
    rows = v.table("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("updated_at"), "event_id")
    return U.upsert_last(rows, "key", "updated_at", "event_id").drop("event_id")


@query("d06_exclusive_activation", "SELECT key_id, CASE WHEN provider IN (SELECT provider FROM v_keys WHERE key_id IN (5, 12)) THEN key_id IN (5, 12) ELSE is_active END AS is_active FROM v_keys")
def d06(v):
    return U.activate(v.keys.select("key_id", "provider", "is_active"), "key_id", F.col("key_id").isin(5, 12), "provider").select("key_id", "is_active")


@query("d07_insert_or_ignore", "SELECT tenant_id, name FROM v_tenants UNION ALL SELECT 25, 'seed'")
def d07(v):
    seeds = v.spark.createDataFrame([(3, "seed"), (25, "seed")], "tenant_id long, name string")
    return U.insert_missing(v.tenants.select("tenant_id", "name"), seeds, "tenant_id")


@query("d08_faq_lifecycle", "SELECT user_id AS faq_id, CASE last(event_type ORDER BY ts, event_id) WHEN 'purchase' THEN 'published_faq' WHEN 'error' THEN 'closed' ELSE 'open' END AS status, count(*) AS changes FROM events GROUP BY 1")
def d08(v):
    last = U.upsert_last(v.table("events").select(F.col("user_id").alias("faq_id"), "event_type", "ts", "event_id"), "faq_id", "ts", "event_id")
    n = v.table("events").groupBy(F.col("user_id").alias("faq_id")).agg(F.count("*").alias("changes"))
    status = F.when(F.col("event_type") == "purchase", "published_faq").when(F.col("event_type") == "error", "closed").otherwise("open")
    return last.join(n, "faq_id").select("faq_id", status.alias("status"), "changes")


@query("d09_hard_delete", "SELECT (SELECT count(*) FROM v_chunks WHERE document_id NOT IN (6, 7)) AS vectors, (SELECT count(*) FROM v_sections WHERE document_id NOT IN (6, 7)) AS sections, (SELECT count(*) FROM v_documents WHERE id NOT IN (6, 7)) AS documents")
def d09(v):
    gone = v.spark.createDataFrame([(6,), (7,)], "document_id long")
    count = lambda df, name: U.delete(df, gone, "document_id").agg(F.count("*").alias(name))
    docs = v.documents.select(F.col("id").alias("document_id"))
    return count(v.chunks.select("document_id"), "vectors").crossJoin(count(v.sections.select("document_id"), "sections")).crossJoin(count(docs, "documents"))


@query(
    "d10_delete_verification",
    """SELECT d.id AS document_id, (SELECT count(*) FROM v_chunks c WHERE c.document_id = d.id AND c.node_id % 3 = 0) AS vectors, (SELECT count(*) FROM v_sections s WHERE s.document_id = d.id AND s.order_index > 20) AS sections, CAST(0 AS BIGINT) AS rows,
 NOT EXISTS (SELECT 1 FROM v_chunks c WHERE c.document_id = d.id AND c.node_id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM v_sections s WHERE s.document_id = d.id AND s.order_index > 20) AS clean FROM v_documents d WHERE d.deleted_at IS NOT NULL""",
)
def d10(v):
    """After a delete of all soft-deleted documents that left every third vector and long documents' last sections."""
    docs = v.documents.select(F.col("id").alias("document_id"), "deleted_at")
    gone = docs.where("deleted_at IS NOT NULL").select("document_id")
    vectors = U.delete(v.chunks.where("node_id % 3 <> 0"), gone, "document_id").select("document_id").unionByName(v.chunks.where("node_id % 3 = 0").select("document_id"))
    sections = U.delete(v.sections.where("order_index <= 20"), gone, "document_id").select("document_id").unionByName(v.sections.where("order_index > 20").select("document_id"))
    return U.left_over(gone, "document_id", vectors=vectors, sections=sections, rows=U.delete(docs, gone, "document_id"))


@query(
    "d11_consistency_report",
    "SELECT (SELECT count(*) FROM v_sections) AS sections, (SELECT count(*) FROM v_chunks) AS vectors, (SELECT count(*) FROM v_chunks c WHERE NOT EXISTS (SELECT 1 FROM v_sections s WHERE s.document_id = c.document_id AND s.order_index = c.section_id)) AS orphan_vectors, (SELECT count(*) FROM v_sections s WHERE NOT EXISTS (SELECT 1 FROM v_chunks c WHERE s.document_id = c.document_id AND s.order_index = c.section_id)) AS bare_sections",
)
def d11(v):
    return U.consistency(v.sections.select("document_id", F.col("order_index").alias("section_id")), v.chunks.select("document_id", F.col("section_id").cast("long").alias("section_id")), "document_id", "section_id")


@query("d12_stuck_recovery", "SELECT id, CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-01 08:00:00' THEN CASE WHEN id IN (SELECT document_id FROM v_chunks) THEN 'ready' ELSE 'failed' END ELSE status END AS status FROM v_documents")
def d12(v):
    has = v.chunks.select(F.col("document_id").alias("id")).distinct().withColumn("has", F.lit(True))
    stuck = F.expr("status = 'processing' AND created_at < TIMESTAMP_NTZ '2024-01-01 08:00:00'")
    return v.documents.select("id", "status", "created_at").join(has, "id", "left").select("id", F.when(stuck, F.when(F.col("has"), "ready").otherwise("failed")).otherwise(F.col("status")).alias("status"))


@query("d13_updated_at", "SELECT id, CASE WHEN id % 6 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE created_at END AS updated_at FROM v_documents")
def d13(v):
    return v.documents.select("id", F.when(F.col("id") % 6 == 0, v.now).otherwise(F.col("created_at")).alias("updated_at"))


@query("d14_feedback_insert", "SELECT id, list_sort(list_distinct(list(document_id))) AS document_ids FROM v_citations GROUP BY 1")
def d14(v):
    return v.citations.groupBy("id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))


@query("d15_key_marks", "SELECT user_id % 50 AS key_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type <> 'error') AS successes FROM events GROUP BY 1")
def d15(v):
    g = v.table("events").groupBy((F.col("user_id") % 50).alias("key_id"))
    return g.agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") != "error").alias("successes"))


# --- point access


@query("k01_by_primary_key", "SELECT id, file_name, status FROM v_documents WHERE id = 42")
def k01(v):
    return v.documents.where("id = 42").limit(1).select("id", "file_name", "status")


@query("k02_by_unique_key", "SELECT tenant_id, name FROM v_tenants WHERE slug = 'france' UNION ALL SELECT -1, 'default' WHERE NOT EXISTS (SELECT 1 FROM v_tenants WHERE slug = 'france')")
def k02(v):
    d = v.spark.createDataFrame([("france", -1, "default")], "slug string, d_id long, d_name string")
    return d.join(v.tenants, "slug", "left").select(F.coalesce("tenant_id", "d_id").alias("tenant_id"), F.coalesce("name", "d_name").alias("name"))


@query("k03_active_provider", "SELECT key_id, name FROM v_keys WHERE is_active ORDER BY key_id LIMIT 1")
def k03(v):
    return v.keys.where("is_active").orderBy("key_id").limit(1).select("key_id", "name")


@query("k04_tenant_guarded", "SELECT id FROM v_documents WHERE id = 42 AND tenant_id = 3")
def k04(v):
    return v.documents.where("id = 42 AND tenant_id = 3").select("id")


@query("k05_sections_of_document", "SELECT section_id, title FROM v_sections WHERE document_id = 12 AND section_id IN ('sec-0001', 'sec-0003') ORDER BY order_index")
def k05(v):
    return v.sections.where("document_id = 12").where(F.col("section_id").isin("sec-0001", "sec-0003")).orderBy("order_index").select("section_id", "title")


@query("k06_key_sets", "SELECT document_id, list_sort(list(section_id)) AS ids FROM v_sections GROUP BY 1")
def k06(v):
    return v.sections.groupBy("document_id").agg(F.array_sort(F.collect_set("section_id")).alias("ids"))


@query("k07_access_both_ways", "SELECT 'tenants' AS what, tenant_id AS id FROM v_access WHERE document_id = 16 UNION ALL SELECT 'documents', document_id FROM v_access WHERE tenant_id = 3")
def k07(v):
    a = v.access.where("document_id = 16").select(F.lit("tenants").alias("what"), F.col("tenant_id").alias("id"))
    return a.unionByName(v.access.where("tenant_id = 3").select(F.lit("documents").alias("what"), F.col("document_id").alias("id")))


@query("k08_insert_with_defaults", "SELECT doc_id AS id, 'pending' AS status, 'uploaded' AS stage, CAST(1 AS BIGINT) AS progress FROM documents")
def k08(v):
    return v.table("documents").select(F.col("doc_id").alias("id"), F.lit("pending").alias("status"), F.lit("uploaded").alias("stage"), F.lit(1).cast("long").alias("progress"))


@query("k09_partial_update", "SELECT tenant_id, CASE WHEN tenant_id = 3 THEN 'renamed' ELSE slug END AS slug, CASE WHEN tenant_id = 5 THEN 'Named' ELSE name END AS name FROM v_tenants")
def k09(v):
    p = v.spark.createDataFrame([(3, "renamed", None), (5, None, "Named")], "tenant_id long, slug string, name string")
    return U.patch(v.tenants, p, "tenant_id")


@query("k10_delete_protected", "SELECT key_id FROM v_keys WHERE NOT (key_id IN (1, 2, 3) AND key_id <> 2)")
def k10(v):
    gone = v.keys.where(F.col("key_id").isin(1, 2, 3) & (F.col("key_id") != 2))
    return U.delete(v.keys, gone, "key_id").select("key_id")


@query("k11_close_faq", "SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'closed' ELSE 'open' END AS status FROM events")
def k11(v):
    return v.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, "closed").otherwise("open").alias("status"))


@query("k12_settings_map", "SELECT list(slug || '=' || name ORDER BY slug) AS entries FROM v_tenants")
def k12(v):
    m = v.tenants.agg(F.map_from_entries(F.collect_list(F.struct("slug", "name"))).alias("m"))
    return m.select(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("entries"))


@query("k13_document_page", "SELECT d.id, coalesce(list(t.name ORDER BY t.name) FILTER (t.name IS NOT NULL), []) AS tenants FROM (SELECT id FROM v_documents WHERE deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 10 OFFSET 20) d LEFT JOIN v_access a ON a.document_id = d.id LEFT JOIN v_tenants t ON t.tenant_id = a.tenant_id GROUP BY 1")
def k13(v):
    page = v.documents.where("deleted_at IS NULL").orderBy(F.desc("created_at"), "id").offset(20).limit(10).select("id")
    named = v.access.join(v.tenants, "tenant_id").select(F.col("document_id").alias("id"), "name")
    return page.join(named, "id", "left").groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("tenants"))


@query("k14_access_change_invalidates", "SELECT DISTINCT tenant_id FROM (SELECT tenant_id FROM v_access WHERE document_id IN (4, 8) UNION ALL SELECT 19) x")
def k14(v):
    """Old and new tenants alike."""
    new = v.spark.createDataFrame([(19,)], "tenant_id long")
    return v.access.where("document_id IN (4, 8)").select("tenant_id").unionByName(new).distinct()


@query("k16_usage_emission", "SELECT id, CASE WHEN model_type = 'llm' THEN total_tokens ELSE greatest(0, total_tokens - 30) END AS tokens, CASE WHEN model_type = 'llm' THEN cost_micros_vnd ELSE 0 END AS cost FROM v_usage WHERE NOT (model_type = 'llm' AND total_tokens = 0)")
def k16(v):
    llm = F.col("model_type") == "llm"
    u = v.usage.where(~(llm & (F.col("total_tokens") == 0)))
    return u.select("id", F.when(llm, F.col("total_tokens")).otherwise(F.greatest(F.lit(0), F.col("total_tokens") - 30)).alias("tokens"), F.when(llm, F.col("cost_micros_vnd")).otherwise(0).alias("cost"))


@query("k18_task_status_merge", "SELECT id, coalesce(CASE WHEN id % 10 <> 3 THEN status END, CASE WHEN id % 20 = 3 THEN 'STARTED' END, 'pending') AS status FROM v_documents")
def k18(v):
    backend = v.documents.where("id % 20 = 3").select("id", F.lit("STARTED").alias("task"))
    return v.documents.select("id", F.when(F.col("id") % 10 != 3, F.col("status")).alias("s")).join(backend, "id", "left").select("id", F.coalesce("s", "task", F.lit("pending")).alias("status"))


@query("k20_audit_payload", "SELECT event_id, coalesce(nullif(actor, 'None'), '') AS actor, CASE WHEN trim(action) = '' THEN '' ELSE action END AS action FROM v_audit")
def k20(v):
    return v.audit.select("event_id", F.coalesce(F.nullif("actor", F.lit("None")), F.lit("")).alias("actor"), F.when(F.trim("action") == "", "").otherwise(F.col("action")).alias("action"))


@query("k21_cache_payload", "SELECT item_id, '{\"id\":' || item_id || ',\"answer\":\"a' || item_id || '\",\"model\":\"faq\"}' AS payload FROM benchmark")
def k21(v):
    s = F.struct(F.col("item_id").alias("id"), F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("answer"), F.lit("faq").alias("model"))
    return v.table("benchmark").select("item_id", F.to_json(s).alias("payload"))


@query("k23_probe_and_add", "SELECT doc_id, doc_id <> first AS seen FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) d")
def k23(v):
    first = v.table("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"))
    return v.table("documents").select("doc_id", F.sha2("text", 256).alias("h")).join(first, "h").select("doc_id", (F.col("doc_id") != F.col("first")).alias("seen"))


@query("k26_faithfulness_decision", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 THEN value > 25 ELSE true END AS faithful FROM events")
def k26(v):
    k = F.col("event_id") % 4
    return v.table("events").select("event_id", F.when(k == 0, False).when(k == 1, F.col("value") > 25).otherwise(True).alias("faithful"))


@query("k27_source_nodes", "SELECT document_id, section_id FROM v_sections WHERE trim(content) <> ''")
def k27(v):
    return v.sections.where(F.trim("content") != "").select("document_id", "section_id")


@query("k28_parser_metadata", "SELECT document_id, section_id, level, title FROM v_sections")
def k28(v):
    m = F.struct("document_id", "section_id", "level", "title")
    return v.sections.select(m.alias("m")).select("m.*")


@query("k29_item_page", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE doc_id % 5 END AS page FROM documents")
def k29(v):
    """Page of the first provenance that has one."""
    d = F.col("doc_id")
    prov = F.array(F.when(d % 3 == 0, d % 7), F.lit(None).cast("long"), d % 5)
    return v.table("documents").select("doc_id", F.get(F.filter(prov, lambda p: p.isNotNull()), 0).alias("page"))


@query("k30_retry_flow", "SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'gone' WHEN tenant_id <> 5 THEN 'not_found' WHEN status = 'failed' THEN 'retry' WHEN status = 'ready' THEN 'rechunk' ELSE 'refused' END AS outcome FROM v_documents")
def k30(v):
    s = F.col("status")
    out = F.when(F.col("deleted_at").isNotNull(), "gone").when(F.col("tenant_id") != 5, "not_found").when(s == "failed", "retry").when(s == "ready", "rechunk").otherwise("refused")
    return v.documents.select("id", out.alias("outcome"))


@query("k31_billing_merge", "SELECT t.tenant_id, coalesce(CASE WHEN tenant_id % 3 = 0 THEN tenant_id * 100 END, 400) AS price FROM v_tenants t")
def k31(v):
    stored = v.tenants.where("tenant_id % 3 = 0").select("tenant_id", (F.col("tenant_id") * 100).alias("price"))
    return v.tenants.join(stored, "tenant_id", "left").select("tenant_id", F.coalesce("price", F.lit(400)).alias("price"))


@query("k25_stopword_filter", "SELECT item_id, len(list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ('de', 'la', 'the'))) AS n FROM benchmark")
def k25(v):
    return v.table("benchmark").select("item_id", F.size(F.filter(F.split(F.lower("text"), " "), lambda w: ~w.isin("de", "la", "the"))).cast("long").alias("n"))


@query("o02_stable_pages", "SELECT id, CAST((row_number() OVER (ORDER BY created_at, id) - 1) // 100 AS BIGINT) AS page FROM v_documents WHERE deleted_at IS NULL AND tenant_id < 10")
def o02p(v):
    """Pages of all rows: numbers of rows before, from counts by hour, so no window holds all rows."""
    d = v.documents.where("deleted_at IS NULL AND tenant_id < 10").select("id", "created_at", F.date_trunc("hour", "created_at").alias("h"))
    n = d.groupBy("h").agg(F.count("*").alias("n"))
    before = n.select("h", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("h").orderBy("created_at", "id"))
    return d.join(before, "h").select("id", F.floor((F.col("before") + own - 1) / 100).alias("page"))
