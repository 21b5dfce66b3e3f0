"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.scope import Actor, require_tenant, tenant_filter
from tessera.plans.registry import query
from tessera.sources import tables as S
from tessera.sources.manifest import BlobStore
from tessera.streaming import jobs


@query("s01_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s01(v):
    return S.table(v.spark, f"{v.dir}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"]).where("o_orderstatus = 'F'").drop("o_orderstatus")


@query("s02_object_read", "SELECT count(*) AS rows FROM region")
def s02(v):
    """The bytes of a file; a Parquet file begins and ends with its magic."""
    b = S.blobs(v.spark, v.dir, "region.parquet").where(F.expr("substring(content, 1, 4) = X'50415231' AND substring(content, -4, 4) = X'50415231'"))
    return b.select("path").crossJoin(v.table("region").agg(F.count("*").alias("rows"))).select("rows")


@query("s03_object_exists", "SELECT * FROM (VALUES ('region.parquet', true), ('absent.parquet', false)) t(name, found)")
def s03(v):
    listing = S.blobs(v.spark, v.dir, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    keys = v.spark.createDataFrame([("region.parquet",), ("absent.parquet",)], "name string")
    return S.existing(keys, listing, "name")


@query("s04_object_write", "SELECT doc_id, text FROM documents")
def s04(v):
    to = jobs.shared_folder(v.spark, "blobs")
    S.write_blobs(v.table("documents"), to, "doc_id", "text")
    return v.spark.read.parquet(to)


@query("s05_prefix_delete", "SELECT lang || '/' || doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'new ' ELSE '' END || text AS body FROM documents WHERE lang <> 'de'")
def s05(v):
    """All texts by language, every tenth put again, then a language deleted; what readers see after that."""
    store = BlobStore(v.spark, jobs.shared_folder(v.spark, "store"))
    d = v.table("documents").select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("body"))
    store.put(d)
    store.put(d.where("doc_id % 10 = 0").withColumn("body", F.concat(F.lit("new "), "body")))
    store.delete_prefix("de/")
    return store.read()


@query("s14_stream_sink_rows", "SELECT event_id, action, nullif(nullif(trim(actor), ''), 'None') AS actor, coalesce(details_json, '{}') AS details_json FROM v_audit WHERE trim(action) <> ''")
def s14(v):
    return jobs.audit_rows(v.audit).drop("ts")


@query("s15_usage_sink", "SELECT id, prompt_tokens + completion_tokens AS total_tokens, CASE WHEN id % 2 = 0 THEN '00000000-0000-4000-8000-' || lpad(CAST(id AS VARCHAR), 12, '0') END AS request_uuid FROM v_usage")
def s15(v):
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))).otherwise("not a uuid")
    return S.usage_rows(v.usage.withColumn("request_uuid", text)).select("id", "total_tokens", "request_uuid")


@query("s16_vector_upsert", "SELECT node_id, CASE WHEN node_id % 10 = 0 THEN 0.0 ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM v_chunks")
def s16(v):
    store = v.chunks.select("node_id", F.col("embedding")[0].cast("double").alias("first"))
    return S.upsert_vectors(store, store.where("node_id % 10 = 0").withColumn("first", F.lit(0.0)))


@query("s17_sparse_attach", "SELECT node_id, CASE WHEN node_id % 3 = 0 THEN node_id * 2 END AS weight FROM v_chunks")
def s17(v):
    return S.attach_sparse(v.chunks.select("node_id"), v.chunks.where("node_id % 3 = 0").select("node_id", (F.col("node_id") * 2).alias("weight")))


@query("s19_payload_scroll", "SELECT node_id FROM v_chunks WHERE document_id = 7 ORDER BY node_id LIMIT 10000")
def s19(v):
    return v.chunks.where("document_id = 7").orderBy("node_id").limit(10_000).select("node_id")


@query("s20_vector_count", "SELECT (SELECT count(*) FROM v_chunks WHERE document_id = 7) + (SELECT count(*) FROM v_sections WHERE document_id = 7) AS n")
def s20(v):
    both = v.chunks.select("document_id").unionByName(v.sections.select("document_id"))
    return both.where("document_id = 7").agg(F.count("*").alias("n"))


@query("s21_json_report", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def s21(v):
    to = jobs.shared_folder(v.spark, "report")
    S.report(v.table("documents").groupBy("lang").agg(F.count("*").alias("n")), to)
    return v.spark.read.schema("lang string, n long").json(to)


@query("s22_change_feed", "SELECT id, CASE WHEN id % 8 = 0 THEN 'ready' ELSE status END AS status FROM v_documents WHERE id % 8 = 0 AND status <> 'ready'")
def s22(v):
    before = v.documents.select("id", "status")
    now = before.withColumn("status", F.when(F.col("id") % 8 == 0, "ready").otherwise(F.col("status")))
    return jobs.changed(now, before, "id")


@query("p02_strict_scope", "SELECT count(*) AS n FROM v_usage WHERE tenant_id = 4")
def p02(v):
    return v.usage.where(F.col("tenant_id") == require_tenant(Actor(tenant_id=4), 4)).agg(F.count("*").alias("n"))


@query("p03_loose_scope", "SELECT (SELECT count(*) FROM v_usage) AS all_rows, (SELECT count(*) FROM v_usage WHERE tenant_id = 4) AS own_rows")
def p03(v):
    def seen(actor, name):
        t = tenant_filter(actor)
        return (v.usage if t is None else v.usage.where(F.col("tenant_id") == t)).agg(F.count("*").alias(name))

    return seen(Actor(is_admin=True), "all_rows").crossJoin(seen(Actor(tenant_id=4), "own_rows"))
