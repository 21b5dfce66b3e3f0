"""The tables of a knowledge assistant's back end, adapted from the test tables, each with its SQL twin.

A view is a DataFrame function and a SQL text with the same columns and rows. Times carry no zone and mean UTC.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for the current time in every query, so that results can be repeated.
NOW = "2024-01-31 00:00:00"
#: Price of a million tokens in VND; a token then costs as many micro-VND.
PRICE_IN, PRICE_OUT = 100, 400

SQL = {
    "v_usage": f"""
SELECT *, prompt_tokens + completion_tokens AS total_tokens, prompt_tokens * {PRICE_IN} + completion_tokens * {PRICE_OUT} AS cost_micros_vnd FROM (
SELECT event_id AS id, ts AS created_at, user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id % 20 END AS tenant_id,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'llm' WHEN event_type = 'view' THEN 'embedding' WHEN event_type = 'click' THEN 'reranker' ELSE 'other' END AS model_type,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CASE WHEN event_type IN ('purchase', 'error') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS completion_tokens,
  value AS latency_ms, '/' || event_type AS endpoint, event_id % 5 = 0 AS is_cache_hit FROM events) u""",
    "v_tenants": "SELECT CAST(n_nationkey AS BIGINT) AS tenant_id, lower(n_name) AS slug, n_name AS name FROM nation",
    "v_users": "SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS role, CAST(c_nationkey AS BIGINT) AS home_tenant FROM customer",
    "v_feedback": """
SELECT event_id AS id, ts AS created_at, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id % 20 END AS tenant_id, CASE WHEN event_type = 'click' THEN 'like' ELSE 'dislike' END AS feedback_type,
  event_id % 50 AS document_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 10 END AS section_id, 1 + event_id % 2 AS n_citations
FROM events WHERE event_type IN ('click', 'error')""",
    "v_citations": """
SELECT id, created_at, tenant_id, feedback_type, pos, CASE WHEN pos = 0 THEN document_id ELSE (document_id + 7) % 50 END AS document_id, section_id,
  CASE WHEN id % 4 = 0 THEN NULL ELSE 'Title ' || CASE WHEN pos = 0 THEN document_id ELSE (document_id + 7) % 50 END || ' v' || id % 3 END AS title
FROM (SELECT *, unnest(range(0, n_citations)) AS pos FROM v_feedback) f""",
    "v_documents": """
SELECT doc_id AS id, source AS file_name, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS version, sha256(text) AS sha256, doc_id % 20 AS tenant_id,
  CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'ready' END AS status,
  CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS deleted_at, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS created_at,
  lang, n_chars, text FROM documents""",
    "v_access": "SELECT (doc_id + 7) % 20 AS tenant_id, doc_id AS document_id FROM documents WHERE doc_id % 4 = 0",
    "v_chunks": "SELECT vec_id AS node_id, vec_id % 50 AS document_id, label AS section_id, embedding FROM embeddings",
    "v_questions": """
SELECT vec_id AS query_id, vec_id // 100 AS request_id, vec_id // 20 % 25 AS tenant_id, CASE WHEN vec_id % 60 = 0 THEN 'section 2.1 ' ELSE '' END || coalesce(string_split(text, chr(10))[1], '') AS text, embedding
FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0""",
    "v_messages": "SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations",
    "v_requests": "SELECT event_id, user_id % 20 AS key, user_id, ts, CAST(floor(value) AS BIGINT) AS cost FROM events",
    "v_audit": "SELECT event_id, ts, CASE WHEN event_id % 50 = 0 THEN ' ' ELSE event_type END AS action, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'None' ELSE CAST(user_id AS VARCHAR) END AS actor, props AS details_json FROM events",
    "v_keys": "SELECT s_suppkey AS key_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS provider, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 00:00:00' - s_suppkey * INTERVAL 37 MINUTE END AS last_used_at, CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-30 12:00:00' + s_suppkey * INTERVAL 29 MINUTE END AS rate_limited_until, s_suppkey % 5 <> 0 AS is_active, CASE WHEN s_suppkey % 6 = 0 THEN TIMESTAMP '2024-01-30 20:00:00' + s_suppkey * INTERVAL 7 MINUTE END AS expires_at, sha256(s_name) AS key_hash FROM supplier",
    "v_sections": """
SELECT doc_id AS document_id, k AS order_index, printf('sec-%04d', k) AS section_id, CASE WHEN k > 0 THEN printf('sec-%04d', (k - 1) // 2) END AS parent_section_id,
  CAST(1 + k // 3 AS VARCHAR) || CASE WHEN k % 3 > 0 THEN '.' || CAST(k % 3 AS VARCHAR) ELSE '' END AS section_code, content, CAST(1 + k AS VARCHAR) || ' Section' AS title, 1 + k % 3 AS level
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents) d""",
}


class Views:
    """DataFrames of the views over a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp_ntz")

    @cached_property
    def usage(self) -> DataFrame:
        kind = F.expr("CASE WHEN event_type IN ('purchase', 'error') THEN 'llm' WHEN event_type = 'view' THEN 'embedding' WHEN event_type = 'click' THEN 'reranker' ELSE 'other' END")
        u = self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            "user_id",
            F.expr("CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id % 20 END").alias("tenant_id"),
            kind.alias("model_type"),
            F.floor(F.col("value") * 10).alias("prompt_tokens"),
            F.when(kind == "llm", F.floor("value")).otherwise(0).alias("completion_tokens"),
            F.col("value").alias("latency_ms"),
            F.concat(F.lit("/"), "event_type").alias("endpoint"),
            (F.col("event_id") % 5 == 0).alias("is_cache_hit"),
        )
        return u.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "cost_micros_vnd": F.col("prompt_tokens") * PRICE_IN + F.col("completion_tokens") * PRICE_OUT})

    @cached_property
    def tenants(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("tenant_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").cast("long").alias("home_tenant"))

    @cached_property
    def feedback(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_type IN ('click', 'error')")
            .selectExpr(
                "event_id AS id", "ts AS created_at", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id % 20 END AS tenant_id", "CASE WHEN event_type = 'click' THEN 'like' ELSE 'dislike' END AS feedback_type",
                "event_id % 50 AS document_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 10 END AS section_id", "1 + event_id % 2 AS n_citations",
            )
        )

    @cached_property
    def citations(self) -> DataFrame:
        """Citations of each feedback, exploded: one row for each (feedback, position)."""
        f = self.feedback.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_citations") - 1)))
        doc = F.when(F.col("pos") == 0, F.col("document_id")).otherwise((F.col("document_id") + 7) % 50)
        f = f.withColumn("document_id", doc)
        title = F.when(F.col("id") % 4 != 0, F.concat(F.lit("Title "), F.col("document_id").cast("string"), F.lit(" v"), (F.col("id") % 3).cast("string")))
        return f.select("id", "created_at", "tenant_id", "feedback_type", "pos", "document_id", "section_id", title.alias("title"))

    @cached_property
    def documents(self) -> DataFrame:
        from pyspark.sql import Window as W

        at = lambda s: F.lit(s).cast("timestamp_ntz")
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("file_name"),
            F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("version"),
            F.sha2("text", 256).alias("sha256"),
            (F.col("doc_id") % 20).alias("tenant_id"),
            F.when(F.col("doc_id") % 10 == 0, "failed").when(F.col("doc_id") % 10 == 1, "processing").otherwise("ready").alias("status"),
            F.when(F.col("doc_id") % 13 == 0, at("2024-01-20 00:00:00")).alias("deleted_at"),
            (at("2024-01-01 00:00:00") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
            "lang",
            "n_chars",
            "text",
        )

    @cached_property
    def versions(self) -> DataFrame:
        """The documents, with versions counted in ranges of ids: few sources have all rows."""
        from pyspark.sql import Window as W

        d = self.documents.drop("version").withColumn("part", F.floor(F.col("id") / 4096))
        counts = d.groupBy("file_name", "part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("file_name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("file_name", "part", before.alias("before"))
        local = F.row_number().over(W.partitionBy("file_name", "part").orderBy("id"))
        return d.withColumn("local", local).join(counts, ["file_name", "part"]).withColumn("version", (F.col("before") + F.col("local")).cast("long")).drop("part", "local", "before")

    @cached_property
    def access(self) -> DataFrame:
        return self.table("documents").where("doc_id % 4 = 0").select(((F.col("doc_id") + 7) % 20).alias("tenant_id"), F.col("doc_id").alias("document_id"))

    @cached_property
    def chunks(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id AS node_id", "vec_id % 50 AS document_id", "label AS section_id", "embedding")

    @cached_property
    def questions(self) -> DataFrame:
        """Every vector whose id is divisible by 20 as a question, with the first line of a document as its text; every third names a section; five make a request."""
        d = self.table("documents").select(F.col("doc_id").alias("vec_id"), F.element_at(F.split("text", "\n", -1), 1).alias("line"))
        e = self.table("embeddings").where("vec_id % 20 = 0").join(d, "vec_id", "left")
        text = F.concat(F.when(F.col("vec_id") % 60 == 0, "section 2.1 ").otherwise(""), F.coalesce("line", F.lit("")))
        return e.select(F.col("vec_id").alias("query_id"), F.expr("vec_id div 100").alias("request_id"), F.expr("vec_id div 20 % 25").alias("tenant_id"), text.alias("text"), F.col("embedding").alias("qvec"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").selectExpr("conv_id AS conversation_id", "turn", "role", "text AS content")

    @cached_property
    def requests(self) -> DataFrame:
        return self.table("events").select("event_id", (F.col("user_id") % 20).alias("key"), "user_id", "ts", F.floor("value").alias("cost"))

    @cached_property
    def audit(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id", "ts", "CASE WHEN event_id % 50 = 0 THEN ' ' ELSE event_type END AS action",
            "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'None' ELSE CAST(user_id AS STRING) END AS actor", "props AS details_json",
        )

    @cached_property
    def keys(self) -> DataFrame:
        """API keys of providers, from suppliers."""
        minutes = lambda base, k: f"TIMESTAMP_NTZ '{base}' + make_dt_interval(0, 0, CAST({k} * s_suppkey AS INT))"
        return self.table("supplier").selectExpr(
            "s_suppkey AS key_id", "s_name AS name", "CAST(s_nationkey AS BIGINT) AS provider",
            f"CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {minutes('2024-01-30 00:00:00', -37)} END AS last_used_at",
            f"CASE WHEN s_suppkey % 4 = 0 THEN {minutes('2024-01-30 12:00:00', 29)} END AS rate_limited_until",
            "s_suppkey % 5 <> 0 AS is_active", f"CASE WHEN s_suppkey % 6 = 0 THEN {minutes('2024-01-30 20:00:00', 7)} END AS expires_at", "sha2(s_name, 256) AS key_hash",
        )

    @cached_property
    def sections(self) -> DataFrame:
        """The lines of each document as a binary tree of sections."""
        d = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "content"))
        k = F.col("p").cast("long")
        code = lambda c: F.format_string("sec-%04d", c)
        third = F.floor(k / 3)
        return d.select(
            F.col("doc_id").alias("document_id"),
            k.alias("order_index"),
            code(k).alias("section_id"),
            F.when(k > 0, code(F.floor((k - 1) / 2))).alias("parent_section_id"),
            F.concat((1 + third).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("."), (k % 3).cast("string"))).otherwise("")).alias("section_code"),
            "content",
            F.concat((1 + k).cast("string"), F.lit(" Section")).alias("title"),
            (1 + k % 3).alias("level"),
        )


def with_views(sql: str) -> str:
    """The query, with the views that it names (and those that they name) before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in SQL and name not in need:
                add(SQL[name])
                if name not in need:
                    need.append(name)

    add(sql)
    if not need:
        return sql
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in need)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
