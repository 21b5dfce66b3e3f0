"""Evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.plans.registry import query
from tessera.plans.retrieval import _dense, dense

_REL = "SELECT q.vec_id AS query_id, c.node_id FROM v_chunks c JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id % 20 = 0) q ON c.section_id = q.label WHERE c.node_id <> q.vec_id"
_RANK = f"SELECT h.query_id, CAST(coalesce(min(CASE WHEN r.node_id IS NOT NULL THEN rank END), 0) AS BIGINT) AS rank FROM ({_dense(5)}) h LEFT JOIN ({_REL}) r ON r.query_id = h.query_id AND r.node_id = h.node_id GROUP BY 1"
_CASES = f"SELECT query_id, CASE WHEN query_id // 20 % 2 = 0 THEN 'even' ELSE 'odd' END AS category, rank, CAST(rank BETWEEN 1 AND 1 AS INTEGER) AS hit1, CAST(rank BETWEEN 1 AND 3 AS INTEGER) AS hit3, CAST(rank BETWEEN 1 AND 5 AS INTEGER) AS hit5, CASE WHEN rank >= 1 THEN 1.0 / rank ELSE 0.0 END AS rr, (query_id // 20 % 5) / 4.0 AS recall FROM ({_RANK}) k"


def ranks(v):
    q = v.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return E.first_ranks(dense(v, 5).join(q, "query_id"), (F.col("section_id") == F.col("label")) & (F.col("node_id") != F.col("query_id")))


def cases(v):
    kind = F.when(F.expr("query_id div 20 % 2 = 0"), "even").otherwise("odd")
    return ranks(v).select("query_id", kind.alias("category"), "rank", *E.case_metrics(F.col("rank")), (F.expr("query_id div 20 % 5") / 4.0).alias("recall"))


@query("e01_target_match", "SELECT document_id, section_id, coalesce(section_code = '2' OR starts_with(section_code, '2.'), false) OR contains(lower(title), '2') AS matches FROM v_sections")
def e01(v):
    return v.sections.select("document_id", "section_id", E.target_match(F.col("section_code"), F.col("title"), F.lit("2")).alias("matches"))


@query("e02_keyword_recall", "SELECT doc_id, round((CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'der') AS INTEGER) + CAST(contains(lower(text), 'que') AS INTEGER)) / 3.0, 6) AS recall FROM documents")
def e02(v):
    return v.table("documents").select("doc_id", F.round(E.keyword_recall(F.col("text"), F.array(F.lit("the"), F.lit("DER"), F.lit("que"))), 6).alias("recall"))


@query("e03_hits_and_reciprocal_rank", f"SELECT query_id, rank, hit1, hit3, hit5, round(rr, 6) AS rr FROM ({_CASES}) c")
def e03(v):
    return cases(v).select("query_id", "rank", "hit1", "hit3", "hit5", F.round("rr", 6).alias("rr"))


@query("e04_verdict", f"SELECT query_id, CASE WHEN rank = 1 AND recall >= 0.7 THEN 'PASS' WHEN rank <= 3 AND recall >= 0.5 THEN 'ACCEPTABLE' ELSE 'FAIL' END AS verdict FROM ({_CASES}) c")
def e04(v):
    return cases(v).select("query_id", E.verdict(F.col("rank"), F.col("recall")).alias("verdict"))


@query("e05_negative_traps", "SELECT doc_id, NOT (contains(lower(text), 'license') OR contains(lower(text), 'password')) AS passed FROM documents")
def e05(v):
    return v.table("documents").select("doc_id", E.trap_passed(F.col("text"), F.array(F.lit("License"), F.lit("password"))).alias("passed"))


_AVG = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("hit1", "hit3", "hit5", "rr", "recall"))


@query("e06_scorecard", f"SELECT category, count(*) AS n, {_AVG} FROM ({_CASES}) c GROUP BY ROLLUP (category)")
def e06(v):
    return E.scorecard(cases(v))


@query("a22_category_metrics", f"SELECT category, count(*) AS n, {_AVG} FROM ({_CASES}) c GROUP BY 1 UNION ALL SELECT 'overall', count(*), {_AVG} FROM ({_CASES}) c")
def a22(v):
    return E.scorecard(cases(v)).withColumn("category", F.coalesce("category", F.lit("overall")))


@query("a23_percentiles", "SELECT p, (SELECT list_sort(list(latency_ms)) FROM v_usage)[1 + least(CAST(floor((SELECT count(*) FROM v_usage) * p) AS BIGINT), (SELECT count(*) FROM v_usage) - 1)] AS latency_ms FROM (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.95)) t(p)")
def a23(v):
    return E.upper_rank_percentiles(v.usage, "latency_ms", (0.5, 0.9, 0.95))
