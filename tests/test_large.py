"""What tables that are many times as large bring out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import cells
from tessera.operators import retrieval as R
from tessera.plans import registry


def test_whole_mean_in_any_order(spark):
    """Doubles in cents with a mean of 50: their sum lies below or above it, by their order (F20)."""
    rng = random.Random(4)
    rows = []
    for k in range(200):
        cents = [rng.randrange(20_000) for _ in range(64)]
        cents.append(65 * 5000 - sum(cents))
        rows += [(k, c / 100) for c in cents]
    df = spark.createDataFrame(rows, "k long, x double").coalesce(1)
    assert {r.m for r in df.groupBy("k").agg(F.avg("x").cast("long").alias("m")).collect()} == {49, 50}
    assert {r.m for r in df.groupBy("k").agg(A.whole_mean("x").alias("m")).collect()} == {50}
    mean = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(A.whole_mean("x").alias("m")).first().m
    assert [mean(-2.5, -1.0), mean(2.9999999), mean(None, 3.0), mean(None), mean(1e10, 1e15)] == [-1, 2, 3, None, 500_005_000_000_000]


def odd_vectors(spark, n=300):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    rows = [(i, i % 3 if i % 50 else None, base[rng.randrange(40)]) for i in range(n)]
    odd = [None, [], [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0, 1.0]]
    rows += [(n + i, i % 3, x) for i, x in enumerate(odd * 2)]
    return spark.createDataFrame(rows, "node_id long, section_id int, embedding array<float>")


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


def test_cells_against_pairs(spark, monkeypatch):
    """Grids of many cells give what all pairs one by one give, whatever the vectors (F1)."""
    monkeypatch.setattr(cells, "ROWS", 60)
    monkeypatch.setattr(cells, "WORK", 500)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    c = odd_vectors(spark)
    q = c.where("node_id % 9 = 0 OR node_id >= 300").select(F.col("node_id").alias("query_id"), F.col("section_id").alias("label"), F.col("embedding").cast("array<double>").alias("qvec"))
    pairs = q.crossJoin(c).withColumn("score", F.round(R.cosine(F.col("embedding"), F.col("qvec")), 6)).drop("embedding", "qvec")
    columns = ["query_id", "label", "node_id", "section_id", "score"]
    order = [F.desc("score"), F.col("node_id")]
    for k in (1, 7, 500):
        assert plain(R.dense_topk(q, c, k).select(*columns, "rank").collect()) == plain(R.ranked(pairs, k, "query_id", *order).select(*columns, "rank").collect())
        assert plain(R.dense_topk(q, c, k, within=("label", "section_id")).select(*columns, "rank").collect()) == plain(R.ranked(pairs.where("label = section_id"), k, "query_id", *order).select(*columns, "rank").collect())
    assert plain(R.cosines(q, c).select(*columns).collect()) == plain(pairs.select(*columns).collect())
    for none in (R.dense_topk(q, c.where("false"), 3), R.dense_topk(q.where("false"), c, 3), R.cosines(q, c.where("false")), R.dense_topk(q.where("query_id = 0"), c, 3, within=("label", "section_id"))):
        assert none.collect() == []


def test_nearest_ids_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "ID_ROWS", 60)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    c = odd_vectors(spark).select((F.col("node_id") * 389 % 1009).alias("node_id"), "section_id").unionByName(spark.createDataFrame([(None, 1), (None, None)], "node_id long, section_id int"))
    q = c.where("node_id % 9 = 0").select(F.col("node_id").alias("query_id"), F.col("section_id").alias("label"))
    pairs = q.join(c, F.col("label") == F.col("section_id")).withColumn("score", 1.0 / (1 + F.abs(F.col("node_id") - F.col("query_id"))))
    for k in (1, 6, 400):
        want = R.ranked(pairs, k, "query_id", F.desc("score"), F.col("node_id"))
        assert plain(R.nearest_ids(q, c, k, ("label", "section_id")).select(*want.columns).collect()) == plain(want.collect())


def test_rounding_borders():
    """A cosine on the border of two rounded values goes up, and its value doesn't depend on how a product of matrices summed it."""
    again = lambda i: np.array([0.0078125, -0.0078125, 0.5, 0.25])[i]
    assert cells.rounded(np.array([0.0078125 - 1e-17, -0.0078125 + 1e-17, 0.5, 0.2500004]), again).tolist() == [0.007813, -0.007813, 0.5, 0.25]


#: Queries that score all pairs, by finding: they go through cells, not through one row for each pair.
SCORED = {
    "F1": "a17_confidence",
    "F2": "a22_category_metrics",
    "F3": "e03_hits_and_reciprocal_rank",
    "F4": "e04_verdict",
    "F5": "e06_scorecard",
    "F6": "j10_hydration",
    "F7": "j17_query_corpus",
    "F8": "o06_sort_dedup_limit",
    "F9": "t35_citations",
    "F10": "v10_bi_encoder_rerank",
    "F11": "v11_cross_encoder_rerank",
    "F12": "v18_semantic_cache",
    "F13": "s18_quantised_topk",
    "F14": "v01_cosine",
    "F15": "v04_fusion_weighted",
    "F16": "v08_auto_merge",
    "F17": "v12_rerank_when_useful",
    "F18": "v22_grounding_needed",
    "F19": "w05_rank_in_query",
    "F21": "o12_long_context_reorder",
    "F22": "v04_fusion_reciprocal",
    "F23": "v07_section_route",
    "F24": "o07_topk_vector",
    "F25": "f14_rerank_skip",
    "F26": "v02_filtered_dense_topk",
}


@pytest.mark.parametrize("name", SCORED.values())
def test_pairs_meet_in_cells(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CoGroupsInArrow" in plan
