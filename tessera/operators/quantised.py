"""Vectors of whole numbers from -127 to 127, a coarse scan over them, and exact scores of what the scan can't rule out.

A vector is kept as codes, a scale, its length, and how far the codes are from it as a share of that length. For any query the cosine of the codes differs from the
exact one by no more than this share (Cauchy-Schwarz), so a row whose upper bound is below the k-th lower bound of a query can't be among its k best. Exact vectors
are read for the others only, and the result is that of an exact scan, ties and rounding included.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.operators import retrieval as R

#: Scores are rounded to six places; what may round to the same value isn't ruled out.
ROUNDING = 2e-6


def checked(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """The rows with `fault`: missing, dimension, not-finite or zero; null for a vector that a collection of this dimension takes."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(odd, "not-finite").when(R.norm(v) == 0, "zero")
    return vectors.withColumn("fault", fault)


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with codes, scale, length and slack instead of the vector, which has to be without a fault other than zero."""
    x = F.col("x")
    q = vectors.withColumn("x", F.transform(vector, lambda e: e.cast("double"))).drop(vector)
    q = q.withColumn("scale", F.coalesce(F.array_max(F.transform(x, lambda e: F.abs(e))), F.lit(0.0)) / 127)
    q = q.withColumn("codes", F.when(F.col("scale") > 0, F.transform(x, lambda e: F.round(e / F.col("scale")).cast("tinyint"))).otherwise(F.transform(x, lambda e: F.lit(0).cast("tinyint"))))
    off = F.sqrt(F.aggregate(F.zip_with(x, "codes", lambda e, c: e - c * F.col("scale")), F.lit(0.0), lambda s, d: s + d * d))
    q = q.withColumn("length", R.norm(x))
    return q.withColumn("slack", F.when(F.col("length") > 0, off / F.col("length")).otherwise(0.0)).drop("x")


def topk(queries: DataFrame, coarse: DataFrame, exact: DataFrame, k: int, key: str = "node_id") -> DataFrame:
    """Of queries (query_id, qvec) the k closest rows of `coarse` (key, codes, scale, length, slack, ...) by the vectors of `exact` (key, embedding): the rows of `dense_topk`. Ids of queries are unique."""
    spare = [n for n in ("codes", "scale", "length") if n in coarse.columns]
    kept = [f"`{n}` {kind}" for n, kind in [*coarse.dtypes, *queries.dtypes] if n not in ("codes", "qvec")]

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return cells.not_ruled_out(q, c, k, ROUNDING)

    rough = cells.grid(queries, coarse, key, run, ", ".join([*kept, "near double"]), R.QUERY_BLOCK, pairs=cells.PAIRS)
    # what a cell's own k-th lower bound left is held against that of all cells
    low = F.col("near") - F.col("slack")
    own = W.partitionBy("query_id")
    first = rough.withColumn("low", low).withColumn("at", F.row_number().over(own.orderBy(F.desc("low"), F.col(key))))
    left = first.withColumn("least", F.min(F.when(F.col("at") <= k, F.col("low"))).over(own)).where(F.col("near") + F.col("slack") + ROUNDING >= F.col("least")).drop("near", "slack", "low", "at", "least", *spare)
    scored = left.join(queries.select("query_id", "qvec"), "query_id").join(exact.select(key, "embedding"), key)
    scored = scored.withColumn("score", F.round(R.cosine(F.col("embedding"), F.col("qvec")), 6)).drop("embedding", "qvec")
    return R.ranked(scored, k, "query_id", F.desc("score"), F.col(key))
