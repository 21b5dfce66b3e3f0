"""Trees as parent pointers: validation, depth and cycles by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.folders import checkpoint_folder


def duplicates(nodes: DataFrame, *key: str) -> DataFrame:
    return nodes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(nodes: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """Nodes whose parent is not in their group."""
    known = nodes.select(F.col(group), F.col(node).alias(parent)).distinct()
    return nodes.where(F.col(parent).isNotNull()).join(known, [group, parent], "left_anti")


def depths(nodes: DataFrame, group: str, node: str, parent: str, most: int = 64) -> DataFrame:
    """(group, node, depth, cyclic): steps to the root. Each round doubles the distance that pointers span, so that log2(most) rounds do; what still has a pointer then is in, or hangs from, a cycle."""
    p = nodes.select(group, F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNotNull(), 1).otherwise(0).alias("d"))
    for _ in range(max(1, (most - 1).bit_length())):
        q = p.select(F.col(group), F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        p = p.join(q, [group, "up"], "left").select(group, "node", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
    return p.select(group, "node", F.col("d").cast("long").alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def report(nodes: DataFrame, group: str, node: str, parent: str, text: str) -> DataFrame:
    """Of each group: nodes, duplicates (rows beyond the first of an id), missing (rows without an id or a group), orphans (rows whose parent is none of the group's ids), cyclic (ids that
    are in a cycle or hang from one), empties (rows with a blank text), hierarchical (rows with a parent), depth (most steps to a root or to a missing parent; of
    ids that aren't cyclic) and valid (no duplicate, missing, orphan or cycle).

    Ids that come more than once count once as a place in the tree, with their smallest parent, so they don't multiply rows. One pass of pointer doubling
    gives depths and cycles: it ends when no pointer can move, or after as many rounds as the largest group needs, when what still moves is cyclic.
    """
    n = nodes.select(F.col(group).alias("g"), F.nullif(node, F.lit("")).alias("node"), F.nullif(parent, F.lit("")).alias("up"), F.col(text).alias("text"))
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == ""
    ids = n.where("g IS NOT NULL AND node IS NOT NULL").groupBy("g", "node").agg(F.min("up").alias("up"), F.count("*").alias("times"), F.count("up").alias("parents"))
    rows = n.groupBy("g").agg(F.count("*").alias("nodes"), F.count_if(F.col("node").isNull() | F.col("g").isNull()).alias("missing"), F.count_if(blank).alias("empties"), F.count("up").alias("hierarchical"))
    known = ids.select("g", F.col("node").alias("up"), F.lit(True).alias("there"))
    lost = n.where("up IS NOT NULL").join(known, ["g", "up"], "left").groupBy("g").agg(F.count_if(F.col("there").isNull()).alias("orphans"))
    checkpoint_folder(nodes.sparkSession)
    most = ids.groupBy("g").count().agg(F.max("count")).first()[0] or 1
    # a pointer to an id that isn't there ends, one step further
    p = ids.join(known, ["g", "up"], "left").select("g", "node", F.when(F.col("there"), F.col("up")).alias("up"), F.col("up").isNotNull().cast("long").alias("d")).checkpoint()
    for _ in range(most.bit_length()):
        if p.where("up IS NOT NULL").isEmpty():
            break
        q = p.select("g", F.col("node").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"))
        p = p.join(q, ["g", "up"], "left").select("g", "node", F.col("next").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")).checkpoint()
    tree = p.groupBy("g").agg(F.count("up").alias("cyclic"), F.max(F.when(F.col("up").isNull(), F.col("d"))).alias("depth"))
    twice = ids.groupBy("g").agg(F.sum(F.col("times") - 1).alias("duplicates"))
    same = lambda a, b: a.join(b.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2")), "left").drop("g2")
    out = same(same(same(rows, lost), tree), twice)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("orphans", "cyclic", "depth", "duplicates")}
    out = out.withColumns(zero)
    sound = (F.col("duplicates") == 0) & (F.col("missing") == 0) & (F.col("orphans") == 0) & (F.col("cyclic") == 0)
    return out.select(F.col("g").alias(group), "nodes", "duplicates", "missing", "orphans", "cyclic", "empties", "hierarchical", "depth", sound.alias("valid"))
