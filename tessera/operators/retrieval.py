"""Exact hybrid retrieval: dense and sparse scores, fusion, hierarchy, rerank decisions, dedup, context packing.

Every ranked result takes an explicit tie-break, so runs agree. Metadata filters are applied to the corpus before scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.sources.folders import checkpoint_folder

#: Queries that meet rows of a corpus at a time.
QUERY_BLOCK = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for an empty or zero vector and for unequal lengths."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (na * nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def ranked(scored: DataFrame, k: int, by: str | list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark keeps k a group in each task before the exchange."""
    w = W.partitionBy(by).orderBy(*order)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


#: Terms of queries, counted for each query, that are broadcast at most.
QUERY_TERMS = 1 << 18


def against(queries: DataFrame, corpus: DataFrame, score: Callable[[DataFrame], DataFrame], query_id: str = "query_id") -> DataFrame:
    """Every query against every row: queries are a stated set, broadcast in blocks of QUERY_BLOCK rows at most."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        parts.append(score(corpus.crossJoin(F.broadcast(own))))
    return reduce(DataFrame.unionByName, parts)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str = "node_id", within: tuple[str, str] | None = None, by: str | list[str] = "query_id") -> DataFrame:
    """From queries (query_id, qvec, ...) and corpus (key, embedding, ...): the k closest of each query by cosine, rounded to six places; with `within`, among rows whose second column equals the query's first."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return cells.closest(q, c, k, key, within)

    return ranked(cells.grid(queries, corpus, key, run, _columns(queries, corpus, "score double"), QUERY_BLOCK), k, by, F.desc("score"), F.col(key))


def cosines(queries: DataFrame, corpus: DataFrame, key: str = "node_id") -> DataFrame:
    """All pairs of queries (query_id, qvec, ...) and corpus (key, embedding, ...) with their cosine, rounded to six places."""
    return cells.grid(queries, corpus, key, cells.every, _columns(queries, corpus, "score double"), QUERY_BLOCK, pairs=cells.PAIRS)


def nearest_ids(queries: DataFrame, corpus: DataFrame, k: int, within: tuple[str, str], key: str = "node_id") -> DataFrame:
    """From queries (query_id, ...) and corpus (key, ...): of the rows whose second column of `within` equals the query's first, the k of nearest ids, ranked; score: 1 / (1 + distance)."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return cells.nearest_ids(q, c, k, key, within)

    near = cells.grid(queries, corpus.where(F.col(key).isNotNull()), key, run, _columns(queries, corpus), QUERY_BLOCK, rows=cells.ID_ROWS)
    # rows without an id have no distance and come last
    last = ranked(corpus.where(F.col(key).isNull()), k, within[1], F.col(key)).drop("rank")
    near = near.unionByName(last.join(queries, F.col(within[0]) == F.col(within[1])))
    return ranked(near.withColumn("score", 1.0 / (1 + F.abs(F.col(key) - F.col("query_id")))), k, "query_id", F.desc("score"), F.col(key))


def _columns(queries: DataFrame, corpus: DataFrame, *more: str) -> str:
    kept = [f"`{n}` {kind}" for n, kind in [*corpus.dtypes, *queries.dtypes] if n not in ("embedding", "qvec")]
    return ", ".join([*kept, *more])


def term_counts(docs: DataFrame, terms: Column, key: str) -> DataFrame:
    """Postings (key, term, tf)."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, terms: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, dl) with n and avgdl on every row, and (term, df)."""
    sizes = docs.select(key, F.size(terms).cast("long").alias("dl"))
    total = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = term_counts(docs, terms, key).groupBy("term").agg(F.count("*").alias("df"))
    return sizes.crossJoin(F.broadcast(total)), df


def bm25(queries: DataFrame, docs: DataFrame, terms: Column, key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) of documents that share a term with a query (query_id, term: one row an occurrence).

    Documents are read and cut into terms once: of each, occurrences of query terms and one row with its length leave its task, to where
    all of its key meet; a task then sums whole scores, so one row a query and document goes on. Queries are a stated set; their terms are
    broadcast as long as there are QUERY_TERMS at most, and joined otherwise.
    A null or empty text has length 0 and counts among the documents; rows of one key and length count as one document's in tf and df.
    """
    q = queries.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    few = q.count() <= QUERY_TERMS
    asked = q.select("term").distinct().withColumn("asked", F.lit(True))
    each = docs.select(key, F.coalesce(terms, F.array().cast("array<string>")).alias("t")).select(key, F.size("t").cast("long").alias("dl"), F.posexplode(F.concat("t", F.array(F.lit(None).cast("string")))).alias("at", "term"))
    met = each.join(F.broadcast(asked) if few else asked, "term", "left").where("asked or at = dl")
    checkpoint_folder(docs.sparkSession)
    # the row of the length is the last, without a term
    postings = met.repartition(key).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"), F.count_if(F.col("at") == F.col("dl")).alias("ends")).checkpoint()
    total = postings.agg(F.sum("ends").alias("n"), (F.sum(F.col("ends") * F.col("dl")) / F.sum("ends")).alias("avgdl"))
    df = postings.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    weighed = q.join(df, "term")
    hits = postings.where("term IS NOT NULL").join(F.broadcast(weighed) if few else weighed, "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = F.col("qtf") * idf * (k1 + 1) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", key).agg(F.sum(s).alias("score"))


def fuse_reciprocal(dense: DataFrame, sparse: DataFrame, key: str, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, key, rank)."""
    d = dense.select("query_id", key, F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", key, F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", key], "full")
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    return both.withColumn("score", part("dense_rank") + part("sparse_rank"))


def fuse_weighted(dense: DataFrame, sparse: DataFrame, key: str, weight: float = 0.5) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each query and list."""

    def scaled(x: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return x.select("query_id", key, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), ["query_id", key], "full")
    return both.select("query_id", key, (weight * F.coalesce("d", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0))).alias("score"))


def dedup_limit(hits: DataFrame, k: int, key: str) -> DataFrame:
    """Best score of each key first, then the k best of each query."""
    best = hits.groupBy("query_id", key).agg(F.max("score").alias("score"))
    return ranked(best, k, "query_id", F.desc("score"), F.col(key))


def auto_merge(hits: DataFrame, children: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Hits (query_id, node_id, score) with all hits of a parent replaced by it (mean score) where they are more than `ratio` of its children (node_id, parent_id)."""
    sizes = children.groupBy("parent_id").agg(F.count("*").alias("size"))
    h = hits.join(children, "node_id", "left").join(sizes, "parent_id", "left")
    w = W.partitionBy("query_id", "parent_id")
    h = h.withColumn("full", F.coalesce((F.count("node_id").over(w) / F.col("size")) > ratio, F.lit(False)))
    parents = h.where("full").groupBy("query_id", "parent_id").agg(F.avg("score").alias("score"))
    leaves = h.where("not full").select("query_id", F.lit("leaf").alias("kind"), F.col("node_id").alias("id"), "score")
    return leaves.unionByName(parents.select("query_id", F.lit("parent").alias("kind"), F.col("parent_id").alias("id"), "score"))


def rerank_decision(text: Column, n: Column, top: Column, second: Column, chars: int = 96, words: int = 12, ratio: float = 1.35) -> Column:
    """Why a rerank is skipped, or null if it is to run."""
    size = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    r = F.when(second > 0, top / second).otherwise(999.0)
    return F.when(n <= 1, "single").when((F.length(text) <= chars) & (size <= words) & (r >= ratio), "dominant")


def confidence(hits: DataFrame, document: str = "document_id") -> DataFrame:
    """Of each query's ranked hits: n, top and second score, their ratio (999 without a second, 0 without a top), documents."""
    g = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.countDistinct(document).alias("documents")
    )
    ratio = F.when(F.coalesce("top", F.lit(0.0)) == 0, 0.0).when(F.coalesce("second", F.lit(0.0)) > 0, F.col("top") / F.col("second")).otherwise(999.0)
    return g.withColumn("ratio", ratio)


def pack_context(hits: DataFrame, text: str, budget: int = 30_000) -> DataFrame:
    """Ranked hits while their texts fit the budget; the first that doesn't ends the query's list."""
    upto = F.sum(F.length(text)).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("upto", upto).where(F.col("upto") <= budget)


def long_context_order(rank: Column, n: Column) -> Column:
    """Position that puts the best at both ends: odd ranks from the front, even ranks from the back."""
    return F.when(rank % 2 == 1, F.floor((rank + 1) / 2)).otherwise(n + 1 - F.floor(rank / 2)).cast("long")


def rescored(hits: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Hits with `score` from a plug-in, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = scorer(batch).astype("float64")
            yield batch

    return hits.mapInPandas(run, hits.schema)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 20) -> DataFrame:
    """(id, text) with embedding, `size` texts to a call, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t = batch["text"].tolist()
            batch["embedding"] = [v for i in range(0, len(t), size) for v in embed(t[i : i + size])]
            yield batch

    return texts.select("id", "text").mapInPandas(run, "id long, text string, embedding array<float>")


def memoised(texts: DataFrame, memo: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, text) with embedding: stored vectors by the text's hash, others embedded once a text."""
    keyed = texts.withColumn("h", F.md5("text"))
    known = keyed.join(memo, "h").select("id", "embedding")
    new = keyed.join(memo, "h", "left_anti")
    made = embedded(new.groupBy("h").agg(F.min("id").alias("id"), F.first("text").alias("text")).select("id", "text"), embed).select(F.md5("text").alias("h"), "embedding")
    return known.unionByName(new.join(made, "h").select("id", "embedding"))


def allowed_documents(tenants: DataFrame, access: DataFrame, documents: DataFrame) -> DataFrame:
    """(tenant_id, document_id) that each tenant may read: by `access` (tenant_id, document_id); where it has nothing for a tenant, the tenant's own `documents` (document_id, tenant_id); for a null tenant, all."""
    given = tenants.join(access, "tenant_id").select("tenant_id", "document_id")
    own = tenants.join(access, "tenant_id", "left_anti").join(documents, "tenant_id").select("tenant_id", "document_id")
    every = documents.select(F.lit(None).cast("long").alias("tenant_id"), "document_id").join(tenants.where("tenant_id IS NULL").limit(1).select(), how="left_semi")
    return given.unionByName(own).unionByName(every).distinct()


def expanded(sections: DataFrame, children: int = 5, siblings: int = 4, short: int = 200) -> DataFrame:
    """(document_id, section_id, text): a section's text with those of its first children; where that is still short, with its first siblings' too. Each has its title above it."""
    s = sections.select("document_id", "section_id", "parent_section_id", "order_index", "title", F.coalesce("content", F.lit("")).alias("content"))
    under = s.where("parent_section_id IS NOT NULL").withColumnRenamed("section_id", "own").withColumn("n", F.row_number().over(W.partitionBy("document_id", "parent_section_id").orderBy("order_index")))
    # a family's first rows are all that is needed: one more than `siblings`, since a section isn't its own sibling
    family = under.where(F.col("n") <= max(children, siblings + 1)).groupBy("document_id", F.col("parent_section_id").alias("p")).agg(F.array_sort(F.collect_list(F.struct("order_index", "own", "title", "content"))).alias("m"))
    joined = lambda m: F.array_join(F.transform(m, lambda x: F.concat(F.lit("\n"), x["title"], F.lit("\n"), x["content"])), "")
    family = family.select(F.col("document_id").alias("d"), "p", "m")
    a = s.join(family, (F.col("document_id") == F.col("d")) & (F.col("section_id") == F.col("p")), "left").select("document_id", "section_id", "parent_section_id", F.concat("content", F.coalesce(joined(F.slice("m", 1, children)), F.lit(""))).alias("text"))
    others = F.slice(F.filter("m", lambda x: x["own"] != F.col("section_id")), 1, siblings)
    b = a.join(family, (F.col("document_id") == F.col("d")) & (F.col("parent_section_id") == F.col("p")), "left")
    more = F.when(F.length(F.btrim("text", F.lit(" \n"))) < short, joined(others))
    return b.select("document_id", "section_id", F.concat("text", F.coalesce(more, F.lit(""))).alias("text"))
