"""Retrieval of many requests as one plan: routes by query, merging, windows, conditional rerank, order, and the hits of a request.

A request has one or more queries. Each query searches what its tenant may read; one that names a section, or is short, takes the section
route as well. Branches are parts of one union, never a loop over queries. The queries are a stated set, broadcast in blocks, and their lists of hits (bounded for each query) are
checkpointed where branches part; what a document's readers are travels with its rows as an array of the tenants that ask, so nothing is joined on a tenant or a section.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.sources.folders import checkpoint_folder

Embed = Callable[[list[str]], list[list[float]]]


def skip_reason(text: Column, n: Column, top: Column, second: Column, chars: int = 48, words: int = 8, ratio: float = 1.35) -> Column:
    """Why hits of a query are not reranked: `single`, `no-second`, `dominant`; null where they are, as those of a long query or without a positive top score always are."""
    asked = F.coalesce(F.btrim(text), F.lit(""))
    short = (F.length(asked) <= chars) & (F.size(T.terms(asked)) <= words)
    by_score = F.when(n == 1, "single").when(top <= 0, None).when(F.coalesce(second, F.lit(0.0)) <= 0, "no-second").when(top / second >= ratio, "dominant")
    return F.when((n > 0) & short, by_score)


def _cosines(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(q)
    return np.divide(vectors @ q, norms, out=np.zeros(len(vectors)), where=norms > 0)


def reranked(hits: DataFrame, embed: Embed, k: int) -> DataFrame:
    """Hits (query_id, question, place, text, score, ...) with scores by an embedder, the k best of each query, in new places.

    The embedder sees a query's question and the texts of all its hits in one call (blank ones as one space), so it sees a bounded group. Where it returns
    another number of vectors, or an empty one for the question, that query's first k stay as they are; where it fails, all of that query's hits do.
    """
    schema = hits.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        texts = [t if t.strip() else " " for t in rows["text"].fillna("")]
        try:
            q, *vectors = embed([rows["question"].iloc[0] or "", *texts])
        except Exception:  # a plug-in's failure is that query's alone
            return rows
        if len(vectors) != len(rows) or not len(q) or any(len(x) != len(q) for x in vectors):
            return rows.head(k)
        rows = rows.assign(score=np.round(_cosines(np.asarray(q, float), np.asarray(vectors, float)), 6))
        rows = rows.sort_values("score", ascending=False, kind="stable").head(k)
        return rows.assign(place=range(1, len(rows) + 1))

    return hits.groupBy("query_id").applyInPandas(run, schema)


def _once(df: DataFrame) -> DataFrame:
    """The same rows, computed once: for what several branches take."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def readers(allowed: DataFrame, questions: DataFrame) -> DataFrame:
    """(document_id, readers): the tenants that ask and may read a document. A document has a tenant once."""
    asking = questions.select("tenant_id").distinct()
    return allowed.join(asking, "tenant_id", "left_semi").groupBy("document_id").agg(F.collect_set("tenant_id").alias("readers"))


def _closest(questions: DataFrame, corpus: DataFrame, k: int, by: list[str], keep: list[str], *ties: str, within: Column | None = None) -> DataFrame:
    """Of the readable rows of a corpus (readers, embedding, ...) the k closest of each group of `by`, with score and rank."""
    corpus = corpus.withColumn("cnorm", R.norm(F.col("embedding")))

    def score(pairs: DataFrame) -> DataFrame:
        may = F.array_contains("readers", F.col("tenant_id"))
        pairs = pairs.where(may if within is None else may & within)
        s = F.round(R.cosine(F.col("embedding"), F.col("qvec"), F.col("cnorm"), F.col("qnorm")), 6)
        return R.ranked(pairs.withColumn("score", s).select("query_id", *keep, "score"), k, by, F.desc("score"), *map(F.col, ties))

    return R.against(questions.withColumn("qnorm", R.norm(F.col("qvec"))), corpus, score)


def section_route(questions: DataFrame, chunks: DataFrame, section_index: DataFrame, sections_k: int, k: int) -> DataFrame:
    """For queries that take it: the closest sections, and the k closest chunks of each. place: by section, then by chunk."""
    routed = questions.where(T.takes_section_route(F.col("text")))
    near = _once(_closest(routed, section_index, sections_k, ["query_id"], ["document_id", "section_id"], "document_id", "section_id"))
    first = near.groupBy("query_id", "section_id").agg(F.min("rank").alias("at"))
    routes = first.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("section_id", "at"))).alias("routes"))
    asked = routed.join(routes, "query_id")
    keep = ["node_id", "document_id", "section_id", "at"]
    at = F.element_at(F.col("routes"), F.col("section_id"))
    inside = F.map_contains_key("routes", F.col("section_id"))
    found = _closest(asked, chunks, k, ["query_id", "section_id"], [*keep[:3], at.alias("at")], "node_id", within=inside)
    return found.select("query_id", *keep[:3], "score", (F.col("at") * (k + 1) + F.col("rank")).cast("long").alias("place"))


def semantic_route(questions: DataFrame, chunks: DataFrame, sections: DataFrame, k: int, ratio: float) -> DataFrame:
    """The k closest chunks, and each section of which more than `ratio` of the chunks are among them, with their mean score; by score, sections first. Chunks of such a section stay. node_id is null for a section."""
    keep = ["node_id", "document_id", "section_id"]
    hits = _once(_closest(questions, chunks, k, ["query_id"], keep, "node_id").drop("rank"))
    # only sections that were hit are counted, and only those that have a text of their own can stand for their chunks
    of_hit = hits.groupBy("query_id", "document_id", "section_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("score"))
    touched = of_hit.select("document_id", "section_id").distinct()
    sizes = chunks.join(touched, ["document_id", "section_id"], "left_semi").groupBy("document_id", "section_id").agg(F.count("*").alias("size"))
    sizes = sizes.join(sections.select("document_id", "section_id"), ["document_id", "section_id"], "left_semi")
    merged = of_hit.join(sizes, ["document_id", "section_id"]).where(F.col("n") / F.col("size") > ratio)
    both = hits.select("query_id", *keep, "score").unionByName(merged.select("query_id", F.lit(None).cast("long").alias("node_id"), "document_id", "section_id", "score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("node_id").asc_nulls_first(), "document_id", "section_id")
    return both.withColumn("place", F.row_number().over(order).cast("long"))


def hydrated(hits: DataFrame, chunk_texts: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds text: a chunk's window where it has one, its own text otherwise; a section's content."""
    own = chunk_texts.select("node_id", F.coalesce("window", "text").alias("own"))
    whole = sections.select(F.col("document_id").alias("d"), F.col("section_id").alias("s"), F.col("content").alias("whole"))
    h = hits.join(own, "node_id", "left").join(whole, F.col("node_id").isNull() & (F.col("document_id") == F.col("d")) & (F.col("section_id") == F.col("s")), "left")
    return h.withColumn("text", F.coalesce("own", "whole", F.lit(""))).drop("own", "whole", "d", "s")


def orchestrated(
    questions: DataFrame,
    chunks: DataFrame,
    chunk_texts: DataFrame,
    section_index: DataFrame,
    sections: DataFrame,
    allowed: DataFrame,
    embed: Embed,
    limit: int = 20,
    sections_k: int = 8,
    section_chunks: int = 8,
    chunks_k: int = 20,
    ratio: float = 0.5,
    rerank_k: int = 10,
) -> DataFrame:
    """request_id, rank, node_id (null: a whole section), document_id, section_id, query_id, score, reranked, summary: the best hits of each request.

    questions (request_id, query_id, tenant_id, text, qvec), chunks (node_id, document_id, section_id, embedding), chunk_texts (node_id, text, window), section_index
    (document_id, section_id, embedding), sections (document_id, section_id, content), allowed (tenant_id, document_id). A tenant that may read nothing finds
    nothing. A node that several queries of a request find counts with its best score. Ties go to the smaller query_id, then to the place in its list, in which
    the best stand at both ends.
    """
    questions = _once(questions)
    who = readers(allowed, questions)
    c, index = chunks.join(who, "document_id"), section_index.join(who, "document_id")
    by_section = section_route(questions, c, index, sections_k, section_chunks).withColumn("branch", F.lit(0))
    by_meaning = semantic_route(questions, c, sections, chunks_k, ratio).withColumn("branch", F.lit(1))
    node = ["query_id", "node_id", "document_id", "section_id"]
    # a query's list: the section route first, each node where it comes first
    first = F.min(F.struct("branch", "place", "score")).alias("first")
    hits = by_section.unionByName(by_meaning).groupBy(*node).agg(first).select(*node, F.col("first.score").alias("score"), "first.branch", "first.place")
    hits = hits.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("branch", "place")).cast("long")).drop("branch")
    hits = hydrated(hits, chunk_texts, sections).join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    own = W.partitionBy("query_id")
    score_at = lambda k: F.max(F.when(F.col("place") == k, F.col("score"))).over(own)
    reason = skip_reason(F.col("question"), F.count("*").over(own), score_at(1), score_at(2))
    hits = _once(hits.withColumn("skip", reason))
    went = reranked(hits.where("skip IS NULL"), embed, rerank_k).withColumn("reranked", F.lit(True))
    hits = hits.where("skip IS NOT NULL").withColumn("reranked", F.lit(False)).unionByName(went)
    # from the worst up, turn by turn to the front and to the back
    up = F.row_number().over(own.orderBy("score", "place")) - 1
    n = F.count("*").over(own)
    half = F.floor((n + 1) / 2)
    hits = hits.withColumn("place", F.when(up % 2 == 0, half - 1 - up / 2).otherwise(half + (up - 1) / 2).cast("long"))
    hits = hits.join(questions.select("query_id", "request_id"), "query_id")
    best = F.min(F.struct((-F.col("score")).alias("least"), "query_id", "place", "reranked", "text")).alias("best")
    one = hits.groupBy("request_id", "node_id", "document_id", "section_id").agg(best)
    top = R.ranked(one, limit, "request_id", F.col("best.least"), F.col("best.query_id"), F.col("best.place"))
    return top.select("request_id", F.col("rank").cast("long").alias("rank"), "node_id", "document_id", "section_id", "best.query_id", (-F.col("best.least")).alias("score"), "best.reranked", F.substring("best.text", 1, 400).alias("summary"))
