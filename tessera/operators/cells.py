"""Every query against every row of a corpus, as cells of a grid: so many rows of the corpus by so many queries meet in one task.

Both sides are dealt to cells by a hash of their ids, so what a cell holds is bounded whatever the tables' sizes, and nothing is broadcast. In a cell, vectors are matrices, and scores come
from matrix products, a few queries at a time; only what a query keeps of a cell becomes rows. A cosine is 0 for a vector that is null, empty, zero, holds a null or has another length.

Products of matrices differ in their last digits by the place of a row in them. So a score that lies close to the border between two rounded values is summed again,
one coordinate after the other, and results don't depend on the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a corpus in a cell; rows of it where a cell needs ids alone; pairs in a cell whose pairs may all become rows; scores that a task has at a time; pairs that are worth a task.
ROWS, ID_ROWS, PAIRS, SCORES, WORK = 1 << 16, 1 << 20, 1 << 22, 1 << 21, 1 << 21

#: Scores are rounded to so many places.
PLACES = 6


def grid(queries: DataFrame, corpus: DataFrame, key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int, rows: int | None = None, pairs: int | None = None) -> DataFrame:
    """`run` of each cell's queries (query_id, ...) and corpus (key, ...), of some `rows` rows (ROWS by itself) by `block` queries at most, and of some `pairs` pairs."""
    n, q = corpus.count(), queries.count()
    parts = max(1, -(-n // (rows or ROWS)))
    tasks = min(3 * queries.sparkSession.sparkContext.defaultParallelism, -(-n * q // WORK))
    blocks = max(1, -(-q // block), min(q, -(-tasks // parts)), -(-n * q // (parts * pairs)) if pairs else 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    c = corpus.withColumn("block", every(blocks)).withColumn("cell", F.col("block") + F.pmod(F.xxhash64(key), F.lit(parts)) * blocks).drop("block")
    a = queries.withColumn("part", every(parts)).withColumn("cell", F.col("part") * blocks + F.pmod(F.xxhash64("query_id"), F.lit(blocks))).drop("part")

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        return run(asked.drop_columns("cell"), held.drop_columns("cell"))

    return a.repartition(parts * blocks, "cell").groupBy("cell").cogroup(c.repartition(parts * blocks, "cell").groupBy("cell")).applyInArrow(cell, schema)


def matrix(vectors: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of doubles as rows, and which of them have this size and no null; the others are zeros."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = sizes(v)
    values = v.flatten()
    ok = lengths == size
    if values.null_count:
        ok[np.repeat(np.arange(len(v)), np.maximum(lengths, 0))[pc.is_null(values).to_numpy(zero_copy_only=False)]] = False
    x = values.to_numpy(zero_copy_only=False).astype(float)
    if size > 0 and ok.all():
        return x.reshape(len(v), size), ok
    out = np.zeros((len(v), max(size, 0)))
    at = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]])[ok] if len(v) else np.zeros(0, int)
    out[ok] = x[at[:, None] + np.arange(max(size, 0))]
    return out, ok


def sizes(vectors: pa.ChunkedArray) -> np.ndarray:
    """Their lengths, -1 for a null."""
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(int)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    with np.errstate(invalid="ignore"):
        return np.divide(x, length, out=np.zeros_like(x), where=length != 0)


def rounded(score: np.ndarray, again: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Scores rounded half up, away from zero; `again` gives those at some places, summed in order."""
    y = np.abs(score) * 10**PLACES
    whole = np.floor(y)
    close = np.flatnonzero(np.abs(y - whole - 0.5) < 1e-7)
    if len(close):
        score = score.copy()
        score[close] = again(close)
        y[close] = np.abs(score[close]) * 10**PLACES
        whole[close] = np.floor(y[close])
    return np.copysign(whole + (y - whole >= 0.5), score) / 10**PLACES + 0.0


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, each sum taken from the first coordinate to the last."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot, na, nb = dot + a[:, i] * b[:, i], na + a[:, i] ** 2, nb + b[:, i] ** 2
    n = np.sqrt(na * nb)
    return np.divide(dot, n, out=np.zeros(len(a)), where=n != 0)


def scored(q: pa.ChunkedArray, c: pa.ChunkedArray, scaled: Callable[[np.ndarray], np.ndarray] = unit) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]]:
    """Places of some queries, their cosines with all rows, and a function of (places of queries among these, places of rows) that gives cosines summed in order."""
    of = sizes(q)
    step = max(1, SCORES // max(1, len(c)))
    for size in np.unique(of):
        x, fit = matrix(c, int(size))
        held = scaled(x)
        those = np.flatnonzero(of == size)
        for i in range(0, len(those), step):
            at = those[i : i + step]
            y, own = matrix(q.take(pa.array(at)), int(size))
            s = unit(y) @ held.T
            s[~own] = 0  # also where the other vector isn't finite
            if not fit.all():
                s[:, ~fit] = 0
            yield at, s, lambda m, n, y=y, x=x: in_order(y[m], x[n])


def within(q: pa.Table, c: pa.Table, names: tuple[str, str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and of rows that may meet: all, or those with equal values in two columns."""
    if names is None:
        yield np.arange(len(q)), np.arange(len(c))
        return
    a, b = q[names[0]].to_pandas(), c[names[1]].to_pandas()
    rows = b.groupby(b).indices
    for value, at in a.groupby(a).indices.items():
        if value in rows:
            yield at, rows[value]


def taken(q: pa.Table, c: pa.Table, at: np.ndarray, row: np.ndarray, **more: np.ndarray) -> pa.Table:
    """Columns of rows and of queries without vectors, and further ones."""
    columns = {n: c[n].take(pa.array(row)) for n in c.column_names if n not in ("embedding", "codes")}
    columns |= {n: q[n].take(pa.array(at)) for n in q.column_names if n != "qvec"}
    return pa.table(columns | {n: pa.array(x) for n, x in more.items()})


def _joined(parts: list[tuple[np.ndarray, ...]], kinds: tuple[type, ...]) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate(kinds)]


def closest(q: pa.Table, c: pa.Table, k: int, key: str, names: tuple[str, str] | None = None) -> pa.Table:
    """Of each query its k closest rows in this cell, by rounded cosine, then by key."""
    order = np.empty(len(c), int)
    order[pc.sort_indices(c[key], null_placement="at_start").to_numpy()] = np.arange(len(c))
    parts = []
    for asked, rows in within(q, c, names):
        some = c["embedding"] if names is None else c["embedding"].take(pa.array(rows))
        for at, s, exact in scored(q["qvec"].take(pa.array(asked)), some):
            nan = np.isnan(s)
            s[nan] = 2  # above every cosine, as in Spark's order
            least = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k, None] if k < len(rows) else -2
            # all that may round to the k-th score
            m, n = np.nonzero(s >= least - 2 * 10.0**-PLACES)
            score = rounded(s[m, n], lambda i, m=m, n=n, exact=exact: exact(m[i], n[i]))
            best = np.lexsort((order[rows[n]], -score, m))
            m, n, score = m[best], n[best], score[best]
            first = np.arange(len(m)) - np.searchsorted(m, m) < k
            m, n, score = m[first], n[first], score[first]
            parts.append((asked[at[m]], rows[n], np.where(nan[m, n], np.nan, score)))
    at, row, score = _joined(parts, (int, int, float))
    return taken(q, c, at, row, score=score)


def not_ruled_out(q: pa.Table, c: pa.Table, k: int, room: float) -> pa.Table:
    """Rows of whole numbers (codes, scale, length, slack) in this cell that may be among a query's k closest, with `near`: the cosine, known to within the row's slack."""
    scale, length, slack = (c[n].to_numpy() for n in ("scale", "length", "slack"))
    factor = np.divide(scale, length, out=np.zeros(len(c)), where=length > 0)[:, None]
    parts = []
    for at, s, _ in scored(q["qvec"], c["codes"], lambda x: x * factor):
        s[np.isnan(s)] = 2
        least = np.partition(s - slack, len(c) - k, axis=1)[:, len(c) - k, None] if k < len(c) else -np.inf
        m, n = np.nonzero(s + (slack + room) >= least)
        parts.append((at[m], n, s[m, n]))
    at, row, near = _joined(parts, (int, int, float))
    return taken(q, c, at, row, near=near)


def every(q: pa.Table, c: pa.Table) -> pa.Table:
    """All pairs of this cell with their rounded cosines."""
    parts = []
    for at, s, exact in scored(q["qvec"], c["embedding"]):
        score = rounded(s.ravel(), lambda i, n=len(c), exact=exact: exact(i // n, i % n))
        parts.append((np.repeat(at, len(c)), np.tile(np.arange(len(c)), len(at)), score))
    at, row, score = _joined(parts, (int, int, float))
    return taken(q, c, at, row, score=score)


def nearest_ids(q: pa.Table, c: pa.Table, k: int, key: str, names: tuple[str, str]) -> pa.Table:
    """Of each query the k rows whose ids are nearest to its own, of equal distances the smaller id first; ids are whole numbers."""
    parts = []
    own, ids = q["query_id"].to_numpy(), c[key].to_numpy()
    for asked, rows in within(q, c, names):
        rows = rows[np.argsort(ids[rows], kind="stable")]
        # k on either side of the query's own place hold its k nearest
        place = np.searchsorted(ids[rows], own[asked])[:, None] + np.arange(-k, k)
        there = (place >= 0) & (place < len(rows))
        place = np.clip(place, 0, len(rows) - 1)
        far = np.where(there, np.abs(ids[rows][place] - own[asked][:, None]), np.iinfo(np.int64).max)
        first = np.argsort(far, axis=1, kind="stable")[:, :k]
        ok = np.take_along_axis(there, first, 1)
        parts.append((np.repeat(asked, ok.sum(1)), rows[np.take_along_axis(place, first, 1)[ok]]))
    at, row = _joined(parts, (int, int))
    return taken(q, c, at, row)
