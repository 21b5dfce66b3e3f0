"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are 64 bits over word shingles. Two of them differ in `radius` bits or fewer only if, in some
group g of bits, they differ in t(g) or fewer, whenever the t(g) + 1 sum to radius + 1 (t = -1: the group is not used).
Bits that correlate go into one group, so that the groups tell more apart; from the sizes of all keys of each
group follows how many candidates a threshold would bring, and dynamic programming picks the thresholds, and the
number of groups, of least cost. Each fingerprint is indexed under its key of each used group and probes the keys
within that group's threshold; candidates that share a key are verified on all bits.

Work is on distinct fingerprints, so copies cost nothing. A key with more than `FULL` fingerprints is split
further by groups of the bits that the key doesn't fix, until each part is small: fingerprints are distinct, so a part
of many always has bits left to split by. Within a part, verified pairs only join components, so a group of g near
copies gives g - 1 links, never g * g.

Defined results: a null or empty text, or one of white space, has fingerprint zero, which links like any other; rows
with a null doc_id keep their fingerprint and lend their component no id (the component is null if no row of it has
one); repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import checkpointed, components, saved

RADIUS, SHINGLE = 3, 3
#: Fingerprints of one key that are compared in one place; a key with more is split.
FULL = 2048
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints_of(buf: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprint of each text of a buffer."""
    low = X.LOWER[buf]
    start, end, words_at = X.word_spans(low, at, X.NOT_SPACE)
    # the words, each followed by one space
    size = end - start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    joined[X.concat_ranges(to[:-1], size - 1)] = low[X.concat_ranges(start, size - 1)]
    data = joined.tobytes()
    n = np.diff(words_at)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = X.concat_ranges(words_at[:-1], count)
    last = np.minimum(first + shingle, np.repeat(words_at[1:], count))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], 42) for a, b in zip(to[first].tolist(), (to[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
    out = np.zeros((len(n), 64), bool)
    some = np.flatnonzero(count)
    if len(some):
        set_in = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
        out[some] = 2 * set_in > count[some][:, None]
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches):
        fp = fingerprints_of(*X.text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint's bits as a signed long) of every row."""
    return X.only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "text").mapInArrow(_fingerprint, "doc_id long, th long, fp long")


# --- groups of bits and their thresholds


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints of the partition have both bit i and bit j, for i <= j."""
    total, n = np.zeros((64, 64)), 0
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        bits = ((fp[:, None] >> _BITS) & np.uint64(1)).astype(np.float64)
        total += bits.T @ bits
        n += len(fp)
    i, j = np.triu_indices(64)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * 64 + j, -1), pa.int32()), pa.array(np.append(total[i, j], n).astype(np.int64))], ["cell", "n"])


def correlation(nodes: DataFrame) -> np.ndarray:
    """Absolute correlation of each pair of bits over all fingerprints; summed in executors, 2,081 numbers in the end."""
    got = dict(nodes.select("fp").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
    n = got.pop(-1, 0)
    both = np.zeros((64, 64))
    for cell, k in got.items():
        both[cell // 64, cell % 64] = both[cell % 64, cell // 64] = k
    if not n:
        return both
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, bits: list[int], m: int) -> list[list[int]]:
    """Splits `bits` into m groups of like size, correlated bits together: each group starts from the bit with most correlation left and takes the bits closest to it."""
    left, groups = list(bits), []
    for g in range(m):
        size = len(left) // (m - g)
        first = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def _ball(width: int, t: int) -> int:
    total, term = 0, 1
    for k in range(t + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def thresholds(candidates: list[float], widths: list[int], radius: int, row: float = 1) -> tuple[float, list[int]]:
    """Least cost and thresholds of the groups: the sum of t + 1 is radius + 1, each t is -1 or more.

    candidates[g]: fingerprints that share a fingerprint's key of group g, on average. A threshold costs its probes,
    at `row` each, and, for each, that many candidates.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for near, width in zip(candidates, widths, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, t) in best.items():
            for own in range(-1, radius - used + 1):
                more = 0.0 if own < 0 else _ball(width, own) * (row + near)
                if (have := step.get(used + own + 1)) is None or cost + more < have[0]:
                    step[used + own + 1] = (cost + more, [*t, own])
        best = step
    return best[radius + 1]


def _keys(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        key |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return key


def _key(groups: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for g, bits in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array(_keys(fp, bits).view(np.int64))], ["g", "key"])

    return run


def plan(nodes: DataFrame, radius: int = RADIUS, row: float = 1) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Bit correlation, groups of bits, and their thresholds, for the number of groups that costs least."""
    corr = correlation(nodes)
    options = [group_bits(corr, list(range(64)), m) for m in range(2, radius + 3)]
    flat = [g for groups in options for g in groups]
    # pairs that share a key, for every group of every option, over all fingerprints
    count = nodes.select("fp").mapInArrow(_key(flat), "g int, key long").groupBy("g", "key").count()
    pairs = {r[0]: (float(r[1]), r[2]) for r in count.groupBy("g").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)), F.sum("count")).collect()}
    best, at = None, 0
    for groups in options:
        near = [pairs.get(at + g, (0.0, 1))[0] / max(pairs.get(at + g, (0.0, 1))[1], 1) for g in range(len(groups))]
        at += len(groups)
        cost, t = thresholds(near, [len(g) for g in groups], radius, row)
        if best is None or cost < best[0]:
            best = (cost, groups, t)
    return corr, best[1], best[2]


# --- candidates and links


def _signatures(groups: list[list[int]], t: list[int]):
    """Rows (b: hash of group and key, used: mask of the group's bits, fp, own: indexed or only a probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for g, (bits, most) in enumerate(zip(groups, t, strict=True)):
                mask = sum(1 << b for b in bits)
                for k in range(most + 1):
                    for flip in combinations(bits, k):
                        turned = fp ^ np.uint64(sum(1 << b for b in flip))
                        b = X.mix(X.mix(_keys(turned, bits) + np.uint64(1)) + np.uint64(g))
                        n = len(fp)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(b.view(np.int64)), pa.array(np.full(n, mask, np.uint64).view(np.int64)), batch.column("fp"), pa.array(np.full(n, k == 0))], ["b", "used", "fp", "own"]
                        )

    return run


def _split(corr: np.ndarray, radius: int):
    """Each row of a full key goes under radius + 1 finer keys, one for each group of the bits that its key leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[list[int]]] = {}
        for batch in batches:
            fp, used, b = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "used", "b"))
            for mask in np.unique(used).tolist():
                free = [k for k in range(64) if not mask >> k & 1]
                if mask not in known:
                    known[mask] = [g for g in group_bits(corr, free, radius + 1) if g]
                at = np.flatnonzero(used == np.uint64(mask))
                rows = batch.take(pa.array(at))
                for g, bits in enumerate(known[mask]):
                    finer = X.mix(X.mix(b[at] + _keys(fp[at], bits)) + np.uint64(g + 1))
                    both = mask | sum(1 << k for k in bits)
                    yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), pa.array(np.full(len(at), both, np.uint64).view(np.int64)), rows.column("fp"), rows.column("own")], ["b", "used", "fp", "own"])

    return run


def link_runs(b: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """For rows in order of b: the first row of each row's component, where rows of one b link within `radius`, one of the two being indexed."""
    parent = np.arange(len(b))
    i = np.flatnonzero(b[1:] == b[:-1])
    d = 1
    while len(i):
        j = i + d
        a = i[own[i] | own[j]]
        a = a[parent[a] != parent[a + d]]
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= radius]
        while len(a):
            x, y = parent[a], parent[a + d]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            a = a[parent[a] != parent[a + d]]
        d += 1
        i = i[: np.searchsorted(i, len(b) - d)]
        i = i[b[i + d] == b[i]]
    return parent


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's rows come in order of b; the last b of a batch waits for the next batch."""
        kept = None
        for batch in batches:
            cols = [batch.column("b").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)]
            cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            kept = [x[cut:] for x in cols]
            yield from _links([x[:cut] for x in cols], radius)
        if kept is not None:
            yield from _links(kept, radius)

    return run


def _links(cols: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    b, fp, own = cols
    parent = link_runs(b, fp, own, radius)
    at = np.flatnonzero(fp != fp[parent])
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[parent[at]].view(np.int64))], ["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect what lies within `radius` of each other."""
    corr, groups, t = plan(nodes, radius)
    schema = "b long, used long, fp long, own boolean"
    rows = nodes.select("fp").mapInArrow(_signatures(groups, t), schema)
    found = None
    for _ in range(64):  # each round fixes at least one more bit of a full key
        rows = checkpointed(rows)
        sizes = rows.groupBy("b").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("n > 1 and some")
        large = sizes.where(F.col("n") > full).select("b")
        some = not large.isEmpty()
        small = rows.join(sizes.where(F.col("n") <= full).select("b") if some else sizes.select("b"), "b", "left_semi")
        small = small.select("b", "fp", "own").repartition("b").sortWithinPartitions("b", "fp")
        part = small.mapInArrow(_link(radius), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not some:
            break
        rows = rows.join(large, "b", "left_semi").mapInArrow(_split(corr, radius), schema)
    return found


def _named(fps: DataFrame, radius: int, full: int) -> DataFrame:
    """own_fp, class and component_id of each distinct fingerprint of (doc_id, fp)."""
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    got = components(links(nodes, radius, full))
    linked = nodes.join(got, nodes["fp"] == got["id"]).select("id", "component", "least")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(ids, "component").select("id", "component", "component_id")
    named = nodes.join(linked, nodes["fp"] == linked["id"], "left").select(
        F.col("fp").alias("own_fp"), F.coalesce("component", "fp").alias("class"), F.when(F.col("id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    )
    # written and read again, it comes to the next join through an exchange of its own, so that Spark can split a fingerprint of very many copies
    return saved(named)


def classes(docs: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """doc_id, th, fp, class and component_id of every row. Rows whose fingerprints connect over links of `radius` bits or fewer share a class; component_id is its smallest doc_id, or null."""
    fps = checkpointed(fingerprints(docs))
    named = _named(fps, radius, full)
    return fps.join(named, fps["fp"] == named["own_fp"]).select("doc_id", "th", "fp", "class", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    return classes(docs, radius, full).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """One row of each class of near duplicates, with all columns: the one with the smallest doc_id (of repeated ids, with the smallest hash of its text).

    The smallest of each fingerprint, then of each class, is found on ids and hashes alone, map-side first; texts move once.
    """
    last = (1 << 63) - 1
    fps = checkpointed(fingerprints(docs))
    named = _named(fps, radius, full)
    least = fps.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(last)).alias("d"), F.col("th").alias("t"))).alias("k"))
    first = least.join(named, least["fp"] == named["own_fp"]).groupBy("class").agg(F.min("k").alias("k")).select("k.d", "k.t")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("r")).select(F.coalesce(F.col("r.doc_id").cast("long"), F.lit(last)).alias("d"), F.xxhash64(F.coalesce(F.col("r.text").cast("string"), F.lit(""))).alias("t"), "r")
    kept = keyed.join(first, ["d", "t"], "left_semi")
    # rows that repeat an id and a text lie together after the join: no exchange
    one = F.row_number().over(W.partitionBy("d", "t").orderBy("d"))
    return kept.withColumn("n", one).where("n = 1").select("r.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
