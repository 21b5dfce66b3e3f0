"""Near copies of texts by the similarity of their five-word shingles, from SimHash candidates and leaders.

`simhash` connects fingerprints of three bits, which is less than a Jaccard similarity of 0.8 asks for. Here each different text
gets two more fingerprints: of its distinct words, which moves little when a word changes, and of its pairs of words, which
tells texts apart that hold the same words in another order. Candidates lie within `RADIUS` bits in the first, which the generalised
pigeonhole of `simhash` finds, and within `PAIRED` bits in the second, have sets of a like size and are not of one class yet. A candidate
pair is a link if the exact similarity of the sets of shingles is `SIMILARITY` or more.

All pairs of a dense group would be its square, and most say what is known already. So first only the leaders of a key (`LEADERS` of its
texts, by hashes) meet the texts of their key, and what links becomes one class; then all candidates that are left between different
classes are verified. A group of g copies costs some g pairs, and no link between different classes goes untested. Leaders are found by
aggregates and meet their keys in joins, which Spark splits. In the second step keys of one class fall away. Of those with more than `FULL`
texts, one with few texts outside its largest class has that class dealt to parts, with the others in each; any other is split by
the bits that it leaves open, of words and of pairs in turn, until it is small or fixes all 128 bits.

Of the pairs of different texts of similarity 0.8 or more, seven bits over distinct words reach 96 % on sf0.1 (48 pairs) and 97 % on the first
12,000 different texts of check_h (25,481 pairs); three bits of `simhash` reach 10 and 4 %. The seven bits were chosen on these figures.
What `PAIRED` loses besides was not measured at 14 bits (at 10 bits: 2 % and 0.1 %).

Open: a full key with many classes that its open bits don't tell apart is written anew under 8 or 15 finer keys a turn, so its rows grow by
that factor. Small values of `full` show it.

Texts are told apart by a 64-bit hash. Defined results: null texts are empty ones; all empty texts and all texts of white space are one
class, since their fingerprints are zero; a text of fewer than five words is one shingle; an empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm import simhash as S
from tessera.llm._spark import checkpointed, components, saved

SIMILARITY, WORDS = 0.8, 5
#: Bits of the fingerprint of distinct words, and of the fingerprint of pairs of words, in which candidates differ at most.
RADIUS, PAIRED = 7, 14
#: Leaders of a key.
LEADERS = 3
#: Texts of one key that are compared in one place.
FULL = 8192
#: What a row of a key costs, in comparisons.
ROW = 300
_ROWS = "b long, used long, used2 long, fp long, pf long, k long, n long, c long, own boolean"
_CARRIED = ["fp", "pf", "k", "n", "c"]


# --- fingerprints and sets of shingles


def _grams(h: np.ndarray, words_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of `size` words; a text of fewer words is one run."""
    n = np.diff(words_at)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = X.concat_ranges(words_at[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    length = np.minimum(n, size)[owner]
    g = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            live = np.flatnonzero(k < length)
            g[live] = g[live] * X._P + h[first[live] + k]
    return X.mix(g), owner


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, texts in order."""
    with np.errstate(over="ignore"):
        at = np.unique(h + X.mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    at.sort()
    return h[at], owner[at]


def _majority(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Fingerprint of each text: the bits that are set in over half of its hashes; zero for none."""
    count = np.bincount(owner, minlength=texts)
    out = np.zeros((texts, 64), bool)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
        out[some] = 2 * np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32) > count[some][:, None]
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, at = X.text_buffer(batch.column("text"))
    low = X.LOWER[buf]
    start, end, words_at = X.word_spans(low, at, X.NOT_SPACE)
    return X.span_hashes(low, start, end), words_at


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches):
        size = batch.num_rows
        h, words_at = _words(batch)
        fp = S.fingerprints_of(*X.text_buffer(batch.column("text")))
        word = _majority(*_distinct(*_grams(h, words_at, 1)), size)
        pair = _majority(*_grams(h, words_at, 2), size)
        n = np.bincount(_distinct(*_grams(h, words_at, WORDS))[1], minlength=size)
        made = [pa.array(x.view(np.int64)) for x in (fp, word, pair, n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *made], ["doc_id", "th", "fp", "wf", "pf", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches):
        g, owner = _distinct(*_grams(*_words(batch), WORDS))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(g.view(np.int64)))], ["k", "s"])


# --- keys


def _signatures(groups: list[list[int]], t: list[int]):
    """Each text under its key of every group of bits (own), and under the keys within the group's threshold (probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n = batch.column("fp").to_numpy().view(np.uint64), batch.num_rows
            for g, (bits, most) in enumerate(zip(groups, t, strict=True)):
                used = np.full(n, sum(1 << b for b in bits), np.uint64).view(np.int64)
                for k in range(most + 1):
                    for flip in combinations(bits, k):
                        turned = fp ^ np.uint64(sum(1 << b for b in flip))
                        b = X.mix(X.mix(S._keys(turned, bits) + np.uint64(1)) + np.uint64(g))
                        made = [pa.array(b.view(np.int64)), pa.array(used), pa.array(np.zeros(n, np.int64))]
                        yield pa.RecordBatch.from_arrays([*made, *[batch.column(x) for x in _CARRIED], pa.array(np.full(n, k == 0))], ["b", "used", "used2", *_CARRIED, "own"])

    return run


def _split(corr: np.ndarray, radius: int, paired: int, turn: int):
    """Each row of a full key under finer keys: groups of the bits that its key leaves open, of words or of pairs, one group more than bits may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bool, int], list[list[int]]] = {}
        for batch in batches:
            used, used2, b, fp, pf = (batch.column(c).to_numpy().view(np.uint64) for c in ("used", "used2", "b", "fp", "pf"))
            for mask, mask2 in {*zip(used.tolist(), used2.tolist(), strict=True)}:
                at = np.flatnonzero((used == np.uint64(mask)) & (used2 == np.uint64(mask2)))
                whole = (1 << 64) - 1
                second = mask == whole or (turn % 2 == 1 and mask2 != whole)
                own = second, mask2 if second else mask
                if own not in known:
                    free = [k for k in range(64) if not own[1] >> k & 1]
                    known[own] = [g for g in S.group_bits(np.zeros((64, 64)) if second else corr, free, (paired if second else radius) + 1) if g]
                rows = batch.take(pa.array(at))
                for g, bits in enumerate(known[own]):
                    finer = X.mix(X.mix(b[at] + S._keys((pf if second else fp)[at], bits)) + np.uint64(g + 1))
                    more = sum(1 << k for k in bits)
                    masks = [np.full(len(at), m, np.uint64).view(np.int64) for m in ((mask, mask2 | more) if second else (mask | more, mask2))]
                    yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), *map(pa.array, masks), *[rows.column(x) for x in _CARRIED], rows.column("own")], rows.schema.names)

    return run


def _near(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, bounds: tuple[int, int, float]) -> np.ndarray:
    """Of the pairs of rows i, j those that are candidates, as places in i."""
    radius, paired, similarity = bounds
    at = np.flatnonzero((cols["c"][i] != cols["c"][j]) & (cols["own"][i] | cols["own"][j]))
    for x, most in (("fp", radius), ("pf", paired)):
        bits = cols[x].view(np.uint64)  # of signed numbers, numpy counts the bits of the absolute value
        at = at[np.bitwise_count(bits[i[at]] ^ bits[j[at]]) <= most]
    n, m = cols["n"][i[at]], cols["n"][j[at]]
    return at[np.minimum(n, m) / np.maximum(np.maximum(n, m), 1) >= similarity]


def _pairs(bounds: tuple[int, int, float]):
    """Candidates (a, b) of all keys and their classes (ca, cb), from rows in order of b; the last b of a batch waits for the next batch."""

    def found(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        b, k, c = cols["b"], cols["k"], cols["c"]
        i, d = np.flatnonzero(b[1:] == b[:-1]), 1
        while len(i):
            at = i[_near(cols, i, i + d, bounds)]
            if len(at):
                turned = k[at] > k[at + d]
                x, y = np.where(turned, at + d, at), np.where(turned, at, at + d)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k[x], k[y], c[x], c[y])], ["a", "b", "ca", "cb"])
            d += 1
            i = i[: np.searchsorted(i, len(b) - d)]
            i = i[b[i + d] == b[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            cols = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("b", *_CARRIED, "own")}
            cols = cols if kept is None else {x: np.concatenate([kept[x], v]) for x, v in cols.items()}
            cut = int(np.searchsorted(cols["b"], cols["b"][-1])) if len(cols["b"]) else 0
            kept = {x: v[cut:] for x, v in cols.items()}
            yield from found({x: v[:cut] for x, v in cols.items()})
        if kept is not None:
            yield from found(kept)

    return run


def _rows(nodes: DataFrame, plan: tuple) -> DataFrame:
    return saved(nodes.select(*_CARRIED).mapInArrow(_signatures(*plan[1:]), _ROWS))


def led(nodes: DataFrame, plan: tuple, bounds: tuple[int, int, float], leaders: int) -> DataFrame:
    """Candidates (a, b, ca, cb) of which a leads a key that both have: one of its `leaders` indexed texts with the least hashes, by one hash function each."""
    radius, paired, similarity = bounds
    rows = _rows(nodes, plan)
    text = F.struct(*_CARRIED)
    least = [F.min(F.when(F.col("own"), F.struct(F.xxhash64("k", F.lit(x)).alias("h"), text.alias("l")))).alias(f"l{x}") for x in range(leaders)]
    # a key of one class has no candidates
    keys = saved(rows.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high"), *least).where("low <> high and l0 is not null"))
    keys = keys.select("b", F.array_distinct(F.array(*[f"l{x}.l" for x in range(leaders)])).alias("ls"))
    met = rows.select("b", *_CARRIED).join(keys, "b").select(*_CARRIED, F.explode("ls").alias("l"))
    near = met.where(
        (F.col("c") != F.col("l.c"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= radius)
        & (F.bit_count(F.col("pf").bitwiseXOR(F.col("l.pf"))) <= paired)
        & (F.least("n", "l.n") / F.greatest("n", "l.n", F.lit(1)) >= similarity)
    )
    return checkpointed(near.select(F.col("l.k").alias("a"), F.col("k").alias("b"), F.col("l.c").alias("ca"), F.col("c").alias("cb")).distinct())


def between(nodes: DataFrame, plan: tuple, bounds: tuple[int, int, float], full: int) -> DataFrame:
    """All candidates (a, b, ca, cb) of different classes."""
    corr = plan[0]
    rows = nodes.select(*_CARRIED).mapInArrow(_signatures(*plan[1:]), _ROWS)
    out = None
    for turn in range(128):  # each turn fixes at least one more bit of a full key
        rows = saved(rows)
        sizes = rows.groupBy("b").agg(F.count("*").alias("size"), F.max("own").alias("some"), F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.expr("used = -1 and used2 = -1")).alias("fixed"))
        sizes = saved(sizes.where("size > 1 and some and low <> high").withColumn("large", (F.col("size") > full) & ~F.col("fixed")))
        large = sizes.where("large").select("b")
        some = not large.isEmpty()
        now = rows.join(sizes.where("not large").select("b"), "b", "left_semi").select("b", *_CARRIED, "own")
        if some:
            most = rows.join(large, "b", "left_semi").groupBy("b", "c").count().groupBy("b").agg(F.max(F.struct("count", "c")).alias("m"), F.sum("count").alias("size"))
            most = saved(most.select("b", F.col("m.c").alias("mc"), (F.col("size") - F.col("m.count") <= full).alias("few"), F.ceil(F.col("m.count") / full).cast("int").alias("parts")))
            # the largest class is dealt to parts, and each of the few other texts meets all of them
            dealt = rows.join(most.where("few"), "b")
            part = F.when(F.col("c") == F.col("mc"), F.array(F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
            now = now.unionByName(dealt.select(F.explode(part).alias("p"), *_CARRIED, "b", "own").select(F.xxhash64("b", "p").alias("b"), *_CARRIED, "own"))
        part = now.repartition("b").sortWithinPartitions("b", "k").mapInArrow(_pairs(bounds), "a long, b long, ca long, cb long")
        out = part if out is None else out.unionByName(part)
        if not some or most.where("not few").isEmpty():
            break
        rows = rows.join(most.where("not few").select("b"), "b", "left_semi").mapInArrow(_split(corr, bounds[0], bounds[1], turn), _ROWS)
    return checkpointed(out.distinct())


# --- links and classes


def _classed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The texts with the classes that links (ca, cb) make of theirs."""
    got = checkpointed(components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    return nodes.join(got, nodes["c"] == got["id"], "left").select("k", "fp", "pf", "n", F.coalesce("component", "c").alias("c"))


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (ca, cb) of the candidates whose sets of shingles are similar enough; the sets of just their texts are made."""
    asked = checkpointed(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct())
    rows = _one_row(_keyed(docs.select("doc_id", "text")), texts.join(asked, "k", "left_semi").select("d", F.col("k").alias("t")))
    sets = saved(rows.select("t", F.coalesce(F.col("r.text").cast("string"), F.lit("")).alias("text")).mapInArrow(_sets, "k long, s array<bigint>"))
    one, two = sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return checkpointed(both.where(F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")) >= similarity).select("ca", "cb").distinct())


def _keyed(docs: DataFrame) -> DataFrame:
    """d (the id, null last), t (the text's hash) and r (the row)."""
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("r"))
    return rows.select(F.coalesce(F.col("r.doc_id").cast("long"), last).alias("d"), F.xxhash64(F.coalesce(F.col("r.text").cast("string"), F.lit(""))).alias("t"), "r")


def _one_row(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of each wanted (d, t); rows that repeat an id and a text lie together after the join."""
    return keyed.join(wanted, ["d", "t"], "left_semi").withColumn("i", F.row_number().over(W.partitionBy("d", "t").orderBy("d"))).where("i = 1").drop("i")


def links(texts: DataFrame, docs: DataFrame, radius: int = RADIUS, paired: int = PAIRED, similarity: float = SIMILARITY, full: int = FULL, leaders: int = LEADERS) -> DataFrame:
    """Links (ca, cb) between classes of texts (k, d: a document that has it, fp, pf, n, c) that connect all candidates of `similarity` or more."""
    bounds = radius, paired, similarity
    nodes = texts.select(*_CARRIED)
    plan = S.plan(nodes, radius, ROW)
    first = _verified(led(nodes, plan, bounds, leaders), texts, docs, similarity)
    # classes of the second step are named by classes of the first
    rest = between(_classed(nodes, first), plan, bounds, full)
    return first.unionByName(_verified(rest, texts, docs, similarity))


def one_of_each(docs: DataFrame, radius: int = RADIUS, paired: int = PAIRED, similarity: float = SIMILARITY, full: int = FULL, leaders: int = LEADERS) -> DataFrame:
    """One row of each class of near copies, with all columns: the one with the smallest doc_id (of repeated ids, with the smallest hash of its text).

    Classes connect fingerprints of `simhash` within its three bits, and texts by `links`. The smallest of a class is found on ids and hashes
    alone, map-side first; rows with a null doc_id come after all others.
    """
    measured = X.only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "text")
    fps = checkpointed(measured.mapInArrow(_measure, "doc_id long, th long, fp long, wf long, pf long, n long"))
    named = S._named(fps, S.RADIUS, S.FULL).select("own_fp", F.col("class").alias("c"))
    least = F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("d")
    own = checkpointed(fps.groupBy(F.col("th").alias("k")).agg(least, *[F.first(x).alias(x) for x in ("fp", "wf", "pf", "n")]))
    texts = checkpointed(own.join(named, own["fp"] == named["own_fp"]).select("k", "d", F.col("wf").alias("fp"), "pf", "n", "c"))
    joined = components(links(texts, docs, radius, paired, similarity, full, leaders).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    first = texts.groupBy("c").agg(F.min(F.struct("d", F.col("k").alias("t"))).alias("o"))
    first = first.join(joined, first["c"] == joined["id"], "left").groupBy(F.coalesce("component", "c").alias("c")).agg(F.min("o").alias("o")).select("o.d", "o.t")
    return _one_row(_keyed(docs), first).select("r.*")
