"""Benchmark decontamination: Wu-Manber multi-pattern search over word symbols.

Patterns are the windows of consecutive words of benchmark items; an item with fewer words than a window
is one pattern of its own length. Patterns of one length form a machine: a block shift table says how far
a search may jump when the last words under its window are seen, suffix-hash buckets select the
patterns that end in those words, and a comparison of the bytes of every word confirms an occurrence. All texts
of a batch are searched at once, one lane for each stretch of text, each at its own jumps.

Items are the stated query set: they are taken in blocks of at most `BLOCK_BYTES` of text (or one longer item), and each block is
broadcast. A batch of documents is searched for `TOGETHER` blocks one after the other, so that a worker holds no more of them; usual
benchmarks need one such pass. Where there are more blocks, the rows are written with what was found, and the next pass reads them; the blocks of a pass are built when it
begins and let go when it ends, so neither the driver nor a task ever holds more than those of one. Documents are never
shuffled, and need no number to be brought together by.

Defined results: a null or empty text has no words and no hit; items without an id are left out, repeated items
count once; repeated documents give a row each; an empty table of items gives no hits, one of documents no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import saved

#: Text of benchmark items that is searched for, and broadcast, at a time.
BLOCK_BYTES = 2 << 20
#: Blocks that one worker holds.
TOGETHER = 8
#: Words of a shift table's block, bits of its index and window ends that a lane covers.
BLOCK_WORDS, TABLE_BITS, LANE = 3, 18, 512

SPANS = "array<struct<start:bigint,end:bigint>>"
_M = np.uint64(0xD6E8FEB86659FD93)


def _block_hash(h: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """Hash of the `words` word hashes before each end."""
    with np.errstate(over="ignore"):
        out = h[end - 1].copy()
        for k in range(2, words + 1):
            out = out * _M + h[end - k]
        return X.mix(out)


class Machine:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, m: int, h: np.ndarray, starts: np.ndarray):
        self.m, self.block = m, min(BLOCK_WORDS, m)
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, np.int64)
        for end in range(self.block, m + 1):  # the farther right a block may stand, the shorter the jump
            key = self.index(_block_hash(h, starts + end, self.block))
            self.shift[key] = np.minimum(self.shift[key], m - end)
        suffix = _block_hash(h, starts + m, self.block)
        order = np.argsort(suffix, kind="stable")
        self.pattern = order
        self.suffix, first = np.unique(suffix[order], return_index=True)
        self.first = np.append(first, len(order))

    @staticmethod
    def index(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def ends(self, h: np.ndarray, words_at: np.ndarray) -> np.ndarray:
        """Ends of the windows, over all texts, whose last block ends some pattern (or collides with one that does)."""
        count = np.diff(words_at) - self.m + 1  # window ends in each text
        own = np.flatnonzero(count > 0)
        lanes = -(-count[own] // LANE)
        text = np.repeat(own, lanes)
        k = X.concat_ranges(np.zeros(len(own), np.int64), lanes)
        pos = words_at[text] + self.m + k * LANE
        stop = np.minimum(pos + LANE, words_at[text + 1] + 1)
        found = []
        while len(pos):
            jump = self.shift[self.index(_block_hash(h, pos, self.block))]
            hit = jump == 0
            if hit.any():
                found.append(pos[hit])
            pos = pos + np.maximum(jump, 1)
            going = pos < stop
            if not going.all():
                pos, stop = pos[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def candidates(self, h: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window end and a pattern in the bucket of its suffix."""
        key = _block_hash(h, end, self.block)
        k = np.searchsorted(self.suffix, key)
        same = k < len(self.suffix)
        same[same] = self.suffix[k[same]] == key[same]
        end, k = end[same], k[same]
        size = self.first[k + 1] - self.first[k]
        return np.repeat(end, size), self.pattern[X.concat_ranges(self.first[k], size)]


class Patterns:
    """The patterns of a block of items. An occurrence is confirmed on the bytes of each word."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        # the texts, end to end, with only words counted
        text = pa.array([t for _, t in items], pa.large_string())
        raw, at = X.text_buffer(text)
        self.buf = X.LOWER[raw]
        self.start, self.end, words = X.word_spans(self.buf, at, X.ALNUM)
        h = X.span_hashes(self.buf, self.start, self.end)
        by_length: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
        for i, (item, _) in enumerate(items):
            a, b = int(words[i]), int(words[i + 1])
            m = min(window, b - a)
            for s in range(a, b - m + 1) if m else ():
                key = b" ".join(self.buf[self.start[w] : self.end[w]].tobytes() for w in range(s, s + m))
                by_length.setdefault(m, {}).setdefault(key, (s, set()))[1].add(item)
        self.machines = []
        for m, found in sorted(by_length.items()):
            starts = np.array([s for s, _ in found.values()], np.int64)
            own = [sorted(x) for _, x in found.values()]
            size = np.array([len(x) for x in own], np.int64)
            self.machines.append((Machine(m, h, starts), starts, np.concatenate([[0], np.cumsum(size)]), np.array([i for x in own for i in x], np.int64)))
        self.h = h

    def occurrences(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, words_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """For each machine: first words of occurrences, their patterns, the length, and the items of patterns."""
        for machine, first, items_at, items in self.machines:
            w, p = machine.candidates(h, machine.ends(h, words_at))
            w = w - machine.m
            for k in range(machine.m):  # word hashes first, they leave few pairs
                same = h[w + k] == self.h[first[p] + k]
                w, p = w[same], p[same]
            a = (w[:, None] + np.arange(machine.m)).ravel()
            b = (first[p][:, None] + np.arange(machine.m)).ravel()
            n = end[a] - start[a]
            sound = n == self.end[b] - self.start[b]
            n = np.where(sound, n, 0)
            equal = buf[X.concat_ranges(start[a], n)] == self.buf[X.concat_ranges(self.start[b], n)]
            sound &= X.sums((~equal).astype(np.int64), np.concatenate([[0], np.cumsum(n)])) == 0
            good = sound.reshape(-1, machine.m).all(1)
            yield w[good], p[good], machine.m, items_at, items


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _search(blocks: list, last: bool):
    """Rows (doc_id, text, spans, items) with what the blocks add; after the last ones, n_words in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            raw, at = X.text_buffer(batch.column("text"))
            buf = X.LOWER[raw]
            start, end, words_at = X.word_spans(buf, at, X.ALNUM)
            h = X.span_hashes(buf, start, end)
            cover = np.zeros(len(start) + 1, np.int64)
            pairs = [np.zeros((2, 0), np.int64)]
            for r, (spans, items) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                for s in spans or ():
                    cover[words_at[r] + s["start"]] += 1
                    cover[words_at[r] + s["end"]] -= 1
                if items:
                    pairs.append(np.stack([np.full(len(items), r), np.array(items, np.int64)]))
            for block in blocks:
                for w, p, m, items_at, items in block.value.occurrences(buf, start, end, h, words_at):
                    np.add.at(cover, w, 1)
                    np.add.at(cover, w + m, -1)
                    size = items_at[p + 1] - items_at[p]
                    doc = np.repeat(np.searchsorted(words_at, w, "right") - 1, size)
                    pairs.append(np.stack([doc, items[X.concat_ranges(items_at[p], size)]]))
            hit = np.cumsum(cover[:-1]) > 0
            s, e, spans_at = X.word_spans(hit.astype(np.uint8), words_at, np.array([False, True]))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(spans_at))
            spans = pa.StructArray.from_arrays([pa.array(s - words_at[doc]), pa.array(e - words_at[doc])], ["start", "end"])
            both = np.unique(np.concatenate(pairs, 1), axis=1)
            items_of = pa.ListArray.from_arrays(pa.array(np.searchsorted(both[0], np.arange(batch.num_rows + 1)), pa.int32()), pa.array(both[1], pa.int64()))
            n = pa.array(np.diff(words_at), pa.int64()) if last else batch.column("text")
            columns = [batch.column("doc_id"), n, pa.ListArray.from_arrays(pa.array(spans_at, pa.int32()), spans), items_of]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words" if last else "text", "spans", "items"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items in blocks of bounded text, read from Spark a block at a time, and whether a block is the last."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in block.toLocalIterator()], k == n - 1


def _passes(docs: DataFrame, items: DataFrame, window: int) -> Iterator[tuple[list, bool]]:
    """Blocks of patterns, broadcast, TOGETHER to a pass, and whether a pass is the last. The rows of a pass but the last are to be written before the next is asked for."""
    sent: list = []
    for block, last in _blocks(items):
        sent.append(docs.sparkSession.sparkContext.broadcast(Patterns(block, window)))
        if last or len(sent) == TOGETHER:
            yield sent, last
            if not last:
                for b in sent:
                    b.unpersist()
            sent = []


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words, as word numbers, end exclusive) and items (ids, sorted) of each document."""
    out = X.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<bigint>").alias("items"))
    for blocks, last in _passes(docs, items, window):
        out = out.mapInArrow(_search(blocks, last), f"doc_id long, {'n_words long' if last else 'text string'}, spans {SPANS}, items array<bigint>")
        out = out if last else saved(out)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS s FROM (
  SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT m FROM p),
x AS (SELECT r, m, k, array_to_string(w[k : k + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, l WHERE len(w) >= m)),
h AS (SELECT r, x.m, k, item_id FROM x JOIN p ON x.m = p.m AND x.s = p.s),
c AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(k, k + m)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, all columns, without an occurrence of a window of any item. Nothing is shuffled."""
    for blocks, last in _passes(docs, items, window):
        docs = X.rewritten(docs, lambda blocks=blocks: _clean(blocks))
        docs = docs if last else saved(docs)
    return docs


def _clean(blocks: list):
    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = X.text_buffer(batch.column("text"))
        buf = X.LOWER[raw]
        start, end, words_at = X.word_spans(buf, at, X.ALNUM)
        h = X.span_hashes(buf, start, end)
        clean = np.ones(batch.num_rows, bool)
        for block in blocks:
            for w, *_ in block.value.occurrences(buf, start, end, h, words_at):
                clean[np.searchsorted(words_at, w, "right") - 1] = False
        return batch.filter(pa.array(clean))

    return change
