"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Only lengths matter to a packing, so it is planned on the histogram of lengths: at most `SEQUENCE` numbers,
however many documents there are. Bins of one content are one class with a multiplicity. Best fit (longest first)
builds classes; local search then moves documents, and exchanges one for one or two for one, from the
emptiest bins to fuller ones, each step raising the sum of squared fills, until the lower bound is met or no exchange is left
(it ends, since that sum can't rise for ever), or CLASSES classes are open: the plan is broadcast, so its size is bounded; the packing
found until then is whole and valid. The plan says which
ranks of each length go to which sequences and offsets. Pieces find their ranks from counts by partition and length,
so nothing but small rows is shuffled, no key holds more than one partition's rows, and no task sees all pieces.

Tokens are those of the byte-level BPE vocabulary `byte_bpe_50k.json`. The same vocabulary's file in rank form encodes the same ids
several times as fast, so that is used (a test holds the ids against the JSON's). A string of a special token in a text is that
token, as the JSON's tokenizer has it. Each document ends in id 0, which a null or empty text consists of.

Defined results: repeated documents are packed as often as they come; rows with a null doc_id too; an empty
table gives no rows; other columns are left out. A document of more than `SEQUENCE` ids is cut into pieces of that
length, the first of which takes the remainder.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import checkpointed

SEQUENCE = 2048
#: White space as the vocabulary's pattern has it, and how long a run has to be to be cut out before the pattern sees it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
#: Classes of bins from which the search stops opening more: the bound of the plan, which is broadcast.
CLASSES = 1 << 17


@cache
def encoder(path: str | None = None, json_path: str | None = None) -> Callable[[str], list[int]]:
    """The vocabulary's encoder; path: its file in rank form, json_path: that with its special tokens.

    The pattern that splits texts looks ahead after white space, for which its engine needs a stack as deep as the run is long. So long runs
    are cut out by the pattern's own rule: at the end of a text a run is one unit, before other characters all but its last character is.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    names = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    white = re.compile(f"[{WHITE}]+")

    def plain(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return encoding.encode_ordinary(text)
        ids, done = [], 0
        for run in white.finditer(text):
            if run.end() - run.start() >= LONG_RUN:
                end = run.end() if run.end() == len(text) else run.end() - 1
                ids += encoding.encode_ordinary(text[done : run.start()])
                ids += encoding._encode_single_piece(text[run.start() : end])
                done = end
        return ids + encoding.encode_ordinary(text[done:])

    def encode(text: str) -> list[int]:
        if names is None or not any(t in text for t in special):
            return plain(text)
        return [i for part in names.split(text) for i in ([special[part]] if part in special else plain(part))]

    return encode


def cuts(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids."""
    first = n % most or min(n, most)
    edges = [0, *range(first, n + 1, most)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _tokenise(path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        seen = np.zeros(SEQUENCE + 1, np.int64)  # pieces of each length so far in this partition
        for batch in X.slices(batches):
            docs, piece, start, crc, ids, length = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = np.array([*encode(text), 0], "<u4")
                for k, (s, e) in enumerate(cuts(len(tokens))):
                    docs.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(tokens[s:e].tobytes()))
                    if with_ids:
                        ids.append(tokens[s:e].astype(np.int32))
            n = np.array(length, np.int64)
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            local = np.empty(len(n), np.int64)
            local[order] = np.arange(len(n)) - first + seen[n[order]]
            seen += np.bincount(n, minlength=SEQUENCE + 1)
            cols = [pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), TaskContext.get().partitionId())), pa.array(local)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with their place among the pieces of their length in their partition."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long" + ", ids array<int>" * with_ids
    return X.only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_tokenise(path, with_ids), schema)


# --- the plan: classes of bins, each a Counter of lengths with a multiplicity


def best_fit(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, Counter]]:
    """Best-fit decreasing: (bins, lengths in each)."""
    room: dict[int, list] = {}
    rooms: list[int] = []
    done = []

    def put(bins: int, content: Counter, left: int) -> None:
        if not left:
            done.append((bins, content))
            return
        if left not in room:
            insort(rooms, left)
            room[left] = []
        room[left].append((bins, content))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                bins, content, left = -(-count // (size // length)), Counter(), size
            else:
                left = rooms[k]
                bins, content = room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
            each = left // length
            if full := min(bins, count // each):
                put(full, content + Counter({length: each}), left - each * length)
                bins, count = bins - full, count - full * each
            if bins and count:
                put(1, content + Counter({length: count}), left - count * length)
                bins, count = bins - 1, 0
            if bins and content:
                put(bins, content, left)
    return done + [x for r in rooms for x in room[r]]


def _exchange(donor: Counter, taker: Counter, room: int) -> tuple[int, tuple, tuple] | None:
    """The exchange that fills the taker most: (rise of its fill, lengths it gets, lengths it gives)."""
    best = None
    gets = [((a,), a) for a in donor] + [((a, b), a + b) for a in donor for b in donor if a < b or (a == b and donor[a] > 1)]
    gives = [((), 0)] + [((b,), b) for b in taker]
    sizes = sorted((n, g) for g, n in gives)
    values = [n for n, _ in sizes]
    for got, n in gets:
        # the smallest length to give back that makes got fit; two for none is two moves, so left out
        k = bisect_left(values, n - room)
        if k < len(sizes) and len(got) == 2 and not sizes[k][1]:
            k += 1
        if k < len(sizes) and (rise := n - sizes[k][0]) > 0 and (best is None or rise > best[0]):
            best = (rise, got, sizes[k][1])
            if rise == room:
                break
    return best


class _Class:
    """Bins of one content, with what a search needs of it: its fill, the sums of one or two of its lengths as bits, and lengths."""

    def __init__(self, content: Counter):
        self.bins, self.content, self.live = 0, content, False
        self.items = tuple(sorted(content.items()))
        self.fill = sum(k * v for k, v in self.items)
        self.place = (self.fill, self.items)
        self.sums = 0
        for i, (a, n) in enumerate(self.items):
            self.sums |= 1 << a | (n > 1) << (2 * a)
            for b, _ in self.items[:i]:
                self.sums |= 1 << (a + b)

    def gives_to(self, taker: _Class, size: int) -> bool:
        """Whether some exchange from here fills a bin of the taker more."""
        if taker.fill < self.fill or (taker is self and self.bins < 2):
            return False
        fits = (1 << (size - taker.fill)) - 1
        return any(self.sums >> (b + 1) & fits for b in (0, *taker.content))


def local_search(classes: list[tuple[int, Counter]], size: int = SEQUENCE, most: int = CLASSES) -> list[tuple[int, Counter]]:
    """Fewer bins, if exchanges from the emptiest bins to fuller ones can empty some; goes on until none is left, the bins are as few as can be, or `most` classes are open."""
    total = sum(m * sum(k * v for k, v in c.items()) for m, c in classes)
    fewest = -(-total // size)
    n_bins = sum(m for m, _ in classes)
    full: list[tuple[int, Counter]] = []
    open_: dict[tuple, _Class] = {}
    order: list[tuple] = []  # places of open classes, emptiest first
    live: list[tuple] = []  # those that may have an exchange

    def wake(x: _Class) -> None:
        if not x.live:
            x.live = True
            insort(live, x.place)

    def add(bins: int, content: Counter) -> None:
        if not bins or not content:
            return
        new = _Class(content)
        if new.fill == size:
            full.append((bins, content))
            return
        x = open_.get(new.items)
        if x is None:
            x = open_[new.items] = new
            insort(order, x.place)
        x.bins += bins
        wake(x)
        for _, items in order[: bisect_right(order, x.place)]:  # those that had no exchange may have one with it
            if not (donor := open_[items]).live and donor.gives_to(x, size):
                wake(donor)

    def drop(x: _Class, bins: int) -> None:
        x.bins -= bins
        if not x.bins:
            del open_[x.items], order[bisect_left(order, x.place)]
            if x.live:
                del live[bisect_left(live, x.place)]

    for bins, content in classes:
        add(bins, content)
    while n_bins > fewest and live and len(open_) < most:
        donor = open_[live[0][1]]
        taker = next((x for _, items in reversed(order) if donor.gives_to(x := open_[items], size)), None)
        if taker is None:
            donor.live = False
            del live[0]
            continue
        _, got, given = _exchange(donor.content, taker.content, size - taker.fill)
        bins = donor.bins // 2 if taker is donor else min(donor.bins, taker.bins)
        less = donor.content - Counter(got) + Counter(given)
        more = taker.content - Counter(given) + Counter(got)
        drop(taker, bins)
        drop(donor, bins)
        if not less:
            n_bins -= bins
        add(bins, more)
        add(bins, less)
    return full + [(x.bins, x.content) for x in open_.values()]


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, bins, pieces of the length in each bin, first sequence, offset), by length and rank.

    A row for each length of each class. Classes are bounded: best fit opens two for a length and splits one, and local
    search stops at CLASSES open ones.
    """
    taken: Counter = Counter()
    rows, sequence = [], 0
    for bins, content in sorted(local_search(best_fit(histogram, size), size), key=lambda x: (-x[0], sorted(x[1].items()))):
        offset = 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, taken[length], bins, each, sequence, offset))
            taken[length] += bins * each
            offset += length * each
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _place(rows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, each, sequence, offset = rows.value.T
        known, begins = np.unique(length, return_index=True)
        by = {k: (a, b) for k, a, b in zip(known.tolist(), begins.tolist(), [*begins[1:].tolist(), len(length)], strict=True)}
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for k in np.unique(n).tolist():
                own = n == k
                a, b = by[k]
                at[own] = a + np.searchsorted(first[a:b], rank[own], "right") - 1
            i = rank - first[at]
            out = [pa.array(sequence[at] + i // each[at]), pa.array(offset[at] + i % each[at] * n)]
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *out], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece of every document."""
    cut = checkpointed(pieces(docs, path, with_ids))
    counts = cut.groupBy("part", "length").agg((F.max("local") + 1).alias("n"))
    counts = checkpointed(counts)
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "length", before.alias("before"))
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    sent = docs.sparkSession.sparkContext.broadcast(plan(histogram))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_place(sent), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, of pieces packed with_ids. A sequence has SEQUENCE ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
