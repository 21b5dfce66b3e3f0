"""Exact substring dedup: suffix arrays by two-stage sorting over the places where texts may repeat each other.

A byte is removed if it lies in a string of `LENGTH` bytes that also starts in a document with a smaller id. Which
strings of that length occur in which document is decided by suffix arrays, whose entries with a common prefix
of LENGTH or more stand side by side:

* only suffixes smaller than their successors are sorted directly,
* scans over the buckets of first bytes, in order, induce all others,
* adjacent common prefixes then bound the groups of equal strings.

A suffix array needs its text in one place, so text is first brought together by content. Each string of LENGTH bytes has
an anchor: its gram of `GRAM` bytes with the least hash (the leftmost of several). Equal strings have equal anchors
at equal offsets, so anchors that occur in one document only rule their strings out, and strings that share an anchor
meet in one bucket. The steps:

1. All documents: anchors by bucket of their hash. An anchor in two documents or more is flagged, for the texts it is in.
2. Texts with flags: for each flagged anchor, the stretch of text whose strings have that anchor, to the anchor's bucket.
   Of equal stretches within a slice of documents only the one with the smallest id goes there; the others are
   repeats of it as they stand. So a passage that very many documents share sends one row for each slice.
3. Each bucket: equal stretches are settled by the smallest id among them, and a stretch whose anchor no other distinct one has by that
   alone (equal strings have equal anchors); suffix array over the distinct stretches that share anchors; for each string the smallest
   id it occurs in; repeats of smaller ids.
4. Documents with their repeats: runs, remaining bytes.

What travels is kept short: anchors as 32 bits of their hash within a bucket (where two have the same, texts are searched in vain), documents, places
and sizes as byte planes, and rows are told apart by doc_id alone unless several have it (`with_ties`).

Buckets are as many as the input asks for; texts move twice, by hash of the text, never into one group. What very many
documents share is spread:

* Texts that very many rows hold are known from counts, and all their rows but those of the smallest document are settled by that alone
  (`split_copies`), so they don't meet the text's flags in one task.
* What a slice has settled (repeats, flags of copies of one text) goes to buckets by document, or by text and `SALTS` groups of
  partitions, so copies of one text meet in no one task.
* An anchor in more than `HOT` texts is hot. Its strings go out one by one, to buckets by their own hash, each once for a
  partition as long as the partition hasn't met it in a smaller document: a bucket gets distinct strings, and each at most a few
  times a partition, whatever surrounds it in how many documents. Hot anchors are broadcast, `HOT_KEYS` of them at most; where there
  are more, the least number of texts that makes an anchor hot rises to a power of two that leaves as many.

Defined results: a null text is empty; texts of fewer than LENGTH bytes lose nothing; a row with a null doc_id comes after all
others (and after no other of that kind); rows that share a doc_id aren't smaller than each other; an empty table gives
no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import let_go, saved

LENGTH, GRAM = 50, 24
#: Places whose grams are hashed at once (what is at hand then stays in a core's cache), and the bits of a key that hold the place.
BLOCK, _PLACE = 1 << 15, np.uint64((1 << 16) - 1)
#: Text behind one bucket of anchors, and text in one suffix array.
ANCHOR_BYTES, ARRAY_BYTES = 48 << 20, 4 << 20
#: Texts from which an anchor is hot (their stretches would fill half an array), and most hot anchors that are broadcast.
HOT, HOT_KEYS = ARRAY_BYTES // (4 * LENGTH), 1 << 20
#: Groups of partitions whose flags for one text meet, and strings of hot anchors from which a partition forgets those it has sent (one may then go out again).
SALTS, REMEMBERED = 1024, 1 << 18
#: Rows of one text from which its copies are settled by a count, and most such texts that are broadcast (5 MB).
MANY, COPIED = 64, 1 << 16
_SPREAD = np.uint64(0x9FB21C651E98DF25)
LAST = (1 << 63) - 1


# --- suffix arrays


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. The empty suffix is the smallest."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # of runs of one byte
    rising = np.zeros(len(ends), bool)
    rising[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(rising, np.diff(np.append(-1, ends)))


def sort_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places in order of their suffixes' first `depth` bytes or more; those alike stay in order of place."""
    padded = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    order = at
    for k in range((depth - 1) // 8, -1, -1):
        order = order[np.argsort(words[order + 8 * k].astype(np.uint64), kind="stable")]
    return order


def two_stage(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (bytes up to 255) in order of their first `depth` bytes or more."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    smaller = suffix_types(t)
    direct = sort_directly(t, np.flatnonzero(smaller), depth)
    edge = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(suffixes: np.ndarray, c: int) -> None:
        """Suffixes one byte longer, whose first byte is greater than c, to the end of their buckets."""
        p = suffixes[suffixes > 0] - 1
        first = t[p]
        p = p[first > c]
        first = t[p]
        order = np.argsort(first, kind="stable")
        p, first = p[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(p, cut) if len(p) else ():
            induced[t[part[0]]].append(part)

    induced[t[n - 1]].append(np.array([n - 1]))  # by the empty suffix
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        induced[c] = []
        larger = [wave]
        while len(wave):  # suffixes that begin with c twice or more
            p = wave[wave > 0] - 1
            wave = p[t[p] == c]
            larger.append(wave)
        own = np.concatenate([*larger, direct[edge[c] : edge[c + 1]]])
        out.append(own)
        if len(own):
            induce(own, c)
    return np.concatenate(out)


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in `order`, counted up to `most`; 0 for the first."""
    padded = np.concatenate([t, np.zeros(most + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for k in range(-(-most // 8)):
        differ = words[order[left] + 8 * k].astype(np.uint64) ^ words[order[left - 1] + 8 * k].astype(np.uint64)
        same = differ == 0
        high, low = differ[~same] >> np.uint64(32), differ[~same] & np.uint64(0xFFFFFFFF)
        bits = np.where(high > 0, 32 - np.frexp(high.astype(np.float64))[1], 64 - np.frexp(low.astype(np.float64))[1])  # zeros before the first difference
        out[left[~same]] = np.minimum(8 * k + bits // 8, most)
        left = left[same]
    out[left] = most
    return out


def smallest_owner(pieces: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of `length` bytes in each piece, in order: the smallest owner of a piece that it occurs in. And the first string of each piece (len+1)."""
    t = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    at = np.cumsum(size + 1) - size - 1
    piece = np.repeat(np.arange(len(pieces)), size + 1)
    count = np.maximum(size - length + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    order = two_stage(t, length)
    place = order - at[piece[order]]
    whole = place < count[piece[order]]
    order, place = order[whole], place[whole]
    out = np.zeros(first[-1], np.int64)
    if len(order):
        starts = np.flatnonzero(adjacent_prefixes(t, order, length) < length)
        least = np.minimum.reduceat(owner[piece[order]], starts)
        out[first[piece[order]] + place] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out, first


# --- anchors


def _gram_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of grams, from their words of eight bytes."""
    h = parts[0]
    with np.errstate(over="ignore"):
        for word in parts[1:]:
            h = (h ^ (h >> np.uint64(32))) * _SPREAD + word
    return X.mix(h)


def anchors(buf: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first string, last string, hash) of each anchor: the strings from first to last, by their starts in `buf`, have it."""
    n, width = len(buf) - length + 1, length - gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    words = np.ndarray((len(buf) - 7,), np.uint64, np.ascontiguousarray(buf), strides=(1,))
    steps = [*range(0, gram - 8, 8), gram - 8]
    where = np.empty(n, np.int32)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        near = words[a : b + length - 8].astype(np.uint64)
        h = _gram_hashes([near[k : k + b - a + width - 1] for k in steps])
        best, k = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1  # the leftmost of those alike
        while k < width:
            step = min(k, width - k)
            best = np.minimum(best[:-step], best[step:])
            k += step
        where[a:b] = (best & _PLACE).astype(np.int32) + np.int32(a)
    size = np.diff(at)
    count = np.maximum(size - length + 1, 0)
    new = np.ones(n, bool)
    np.not_equal(where[1:], where[:-1], out=new[1:])
    new[at[:-1][count > 0]] = True
    ends = X.concat_ranges(at[:-1] + count, size - count)  # where no string of the text starts
    new[ends[ends < n]] = False
    begin = np.flatnonzero(new)
    text = np.searchsorted(at, begin, "right") - 1
    last = np.minimum(np.append(begin[1:], n) - 1, at[text] + count[text] - 1)
    anchor = where[begin]
    return text, begin, last, _gram_hashes([words[anchor + k].astype(np.uint64) for k in steps])


def _low(h: np.ndarray) -> np.ndarray:
    """What stands for an anchor within its bucket, and for a hot one. Where two anchors have the same, texts without repeats may be searched too."""
    return h.astype(np.uint32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(key)).astype(np.int64)


#: Kinds of rows of anchors: of one text of the slice; flagged in the slice; of several texts of it (then `count` says how many).
LONE, FLAGGED, SHARED = 0, 1, 2
_ANCHORS = pa.schema([("bucket", pa.int64()), ("th", pa.binary()), ("count", pa.binary()), ("low", pa.binary()), ("kind", pa.int32())])


def _emit_anchors(buckets: int, slice_bytes: int):
    """By slice and bucket: texts (their hashes), how many anchors of each follow, and the low bits of these anchors' hashes.

    An anchor goes out once for a slice. If several texts of the slice have it, it is flagged for these here, in rows of
    their own, and goes out for no text, with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = X.mix(np.array([TaskContext.get().partitionId() % SALTS], np.uint64))
        for batch in X.slices(batches, slice_bytes):
            buf, at = X.text_buffer(batch.column("text"))
            th = batch.column("th").to_numpy().view(np.uint64)
            text, _, _, h = anchors(buf, at)
            order = np.argsort(h, kind="stable")  # texts stay in order
            h, text = h[order], text[order]
            once = np.ones(len(h), bool)  # an anchor that a text has twice
            once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[once], text[once]
            start, end = _runs(h)
            n = end - start
            own = start[n == 1]
            yield from _blobs(_bucket(h[own], buckets), text[own], th, _low(h[own]), LONE)
            several = np.repeat(n > 1, n)
            yield from _blobs(_bucket(X.mix(th[text[several]] ^ salt), buckets), text[several], th, _low(h[several]), FLAGGED)
            own = start[n > 1]
            yield from _blobs(_bucket(h[own], buckets), n[n > 1], None, _low(h[own]), SHARED)

    return run


def _blobs(bucket: np.ndarray, owner: np.ndarray, th: np.ndarray | None, low: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of one kind; `owner` is the text of each anchor (a place in `th`), or the number of its texts."""
    if not len(bucket):
        return
    order = np.argsort(bucket * (int(owner.max()) + 1) + owner, kind="stable")
    bucket, owner, low = bucket[order], owner[order], low[order]
    start, _ = _runs(bucket)
    if kind == SHARED:
        ths, counts = pa.array([b""] * len(start), pa.binary()), _planes(owner.astype(np.uint32), start)
    else:
        first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))
        cell = np.searchsorted(first, start)
        ths, counts = _binaries(th[owner[first]], cell), _planes(np.diff(np.append(first, len(owner))).astype(np.uint32), cell)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), ths, counts, _binaries(low, start), pa.array(np.full(len(start), kind, np.int32))], schema=_ANCHORS)


_FLAGS = pa.schema([("th", pa.int64()), ("power", pa.int32()), ("flags", pa.binary())])


def _flag(hot_from: int):
    """Rows (th, flags): the flagged anchors of each text that has any in this bucket. And, without a th, hot anchors by the power of two of their number of texts."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        th, _ = _values(table.column("th"), np.uint64)
        count, each = _unplaned(table.column("count"), np.uint32)
        low, size = _values(table.column("low"), np.uint32)
        shared, kinds = np.repeat(kind == SHARED, each), np.repeat(kind, size)
        times, owner = np.ones(len(low), np.int64), np.zeros(len(low), np.uint64)
        times[kinds == SHARED] = count[shared]
        owner[kinds != SHARED] = np.repeat(th, count[~shared])
        seen = np.flatnonzero(kinds != FLAGGED)
        seen = seen[np.argsort(low[seen])]
        start, end = _runs(low[seen])
        texts = np.add.reduceat(times[seen], start) if len(start) else np.zeros(0, np.int64)
        flagged = kinds == FLAGGED
        flagged[seen] = np.repeat(texts > 1, end - start)
        take = np.flatnonzero(flagged & (kinds != SHARED))
        take = take[np.lexsort((low[take], owner[take]))]
        o, v = owner[take], low[take]
        new = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])) if len(o) else np.zeros(0, bool)  # slices may have flagged the same
        o, v = o[new], v[new]
        first, _ = _runs(o)
        hot = np.flatnonzero(texts > hot_from)
        power = np.frexp(texts[hot].astype(np.float64))[1]
        hot = hot[np.argsort(power, kind="stable")]
        power = np.sort(power, kind="stable")
        begin, _ = _runs(power)
        ths = pa.concat_arrays([pa.array(o[first].view(np.int64)), pa.nulls(len(begin), pa.int64())])
        powers = pa.concat_arrays([pa.nulls(len(first), pa.int32()), pa.array(power[begin].astype(np.int32))])
        flags = pa.concat_arrays([_binaries(v, first), _binaries(low[seen][start[hot]], begin)])
        return pa.table([ths, powers, flags], schema=_FLAGS)

    return run


def _hot_anchors(flags: DataFrame, most: int) -> np.ndarray:
    """Low bits of the hashes of hot anchors, sorted; `most` at most, those of the most texts."""
    rows = flags.where("th is null")
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("power").agg(F.sum(F.octet_length("flags") / 4)).collect()}
    least, total = max(sizes, default=0) + 1, 0
    for power in sorted(sizes, reverse=True):
        if total + sizes[power] > most:
            break
        least, total = power, total + sizes[power]
    found = [np.frombuffer(r[0], np.uint32) for r in rows.where(F.col("power") >= least).select("flags").toLocalIterator()] if total else []
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _binaries(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """values, cut at `start`, as binaries."""
    data = np.ascontiguousarray(values)
    offsets = (np.append(start, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8) if len(data) else b"")])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries, end to end, and the length of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], np.diff(at)


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values in a column of binaries, and how many each holds."""
    data, size = _flat(column)
    return data.view(kind), size // np.dtype(kind).itemsize


def _byte_places(n: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each byte of values of `width` bytes: its places in binaries of n values each, which hold the first bytes of their values, then the second ones, and so on."""
    before = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat((width - 1) * before, n)
    step = np.repeat(n, n)
    for k in range(width):
        yield at + k * step


def _planes(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """values, cut at `start`, as binaries of byte planes: where values are small, the codec of shuffles and files finds runs of zeros."""
    data = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)
    out = np.empty(data.size, np.uint8)
    for k, place in enumerate(_byte_places(np.diff(np.append(start, len(values))), data.shape[1])):
        out[place] = data[:, k]
    return _binaries(out, start * data.shape[1])


def _unplaned(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values in a column of `_planes`, and how many each holds."""
    data, size = _flat(column)
    width = np.dtype(kind).itemsize
    n = size // width
    out = np.empty((int(n.sum()), width), np.uint8)
    for k, place in enumerate(_byte_places(n, width)):
        out[:, k] = data[place]
    return out.view(kind).ravel(), n


# --- stretches of text and their repeats

_STRETCHES = pa.schema([("bucket", pa.int64()), ("doc", pa.binary()), ("tie", pa.binary()), ("pos", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])


def _alike(data: np.ndarray, n: np.ndarray) -> pa.DictionaryArray:
    """Pieces of n bytes each, which `data` holds end to end, as a dictionary of the distinct ones."""
    return _binaries(data, np.cumsum(n) - n).dictionary_encode()


def _settle(buf: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of spans of `buf`: the smallest document of an equal span."""
    pieces = _alike(buf[X.concat_ranges(first, end - first)], end - first)
    which = pieces.indices.to_numpy()
    least = np.full(len(pieces.dictionary), LAST)
    np.minimum.at(least, which, doc)
    return least[which]


def _place(doc: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of what is settled: by document and text."""
    return _bucket(X.mix(tie.view(np.uint64) ^ X.mix(doc.view(np.uint64))), buckets)


def _emit_stretches(buckets: int, hot: Broadcast, slice_bytes: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value
        sent: dict[bytes, int] = {}
        for batch in X.slices(batches, slice_bytes):
            if len(sent) >= remembered:
                sent.clear()
            buf, at = X.text_buffer(batch.column("text"))
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            text, first, last, h = anchors(buf, at)
            cells = batch.column("flags")
            flags, n = _values(cells.flatten(), np.uint32)
            flagged = np.repeat(np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy()), n)
            keep = np.isin(_of_text(text, _low(h)), _of_text(flagged, flags))
            text, first, end, h = text[keep], first[keep], last[keep] + LENGTH, h[keep]
            if not len(text):
                continue
            repeat = doc[text] > _settle(buf, first, end, doc[text])
            pos, n = first - at[text], end - first
            # decided here: no bytes travel
            yield from _stretches(_place(doc[text[repeat]], tie[text[repeat]], buckets), doc[text[repeat]], tie[text[repeat]], pos[repeat], n[repeat], None, None)
            split = ~repeat & np.isin(_low(h), often)
            own = ~repeat & ~split
            yield from _stretches(_bucket(h[own], buckets), doc[text[own]], tie[text[own]], pos[own], n[own], buf, first[own])
            if split.any():
                yield from _single(buf, first[split], n[split] - LENGTH + 1, doc[text[split]], tie[text[split]], pos[split], buckets, sent)

    return run


def _of_text(text: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (text.astype(np.uint64) << np.uint64(32)) | low


def _single(buf, first, count, doc, tie, pos, buckets: int, sent: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The strings of hot anchors, one by one; `sent`: strings that this partition has sent, with the smallest document."""
    which = np.repeat(np.arange(len(first)), count)
    at = X.concat_ranges(first, count)
    doc, tie, pos = doc[which], tie[which], pos[which] + at - first[which]
    decided = doc > _settle(buf, at, at + LENGTH, doc)
    for i in np.flatnonzero(~decided).tolist():
        key, d = buf[at[i] : at[i] + LENGTH].tobytes(), int(doc[i])
        before = sent.get(key, LAST)
        if before < d:
            decided[i] = True
        elif d < before:
            sent[key] = d
    left = ~decided
    yield from _stretches(_bucket(X.span_hashes(buf, at[left], at[left] + LENGTH), buckets), doc[left], tie[left], pos[left], np.full(int(left.sum()), LENGTH), buf, at[left])
    # runs of settled strings of one stretch
    i = np.flatnonzero(decided)
    new = np.append(True, (which[i][1:] != which[i][:-1]) | (i[1:] != i[:-1] + 1)) if len(i) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(i))) + LENGTH - 1
    i = i[begin]
    yield from _stretches(_place(doc[i], tie[i], buckets), doc[i], tie[i], pos[i], size, None, None)


def _stretches(bucket, doc, tie, pos, n, buf, first) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, doc, tie, pos, n = bucket[order], doc[order], tie[order], pos[order].astype(np.uint32), n[order].astype(np.uint32)
    start, _ = _runs(bucket)
    data = buf[X.concat_ranges(first[order], n.astype(np.int64))] if buf is not None else np.zeros(0, np.uint8)
    upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    text = _binaries(data, upto[start]) if buf is not None else pa.nulls(len(start), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), *(_planes(x, start) for x in (doc, tie, pos, n)), text], schema=_STRETCHES)


_SPANS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("spans", pa.binary())])


def _share_anchors(pieces: pa.Array) -> np.ndarray:
    """True for distinct pieces that have an anchor of another one."""
    buf, size = _flat(pieces)
    piece, _, _, h = anchors(buf, np.concatenate([[0], np.cumsum(size)]))
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    out = np.zeros(len(pieces), bool)
    out[piece[times[which] > 1]] = True
    return out


def _repeats(table: pa.Table) -> pa.Table:
    """Rows (doc, tie, spans): repeated runs of each document that has any in this bucket; a span's start is its low 32 bits, its size the high ones."""
    doc, rows = _unplaned(table.column("doc"), np.int64)
    tie, pos, size = (_unplaned(table.column(c), k)[0] for c, k in (("tie", np.int64), ("pos", np.uint32), ("size", np.uint32)))
    pos, size = pos.astype(np.int64), size.astype(np.int64)
    open_ = np.flatnonzero(np.repeat(table.column("bytes").combine_chunks().is_valid().to_numpy(zero_copy_only=False), rows))
    settled = np.ones(len(doc), bool)  # whole stretches that are repeats; `row`, `start` and `end` are those in part
    row = start = end = np.zeros(0, np.int64)
    if len(open_):
        pieces = _alike(_flat(table.column("bytes").drop_null())[0], size[open_])
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary
        owner = np.full(len(distinct), LAST)
        np.minimum.at(owner, which, doc[open_])
        settled[open_] = owner[which] < doc[open_]
        # equal strings have equal anchors: a suffix array decides among distinct stretches that share one
        common = _share_anchors(distinct)
    else:
        common = np.zeros(0, bool)
    if common.any():
        left = common[which] & ~settled[open_]
        part, which = open_[left], (np.cumsum(common) - 1)[which[left]]
        least, first = smallest_owner(distinct.filter(pa.array(common)).to_pylist(), owner[common], LENGTH)
        count = first[which + 1] - first[which]
        hit = least[X.concat_ranges(first[which], count)] < np.repeat(doc[part], count)
        edge = np.concatenate([[0], np.cumsum(count)])
        s, e, at = X.word_spans(hit.astype(np.uint8), edge, np.array([False, True]))
        k = np.repeat(np.arange(len(which)), np.diff(at))
        row, start, end = part[k], pos[part[k]] + s - edge[k], pos[part[k]] + e - edge[k] - 1 + LENGTH
    whole = np.flatnonzero(settled)
    row, start, end = np.concatenate([whole, row]), np.concatenate([pos[whole], start]), np.concatenate([pos[whole] + size[whole], end])
    order = np.lexsort((tie[row], doc[row]))
    doc, tie, start, end = doc[row[order]], tie[row[order]], start[order], end[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))) if len(order) else np.zeros(0, np.int64)
    spans = start.astype(np.uint64) | ((end - start).astype(np.uint64) << np.uint64(32))
    return pa.table([pa.array(doc[new]), pa.array(tie[new]), _planes(spans, new)], schema=_SPANS)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches):
        buf, at = X.text_buffer(batch.column("text"))
        cover = np.zeros(len(buf) + 1, np.int64)
        cells = batch.column("spans")
        spans, n = _unplaned(cells.flatten(), np.uint64)
        first = np.repeat(np.repeat(at[:-1], pc.fill_null(cells.value_lengths(), 0).to_numpy()), n) + (spans & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + (spans >> np.uint64(32)).astype(np.int64), -1)
        gone = np.cumsum(cover[:-1]) > 0
        start, end, first = X.word_spans(gone.astype(np.uint8), at, np.array([False, True]))
        kept = buf[~gone].tobytes()
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[at].tolist()
        removed = [[{"start": s, "end": e} for s, e in zip((start[a:b] - x).tolist(), (end[a:b] - x).tolist(), strict=True)] for a, b, x in zip(first[:-1].tolist(), first[1:].tolist(), at.tolist(), strict=False)]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                pa.array(X.sums(gone.astype(np.int64), at)),
                pa.array(removed, pa.list_(span)),
                pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]),
            ],
            ["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"],
        )


def split_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that need a search, copies) of rows (doc, th, text): copies have a text of a smaller doc that very many rows hold.

    Of texts with MANY rows or more, the COPIED most frequent are broadcast with their smallest doc; a text beyond these has less than one row in COPIED, so no text that is
    left is one task's burden. All 50-byte strings of a copy start in that smaller doc, so it needs no search.
    """
    marked = rows.withColumn("digest", F.md5("text"))
    many = saved(marked.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc").alias("least")).where(F.col("n") >= MANY).orderBy(F.desc("n")).limit(COPIED))
    marked = marked.join(F.broadcast(many.select("digest", "least")), "digest", "left").drop("digest")
    copy = F.coalesce(F.col("doc") > F.col("least"), F.lit(False))
    return marked.where(~copy).drop("least"), marked.where(copy).drop("least")


def _whole(copies: DataFrame) -> DataFrame:
    """(doc, tie, spans) of copies: all of a text, if it has a string at all."""
    h = F.lpad(F.hex(F.octet_length("text").cast("long")), 8, "0")
    end = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return copies.where(F.octet_length("text") >= LENGTH).select("doc", "tie", F.unhex(F.concat(F.lit("00000000"), end)).alias("spans"))


def with_ties(rows: DataFrame) -> DataFrame:
    """rows (doc, th, ...) and `tie`: 0 where no other row has that doc, else th. (doc, tie) tells texts apart as (doc, th) does, in fewer bytes.

    Docs of several rows are broadcast; if there are more than COPIED, every row's tie is its th.
    """
    several = [r[0] for r in rows.groupBy("doc").count().where("count > 1").select("doc").limit(COPIED + 1).collect()]
    if not several or len(several) > COPIED:
        return rows.withColumn("tie", F.col("th") if several else F.lit(0).cast("long"))
    known = rows.sparkSession.createDataFrame([(d,) for d in several], "doc long").withColumn("again", F.lit(True))
    return rows.join(F.broadcast(known), "doc", "left").withColumn("tie", F.when(F.col("again"), F.col("th")).otherwise(F.lit(0).cast("long"))).drop("again")


def repeated_strings(docs: DataFrame, hot_from: int = HOT, hot_keys: int = HOT_KEYS, remembered: int = REMEMBERED, slice_bytes: int = X.SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal runs of bytes, end exclusive) and kept_sha256 of every row. The other parameters change the plan, not the rows."""
    rows = X.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    rows = with_ties(rows)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, -(-size // ANCHOR_BYTES))
    by_bucket = rows.select("th", "text").mapInArrow(_emit_anchors(buckets, slice_bytes), "bucket long, th binary, count binary, low binary, kind int")
    flags = saved(by_bucket.groupBy("bucket").applyInArrow(_flag(hot_from), "th long, power int, flags binary"))
    let_go(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_anchors(flags, hot_keys))
    flags = flags.where("th is not null")
    # a flagged anchor has one stretch of a text at least, of up to 2 * LENGTH - GRAM bytes, and what belongs to it
    n = flags.agg(F.sum(F.octet_length("flags").cast("long") / 4)).first()[0] or 0
    arrays = max(16, -(-int(n) * (2 * LENGTH) // ARRAY_BYTES))
    searched, copies = split_copies(rows.select("doc", "tie", "th", "text"))
    per_text = flags.groupBy(F.col("th").alias("own")).agg(F.collect_list("flags").alias("flags"))
    flagged = searched.join(per_text, F.col("th") == F.col("own")).select("doc", "tie", "flags", "text")
    stretches = flagged.mapInArrow(_emit_stretches(arrays, hot, slice_bytes, remembered), "bucket long, doc binary, tie binary, pos binary, size binary, bytes binary")
    repeats = saved(stretches.groupBy("bucket").applyInArrow(_repeats, "doc long, tie long, spans binary"))
    let_go(docs.sparkSession)
    by_doc = repeats.unionByName(_whole(copies)).groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(F.collect_list("spans").alias("spans"))
    whole = rows.join(by_doc, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")), "left").select("doc_id", "spans", "text")
    return whole.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def _digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet")))
