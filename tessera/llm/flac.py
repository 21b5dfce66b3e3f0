"""FLAC media columns: streams of 8-bit mono samples, written and read in whole batches.

The encoder cuts each payload into blocks of `BLOCK` samples and takes for each the cheapest of: a constant, the
samples as they are, a fixed predictor, or a linear predictor fitted to the block, with Rice-coded residuals. Streams
carry STREAMINFO (with the MD5 of the samples) and a seek table. The decoder reads any mono stream of 8 bits
a sample: it follows frame headers, decodes Rice residuals (escaped partitions too) and linear predictors of any order,
checks the CRC-8 of each header, the CRC-16 of each frame and the MD5, and gives PCM blocks (unsigned 8 bits, as in WAV
files) with the sample number and the byte offset of each. Frames are coded and decoded in step with each other, one lane each,
in runs of `RUN` and `LANES` frames, so working memory follows the run and not the length of a text.

Defined results: a null or empty text is a payload of 64 zero bytes; equal payloads give equal streams; repeated rows give
a row each; an empty table gives none; other columns are left out. A null stream decodes to nulls, a damaged one to nulls and what
is wrong with it in `error`; other rows don't change by it. The functions on single streams raise `Damaged`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X

#: Samples of a block; payloads are padded to a multiple of UNIT bytes.
BLOCK, UNIT, RATE = 1024, 64, 8000
#: Order, coefficient bits and shift of the fitted predictor; partitions of a full block; frames between seek points.
ORDER, PRECISION, SHIFT, PARTITIONS, SEEK = 4, 10, 7, 4, 8
#: Frames that are coded together, and that are decoded together.
RUN, LANES = 1024, 4096
#: Coefficients of the fixed predictors, by order.
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


class Damaged(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start:start+length] for each lane, a byte of every lane at a time."""
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    crc = np.zeros(len(n), np.int64)
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # lanes longer than t
    for t, k in enumerate(active.tolist()):
        c = crc[:k]
        crc[:k] = ((c << 8) & ((1 << bits) - 1)) ^ table[(c >> (bits - 8)) ^ data[at[:k] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# --- encoder


def _utf8(n: int) -> bytes:
    """A number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> 6 * i & 0x3F) for i in range(k - 2, -1, -1)]
    return bytes([(0xFF00 >> k & 0xFF) | (n >> 6 * (k - 1))] + tail)


def _fit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised coefficients (frames, ORDER) of the predictor that autocorrelation gives."""
    f = x.astype(np.float32)  # zero past n; sums of up to 2**24 stay whole numbers
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : BLOCK - k]) for k in range(ORDER + 1)], 1).astype(np.float64)
    a, e = np.zeros((len(x), ORDER)), np.maximum(r[:, 0] * 1.0001, 1e-9)
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / e
        b = a.copy()
        b[:, i] = k
        b[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, e = b, np.maximum(e * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top).astype(np.int32)


def _residual(x: np.ndarray, coef: np.ndarray, shift: int) -> np.ndarray:
    """x less its prediction; the first samples, which nothing predicts, count as they are."""
    order = coef.shape[1]
    if not order:
        return x
    pred = np.zeros_like(x)
    for i in range(order):
        pred[:, order:] += coef[:, i : i + 1] * x[:, order - 1 - i : x.shape[1] - 1 - i]
    return x - (pred >> shift)


class _Bits:
    """Bits of all frames, end to end; each frame begins on a byte."""

    def __init__(self, total: int):
        self.bits = np.zeros(total, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Writes value in `width` bits at each place; the places after."""
        for w in np.unique(width).tolist():
            own = slice(None) if len(width) and width.min() == width.max() else np.flatnonzero(width == w)
            place, v = at[own], value[own]
            for b in range(w):
                self.bits[place + b] = (v >> (w - 1 - b)) & 1
        return at + width


def encode_frames(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of signed samples x (frames, BLOCK), n of them valid in each, with their numbers in their streams."""
    m = len(n)
    t = np.arange(BLOCK)
    valid = t < n[:, None]
    x = np.where(valid, x, 0).astype(np.int32)
    fitted = _fit(x, n)
    choices = [(o, np.tile(np.array(FIXED[o], np.int32), (m, 1)), 0) for o in (0, 1, 2)] + [(ORDER, fitted, SHIFT)]
    residuals, cost = [], np.empty((len(choices) + 1, m))
    for c, (o, coef, shift) in enumerate(choices):
        e = _residual(x, coef.reshape(m, -1), shift)
        u = (e << 1) ^ (e >> 31)
        u[:, :o] = 0
        u[~valid] = 0
        residuals.append(u)
        mean = u.sum(1) / np.maximum(n - o, 1)
        cost[c] = 8 * o + (n - o) * (np.log2(mean + 1) + 1.5) + (9 + PRECISION * ORDER if shift else 0) + 6
    cost[-1] = 8 * n
    constant = (x.max(1, where=valid, initial=-999) == x.min(1, where=valid, initial=999)) if m else np.zeros(0, bool)
    choice = cost.argmin(0)
    choice[constant] = -1
    verbatim = len(choices)
    coded = np.flatnonzero((choice >= 0) & (choice < verbatim))
    order = np.zeros(m, np.int64)
    u = np.zeros_like(x)
    zero = np.int32(0)
    for c, (o, _, _) in enumerate(choices):
        own = choice == c
        order[own] = o
        u[own] = residuals[c][own]
    # Rice parameters by partition
    parts = np.where(n == BLOCK, PARTITIONS, 1)
    own = valid & (t >= order[:, None])
    in_part = own.reshape(m, PARTITIONS, -1).sum(2)
    total = u.reshape(m, PARTITIONS, -1).sum(2)
    whole = n < BLOCK  # one partition
    in_part[whole], total[whole] = in_part[whole].sum(1, keepdims=True), total[whole].sum(1, keepdims=True)
    mean = total / np.maximum(in_part, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9)) + 1), 0, 14).astype(np.int32)
    rice = np.repeat(k, BLOCK // PARTITIONS, axis=1)
    width = np.where(own, (u >> rice) + 1 + rice, zero)
    starts = (t == 0) | ((n[:, None] == BLOCK) & (t % (BLOCK // PARTITIONS) == 0))  # where a parameter stands
    is_coded = np.zeros(m, bool)
    is_coded[coded] = True
    step = np.where(is_coded[:, None], width + np.where(starts & valid, np.int32(4), zero), zero)
    fitted_too = choice == 3
    # header bytes, then bits of the subframe's head, its samples or residuals
    heads = []
    for size, num in zip(n.tolist(), number.tolist(), strict=True):
        full = size == BLOCK
        heads.append(bytes([0xFF, 0xF8, (0xA4 if full else 0x74), 0x02]) + _utf8(num) + (b"" if full else (size - 1).to_bytes(2, "big")))
    head_len = np.array([len(h) for h in heads], np.int64)
    lead = 8 + np.where(choice == -1, 8, np.where(choice == verbatim, 8 * n, 8 * order + np.where(fitted_too, 9 + PRECISION * ORDER, 0) + 6))
    body = (lead + step.sum(1, dtype=np.int64) + 7) // 8
    frame_len = head_len + 1 + body + 2
    frame_at = np.concatenate([[0], np.cumsum(frame_len)])
    bits = _Bits(int(frame_at[-1]) * 8)
    at = (frame_at[:-1] + head_len + 1) * 8
    kind = np.where(choice == -1, 0, np.where(choice == verbatim, 1, np.where(fitted_too, 0x20 + ORDER - 1, 8 + order)))
    at = bits.put(at, kind << 1, np.full(m, 8))
    raw = np.flatnonzero((choice == -1) | (choice == verbatim))
    count = np.where(choice[raw] == -1, 1, n[raw])
    i = X.concat_ranges(raw * BLOCK, count)
    bits.put(X.concat_ranges(at[raw] // 8, count) * 8, x.ravel()[i] & 0xFF, np.full(len(i), 8))
    warm = np.repeat(coded, order[coded])
    j = X.concat_ranges(np.zeros(len(coded), np.int64), order[coded])
    bits.put(at[warm] + 8 * j, x[warm, j] & 0xFF, np.full(len(warm), 8))
    at = at + 8 * order
    lpc = np.flatnonzero(fitted_too)
    a = bits.put(at[lpc], np.full(len(lpc), PRECISION - 1), np.full(len(lpc), 4))
    a = bits.put(a, np.full(len(lpc), SHIFT), np.full(len(lpc), 5))
    for c in range(ORDER):
        a = bits.put(a, fitted[lpc, c] & ((1 << PRECISION) - 1), np.full(len(lpc), PRECISION))
    at[lpc] = a
    at[coded] = bits.put(at[coded], np.where(parts[coded] == PARTITIONS, PARTITIONS.bit_length() - 1, 0), np.full(len(coded), 6))
    place = at[:, None] + (np.cumsum(step, 1, dtype=np.int32) - step)
    mark = np.flatnonzero((starts & valid & is_coded[:, None]).ravel())
    bits.put(place.ravel()[mark], rice.ravel()[mark], np.full(len(mark), 4))
    place += np.where(starts, 4, 0)
    s = np.flatnonzero((own & is_coded[:, None]).ravel())
    r, v = rice.ravel()[s], u.ravel()[s]
    bits.put(place.ravel()[s] + (v >> r), (v & ((1 << r) - 1)) | (1 << r), r + 1)  # the zeros before the one are there already
    data = np.packbits(bits.bits)
    for size in np.unique(head_len).tolist():
        rows = np.flatnonzero(head_len == size)
        data[frame_at[rows][:, None] + np.arange(size)] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(-1, size)
    data[frame_at[:-1] + head_len] = _crc(data, frame_at[:-1], head_len, _CRC8, 8)
    c16 = _crc(data, frame_at[:-1], frame_len - 2, _CRC16, 16)
    data[frame_at[1:] - 2], data[frame_at[1:] - 1] = c16 >> 8, c16 & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(frame_at[:-1].tolist(), frame_at[1:].tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload of unsigned 8-bit samples, which isn't empty."""
    size = np.array([len(p) for p in payloads], np.int64)
    blocks = -(-size // BLOCK)
    stream = np.repeat(np.arange(len(payloads)), blocks)
    number = X.concat_ranges(np.zeros(len(payloads), np.int64), blocks)
    n = np.minimum(size[stream] - number * BLOCK, BLOCK)
    padded = np.frombuffer(b"".join(p.ljust(int(b) * BLOCK, b"\0") for p, b in zip(payloads, blocks, strict=True)), np.uint8)
    samples = padded.reshape(-1, BLOCK)
    frames = [f for a in range(0, len(n), RUN) for f in encode_frames(samples[a : a + RUN].astype(np.int32) - 128, n[a : a + RUN], number[a : a + RUN])]
    out, first = [], 0
    for p, b in zip(payloads, blocks.tolist(), strict=True):
        own = frames[first : first + b]
        first += b
        lengths = [len(f) for f in own]
        at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        points = b"".join((i * BLOCK).to_bytes(8, "big") + at[i].to_bytes(8, "big") + min(BLOCK, len(p) - i * BLOCK).to_bytes(2, "big") for i in range(0, b, SEEK))
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


# --- decoder


def stream_info(media: bytes) -> dict:
    """total samples, md5, seek points (sample, byte, samples) and the place of the first frame."""
    if media[:4] != b"fLaC":
        raise Damaged("no FLAC stream")
    at, out, last = 4, {"points": []}, False
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if len(body) < size or (kind == 0 and size < 34):
            raise Damaged("metadata ends early")
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            if v >> 41 & 7 or (v >> 36 & 31) != 7:
                raise Damaged("not mono of 8 bits")
            out |= {"block": int.from_bytes(body[2:4], "big"), "total": v & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            out["points"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size - size % 18, 18)]
        at += 4 + size
    return out | {"frames": at}


class _Reader:
    """Reads bits of many lanes at once, each at its own place."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\0" * 16, np.uint8)
        self.raw = padded[: len(data)]
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        self.end = (len(padded) - 9) * 8

    def word(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place, at the top of a word."""
        if len(at) and int(at.max()) > self.end:
            raise Damaged("a frame ends early")
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned value of `width` bits (0 to 56) at each place."""
        w = np.broadcast_to(np.asarray(width, np.uint64), at.shape)
        return np.where(w > 0, self.word(at) >> (np.uint64(64) - np.maximum(w, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one from each place."""
        count = np.zeros(len(at), np.int64)
        going = np.arange(len(at))
        while len(going):
            top = (self.word(at[going] + count[going]) >> np.uint64(12)).astype(np.float64)  # 52 bits, exact
            lead = 52 - np.frexp(top)[1]
            count[going] += np.where(top > 0, lead, 52)
            going = going[top == 0]
        return count

    def rice(self, at: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the Rice code with parameter r at each place: bits of its unary part, and the value. One word of each lane nearly always holds both."""
        word = self.word(at)
        ones = 53 - np.frexp((word >> np.uint64(12)).astype(np.float64))[1].astype(np.int64)
        if len(at) and int((ones + r).max()) <= 52:
            low = ((word << ones.astype(np.uint64)) >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64)
        else:
            ones = self.zeros(at) + 1
            low = self.take(at + ones, r)
        return ones, (ones - 1) << r | low


def _signed(value: np.ndarray, width) -> np.ndarray:
    return value - ((value >> (np.maximum(width, 1) - 1) & 1) << width)


_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}


def _heads(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, samples, header bytes (with CRC-8) and check of the header at each place."""
    number, size, length, sound = (np.zeros(len(at), np.int64) for _ in range(4))
    for i, a in enumerate(at.tolist()):
        h = data[a : a + 20].tobytes()
        if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] >> 4 or (h[3] >> 1 & 7) not in (0, 1):
            raise Damaged("no frame where one should begin")
        k = 1 if h[4] < 0x80 else 8 - int(h[4] ^ 0xFF).bit_length()
        v = h[4] if k == 1 else h[4] & (0x7F >> k)
        for b in h[5 : 4 + k]:
            v = v << 6 | b & 0x3F
        n, code, rate = 4 + k, h[2] >> 4, h[2] & 15
        if code in (6, 7):
            size[i] = int.from_bytes(h[n : n + code - 5], "big") + 1
            n += code - 5
        else:
            size[i] = _SIZES[code]
        n += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        number[i], length[i] = v, n + 1
    crc = _crc(data, at, length - 1, _CRC8, 8)
    sound = crc == data[at + length - 1]
    return number, size, length, sound


def decode_frames(data: bytes | _Reader, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the frame at each place: signed samples (longest block, frames), their number, the frame's number and its end.

    Raises Damaged unless the CRC-8 of every header and the CRC-16 of every frame hold.
    """
    bits = data if isinstance(data, _Reader) else _Reader(data)
    raw = bits.raw
    number, size, head, sound = _heads(raw, at)
    if not sound.all():
        raise Damaged("the CRC-8 of a frame header differs")
    lanes = len(at)
    pos = (at + head) * 8
    kind = bits.take(pos, 8)
    if (kind & 0x81).any():
        raise Damaged("a subframe of an unknown kind")
    kind = kind >> 1
    pos = pos + 8
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise Damaged("a subframe of an unknown kind")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    most = int(size.max()) if lanes else 0
    x = np.zeros((most, lanes), np.int64)
    one = np.flatnonzero(constant)
    v = _signed(bits.take(pos[one], 8), 8)
    x[:, one] = v
    pos[one] += 8
    plain = np.flatnonzero(verbatim)
    for lane in plain.tolist():
        b = int(pos[lane]) >> 3
        x[: size[lane], lane] = raw[b : b + size[lane]].view(np.int8)
    pos[plain] += 8 * size[plain]
    coded = np.flatnonzero(fixed | lpc)
    coded = coded[np.argsort(-size[coded], kind="stable")]
    if len(coded):
        n, o, p = size[coded], order[coded], pos[coded]
        deepest = int(o.max())
        y = np.zeros((most + deepest, len(coded)), np.int64)  # with room for what stands before the first sample
        for i in range(deepest):
            own = np.flatnonzero(o > i)
            y[deepest + i, own] = _signed(bits.take(p[own], 8), 8)
            p[own] += 8
        coef, shift = np.zeros((deepest, len(coded)), np.int64), np.zeros(len(coded), np.int64)
        for k in range(1, min(4, deepest) + 1):
            for i, c in enumerate(FIXED[k]):
                coef[i, fixed[coded] & (o == k)] = c
        own = np.flatnonzero(lpc[coded])
        precision = bits.take(p[own], 4) + 1
        shift[own] = _signed(bits.take(p[own] + 4, 5), 5)
        p[own] += 9
        for i in range(deepest):
            more = o[own] > i
            coef[i, own[more]] = _signed(bits.take(p[own[more]], precision[more]), precision[more])
            p[own[more]] += precision[more]
        method = bits.take(p, 2)
        if (method > 1).any():
            raise Damaged("an unknown residual coding")
        wide = 4 + method
        per = n >> bits.take(p + 2, 4)
        p += 6
        rice, escaped, width = (np.zeros(len(coded), np.int64) for _ in range(3))
        some_escaped = False
        for t in range(most):
            k = int(np.searchsorted(-n, -t, "left"))  # lanes with more than t samples
            begin = np.flatnonzero(t % per[:k] == 0)
            if len(begin):
                w = wide[begin]
                rice[begin] = bits.take(p[begin], w)
                p[begin] += w
                escaped[begin] = rice[begin] == (1 << w) - 1
                raw_now = begin[escaped[begin] == 1]
                width[raw_now] = bits.take(p[raw_now], 5)
                p[raw_now] += 5
                some_escaped = bool(escaped[:k].any())
            own = np.flatnonzero(o[:k] <= t) if t < deepest else slice(0, k)
            q = p[own]
            r = rice[own]
            if some_escaped:
                e = escaped[own] == 1
                ones = np.where(e, 0, bits.zeros(q) + 1)
                w = np.where(e, width[own], r)
                low = bits.take(q + ones, w)
                value = np.where(e, _signed(low, w), (np.maximum(ones - 1, 0) << np.where(e, 0, r)) | low)
                value = np.where(e, value, (value >> 1) ^ -(value & 1))
                p[own] = q + ones + w
            else:
                ones, value = bits.rice(q, r)
                value = (value >> 1) ^ -(value & 1)
                p[own] = q + ones + r
            pred = np.zeros(len(q), np.int64)
            for i in range(deepest):
                pred += coef[i, own] * y[deepest + t - 1 - i, own]
            y[deepest + t, own] = value + (pred >> shift[own])
        x[:, coded] = y[deepest:]
        pos[coded] = p
    end = (pos + 7) // 8 + 2
    if lanes and int(end.max()) > len(raw):
        raise Damaged("a frame ends early")
    crc = _crc(raw, at, end - 2 - at, _CRC16, 16)
    if not (crc == (raw[end - 2].astype(np.int64) << 8 | raw[end - 1])).all():
        raise Damaged("the CRC-16 of a frame differs")
    if lanes and np.abs(x).max() > 128:
        raise Damaged("a sample of more than 8 bits")
    return x, size, number, end


def _frames(media: bytes, info: dict) -> list[int]:
    """Where frames begin: at seek points, and in between where a header and its CRC-8 stand and the frame before it ends.

    Candidates are sync codes with a sound header and the next number; the CRC-16 of each frame then confirms them.
    """
    out, at, want = [], info["frames"], 0
    n = -(-info["total"] // info["block"])
    while want < n:
        if at < 0 or at + 6 > len(media):
            raise Damaged("a frame is missing")
        h = media[at : at + 20]
        if h[0] == 0xFF and h[1] & 0xFE == 0xF8 and not h[3] >> 4 and (h[3] >> 1 & 7) in (0, 1) and h[2] >> 4:
            with_number = _utf8(want)
            k = 4 + len(with_number) + {6: 1, 7: 2}.get(h[2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(h[2] & 15, 0)
            if h[4 : 4 + len(with_number)] == with_number and k < len(h) and _crc_of(h[:k]) == h[k]:
                out.append(at)
                want += 1
                at += k
        at = media.find(b"\xff\xf8", at + 1)
    return out


def _crc_of(head: bytes) -> int:
    c = 0
    for b in head:
        c = _TABLE8[c ^ b]
    return c


_TABLE8 = _CRC8.tolist()


def decode(streams: list[bytes]) -> list[tuple[bytes, list[int], list[int]]]:
    """Of each stream: its PCM (unsigned), and the sample number and byte offset of each block. Everything is verified."""
    try:
        return _together(streams)
    except Damaged:  # or bytes inside a frame that look like the next frame's header: one frame after the other tells
        return [_in_turn(s) for s in streams]


def _verified(media: bytes, info: dict, pcm: bytes) -> bytes:
    if len(pcm) != info["total"] or hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()).digest() != info["md5"]:
        raise Damaged("the samples' MD5 differs")
    return pcm


def _in_turn(media: bytes) -> tuple[bytes, list[int], list[int]]:
    info = stream_info(media)
    at, blocks, samples, places = info["frames"], [], [0], []
    bits = _Reader(media)
    while samples[-1] < info["total"]:
        if at >= len(media):
            raise Damaged("a frame is missing")
        x, size, number, end = decode_frames(bits, np.array([at]))
        if number[0] != len(places):
            raise Damaged("a frame is missing")
        places.append(at)
        blocks.append((x[: size[0], 0] + 128).astype(np.uint8).tobytes())
        samples.append(samples[-1] + int(size[0]))
        at = int(end[0])
    return _verified(media, info, b"".join(blocks)), samples[:-1], places


def _together(streams: list[bytes]) -> list[tuple[bytes, list[int], list[int]]]:
    infos = [stream_info(s) for s in streams]
    data = b"".join(streams)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).tolist()
    places = [_frames(s, i) for s, i in zip(streams, infos, strict=True)]
    at = np.array([b + p for b, own in zip(base[:-1], places, strict=True) for p in own], np.int64)
    bits = _Reader(data)
    pcm, size, end = [], [], []
    for a in range(0, len(at), LANES):
        x, n, _, e = decode_frames(bits, at[a : a + LANES])
        rows = (x.T + 128).astype(np.uint8)
        pcm += [rows[i, :k].tobytes() for i, k in enumerate(n.tolist())]
        size += n.tolist()
        end += e.tolist()
    out, first = [], 0
    for info, own, b, stop in zip(infos, places, base[:-1], base[1:], strict=True):
        k = len(own)
        if k and [*[p + b for p in own[1:]], stop] != end[first : first + k]:
            raise Damaged("a frame doesn't end where the next begins")
        n = size[first : first + k]
        blocks = b"".join(pcm[first : first + k])
        first += k
        out.append((_verified(streams[len(out)], info, blocks), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(int).tolist() if k else [], own))
    return out


def read_range(media: bytes, start: int, count: int) -> bytes:
    """PCM of `count` samples from `start`, by way of the seek table: only frames from the point before it are decoded."""
    info = stream_info(media)
    stop = min(start + count, info["total"])
    sample, byte = max(((s, b) for s, b, _ in info["points"] if s <= start), default=(0, 0))
    at, out = info["frames"] + byte, []
    bits = _Reader(media)
    while sample < stop:
        x, size, _, end = decode_frames(bits, np.array([at]))
        block = (x[: size[0], 0] + 128).astype(np.uint8).tobytes()
        out.append(block[max(0, start - sample) : stop - sample])
        sample, at = sample + int(size[0]), int(end[0])
    return b"".join(out)


# --- columns


def payload(text: str | bytes) -> bytes:
    raw = text if isinstance(text, bytes) else text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, 1 << 20):
        buf, at = X.text_buffer(batch.column("text"))
        raw, at = buf.tobytes(), at.tolist()
        media = encode([payload(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the FLAC stream of each text's payload."""
    return X.only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _feature(pcm: bytes) -> str:
    s = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"peak={int(np.abs(s).max())};energy={int((s * s).sum())};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


def _each(streams: list[bytes | None]) -> list[tuple]:
    """Of each stream: PCM, samples, offsets, feature and what is wrong with it."""
    known = [i for i, s in enumerate(streams) if s is not None]
    out: list[tuple] = [(None,) * 5] * len(streams)
    try:
        got = [(*x, None) for x in decode([streams[i] for i in known])]
    except (Damaged, LookupError):
        got = []
        for i in known:
            try:
                got.append((*decode([streams[i]])[0], None))
            except (Damaged, LookupError) as e:
                got.append((None, None, None, str(e) if isinstance(e, Damaged) else "no sound FLAC stream"))
    for i, (pcm, samples, offsets, error) in zip(known, got, strict=True):
        out[i] = (pcm, samples, offsets, None if pcm is None else _feature(pcm), error)
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"pcm": pa.binary(), "samples": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()), "feature": pa.string(), "error": pa.string()}
    for batch in batches:
        size = np.cumsum([len(m or b"") for m in batch.column("media").to_pylist()])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + (2 << 20), "right")))
            part = batch.slice(first, last - first)
            got = zip(*_each(part.column("media").to_pylist()), strict=True)
            cols = [pa.array(list(c), t) for c, t in zip(got, types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *types])
            first = last


def from_media(media: DataFrame) -> DataFrame:
    """Adds pcm, samples and offsets (first sample and byte of each block), feature, and error: what doesn't hold in a damaged stream."""
    m = media.select("doc_id", "n_bytes", "media")
    return m.mapInArrow(_decode, "doc_id long, n_bytes long, media binary, pcm binary, samples array<bigint>, offsets array<bigint>, feature string, error string")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """A row for each block: doc_id, block, first_sample, byte_offset and pcm, to be written and sought by sample. A block ends where the next begins."""
    block = F.expr("""transform(samples, (s, i) -> named_struct('block', i, 'first_sample', s, 'byte_offset', offsets[i],
        'pcm', substring(pcm, cast(s as int) + 1, cast(coalesce(get(samples, i + 1), octet_length(pcm)) - s as int))))""")
    return decoded.select("doc_id", F.explode(block).alias("b")).select("doc_id", "b.*")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = from_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(pcm, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
