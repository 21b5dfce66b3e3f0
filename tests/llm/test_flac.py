import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import flac as M


def bits(*fields):
    s = "".join(f"{v & ((1 << w) - 1):0{w}b}" for v, w in fields)
    return int(s.ljust(-(-len(s) // 8) * 8, "0"), 2).to_bytes(-(-len(s) // 8), "big")


def crc(data, table, width):
    c = 0
    for b in data:
        c = ((c << 8) & ((1 << width) - 1)) ^ int(table[(c >> (width - 8)) ^ b])
    return c


def test_crc_tables():
    assert crc(b"123456789", M._CRC8, 8) == 0xF4 and crc(b"123456789", M._CRC16, 16) == 0xFEE8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.text(max_size=200).map(str.encode), st.integers(0, 5000).map(lambda n: b"ab" * n), st.integers(0, 3000).map(lambda n: bytes(i * i >> 4 & 255 for i in range(n)))), min_size=1, max_size=6))
def test_round_trip(texts):
    payloads = [M.payload(t) for t in texts]
    media = M.encode(payloads)
    assert [g[0] for g in M.decode(media)] == payloads


def test_predictors_are_used_and_help():
    t = np.arange(8192)
    wave = (128 + 90 * np.sin(t / 9)).astype(np.uint8).tobytes()
    (media,) = M.encode([wave])
    assert len(media) < 0.6 * len(wave)
    kinds = {media[p + 6] >> 1 for p in M.decode([media])[0][2]}  # the subframe's head, after a header of six bytes
    assert M.decode([media])[0][0] == wave and 0x20 + M.ORDER - 1 in kinds
    assert M.read_range(media, 5000, 700) == wave[5000:5700]
    assert M.read_range(media, 8190, 50) == wave[8190:]


def test_escaped_partition_and_lpc_by_hand():
    """A frame of 16 samples: linear predictor of order 1 (coefficient 1, shift 1), residuals raw in 4 bits."""
    rng = np.random.default_rng(5)
    res = rng.integers(-8, 8, 15).tolist()
    x = [5]
    for r in res:
        x.append(r + (x[-1] >> 1))
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0x00, 15])
    head += bytes([crc(head, M._CRC8, 8)])
    body = bits((0x20 << 1, 8), (x[0], 8), (3, 4), (1, 5), (1, 4), (0, 2), (0, 4), (15, 4), (4, 5), *[(r, 4) for r in res])
    frame = head + body
    frame += crc(frame, M._CRC16, 16).to_bytes(2, "big")
    y, size, number, end = M.decode_frames(frame, np.array([0]))
    assert size[0] == 16 and number[0] == 0 and end[0] == len(frame) and y[:16, 0].tolist() == x


def test_damage_is_found():
    (media,) = M.encode([M.payload("some words and some more of them " * 99)])
    first = M.stream_info(media)["frames"]
    for at in range(first, len(media), 37):
        with pytest.raises(M.Damaged):
            M.decode([media[:at] + bytes([media[at] ^ 0x10]) + media[at + 1 :]])
    with pytest.raises(M.Damaged):
        M.decode([media[:-9]])


def test_table(spark, tmp_path):
    texts = [None, "", "a", "é" * 63, "x" * 200_000, "two\n\nlines " * 400, "two\n\nlines " * 400]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "n", 0), (2, "a", 0)], "doc_id long, text string, media int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.asDict() for r in M.op6_flac(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == 9
    for r in got:
        if r["doc_id"] is None:
            continue
        p = M.payload(texts[r["doc_id"]] or "")
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["payload_bytes"] == len(p) and r["payload_sha256"] == sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (5, 6)}) == 1
    blocks = M.pcm_blocks(M.from_media(M.to_media(docs))).where("doc_id = 5").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == M.payload(texts[5]) and [b.first_sample for b in blocks] == list(range(0, 4416, 1024))
    assert M.from_media(M.to_media(docs.where("false"))).collect() == []


def test_rice_codes_of_any_length():
    """Short codes come from one word, a lane with a long one from several: both give what the bits say."""
    rng = np.random.default_rng(4)
    for longest in (3, 40, 400):
        r = rng.integers(0, 15, 200)
        high = rng.integers(0, longest, 200)
        low = rng.integers(0, 1 << 15, 200) & ((1 << r) - 1)
        codes = ["0" * h + "1" + (format(v, f"0{k}b") if k else "") for h, v, k in zip(high.tolist(), low.tolist(), r.tolist(), strict=True)]
        at = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        data = bits(*[(int(c, 2), len(c)) for c in codes])
        ones, value = M._Reader(data).rice(at[:-1], r)
        assert (ones == high + 1).all() and (value == (high << r | low)).all()
