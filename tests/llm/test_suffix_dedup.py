import hashlib
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup as S


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=120), st.lists(st.integers(0, 255), max_size=60), st.lists(st.sampled_from([7, 7, 7, 9]), max_size=80)))
def test_two_stage_is_a_suffix_array(values):
    t = np.array(values, np.uint8)
    got = S.two_stage(t, max(len(t), 1)).tolist()
    assert got == sorted(range(len(t)), key=lambda i: bytes(t[i:]))
    want = [0] + [next((k for k in range(len(t)) if a + k >= len(t) or b + k >= len(t) or t[a + k] != t[b + k]), 0) for a, b in zip(got[1:], got[:-1], strict=True)]
    if 0 not in values:  # a byte 0 equals the padding
        assert S.adjacent_prefixes(t, np.array(got, np.int64), 1000).tolist()[: len(t)] == (want if len(t) else [])


def brute(rows):
    """rows (doc_id or None, text) -> (doc_id, n_bytes, n_removed, n_spans, sha)"""
    order = lambda d: S.LAST if d is None else d
    first = {}
    data = [(order(d), (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, _), (o, b) in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < o:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("slice_bytes", "hot", "keys", "remembered"), [(400, 10**6, 1, 1), (400, 2, 10**6, 10**6), (1 << 20, 2, 10**6, 3), (400, 3, 20, 30)])
def test_against_brute_force(spark, tmp_path, slice_bytes, hot, keys, remembered):
    rng = np.random.default_rng(6)
    words = ["the", "of", "straße", "and", "é", "token", "aaaa", "to", "☃", "x"]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    passage = "a passage that many texts of this small collection share, letter for letter, over some hundred bytes"
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 400, passage, passage[:50], passage[1:50], passage[-50:]]
    for i in range(60):
        t = base[int(rng.integers(12))]
        k = int(rng.integers(4))
        if k == 0:
            texts.append(t)
        elif k == 1:
            a = int(rng.integers(100))
            texts.append(t[a : a + 90] + f" {i} " + base[int(rng.integers(12))][a : a + 60])
        elif k == 2:
            texts.append(f"{i} " + passage + t[:40] + passage)
        else:
            texts.append(" ".join(rng.choice(words, 30)) + passage[: int(rng.integers(40, 80))])
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts, strict=True)) + [(ids[7], passage), (ids[30], passage + "again"), (None, passage), (None, texts[40])]
    spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, doc int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in S._digest(S.repeated_strings(docs, hot, keys, remembered, slice_bytes)).collect()), key=str)
    assert got == brute(rows)
    got = sorted((tuple(r) for r in S.op2_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op2_suffix_dedup(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("many", [64, 2])
def test_copies_of_one_text(spark, monkeypatch, many):
    """Of 3,000 copies one row goes on to the search, and the result is that of brute force."""
    monkeypatch.setattr(S, "MANY", many)
    text = "A passage of more than fifty bytes, é, which very many documents hold as it is."
    rows = [(i, text) for i in range(10, 3010)] + [(3, "x " + text[:60]), (4000, text + " and more"), (4001, "short"), *[(5000 + i, "short, too") for i in range(100)], (None, text), (None, text), (10, text), (7, None)]
    rng = np.random.default_rng(4)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(None if d is None else int(d), t) for d, t in rows], "doc_id long, text string").repartition(6)
    own = docs.select(F.coalesce("doc_id", F.lit(S.LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    rest, copies = S.split_copies(own)
    assert rest.where(F.col("text") == text).count() == 2 and copies.where(F.col("text") == text).count() == 3001  # document 10 has two rows
    assert rest.count() + copies.count() == len(rows)
    got = sorted(((S.LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S._digest(S.repeated_strings(docs)).collect()), key=str)
    want = sorted(((S.LAST if d is None else d, *rest_) for d, *rest_ in brute([(None if d is None else int(d), t) for d, t in rows])), key=str)
    assert got == want


def test_suffix_array_over_stretches_that_share_an_anchor(monkeypatch):
    """A stretch that only equal ones share an anchor with is settled by its smallest document; no suffix array is built over it."""
    searched = []
    plain = S.smallest_owner
    monkeypatch.setattr(S, "smallest_owner", lambda pieces, *a: searched.extend(pieces) or plain(pieces, *a))
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 40 * 60).astype(np.uint8)
    n = np.full(40, 60)
    doc = np.arange(40)
    # texts 0 to 29 are alone; 30 to 34 have copies; 35 to 39 are 60 bytes around one string of 55 bytes
    first = np.arange(40) * 60
    for k in range(35, 40):
        text[60 * k + k - 35 : 60 * k + k + 20] = text[60 * 35 : 60 * 35 + 55]
    first = np.concatenate([first, first[30:35]])
    doc, n = np.concatenate([doc, np.arange(100, 105)]), np.concatenate([n, n[30:35]])
    order = rng.permutation(45)
    rows = S._stretches(np.zeros(45, np.int64), doc[order], np.zeros(45, np.int64), np.full(45, 7), n[order], text, first[order])
    got = S._repeats(pa.Table.from_batches(list(rows)))
    assert sorted(searched) == sorted(text[60 * k : 60 * k + 60].tobytes() for k in range(35, 40))
    spans = {d: s for d, s in zip(got.column("doc").to_pylist(), got.column("spans").to_pylist(), strict=True)}
    want = {d: (7, 60) for d in range(100, 105)} | {k: (7 + k - 35, 55) for k in range(36, 40)}
    assert {d: tuple(np.frombuffer(s, np.uint32).tolist()) for d, s in spans.items()} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**63 - 1), max_size=5), min_size=1, max_size=6))
def test_byte_planes(cells):
    values = np.array([x for c in cells for x in c], np.int64)
    start = np.cumsum([0] + [len(c) for c in cells])[:-1]
    got, n = S._unplaned(S._planes(values, start), np.int64)
    assert got.tolist() == values.tolist() and n.tolist() == [len(c) for c in cells]


def test_anchors_go_out_in_four_bytes(spark):
    rng = np.random.default_rng(7)
    rows = [(i, bytes(rng.integers(97, 123, 3000).astype(np.uint8)).decode()) for i in range(8)]
    own = spark.createDataFrame(rows, "th long, text string").mapInArrow(S._emit_anchors(16, 1 << 20), "bucket long, th binary, count binary, low binary, kind int").collect()
    texts = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    n = len(S.anchors(texts, np.arange(9) * 3000)[0])
    assert sum(len(r.low) for r in own) <= 4 * n


@pytest.mark.parametrize("most", [S.COPIED, 1])
def test_texts_that_share_a_doc_id(spark, monkeypatch, most):
    """Rows are told apart by doc_id where that is enough, else by their text too."""
    monkeypatch.setattr(S, "COPIED", most)
    text = "A passage of more than fifty bytes, é, which several documents hold as it is."
    rows = [(1, text), (2, "x " + text), (2, text + " y"), (3, text), (None, "z " + text), (None, text), (4, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = docs.select(F.coalesce("doc_id", F.lit(S.LAST)).alias("doc"), F.xxhash64("text").alias("th"))
    told = S.with_ties(own).collect()
    assert len(told) == len(rows) and all(r.tie == (r.th if most == 1 or r.doc in (2, S.LAST) else 0) for r in told)
    assert sorted((tuple(r) for r in S._digest(S.repeated_strings(docs)).collect()), key=str) == brute(rows)


def test_shuffle_files_go_before_the_last_join(spark):
    """The shuffles of anchors and of stretches don't stay on disk while texts and their repeats are joined."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def sizes():
        found = [f for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f]
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    before = sizes()
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2((F.col("id") % 500).cast("string"), 256), 2).alias("text"))
    out = S.repeated_strings(docs)
    left, until = {}, time.time() + 20
    while time.time() < until:
        left = {f: n for f, n in sizes().items() if f not in before}
        if sum(left.values()) < 10_000:  # anchors, texts and stretches are more than that each
            break
        time.sleep(0.2)
    assert sum(left.values()) < 10_000, left
    assert out.where("n_removed = 128").count() == 1500
