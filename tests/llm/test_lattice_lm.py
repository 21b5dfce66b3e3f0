import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lattice_lm as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def all_paths(pieces, word):
    """The weight of every segmentation, one by one."""
    if not word:
        return 1.0
    return sum(math.exp(pieces.scores[k]) * all_paths(pieces, word[len(p) :]) for p, k in pieces.index.items() if word.startswith(p))


def toy():
    p = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab", b"bc", b"abc", b"ca"]
    s = np.random.default_rng(4).random(len(p) + 1)
    return L.Pieces(p, np.log(s / s.sum()))


def test_marginals_add_all_segmentations():
    pieces = toy()
    words = [b"a", b"abc", b"abcabcab", b"xyz", b"cab"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    got = pieces.marginals(buf, np.cumsum(size) - size, size)
    for w, g in zip(words, got, strict=True):
        want = math.log(all_paths(pieces, b" " + w)) + pieces.scores[-1]
        assert g == pytest.approx(want) and pieces.one(b" " + w) == pytest.approx(want)


def test_expected_uses_add_up():
    pieces = toy()
    words = np.frombuffer(b" abcab cabca", np.uint8).reshape(2, 6).astype(np.uint64)
    uses = pieces.expected(words, np.array([2.0, 3.0]))
    assert uses[-1] == 5
    assert sum(u * len(p) for u, p in zip(uses, pieces.pieces, strict=False)) == pytest.approx(6 * 5)


def test_expected_uses_of_one_word():
    pieces = toy()
    for word in (b" abcab", b" x", b" " + b"abc" * 15):
        words = np.frombuffer(word, np.uint8)[None].astype(np.uint64)
        got = np.zeros(len(pieces.scores))
        pieces.add_expected(word, got)
        assert got == pytest.approx(pieces.expected(words, np.ones(1)))


def plain_logs(pieces, uses):
    begin = sum(u for p, u in zip(pieces, uses, strict=False) if p.startswith(b" "))
    rest = sum(uses) - begin
    return [math.log(u / (begin if k < len(pieces) and pieces[k].startswith(b" ") else rest)) for k, u in enumerate(uses)]


def test_long_words_train(spark):
    """A piece that only a word longer than TOGETHER bytes uses gets evidence."""
    from pyspark.sql import functions as F

    first = L.vocabulary()
    long = "information" * 200
    assert len(long) > L.TOGETHER
    docs = spark.createDataFrame([("the cat", True), (long, True)], "text string, train boolean")
    model, _ = L.learn(docs.select("train", F.col("text")), rounds=1)
    want = np.full(len(first.scores), L.FLOOR)
    for w in (b" the", b" cat", b" " + long.encode()):
        first.add_expected(w, want)
    assert model.pieces.scores == pytest.approx(plain_logs(first.pieces, want))
    for pieces in (first, model.pieces):  # two distributions: what begins a word, and what goes on or ends it
        p = np.exp(pieces.scores)
        begins = np.array([x.startswith(b" ") for x in pieces.pieces] + [False])
        assert p[begins].sum() == pytest.approx(1) and p[~begins].sum() == pytest.approx(1)
    assert want.sum() - L.FLOOR * len(want) > 200


@pytest.mark.parametrize("head", [0, 1 << 18])
def test_table(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    rng = np.random.default_rng(8)
    texts = [None, "", " \n ", "The the THE", "É é", "x" * 5000, "q" * 60 + " the", "never\x00seen ☃"] + [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 60) % 500) for _ in range(40)]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(4, "again the", 1), (None, "the none", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, c int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = Counter(w for _, t, _ in train for w in [*words_of(t), "<end> "])
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(d), d is not None and zlib.crc32(str(d).encode()) % 5 == 1, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
        for d, t, _ in rows
        for ws in [[*words_of(t), "<end> "]]
    )
    out = L.op1_lattice_lm(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    # the score, word by word
    docs = spark.createDataFrame([(t, True) for _, t, _ in train], "text string, train boolean")
    from pyspark.sql import functions as F

    model, _ = L.learn(docs.select("train", F.coalesce("text", F.lit("")).alias("text")))
    for r in out:
        if r.doc_id is None or r.doc_id == 4:
            continue
        s = model.end()[1]
        for w in words_of(texts[r.doc_id]):
            paths = model.left + model.pieces.one(b" " + w.encode()) / math.log(10)
            whole = max(count[w] - L.DISCOUNT, 0) / model.n
            s += math.log10(whole + 10**paths) if whole else paths
        assert r.score == pytest.approx(s, rel=1e-9)


def test_no_training_texts(spark, tmp_path):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    spark.createDataFrame([(held, "some words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = L.op1_lattice_lm(spark, str(tmp_path)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert L.op1_lattice_lm(spark, str(tmp_path)).collect() == []
