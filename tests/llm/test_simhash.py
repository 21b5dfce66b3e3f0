import re

import numpy as np
import xxhash

from tessera.llm import simhash as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (doc_id, fingerprint)"""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def test_texts(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 400, n)) for n in (0, 1, 2, 3, 40, 200, 5000)]
    texts = [None, "", " \t\n", "Ä b C", "ä B c", "x" * 100_000, *base, *[t.upper() for t in base]]
    for t in base[4:6]:
        for _ in range(15):  # near copies: a word or two changed
            w = t.split()
            w[int(rng.integers(len(w)))] = "changed"
            texts.append(" ".join(w))
    rows = [(i + 5, t, i) for i, t in enumerate(texts)] + [(5, None, 0), (9, "x" * 100_000, 1), (None, "Ä b C", 2), (None, "only here alone now", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)  # fp: a clashing name
    got = sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t, _ in rows])


def test_dense_group_is_split_and_whole(spark):
    """Fingerprints around few centres: far more to a key than `full`, which forces splits."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(220):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = {i: np.uint64(f).astype(np.int64).item() for i, f in rows}
    nodes = spark.createDataFrame([(f,) for f in signed.values()], "fp long").repartition(3)
    from tessera.llm._spark import components

    got = {r.id: r.component for r in components(S.links(nodes, full=16)).collect()}
    least = {}
    for i, f in signed.items():
        least[got.get(f, f)] = min(least.get(got.get(f, f), i), i)
    assert sorted(((i, f"{f:016x}", least[got.get(signed[i], signed[i])]) for i, f in rows), key=str) == plain_components(rows)


def test_thresholds_follow_candidates():
    cost, t = S.thresholds([0.0, 0.0, 0.0, 0.0], [16] * 4, 3)
    assert t == [0, 0, 0, 0] and cost == 4
    assert S.thresholds([1e9, 0.0, 0.0], [20] * 3, 3)[1][0] == -1  # a group whose keys are shared by all is left out
    for m in (2, 3, 4, 5):
        assert sum(x + 1 for x in S.thresholds([1.0] * m, [64 // m] * m, 3)[1]) == 4


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []
