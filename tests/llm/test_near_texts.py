import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_texts as N
from tests.llm.test_simhash import LOWER, plain_components, plain_fingerprint


def five_word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_one_of_each(rows, prints, radius=N.RADIUS, paired=N.PAIRED):
    """rows (doc_id, text) with distinct ids -> ids kept: of classes of three bits and of links at 0.8 or more; prints: the two fingerprints of each id, or none for all pairs."""
    root = {d: c for d, _, c in plain_components([(d, plain_fingerprint(t)) for d, t in rows])}
    own = sorted((d, five_word_shingles(t)) for d, t in rows)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, s) in enumerate(own):
        for e, t in own[:i]:
            if jaccard(s, t) < 0.8:
                continue
            if prints is None or all((prints[d][x] ^ prints[e][x]) & (1 << 64) - 1 in _within(most, prints[d][x] ^ prints[e][x]) for x, most in ((0, radius), (1, paired))):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d for d, _ in rows if find(d) == d}


def _within(most, x):
    x &= (1 << 64) - 1
    return (x,) if x.bit_count() <= most else ()


def prints_of(docs):
    got = N.X.only(docs, "doc_id", "text").selectExpr("doc_id", "xxhash64(text) th", "text").mapInArrow(N._measure, "doc_id long, th long, fp long, wf long, pf long, n long")
    return {r.doc_id: (r.wf, r.pf) for r in got.collect()}


def texts_of(rng, groups, copies):
    texts = ["", " \t", "one", "one two", "One two three"]
    for _ in range(groups):
        base = [f"w{k}" for k in rng.integers(0, 3000, int(rng.integers(60, 300)))]
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for i in rng.choice(len(w), max(1, int(len(w) * rng.choice([0.004, 0.01, 0.02, 0.06]))), replace=False):
                w[int(i)] = f"changed{rng.integers(0, 9999)}"
            texts.append(" ".join(w))
    return texts


def test_measures_against_plain_ones(spark):
    rng = np.random.default_rng(2)
    texts = texts_of(rng, 3, 3) + ["a b a b a b", "Ä ö ü ß ä Ö x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in N.X.only(docs, "doc_id", "text").selectExpr("doc_id", "xxhash64(text) th", "text").mapInArrow(N._measure, "doc_id long, th long, fp long, wf long, pf long, n long").collect()}
    for d, t in enumerate(texts):
        assert got[d].n == len(five_word_shingles(t))
        assert got[d].fp & (1 << 64) - 1 == plain_fingerprint(t)
    # order doesn't move the fingerprint of words, repeats don't either; both move that of pairs
    same = spark.createDataFrame([(1, "a b c d e f"), (2, "f e d c b a"), (3, "a b c d e f a a a")], "doc_id long, text string")
    p = prints_of(same)
    assert p[1][0] == p[2][0] == p[3][0] and len({p[1][1], p[2][1], p[3][1]}) == 3


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(texts_of(rng, 12, 8), 3))
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, k int, r int, d int").repartition(3)  # clashing names
    got = N.one_of_each(docs)
    assert got.columns == docs.columns
    want = plain_one_of_each(rows, prints_of(docs))
    assert {r.doc_id for r in got.collect()} == want
    # full keys, split and dealt; no leaders worth the name
    assert {r.doc_id for r in N.one_of_each(docs, full=30, leaders=1).collect()} == want
    # of the groups by all pairs, at least nine in ten are whole
    exact = plain_one_of_each(rows, None)
    assert len(want) <= len(exact) + 0.1 * (len(rows) - len(exact))


def test_dense_group_costs_its_size(spark):
    """300 copies that three bits don't fold: far fewer pairs than the group's square, one row left."""
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(300):
        w = list(base)
        for i in rng.choice(200, 2, replace=False):
            w[int(i)] = f"new{k}x{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate([" ".join(base), *texts])), "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in N.one_of_each(docs).collect()] == [0]
    measured = N.X.only(docs, "doc_id", "text").selectExpr("doc_id", "xxhash64(text) th", "text").mapInArrow(N._measure, "doc_id long, th long, fp long, wf long, pf long, n long")
    nodes = measured.select(F.col("wf").alias("fp"), "pf", F.col("th").alias("k"), "n", F.col("th").alias("c"))
    plan = N.S.plan(nodes, N.RADIUS, N.ROW)
    bounds = N.RADIUS, N.PAIRED, N.SIMILARITY
    assert N.led(nodes, plan, bounds, N.LEADERS).count() < 301 * 30
    # of two classes, one of them large, only pairs between these are left
    two = nodes.withColumn("c", F.when(F.col("k") % 100 == 0, F.lit(1)).otherwise(F.lit(2)).cast("long"))
    few = two.where("c = 1").count()
    for full in (10_000, 20):
        got = N.between(two, plan, bounds, full)
        assert got.where("ca = cb").count() == 0 and 0 < got.count() <= few * 301


def test_odd_rows(spark):
    odd = spark.createDataFrame([(None, None), (None, "a b c d e f"), (2, "a b c d e f"), (2, "x y z"), (2, "x y z")], "doc_id long, text string")
    assert sorted(map(str, N.one_of_each(odd).collect())) == sorted(["Row(doc_id=None, text=None)", "Row(doc_id=2, text='a b c d e f')", "Row(doc_id=2, text='x y z')"])
    assert N.one_of_each(odd.where("false")).collect() == []
    # the same words in other orders are candidates of nothing, however many
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    mixed = [(k, " ".join(rng.permutation(words))) for k in range(120)]
    docs = spark.createDataFrame(mixed, "doc_id long, text string")
    assert len(N.one_of_each(docs).collect()) == 120
