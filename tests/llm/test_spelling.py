"""Spelling variants against a plain statement of the rule, and against the SQL twin."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling as S


def apart(a, b):
    """Whether one edit makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_words(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(words):
    out, form = [], {}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    stems = ["letters", "Strasse", "straßeÿ", "ÉLÈVESés", "aaaaaaa", "aaaaaaaa", "abababab", "x" * 40]
    out = []
    for d in range(400):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(stems) if rng.random() < 0.8 else stems[0]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(w) + 1), rng.choice("abé")
                w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            words.append(w)
        out.append((d, rng.choice([" ", ", ", "\n", "×" if d % 2 else "-", "1"]).join(words)))
    return [*out, *out[:3], (None, "letters letters letterz letterz"), (None, None), (900, ""), (901, None), (902, "Łletters " * 3)]


def test_against_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("w"), "id": F.lit(1), "n": F.lit(2), "key": F.lit("k")})
    got = rows(S.variants(S.counted(S.runs(df).select(S.misspelt(F.col("run"), F.col("doc_id")).alias("word")))))
    words = brute_words(docs)
    assert len(words) > 100 and got == brute(words)
    assert any(r[1] and r[1] != r[2] for r in got), "no path of two forms"


def test_query_and_twin(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    twin = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({S.ORACLE})").fetchall()
    assert rows(S.op13_spelling(spark, str(tmp_path))) == sorted(twin, key=str)


def test_long_words(spark):
    """Words of 100,000 letters: n short keys each, not n copies."""
    rng = random.Random(1)
    w = "".join(rng.choice("abcdefg") for _ in range(100_000))
    counts = [(w, 100), (w[:50_000] + w[50_001:], 10), (w[:-1] + "é", 1), (w[:7] + "zz" + w[9:], 5), (w[2:], 3), ("ordinary", 50)]
    got = {r[0]: r for r in rows(S.variants(spark.createDataFrame(counts, "word string, n long")))}
    assert got[counts[1][0]][1:] == (w, w, 10, 1, 100) and got[counts[2][0]][1:] == (w, w, 1, 1, 100)
    assert got[w][4] == 2 and got[counts[3][0]][4] == got[counts[4][0]][4] == got["ordinary"][4] == 0


def test_chains_and_ties(spark):
    counts = [("aaaaaaa", 10**6), ("aaaaaaab", 10**5), ("aaaaaabb", 10**4), ("aaaaabbb", 10**3), ("aaaabbbb", 100), ("aaabbbbb", 10), ("aabbbbbb", 1), ("zeilenx", 20), ("zeileny", 20), ("zeilenz", 2), ("zeilené", 20)]
    got = {r[0]: r for r in rows(S.variants(spark.createDataFrame(counts, "word string, n long")))}
    assert got["aabbbbbb"][1:3] == ("aaabbbbb", "aaaaaaa") and got["aaaaaaa"][1:3] == (None, "aaaaaaa")
    assert got["zeilenz"][1:] == ("zeilenx", "zeilenx", 2, 3, 20)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(S.variants(S.counted(S.runs(empty).select(F.col("run").alias("word"))))) == []
