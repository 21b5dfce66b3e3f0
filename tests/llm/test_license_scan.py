import re

import numpy as np
import pytest

from tessera.llm import license_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, templates):
    """Every window against every template."""
    own, out = shingles(text), {}
    for name, t in templates.items():
        want = set(shingles(t))
        m = S.size_class(len(want))
        for lo in range(0, len(own), m):
            share = len(want & set(own[lo : lo + 2 * m])) / len(want)
            if share >= 0.8:
                out[name] = max(out.get(name, 0), share)
    return out


def test_bands_reach_the_bound():
    j = S.least_similarity()
    assert (1 - j) ** S.bands(j) <= S.MISS < (1 - j) ** (S.bands(j) - 1)


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    filler = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 300, n))
    texts = [None, "", "Released under the MIT", "Released under the MIT License.", "É " * 3000]
    for name, t in S.TEMPLATES.items():
        texts += [t, f"{filler(37)} {t.upper()} {filler(5)}", f"{filler(9)}\n# {t}\n{filler(400)}\n{t}"]
        w = t.split()
        for k in (1, 2, 5):  # words changed: some stay above the bound, some fall below
            v = list(w)
            for i in rng.choice(len(v), min(k, len(v)), replace=False):
                v[int(i)] = "changed"
            texts.append(f"{filler(11)} {' '.join(v)} {filler(13)}")
        texts.append(f"{filler(11)} {' '.join(w[: len(w) * 9 // 10])} {filler(3)}")
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, texts[3], "y")]
    spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op10_licenses(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute(texts[3 if r.doc_id is None else r.doc_id], S.TEMPLATES)
        assert r.licenses == ",".join(sorted(want)) and r.n_licenses == len(want) and r.containment == pytest.approx(max(want.values(), default=0.0))


def test_span_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f Released under the MIT License. g h")], "doc_id long, text string")
    (r,) = S.find_licenses(docs).collect()
    assert [(x.license, x.start, x.end) for x in r.found] == [("MIT", 6, 11)]
    assert S.find_licenses(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        S.Templates({"short": "only four words here"})


def test_every_occurrence(spark):
    mit, bsd = S.TEMPLATES["MIT-text"], S.TEMPLATES["BSD-2-Clause-text"]
    half = " ".join(mit.split()[:80])
    text = f"{half} first {mit} {mit}\nthen {bsd} {bsd} {'and more ' * 500} {mit}"
    (r,) = S.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    words = WORD.findall(text.translate(LOWER))
    for name, times in (("MIT-text", 3), ("BSD-2-Clause-text", 2)):
        own = WORD.findall(S.TEMPLATES[name].translate(LOWER))
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        assert [(x.start, x.end, x.containment) for x in r.found if x.license == name] == [(i, i + len(own), 1.0) for i in at] and len(at) == times


def test_recall_with_many_templates(spark):
    rng = np.random.default_rng(4)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    templates = {f"T{k:03d}": " ".join(some(int(rng.integers(9, 400)))) for k in range(200)}
    rows = []
    for i in range(300):
        words = some(30)
        for t in rng.choice(sorted(templates), 3):
            w = templates[t].split()
            for j in rng.choice(len(w), len(w) // 60):
                w[j] = "changed"
            words += w + some(int(rng.integers(0, 40)))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, x.license) for r in S.find_licenses(docs, templates).collect() for x in r.found}
    sets = {t: set(shingles(x)) for t, x in templates.items()}
    want = set()
    for i, text in rows:
        own = shingles(text)
        for t, x in sets.items():
            m = S.size_class(len(x))
            if x & set(own) and any(len(x & set(own[lo : lo + 2 * m])) >= 0.8 * len(x) for lo in range(0, len(own), m)):
                want.add((i, t))
    assert len(want) > 400 and got <= want and len(got) >= 0.99 * len(want)
