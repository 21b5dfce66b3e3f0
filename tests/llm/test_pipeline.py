import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as Q
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import packing, quality, secrets_scan
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_decontaminated(rows, items):
    windows = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[i : i + n]) in windows for w in [words(r[1])] for n in sizes for i in range(len(w) - n + 1))]


def plain_redacted(text):
    base = secrets_scan.base_spans(text)
    spans = [(s, e) for s, _, e in base + secrets_scan.guess_spans(text, base, secrets_scan.Guesser())]
    covered = sorted({i for s, e in spans for i in range(s, e)})
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    assert not covered or covered[0] == min(s for s, _ in spans)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    db = duckdb.connect()
    rows = db.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()
    items = [r[0] for r in db.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    weights = quality.fit(spark, SF, docs)
    score = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        if name == "quality":
            rows = [r for r in rows if score[r[0]] >= 0.3]
        elif name == "near_duplicates":
            keep = {d for d, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows]) if d == c}
            rows = [r for r in rows if r[0] in keep]
        elif name == "decontamination":
            rows = plain_decontaminated(rows, items)
        else:
            rows = [(d, t, a, b, len(t)) for d, t, a, b, _ in ((r[0], plain_redacted(r[1]), *r[2:]) for r in rows)]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
    got = C.STAGES[-1][1](spark, docs, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in rows:
        ids = [*t.encode(r[1], add_special_tokens=False).ids, 0]
        want |= {(r[0], i, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for i, (s, e) in enumerate(packing.cuts(len(ids)))}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2
    assert {tuple(r)[:5] for r in C.run(spark, SF).collect()} == want


def test_odd_rows(spark, tmp_path):
    """Nulls, repeats, extra columns and empty tables pass every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, class string, d int"
    long = "word " * 20_000
    secret = "password=abcdefgh12345678 and text around it, long enough to stand"
    rows = [(1, None, None, None, None, 1, "a", 1), (2, "", "en", "s", 0, 1, "a", 1), (None, secret, None, "s", 3, None, None, None), (None, secret, None, "s", 3, None, None, None), (3, long, "en", None, 5, 1, "", 1), (3, long, "en", None, 5, 2, "", 1), (3, "other text of the same id", "en", None, 5, 2, "", 1)]
    docs = spark.createDataFrame(rows, schema)
    empty = docs.where("false")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "other text"), (7, None), (8, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, empty):
        out = given
        for name, stage in C.STAGES[1:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if given is docs:
            assert got == sorted([(1, None), (None, secret.replace("password=abcdefgh12345678", "[secret]")), (3, long), (3, "other text of the same id")], key=str)
        else:
            assert got == []
        packed = C.pack_sequences(spark, out, str(tmp_path)).collect()
        assert bool(packed) == bool(got)
    weights = quality.fit(spark, str(tmp_path), docs)
    good = C.keep_quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    score = quality.score(docs.withColumn("score", Q.lit(3)), weights).select("doc_id", Q.round("score", 9).alias("s")).collect()
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in score if r.s >= 0.3)
    scored = quality.score(docs, weights).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert C.keep_quality(spark, empty, str(tmp_path)).collect() == []
