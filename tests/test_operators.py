"""Goldens worked out by hand, and invariants, of operators that SQL can't state."""

import datetime
import hashlib
import math
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import money
from tessera.functions import text as T
from tessera.operators import analytics as A
from tessera.operators import bloom as B
from tessera.operators import boost as BO
from tessera.operators import gates as G
from tessera.operators import hierarchy as H
from tessera.operators import markdown as M
from tessera.operators import orchestration as O
from tessera.operators import progress as P
from tessera.operators import quantised as QU
from tessera.operators import retrieval as R
from tessera.operators import semantic_cache as SC
from tessera.operators.scope import Actor, Forbidden, chunk_filter, require_tenant
from tessera.sources.manifest import BlobStore
from tessera.streaming import jobs


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_sections_preface_dropped_reused_fallback():
    s = M.parse_sections("intro\n\n# A\n## B\ntext b\n# C\n### D\ntext d\n## E\ntext e")
    assert [(x["section_id"], x["title"], x["parent_section_id"], x["breadcrumb"]) for x in s] == [
        ("sec-0000", "Giới thiệu", None, ["Giới thiệu"]),
        ("sec-0001", "B", "sec-0001", ["B"]),  # A had no body, so its number came again, and it isn't told from B
        ("sec-0002", "D", "sec-0002", ["D"]),
        ("sec-0003", "E", "sec-0002", ["C", "E"]),
    ]
    strict = M.parse_sections("# A\n## B\ntext b", strict_ids=True)
    assert [(x["section_id"], x["parent_section_id"]) for x in strict] == [("sec-0001", "sec-0000")]
    assert [(x["title"], x["level"], x["content"]) for t in ("", None) for x in M.parse_sections(t)] == [("Nội dung", 1, "")] * 2
    assert [(x["title"], x["level"], x["content"]) for x in M.parse_sections("one\n\n two\n  ## In # it ##  \nbody")] == [("Giới thiệu", 1, "one\n two"), ("In # it ##", 2, "body")]
    assert [x["content"] for x in M.parse_sections("# only\n## headings")] == ["# only\n## headings"]
    coded = M.parse_sections("# 1.2) Title\nbody")
    assert (coded[0]["section_code"], coded[0]["section_id"]) == ("1.2", "sec-1-2-0000")


def test_local_sections(spark):
    texts = ["| a | b |\n\n# A\n### C\ntext\n## B\n| x |\n### D\n#no heading\n# Z", "", None, "\nx", "### c\n## b\n#### d\n# a\n### e\n## f\n### g"]
    rows = M.local_sections(spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")).orderBy("document_id", "order_index").collect()
    of = lambda d: [(x.section_id, x.title, x.level, x.parent_section_id, x.breadcrumb, x.content, x.table_count) for x in rows if x.document_id == d]
    assert of(0) == [
        ("sec_0000", "| a | b |...", 1, None, [], "| a | b |\n\n", 1),
        ("sec_0001", "A", 1, None, ["A"], None, 0),
        ("sec_0002", "C", 3, None, ["A", "C"], "text\n", 0),
        ("sec_0003", "B", 2, "sec_0001", ["A", "B"], "| x |\n", 1),
        ("sec_0004", "D", 3, "sec_0003", ["A", "B", "D"], "#no heading\n", 0),
        ("sec_0005", "Z", 1, None, ["Z"], None, 0),
    ]
    assert of(1) == of(2) == [] and [x[1] for x in of(3)] == ["Phần mở đầu"]
    assert [(x[1], x[3], x[4]) for x in of(4)] == [("c", None, ["c"]), ("b", None, ["b"]), ("d", None, ["b", "d"]), ("a", None, ["a"]), ("e", None, ["a", "e"]), ("f", "sec_0003", ["a", "f"]), ("g", "sec_0005", ["a", "f", "g"])]


def test_blocks_and_chunks(spark):
    blocks = lambda t: one(spark, M.split_blocks(F.lit(t)))
    assert blocks("para one\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\n- x\n- y\n- z\nafter\nmore\n\nlast") == ["para one", "| a | b |\n| - | - |\n| 1 | 2 |", "- x", "- y", "- z\nafter\nmore", "last"]
    # a blank line right after an item belongs to it; a bar in a formula is no table, and - alone no item
    assert blocks("1. x\n\nnext\n\n |p| < q \nr\n-\n  + y") == ["1. x\n\nnext", " |p| < q \nr\n-", "  + y"] and blocks("") == blocks("\n \n") == []
    assert M.chunk_units(["aaaa", "bbbb", "cccc"], 9, 4) == ["aaaa bbbb", "bbbb cccc"]
    assert M.chunk_units(["aaaa", "b" * 20, "cc"], 9, 4) == ["aaaa", "b" * 20, "cc"]
    table = "| r | c |\n" * 300
    docs = spark.createDataFrame([(1, "start. " + "\n\n" + table + "\nend of it."), (2, None), (3, "short")], "document_id long, text string")
    got = M.chunks(docs).collect()
    assert any(c.text.count("| r | c |") == 300 for c in got if c.document_id == 1)
    assert [c.text for c in got if c.document_id > 1] == ["", "short"]


def test_token_spans():
    cut = lambda t, size, overlap=0, count=len: [t[a:b] for a, b in M.token_spans(t, size, overlap, count)]
    assert cut("One. Two.\n\n\nThree", 12) == ["One. Two.\n\n\n", "Three"]  # paragraphs
    assert cut("One two. Three four. Five", 12) == ["One two. ", "Three four. ", "Five"]  # sentences
    assert cut("alpha, beta, gamma", 8) == ["alpha,", " beta,", " gamma"]  # clauses
    assert cut("alpha beta gamma", 6) == ["alpha ", "beta ", "gamma"]  # words
    assert cut("x" * 20, 6) == ["xxxxx"] * 4 and cut("", 5) == []  # halves
    assert cut("aa bb cc dd ee ", 9, 3) == ["aa bb cc ", "cc dd ee "]  # the last piece comes again
    assert cut("aa bbbbbbb cc ", 9, 3) == ["aa ", "bbbbbbb ", "cc "]  # unless the next would not fit then
    text = "".join(f"Sentence {i} has words; and more, of them. " * (1 + i % 3) for i in range(200)) + "y" * 9000
    spans = M.token_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < d <= b < e for (a, b), (d, e) in zip(spans, spans[1:])) and all(M.estimated_tokens(text[a:b]) <= 1024 for a, b in spans)


def test_index_chunks(spark):
    long = "A sentence of some words. " * 400
    rows = [(1, "s", "T", "H", None, " short \n"), (2, "s", "T", "H", "T > H", long), (3, "s", "T", "H", None, " \n"), (4, "s", None, None, None, None)]
    got = M.index_chunks(spark.createDataFrame(rows, "document_id long, section_id string, document_title string, heading string, breadcrumb string, content string")).orderBy("document_id", "chunk").collect()
    assert [(r.document_id, r.chunk) for r in got] == [(1, 0), *[(2, i) for i in range(len(got) - 1)]] and len(got) > 3
    assert got[0].text == "[Tài liệu: T | Mục: H]\nĐường dẫn: H\n\nshort" and got[0].window == "short"
    assert all(r.text == "[Tài liệu: T | Mục: H]\nĐường dẫn: T > H\n\n" + r.window for r in got[1:])


def test_sentences(spark):
    cut = lambda t: one(spark, M.split_sentences(F.lit(t)))
    assert cut("See e.g. this. And that!  Done?") == ["See e.g. this.", "And that!", "Done?"]
    assert cut("第一。第二。 third.") == ["第一。", "第二。", "third."] and cut("Dr.\n X. etc.") == ["Dr. X.", "etc."]


def test_rerank_keeps_what_fails(spark):
    rows = [(q, question, p, t, s) for q, question in ((1, "good"), (2, "fail"), (3, "few")) for p, t, s in ((1, "bb", 0.9), (2, "good", 0.8), (3, " ", 0.7))]
    hits = spark.createDataFrame(rows, "query_id long, question string, place long, text string, score double")

    def embed(texts):
        if texts[0] == "fail":
            raise RuntimeError
        out = [[float(t.count("o")), float(t.count("b")), float(t == " ")] for t in texts]
        return out[:-1] if texts[0] == "few" else out

    got = {}
    for r in O.reranked(hits, embed, 2).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.text, r.score))
    assert got == {1: [("good", 1.0), ("bb", 0.0)], 2: [("bb", 0.9), ("good", 0.8), (" ", 0.7)], 3: [("bb", 0.9), ("good", 0.8)]}


def test_skip_reasons(spark):
    f = lambda text, n, top, second: one(spark, O.skip_reason(F.lit(text), F.lit(n), F.lit(top), F.lit(second).cast("double")))
    assert [f("q", 1, 0.5, None), f("q", 2, 0.5, 0.0), f("q", 2, 0.5, 0.3), f("q", 2, 0.5, 0.4), f("q", 2, 0.0, 0.0)] == ["single", "no-second", "dominant", None, None]
    assert f("x" * 49, 1, 0.5, None) is None and f("a b c d e f g h i", 1, 0.5, None) is None and f("q", 0, None, None) is None


def test_clean(spark):
    text = "Title\n12\nPage 4\n- 5 -\n3 // 9\nFooter 1\nChapter ........ 7\na\n\n\t\n\nb"
    assert one(spark, M.clean(F.lit(text), ("Foo.er",))) == "Title\n12\na\n\nb"
    assert one(spark, M.clean(F.lit("\n \n\nx\n\n\n"))) == "\nx\n"
    lines = "\n".join(f"line {i}\n\n" for i in range(40_000))
    began = time.time()
    assert spark.createDataFrame([(lines,)], "t string").select(F.length(M.clean(F.col("t"))).alias("n")).first().n == len(lines) - 40_000
    assert time.time() - began < 20  # a quadratic form took 22 s for a tenth of the lines


def emitted(events, step=5.0):
    """The rule of throttled progress, as a fold."""
    out, last = [], None
    for stage, percent in events:
        go = last is None or stage != last[0] or percent - last[1] >= step or percent >= 100 or percent <= 0
        out.append(go)
        last = (stage, percent) if go else last
    return out


def test_progress(spark):
    assert emitted([("a", 0), ("a", 3), ("a", 6), ("b", 7), ("b", 9), ("b", 100)]) == [True, False, True, True, False, True]
    rng = random.Random(4)
    logs = {"one": [("a", float(i % 90) / 3 + 1) for i in range(900)], None: [], "x": [], "": [("b", 50.0), (None, 51.0), (None, 52.0)]}
    for key in (None, "x"):
        p = 0.0
        for _ in range(700):
            p = rng.choice([p + rng.random(), p + rng.random(), p - 2, rng.random() * 100, 100.0, 0.0] if rng.random() < 0.1 else [p + rng.random() * 0.3])
            logs[key].append((rng.choice("ab") if rng.random() < 0.02 else "a", p))
    rows = [(k, i, 1000 * j + i, s, p) for j, (k, log) in enumerate(logs.items()) for i, (s, p) in enumerate(log)]
    df = spark.createDataFrame(rows, "key string, ts int, event_id long, stage string, percent double").repartition(3)
    want = sorted(((k, 1000 * j + i, e) for j, (k, log) in enumerate(logs.items()) for i, e in enumerate(emitted(log))), key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for block in (512, 7):
        assert sorted(map(tuple, P.throttled(df, block=block).collect()), key=str) == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_progress_of_one_task_in_many(spark):
    df = spark.range(20_000).select(F.lit("t").alias("key"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.lit("s").alias("stage"), (F.col("id") % 99 + 0.5).alias("percent")).repartition(8)
    set_ = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in set_.items():
        spark.conf.set(k, v)
    parts = [r.n for r in P.throttled(df).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    for k in set_:
        spark.conf.unset(k)
    assert sum(parts) == 20_000 and len(parts) > 1 and max(parts) < 15_000


def test_sliding_window_counts_admitted_only():
    assert G.admit([0, 10, 20, 1000, 1001, 1010], 1000, 2) == [True, True, False, True, False, True]
    assert G.admit([5, 5, 5, 6, 7], 100, 2) == [True, True, True, True, False]  # one entry a millisecond


def test_sliding_window_in_buckets(spark):
    """Bursts, pauses and equal times of several keys, with limits that are reached; a null key too."""
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(4000):
        t += rng.choice([0, 1, 3, 10, 40]) if rng.random() < 0.97 else rng.choice([500, 1000, 5000])
        rows.append((rng.choice([1, 1, 1, 2, None]), i, datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=t)))
    df = spark.createDataFrame(rows, "k long, event_id long, ts timestamp_ntz").repartition(5)
    for window, limit in ((100, 3), (1000, 20), (50, 0), (7, 1)):
        want = {}
        for k in (1, 2, None):
            own = sorted((int((ts - datetime.datetime(1970, 1, 1)) / datetime.timedelta(milliseconds=1)), i) for key, i, ts in rows if key == k)
            want |= dict(zip([i for _, i in own], G.admit([ms for ms, _ in own], window, limit), strict=True))
        got = {r.event_id: r.allowed for r in G.sliding_window(df, "k", window, limit).collect()}
        assert got == want and (limit == 0 or 0 < sum(want.values()) < len(rows))


def test_sliding_window_batch_equals_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 5).alias("key"), "event_id", "ts")
    want = sorted(map(tuple, G.sliding_window(e, "key", 7_200_000, 2).collect()))
    plain = []
    rows = sorted((r.key, r.ms, r.event_id) for r in e.select("key", "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts)").alias("ms")).collect())
    for k in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == k]
        plain += [(k, i, t, a) for (_, t, i), a in zip(own, G.admit([t for _, t, _ in own], 7_200_000, 2), strict=True)]
    assert want == sorted(plain)
    jobs.sliding_window_stream(jobs.files(spark, "/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 5).alias("key"), "event_id", "ts"), str(tmp_path), 7_200_000, 2)
    assert sorted(map(tuple, jobs.result(spark, str(tmp_path)).collect())) == want


def test_counter_floor(spark):
    e = spark.createDataFrame([("a", i, i, d) for i, d in enumerate([1, -1, -1, -1, 1, 1, -1])], "key string, ts int, event_id int, delta int")
    assert G.floored_counter(e, "key").first().n == 1


def test_query_forms(spark):
    n = lambda s: one(spark, T.normalise_query(F.lit(s)))
    assert n("Could you  ÉTABLIR,  the  Rapport?") == "établir rapport" and n("the of") == ""
    h = lambda s: one(spark, T.query_hash(F.lit(s)))
    assert h("the, of!") == hashlib.sha256(b"the of").hexdigest() and h("  ") is None
    assert one(spark, T.uuid5(F.lit("doc/1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc/1"))


@pytest.mark.parametrize(("micros", "text", "vnd"), [(0, "0", 0), (1, "0.000001", 0), (499_999, "0.499999", 0), (500_000, "0.5", 1), (-1_500_000, "-1.5", -2), (12_000_000, "12", 12)])
def test_money(spark, micros, text, vnd):
    m = F.lit(micros).cast("long")
    assert one(spark, money.decimal_string(m)) == text and one(spark, money.rounded_vnd(m)) == vnd


def test_cosine_edges(spark):
    a = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, R.cosine(a(0, 0), a(1, 1))) == 0.0 and one(spark, R.cosine(a(1), a(1, 1))) == 0.0 and one(spark, R.cosine(a(3, 4), a(3, 4))) == pytest.approx(1.0)


def test_scopes(spark):
    df = spark.range(3).withColumnRenamed("id", "tenant_id")
    assert df.where(chunk_filter()).count() == 0 and df.where(chunk_filter(tenant_id=1)).count() == 1
    assert require_tenant(Actor(is_admin=True), 5) == 5
    with pytest.raises(Forbidden):
        require_tenant(Actor(tenant_id=4), 5)
    with pytest.raises(Forbidden):
        require_tenant(Actor(), 5)


def test_trees(spark):
    rows = [("g", "a", None), ("g", "b", "a"), ("g", "c", "b"), ("g", "x", "y"), ("g", "y", "x"), ("g", "z", "y"), ("g", "o", "lost")]
    t = spark.createDataFrame(rows, "g string, n string, p string")
    d = {r.node: (r.depth, r.cyclic) for r in H.depths(t, "g", "n", "p").collect()}
    assert d["a"] == (0, False) and d["c"] == (2, False) and all(d[k][1] for k in "xyz")
    assert [r.n for r in H.orphans(t, "g", "n", "p").collect()] == ["o"]


def plain_bm25(queries, docs, k1=1.5, b=0.75):
    n, avgdl = len(docs), sum(len(t) for _, t in docs) / len(docs)
    out = {}
    for q, asked in queries:
        for d, t in docs:
            for term in asked:  # one occurrence after the other
                df = sum(term in u for _, u in docs)
                if tf := t.count(term):
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    out[q, d] = out.get((q, d), 0.0) + idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * len(t) / avgdl))
    return out


@pytest.mark.parametrize("most", [1 << 18, 1])
def test_bm25(spark, monkeypatch, most):
    """Broadcast and joined query terms give the scores of the formula; null and empty texts count as documents of no length."""
    monkeypatch.setattr(R, "QUERY_TERMS", most)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(40)] + [None, "", "w1 " * 500]
    docs = [(i, t) for i, t in enumerate(texts)]
    asked = [(q, rng.choices([*words, "unknown"], k=6)) for q in range(7)]
    q = spark.createDataFrame([(i, t) for i, terms in asked for t in terms], "query_id long, term string")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("w1")).withColumn("dl", F.lit(3))
    terms = F.filter(F.split("text", " "), lambda w: w != "")
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(q, d, terms, "doc_id").collect()}
    want = plain_bm25(asked, [(i, (t or "").split()) for i, t in docs])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert R.bm25(q, d.where("false"), terms, "doc_id").collect() == R.bm25(q.where("false"), d, terms, "doc_id").collect() == []


def test_terms_of_odd_texts(spark):
    """Punctuation, underscores, line ends and all Unicode spaces part terms; marks stay in them."""
    text = "Tệp_tin, the\u00a0BIÊN-bản...a1\u2028b2\tx 9 số\n\n§12.34% e\u0301tude __ of\u3000end"
    assert one(spark, T.clean_terms(F.lit(text))) == ["tệp", "tin", "biên", "bản", "a1", "b2", "số", "12", "34", "e\u0301tude", "end"]
    assert one(spark, T.clean_terms(F.lit(""))) == [] and one(spark, T.clean_terms(F.lit(None).cast("string"))) is None


def test_packing_keeps_budget(spark):
    h = spark.createDataFrame([(1, 1, "x" * 40), (1, 2, "x" * 50), (1, 3, "x" * 20), (1, 4, "x")], "query_id int, rank int, text string")
    assert [r.rank for r in R.pack_context(h, "text", 100).orderBy("rank").collect()] == [1, 2]


def test_items():
    items = [
        ("page_header", None, "h"), ("text", None, "before"), ("title", None, "Doc"), ("heading", 1, "One"), ("heading", 4, "deep"), ("text", None, "body"), ("heading", 2, "Chapter 2"),
        ("picture", None, ""), ("table", None, "| a |"), ("heading", 3, "Article 5"), ("page_footer", None, "f"), ("title", None, "Next"), ("text", None, "t"),
    ]
    s = M.parse_items(items)
    assert [(x["section_id"], x["title"], x["level"], x["parent_section_id"], x["content"], x["pictures"], x["tables"]) for x in s] == [
        ("sec_0001", "", 1, None, "before", 0, 0),
        ("sec_0002", "Doc", 0, None, "", 0, 0),
        ("sec_0003", "One", 1, "sec_0002", "deep\nbody", 0, 0),
        ("sec_0004", "Chapter 2", 1, "sec_0002", "| a |", 1, 1),
        ("sec_0005", "Article 5", 2, "sec_0004", "", 0, 0),
        ("sec_0006", "Next", 0, None, "t", 0, 0),
    ]
    assert M.parse_items([]) == []


def test_bloom(spark):
    keys = spark.range(0, 6000, 2).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("h")).unionByName(spark.createDataFrame([(None,)], "h string"))
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 100 != 7, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("h"))
    words = B.words_for(3000)
    whole = B.sketch(keys, "h", words)
    parts = B.merged(B.sketch(keys.where("h < 'k3'"), "h", words), B.sketch(keys.where("h >= 'k3'"), "h", words))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    p = B.probed(rows, "h", whole, words)
    assert p.where("NOT maybe AND id < 6000 AND id % 2 = 0 AND h IS NOT NULL").count() == 0  # no key is lost
    assert p.where("maybe AND (id >= 6000 OR id % 2 = 1)").count() < 0.05 * 17_000  # few others go on to the join
    want = {i: i < 6000 and i % 2 == 0 and i % 100 != 7 for i in range(20_000)}
    for s, w in ((whole, words), (B.sketch(keys, "h", 1), 1)):  # a sketch that is full still gives the exact rows
        assert {r.id: r.known for r in B.known(rows, "h", keys, s, w).collect()} == want
    assert not any(r.known for r in B.known(rows, "h", keys.limit(0), B.sketch(keys.limit(0), "h", 1), 1).collect())
    assert B.words_for(10**12) == B.WORDS and B.words_for(0) == 1


def test_merged_citations(spark):
    pages = ["1-2", "4", "3", "10-12", "11-20", "30 ", "x-3", "-3", None, "9-8", "15", "1000000000-2000000000"]
    rows = [("d", i, None if i == 0 else f"t{i}", p) for i, p in enumerate(pages)] + [(None, 0, "none", None)]
    got = A.merged_citations(spark.createDataFrame(rows, "d string, i int, title string, page_range string"), ["d"], ["i"]).collect()
    assert {r.d: (r.title, r.pages) for r in got} == {"d": ("Tài liệu", "1-4, 10-20, 30, 1000000000-2000000000"), None: ("none", "")}


def test_hierarchy_report(spark):
    chain = [("long", f"n{i}", f"n{i - 1}" if i else None, "x") for i in range(200)]
    rows = [*chain, ("g", "a", None, " "), ("g", "a", "", "x"), ("g", "b", "a", None), ("g", "c", "lost", "x"), ("g", "d", "c", "x"), ("g", "x", "y", "x"), ("g", "y", "x", "x"), ("g", "z", "y", "x"), ("g", None, "a", "x"), ("g", "s", "s", "x"), (None, "q", None, "x")]
    r = {x[0]: tuple(x)[1:] for x in H.report(spark.createDataFrame(rows, "g string, n string, p string, t string"), "g", "n", "p", "t").collect()}
    assert r["long"] == (200, 0, 0, 0, 0, 0, 199, 199, True)
    assert r["g"] == (10, 1, 1, 1, 4, 2, 8, 2, False)
    assert r[None] == (1, 0, 1, 0, 0, 0, 0, 0, False)


def test_boosts(spark):
    q = spark.createDataFrame([(1, "Red  Apple pie, red apple"), (2, "code 1 12"), (3, None)], "query_id long, text string")
    s = spark.createDataFrame([(1, "a", "12.3", "The RED apple", "red apple pie,"), (1, "b", "1.12", None, "xred appley"), (1, "c", "12", "", None), (1, "d", None, "one", "two")], "document_id long, section_id string, section_code string, title string, content string")
    got = {(r.query_id, r.section_id): r.boost for r in BO.boosted(q, s, ("the",)).collect()}
    # "red apple" counts twice, "red apple pie," and "apple pie," are phrases too; 1 is too short for a code
    assert got == {(1, "a"): 25 * 2 * 2 + 5 * 3 + 5 * 2, (1, "b"): 5 * 2 * 2, (2, "a"): 35, (2, "c"): 35}


def test_semantic_cache_over_time(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([1, 5, 20]) if rng.random() < 0.95 else rng.choice([90, 101, 400])
        rows.append((rng.choice([1, 1, 2, None]), t, i, rng.choice(["put", "get", "get"]), rng.randrange(12), [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]))
    schema = "tenant long, ms long, event_id long, op string, entry long, vector array<double>"
    df = spark.createDataFrame(rows, schema)
    want = {}
    for tenant in (1, 2, None):
        live = SC.Live(100, 0.4)
        want |= {i: live.step(ms, op, entry, x) for k, ms, i, op, entry, x in rows if k == tenant}
    want = {i: want[i] for _, _, i, op, _, _ in rows if op == "get"}
    got = {r.event_id: r.hit for r in SC.lookups(df.repartition(4), 100, 0.4).collect()}
    assert got == want and 50 < sum(x is not None for x in got.values()) < len(got) - 50
    assert SC.parts(df, 100).select("tenant", "part").distinct().count() > 6
    # a stream in three batches gives the same
    src = tmp_path / "in"
    for b in range(3):
        part = spark.createDataFrame(rows[200 * b : 200 * b + 200], schema)
        part.where("tenant IS NOT NULL").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(src / f"b={b}"))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src)).withWatermark("ts", "1 second")
    jobs.drain(SC.stream_lookups(stream, 100, 0.4), str(tmp_path), jobs.numbered(str(tmp_path)))
    assert {r.event_id: r.hit for r in jobs.result(spark, str(tmp_path)).collect()} == {i: want[i] for k, _, i, op, _, _ in rows if op == "get" and k is not None}


def test_quantised_topk_is_exact(spark):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.002 * (i % 4)) for x in base[i % 30]]) for i in range(900)] + [(900, [0.0] * 16), (901, [1.0, 2.0]), *[(902 + i, base[0]) for i in range(9)]]
    df = spark.createDataFrame(rows, "node_id long, embedding array<float>")
    q = spark.createDataFrame([(i, base[i]) for i in range(12)] + [(12, [0.0] * 16), (13, [1.0] * 3)], "query_id long, qvec array<double>")
    key = lambda d: sorted((r.query_id, r.node_id, r.score, r["rank"]) for r in d.collect())
    for k in (1, 5, 40):
        assert key(QU.topk(q, QU.quantised(df), df, k)) == key(R.dense_topk(q, df, k))
    c = QU.quantised(df).where("node_id < 900")
    assert c.agg(F.max("slack")).first()[0] < 0.02 and dict(c.dtypes)["codes"] == "array<tinyint>"


def test_blob_store(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "store"))
    seen = lambda v=None: {r.key: r.body for r in store.read(v).collect()}
    blobs = lambda **kv: spark.createDataFrame([(k.replace("_", "/"), v) for k, v in kv.items()], "key string, body string")
    assert store.version() == 0 and seen() == {}
    first = store.put(blobs(a_1="x", a_2="yé", b_1="z"))
    store.put(blobs(a_2="new", ab="q"))
    assert seen() == {"a/1": "x", "a/2": "new", "b/1": "z", "ab": "q"} and seen(first) == {"a/1": "x", "a/2": "yé", "b/1": "z"}
    assert {r.key: r.length for r in store.listing(first).collect()} == {"a/1": 1, "a/2": 3, "b/1": 1}
    before = store.version()
    reader = store.read()
    # a change that was broken off isn't seen, and is written over
    (tmp_path / "store" / "listing" / f"v={before + 1}").mkdir()
    assert store.version() == before
    store.delete_prefix("a/")
    assert seen() == {"b/1": "z", "ab": "q"} and len(reader.collect()) == 4
    with pytest.raises(ValueError, match="prefix"):
        store.delete_prefix("")
    assert store.vacuum() == [] and seen() == {"b/1": "z", "ab": "q"}  # each batch has a live key
    store.delete_prefix("b/")
    assert len(store.vacuum()) == 1 and seen() == {"ab": "q"} and store.version() == before + 2
    store.delete(F.lit(True))
    assert seen() == {}
