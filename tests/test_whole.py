"""Queries over the whole of their input, against plain statements on a small fixture."""

import pytest

from tessera.plans import registry

QUERIES = registry.queries()


def rows(spark, name, folder, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect())


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    """A document of 12,000 lines, one of nine, one of a line and one that ends in line ends."""
    texts = {1: "\n".join(f"line {k}" for k in range(12_000)), 2: "\n".join("abcdefghi"), 3: "one", 4: "a\n\n\n"}
    folder = tmp_path_factory.mktemp("lines")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, {i: t.split("\n") for i, t in texts.items()}


def test_sections_of_all_lines(spark, long_documents):
    folder, lines = long_documents
    each = [(i, k, c) for i, cs in lines.items() for k, c in enumerate(cs)]
    assert rows(spark, "t20_drop_empty", folder, "document_id", "section_id", "content") == sorted((i, f"sec-{k:04d}", c) for i, k, c in each if c)
    assert rows(spark, "t26_tree_depth", folder, "document_id", "section_id", "depth") == sorted((i, f"sec-{k:04d}", (k + 1).bit_length() - 1) for i, k, _ in each)
    assert rows(spark, "j11_child_parent", folder, "document_id", "section_id", "parent_title") == sorted((i, f"sec-{k:04d}", f"{1 + (k - 1) // 2} Section") for i, k, _ in each if k)
    assert rows(spark, "t16_base_metadata", folder, "document_id", "sections") == [(i, len(cs)) for i, cs in lines.items()]


def test_query_sets(spark, tmp_path, monkeypatch):
    from tessera.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)  # eight query vectors in blocks
    vectors = [(i, [float(i % 7), float(i % 11), 1.0], i % 3) for i in range(150)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"term{i} common") for i in range(30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"term{i} common words") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = range(0, 150, 20)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    scores = {q: sorted((-round(cosine(vectors[q][1], e), 6), i) for i, e, _ in vectors) for q in asked}
    assert rows(spark, "v01_cosine", tmp_path, "query_id", "node_id", "score") == sorted((q, i, -s) for q in asked for s, i in scores[q])
    assert rows(spark, "o07_topk_vector", tmp_path, "query_id", "rank", "node_id") == sorted((q, r, i) for q in asked for r, (_, i) in enumerate(scores[q][:8], 1))
    assert rows(spark, "e03_hits_and_reciprocal_rank", tmp_path, "query_id") == [(q,) for q in asked]
    best = {q: next((i, -s) for s, i in scores[q] if i % 20 and i % 50 % 2 == q // 20 % 2) for q in asked}
    assert rows(spark, "v18_semantic_cache", tmp_path, "query_id", "hit") == [(q, i) for q, (i, s) in best.items() if 1 - s <= 0.95]
    assert rows(spark, "v03_sparse_topk", tmp_path, "query_id", "doc_id")[::3] == [(q, 0) for q in range(30)]
    assert {q for q, d in rows(spark, "v03_sparse_topk", tmp_path, "query_id", "doc_id") if q == d} == set(range(30))


def test_whole_tables(spark, tmp_path):
    from datetime import datetime

    events = [(i, datetime(2024, 1, 1), i % 7, "view", 1.0, "{}") for i in range(990, 1010)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(20)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    texts = {i: "a\nb\nc\nd" if i == 403 else "same" if i in (404, 405) else f"text {i} " + "x" * 2500 * (i == 402) for i in (5, 99, 299, *range(400, 420))}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(spark, "u02_set_difference", tmp_path, "id", "gone") == [(i, sorted({i % 3, i % 5, i % 7} - {i % 2, i % 4})) for i, *_ in events]
    assert rows(spark, "u03_set_union", tmp_path, "id", "both") == [(i, sorted({i % 3, i % 5, i % 2, i % 4})) for i, *_ in events]
    assert rows(spark, "t25_cycle_detection", tmp_path, "document_id", "section_id", "cyclic") == sorted((i, f"sec-{k:04d}", i == 403 and k > 1) for i, t in texts.items() for k in range(t.count("\n") + 1))
    assert rows(spark, "j03_tenants_of_documents", tmp_path, "id", "tenants") == sorted((i, [f"N{(i + 7) % 20}"] * (i % 4 == 0)) for i in texts)
    assert rows(spark, "s04_object_write", tmp_path, "doc_id", "text") == sorted(texts.items())
    ready = {t for i, t in texts.items() if i % 10 > 1}
    assert rows(spark, "j16_dedup_probe", tmp_path, "doc_id", "known") == sorted((i, t in ready) for i, t in texts.items())
    chunks = rows(spark, "t12_chunk_rule", tmp_path, "document_id", "chunk", "window", "text")
    assert [(d, t) for d, _, t, _ in chunks if d != 402] == sorted((i, t.strip()) for i, t in texts.items() if i != 402)
    assert "".join(t for d, _, t, _ in chunks if d == 402).replace(" ", "") == texts[402].replace(" ", "")
    assert all(t == f"[Tài liệu: s | Mục: en]\nĐường dẫn: {'s > en' if d % 2 == 0 else 'en'}\n\n{w}" for d, _, w, t in chunks)
