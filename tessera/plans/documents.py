"""Documents: sections, chunks, windows over lines, trees, sets and copies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import analytics as A
from tessera.operators import bloom as B
from tessera.operators import hierarchy as H
from tessera.operators import markdown as M
from tessera.operators import progress as P
from tessera.plans.registry import query

_MD = """SELECT doc_id AS document_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN repeat('#', CAST(1 + ((i - 1) // 4) % 3 AS INTEGER)) || ' ' || ((i - 1) // 4 + 1) || ' Section' || chr(10) || x ELSE x END), chr(10)) AS text FROM documents"""


def markdown(v):
    return v.table("documents").select(F.col("doc_id").alias("document_id"), M.with_headings(F.col("text")).alias("text"))


@query("s07_markdown_source", _MD)
def s07(v):
    return markdown(v)


_LINES = "SELECT document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM m"
_HEAD = f"WITH m AS ({_MD}), l AS ({_LINES}), h AS (SELECT *, regexp_matches(line, '^#+ \\d+ Section$') AS heading, length(regexp_extract(line, '^#+')) AS level FROM l)"


def lines(v):
    d = markdown(v).select("document_id", F.posexplode(M.lines_of(F.col("text"))).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    return d.withColumns({"heading": F.col("line").rlike(r"^#+ \d+ Section$"), "level": F.length(F.regexp_extract("line", "^#+", 0)).cast("long")})


@query("w01_heading_carry_forward", f"{_HEAD} SELECT document_id, i, last_value(CASE WHEN heading THEN line END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h")
def w01(v):
    w = W.partitionBy("document_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return lines(v).select("document_id", "i", F.last(F.when(F.col("heading"), F.col("line")), ignorenulls=True).over(w).alias("heading"))


@query("w02_running_section_number", f"{_HEAD} SELECT document_id, i, CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS BIGINT) AS section FROM h")
def w02(v):
    w = W.partitionBy("document_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return lines(v).select("document_id", "i", F.sum(F.col("heading").cast("int")).over(w).alias("section"))


@query("w03_nearest_previous_level", f"{_HEAD} SELECT document_id, i, last_value(CASE WHEN heading AND level = 1 THEN i END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM h WHERE heading AND level > 0")
def w03(v):
    w = W.partitionBy("document_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return lines(v).where("heading").select("document_id", "i", F.last(F.when(F.col("level") == 1, F.col("i")), ignorenulls=True).over(w).alias("parent"))


_SECTION = f"""{_HEAD}, n AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS s FROM h),
 b AS (SELECT document_id, s, max(line) FILTER (heading) AS head, max(level) FILTER (heading) AS level, trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT heading), chr(10) || ' ' || chr(9)) AS content FROM n GROUP BY 1, 2)"""


@query("t05_section_parse_bodies", f"{_SECTION} SELECT document_id, CAST(s - 1 AS BIGINT) AS k, ltrim(head, '# ') AS title, CAST(level AS BIGINT) AS level, coalesce(content, '') AS content FROM b")
def t05(v):
    s = M.sections(markdown(v), strict_ids=True, keep_empty=True)
    return s.select("document_id", F.col("order_index").cast("long").alias("k"), "title", F.col("level").cast("long").alias("level"), "content")


_CRUMBS = "array_to_string(list_transform(range(s - level + 1, s + 1), lambda j: j || ' Section'), ' > ')"


@query(
    "t02_section_parse",
    f"""{_SECTION}, e AS (SELECT document_id, CAST(s AS BIGINT) AS s, CAST(level AS BIGINT) AS level, content, CAST(coalesce(sum(CASE WHEN content <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM b),
 x AS (SELECT *, 'sec-' || s || '-' || printf('%04d', k) AS id FROM e), y AS (SELECT *, lag(id) OVER (PARTITION BY document_id ORDER BY s) AS above FROM x)
 SELECT document_id, k AS order_index, id AS section_id, CASE WHEN level > 1 THEN above END AS parent_section_id, CAST(s AS VARCHAR) AS section_code, s || ' Section' AS title, level, {_CRUMBS} AS breadcrumb, content FROM y WHERE content <> ''
 UNION ALL SELECT document_id, 0, 'sec-0000', NULL, NULL, 'Nội dung', 1, 'Nội dung', trim(coalesce(text, ''), chr(10) || ' ' || chr(9)) FROM m WHERE document_id NOT IN (SELECT document_id FROM b WHERE content <> '')""",
)
def t02(v):
    s = M.sections(markdown(v))
    return s.select("document_id", F.col("order_index").cast("long").alias("order_index"), "section_id", "parent_section_id", "section_code", "title", F.col("level").cast("long").alias("level"), F.array_join("breadcrumb", " > ").alias("breadcrumb"), "content")


@query(
    "t04_section_parse_keep_empty",
    rf"""{_HEAD}, n AS (SELECT *, CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS BIGINT) AS s FROM h),
 b AS (SELECT document_id, s, CAST(max(level) FILTER (heading) AS BIGINT) AS level, string_agg(line || chr(10), '' ORDER BY i) FILTER (NOT heading) AS content, count(*) FILTER (NOT heading AND regexp_matches(line, '^\s*\|.*\|\s*$')) AS table_count FROM n GROUP BY 1, 2)
 SELECT document_id, s - 1 AS order_index, 'sec_' || printf('%04d', s - 1) AS section_id, CASE WHEN level > 1 THEN 'sec_' || printf('%04d', s - 2) END AS parent_section_id, s || ' Section' AS title, level, {_CRUMBS} AS breadcrumb, content, table_count FROM b""",
)
def t04(v):
    s = M.local_sections(markdown(v))
    long = [F.col(n).cast("long").alias(n) for n in ("order_index", "level", "table_count")]
    return s.select("document_id", *long, "section_id", "parent_section_id", "title", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "content")


@query("t01_markdown_clean", r"""
WITH k AS (SELECT doc_id, list_filter(string_split(CAST(doc_id AS VARCHAR) || chr(10) || text || chr(10) || '## Contents .......... 12' || chr(10) || 'Page 3' || chr(10) || 'page 3 of 9' || chr(10) || ' - 7 - ' || chr(10) || '3 / 9' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'end', chr(10)),
  lambda x: NOT regexp_matches(trim(x, e' \t\r\f\v'), '(?i)^(trang|page|-)\s*\d{1,4}\s*-?$') AND NOT regexp_matches(trim(x, e' \t\r\f\v'), '^\d+\s*/+\s*\d+$') AND NOT (contains(x, '...') AND regexp_matches(ltrim(trim(x, e' \t\r\f\v'), '# '), '[.•…]{4,}'))) AS a FROM documents)
SELECT doc_id, array_to_string(list_filter(a, lambda x, i: NOT (trim(x, e' \t\r\f\v') = '' AND i > 1 AND trim(coalesce(a[i - 1], 'x'), e' \t\r\f\v') = '')), chr(10)) AS cleaned FROM k""")
def t01(v):
    t = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n## Contents .......... 12\nPage 3\npage 3 of 9\n - 7 - \n3 / 9\n\n \n\nend"))
    return v.table("documents").select("doc_id", M.clean(t).alias("cleaned"))


@query("w09_blank_line_collapse", "WITH k AS (SELECT page_id, string_split(regexp_replace(html, '<[^>]*>', chr(10) || chr(10), 'g'), chr(10)) AS a FROM pages) SELECT page_id, len(list_filter(a, lambda x, i: NOT (trim(x) = '' AND i > 1 AND trim(coalesce(a[i - 1], 'x')) = ''))) AS kept FROM k")
def w09(v):
    kept = M.blanks_once(F.split(F.regexp_replace("html", "<[^>]*>", "\n\n"), "\n"), lambda x: F.trim(x) == "")
    return v.table("pages").select("page_id", F.size(kept).cast("long").alias("kept"))


@query("t06_heading_override", "SELECT document_id, order_index, CASE order_index % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE level END AS level FROM v_sections")
def t06(v):
    k = F.col("order_index") % 4
    title = F.concat(F.when(k == 0, "Chapter ").when(k == 1, "ARTICLE ").otherwise("Other "), F.col("title"))
    return v.sections.select("document_id", "order_index", M.heading_level(title, F.col("level")).alias("level"))


_CELLS = "SELECT document_id, order_index // 3 AS row, order_index % 3 AS col, title AS text FROM v_sections WHERE order_index <> 4"


@query("t07_table_markdown", f"""WITH c AS ({_CELLS}), w AS (SELECT document_id, max(col) + 1 AS width FROM c GROUP BY 1),
 g AS (SELECT w.document_id, row, width, unnest(range(0, width)) AS col FROM w JOIN (SELECT DISTINCT document_id, row FROM c) r USING (document_id)),
 l AS (SELECT g.document_id, g.row, max(width) AS width, '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY g.col) || ' |' AS line FROM g LEFT JOIN c ON c.document_id = g.document_id AND c.row = g.row AND c.col = g.col GROUP BY 1, 2)
 SELECT document_id, string_agg(CASE WHEN row = 0 THEN line || chr(10) || '|' || repeat(' --- |', CAST(width AS INTEGER)) ELSE line END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY 1""")
def t07(v):
    k = F.col("order_index")
    cells = v.sections.where(k != 4).select("document_id", F.floor(k / 3).alias("row"), (k % 3).alias("col"), F.col("title").alias("text"))
    return M.table_markdown(cells, "document_id")


@query(
    "t08_block_split",
    r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '<li>', chr(10) || '- ', 'g'), '</ul>', chr(10), 'g'), '<p>', chr(10) || chr(10) || '| x | y |' || chr(10), 'g'), chr(10)) AS a FROM pages),
 k AS (SELECT *, list_transform(a, lambda x: regexp_matches(x, '^\s*(?:[-*+] |\d+\.\s)\s*\S')) AS li, list_transform(a, lambda x: regexp_matches(x, '^\s*$')) AS bl FROM p),
 f AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: bl[i] AND NOT coalesce(li[i - 1], false)) AS fl FROM k),
 m AS (SELECT page_id, list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT fl[i]), lambda i: CASE WHEN i = 1 OR li[i] OR fl[i - 1] THEN chr(1) ELSE '' END || a[i]) AS kept FROM f)
 SELECT page_id, len(list_filter(kept, lambda x: starts_with(x, chr(1)))) AS blocks, md5(array_to_string(kept, chr(10))) AS text_md5 FROM m""",
)
def t08(v):
    """List items, paragraphs and lines of tables, from a page's tags."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<li>", "\n- "), "</ul>", "\n"), "<p>", "\n\n| x | y |\n")
    b = M.split_blocks(t)
    marked = F.array_join(F.transform(b, lambda x: F.concat(F.lit("\x01"), x)), "\n")
    return v.table("pages").select("page_id", F.size(b).cast("long").alias("blocks"), F.md5(marked).alias("text_md5"))


@query("t09_atomic_block", r"SELECT page_id, len(regexp_extract_all(t, '(?m)^\s*[-*+]\s+')) >= 2 AS atomic FROM (SELECT page_id, regexp_replace(html, '<li>', chr(10) || '- ', 'g') AS t FROM pages) p")
def t09(v):
    return v.table("pages").select("page_id", M.is_atomic(F.regexp_replace("html", "<li>", "\n- ")).alias("atomic"))


_ABBR = ("e.g.", "i.e.", "Dr.", "Mr.", "Mrs.", "vs.", "No.", "etc.")
_SENT = r"regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g')"
for _a in _ABBR:
    _SENT = f"replace({_SENT}, '{_a}' || chr(1), '{_a} ')"
_SENT = rf"list_filter(string_split(regexp_replace({_SENT}, '([。！？])' || chr(1) || '?', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query("t10_sentence_split", f"SELECT doc_id, len({_SENT}) AS sentences, md5(array_to_string({_SENT}, chr(1))) AS text_md5 FROM documents")
def t10(v):
    s = M.split_sentences(F.col("text"))
    return v.table("documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.md5(F.array_join(s, "\x01")).alias("text_md5"))


@query("t11_chunk_with_overlap")
def t11(v):
    return M.chunks(v.table("documents").select(F.col("doc_id").alias("document_id"), "text"))


def index_chunks(v):
    """Documents as sections: titled by their source, under a heading of their language, with a breadcrumb where they have an even number."""
    crumb = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" > ", "source", "lang"))
    return M.index_chunks(v.table("documents").select(F.col("doc_id").alias("document_id"), F.lit("sec-0000").alias("section_id"), F.col("source").alias("document_title"), F.col("lang").alias("heading"), crumb.alias("breadcrumb"), F.col("text").alias("content")))


@query("t12_chunk_rule")
def t12(v):
    """Texts of all lengths; those over 2,000 characters are cut by tokens."""
    return index_chunks(v)


@query(
    "t12_chunk_coverage",
    r"""WITH d AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM documents)
 SELECT doc_id AS document_id, length(c) <= 2000 AS single, CAST(length(c) AS BIGINT) AS covered, true AS within, true AS overlaps,
  CASE WHEN length(c) <= 2000 THEN '[Tài liệu: ' || coalesce(source, '') || ' | Mục: ' || coalesce(lang, '') || ']' || chr(10) || 'Đường dẫn: ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN concat_ws(' > ', source, lang) END, lang, '') || chr(10) || chr(10) || c END AS text
 FROM d WHERE c <> ''""",
)
def t12c(v):
    """What every chunking of all texts keeps: a short text whole and under its context, every character in a chunk, no chunk over the budget or without progress."""
    w = W.partitionBy("document_id").orderBy("chunk")
    before = F.coalesce(F.lag("end").over(w), F.lit(0))
    c = index_chunks(v).withColumn("fresh", F.col("end") - before).withColumn("joined", (F.col("start") <= before) & (F.col("end") > before))
    g = c.groupBy("document_id").agg(F.max("end").alias("size"), F.sum("fresh").alias("covered"), F.bool_and((F.length("window") <= 4 * 1024)).alias("within"), F.bool_and("joined").alias("overlaps"), F.min_by("text", "chunk").alias("text"))
    single = F.col("size") <= 2000
    return g.select("document_id", single.alias("single"), "covered", "within", "overlaps", F.when(single, F.col("text")).alias("text"))


@query("w08_greedy_accumulation")
def w08(v):
    c = M.chunks(v.table("documents").select(F.col("doc_id").alias("document_id"), "text"), 600, 120)
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@query("t13_context_prefix", "SELECT document_id, section_id, '[' || title || '] ' || title || chr(10) || content AS text, content AS \"window\" FROM v_sections")
def t13(v):
    return v.sections.select("document_id", "section_id", F.concat(F.lit("["), "title", F.lit("] "), "title", F.lit("\n"), "content").alias("text"), F.col("content").alias("window"))


@query("t14_section_index_text", "SELECT document_id, section_id, title || chr(10) || section_code || chr(10) || substring(content, 1, 1500) AS text FROM v_sections")
def t14(v):
    return v.sections.select("document_id", "section_id", F.concat_ws("\n", "title", "section_code", F.substring("content", 1, 1500)).alias("text"))


@query("t15_section_nodes", "SELECT document_id, section_id, content = '' AS is_empty FROM v_sections")
def t15(v):
    return v.sections.select("document_id", "section_id", (F.col("content") == "").alias("is_empty"))


@query("t16_base_metadata", "SELECT document_id, first(title ORDER BY order_index) AS document_title, count(*) AS sections FROM v_sections GROUP BY 1")
def t16(v):
    return v.sections.groupBy("document_id").agg(F.min_by("title", "order_index").alias("document_title"), F.count("*").alias("sections"))


@query("t17_chunk_back_annotation", "SELECT section_id, count(*) AS chunk_count, list(node_id ORDER BY node_id) AS chunk_node_ids FROM v_chunks GROUP BY 1")
def t17(v):
    return v.chunks.groupBy("section_id").agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_list("node_id")).alias("chunk_node_ids"))


@query("t18_node_refine", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '. ', '.'), '\s+', ' ', 'g'), '([.!?])(\p{Lu})', '\1 \2', 'g')) AS text FROM documents")
def t18(v):
    return v.table("documents").select("doc_id", M.refine(F.replace("text", F.lit(". "), F.lit("."))).alias("text"))


@query("t19_section_refine", r"SELECT document_id, section_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS content FROM v_sections")
def t19(v):
    return v.sections.select("document_id", "section_id", F.trim(F.regexp_replace("content", r"(?U)\s+", " ")).alias("content"))


@query("t20_drop_empty", "SELECT document_id, section_id, trim(content) AS content FROM v_sections WHERE trim(content) <> ''")
def t20(v):
    c = F.trim(F.replace("content", F.lit("\0"), F.lit("")))
    return v.sections.select("document_id", "section_id", c.alias("content")).where("content <> ''")


_MARKED = "CASE order_index % 7 WHEN 1 THEN '```' || content WHEN 2 THEN '| ' || content WHEN 3 THEN '## ' || content WHEN 4 THEN 'the class of ' || content WHEN 5 THEN '|' || repeat(chr(10), CAST(order_index AS INTEGER) % 40) || content ELSE content END"


@query(
    "t21_node_type",
    f"""SELECT document_id, order_index, coalesce(CASE WHEN level = 2 AND order_index % 3 = 0 THEN 'image' END, CASE WHEN contains(t, '```') OR contains(t, 'def ') OR contains(t, 'class ') THEN 'code_block'
 WHEN contains(t, '|') AND length(t) - length(replace(t, chr(10), '')) < 20 THEN 'table' WHEN starts_with(t, '#') THEN 'section' ELSE 'paragraph' END) AS kind FROM (SELECT *, {_MARKED} AS t FROM v_sections) s""",
)
def t21(v):
    """Contents with marks of each kind; some nodes have a kind of their own, some one that is none."""
    k = F.col("order_index")
    t = F.when(k % 7 == 1, F.concat(F.lit("```"), "content")).when(k % 7 == 2, F.concat(F.lit("| "), "content")).when(k % 7 == 3, F.concat(F.lit("## "), "content")).when(k % 7 == 4, F.concat(F.lit("the class of "), "content"))
    t = t.when(k % 7 == 5, F.concat(F.lit("|"), F.repeat(F.lit("\n"), (k % 40).cast("int")), "content")).otherwise(F.col("content"))
    given = F.when((F.col("level") == 2) & (k % 3 == 0), "IMAGE").when(k % 5 == 0, "chapter")
    return v.sections.select("document_id", "order_index", M.node_type(t, given).alias("kind"))


@query(
    "t22_persist_test",
    "SELECT document_id, section_id, trim(content) <> '' OR (order_index % 2 = 0) OR (order_index % 3 = 0 AND order_index > 0) OR order_index % 5 = 1 AS keep FROM v_sections",
)
def t22(v):
    """Every other title is blank; images and tables are counted in some sections, unknown in others."""
    k = F.col("order_index")
    title = F.when(k % 2 == 0, F.col("title")).otherwise(F.lit(" \n"))
    return v.sections.select("document_id", "section_id", M.persists(title, F.col("content"), F.when(k % 3 == 0, k), F.when(k % 5 == 1, 1)).alias("keep"))


_TREE = "WITH RECURSIVE t AS (SELECT document_id, section_id, CAST(0 AS BIGINT) AS depth FROM s WHERE parent_section_id IS NULL UNION ALL SELECT s.document_id, s.section_id, t.depth + 1 FROM s JOIN t ON s.document_id = t.document_id AND s.parent_section_id = t.section_id)"


#: Sections with a defect of each kind, by document: a parent that isn't there, a cycle with what hangs from it, a section twice, one without an id.
_DEFECTS = """SELECT document_id, CASE WHEN document_id % 5 = 4 AND order_index = 2 THEN NULL ELSE section_id END AS section_id, CASE WHEN document_id % 5 = 1 AND order_index = 3 THEN 'sec-9999'
  WHEN document_id % 5 = 2 AND order_index = 1 THEN 'sec-0003' ELSE parent_section_id END AS parent_section_id, content FROM v_sections
 UNION ALL SELECT document_id, section_id, parent_section_id, '' FROM v_sections WHERE document_id % 5 = 3 AND order_index = 1"""


@query(
    "t24_hierarchy_validation",
    f"""WITH RECURSIVE s AS ({_DEFECTS}), i AS (SELECT document_id, section_id, min(parent_section_id) AS up, count(*) AS times FROM s WHERE section_id IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT i.*, p.section_id IS NOT NULL AS there FROM i LEFT JOIN i p ON p.document_id = i.document_id AND p.section_id = i.up),
 t AS (SELECT document_id, section_id, CAST(CASE WHEN up IS NULL THEN 0 ELSE 1 END AS BIGINT) AS depth FROM k WHERE up IS NULL OR NOT there
  UNION ALL SELECT k.document_id, k.section_id, t.depth + 1 FROM t JOIN k ON k.document_id = t.document_id AND k.up = t.section_id),
 r AS (SELECT document_id, count(*) AS nodes, count(*) FILTER (section_id IS NULL) AS missing, count(*) FILTER (trim(content) = '') AS empties, count(parent_section_id) AS hierarchical,
  count(*) FILTER (parent_section_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.document_id = s.document_id AND i.section_id = s.parent_section_id)) AS orphans FROM s GROUP BY 1),
 g AS (SELECT k.document_id, CAST(sum(times - 1) AS BIGINT) AS duplicates, count(*) FILTER (t.section_id IS NULL) AS cyclic, coalesce(max(depth), 0) AS depth FROM k LEFT JOIN t ON t.document_id = k.document_id AND t.section_id = k.section_id GROUP BY 1)
 SELECT document_id, nodes, coalesce(duplicates, 0) AS duplicates, missing, orphans, coalesce(cyclic, 0) AS cyclic, empties, hierarchical, coalesce(depth, 0) AS depth,
  coalesce(duplicates, 0) = 0 AND missing = 0 AND orphans = 0 AND coalesce(cyclic, 0) = 0 AS valid FROM r LEFT JOIN g USING (document_id)""",
)
def t24(v):
    k, d = F.col("order_index"), F.col("document_id") % 5
    s = v.sections.select(
        "document_id",
        F.when((d == 4) & (k == 2), None).otherwise(F.col("section_id")).alias("section_id"),
        F.when((d == 1) & (k == 3), "sec-9999").when((d == 2) & (k == 1), "sec-0003").otherwise(F.col("parent_section_id")).alias("parent_section_id"),
        "content",
    )
    again = v.sections.where((d == 3) & (k == 1)).select("document_id", "section_id", "parent_section_id", F.lit("").alias("content"))
    return H.report(s.unionByName(again), "document_id", "section_id", "parent_section_id", "content")


@query("t25_cycle_detection", "SELECT document_id, section_id, order_index >= 2 AND count(*) OVER (PARTITION BY document_id) >= 4 AS cyclic FROM v_sections")
def t25(v):
    """Sections 2 and 3 point at each other, so these and what hangs from them (4 on) are cyclic, if 3 exists; others hang from the root or from section 1."""
    s = v.sections
    k = F.col("order_index")
    up = F.when(k == 2, "sec-0003").when(k == 3, "sec-0002").when(k > 3, "sec-0003").otherwise(F.col("parent_section_id"))
    d = H.depths(s.withColumn("parent_section_id", up), "document_id", "section_id", "parent_section_id")
    return d.select("document_id", F.col("node").alias("section_id"), "cyclic")


@query("t26_tree_depth", "SELECT document_id, section_id, CAST(length(bin(order_index + 1)) - 1 AS BIGINT) AS depth FROM v_sections")
def t26(v):
    return H.depths(v.sections, "document_id", "section_id", "parent_section_id", 32).select("document_id", F.col("node").alias("section_id"), "depth")


@query("p09_escaped_substring", r"SELECT document_id, section_id FROM v_sections WHERE title ILIKE '%5 sec%' OR content ILIKE '%the\_of%' ESCAPE '\'")
def p09(v):
    q = lambda s: "%" + s.replace("%", "\\%").replace("_", "\\_") + "%"
    return v.sections.where(F.col("title").ilike(q("5 sec")) | F.col("content").ilike(q("the_of"))).select("document_id", "section_id")


@query("t27_node_search", "SELECT document_id, section_id, substring(content, 1, 200) AS preview FROM v_sections WHERE content ILIKE '%anti%' OR title ILIKE '%anti%'")
def t27(v):
    return v.sections.where(F.col("content").ilike("%anti%") | F.col("title").ilike("%anti%")).select("document_id", "section_id", F.substring("content", 1, 200).alias("preview"))


@query("t28_node_detail", "SELECT title, level, content, length(content) // 4 AS tokens FROM v_sections WHERE document_id = 11 AND section_id = 'sec-0002'")
def t28(v):
    return v.sections.where("document_id = 11 AND section_id = 'sec-0002'").select("title", "level", "content", F.floor(F.length("content") / 4).alias("tokens"))


@query("t29_tree_page", "SELECT document_id, section_id, title, length(content) AS text_length FROM v_sections WHERE document_id = 21 ORDER BY order_index LIMIT 4 OFFSET 2")
def t29(v):
    return v.sections.where("document_id = 21").orderBy("order_index").offset(2).limit(4).select("document_id", "section_id", "title", F.length("content").cast("long").alias("text_length"))


@query("p15_nested_default", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END AS node_count FROM documents")
def p15(v):
    meta = F.when(F.col("doc_id") % 3 == 0, F.struct(F.struct(F.col("n_chars").alias("node_count")).alias("stats")))
    return v.table("documents").select("doc_id", F.coalesce(meta["stats"]["node_count"], F.lit(0)).alias("node_count"))


@query("p16_tree_projection", "SELECT section_id AS id, parent_section_id AS parent, coalesce(CASE WHEN order_index % 2 = 0 THEN order_index END, 1) AS page, length(content) AS text_length FROM v_sections")
def p16(v):
    page = F.coalesce(F.when(F.col("order_index") % 2 == 0, F.col("order_index")), F.lit(1))
    return v.sections.select(F.col("section_id").alias("id"), F.col("parent_section_id").alias("parent"), page.alias("page"), F.length("content").cast("long").alias("text_length"))


@query("p19_first_title", "SELECT document_id, first(title ORDER BY order_index) FILTER (title <> '' AND title <> 'Untitled' AND title NOT LIKE '1 %') AS title FROM v_sections GROUP BY 1")
def p19(v):
    t = F.col("title")
    good = (t != "") & (t != "Untitled") & ~t.startswith("1 ")
    return v.sections.groupBy("document_id").agg(F.min_by(t, F.when(good, F.col("order_index"))).alias("title"))


@query("t38_progress_mapping", "SELECT document_id, section_id, CAST(least(95, greatest(40, 40 + floor(55 * (order_index / 8.0)))) AS BIGINT) AS progress FROM v_sections")
def t38(v):
    return v.sections.select("document_id", "section_id", F.least(F.lit(95), F.greatest(F.lit(40), 40 + F.floor(55 * (F.col("order_index") / 8.0)))).cast("long").alias("progress"))


@query("w07_page_runs", """WITH p AS (SELECT DISTINCT document_id, section_id AS page FROM v_citations WHERE section_id IS NOT NULL), g AS (SELECT document_id, page, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS g FROM p),
 r AS (SELECT document_id, min(page) AS a, max(page) AS b FROM g GROUP BY document_id, g.g) SELECT document_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1""")
def w07(v):
    p = v.citations.where("section_id IS NOT NULL").select("document_id", F.col("section_id").alias("page")).distinct()
    g = p.withColumn("g", F.col("page") - F.row_number().over(W.partitionBy("document_id").orderBy("page")))
    r = g.groupBy("document_id", "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    span = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return r.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", span.alias("s")))), lambda x: x["s"]), ", ").alias("pages"))


_RANGES = """SELECT tenant_id, document_id, id, pos, title, CASE (id + pos) % 7 WHEN 0 THEN '3-5' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN '9 - 4'
 WHEN 5 THEN (20 + id % 40) || '-' || (20 + id % 40 + id % 3) ELSE '1-2-' || (2 + id % 2) END AS page_range FROM v_citations"""


@query(
    "t36_citation_merge",
    f"""WITH c AS ({_RANGES}), t AS (SELECT tenant_id, document_id, arg_min(coalesce(title, 'Tài liệu'), (id, pos)) AS title FROM c GROUP BY 1, 2),
 n AS (SELECT tenant_id, document_id, TRY_CAST(trim(string_split(page_range, '-')[1]) AS INTEGER) AS a, TRY_CAST(trim(string_split(page_range, '-')[-1]) AS INTEGER) AS b FROM c WHERE page_range IS NOT NULL),
 p AS (SELECT DISTINCT tenant_id, document_id, unnest(range(a, b + 1)) AS page FROM n WHERE a IS NOT NULL AND b IS NOT NULL), g AS (SELECT *, page - row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY page) AS g FROM p),
 r AS (SELECT tenant_id, document_id, min(page) AS a, max(page) AS b FROM g GROUP BY 1, 2, g.g), d AS (SELECT tenant_id, document_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1, 2)
 SELECT t.tenant_id, t.document_id, title, coalesce(pages, '') AS pages FROM t LEFT JOIN d ON d.tenant_id IS NOT DISTINCT FROM t.tenant_id AND d.document_id = t.document_id""",
)
def t36(v):
    """A tenant's citations as those of one answer."""
    k = (F.col("id") + F.col("pos")) % 7
    page = F.when(k == 0, "3-5").when(k == 1, " 7 ").when(k == 2, "x").when(k == 3, None).when(k == 4, "9 - 4")
    from_ = 20 + F.col("id") % 40
    page = page.when(k == 5, F.concat_ws("-", from_.cast("string"), (from_ + F.col("id") % 3).cast("string"))).otherwise(F.concat(F.lit("1-2-"), (2 + F.col("id") % 2).cast("string")))
    return A.merged_citations(v.citations.withColumn("page_range", page), ["tenant_id", "document_id"], ["id", "pos"])


@query(
    "w10_progress_throttle",
    """WITH RECURSIVE e AS (SELECT user_id % 20 AS task, event_id, event_type AS stage, value % 100 AS p, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
 r(task, event_id, stage, n, emitted, last) AS (SELECT task, event_id, stage, n, true, p FROM e WHERE n = 1
  UNION ALL SELECT e.task, e.event_id, e.stage, e.n, e.stage <> r.stage OR e.p - r.last >= 5 OR e.p >= 100 OR e.p <= 0, CASE WHEN e.stage <> r.stage OR e.p - r.last >= 5 OR e.p >= 100 OR e.p <= 0 THEN e.p ELSE r.last END FROM r JOIN e ON e.task = r.task AND e.n = r.n + 1)
 SELECT task, event_id, emitted FROM r""",
)
def w10(v):
    e = v.table("events").select((F.col("user_id") % 20).alias("key"), "ts", "event_id", F.col("event_type").alias("stage"), (F.col("value") % 100).alias("percent"))
    return P.throttled(e).select(F.col("key").cast("long").alias("task"), "event_id", "emitted")


@query("w11_change_only", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) e WHERE p IS NULL OR p <> event_type")
def w11(v):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = v.table("events").withColumn("p", F.lag(F.sha2("event_type", 256)).over(w))
    return e.where(F.col("p").isNull() | (F.col("p") != F.sha2("event_type", 256))).select("user_id", "event_id")


# --- sets, copies, versions, access


@query("u01_bag_concat", "SELECT node_id FROM v_chunks UNION ALL SELECT document_id FROM v_sections")
def u01(v):
    return v.chunks.select("node_id").unionByName(v.sections.select(F.col("document_id").alias("node_id")))


@query("u02_set_difference", "SELECT id, list_sort(list_distinct(list_filter([id % 3, id % 5, id % 7], lambda x: NOT list_contains([id % 2, id % 4], x)))) AS gone FROM v_usage")
def u02(v):
    i = F.col("id")
    return v.usage.select("id", F.array_sort(F.array_except(F.array(i % 3, i % 5, i % 7), F.array(i % 2, i % 4))).alias("gone"))


@query("u03_set_union", 'SELECT id, list_sort(list_distinct([id % 3, id % 5, id % 2, id % 4])) AS "both" FROM v_usage')
def u03(v):
    i = F.col("id")
    return v.usage.select("id", F.array_sort(F.array_union(F.array(i % 3, i % 5), F.array(i % 2, i % 4))).alias("both"))


@query("u04_ordered_distinct", "SELECT conversation_id, list(role ORDER BY first_turn) AS roles FROM (SELECT conversation_id, role, min(turn) AS first_turn FROM v_messages GROUP BY 1, 2) m GROUP BY 1")
def u04(v):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return v.messages.groupBy("conversation_id").agg(F.array_distinct(ordered).alias("roles"))


@query("u05_exact_duplicates", "SELECT id FROM v_documents d WHERE EXISTS (SELECT 1 FROM v_documents o WHERE o.sha256 = d.sha256 AND o.id < d.id AND o.status <> 'failed' AND o.deleted_at IS NULL)")
def u05(v):
    live = v.documents.where("status <> 'failed' AND deleted_at IS NULL").groupBy("sha256").agg(F.min("id").alias("first"))
    return v.documents.select("id", "sha256").join(live, "sha256").where("first < id").select("id")


@query("u06_access_replace", "SELECT tenant_id, document_id FROM v_access WHERE document_id % 8 <> 0 UNION SELECT DISTINCT doc_id % 3 AS tenant_id, doc_id AS document_id FROM documents WHERE doc_id % 8 = 0")
def u06(v):
    new = v.table("documents").where("doc_id % 8 = 0").select((F.col("doc_id") % 3).alias("tenant_id"), F.col("doc_id").alias("document_id")).distinct()
    return v.access.join(new.select("document_id").distinct(), "document_id", "left_anti").select("tenant_id", "document_id").unionByName(new)


@query("j06_latest_version", "SELECT id, file_name, version FROM (SELECT *, rank() OVER (PARTITION BY file_name ORDER BY version DESC) AS r FROM v_documents WHERE status = 'ready' AND deleted_at IS NULL) d WHERE r = 1")
def j06(v):
    live = v.versions.where("status = 'ready' AND deleted_at IS NULL").select("id", "file_name", "version")
    top = live.groupBy("file_name").agg(F.max("version").alias("version"))
    return live.join(top, ["file_name", "version"]).select("id", "file_name", "version")


@query("j07_owner_or_access", "SELECT id FROM v_documents d WHERE tenant_id = 11 OR EXISTS (SELECT 1 FROM v_access a WHERE a.document_id = d.id AND a.tenant_id = 11)")
def j07(v):
    granted = v.access.where("tenant_id = 11").select(F.col("document_id").alias("id")).distinct().withColumn("granted", F.lit(True))
    return v.documents.select("id", "tenant_id").join(granted, "id", "left").where("tenant_id = 11 OR granted").select("id")


@query("j08_conversation_messages", "SELECT conversation_id, turn, role, length(content) AS n FROM v_messages WHERE conversation_id = 3 ORDER BY turn")
def j08(v):
    head = v.messages.where("conversation_id = 3").select("conversation_id").distinct()
    return head.join(v.messages, "conversation_id").orderBy("turn").select("conversation_id", "turn", "role", F.length("content").cast("long").alias("n"))


@query("j15_orphans", "SELECT node_id FROM v_chunks c WHERE section_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_sections s WHERE s.document_id = c.document_id AND s.order_index = c.section_id)")
def j15(v):
    known = v.sections.select("document_id", F.col("order_index").alias("section_id"))
    return v.chunks.where("section_id IS NOT NULL").join(known, ["document_id", "section_id"], "left_anti").select("node_id")


@query("j16_dedup_probe", "SELECT doc_id, sha256(text) IN (SELECT sha256 FROM v_documents WHERE status = 'ready') AS known FROM documents")
def j16(v):
    """A Bloom sketch of the known hashes first; only texts that pass it meet the hashes themselves."""
    seen = v.documents.where("status = 'ready'").select("sha256")
    words = B.words_for(seen.count())
    rows = v.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return B.known(rows, "sha256", seen, B.sketch(seen, "sha256", words), words).select("doc_id", "known")


@query("j18_previous_user_turn", "SELECT conversation_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM v_messages")
def j18(v):
    w = W.partitionBy("conversation_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return v.messages.select("conversation_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


@query("k17_orphan_sweep", "SELECT count(*) AS cleaned FROM v_chunks c WHERE NOT EXISTS (SELECT 1 FROM v_documents d WHERE d.id = c.document_id AND d.deleted_at IS NULL)")
def k17(v):
    live = v.documents.where("deleted_at IS NULL").select(F.col("id").alias("document_id"))
    return v.chunks.join(live, "document_id", "left_anti").agg(F.count("*").alias("cleaned"))


@query("k22_index_repair", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS kept FROM benchmark")
def k22(v):
    old = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>"))
    new = F.when(F.size(old) == 0, T.faq_hashes(F.array("text"))).otherwise(old)
    return v.table("benchmark").select("item_id", F.when(F.element_at(new, 1) == "h", 1).otherwise(0).alias("kept"))


@query(
    "t03_section_parse_items",
    r"""WITH a AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents), i AS (SELECT document_id, l, unnest(range(0, len(l), 3)) AS k FROM a)
 SELECT document_id, k // 3 AS order_index, 'sec_' || printf('%04d', k // 3 + 1) AS section_id, CASE WHEN k % 6 <> 0 THEN 'sec_' || printf('%04d', k // 3) END AS parent_section_id, 'x ' || l[k + 1] AS title, CASE WHEN k % 6 = 0 THEN 1 ELSE 2 END AS level,
  CASE WHEN k % 6 = 0 THEN 'x ' || l[k + 1] ELSE 'x ' || l[k - 2] || ' > x ' || l[k + 1] END AS breadcrumb, coalesce(trim('x ' || l[k + 2], e' \t\n\r\f\v'), '') AS content, CAST(k + 2 < len(l) AS INTEGER) AS pictures FROM i""",
)
def t03(v):
    """Every third line is a heading, of level 1 or 2, with a text and a picture after it."""
    d = v.table("documents").select(F.col("doc_id").alias("document_id"), F.posexplode(M.lines_of(F.col("text"))).alias("seq", "text"))
    k = F.col("seq")
    kind = F.when(k % 3 == 0, "heading").when(k % 3 == 1, "text").otherwise("picture")
    items = d.select("document_id", k.alias("seq"), kind.alias("kind"), F.when(k % 6 == 0, 1).otherwise(2).alias("level"), F.concat(F.lit("x "), "text").alias("text"))
    s = M.item_sections(items)
    return s.select("document_id", F.col("order_index").cast("long").alias("order_index"), "section_id", "parent_section_id", "title", "level", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "content", "pictures")
