"""From text to sections and chunks.

What one line or one unit decides alone is a column expression inside the row, without exploding or shuffling lines. What
depends on earlier decisions (section stacks, greedy chunks) is a fold over one document in plain Python, applied to
batches of documents; documents stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Headings of Markdown, codes of titles, table rows, list items.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
CODE = re.compile(r"^(\d+(?:\.\d+)*)(?:[).:]|\s|$)")
LOCAL_HEADING = r"(?s)^(#{1,6})\s+(.+)$"
TABLE_LINE = r"^\s*\|.*\|\s*$"
LIST_ITEM = r"(?U)^\s*(?:[-*+] |\d+\.\s)\s*\S"
# Titles of what stands before the first heading, of a text without sections, and of an untitled beginning.
PREFACE, WHOLE, OPENING = "Giới thiệu", "Nội dung", "Phần mở đầu"
ABBREVIATIONS = ("e.g.", "i.e.", "Dr.", "Mr.", "Mrs.", "vs.", "No.", "etc.")


#: White space within a line.
BLANKS = " \t\r\f\v"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def with_headings(text: Column) -> Column:
    """A heading before every fourth line, of level 1 + k % 3 and title `k+1 Section`: Markdown for tests."""
    head = lambda k: F.concat(F.repeat(F.lit("#"), (1 + k % 3).cast("int")), F.lit(" "), (k + 1).cast("string"), F.lit(" Section\n"))
    return F.array_join(F.transform(lines_of(text), lambda x, i: F.when(i % 4 == 0, F.concat(head(F.floor(i / 4)), x)).otherwise(x)), "\n")


def clean(text: Column, noise: tuple[str, ...] = ()) -> Column:
    """Drops page numbers (`Page 3`, `Trang 3`, `- 3 -`), `3 / 9`, lines in which a `noise` pattern is found, and table-of-contents leaders; runs of blank lines become one. A line of a number alone stays."""
    bare = lambda x: F.btrim(x, F.lit(BLANKS))
    page = lambda x: bare(x).rlike(r"(?i)^(trang|page|-)\s*\d{1,4}\s*-?$")
    of = lambda x: bare(x).rlike(r"^\d+\s*/+\s*\d+$")
    leader = lambda x: F.contains(x, F.lit("...")) & F.ltrim(bare(x), F.lit("# ")).rlike(r"[.•…]{4,}")
    drop = lambda x: reduce(lambda a, p: a | bare(x).rlike(p), noise, page(x) | of(x) | leader(x))
    kept = F.filter(lines_of(text), lambda x: ~drop(x))
    return F.array_join(blanks_once(kept, lambda x: bare(x) == ""), "\n")


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), in which c is computed once however often it is named."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _with_before(lines: Column, n: int = 1) -> Column:
    """Each line x with p, the one before it (and pp, the one before that); null before the first."""
    shifted = lambda a, k: F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.slice(a, F.lit(1), F.greatest(F.size(a) - k, F.lit(0))))
    if n == 1:
        return _bound(lines, lambda a: F.zip_with(a, shifted(a, 1), lambda x, p: F.struct(x.alias("x"), p.alias("p"))))
    pairs = lambda a: F.zip_with(a, shifted(a, 1), lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    return _bound(lines, lambda a: F.zip_with(pairs(a), F.slice(shifted(a, 2), F.lit(1), F.size(a)), lambda z, pp: F.struct(z["x"].alias("x"), z["p"].alias("p"), pp.alias("pp"))))


def blanks_once(lines: Column, blank: Callable[[Column], Column]) -> Column:
    """The lines without those blank ones that follow a blank one."""
    kept = F.filter(_with_before(lines), lambda z: ~(blank(z["x"]) & F.coalesce(blank(z["p"]), F.lit(False))))
    return F.transform(kept, lambda z: z["x"])


def parse_sections(text: str, strict_ids: bool = False, keep_empty: bool = False, preface: str = PREFACE, whole: str = WHOLE) -> list[dict]:
    """Sections of a Markdown text.

    A heading closes those of its level or deeper. A section without a body is dropped (unless keep_empty) but stays an
    ancestor. Ids count, from 0, the sections emitted so far, so after a dropped heading a number is used again, and an ancestor of the same
    id is left out of the breadcrumb; strict_ids counts headings as seen. Lines before the first heading, blank ones left out, are a section
    titled `preface`; a text without sections is one, titled `whole`.
    """
    out: list[dict] = []
    stack: list[dict] = []
    current: dict | None = None
    body: list[str] = []
    seen = 0

    def made(level: int, title: str, above: list[dict]) -> dict:
        code = CODE.match(title)
        number = seen if strict_ids else len(out)
        name = f"sec-{code[1].replace('.', '-')}-{number:04d}" if code else f"sec-{number:04d}"
        crumbs = [x["title"] for x in above if x["section_id"] != name]
        return {"section_id": name, "parent_section_id": above[-1]["section_id"] if above else None, "section_code": code[1] if code else None, "title": title, "level": level, "breadcrumb": [*crumbs, title]}

    def close() -> None:
        nonlocal seen
        if current is not None:
            content = "\n".join(body).strip()
            if content or keep_empty:
                out.append(current | {"content": content})
        elif content := "\n".join(x for x in body if x.strip()).strip():
            out.append(made(1, preface, []) | {"content": content})
            seen += 1

    for line in (text or "").splitlines():
        m = HEADING.match(line.strip())
        if not m:
            body.append(line)
            continue
        close()
        body = []
        level, title = len(m[1]), m[2].strip()
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        current = made(level, title, stack)
        seen += 1
        stack.append(current)
    close()
    if not out:
        out.append({"section_id": "sec-0000", "parent_section_id": None, "section_code": None, "title": whole, "level": 1, "breadcrumb": [whole], "content": (text or "").strip()})
    return [s | {"order_index": i} for i, s in enumerate(out)]


def local_sections(docs: DataFrame, opening: str = OPENING) -> DataFrame:
    """Sections of (document_id, text) by place, one row each, those without a body too (their content is null).

    A heading begins a section, and so does the first line; where that is no heading, the section is titled by it, or `opening` if it is blank, and
    has no breadcrumb. A level is open below the last heading of a higher one: the breadcrumb is the open titles and a section's own, the parent is
    the section that opened the level just above. Table rows are counted. Windows over a document's lines, and then over its headings; a null or empty text has no sections.
    """
    lines = docs.where("text <> ''").select("document_id", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    head = lambda k: F.regexp_extract("line", LOCAL_HEADING, k)
    lines = lines.withColumn("level", F.nullif(F.length(head(1)), F.lit(0)))
    begins = F.col("level").isNotNull() | (F.col("i") == 0)
    so_far = W.partitionBy("document_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("order_index", (F.sum(begins.cast("int")).over(so_far) - 1).cast("int"))
    own = F.col("level").isNull()
    body = F.array_sort(F.collect_list(F.when(own, F.struct("i", "line"))))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    cut = F.substring(strip(F.col("line")), 1, 50)
    title = F.when(~own, strip(head(2))).otherwise(F.when(cut == "", opening).otherwise(F.concat(cut, F.lit("..."))))
    parts = lines.groupBy("document_id", "order_index").agg(
        F.max("level").alias("heading"), F.min_by(title, "i").alias("title"), F.array_join(F.transform(body, lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("content"), F.count_if(own & F.col("line").rlike(TABLE_LINE)).cast("int").alias("table_count")
    )
    before = W.partitionBy("document_id").orderBy("order_index").rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("heading") == k, F.struct("order_index", "title")), ignorenulls=True).over(before) for k in range(1, 7)]
    parts = parts.withColumns({f"last{k}": c for k, c in enumerate(last, 1)})
    # level k is open if its last heading comes after those of all higher levels
    at = lambda k: F.coalesce(F.col(f"last{k}.order_index"), F.lit(-1))
    open_ = {k: (F.col("heading") > k) & (at(k) > (F.greatest(F.lit(-1), *[at(j) for j in range(1, k)]) if k > 1 else F.lit(-1))) for k in range(1, 6)}
    crumbs = F.array_compact(F.array(*[F.when(open_[k], F.col(f"last{k}.title")) for k in open_], F.when(F.col("heading").isNotNull(), F.col("title"))))
    name = lambda c: F.format_string("sec_%04d", c)
    parent = F.coalesce(*[F.when((F.col("heading") == k + 1) & open_[k], name(F.col(f"last{k}.order_index"))) for k in open_])
    return parts.select("document_id", name(F.col("order_index")).alias("section_id"), parent.alias("parent_section_id"), "title", F.coalesce("heading", F.lit(1)).alias("level"), crumbs.alias("breadcrumb"), F.nullif("content", F.lit("")).alias("content"), "table_count", "order_index")


def sections(docs: DataFrame, strict_ids: bool = False, keep_empty: bool = False) -> DataFrame:
    """Sections of (document_id, text), one row each, in order_index."""
    names = ["section_id", "parent_section_id", "section_code", "title", "level", "breadcrumb", "content", "order_index"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *(s[n] for n in names)) for d, t in zip(batch["document_id"], batch["text"], strict=True) for s in parse_sections(t, strict_ids, keep_empty)]
            yield pd.DataFrame(rows, columns=["document_id", *names])

    schema = "document_id long, section_id string, parent_section_id string, section_code string, title string, level int, breadcrumb array<string>, content string, order_index int"
    return docs.select("document_id", "text").mapInPandas(run, schema)


def heading_level(title: Column, level: Column) -> Column:
    """Chapters, parts and appendices are level 1, sections and articles level 2, whatever their marks say."""
    return F.when(title.rlike(r"(?iU)^\s*(chapter|part|appendix)\b"), 1).when(title.rlike(r"(?iU)^\s*(section|article)\b"), 2).otherwise(level)


def table_markdown(cells: DataFrame, key: str) -> DataFrame:
    """From cells (key, row, col, text): each table as Markdown, with a rule under row 0 and blanks for missing cells."""
    width = cells.groupBy(key).agg((F.max("col") + 1).alias("width"))
    rows = cells.groupBy(key, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(width, key)
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("width") - 1), lambda c: F.coalesce(F.col("m")[c], F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")))
    text = F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line)
    return rows.select(key, "row", text.alias("line")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("markdown"))


def split_blocks(text: Column) -> Column:
    """Blocks of a text, in order: a list item begins one, a blank line ends one, but what follows a list item directly, a blank line too, belongs to that. Lines of
    tables are neither, so a table stays whole.
    """
    item = lambda x: x.rlike(LIST_ITEM)
    ends = lambda x, p: x.rlike(r"(?U)^\s*$") & ~F.coalesce(item(p), F.lit(False))
    kept = F.filter(_with_before(lines_of(F.translate(text, "\x01", "")), 2), lambda z: ~ends(z["x"], z["p"]))
    begins = lambda z: z["p"].isNull() | item(z["x"]) | ends(z["p"], z["pp"])
    marked = F.transform(kept, lambda z: F.when(begins(z), F.concat(F.lit("\x01"), z["x"])).otherwise(z["x"]))
    return F.filter(F.split(F.array_join(marked, "\n"), "\n?\x01"), lambda b, i: i > 0)


def is_atomic(block: Column) -> Column:
    """A table or list of two lines or more is never cut."""
    many = lambda pattern: F.size(F.filter(lines_of(block), lambda x: x.rlike(pattern))) >= 2
    return many(r"^\s*\|.*\|\s*$") | many(r"^\s*([-*+]|\d+[.)])\s+")


def split_sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """At white space after a full stop, or its like in other scripts; not after an abbreviation, where it becomes one space."""
    short = "|".join(re.escape(a) for a in abbreviations)
    one = F.regexp_replace(text, rf"(?U)(?<={short})\s+", " ")
    return F.filter(F.split(one, rf"(?U)(?<=[.!?。！？])(?<!{short})\s+|(?<=[。！？])(?!\s)"), lambda x: x != "")


def chunk_units(units: list[str], budget: int, overlap: int, joiner: str = " ") -> list[str]:
    """Greedy chunks of whole units within `budget` characters; each begins with the whole units, up to `overlap` characters, that end the one before. A unit beyond the budget is a chunk of its own."""
    out: list[str] = []
    now: list[str] = []
    size = lambda u: sum(map(len, u)) + len(joiner) * max(len(u) - 1, 0)
    fresh = False
    for unit in units:
        if now and size([*now, unit]) > budget:
            if fresh:
                out.append(joiner.join(now))
            tail: list[str] = []
            while len(tail) < len(now) and size([now[-1 - len(tail)], *tail]) <= overlap:
                tail.insert(0, now[-1 - len(tail)])
            now = tail if size([*tail, unit]) <= budget else []
        now.append(unit)
        fresh = True
    if now and fresh:
        out.append(joiner.join(now))
    return out


def chunks(docs: DataFrame, budget: int = 2000, overlap: int = 300) -> DataFrame:
    """(document_id, chunk, text) of (document_id, text): a short text is one chunk; a longer one is cut at blocks, and at sentences where a block is not a table or list."""
    units = F.flatten(F.transform(split_blocks(F.col("text")), lambda b: F.when(is_atomic(b), F.array(b)).otherwise(split_sentences(b))))
    d = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("document_id", F.when(F.length("text") <= budget, F.array("text")).otherwise(units).alias("units"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c) for d, u in zip(batch["document_id"], batch["units"], strict=True) for i, c in enumerate(chunk_units(list(u), budget, overlap))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk", "text"])

    return d.mapInPandas(run, "document_id long, chunk int, text string")


#: Ways to cut a text, from the coarsest: at empty paragraphs, sentences, clauses, words. Each keeps what it cuts at.
_CUTS = (re.compile(r".+?(?:\n\n\n|\Z)", re.S), re.compile(r".+?(?:[.!?。！？]+\s+|[。！？]|\n|\Z)", re.S), re.compile(r".+?(?:[,.;。？！]|\Z)", re.S), re.compile(r".+?(?:\s+|\Z)", re.S))


def estimated_tokens(text: str) -> int:
    """Words and marks, or a quarter of the characters if that is more."""
    return max(len(re.findall(r"\w+|[^\w\s]", text)), -(-len(text) // 4))


def _pieces(text: str, start: int, size: int, count: Callable[[str], int], way: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of pieces of at most `size` tokens each, cut as coarsely as that allows; what no way cuts is halved."""
    n = count(text)
    if n <= size or len(text) < 2:
        yield start, start + len(text), n
        return
    if way < len(_CUTS):
        parts = [(m.start(), m.group()) for m in _CUTS[way].finditer(text)]
    else:
        half = len(text) // 2
        parts = [(0, text[:half]), (half, text[half:])]
    for at, part in parts:
        yield from _pieces(part, start + at, size, count, way + 1 if len(parts) > 1 or way < len(_CUTS) else way)


def token_spans(text: str, size: int = 1024, overlap: int = 100, count: Callable[[str], int] = estimated_tokens) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `size` tokens that cover a text; each but the first begins with the whole pieces, up to `overlap` tokens, that end the one before, if the next piece still fits."""
    out: list[tuple[int, int]] = []
    now: list[tuple[int, int, int]] = []
    held = 0
    for piece in _pieces(text, 0, size, count) if text else ():
        if now and held + piece[2] > size:
            out.append((now[0][0], now[-1][1]))
            tail, kept = len(now), 0
            while tail > 1 and kept + now[tail - 1][2] <= min(overlap, size - piece[2]):
                tail -= 1
                kept += now[tail][2]
            now, held = now[tail:], kept
        now.append(piece)
        held += piece[2]
    return [*out, (now[0][0], now[-1][1])] if now else out


def index_chunks(sections: DataFrame, whole: int = 2000, size: int = 1024, overlap: int = 100, count: Callable[[str], int] = estimated_tokens) -> DataFrame:
    """(document_id, section_id, chunk, start, end, window, text) of sections (document_id, section_id, document_title, heading, breadcrumb, content).

    Contents are stripped; empty ones have no chunk. Up to `whole` characters a content is one chunk, else it is cut by a budget of tokens. window is
    a chunk's part of the content, text has the section's context before it; start and end are places in the content.
    """
    c = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    crumbs = F.coalesce(F.nullif("breadcrumb", F.lit("")), F.col("heading"))
    # The words of the context prefix.
    prefix = F.concat(F.lit("[Tài liệu: "), F.coalesce("document_title", F.lit("")), F.lit(" | Mục: "), F.coalesce("heading", F.lit("")), F.lit("]\nĐường dẫn: "), F.coalesce(crumbs, F.lit("")), F.lit("\n\n"))
    s = sections.select("document_id", "section_id", prefix.alias("prefix"), c.alias("content")).where("content <> ''")
    short = s.where(F.length("content") <= whole).select("document_id", "section_id", F.lit(0).alias("chunk"), F.lit(0).alias("start"), F.length("content").alias("end"), F.col("content").alias("window"), "prefix")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, s, i, a, b, t[a:b].strip(), p) for d, s, p, t in batch.itertuples(index=False) for i, (a, b) in enumerate(token_spans(t, size, overlap, count))]
            yield pd.DataFrame(rows, columns=["document_id", "section_id", "chunk", "start", "end", "window", "prefix"])

    both = short.unionByName(s.where(F.length("content") > whole).mapInPandas(run, short.schema))
    return both.select("document_id", "section_id", "chunk", "start", "end", "window", F.concat("prefix", "window").alias("text"))


def refine(text: Column) -> Column:
    """White space of any kind to one space, a space between a full stop and a capital, trimmed."""
    c = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(c, r"(?<=[.!?])(?=\p{Lu})", " "))


# The kinds of nodes, and what marks each.
NODE_KINDS = ("section", "subsection", "paragraph", "table", "code_block", "image", "page")


def node_type(text: Column, given: Column | None = None) -> Column:
    """The kind that is given, if it is one (in any case); else by the text: code, a table of fewer than 20 line ends, a heading, or a paragraph."""
    text = F.coalesce(text, F.lit(""))
    has = lambda *marks: reduce(lambda a, m: a | F.contains(text, F.lit(m)), marks, F.lit(False))
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    kind = F.when(has("```", "def ", "class "), "code_block").when(has("|") & (ends < 20), "table").when(F.startswith(text, F.lit("#")), "section").otherwise("paragraph")
    if given is None:
        return kind
    return F.coalesce(F.when(F.lower(given).isin(*NODE_KINDS), F.lower(given)), kind)


def persists(title: Column, content: Column, images: Column, tables: Column) -> Column:
    """Whether a section has anything: a title, content, an image or a table."""
    filled = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") != "", F.lit(False))
    return filled(title) | filled(content) | (F.coalesce(images, F.lit(0)) > 0) | (F.coalesce(tables, F.lit(0)) > 0)


_OVERRIDES = ((re.compile(r"^\s*(chapter|part|appendix)\b", re.I), 1), (re.compile(r"^\s*(section|article)\b", re.I), 2))


def parse_items(items: list[tuple[str, int | None, str]], deepest: int = 3) -> list[dict]:
    """Sections of a parsed document's items (kind, level, text), in order.

    A title is level 0 and closes everything. Headings deeper than `deepest` belong to the body. Page headers and footers are
    ignored, pictures and tables counted, tables kept as text. Sections with any content, title, picture or table are kept.
    """
    out: list[dict] = []
    stack: list[dict] = []
    now: dict | None = None

    def begin(title: str, level: int) -> dict:
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        s = {"section_id": f"sec_{len(out) + 1:04d}", "parent_section_id": parent["section_id"] if parent else None, "title": title, "level": level, "breadcrumb": [*(parent["breadcrumb"] if parent else []), title], "body": [], "pictures": 0, "tables": 0}
        stack.append(s)
        out.append(s)
        return s

    for kind, level, text in items:
        if kind in ("page_header", "page_footer"):
            continue
        if kind in ("title", "heading"):
            depth = 0 if kind == "title" else next((n for p, n in _OVERRIDES if p.match(text)), level or 1)
            if depth <= deepest:
                now = begin(text, depth)
                continue
        if now is None:
            now = begin("", 1)
        if kind == "picture":
            now["pictures"] += 1
        else:
            now["tables"] += kind == "table"
            now["body"].append(text)
    for i, s in enumerate(out):
        s["content"] = "\n".join(s.pop("body")).strip()
        s["order_index"] = i
    return [s for s in out if s["content"] or s["title"] or s["pictures"] or s["tables"]]


def item_sections(items: DataFrame) -> DataFrame:
    """Sections of items (document_id, seq, kind, level, text); a document's items are brought together, in order of seq."""
    names = ["section_id", "parent_section_id", "title", "level", "breadcrumb", "content", "pictures", "tables", "order_index"]
    g = items.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "level", "text"))).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *(s[n] for n in names)) for d, x in zip(batch["document_id"], batch["items"], strict=True) for s in parse_items([(i["kind"], i["level"], i["text"]) for i in x])]
            yield pd.DataFrame(rows, columns=["document_id", *names])

    schema = "document_id long, section_id string, parent_section_id string, title string, level int, breadcrumb array<string>, content string, pictures int, tables int, order_index int"
    return g.mapInPandas(run, schema)
