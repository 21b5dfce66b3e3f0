"""Text functions as column expressions. Lists of phrases and words are parameters; patterns treat letters of all scripts alike."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Example lexicons of the queries; callers bring their own.
PHRASES = ("please tell me", "could you")
STOPWORDS = ("the", "a", "of", "and", "is")
GREETINGS = ("hello", "hi", "good morning", "hey there")
NO_ANSWER = ("no information", "not found in the documents", "cannot answer")
NO_ANSWER_UNCITED = ("i am not sure", "please contact")


def normalise_query(text: Column, phrases: tuple[str, ...] = PHRASES, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower case, listed phrases out, punctuation to spaces, white space collapsed, stopwords out."""
    c = F.lower(F.coalesce(text, F.lit("")))
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(" "))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(*stopwords) & (w != "")), " ")


def raw_form(text: Column) -> Column:
    """Lower case with punctuation taken out and white space collapsed."""
    c = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def query_hash(text: Column, phrases: tuple[str, ...] = PHRASES, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """SHA-256 of the normalised query; of the raw form if nothing is left; null for a blank."""
    form = F.coalesce(F.nullif(normalise_query(text, phrases, stopwords), F.lit("")), raw_form(text))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.sha2(form, 256))


def faq_hashes(questions: Column) -> Column:
    """Both hashes of a question and its variants, each once, in order."""
    both = F.flatten(F.transform(questions, lambda q: F.array(query_hash(q), F.when(F.trim(q) != "", F.sha2(raw_form(q), 256)))))
    return F.array_distinct(F.filter(both, lambda h: h.isNotNull()))


def cache_key(prefix: str, tenant: Column, documents: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), tenant.cast("string"), documents, F.sha2(text, 256))


def document_set_key(ids: Column, tenant: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted ids; the tenant where there are none."""
    return F.when(F.size(ids) > 0, F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 16)).otherwise(tenant.cast("string"))


def slug(text: Column) -> Column:
    """Null where fewer than two characters are left."""
    c = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-"), "-+", "-")
    c = F.regexp_replace(c, "^-|-$", "")
    return F.when(F.length(c) >= 2, c)


def is_greeting(text: Column, greetings: tuple[str, ...] = GREETINGS, most: int = 120) -> Column:
    return (F.length(text) <= most) & text.rlike(r"(?iU)^\s*(" + "|".join(greetings) + r")\b[\s!.,?]*$")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.lower(text), F.lit(p.lower()))
    return out


def is_no_answer(text: Column, uncited: Column, marker: str = "NO_ANSWER", phrases=NO_ANSWER, more=NO_ANSWER_UNCITED) -> Column:
    """Blank, the marker itself, or a listed phrase; some phrases count only where citations are known to be empty."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return blank | (F.trim(text) == marker) | contains_any(text, phrases) | (uncited & contains_any(text, more))


def section_code(title: Column) -> Column:
    """`1.2.3` at the start, before `)`, `.`, `:`, white space or the end; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(title), r"^(\d+(?:\.\d+)*)(?:[).:]|\s|$)", 1), F.lit(""))


def has_section_code(text: Column) -> Column:
    return text.rlike(r"\b\d+(?:\.\d+)+\b")


def terms(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def takes_section_route(text: Column, chars: int = 96, words: int = 12) -> Column:
    """Names a section, or is short in characters and in words."""
    return has_section_code(text) | ((F.length(text) <= chars) & (F.size(terms(text)) <= words))


def preview(text: Column, chars: int = 240) -> Column:
    c = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def page_range(explicit: Column, start: Column, end: Column) -> Column:
    pair = F.when(start.isNotNull() & end.isNotNull() & (start != end), F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), pair, start.cast("string"), end.cast("string"))


def breadcrumb(path: Column) -> Column:
    return F.array_join(path, " > ")


def section_id(code: Column, n: Column) -> Column:
    """`sec-1-2-0007`, or `sec-0007` without a code."""
    number = F.lpad(n.cast("string"), 4, "0")
    return F.when(code.isNotNull(), F.concat(F.lit("sec-"), F.replace(code, F.lit("."), F.lit("-")), F.lit("-"), number)).otherwise(F.concat(F.lit("sec-"), number))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def uuid7(ts: Column, entropy: Column) -> Column:
    """Time-ordered UUID (version 7) from a time and 20 or more hex digits."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(ts.cast("timestamp")))), 12, "0")
    e = F.lower(entropy)
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(e, 1, 3), F.lit("-a"), F.substring(e, 4, 3), F.lit("-"), F.substring(e, 7, 12))


def uuid_or_null(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(text))


def file_format(name: Column) -> Column:
    """Format token of a file name: known extensions are mapped, others stay, none is `unknown`."""
    # Extensions and their formats.
    known = {"md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "htm": "html", "html": "html", "jpg": "image", "jpeg": "image", "png": "image", "pdf": "pdf", "docx": "docx"}
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(table[ext], F.nullif(ext, F.lit("")), F.lit("unknown"))


def mask_ip(ip: Column) -> Column:
    """First three octets of IPv4, first three groups of IPv6."""
    v4 = F.concat(F.array_join(F.slice(F.split(ip, r"\."), 1, 3), "."), F.lit(".0"))
    v6 = F.concat(F.array_join(F.slice(F.split(ip, ":"), 1, 3), ":"), F.lit("::"))
    return F.when(F.contains(ip, F.lit(":")), v6).otherwise(v4)


def client_ip(real: Column, forwarded: Column, peer: Column) -> Column:
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.nullif(F.trim(real), F.lit("")), F.nullif(first, F.lit("")), peer)


def strip_suffix(url: Column, suffix: str) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), suffix.replace(".", r"\.") + "$", "")


def clean_terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Terms of more than one character of lower-cased text without punctuation, less stopwords."""
    # whatever is no word character, and the underscore, parts terms: one pattern does for punctuation, line ends and spaces
    return F.filter(F.split(F.lower(text), r"(?U)[\W_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
