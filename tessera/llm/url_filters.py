"""URL filters that see through aliases, with DataFrame and SQL functions only.

A rule is (verdict, host, path): it fits its host and all subdomains, where the url's path starts with the rule's; of those that
fit, the longest (host and path together) decides, on a tie an allow rule. What no rule decides takes part in the decisions of its
aliases: redirects (`<meta http-equiv=refresh>`, or a table of them) and canonical links (`<link rel=canonical>`) are edges
between addresses, the classes are their connected components, and a class with an address that a rule blocks is blocked - but for addresses that a
rule allows by name, which stay allowed. Link targets count whether or not there is a page for them.

An address is host, path (`/` if empty) and query; scheme and fragment are left out, since they don't tell resources apart. Links are
resolved against the page's url; links of other schemes (`mailto:`), to a fragment, or in comments and scripts are none.

Rules are a list of the caller's that is compiled into the plan, meant for hundreds of them.

Scale: texts are read in one pass and never shuffled; edges hold addresses only, each once. A hub that very many addresses link to is a
hot key of joins against written tables, which Spark splits. Only addresses of blocked classes meet the pages again.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and has no address, so it is allowed; null
html has no links; repeated rows are judged alike; an empty table gives no row; columns beyond page_id, url and html are left out, whatever their
names; without rules everything is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._spark import checkpointed, components

Rule = tuple[str, str, str]

_PARTS = r"^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_CANONICAL = r"""(?i)[\s"'/]rel\s*=\s*("[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?i)[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CONTENT = r"""(?is)[\s"'/]content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_TARGET = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)" + _PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)" + _PARTS, 2)


def address(url: Column) -> Column:
    """Host, path and query of a url with `://`; null for others."""
    query = F.regexp_extract(url, r"(?s)" + _PARTS, 3)
    where = F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), F.when(query == "?", "").otherwise(query))
    return F.when(F.contains(url, F.lit("://")), where)


def decision(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """struct(length, allows, rule, verdict) of the rule that decides; null where none fits."""
    none = F.lit(None).cast("struct<length:int,allows:boolean,rule:string,verdict:string>")
    found = [none, none]
    for verdict, h, p in rules:
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        this = F.struct(F.lit(len(h + p)).alias("length"), F.lit(verdict == "allow").alias("allows"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found.append(F.when(fits, this))
    return F.greatest(*found)


def _resolved(link: Column, url: Column) -> Column:
    """The url that a link leads to from a page's, null where it leads to none."""
    t = F.replace(F.btrim(link, F.lit(" \t\r\n\f")), F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("x://"), host(url))
    folder = F.coalesce(F.nullif(F.regexp_extract(path(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when((t == "") | F.startswith(t, F.lit("#")), None)
        .when(t.rlike(_SCHEME + "//"), t)
        .when(t.rlike(_SCHEME), None)
        .when(F.startswith(t, F.lit("//")), F.concat(F.lit("x:"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(base, t))
        .when(F.startswith(t, F.lit("?")), F.concat(base, path(url), t))
        .otherwise(F.concat(base, folder, t))
    )


def links(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that the pages (url, html) declare to be one, by canonical links and immediate redirects."""
    html = F.regexp_replace("html", _UNSEEN, "")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
    value = lambda c, pattern, n: F.concat(*[F.regexp_extract(c, pattern, k + 1) for k in range(n)])
    canonical = F.transform(F.filter(tags("link"), lambda t: t.rlike(_CANONICAL)), lambda t: value(t, _HREF, 3))
    refresh = F.transform(F.filter(tags("meta"), lambda t: t.rlike(_REFRESH)), lambda t: F.regexp_extract(value(t, _CONTENT, 2), _TARGET, 1))
    # a cheap test first: most pages have neither
    some = pages.where(F.contains("url", F.lit("://")) & F.col("html").rlike("(?i)canonical|http-equiv"))
    out = some.select(F.col("url"), F.explode(F.concat(canonical, refresh)).alias("link"))
    return out.select(address(F.col("url")).alias("a"), address(_resolved(F.col("link"), F.col("url"))).alias("b"))


def blocked_aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(address), each once: those whose class holds an address that a rule blocks."""
    edges = edges.where("a is not null and b is not null and a <> b").distinct()
    classes = checkpointed(components(edges, hubs=True))
    url = F.concat(F.lit("x://"), "id")
    blocks = decision(host(url), path(url), rules)["verdict"] == "block"
    bad = checkpointed(classes.where(blocks).select("component").distinct())
    return classes.join(bad, "component").select(F.col("id").alias("address"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url, html). `redirects`: more edges (source, target; urls)."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")))
    bad = checkpointed(blocked_aliases(edges, rules)).withColumn("bad", F.lit(True))
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    judged = judged.withColumn("by", decision(F.col("host"), F.col("path"), rules))
    # only what no rule decides asks for its class
    asked = F.when(F.col("by").isNull(), F.col("address"))
    out = judged.withColumn("address", asked).join(bad, "address", "left")
    return out.select("page_id", "host", "path", F.col("by")["rule"].alias("rule"), F.coalesce(F.col("by")["verdict"], F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


#: Rules of the contract.
RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _oracle() -> str:
    e = lambda pattern: pattern.replace("'", "''")
    parts = lambda url, n: f"regexp_extract({url}, '(?s){_PARTS}', {n})"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    addr = lambda url: f"CASE WHEN contains({url}, '://') THEN {low.format(parts(url, 1))} || CASE {parts(url, 2)} WHEN '' THEN '/' ELSE {parts(url, 2)} END || CASE {parts(url, 3)} WHEN '?' THEN '' ELSE {parts(url, 3)} END END"
    values = lambda tag, pattern, n: " || ".join(f"regexp_extract({tag}, '{e(pattern)}', {k + 1})" for k in range(n))
    rules = ", ".join(f"({k}, '{v}', '{h}', '{p}')" for k, (v, h, p) in enumerate(RULES))
    fits = "(h = r.host OR ends_with(h, '.' || r.host)) AND starts_with(p, r.path)"
    best = "ORDER BY length(r.host || r.path) DESC, r.verdict LIMIT 1"
    return f"""
WITH RECURSIVE rules(k, verdict, host, path) AS (VALUES {rules}),
p AS (SELECT page_id, url, html, {low.format(parts("coalesce(url, '')", 1))} AS h, {parts("coalesce(url, '')", 2)} AS p, {addr("url")} AS node FROM pages),
seen AS (SELECT url, h, p, node, regexp_replace(html, '{_UNSEEN}', '', 'g') AS html FROM p WHERE node IS NOT NULL AND html IS NOT NULL),
tags AS (
  SELECT url, h, p, node, {values("t", _HREF, 3)} AS link FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) AS t FROM seen) x WHERE regexp_matches(t, '{e(_CANONICAL)}')
  UNION ALL
  SELECT url, h, p, node, regexp_extract({values("t", _CONTENT, 2)}, '{e(_TARGET)}', 1) FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS t FROM seen) x WHERE regexp_matches(t, '{e(_REFRESH)}')),
trimmed AS (SELECT *, replace(trim(link, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '&amp;', '&') AS t FROM tags),
urls AS (SELECT node, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '{_SCHEME}//') THEN t WHEN regexp_matches(t, '{_SCHEME}') THEN NULL
  WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN 'x://' || h || t WHEN starts_with(t, '?') THEN 'x://' || h || p || t
  ELSE 'x://' || h || coalesce(nullif(regexp_extract(p, '(?s)^(.*/)', 1), ''), '/') || t END AS target FROM trimmed),
edges AS (SELECT node AS a, {addr("target")} AS b FROM urls WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
nodes AS (SELECT DISTINCT a, {low.format(parts("'x://' || a", 1))} AS h, {parts("'x://' || a", 2)} AS p FROM both_ways),
judged AS (SELECT a, (SELECT r.verdict FROM rules r WHERE {fits} {best}) AS v FROM nodes),
bad(a) AS (SELECT a FROM judged WHERE v = 'block' UNION SELECT b.b FROM bad JOIN both_ways b ON b.a = bad.a),
ruled AS (SELECT p.*, (SELECT r.k FROM rules r WHERE {fits} {best}) AS k FROM p)
SELECT page_id, h AS host, p AS path, r.host || r.path AS rule,
  coalesce(r.verdict, CASE WHEN node IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN rules r ON r.k = ruled.k
"""


ORACLE = _oracle()
