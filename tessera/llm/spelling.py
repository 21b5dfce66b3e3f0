"""Groups of spelling variants by symmetric deletes.

Words are runs of Latin letters, counted over all texts. Two words are near if they differ by exactly one inserted, deleted or
replaced code point. Every word emits itself and each distinct word that one deletion makes of it; words that share a key are candidates, and
exact verification keeps those at distance one. A word's form is its most frequent near word, if that is RATIO times as frequent; forms are
followed to the root of each group.

Keys are 64-bit hashes of code points, taken for all deletions of a word at once from prefix sums, so a word of n letters costs n short rows and not n copies
of itself; the words themselves come back by the ids of the candidate pairs. A key of n letters has at most one word for each letter and place
(64 n) and itself, so no key is frequent, however frequent its words: the join is on distinct words. Counts are combined in each task before they are shuffled.
Each form is RATIO times as frequent as its word, so paths to the roots are as short as the logarithm of the largest count; they are halved in each round.

Defined results: null and empty texts have no words; a null doc_id is an empty one in the damage of the contract; repeated rows count
as often as they come; ties between near words of one count go to the smallest in code-point order; an empty table gives no row; other columns
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._spark import checkpointed, saved
from tessera.llm._text import mix, slices

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every run of letters of every text, with A-Z lower-cased."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))


def misspelt(run: Column, doc_id: Column) -> Column:
    """The run as the contract damages it: one code point out where the CRC of document and run is divisible by 31."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of a column `word`: those of at least so many code points and occurrences."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _wrapping(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (id, key): hashes of the word and of its distinct single deletions."""
    for batch in slices(batches, 1 << 18, "word"):
        words = batch.column("word").to_pylist()
        ids = batch.column("id").to_numpy()
        size = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(code)) - first[row]
        with np.errstate(over="ignore"):
            term = mix(code + np.uint64(1)) * _wrapping(_STEP, int(size.max(initial=1)))[place]
            upto = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(term, out=upto[1:])
            ends = first + size
            whole = upto[ends] - upto[first]
            # what stands before the place, and what stands after it moved one to the left
            less = upto[:-1] - upto[first][row] + (upto[ends][row] - upto[1:]) * np.uint64(_BACK)
        # deletions within a run of one letter are one word: keep the last
        last = np.ones(len(code), bool)
        last[:-1] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        key = np.concatenate([mix(whole + size.astype(np.uint64)), mix(less[last] + (size[row[last]] - 1).astype(np.uint64))])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, ids[row[last]]])), pa.array(key.view(np.int64))], names=["id", "key"])


def _one_apart(a: Column, b: Column) -> Column:
    """Exactly one insertion, deletion or replacement between two words; the threshold keeps it linear."""
    return F.levenshtein(a, b, 1) == 1


def near(words: DataFrame) -> DataFrame:
    """(a, b): ids of near words, each pair both ways once, of words (id, word)."""
    keys = saved(words.select("id", "word").mapInArrow(_keys, "id long, key long"))
    pairs = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()
    with_a = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("wa")), "a")
    both = with_a.join(words.select(F.col("id").alias("b"), F.col("word").alias("wb")), "b").where(_one_apart(F.col("wa"), F.col("wb"))).select("a", "b")
    return both.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n), words each once."""
    words = saved(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    links = saved(near(words))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form", "b", "form_n"))
    top = links.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), best.alias("top"))
    rows = words.join(top.withColumnRenamed("a", "id"), "id", "left")
    enough = F.col("top.form_n") >= ratio * F.col("n")
    rows = saved(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(enough, F.col(f"top.{c}")).alias(d) for c, d in (("form", "form"), ("form_n", "form_n"), ("b", "next"))]))
    jumps = checkpointed(rows.where("next is not null").select("id", "next"))
    while True:
        # each path is halved: where a next has a next of its own, go on to that
        further = jumps.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jumps = checkpointed(jumps.join(further, "next", "left").select("id", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moved")))
        moved = jumps.where("moved").count()
        jumps = jumps.select("id", "next")
        if not moved:
            break
    roots = jumps.join(words.select(F.col("id").alias("next"), F.col("word").alias("root")), "next").select("id", "root")
    out = rows.join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(counted(runs(docs).select(misspelt(F.col("run"), F.col("doc_id")).alias("word"))))


#: CRC-32 over bytes by a table that the query makes; near words by keys as strings: one replaced (the same place left out of both), or one left out of the other.
ORACLE = r"""
WITH RECURSIVE steps(i, k, c) AS (SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT d, run, n, list_transform(range(0, CAST(length(hex(encode(d || ':' || run))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(d || ':' || run)), 2 * i + 1, 2) AS UBIGINT)) AS b FROM each),
hashed AS (SELECT d, run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b), lambda a, x: xor(t[CAST(xor(a & 255, x) AS BIGINT) + 1], a >> 8)), CAST(4294967295 AS UBIGINT)) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
keys AS (SELECT word, word AS key, -1 AS i FROM words UNION ALL SELECT word, substr(word, 1, i) || substr(word, i + 2), i FROM (SELECT word, unnest(range(length(word))) AS i FROM words) x),
near AS (SELECT DISTINCT a.word AS a, b.word AS b FROM keys a JOIN keys b ON a.key = b.key WHERE a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
ranked AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, encode(b)) AS r FROM near JOIN words w ON w.word = b),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.b END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
paths AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT p.word, f.form, k + 1 FROM paths p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM paths GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN roots USING (word)
"""
