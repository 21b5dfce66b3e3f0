"""Secret scan: base patterns, and password guess costs for values in a credential context.

Base patterns (leftmost, not overlapping, each kind for itself) find assignments, access keys and hex
strings. Besides, every value that stands after a credential word is costed by dynamic programming: the cheapest
segmentation into words, dates, repeats, keyboard walks and brute-force spans, each with its number of
guesses, gives log10 of the guesses an informed attacker needs. A value that costs `MIN_GUESSES` or more
and lies within no base span is added as kind `guess`; it may overlap base spans, which stay.

Words for the segmentation are a ranked list and a parameter. By default they are the list stated below, then the `DICTIONARY` most frequent
words (letters only) of the texts themselves, without those in base spans and in values of a credential context, so that a secret
does not become a word by being repeated.

Defined results: null and empty texts have no spans; values of any length are costed; repeated documents give a row each; an empty table gives no rows; other columns are left out. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import saved

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer can't hold one of 16
#: Credential context of the costed values.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|pass|secret|token|credentials?|auth|api_?key)["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?([^\s"'<>]{6,})""", re.I | re.A)

#: log10 of the guesses from which a value counts as a secret.
MIN_GUESSES = 8.0

#: Most words of the texts that join the list (a bound on what is sent to each task), their letters, and how often they occur at least.
DICTIONARY, LETTERS, OFTEN = 1 << 16, (3, 24), 2

# Rows of the keyboard layouts that walks follow, and a ranked list of common words.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
WORDS = (
    "password the and for you that this with admin user test root login welcome secret master access monkey dragon letmein football baseball "
    "shadow sunshine princess iloveyou abc love pass guest default changeme example sample demo public private server system data home "
    "mysql oracle postgres database token key api auth service account email name hello world summer winter spring autumn january february "
    "march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "company office internet computer network windows linux google apple string value your here none null true false"
).split()

_LEET = str.maketrans("@4301$5", "aaeoiss")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)?\d\d")


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, c in enumerate(row):
            for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)):
                if 0 <= v < len(KEYBOARD) and 0 <= u < len(KEYBOARD[v]):
                    near.setdefault(c, set()).add(KEYBOARD[v][u])
    return {c: "".join(sorted(s)) for c, s in near.items()}


_NEAR = _neighbours()


class Guesser:
    """log10 of the guesses that a value takes, by the cheapest segmentation."""

    def __init__(self, words=WORDS):
        self.rank = {}
        for i, w in enumerate(words, 1):
            if w:
                self.rank.setdefault(w.lower(), i)
        self.longest = max(map(len, self.rank), default=0)

    def _pool(self, c: str) -> int:
        return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100

    def pieces(self, s: str) -> Iterator[tuple[int, int, float, str]]:
        """(start, end, log10 of guesses, kind) of every part of s that an attacker would not try letter by letter."""
        low = s.lower()
        plain = low.translate(_LEET)
        for i in range(len(s)):
            for j, cost, kind in self.pieces_at(s, low, plain, i):
                yield i, j, cost, kind

    def pieces_at(self, s: str, low: str, plain: str, i: int) -> Iterator[tuple[int, float, str]]:
        """(end, log10 of guesses, kind) of the parts that begin at i; `low` and `plain` are s in lower case, and that with letters for digits."""
        n = len(s)
        for j in range(i + 2, min(n, i + self.longest) + 1):
            for k, extra in ((low, 0.0), (plain, 0.6)):
                if (rank := self.rank.get(k[i:j])) is not None:
                    upper = sum(c.isupper() for c in s[i:j])
                    case = 0.0 if not upper else 0.3 if upper == j - i or (upper == 1 and s[i].isupper()) else math.log10(max(2, math.comb(j - i, upper)))
                    yield j, math.log10(rank + 1) + extra + case, "word"
                    break
        if m := _DATE.match(s, i):
            yield m.end(), 2.2 if m.end() - i == 4 else 4.6, "date"
        for size in (1, 2, 3, 4):  # the unit that repeats
            j = i + size
            while j + size <= n and s[j : j + size] == s[i : i + size]:
                j += size
            if j - i >= max(3, 2 * size):
                yield j, size * math.log10(self._pool(s[i])) + math.log10((j - i) // size), "repeat"
        j, turns, way = i + 1, 0, None
        while j < n and low[j] in _NEAR.get(low[j - 1], ""):
            step = _NEAR[low[j - 1]].index(low[j])
            turns += step != way
            way = step
            j += 1
        if j - i >= 3:
            yield j, math.log10(47 * (j - i)) + turns * math.log10(5), "walk"

    def reaches(self, s: str, least: float) -> bool:
        """Whether the cheapest segmentation of s costs `least` or more.

        Parts cost something, so only places that are reached for less go on, and the answer is known when none is left: the work
        follows what can be reached for `least`, not the length of s.
        """
        if least <= 0:
            return True
        low = s.lower()
        plain = low.translate(_LEET)
        n = len(s)
        best, open_ = {0: 0.0}, [0]
        while open_:
            i = heapq.heappop(open_)
            if i == n:
                return False
            new = 0.3 if i else 0.0
            steps = [(j, best[i] + cost + new) for j, cost, _ in self.pieces_at(s, low, plain, i)]
            for j, cost in [(i + 1, best[i] + math.log10(self._pool(s[i]))), *steps]:
                if cost < least:
                    if j not in best:
                        heapq.heappush(open_, j)
                    best[j] = min(cost, best.get(j, cost))
        return True

    def cheapest(self, s: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The cost of s and the parts of its cheapest segmentation."""
        at: dict[int, list] = {}
        for i, j, cost, kind in self.pieces(s):
            at.setdefault(j, []).append((i, cost, kind))
        best = [(0.0, 0, "")]
        for j in range(1, len(s) + 1):
            # brute force goes on one character at a time; a new part costs a factor of 2 for where it begins
            found = (best[j - 1][0] + math.log10(self._pool(s[j - 1])), j - 1, "brute")
            for i, cost, kind in at.get(j, ()):
                if best[i][0] + cost + (0.3 if i else 0.0) < found[0]:
                    found = (best[i][0] + cost + (0.3 if i else 0.0), i, kind)
            best.append(found)
        parts, j = [], len(s)
        while j:
            parts.append((best[j][1], j, best[j][2]))
            j = best[j][1]
        return best[-1][0], parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], guesser: Guesser, least: float = MIN_GUESSES) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost `least` or more and lie within no base span (`base` by start). Both lists are walked once."""
    found = []
    if "=" not in text and ":" not in text:
        return found
    reach, k = -1, 0  # the farthest end of base spans that begin no later than a value
    for m in CONTEXT.finditer(text):
        s, e = m.span(1)
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if e > reach and guesser.reaches(text[s:e], least):
            found.append((s, 3, e))
    return found


_WORD = re.compile(r"[^\W\d_]+")


def _open_words(text: str) -> list[str]:
    """The words of a text in lower case, outside base spans and values of a credential context."""
    hidden = [(s, e) for s, _, e in base_spans(text)]
    if "=" in text or ":" in text:
        hidden += [m.span(1) for m in CONTEXT.finditer(text)]
    low, high = LETTERS
    return [w for w in _WORD.findall((redact(text, hidden, " ") if hidden else text).lower()) if low <= len(w) <= high]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches):
        found = Counter()
        for text in batch.column("text").to_pylist():
            found.update(_open_words(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def ranked_words(docs: DataFrame, most: int = DICTIONARY) -> tuple[str, ...]:
    """WORDS, and the most frequent words of all texts, `most` at most, by falling count.

    Counts stay a distributed table. The driver sees the number of words in each class of counts (64 classes to a power of
    two), and then only the words of the highest classes that together have `most` words or fewer.
    """
    words = X.only(docs, "text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(words.where(F.col("n") >= OFTEN).withColumn("class", F.floor(F.log2("n") * 64).cast("int")))
    least, total = None, 0
    for k, n in sorted(counts.groupBy("class").count().collect(), reverse=True):
        if total + n > most:
            break
        least, total = k, total + n
    top = counts.where(F.col("class") >= least).select("word", "n").collect() if total else []
    return (*WORDS, *(r["word"] for r in sorted(top, key=lambda r: (-r["n"], r["word"]))))


def _scan(words: tuple[str, ...], least: float):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words)
        for batch in X.slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + guess_spans(text, base, guesser, least))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], schema=schema)

    return run


def find_secrets(docs: DataFrame, words: tuple[str, ...] | None = None, least: float = MIN_GUESSES) -> DataFrame:
    """doc_id and spans (kind, start, end; by start, then kind) of every row of `docs`. Without `words`, those of the texts are counted first; nothing else is shuffled."""
    words = ranked_words(docs) if words is None else words
    return X.only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(words, least), "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]



def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
    )


def redact_secrets(docs: DataFrame, words: tuple[str, ...] | None = None, least: float = MIN_GUESSES, mark: str = "[secret]") -> DataFrame:
    """The rows of `docs`, all columns, with every secret in their texts replaced by a mark. Words are those of `find_secrets`.

    A row without a secret stays as it is (a null text null); one with a secret has the new text's length in n_chars.
    """
    words = ranked_words(docs) if words is None else words

    def make():
        guesser = Guesser(words)

        def change(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = {}
            for i, text in enumerate(batch.column("text").to_pylist()):
                base = base_spans(text or "")
                if spans := [(s, e) for s, _, e in base + guess_spans(text or "", base, guesser, least)]:
                    texts[i] = redact(text, spans, mark)
            return X.with_texts(batch, texts) if texts else batch

        return change

    return X.rewritten(docs, make)
