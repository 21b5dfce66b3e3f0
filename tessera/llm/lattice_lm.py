"""Language-model scores from subword lattices: the marginal probability of a text over all segmentations.

A word's lattice has an arc for every piece of an existing subword vocabulary that spells a part of it, and, if the
corpus has the word, one arc for all of it. The forward recursion adds, in log space, the weight of every path. Weights are learnt:

* pieces: a word is one piece that begins it (with the space before the word), then pieces that go on, then its end. Those that begin
  have one distribution, those that go on and the end another, so nothing goes to what can't follow. The vocabulary's order
  gives first scores (a piece's share falls with its rank); `rounds` of expectation maximisation over the distinct words of the training
  texts (0: the vocabulary's own scores) turn them into unigram probabilities. Single bytes are always pieces, so every text has a
  probability.
* whole words: their count in the training texts, less `DISCOUNT`, over all tokens. What the discounts free goes to
  the pieces' paths. Every text ends in one end token, counted as a word.

The probability of a text is the product over its words and its end; log10 of it is the score. `base_score` is that of
a plain unigram model of words with half a count added.

Counts cover all words of all training texts: they are summed map-side and by word, and stay a distributed table. Words
that are frequent (at most `HEAD` words and `HEAD_BYTES` bytes of them: a bound on what is broadcast; single ones of `LONG_BYTES` at most) are scored where texts lie;
the others of each text go through a join with the table, in which a text has a word once. A word beyond these bounds that very many texts hold is a
hot key of that join, which is one of plain exchanges, so Spark splits it.

Defined results: a null or empty text consists of its end; with no training texts all words are unknown and the
pieces keep their first scores; rows with a null doc_id are held back from training and are not marked held out; repeated
rows give (and train) a row each; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import saved

#: Bound of the broadcast table of frequent words.
HEAD, HEAD_BYTES, LONG_BYTES = 1 << 18, 8 << 20, 4096
DISCOUNT, ROUNDS, PIECE_BYTES, FLOOR = 0.75, 2, 16, 0.05
#: Share of a word's end in the first scores.
END = 0.2
#: Words of up to so many bytes go through the lattice together, longer ones one by one.
TOGETHER = 48
_TEN = math.log(10)
_P = np.uint64(0x9E3779B97F4A7C15)


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y)), y finite."""
    return max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y


class Pieces:
    """Byte strings with natural-log scores; a word's first byte is a space. The last score is that of a word's end."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.pieces, self.scores = pieces, scores
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.hashes = h
        # two tables by different bits of the hash: those that lose a place in the first take one in the second
        self.tables = []
        left = np.arange(len(h))
        for shift in (44, 24, 4):
            table = np.full(1 << 20, -1, np.int32)
            slot = ((h[left] >> np.uint64(shift)) & np.uint64(0xFFFFF)).astype(np.int64)
            table[slot[::-1]] = left[::-1]
            self.tables.append((np.uint64(shift), table))
            left = left[table[slot] != left]
        if len(left) or len(np.unique(h)) < len(h):
            raise ValueError("pieces whose hashes collide")

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_P) + b + 1) & (2**64 - 1)
        return int(X.mix(np.array([h], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each rolling hash, or -1."""
        h = X.mix(h)
        out = np.full(len(h), -1, np.int32)
        for shift, table in self.tables:
            i = table[((h >> shift) & np.uint64(0xFFFFF)).astype(np.int64)]
            good = (i >= 0) & (self.hashes[i] == h)
            out[good] = i[good]
        return out

    def arcs(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all arcs of words (n, length), by start, then end."""
        n, length = words.shape
        out = []
        with np.errstate(over="ignore"):
            for i in range(length):
                h = np.zeros(n, np.uint64)
                for j in range(i + 1, min(length, i + self.longest) + 1):
                    h = h * _P + words[:, j - 1] + np.uint64(1)
                    k = self.find(h)
                    rows = np.flatnonzero(k >= 0)
                    if len(rows):
                        out.append((i, j, rows, k[rows]))
        return out

    def forward(self, words: np.ndarray, arcs) -> np.ndarray:
        """(n, length + 1): log of the weight of all paths from the start to each place."""
        alpha = np.full((len(words), words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for i, j, rows, k in arcs:
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + self.scores[k])
        return alpha

    def expected(self, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, and of the end, in words (n, length)."""
        arcs = self.arcs(words)
        alpha = self.forward(words, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        out = np.zeros(len(self.scores))
        for i, j, rows, k in reversed(arcs):
            through = beta[rows, j] + self.scores[k]
            use = np.exp(alpha[rows, i] + through - alpha[rows, -1]) * weight[rows]
            out += np.bincount(k, use, len(out))
            beta[rows, i] = np.logaddexp(beta[rows, i], through)
        out[-1] += weight.sum()
        return out

    @cached_property
    def plain(self) -> list[float]:
        return self.scores.tolist()

    def _alpha(self, word: bytes) -> list[float]:
        """`forward` for one word of any length."""
        alpha = [0.0] + [-math.inf] * len(word)
        index, scores = self.index, self.plain
        for i in range(len(word)):
            if alpha[i] > -math.inf:
                for j in range(i + 1, min(len(word), i + self.longest) + 1):
                    if (k := index.get(word[i:j])) is not None:
                        alpha[j] = _add(alpha[j], alpha[i] + scores[k])
        return alpha

    def one(self, word: bytes) -> float:
        """The marginal of one word of any length, with its end."""
        return self._alpha(word)[-1] + self.plain[-1]

    def add_expected(self, word: bytes, out: np.ndarray) -> None:
        """Adds to `out` the expected uses of each piece, and of the end, in one word of any length."""
        alpha = self._alpha(word)
        beta = [-math.inf] * len(word) + [0.0]
        index, scores, uses = self.index, self.plain, {}
        for i in range(len(word) - 1, -1, -1):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                if (k := index.get(word[i:j])) is not None and beta[j] > -math.inf:
                    through = beta[j] + scores[k]
                    uses[k] = uses.get(k, 0.0) + math.exp(alpha[i] + through - alpha[-1])
                    beta[i] = _add(beta[i], through)
        for k, x in uses.items():
            out[k] += x
        out[-1] += 1

    def by_length(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, chunk: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of up to TOGETHER bytes as (rows, matrix with the leading space), those of one length together."""
        for n in np.unique(size[size <= TOGETHER]).tolist():
            own = np.flatnonzero(size == n)
            for a in range(0, len(own), chunk):
                rows = own[a : a + chunk]
                words = np.full((len(rows), n + 1), 0x20, np.uint64)
                words[:, 1:] = buf[start[rows][:, None] + np.arange(n)]
                yield rows, words

    def marginals(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log of the lattice probability of each word buf[start:start+size]."""
        out = np.empty(len(start))
        for rows, words in self.by_length(buf, start, size):
            out[rows] = self.forward(words, self.arcs(words))[:, -1] + self.scores[-1]
        for r in np.flatnonzero(size > TOGETHER).tolist():
            out[r] = self.one(b" " + buf[start[r] : start[r] + size[r]].tobytes())
        return out


def logs(pieces: list[bytes], uses: np.ndarray) -> np.ndarray:
    """Natural logs of the shares of uses (the last of a word's end) in their distribution: that of pieces that begin a word, or that of the others and the end."""
    begins = np.array([p[:1] == b" " for p in pieces] + [False])
    return np.log(uses / np.where(begins, uses[begins].sum(), uses[~begins].sum()))


def vocabulary(path: str | None = None) -> Pieces:
    """The pieces of a sentencepiece model file that can stand in lower-cased words, and all single bytes, with first scores."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ranked = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        p = model.id_to_piece(i).replace("▁", " ").encode()
        if len(p) <= PIECE_BYTES and b" " not in p[1:] and not any(65 <= b <= 90 for b in p):
            ranked.setdefault(p, i)
    for b in range(256):
        ranked.setdefault(bytes([b]), model.get_piece_size())
    share = np.array([1 / (100 + r) for r in ranked.values()] + [0.0])
    share[-1] = share[[p[:1] != b" " for p in ranked] + [False]].sum() * END / (1 - END)
    return Pieces(list(ranked), logs(list(ranked), share))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _strings(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans of a buffer as an Arrow array of strings."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[X.concat_ranges(start, size)])])


def _words(batch: pa.RecordBatch):
    """Of a batch's lower-cased texts: the buffer, each text's first word, each word's number among the distinct ones, and their spans."""
    raw, at = X.text_buffer(batch.column("text"))
    buf = X.LOWER[raw]
    start, end, words_at = X.word_spans(buf, at, X.NOT_SPACE)
    _, first, which = np.unique(X.span_hashes(buf, start, end), return_index=True, return_inverse=True)
    return buf, words_at, which, start[first], (end - start)[first]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches):
        buf, words_at, which, start, size = _words(batch)
        train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(words_at))
        yield pa.RecordBatch.from_arrays([_strings(buf, start, size), pa.array(np.bincount(which, train, len(start)).astype(np.int64))], ["word", "c"])


def _word_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, at = X.text_buffer(batch.column("word"))
    return buf, at[:-1], np.diff(at)


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = Pieces(*model.value)
        total = np.zeros(len(pieces.scores))
        for batch in X.slices(batches, 1 << 20, "word"):
            buf, start, size = _word_arrays(batch)
            for _, words in pieces.by_length(buf, start, size):
                total += pieces.expected(words, np.ones(len(words)))
            for r in np.flatnonzero(size > TOGETHER).tolist():
                pieces.add_expected(b" " + buf[start[r] : start[r] + size[r]].tobytes(), total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

    return run


class Model:
    """What scores a word: piece scores, N (tokens), V (distinct) and c of the end, in training texts."""

    def __init__(self, pieces: Pieces, n: int, v: int, ends: int):
        self.pieces, self.n, self.v, self.ends = pieces, n, v, ends
        self.below = n + 0.5 * (v + 1)
        self.left = math.log10(DISCOUNT * v / n) if n else 0.0

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.below)

    def whole(self, c: np.ndarray) -> np.ndarray:
        """log10 of the weight of the arc for a whole word."""
        with np.errstate(divide="ignore"):
            return np.log10(np.maximum(c - DISCOUNT, 0) / max(self.n, 1))

    def word_scores(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, c: np.ndarray) -> np.ndarray:
        paths = self.left + self.pieces.marginals(buf, start, size) / _TEN
        return np.logaddexp(self.whole(c) * _TEN, paths * _TEN) / _TEN

    def end(self) -> tuple[float, float]:
        """base and score of a text's end, which no piece spells; without training texts it costs nothing."""
        c = np.array([self.ends], np.float64)
        return float(self.base(c)[0]), float(self.whole(c)[0]) if self.ends else 0.0


def _score_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = _load(model.value)
        for batch in X.slices(batches, 1 << 20, "word"):
            buf, start, size = _word_arrays(batch)
            c = batch.column("c").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(m.base(c)), pa.array(m.word_scores(buf, start, size, c))], ["word", "c", "base_w", "score_w"])

    return run


def _load(value) -> Model:
    pieces, scores, n, v, ends = value
    return Model(Pieces(pieces, scores), n, v, ends)


class _Head:
    """Frequent words, found by hash and confirmed by their bytes."""

    def __init__(self, table: pa.Table):
        self.buf, at = X.text_buffer(table.column("word"))
        self.start, self.size = at[:-1], np.diff(at)
        h = X.span_hashes(self.buf, at[:-1], at[1:])
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.c, self.base, self.score = (table.column(k).to_numpy() for k in ("c", "base_w", "score_w"))

    def find(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(self.hash) or not len(start):
            return np.full(len(start), -1)
        h = X.span_hashes(buf, start, start + size)
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        i = self.order[k]
        same = (self.hash[k] == h) & (self.size[i] == size)
        n = np.where(same, size, 0)
        unlike = buf[X.concat_ranges(start, n)] != self.buf[X.concat_ranges(self.start[i], n)]
        same &= X.sums(unlike.astype(np.int64), np.concatenate([[0], np.cumsum(n)])) == 0
        return np.where(same, i, -1)


def _score_texts(head):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.string()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = _Head(head.value)
        for batch in X.slices(batches):
            buf, words_at, which, start, size = _words(batch)
            found = known_words.find(buf, start, size)
            i = found[which]
            hit = i >= 0
            i = np.where(hit, i, 0)
            take = lambda a: np.where(hit, a[i], 0) if len(a) else np.zeros(len(i), a.dtype)
            row, doc, held = (batch.column(c) for c in ("row", "doc_id", "held_out"))
            keys = pa.array([f" {r}" for r in row.to_pylist()])  # a space: no word is like it
            zero = pa.array(np.zeros(batch.num_rows, np.int64))
            sums = [pa.array(np.diff(words_at), pa.int64()), *(pa.array(X.sums(take(a), words_at)) for a in ((known_words.c > 0).astype(np.int64), known_words.base, known_words.score))]
            yield pa.RecordBatch.from_arrays([row, doc, held, keys, zero, *sums], schema=schema)
            # words that aren't frequent: one row for each of a text's distinct ones
            text = np.repeat(np.arange(batch.num_rows), np.diff(words_at))[~hit]
            pair, n = np.unique(text * len(start) + which[~hit], return_counts=True)
            of, word = pair // max(len(start), 1), pair % max(len(start), 1)
            at = pa.array(of)
            zero = pa.array(np.zeros(len(pair), np.int64))
            none = pa.array(np.zeros(len(pair)))
            yield pa.RecordBatch.from_arrays([row.take(at), doc.take(at), held.take(at), _strings(buf, start[word], size[word]), pa.array(n, pa.int64()), zero, zero, none, none], schema=schema)

    return run


def learn(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """From docs (text, train: boolean): the model, and the table (word, c) of all words with their training counts."""
    spark = docs.sparkSession
    words = saved(docs.select("train", "text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = docs.agg(F.count_if("train")).first()[0]
    pieces = vocabulary(path)
    for _ in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast((pieces.pieces, pieces.scores))
        got = words.where("c > 0").select("word").mapInArrow(_expect(sent), "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect()
        uses = np.full(len(pieces.scores), FLOOR)
        for k, x in got:
            uses[k] += x
        pieces = Pieces(pieces.pieces, logs(pieces.pieces, uses))
    return Model(pieces, n + ends, v + (ends > 0), ends), words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """From docs (doc_id, held_out, text): doc_id, held_out, n_tokens, n_known, base_score and score of every row."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((model.pieces.pieces, model.pieces.scores, model.n, model.v, model.ends))
    short = F.octet_length("word") <= LONG_BYTES
    # words by the power of two of their count; the least power from which at most HEAD words of HEAD_BYTES in all are left
    sizes = words.where(short & (F.col("c") > 0)).groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*"), F.sum(F.octet_length("word")))
    powers = {p: (n, size) for p, n, size in sizes.collect()}
    least = max(powers, default=0) + 1
    total = size = 0
    while least > 0:
        more, bytes_ = powers.get(least - 1, (0, 0))
        if total + more > HEAD or size + bytes_ > HEAD_BYTES:
            break
        least, total, size = least - 1, total + more, size + bytes_
    frequent = short & (F.col("c") >= 2**least)
    schema = "word string, c long, base_w double, score_w double"
    head = context.broadcast(words.where(frequent).mapInArrow(_score_words(sent), schema).toArrow())
    rest = words.where(~frequent).mapInArrow(_score_words(sent), schema)
    texts = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    parts = texts.mapInArrow(_score_texts(head), "row long, doc_id long, held_out boolean, key string, n long, n_tokens long, known long, base double, score double")
    joined = parts.join(rest, parts["key"] == rest["word"], "left")
    base, end = model.end()
    return joined.groupBy("row", "doc_id", "held_out").agg(
        (F.sum("n_tokens") + 1).alias("n_tokens"),
        (F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)) + int(model.ends > 0)).alias("n_known"),
        (F.sum(F.col("base") + F.col("n") * F.coalesce("base_w", F.lit(0.0))) + base).alias("base_score"),
        (F.sum(F.col("score") + F.col("n") * F.coalesce("score_w", F.lit(0.0))) + end).alias("score"),
    )


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = fold(F.col("doc_id"))
    docs = X.only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.coalesce(remainder != 1, F.lit(False)).alias("train"), F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "text"
    )
    model, words = learn(docs)
    return score(docs, model, words).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
