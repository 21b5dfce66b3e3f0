"""A mergeable Bloom sketch as a table, and a probe that keeps most rows out of an exact join.

Each key sets BITS bits of one 64-bit word, so a sketch is a table (word, bits) that `bit_or` builds from partial results in each task, that merges with others by a
union, and that may be stored. A probe is one join on the word. The number of words is a power of two for the number of keys, WORDS at most, which bounds
the broadcast; a sketch of more keys than that lets more rows through, but never loses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a sketch at most (16 bytes each as a table), bits of a key, and bits of the sketch for each key.
WORDS, BITS, PER_KEY = 1 << 20, 4, 16


def words_for(keys: int) -> int:
    return min(WORDS, 1 << max(0, (max(keys, 1) * PER_KEY // 64 - 1)).bit_length())


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def sketch(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits) of the keys that are not null; words: a power of two."""
    k = F.col(key)
    return keys.where(k.isNotNull()).select(_word(k, words).alias("word"), _mask(k).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all keys of sketches with one number of words."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probed(rows: DataFrame, key: str, sketched: DataFrame, words: int) -> DataFrame:
    """The rows with `maybe`: false where the key is certainly not among the sketched ones."""
    s = sketched.select(F.col("word").alias("sketch_word"), F.col("bits").alias("sketch_bits"))
    r = rows.withColumn("sketch_mask", _mask(F.col(key))).join(F.broadcast(s), _word(F.col(key), words) == F.col("sketch_word"), "left")
    maybe = F.coalesce(F.col("sketch_bits").bitwiseAND(F.col("sketch_mask")) == F.col("sketch_mask"), F.lit(False)) & F.col(key).isNotNull()
    return r.withColumn("maybe", maybe).drop("sketch_word", "sketch_bits", "sketch_mask")


def known(rows: DataFrame, key: str, keys: DataFrame, sketched: DataFrame, words: int) -> DataFrame:
    """The rows with `known`, whether their key is among `keys` (one column of the same name): only rows that pass the sketch are joined."""
    p = probed(rows, key, sketched, words)
    seen = keys.where(F.col(key).isNotNull()).select(key).distinct().withColumn("known", F.lit(True))
    exact = p.where("maybe").drop("maybe").join(seen, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return exact.unionByName(p.where("NOT maybe").drop("maybe").withColumn("known", F.lit(False)))
