"""A corpus pipeline of five operators: quality, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. The
result of each is written as Parquet and read again for the next. Every stage works on all rows and whole texts that the
stage before kept.

Defined results: null texts count as empty ones and stay null where they are kept; an empty table gives an empty one of the same
columns; columns beyond those of `documents` are kept as they are, whatever their names; rows with a null doc_id come after all others.
Repeated rows pass the quality stage alike, and all but one of them go in the near-duplicate stage. A stage's own results for such rows
stand in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, packing, quality, secrets_scan, simhash
from tessera.llm._spark import saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts score the intercept; with no usable label every score is 0.5, so all stay."""
    return quality.keep_good(docs, quality.fit(spark, sf_dir, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: fingerprints that links of three bits
    connect. Null and empty texts are duplicates of each other; of rows that repeat an id and a text one stays, of rows that repeat an
    id with other texts each group's.
    """
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts have none; items without an id are left out; with no items all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark, and n_chars of those changed. Rows without a secret stay as they are, null texts null."""
    return secrets_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences. A null or empty text is one piece of one id; repeated rows are packed as often as they come."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs


#: Simhash, the classifier and the tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
