"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), reads all its predecessor kept, and
returns documents (doc_id, text, lang, source, n_chars and whatever columns came
along); the last returns the pieces and their places.  Between stages the rows
are written as Parquet and read again, so a lost executor never costs a stage.

Defined cases, for every stage: extra columns of any name stay as they are; an
empty table gives an empty one; a null text is empty.  Quality rules drop rows of
fewer than 50 words, null and empty ones among them; near-dedup keeps one row of a
class, and every row without words; secret scans leave a null text null; the mix
takes no row without words, and repeated rows are rows of their own; packing gives
a row without words its end id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import mixing as _mixing
from fieldloom.llm import near_dedup as _near_dedup
from fieldloom.llm import packing as _packing
from fieldloom.llm import quality_rules as _quality_rules
from fieldloom.llm import secrets as _secrets
from fieldloom.llm._common import stored
from fieldloom.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and their group's fences."""
    columns = docs.columns
    judged = _quality_rules.quality_rules(docs)
    verdict = next(c for c in judged.columns if c not in columns)
    return judged.filter(F.col(f"{verdict}.kept")).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return _near_dedup.near_dedup(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced; n_chars follows the text."""
    out = _secrets.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for."""
    return _mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and offset."""
    return _packing.pack(docs, vocabulary("word_bpe_49k.json"), 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Sketches, hashes, tests of randomness and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
