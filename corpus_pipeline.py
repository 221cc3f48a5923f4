"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patternspark.llm import decontaminate as _decontaminate
from patternspark.llm import mixing as _mixing
from patternspark.llm import near_dedup as _near_dedup
from patternspark.llm import quality as _quality
from patternspark.llm import token_codes as _token_codes
from patternspark.llm.queries import BPE, END_ID
from patternspark.llm.scratch import Scratch

#: The five stages take rows in different columns, so no oracle in one SQL statement is given.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more, unless the classifier finds nothing to learn from.

    Null and empty texts have a score like all others; repeated rows have equal scores and stay or go together; a score of
    exactly 0.7 stays; an empty table stays empty. Columns and rows that stay are as they were, in any column.
    """
    return _quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the smallest id.

    A similarity of exactly 0.8 links; null and empty texts link with nothing and stay; rows with a null id stay; of rows
    that repeat an id and all columns one stays; an empty table stays empty. Columns named _dedup_* are refused.
    """
    return _near_dedup.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (five words, similarity 0.8).

    A similarity of exactly 0.8 drops a document; null and empty texts and items match nothing; repeated rows stay or go
    together; without documents or items nothing changes.
    """
    return _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, those of small sources up to twice: a row for each time that a document is taken.

    Every document is taken once at least; a null source is a source of its own; null texts have no tokens; repeated rows
    are taken alike; an empty table stays empty. Columns named _mix_* are refused.
    """
    return _mixing.mix(docs, repetition=2.0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and where each document lies in them: doc_id, start, n_tokens, ids_crc32.

    Rows that repeat an id are rows of their own, next to each other; null ids come first; null and empty texts are the end
    id alone; an empty table gives no rows.
    """
    path = Scratch(spark, "pipeline-tokens").path
    _token_codes.write_tokens(docs, path, BPE, END_ID)
    return _token_codes.read_tokens(spark, path)


STAGES = [
    ("quality", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.written(out, name) if k + 1 < len(STAGES) else out
    return docs
