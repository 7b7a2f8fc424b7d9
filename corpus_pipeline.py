"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept and is written as Parquet; all but the last return the columns of
``documents``. Rejected documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are masked in place, and what is left is packed.

Defined cases: a null, empty or very short text goes in the first stage. Rows are judged each by its own text, so repeated
ids and rows change nothing there; of equal rows with one id one stays as near duplicates are taken out, and rows without an
id stay there. Very long texts are taken whole throughout. Other columns pass through all stages but the last, whatever
their names. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.common import stored, table
from stratalog.llm.decontaminate import decontaminate
from stratalog.llm.ngram_join import one_of_each
from stratalog.llm.packing import pack
from stratalog.llm.quality_rules import quality_filter
from stratalog.llm.secret_scan import mask_secrets


#: Near duplicates here are five-word shingle sets with a similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, what="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
