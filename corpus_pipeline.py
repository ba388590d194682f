"""The corpus pipeline: toxicity, exact dedup, near dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and gives documents with the columns of ``documents``; the
last gives packed pieces.  Every stage's result is written as Parquet in the shared folder and read
again, so a lost executor never reaches back beyond its stage.  Null text counts as empty, except
that pseudonyms leave it null.  Every row is judged by its own text, whatever its doc_id, which may be
null or shared; of rows that share doc_id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from treeline.llm.common import numbered, table, written
from treeline.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under TOXIC_FROM stay; the machine learns from labelled rows of docs."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    machine = toxicity.train(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs.select(*COLUMNS), machine, carry=tuple(COLUMNS))
    return scored.filter(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the longest stays, then the smallest doc_id."""
    docs = numbered(docs.select(*COLUMNS))
    kept = exact_dedup.judged(docs).filter("kept").select("row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the smallest doc_id stays."""
    docs = numbered(docs.select(*COLUMNS))
    kept = jaccard_join.judged(docs).filter("kept").select("row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format; n_chars follows the new text."""
    return pii.pseudonymise(docs.select(*COLUMNS), pii_key(spark)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", pseudonyms),
    ("packing", pack),
]
ORACLE_SQL = None  # the first stage is a trained model; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
