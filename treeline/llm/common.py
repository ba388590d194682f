"""Shared helpers: reading tables, tables in the shared folder, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sinks import new_folder

#: What the contracts call white space: space, tab, line feed, vertical tab, form feed, return.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder (spark.checkpoint.dir).

    Cuts the lineage durably: a lost executor loses nothing, and the table can be read again
    column by column.  The table stays until the owner of the folder clears it."""
    path = new_folder(df.sparkSession, "llm")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with ``row``, a number of its own for each, from a written table."""
    return written(df.withColumn("row", F.monotonically_increasing_id()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of df has it."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name += "_"
    return name


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (the fold of a document)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))
