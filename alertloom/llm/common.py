"""Helpers shared by the operators of this folder."""

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import cut_lineage, shared_dir, shuffles_freed

# Rows of one Arrow batch; with very long texts this bounds a Python worker's memory.
BATCH_ROWS = 1000
# White space of the word definitions, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["BATCH_ROWS", "WORD", "ascii_lower", "cut_lineage", "free_name", "hashed_part",
           "scratch", "shared_dir", "stored", "table", "tuned"]


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def hashed_part(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, wish: str) -> str:
    """``wish`` or, if the frame has such a column in any case, the name with underscores added."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    name = re.sub(r"\W", "-", what)
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The frame written once to a table in the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession, what)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
