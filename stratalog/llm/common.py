"""What the operators of this subpackage share: tables, words, native helpers, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the plain contracts: anything between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, pattern: str = SPACED_WORD) -> Column:
    """All words of a text in order; no text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster sees; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    With ``by``, a last column with few values, each value has a folder of its own and filters on it read no other."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, partitionBy=by, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    """How many parts a shuffle is dealt into; the cluster sets it with the size of its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_small_batches(spark: SparkSession) -> None:
    """From now on this session's rows go to Python ``BATCH_BYTES`` at a time, not 64 MB, which with buffers that grow by
    doubling take several times that of every core, in the JVM and in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
