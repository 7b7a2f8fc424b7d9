"""Operator 3, sharding: a lookup table of prime size that shards fill by turns, each in its own order of preference.

Every shard's preferences are a permutation of the slots, ``(offset + j * skip) mod SLOTS`` with offset and skip out of its
name's digest. In each round every shard claims its next free slot, so shares differ by one slot at most, and when a
shard comes or goes nearly all other slots keep their shard. The table has ``SLOTS`` entries whatever the data, so it is
broadcast, and a row finds its shard by one look-up of its key's hash.

Placement is DataFrame functions only. A hot key can be spread over several shards: ``spread`` is how many, and a second
column deals its rows out.

Whole rows move: they are written to a folder for each shard and read back from there. Within a shard, a hash of the whole
row deals rows out to files, so that a hot key is no task of its own even where it isn't spread.

Defined cases: a null key goes to slot 0, and with ``spread`` is dealt out like any other; equal keys go to one shard
(unless spread); an empty table gives no row; a single shard takes all; duplicate shard names, no shard at all and a spread
without a column to spread by are errors; all columns of the table are kept, and the new ones replace columns of their
name.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, table

#: Prime, and over a hundred times the usual number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot by slot the number of the shard that claimed it; a constant of the plan, the same on every machine."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the key's MD5 digest, modulo the slots."""
    digest = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(F.pmod(digest, F.lit(slots)), F.lit(0)).cast("bigint")


def lookup_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): SLOTS rows out of one literal."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("bigint").alias("shard"))


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, spread: int = 1, spread_by: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` (a number). With ``spread``, a key's rows go to that many slots by ``spread_by``."""
    if spread > 1 and not spread_by:
        raise ValueError("a key is spread by another column")
    named = F.col(key).cast("string")
    if spread > 1:
        named = F.concat_ws("#", named, F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("string"))
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(named, slots))
    return placed.join(F.broadcast(lookup_frame(docs.sparkSession, shards, slots)), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, files_per_shard: int = 8, spread: int = 1, spread_by: str | None = None) -> None:
    """One folder a shard, of several files, so that no shard is written by one task."""
    placed = place(docs, key, shards, spread, spread_by)
    deal = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition(slices(docs.sparkSession), "shard", deal).write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, **how) -> DataFrame:
    """The table written to its shards and read back, with ``slot`` and ``shard``."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, **how)
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    empty = place(docs, **{k: v for k, v in how.items() if k != "files_per_shard"}).limit(0)
    files = docs.sparkSession.read.schema(empty.schema).parquet(path)
    return files.select(*kept, "slot", "shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's row is in its shard's files, and how many rows the shard has there."""
    rows = sharded(table(spark, sf_dir, "documents"))
    each = rows.select("doc_id", "slot", "shard", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"), "source")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("shard_rows"))  # one row a shard
    return each.join(F.broadcast(sizes), "shard").select("doc_id", "slot", "shard", "n_bytes", "text_md5", "source", "shard_rows")


ORACLE = f"""
WITH t AS (SELECT unnest(range({SLOTS})) AS slot, CAST(unnest(string_split('{",".join(map(str, lookup_table()))}', ',')) AS BIGINT) AS shard),
d AS (SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS text_md5, source, CAST(coalesce(CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % {SLOTS}, 0) AS BIGINT) AS slot FROM documents)
SELECT doc_id, slot, shard, n_bytes, text_md5, source, count(*) OVER (PARTITION BY shard) AS shard_rows FROM d JOIN t USING (slot)
"""
