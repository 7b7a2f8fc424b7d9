"""Operator 1, n-gram Jaccard join: globally ordered shingle sets, necessary prefixes, and a prefix tree.

1. A fixed-size count sketch of all shingles gives a global order: common shingles last, the others by hash.
   Any order gives the same links; this one keeps what many documents share out of the prefixes.
2. Documents with equal sets form a class, which its smallest doc_id stands for.
3. Two sets can only link if they share a shingle of their first ``n - ceil(t * n) + 1``. The representatives
   are dealt by those shingles. In a first round each meets only the smallest document of every bucket; groups
   of near copies are joined to one component here, without their pairs.
4. A parity bitmap of each set, about as many bits as it has elements, bounds the symmetric difference from below
   and drops almost all pairs that don't link, without their sets and without losing a link.
5. In a second round, buckets that still hold several components compare their members by bitmap inside a task,
   skipping pairs inside a component, pairs already compared and pairs whose lengths rule a link out; only pairs
   that may link become rows. A bucket of more than ``MEMBERS`` documents is cut into blocks, and pairs of
   blocks are tasks' work of their own, so no task holds more than two blocks.
6. What is left is verified exactly: the partners of one probe, in blocks of bounded size, are stored in a prefix tree
   over the block's order, and the probe walks the tree. What a path shares with the probe is counted once for all
   sets below it, and a subtree is left as soon as its remaining length can't reach the needed overlap.

Defined cases: null and empty texts and texts without words have the empty set and link with nothing, not
even each other; rows that share a doc_id are judged by their texts; a row without doc_id gets its class's
smallest id; an empty table gives no row; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import mix, shingle_sets
from .common import in_small_batches, slices, stored, table
from .components import connected
from .encode import chunks

WORDS = 4
PERCENT = 85
#: Cells of the count sketch, whatever the corpus; one byte each is sent to the executors.
CELLS = 1 << 20
SKETCH_SLICES = 16
#: Most ids (8 bytes each) that are broadcast to pick texts out; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Most sets in one prefix tree.
BLOCK = 256
#: Most documents of a bucket that are compared at once.
MEMBERS = 2048


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection with which sets of a and b elements reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


# The global order


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for _, texts in chunks(batches):
            sets = shingle_sets(texts, words)
            counts += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if counts.any():
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SKETCH_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    return run


def _add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in rows["counts"])
    return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})


def shingle_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each cell 0, or the binary logarithm of what it holds beyond its share: how common its shingles are."""
    rows = docs.select("text").mapInArrow(_sketch(words), "slice int, counts binary").groupBy("slice").applyInPandas(_add_up, "slice int, counts binary").collect()
    counts = np.zeros((SKETCH_SLICES, CELLS // SKETCH_SLICES), np.int64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    excess = counts.ravel() - mean
    return np.where(excess > 4 + 5 * np.sqrt(mean), np.log2(np.maximum(excess, 1)).astype(np.uint8), 0).astype(np.uint8)


def ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted hashes in the global order."""
    level = levels[(found & np.uint64(CELLS - 1)).astype(np.int64)]
    return found[np.argsort(level, kind="stable")] if level.any() else found


# Sets, classes and prefixes


def _signed(sets: list[np.ndarray], levels: np.ndarray, percent: int) -> tuple[list, list, list, list]:
    n = [len(x) for x in sets]
    one = [int(x.sum().astype(np.int64)) for x in sets]
    two = [int(mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64)) for x in sets]
    head = [ordered(x, levels)[: len(x) + percent * -len(x) // 100 + 1].view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
    return n, one, two, head


def parity(found: np.ndarray) -> bytes:
    """One bit for each cell, set if an odd number of elements falls into it; a power of two of at least 64 cells."""
    cells = 1 << max(6, len(found).bit_length())
    return np.packbits((np.bincount(((found >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """False only if sets of n and m elements with these bitmaps can't reach the similarity: every bit that differs
    stands for an element that only one of them has. The larger bitmap is folded onto the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * least_overlap(n, m, percent)


def _filter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, x, b, m, y = (batch.column(c).to_pylist() for c in ("a", "a_n", "a_bits", "b", "b_n", "b_bits"))
            yield _pairs([(a[i], b[i]) for i in range(len(a)) if may_link(x[i], n[i], y[i], m[i], percent)])

    return run


def _number(bits: bytes) -> dict[int, int]:
    """The bitmap as a number, and folded once, by its size in bits; sets that may link differ by one size at most."""
    size, x = 8 * len(bits), int.from_bytes(bits, "big")
    half = size // 2
    return {size: x, half: (x >> half) ^ (x & ((1 << half) - 1))}


def _cross(percent: int):
    """Pairs (a, b) that may link and aren't compared yet, out of the members of one bucket or of two of its blocks."""

    def pairs(rows: list[tuple], between: bool) -> set[tuple[int, int]]:
        out = set()
        rows.sort(key=lambda r: r[1])
        for i, (a, n, part, block, leader, x) in enumerate(rows):
            for b, m, other, beside, _, y in rows[i + 1 :]:
                if 100 * n < percent * m:
                    break  # the others are longer still
                if part == other or leader in (a, b) or (between and block == beside):
                    continue
                size = min(max(x), max(y))
                if size not in x or size not in y or (x[size] ^ y[size]).bit_count() <= n + m - 2 * least_overlap(n, m, percent):
                    out.add((min(a, b), max(a, b)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for token, i, j, doc, n, part, block, leader, bits in zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j", "doc_id", "n", "component", "block", "leader", "bits")), strict=True):
                if (token, i, j) != key:
                    out |= pairs(rows, key[1] != key[2]) if key else set()
                    key, rows = (token, i, j), []
                rows.append((doc, n, part, block, leader, _number(bits)))
            yield _pairs(sorted(out))
        yield _pairs(sorted(pairs(rows, key[1] != key[2])) if key else [])

    return run


def _describe(words: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, words)
            n, one, two, head = _signed(sets, levels.value, percent)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in head])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(head), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, one, two)), prefix, pa.array([parity(x) for x in sets], pa.binary())], names=["doc_id", "n", "s1", "s2", "prefix", "bits"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = [x.tobytes() for x in shingle_sets(texts, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


# The prefix tree


class PrefixTree:
    """Sets as ascending rank sequences, sorted, with the length each shares with the one before: a tree whose
    paths are walked in that order."""

    STEP = 64

    def __init__(self, sets: list[np.ndarray]):
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int32)
        rank[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.int32)
        ranked, at, self.paths = rank[inverse.ravel()], 0, []
        for x in sets:
            self.paths.append(np.sort(ranked[at : at + len(x)]))
            at += len(x)
        self.values, self.rank = values, rank
        self.order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">i4").tobytes())

    def _shared(self, a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def linked(self, probe: np.ndarray, percent: int) -> list[int]:
        """Which sets reach the similarity with the probe."""
        at = np.searchsorted(self.values, probe)
        known = at < len(self.values)
        known[known] = self.values[at[known]] == probe[known]
        mine = np.zeros(len(self.values), np.int32)
        mine[self.rank[at[known]]] = 1
        total = int(known.sum())
        out: list[int] = []
        before, upto = np.zeros(0, np.int32), np.zeros(1, np.int64)  # a path, and the overlap at each depth walked so far
        for i in self.order:
            path = self.paths[i]
            need = least_overlap(len(probe), len(path), percent)
            depth = min(self._shared(before, path), len(upto) - 1)
            walked = [upto[: depth + 1]]
            have = int(upto[depth])
            while depth < len(path) and have + min(total - have, len(path) - depth) >= need:
                part = have + np.cumsum(mine[path[depth : depth + self.STEP]])
                walked.append(part)
                have, depth = int(part[-1]), depth + len(part)
            if depth == len(path) and have >= need:
                out.append(i)
            before, upto = path, np.concatenate(walked)
        return out


def _walk(percent: int):
    def links(a: int, probes: list[np.ndarray], ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if not sets or not probes:
            return []
        tree = PrefixTree(sets)
        return [(a, ids[i]) for p in probes for i in tree.linked(p, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probes, ids, sets, out = None, [], [], [], []
        for batch in batches:
            for a, block, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b", "shingles")), strict=True):
                if (a, block) != key:
                    out += links(key[0], probes, ids, sets) if key else []
                    key, probes, ids, sets = (a, block), [], [], []
                found = np.frombuffer(raw, np.uint64)
                if b is None:
                    probes.append(found)
                else:
                    ids.append(b)
                    sets.append(found)
            yield _pairs(out)
            out = []
        yield _pairs(links(key[0], probes, ids, sets) if key else [])

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, bits: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole shingle sets reach the similarity."""
    spark = docs.sparkSession
    of = lambda c: bits.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    pairs = stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "a_n", "a_bits", "b", "b_n", "b_bits").mapInArrow(_filter(percent), "a long, b long").distinct(), "possible")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "candidates")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(_sets(words), "doc_id long, shingles binary"), "shingles")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = stored(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "blocks")
    members = dealt.join(sets, F.col("b") == F.col("doc_id")).select("a", "block", "b", "shingles")
    probes = dealt.select("a", "block").distinct().join(sets, F.col("a") == F.col("doc_id")).select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")
    grouped = members.unionByName(probes).repartition(slices(spark), "a", "block").sortWithinPartitions("a", "block")
    return grouped.mapInArrow(_walk(percent), "a long, b long").distinct()


# The join


def _fits(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of each row, and verified links (a, b) between representatives, enough for all components."""
    spark = docs.sparkSession
    in_small_batches(spark)
    levels = spark.sparkContext.broadcast(shingle_levels(docs, words))
    every = stored(docs.select("doc_id", "text").mapInArrow(_describe(words, percent, levels), "doc_id long, n long, s1 long, s2 long, prefix array<long>, bits binary"), "prefixes")
    key = ["s1", "s2", "n"]
    reps = every.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = every.select("doc_id", *key).join(reps, key, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    heads = every.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", *key], "left_semi")
    bits = heads.select("doc_id", "n", "bits")
    shared = heads.select("doc_id", "n", F.explode("prefix").alias("token"))
    size = shared.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "n")).alias("first")).where("c > 1")
    buckets = stored(shared.join(size, "token").select("token", "doc_id", "n", F.col("first.doc_id").alias("leader"), F.col("first.n").alias("leader_n")), "buckets")
    stars = stored(buckets.where(F.col("leader") != F.col("doc_id")).where(_fits("leader_n", "n", percent)).select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    links = stored(verified(docs, stars, bits, words, percent), "star-links")
    part = connected(links)
    placed = buckets.select("token", "doc_id", "n", "leader").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("token", F.ceil(F.col("c") / MEMBERS).alias("blocks"))
    left = placed.join(mixed, "token").join(bits.select("doc_id", "bits").dropDuplicates(["doc_id"]), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    left = left.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "x")).withColumn("j", F.greatest("block", "x"))
    columns = ["token", "i", "j", "doc_id", "n", "component", "block", "leader", "bits"]
    dealt = left.select(*columns).repartition(slices(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    rest = dealt.mapInArrow(_cross(percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    return classes, stored(links.unionByName(verified(docs, stored(rest, "rest"), bits, words, percent)), "all-links")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (distinct shingles), component (smallest doc_id that links reach)."""
    classes, links = jaccard_classes(docs, words, percent)
    return classes.join(connected(links).withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their component, all columns as they were; rows without id stay.
    Rows that repeat a kept id and text stay once."""
    keep = jaccard_components(docs, words, percent).where("doc_id = component").select("doc_id").distinct()
    some = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return some.unionByName(docs.where("doc_id IS NULL"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = jaccard_components(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[i : i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT r.id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
