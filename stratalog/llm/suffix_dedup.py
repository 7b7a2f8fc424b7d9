"""Operator 2, suffix-array dedup: remove every byte of a ``LENGTH``-byte string that an earlier document holds.

1. Anchors. In each window of ``LENGTH`` bytes the ``GRAM``-byte gram with the least hash is its anchor, so equal
   windows have equal anchors at the same place. Neighbouring windows with one anchor form a run; a run's bytes
   are its windows' union. About one byte in sixteen starts a run.
2. Equal runs. Runs are dealt by anchor, packed by map task. A run that an earlier document has byte for byte is
   removed whole; repeats inside one map batch are settled there, so a passage that a third of all documents
   share costs one run per batch.
3. Suffix array. Where an anchor has several different runs (at the edges of repeats), the first document's bytes
   of each are fetched and the windows compared: a suffix array of the places where windows begin, sorted eight
   bytes at a time, adjacent common prefixes, and the least doc_id of each stretch of equal windows.
4. Hot anchors. Where texts differ around a gram that many share, the runs of one anchor grow with the documents.
   Such anchors are found on a sample by hash; their runs are dealt by their own hash instead, and their windows one
   by one by theirs, after each map task has kept the least doc_id of equal ones. Which anchors are hot says where
   windows meet, never what is found.
5. Each document's removed windows are united and cut out.

Defined cases: null and empty texts and texts under ``LENGTH`` bytes lose nothing; strings inside one document or
under one doc_id never remove each other; a row without doc_id loses nothing and removes nothing; rows that repeat
id and text are both kept; an empty table gives no row; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import prefix_sums, span_hashes
from .common import slices, stored, table
from .encode import chunks

LENGTH = 50
GRAM = 20
#: Buckets of anchors for each part of a shuffle.
BUCKETS = 8
#: Bytes of runs that go into one suffix array, unless one anchor alone has more.
ARRAY_BYTES = 2 << 20
#: Different runs of one anchor that stay together; about SAMPLE_DOCS rows (never more than twice that on average, and
#: all of fewer) show which anchors have more, and SEEN different runs among them are the least that count.
MOST = 1024
SAMPLE_DOCS = 8000
SEEN = 8
#: Windows of hot anchors that a map task holds at once.
HELD_WINDOWS = 100_000


# Anchors and runs


def anchor_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run: text's number, first window, windows, anchor's hash, hash of the run's bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    ends = np.cumsum(sizes)
    sums = prefix_sums(data)
    place = np.arange(len(data) - gram + 1)
    value, at = span_hashes(sums, place, place + gram), place.astype(np.int32)
    grams = value
    have, want = 1, length - gram + 1
    while have < want:  # the least of twice as many grams each time, the leftmost among equals
        step = min(have, want - have)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(value)]
    whole = np.arange(len(value)) + length <= ends[owner]
    same = np.concatenate([[False], whole[1:] & whole[:-1] & (at[1:] == at[:-1])])
    first = np.flatnonzero(whole & ~same)
    last = np.flatnonzero(whole & ~np.concatenate([same[1:], [False]]))
    text = owner[first]
    return text, first - (ends - sizes)[text], last - first + 1, grams[at[first]], span_hashes(sums, first, last + length)


def _first_of(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts equal keys together with the least doc first, the group of each row and its least doc."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    return order, group, doc[order][new][group] if len(order) else doc


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint spans out of any; spans that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([new[1:], [True]])]


# Hot anchors


def _sampled_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            _, _, _, anchor, bytes_ = anchor_runs([x.encode("utf-8", "surrogatepass") for x in texts], length, gram)
            pairs = np.unique(np.stack([anchor >> _LOW, bytes_ >> _LOW]), axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["anchor", "run"])

    return run


def hot_anchors(known: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> np.ndarray:
    """The anchors (without their low bits) that seem to have more than ``most`` different runs, sorted."""
    step = max(1, known.count() // SAMPLE_DOCS)
    sample = known.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(step)) == 0)
    pairs = sample.select("text").mapInArrow(_sampled_runs(length, gram), "anchor long, run long").distinct()
    # At most the sample's runs / SEEN rows.
    found = pairs.groupBy("anchor").count().where(F.col("count") >= max(SEEN, most // step)).select("anchor").toArrow()
    return np.sort(found.column("anchor").to_numpy()).astype(np.uint64)


# Stage one: runs, packed by bucket of their anchors

_PACKED = "bucket int, data binary"
#: Packs hold six bytes of each hash; these are the bits that go.
_LOW = np.uint64(16)
#: What stands for every hot anchor; no packed anchor has such low bits.
HOT = -1
#: mark is the CRC of the text, which tells rows apart that share a doc_id.
_ROWS = "doc_id long, mark long, start int, windows int, anchor long"
_NAMES = ["doc_id", "mark", "start", "windows", "anchor"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _from_six(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(n, 6)
    return out.view("<u8").ravel()


def _pack(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, run: np.ndarray, zstd) -> bytes:
    order = np.lexsort((start, mark, doc))
    doc, mark, start, windows, anchor, run = (x[order] for x in (doc, mark, start, windows, anchor, run))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    which = np.cumsum(new) - 1
    head = np.array([int(new.sum()), len(doc)], "<i8").tobytes()
    rest = zstd.compress(doc[new].astype("<i8").tobytes() + mark[new].astype("<u4").tobytes() + which.astype("<u4").tobytes() + start.astype("<u4").tobytes() + windows.astype(np.uint8).tobytes())
    return head + _six(anchor) + _six(run) + rest


def _unpack(raw: bytes, zstd) -> tuple[np.ndarray, ...]:
    k, n = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16 + 6 * n
    rest = zstd.decompress(raw[at + 6 * n :])
    place = 12 * k
    which, start = np.frombuffer(rest, "<u4", n, place), np.frombuffer(rest, "<u4", n, place + 4 * n).astype(np.int64)
    doc, mark = np.frombuffer(rest, "<i8", k)[which], np.frombuffer(rest, "<u4", k, 8 * k).astype(np.int64)[which]
    return doc, mark, start, np.frombuffer(rest, np.uint8, n, place + 8 * n).astype(np.int64), _from_six(raw[16:at], n), _from_six(raw[at : at + 6 * n], n)


def _find_runs(buckets: int, length: int, gram: int, hot):
    """Packs with bucket >= 0, and what a batch settled by itself with bucket -1 - n, dealt like the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for batch, texts in chunks(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            raw = [x.encode("utf-8", "surrogatepass") for x in texts]
            text, start, windows, anchor, bytes_ = anchor_runs(raw, length, gram)
            doc, mark = ids[text], np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))[text]
            order, _, least = _first_of([anchor, bytes_], doc)
            doc, mark, start, windows, anchor, bytes_ = (x[order] for x in (doc, mark, start, windows, anchor, bytes_))
            late = doc > least
            out_bucket, out = [], []
            if late.any():
                zero = np.zeros(int(late.sum()), np.uint64)
                out_bucket.append(-1 - int(ids.min() % buckets))
                out.append(_pack(doc[late], mark[late], start[late], windows[late], zero, zero, zstd))
            keep = ~late
            doc, mark, start, windows, anchor, bytes_ = (x[keep] for x in (doc, mark, start, windows, anchor, bytes_))
            dealt_by = np.where(np.isin(anchor >> _LOW, hot.value), bytes_, anchor) >> _LOW
            bucket = (dealt_by % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    out_bucket.append(int(bucket[part[0]]))
                    out.append(_pack(doc[part], mark[part], start[part], windows[part], anchor[part], bytes_[part], zstd))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "data"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != now or bucket < 0:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(data)
    if held:
        yield now, held


def _rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _settle_runs(hot):
    """Rows with anchor 0 are removed windows; the others are runs whose windows a suffix array must compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for bucket, packs in _by_bucket(batches):
            doc, mark, start, windows, anchor, bytes_ = (np.concatenate(x) for x in zip(*(_unpack(p, zstd) for p in packs), strict=True))
            if bucket < 0:
                yield _rows(doc, mark, start, windows, np.zeros(len(doc), np.int64))
                continue
            order, group, least = _first_of([anchor, bytes_], doc)
            doc, mark, start, windows, anchor = (x[order] for x in (doc, mark, start, windows, anchor))
            late = doc > least
            new = np.concatenate([[True], group[1:] != group[:-1]])
            # Anchors that more than one document starts a run of its own for.
            first_doc, of = least[new], anchor[new]
            edge = np.concatenate([[True], of[1:] != of[:-1]])
            at = np.flatnonzero(edge)
            several = (np.minimum.reduceat(first_doc, at) != np.maximum.reduceat(first_doc, at))[np.cumsum(edge) - 1][group]
            hot_row = np.isin(anchor >> _LOW, hot.value)  # the anchor's other runs may be in other buckets
            mixed = (several | hot_row) & ~late
            kept = np.where(hot_row, HOT, np.where(anchor == 0, 1, anchor).astype(np.int64))
            yield _rows(doc[late], mark[late], start[late], windows[late], np.zeros(int(late.sum()), np.int64))
            yield _rows(doc[mixed], mark[mixed], start[mixed], windows[mixed], kept[mixed])

    return run


# Stage two: suffix arrays over the runs that differ


def _words(data: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.uint64]]:
    """Numbers that order suffixes by their first ``depth`` values: at each place as many values as eight bytes hold, read
    ahead by so many places, and how many bits of the last go."""
    per = 8 // data.itemsize
    big = np.concatenate([data, np.zeros(depth + per, data.dtype)]).astype(data.dtype.newbyteorder(">"))
    read = np.ndarray((len(data) + depth,), ">u8", big, strides=(data.itemsize,))
    return [(read[j:], np.uint64(8 * data.itemsize * max(0, j + per - depth))) for j in range(0, depth, per)]


def suffix_order(data: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Places of ``data``, or those given, by their suffixes' first ``depth`` values. What lies deeper is in no particular order."""
    at = np.arange(len(data)) if at is None else at
    return at[np.lexsort([read[at].astype(np.uint64) >> bits for read, bits in reversed(_words(data, depth))])]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbour pair in the order, whether the first ``depth`` values agree."""
    same = np.zeros(max(0, len(order) - 1), bool)
    left = np.arange(len(same))
    for read, bits in _words(data, depth):
        left = left[read[order[left]].astype(np.uint64) >> bits == read[order[left + 1]].astype(np.uint64) >> bits]
    same[left] = True
    return same


def later_windows(doc: np.ndarray, runs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(run's number, place in it) of the windows of these runs that a run of a smaller doc also holds."""
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    data = np.frombuffer(b"".join(runs), np.uint8)
    of = np.repeat(np.arange(len(runs)), size)
    place = np.arange(len(data)) - begin[of]
    # Only suffixes that begin with a whole window: they end in no other run.
    order = suffix_order(data, length, np.flatnonzero(place + length <= size[of]))
    new = np.concatenate([[True], ~common_prefixes(data, order, length)])
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = doc[of[order]]
    least = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = order[docs > least]
    return of[late], place[late]


_DEALT = "key long, doc_id long, mark long, start int, windows int, run binary"
_DEALT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _DEALT_KINDS, strict=True)], names=["key", "doc_id", "mark", "start", "windows", "run"])


def _by_window(found: list[tuple]) -> list[tuple]:
    """Windows (bytes, doc, mark, start) by the hash of their bytes; without bytes those that a smaller doc here holds."""
    least: dict[bytes, int] = {}
    for w, doc, _, _ in found:
        least[w] = min(doc, least.get(w, doc))
    key = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) for w in least}
    return [(key[w], doc, mark, start, 1, w) if doc == least[w] else (doc, doc, mark, start, 1, None) for w, doc, mark, start in found]


def _fetch(length: int):
    """Runs by their anchors, and each window by itself where the anchor is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for doc, mark, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "wanted")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    start, n = w["start"], w["windows"]
                    if w["anchor"] != HOT:
                        rows.append((w["anchor"], doc, mark, start, n, raw[start : start + n + length - 1]))
                        continue
                    found += [(raw[i : i + length], doc, mark, i) for i in range(start, start + n)]
                    if len(found) >= HELD_WINDOWS:
                        yield _dealt(_by_window(found))
                        found = []
            yield _dealt(rows + _by_window(found))

    return run


def _compare(length: int):
    def windows(rows: list[tuple]) -> pa.RecordBatch:
        rows = list(dict.fromkeys(rows))
        doc, mark, start = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        which, at = later_windows(doc, [r[5] for r in rows], length)
        order = np.lexsort((at, which))
        which, at = which[order], at[order]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] > at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
        run = which[first]
        return _rows(doc[run], mark[run], start[run] + at[first], at[last] - at[first] + 1, np.zeros(len(first), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            settled = batch.filter(batch.column("run").is_null())
            yield pa.RecordBatch.from_arrays([*(settled.column(c) for c in _NAMES[:4]), pa.array(np.zeros(settled.num_rows, np.int64))], names=_NAMES)
            batch = batch.filter(batch.column("run").is_valid())
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield windows(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield windows(held)

    return run


# The whole


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                at = np.array([(w["start"], w["start"] + w["windows"] + length - 1) for w in found or ()], np.int64).reshape(-1, 2)
                start, end = unite(at[:, 0], at[:, 1])
                edges = [0, *(x for s in zip(start.tolist(), end.tolist(), strict=True) for x in s), len(raw)]
                n.append(len(raw))
                removed.append(int((end - start).sum()))
                spans.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip((n, removed, spans, kept), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def dealt_runs(known: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """What stage one settled, and the runs and windows that suffix arrays must compare, with the key that deals them."""
    spark, row = known.sparkSession, ["doc_id", "mark"]
    n = slices(spark)
    hot = spark.sparkContext.broadcast(hot_anchors(known, length, gram, most))
    packed = known.select("doc_id", "text").mapInArrow(_find_runs(BUCKETS * n, length, gram, hot), _PACKED)
    settled = stored(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle_runs(hot), _ROWS), "runs")
    wanted = settled.where("anchor <> 0").groupBy(*row).agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    return settled, known.join(wanted, row).select(*row, "text", "wanted").mapInArrow(_fetch(length), _DEALT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of the removed bytes), kept (the bytes that stay)."""
    n = slices(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    row = ["doc_id", "mark"]
    settled, dealt = dealt_runs(known, length, gram, most)
    compared = dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(length), _ROWS)
    found = settled.where("anchor = 0").unionByName(compared).groupBy(*row).agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    nothing = F.array().cast("array<struct<start:int,windows:int>>")
    joined = known.join(found, row, "left").select("doc_id", "text", "found").unionByName(docs.select("doc_id", "text", nothing.alias("found")).where(F.col("doc_id").isNull()))
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
