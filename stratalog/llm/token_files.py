"""Operator 6, token ids in binary files: bit planes of fixed-size blocks, zstandard, and a chunk index.

Documents are dealt by range of doc_id and sorted, so file after file holds them in ascending order. A file:

    magic; for each block of BLOCK ids its planes, each compressed on its own; then the index:
    per block (place, number of ids, sizes of its planes), per document (doc_id, has an id, number of ids);
    last the index's place and size, and the magic again.

Plane ``b`` of a block holds bit ``b`` of its ids (or byte ``b``, with ``planes="byte"``); a block has as many planes
as its largest id needs. A reader can fetch any block by the index. Files are written under a name of their own
and moved into place, so a task that is run again replaces its file with the same bytes.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; equal ids are ordered by
text; an empty table writes no file and reads back as no row; other columns are not carried.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored, table
from .encode import Encoder, Spaced, chunks, released, with_end

TOKENIZER = "word_bpe_49k.json"
BLOCK = 1 << 16
MAGIC = b"TBP1"
LEVEL = 3


def to_planes(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if planes == "byte":
        table_ = ids.view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(table_[:, b]).tobytes() for b in range((bits + 7) // 8)]
    return [np.packbits((ids >> b & 1).astype(np.uint8)).tobytes() for b in range(bits)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        out |= raw.astype(np.uint32) << (8 * b) if kind == "byte" else np.unpackbits(raw, count=n).astype(np.uint32) << b
    return out


class Writer:
    """Writes one file to an open stream; memory holds one block and the index."""

    def __init__(self, sink, planes: str = "bit", block: int = BLOCK):
        self.sink, self.kind, self.block = sink, planes, block
        self.zstd, self.held, self.at = zstandard.ZstdCompressor(level=LEVEL), np.zeros(0, np.uint32), len(MAGIC)
        self.blocks: list[list] = []
        self.docs: list[tuple] = []
        sink.write(MAGIC)

    def add(self, doc_ids: list, sizes: list[int], ids: np.ndarray) -> None:
        self.docs += zip(doc_ids, sizes, strict=True)
        self.held = np.concatenate([self.held, ids])
        while len(self.held) >= self.block:
            self._block(self.held[: self.block])
            self.held = self.held[self.block :]

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if len(self.held):
            self._block(self.held)
        docs = [d for d, _ in self.docs]
        head = self.zstd.compress(json.dumps({"planes": self.kind, "blocks": self.blocks}).encode())
        ids = self.zstd.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is not None for d in docs], np.uint8).tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes())
        index = struct.pack("<QQQ", len(head), len(ids), len(docs)) + head + ids
        self.sink.write(index + struct.pack("<QQ", self.at, len(index)) + MAGIC)


class Reader:
    """Reads a file by its index; memory holds the index and the blocks asked for."""

    def __init__(self, source):
        self.source, tail = source, 16 + len(MAGIC)
        size = source.size()
        source.seek(size - tail)
        at, n = struct.unpack("<QQ", source.read(16))
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        index = source.read(n)
        a, b, count = struct.unpack_from("<QQQ", index)
        self.zstd = zstandard.ZstdDecompressor()
        head = json.loads(self.zstd.decompress(index[24 : 24 + a]))
        raw = self.zstd.decompress(index[24 + a : 24 + a + b])
        self.kind, self.blocks = head["planes"], head["blocks"]
        values, has = np.frombuffer(raw, "<i8", count), np.frombuffer(raw, np.uint8, count, 8 * count)
        self.doc_ids = [v if h else None for v, h in zip(values.tolist(), has.tolist(), strict=True)]
        self.sizes = np.frombuffer(raw, "<i8", count, 9 * count)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        self.source.seek(at)
        return from_planes([self.zstd.decompress(self.source.read(s)) for s in sizes], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, at, k = np.zeros(0, np.uint32), 0, 0
        for doc, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            if at + n > len(held):
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                held, at = np.concatenate(parts), 0
            yield doc, held[at : at + n]
            at += n


def _write(path: str, folder: str, planes: str):
    def files(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        writer, stream = None, None
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, draft = f"{root}/part-{part:06d}.tbp", f"{root}/draft-{part:06d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        first = None
        for batch, texts in chunks(batches):
            if writer is None:
                stream = fs.open_output_stream(draft)
                writer, first = Writer(stream, planes), batch.column("doc_id")[0].as_py()
            ids, sizes = with_end(*encoder.encode(texts))
            writer.add(batch.column("doc_id").to_pylist(), sizes.tolist(), ids)
            n_docs, n_ids = n_docs + len(texts), n_ids + len(ids)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(draft, name)
            row = [[f"{folder}/part-{part:06d}.tbp"], [part], [first], [n_docs], [n_ids]]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["path", "part", "first_doc", "n_docs", "n_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every task meets the same words; the cache, which is bounded, is not learned anew by each.
        with released(Spaced, path, keep=True) as encoder:
            yield from files(batches, encoder)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, planes: str = "bit", parts: int | None = None) -> DataFrame:
    """Write all documents; returns one row per file: path, part, first_doc, n_docs, n_ids, start (ids before it)."""
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    ranged = docs.select("doc_id", "text").repartitionByRange(parts or slices(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ranged.mapInArrow(_write(path, folder, planes), "path string, part int, first_doc long, n_docs long, n_ids long"), "token-files")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(what: str):
    kind = {"crc32": ("ids_crc32", pa.int64()), "ids": ("ids", pa.list_(pa.int32()))}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    rows = []
                    for doc, ids in Reader(source).documents():
                        rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) if what == "crc32" else ids.tolist()))
                        start += len(ids)
                        if len(rows) >= (10_000 if what == "crc32" else 500):
                            yield _batch(rows, kind)
                            rows = []
                    if rows:
                        yield _batch(rows, kind)

    return run


def _batch(rows: list[tuple], kind: tuple) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    names, kinds = ["doc_id", "start", "n_tokens", kind[0]], [pa.int64()] * 3 + [kind[1]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def read_token_files(files: DataFrame, what: str = "ids") -> DataFrame:
    """doc_id, start, n_tokens and the ids (or their CRC) of each document, from the files themselves."""
    dealt = files.select("path", "start").repartition(slices(files.sparkSession))
    return dealt.mapInArrow(_read(what), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if what == 'crc32' else 'ids array<int>'}")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    return read_token_files(files, what="crc32")
