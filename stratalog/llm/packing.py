"""Operator 5, packing: bounded-space best-fit packing of tokenized documents into fixed windows.

Each partition keeps at most ``OPEN`` windows open. A document's full windows are sequences of their own; its
rest goes into the open window that it fills best; when none has room, the fullest is emitted and a new one
opened. What is still open at a partition's end is merged: leftovers of ``MERGE`` neighbouring partitions form
one bounded group and are packed best-fit, largest first.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are packed one by one; ties go to
the oldest window; an empty table gives no piece; other columns are not carried. Sequences end where their
last piece ends; a reader pads them to the window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, stored, table
from .encode import ByteLevel, Encoder, chunks, released, with_end

WINDOW = 2048
OPEN = 64
MERGE = 64
TOKENIZER = "byte_bpe_50k.json"

PIECE = "doc_id long, start long, length long, {what}, doc_tokens long, part int, window long, offset long, fill int, closed boolean"
_ARROW = {"crc32": pa.int64(), "ids": pa.list_(pa.int32())}
_SQL = {"crc32": "ids_crc32 long", "ids": "ids array<int>"}


class OpenWindows:
    """A fixed number of open windows; sizes in, (window number, place in it) out."""

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most, self.next = window, most, 0
        self.room: dict[int, int] = {}
        self.order: list[tuple[int, int]] = []  # (room, window), the fullest first

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        at = bisect_left(self.order, (size, -1))
        if at < len(self.order):
            room, best = self.order.pop(at)
        else:
            if len(self.order) == self.most:
                del self.room[self.order.pop(0)[1]]
            room, best = self.window, self.fresh()
        if room > size:
            self.room[best] = room - size
            insort(self.order, (room - size, best))
        else:
            self.room.pop(best, None)
        return best, self.window - room


def _pack_partition(path: str, window: int, most: int, what: str):
    names = [x.split()[0] for x in PIECE.format(what=_SQL[what]).split(", ")]
    kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), _ARROW[what], pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True))

    def out(rows: list[tuple], closed: bool, windows: OpenWindows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        part = TaskContext.get().partitionId()
        fill = [windows.window - windows.room.get(k, 0) for k in cols[5]]
        values = [*cols[:5], [part] * len(rows), cols[5], cols[6], fill, [closed] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in zip(names, values, strict=True)], names=names)

    def pieces(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(window, most)
        waiting: dict[int, list[tuple]] = {}
        for batch, texts in chunks(batches):
            ids, sizes = with_end(*encoder.encode(texts))
            done, at = [], 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                for start in range(0, n, window):
                    size = min(window, n - start)
                    piece = np.ascontiguousarray(ids[at + start : at + start + size], dtype="<u4")
                    shown = zlib.crc32(piece.tobytes()) if what == "crc32" else piece.astype(np.int32)
                    if size == window:
                        done.append((doc, start, size, shown, n, windows.fresh(), 0))
                        continue
                    k, offset = windows.place(size)
                    waiting.setdefault(k, []).append((doc, start, size, shown, n, k, offset))
                at += n
            for k in [k for k in waiting if k not in windows.room]:
                done += waiting.pop(k)
            if done:
                yield out(done, True, windows)
        if waiting:
            yield out([x for v in waiting.values() for x in v], False, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released(ByteLevel, path) as encoder:
            yield from pieces(batches, encoder)

    return run


def _merge_group(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins = OpenWindows(window, max(1, len(rows)))
        each = rows[["part", "window", "fill"]].drop_duplicates().sort_values(["fill", "part", "window"], ascending=[False, True, True])
        placed = [(p, w, *bins.place(fill)) for p, w, fill in each.itertuples(index=False)]
        to = pd.DataFrame(placed, columns=["part", "window", "to", "base"])
        rows = rows.merge(to, on=["part", "window"])
        rows["offset"] += rows["base"]
        rows["sequence_id"] = (1 << 62) + (int(key[0]) << 32) + rows["to"]
        return rows

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN, what: str = "ids") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (or their CRC), doc_tokens, sequence_id, offset."""
    in_small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = PIECE.format(what=_SQL[what])
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_pack_partition(path, window, open_windows, what), schema), "pieces")
    names = ["doc_id", "start", "length", _SQL[what].split()[0], "doc_tokens", "sequence_id", "offset"]
    done = pieces.where("closed").withColumn("sequence_id", F.col("part").cast("long") * (1 << 32) + F.col("window"))
    left = pieces.where("NOT closed").withColumn("group", F.floor(F.col("part") / MERGE))
    keep = [x for x in pieces.columns if x != "closed"]
    fields = ", ".join(x for x in schema.split(", ") if not x.startswith("closed"))
    merged = left.select("group", *keep).groupBy("group").applyInPandas(lambda k, rows: _merge_group(window)(k, rows)[[*keep, "sequence_id"]], f"{fields}, sequence_id long")
    return done.select(*names).unionByName(merged.select(*names))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), what="crc32")
