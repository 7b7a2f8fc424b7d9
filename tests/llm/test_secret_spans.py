"""Operation 9: unions and remainders of many spans against plain loops, and a text with very many keys."""

import random
import time

from pyspark.sql import functions as F

from stratalog.llm import secret_scan as s


def union_of(spans):
    out = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def left_of(runs, union):
    out = []
    for start, end, _ in runs:
        met = [b for b in union if b[0] < end and start < b[1]]
        out += [(a, b) for a, b in zip([start] + [x[1] for x in met], [x[0] for x in met] + [end], strict=True) if b - a >= 16]
    return out


def test_unions_and_what_they_leave(spark):
    draw, rows = random.Random(3), []
    for k in range(200):
        spans = [(a := draw.randint(0, 900), a + draw.randint(1, 30)) for _ in range(draw.choice([0, 1, 3, 40, 300, 700]))]
        runs, at = [], 0
        while at < 900 and draw.random() < 0.98:
            at += draw.randint(1, 40)
            end = at + draw.randint(16, 60)
            runs.append((at, end, "x" * (end - at)))
            at = end + 1
        rows.append((k, spans, runs))
    df = spark.createDataFrame(rows, "k int, spans array<struct<start:int,end:int>>, runs array<struct<start:int,end:int,value:string>>")
    df = df.withColumn("u", s.united(F.col("spans"))).withColumn("left", s.free_parts(F.col("runs"), F.col("u"), 16))
    for r in df.collect():
        union = union_of(map(tuple, r.spans))
        assert [tuple(x) for x in r.u] == union
        assert [(x.start, x.end) for x in r.left] == left_of(r.runs, union) and all(len(x.value) == x.end - x.start for x in r.left)


def test_very_many_keys_in_one_text(spark):
    draw = random.Random(4)
    keys = [f"{draw.getrandbits(128):032x}" for _ in range(12_000)]
    docs = spark.createDataFrame([(1, "é ".join(keys))], "doc_id long, text string").cache()
    docs.count()
    s.scan(docs.where("doc_id < 0")).count()  # what planning takes isn't meant
    began = time.monotonic()
    (row,) = s.scan(docs).select("hex").collect()
    assert [(m.start, m.end, m.value) for m in row.hex] == [(34 * i, 34 * i + 32, k) for i, k in enumerate(keys)]
    assert time.monotonic() - began < 30  # 5 s beside other work; quadratic it took 28 there
    (masked,) = s.mask_secrets(docs).collect()
    assert masked.text == "é ".join([s.MASK] * 12_000)
