"""What is held at once on the way of texts to Python: a run's strings, a small batch's rows."""

import tracemalloc

import pyarrow as pa

import corpus_pipeline
from stratalog.llm import common, encode


def test_only_a_run_of_texts_is_strings_at_once():
    texts = ["a", None, "é" * 600_000, *["x" * 200_000] * 200, "", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    tracemalloc.start()
    sizes, ids = [], []
    for part, some in encode.chunks(iter([batch])):
        sizes.append([len(x.encode()) for x in some])
        ids += part.column("doc_id").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(len(texts))) and [n for x in sizes for n in x] == [len((x or "").encode()) for x in texts]
    assert all(sum(x) <= encode.CHUNK_BYTES or len(x) == 1 for x in sizes)
    assert peak < 8 << 20  # the batch has 41 MB


def test_stages_with_python_send_small_batches(spark):
    key, given = "spark.sql.execution.arrow.maxBytesPerBatch", "64m"
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('abcde ', 1000) AS text")
    size = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.packing):
        spark.conf.set(key, given)
        stage(spark, docs.limit(3), "")
        found = docs.mapInArrow(size, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 3000 and max(r.bytes for r in found) <= common.BATCH_BYTES + 10_000
