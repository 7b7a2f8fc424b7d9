"""Operator 2 where many documents put bytes of their own beside one passage."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.llm import suffix_dedup

from .test_dedup import brute_removed, corpus, frame  # noqa: F401


@pytest.fixture(scope="module")
def edges():
    r = random.Random(5)
    own = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 70)))
    passage = "".join(r.choice("ijklmnop ") for _ in range(160))
    rows = [(i, own() + passage + own()) for i in range(400)]
    return [*rows, (3, own() + passage), (400, passage), (None, passage), (7, rows[7][1])]


def known(docs):
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.crc32("text").alias("mark"), "text")


def test_no_anchor_is_a_task_of_its_own(spark, edges):
    _, dealt = suffix_dedup.dealt_runs(known(frame(spark, edges)), most=20)
    whole = suffix_dedup.dealt_runs(known(frame(spark, edges)), most=10**9)[1]
    largest = lambda d: d.where("run IS NOT NULL").groupBy("key").agg(F.sum(F.length("run")).alias("n")).agg(F.max("n")).first()[0]
    assert largest(whole) > 15_000  # grows with the documents
    assert largest(dealt) < 3_000


@pytest.mark.parametrize("most", [1, 20, 10**9])
def test_results_are_the_same_wherever_runs_meet(spark, edges, corpus, most):  # noqa: F811
    for rows in (edges, corpus):
        out = suffix_dedup.remove_repeats(frame(spark, rows), most=most).collect()
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out), key=str)
        assert got == brute_removed(rows, suffix_dedup.LENGTH)
