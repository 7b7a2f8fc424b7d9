"""Operation 13: held-out labels, sums against whole matrices, the prior on known mixtures, odd rows."""

import os
import zlib

import numpy as np
import pytest

from stratalog.llm.quality_classifier import BINS, NAMES, Scale, Sums, best_bin, classify, featured, fit, passed, prior_of, train
from stratalog.llm.text_features import figures

SF = "/root/testdata/sf0.01"
held_out = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(1, len(score) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@needs_tables
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    of = {r["doc_id"]: r["score"] for r in rows}
    test = [(of[r["doc_id"]], r["quality"]) for r in labels.collect() if held_out(r["doc_id"])]
    score, label = map(np.array, zip(*test, strict=True))
    assert auc(score, label) > 0.98 and ((score >= 0.5) == label).mean() > 0.97


@needs_tables
def test_nothing_but_text_and_training_labels_counts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if held_out(r["doc_id"]) else r["quality"]) for r in labels.collect()], "doc_id long, quality int")
    bare = docs.selectExpr("doc_id", "text", "'xx' as lang", "reverse(source) as source")
    by = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    a, b = by(classify(docs, labels)), by(classify(bare, turned))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_sums_over_parts_are_those_of_the_whole(spark):
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(["one", "Two,", "three.", "4", "$$$"], int(n))) for n in draw.integers(0, 30, 60)]
    x = np.array([figures(t) for t in texts], np.float64)
    good = draw.random(60) < 0.4
    rows = spark.createDataFrame([(figures(t).tobytes(), bool(g)) for t, g in zip(texts, good, strict=True)], "x binary, good boolean").repartition(4)
    scale = Scale(x.mean(0), x.std(0))
    w = draw.normal(size=1 + len(NAMES)) / 9
    got = passed(rows, scale, [w, 2 * w])
    assert np.allclose(got[0], Sums.of(scale.of(x), good, w)) and np.allclose(got[1], Sums.of(scale.of(x), good, 2 * w))
    # The step is downhill, and the fit's risk of the bad isn't below 0.
    s = Sums(got[0], 0.4, w)
    assert Sums(Sums.of(scale.of(x), good, w + 1e-4 * s.step), 0.4, w + 1e-4 * s.step).risk < s.risk
    best = fit(rows, scale, 0.4)
    assert Sums(Sums.of(scale.of(x), good, best), 0.4, best).bad_risk >= 0
    assert 0 < prior_of(rows, scale, best) <= 1


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_of_a_known_mixture(share):
    draw = np.random.default_rng(2)
    good, bad = draw.beta(8, 2, 40_000), draw.beta(2, 8, 40_000)
    every = np.concatenate([good[: int(20_000 * share)], bad[: int(20_000 * (1 - share))]])
    count = lambda x: np.histogram(x, BINS, (0, 1))[0]
    assert abs(best_bin(count(good[20_000:]), count(every)) - share) < 0.05


def test_odd_rows(spark):
    good, bad = "The plain words of a fair text, and more of them. ", "$$$ ### %%% "
    rows = [(k, good * (k % 5 + 1) if k % 4 else bad * (k % 7 + 1)) for k in range(90)] + [(200, None), (201, ""), (202, "   "), (None, good), (None, bad), (7, good * 3), (7, good * 3), (300, good * 20_000)]
    docs = spark.createDataFrame([(k, t, 1, "l", b"x") for k, t in rows], "doc_id long, text string, quality int, train string, x binary").repartition(3)
    labels = [(k, int(k % 4 > 0)) for k in range(0, 90, 2)] + [(k, 1) for k in range(1, 90, 3)] + [(5, 0), (5, 1), (None, 1), (12, None)]
    labels = spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r["held_out"] == (r["doc_id"] is not None and held_out(r["doc_id"])) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in got if r["doc_id"] is not None and 7 < r["doc_id"] < 90)
    model = train(featured(docs), labels)
    assert model is not None and 0.5 < model.prior <= 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert sorted((r["score"], r["predicted"]) for r in classify(docs, labels).collect()) == [(0.5, 1), (0.5, 1)]
    assert classify(docs.limit(0), labels).collect() == [] and classify(docs, labels.limit(0)).count() == 2


def test_figures_of_repetition():
    at = {n: i for i, n in enumerate(NAMES)}
    once, again = figures("a b c d e f g h"), figures("a b c a b c a b c")
    assert once[at["repeated triples"]] == 0 < again[at["repeated triples"]] and figures("x\ny\nx\nx")[at["repeated lines"]] > 0
    assert figures("")[at["empty"]] == figures(None)[at["empty"]] == 1 and np.isfinite(figures("\ud800 \x00 é")).all()
