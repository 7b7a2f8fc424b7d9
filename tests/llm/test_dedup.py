"""Operators 1 and 2 against brute force."""

import random
import re

import numpy as np
import pytest

from stratalog.llm import bytescan, components, ngram_join, suffix_dedup


def test_two_stage_suffix_order():
    r = random.Random(1)
    for n in (0, 1, 2, 5, 40, 300):
        for letters in ("a", "ab", "abcdefgh"):
            parts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(n)]
            data = np.array([x for p in parts for x in (*(ord(c) for c in p), 0)], np.uint16)
            text = data.tolist() + [0] * 6
            got = suffix_dedup.suffix_order(data, 6).tolist()
            assert sorted(got) == list(range(len(data)))
            keys = [text[i : i + 6] for i in got]
            assert keys == sorted(keys)
            same = suffix_dedup.common_prefixes(data, np.array(got, np.int64), 6).tolist()
            assert same == [a == b for a, b in zip(keys, keys[1:])]


def test_only_places_of_whole_windows_are_sorted(monkeypatch):
    r, sorted_places, order = random.Random(2), [], suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda *a: sorted_places.append(order(*a)) or sorted_places[-1])
    runs = [bytes(r.choice(b"\0ab\xff") for _ in range(r.randint(0, 20))) for _ in range(300)]
    doc = np.array([r.randrange(60) for _ in runs], np.int64)
    for length in (1, 3, 8, 10):
        which, at = suffix_dedup.later_windows(doc, runs, length)
        first = {}
        for d, x in zip(doc.tolist(), runs):
            for p in range(len(x) - length + 1):
                first[x[p : p + length]] = min(d, first.get(x[p : p + length], d))
        windows = [(k, p) for k, x in enumerate(runs) for p in range(len(x) - length + 1)]
        assert sorted(zip(which.tolist(), at.tolist())) == [(k, p) for k, p in windows if first[runs[k][p : p + length]] < doc[k]]
        assert len(sorted_places[-1]) == len(windows)


def brute_removed(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in raw:
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                hit[p : p + length] = b"\1" * length
        out.append((i, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), bytes(x for x, h in zip(b, hit) if not h)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice(["the", "tion", "é", "or", "a", "😀", "x", "ing"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(25) for _ in range(4)]
    rows = [(i, text(r.randint(0, 120)) + (" " + r.choice(passages) + " " + text(r.randint(0, 20)) if r.random() < 0.5 else "")) for i in range(60)]
    base = text(90).split()
    for i in range(60, 110):
        near = list(base)
        for _ in range(r.randint(0, 3)):
            near[r.randrange(len(near))] = word()
        rows.append((i, " ".join(near)))
    rows += [(i, rows[7][1]) for i in range(110, 120)] + [(120, None), (121, ""), (122, "aa"), (123, "a" * 300), (124, "a" * 200), (125, "AB " * 99), (126, "ab " * 99), (3, "one id, two texts " + passages[0]), (None, passages[1] * 2), (7, rows[7][1])]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, n long").repartition(5)


def test_repeats_removed(spark, corpus):
    out = suffix_dedup.remove_repeats(frame(spark, corpus)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out), key=str)
    assert got == brute_removed(corpus, suffix_dedup.LENGTH)
    assert sum(x[2] for x in got) > 1000
    assert suffix_dedup.remove_repeats(frame(spark, corpus[:1]).limit(0)).count() == 0


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("percent", [85, 60])
def test_components(spark, corpus, percent):
    rows = [x for x in corpus if x[0] != 3]  # an id with two texts has two places
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), percent=percent).collect()), key=str)
    assert got == brute_components(rows, 4, percent)


def test_one_of_each(spark, corpus):
    docs = frame(spark, corpus)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 1 and 110 not in ids and {120, 121, 122} <= set(ids) and None in ids
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_prefix_tree_agrees_with_sets():
    r = np.random.default_rng(4)
    for _ in range(20):
        core = r.integers(0, 2**63, 80).astype(np.uint64)
        sets = [np.unique(np.concatenate([core[r.random(80) > 0.1], r.integers(0, 2**63, r.integers(0, 12)).astype(np.uint64)])) for _ in range(30)]
        probe = sets.pop()
        for percent in (50, 85, 100):
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe))]
            assert sorted(ngram_join.PrefixTree(sets).linked(probe, percent)) == want


def test_bitmaps_never_drop_a_link():
    r = np.random.default_rng(8)
    dropped = 0
    for _ in range(400):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.4], r.integers(0, 2**63, r.integers(0, 1 + n // 4)).astype(np.uint64)]))
        if len(b):
            link = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
            may = ngram_join.may_link(ngram_join.parity(a), len(a), ngram_join.parity(b), len(b), 85)
            assert may or not link
            dropped += not may
    assert dropped > 100


def test_words_are_hashed_by_content():
    hashes, counts = bytescan.word_hashes(["a Bc  é", "", "bc a", "\tÉ é\n"])
    assert counts.tolist() == [3, 0, 2, 2] and hashes[0] == hashes[4] and hashes[1] == hashes[3] and hashes[2] == hashes[6] != hashes[5]


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.connected(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
