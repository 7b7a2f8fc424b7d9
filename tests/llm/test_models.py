"""Operators 4 and 8: brute-force counts, exact likelihoods, held-out quality."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import hmm_scoring as hm
from stratalog.llm import html_extract as hx


def corpus(n=400):
    r = random.Random(2)
    tongues = [["".join(r.choice(p) for _ in range(r.randint(1, 3))) for _ in range(200)] for p in (["the", "ing", "or"], ["der", "ung", "ß"], ["que", "eau", "é"])]
    rows = []
    for i in range(n):
        t = r.choice(tongues)
        rows.append((i, " ".join(t[min(int(r.expovariate(0.03)), 199)].capitalize() for _ in range(r.randint(0, 80)))))
    return [*rows, (None, "Der ung"), (n, None), (n, ""), (7, "x" * 40), (11, "new\x0bWords\there " * 3), (13, "w " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, n int, base double").repartition(3)


def tokens(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_score_and_model(spark):
    rows = corpus()
    out = hm.score(frame(spark, rows)).collect()
    train = Counter(x for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for x in tokens(t))
    total, distinct = sum(train.values()), len(train)
    want = sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens(t)), sum(train[x] > 0 for x in tokens(t)), total, round(sum(math.log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert hm.score(frame(spark, rows[:1]).limit(0)).count() == 0


def test_nothing_to_train_on(spark):
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = hm.score(frame(spark, [(i, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0)


def small_model(k=3, n=5):
    r = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hm.Hmm(norm(r.random(k)), norm(r.random((k, k))), norm(r.random((k, n))))


def test_forward_and_baum_welch_agree_with_enumeration():
    import itertools

    m, texts = small_model(), [np.array(x) for x in ([0], [1, 2, 4], [3, 3], [0, 1, 2, 3])]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for text, got in zip(texts, m.log10(texts), strict=True):
        total = 0.0
        s, mv, e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
        for path in itertools.product(range(3), repeat=len(text)):
            p = m.start[path[0]] * m.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], text[t]]
            total += p
            s[path[0]] += p
            for t, x in enumerate(text):
                e[path[t], x] += p
                if t:
                    mv[path[t - 1], path[t]] += p
        assert got == pytest.approx(math.log10(total))
        starts, moves, emits = starts + s / total, moves + mv / total, emits + e / total
    for a, b in zip(m.expected(texts), (starts, moves, emits), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_probabilities_of_words_add_up_to_one_within_a_class():
    words = [b"thing", b"wing", b"a"]
    tokens_, distinct = np.zeros(hm.CLASSES, np.int64), np.zeros(hm.CLASSES, np.int64)
    for w, c in zip(words, (500, 3, 9), strict=True):
        tokens_[hm.word_class(w)] += c
        distinct[hm.word_class(w)] += 1
    lex = hm.Lexicon(words[:1], [500], tokens_, distinct, 10)
    assert lex.symbol[0] == hm.CLASSES and lex.end == hm.CLASSES + 1 and lex.share.sum() == pytest.approx(1)
    assert lex.tokens == 522 and lex.distinct == 4
    assert lex.inner_log(np.array([hm.word_class(b"wing")]), np.array([3]))[0] == pytest.approx(math.log10(3.5 / (3 + 0.5 * 2)))


def test_hash_and_class_are_sparks(spark):
    words = [b"a", "é😀".encode(), b"longer than thirty-two bytes, to reach every branch of it", b"ab", b"abc", b"abcd"]
    last = F.expr(f"substring(word, greatest(length(word) - {hm.SUFFIX - 1}, 1), {hm.SUFFIX})")
    got = spark.createDataFrame([(w,) for w in words], "word binary").select("word", F.xxhash64("word").alias("h"), F.pmod(F.crc32(last), F.lit(hm.CLASSES)).alias("c")).collect()
    assert all((hm.word_hash(bytes(r.word)), hm.word_class(bytes(r.word))) == (r.h, r.c) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav class=menu><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="ad">Buy now &amp; save.</div>
<article><h1>Head&nbsp;line &amp; more</h1><p>First <b>bold</b>ly
 said, a &lt; b.<br>Second line of the text, with words.<p>Third paragraph holds many more words, so that it counts.</p></article>
<div class="comments"><p>Nice post!</p></div><footer>&copy; x</footer>"""


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(5)
    words = ["tion", "the", "or", "ing", "an", "er", "of"]
    text = lambda n: " ".join("".join(r.choice(words, r.integers(1, 4))) for _ in range(n)).capitalize() + "."
    pages = []
    for _ in range(60):
        body = "".join(f"<p>{text(int(r.integers(5, 60)))}</p>" for _ in range(r.integers(1, 8)))
        pages.append(f"<html><body><nav><ul><li><a href=x>{text(2)}</a></li></ul></nav><div class=ad>{text(8)}</div><article><h1>{text(5)}</h1>{body}</article><footer>{text(6)}</footer></body></html>")
    return pages, hx.train(pages)


def test_page(model):
    got = hx.extract_page(PAGE, model[1])
    assert got == "Head line & more First boldly said, a < b. Second line of the text, with words. Third paragraph holds many more words, so that it counts."


def test_odd_markup(model):
    for source in ("", "text only", "<", "<<p", "<!-- never closed <p>x", "<script>alert(1)", "<p", "</p></div>", "<div " + 'a="' * 500, "<p>" * 3000 + "deep", "<div>" * 3000 + "x" + "</div>" * 3000, "&#x110000; &bogus; &amp"):
        assert isinstance(hx.extract_page(source, model[1]), str)


def test_decoding_never_contradicts():
    r = np.random.default_rng(3)
    nodes = hx.parse(PAGE)
    for _ in range(50):
        keep = hx.decode(nodes, r.normal(0, 3, len(nodes)))
        assert keep[0] and all(keep[x.parent] for x, k in zip(nodes[1:], keep[1:], strict=True) if k)


def test_held_out_layouts(model):
    pages, trees = model
    r = np.random.default_rng(77)
    pool = [t for p in pages for x in hx.parse(p) for _, t in x.blocks if len(t) > 20]
    good = 0
    for _ in range(150):
        main = [pool[r.integers(len(pool))] for _ in range(r.integers(2, 12))]
        nodes, _ = hx.layout_labels(hx.layout(r, main, pool))
        good += hx.text_of(nodes, hx.decode(nodes, trees.log_odds(hx.features(nodes)))) == " ".join(main)
    assert good >= 0.8 * 150


def test_extract(spark, model):
    pages = model[0]
    rows = [(i, f"u{i}", p, 1) for i, p in enumerate(pages)] + [(100, "u", None, 1), (101, None, "", 1), (None, "u", PAGE, 1), (0, "u0", pages[0], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = hx.extract(df).collect()
    assert len(out) == len(rows)
    by = {(r.page_id, r.url): r.text for r in out}
    assert by[100, "u"] == by[101, None] == ""
    want = [re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", re.search("<article>(.*)</article>", p)[1])).strip() for p in pages]
    assert sum(by[i, f"u{i}"] == w for i, w in enumerate(want)) >= 57
    assert hx.extract(df.limit(0)).count() == 0
