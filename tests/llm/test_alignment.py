"""Operation 11 against a token-by-token alignment of whole texts by the libraries alone."""

import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratalog.llm.alignment import Led, Pieces, align, diagonals, op11_alignment

SF = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    None, "", " ", "   ", "a", "a ", " a", "a  b", "  a   b  ", "\n", "\n\n a", "x\n\ny", "\t tab\there", "<|endoftext|> <s> </s> <unk>", "a<|endoftext|>b", "▁x", "a ▁", "naïve café, Straße", "日本語のテキスト 混ぜる", "👩‍👩‍👧‍👦 emoji 🙂",
    "\x00 nul \x1f", "é ﬁ  nbsp em", "tie tie tie", "tie tie tie", "word " * 3000, "abc" * 4000, " " * 500 + "end", "1234567890" * 50, "<0x0A> 0x0A", "it's I'LL don't",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_table():
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + n)] = b
            n += 1
    return table


def brute(libraries, rows):
    a, b = libraries
    table, found = byte_table(), []
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((doc, [], [], []))
            continue
        spans = lambda xs: list(zip(np.cumsum([0, *map(len, xs[:-1])]).tolist(), np.cumsum(list(map(len, xs))).tolist(), strict=True))
        at_a, at_b, links, groups, j = spans(bytes_a), spans(bytes_b), [], [], 0
        for i, (lo, hi) in enumerate(at_a):
            while at_b[j][1] <= lo:
                j += 1
            k = j
            while k < len(at_b) and at_b[k][0] < hi:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        i = j = 0
        for end in both:
            m, n = i, j
            while m < len(at_a) and at_a[m][1] <= end:
                m += 1
            while n < len(at_b) and at_b[n][1] <= end:
                n += 1
            groups.append(",".join(map(str, ids_a[i:m])) + "|" + ",".join(map(str, ids_b[j:n])))
            i, j = m, n
        found.append((doc, (ids_a, ids_b), links, groups))
    counts = Counter(x for _, _, links, _ in found for x in links)
    best: dict = {}
    for (_, b_id), c in counts.items():
        best[b_id] = max(best.get(b_id, 0), c)
    return sorted(
        (
            -1 if doc is None else doc, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc, ids, links, groups in found
    )


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


@pytest.mark.parametrize(("piece", "rate"), [(8192, 400_000), (16, 400_000), (7, 50), (64, 0)])
def test_odd_texts(spark, libraries, piece, rate):
    rows = [(i if i != 3 else None, x) for i, x in enumerate(ODD)] + [(5, "repeated id"), (5, "repeated id")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, links string, piece int, doc int").repartition(3)
    assert got(align(df, piece=piece, known_rate=rate)) == brute(libraries, rows)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_given_table(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(libraries, rows)
    assert got(op11_alignment(spark, SF)) == want
    assert got(align(spark.read.parquet(f"{SF}/documents.parquet"), piece=500, known_rate=1000)) == want


def test_cut_texts_have_the_ids_of_whole_ones(libraries):
    a, b = libraries
    led, own = Led(PATHS[0]), Pieces(PATHS[1])
    draw = np.random.default_rng(4)
    texts = ["".join(draw.choice(list("ab c  \n.,'1é▁<s>\t"), n).tolist()) for n in draw.integers(1, 60, 400)] + [x for x in ODD if x]
    for encoder, of, want in ((led, lambda t: " " + t, lambda t: a.encode(" " + t, add_special_tokens=False).ids), (own, lambda t: t, b.encode)):
        held = [t for t in texts if encoder is led or "▁" not in t]  # such texts don't come back byte by byte, and count as none
        ids, n = encoder.encode([of(t) for t in held])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [want(t) for t in held]


def test_diagonals_cut_equal_work_and_no_tie():
    draw = np.random.default_rng(6)
    for _ in range(300):
        end = int(draw.integers(1, 60))
        a, b = (np.unique(np.append(draw.integers(1, end + 1, draw.integers(0, 50)), end)) for _ in "ab")
        piece = int(draw.integers(1, 12))
        i, j = diagonals(a, b, piece)
        path = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for m, n in zip(i.tolist(), j.tolist(), strict=True):
            assert [s for _, s in path[: m + n]].count(0) == m
            assert not (0 < m and n < len(b) and a[m - 1] == b[n])
        assert max(np.diff(i + j)) <= piece + 1
