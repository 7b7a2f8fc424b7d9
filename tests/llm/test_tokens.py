"""Operators 5 and 6: ids of whole texts, exact round trips, gapless windows."""

import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratalog.llm import encode, packing, token_files

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\nb c", "a \n b", "x\n\ny", "don't we'll 'tis", "é ü ß ñ 中文 字", "tab\tsep\r\nline", "Σας ΣΑΣ", "a\x01b", " x y z",
    "é ́x", "<|endoftext|> and <|endoftext|>x", "1234 5 67", "## %% && ... !!", "w" * 3000, "😀 😀😀 a😀", "line\x1cbreak\x85next", "a\x02b \x02 c", "İstanbul œuvre ªº µm e\u0301",
]


def texts(n=300):
    r = random.Random(3)
    bits = ["tion", "The", "é", "ing", "or", ",", ".", "'s", "12", "😀", "A"]
    gaps = [" "] * 12 + ["\n", "  ", "\n\n", "\t"]
    return ODD + ["".join("".join(r.choice(bits) for _ in range(r.randint(1, 4))) + r.choice(gaps) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, encode.ByteLevel), (WORD, encode.Spaced)])
def test_ids_are_those_of_whole_texts(path, kind):
    plain, many = Tokenizer.from_file(path), texts()
    for limit in (10**9, 20_000, 0):
        e = kind(path, limit)
        for part in (many[:100], many[100:], many[50:150]):
            ids, sizes = e.encode(part)
            want = [x.ids for x in plain.encode_batch(part, add_special_tokens=False)]
            assert sizes.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
            assert e.held_bytes() <= limit and all(len(p) <= encode.LONG for p in e.known) or limit == 10**9


def test_forms_of_a_word_are_few_and_kept():
    with encode.released(encode.Spaced, WORD, keep=True) as e:
        e.empty()
        e.encode(["once"])
    assert e.known
    e = encode.Spaced(WORD)
    e.encode(["Mile mile, MILE. mile", "MILE.\n", "<|ENDOFTEXT|> mile"])
    assert set(e.known) == {"mile", "mile,", "mile.", "", "<|ENDOFTEXT|>"}
    odd = ["a,. b", "it's, A.", "a.\tb, ", ".a , B.", "<|ENDOFTEXT|>, <|endoftext|>.", "K\u212a, K.", "'S, x"]
    ids, _ = e.encode(odd)
    assert ids.tolist() == [i for t in odd for i in Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids]


def test_cache_is_emptied_at_a_tasks_end():
    with encode.released(encode.ByteLevel, BYTE) as e:
        e.encode(texts())
        assert e.known and len(e.again) == len(e.known) == len(e.size)
    assert not e.known and not len(e.pool)
    with encode.released(encode.ByteLevel, BYTE) as again:
        assert again is e


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, length int, start string").repartition(3)


def test_packing_places_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(texts(200))] + [(5, "twin"), (5, "twin"), (None, None), (900, "long text here " * 3000)]
    out = packing.pack(frame(spark, rows)).toPandas()
    plain = Tokenizer.from_file(BYTE)
    want = sorted(tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    by = {}
    for r in out.itertuples():
        assert len(r.ids) == r.length and 0 < r.length <= 2048
        by.setdefault((None if np.isnan(r.doc_id) else r.doc_id), []).append(r)
    for d in {d for d, _ in rows} - {5}:
        got = sorted(by[d], key=lambda r: r.start)
        flat = [i for r in got for i in r.ids]
        assert tuple(flat) in want and got[0].doc_tokens == len(flat) and [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
    assert len(by[5]) == 3
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.cumsum([0, *g["length"]])[:-1].tolist() and g["length"].sum() <= 2048
    assert out["length"].sum() == sum(map(len, want))
    assert out["sequence_id"].nunique() <= np.ceil(out["length"].sum() / 2048) + 2
    assert packing.pack(frame(spark, rows[:1]).limit(0)).count() == 0


def test_best_fit_is_bounded():
    w = packing.OpenWindows(10, 2)
    assert [w.place(n) for n in (6, 7, 3, 4, 5, 6, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 5)]
    assert w.place(9)[1] == 0 and len(w.room) <= 2


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_file_round_trip(kind, n):
    r = np.random.default_rng(n)
    sizes = r.integers(0, 9, n)
    ids = r.integers(0, 49408, sizes.sum()).astype(np.uint32)
    sink = io.BytesIO()
    w = token_files.Writer(sink, kind, block=64)
    docs = [None if i % 5 == 4 else int(i) * 3 - 4 for i in range(n)]
    w.add(docs, sizes.tolist(), ids)
    w.close()
    got = list(token_files.Reader(pa.BufferReader(sink.getvalue())).documents())
    assert [d for d, _ in got] == docs and [len(x) for _, x in got] == sizes.tolist()
    assert np.concatenate([np.zeros(0, np.uint32), *(x for _, x in got)]).tolist() == ids.tolist()


def test_token_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(100))] + [(5, "twin"), (5, "twin"), (None, None)]
    files = token_files.write_token_files(frame(spark, rows), str(tmp_path / "f"), parts=4)
    out = token_files.read_token_files(files, what="crc32").collect()
    plain = Tokenizer.from_file(WORD)
    want, at = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(frame(spark, rows[:1]).limit(0), str(tmp_path / "e"))).count() == 0
