"""Operator 3: even shares, little movement, equal placement everywhere."""

import hashlib
from collections import Counter

import pytest

from stratalog.llm import sharding as sh


def test_table_is_even_and_moves_little():
    a = sh.lookup_table()
    assert len(a) == sh.SLOTS and max(Counter(a).values()) - min(Counter(a).values()) <= 1
    names = sh.SHARDS[:40] + sh.SHARDS[41:]
    b = [names[i] for i in sh.lookup_table(names)]
    moved = sum(sh.SHARDS[x] != y for x, y in zip(a, b, strict=True))
    assert moved < 3 * sh.SLOTS / 64
    assert set(sh.lookup_table(("one",), 11)) == {0}
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError, match="distinct"):
            sh.lookup_table(bad)


def test_turns_by_hand():
    names, slots = ("a", "b", "c"), 7
    prefs = []
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        o, s = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefs.append([(o + j * s) % slots for j in range(slots)])
    assert all(sorted(p) == list(range(slots)) for p in prefs)
    owner = {}
    while len(owner) < slots:
        for i, p in enumerate(prefs):
            free = next((x for x in p if x not in owner), None)
            if free is not None:
                owner[free] = i
    assert sh.lookup_table(names, slots) == [owner[i] for i in range(slots)]


def test_placement(spark, tmp_path):
    rows = [(i, "x", 9) for i in range(500)] + [(7, "again", 9), (None, "none", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sh.place(docs).collect()
    table = sh.lookup_table()
    assert len(out) == len(rows)
    for r in out:
        slot = 0 if r.doc_id is None else int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sh.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sh.place(docs.limit(0)).count() == 0
    hot = spark.range(4000).selectExpr("'hot' AS k", "id")
    assert sh.place(hot, "k").select("shard").distinct().count() == 1
    assert 4 < sh.place(hot, "k", spread=16, spread_by="id").select("shard").distinct().count() <= 16
    sh.write_shards(docs.drop("shard"), str(tmp_path / "s"), shards=("a", "b"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_rows_move_whole_and_come_back(spark, tmp_path):
    rows = [(i, f"text {i}", None if i % 3 else "s", 9) for i in range(300)] + [(7, "again", "s", 9), (7, "again", "s", 9), (None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    back = sh.sharded(docs)
    assert back.columns == ["doc_id", "text", "source", "slot", "shard"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, sh.place(docs).collect()), key=key)
    assert sh.sharded(docs.limit(0)).collect() == []
    # A hot key's rows are dealt over its shard's files, and with a spread over several shards.
    hot = spark.range(4000).selectExpr("'hot' AS k", "id")
    sh.write_shards(hot, str(tmp_path / "h"), "k", files_per_shard=16)
    assert len(list((tmp_path / "h").glob("shard=*"))) == 1 and len(list((tmp_path / "h").glob("shard=*/*.parquet"))) > 1
    assert sh.sharded(hot, key="k", spread=16, spread_by="id").select("shard").distinct().count() > 4
    with pytest.raises(ValueError, match="another column"):
        sh.place(hot, "k", spread=2)
