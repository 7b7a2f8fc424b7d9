"""Policies in one form: equal texts are read once, whatever rows they come in."""

from stratalog.operators import declared


def test_equal_texts_are_read_once_and_each_row_has_its_own_hash(spark, monkeypatch):
    sizes, settled = [], declared.settled
    monkeypatch.setattr(declared, "settled", lambda df: sizes.append((out := settled(df)).count()) or out)
    one, same, other = '{"a":["x"],"b":1}', ' {"b":1,"a":"x"}', '{"a":"y","b":1}'
    rows = [(i, one) for i in range(200)] + [(7, same), (7, other), (8, None), (9, "[1]"), (10, "no json"), (None, one)]
    got = declared.policy_hash(spark.createDataFrame(rows, "id long, text string")).collect()
    assert max(sizes) < 20
    assert len(got) == len(rows)
    kinds = {h for h in (r.hash for r in got)}
    assert len(kinds) == 3 and None in kinds
    assert sum(r.hash is None for r in got) == 3
    assert len({r.hash for r in got if r.id is None or r.id > 10 and r.id < 200}) == 1
    assert len([r for r in got if r.id == 7]) == 3 and len({r.hash for r in got if r.id == 7}) == 2


def test_no_object_at_all(spark):
    rows = [(1, "[1]"), (1, None), (2, "x")]
    assert sorted(tuple(r) for r in declared.policy_hash(spark.createDataFrame(rows, "id long, text string")).collect()) == [(1, None), (1, None), (2, None)]
