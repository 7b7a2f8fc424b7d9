"""How much of the flows moves, and how large plans get: answers come to flows, flows don't go to answers."""

import os

import pytest

from stratalog import plans
from stratalog.operators import paths

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in x and "BroadcastExchange" not in x for x in plan.splitlines())


def size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_no_plan_of_the_matrix_is_large(spark, monkeypatch):
    """The driver keeps every plan of a query, and each again whenever it is planned anew."""
    sizes, write = [], paths.settled
    monkeypatch.setattr(paths, "settled", lambda df: sizes.append(size(df)) or write(df))
    sizes.append(size(plans.QUERIES["reach_matrix"](spark, SF)))
    assert max(sizes) < 200


def test_flows_that_are_placed_move_once_more_for_their_verdict(spark):
    assert shuffles(plans.QUERIES["reach_verdict"](spark, SF)) == 1


def test_flows_that_are_placed_move_no_more_for_their_hops(spark):
    assert shuffles(plans.QUERIES["reach_path"](spark, SF)) == 0


def test_answers_that_are_many_are_shuffled(spark, monkeypatch):
    """Without broadcasts the rows are the same."""
    rows = lambda: sorted(plans.QUERIES["reach_path"](spark, SF).collect())
    few = rows()
    monkeypatch.setattr(paths, "FEW", 0)
    monkeypatch.setattr(paths, "A_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_tell_blocks_that_hold_an_address(spark):
    """Of nested blocks the longest is the cell; where it ends, the one around it goes on, over many /16."""
    net = paths.network(spark, SF)
    frame = lambda rows: spark.createDataFrame(rows, "lo long, len int")
    blocks = [(10 << 24, 8), ((10 << 24) + (5 << 16), 16), ((10 << 24) + (5 << 16) + 64, 26), ((10 << 24) + (5 << 16) + 64, 32), (0xFFFFFFFF, 32), (255 << 24, 8)]
    net.routes, net.blocks, net.entries, net.rules = frame(blocks), frame(blocks[:1]), frame([]), spark.createDataFrame([], "lo long, len int, kind string")
    ips = [0, (10 << 24) - 1, 10 << 24, (10 << 24) + 70000, (10 << 24) + (5 << 16) + 63, *((10 << 24) + (5 << 16) + x for x in (64, 65, 127, 128, 65535, 65536)), (11 << 24) - 1, 11 << 24, 0xFFFFFFFF - 1, 0xFFFFFFFF, None]
    got = dict(paths.celled(spark.createDataFrame([(x,) for x in ips], "ip long"), paths.cells(net), "ip", "cell").collect())
    holds = lambda ip: max((n, lo) for lo, n in [*blocks, (0, 0)] if lo <= ip < lo + (1 << 32 - n))
    assert got == {x: None if x is None else holds(x)[1] * 64 + holds(x)[0] for x in ips}
