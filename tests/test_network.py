"""Ranges as blocks, overlaps, access lists and groups against brute force, and on many equal or neighbouring ranges."""

import random
import time

from pyspark.sql import functions as F

from stratalog.operators import network, reach


def test_blocks_are_the_fewest(spark):
    r = random.Random(4)
    spans = [(0, 0, (1 << 32) - 1), (1, 5, 4), (2, 7, 7), (3, 0, (1 << 32) - 2), (4, 1, (1 << 32) - 1)] + [(i, a, a + r.choice([0, 1, 255, 256, 511, 70000, r.randrange(1 << 20)])) for i in range(5, 200) for a in [r.randrange(1 << 31)]]
    want = []
    for i, lo, hi in spans:
        while lo <= hi:
            k = max(k for k in range(33) if lo % (1 << k) == 0 and (1 << k) <= hi - lo + 1)
            want.append((i, lo, 32 - k))
            lo += 1 << k
    got = network.in_blocks(spark.createDataFrame(spans, "id long, lo long, hi long")).select("id", "lo", "len")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_overlaps(spark):
    r = random.Random(5)
    rows = [(r.randrange(50), r.randrange(3), lo, lo + r.choice([-3, 0, 1, 7, 40])) for _ in range(120) for lo in [r.randrange(150)]]
    want = sorted((x[1], x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[0] < y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, network.overlapping_subnets(spark.createDataFrame(rows, "id long, vpc long, lo long, hi long")).collect())) == want


def test_neighbours_make_no_candidates(spark):
    """65,536 subnets side by side in one network: pairs of one bucket were 4,294,967,296."""
    began = time.perf_counter()
    assert network.overlapping_subnets(spark.range(1 << 16).selectExpr("id", "1L AS vpc", "id AS lo", "id AS hi")).count() == 0
    assert time.perf_counter() - began < 40


def test_equal_entries_meet_once(spark):
    """50,000 points and 80,000 entries of one list: pairs were 4,000,000,000."""
    points = spark.range(50000).selectExpr("id", "1L AS acl", "id * 5 AS ip", "id % 100 AS port")
    entries = spark.range(80000).selectExpr("1L AS acl", "id + 1 AS rule", "CASE WHEN id % 2 = 0 THEN 'deny' ELSE 'allow' END AS action", "id % 3 * 1000 AS lo", "id % 3 * 1000 + 1999 AS hi", "id % 2 * 50 AS from_port", "id % 2 * 50 + 59 AS to_port")
    began = time.perf_counter()
    got = {x["id"]: (x["action"], x["rule"]) for x in network.first_match(points, entries).collect()}
    assert time.perf_counter() - began < 40
    first = [(k % 3 * 1000, k % 2 * 50, "allow" if k % 2 else "deny", k + 1) for k in range(6)]
    for i in range(50000):
        hit = next(((v, n) for lo, port, v, n in first if lo <= i * 5 < lo + 2000 and port <= i % 100 < port + 60), ("deny", None))
        assert got[i] == hit


def test_equal_rules_meet_once(spark):
    """40,000 pairs and 100,000 rules of one group, of every kind."""
    pairs = spark.range(40000).selectExpr("id AS pair", "id % 7 AS source", "100L AS target", "id AS ip", "id % 10 AS port")
    members = spark.createDataFrame([(100, 1), (3, 2), (4, 3)], "host long, grp long")
    rules = spark.range(100000).select(
        F.lit(1).cast("long").alias("grp"), F.expr("element_at(array('cidr', 'group', 'list'), cast(id % 3 AS int) + 1)").alias("kind"), F.lit(2).cast("long").alias("peer"),
        F.lit(0).cast("long").alias("lo"), F.lit(99).cast("long").alias("hi"), F.expr("id % 3").alias("from_port"), F.expr("id % 3 + 2").alias("to_port"),
    )
    began = time.perf_counter()
    got = dict(map(tuple, reach.allowed_by_groups(pairs, members, rules).collect()))
    assert time.perf_counter() - began < 40
    for i in range(40000):
        port = i % 10
        allow = port <= 2 and i <= 99 or 1 <= port <= 3 and i % 7 == 3
        assert got[i] == ("allow" if allow else "unknown" if 2 <= port <= 4 else "block")
