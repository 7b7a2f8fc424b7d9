"""Ways of single flows by hand: translation, replies that fail, peerings that don't lead on, equal classes."""

from dataclasses import replace

import pytest

from stratalog.operators import paths
from stratalog.operators.paths import Network, hops, matrix, verdicts


def ip(text):
    a, b, c, d = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | d


A, B, C = "10.1.0.0", "10.2.0.0", "10.3.0.0"


@pytest.fixture(scope="module")
def net(spark):
    def frame(schema, rows):
        return spark.createDataFrame(rows, schema)

    everything = [(acl, way, 100, None, 0, 0, 0, 65535, True) for acl in (1, 2) for way in (True, False)]
    # List 3 lets connections in and only some reply ports out.
    narrow = [(3, False, 100, 6, 0, 0, 0, 65535, True), (3, True, 100, 6, 0, 0, 32768, 65535, True), (3, True, 90, 6, ip(A), 24, 40000, 40000, False)]
    return Network(
        hosts=frame("host long, kind string, subnet long, ip long, state string, public string", [(1, "instance", 11, ip("10.1.0.5"), "running", "yes"), (2, "instance", 12, ip("10.1.1.5"), "running", "no"), (3, "instance", 21, ip("10.2.0.5"), "running", None), (4, "instance", 31, ip("10.3.0.5"), "running", "no"), (5, "instance", 11, ip("10.1.0.6"), "stopped", "yes"), (6, "rds", 21, ip("10.2.0.9"), "running", "no"), (7, "instance", 12, ip("10.1.1.6"), "running", "no")]),
        membership=frame("host long, grp long", [(h, 100) for h in (1, 2, 5, 7)] + [(3, 200), (6, 200), (4, 300)]),
        subnets=frame("subnet long, vpc long, tbl long, acl long", [(11, 1, 1, 1), (12, 1, 2, 2), (21, 2, 3, 3), (31, 3, 4, 1)]),
        blocks=frame("vpc long, lo long, len int", [(1, ip(A), 16), (2, ip(B), 16), (3, ip(C), 16)]),
        regions=frame("vpc long, region string", [(1, "x"), (2, "x"), (3, "y")]),
        gateways=frame("gateway string, vpc long", [("igw", 1)]),
        routes=frame("tbl long, lo long, len int, kind string, target string, blackhole boolean", [(1, 0, 0, "igw", "igw", False), (1, ip(B), 16, "peering", "p12", False), (1, ip(C), 16, "peering", "p12", False), (2, 0, 0, "nat", "nat", False), (2, ip(B), 16, "peering", "p12", True), (3, ip(A), 16, "peering", "p12", False), (3, ip(C), 16, "peering", "p23", False), (4, ip(B), 16, "tgw", "t", False)]),
        tables=frame("tbl long, vpc long", [(1, 1), (2, 1), (3, 2), (4, 3)]),
        peerings=frame("pcx string, a long, b long, status string", [("p12", 1, 2, "active"), ("p23", 2, 3, "active")]),
        attachments=frame("tgw string, vpc long", [("t", 3)]),
        nats=frame("nat string, subnet long, state string, private boolean", [("nat", 11, "available", False)]),
        entries=frame("acl long, egress boolean, num long, proto long, lo long, len int, from_port long, to_port long, allow boolean", everything + narrow),
        rules=frame("grp long, egress boolean, proto long, kind string, lo long, len int, peer long, from_port long, to_port long", [(g, True, None, "cidr", 0, 0, None, 0, 65535) for g in (100, 200, 300)] + [(100, False, 6, "group", None, None, 100, 0, 65535), (200, False, 6, "group", None, None, 100, 443, 443), (300, False, 6, "group", None, None, 200, 443, 443)]),
        listeners=frame("host long, proto string, port long", [(6, "TCP", 5432)]),
    )


FLOWS = "flow long, s_host long, d_host long, s_ip long, d_ip long, proto long, port long"


def asked(spark, net, flows):
    h = hops(spark.createDataFrame(flows, FLOWS), net).collect()
    out = {}
    for r in sorted(h, key=lambda r: r.ord):
        out.setdefault(r.flow, {})[r.hop] = r.status
    return out


def test_ways_by_hand(spark, net):
    web = ip("8.8.8.8")
    got = asked(spark, net, [
        (1, 1, 5, None, None, 6, 80), (2, 1, 2, None, None, 6, 80), (3, 1, 3, None, None, 6, 443), (4, 1, 4, None, None, 6, 443), (5, 2, 3, None, None, 6, 443), (6, 1, None, None, web, 6, 443), (7, 2, None, None, web, 6, 443),
        (8, None, 1, web, None, 6, 443), (9, None, 2, web, None, 6, 443), (10, 3, 4, None, None, 6, 443), (11, 1, 6, None, None, 6, 443), (12, 2, None, None, ip("192.168.0.1"), 6, 443), (13, 999, 1, None, None, 6, 443), (14, None, None, web, web, 6, 443),
    ])
    assert got[1] == {"state": "blocked", "sg-out": "ok", "sg-in": "ok"}  # one subnet: neither list nor route
    assert set(got[2].values()) == {"ok"} and {"nacl-out", "route", "nacl-in", "nacl-back-out", "nacl-back-in"} <= got[2].keys() and "route-back" not in got[2]
    # Replies out of list 3 pass on some ports, so it depends on the client's.
    assert got[3]["peering"] == got[3]["sg-in"] == got[3]["route-back"] == "ok" and got[3]["nacl-back-out"] == "unknown"
    assert got[4]["peering"] == "blocked" and got[4]["route"] == "ok"  # p12 doesn't lead on to the third network
    assert got[5]["route"] == "blocked" and "peering" not in got[5]  # a blackhole
    assert set(got[6].values()) == {"ok"} and "public-ip" in got[6] and "route-back" not in got[6]
    assert got[7]["nat"] == got[7]["nat-route"] == got[7]["nat-nacl-in"] == "ok" and "public-ip" not in got[7]
    assert got[8]["public-ip"] == got[8]["igw"] == got[8]["route-back"] == "ok" and got[8]["sg-in"] == "blocked"
    assert got[9]["public-ip"] == "blocked" and got[9]["route-back"] == "blocked"  # replies would leave translated
    # Between regions a group named in a rule doesn't count.
    assert got[10]["peering"] == "ok" and got[10]["sg-in"] == "blocked" and got[10]["route-back"] == "unknown"
    assert got[11]["service"] == "blocked"
    assert got[12]["nat-route"] == "blocked"  # a private address isn't on the internet
    assert 13 not in got and 14 not in got


def test_no_flows(spark, net):
    assert asked(spark, net, []) == {}


def test_matrix_is_the_sum_of_its_pairs(spark, net):
    hosts = {r.host: r.subnet for r in net.hosts.collect()}
    vpc = {r.subnet: r.vpc for r in net.subnets.collect()}
    linked = {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (2, 3), (3, 2)}
    pairs = [(s, d) for s in hosts for d in hosts if s != d and (vpc[hosts[s]], vpc[hosts[d]]) in linked]
    flows = [(i, s, d, None, None, 6, 443) for i, (s, d) in enumerate(pairs)]
    want = {}
    for r in verdicts(hops(spark.createDataFrame(flows, FLOWS), net)).collect():
        s, d = pairs[r.flow]
        key = (vpc[hosts[s]], vpc[hosts[d]], r.verdict)
        want[key] = want.get(key, 0) + 1
    assert {(r.a, r.b, r.verdict): r.pairs for r in matrix(net, 6, 443).collect()} == want


def test_classes_do_not_grow_with_subnets(spark):
    """240 subnets of one network that differ in nothing but their number are one class, and so are hosts that are stopped."""
    net = replace(
        paths.network(spark, "/root/testdata/sf0.001"), subnets=spark.range(240).selectExpr("id AS subnet", "1L AS vpc", "4L AS tbl", "3L AS acl"),
        hosts=spark.range(720).selectExpr("id AS host", "'instance' AS kind", "id % 240 AS subnet", "167837696 + id AS ip", "CASE WHEN id % 4 = 3 THEN 'stopped' ELSE 'running' END AS state", "CAST(NULL AS STRING) AS public"),
        membership=spark.range(720).selectExpr("id AS host", "CASE WHEN id % 4 = 3 THEN id % 2 + 10 ELSE 10L END AS grp"),
    )
    found = paths.classes(net, 6, 443)
    assert found.select("src").distinct().count() == found.select("dst").distinct().count() == 2
    assert sum(x["pairs"] for x in matrix(net, 6, 443).where("a = 1 AND b = 1").collect()) == 720 * 719


def test_flows_are_dealt_out_by_their_number(spark, net, monkeypatch):
    """Parts grow with flows, not tasks with them; flows with an end outside, which have no host, don't all go to one task."""
    monkeypatch.setattr(paths, "A_TASK", 50)
    flows = spark.range(400).selectExpr("id AS flow", "CAST(NULL AS LONG) AS s_host", "1L AS d_host", "134744072 + id AS s_ip", "CAST(NULL AS LONG) AS d_ip", "6L AS proto", "443L AS port")
    written = paths.settled(flows)
    assert paths.dealt(written).rdd.getNumPartitions() == 8
    joined = paths.beside(written.repartition(1), net.hosts.hint("merge").selectExpr("host AS s_host", "kind"), "s_host")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(len(p) for p in joined.select("flow").rdd.glom().collect()) < 200
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    twice = verdicts(hops(flows.unionByName(flows), net)).collect()  # a flow asked twice has one verdict
    assert len(twice) == 400 and {(r.verdict, r.first) for r in twice} == {("blocked", "sg-in")}
