"""The way of many flows at once: every check that a packet meets, hop by hop, as rows.

A flow has a side in a network (a host) or outside (an address) at either end, a protocol and a port. Flows ask questions:
which route a table picks for an address, what an access list says to an address, protocol and ports, whether a host's
groups let a peer in. Addresses that the same blocks hold are one cell, hosts that are alike are one class, and equal
questions of classes, cells and services are asked once. Cells meet routes, entries and rules by the prefix lengths that occur
under a table, list or group, so that each join is on equal prefixes and makes matches only, never points times rules. Flows
themselves are dealt out twice, once for each end; answers come to them, by broadcast where they are few.

Statuses: ok, partial (a list lets only some of the replies in), unknown (what isn't recorded decides), blocked. Addresses
are IPv4. Icmp is a ping: type 8 there, type 0 back, as ports of protocol 1."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck, values
from ..functions.rounds import settled
from .network import BUCKET, containing

# The order in which hops are listed, ports of replies, and networks that aren't the internet.
ORDER = (
    "state", "sg-out", "nacl-out", "route", "nat-nacl-in", "nat", "nat-route", "nat-nacl-out", "public-ip", "igw", "peering", "tgw", "nacl-in", "sg-in", "service", "nacl-back-out", "route-back", "nat-nacl-back-in", "nat-nacl-back-out", "nacl-back-in",
)
REPLIES = (1024, 65535)
PRIVATE = ((0, 8), (10 << 24, 8), (0x64400000, 10), (127 << 24, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0000000, 24), (0xC0A80000, 16), (0xC6120000, 15), (224 << 24, 4), (240 << 24, 4))
#: Flows of a task. Files of flows pack well, so that tasks dealt by bytes would hold more flows the more there are.
A_TASK = 100_000
#: Rows of answers that go to every task; more of them meet the flows in a shuffle.
FEW = 200_000
STATUSES = ("ok", "partial", "unknown", "blocked")
MIDDLEBOX = ("eni", "instance", "endpoint", "local-gateway", "carrier")
CARRIES = {"HTTP": 6, "HTTPS": 6, "TCP": 6, "TLS": 6, "UDP": 17, "GENEVE": 17}


@dataclass
class Network:
    """hosts(host, kind, subnet, ip, state, public: yes, no or null) · membership(host, grp) · subnets(subnet, vpc, tbl, acl)
    · blocks(vpc, lo, len) · regions(vpc, region) · gateways(gateway, vpc) · routes(tbl, lo, len, kind, target, blackhole)
    · tables(tbl, vpc) · peerings(pcx, a, b, status) · attachments(tgw, vpc) · nats(nat, subnet, state, private)
    · entries(acl, egress, num, proto: null for all, lo: null for unrecorded, len, from_port, to_port, allow)
    · rules(grp, egress, proto, kind: cidr, group or list, lo, len, peer, from_port, to_port) · listeners(host, proto, port)."""

    hosts: DataFrame
    membership: DataFrame
    subnets: DataFrame
    blocks: DataFrame
    regions: DataFrame
    gateways: DataFrame
    routes: DataFrame
    tables: DataFrame
    peerings: DataFrame
    attachments: DataFrame
    nats: DataFrame
    entries: DataFrame
    rules: DataFrame
    listeners: DataFrame


def private(ip: Column) -> Column:
    hits = [ip.between(lo, lo + (1 << (32 - n)) - 1) for lo, n in PRIVATE]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def numbered(name: Column, names: tuple[str, ...]) -> Column:
    """A name's place among the names. Numbers are added up in place, while texts in an aggregate make it sort its rows."""
    return F.array_position(F.array(*map(F.lit, names)), name).cast("int")


def named(number: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), number - 1)


def parts(flows: DataFrame) -> int:
    return max(1, -(-flows.count() // A_TASK))


def dealt(written: DataFrame) -> DataFrame:
    """Flows that are written, by flow, in parts of about ``A_TASK``; their number is read from the files' ends."""
    return written.repartition(parts(written), "flow")


def beside(f: DataFrame, right: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Left join on a key that many flows don't have: those meet nothing, and are dealt out by flow, not all to one task."""
    spread = F.when(F.col(key).isNull(), F.xxhash64("flow")).otherwise(0)
    f = f.withColumn("spread", spread)
    f = f.repartition(n, key, "spread") if n else f
    return f.join(right.withColumn("spread", F.pmod(F.xxhash64(key), F.lit(1))), [key, "spread"], "left").drop("spread")


def kept(df: DataFrame) -> DataFrame:
    """Answers that every flow looks up: written once, and sent to all tasks where they are few."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= FEW else df


# Questions


def with_local(net: Network) -> DataFrame:
    """All routes; each table also reaches its own network's blocks, unless a route names the very block."""
    own = net.tables.join(net.blocks, "vpc").select("tbl", "lo", "len", F.lit("local").alias("kind"), F.lit("local").alias("target"), F.lit(False).alias("blackhole"))
    return net.routes.unionByName(own.join(net.routes, ["tbl", "lo", "len"], "left_anti"))


def cell_of(lo: Column, length: Column) -> Column:
    """A cell's number: the block it lies in."""
    return lo * 64 + length


def _within() -> tuple[Column, Column]:
    """The first address of a cell's block, and its length: what holds that block holds the whole cell."""
    return F.expr("shiftright(cell, 6)").alias("ip"), F.expr("CAST(cell & 63 AS INT)").alias("within")


def all_blocks(net: Network, rules: DataFrame) -> DataFrame:
    """lo, len: every block that decides, and the whole space."""
    every = net.routes.select("lo", "len")
    for df in (net.blocks, net.entries, rules.where("kind = 'cidr'")):
        every = every.unionByName(df.select("lo", "len"))
    return every.where("lo IS NOT NULL").unionByName(net.blocks.sparkSession.range(1).selectExpr("0L AS lo", "0 AS len")).distinct()


def cells(net: Network) -> DataFrame:
    """bucket, cuts: for each /16, the addresses at which another block begins to be the longest that holds what follows, with
    that block's cell. Blocks hold each other or are apart, so the longest one tells all that hold an address."""
    every = settled(all_blocks(net, net.rules))
    edges = every.select(F.explode(F.array("lo", F.expr("lo + shiftleft(1L, 32 - len)"))).alias("ip"))
    points = edges.where(F.col("ip") < 1 << 32).unionByName(every.sparkSession.range(1 << 16).select((F.col("id") * BUCKET).alias("ip"))).distinct()
    probes = points.crossJoin(F.broadcast(every.select("len").distinct())).withColumn("lo", F.expr("shiftleft(shiftright(ip, 32 - len), 32 - len)"))
    best = probes.join(every, ["lo", "len"]).groupBy("ip").agg(F.max(F.struct("len", "lo")).alias("b"))
    cut = F.struct(F.col("ip").alias("at"), cell_of(F.col("b.lo"), F.col("b.len")).alias("cell"))
    return kept(best.groupBy(F.shiftright("ip", 16).alias("bucket")).agg(F.array_sort(F.collect_list(cut)).alias("cuts")))


def celled(df: DataFrame, cut: DataFrame, ip: str, name: str) -> DataFrame:
    """Adds the cell of an address; one that is null has none."""
    at = F.element_at(F.filter("cuts", lambda x: x["at"] <= F.col(ip)), -1)["cell"]
    return df.withColumn("bucket", F.shiftright(ip, 16)).join(cut, "bucket", "left").withColumn(name, at).drop("bucket", "cuts")


def picked(questions: DataFrame, routes: DataFrame) -> DataFrame:
    """(tbl, cell) to the route with the longest prefix; no row where there is none."""
    one = routes.groupBy("tbl", "len", "lo").agg(F.max(F.struct("kind", "target", "blackhole")).alias("r"))
    held = containing(questions.select("tbl", "cell", *_within()), one, ["tbl"]).where("len <= within")
    return held.groupBy("tbl", "cell").agg(F.max(F.struct("len", "r")).alias("best")).select("tbl", "cell", "best.r.*")


def by_list(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(acl, egress, cell, proto, lo_port, hi_port) to ok, blocked, partial or unknown. The ports asked about are cut where
    entries begin and end; in each part the entry with the least number decides, and none denies."""
    keys = ["acl", "egress", "cell", "proto", "lo_port", "hi_port"]
    q = questions.select(*keys).distinct()
    fits = (F.col("e_proto").isNull() | (F.col("e_proto") == F.col("proto"))) & (F.col("from_port") <= F.col("hi_port")) & (F.col("to_port") >= F.col("lo_port"))
    e = entries.withColumnRenamed("proto", "e_proto")
    told = containing(q.select("*", *_within()), e.where("lo IS NOT NULL"), ["acl", "egress"]).where(fits).where("len <= within")
    open_ = q.join(e.where("lo IS NULL").drop("lo", "len"), ["acl", "egress"]).where(fits)
    entry = lambda verdict: F.struct("num", F.greatest("from_port", "lo_port").alias("lo"), F.least("to_port", "hi_port").alias("hi"), verdict.alias("v"))
    rows = told.select(*keys, entry(F.when(F.col("allow"), "allow").otherwise("deny")).alias("e")).unionByName(open_.select(*keys, entry(F.lit("unknown")).alias("e")))
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    cuts = F.array_distinct(F.concat(F.array("lo_port"), F.transform("es", lambda e: e["lo"]), F.filter(F.transform("es", lambda e: e["hi"] + 1), lambda p: p <= F.col("hi_port"))))
    first = lambda p: F.coalesce(F.get(F.filter("es", lambda e: (e["lo"] <= p) & (p <= e["hi"])), 0)["v"], F.lit("deny"))
    said = found.select(*keys, F.array_distinct(F.transform(cuts, first)).alias("vs"))
    has = lambda v: F.array_contains("vs", v)
    status = F.when(has("unknown"), "unknown").when(~has("deny"), "ok").when(~has("allow"), "blocked").otherwise("partial")
    answers = said.select(*keys, status.alias("status"))
    return q.join(answers, keys, "left").withColumn("status", F.coalesce("status", F.lit("blocked")))


#: What the hops of a list ask, by a name for each: whether it lets a packet of the flow out, replies in, and so on.
_WAYS = {"leave": (True, False), "enter": (False, False), "back_out": (True, True), "back_in": (False, True)}


def all_lists(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(acl, cell, proto, port) to what a list says in each of ``_WAYS``. The replies' ports are the other end's choice."""
    keys = ["acl", "cell", "proto", "port"]
    icmp = F.col("proto") == 1
    way = lambda name, egress, reply: F.struct(F.lit(name).alias("way"), F.lit(egress).alias("egress"), *((F.when(icmp, 0).otherwise(p) if reply else F.col("port")).cast("bigint").alias(n) for n, p in (("lo_port", REPLIES[0]), ("hi_port", REPLIES[1]))))
    q = questions.select(*keys, F.explode(F.array(*(way(k, *v) for k, v in _WAYS.items()))).alias("w")).select(*keys, "w.*")
    said = q.join(by_list(q, entries), ["acl", "egress", "cell", "proto", "lo_port", "hi_port"])
    return said.groupBy(*keys).agg(*(F.max(F.when(F.col("way") == k, F.col("status"))).alias(k) for k in _WAYS))


def by_blocks(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(grps, egress, cell) to the services that rules over blocks let through: told, as structs of proto, from_port, to_port and
    whether that is sure. One over a prefix list may. No row where there is none."""
    asked = questions.select("grps", "egress", "cell", *_within(), F.explode("grps").alias("grp"))
    by = lambda kind: rules.where(F.col("kind") == kind)
    rule = lambda sure: F.struct("proto", "from_port", "to_port", F.lit(sure).alias("sure")).alias("rule")
    yes = containing(asked, by("cidr"), ["grp", "egress"]).where("len <= within").select("grps", "egress", "cell", rule(True))
    listed = asked.join(by("list").drop("lo", "len"), ["grp", "egress"]).select("grps", "egress", "cell", rule(False))
    return yes.unionByName(listed).groupBy("grps", "egress", "cell").agg(F.collect_set("rule").alias("told"))


def by_names(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(s_grps, d_grps) to the services of rules that name one of the peer's groups: of the source out, of the target in. No
    row where there is none."""
    named = rules.where("kind = 'group'").select("grp", "egress", F.col("peer"), F.struct("proto", "from_port", "to_port").alias("rule"))
    pair = ["s_grps", "d_grps"]
    out = questions.withColumn("grp", F.explode("s_grps")).join(named.where("egress"), "grp").where(F.array_contains("d_grps", F.col("peer")))
    in_ = questions.withColumn("grp", F.explode("d_grps")).join(named.where("NOT egress"), "grp").where(F.array_contains("s_grps", F.col("peer")))
    rows = out.select(*pair, F.lit(True).alias("egress"), "rule").unionByName(in_.select(*pair, F.lit(False).alias("egress"), "rule"))
    return rows.groupBy(*pair).agg(*(F.collect_set(F.when(F.col("egress") == e, F.col("rule"))).alias(n) for n, e in (("named_out", True), ("named_in", False))))


def _let(grps: str, told: str, named: str) -> Column:
    """What a host's groups say. Rules unite. One that names the peer's group counts where ``refs`` is true, and may where it
    is null. A host without groups, or one whose groups aren't known, is unknown."""
    fits = lambda r: (r["proto"].isNull() | (r["proto"] == F.col("proto"))) & F.col("port").between(r["from_port"], r["to_port"])
    any_ = lambda rules, test: F.coalesce(F.exists(rules, test), F.lit(False))
    by_name = any_(named, fits)
    sure = any_(told, lambda r: r["sure"] & fits(r)) | (by_name & F.coalesce("refs", F.lit(False)))
    return F.when(F.col(grps).isNull(), "unknown").when(sure, "ok").when(any_(told, fits) | (by_name & F.col("refs").isNull()), "unknown").otherwise("blocked")


# Flows


def listening(net: Network) -> DataFrame:
    """host, at: the ports that a host listens on, with the protocols of each."""
    carried = F.create_map(*(x for k, v in CARRIES.items() for x in (F.lit(k), F.array(F.lit(v)))), F.lit("TCP_UDP"), F.array(F.lit(6), F.lit(17)))
    return net.listeners.groupBy("host").agg(F.array_sort(F.collect_set(F.struct("port", F.coalesce(F.element_at(carried, F.upper("proto")), F.array(F.lit(6))).alias("protos")))).alias("at"))


#: What hosts of one class have in common.
_ALIKE = ["kind", "stopped", "public", "vpc", "tbl", "acl", "region", "grps", "at", "cell", "hidden", "gated", "attached"]


def alike(net: Network, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, subnet, ip, cls) of each host, and what each class has in common; a class has the name of its least host."""
    places = settled(
        net.subnets.join(net.regions, "vpc", "left").join(net.gateways.select("vpc", F.lit(True).alias("gated")).distinct(), "vpc", "left")
        .join(net.attachments.select("vpc", F.lit(True).alias("attached")).distinct(), "vpc", "left")
    )
    grps = net.membership.groupBy("host").agg(F.array_sort(F.collect_set("grp")).alias("grps"))
    # A host may be known by its groups alone.
    h = net.hosts.join(places, "subnet", "left").join(grps, "host", "full").join(listening(net), "host", "left")
    stopped = F.coalesce((F.col("kind") == "instance") & ~F.col("state").isin("running", "pending"), F.lit(False))
    h = celled(h.withColumns({"stopped": stopped, "hidden": private(F.col("ip"))}), cut, "ip", "cell")
    h = settled(h.select("host", "subnet", "ip", *_ALIKE, F.to_json(F.struct(*_ALIKE)).alias("text")))
    found = kept(h.groupBy("text", *_ALIKE).agg(F.min("host").alias("cls")))
    return settled(h.select("host", "subnet", "ip", "text").join(found.select("text", "cls"), "text").drop("text")), found.drop("text")


def placed(flows: DataFrame, net: Network, ips: bool = False) -> tuple[DataFrame, DataFrame]:
    """Flows, written, with the class of each end that is a host, and the cell of each that is given as an address; and what
    the classes have in common. ``ips`` keeps the addresses."""
    cut = cells(net)
    hosts, classes = alike(net, cut)
    n = parts(flows)
    f = flows.where("(s_host IS NOT NULL OR s_ip IS NOT NULL) AND (d_host IS NOT NULL OR d_ip IS NOT NULL)")
    for p in "sd":
        f = celled(f, cut, f"{p}_ip", f"{p}_cell").withColumn(f"{p}_hidden", private(F.col(f"{p}_ip")))
    f = f if ips else f.drop("s_ip", "d_ip")
    own = ["ip"] if ips else []
    side = lambda p: hosts.select(F.col("host").alias(f"{p}_host"), F.col("subnet").alias(f"{p}_subnet"), F.col("cls").alias(f"{p}_cls"), *(F.col(c).alias(f"{p}_own") for c in own))
    f = beside(beside(f, side("s"), "s_host", n).drop("s_host"), side("d"), "d_host", n)
    if ips:
        f = f.withColumns({"s_ip": F.coalesce("s_own", "s_ip"), "d_ip": F.coalesce("d_own", "d_ip")}).drop("s_own", "d_own")
    return settled(f.withColumn("near", F.col("s_subnet") == F.col("d_subnet")).drop("d_host", "d_subnet")), classes


def classed(f: DataFrame, classes: DataFrame) -> DataFrame:
    """Flows beside what their ends' classes have, with their scenario. A host's own address goes before a given one."""
    for p in "sd":
        c = classes.select(F.col("cls").alias(f"{p}_cls"), *(F.col(x).alias(f"{p}_own_{x}" if x in ("cell", "hidden") else f"{p}_{x}") for x in _ALIKE))
        f = f.join(c, f"{p}_cls", "left")
        hidden = F.col(f"{p}_own_hidden")
        f = f.withColumns({f"{p}_cell": F.when(hidden.isNotNull(), F.col(f"{p}_own_cell")).otherwise(F.col(f"{p}_cell")), f"{p}_hidden": F.coalesce(hidden, f"{p}_hidden")}).drop(f"{p}_own_cell", f"{p}_own_hidden", f"{p}_cls")
    inside = F.col("s_vpc").isNotNull() & F.col("d_vpc").isNotNull()
    scenario = F.when(inside & F.col("near"), "subnet").when(inside & (F.col("s_vpc") == F.col("d_vpc")), "vpc").when(inside, "between").when(F.col("s_vpc").isNotNull(), "out").when(F.col("d_vpc").isNotNull(), "in")
    return f.withColumn("scenario", scenario).where("scenario IS NOT NULL AND s_hidden IS NOT NULL AND d_hidden IS NOT NULL")


def ways(questions: DataFrame, net: Network) -> DataFrame:
    """(tbl, cell) to the route that a table picks, and what stands behind its target: both ends and the state of a peering,
    whether a transit gateway is known, a translation gateway with the route on from it, and whose internet gateway it is."""
    routes = settled(with_local(net))
    q = settled(questions.where("tbl IS NOT NULL AND cell IS NOT NULL").distinct())
    kind = F.when(F.col("blackhole"), "blackhole").otherwise(F.col("kind")).alias("kind")
    w = picked(q, routes).select("tbl", "cell", kind, "target")
    peers = net.peerings.select(F.col("pcx").alias("target"), "a", "b", F.coalesce("status", F.lit("active")).alias("status"))
    transit = net.attachments.select(F.col("tgw").alias("target"), F.lit(True).alias("transit")).distinct()
    nat = net.nats.join(net.subnets, "subnet", "left").select(F.col("nat").alias("target"), F.col("subnet").alias("n_subnet"), F.col("tbl").alias("n_tbl"), F.col("acl").alias("n_acl"), F.col("state").alias("n_state"), F.col("private").alias("n_private"))
    gates = net.gateways.select(F.col("gateway").alias("target"), F.col("vpc").alias("gate"))
    for behind in (peers, transit, nat, gates):
        w = w.join(behind, "target", "left")
    w = settled(w)
    on = w.where("kind = 'nat' AND n_tbl IS NOT NULL").select(F.col("n_tbl").alias("tbl"), "cell").distinct()
    went = picked(on, routes).select(F.col("tbl").alias("n_tbl"), "cell", kind.alias("n_kind"))
    return kept(w.join(went, ["n_tbl", "cell"], "left"))


def _joins(f: str) -> Column:
    """Does the peering named by this route join the two ends' networks."""
    ends = F.array(f"{f}_a", f"{f}_b")
    return F.array_contains(ends, F.col("s_vpc")) & F.array_contains(ends, F.col("d_vpc"))


def looked_up(f: DataFrame, net: Network) -> DataFrame:
    """Flows with everything that decides on a route beside them."""
    asked = f.select(F.explode(F.array(F.struct(F.col("s_tbl").alias("tbl"), F.col("d_cell").alias("cell")), F.struct(F.col("d_tbl").alias("tbl"), F.col("s_cell").alias("cell")))).alias("q")).select("q.*")
    w = ways(asked, net)
    there = w.select(F.col("tbl").alias("s_tbl"), F.col("cell").alias("d_cell"), *(F.col(c).alias(f"there_{c}") for c in ("kind", "target", "a", "b", "status", "gate", "transit")), "n_subnet", "n_tbl", "n_acl", "n_state", "n_private", F.col("n_kind").alias("nat_kind"))
    back = w.select(F.col("tbl").alias("d_tbl"), F.col("cell").alias("s_cell"), *(F.col(c).alias(f"back_{c}") for c in ("kind", "target", "a", "b", "status", "gate")))
    return f.join(there, ["s_tbl", "d_cell"], "left").join(back, ["d_tbl", "s_cell"], "left")


def listed_beside(f: DataFrame, net: Network, wanted: tuple[str, ...]) -> DataFrame:
    """Adds what access lists say, under each hop's name."""
    apart = F.col("scenario").isin("vpc", "between")
    natted = (F.col("scenario") == "out") & (F.col("there_kind") == "nat") & F.col("n_subnet").isNotNull()
    meets = [
        # when, list, cell, and which hop has which of its answers
        (apart | (F.col("scenario") == "out"), "s_acl", "d_cell", {"nacl-out": "leave", "nacl-back-in": "back_in"}), (apart | (F.col("scenario") == "in"), "d_acl", "s_cell", {"nacl-in": "enter", "nacl-back-out": "back_out"}),
        (natted, "n_acl", "d_cell", {"nat-nacl-out": "leave", "nat-nacl-back-in": "back_in"}), (natted & (F.col("n_subnet") != F.col("s_subnet")), "n_acl", "s_cell", {"nat-nacl-in": "enter", "nat-nacl-back-out": "back_out"}),
    ]
    meets = [m for m in meets if any(h in wanted for h in m[3])]
    ask = lambda when, acl, cell: F.when(when & F.col(acl).isNotNull(), F.struct(F.col(acl).alias("acl"), F.col(cell).alias("cell"), "proto", "port"))
    asked = f.select(F.explode(F.array(*(ask(*m[:3]) for m in meets))).alias("q")).where("q IS NOT NULL").select("q.*").distinct()
    said = kept(all_lists(settled(asked), net.entries))
    for _, acl, cell, hop in meets:
        f = f.join(said.select(F.col("acl").alias(acl), F.col("cell").alias(cell), "proto", "port", *(F.coalesce(way, F.lit("blocked")).alias(h) for h, way in hop.items())), [acl, cell, "proto", "port"], "left")
    return f


def grouped_beside(f: DataFrame, net: Network) -> DataFrame:
    """Adds what both ends' groups say, as sg-out and sg-in."""
    refs = F.when(F.col("scenario").isin("subnet", "vpc"), True).when((F.col("scenario") == "between") & (F.col("there_kind") == "peering") & _joins("there") & (F.col("there_status") == "active"), F.col("s_region") == F.col("d_region"))
    end = lambda grps, egress, cell: F.struct(F.col(grps).alias("grps"), F.lit(egress).alias("egress"), F.col(cell).alias("cell"))
    asked = f.select(F.explode(F.array(end("s_grps", True, "d_cell"), end("d_grps", False, "s_cell"))).alias("q")).select("q.*").where("grps IS NOT NULL AND cell IS NOT NULL").distinct()
    told = kept(by_blocks(settled(asked), net.rules))
    named = kept(by_names(settled(f.select("s_grps", "d_grps").where("s_grps IS NOT NULL AND d_grps IS NOT NULL").distinct()), net.rules))
    f = f.withColumn("refs", refs).join(told.where("egress").select(F.col("grps").alias("s_grps"), F.col("cell").alias("d_cell"), F.col("told").alias("told_out")), ["s_grps", "d_cell"], "left")
    f = f.join(told.where("NOT egress").select(F.col("grps").alias("d_grps"), F.col("cell").alias("s_cell"), F.col("told").alias("told_in")), ["d_grps", "s_cell"], "left").join(named, ["s_grps", "d_grps"], "left")
    return f.withColumns({"sg-out": _let("s_grps", "told_out", "named_out"), "sg-in": _let("d_grps", "told_in", "named_in")})


def heard(at: str) -> Column:
    """What the target listens on: a database on its own port, a balancer on its listeners' protocols and never to a ping;
    instances aren't judged, nor are targets whose listeners aren't recorded."""
    hit = F.exists(at, lambda x: (x["port"] == F.col("port")) & F.array_contains(x["protos"], F.col("proto").cast("int")))
    return F.when((F.col("d_kind") == "lb") & (F.col("proto") == 1), "blocked").when(F.col(at).isNull() | ~F.col("d_kind").isin("lb", "rds"), None).when(hit, "ok").otherwise("blocked")


def _route_status() -> Column:
    """What the route there is worth, by scenario."""
    kind = F.col("there_kind")
    missing = F.col("s_tbl").isNull()
    beyond = F.when(kind.isNull() | (kind == "blackhole"), "blocked")
    inside = beyond.when(kind == "local", "ok").when(kind.isin(*MIDDLEBOX), "unknown").otherwise("blocked")
    between = beyond.when(kind.isin("peering", "tgw"), "ok").when(kind.isin("local", "igw", "nat", "eigw"), "blocked").otherwise("unknown")
    far = F.col("there_a").isNull()
    out = (
        beyond.when(kind == "igw", F.when(F.col("d_hidden"), "blocked").otherwise("ok")).when(kind.isin("eigw", "local"), "blocked")
        .when(kind == "nat", F.when(F.col("n_state").isNull(), "unknown").otherwise("ok")).when(kind == "peering", F.when(far, "unknown").otherwise("blocked")).otherwise("unknown")
    )
    return F.when(missing, "unknown").when(F.col("scenario") == "vpc", inside).when(F.col("scenario") == "between", between).otherwise(out)


def _peering_status() -> Column:
    ends = F.array("there_a", "there_b")
    return F.when(F.col("there_a").isNull(), "unknown").when(~F.array_contains(ends, F.col("s_vpc")) | ~F.array_contains(ends, F.col("d_vpc")), "blocked").when(F.col("there_status") != "active", "blocked").otherwise("ok")


def _transit_status() -> Column:
    """Attached, the gateway's own tables decide, which aren't recorded; attached elsewhere, a peering of gateways might."""
    return F.when(F.col("there_transit").isNull() | F.coalesce("d_attached", F.lit(False)), "unknown").otherwise("blocked")


def _back_status() -> Column:
    kind, beyond = F.col("back_kind"), F.when(F.col("d_tbl").isNull(), "unknown").when(F.col("back_kind").isNull() | (F.col("back_kind") == "blackhole"), "blocked")
    inside = beyond.when(kind == "local", "ok").when(kind.isin(*MIDDLEBOX), "unknown").otherwise("blocked")
    # Between networks: the way it came, or another active peering of the two; without a way there nothing can be told.
    way = F.col("there_kind").isin("peering", "tgw")
    same = (kind == F.col("there_kind")) & (F.col("back_target") == F.col("there_target"))
    other = F.when(F.col("back_a").isNull(), "unknown").when(_joins("back") & (F.col("back_status") == "active"), "ok").otherwise("blocked")
    between = beyond.when(~F.coalesce(way, F.lit(False)), "unknown").when(same, "ok").when(kind == "peering", other).when(kind.isin("tgw", "vgw", *MIDDLEBOX), "unknown").otherwise("blocked")
    public = beyond.when(kind == "igw", F.when(F.col("back_gate") != F.col("d_vpc"), "blocked").otherwise("ok")).when(kind.isin("eigw", "tgw", "vgw", *MIDDLEBOX), "unknown").otherwise("blocked")
    hidden = beyond.when(kind == "igw", "blocked").otherwise("unknown")
    outside = F.when(F.col("s_hidden"), hidden).otherwise(public)
    return F.when(F.col("scenario") == "vpc", inside).when(F.col("scenario") == "between", between).otherwise(outside)


def _nat_route_status() -> Column:
    kind = F.col("nat_kind")
    public = F.when(kind == "igw", "ok").when(kind.isin("nat", "local", "peering", "eigw"), "blocked").otherwise("unknown")
    hidden = F.when(kind.isin("igw", "eigw"), "blocked").otherwise("unknown")
    return F.when(F.col("n_tbl").isNull(), "unknown").when(kind.isNull() | (kind == "blackhole"), "blocked").when(F.col("d_hidden"), hidden).otherwise(public)


def met(f: DataFrame, classes: DataFrame, net: Network, wanted: tuple[str, ...] = ORDER, keep: tuple[str, ...] = ("flow",)) -> DataFrame:
    """What to keep, scenario, met: what each placed flow meets, as structs of ord, hop and status in order, of the hops wanted;
    lists, groups and listeners are asked only where one of theirs is."""
    f = looked_up(classed(f, classes), net)
    if any("nacl" in h for h in wanted):
        f = listed_beside(f, net, wanted)
    if any(h.startswith("sg") for h in wanted):
        f = grouped_beside(f, net)
    is_ = lambda *x: F.col("scenario").isin(*x)
    took = lambda *k: F.coalesce(F.col("there_kind").isin(*k), F.lit(False))
    natted = is_("out") & took("nat") & F.col("n_state").isNotNull()
    broken = (F.col("n_state") != "available") | (F.col("n_private") & ~F.col("d_hidden"))
    carried = natted & ~broken
    from_net = is_("in") & ~F.col("s_hidden")
    public = lambda p: F.when(F.col(f"{p}_public") == "yes", "ok").when(F.col(f"{p}_public") == "no", "blocked").otherwise("unknown")
    group = lambda hop: F.coalesce(hop, F.lit("unknown")) if hop in wanted else F.lit(None).cast("string")
    clients = {"nat-nacl-back-in": F.lit(True)} | dict.fromkeys(("nacl-back-in", "nacl-back-out", "nat-nacl-back-out"), F.coalesce(F.col("s_kind") == "lb", F.lit(False)))

    def listed(hop: str) -> Column:
        """Some reply ports only: gateways and balancers use them all, so some connections fail; others' choice is open."""
        said = group(hop)
        return F.when(said != "partial", said).when(clients.get(hop, F.lit(False)), "partial").otherwise("unknown")

    says = heard("d_at")
    igw_out = is_("out") & took("igw") & (_route_status() == "ok")
    stopped = F.coalesce("s_stopped", F.lit(False)) | F.coalesce("d_stopped", F.lit(False))
    rows: list[tuple[str, Column, Column]] = [
        # hop, where it is met, what it says
        ("state", stopped, F.lit("blocked")),
        ("sg-out", ~is_("in"), group("sg-out")), ("nacl-out", ~is_("in", "subnet"), listed("nacl-out")), ("route", ~is_("in", "subnet"), _route_status()),
        ("nat-nacl-in", carried & (F.col("n_subnet") != F.col("s_subnet")), listed("nat-nacl-in")), ("nat", natted, F.when(broken, "blocked").otherwise("ok")), ("nat-route", carried, _nat_route_status()),
        ("nat-nacl-out", carried, listed("nat-nacl-out")), ("public-ip", igw_out | from_net, F.when(is_("out"), public("s")).otherwise(public("d"))),
        ("igw", igw_out & (F.col("there_gate") != F.col("s_vpc")), F.lit("blocked")), ("igw", from_net, F.when(F.col("d_gated"), "ok").otherwise("blocked")),
        ("peering", is_("between") & took("peering"), _peering_status()), ("tgw", is_("between") & took("tgw"), _transit_status()),
        ("nacl-in", is_("vpc", "between", "in"), listed("nacl-in")), ("sg-in", ~is_("out"), group("sg-in")), ("service", ~is_("out") & says.isNotNull(), says),
        ("nacl-back-out", is_("vpc", "between", "in"), listed("nacl-back-out")), ("route-back", is_("between", "in") | is_("vpc") & (_back_status() != "ok"), _back_status()),
        ("nat-nacl-back-in", carried, listed("nat-nacl-back-in")), ("nat-nacl-back-out", carried & (F.col("n_subnet") != F.col("s_subnet")), listed("nat-nacl-back-out")),
        ("nacl-back-in", is_("vpc", "between", "out"), listed("nacl-back-in")),
    ]
    each = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(ORDER.index(hop)).alias("ord"), F.lit(hop).alias("hop"), F.coalesce(status, F.lit("unknown")).alias("status"))) for hop, when, status in rows if hop in wanted]
    return f.select(*keep, "scenario", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("met"))


def hops(flows: DataFrame, net: Network, wanted: tuple[str, ...] = ORDER) -> DataFrame:
    """flow, scenario, ord, hop, status: a row for each hop that a flow meets. Flows without an end in a network, or with one
    that is neither a host nor an address, have no row."""
    return met(*placed(flows, net), net, wanted).select("flow", "scenario", F.explode("met").alias("h")).select("flow", "scenario", "h.*")


#: From bad to worse.
_WORSE = ("ok", "unknown", "partial", "blocked")


def _judged(worst: Column, first: Column) -> list[Column]:
    return [F.when(worst == 1, "reachable").otherwise(named(worst, _WORSE)).alias("verdict"), named(first + 1, ORDER).alias("first")]


def verdicts(found: DataFrame) -> DataFrame:
    """flow, verdict, first: reachable only when every hop is ok; the first hop in order that blocks."""
    return found.groupBy("flow").agg(*_judged(F.max(numbered(F.col("status"), _WORSE)), F.min(F.when(F.col("status") == "blocked", F.col("ord")))))


def _worst() -> Column:
    return F.array_max(F.transform("met", lambda h: numbered(h["status"], _WORSE)))


def judged(flows: DataFrame, ways_met: DataFrame) -> DataFrame:
    """The same from what flows met, each judged on its own before those of one number meet."""
    first = F.array_min(F.transform(F.filter("met", lambda h: h["status"] == "blocked"), lambda h: h["ord"]))
    one = ways_met.where(F.size("met") > 0).select("flow", _worst().alias("worst"), first.alias("at"))
    return one.repartition(parts(flows), "flow").groupBy("flow").agg(*_judged(F.max("worst"), F.min("at")))


def fixes(flows: DataFrame, net: Network) -> DataFrame:
    """flow, hop, place, proto, from_port, to_port, source: the rule that would open the first hop that blocks, where that is
    a group or a list. A group names the peer's least group inside one network, else the peer's address; a list's rule is
    for the reply ports on the way back."""
    f, classes = placed(flows, net, ips=True)
    first = judged(f, met(f, classes, net)).where(F.col("first").contains("nacl") | F.col("first").startswith("sg")).select("flow", F.col("first").alias("hop"))
    f = classed(f, classes).select("flow", "proto", "port", "s_ip", "d_ip", "s_vpc", "d_vpc", "s_acl", "d_acl", F.get("s_grps", F.lit(0)).alias("s_grp"), F.get("d_grps", F.lit(0)).alias("d_grp")).join(first, "flow")
    hop, out = F.col("hop"), F.col("hop").isin("sg-out", "nacl-out", "nacl-back-in")
    place = F.when(hop == "sg-out", F.concat(F.lit("group "), "s_grp")).when(hop == "sg-in", F.concat(F.lit("group "), "d_grp")).when(hop.isin("nacl-out", "nacl-back-in"), F.concat(F.lit("list "), "s_acl")).when(hop.isin("nacl-in", "nacl-back-out"), F.concat(F.lit("list "), "d_acl"))
    peer = F.when(out, F.col("d_ip")).otherwise(F.col("s_ip"))
    named = F.when(hop.startswith("sg") & (F.col("s_vpc") == F.col("d_vpc")), F.when(out, F.col("d_grp")).otherwise(F.col("s_grp")))
    octets = F.concat_ws(".", *(F.shiftright(peer, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)))
    back = hop.contains("back")
    low, high = F.when(F.col("proto") == 1, 0).otherwise(REPLIES[0]), F.when(F.col("proto") == 1, 0).otherwise(REPLIES[1])
    return f.where(place.isNotNull()).select(
        "flow", "hop", place.alias("place"), "proto", F.when(back, low).otherwise(F.col("port")).cast("bigint").alias("from_port"), F.when(back, high).otherwise(F.col("port")).cast("bigint").alias("to_port"),
        F.coalesce(F.concat(F.lit("group "), named), F.concat(octets, F.lit("/32"))).alias("source"),
    )


# All pairs

#: Hops that a flow between hosts may meet.
_INSIDE = tuple(h for h in ORDER if not h.startswith("nat") and h not in ("public-ip", "igw"))


def served(net: Network, proto: int, port: int) -> tuple[DataFrame, DataFrame]:
    """host, subnet, vpc, cls, src, dst of each host that has an address: for one service, the class of hosts that are alike as
    its source, and as its target; and what the classes cls of all services have in common. Sources and targets have in common
    their network, table and list, the longest block of entries, routes and rules that fit, the rules of their groups that fit,
    and which of their groups the other end's rules name; sources also whether they are balancers, targets whether they listen.
    Hosts that nothing leaves, or nothing enters, are one class."""
    hosts, found = alike(net, cells(net))
    fit = net.rules.where((F.col("proto").isNull() | (F.col("proto") == proto)) & F.lit(port).between(F.col("from_port"), F.col("to_port")))
    cidr, group = F.col("kind") == "cidr", F.col("kind") == "group"
    told = fit.select("grp", "egress", F.struct("kind", F.when(cidr, F.col("lo")).alias("lo"), F.when(cidr, F.col("len")).alias("len"), F.when(group, F.col("peer")).alias("peer")).alias("rule")).distinct()
    named = fit.where(group).select(F.col("peer").alias("grp"), F.col("egress").alias("by_egress")).distinct()
    of = found.select("cls", F.explode("grps").alias("grp"))
    own = of.join(told, "grp", "left").groupBy("cls").agg(*(F.array_sort(F.collect_set(F.when(F.col("egress") == e, F.col("rule")))).alias(n) for n, e in (("out_rules", True), ("in_rules", False))))
    called = of.join(named, "grp").groupBy("cls").agg(*(F.array_sort(F.collect_set(F.when(F.col("by_egress") == e, F.col("grp")))).alias(n) for n, e in (("out_names", True), ("in_names", False))))
    # Blocks of rules that don't fit don't part hosts.
    k = F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k")
    wide = containing(found.select("cell").distinct().select("cell", *_within(), k), all_blocks(net, fit).withColumn("k", F.col("len")), ["k"]).where("len <= within").groupBy("cell").agg(F.max(F.struct("len", "lo")).alias("block"))
    h = found.where("hidden IS NOT NULL AND vpc IS NOT NULL").join(own, "cls", "left").join(called, "cls", "left").join(wide, "cell", "left")
    h = h.withColumns({"d_kind": F.col("kind"), "proto": F.lit(proto), "port": F.lit(port)}).withColumn("service", heard("at"))
    # A host without groups has null for its rules, which is unknown; none that fit block.
    shut = lambda rules: F.col("stopped") | F.col(rules).isNotNull() & (F.size(rules) == 0)
    kind = lambda closed, *c: F.sha2(F.to_json(F.struct("vpc", F.when(~closed, F.struct("tbl", "acl", "block", *c)).alias("open"))), 256)
    src = kind(shut("out_rules"), "out_rules", "in_names", (F.col("kind") == "lb").alias("lb"))
    dst = kind(shut("in_rules") | F.coalesce(F.col("service") == "blocked", F.lit(False)), "in_rules", "out_names", "service")
    return hosts.join(kept(h.select("cls", "vpc", src.alias("src"), dst.alias("dst"))), "cls"), found


def classes(net: Network, proto: int, port: int) -> DataFrame:
    return served(net, proto, port)[0]


def linked(net: Network) -> DataFrame:
    """a, b: networks with a way between them that is worth a look: themselves, both ends of a peering, and those on one
    transit gateway. Between others every pair is blocked or leaves what is recorded."""
    own = net.blocks.select(F.col("vpc").alias("a"), F.col("vpc").alias("b"))
    peers = net.peerings.select("a", "b").unionByName(net.peerings.select(F.col("b").alias("a"), F.col("a").alias("b")))
    on = net.attachments.select("tgw", F.col("vpc").alias("a")).join(net.attachments.select("tgw", F.col("vpc").alias("b")), "tgw").select("a", "b")
    return own.unionByName(peers).unionByName(on).distinct()


def matrix(net: Network, proto: int, port: int) -> DataFrame:
    """a, b, verdict, pairs: how many pairs of different hosts of two linked networks have each verdict for one service.
    Classes meet classes, with one flow for their pairs in one subnet and one for those in two; no pair of hosts is made."""
    c, found = served(net, proto, port)
    c = settled(c.select("subnet", "vpc", "src", "dst", F.struct("subnet", "host", "cls").alias("at")))
    side = lambda name, *on: c.groupBy("vpc", *on, name).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    named = lambda df, p, on: df.select(*on, *(F.col(x).alias(f"{p}_{x}") for x in ("n", "lo", "hi")))
    # In one subnet: pairs of its classes; a host of both meets itself, which goes.
    both = c.groupBy("subnet", "src", "dst").agg(F.count("*").alias("self"))
    near = named(side("src", "subnet"), "s", ["vpc", "subnet", "src"]).join(named(side("dst", "subnet"), "d", ["vpc", "subnet", "dst"]), ["vpc", "subnet"]).join(both, ["subnet", "src", "dst"], "left")
    unlike = lambda what: lambda x, y: F.when(F.col(f"{x}.{what}") != F.col(f"{y}.{what}"), F.struct(F.col(x).alias("s"), F.col(y).alias("d")))
    two, apart = unlike("host"), unlike("subnet")
    ends = F.coalesce(two("s_lo", "d_lo"), two("s_lo", "d_hi"), two("s_hi", "d_lo"))
    same = near.groupBy("vpc", "src", "dst").agg(F.sum(F.col("s_n") * F.col("d_n")).alias("met"), F.sum(F.col("s_n") * F.col("d_n") - F.coalesce("self", F.lit(0))).alias("pairs"), F.min(ends).alias("ends"))
    same = settled(same)
    # In two subnets: all pairs of the classes but those.
    far = linked(net).join(named(side("src").withColumnRenamed("vpc", "a"), "s", ["a", "src"]), "a").join(named(side("dst").withColumnRenamed("vpc", "b"), "d", ["b", "dst"]), "b")
    far = far.join(same.select(F.col("vpc").alias("a"), F.col("vpc").alias("b"), "src", "dst", "met"), ["a", "b", "src", "dst"], "left").withColumn("pairs", F.col("s_n") * F.col("d_n") - F.coalesce("met", F.lit(0)))
    far = far.withColumn("ends", F.coalesce(apart("s_lo", "d_lo"), apart("s_lo", "d_hi"), apart("s_hi", "d_lo"))).select("a", "b", "pairs", "ends")
    own = linked(net).where("a = b").join(same.withColumnRenamed("vpc", "a"), "a").select("a", "b", "pairs", "ends")
    pairs = own.unionByName(far).where("pairs > 0").select("a", "b", "pairs", F.lit(proto).alias("proto"), F.lit(port).cast("bigint").alias("port"), F.col("ends.s.subnet").alias("s_subnet"), (F.col("ends.s.subnet") == F.col("ends.d.subnet")).alias("near"), F.col("ends.s.cls").alias("s_cls"), F.col("ends.d.cls").alias("d_cls"))
    # Ends are hosts with an address, so none is given.
    none = {f"{p}_{c}": F.lit(None).cast(t) for p in "sd" for c, t in (("cell", "bigint"), ("hidden", "boolean"))}
    told = met(settled(pairs).withColumns(none), found, net, _INSIDE, ("a", "b", "pairs")).where(F.size("met") > 0).withColumn("worst", _worst())
    return told.groupBy("a", "b", "worst").agg(F.sum("pairs").alias("pairs")).select("a", "b", _judged(F.col("worst"), F.lit(0))[0], "pairs")


# Queries and their SQL

#: A network for each nation, subnets out of suppliers, hosts out of customers, flows out of orders.
_V = "CAST(n_nationkey AS BIGINT) AS vpc"
_AT = "167772160 + {v} * 65536"


def _each(columns: str, rows: list[tuple]) -> str:
    """Nations beside literal rows, as SQL that both engines run."""
    return f"FROM $nation, {values('x', columns, rows)}"


_SUPPLIERS = "(SELECT count(*) FROM $supplier)"
SUBNETS = "SELECT CAST(s_suppkey AS BIGINT) AS subnet, CAST(s_nationkey AS BIGINT) AS vpc, CAST(CASE WHEN s_suppkey % 17 <> 0 THEN s_nationkey * 4 + s_suppkey % 4 END AS BIGINT) AS tbl, CAST(CASE WHEN s_suppkey % 19 <> 0 THEN s_nationkey * 3 + s_suppkey % 3 END AS BIGINT) AS acl FROM $supplier"
_HOME = f"$customer JOIN $supplier ON s_suppkey = c_custkey % {_SUPPLIERS} + 1"
HOSTS = f"""SELECT CAST(c_custkey AS BIGINT) AS host, CASE s_suppkey % 5 WHEN 0 THEN 'rds' WHEN 1 THEN 'lb' ELSE 'instance' END AS kind, CAST(s_suppkey AS BIGINT) AS subnet, CAST({_AT.format(v='s_nationkey')} + (s_suppkey % 200) * 256 + c_custkey % 250 + 4 AS BIGINT) AS ip,
CASE WHEN c_custkey % 23 = 0 THEN 'stopped' ELSE 'running' END AS state, CASE s_suppkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS public FROM {_HOME}"""
MEMBERS = f"SELECT CAST(c_custkey AS BIGINT) AS host, CAST(s_nationkey * 8 + s_suppkey % 5 AS BIGINT) AS grp FROM {_HOME} WHERE s_suppkey % 11 <> 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), CAST(s_nationkey * 8 + 5 AS BIGINT) FROM {_HOME} WHERE s_suppkey % 7 = 0"
BLOCKS = f"SELECT {_V}, CAST({_AT.format(v='n_nationkey')} AS BIGINT) AS lo, 16 AS len FROM $nation"
REGIONS = f"SELECT {_V}, CASE WHEN n_nationkey % 9 <> 8 THEN 'r' || CAST(n_nationkey % 3 AS VARCHAR(9)) END AS region FROM $nation"
GATEWAYS = f"SELECT 'igw' || CAST(n_nationkey AS VARCHAR(9)) AS gateway, {_V} FROM $nation WHERE n_nationkey % 4 <> 3"
TABLES = f"SELECT CAST(n_nationkey * 4 + k AS BIGINT) AS tbl, {_V} {_each('k', [(k,) for k in range(4)])}"
#: k: table; off: the network whose block is the destination, from this one; what: target; own: the number behind it.
_PEERED = [(k, off, "peering", "pcx", own) for k in (0, 1, 2) for off, own in ((1, 0), (24, 24))] + [(0, 2, "peering", "pcx", 0), (1, 5, "blackhole", "pcx", 5), (0, 3, "tgw", "tgw", 100), (2, 3, "tgw", "tgw", 100), (2, 6, "tgw", "tgw", 100), (0, 4, "igw", "igw", 0), (1, 7, "vgw", "vgw", 0)]
_DEFAULT = [(0, "igw", "igw"), (1, "nat", "nat"), (2, "tgw", "tgw")]
ROUTES = f"""SELECT CAST(n_nationkey * 4 + k AS BIGINT) AS tbl, CAST({_AT.format(v='((n_nationkey + off) % 25)')} AS BIGINT) AS lo, 16 AS len, CASE what WHEN 'blackhole' THEN 'peering' ELSE what END AS kind, name || CAST(CASE own WHEN 100 THEN n_nationkey % 2 ELSE (n_nationkey + own) % 25 END AS VARCHAR(9)) AS target, what = 'blackhole' AS blackhole {_each('k, off, what, name, own', _PEERED)}
UNION ALL SELECT CAST(n_nationkey * 4 + k AS BIGINT), CAST(0 AS BIGINT), 0, what, name || CAST(CASE WHEN what = 'tgw' THEN n_nationkey % 2 WHEN what = 'igw' AND n_nationkey % 4 = 3 THEN (n_nationkey + 1) % 25 ELSE n_nationkey END AS VARCHAR(9)), false {_each('k, what, name', _DEFAULT)}
UNION ALL SELECT CAST(n_nationkey * 4 + 3 AS BIGINT), CAST(0 AS BIGINT), 0, CASE n_nationkey % 3 WHEN 0 THEN 'eigw' ELSE 'eni' END, 'x', false FROM $nation WHERE n_nationkey % 3 < 2
UNION ALL SELECT CAST(n_nationkey * 4 + 1 AS BIGINT), CAST({_AT.format(v='n_nationkey')} + 16384 AS BIGINT), 18, CASE n_nationkey % 2 WHEN 0 THEN 'eni' ELSE 'nat' END, 'y', false FROM $nation"""
PEERINGS = "SELECT 'pcx' || CAST(n_nationkey AS VARCHAR(9)) AS pcx, CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey + 1) % 25 AS BIGINT) AS b, CASE n_nationkey % 7 WHEN 3 THEN 'pending' WHEN 4 THEN NULL ELSE 'active' END AS status FROM $nation WHERE n_nationkey % 11 <> 10"
ATTACHMENTS = f"SELECT 'tgw0' AS tgw, {_V} FROM $nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'tgw1', CAST(n_nationkey AS BIGINT) FROM $nation WHERE n_nationkey % 3 = 0"
NATS = "SELECT 'nat' || CAST(s_nationkey AS VARCHAR(9)) AS nat, CAST(min(s_suppkey) AS BIGINT) AS subnet, CASE s_nationkey % 6 WHEN 5 THEN 'failed' ELSE 'available' END AS state, s_nationkey % 8 = 7 AS private FROM $supplier GROUP BY s_nationkey"
#: k: list; way: 1 out, 0 in; off: the network whose block is meant, else 10.0.0.0/8 (88), everything (99) or unrecorded (77).
_ENTRY_ROWS = [(0, w, 100, None, 99, 0, 65535, 1) for w in (0, 1)] + [(1, 0, 90, 6, 1, 443, 443, 0)]
_ENTRY_ROWS += [(1, w, n, p, 99, lo, hi, 1) for w in (0, 1) for n, p, lo, hi in ((100, 6, 0, 1023), (110, 6, 32768, 65535), (120, 1, 0, 255))]
_ENTRY_ROWS += [(2, w, n, p, off, lo, hi, a) for w in (0, 1) for n, p, off, lo, hi, a in ((95, 6, 24, 22, 22, 0), (100, None, 0, 0, 65535, 1), (105, 6, 77, 5000, 6000, 1), (110, 6, 88, 0, 6500, 1), (115, 17, 88, 0, 65535, 1))]
_ENTRY_ROWS += [(2, 1, 120, 6, 99, 1024, 65535, 1), (2, 0, 130, 6, 99, 443, 443, 1), (2, 1, 130, 6, 99, 443, 443, 1)]
_BLOCK = f"CAST(CASE off WHEN 99 THEN 0 WHEN 88 THEN 167772160 WHEN 77 THEN NULL ELSE {_AT.format(v='((n_nationkey + off) % 25)')} END AS BIGINT) AS lo, CASE off WHEN 99 THEN 0 WHEN 88 THEN 8 WHEN 77 THEN NULL ELSE 16 END AS len"
ENTRIES = f"SELECT CAST(n_nationkey * 3 + k AS BIGINT) AS acl, way = 1 AS egress, CAST(num AS BIGINT) AS num, CAST(proto AS BIGINT) AS proto, {_BLOCK}, CAST(lo_p AS BIGINT) AS from_port, CAST(hi_p AS BIGINT) AS to_port, ok = 1 AS allow {_each('k, way, num, proto, off, lo_p, hi_p, ok', _ENTRY_ROWS)}"
#: g: group; peer: a group's number in the network ``off`` places on.
_RULE_ROWS = [
    (0, 0, 6, "cidr", 99, None, 443, 443), (0, 1, None, "cidr", 99, None, 0, 65535), (1, 0, 6, "group", 0, 0, 0, 65535), (1, 1, 6, "cidr", 88, None, 0, 65535), (2, 0, 6, "list", 99, None, 22, 22), (2, 0, None, "cidr", 0, None, 0, 65535),
    (2, 1, 6, "group", 0, 1, 0, 65535), (2, 1, 6, "cidr", 99, None, 443, 443), (3, 0, 6, "group", 1, 0, 0, 65535), (3, 0, 6, "group", 24, 3, 0, 65535), (3, 1, None, "cidr", 99, None, 0, 65535), (4, 0, 1, "cidr", 99, None, 0, 255), (4, 0, 6, "cidr", 88, None, 5432, 5500),
    (4, 1, 6, "cidr", 99, None, 0, 1023), (5, 0, 17, "cidr", 88, None, 53, 53), (5, 1, 17, "cidr", 99, None, 53, 53), (5, 1, 6, "list", 99, None, 8080, 8080),
]
RULES = f"SELECT CAST(n_nationkey * 8 + g AS BIGINT) AS grp, way = 1 AS egress, CAST(proto AS BIGINT) AS proto, kind, {_BLOCK}, CAST((n_nationkey + off) % 25 * 8 + peer AS BIGINT) AS peer, CAST(lo_p AS BIGINT) AS from_port, CAST(hi_p AS BIGINT) AS to_port {_each('g, way, proto, kind, off, peer, lo_p, hi_p', _RULE_ROWS)}"
LISTENERS = f"SELECT CAST(c_custkey AS BIGINT) AS host, 'TCP' AS proto, CAST(5432 AS BIGINT) AS port FROM {_HOME} WHERE s_suppkey % 5 = 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'HTTPS', CAST(443 AS BIGINT) FROM {_HOME} WHERE s_suppkey % 5 = 1 AND c_custkey % 13 <> 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'TCP_UDP', CAST(53 AS BIGINT) FROM {_HOME} WHERE s_suppkey % 5 = 1 AND s_suppkey % 2 = 0 AND c_custkey % 13 <> 0"
_CUSTOMERS = "(SELECT count(*) FROM $customer)"
FLOWS = f"""SELECT CAST(o_orderkey AS BIGINT) AS flow, CAST(CASE WHEN o_orderkey % 6 <> 1 THEN o_custkey END AS BIGINT) AS s_host, CAST(CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 2 THEN (o_custkey + {_SUPPLIERS} - 1) % {_CUSTOMERS} + 1 ELSE o_orderkey * 31 % {_CUSTOMERS} + 1 END AS BIGINT) AS d_host,
CAST(CASE o_orderkey % 12 WHEN 1 THEN 134744072 + o_orderkey WHEN 7 THEN 3232235777 END AS BIGINT) AS s_ip, CAST(CASE o_orderkey % 12 WHEN 0 THEN 134744072 + o_orderkey WHEN 6 THEN {_AT.format(v='(o_orderkey % 40)')} + 9 END AS BIGINT) AS d_ip,
CAST(CASE o_orderkey % 7 WHEN 0 THEN 17 WHEN 1 THEN 1 ELSE 6 END AS BIGINT) AS proto, CAST(CASE o_orderkey % 7 WHEN 0 THEN 53 WHEN 1 THEN 8 ELSE CASE o_orderkey % 5 WHEN 0 THEN 443 WHEN 1 THEN 5432 WHEN 2 THEN 22 WHEN 3 THEN 8080 ELSE 5500 END END AS BIGINT) AS port FROM $orders"""


def network(spark, sf_dir: str) -> Network:
    return Network(*(derived(spark, sf_dir, q) for q in (HOSTS, MEMBERS, SUBNETS, BLOCKS, REGIONS, GATEWAYS, ROUTES, TABLES, PEERINGS, ATTACHMENTS, NATS, ENTRIES, RULES, LISTENERS)))


#: What each key of the inventory shows: hops, and a scenario's only.
_SHOWN = {
    "reach_path": (ORDER, "true"), "reach_peering": (("peering",), "true"), "reach_transit": (("tgw",), "true"), "reach_nat": (tuple(h for h in ORDER if h.startswith("nat")), "true"), "reach_outside": (("route",), "scenario = 'out'"), "reach_local_route": (("route", "route-back"), "scenario = 'vpc'"),
    "reach_reply_route": (("route-back",), "scenario <> 'vpc'"), "reach_public_ip": (("public-ip", "igw"), "true"), "reach_service": (("service",), "true"),
}


def _hops(wanted: tuple[str, ...], test: str) -> Callable:
    return lambda spark, sf_dir: hops(derived(spark, sf_dir, FLOWS), network(spark, sf_dir), wanted).where(test).select("flow", "hop", "status")


def _fixes(spark, sf_dir):
    return fixes(derived(spark, sf_dir, FLOWS), network(spark, sf_dir))


def _verdicts(spark, sf_dir):
    flows, net = derived(spark, sf_dir, FLOWS), network(spark, sf_dir)
    return judged(flows, met(*placed(flows, net), net))


QUERIES = {
    **{k: _hops(*shown) for k, shown in _SHOWN.items()},
    "reach_verdict": _verdicts,
    "reach_fix": _fixes,
    "reach_matrix": lambda spark, sf_dir: matrix(network(spark, sf_dir), 6, 443),
}
_TABLES_SQL = ", ".join(f"{name} AS ({duck(sql)})" for name, sql in (("hosts", HOSTS), ("members", MEMBERS), ("subnets", SUBNETS), ("blocks", BLOCKS), ("regions", REGIONS), ("gateways", GATEWAYS), ("given_routes", ROUTES), ("tables", TABLES), ("peerings", PEERINGS), ("attachments", ATTACHMENTS), ("nats", NATS), ("entries", ENTRIES), ("rules", RULES), ("listeners", LISTENERS)))
_HIDDEN = lambda c: "(" + " OR ".join(f"{c} BETWEEN {lo} AND {lo + (1 << (32 - n)) - 1}" for lo, n in PRIVATE) + ")"
_BOX = str(MIDDLEBOX)


def _best(tbl: str, ip: str) -> str:
    return f"SELECT {tbl} AS tbl, {ip} AS ip, arg_max(CASE WHEN blackhole THEN 'blackhole' ELSE kind END, len) AS kind, arg_max(target, len) AS target FROM (SELECT DISTINCT {tbl}, {ip} FROM {{src}} WHERE {tbl} IS NOT NULL) JOIN routes ON routes.tbl = {tbl} AND {ip} >= lo AND {ip} < lo + (1::BIGINT << (32 - len)) GROUP BY 1, 2"


def _sql(flows: str) -> str:
    """Hop rows of a flow table, by range joins and plain conditions."""
    said = "(SELECT status FROM acl a WHERE a.flow = f.flow AND a.hop = '{hop}')"
    out, net, nat = "scenario = 'out'", "scenario IN ('vpc', 'between')", "scenario = 'out' AND tk = 'nat'"
    lists = {
        "nacl-out": (f"{net} OR {out}", "s_acl", "true", "d_ip", 0), "nacl-in": (f"{net} OR scenario = 'in'", "d_acl", "false", "s_ip", 0), "nacl-back-out": (f"{net} OR scenario = 'in'", "d_acl", "true", "s_ip", 1), "nacl-back-in": (f"{net} OR {out}", "s_acl", "false", "d_ip", 1),
        "nat-nacl-in": (f"{nat} AND n_ok AND n_subnet <> s_subnet", "n_acl", "false", "s_ip", 0), "nat-nacl-out": (f"{nat} AND n_ok", "n_acl", "true", "d_ip", 0), "nat-nacl-back-in": (f"{nat} AND n_ok", "n_acl", "false", "d_ip", 1), "nat-nacl-back-out": (f"{nat} AND n_ok AND n_subnet <> s_subnet", "n_acl", "true", "s_ip", 1),
    }
    asked = " UNION ALL ".join(f"SELECT flow, '{hop}' AS hop, {acl} AS acl, {egress} AS egress, {ip} AS ip, proto, CASE WHEN {reply} = 0 THEN port WHEN proto = 1 THEN 0 ELSE 1024 END AS lo_port, CASE WHEN {reply} = 0 THEN port WHEN proto = 1 THEN 0 ELSE 65535 END AS hi_port, {'true' if hop == 'nat-nacl-back-in' else 'coalesce(s_kind, chr(0)) = ' + repr('lb') if reply else 'false'} AS busy FROM w WHERE {when}" for hop, (when, acl, egress, ip, reply) in lists.items())
    joins = lambda p: f"((s_vpc = {p}a AND d_vpc = {p}b) OR (s_vpc = {p}b AND d_vpc = {p}a))"
    route = f"""CASE WHEN s_tbl IS NULL THEN 'unknown' WHEN tk IS NULL OR tk = 'blackhole' THEN 'blocked'
 WHEN scenario = 'vpc' THEN CASE WHEN tk = 'local' THEN 'ok' WHEN tk IN {_BOX} THEN 'unknown' ELSE 'blocked' END
 WHEN scenario = 'between' THEN CASE WHEN tk IN ('peering', 'tgw') THEN 'ok' WHEN tk IN ('local', 'igw', 'nat', 'eigw') THEN 'blocked' ELSE 'unknown' END
 WHEN tk = 'igw' THEN CASE WHEN {_HIDDEN('d_ip')} THEN 'blocked' ELSE 'ok' END WHEN tk IN ('eigw', 'local') THEN 'blocked' WHEN tk = 'nat' THEN CASE WHEN n_state IS NULL THEN 'unknown' ELSE 'ok' END
 WHEN tk = 'peering' THEN CASE WHEN pa IS NULL THEN 'unknown' ELSE 'blocked' END ELSE 'unknown' END"""
    back = f"""CASE WHEN d_tbl IS NULL THEN 'unknown' WHEN bk IS NULL OR bk = 'blackhole' THEN 'blocked'
 WHEN scenario = 'vpc' THEN CASE WHEN bk = 'local' THEN 'ok' WHEN bk IN {_BOX} THEN 'unknown' ELSE 'blocked' END
 WHEN scenario = 'between' THEN CASE WHEN tk IS NULL OR tk NOT IN ('peering', 'tgw') THEN 'unknown' WHEN bk = tk AND bt = tt THEN 'ok' WHEN bk = 'peering' THEN CASE WHEN qa IS NULL THEN 'unknown' WHEN {joins('q')} AND qs = 'active' THEN 'ok' ELSE 'blocked' END WHEN bk IN ('tgw', 'vgw') OR bk IN {_BOX} THEN 'unknown' ELSE 'blocked' END
 WHEN {_HIDDEN('s_ip')} THEN CASE WHEN bk = 'igw' THEN 'blocked' ELSE 'unknown' END
 WHEN bk = 'igw' THEN CASE WHEN (SELECT vpc FROM gateways WHERE gateway = bt) <> d_vpc THEN 'blocked' ELSE 'ok' END WHEN bk IN ('eigw', 'tgw', 'vgw') OR bk IN {_BOX} THEN 'unknown' ELSE 'blocked' END"""
    rows = [
        ("state", "(s_kind = 'instance' AND s_state = 'stopped') OR (d_kind = 'instance' AND d_state = 'stopped')", "'blocked'"),
        ("sg-out", "scenario <> 'in'", "(SELECT status FROM sg WHERE sg.flow = f.flow AND sg.egress)"), ("sg-in", "scenario <> 'out'", "(SELECT status FROM sg WHERE sg.flow = f.flow AND NOT sg.egress)"), ("route", "scenario IN ('vpc', 'between', 'out')", route),
        ("nat", f"{nat} AND n_state IS NOT NULL", "CASE WHEN n_ok THEN 'ok' ELSE 'blocked' END"),
        ("nat-route", f"{nat} AND n_ok", f"CASE WHEN n_tbl IS NULL THEN 'unknown' WHEN nk IS NULL OR nk = 'blackhole' THEN 'blocked' WHEN {_HIDDEN('d_ip')} THEN CASE WHEN nk IN ('igw', 'eigw') THEN 'blocked' ELSE 'unknown' END WHEN nk = 'igw' THEN 'ok' WHEN nk IN ('nat', 'local', 'peering', 'eigw') THEN 'blocked' ELSE 'unknown' END"),
        ("public-ip", f"{out} AND tk = 'igw' AND ({route}) = 'ok'", "CASE s_public WHEN 'yes' THEN 'ok' WHEN 'no' THEN 'blocked' ELSE 'unknown' END"), ("public-ip", f"scenario = 'in' AND NOT {_HIDDEN('s_ip')}", "CASE d_public WHEN 'yes' THEN 'ok' WHEN 'no' THEN 'blocked' ELSE 'unknown' END"),
        ("igw", f"{out} AND tk = 'igw' AND ({route}) = 'ok' AND (SELECT vpc FROM gateways WHERE gateway = tt) <> s_vpc", "'blocked'"), ("igw", f"scenario = 'in' AND NOT {_HIDDEN('s_ip')}", "CASE WHEN d_vpc IN (SELECT vpc FROM gateways) THEN 'ok' ELSE 'blocked' END"),
        ("peering", "scenario = 'between' AND tk = 'peering'", f"CASE WHEN pa IS NULL THEN 'unknown' WHEN NOT {joins('p')} OR ps <> 'active' THEN 'blocked' ELSE 'ok' END"),
        ("tgw", "scenario = 'between' AND tk = 'tgw'", "CASE WHEN tt NOT IN (SELECT tgw FROM attachments) OR d_vpc IN (SELECT vpc FROM attachments) THEN 'unknown' ELSE 'blocked' END"),
        ("service", "scenario <> 'out' AND d_kind = 'lb' AND proto = 1", "'blocked'"),
        ("service", "scenario <> 'out' AND d_kind IN ('lb', 'rds') AND NOT (d_kind = 'lb' AND proto = 1) AND d_host IN (SELECT host FROM listeners)", "CASE WHEN EXISTS (SELECT 1 FROM listeners l WHERE l.host = f.d_host AND l.port = f.port AND (l.proto = 'TCP_UDP' AND f.proto IN (6, 17) OR l.proto <> 'TCP_UDP' AND f.proto = 6)) THEN 'ok' ELSE 'blocked' END"),
        ("route-back", f"scenario IN ('between', 'in') OR scenario = 'vpc' AND ({back}) <> 'ok'", back), *((hop, when, said.format(hop=hop)) for hop, (when, *_) in lists.items()),
    ]
    hop_rows = " UNION ALL ".join(f"SELECT flow, scenario, '{hop}' AS hop, {status} AS status FROM w f WHERE {when}" for hop, when, status in rows)
    side = lambda p: f"SELECT host AS {p}_host, kind AS {p}_kind, state AS {p}_state, public AS {p}_public, hosts.subnet AS {p}_subnet, hosts.ip AS {p}_own, subnets.vpc AS {p}_vpc, tbl AS {p}_tbl, acl AS {p}_acl, region AS {p}_region FROM hosts JOIN subnets USING (subnet) JOIN regions USING (vpc)"
    ordered = "CASE hop " + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(ORDER)) + " END"
    return f"""{_TABLES_SQL}, routes AS (SELECT * FROM given_routes UNION ALL SELECT tbl, lo, len, 'local', 'local', false FROM tables JOIN blocks USING (vpc) WHERE (tbl, lo, len) NOT IN (SELECT (tbl, lo, len) FROM given_routes)),
e AS (SELECT fl.* EXCLUDE (s_ip, d_ip), s.* EXCLUDE (s_host), d.* EXCLUDE (d_host), coalesce(s_own, fl.s_ip) AS s_ip, coalesce(d_own, fl.d_ip) AS d_ip FROM ({flows}) fl LEFT JOIN ({side('s')}) s USING (s_host) LEFT JOIN ({side('d')}) d USING (d_host)),
c AS MATERIALIZED (SELECT *, CASE WHEN s_subnet = d_subnet THEN 'subnet' WHEN s_vpc = d_vpc THEN 'vpc' WHEN s_vpc IS NOT NULL AND d_vpc IS NOT NULL THEN 'between' WHEN s_vpc IS NOT NULL THEN 'out' ELSE 'in' END AS scenario FROM e WHERE (s_vpc IS NOT NULL OR d_vpc IS NOT NULL) AND s_ip IS NOT NULL AND d_ip IS NOT NULL),
rt AS ({_best('s_tbl', 'd_ip').format(src='c')}), rb AS ({_best('d_tbl', 's_ip').format(src='c')}),
x AS MATERIALIZED (SELECT c.*, rt.kind AS tk, rt.target AS tt, rb.kind AS bk, rb.target AS bt, p.a AS pa, p.b AS pb, coalesce(p.status, 'active') AS ps, q.a AS qa, q.b AS qb, coalesce(q.status, 'active') AS qs, n.subnet AS n_subnet, n.state AS n_state, ns.tbl AS n_tbl, ns.acl AS n_acl, coalesce(n.state = 'available' AND NOT (n.private AND NOT {_HIDDEN('d_ip')}), false) AS n_ok
 FROM c LEFT JOIN rt ON rt.tbl = s_tbl AND rt.ip = d_ip LEFT JOIN rb ON rb.tbl = d_tbl AND rb.ip = s_ip LEFT JOIN peerings p ON p.pcx = rt.target LEFT JOIN peerings q ON q.pcx = rb.target LEFT JOIN nats n ON n.nat = rt.target LEFT JOIN subnets ns ON ns.subnet = n.subnet),
rn AS ({_best('n_tbl', 'd_ip').format(src="(SELECT * FROM x WHERE scenario = 'out' AND tk = 'nat')")}),
w AS MATERIALIZED (SELECT x.*, rn.kind AS nk FROM x LEFT JOIN rn ON rn.tbl = n_tbl AND rn.ip = d_ip AND scenario = 'out' AND tk = 'nat'),
asked AS MATERIALIZED ({asked}), ports AS (SELECT DISTINCT from_port AS pt FROM entries UNION SELECT to_port + 1 FROM entries),
tried AS (SELECT DISTINCT acl, egress, ip, proto, lo_port, hi_port, lo_port AS pt FROM asked UNION SELECT acl, egress, ip, proto, lo_port, hi_port, pt FROM asked JOIN ports ON pt BETWEEN lo_port AND hi_port),
fit AS (SELECT t.*, arg_min(CASE WHEN n.lo IS NULL THEN 'unknown' WHEN allow THEN 'allow' ELSE 'deny' END, num) AS v FROM tried t LEFT JOIN entries n ON n.acl = t.acl AND n.egress = t.egress AND (n.lo IS NULL OR ip >= lo AND ip < lo + (1::BIGINT << (32 - len))) AND (n.proto IS NULL OR n.proto = t.proto) AND pt BETWEEN from_port AND to_port GROUP BY ALL),
judged AS (SELECT acl, egress, ip, proto, lo_port, hi_port, bool_or(v = 'unknown') AS u, bool_or(v IS NULL OR v = 'deny') AS d, bool_or(v = 'allow') AS a FROM fit GROUP BY ALL),
acl AS MATERIALIZED (SELECT flow, hop, CASE WHEN asked.acl IS NULL OR u THEN 'unknown' WHEN NOT coalesce(d, true) THEN 'ok' WHEN NOT coalesce(a, false) THEN 'blocked' WHEN busy THEN 'partial' ELSE 'unknown' END AS status FROM asked LEFT JOIN judged j ON j.acl = asked.acl AND j.egress = asked.egress AND j.ip = asked.ip AND j.proto = asked.proto AND j.lo_port = asked.lo_port AND j.hi_port = asked.hi_port),
ends AS (SELECT flow, true AS egress, s_host AS host, d_host AS peer, d_ip AS ip, proto, port, CASE WHEN scenario IN ('subnet', 'vpc') THEN true WHEN scenario = 'between' AND tk = 'peering' AND {joins('p')} AND ps = 'active' THEN s_region = d_region END AS refs FROM w WHERE s_host IS NOT NULL UNION ALL SELECT flow, false, d_host, s_host, s_ip, proto, port, CASE WHEN scenario IN ('subnet', 'vpc') THEN true WHEN scenario = 'between' AND tk = 'peering' AND {joins('p')} AND ps = 'active' THEN s_region = d_region END FROM w WHERE d_host IS NOT NULL),
sg AS MATERIALIZED (SELECT n.flow, n.egress, CASE WHEN count(m.grp) = 0 THEN 'unknown' WHEN bool_or(r.kind = 'cidr' AND n.ip >= r.lo AND n.ip < r.lo + (1::BIGINT << (32 - r.len)) OR r.kind = 'group' AND n.refs AND pm.grp IS NOT NULL) THEN 'ok' WHEN bool_or(r.kind = 'list' OR r.kind = 'group' AND n.refs IS NULL AND pm.grp IS NOT NULL) THEN 'unknown' ELSE 'blocked' END AS status
 FROM ends n LEFT JOIN members m ON m.host = n.host LEFT JOIN rules r ON r.grp = m.grp AND r.egress = n.egress AND (r.proto IS NULL OR r.proto = n.proto) AND n.port BETWEEN r.from_port AND r.to_port LEFT JOIN members pm ON pm.host = n.peer AND pm.grp = r.peer GROUP BY n.flow, n.egress),
raw AS ({hop_rows}), h AS MATERIALIZED (SELECT flow, scenario, hop, coalesce(status, 'unknown') AS status, {ordered} AS ord FROM raw),
v AS (SELECT flow, CASE WHEN bool_or(status = 'blocked') THEN 'blocked' WHEN bool_or(status = 'partial') THEN 'partial' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'reachable' END AS verdict, arg_min(hop, ord) FILTER (status = 'blocked') AS first FROM h GROUP BY flow)"""


_ONE = f"WITH {_sql(duck(FLOWS))} "
_OCTETS = "concat_ws('.', {0} >> 24, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255) || '/32'"
_GRP = "(SELECT min(grp) FROM members WHERE host = {0})"
#: Pairs of hosts one by one: of one network, of both ends of a peering, or on one transit gateway.
_LINKED = "SELECT vpc AS a, vpc AS b FROM blocks UNION SELECT a, b FROM peerings UNION SELECT b, a FROM peerings UNION SELECT x.vpc, y.vpc FROM attachments x JOIN attachments y USING (tgw)"
_ALL = f"SELECT row_number() OVER () AS flow, k.a, k.b, s.host AS s_host, d.host AS d_host, CAST(NULL AS BIGINT) AS s_ip, CAST(NULL AS BIGINT) AS d_ip, 6 AS proto, 443 AS port FROM ({_LINKED}) k JOIN (SELECT host, vpc FROM hosts JOIN subnets USING (subnet)) s ON s.vpc = k.a JOIN (SELECT host, vpc FROM hosts JOIN subnets USING (subnet)) d ON d.vpc = k.b WHERE s.host <> d.host"
ORACLES = {
    **{k: _ONE + f"SELECT flow, hop, status FROM h WHERE {test} AND hop IN ({', '.join(map(repr, wanted))})" for k, (wanted, test) in _SHOWN.items()},
    "reach_verdict": _ONE + "SELECT flow, verdict, first FROM v",
    "reach_fix": _ONE + f"""SELECT flow, first AS hop, CASE first WHEN 'sg-out' THEN 'group ' || {_GRP.format('s_host')} WHEN 'sg-in' THEN 'group ' || {_GRP.format('d_host')} WHEN 'nacl-out' THEN 'list ' || s_acl WHEN 'nacl-back-in' THEN 'list ' || s_acl ELSE 'list ' || d_acl END AS place, proto,
CASE WHEN first NOT LIKE '%back%' THEN port WHEN proto = 1 THEN 0 ELSE 1024 END AS from_port, CASE WHEN first NOT LIKE '%back%' THEN port WHEN proto = 1 THEN 0 ELSE 65535 END AS to_port,
coalesce(CASE WHEN first IN ('sg-out', 'sg-in') AND s_vpc = d_vpc THEN 'group ' || CASE first WHEN 'sg-out' THEN {_GRP.format('d_host')} ELSE {_GRP.format('s_host')} END END, CASE WHEN first IN ('sg-out', 'nacl-out', 'nacl-back-in') THEN {_OCTETS.format('d_ip')} ELSE {_OCTETS.format('s_ip')} END) AS source
FROM v JOIN w USING (flow) WHERE first IN ('sg-out', 'sg-in', 'nacl-out', 'nacl-in', 'nacl-back-out', 'nacl-back-in')""",
    "reach_matrix": f"WITH {_sql(_ALL)} SELECT a, b, verdict, CAST(count(*) AS BIGINT) AS pairs FROM v JOIN w USING (flow) GROUP BY ALL",
}
