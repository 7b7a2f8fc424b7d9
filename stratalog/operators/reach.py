"""Groups on their own: rules by address or by the peer's group, references, ranges as blocks. Whole ways are in ``paths``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from .network import containing, in_blocks


def allowed_by_groups(pairs: DataFrame, membership: DataFrame, rules: DataFrame) -> DataFrame:
    """Does any group of the target let this peer in on this port: by address (met by aligned blocks) or by the peer's group
    (an equi join). Rules over prefix lists are unknown. Rules unite, so any allow wins and equal rules count once."""
    ports = ["from_port", "to_port"]
    of = lambda kind, *c: rules.where(F.col("kind") == kind).select("grp", *c, *ports).distinct()
    fits = F.col("port").between(*map(F.col, ports))
    hit = lambda df, v: df.where(fits).select("pair", F.lit(v).cast("boolean").alias("v"))
    want = pairs.join(membership.select(F.col("host").alias("target"), "grp"), "target").select("pair", "source", "ip", "port", "grp")
    by_ip = hit(containing(want, in_blocks(of("cidr", "lo", "hi")).distinct(), ["grp"]), True)
    peers = membership.select(F.col("host").alias("source"), F.col("grp").alias("peer"))
    by_group = hit(want.join(peers, "source").join(of("group", "peer"), ["grp", "peer"]), True)
    unknown = hit(want.join(of("list"), "grp"), None)
    hits = by_ip.unionByName(by_group).unionByName(unknown)
    any_hit = hits.groupBy("pair").agg(F.coalesce(F.bool_or("v"), F.lit(False)).alias("yes"), F.bool_or(F.col("v").isNull()).alias("maybe"))
    state = F.when(F.col("yes"), "allow").when(F.col("maybe"), "unknown").otherwise("block")
    return pairs.select("pair").join(any_hit, "pair", "left").select("pair", state.alias("state"))


def to_blocks(ranges: DataFrame) -> DataFrame:
    """Each range as the fewest aligned blocks."""
    return in_blocks(ranges.select("id", "lo", "hi")).select("id", "lo", F.col("len").cast("bigint").alias("len"))


def group_edges(rules: DataFrame) -> DataFrame:
    """Group to group references with their ports together."""
    port = F.when(F.col("from_port") == F.col("to_port"), F.col("from_port").cast("string")).otherwise(F.concat(F.col("from_port").cast("string"), F.lit("-"), F.col("to_port").cast("string")))
    return rules.where("kind = 'group' AND peer <> grp").groupBy(F.col("peer").alias("src"), F.col("grp").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set(port)), ",").alias("ports"))


HOSTS = "SELECT CAST(c_custkey AS BIGINT) AS host, CAST(c_nationkey AS BIGINT) AS grp FROM $customer UNION SELECT CAST(c_custkey AS BIGINT), CAST(c_custkey % 20 AS BIGINT) FROM $customer WHERE c_custkey % 5 = 0"
RULES = "SELECT CAST(s_suppkey AS BIGINT) AS rule, CAST(s_nationkey AS BIGINT) AS grp, CASE s_suppkey % 5 WHEN 0 THEN 'group' WHEN 1 THEN 'group' WHEN 2 THEN 'list' ELSE 'cidr' END AS kind, CAST(s_suppkey % 25 AS BIGINT) AS peer, CASE s_suppkey % 3 WHEN 0 THEN CAST(0 AS BIGINT) ELSE 167772160 + (s_suppkey % 30) * 65536 END AS lo, CASE s_suppkey % 3 WHEN 0 THEN 4294967295 ELSE 167772160 + (s_suppkey % 30 + 4) * 65536 - 1 END AS hi, CAST(s_suppkey % 4 * 100 AS BIGINT) AS from_port, CAST(s_suppkey % 4 * 100 + s_suppkey % 2 * 250 AS BIGINT) AS to_port FROM $supplier"
PAIRS = "SELECT CAST(o_orderkey AS BIGINT) AS pair, CAST(o_custkey AS BIGINT) AS source, CAST(o_orderkey % 150 AS BIGINT) AS target, 167772160 + o_orderkey * 7919 % 2621440 AS ip, CAST(o_orderkey % 5 * 100 AS BIGINT) AS port FROM $orders"
SPANS = "SELECT CAST(p_partkey AS BIGINT) AS id, 167772160 + p_partkey * 37 AS lo, 167772160 + p_partkey * 37 + p_size * 11 AS hi FROM $part"


def _groups(spark, sf_dir):
    return allowed_by_groups(derived(spark, sf_dir, PAIRS), derived(spark, sf_dir, HOSTS), derived(spark, sf_dir, RULES))


QUERIES = {
    "reach_sg": _groups,
    "cidr_to_blocks": lambda spark, sf_dir: to_blocks(derived(spark, sf_dir, SPANS)).groupBy("id").agg(F.count("*").alias("blocks"), F.sum(F.pow(F.lit(2), 32 - F.col("len")).cast("bigint")).alias("addresses"), F.min("lo").alias("lo"), F.max(F.expr("lo % cast(pow(2, 32 - len) as bigint)")).alias("misaligned")),
    "net_sg_edges": lambda spark, sf_dir: group_edges(derived(spark, sf_dir, RULES)),
}
_G = f"""WITH p AS ({duck(PAIRS)}), h AS ({duck(HOSTS)}), r AS ({duck(RULES)}), w AS (SELECT p.*, h.grp FROM p JOIN h ON h.host = p.target),
x AS (SELECT w.pair, true AS v FROM w JOIN r ON r.grp = w.grp AND kind = 'cidr' AND port BETWEEN from_port AND to_port AND ip BETWEEN lo AND hi UNION ALL SELECT w.pair, true FROM w JOIN r ON r.grp = w.grp AND kind = 'group' AND port BETWEEN from_port AND to_port JOIN h ON h.host = w.source AND h.grp = r.peer UNION ALL SELECT w.pair, NULL FROM w JOIN r ON r.grp = w.grp AND kind = 'list' AND port BETWEEN from_port AND to_port),
g AS (SELECT pair, bool_or(v) AS yes, bool_or(v IS NULL) AS maybe FROM x GROUP BY pair), s AS (SELECT p.pair, CASE WHEN yes THEN 'allow' WHEN maybe THEN 'unknown' ELSE 'block' END AS state, ip FROM p LEFT JOIN g USING (pair)) """
ORACLES = {
    "reach_sg": _G + "SELECT pair, state FROM s",
    "cidr_to_blocks": f"""WITH RECURSIVE s AS ({duck(SPANS)}), b(id, pos, hi, size) AS (SELECT id, lo, hi, (SELECT max(1::BIGINT << k) FROM range(0, 33) t(k) WHERE lo % (1::BIGINT << k) = 0 AND (1::BIGINT << k) <= hi - lo + 1) FROM s UNION ALL SELECT id, pos + size, hi, (SELECT max(1::BIGINT << k) FROM range(0, 33) t(k) WHERE (pos + size) % (1::BIGINT << k) = 0 AND (1::BIGINT << k) <= hi - (pos + size) + 1) FROM b WHERE pos + size <= hi)
SELECT id, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS addresses, min(pos) AS lo, max(pos % size) AS misaligned FROM b GROUP BY id""",
    "net_sg_edges": f"SELECT peer AS src, grp AS dst, string_agg(DISTINCT CASE WHEN from_port = to_port THEN CAST(from_port AS VARCHAR) ELSE from_port || '-' || to_port END, ',' ORDER BY CASE WHEN from_port = to_port THEN CAST(from_port AS VARCHAR) ELSE from_port || '-' || to_port END) AS ports FROM ({duck(RULES)}) WHERE kind = 'group' AND peer <> grp GROUP BY ALL",
}
