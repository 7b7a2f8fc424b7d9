"""Addresses, routes and rules as interval joins. Range joins meet in /16 buckets, so that each is an equi join first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import derived, duck

BUCKET = 1 << 16
#: An interval of more buckets than this is kept whole and matched by its own, short list.
MOST_BUCKETS = 256


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a.b.c.d/n."""
    o = F.split(F.substring_index(cidr, "/", 1), r"\.")
    base = sum(((F.get(o, i).cast("bigint") * (1 << (24 - 8 * i))) for i in range(1, 4)), F.get(o, 0).cast("bigint") * (1 << 24))
    size = F.pow(F.lit(2), 32 - F.substring_index(cidr, "/", -1).cast("int")).cast("bigint")
    lo = base - F.pmod(base, size)
    return lo, lo + size - 1


def merge(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges that touch or overlap become one, per key."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") > reach + 1, 1).when(reach.isNull(), 1).otherwise(0)
    return ranges.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def _cells(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Elementary intervals of both sides per key, with how many ranges of each side cover them: a sweep, no join."""
    edge = lambda df, x, y: df.select(key, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(x).alias("da"), F.lit(y).alias("db")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-x).alias("da"), F.lit(-y).alias("db")))).alias("e")).select(key, "e.*")
    points = edge(a, 1, 0).unionByName(edge(b, 0, 1)).groupBy(key, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(key, F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b")).where("hi IS NOT NULL")


def minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return merge(_cells(a, b, key).where("a > 0 AND b = 0").select(key, "lo", "hi"), key)


def both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return merge(_cells(a, b, key).where("a > 0 AND b > 0").select(key, "lo", "hi"), key)


def in_blocks(ranges: DataFrame) -> DataFrame:
    """Each range as the fewest aligned blocks (lo, len): at each size one where the range begins, and one where it ends, that
    no block of twice the size holds. One row per block; hi goes."""
    largest = F.least(F.lit(32), F.floor(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int") + 1)
    r = ranges.where("hi >= lo").withColumn("_k", F.explode(F.sequence(F.lit(0), largest)))
    r = r.withColumns({"_a": F.expr("shiftright(lo + shiftleft(1L, _k) - 1, _k)"), "_e": F.expr("shiftright(hi + 1, _k)")}).where("_a < _e AND (_a & 1 = 1 OR _e & 1 = 1)")
    block = lambda odd, i: F.expr(f"CASE WHEN {odd} & 1 = 1 THEN shiftleft({i}, _k) END")
    cut = r.withColumns({"len": 32 - F.col("_k"), "lo": F.explode(F.array(block("_a", "_a"), block("_e", "_e - 1")))})
    return cut.where("lo IS NOT NULL").drop("hi", "_k", "_a", "_e")


def containing(points: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Points (on, ip, …) beside every block (on, lo, len, …) of the same key that holds them: one probe for each prefix
    length that the key has, then equal prefixes."""
    lengths = blocks.select(*on, "len").distinct()
    probes = points.join(lengths, on).withColumn("lo", F.expr("shiftleft(shiftright(ip, 32 - len), 32 - len)"))
    return probes.join(blocks, [*on, "len", "lo"])


def bucketed(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))))


def longest_prefix(points: DataFrame, routes: DataFrame) -> DataFrame:
    """The most specific route of each address; routes have table, lo, hi, len, target. Wide routes meet by table alone:
    a table has at most one per prefix length under 24, so that join stays small."""
    wide = (F.col("hi") - F.col("lo")) / BUCKET > MOST_BUCKETS
    inside = (F.col("ip") >= F.col("lo")) & (F.col("ip") <= F.col("hi"))
    near = points.withColumn("bucket", F.floor(F.col("ip") / BUCKET)).join(bucketed(routes.where(~wide)), ["table", "bucket"]).where(inside).drop("bucket")
    far = points.join(routes.where(wide), "table").where(inside)
    best = near.select("id", "len", "target").unionByName(far.select("id", "len", "target")).groupBy("id").agg(F.max_by("target", F.struct("len", "target")).alias("target"), F.max("len").alias("len"))
    return points.select("id").join(best, "id", "left").select("id", F.coalesce("target", F.lit("none")).alias("target"), F.coalesce("len", F.lit(-1)).alias("len"))


def first_match(points: DataFrame, entries: DataFrame) -> DataFrame:
    """The access list entry with the least number that fits decides; nothing fits: deny. Of entries that hold one block for
    the same ports only the least number can decide."""
    cut = in_blocks(entries).groupBy("acl", "len", "lo", "from_port", "to_port").agg(F.min_by("action", "rule").alias("action"), F.min("rule").alias("rule"))
    m = containing(points, cut, ["acl"]).where(F.col("port").between(F.col("from_port"), F.col("to_port")))
    hit = m.groupBy("id").agg(F.min_by("action", "rule").alias("action"), F.min("rule").alias("rule"))
    return points.select("id").join(hit, "id", "left").select("id", F.coalesce("action", F.lit("deny")).alias("action"), "rule")


def overlapping_subnets(subnets: DataFrame) -> DataFrame:
    """Pairs of one network's subnets that share an address. Of two, the one that begins later begins inside the other, so
    starts meet the aligned blocks of ranges and each pair is made once; no others are but equal starts the other way round."""
    blocks = in_blocks(subnets.select("vpc", F.col("id").alias("x_id"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), "lo", "hi"))
    starts = subnets.select("vpc", "id", F.col("lo").alias("ip"), F.col("hi").alias("y_hi"))
    hit = containing(starts, blocks, ["vpc"]).where("id <> x_id AND x_lo <= y_hi AND ip <= x_hi AND (x_lo < ip OR x_lo = ip AND x_id < id)")
    return hit.select("vpc", F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b"))


def outside(subnets: DataFrame, networks: DataFrame) -> DataFrame:
    n = networks.select("vpc", F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"))
    return subnets.join(n, "vpc").where("lo < n_lo OR hi > n_hi").select("vpc", "id")


def subnet_table(subnets: DataFrame, explicit: DataFrame, mains: DataFrame) -> DataFrame:
    """A subnet's route table: its own, else its network's main one."""
    return subnets.select("id", "vpc").join(explicit, "id", "left").join(mains, "vpc", "left").select("id", F.coalesce("table", "main").alias("table"))


#: Subnets, routes and entries out of line items: networks by integer arithmetic.
SUBNETS = "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 40 AS BIGINT) AS vpc, 167772160 + (p_partkey % 40) * 65536 + (p_partkey * 37 % 251) * 256 AS lo, 167772160 + (p_partkey % 40) * 65536 + (p_partkey * 37 % 251) * 256 + CASE WHEN p_size % 3 = 0 THEN 511 ELSE 255 END AS hi FROM $part"
POINTS = "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 25 AS BIGINT) AS tbl, 167772160 + o_orderkey * 7919 % 2621440 AS ip, CAST(o_orderkey % 1000 AS BIGINT) AS port FROM $orders"
ROUTES = "SELECT CAST(s_suppkey % 25 AS BIGINT) AS tbl, 0 AS len, CAST(0 AS BIGINT) AS lo, 4294967295 AS hi, 'igw' AS target FROM $supplier WHERE s_suppkey < 20 UNION ALL SELECT CAST(s_suppkey % 25 AS BIGINT), 16, 167772160 + (s_suppkey % 40) * 65536, 167772160 + (s_suppkey % 40) * 65536 + 65535, 'pcx' || CAST(s_suppkey % 7 AS VARCHAR(9)) FROM $supplier UNION ALL SELECT CAST(s_suppkey % 25 AS BIGINT), 20, 167772160 + (s_suppkey % 40) * 65536 + 4096, 167772160 + (s_suppkey % 40) * 65536 + 8191, 'nat' || CAST(s_suppkey % 5 AS VARCHAR(9)) FROM $supplier"
ENTRIES = "SELECT CAST(s_suppkey % 25 AS BIGINT) AS tbl, CAST(100 + s_suppkey AS BIGINT) AS rule, CASE WHEN s_suppkey % 3 = 0 THEN 'deny' ELSE 'allow' END AS action, 167772160 + (s_suppkey % 40) * 65536 AS lo, 167772160 + (s_suppkey % 40 + 8) * 65536 - 1 AS hi, CAST(s_suppkey % 5 * 100 AS BIGINT) AS from_port, CAST(s_suppkey % 5 * 100 + 400 AS BIGINT) AS to_port FROM $supplier"


def _get(spark, sf_dir, sql, to=None):
    df = derived(spark, sf_dir, sql)
    return df.withColumnRenamed("tbl", to) if to else df


QUERIES = {
    "cidr_merge": lambda spark, sf_dir: merge(_get(spark, sf_dir, SUBNETS), "vpc"),
    "cidr_minus": lambda spark, sf_dir: minus(_get(spark, sf_dir, SUBNETS).where("id % 2 = 0"), _get(spark, sf_dir, SUBNETS).where("id % 6 < 2"), "vpc"),
    "cidr_and": lambda spark, sf_dir: both(_get(spark, sf_dir, SUBNETS).where("id % 80 < 40"), _get(spark, sf_dir, SUBNETS).where("id % 80 >= 40"), "vpc"),
    "cidr_plan_check": lambda spark, sf_dir: overlapping_subnets(_get(spark, sf_dir, SUBNETS)),
    "reach_route": lambda spark, sf_dir: longest_prefix(_get(spark, sf_dir, POINTS, "table"), _get(spark, sf_dir, ROUTES, "table").distinct()),
    "reach_nacl": lambda spark, sf_dir: first_match(_get(spark, sf_dir, POINTS, "acl"), _get(spark, sf_dir, ENTRIES, "acl")),
    "reach_acl_of_subnet": lambda spark, sf_dir: subnet_table(_get(spark, sf_dir, SUBNETS), _get(spark, sf_dir, SUBNETS).where("id % 3 = 0").select("id", (F.col("id") % 25).alias("table")), _get(spark, sf_dir, SUBNETS).select("vpc", (F.col("vpc") + 100).alias("main")).distinct()),
    "net_public_subnets": lambda spark, sf_dir: _get(spark, sf_dir, SUBNETS).select("id", (F.col("id") % 25).alias("table")).join(_get(spark, sf_dir, ROUTES, "table").where("len = 0 AND target = 'igw'").select("table").distinct(), "table", "left_semi").select("id"),
}
_best = "SELECT p.id, max(len) AS len FROM p JOIN r ON p.tbl = r.tbl AND p.ip BETWEEN r.lo AND r.hi GROUP BY p.id"
_sweep = "e AS (SELECT vpc, lo AS pt, {a} AS da, {b} AS db FROM s UNION ALL SELECT vpc, hi + 1, -{a}, -{b} FROM s), q AS (SELECT vpc, pt, sum(da) AS da, sum(db) AS db FROM e GROUP BY ALL), c AS (SELECT vpc, pt AS lo, lead(pt) OVER w - 1 AS hi, sum(da) OVER w AS a, sum(db) OVER w AS b FROM q WINDOW w AS (PARTITION BY vpc ORDER BY pt)), s2 AS (SELECT vpc, lo, hi FROM c WHERE hi IS NOT NULL AND {test}), "
_merge = "m AS (SELECT vpc, lo, hi, max(hi) OVER (PARTITION BY vpc ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {src}), g AS (SELECT vpc, lo, hi, sum(CASE WHEN r IS NULL OR lo > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vpc ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT vpc, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY vpc, g"
_S = f"WITH s AS ({duck(SUBNETS)}), "
ORACLES = {
    "cidr_merge": _S + _merge.format(src="s"),
    "cidr_minus": _S + _sweep.format(a="CAST(id % 2 = 0 AS INT)", b="CAST(id % 6 < 2 AS INT)", test="a > 0 AND b = 0") + _merge.format(src="s2"),
    "cidr_and": _S + _sweep.format(a="CAST(id % 80 < 40 AS INT)", b="CAST(id % 80 >= 40 AS INT)", test="a > 0 AND b > 0") + _merge.format(src="s2"),
    "cidr_plan_check": f"WITH s AS ({duck(SUBNETS)}) SELECT x.vpc, x.id AS a, y.id AS b FROM s x JOIN s y ON x.vpc = y.vpc AND x.id < y.id AND x.lo <= y.hi AND y.lo <= x.hi",
    "reach_route": f"WITH p AS ({duck(POINTS)}), r AS (SELECT DISTINCT * FROM ({duck(ROUTES)})), b AS ({_best}) SELECT p.id, coalesce(max(r.target), 'none') AS target, coalesce(any_value(b.len), -1) AS len FROM p LEFT JOIN b ON p.id = b.id LEFT JOIN r ON p.tbl = r.tbl AND r.len = b.len AND p.ip BETWEEN r.lo AND r.hi GROUP BY p.id",
    "reach_nacl": f"WITH p AS ({duck(POINTS)}), e AS ({duck(ENTRIES)}), h AS (SELECT p.id, arg_min(action, rule) AS action, min(rule) AS rule FROM p JOIN e ON p.tbl = e.tbl AND ip BETWEEN lo AND hi AND port BETWEEN from_port AND to_port GROUP BY p.id) SELECT p.id, coalesce(h.action, 'deny') AS action, h.rule FROM p LEFT JOIN h ON p.id = h.id",
    "reach_acl_of_subnet": f"WITH s AS ({duck(SUBNETS)}) SELECT id, CASE WHEN id % 3 = 0 THEN id % 25 ELSE vpc + 100 END AS \"table\" FROM s",
    "net_public_subnets": f"WITH s AS ({duck(SUBNETS)}), r AS ({duck(ROUTES)}) SELECT id FROM s WHERE id % 25 IN (SELECT tbl FROM r WHERE len = 0 AND target = 'igw')",
}
