"""What runs and what it costs a month. A price that cannot be known is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck, values

HOURS = 730
# Hourly prices by kind and class; other kinds have one price, by hour or month.
HOURLY = {
    "ec2_instance": "t2.nano 0.0058 t2.micro 0.0116 t2.small 0.023 t2.medium 0.0464 t2.large 0.0928 t3.nano 0.0052 t3.micro 0.0104 t3.small 0.0208 t3.medium 0.0416 t3.large 0.0832 t3.xlarge 0.1664 t3a.nano 0.0047 t3a.micro 0.0094 t3a.small 0.0188 t3a.medium 0.0376 t3a.large 0.0752 t4g.nano 0.0042 t4g.micro 0.0084 t4g.small 0.0168 t4g.medium 0.0336 t4g.large 0.0672 m5.large 0.096 m5.xlarge 0.192 m6i.large 0.096 m6g.large 0.077 m7i.large 0.1008 m7g.large 0.0816 c5.large 0.085 c6i.large 0.085 c7g.large 0.0725 r5.large 0.126 r6i.large 0.126",
    "rds_instance": "db.t3.micro 0.017 db.t4g.micro 0.016 db.t3.small 0.034 db.t4g.small 0.032 db.t3.medium 0.068 db.t4g.medium 0.065 db.m5.large 0.171 db.m6g.large 0.152 db.r5.large 0.25 db.r6g.large 0.225",
    "elasticache": "cache.t2.micro 0.017 cache.t3.micro 0.017 cache.t4g.micro 0.016 cache.t3.small 0.034 cache.t4g.small 0.032 cache.t3.medium 0.068 cache.t4g.medium 0.065 cache.m5.large 0.156 cache.r6g.large 0.206",
    "opensearch": "t3.small.search 0.036 t3.medium.search 0.073 m6g.large.search 0.128 r6g.large.search 0.167 m5.large.search 0.142",
    "load_balancer": "application 0.0225 network 0.0225 gateway 0.0125",
}
FLAT_HOURLY = {"nat_gateway": 0.045, "elastic_ip": 0.005, "classic_elb": 0.025, "vpn_connection": 0.05, "tgw_attachment": 0.05, "eks_cluster": 0.10}
PER_UNIT_HOURLY = {"vpc_endpoint": 0.01, "network_firewall": 0.395, "cloudhsm": 1.45}
PER_GB = {"rds_snapshot": 0.095, "s3_bucket": 0.023}
MONTHLY = {"ami": 0.0, "secret": 0.40, "route53_zone": 0.50, "shield": 3000.0}
VOLUME_GB = {"gp3": 0.08, "gp2": 0.10, "io1": 0.125, "io2": 0.125, "st1": 0.045, "sc1": 0.015, "standard": 0.05}
#: Usage decides, so nothing is known: client_vpn, rds_cluster, guardduty, securityhub, config_recorder, inspector, macie, aoss, waf_acl.
UNKNOWN = "client_vpn rds_cluster guardduty securityhub config_recorder inspector macie".split()
#: The order in which kinds could go; 99 is by hand.
ORDER = {
    "guardduty": 10, "securityhub": 10, "config_recorder": 10, "inspector": 10, "macie": 10, "ec2_instance": 20, "rds_instance": 20, "elasticache": 20, "opensearch": 20, "aoss": 20, "nat_gateway": 25, "load_balancer": 25, "classic_elb": 25,
    "vpc_endpoint": 25, "vpn_connection": 25, "network_firewall": 25, "waf_acl": 25, "rds_cluster": 30, "elastic_ip": 40, "ami": 50, "ebs_volume": 60, "ebs_snapshot": 60, "rds_snapshot": 60, "kms_key": 70, "secret": 70, "private_ca": 70, "s3_bucket": 70,
    "tgw_attachment": 99, "client_vpn": 99, "eks_cluster": 99, "cloudhsm": 99, "route53_zone": 99, "shield": 99,
}
CLASSES = [(kind, c, float(p)) for kind, text in HOURLY.items() for c, p in zip(text.split()[::2], text.split()[1::2], strict=True)]


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def volume() -> Column:
    """By size, with IOPS and throughput beyond the free part."""
    base = F.coalesce(_map(VOLUME_GB)[F.col("class")], F.lit(0.10)) * F.col("size_gb")
    io = F.when(F.col("class").isin("io1", "io2"), 0.065 * F.coalesce("iops", F.lit(0)))
    gp3 = F.when(F.col("class") == "gp3", 0.005 * F.greatest(F.coalesce("iops", F.lit(3000)) - 3000, F.lit(0)) + 0.04 * F.greatest(F.coalesce("throughput", F.lit(125)) - 125, F.lit(0)))
    return base + F.coalesce(io, gp3, F.lit(0.0))


def database() -> Column:
    """Twice over two zones, with storage unless a cluster has it; stopped ones pay storage alone."""
    storage = 0.115 * F.coalesce("size_gb", F.lit(0))
    return F.when(F.col("state") == "stopped", storage).otherwise(F.col("hourly") * HOURS * F.when(F.col("multi_az"), 2).otherwise(1) + F.when(F.col("in_cluster"), 0.0).otherwise(storage))


def monthly(items: DataFrame) -> DataFrame:
    """Adds ``monthly``. The price list is a constant of some sixty rows."""
    prices = F.broadcast(items.sparkSession.createDataFrame(CLASSES, "kind string, class string, hourly double"))
    units = F.coalesce("units", F.lit(1))
    kind, price = F.col("kind"), F.col("hourly") * HOURS
    cost = (
        F.when(kind == "ec2_instance", F.when(F.col("state") == "stopped", 0.0).otherwise(price)).when(kind == "ebs_volume", volume()).when(kind == "rds_instance", database())
        .when(kind == "elasticache", price * units).when(kind == "opensearch", (price + 0.122 * F.coalesce("size_gb", F.lit(0))) * units).when(kind == "load_balancer", F.coalesce(price, F.lit(0.0225 * HOURS)))
        .when(kind == "ebs_snapshot", F.when(F.col("class") == "archive", 0.0125).otherwise(0.05) * F.col("size_gb"))
    )
    for rates, per in ((FLAT_HOURLY, F.lit(float(HOURS))), (PER_UNIT_HOURLY, units * HOURS), (PER_GB, F.col("size_gb")), (MONTHLY, F.lit(1.0))):
        cost = cost.when(kind.isin(*rates), _map(rates)[kind] * per)
    return items.join(prices, ["kind", "class"], "left").withColumn("monthly", cost).drop("hourly")


def kept(items: DataFrame, keep: list[str], tag: str | None) -> DataFrame:
    """Adds ``kept``: named by id, name or the end of an ARN on either side, or tagged."""
    end = lambda x: F.when(x.rlike("^arn:(?:[^:]*:){4}"), F.regexp_extract(x, r"([^:/]*)$", 1)).otherwise("")
    tails = [k.rsplit(":", 1)[-1].rsplit("/", 1)[-1] for k in keep if k.startswith("arn:") and k.count(":") >= 5]
    named = F.col("id").isin(*keep, *tails) | F.col("name").isin(*keep, *tails) | end(F.col("id")).isin(*keep)
    return items.withColumn("kept", F.coalesce(named, F.lit(False)) | (F.array_contains("tags", tag) if tag else F.lit(False)))


def summary(items: DataFrame) -> DataFrame:
    """By account, with what is kept left out of totals and what is unpriced counted."""
    return items.groupBy("account").agg(F.count("*").alias("items"), F.count_if("kept").alias("kept"), F.count_if(F.col("monthly").isNull()).alias("unpriced"), F.round(F.sum(F.when(~F.col("kept"), F.col("monthly"))), 2).alias("monthly"))


def teardown(items: DataFrame) -> DataFrame:
    """The order in which items could go, and what stays or goes by hand."""
    order = F.coalesce(_map(ORDER)[F.col("kind")], F.lit(99))
    fate = F.when(F.col("kept"), "kept").when(order == 99, "by hand").when((F.col("kind") == "ebs_volume") & (F.col("state") != "available"), "attached").otherwise("delete")
    return items.select("id", "kind", order.alias("rank"), fate.alias("fate"))


_KINDS = [
    ("ec2_instance", "t3.micro"), ("ec2_instance", "m5.large"), ("ec2_instance", "p9.huge"), ("ebs_volume", "gp3"), ("ebs_volume", "io2"), ("ebs_volume", "sc1"), ("rds_instance", "db.t3.small"), ("rds_instance", "db.x1.odd"), ("nat_gateway", "-"), ("elastic_ip", "-"),
    ("vpc_endpoint", "-"), ("elasticache", "cache.t3.micro"), ("opensearch", "t3.small.search"), ("load_balancer", "gateway"), ("secret", "-"), ("guardduty", "-"), ("s3_bucket", "-"), ("eks_cluster", "-"), ("ebs_snapshot", "archive"),
]
ITEMS = f"""
SELECT CAST(l.l_orderkey AS VARCHAR(20)) || '-' || CAST(l.l_linenumber AS VARCHAR(9)) || '-' || CAST(l.l_partkey AS VARCHAR(20)) || '-' || CAST(l.l_suppkey AS VARCHAR(20)) || '-' || CAST(CAST(FLOOR(l.l_extendedprice * 100 + 0.5) AS BIGINT) AS VARCHAR(20)) AS id,
  'n' || CAST(l.l_suppkey AS VARCHAR(20)) AS name, l.l_suppkey % 5 AS account, k.kind, k.class, CAST(l.l_quantity AS BIGINT) * 10 AS size_gb, CAST(l.l_quantity AS BIGINT) * 200 AS iops, CAST(l.l_quantity AS BIGINT) * 10 AS throughput,
  1 + l.l_linenumber % 3 AS units, CASE WHEN l.l_linestatus = 'O' THEN 'running' WHEN l.l_linenumber = 1 THEN 'available' ELSE 'stopped' END AS state, l.l_returnflag = 'A' AS multi_az, l.l_returnflag = 'R' AS in_cluster, l.l_linenumber = 7 AS tagged
FROM $lineitem l JOIN {values("k", "i, kind, class", [(i, *k) for i, k in enumerate(_KINDS)])} ON l.l_partkey % {len(_KINDS)} = k.i
"""
KEEP = ["n3", "arn:aws:rds:eu-west-1:111122223333:db:n7"]


def _items(spark, sf_dir):
    return derived(spark, sf_dir, ITEMS).withColumn("tags", F.when(F.col("tagged"), F.array(F.lit("keep"))).otherwise(F.array().cast("array<string>")))


def _priced(spark, sf_dir):
    return kept(monthly(_items(spark, sf_dir)), KEEP, "keep")


QUERIES = {
    "cost_monthly": lambda spark, sf_dir: monthly(_items(spark, sf_dir)).groupBy("kind", "class").agg(F.count("*").alias("items"), F.count("monthly").alias("priced"), F.round(F.sum("monthly"), 2).alias("monthly")),
    "cost_volume": lambda spark, sf_dir: _items(spark, sf_dir).where("kind = 'ebs_volume'").select("id", "class", F.round(volume(), 4).alias("monthly")),
    "cost_database": lambda spark, sf_dir: monthly(_items(spark, sf_dir)).where("kind = 'rds_instance'").select("id", "state", F.round("monthly", 4).alias("monthly")),
    "cost_keep": lambda spark, sf_dir: kept(_items(spark, sf_dir), KEEP, "keep").groupBy("name").agg(F.count_if("kept").alias("kept"), F.count("*").alias("items")),
    "cost_summary": lambda spark, sf_dir: summary(_priced(spark, sf_dir)),
    "cost_rank": lambda spark, sf_dir: _priced(spark, sf_dir).where("NOT kept").orderBy(F.desc_nulls_last("monthly"), "id").limit(100).select("id", "kind", F.round("monthly", 4).alias("monthly")),
    "cost_by_service": lambda spark, sf_dir: monthly(_items(spark, sf_dir)).groupBy("account", F.element_at(F.split("kind", "_"), 1).alias("service")).agg(F.round(F.sum("monthly"), 2).alias("spend")).where("abs(spend) >= 0.005"),
    "cost_teardown_plan": lambda spark, sf_dir: teardown(_priced(spark, sf_dir)).groupBy("rank", "kind", "fate").agg(F.count("*").alias("items")),
}
_q = lambda xs: "(" + ", ".join(repr(x) for x in xs) + ")"
_case = lambda d, per: " ".join(f"WHEN kind = '{k}' THEN {v} * {per}" for k, v in d.items())
_VOLUME = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VOLUME_GB.items()) + " ELSE 0.1 END * size_gb + CASE WHEN class IN ('io1', 'io2') THEN 0.065 * iops WHEN class = 'gp3' THEN 0.005 * greatest(iops - 3000, 0) + 0.04 * greatest(throughput - 125, 0) ELSE 0 END"
_DB = "CASE WHEN state = 'stopped' THEN 0.115 * size_gb ELSE hourly * 730 * CASE WHEN multi_az THEN 2 ELSE 1 END + CASE WHEN in_cluster THEN 0 ELSE 0.115 * size_gb END END"
_C = f"""WITH p AS (SELECT * FROM {values("p", "kind, class, hourly", CLASSES)}), i AS (SELECT * FROM ({duck(ITEMS)})), c AS (SELECT i.*, tagged OR name IN ('n3', 'n7') AS kept, CAST(CASE WHEN kind = 'ec2_instance' THEN CASE WHEN state = 'stopped' THEN 0 ELSE hourly * 730 END WHEN kind = 'ebs_volume' THEN {_VOLUME}
 WHEN kind = 'rds_instance' THEN {_DB} WHEN kind = 'elasticache' THEN hourly * 730 * units WHEN kind = 'opensearch' THEN (hourly * 730 + 0.122 * size_gb) * units WHEN kind = 'load_balancer' THEN hourly * 730 WHEN kind = 'ebs_snapshot' THEN 0.0125 * size_gb {_case(FLAT_HOURLY, 730)} {_case(PER_UNIT_HOURLY, '730 * units')} {_case(PER_GB, 'size_gb')} {_case(MONTHLY, 1)} END AS DOUBLE) AS monthly
 FROM i LEFT JOIN p USING (kind, class)) """
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDER.items()) + " ELSE 99 END"
ORACLES = {
    "cost_monthly": _C + "SELECT kind, class, count(*) AS items, count(monthly) AS priced, round(sum(monthly), 2) AS monthly FROM c GROUP BY ALL",
    "cost_volume": _C + "SELECT id, class, round(monthly, 4) AS monthly FROM c WHERE kind = 'ebs_volume'",
    "cost_database": _C + "SELECT id, state, round(monthly, 4) AS monthly FROM c WHERE kind = 'rds_instance'",
    "cost_keep": _C + "SELECT name, CAST(count_if(kept) AS BIGINT) AS kept, count(*) AS items FROM c GROUP BY ALL",
    "cost_summary": _C + "SELECT account, count(*) AS items, CAST(count_if(kept) AS BIGINT) AS kept, CAST(count_if(monthly IS NULL) AS BIGINT) AS unpriced, round(sum(monthly) FILTER (WHERE NOT kept), 2) AS monthly FROM c GROUP BY account",
    "cost_rank": _C + "SELECT id, kind, round(monthly, 4) AS monthly FROM c WHERE NOT kept ORDER BY c.monthly DESC NULLS LAST, id LIMIT 100",
    "cost_by_service": _C + "SELECT account, split_part(kind, '_', 1) AS service, round(sum(monthly), 2) AS spend FROM c GROUP BY ALL HAVING abs(round(sum(monthly), 2)) >= 0.005",
    "cost_teardown_plan": _C + f", t AS (SELECT kind, kept, state, {_RANK} AS rank FROM c) SELECT rank, kind, CASE WHEN kept THEN 'kept' WHEN rank = 99 THEN 'by hand' WHEN kind = 'ebs_volume' AND state <> 'available' THEN 'attached' ELSE 'delete' END AS fate, count(*) AS items FROM t GROUP BY ALL",
}
