"""Single-table checks of an inventory, rules taken apart and compared, matching keys, guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from . import org
from .redact import Options, redact


def instance_metadata(instances: DataFrame) -> DataFrame:
    """Instances that answer without a token; worse with a public address."""
    open_ = (F.col("imds_endpoint") != "disabled") & (F.coalesce("imds_tokens", F.lit("optional")) != "required")
    return instances.where(open_).select("id", F.when(F.col("public_ip").isNotNull(), "high").otherwise("medium").alias("severity"))


def instance_flags(instances: DataFrame, open_groups: DataFrame) -> DataFrame:
    """Instances with a public address in a group that is open to everyone."""
    return instances.where("public_ip IS NOT NULL").join(open_groups.select("grp").distinct(), "grp", "left_semi").select("id")


def unencrypted(volumes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Unencrypted volumes per account, and whether encryption by default is off."""
    v = volumes.groupBy("account").agg(F.count_if(~F.col("encrypted")).alias("plain"), F.count("*").alias("volumes"))
    return v.join(accounts, "account", "left").select("account", "plain", "volumes", (~F.coalesce("by_default", F.lit(False))).alias("default_off"))


def database_risks(databases: DataFrame) -> DataFrame:
    rows = [(F.col("public"), "high", "Public endpoint"), (~F.col("encrypted"), "medium", "Not encrypted"), (F.array_contains("shared", "all"), "critical", "Public snapshot")]
    each = F.filter(F.array(*(F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(x).alias("risk"))) for t, s, x in rows)), lambda x: x.isNotNull())
    return databases.select("id", F.explode(each).alias("r")).select("id", "r.*")


def trail_gaps(trails: DataFrame) -> DataFrame:
    """Accounts without a trail that logs every region; trails that don't validate their files."""
    good = F.col("multi_region") & F.col("logging")
    return trails.groupBy("account").agg((~F.bool_or(good)).alias("no_trail"), F.count_if(~F.col("validates")).alias("unvalidated"))


def shared_images(images: DataFrame) -> DataFrame:
    return images.where(F.array_contains("shared", "all")).groupBy("account").agg(F.count("*").alias("public_images"))


def match_key(family: Column, id_: Column) -> Column:
    """An id in the form that both sides have: queues by account and name, keys by their id."""
    return F.when(family == "queue", F.regexp_extract(id_, r"([^/]+/[^/]+)$", 1)).when(family == "key", F.regexp_extract(id_, r"([^/:]+)$", 1)).otherwise(id_)


_PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp", "58": "icmpv6", "all": "-1"}


def rule_atoms(rules: DataFrame) -> DataFrame:
    """One row per source of a rule; protocols have one name, and ports go where they mean nothing."""
    proto = F.coalesce(F.create_map(*(F.lit(x) for kv in _PROTOCOLS.items() for x in kv))[F.lower("protocol")], F.lower("protocol"))
    each = F.concat(F.transform("cidrs", lambda c: F.struct(F.lit("cidr").alias("kind"), c.alias("source"))), F.transform("groups", lambda g: F.struct(F.lit("group").alias("kind"), g.alias("source"))))
    r = rules.withColumn("proto", proto).select("grp", "proto", "from_port", "to_port", F.explode(each).alias("s"))
    port = lambda c: F.when(F.col("proto") != "-1", F.col(c))
    return r.select("grp", "proto", port("from_port").alias("from_port"), port("to_port").alias("to_port"), "s.kind", "s.source").distinct()


def rule_changes(declared: DataFrame, live: DataFrame) -> DataFrame:
    """Atoms that only one side has."""
    return declared.exceptAll(live).withColumn("change", F.lit("missing")).unionByName(live.exceptAll(declared).withColumn("change", F.lit("extra")))


def outputs(rows: DataFrame) -> DataFrame:
    """Output changes that look secret and aren't marked so."""
    return rows.where((F.col("before") != F.col("after")) & ~F.col("sensitive") & F.col("name").rlike("(?i)(password|secret|token|key)")).select("name")


def guardrails(accounts: DataFrame, budgets: DataFrame, monitors: DataFrame) -> DataFrame:
    n = lambda df, c: df.groupBy("account").agg(F.count("*").alias(c))
    return accounts.join(n(budgets, "budgets"), "account", "left").join(n(monitors, "monitors"), "account", "left").select("account", F.coalesce("budgets", F.lit(0)).alias("budgets"), F.coalesce("monitors", F.lit(0)).alias("monitors"))


def control_summary(effective: DataFrame, stmts: DataFrame) -> DataFrame:
    """Per node how many denies and limits of what is allowed reach it."""
    s = stmts.withColumn("limit", (F.col("effect") == "Allow") & (F.col("pattern") != "*"))
    return effective.join(s, "policy").groupBy("id").agg(F.count_if(F.col("effect") == "Deny").alias("denies"), F.count_if("limit").alias("limits"))


ASSETS = "SELECT CAST(p_partkey AS BIGINT) AS k, 'i' || CAST(p_partkey AS VARCHAR(20)) AS id, CAST(p_partkey % 12 AS BIGINT) AS account, CAST(p_partkey % 17 AS BIGINT) AS grp, CASE WHEN p_size % 3 = 0 THEN '1.2.3.4' END AS public_ip, CASE WHEN p_size % 5 = 0 THEN 'disabled' ELSE 'enabled' END AS imds_endpoint, CASE WHEN p_size % 4 = 0 THEN 'required' WHEN p_size % 4 = 1 THEN 'optional' END AS imds_tokens, p_size % 7 <> 0 AS encrypted, p_size % 11 = 0 AS public, CASE WHEN p_size % 13 = 0 THEN 'me,all' ELSE 'me' END AS shared_text, p_size % 2 = 0 AS multi_region, p_size % 3 <> 1 AS logging, p_size > 9 AS validates FROM $part"
_ATOMS = "SELECT CAST(s_suppkey % 9 AS BIGINT) AS grp, CASE s_suppkey % 4 WHEN 0 THEN '6' WHEN 1 THEN 'TCP' WHEN 2 THEN 'all' ELSE 'udp' END AS protocol, CAST(s_suppkey % 5 AS INT) AS from_port, CAST(s_suppkey % 5 + 1 AS INT) AS to_port, '10.' || CAST(s_suppkey % 6 AS VARCHAR(9)) || '.0.0/16' AS cidr, 'sg-' || CAST(s_suppkey % 3 AS VARCHAR(9)) AS peer, s_suppkey AS k FROM $supplier"


def _assets(f):
    return lambda spark, sf_dir: f(derived(spark, sf_dir, ASSETS).withColumn("shared", F.split("shared_text", ",")))


def _atoms(spark, sf_dir, test):
    r = derived(spark, sf_dir, _ATOMS).where(test)
    return rule_atoms(r.select("grp", "protocol", "from_port", "to_port", F.array("cidr").alias("cidrs"), F.array("peer").alias("groups")))


QUERIES = {
    "expo_imds": _assets(instance_metadata),
    "net_instance_flags": _assets(lambda a: instance_flags(a, a.where("k % 50 = 1"))),
    "expo_encryption": _assets(lambda a: unencrypted(a, a.where("k < 8").select("account", (F.col("k") % 2 == 0).alias("by_default")))),
    "expo_databases": _assets(database_risks),
    "expo_trail": _assets(trail_gaps),
    "expo_public_images": _assets(shared_images),
    "cost_guardrails": _assets(lambda a: guardrails(a.select("account").distinct(), a.where("k % 30 = 1"), a.where("k % 70 = 3"))),
    "drift_match_key": _assets(lambda a: a.select("id", match_key(F.when(F.col("k") % 3 == 0, "queue").when(F.col("k") % 3 == 1, "key").otherwise("other"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://sqs/acc/"), "id")).when(F.col("k") % 3 == 1, F.concat(F.lit("arn:aws:kms:r:1:key/"), "id")).otherwise(F.col("id"))).alias("key"))),
    "drift_rule_atoms": lambda spark, sf_dir: _atoms(spark, sf_dir, "true"),
    "drift_rules": lambda spark, sf_dir: rule_changes(_atoms(spark, sf_dir, "k % 7 <> 0"), _atoms(spark, sf_dir, "k % 11 <> 0")),
    "plan_outputs": lambda spark, sf_dir: outputs(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "db_Password_").otherwise("size_"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_custkey") % 2).alias("before"), (F.col("o_custkey") % 3).alias("after"), (F.col("o_orderkey") % 4 == 0).alias("sensitive"))),
    "scp_summary": lambda spark, sf_dir: control_summary(org.effective(org._p(spark, sf_dir), derived(spark, sf_dir, org.ATTACHED)), derived(spark, sf_dir, org.STATEMENTS)),
    "redact_always": lambda spark, sf_dir: redact(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat("c_name", F.lit(" buys "), "c_mktsegment").alias("text")), options=Options(enabled=(), always=("Building", "machinery"))).select("c_custkey", "redacted"),
}
_A = f"WITH a AS ({duck(ASSETS)}) "
_AT = f"WITH r AS (SELECT *, CASE lower(protocol) WHEN '6' THEN 'tcp' WHEN 'all' THEN '-1' ELSE lower(protocol) END AS proto FROM ({duck(_ATOMS)})), t AS (SELECT grp, proto, CASE WHEN proto <> '-1' THEN from_port END AS from_port, CASE WHEN proto <> '-1' THEN to_port END AS to_port, 'cidr' AS kind, cidr AS source, k FROM r UNION ALL SELECT grp, proto, CASE WHEN proto <> '-1' THEN from_port END, CASE WHEN proto <> '-1' THEN to_port END, 'group', peer, k FROM r) "
_six = "grp, proto, from_port, to_port, kind, source"
ORACLES = {
    "expo_imds": _A + "SELECT id, CASE WHEN public_ip IS NOT NULL THEN 'high' ELSE 'medium' END AS severity FROM a WHERE imds_endpoint <> 'disabled' AND coalesce(imds_tokens, 'optional') <> 'required'",
    "net_instance_flags": _A + "SELECT id FROM a WHERE public_ip IS NOT NULL AND grp IN (SELECT grp FROM a WHERE k % 50 = 1)",
    "expo_encryption": _A + "SELECT account, count(*) FILTER (WHERE NOT encrypted) AS plain, count(*) AS volumes, NOT (account < 8 AND account % 2 = 0) AS default_off FROM a GROUP BY account",
    "expo_databases": _A + "SELECT id, 'high' AS severity, 'Public endpoint' AS risk FROM a WHERE public UNION ALL SELECT id, 'medium', 'Not encrypted' FROM a WHERE NOT encrypted UNION ALL SELECT id, 'critical', 'Public snapshot' FROM a WHERE shared_text = 'me,all'",
    "expo_trail": _A + "SELECT account, NOT bool_or(multi_region AND logging) AS no_trail, count(*) FILTER (WHERE NOT validates) AS unvalidated FROM a GROUP BY account",
    "expo_public_images": _A + "SELECT account, count(*) AS public_images FROM a WHERE shared_text = 'me,all' GROUP BY account",
    "cost_guardrails": _A + "SELECT account, count(*) FILTER (WHERE k % 30 = 1) AS budgets, count(*) FILTER (WHERE k % 70 = 3) AS monitors FROM a GROUP BY account",
    "drift_match_key": _A + "SELECT id, CASE WHEN k % 3 = 0 THEN 'acc/' || id ELSE id END AS key FROM a",
    "drift_rule_atoms": _AT + f"SELECT DISTINCT {_six} FROM t",
    "drift_rules": _AT + f", d AS (SELECT DISTINCT {_six} FROM t WHERE k % 7 <> 0), l AS (SELECT DISTINCT {_six} FROM t WHERE k % 11 <> 0) SELECT *, 'missing' AS change FROM (SELECT * FROM d EXCEPT SELECT * FROM l) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM l EXCEPT SELECT * FROM d)",
    "plan_outputs": "SELECT 'db_Password_' || o_orderkey AS name FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 <> o_custkey % 3 AND o_orderkey % 4 <> 0",
    "scp_summary": org._O + "SELECT p.id, count(*) FILTER (WHERE effect = 'Deny') AS denies, count(*) FILTER (WHERE effect = 'Allow' AND pattern <> '*') AS limits FROM p JOIN a USING (node) JOIN s USING (policy) GROUP BY p.id",
    "redact_always": r"SELECT c_custkey, regexp_replace(c_name || ' buys ' || c_mktsegment, '(?i)\b(building|machinery)\b', '[REDACTED]', 'g') AS redacted FROM customer",
}
