"""Organisation controls: paths through the tree, the policies in force, and verdicts with three values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from ..functions.rounds import settled
from .policy import glob


def all_of(v: Column) -> Column:
    """Kleene AND over rows: false wins, then unknown; no row is true."""
    return F.when(F.coalesce(F.bool_or(~v), F.lit(False)), False).when(F.bool_or(v.isNull()), None).otherwise(True)


def any_of(v: Column) -> Column:
    """Kleene OR over rows: true wins, then unknown; no row is false."""
    return F.when(F.coalesce(F.bool_or(v), F.lit(False)), True).when(F.bool_or(v.isNull()), None).otherwise(False)


def paths(nodes: DataFrame) -> DataFrame:
    """(id, node, depth): each node with all above it and itself; the root's depth is 0. Paths are doubled each round, so
    a tree of any depth takes a logarithm of rounds. The depth is null where no root is above, as in a loop."""
    above = settled(nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("node"), F.lit(1).alias("steps")))
    last = -1
    while last != (last := above.count()):
        a, b = above.alias("a"), above.alias("b")
        twice = a.join(b, F.col("a.node") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.node").alias("node"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        above = settled(above.unionByName(twice).groupBy("id", "node").agg(F.min("steps").alias("steps")))
    up = nodes.select("id", F.col("id").alias("node"), F.lit(0).alias("steps")).unionByName(above).groupBy("id", "node").agg(F.min("steps").alias("steps"))
    roots = up.select("node").distinct().join(nodes.where("parent IS NOT NULL").select(F.col("id").alias("node")), "node", "left_anti").withColumn("root", F.lit(True))
    most = up.join(roots, "node").groupBy("id").agg(F.max("steps").alias("most"))
    return up.join(most, "id", "left").select("id", "node", (F.col("most") - F.col("steps")).alias("depth"))


def effective(path: DataFrame, attachments: DataFrame) -> DataFrame:
    """Every policy that applies at a node, attached there or inherited."""
    return path.join(attachments, "node").select("id", "node", "depth", "policy", (F.col("id") == F.col("node")).alias("attached"))


def verdicts(requests: DataFrame, path: DataFrame, attachments: DataFrame, statements: DataFrame) -> DataFrame:
    """Per account and action: allowed only if every level allows and none denies; unknown conditions stay unknown. A level
    that nothing is attached to allows nothing; an account outside the tree, or under no root, depends.
    Requests are reduced to distinct (account, action) first; levels meet statements by policy."""
    asked = requests.select("id", "action").distinct()
    rules = attachments.join(statements, "policy").select("node", "effect", "pattern", "conditional")
    level = asked.join(path, "id", "left").join(rules, "node", "left")
    fits = F.rlike(F.lower("action"), glob(F.col("pattern")))
    match = F.when(~fits, False).otherwise(F.when(F.col("conditional"), F.lit(None).cast("boolean")).otherwise(True))
    says = lambda effect: any_of(F.when(F.col("effect") == effect, match).otherwise(False))
    per = level.groupBy("id", "action", "node", "depth").agg(says("Allow").alias("allow"), says("Deny").alias("deny"))
    stops = F.min_by("node", F.when(~F.col("allow") | F.col("deny"), F.col("depth")))
    out = per.groupBy("id", "action").agg(
        all_of(F.col("allow")).alias("allowed"), any_of(F.col("deny")).alias("denied"), stops.alias("blocked_by"), F.bool_and(F.col("node").isNotNull() & F.col("depth").isNotNull()).alias("placed")
    )
    verdict = F.when(~F.col("placed"), "depends").when(F.col("denied") | ~F.col("allowed"), "denied").when(F.col("allowed") & ~F.col("denied"), "allowed").otherwise("depends")
    return out.select("id", "action", verdict.alias("verdict"), F.when(verdict == "denied", F.col("blocked_by")).alias("blocked_by"))


NODES = "SELECT 'root' AS id, CAST(NULL AS VARCHAR(40)) AS parent, 'root' AS kind FROM $region WHERE r_regionkey = 0 UNION ALL SELECT 'ou' || CAST(r_regionkey AS VARCHAR(9)), 'root', 'ou' FROM $region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(9)), 'ou' || CAST(n_regionkey AS VARCHAR(9)), 'ou' FROM $nation UNION ALL SELECT 'a' || CAST(s_suppkey AS VARCHAR(20)), 'n' || CAST(s_nationkey AS VARCHAR(9)), 'account' FROM $supplier"
ATTACHED = "SELECT id AS node, 'full' AS policy FROM ({nodes}) x WHERE id <> 'n3' AND id NOT LIKE 'a%7' UNION ALL SELECT id, 'deny-iam' FROM ({nodes}) x WHERE id LIKE 'ou%' AND id < 'ou3' UNION ALL SELECT id, 'maybe' FROM ({nodes}) x WHERE id LIKE 'n1%' UNION ALL SELECT id, 'only-s3' FROM ({nodes}) x WHERE id = 'n3'".format(nodes=NODES)
STATEMENTS = "SELECT * FROM (VALUES ('full', 'Allow', '*', false), ('deny-iam', 'Deny', 'iam:Create*', false), ('maybe', 'Deny', 's3:Put?bject', true), ('only-s3', 'Allow', 's3:*', false)) AS s(policy, effect, pattern, conditional)"
REQUESTS = "SELECT CASE WHEN l_suppkey % 9 = 4 THEN 'gone' ELSE 'a' END || CAST(l_suppkey AS VARCHAR(20)) AS id, CASE l_linenumber % 5 WHEN 0 THEN 's3:GetObject' WHEN 1 THEN 'iam:CreateUser' WHEN 2 THEN 's3:PutObject' WHEN 3 THEN 'ec2:RunInstances' ELSE 'S3:putobject' END AS action FROM $lineitem"


def _p(spark, sf_dir):
    return paths(derived(spark, sf_dir, NODES))


QUERIES = {
    "org_paths": lambda spark, sf_dir: _p(spark, sf_dir).select("id", "node", F.col("depth").cast("bigint").alias("depth")),
    "org_effective_policies": lambda spark, sf_dir: effective(_p(spark, sf_dir), derived(spark, sf_dir, ATTACHED)).groupBy("policy", "attached").agg(F.count("*").alias("nodes")),
    "scp_verdict": lambda spark, sf_dir: verdicts(derived(spark, sf_dir, REQUESTS), _p(spark, sf_dir), derived(spark, sf_dir, ATTACHED), derived(spark, sf_dir, STATEMENTS)).select("id", "action", "verdict"),
    "scp_blocked_by": lambda spark, sf_dir: verdicts(derived(spark, sf_dir, REQUESTS), _p(spark, sf_dir), derived(spark, sf_dir, ATTACHED), derived(spark, sf_dir, STATEMENTS)).where("verdict = 'denied'").select("id", "action", "blocked_by"),
    "eval_glob": lambda spark, sf_dir: derived(spark, sf_dir, REQUESTS).distinct().withColumn("pattern", F.explode(F.array(*map(F.lit, ("*", "iam:Create*", "s3:Put?bject", "s3:*"))))).select("id", "action", "pattern", F.rlike(F.lower("action"), glob(F.col("pattern"))).alias("matches")),
}
_O = f"""WITH RECURSIVE n AS MATERIALIZED ({duck(NODES)}), up(id, node, steps) AS (SELECT id, id, 0 FROM n UNION ALL SELECT up.id, n.parent, steps + 1 FROM up JOIN n ON up.node = n.id WHERE n.parent IS NOT NULL),
p AS (SELECT id, node, max(steps) OVER (PARTITION BY id) - steps AS depth FROM up), a AS ({duck(ATTACHED)}), s AS ({duck(STATEMENTS)}), r AS (SELECT DISTINCT * FROM ({duck(REQUESTS)})),
l AS (SELECT r.id, action, p.node, depth, effect, CASE WHEN effect IS NULL OR NOT lower(action) GLOB lower(pattern) THEN 0 WHEN conditional THEN 1 ELSE 2 END AS m FROM r LEFT JOIN p USING (id) LEFT JOIN a ON a.node = p.node LEFT JOIN s USING (policy)),
v AS (SELECT id, action, node, depth, max(CASE effect WHEN 'Allow' THEN m ELSE 0 END) AS al, max(CASE effect WHEN 'Deny' THEN m ELSE 0 END) AS de FROM l GROUP BY ALL),
w AS (SELECT id, action, min(al) AS al, max(de) AS de, arg_min(node, depth) FILTER (WHERE al = 0 OR de = 2) AS blocked_by FROM v GROUP BY ALL) """
_V = "CASE WHEN id LIKE 'gone%' THEN 'depends' WHEN de = 2 OR al = 0 THEN 'denied' WHEN al = 2 AND de = 0 THEN 'allowed' ELSE 'depends' END"
ORACLES = {
    "org_paths": _O + "SELECT id, node, CAST(depth AS BIGINT) AS depth FROM p",
    "org_effective_policies": _O + "SELECT policy, id = node AS attached, count(*) AS nodes FROM p JOIN a USING (node) GROUP BY ALL",
    "scp_verdict": _O + f"SELECT id, action, {_V} AS verdict FROM w",
    "scp_blocked_by": _O + f"SELECT id, action, blocked_by FROM w WHERE {_V} = 'denied'",
    "eval_glob": _O + "SELECT id, action, pattern, lower(action) GLOB lower(pattern) AS matches FROM r, s",
}
