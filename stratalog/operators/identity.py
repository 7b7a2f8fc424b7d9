"""More on identities, drafts and drift: key use by time, policies through groups, what grants are not used, fixes as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import POLICY, TRAIL, derived, duck
from . import inventory, org
from .leastpriv import identity
from .policy import glob, statements


def key_use(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """Fill the use of keys by a creation time within two seconds, only where exactly one slot of the user fits. Times meet
    in buckets of two seconds and the two beside them."""
    at = lambda c: F.floor(F.unix_timestamp(c) / 2)
    k = keys.withColumn("b", at("rotated"))
    u = uses.withColumn("b", F.explode(F.array(at("made") - 1, at("made"), at("made") + 1)))
    met = k.join(u, ["user", "b"]).where(F.abs(F.unix_timestamp("rotated") - F.unix_timestamp("made")) < 2).select("user", "use_id", "slot", "last_use")
    one = met.groupBy("user", "use_id").agg(F.countDistinct("slot").alias("slots"), F.min("slot").alias("slot"), F.max("last_use").alias("last_use"))
    return one.where("slots = 1").select("user", "slot", "last_use")


def policy_sources(users: DataFrame, attached: DataFrame, members: DataFrame, group_policies: DataFrame) -> DataFrame:
    """A user's own policies and those through each group."""
    own = users.select("user").join(attached, "user").select("user", "policy", F.lit("own").alias("through"))
    through = members.join(group_policies, "grp").select("user", "policy", F.concat(F.lit("group "), F.col("grp").cast("string")).alias("through"))
    return own.unionByName(through)


def unused_services(allowed: DataFrame, used: DataFrame, start: str) -> DataFrame:
    """Services that are allowed and not used since ``start``, never used first."""
    last = used.groupBy("principal", "service").agg(F.max("event_time").alias("last_time"))
    out = allowed.distinct().join(last, ["principal", "service"], "left")
    return out.where(F.col("last_time").isNull() | (F.col("last_time") < F.lit(start).cast("timestamp")))


#: Actions on data, which management events don't record.
DATA_ACTIONS = "s3:GetObject s3:PutObject s3:DeleteObject dynamodb:GetItem dynamodb:PutItem dynamodb:Query dynamodb:Scan lambda:InvokeFunction sns:Publish sqs:SendMessage sqs:ReceiveMessage".split()


def data_gap(stmts: DataFrame) -> DataFrame:
    """Data actions that a policy allows."""
    found = F.filter(F.array(*map(F.lit, DATA_ACTIONS)), lambda a: F.exists("actions", lambda p: F.rlike(F.lower(a), glob(p))))
    return stmts.where("effect = 'Allow'").select("policy_id", F.explode(found).alias("action")).distinct()


def whatif(requests: DataFrame, path: DataFrame, attached: DataFrame, stmts: DataFrame, draft: DataFrame) -> DataFrame:
    """Verdicts that change when a draft is attached too."""
    now = org.verdicts(requests, path, attached, stmts).select("id", "action", F.col("verdict").alias("before"))
    then = org.verdicts(requests, path, attached.unionByName(draft), stmts).select("id", "action", F.col("verdict").alias("after"))
    return now.join(then, ["id", "action"]).where("before <> after")  # both have a row for every request


def policy_problems(stmts: DataFrame) -> DataFrame:
    """Why an organisation control would be refused."""
    rows = [(~F.col("effect").isin("Allow", "Deny"), "Effect must be Allow or Deny"), ((F.size("actions") == 0) & (F.size("not_actions") == 0), "No action"), ((F.size("actions") > 0) & (F.size("not_actions") > 0), "Action and NotAction"), (F.col("has_principal"), "Principal isn't allowed here")]
    each = F.filter(F.array(*(F.when(t, F.lit(x)) for t, x in rows)), lambda x: x.isNotNull())
    return stmts.select("policy_id", "stmt", F.explode(each).alias("problem"))


def ignored(rows: DataFrame, keys: DataFrame, tag: str, value: str) -> DataFrame:
    """Rows that no ignore entry names by id, name or family/id, and that don't have the tag and value."""
    left = rows.withColumn("_k", F.array("id", "name", F.concat_ws("/", "family", "id")))
    hit = left.select("family", "id", F.explode("_k").alias("key")).join(keys, "key", "left_semi").select("family", "id").distinct()
    return left.drop("_k").join(hit, ["family", "id"], "left_anti").where(~F.col("tags")[tag].eqNullSafe(value))


def import_blocks(named: DataFrame) -> DataFrame:
    """Import text for each row, with quotes and backslashes in ids escaped."""
    safe = F.replace(F.replace("id", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return named.select("family", "id", F.format_string('import {\n  to = %s.%s\n  id = "%s"\n}\n', F.col("family"), F.col("name"), safe).alias("block"))


USES = "SELECT c_custkey AS u, c_custkey * 10 AS use_id, o.first_o AS made, o.last_o AS last_use FROM $customer c JOIN (SELECT o_custkey, min(o_orderdate) AS first_o, max(o_orderdate) AS last_o FROM $orders WHERE o_orderdate < TIMESTAMP '2000-05-30 00:00:00' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey"


def _key_use(spark, sf_dir):
    users = derived(spark, sf_dir, inventory._U).withColumnRenamed("user_", "user")
    uses = derived(spark, sf_dir, USES).select(F.concat(F.lit("user"), F.col("u").cast("string")).alias("user"), "use_id", "made", "last_use")
    return key_use(inventory.access_keys(users), uses)


def _sources(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), (F.col("c_custkey") % 9).alias("k"), (F.col("c_nationkey") % 6).alias("grp"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return policy_sources(c, c.where("k = 0").select("user", F.lit("direct").alias("policy")), c.where("k > 1").select("user", "grp"), s.where("s_suppkey < 12").select((F.col("s_suppkey") % 6).alias("grp"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("policy")))


def _unused(spark, sf_dir):
    e = identity(derived(spark, sf_dir, TRAIL)).where("kind IS NOT NULL").select(F.col("name").alias("principal"), F.regexp_replace("event_source", r"\.amazonaws\.com", "").alias("service"), "event_time")
    allowed = e.select("principal").distinct().select("principal", F.explode(F.array(*map(F.lit, ("s3", "ec2", "kms", "sns")))).alias("service"))
    return unused_services(allowed, e, "2024-01-25")


def _whatif(spark, sf_dir):
    t = lambda q: derived(spark, sf_dir, q)
    draft = t(org.NODES).where("id LIKE 'ou4%'").select(F.col("id").alias("node"), F.lit("deny-iam").alias("policy"))
    return whatif(t(org.REQUESTS), org.paths(t(org.NODES)), t(org.ATTACHED), t(org.STATEMENTS), draft)


QUERIES = {
    "cred_key_use": _key_use,
    "cred_policy_sources": _sources,
    "lp_unused_services": _unused,
    "lp_data_gap": lambda spark, sf_dir: data_gap(statements(derived(spark, sf_dir, POLICY))),
    "scp_draft_whatif": _whatif,
    "scp_problems": lambda spark, sf_dir: policy_problems(statements(derived(spark, sf_dir, POLICY))),
    "drift_ignore": inventory._drift(lambda s, v, r: ignored(v, v.where("k % 23 = 0").select(F.col("id").alias("key")).unionByName(v.where("k % 31 = 0").select(F.concat_ws("/", "family", "id").alias("key"))), "team", "Brand#2").groupBy("family").agg(F.count("*").alias("resources"))),
    "drift_import_blocks": inventory._drift(lambda s, v, r: import_blocks(inventory.import_names(v.join(s.select("family", "id"), ["family", "id"], "left_anti"), s.where("k < 0").select("family", "name")))),
}
_names = """x AS (SELECT family, id, regexp_replace(regexp_replace(lower(coalesce(nullif(trim(name), ''), id)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g') AS b FROM v WHERE (family, id) NOT IN (SELECT family, id FROM s)),
y AS (SELECT family, id, CASE WHEN regexp_matches(b, '^[0-9]') THEN 'r_' || b ELSE b END AS base FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY family, base ORDER BY id) AS i FROM y)"""
ORACLES = {
    "cred_key_use": inventory._CU + f", {inventory._KEYS}, o AS ({duck(USES)}), j AS (SELECT k.user_, use_id, slot, last_use FROM k JOIN o ON k.user_ = 'user' || o.u AND abs(epoch(rotated) - epoch(made)) < 2 WHERE active IS NOT NULL), g AS (SELECT user_, use_id, count(DISTINCT slot) AS n, min(slot) AS slot, max(last_use) AS last_use FROM j GROUP BY ALL) SELECT user_ AS user, slot, last_use FROM g WHERE n = 1",
    "cred_policy_sources": "SELECT 'u' || c_custkey AS user, 'direct' AS policy, 'own' AS through FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'u' || c_custkey, 'p' || s_suppkey, 'group ' || (c_nationkey % 6) FROM customer JOIN supplier ON s_suppkey < 12 AND s_suppkey % 6 = c_nationkey % 6 WHERE c_custkey % 9 > 1",
    "lp_unused_services": f"""WITH t AS (SELECT event_time, replace(event_source, '.amazonaws.com', '') AS service, CASE id_type WHEN 'AssumedRole' THEN split_part(id_arn, '/', 2) ELSE coalesce(id_user, split_part(id_arn, '/', -1)) END AS principal FROM ({duck(TRAIL)}) WHERE id_type IN ('AssumedRole', 'IAMUser')), a AS (SELECT DISTINCT principal, unnest(['s3', 'ec2', 'kms', 'sns']) AS service FROM t), l AS (SELECT principal, service, max(event_time) AS last_time FROM t GROUP BY ALL) SELECT principal, service, last_time FROM a LEFT JOIN l USING (principal, service) WHERE last_time IS NULL OR last_time < TIMESTAMP '2024-01-25'""",
    "lp_data_gap": f"WITH s AS (SELECT policy_id, unnest(string_split(actions, ',')) AS p FROM ({duck(POLICY)}) WHERE lower(effect) = 'allow' AND actions <> '') SELECT DISTINCT policy_id, a AS action FROM s, (SELECT unnest({DATA_ACTIONS!r}) AS a) WHERE lower(a) GLOB lower(p)",
    "scp_draft_whatif": org._O + f", d AS (SELECT p.id FROM p WHERE node LIKE 'ou4%') SELECT id, action, {org._V} AS before, 'denied' AS after FROM w WHERE id IN (SELECT id FROM d) AND lower(action) GLOB 'iam:create*' AND {org._V} <> 'denied'",
    "scp_problems": f"WITH s AS (SELECT *, coalesce(actions, '') <> '' AS a, not_actions IS NOT NULL AS n FROM ({duck(POLICY)})) SELECT policy_id, stmt, 'Effect must be Allow or Deny' AS problem FROM s WHERE lower(effect) NOT IN ('allow', 'deny') UNION ALL SELECT policy_id, stmt, 'No action' FROM s WHERE NOT a AND NOT n UNION ALL SELECT policy_id, stmt, 'Action and NotAction' FROM s WHERE a AND n UNION ALL SELECT policy_id, stmt, 'Principal isn''t allowed here' FROM s WHERE has_principal",
    "drift_ignore": inventory._D + "SELECT family, count(*) AS resources FROM v WHERE k % 23 <> 0 AND k % 31 <> 0 AND team <> 'Brand#2' GROUP BY family",
    "drift_import_blocks": inventory._D + f", {_names} SELECT family, id, 'import {{' || chr(10) || '  to = ' || family || '.' || base || CASE WHEN i > 1 THEN '__' || md5(id)[1:16] ELSE '' END || chr(10) || '  id = \"' || id || '\"' || chr(10) || '}}' || chr(10) AS block FROM z",
}
