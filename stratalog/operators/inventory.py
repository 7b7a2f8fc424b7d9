"""Identities and their credentials, declared state against live inventory, and planned changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import CHANGES_SQL as CHANGES
from ..adapters import derived, duck
from ..functions.text import masked

# Thresholds in days, and codes in order with their severities.
MAX_KEY_AGE, MAX_UNUSED, GRACE = 90, 90, 7
CODES = {
    "console_no_mfa": "high", "password_never_used": "low", "password_unused": "medium", "key_old": "medium", "key_never_used": "medium", "key_unused": "medium", "two_keys": "low", "inactive_keys": "low", "admin_keys": "high", "admin_user": "info",
}
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def days_since(now: Column, then: Column) -> Column:
    return F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400), F.lit(0))


# Credentials


def access_keys(users: DataFrame) -> DataFrame:
    """One row per key slot of the report that holds a key."""
    slot = lambda n: F.struct(F.lit(n).alias("slot"), F.col(f"key{n}_active").alias("active"), F.col(f"key{n}_rotated").alias("rotated"), F.col(f"key{n}_used").alias("used"))
    return users.select("user", "created", "now", F.explode(F.array(slot(1), slot(2))).alias("k")).select("user", "created", "now", "k.*").where("active IS NOT NULL")


def last_activity(users: DataFrame) -> DataFrame:
    return users.select("user", F.greatest("password_used", "key1_used", "key2_used").alias("last_activity"))


def findings(users: DataFrame) -> DataFrame:
    """user, code, slot (null unless a key's), severity. Ages are whole days; older is >, unused is >=."""
    age = days_since(F.col("now"), F.col("created"))
    unused = lambda at: days_since(F.col("now"), at) >= MAX_UNUSED
    console = F.col("password_enabled")
    both = F.coalesce(F.col("key1_active"), F.lit(False)) & F.coalesce(F.col("key2_active"), F.lit(False))
    some = F.coalesce(F.col("key1_active"), F.lit(False)) | F.coalesce(F.col("key2_active"), F.lit(False))
    idle = F.coalesce(~F.col("key1_active"), F.lit(False)) | F.coalesce(~F.col("key2_active"), F.lit(False))
    tests = {
        "console_no_mfa": console & ~F.col("mfa"), "password_never_used": console & F.col("password_used").isNull() & (age >= GRACE), "password_unused": console & F.coalesce(unused(F.col("password_used")), F.lit(False)),
        "two_keys": both, "inactive_keys": idle, "admin_keys": F.col("admin") & some, "admin_user": F.col("admin"),
    }
    rows = [F.when(t, F.struct(F.lit(c).alias("code"), F.lit(None).cast("int").alias("slot"))) for c, t in tests.items()]
    for n in (1, 2):
        on = F.coalesce(F.col(f"key{n}_active"), F.lit(False))
        rotated, used = F.col(f"key{n}_rotated"), F.col(f"key{n}_used")
        key_age = days_since(F.col("now"), rotated)
        for code, t in (("key_old", key_age > MAX_KEY_AGE), ("key_never_used", used.isNull() & (key_age >= GRACE)), ("key_unused", used.isNotNull() & unused(used))):
            rows.append(F.when(on & t, F.struct(F.lit(code).alias("code"), F.lit(n).alias("slot"))))
    severity = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    out = users.select("user", "account", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).select("user", "account", "f.*")
    return out.withColumn("severity", severity[F.col("code")])


def worst(found: DataFrame) -> DataFrame:
    """The first finding of each user by severity, then by the codes' order."""
    rank = F.create_map(*(F.lit(x) for i, (c, s) in enumerate(CODES.items()) for x in (c, 100 * SEVERITY[s] + i)))
    return found.groupBy("user").agg(F.min_by("code", rank[F.col("code")]).alias("code"), F.count("*").alias("findings"))


def stats(users: DataFrame) -> DataFrame:
    """Counters per account and over all; the total's account is null."""
    has = lambda n: F.coalesce(F.col(f"key{n}_active"), F.lit(False)).cast("bigint")
    return users.rollup("account").agg(F.count("*").alias("users"), F.count_if("password_enabled").alias("console"), F.count_if(F.col("password_enabled") & ~F.col("mfa")).alias("no_mfa"), F.sum(has(1) + has(2)).alias("active_keys"), F.count_if("admin").alias("admins"))


def retire_key(users: DataFrame) -> DataFrame:
    """Of two active keys, keep the most recently used, then the newest; the other one may go."""
    keys = access_keys(users).where("active")
    w = Window.partitionBy("user")
    order = w.orderBy(F.desc_nulls_last("used"), F.desc_nulls_last("rotated"), "slot")
    return keys.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(order)).where("n = 2 AND i = 2").select("user", F.col("slot").alias("retire_slot"))


USERS = """
SELECT c.c_custkey AS u, 'user' || CAST(c.c_custkey AS VARCHAR(20)) AS "user", c.c_nationkey % 6 AS account, TIMESTAMP '2000-06-01 12:00:00' AS now, o.first_o AS created, c.c_custkey % 3 <> 0 AS password_enabled, c.c_custkey % 4 <> 1 AS mfa,
  CASE WHEN c.c_custkey % 5 <> 0 THEN o.last_o END AS password_used, CASE WHEN c.c_custkey % 4 <> 3 THEN c.c_custkey % 8 <> 1 END AS key1_active, CASE WHEN c.c_custkey % 4 <> 3 THEN o.first_o END AS key1_rotated, CASE WHEN c.c_custkey % 4 <> 3 AND c.c_custkey % 6 <> 2 THEN o.last_o END AS key1_used,
  CASE WHEN c.c_custkey % 7 < 3 THEN c.c_custkey % 2 = 0 END AS key2_active, CASE WHEN c.c_custkey % 7 < 3 THEN o.mid_o END AS key2_rotated, CASE WHEN c.c_custkey % 7 < 2 THEN o.mid_o END AS key2_used, c.c_acctbal > 9000 AS admin
FROM $customer c JOIN (SELECT o_custkey, min(o_orderdate) AS first_o, max(CASE WHEN o_orderdate < TIMESTAMP '2000-05-30 00:00:00' THEN o_orderdate END) AS last_o, max(CASE WHEN o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '2000-05-30 00:00:00' THEN o_orderdate END) AS mid_o FROM $orders WHERE o_orderdate < TIMESTAMP '2000-05-30 00:00:00' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
"""
_U = USERS.replace('AS "user"', "AS user_")


def _users(f):
    return lambda spark, sf_dir: f(derived(spark, sf_dir, _U).withColumnRenamed("user_", "user"))


# Drift


def match(state: DataFrame, live: DataFrame, read: DataFrame) -> DataFrame:
    """family, id, status: gone (in state, not live, and its account was read), unmanaged (live, in no state), changed or same."""
    a = state.select("family", "id", F.col("account").alias("s_account"), F.struct("size", "flag").alias("s"))
    b = live.select("family", "id", F.col("account").alias("l_account"), F.struct("size", "flag").alias("l"), "owner")
    both = a.join(b, ["family", "id"], "full_outer").join(read.select(F.col("account").alias("s_account"), F.lit(True).alias("covered")), "s_account", "left")
    status = (
        F.when(F.col("l").isNull(), F.when(F.coalesce("covered", F.lit(False)), "gone").otherwise("not checked"))
        .when(F.col("s").isNull(), F.when(F.col("owner").isNotNull(), "other").otherwise("unmanaged")).when(F.col("s").eqNullSafe(F.col("l")), "same").otherwise("changed")
    )
    return both.select("family", "id", "owner", status.alias("status"))


def changed_settings(state: DataFrame, live: DataFrame) -> DataFrame:
    """One row per entry of the map ``settings`` that differs; absent and null are equal, and only settings that were
    declared are compared."""
    long = lambda df, c: df.select("family", "id", F.explode("settings").alias("setting", c))
    pair = state.select("family", "id").join(live.select("family", "id"), ["family", "id"])
    both = long(state, "declared").join(pair, ["family", "id"], "left_semi").join(long(live, "found"), ["family", "id", "setting"], "left")
    return both.where(~F.col("declared").eqNullSafe(F.col("found")))


def tag_changes(state: DataFrame, live: DataFrame) -> DataFrame:
    """Tags added, removed or changed; platform tags are ignored."""
    long = lambda df, c: df.select("family", "id", F.explode("tags").alias("tag", c)).where("NOT startswith(tag, 'aws:')")
    pair = state.select("family", "id").join(live.select("family", "id"), ["family", "id"])
    both = long(state, "declared").join(long(live, "found"), ["family", "id", "tag"], "full_outer").join(pair, ["family", "id"], "left_semi")
    kind = F.when(F.col("declared").isNull(), "added").when(F.col("found").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("declared").eqNullSafe(F.col("found"))).select("family", "id", "tag", kind.alias("change"))


#: Tags that tell the tool that made a resource, first match wins.
OWNER_TAGS = {"aws:cloudformation:stack-name": "CloudFormation", "aws:autoscaling:groupName": "Auto Scaling", "eks:cluster-name": "EKS", "pulumi:project": "Pulumi"}


def owner(tags: Column) -> Column:
    found = F.coalesce(*(F.when(F.map_contains_key(tags, k), v) for k, v in OWNER_TAGS.items()))
    return F.coalesce(found, F.when(F.exists(F.map_keys(tags), lambda k: k.startswith("kubernetes.io/cluster/")), "Kubernetes"))


def import_names(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """A valid, unique name per type for each row, never one that is taken. The first row of a base keeps it; the others
    put two underscores and a hash of their id behind it, and no base holds two underscores in a row. A base starts with
    a letter or underscore (``r_`` goes before digits) and comes from the id where there is no name."""
    named = F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("id"))
    base = F.regexp_replace(F.regexp_replace(F.lower(named), "[^a-z0-9_]+", "_"), "_+", "_")
    r = rows.select("family", "id", F.when(base.rlike("^[0-9]"), F.concat(F.lit("r_"), base)).otherwise(base).alias("base"))
    used = taken.select("family", F.col("name").alias("base")).distinct().withColumn("used", F.lit(True))
    first = r.groupBy("family", "base").agg(F.min("id").alias("first")).join(used, ["family", "base"], "left")
    own = (F.col("id") == F.col("first")) & F.col("used").isNull()
    late = F.concat(F.col("base"), F.lit("__"), F.substring(F.md5("id"), 1, 16))
    return r.join(first, ["family", "base"]).select("family", "id", F.when(own, F.col("base")).otherwise(late).alias("name"))


_TAGS = ["aws:cloudformation:stack-name", "pulumi:project", "kubernetes.io/cluster/x"]
_RES = """SELECT 'f' || CAST(p_partkey % 5 AS VARCHAR(9)) AS family, 'id' || CAST(p_partkey AS VARCHAR(20)) AS id, p_name AS name, p_partkey % 7 AS account, p_size AS size, p_retailprice > 1200 AS flag, p_brand AS team, p_type AS env, p_partkey AS k FROM $part"""
STATE = f"SELECT *, CAST(NULL AS VARCHAR(40)) AS owner_tag FROM ({_RES}) r WHERE k % 11 <> 0"
LIVE = f"SELECT family, id, name, account, CASE WHEN k % 13 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN k % 29 = 0 THEN NOT flag ELSE flag END AS flag, CASE WHEN k % 17 = 0 THEN 'other' ELSE team END AS team, CASE WHEN k % 19 = 0 THEN NULL ELSE env END AS env, k, CASE k % 6 WHEN 0 THEN '{_TAGS[0]}' WHEN 1 THEN '{_TAGS[1]}' WHEN 2 THEN '{_TAGS[2]}' END AS owner_tag FROM ({_RES}) r WHERE k % 10 <> 3"


def _drift(f):
    def tagged(df: DataFrame) -> DataFrame:
        tags = F.map_filter(F.create_map(F.lit("team"), F.col("team"), F.lit("env"), F.col("env"), F.coalesce("owner_tag", F.lit("-")), F.lit("x")), lambda k, v: v.isNotNull() & (k != "-"))
        return df.withColumn("tags", tags).withColumn("owner", owner(F.col("tags")))

    return lambda spark, sf_dir: f(tagged(derived(spark, sf_dir, STATE)), tagged(derived(spark, sf_dir, LIVE)), spark.range(6).withColumnRenamed("id", "account"))


# Plans


def plan_action(actions: Column) -> Column:
    a = F.array_sort(actions)
    has = lambda x: F.array_contains(a, x)
    return F.when(has("create") & has("delete"), "replace").when(has("create"), "create").when(has("update"), "update").when(has("delete"), "delete").when(has("forget"), "forget").when(has("read"), "read").otherwise("no-op")


def changed_attrs(changes: DataFrame) -> DataFrame:
    """Attributes that differ before and after, or are known only after apply."""
    before, after = (F.from_json(c, "map<string,string>") for c in ("before", "after"))
    keys = F.array_sort(F.array_union(F.coalesce(F.map_keys(before), F.array()), F.array_union(F.coalesce(F.map_keys(after), F.array()), F.coalesce("after_unknown", F.array().cast("array<string>")))))
    e = changes.withColumn("b", before).withColumn("a", after).select("address", "a", "b", "after_unknown", F.explode(keys).alias("attr"))
    unknown = F.coalesce(F.array_contains("after_unknown", F.col("attr")), F.lit(False))
    return e.where(unknown | ~F.col("a")[F.col("attr")].eqNullSafe(F.col("b")[F.col("attr")])).select("address", "attr", unknown.alias("known_after_apply"))


#: Types whose loss loses data.
STATEFUL = "aws_db_instance aws_rds_cluster aws_dynamodb_table aws_s3_bucket aws_ebs_volume aws_efs_file_system aws_kms_key".split()


def plan_risks(changes: DataFrame) -> DataFrame:
    after, action = F.from_json("after", "map<string,string>"), plan_action(F.col("actions"))
    goes = action.isin("delete", "replace")
    writes = action.isin("create", "update", "replace")
    rows = [
        (goes & F.col("type").isin(*STATEFUL), F.when(action == "delete", "critical").otherwise("high"), "Data is lost"), ((action == "replace") & ~F.col("type").isin(*STATEFUL), F.lit("low"), "Replaced"),
        (writes & (after["acl"].isin("public-read", "public-read-write")), F.lit("high"), "Public ACL"), (writes & (after["publicly_accessible"] == "true"), F.lit("high"), "Public database"), (writes & (after["storage_encrypted"] == "false"), F.lit("medium"), "Not encrypted"),
    ]
    found = F.filter(F.array(*(F.when(t, F.struct(s.alias("severity"), F.lit(x).alias("risk"))) for t, s, x in rows)), lambda x: x.isNotNull())
    return changes.select("address", F.explode(found).alias("r")).select("address", "r.*")


def _plan(f):
    def typed(df: DataFrame) -> DataFrame:
        return df.withColumn("actions", F.split("acts", ",")).withColumn("after_unknown", F.when(F.col("arn_unknown"), F.array(F.lit("arn"))).otherwise(F.array().cast("array<string>")))

    return lambda spark, sf_dir: f(typed(derived(spark, sf_dir, CHANGES)))


_RANKED = "array('delete', 'replace', 'update', 'create', 'forget')"
QUERIES = {
    "cred_keys": _users(lambda u: access_keys(u).select("user", "slot", "active", days_since(F.col("now"), F.col("rotated")).cast("bigint").alias("age_days"))),
    "cred_last_activity": _users(last_activity),
    "cred_findings": _users(findings),
    "cred_worst": _users(lambda u: worst(findings(u))),
    "cred_stats_rollup": _users(stats),
    "cred_retire_key": _users(retire_key),
    "cred_masked": _users(lambda u: u.select("user", masked(F.concat(F.lit("AKIA"), F.lpad(F.col("u").cast("string"), 16, "0"))).alias("key"))),
    "cred_not_in_report": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("u")).join(derived(spark, sf_dir, _U).select("u"), "u", "left_anti"),
    "drift_gone": _drift(lambda s, v, r: match(s, v, r).where("status IN ('gone', 'not checked')").select("family", "id", "status")),
    "drift_unmanaged": _drift(lambda s, v, r: match(s, v, r).where("status IN ('unmanaged', 'other')").select("family", "id", "owner", "status")),
    "drift_changed": _drift(lambda s, v, r: changed_settings(*(x.withColumn("settings", F.create_map(*(y for c in ("size", "flag", "team") for y in (F.lit(c), F.col(c).cast("string"))))) for x in (s, v)))),
    "drift_tags": _drift(lambda s, v, r: tag_changes(s, v)),
    "drift_owner": _drift(lambda s, v, r: v.groupBy("owner").agg(F.count("*").alias("resources"))),
    "drift_report": _drift(lambda s, v, r: match(s, v, r).groupBy("family", "status").agg(F.count("*").alias("resources"))),
    "drift_not_checked": _drift(lambda s, v, r: s.join(r, "account", "left_anti").groupBy("account").agg(F.count("*").alias("resources"))),
    "drift_import_names": _drift(lambda s, v, r: import_names(v.join(s.select("family", "id"), ["family", "id"], "left_anti"), s.where("k % 40 = 1").select("family", F.regexp_replace("name", "[^a-z0-9_]+", "_").alias("name")))),
    "plan_action": _plan(lambda c: c.select("address", plan_action(F.col("actions")).alias("action"))),
    "plan_counts": _plan(lambda c: c.groupBy("plan_id").agg(*(F.count_if(plan_action(F.col("actions")) == a).alias(a.replace("-", "_")) for a in ("create", "update", "replace", "delete", "read", "no-op")))),
    "plan_changes": _plan(lambda c: c.withColumn("action", plan_action(F.col("actions"))).withColumn("rank", F.array_position(F.expr(_RANKED), F.col("action"))).where("rank > 0").orderBy("rank", "address").select("plan_id", "address", "action", "rank")),
    "plan_changed_attrs": _plan(changed_attrs),
    "plan_risks": _plan(plan_risks),
}

_CU = f"WITH u AS (SELECT * FROM ({duck(_U)})) "
_days = lambda c: f"greatest(CAST(floor((epoch(now) - epoch({c})) / 86400) AS BIGINT), 0)"
_KEYS = "k AS (SELECT user_, created, now, 1 AS slot, key1_active AS active, key1_rotated AS rotated, key1_used AS used, account FROM u UNION ALL SELECT user_, created, now, 2, key2_active, key2_rotated, key2_used, account FROM u)"
_FOUND = f"""f AS (SELECT user_, account, 'console_no_mfa' AS code, NULL AS slot FROM u WHERE password_enabled AND NOT mfa
 UNION ALL SELECT user_, account, 'password_never_used', NULL FROM u WHERE password_enabled AND password_used IS NULL AND {_days('created')} >= 7
 UNION ALL SELECT user_, account, 'password_unused', NULL FROM u WHERE password_enabled AND {_days('password_used')} >= 90 AND password_used IS NOT NULL
 UNION ALL SELECT user_, account, 'two_keys', NULL FROM u WHERE key1_active AND key2_active UNION ALL SELECT user_, account, 'inactive_keys', NULL FROM u WHERE NOT key1_active OR NOT key2_active
 UNION ALL SELECT user_, account, 'admin_keys', NULL FROM u WHERE admin AND (key1_active OR key2_active) UNION ALL SELECT user_, account, 'admin_user', NULL FROM u WHERE admin
 UNION ALL SELECT user_, account, 'key_old', slot FROM k WHERE active AND {_days('rotated')} > 90 UNION ALL SELECT user_, account, 'key_never_used', slot FROM k WHERE active AND used IS NULL AND {_days('rotated')} >= 7 AND rotated IS NOT NULL
 UNION ALL SELECT user_, account, 'key_unused', slot FROM k WHERE active AND used IS NOT NULL AND {_days('used')} >= 90)"""
_SEV = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in CODES.items()) + " END"
_RK = "CASE code " + " ".join(f"WHEN '{c}' THEN {100 * SEVERITY[s] + i}" for i, (c, s) in enumerate(CODES.items())) + " END"
_OWN = "CASE owner_tag " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in zip(_TAGS, ("CloudFormation", "Pulumi", "Kubernetes"), strict=True)) + " END"
_D = f"WITH s AS (SELECT * FROM ({duck(STATE)})), v AS (SELECT *, {_OWN} AS owner FROM ({duck(LIVE)})), m AS (SELECT coalesce(s.family, v.family) AS family, coalesce(s.id, v.id) AS id, v.owner, CASE WHEN v.id IS NULL THEN CASE WHEN s.account < 6 THEN 'gone' ELSE 'not checked' END WHEN s.id IS NULL THEN CASE WHEN v.owner IS NULL THEN 'unmanaged' ELSE 'other' END WHEN s.size = v.size AND s.flag = v.flag THEN 'same' ELSE 'changed' END AS status FROM s FULL JOIN v ON s.family = v.family AND s.id = v.id) "
_ACT = "CASE WHEN acts IN ('delete,create', 'create,delete') THEN 'replace' ELSE acts END"
_P = f"WITH c AS (SELECT *, {_ACT} AS action FROM ({duck(CHANGES)})) "
ORACLES = {
    "cred_keys": _CU + f", {_KEYS} SELECT user_ AS user, slot, active, CASE WHEN rotated IS NOT NULL THEN {_days('rotated')} ELSE 0 END AS age_days FROM k WHERE active IS NOT NULL",
    "cred_last_activity": _CU + "SELECT user_ AS user, greatest(password_used, key1_used, key2_used) AS last_activity FROM u",
    "cred_findings": _CU + f", {_KEYS}, {_FOUND} SELECT user_ AS user, account, code, slot, {_SEV} AS severity FROM f",
    "cred_worst": _CU + f", {_KEYS}, {_FOUND} SELECT user_ AS user, arg_min(code, {_RK}) AS code, count(*) AS findings FROM f GROUP BY user_",
    "cred_stats_rollup": _CU + "SELECT account, count(*) AS users, count(*) FILTER (WHERE password_enabled) AS console, count(*) FILTER (WHERE password_enabled AND NOT mfa) AS no_mfa, CAST(sum(CAST(coalesce(key1_active, false) AS BIGINT) + CAST(coalesce(key2_active, false) AS BIGINT)) AS BIGINT) AS active_keys, count(*) FILTER (WHERE admin) AS admins FROM u GROUP BY ROLLUP (account)",
    "cred_retire_key": _CU + f", {_KEYS}, r AS (SELECT *, count(*) OVER (PARTITION BY user_) AS n, row_number() OVER (PARTITION BY user_ ORDER BY used DESC NULLS LAST, rotated DESC NULLS LAST, slot) AS i FROM k WHERE active) SELECT user_ AS user, slot AS retire_slot FROM r WHERE n = 2 AND i = 2",
    "cred_masked": _CU + "SELECT user_ AS user, 'AKIA****' || right(lpad(CAST(u AS VARCHAR), 16, '0'), 4) AS key FROM u",
    "cred_not_in_report": _CU + "SELECT c_custkey AS u FROM customer WHERE c_custkey NOT IN (SELECT u FROM u)",
    "drift_gone": _D + "SELECT family, id, status FROM m WHERE status IN ('gone', 'not checked')",
    "drift_unmanaged": _D + "SELECT family, id, owner, status FROM m WHERE status IN ('unmanaged', 'other')",
    "drift_changed": _D + "SELECT s.family, s.id, 'size' AS setting, CAST(s.size AS VARCHAR) AS declared, CAST(v.size AS VARCHAR) AS found FROM s JOIN v USING (family, id) WHERE s.size <> v.size UNION ALL SELECT s.family, s.id, 'flag', CAST(s.flag AS VARCHAR), CAST(v.flag AS VARCHAR) FROM s JOIN v USING (family, id) WHERE s.flag <> v.flag UNION ALL SELECT s.family, s.id, 'team', s.team, v.team FROM s JOIN v USING (family, id) WHERE s.team <> v.team",
    "drift_tags": _D + "SELECT s.family, s.id, 'team' AS tag, 'changed' AS change FROM s JOIN v USING (family, id) WHERE s.team <> v.team UNION ALL SELECT s.family, s.id, 'env', 'removed' FROM s JOIN v USING (family, id) WHERE v.env IS NULL UNION ALL SELECT s.family, s.id, v.owner_tag, 'added' FROM s JOIN v USING (family, id) WHERE v.owner_tag IS NOT NULL AND v.owner_tag NOT LIKE 'aws:%'",
    "drift_owner": _D + "SELECT owner, count(*) AS resources FROM v GROUP BY owner",
    "drift_report": _D + "SELECT family, status, count(*) AS resources FROM m GROUP BY ALL",
    "drift_not_checked": _D + "SELECT account, count(*) AS resources FROM s WHERE account >= 6 GROUP BY account",
    "drift_import_names": _D
    + """, x AS (SELECT family, id, regexp_replace(regexp_replace(lower(coalesce(nullif(trim(name), ''), id)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g') AS b FROM v WHERE (family, id) NOT IN (SELECT family, id FROM s)),
y AS (SELECT family, id, CASE WHEN regexp_matches(b, '^[0-9]') THEN 'r_' || b ELSE b END AS base FROM x), t AS (SELECT DISTINCT family, regexp_replace(name, '[^a-z0-9_]+', '_', 'g') AS base FROM s WHERE k % 40 = 1)
SELECT family, id, CASE WHEN row_number() OVER (PARTITION BY family, base ORDER BY id) = 1 AND (family, base) NOT IN (SELECT family, base FROM t) THEN base ELSE base || '__' || md5(id)[1:16] END AS name FROM y""",
    "plan_action": _P + "SELECT address, action FROM c",
    "plan_counts": _P + 'SELECT plan_id, count(*) FILTER (WHERE action = \'create\') AS "create", count(*) FILTER (WHERE action = \'update\') AS "update", count(*) FILTER (WHERE action = \'replace\') AS "replace", count(*) FILTER (WHERE action = \'delete\') AS "delete", count(*) FILTER (WHERE action = \'read\') AS "read", count(*) FILTER (WHERE action = \'no-op\') AS no_op FROM c GROUP BY plan_id',
    "plan_changes": _P + "SELECT plan_id, address, action, CAST(list_position(['delete', 'replace', 'update', 'create', 'forget'], action) AS BIGINT) AS rank FROM c WHERE action IN ('delete', 'replace', 'update', 'create', 'forget')",
    "plan_changed_attrs": _P + ", k AS (SELECT address, unnest(['size', 'acl', 'publicly_accessible', 'storage_encrypted', 'arn']) AS attr, before, after, arn_unknown FROM c) SELECT address, attr, attr = 'arn' AS known_after_apply FROM k WHERE CASE WHEN attr = 'arn' THEN arn_unknown ELSE json_extract_string(before, '$.' || attr) IS DISTINCT FROM json_extract_string(after, '$.' || attr) END",
    "plan_risks": _P + f", j AS (SELECT *, json_extract_string(after, '$.acl') AS acl, json_extract_string(after, '$.publicly_accessible') AS pub, json_extract_string(after, '$.storage_encrypted') AS enc, action IN ('create', 'update', 'replace') AS writes, type IN ({', '.join(repr(x) for x in STATEFUL)}) AS holds FROM c) SELECT address, CASE action WHEN 'delete' THEN 'critical' ELSE 'high' END AS severity, 'Data is lost' AS risk FROM j WHERE action IN ('delete', 'replace') AND holds UNION ALL SELECT address, 'low', 'Replaced' FROM j WHERE action = 'replace' AND NOT holds UNION ALL SELECT address, 'high', 'Public ACL' FROM j WHERE writes AND acl LIKE 'public-read%' UNION ALL SELECT address, 'high', 'Public database' FROM j WHERE writes AND pub = 'true' UNION ALL SELECT address, 'medium', 'Not encrypted' FROM j WHERE writes AND enc = 'false'",
}
