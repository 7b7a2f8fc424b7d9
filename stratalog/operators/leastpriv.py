"""From audit events to the smallest policies that cover them, for every principal at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import TRAIL, derived, duck
from .trail import DENIED, service

# Event sources whose action prefix differs, sources and events left out, and events whose actions differ.
PREFIX = {"monitoring": "cloudwatch", "email": "ses", "tagging": "tag"}
KNOWN = (
    "access-analyzer acm athena autoscaling backup batch bedrock budgets cloudformation cloudfront cloudtrail codebuild codecommit codepipeline cognito-identity cognito-idp config dynamodb ec2 ecr ecs eks elasticache elasticfilesystem"
    " elasticloadbalancing events firehose glue guardduty health iam inspector2 kafka kinesis kms lambda logs macie2 organizations pipes ram rds redshift route53 s3 sagemaker scheduler secretsmanager securityhub servicequotas ses"
    " shield sns sqs sso ssm states sts support transfer wafv2 xray cloudwatch tag"
).split()
SKIP_SOURCES = {"signin": "console sign-ins", "sso-signin": "console sign-ins"}
NO_PERMISSION = ("sts:GetCallerIdentity",)
RENAMED = {
    "s3:ListObjects": ["ListBucket"], "s3:ListObjectsV2": ["ListBucket"], "s3:HeadBucket": ["ListBucket"], "s3:HeadObject": ["GetObject"], "s3:ListBuckets": ["ListAllMyBuckets"], "s3:CopyObject": ["PutObject"], "s3:UploadPart": ["PutObject"], "s3:DeleteObjects": ["DeleteObject"],
    "s3:PutBucketCors": ["PutBucketCORS"], "s3:GetBucketCors": ["GetBucketCORS"], "s3:DeleteBucketCors": ["PutBucketCORS"], "lambda:Invoke": ["InvokeFunction"], "kms:ReEncrypt": ["ReEncryptFrom", "ReEncryptTo"], "dynamodb:TransactGetItems": ["GetItem"],
}
COLLAPSE_AT, PREFIX_CHARS, SIZE_LIMIT = 10, 4, 6144


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in pairs.items() for x in kv))


def identity(events: DataFrame) -> DataFrame:
    """Adds kind, name and account of the calling role or user; null for others."""
    arn = F.coalesce("id_arn", F.lit(""))
    role = F.nullif(F.regexp_extract(arn, r"^arn:[\w-]+:sts::\d{12}:assumed-role/([^/]+)/", 1), F.lit(""))
    kind = F.when((F.col("id_type") == "AssumedRole") & role.isNotNull(), "role").when(F.col("id_type") == "IAMUser", "user")
    name = F.when(F.col("id_type") == "AssumedRole", role).when(F.col("id_type") == "IAMUser", F.coalesce("id_user", F.element_at(F.split(arn, "/"), -1)))
    return events.withColumns({"kind": kind, "name": name, "account": F.when(kind.isNotNull(), F.col("id_account"))})


def principals(events: DataFrame) -> DataFrame:
    return identity(events).where("kind IS NOT NULL").groupBy("kind", "name", "account").agg(F.count("*").alias("events"))


def ambiguous(events: DataFrame) -> DataFrame:
    """Bare names that stand for several kinds or accounts."""
    return principals(events).groupBy(F.lower("name").alias("bare")).agg(F.count("*").alias("principals")).where("principals > 1")


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of a role by the events that assumed it; latest time of each."""
    role = F.regexp_extract(F.get_json_object("request", "$.roleArn"), r"^arn:[\w-]+:iam::\d{12}:role/(?:.*/)?([^/]+)$", 1)
    hit = events.where(F.col("event_source") == "sts.amazonaws.com").where(F.col("event_name").isin("AssumeRole", "AssumeRoleWithWebIdentity", "AssumeRoleWithSAML")).where(F.coalesce("error_code", F.lit("")) == "")
    return hit.select(role.alias("role"), F.get_json_object("request", "$.roleSessionName").alias("session"), "event_time").where("role <> ''").groupBy("role", "session").agg(F.max("event_time").alias("last_time"), F.count("*").alias("times"))


def resources(prefix: Column) -> Column:
    """What a call touched; names are kept as they are and never widen. No rule, no name: everything."""
    p = lambda k: F.get_json_object("request", f"$.{k}")
    place = F.concat(F.lit(":"), F.col("region"), F.lit(":"), F.coalesce("id_account", F.lit("")), F.lit(":"))
    found = (
        F.when(prefix == "s3", F.when(p("key").isNotNull(), F.concat(F.lit("arn:aws:s3:::"), p("bucketName"), F.lit("/"), p("key"))).otherwise(F.concat(F.lit("arn:aws:s3:::"), p("bucketName"))))
        .when(prefix == "dynamodb", F.concat(F.lit("arn:aws:dynamodb"), place, F.lit("table/"), p("tableName"))).when(prefix == "lambda", F.concat(F.lit("arn:aws:lambda"), place, F.lit("function:"), p("functionName")))
        .when(prefix == "ssm", F.concat(F.lit("arn:aws:ssm"), place, F.lit("parameter/"), F.regexp_replace(p("name"), "^/", ""))).when((prefix == "sts") & p("roleArn").isNotNull(), p("roleArn"))
        .when((prefix == "iam") & p("roleName").isNotNull(), F.concat(F.lit("arn:aws:iam::"), F.col("id_account"), F.lit(":role/"), p("roleName")))
    )
    return F.coalesce(F.when(found.rlike(r"[*?$]"), "*").otherwise(found), F.lit("*"))


def mapped(events: DataFrame) -> DataFrame:
    """event_id, principal, outcome (ok, skip or unmapped), reason, action and resource; one row per needed action."""
    e = identity(events)
    prefix = F.coalesce(_map(PREFIX)[service()], service())
    e = e.withColumn("prefix", prefix).withColumn("call", F.regexp_replace("event_name", r"^([A-Za-z][A-Za-z0-9]*?[A-Za-z])(\d{8}(?:v\d+)?|\d{4}_\d{2}_\d{2})$", "$1"))
    full = F.concat_ws(":", "prefix", "call")
    reason = (
        F.coalesce(F.when(F.col("event_type") == "AwsServiceEvent", "AWS service events"), _map(SKIP_SOURCES)[service()], F.when(full.isin(*NO_PERMISSION), "calls that need no permission"))
    )
    outcome = F.when(reason.isNotNull(), "skip").when(~F.col("prefix").isin(*KNOWN), "unmapped").otherwise("ok")
    e = e.withColumns({"outcome": outcome, "reason": F.coalesce(reason, F.when(outcome == "unmapped", "not in the service table"))})
    calls = F.when(F.col("outcome") == "ok", F.coalesce(_map(RENAMED)[full], F.array("call"))).otherwise(F.array(F.lit(None).cast("string")))
    e = e.withColumn("one", F.explode(calls))
    return e.withColumn("action", F.when(F.col("outcome") == "ok", F.concat_ws(":", "prefix", "one"))).withColumn("resource", F.when(F.col("outcome") == "ok", resources(F.col("prefix"))))


def usage(events: DataFrame) -> DataFrame:
    """Per principal, action and origin (used or denied): calls, resources, regions, last use. A denied call is no use."""
    denied = F.lower(F.coalesce("error_code", F.lit(""))).rlike(DENIED)
    m = mapped(events).where("outcome = 'ok' AND kind IS NOT NULL").withColumn("origin", F.when(denied, "denied").otherwise("used"))
    return m.groupBy("kind", "name", "account", "action", "origin").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("resource")).alias("resources"), F.array_sort(F.collect_set("region")).alias("regions"), F.max("event_time").alias("last_time"))


def collapse(use: DataFrame) -> DataFrame:
    """More than ten resources of one type, account and region become one wildcard that keeps a shared prefix of four
    characters or more. The shared prefix of a set is that of its least and greatest."""
    r = use.select("kind", "name", "account", "action", "origin", F.explode("resources").alias("resource"))
    part = F.split("resource", ":", 6)
    tail = F.element_at(part, -1)
    r = r.withColumn("place", F.when(F.size(part) == 6, F.concat_ws(":", F.slice(part, 1, 5), F.regexp_extract(tail, r"^([\w-]+[/:])", 1))).otherwise(F.col("resource")))
    r = r.withColumn("own", F.when(F.size(part) == 6, F.regexp_replace(tail, r"^[\w-]+[/:]", "")).otherwise(""))
    keys = ["kind", "name", "account", "action", "origin", "place"]
    g = r.groupBy(*keys).agg(F.countDistinct("resource").alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi"), F.array_sort(F.collect_set("resource")).alias("all"))
    n = F.least(F.length("lo"), F.length("hi"))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring("lo", 1, i) == F.substring("hi", 1, i)) & (i <= n), i).otherwise(acc))
    prefix = F.when(shared >= PREFIX_CHARS, F.expr("substring(lo, 1, 0)")).otherwise("")
    g = g.withColumn("k", shared).withColumn("wild", F.concat("place", F.when(F.col("k") >= PREFIX_CHARS, F.substring(F.col("lo"), F.lit(1), F.col("k"))).otherwise(prefix), F.lit("*")))
    out = g.select(*keys[:-1], F.explode(F.when(F.col("n") > COLLAPSE_AT, F.array("wild")).otherwise(F.col("all"))).alias("resource"))
    return out.groupBy(*keys[:-1]).agg(F.array_sort(F.collect_set("resource")).alias("resources"))


def draft(use: DataFrame) -> DataFrame:
    """One statement for each origin, service and resource set, with sorted actions and a stable, numbered Sid."""
    c = collapse(use).withColumn("service", F.substring_index("action", ":", 1)).withColumn("set", F.when(F.array_contains("resources", "*"), F.array(F.lit("*"))).otherwise(F.col("resources")))
    who = ["kind", "name", "account"]
    s = c.groupBy(*who, "origin", "service", "set").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    base = F.concat(F.when(F.col("origin") == "denied", "PreviouslyDenied").otherwise(""), F.initcap("service"), F.when(F.size("actions") == 1, F.substring_index(F.element_at("actions", 1), ":", -1)).otherwise("Access"))
    s = s.withColumn("base", F.regexp_replace(base, "[^A-Za-z0-9]", "")).withColumn("i", F.row_number().over(Window.partitionBy(*who, "base").orderBy("origin", F.array_join("set", ","))))
    sid = F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat("base", F.col("i").cast("string")))
    return s.select(*who, "origin", sid.alias("sid"), F.array_join("actions", ",").alias("actions"), F.array_join("set", ",").alias("resources"))


def documents(drafts: DataFrame) -> DataFrame:
    """The policy text of what each principal used, and whether it fits the size limit."""
    st = F.struct(F.col("sid").alias("Sid"), F.lit("Allow").alias("Effect"), F.split("actions", ",").alias("Action"), F.split("resources", ",").alias("Resource"))
    d = drafts.where("origin = 'used'").groupBy("kind", "name", "account").agg(F.array_sort(F.collect_list(st)).alias("s"))
    text = F.to_json(F.struct(F.lit("2012-10-17").alias("Version"), F.col("s").alias("Statement")))
    return d.select("kind", "name", "account", text.alias("policy"), F.length(text).cast("bigint").alias("size"), (F.length(text) <= SIZE_LIMIT).alias("fits"))


def _on(f):
    return lambda spark, sf_dir: f(derived(spark, sf_dir, TRAIL))


_flat = lambda c: F.array_join(c, ",").alias(c)
QUERIES = {
    "lp_identity": _on(lambda e: identity(e).select("event_id", "kind", "name", "account")),
    "lp_principals": _on(principals),
    "lp_principal_match": _on(lambda e: identity(e).where((F.lower("name") == "role2") & (F.coalesce("account", F.lit("111122223333")) == "111122223333")).select("event_id")),
    "lp_ambiguous": _on(lambda e: ambiguous(e.unionByName(e.where("id_type = 'AssumedRole' AND event_id % 5 = 0").withColumn("id_account", F.lit("999988887777"))))),
    "lp_sessions": _on(sessions),
    "lp_map_action": _on(lambda e: mapped(e).where("outcome = 'ok'").select("event_id", "action")),
    "lp_resources": _on(lambda e: mapped(e).where("outcome = 'ok'").groupBy("action", "resource").agg(F.count("*").alias("calls"))),
    "lp_skipped": _on(lambda e: mapped(e).where("outcome = 'skip'").groupBy("reason").agg(F.count("*").alias("events"))),
    "lp_unmapped": _on(lambda e: mapped(e.withColumn("event_source", F.when(F.col("event_id") % 50 == 0, "odd.amazonaws.com").otherwise(F.col("event_source")))).where("outcome = 'unmapped'").groupBy("prefix", "call").agg(F.count("*").alias("calls"), F.max("event_time").alias("last_time"))),
    "lp_usage": _on(lambda e: usage(e).withColumns({"resources": _flat("resources"), "regions": _flat("regions")})),
    "lp_collapse": _on(lambda e: collapse(usage(e.withColumn("request", F.when(F.col("event_source") == "s3.amazonaws.com", F.format_string('{"bucketName":"data-%d"}', F.col("event_id") % 40)).otherwise(F.col("request"))))).groupBy("action").agg(F.count("*").alias("principals"), F.sum(F.size("resources")).alias("resources"), F.count_if(F.exists("resources", lambda r: r.endswith("data-*"))).alias("wild"))),
    "lp_draft_policy": _on(lambda e: draft(usage(e))),
    "lp_policy_size": _on(lambda e: documents(draft(usage(e))).select("kind", "name", "account", "fits", (F.col("size") > 100).alias("has_text"))),
}

_T = rf"""WITH t AS (SELECT *, replace(event_source, '.amazonaws.com', '') AS svc, regexp_replace(event_name, '^([A-Za-z][A-Za-z0-9]*?[A-Za-z])(\d{{8}}(?:v\d+)?|\d{{4}}_\d{{2}}_\d{{2}})$', '\1') AS call,
 CASE id_type WHEN 'AssumedRole' THEN 'role' WHEN 'IAMUser' THEN 'user' END AS kind, CASE id_type WHEN 'AssumedRole' THEN split_part(id_arn, '/', 2) WHEN 'IAMUser' THEN coalesce(id_user, split_part(id_arn, '/', -1)) END AS name,
 CASE WHEN id_type IN ('AssumedRole', 'IAMUser') THEN id_account END AS account, CASE WHEN regexp_matches(lower(coalesce(error_code, '')), '{DENIED}') THEN 'denied' ELSE 'used' END AS origin,
 json_extract_string(request, '$.bucketName') AS bucket, json_extract_string(request, '$.key') AS k, ':' || region || ':' || coalesce(id_account, '') || ':' AS place FROM ({duck(TRAIL)})),
m AS (SELECT *, svc || ':' || CASE svc || ':' || call WHEN 's3:ListBuckets' THEN 'ListAllMyBuckets' WHEN 'lambda:Invoke' THEN 'InvokeFunction' ELSE call END AS action,
 coalesce(CASE svc WHEN 's3' THEN 'arn:aws:s3:::' || bucket || coalesce('/' || k, '') WHEN 'dynamodb' THEN 'arn:aws:dynamodb' || place || 'table/' || json_extract_string(request, '$.tableName') WHEN 'lambda' THEN 'arn:aws:lambda' || place || 'function:' || json_extract_string(request, '$.functionName')
 WHEN 'ssm' THEN 'arn:aws:ssm' || place || 'parameter/' || ltrim(json_extract_string(request, '$.name'), '/') WHEN 'sts' THEN json_extract_string(request, '$.roleArn') WHEN 'iam' THEN 'arn:aws:iam::' || id_account || ':role/' || json_extract_string(request, '$.roleName') END, '*') AS resource FROM t WHERE svc <> 'signin'),
u AS (SELECT kind, name, account, action, origin, count(*) AS calls, list_sort(list(DISTINCT resource)) AS rs, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, max(event_time) AS last_time FROM m WHERE kind IS NOT NULL GROUP BY ALL),
st AS (SELECT kind, name, account, origin, split_part(action, ':', 1) AS service, CASE WHEN list_contains(rs, '*') THEN '*' ELSE array_to_string(rs, ',') END AS resources, list_sort(list(DISTINCT action)) AS acts FROM u GROUP BY ALL),
dr AS (SELECT kind, name, account, origin, array_to_string(acts, ',') AS actions, resources, regexp_replace(CASE WHEN origin = 'denied' THEN 'PreviouslyDenied' ELSE '' END || upper(service[1]) || service[2:] || CASE WHEN len(acts) = 1 THEN split_part(acts[1], ':', 2) ELSE 'Access' END, '[^A-Za-z0-9]', '', 'g') AS base FROM st),
dn AS (SELECT *, row_number() OVER (PARTITION BY kind, name, account, base ORDER BY origin, resources) AS i FROM dr) """
ORACLES = {
    "lp_identity": _T + "SELECT event_id, kind, name, account FROM t",
    "lp_principals": _T + "SELECT kind, name, account, count(*) AS events FROM t WHERE kind IS NOT NULL GROUP BY ALL",
    "lp_principal_match": _T + "SELECT event_id FROM t WHERE lower(name) = 'role2' AND account = '111122223333'",
    "lp_ambiguous": _T + ", p AS (SELECT kind, name, account FROM t WHERE kind IS NOT NULL UNION SELECT kind, name, '999988887777' FROM t WHERE kind = 'role' AND event_id % 5 = 0) SELECT lower(name) AS bare, count(*) AS principals FROM p GROUP BY ALL HAVING count(*) > 1",
    "lp_sessions": _T + "SELECT split_part(json_extract_string(request, '$.roleArn'), '/', -1) AS role, json_extract_string(request, '$.roleSessionName') AS session, max(event_time) AS last_time, count(*) AS times FROM t WHERE event_name = 'AssumeRole' AND error_code IS NULL GROUP BY ALL",
    "lp_map_action": _T + "SELECT event_id, action FROM m",
    "lp_resources": _T + "SELECT action, resource, count(*) AS calls FROM m GROUP BY ALL",
    "lp_skipped": _T + "SELECT 'console sign-ins' AS reason, count(*) AS events FROM t WHERE svc = 'signin'",
    "lp_unmapped": _T + "SELECT 'odd' AS prefix, call, count(*) AS calls, max(event_time) AS last_time FROM t WHERE event_id % 50 = 0 GROUP BY call",
    "lp_usage": _T + "SELECT kind, name, account, action, origin, calls, array_to_string(rs, ',') AS resources, regions, last_time FROM u",
    "lp_collapse": _T + ", b AS (SELECT kind, name, account, action, origin, CASE svc WHEN 's3' THEN 'arn:aws:s3:::data-' || (event_id % 40) ELSE resource END AS r FROM m WHERE kind IS NOT NULL), g AS (SELECT kind, name, account, action, origin, count(DISTINCT r) AS n, bool_or(r LIKE '%:::data-%') AS d FROM b GROUP BY ALL) SELECT action, count(*) AS principals, CAST(sum(CASE WHEN n > 10 THEN 1 ELSE n END) AS BIGINT) AS resources, count(*) FILTER (WHERE n > 10 AND d) AS wild FROM g GROUP BY action",
    "lp_draft_policy": _T + "SELECT kind, name, account, origin, CASE WHEN i = 1 THEN base ELSE base || i END AS sid, actions, resources FROM dn",
    "lp_policy_size": _T + "SELECT DISTINCT kind, name, account, true AS fits, true AS has_text FROM dn WHERE origin = 'used'",
}
