"""Audit events: who did what, which rule flags it, and what was denied.

Every operator takes flat event rows (see ``adapters.TRAIL`` for the columns) and returns a DataFrame; those that only
add columns run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import TRAIL, derived, duck

# The rule catalog in match order, as (key, severity, title, source, event names).
_CALL_RULES = {
    "trail-change": ("high", "CloudTrail changed", "cloudtrail", "CreateTrail UpdateTrail DeleteTrail StartLogging StopLogging PutEventSelectors"),
    "config-change": ("high", "AWS Config recording changed", "config", "StopConfigurationRecorder DeleteDeliveryChannel PutDeliveryChannel PutConfigurationRecorder"),
    "kms-delete": ("high", "KMS key disabled or set to be deleted", "kms", "DisableKey ScheduleKeyDeletion"),
    "iam-policy": ("medium", "IAM policy changed", "iam", "DeleteGroupPolicy DeleteRolePolicy DeleteUserPolicy PutGroupPolicy PutRolePolicy PutUserPolicy CreatePolicy DeletePolicy CreatePolicyVersion DeletePolicyVersion SetDefaultPolicyVersion AttachRolePolicy DetachRolePolicy AttachUserPolicy DetachUserPolicy AttachGroupPolicy DetachGroupPolicy UpdateAssumeRolePolicy PutRolePermissionsBoundary DeleteRolePermissionsBoundary"),
    "iam-credentials": ("medium", "New IAM user or credentials", "iam", "CreateUser CreateAccessKey CreateLoginProfile UpdateLoginProfile DeactivateMFADevice DeleteVirtualMFADevice"),
    "org-change": ("medium", "Organizations changed", "organizations", "AcceptHandshake AttachPolicy CreateAccount CreateOrganizationalUnit CreatePolicy DeclineHandshake DeleteOrganization DeleteOrganizationalUnit DeletePolicy DetachPolicy DisablePolicyType EnablePolicyType InviteAccountToOrganization LeaveOrganization MoveAccount RemoveAccountFromOrganization UpdatePolicy UpdateOrganizationalUnit"),
    "s3-policy": ("medium", "S3 bucket policy or ACL changed", "s3", "PutBucketAcl PutBucketPolicy PutBucketCors PutBucketLifecycle PutBucketReplication DeleteBucketPolicy DeleteBucketCors DeleteBucketLifecycle DeleteBucketReplication"),
    "sg-change": ("low", "Security group changed", "ec2", "AuthorizeSecurityGroupIngress AuthorizeSecurityGroupEgress RevokeSecurityGroupIngress RevokeSecurityGroupEgress CreateSecurityGroup DeleteSecurityGroup ModifySecurityGroupRules"),
    "nacl-change": ("low", "Network ACL changed", "ec2", "CreateNetworkAcl CreateNetworkAclEntry DeleteNetworkAcl DeleteNetworkAclEntry ReplaceNetworkAclEntry ReplaceNetworkAclAssociation"),
    "gateway-change": ("low", "Network gateway changed", "ec2", "CreateCustomerGateway DeleteCustomerGateway AttachInternetGateway CreateInternetGateway DeleteInternetGateway DetachInternetGateway"),
    "route-change": ("low", "Route table changed", "ec2", "CreateRoute CreateRouteTable ReplaceRoute ReplaceRouteTableAssociation DeleteRouteTable DeleteRoute DisassociateRouteTable"),
    "vpc-change": ("low", "VPC changed", "ec2", "CreateVpc DeleteVpc ModifyVpcAttribute AcceptVpcPeeringConnection CreateVpcPeeringConnection DeleteVpcPeeringConnection RejectVpcPeeringConnection"),
}
_OTHER_RULES = {
    "root": ("high", "Root user used"), "login-no-mfa": ("high", "Console sign-in without MFA"), "guardduty-off": ("high", "GuardDuty turned off"), "made-public": ("critical", "Snapshot or image shared with everyone"),
    "s3-block-public": ("high", "S3 Block Public Access loosened"), "login-failed": ("medium", "Failed console sign-in"), "denied": ("medium", "Call denied"),
}
ORDER = (
    "root login-no-mfa trail-change config-change kms-delete guardduty-off made-public s3-block-public iam-policy iam-credentials org-change login-failed s3-policy denied sg-change nacl-change"
    " gateway-change route-change vpc-change"
).split()
DENIED = "accessdenied|unauthorizedoperation|unauthorized|forbidden"
_GUARD_CALLS = ["DeleteDetector", "DisassociateFromMasterAccount", "DisassociateFromAdministratorAccount", "StopMonitoringMembers"]


def rule(key: str) -> tuple[str, str]:
    """(severity, title)"""
    return _OTHER_RULES[key] if key in _OTHER_RULES else _CALL_RULES[key][:2]


def service() -> Column:
    return F.regexp_replace("event_source", r"\.amazonaws\.com", "")


def _tail(arn: Column) -> Column:
    return F.element_at(F.split(arn, "/"), -1)


def who() -> Column:
    """A readable actor for each kind of identity."""
    arn, user = F.coalesce("id_arn", F.lit("")), F.nullif(F.col("id_user"), F.lit(""))
    role = F.regexp_extract(arn, r"^arn:aws[\w-]*:sts::\d{12}:assumed-role/([^/]+)/(.+)", 1)
    session = F.regexp_extract(arn, r"^arn:aws[\w-]*:sts::\d{12}:assumed-role/([^/]+)/(.+)", 2)
    sso = F.concat(F.regexp_replace(role, r"^AWSReservedSSO_(.*?)(_[^_]*)?$", "$1"), F.lit(" (SSO)"))
    return (
        F.when(F.col("id_type") == "Root", "root")
        .when(F.col("id_type") == "IAMUser", F.coalesce(user, _tail(arn)))
        .when((F.col("id_type") == "AssumedRole") & (role != ""), F.concat_ws("/", F.when(role.startswith("AWSReservedSSO_"), sso).otherwise(role), session))
        .when(F.col("id_type") == "AssumedRole", arn)
        .when(F.col("id_type") == "AWSService", F.coalesce("id_invoked_by", F.lit("AWS service")))
        .when(F.col("id_type") == "AWSAccount", F.concat(F.lit("account "), F.coalesce("id_account", F.lit(""))))
        .when(F.col("id_type") == "FederatedUser", _tail(arn))
        .otherwise(F.coalesce(user, F.nullif(F.col("id_type"), F.lit("")), F.lit("unknown")))
    )


def _tests() -> dict[str, Column]:
    name, source = F.col("event_name"), F.col("event_source")
    call = lambda s, names: (source == f"{s}.amazonaws.com") & name.isin(*names)
    tests = {k: call(s, names.split()) for k, (_, _, s, names) in _CALL_RULES.items()}
    login = (name == "ConsoleLogin") & (F.coalesce(source, F.lit("signin.amazonaws.com")) == "signin.amazonaws.com")
    ok = F.lower(F.coalesce("login_result", F.lit(""))) == "success"
    said = (F.coalesce("error_message", F.lit("")) != "") | (F.coalesce("login_result", F.lit("")) != "")
    request = F.coalesce("request", F.lit(""))
    block = F.coalesce(F.get_json_object(request, "$.PublicAccessBlockConfiguration"), F.lit(""))
    tests["root"] = (F.col("id_type") == "Root") & (F.coalesce("id_invoked_by", F.lit("")) == "") & ~F.col("event_type").eqNullSafe("AwsServiceEvent")
    tests["login-no-mfa"] = login & ok & F.col("id_type").isin("IAMUser", "Root") & (F.lower(F.coalesce("mfa_used", F.lit(""))) != "yes")
    tests["login-failed"] = login & ~ok & said
    tests["guardduty-off"] = call("guardduty", _GUARD_CALLS) | (call("guardduty", ["UpdateDetector"]) & (F.get_json_object(request, "$.enable") == "false"))
    tests["made-public"] = name.isin("ModifySnapshotAttribute", "ModifyImageAttribute") & request.rlike('"group": *"all"') & request.rlike('"add"|Add')
    tests["s3-block-public"] = call("s3", ["DeletePublicAccessBlock"]) | (call("s3", ["PutPublicAccessBlock"]) & F.lower(block).contains("false"))
    tests["denied"] = F.lower(F.coalesce("error_code", F.lit(""))).rlike(DENIED)
    return {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}


def alert_key() -> Column:
    """The first rule of the catalog that an event matches; null if none."""
    tests = _tests()
    found = F
    for key in ORDER:
        found = found.when(tests[key], key)
    return found


def _of_rule(column: Column, k: int) -> Column:
    found = F
    for key in ORDER:
        found = found.when(column == key, rule(key)[k])
    return found


def parse(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("event_time"), F.col("event_name").alias("name"), service().alias("service"), who().alias("who"), F.coalesce("id_type", F.lit("unknown")).alias("who_type"), F.col("region"), F.coalesce("error_code", F.lit("")).alias("error"), F.col("read_only"))


def resources() -> Column:
    """Up to two request parameters whose names tell a resource, comma-joined."""
    params = F.from_json(F.coalesce("request", F.lit("{}")), "map<string,string>")
    named = F.filter(F.map_entries(params), lambda e: e["key"].rlike("(?i)(name|id|ids|arn|bucket|key)$") & (F.coalesce(e["value"], F.lit("")) != "") & ~e["value"].rlike(r"^[\[{]") & ~e["value"].isin("true", "false"))
    return F.array_join(F.array_distinct(F.slice(F.transform(named, lambda e: e["value"]), 1, 2)), ", ")


def alerts(events: DataFrame) -> DataFrame:
    flagged = events.withColumn("rule", alert_key()).where(F.col("rule").isNotNull())
    return flagged.select("event_id", "rule", _of_rule(F.col("rule"), 0).alias("severity"), _of_rule(F.col("rule"), 1).alias("title"), who().alias("who"))


def alert_counts(events: DataFrame) -> DataFrame:
    found = events.select(alert_key().alias("rule"), who().alias("who"), "event_time").where(F.col("rule").isNotNull())
    return found.groupBy("rule", _of_rule(F.col("rule"), 0).alias("severity")).agg(F.count("*").alias("events"), F.countDistinct("who").alias("actors"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))


def search(events: DataFrame, start: str, end: str, limit: int = 500, source: str | None = None, errors_only: bool = False, writes_only: bool = False, security_only: bool = False) -> DataFrame:
    """Newest events of a time range. The limit is the feature; ties are broken by event_id."""
    found = events.where((F.col("event_time") >= F.lit(start).cast("timestamp")) & (F.col("event_time") < F.lit(end).cast("timestamp")))
    if source:
        found = found.where(F.col("event_source") == source)
    if errors_only:
        found = found.where(F.coalesce("error_code", F.lit("")) != "")
    if writes_only:
        found = found.where(~F.col("read_only").eqNullSafe(True))
    if security_only:
        found = found.where(alert_key().isNotNull())
    return parse(found.orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit))


def explain_denied(events: DataFrame) -> DataFrame:
    message = F.coalesce("error_message", F.lit(""))
    permission = F.regexp_extract(message, r"not authorized to perform: (\S+)", 1)
    target = F.regexp_replace(F.regexp_extract(message, r"not authorized to perform: \S+ on resource: (\S+)", 1), r'^"+|"+$', "")
    why = F.regexp_replace(F.regexp_extract(message, r"because (.+)$", 1), r"\.+$", "")
    return events.where(message != "").select("event_id", permission.alias("permission"), target.alias("resource"), why.alias("why"))


def denied_summary(events: DataFrame) -> DataFrame:
    hit = events.where(_tests()["denied"]).select(who().alias("who"), F.concat_ws(":", service(), "event_name").alias("action"), "event_time", "event_id", "error_message")
    return hit.groupBy("who", "action").agg(F.count("*").alias("calls"), F.max("event_time").alias("last_time"), F.max_by("error_message", F.struct("event_time", "event_id")).alias("last_message"))


def dedupe(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each id once; rows without an id all stay."""
    return events.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(events.where(F.col(key).isNull()))


# Queries and their SQL

_WHO = r"""CASE WHEN id_type = 'Root' THEN 'root' WHEN id_type = 'IAMUser' THEN coalesce(id_user, split_part(id_arn, '/', -1))
 WHEN id_type = 'AssumedRole' AND id_arn LIKE '%/AWSReservedSSO_%' THEN regexp_extract(id_arn, 'AWSReservedSSO_(.*)_[^_/]*/', 1) || ' (SSO)/' || split_part(id_arn, '/', 3)
 WHEN id_type = 'AssumedRole' THEN split_part(id_arn, '/', 2) || '/' || split_part(id_arn, '/', 3)
 WHEN id_type = 'AWSService' THEN coalesce(id_invoked_by, 'AWS service') WHEN id_type = 'AWSAccount' THEN 'account ' || id_account ELSE split_part(id_arn, '/', -1) END"""


def _sql_test(key: str) -> str:
    if key in _CALL_RULES:
        _, _, s, names = _CALL_RULES[key]
        return f"event_source = '{s}.amazonaws.com' AND event_name IN ({', '.join(repr(n) for n in names.split())})"
    return {
        "root": "id_type = 'Root' AND id_invoked_by IS NULL",
        "login-no-mfa": "event_name = 'ConsoleLogin' AND login_result = 'Success' AND id_type IN ('IAMUser', 'Root') AND mfa_used <> 'Yes'",
        "guardduty-off": "event_source = 'guardduty.amazonaws.com' AND (event_name IN (" + ", ".join(repr(n) for n in _GUARD_CALLS) + ") OR event_name = 'UpdateDetector' AND json_extract_string(request, '$.enable') = 'false')",
        "made-public": "event_name IN ('ModifySnapshotAttribute', 'ModifyImageAttribute') AND request LIKE '%\"group\": \"all\"%' AND request LIKE '%\"add\"%'",
        "s3-block-public": "event_source = 's3.amazonaws.com' AND (event_name = 'DeletePublicAccessBlock' OR event_name = 'PutPublicAccessBlock' AND CAST(json_extract(request, '$.PublicAccessBlockConfiguration') AS VARCHAR) LIKE '%false%')",
        "login-failed": "event_name = 'ConsoleLogin' AND login_result <> 'Success'",
        "denied": f"regexp_matches(lower(error_code), '{DENIED}')",
    }[key]


_RULE = "CASE " + " ".join(f"WHEN {_sql_test(k)} THEN '{k}'" for k in ORDER) + " END"
_SEVERITY = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{rule(k)[0]}'" for k in ORDER) + " END"
_TITLE = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{rule(k)[1]}'" for k in ORDER) + " END"
_T = f"WITH t AS (SELECT *, {_WHO} AS who, replace(event_source, '.amazonaws.com', '') AS service, {_RULE} AS rule FROM ({duck(TRAIL)})) "


def _on(f):
    return lambda spark, sf_dir: f(derived(spark, sf_dir, TRAIL))


QUERIES = {
    "trail_parse": _on(parse),
    "trail_who": _on(lambda e: e.groupBy(who().alias("who"), "id_type").agg(F.count("*").alias("events"))),
    "trail_resources": _on(lambda e: e.select("event_id", resources().alias("resources"))),
    "trail_alerts": _on(alerts),
    "trail_alert_counts": _on(alert_counts),
    "trail_search": _on(lambda e: search(e, "2024-01-05", "2024-01-20", limit=200, writes_only=True, security_only=True)),
    "trail_denied_explain": _on(explain_denied),
    "trail_denied_summary": _on(denied_summary),
    "trail_dedupe": _on(lambda e: dedupe(e.unionByName(e.where("event_id % 3 = 0"))).groupBy("event_name").agg(F.count("*").alias("events"))),
}
_PARAM = "(name|id|ids|arn|bucket|key)$"
ORACLES = {
    "trail_parse": _T + "SELECT event_id, event_time, event_name AS name, service, who, id_type AS who_type, region, coalesce(error_code, '') AS error, read_only FROM t",
    "trail_who": _T + "SELECT who, id_type, count(*) AS events FROM t GROUP BY ALL",
    "trail_resources": _T + f", p AS (SELECT event_id, i, k, json_extract_string(request, '$.' || k) AS v, json_type(request, '$.' || k) AS y FROM (SELECT event_id, request, unnest(json_keys(request)) AS k, generate_subscripts(json_keys(request), 1) AS i FROM t)), q AS (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY i) AS i FROM p WHERE regexp_matches(lower(k), '{_PARAM}') AND y NOT IN ('OBJECT', 'ARRAY', 'BOOLEAN')) SELECT t.event_id, coalesce(string_agg(v, ', ' ORDER BY i) FILTER (WHERE i <= 2), '') AS resources FROM t LEFT JOIN q USING (event_id) GROUP BY t.event_id",
    "trail_alerts": _T + f"SELECT event_id, rule, {_SEVERITY} AS severity, {_TITLE} AS title, who FROM t WHERE rule IS NOT NULL",
    "trail_alert_counts": _T + f"SELECT rule, {_SEVERITY} AS severity, count(*) AS events, count(DISTINCT who) AS actors, min(event_time) AS first_time, max(event_time) AS last_time FROM t WHERE rule IS NOT NULL GROUP BY rule",
    "trail_search": _T + "SELECT event_id, event_time, event_name AS name, service, who, id_type AS who_type, region, coalesce(error_code, '') AS error, read_only FROM t WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-20' AND NOT read_only AND rule IS NOT NULL ORDER BY event_time DESC, event_id DESC LIMIT 200",
    "trail_denied_explain": _T + r"""SELECT event_id, regexp_extract(error_message, 'not authorized to perform: (\S+)', 1) AS permission, trim(regexp_extract(error_message, 'on resource: (\S+)', 1), '"') AS resource, rtrim(regexp_extract(error_message, 'because (.+)$', 1), '.') AS why FROM t WHERE error_message <> ''""",
    "trail_denied_summary": _T + f"SELECT who, service || ':' || event_name AS action, count(*) AS calls, max(event_time) AS last_time, arg_max(error_message, (event_time, event_id)) AS last_message FROM t WHERE regexp_matches(lower(error_code), '{DENIED}') GROUP BY ALL",
    "trail_dedupe": _T + "SELECT event_name, count(*) AS events FROM t GROUP BY ALL",
}
