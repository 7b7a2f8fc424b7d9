"""Cloud tables derived from the given ones by plain arithmetic, as SQL that Spark and DuckDB both run.

``$name`` stands for a given table. Production users pass their own DataFrames to the operators; these are for the
registered queries, whose work so grows with the given tables.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an adapter over the tables of one folder."""

    def view(m: re.Match) -> str:
        name = f"given_{zlib.crc32(sf_dir.encode())}_{m[1]}"
        if not spark.catalog.tableExists(name):
            spark.read.parquet(f"{sf_dir}/{m[1]}.parquet").createOrReplaceTempView(name)
        return name

    return spark.sql(re.sub(r"\$(\w+)", view, sql))


def duck(sql: str) -> str:
    return re.sub(r"\$(\w+)", r"\1", sql)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {name}({columns})"


_CALLS = [
    ("ConsoleLogin", "signin", '{"name":"x"}'), ("StopLogging", "cloudtrail", '{"name":"main-trail"}'), ("PutConfigurationRecorder", "config", "{}"), ("DisableKey", "kms", '{"keyId":"k-1"}'),
    ("UpdateDetector", "guardduty", '{"detectorId":"d","enable":false}'), ("ModifySnapshotAttribute", "ec2", '{"snapshotId":"snap-1","createVolumePermission":{"add":{"items":[{"group": "all"}]}}}'),
    ("PutPublicAccessBlock", "s3", '{"bucketName":"b1","PublicAccessBlockConfiguration":{"BlockPublicAcls":false}}'), ("AttachRolePolicy", "iam", '{"roleName":"r1","policyArn":"arn:aws:iam::aws:policy/P"}'),
    ("CreateAccessKey", "iam", '{"userName":"u1"}'), ("MoveAccount", "organizations", '{"accountId":"111122223333"}'), ("PutBucketPolicy", "s3", '{"bucketName":"b2"}'), ("GetObject", "s3", '{"bucketName":"b3","key":"a/b.txt"}'),
    ("ListBuckets", "s3", "{}"), ("DescribeInstances", "ec2", '{"maxResults":5}'), ("AuthorizeSecurityGroupIngress", "ec2", '{"groupId":"sg-1"}'), ("CreateNetworkAclEntry", "ec2", '{"networkAclId":"acl-1"}'),
    ("AttachInternetGateway", "ec2", '{"internetGatewayId":"igw-1","vpcId":"vpc-1"}'), ("ReplaceRoute", "ec2", '{"routeTableId":"rtb-1"}'), ("CreateVpc", "ec2", '{"cidrBlock":"10.0.0.0/16"}'), ("AssumeRole", "sts", '{"roleArn":"arn:aws:iam::111122223333:role/app","roleSessionName":"s1"}'),
    ("Invoke20150331", "lambda", '{"functionName":"fn"}'), ("GetItem", "dynamodb", '{"tableName":"t1"}'), ("PutParameter", "ssm", '{"name":"/p/q"}'),
]

#: One row per given event: its record, identity and texts as a trail has them.
TRAIL = f"""
SELECT e.event_id, e.ts AS event_time, e.user_id, c.name AS event_name, c.source || '.amazonaws.com' AS event_source, c.request AS request,
  CASE e.user_id % 7 WHEN 0 THEN 'Root' WHEN 1 THEN 'IAMUser' WHEN 2 THEN 'AssumedRole' WHEN 3 THEN 'AssumedRole' WHEN 4 THEN 'AWSService' WHEN 5 THEN 'AWSAccount' ELSE 'FederatedUser' END AS id_type,
  CASE e.user_id % 7 WHEN 0 THEN 'arn:aws:iam::111122223333:root' WHEN 1 THEN 'arn:aws:iam::111122223333:user/team/u' || CAST(e.user_id AS VARCHAR(20))
    WHEN 2 THEN 'arn:aws:sts::111122223333:assumed-role/role' || CAST(e.user_id AS VARCHAR(20)) || '/s' || CAST(e.event_id % 5 AS VARCHAR(20))
    WHEN 3 THEN 'arn:aws:sts::444455556666:assumed-role/AWSReservedSSO_Admin' || CAST(e.user_id AS VARCHAR(20)) || '_0123abcd/me@example.com'
    WHEN 6 THEN 'arn:aws:sts::111122223333:federated-user/f' || CAST(e.user_id AS VARCHAR(20)) END AS id_arn,
  CASE WHEN e.user_id % 7 = 1 AND e.user_id % 2 = 0 THEN 'u' || CAST(e.user_id AS VARCHAR(20)) END AS id_user,
  CASE WHEN e.user_id % 7 = 4 THEN 'svc' || CAST(e.user_id AS VARCHAR(20)) || '.amazonaws.com' WHEN e.user_id % 7 = 0 AND e.event_id % 4 = 0 THEN 'support.amazonaws.com' END AS id_invoked_by,
  CASE WHEN e.user_id % 7 = 3 THEN '444455556666' WHEN e.user_id % 7 <> 4 THEN '111122223333' END AS id_account,
  'AwsApiCall' AS event_type,
  CASE WHEN e.event_type = 'error' THEN CASE e.event_id % 3 WHEN 0 THEN 'AccessDenied' WHEN 1 THEN 'Client.UnauthorizedOperation' ELSE 'ThrottlingException' END END AS error_code,
  CASE WHEN e.event_type = 'error' THEN CASE e.event_id % 3 WHEN 0 THEN 'User: x is not authorized to perform: ' || c.source || ':' || c.name || ' on resource: "arn:aws:x:::r' || CAST(e.event_id % 9 AS VARCHAR(20)) || '" because no identity-based policy allows it.'
    WHEN 1 THEN 'You are not authorized to perform: ' || c.source || ':' || c.name ELSE 'Rate exceeded' END END AS error_message,
  CASE WHEN c.name = 'ConsoleLogin' THEN CASE WHEN e.event_type = 'error' THEN 'Failure' ELSE 'Success' END END AS login_result,
  CASE WHEN c.name = 'ConsoleLogin' THEN CASE WHEN e.event_id % 2 = 0 THEN 'Yes' ELSE 'No' END END AS mfa_used,
  CASE e.event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' ELSE 'ap-south-1' END AS region,
  c.name LIKE 'Get%' OR c.name LIKE 'List%' OR c.name LIKE 'Describe%' AS read_only
FROM $events e JOIN {values("c", "k, name, source, request", [(i, *r) for i, r in enumerate(_CALLS)])} ON e.event_id % {len(_CALLS)} = c.k
"""

_ACTIONS = ["*", "s3:*", "iam:*", "s3:Get*,s3:List*", "iam:PassRole,ec2:RunInstances", "iam:Create*", "lambda:UpdateFunctionCode,lambda:CreateFunction", "ec2:Describe*", "cloudtrail:StopLogging,guardduty:*", "dynamodb:GetItem,kms:Decrypt", "s3:DeleteBucket,iam:DeleteR?le", "sts:AssumeRole", "sts:AssumeRoleWithWebIdentity", "logs:*", "", "iam:passrole"]
_RESOURCES = ["*", "arn:aws:s3:::my-bucket/*", "arn:aws:iam::111122223333:role/*", "arn:aws:s3:::*", "arn:aws:iam::111122223333:role/app", "arn:aws:ec2:us-east-1:111122223333:instance/i-1,arn:aws:*:*:*:*", "arn:aws:dynamodb:*:111122223333:table/t", "arn:aws:lambda:eu-west-1:111122223333:function:*", "arn:aws:sns:eu-west-1:111122223333:a*", "arn:aws:x*"]
_CONDITIONS = [
    (None, None, None), (None, None, None), (None, None, None), ("StringEquals", "aws:PrincipalOrgID", "o-1"), ("StringLike", "aws:PrincipalArn", "*"), ("StringNotEquals", "aws:SourceAccount", "111122223333"), ("StringLike", "token.actions.githubusercontent.com:sub", "repo:*/app:*"),
    ("StringLike", "token.actions.githubusercontent.com:sub", "repo:my-org/*"), ("StringEquals", "token.actions.githubusercontent.com:aud", "sts.amazonaws.com"), ("IpAddress", "aws:SourceIp", "8.0.0.0/8,203.0.113.0/24"), ("StringEqualsIfExists", "aws:SourceArn", "arn:aws:s3:::b"), ("StringEquals", "sts:ExternalId", "x1"),
    ("StringEquals", "iam:PassedToService", "ec2.amazonaws.com"), ("Bool", "aws:SecureTransport", "true"), ("ArnLike", "aws:SourceArn", "arn:aws:sns:*:111122223333:t"),
]
#: Policy documents of four statements each; lists are comma-joined, an absent element is NULL.
POLICY = f"""
SELECT q.policy_id, q.stmt, q.sid, CASE q.policy_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2008-10-17' ELSE '2012-10-17' END AS version,
  CASE q.k % 11 WHEN 3 THEN 'Deny' WHEN 7 THEN 'allow' WHEN 9 THEN 'Permit' ELSE 'Allow' END AS effect,
  CASE WHEN q.k % 13 <> 5 THEN a.actions END AS actions, CASE WHEN q.k % 13 = 5 THEN 'iam:Create*,ec2:*' END AS not_actions,
  CASE WHEN q.policy_id % 9 = 8 THEN NULL WHEN q.k % 17 <> 6 THEN r.resources END AS resources, CASE WHEN q.k % 17 = 6 AND q.policy_id % 9 <> 8 THEN 'arn:aws:s3:::keep' END AS not_resources,
  CASE WHEN q.policy_id % 9 = 5 THEN CASE WHEN q.k % 2 = 0 THEN '*' ELSE 'arn:aws:iam::444455556666:root,111122223333' END WHEN q.policy_id % 9 = 8 THEN CASE q.k % 3 WHEN 0 THEN '*' WHEN 1 THEN 'arn:aws:iam::999988887777:role/x' END END AS aws,
  CASE WHEN q.policy_id % 9 = 6 THEN 'sns.amazonaws.com' END AS services,
  CASE WHEN q.policy_id % 9 = 7 THEN CASE WHEN q.k % 2 = 0 THEN 'arn:aws:iam::111122223333:oidc-provider/token.actions.githubusercontent.com' ELSE 'arn:aws:iam::111122223333:saml-provider/corp' END END AS federated,
  q.policy_id % 9 >= 5 AS has_principal, q.policy_id % 9 = 6 AND q.k % 4 = 1 AS not_principal,
  c.op AS cond_op, c.ck AS cond_key, c.vals AS cond_values
FROM (SELECT p_partkey AS k, CAST(FLOOR(p_partkey / 4.0) AS BIGINT) AS policy_id, p_partkey % 4 AS stmt, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'A' ELSE 'S' || CAST(p_partkey % 4 AS VARCHAR(9)) END AS sid, p_size FROM $part) q
JOIN {values("a", "ak, actions", list(enumerate(_ACTIONS)))} ON CASE WHEN q.policy_id % 9 = 8 THEN 11 + q.k % 2 ELSE (q.k * 7 + q.p_size) % {len(_ACTIONS)} END = a.ak
JOIN {values("r", "rk, resources", list(enumerate(_RESOURCES)))} ON (q.k + q.p_size) % {len(_RESOURCES)} = r.rk
JOIN {values("c", "cc, op, ck, vals", [(i, *x) for i, x in enumerate(_CONDITIONS)])} ON (q.k + 3 * q.p_size) % {len(_CONDITIONS)} = c.cc
"""

_TYPES = [(0, "aws_db_instance"), (1, "aws_s3_bucket"), (2, "aws_instance"), (3, "aws_vpc"), (4, "aws_kms_key")]
#: Planned changes out of orders.
CHANGES_SQL = f"""
SELECT t.type || '.r' || CAST(o.o_orderkey AS VARCHAR(20)) AS address, t.type, o.o_custkey % 9 AS plan_id, CASE o.o_orderkey % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'delete,create' WHEN 2 THEN 'create,delete' WHEN 3 THEN 'update' WHEN 4 THEN 'delete' WHEN 5 THEN 'no-op' ELSE 'read' END AS acts,
  CASE WHEN o.o_orderkey % 7 <> 0 THEN '{{"size":"' || CAST(o.o_custkey % 5 AS VARCHAR(9)) || '","acl":"private"}}' END AS before,
  CASE WHEN o.o_orderkey % 7 <> 4 THEN '{{"size":"' || CAST((o.o_custkey + o.o_orderkey % 2) % 5 AS VARCHAR(9)) || '","acl":"' || CASE WHEN o.o_orderkey % 6 = 0 THEN 'public-read' ELSE 'private' END || '","publicly_accessible":"' || CASE WHEN t.k = 0 AND o.o_orderkey % 4 = 0 THEN 'true' ELSE 'false' END || '","storage_encrypted":"' || CASE WHEN o.o_orderkey % 5 = 0 THEN 'false' ELSE 'true' END || '"}}' END AS after, o.o_orderkey % 8 = 0 AS arn_unknown
FROM $orders o JOIN {values("t", "k, type", _TYPES)} ON o.o_custkey % 5 = t.k
"""
