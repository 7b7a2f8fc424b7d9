"""Permissions that a call needs besides its own: roles passed to a service, session tags, a source identity.

Where a call's parameters hold a role is a table of places. Events meet it by service and call, and a place is read from
the parameters as the table says, a key, a key inside an object, or a key in each item of a list; the same words
elsewhere, in a tag or a variable, aren't roles being passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck

# Service, call, places of roles, and the service that gets them where that is one.
PASSED = [
    ("lambda", "CreateFunction", ("role",), "lambda"), ("lambda", "UpdateFunctionConfiguration", ("role",), "lambda"), ("ecs", "RegisterTaskDefinition", ("taskRoleArn", "executionRoleArn"), "ecs-tasks"), ("cloudformation", "CreateStack", ("roleARN",), "cloudformation"),
    ("cloudformation", "UpdateStack", ("roleARN",), "cloudformation"), ("cloudformation", "CreateChangeSet", ("roleARN",), "cloudformation"), ("states", "CreateStateMachine", ("roleArn",), "states"), ("states", "UpdateStateMachine", ("roleArn",), "states"), ("glue", "CreateJob", ("role",), "glue"),
    ("glue", "CreateCrawler", ("role",), "glue"), ("codebuild", "CreateProject", ("serviceRole",), "codebuild"), ("codebuild", "UpdateProject", ("serviceRole",), "codebuild"), ("events", "PutTargets", ("targets[].roleArn",), "events"), ("eks", "CreateCluster", ("roleArn",), "eks"), ("eks", "CreateNodegroup", ("nodeRole",), None),
    ("sagemaker", "CreateNotebookInstance", ("roleArn",), "sagemaker"), ("sagemaker", "CreateTrainingJob", ("roleArn",), "sagemaker"), ("config", "PutConfigurationRecorder", ("configurationRecorder.roleARN",), "config"), ("logs", "PutSubscriptionFilter", ("roleArn",), None), ("iam", "AddRoleToInstanceProfile", ("roleName",), None),
]
#: These pass a role inside an instance profile, which the event doesn't name.
PROFILES = ("RunInstances", "AssociateIamInstanceProfile", "ReplaceIamInstanceProfileAssociation")


def literal(name: Column) -> Column:
    """Wildcards and variables of a name written as plain characters."""
    return F.regexp_replace(name, r"([*?$])", r"\${$1}")


def places(spark) -> DataFrame:
    """prefix, call, listed (path to a list or null), place, service."""
    rows = [(s, c, "$." + p.split("[].")[0] if "[]" in p else None, p.split("[].")[-1] if "[]" in p else "$." + p, f"{to}.amazonaws.com" if to else None) for s, c, ps, to in PASSED for p in ps]
    return spark.createDataFrame(rows, "prefix string, call string, listed string, place string, service string")


def implied(events: DataFrame) -> DataFrame:
    """event_id, action, resource, service: what each event (event_id, prefix, call, request, partition, account) needs
    besides. A role given by name is one of the account; anything else at the place is none."""
    at = events.join(F.broadcast(places(events.sparkSession)), ["prefix", "call"])
    items = F.expr("from_json(get_json_object(request, listed), 'array<map<string,string>>')")
    values = F.when(F.col("listed").isNull(), F.array(F.expr("get_json_object(request, CASE WHEN listed IS NULL THEN place ELSE '$' END)"))).otherwise(F.transform(items, lambda m: F.element_at(m, F.col("place"))))
    role = lambda v: F.when(v.rlike(r"^arn:[\w-]+:iam::\d{12}:role/"), literal(v)).when(v.rlike(r"^[\w+=,.@-]{1,128}$"), F.concat(F.lit("arn:"), "partition", F.lit(":iam::"), "account", F.lit(":role/"), v))
    passed = at.select("event_id", "service", F.explode(F.filter(F.transform(values, role), lambda r: r.isNotNull())).alias("resource")).select("event_id", F.lit("iam:PassRole").alias("action"), "resource", "service").distinct()
    given = lambda k: F.coalesce(~F.get_json_object("request", f"$.{k}").isin("", "{}", "[]", "false", "0"), F.lit(False))
    profiled = events.where((F.col("prefix") == "ec2") & F.col("call").isin(*PROFILES) & (given("iamInstanceProfile") | (F.col("call") != "RunInstances")))
    in_profile = profiled.select("event_id", F.lit("iam:PassRole").alias("action"), F.lit("*").alias("resource"), F.lit("ec2.amazonaws.com").alias("service"))
    arn = F.get_json_object("request", "$.roleArn")
    target = F.when(arn.startswith("arn:") & arn.contains(":role/"), literal(arn)).otherwise("*")
    extras = F.filter(F.array(F.when(given("tags") | given("transitiveTagKeys"), "sts:TagSession"), F.when(given("sourceIdentity"), "sts:SetSourceIdentity")), lambda a: a.isNotNull())
    assumed = events.where("prefix = 'sts' AND call = 'AssumeRole'").select("event_id", F.explode(extras).alias("action"), target.alias("resource"), F.lit(None).cast("string").alias("service"))
    return passed.unionByName(in_profile).unionByName(assumed)


# Queries and their SQL

_ROLE = "arn:aws:iam::111122223333:role/r"
#: prefix, call, request, and what it needs: (action, resource, service).
_CASES = [
    ("lambda", "CreateFunction", f'{{"role":"{_ROLE}","tags":{{"role":"arn:aws:iam::111122223333:role/admin"}}}}', [("iam:PassRole", _ROLE, "lambda.amazonaws.com")]), ("lambda", "UpdateFunctionConfiguration", '{"environment":{"variables":{"role":"x"}}}', []), ("ecs", "RegisterTaskDefinition", f'{{"taskRoleArn":"{_ROLE}","executionRoleArn":"exec"}}', [("iam:PassRole", _ROLE, "ecs-tasks.amazonaws.com"), ("iam:PassRole", "arn:aws:iam::111122223333:role/exec", "ecs-tasks.amazonaws.com")]),
    ("ecs", "RegisterTaskDefinition", f'{{"taskRoleArn":"{_ROLE}","executionRoleArn":"{_ROLE}"}}', [("iam:PassRole", _ROLE, "ecs-tasks.amazonaws.com")]), ("cloudformation", "CreateStack", '{"roleARN":"not a role!"}', []), ("events", "PutTargets", f'{{"roleArn":"x","targets":[{{"id":1,"roleArn":"{_ROLE}"}},{{"id":2}},{{"roleArn":"two"}}]}}', [("iam:PassRole", _ROLE, "events.amazonaws.com"), ("iam:PassRole", "arn:aws:iam::111122223333:role/two", "events.amazonaws.com")]),
    ("events", "PutTargets", '{"roleArn":"x","targets":[{"id":1}]}', []), ("config", "PutConfigurationRecorder", f'{{"configurationRecorder":{{"roleARN":"{_ROLE}"}}}}', [("iam:PassRole", _ROLE, "config.amazonaws.com")]), ("eks", "CreateNodegroup", '{"nodeRole":"n"}', [("iam:PassRole", "arn:aws:iam::111122223333:role/n", None)]), ("iam", "AddRoleToInstanceProfile", '{"roleName":"web","instanceProfileName":"p"}', [("iam:PassRole", "arn:aws:iam::111122223333:role/web", None)]),
    ("states", "CreateStateMachine", '{"roleArn":"arn:aws:iam::111122223333:role/a*b"}', [("iam:PassRole", "arn:aws:iam::111122223333:role/a${*}b", "states.amazonaws.com")]), ("ec2", "RunInstances", '{"instanceType":"t3"}', []), ("ec2", "RunInstances", '{"iamInstanceProfile":{"name":"w"}}', [("iam:PassRole", "*", "ec2.amazonaws.com")]), ("ec2", "AssociateIamInstanceProfile", "{}", [("iam:PassRole", "*", "ec2.amazonaws.com")]),
    ("sts", "AssumeRole", f'{{"roleArn":"{_ROLE}","tags":[{{"key":"k"}}],"sourceIdentity":"me"}}', [("sts:TagSession", _ROLE, None), ("sts:SetSourceIdentity", _ROLE, None)]), ("sts", "AssumeRole", '{"tags":[],"transitiveTagKeys":["k"]}', [("sts:TagSession", "*", None)]), ("sts", "AssumeRole", f'{{"roleArn":"{_ROLE}"}}', []), ("s3", "GetObject", f'{{"role":"{_ROLE}"}}', []), ("lambda", "CreateFunction", "not json", []),
    ("glue", "CreateJob", '{"role":["x"]}', []), ("logs", "PutSubscriptionFilter", f'{{"roleArn":"{_ROLE}"}}', [("iam:PassRole", _ROLE, None)]),
]
_pick = lambda i: "CASE event_id % " + str(len(_CASES)) + " " + " ".join(f"WHEN {k} THEN '{c[i]}'" for k, c in enumerate(_CASES)) + " END"
EVENTS = f"SELECT event_id, {_pick(0)} AS prefix, {_pick(1)} AS call, {_pick(2)} AS request, 'aws' AS partition_, '111122223333' AS account FROM $events"
QUERIES = {"lp_implied": lambda spark, sf_dir: implied(derived(spark, sf_dir, EVENTS).withColumnRenamed("partition_", "partition"))}
_text = lambda x: "NULL" if x is None else f"'{x}'"
_NEEDS = ", ".join(f"({k}, {', '.join(map(_text, need))})" for k, c in enumerate(_CASES) for need in c[3])
ORACLES = {"lp_implied": f"SELECT e.event_id, n.action, n.resource, n.service FROM events e JOIN (VALUES {_NEEDS}) AS n(k, action, resource, service) ON e.event_id % {len(_CASES)} = n.k"}
