"""Statements against requests: resource patterns, variables, and results with three values.

A result is true, false or null (it depends on what the request doesn't tell). A context is a map from a lower-case key
to its values; a key with no value is known to be absent, a missing key is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from ..functions.rounds import settled
from ..functions.wild import STAR, arn_match, wild_match
from .conditions import CONDITION, VARIABLE, VERSION, all_of, condition, filled
from .conditions import any_of as three


def substitute(text: Column, context: Column, version: Column) -> Column:
    """The text with its variables filled in; null where a key has no value and no default."""
    return filled(text, context, version)["text"]


def both(*values: Column) -> Column:
    """Kleene AND, as SQL has it."""
    out = values[0]
    for v in values[1:]:
        out = out & v
    return out


def pattern_request(pattern: Column, request: Column) -> Column:
    """A pattern against a request resource that is a prefix and a star: true if it covers all that the request may mean,
    false if it covers none of it, else null. A pattern is decided where it, too, has no wildcard but a star at its end."""
    stem, bare = F.regexp_replace(pattern, r"\*+$", ""), F.regexp_replace(request, r"\*+$", "")
    simple = ~stem.rlike(r"[*?]") & ~bare.rlike(r"[*?]")
    open_ = pattern.endswith("*")
    apart = ~bare.startswith(stem) & ~stem.startswith(bare)
    covered = F.when(open_ & bare.startswith(stem), True).when(apart | (~open_ & ~stem.startswith(bare)), False)
    return F.when(pattern.rlike(r"^\*+$"), True).when(simple, covered)


def resource_match(patterns: Column, resource: Column, context: Column, version: Column) -> Column:
    def one(f: Column) -> Column:
        p = f["text"]
        return (
            F.when(f["absent"], False).when(f["unknown"], None).when(p.rlike(r"^\*+$"), True).when(resource.isNull(), None)
            .when(resource.rlike(r"[*?]"), pattern_request(p, resource)).otherwise(arn_match(p, resource))
        )

    return three(F.transform(F.transform(patterns, lambda p: filled(F.trim(p), context, version)), one))


#: What a context tells about the caller.
CALLER = ("aws:principalarn", "aws:principalaccount", "aws:principalservicename")


def principal_match(principals: Column, caller: Column) -> Column:
    """Principals are (type, who), the caller is (arn, account, servicename). Account numbers and root ARNs stand for their
    account; a caller that isn't told is unknown, and a told caller that isn't a service is none."""
    arn, account, service = (caller[k.removeprefix("aws:principal")] for k in CALLER)

    def one(p: Column) -> Column:
        who = p["who"]
        of = F.when(who.rlike(r"^\d{12}$"), who).when(who.endswith(":root"), F.get(F.split(who, ":"), 4))
        named = F.when(p["type"] == "Service", F.when(service.isNotNull(), who == service).when(arn.isNotNull(), False))
        return named.when(p["type"] == "Service", None).when((p["type"] == "AWS") & of.isNotNull(), of == account).otherwise(who == arn)

    anyone = F.exists(principals, lambda p: (p["type"] == "AWS") & (p["who"] == "*"))
    return F.when(anyone, True).otherwise(three(F.transform(principals, one)))


#: An element that is left out is null, an empty list is there and matches nothing.
STATEMENT = f"policy, stmt, effect, version, actions, not_actions, resources, not_resources array<string>, principals, not_principals array<struct<type:string,who:string>>, conditions array<{CONDITION}>"


def _variables(texts: Column) -> Column:
    """The keys that variables in texts name."""
    name = lambda n: F.lower(F.trim(F.substring_index(F.trim(n), ",", 1)))
    return F.flatten(F.transform(F.array_compact(F.coalesce(texts, F.array().cast("array<string>"))), lambda t: F.transform(F.regexp_extract_all(t, F.lit(VARIABLE), F.lit(1)), name)))


def _answered(questions: DataFrame, name: str, answer: Column, content: DataFrame | None = None) -> DataFrame:
    """(name, answer) of each different question; equal ones are asked once, beside the content that they are of."""
    asked = questions.select(name).distinct().repartition(F.xxhash64(name))
    if content is not None:
        asked = asked.join(content, F.col(f"{name}.of") == F.col("of"))
    return asked.select(name, answer.alias("answer"))


def evaluate(requests: DataFrame, statements: DataFrame) -> DataFrame:
    """Each request (request, policy, action, resource, context) against the statements of its policy (``STATEMENT``): the
    result, its parts, and what a null result depends on. A statement whose effect is neither Allow nor Deny, that has
    neither Action nor NotAction, or a condition with an unknown operator, has an error and applies to nothing.

    Each part of a statement, and each condition, is a question that holds what of the request decides on it: of the context
    only the keys that are named there. Equal questions are asked once, so that patterns are read and tried for different
    questions, not for each request; rows with their questions, which hold a digest of the statement's part, are written once."""
    keys = lambda *arrays: F.array_distinct(F.array_compact(F.concat(*arrays)))
    named = lambda c: F.concat(F.array(F.lower(c["key"])), _variables(c["values"]))
    conditions = F.coalesce("conditions", F.array().cast(f"array<{CONDITION}>"))
    s = statements.withColumn("conditions", conditions).withColumns({"resource_keys": keys(_variables(F.col("resources")), _variables(F.col("not_resources"))), "condition_keys": keys(F.flatten(F.transform("conditions", named)))})
    held = {"action": ("actions", "not_actions"), "resource": ("resources", "not_resources", "version", "resource_keys"), "principal": ("principals", "not_principals"), "list": ("conditions", "version", "condition_keys")}
    s = s.withColumns({f"of_{k}": F.sha2(F.to_json(F.struct(*c)), 256) for k, c in held.items()})
    content = {k: s.select(F.col(f"of_{k}").alias("of"), *c).dropDuplicates(["of"]) for k, c in held.items()}
    told = lambda names, context: F.transform(names, lambda k: F.element_at(context, k))
    known = lambda k: F.get(F.element_at("context", k), 0).alias(k.removeprefix("aws:principal"))
    j = requests.repartition("policy").join(s, "policy").select(
        "request", "policy", "stmt", F.initcap(F.trim("effect")).alias("effect"), F.struct(F.col("of_action").alias("of"), "action").alias("q_action"), F.struct(F.col("of_resource").alias("of"), "resource", told("resource_keys", "context").alias("told")).alias("q_resource"),
        F.struct(F.col("of_principal").alias("of"), *(known(k) for k in CALLER)).alias("q_principal"), F.struct(F.col("of_list").alias("of"), told("condition_keys", "context").alias("told")).alias("q_list"),
    )
    j = settled(j)
    either = lambda yes, no, meets: F.when(F.col(yes).isNotNull(), meets(F.col(yes))).when(F.col(no).isNotNull(), ~meets(F.col(no)))
    context = lambda names, q: F.map_from_arrays(F.col(names), F.col(f"{q}.told"))
    answers = {
        "action": either("actions", "not_actions", lambda c: F.exists(c, lambda p: wild_match(F.lower(F.trim(p)), F.lower("q_action.action")))),
        "resource": either("resources", "not_resources", lambda c: resource_match(c, F.col("q_resource.resource"), context("resource_keys", "q_resource"), F.col("version"))).otherwise(True),
        "principal": either("principals", "not_principals", lambda c: principal_match(c, F.col("q_principal"))).otherwise(True),
    }
    parts = j
    for part, answer in answers.items():
        parts = parts.join(_answered(j, f"q_{part}", answer, content[part]).withColumnRenamed("answer", f"{part}_match"), f"q_{part}")
    one = lambda c: F.struct(c["op"].alias("op"), c["key"].alias("key"), c["values"].alias("values"), "version", keys(named(c)).alias("names"), told(keys(named(c)), "context").alias("told"))
    lists = _answered(j, "q_list", F.struct("conditions", "version", context("condition_keys", "q_list").alias("context")), content["list"])
    lists = settled(lists.select("q_list", "answer.*").select("q_list", F.transform("conditions", one).alias("qs")))
    each = lists.select("q_list", F.posexplode_outer("qs").alias("at", "q_one"))
    is_ = condition(F.col("q_one.op"), F.col("q_one.key"), F.col("q_one.values"), F.map_from_arrays("q_one.names", "q_one.told"), F.col("q_one.version"))
    met = each.join(_answered(each.where("q_one IS NOT NULL"), "q_one", F.struct(F.lower("q_one.key").alias("key"), is_.alias("is"))), "q_one", "left")
    met = met.groupBy("q_list").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "answer")))).alias("told")).withColumn("told", F.col("told.answer"))
    wrong = F.get(F.filter(F.transform("told", lambda c: c["is"]["error"]), lambda e: e.isNotNull()), 0)
    met = met.select("q_list", wrong.alias("wrong"), all_of(F.transform("told", lambda c: c["is"]["result"])).alias("condition_match"), F.transform(F.filter("told", lambda c: c["is"]["result"].isNull()), lambda c: c["key"]).alias("asks"))
    parts = parts.join(met, "q_list")
    error = F.when(~F.col("effect").isin("Allow", "Deny"), "effect").when(F.col("action_match").isNull(), "action").otherwise(F.col("wrong"))
    result = both(F.col("action_match"), F.col("resource_match"), F.col("principal_match"), F.col("condition_match"))
    parts = parts.withColumn("error", error).withColumn("result", F.when(F.col("error").isNull(), result).otherwise(False))
    open_ = F.concat(
        F.when(F.col("resource_match").isNull(), F.array(F.lit("resource"))).otherwise(F.array().cast("array<string>")), F.when(F.col("principal_match").isNull(), F.array(F.lit("aws:principalarn"))).otherwise(F.array().cast("array<string>")), "asks",
    )
    depends = F.when(F.col("result").isNull(), F.array_join(F.array_sort(F.array_distinct(open_)), ","))
    return parts.select("request", "policy", "stmt", "effect", "action_match", "resource_match", "principal_match", "error", "condition_match", "result", depends.alias("depends_on"))


# Queries and their SQL

#: Statements of one policy for each tenth order; requests meet the policy of their supplier.
_PATTERNS = [
    "*", "arn:aws:s3:::team-${aws:username}/*", "arn:aws:s3:::prod-*", "arn:aws:iam::*:role/app", "arn:aws:ec2:*:111122223333:instance/*", "arn:aws:s3:::${aws:missing, 'shared'}/x", "arn:aws:s3:::${aws:missing}/x", "arn:aws:sns:eu-?-1:111122223333:a*", "arn:aws:s3*",
]
_RESOURCES = ["arn:aws:s3:::team-u1/a", "arn:aws:s3:::prod-x/k", "arn:aws:iam::111122223333:role/app", "arn:aws:ec2:us-east-1:111122223333:instance/i-1", "arn:aws:s3:::shared/x", "arn:aws:sns:eu-w-1:111122223333:abc", "arn:aws:s3:::prod-*", "arn:aws:s3:::p*", "arn:aws:sqs:::q*", None]


def _pick(expr: str, options: list[str | None]) -> str:
    cell = lambda x: "CAST(NULL AS VARCHAR(99))" if x is None else "'" + x.replace("'", "''") + "'"
    return f"CASE {expr} % {len(options)} " + " ".join(f"WHEN {i} THEN {cell(x)}" for i, x in enumerate(options)) + " END"


#: (operator, key, values, the result in SQL: 2 true, 1 unknown, 0 false): each is worked out from the rule by hand.
_TAGS = "CASE WHEN tags IS NULL THEN 1 WHEN tags = '' THEN {absent} WHEN {test} THEN 2 ELSE 0 END"
_ONE_KEY = "CASE WHEN {col} IS NULL THEN 1 WHEN {test} THEN 2 ELSE 0 END"
_IP = "coalesce(ip LIKE '10.%' AND TRY_CAST(split_part(ip, '.', 2) AS INT) < 16, false)"
_CONDITIONS = [
    ("StringEquals", "aws:username", "u1", _ONE_KEY.format(col="username", test="username = 'u1'")), ("StringNotEqualsIgnoreCase", "aws:UserName", "U1,x", _ONE_KEY.format(col="username", test="username <> 'u1'")), ("StringLike", "aws:username", "u?,*z", _ONE_KEY.format(col="username", test="username IN ('u1', 'u*')")),
    ("StringEquals", "aws:username", "${aws:username}", _ONE_KEY.format(col="username", test="version = '2012-10-17'")), ("StringLike", "aws:mfa", "${aws:username}", "CASE WHEN mfa IS NULL OR username IS NULL AND version = '2012-10-17' THEN 1 ELSE 0 END"), ("StringNotEquals", "aws:mfa", "${aws:absent},zz", _ONE_KEY.format(col="mfa", test="true")),
    ("ForAllValues:StringEquals", "aws:TagKeys", "a,b", _TAGS.format(absent=2, test="tags IN ('a,b', 'a')")), ("ForAnyValue:StringEquals", "aws:tagkeys", "c", _TAGS.format(absent=0, test="tags = 'a,c'")), ("ForAnyValue:StringNotEquals", "aws:tagkeys", "a", _TAGS.format(absent=0, test="tags <> 'a'")),
    ("StringEquals", "aws:tagkeys", "c", _TAGS.format(absent=0, test="tags = 'a,c'")), ("StringNotLike", "aws:tagkeys", "c*", _TAGS.format(absent=2, test="tags <> 'a,c'")), ("StringEqualsIfExists", "aws:tagkeys", "b", _TAGS.format(absent=2, test="tags = 'a,b'")), ("Null", "aws:tagkeys", "true", _TAGS.format(absent=2, test="false")), ("Null", "aws:absent", "false", "0"),
    ("IpAddress", "aws:SourceIp", "10.0.0.0/12,2001:db8::/32", _ONE_KEY.format(col="ip", test=f"{_IP} OR ip LIKE '2001:db8:%'")), ("NotIpAddress", "aws:sourceip", "10.0.0.0/12", _ONE_KEY.format(col="ip", test=f"NOT {_IP}")), ("NumericLessThan", "aws:age", "100", "CASE WHEN TRY_CAST(age AS DOUBLE) < 100 THEN 2 ELSE 0 END"), ("NumericNotEquals", "aws:age", "99.0", "CASE WHEN TRY_CAST(age AS DOUBLE) = 99 THEN 0 ELSE 2 END"),
    ("NumericGreaterThanEquals", "aws:age", "99,500", "CASE WHEN TRY_CAST(age AS DOUBLE) >= 99 THEN 2 ELSE 0 END"), ("DateGreaterThan", "aws:CurrentTime", "2020-06-01T00:00:00Z", "CASE WHEN moment > TIMESTAMP '2020-06-01 00:00:00' THEN 2 ELSE 0 END"), ("DateLessThanEquals", "aws:currenttime", "1590969600", "CASE WHEN moment <= TIMESTAMP '2020-06-01 00:00:00' THEN 2 ELSE 0 END"),
    ("Bool", "aws:mfa", "TRUE", _ONE_KEY.format(col="mfa", test="mfa = 'true'")), ("ArnLike", "aws:PrincipalArn", "arn:aws:iam::*:user/*", _ONE_KEY.format(col="caller", test="caller LIKE '%:user/%'")), ("ArnNotEquals", "aws:principalarn", "arn:aws:iam::*", _ONE_KEY.format(col="caller", test="false")), ("ArnEquals", "aws:principalarn", "arn:aws:*:user/u1", _ONE_KEY.format(col="caller", test="false")),
    ("BinaryEquals", "aws:mfa", "dHJ1ZQ==", _ONE_KEY.format(col="mfa", test="false")), ("StringEqualz", "aws:mfa", "true", "NULL"), ("NullIfExists", "aws:mfa", "true", "NULL"),
]
#: Statements of four to a policy, all parts; orders ask one policy each.
_POLICIES = "(SELECT CAST(floor(count(*) / 4) AS BIGINT) FROM $part)"
_STATEMENTS = f"""SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS policy, CAST(p_partkey AS BIGINT) AS stmt, {_pick('p_size', ['Allow', 'Deny', 'allow', 'Deny', 'Permit'])} AS effect,
{_pick('p_partkey', ['s3:*', '*', 'iam:PassRole', 'ec2:Start?nstances', '', 's3:*,iam:*', '*'])} AS action, {_pick('p_partkey', ['', '', '', '', 'ec2:*', '', ''])} AS not_action, {_pick('p_size', [*_PATTERNS, '*', '*'])} AS resource_pattern, p_size % 7 = 3 AS negated,
{_pick('p_partkey', ['', 'AWS *', 'AWS 111122223333', 'AWS arn:aws:iam::111122223333:user/u1', '', 'Service ec2.amazonaws.com', 'Federated arn:aws:iam::111122223333:user/u1', ''])} AS principal, p_size % 9 = 4 AS not_principal,
CAST(p_partkey * 5 % {len(_CONDITIONS) + 6} AS BIGINT) AS c1, CAST(p_size * 7 % {len(_CONDITIONS) + 20} AS BIGINT) AS c2, CASE WHEN p_size % 11 = 1 THEN '2008-10-17' ELSE '2012-10-17' END AS version FROM $part"""
_REQUESTS = f"""SELECT CAST(o_orderkey AS BIGINT) AS request, CAST(o_orderkey % {_POLICIES} AS BIGINT) AS policy, {_pick('o_orderkey', ['s3:GetObject', 'IAM:passrole', 'ec2:StartInstances'])} AS action, {_pick('o_orderkey', _RESOURCES)} AS resource,
{_pick('o_custkey', ['u1', 'u*', None])} AS username, {_pick('o_custkey', ['true', 'false', None, 'true'])} AS mfa, {_pick('o_orderkey', ['arn:aws:iam::111122223333:user/u1', None, 'arn:aws:iam::444455556666:role/r', 'arn:aws:iam::111122223333:user/u2'])} AS caller,
{_pick('o_custkey', ['a,b', 'a,c', 'a', '', None])} AS tags, {_pick('o_custkey', ['10.1.2.3', '10.200.0.1', '2001:db8:0:5::1', None, 'x'])} AS ip, {_pick('o_orderkey', ['99', '100.5', 'x', '7'])} AS age, o_orderdate AS moment FROM $orders"""


def _split(c: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.split(c, ","))


def _context() -> Column:
    pairs = [("aws:username", F.array("username")), ("aws:mfa", F.array("mfa")), ("aws:principalarn", F.array("caller")), ("aws:principalaccount", F.array(F.get(F.split("caller", ":"), 4))), ("aws:sourceip", F.array("ip")), ("aws:age", F.array("age")), ("aws:currenttime", F.array(F.date_format("moment", "yyyy-MM-dd'T'HH:mm:ss'Z'")))]
    told = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("v")) for k, v in pairs)), lambda x: F.get(x["v"], 0).isNotNull())
    none = F.array().cast("array<string>")
    tags = F.when(F.col("tags").isNull(), F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("aws:tagkeys"), F.when(F.col("tags") == "", none).otherwise(F.split("tags", ","))))
    return F.map_concat(F.map_from_entries(told), F.create_map(F.lit("aws:absent"), none), tags)


def _evaluated(spark, sf_dir):
    s = derived(spark, sf_dir, _STATEMENTS)
    named = F.when(F.col("principal") != "", F.array(F.struct(F.substring_index("principal", " ", 1).alias("type"), F.substring_index("principal", " ", -1).alias("who"))))
    pattern = F.array("resource_pattern")
    every = F.array(*(F.struct(F.lit(op).alias("op"), F.lit(key).alias("key"), F.split(F.lit(values), ",").alias("values")) for op, key, values, _ in _CONDITIONS))
    one = lambda c: F.get(every, F.col(c).cast("int"))
    s = s.select(
        "policy", "stmt", "effect", "version", _split("action").alias("actions"), _split("not_action").alias("not_actions"), F.when(~F.col("negated"), pattern).alias("resources"), F.when(F.col("negated"), pattern).alias("not_resources"),
        F.when(~F.col("not_principal"), named).alias("principals"), F.when(F.col("not_principal"), named).alias("not_principals"), F.filter(F.array(one("c1"), one("c2")), lambda c: c.isNotNull()).alias("conditions"),
    )
    r = derived(spark, sf_dir, _REQUESTS).select("request", "policy", "action", "resource", _context().alias("context"))
    return evaluate(r, s)


def _conditions(spark, sf_dir):
    """Every condition against every order's context."""
    r = derived(spark, sf_dir, _REQUESTS).select("request", _context().alias("context"))
    rows = F.array(*(F.struct(F.lit(i).cast("bigint").alias("n"), F.lit(op).alias("op"), F.lit(key).alias("key"), F.split(F.lit(values), ",").alias("values")) for i, (op, key, values, _) in enumerate(_CONDITIONS)))
    each = r.select("request", "context", F.get(rows, (F.col("request") % len(_CONDITIONS)).cast("int")).alias("c"))
    return each.select("request", F.col("c.n").alias("n"), condition(F.col("c.op"), F.col("c.key"), F.col("c.values"), F.col("context"), F.lit(VERSION)).alias("r")).select("request", "n", "r.result", "r.error")


_PAIRS = f"SELECT DISTINCT {_pick('l_partkey', _PATTERNS)} AS pattern, {_pick('l_suppkey', _RESOURCES)} AS resource, {_pick('l_linenumber', ['u1', 'u*', None])} AS username FROM $lineitem"


def _filled(spark, sf_dir):
    known = F.when(F.col("username").isNotNull(), F.create_map(F.lit("aws:username"), F.array("username"))).otherwise(F.create_map(F.lit("none"), F.array(F.lit(""))))
    return derived(spark, sf_dir, _PAIRS).withColumn("filled", substitute(F.col("pattern"), known, F.lit(VERSION)))


QUERIES = {
    "eval_variables": lambda spark, sf_dir: _filled(spark, sf_dir).select("pattern", "username", F.replace("filled", F.lit(STAR), F.lit("<star>")).alias("filled")).distinct(),
    "eval_arn": lambda spark, sf_dir: derived(spark, sf_dir, _PAIRS).where("resource IS NOT NULL").select("pattern", "resource", arn_match(F.col("pattern"), F.col("resource")).alias("as_resource"), arn_match(F.col("pattern"), F.col("resource"), False).alias("as_condition")).distinct(),
    "eval_pattern_request": lambda spark, sf_dir: derived(spark, sf_dir, _PAIRS).where("resource LIKE '%*'").select("pattern", "resource", pattern_request(F.col("pattern"), F.col("resource")).alias("covered")).distinct(),
    "eval_statement": lambda spark, sf_dir: _evaluated(spark, sf_dir).select("request", "policy", "stmt", "effect", "error", "result"),
    "eval_condition": _conditions,
}
_FILL = "replace(replace(replace(pattern, '${aws:missing, ''shared''}', 'shared'), '${aws:username}', coalesce(replace(username, '*', chr(1)), chr(3))), '${aws:missing}', chr(3))"


def _regex(pattern: str, expand: bool) -> str:
    """The reading of a pattern that the documentation gives, part by part, for RE2."""
    p = [f"split_part({pattern}, ':', {i})" for i in range(1, 6)]
    rest = f"array_to_string(string_split({pattern}, ':')[6:], ':')"
    n = f"len(string_split({pattern}, ':'))"
    quoted = lambda x: f"regexp_replace({x}, '([.+^$(){{}}|\\[\\]\\\\])', '\\\\\\1', 'g')"
    inner = lambda x: f"replace(replace({quoted(x)}, '*', '[^:]*'), '?', '[^:]')"
    each = []
    for i, x in enumerate(p, 1):
        ends = f"{x} LIKE '%*' AND ({n} = {i}{' OR true' if expand else ''})"
        each.append(f"CASE WHEN {n} < {i} THEN '' WHEN {ends} THEN {inner(f'rtrim({x}, chr(42))')} || '.*' ELSE {inner(x)} END || CASE WHEN {n} > {i} THEN ':' ELSE '' END")
    tail = f"CASE WHEN {n} > 5 THEN replace(replace({quoted(rest)}, '*', '.*'), '?', '.') ELSE '' END"
    return f"replace({' || '.join([*each, tail])}, chr(1), '\\*')"


def _arn(pattern: str, value: str, expand: bool = True) -> str:
    return f"({pattern} = '*' OR regexp_full_match({value}, {_regex(pattern, expand)}))"


_COVER = "CASE WHEN p = '*' THEN 2 WHEN rtrim(p, '*') LIKE '%*%' OR p LIKE '%?%' THEN 1 WHEN p LIKE '%*' AND starts_with(rtrim(resource, '*'), rtrim(p, '*')) THEN 2 WHEN NOT starts_with(rtrim(resource, '*'), rtrim(p, '*')) AND NOT starts_with(rtrim(p, '*'), rtrim(resource, '*')) THEN 0 WHEN p NOT LIKE '%*' AND NOT starts_with(p, rtrim(resource, '*')) THEN 0 ELSE 1 END"
_CASE = "CASE {c} " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, _, _, sql) in enumerate(_CONDITIONS)) + " ELSE 2 END"
_ERROR = "CASE {c} " + " ".join(f"WHEN {i} THEN 'operator {op}'" for i, (op, _, _, sql) in enumerate(_CONDITIONS) if sql == "NULL") + " END"
ORACLES = {
    "eval_variables": f"SELECT DISTINCT pattern, username, CASE WHEN f NOT LIKE '%' || chr(3) || '%' THEN replace(f, chr(1), '<star>') END AS filled FROM (SELECT pattern, username, {_FILL} AS f FROM ({duck(_PAIRS)}))",
    "eval_arn": f"SELECT DISTINCT pattern, resource, {_arn('pattern', 'resource')} AS as_resource, {_arn('pattern', 'resource', False)} AS as_condition FROM ({duck(_PAIRS)}) WHERE resource IS NOT NULL",
    "eval_pattern_request": f"SELECT pattern, resource, CASE c WHEN 2 THEN true WHEN 0 THEN false END AS covered FROM (SELECT DISTINCT pattern, resource, {_COVER} AS c FROM (SELECT *, pattern AS p FROM ({duck(_PAIRS)})) WHERE resource LIKE '%*')",
    # 2 is true, 1 unknown, 0 false, null an error; AND is the least, NOT is 2 minus.
    "eval_condition": f"SELECT request, n, CASE r WHEN 2 THEN true WHEN 1 THEN NULL ELSE false END AS result, {_ERROR.format(c='n')} AS error FROM (SELECT *, request % {len(_CONDITIONS)} AS n, {_CASE.format(c=f'request % {len(_CONDITIONS)}')} AS r FROM (SELECT *, '2012-10-17' AS version FROM ({duck(_REQUESTS)})))",
    "eval_statement": f"""WITH j AS (SELECT *, resource_pattern AS pattern FROM ({duck(_REQUESTS)}) r JOIN ({duck(_STATEMENTS)}) s USING (policy)),
f AS (SELECT *, CASE WHEN version = '2012-10-17' THEN {_FILL} ELSE pattern END AS p, lower(j.action) AS asked FROM (SELECT * EXCLUDE (action, action_1), action, action_1 AS wanted FROM j) j),
m AS (SELECT *, CASE WHEN wanted <> '' THEN CASE WHEN len(list_filter(string_split(lower(wanted), ','), lambda x: asked GLOB x)) > 0 THEN 2 ELSE 0 END ELSE CASE WHEN asked GLOB not_action THEN 0 ELSE 2 END END AS a,
CASE WHEN p = '*' THEN 2 WHEN p LIKE '%' || chr(3) || '%' OR resource IS NULL THEN 1 WHEN resource LIKE '%*' THEN {_COVER} WHEN {_arn('p', 'resource')} THEN 2 ELSE 0 END AS r,
CASE WHEN principal IN ('', 'AWS *') THEN 2 WHEN caller IS NULL THEN 1 WHEN principal LIKE 'Service%' THEN 0 WHEN principal = 'AWS 111122223333' THEN CASE WHEN split_part(caller, ':', 5) = '111122223333' THEN 2 ELSE 0 END WHEN split_part(principal, ' ', 2) = caller THEN 2 ELSE 0 END AS w0,
{_CASE.format(c='c1')} AS x1, {_CASE.format(c='c2')} AS x2, CASE WHEN lower(effect) NOT IN ('allow', 'deny') THEN 'effect' ELSE coalesce({_ERROR.format(c='c1')}, {_ERROR.format(c='c2')}) END AS error FROM f),
x AS (SELECT *, CASE WHEN error IS NOT NULL THEN 0 ELSE least(a, CASE WHEN negated THEN 2 - r ELSE r END, CASE WHEN not_principal AND principal <> '' THEN 2 - w0 ELSE w0 END, x1, x2) END AS out FROM m)
SELECT request, policy, stmt, upper(effect[1]) || lower(effect[2:]) AS effect, error, CASE out WHEN 2 THEN true WHEN 0 THEN false END AS result FROM x""",
}
