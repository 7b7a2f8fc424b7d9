"""Conditions and statements by hand: every kind of operator, sets, what is absent and what isn't known."""

from pyspark.sql import functions as F

from stratalog.operators import evaluate as evaluate_
from stratalog.operators.conditions import VERSION, condition, in_network
from stratalog.operators.evaluate import evaluate

CONTEXT = {"aws:username": ["Ann"], "aws:tagkeys": ["a", "c"], "aws:none": [], "aws:sourceip": ["2001:db8::1"], "aws:n": ["10"], "aws:t": ["2024-05-01T12:00:00.25+02:00"], "aws:b": ["aGk="], "aws:arn": ["arn:aws:iam::111122223333:role/a"]}
# operator, key, values, result
CASES = [
    ("StringEquals", "aws:UserName", ["ann", "Ann"], True), ("StringEqualsIgnoreCase", "aws:username", ["ANN"], True), ("StringNotEquals", "aws:username", ["x", "Ann"], False), ("StringLike", "aws:username", ["A?n"], True), ("StringLike", "aws:username", ["a*"], False), ("StringNotLike", "aws:username", ["a*"], True),
    ("ForAllValues:StringEquals", "aws:tagkeys", ["a", "b"], False), ("ForAllValues:StringLike", "aws:tagkeys", ["?"], True), ("ForAllValues:StringEquals", "aws:none", ["x"], True), ("ForAnyValue:StringEquals", "aws:tagkeys", ["c"], True), ("ForAnyValue:StringEquals", "aws:none", ["c"], False), ("ForAnyValue:StringNotEquals", "aws:tagkeys", ["a"], True), ("ForAllValues:StringNotEquals", "aws:tagkeys", ["a"], False),
    ("StringEquals", "aws:unknown", ["x"], None), ("StringEqualsIfExists", "aws:none", ["x"], True), ("StringEquals", "aws:none", ["x"], False), ("StringNotEquals", "aws:none", ["x"], True), ("Null", "aws:none", ["true"], True), ("Null", "aws:username", ["TRUE"], False), ("Null", "aws:unknown", ["true"], None),
    ("NumericLessThan", "aws:n", ["9.5", "11"], True), ("NumericEquals", "aws:n", ["10.0"], True), ("NumericNotEquals", "aws:n", ["x"], True), ("NumericGreaterThan", "aws:n", ["10"], False), ("NumericGreaterThanEquals", "aws:username", ["1"], False), ("DateLessThan", "aws:t", ["2024-05-01T10:00:01Z"], True), ("DateGreaterThanEquals", "aws:t", ["1714557600"], True), ("DateEquals", "aws:n", ["10"], True),
    ("IpAddress", "aws:sourceip", ["10.0.0.0/8", "2001:db8::/33"], True), ("NotIpAddress", "aws:sourceip", ["2001:db8::/128"], True), ("IpAddress", "aws:username", ["0.0.0.0/0"], False), ("Bool", "aws:username", ["ANN"], True), ("BinaryEquals", "aws:b", ["aGk="], True), ("BinaryEquals", "aws:b", ["hi"], True), ("ArnLike", "aws:arn", ["arn:aws:iam::*:role/*"], True), ("ArnEquals", "aws:arn", ["arn:aws:*:role/a"], False),
    ("StringEquals", "aws:username", ["${aws:username}"], True), ("StringEquals", "aws:username", ["${aws:none, 'Ann'}"], True), ("StringEquals", "aws:username", ["${aws:none}"], False), ("StringEquals", "aws:username", ["${aws:unknown}"], None), ("StringEquals", "aws:username", ["${aws:unknown}", "Ann"], True), ("StringLike", "aws:username", ["${*}nn"], False), ("StringEquals", "aws:username", [], False),
    ("Surprise", "aws:username", ["Ann"], False), ("NullIfExists", "aws:username", ["true"], False), ("ForAnyValue:Null", "aws:username", ["true"], False),
]


def test_conditions_by_hand(spark):
    rows = [(i, op, key, values, CONTEXT) for i, (op, key, values, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, op string, key string, vals array<string>, context map<string,array<string>>")
    got = {r.i: (r.c.result, r.c.error) for r in df.select("i", condition(F.col("op"), F.col("key"), F.col("vals"), F.col("context"), F.lit(VERSION)).alias("c")).collect()}
    for i, case in enumerate(CASES):
        assert got[i][0] == case[3], (case, got[i])
        assert (got[i][1] is not None) == (case[0] in ("Surprise", "NullIfExists", "ForAnyValue:Null")), case


def test_networks(spark):
    cases = [("10.1.2.3", "10.0.0.0/8", True), ("10.1.2.3", "10.1.2.3", True), ("10.1.2.3", "10.0.0.0/33", None), ("1.2.3.256", "0.0.0.0/0", None), ("::1", "::/0", True), ("::1", "0.0.0.0/0", False), ("2001:db8:0:0:0:0:0:1", "2001:db8::1", True), ("1:2:3:4:5:6:7:8", "1:2::/31", True), ("1::2::3", "::/0", None), ("fe80::g", "::/0", None), (" 10.0.0.1 ", " 10.0.0.0/31", True)]
    df = spark.createDataFrame(cases, "a string, n string, want boolean").withColumn("got", in_network(F.col("a"), F.col("n")))
    for r in df.collect():
        assert bool(r.got) == bool(r.want), r


def test_statements_by_hand(spark):
    none = None
    statements = [
        (1, 1, "allow", VERSION, ["s3:Get*"], none, ["arn:aws:s3:::b/*"], none, none, none, [("StringEquals", "aws:username", ["Ann"]), ("Bool", "aws:mfa", ["true"])]),
        (1, 2, "Deny", VERSION, none, ["iam:*"], none, ["arn:aws:s3:::b/*"], none, none, none), (1, 3, "Deny", VERSION, ["*"], none, ["*"], none, none, [("AWS", "arn:aws:iam::111122223333:root")], []), (1, 4, "Permit", VERSION, ["*"], none, ["*"], none, none, none, none),
        (1, 5, "Allow", VERSION, none, none, ["*"], none, none, none, none), (1, 6, "Allow", VERSION, [], none, ["*"], none, [("Service", "ec2.amazonaws.com")], none, none), (1, 7, "Allow", VERSION, ["*"], none, ["*"], none, [("Service", "ec2.amazonaws.com")], none, none), (1, 8, "Allow", VERSION, ["*"], none, ["*"], none, none, none, [("Odd", "k", ["v"])]),
    ]
    lists = "actions array<string>, not_actions array<string>, resources array<string>, not_resources array<string>, principals array<struct<type:string,who:string>>, not_principals array<struct<type:string,who:string>>"
    s = spark.createDataFrame(statements, f"policy int, stmt int, effect string, version string, {lists}, conditions array<struct<op:string,key:string,values:array<string>>>")
    told = {"aws:username": ["Ann"], "aws:principalarn": ["arn:aws:iam::111122223333:user/a"], "aws:principalaccount": ["111122223333"]}
    requests = [(1, 1, "S3:getobject", "arn:aws:s3:::b/k", told), (2, 1, "s3:GetObject", None, {"aws:none": []})]
    r = spark.createDataFrame(requests, "request int, policy int, action string, resource string, context map<string,array<string>>")
    got = {(x.request, x.stmt): (x.result, x.error, x.depends_on) for x in evaluate(r, s).collect()}
    assert got[1, 1] == (None, None, "aws:mfa") and got[1, 2] == (False, None, None) and got[1, 3] == (False, None, None)
    assert got[1, 4][1] == "effect" and got[1, 5][1] == "action" and got[1, 6][0] is False and got[1, 7][0] is False and got[1, 8] == (False, "operator Odd", None)
    assert got[2, 1] == (None, None, "aws:mfa,aws:username,resource") and got[2, 2] == (None, None, "resource") and got[2, 3] == (None, None, "aws:principalarn") and got[2, 7][0] is None


def test_equal_questions_are_asked_once(spark, monkeypatch):
    """Requests that differ in what no part of a statement looks at ask one question for each part and condition."""
    asked, real = {}, evaluate_._answered

    def counted(questions, name, *answer):
        found = real(questions, name, *answer)
        asked[name] = found.count()
        return found

    monkeypatch.setattr(evaluate_, "_answered", counted)
    requests = spark.range(200).selectExpr("id AS request", "1 AS policy", "'s3:GetObject' AS action", "'arn:aws:s3:::b/Ann' AS resource", "map('aws:username', array('Ann'), 'aws:other', array(string(id))) AS context")
    s = spark.range(50).selectExpr("1 AS policy", "id AS stmt", "'Allow' AS effect", f"'{VERSION}' AS version", "array('s3:*') AS actions", "CAST(NULL AS array<string>) AS not_actions", "array('arn:aws:s3:::b/${aws:UserName}', NULL) AS resources", "CAST(NULL AS array<string>) AS not_resources", "CAST(NULL AS array<struct<type:string,who:string>>) AS principals", "CAST(NULL AS array<struct<type:string,who:string>>) AS not_principals", "array(named_struct('op', 'StringEquals', 'key', 'aws:username', 'values', array('${AWS:username}')), named_struct('op', 'Null', 'key', 'aws:mfa', 'values', array('true'))) AS conditions")
    got = evaluate_.evaluate(requests, s).groupBy("result", "depends_on", "error").count().collect()
    assert [tuple(x) for x in got] == [(None, "aws:mfa", None, 10_000)]
    assert asked == {"q_action": 1, "q_resource": 1, "q_principal": 1, "q_list": 1, "q_one": 2}
