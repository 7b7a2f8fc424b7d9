"""Readers: records out of the wrappers that trails, states, plans, reports and policies come in.

Each reader takes a DataFrame with a text column (``spark.read.text(path, wholetext=True)`` gives one, gzip by suffix),
so a file and a table are read alike; text that doesn't parse becomes a row of the reject table, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import CHANGES_SQL, TRAIL, derived, duck
from ..functions.rounds import settled

RECORD = "eventID string, eventTime string, eventName string, eventSource string, awsRegion string, errorCode string, userIdentity struct<type:string,arn:string,accountId:string,userName:string,invokedBy:string>"


def text_files(spark, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))


def trail_records(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per record of {"Records": [...]}, {"Events": [{"CloudTrailEvent": "..."}]}, a list, or one bare record."""
    t = F.trim(F.col(text))
    wrapped = F.from_json(t, "Records array<string>, Events array<struct<CloudTrailEvent:string>>")
    many = F.coalesce(wrapped["Records"], F.transform(wrapped["Events"], lambda e: e["CloudTrailEvent"]), F.when(t.startswith("["), F.from_json(t, "array<string>")), F.array(t))
    return files.select(F.explode(many).alias("raw")).select("raw", F.from_json("raw", RECORD).alias("r")).where("r.eventName IS NOT NULL AND r.eventSource IS NOT NULL").select("raw", "r.*")


def rejects(files: DataFrame, text: str = "text") -> DataFrame:
    """Texts that are no JSON at all."""
    return files.where(F.expr(f"try_parse_json({text}) IS NULL"))


def policy_document(text: Column) -> Column:
    """The policy inside any wrapper, URL-encoded or with a byte order mark."""
    t = F.regexp_replace(F.trim(text), "^\ufeff", "")
    t = F.when(t.rlike(r"^%7[Bb]"), F.try_url_decode(t)).otherwise(t)
    inner = F.coalesce(*(F.get_json_object(t, f"$.{p}") for p in ("PolicyVersion.Document", "Policy.PolicyDocument", "Role.AssumeRolePolicyDocument", "PolicyDocument", "Policy", "Document")), t)
    return F.when(inner.rlike(r"^%7[Bb]"), F.try_url_decode(inner)).otherwise(inner)


RESOURCE = "array<struct<address:string,mode:string,type:string,name:string,values:string>>"
INSTANCES = "array<struct<mode:string,type:string,name:string,module:string,instances:array<struct<index_key:string,attributes:string>>>>"


def _managed(rows: DataFrame, at: str) -> DataFrame:
    """Resources listed under a path of a module's text."""
    found = rows.select(F.explode(F.from_json(F.get_json_object("m", at), RESOURCE)).alias("r")).select("r.*")
    return found.where("mode = 'managed'").select("address", "type", "name", "values")


def state_resources(files: DataFrame, text: str = "text") -> DataFrame:
    """address, type, name, values of each resource of raw state (version 4), shown state or a plan's planned values, with
    modules nested to any depth: a round takes one level of all files apart, and the rounds end with the deepest one."""
    t = F.col(text)
    raw = F.from_json(F.get_json_object(t, "$.resources"), INSTANCES)
    one = files.select(F.explode(raw).alias("r")).select("r.*").select("mode", "type", "name", "module", F.explode("instances").alias("i"))
    address = F.concat_ws(".", "module", "type", "name")
    index = F.when(F.col("i.index_key").isNull(), "").when(F.col("i.index_key").rlike(r"^\d+$"), F.concat(F.lit("["), F.col("i.index_key"), F.lit("]"))).otherwise(F.concat(F.lit('["'), F.col("i.index_key"), F.lit('"]')))
    out = one.where("mode = 'managed'").select(F.concat(address, index).alias("address"), "type", "name", F.col("i.attributes").alias("values"))
    roots = F.coalesce(F.get_json_object(t, "$.values.root_module"), F.get_json_object(t, "$.planned_values.root_module"))
    level = settled(files.select(roots.alias("m")).where("m IS NOT NULL"))
    while not level.isEmpty():
        out = out.unionByName(_managed(level, "$.resources"))
        level = settled(level.select(F.explode(F.from_json(F.get_json_object("m", "$.child_modules"), "array<string>")).alias("m")).where("m IS NOT NULL"))
    return out


def state_rejects(files: DataFrame, text: str = "text") -> DataFrame:
    """Texts that hold no state: no JSON, or none of the three shapes."""
    shapes = [F.get_json_object(F.col(text), p).isNotNull() for p in ("$.resources", "$.values", "$.planned_values")]
    return files.where(F.expr(f"try_parse_json({text}) IS NULL") | ~(shapes[0] | shapes[1] | shapes[2]))


def plan_changes(files: DataFrame, text: str = "text") -> DataFrame:
    """address, type, actions, before and after of each planned change."""
    rows = F.from_json(F.get_json_object(F.col(text), "$.resource_changes"), "array<struct<address:string,type:string,change:struct<actions:array<string>,before:string,after:string>>>")
    return files.select(F.explode(rows).alias("r")).select("r.address", "r.type", "r.change.actions", "r.change.before", "r.change.after")


def credential_report(lines: DataFrame, columns: str, text: str = "text") -> DataFrame:
    """Rows of a report in CSV; ``lines_up`` is false where the ARN doesn't end in the row's user."""
    r = lines.select(F.from_csv(F.col(text), F.lit(columns)).alias("r")).select("r.*")
    clean = [F.when(F.col(c).isin("", "N/A", "no_information", "not_supported"), None).otherwise(F.col(c)).alias(c) for c in r.columns]
    fits = F.coalesce(F.col("arn").endswith(F.concat(F.lit("/"), F.col("user"))) | (F.col("user") == "<root_account>"), F.lit(False))
    return r.select(*clean, fits.alias("lines_up"))


def coverage(reads: DataFrame) -> DataFrame:
    """What was not read and why, with regions together; what is missing is never taken as clean."""
    return reads.where("NOT done").groupBy("account", "type", "reason").agg(F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


def safe_cell(value: Column) -> Column:
    """Cells that a spreadsheet would run get a quote in front, unless they are numbers."""
    number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(value.rlike("^[=+\\-@\\t\\r]") & ~number, F.concat(F.lit("'"), value)).otherwise(value)


def write_findings(findings: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV, JSON or a Markdown table; one part per task."""
    if kind == "json":
        findings.write.mode("overwrite").json(path)
    elif kind == "csv":
        findings.select(*(safe_cell(F.col(c).cast("string")).alias(c) for c in findings.columns)).write.mode("overwrite").option("header", True).csv(path)
    else:
        cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\\\\\|"), "\n", " ")
        findings.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, findings.columns)), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)


# Queries: the given tables are put into each wrapper and read back.

#: Keys that a file takes rows from, so that files have a bounded size and their number grows with the table.
FILE = 1000


def _trail_files(spark, sf_dir):
    e = derived(spark, sf_dir, TRAIL)
    one = F.struct(F.col("event_id").cast("string").alias("eventID"), F.col("event_time").cast("string").alias("eventTime"), F.col("event_name").alias("eventName"), F.col("event_source").alias("eventSource"), F.col("region").alias("awsRegion"), F.col("error_code").alias("errorCode"), F.struct(F.col("id_type").alias("type"), F.col("id_arn").alias("arn")).alias("userIdentity"))
    g = e.groupBy("user_id", F.floor(F.col("event_id") / FILE).alias("file")).agg(F.collect_list(one).alias("l"))
    events = F.transform("l", lambda x: F.struct(F.to_json(x).alias("CloudTrailEvent")))
    kind = F.col("user_id") % 3
    text = F.when(kind == 0, F.to_json(F.struct(F.col("l").alias("Records")))).when(kind == 1, F.to_json(F.struct(events.alias("Events")))).otherwise(F.to_json("l"))
    return trail_records(g.select(text.alias("text")).unionByName(spark.createDataFrame([("not json",), ("{}",)], "text string"))).select("eventID", "eventName", "eventSource", "awsRegion", F.col("userIdentity.type").alias("type"))


def _state(spark, sf_dir):
    """Files of all three shapes; shown ones and plans nest their modules up to fifteen deep."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumns({"g": F.col("p_partkey") % 7, "file": F.floor(F.col("p_partkey") / 70)})
    name = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    value = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    raw = p.where("g < 3").groupBy("g", "file").agg(F.collect_list(F.struct(F.lit("managed").alias("mode"), F.lit("aws_x").alias("type"), name.alias("name"), F.array(F.struct(F.lit("0").alias("index_key"), value.alias("attributes"))).alias("instances"))).alias("resources"))
    shown = p.where("g >= 3").groupBy("g", "file").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("module.m.aws_x."), name).alias("address"), F.lit("managed").alias("mode"), F.lit("aws_x").alias("type"), name.alias("name"), value.alias("values")))).alias("rs"))
    deep = ((F.col("file") * 7 + F.col("g")) % 16).cast("int")
    nested = F.concat(F.repeat(F.lit('{"child_modules":['), deep), F.lit('{"resources":'), F.col("rs"), F.lit("}"), F.repeat(F.lit("]}"), deep))
    top = F.when(F.col("g") == 6, "planned_values").otherwise("values")
    texts = raw.select(F.to_json(F.struct(F.lit(4).alias("version"), "resources")).alias("text")).unionByName(shown.select(F.concat(F.lit('{"'), top, F.lit('":{"root_module":'), nested, F.lit("}}")).alias("text")))
    return state_resources(texts).select("address", "type", F.get_json_object("values", "$.size").alias("size"))


def _plans(spark, sf_dir):
    c = derived(spark, sf_dir, CHANGES_SQL)
    one = F.struct("address", "type", F.struct(F.split("acts", ",").alias("actions"), F.from_json("before", "map<string,string>").alias("before"), F.from_json("after", "map<string,string>").alias("after")).alias("change"))
    key = F.floor(F.regexp_extract("address", r"(\d+)$", 1).cast("bigint") / FILE)
    texts = c.groupBy("plan_id", key.alias("file")).agg(F.to_json(F.struct(F.collect_list(one).alias("resource_changes"))).alias("text"))
    return plan_changes(texts).select("address", "type", F.array_join("actions", ",").alias("acts"), F.get_json_object("after", "$.size").alias("size"))


def _policies(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    doc = F.format_string('{"Version":"2012-10-17","Statement":[{"Sid":"s%d"}]}', F.col("p_partkey"))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, doc).when(k == 1, F.url_encode(doc)).when(k == 2, F.concat(F.lit('{"PolicyVersion":{"Document":'), doc, F.lit("}}"))).otherwise(F.concat(F.lit('\ufeff{"PolicyDocument":'), doc, F.lit("}")))
    return p.select("p_partkey", F.get_json_object(policy_document(text), "$.Statement[0].Sid").alias("sid"))


def _report(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    user = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    line = F.concat_ws(",", user, F.concat(F.lit("arn:aws:iam::111122223333:user/"), F.when(F.col("c_custkey") % 10 == 3, "else").otherwise(user)), F.when(F.col("c_custkey") % 2 == 0, "N/A").otherwise("2024-01-01"))
    return credential_report(c.select(line.alias("text")), "user string, arn string, password_last_used string").select("user", "password_last_used", "lines_up")


def _coverage(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return coverage(s.select((F.col("s_suppkey") % 5).alias("account"), F.concat(F.lit("t"), (F.col("s_suppkey") % 3).cast("string")).alias("type"), F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("region"), (F.col("s_suppkey") % 4 != 0).alias("done"), F.when(F.col("s_suppkey") % 8 == 0, "denied").otherwise("unreachable").alias("reason")))


def _cells(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, F.concat(F.lit("="), F.col("o_orderpriority"))).when(k == 1, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).when(k == 2, F.concat(F.lit("@"), F.col("o_orderstatus"))).when(k == 3, F.concat(F.lit("\t"), F.col("o_orderstatus"))).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", safe_cell(v).alias("cell"))


QUERIES = {"src_trail_files": _trail_files, "src_tf_state": _state, "src_tf_plan": _plans, "src_policy_docs": _policies, "src_cred_report": _report, "src_coverage": _coverage, "sink_findings": _cells}
ORACLES = {
    "src_trail_files": f'SELECT CAST(event_id AS VARCHAR) AS "eventID", event_name AS "eventName", event_source AS "eventSource", region AS "awsRegion", id_type AS type FROM ({duck(TRAIL)})',
    "src_tf_state": "SELECT CASE WHEN p_partkey % 7 < 3 THEN 'aws_x.r' || p_partkey || '[0]' ELSE 'module.m.aws_x.r' || p_partkey END AS address, 'aws_x' AS type, CAST(p_size AS VARCHAR) AS size FROM part",
    "src_tf_plan": f"SELECT address, type, acts, json_extract_string(after, '$.size') AS size FROM ({duck(CHANGES_SQL)})",
    "src_policy_docs": "SELECT p_partkey, 's' || p_partkey AS sid FROM part",
    "src_cred_report": "SELECT 'u' || c_custkey AS user, CASE WHEN c_custkey % 2 = 1 THEN '2024-01-01' END AS password_last_used, c_custkey % 10 <> 3 AS lines_up FROM customer",
    "src_coverage": "SELECT s_suppkey % 5 AS account, 't' || (s_suppkey % 3) AS type, CASE WHEN s_suppkey % 8 = 0 THEN 'denied' ELSE 'unreachable' END AS reason, string_agg(DISTINCT 'r' || s_nationkey, ',' ORDER BY 'r' || s_nationkey) AS regions FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY ALL",
    "sink_findings": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '''=' || o_orderpriority WHEN 1 THEN '-' || o_custkey WHEN 2 THEN '''@' || o_orderstatus WHEN 3 THEN '''' || chr(9) || o_orderstatus ELSE o_orderpriority END AS cell FROM orders",
}
