"""What declared state says of each resource: identity, place and settings, children folded into parents, and policies in a
form where equal meaning is equal text.

Values come as JSON text of a resource's attributes, with marks of what is sensitive beside them. A sensitive value, or one
under a name that tells of a secret, is never read; marks that can't be read count for every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from ..functions.rounds import settled

# Families, their identifying and naming attributes, other types for the same thing, and child types.
ID_ATTR = {
    "aws_db_instance": "identifier", "aws_rds_cluster_instance": "identifier", "aws_s3_bucket": "bucket", "aws_iam_role": "name", "aws_iam_user": "name", "aws_iam_policy": "arn", "aws_lambda_function": "function_name", "aws_dynamodb_table": "name", "aws_sns_topic": "arn", "aws_kms_key": "key_id",
    "aws_secretsmanager_secret": "arn", "aws_cloudwatch_log_group": "name", "aws_ecr_repository": "name", "aws_lb": "arn", "aws_sqs_queue": "url", "aws_eip": "allocation_id",
}
NAME_ATTR = {
    "aws_security_group": "name", "aws_lb": "name", "aws_db_instance": "identifier", "aws_rds_cluster_instance": "identifier", "aws_s3_bucket": "bucket", "aws_iam_role": "name", "aws_iam_user": "name", "aws_iam_policy": "name", "aws_lambda_function": "function_name", "aws_dynamodb_table": "name", "aws_sns_topic": "name",
    "aws_sqs_queue": "name", "aws_kms_key": "description", "aws_secretsmanager_secret": "name", "aws_cloudwatch_log_group": "name", "aws_ecr_repository": "name",
}
FAMILIES = sorted({*ID_ATTR, "aws_vpc", "aws_subnet", "aws_internet_gateway", "aws_nat_gateway", "aws_route_table", "aws_security_group", "aws_network_acl", "aws_vpc_endpoint", "aws_instance", "aws_ebs_volume"})
SAME = {"aws_default_vpc": "aws_vpc", "aws_default_subnet": "aws_subnet", "aws_default_security_group": "aws_security_group", "aws_default_network_acl": "aws_network_acl", "aws_default_route_table": "aws_route_table", "aws_alb": "aws_lb"}
CHILDREN = ("aws_route", "aws_security_group_rule", "aws_iam_role_policy_attachment", "aws_iam_policy_attachment", "aws_s3_bucket_versioning")
GLOBAL = ("aws_iam_role", "aws_iam_user", "aws_iam_policy")
SECRET_NAME = "(?i)password|passwd|secret|private_key|privatekey|token|credential|passphrase|key_material|user_data|auth_key"
TARGETS = ("gateway_id", "nat_gateway_id", "transit_gateway_id", "vpc_peering_connection_id", "network_interface_id", "vpc_endpoint_id", "egress_only_gateway_id", "instance_id")
REGION = r"[a-z]{2}(-[a-z]+)+-\d+"


class Values:
    """Columns over ``vals`` and ``marks``, both maps of JSON text by attribute."""

    @staticmethod
    def secret(attr: Column) -> Column:
        marked = F.coalesce(F.element_at("marks", attr).rlike(r"(^|[\[:,{]\s*)true"), F.lit(False))
        return F.col("marks").isNull() | marked | attr.rlike(SECRET_NAME)

    @classmethod
    def text(cls, attr: str | Column) -> Column:
        """A plain value as text; null for none, an empty one, a list or an object."""
        a = F.lit(attr) if isinstance(attr, str) else attr
        got = F.element_at("vals", a)
        return F.when(~cls.secret(a) & ~got.rlike(r"^\s*[\[{]") & (got != ""), got)

    @classmethod
    def strings(cls, attr: str) -> Column:
        """A list of texts; a single text is a list of one."""
        got = F.element_at("vals", F.lit(attr))
        found = F.when(got.startswith("["), F.filter(F.from_json(got, "array<string>"), lambda x: x != "")).when(got != "", F.array(got))
        return F.when(~cls.secret(F.lit(attr)), F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def _picked(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def opened(resources: DataFrame) -> DataFrame:
    """Resources (stack, address, type, grp, values, marks) with their maps and family."""
    return resources.select("stack", "address", "type", "grp", F.coalesce(_picked(SAME, F.col("type")), F.col("type")).alias("family"), F.coalesce(F.from_json("values", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("vals"), F.from_json("marks", "map<string,string>").alias("marks"))


def reduced(resources: DataFrame) -> DataFrame:
    """stack, address, grp, family, id, name, region, account, tags, settings, hidden of every resource of a known family; rows
    without an id have ``unread`` true, as have unknown families, so that nothing is left out unseen."""
    v = opened(resources).where(~F.col("type").isin(*CHILDREN))
    family, text = F.col("family"), Values.text
    known = family.isin(*FAMILIES)
    ident = F.coalesce(text(F.coalesce(_picked(ID_ATTR, family), F.lit("id"))), text("id"))
    tags = lambda a: F.when(F.col("marks").isNotNull() & F.element_at("vals", a).startswith("{"), F.from_json(F.element_at("vals", a), "map<string,string>"))
    chosen = F.coalesce(F.when(F.size(tags("tags_all")) > 0, tags("tags_all")), tags("tags"), tags("tags_all"))
    marked = lambda a: F.coalesce(F.get_json_object(F.element_at("marks", a), "$.Name") == "true", F.element_at("marks", a) == "true", F.lit(False))
    named = F.when(~marked("tags") & ~marked("tags_all"), F.coalesce(*(F.when(F.element_at(tags(a), F.lit("Name")) != "", F.element_at(tags(a), F.lit("Name"))) for a in ("tags_all", "tags"))))
    name = F.coalesce(named, text(F.coalesce(_picked(NAME_ATTR, family), F.lit(""))), F.lit(""))
    arn = lambda i: F.when(text("arn").startswith("arn:"), F.nullif(F.get(F.split(text("arn"), ":"), i), F.lit("")))
    zone = F.regexp_extract(F.coalesce(text("availability_zone"), F.lit("")), f"^({REGION})[a-z]$", 1)
    queue = lambda p: F.when(family == "aws_sqs_queue", F.nullif(F.regexp_extract(ident, p, 1), F.lit("")))
    region = F.when(family.isin(*GLOBAL), "global").otherwise(F.coalesce(F.when(text("region").rlike(f"^{REGION}$"), text("region")), arn(3), queue(r"^https?://sqs\.([a-z0-9-]+)\.amazonaws"), F.nullif(zone, F.lit(""))))
    account = F.coalesce(arn(4), F.when(text("owner_id").rlike(r"^\d{12}$"), text("owner_id")), queue(r"^https?://[^/]+/(\d{12})/"))
    first = lambda attr, field: F.get_json_object(F.element_at("vals", attr), f"$[0].{field}")
    # label, family, attribute, the value to compare
    wanted = [
        ("public_ip", "aws_subnet", "map_public_ip_on_launch", F.when(text("map_public_ip_on_launch").isin("true", "false"), text("map_public_ip_on_launch"))), ("instance_type", "aws_instance", "instance_type", text("instance_type")),
        ("security_groups", "aws_instance", "vpc_security_group_ids", F.nullif(F.array_join(F.array_sort(F.array_distinct(Values.strings("vpc_security_group_ids"))), ","), F.lit(""))), ("trust", "aws_iam_role", "assume_role_policy", F.when(~Values.secret(F.lit("assume_role_policy")), F.element_at("vals", "assume_role_policy"))),
        ("policies", "aws_iam_role", "managed_policy_arns", F.when(F.element_at("vals", "managed_policy_arns").startswith("["), F.array_join(F.array_sort(F.array_distinct(Values.strings("managed_policy_arns"))), ","))), ("versioning", "aws_s3_bucket", "versioning", F.when(first("versioning", "enabled").isin("true", "false"), first("versioning", "enabled"))),
    ]
    there = lambda attr: F.map_contains_key("vals", attr)
    rows = F.array(*(F.when((family == fam) & there(attr) & ~Values.secret(F.lit(attr)) & value.isNotNull(), F.struct(F.lit(label).alias("k"), value.alias("v"))) for label, fam, attr, value in wanted))
    kept_back = F.array(*(F.when((family == fam) & there(attr) & Values.secret(F.lit(attr)), label) for label, fam, attr, _ in wanted))
    return v.select(
        "stack", "address", "grp", "family", ident.alias("id"), name.alias("name"), region.alias("region"), account.alias("account"), chosen.alias("tags"), F.map_from_entries(F.filter(rows, lambda x: x.isNotNull())).alias("settings"), F.filter(kept_back, lambda x: x.isNotNull()).alias("hidden"), (~known | ident.isNull()).alias("unread"),
    )


def children(resources: DataFrame) -> DataFrame:
    """stack, kind, parent, payload: routes, group rules, attached policies and versioning, for the parent they belong to."""
    v, text = opened(resources).where(F.col("type").isin(*CHILDREN)), Values.text
    kind = F.col("type")
    none = F.array().cast("array<struct<kind:string,parent:string,payload:string>>")
    one = lambda k, parent, payload: F.struct(F.lit(k).alias("kind"), parent.alias("parent"), payload.alias("payload"))
    dest = F.coalesce(*map(text, ("destination_cidr_block", "destination_ipv6_cidr_block", "destination_prefix_list_id")))
    target = F.coalesce(*map(text, TARGETS), F.lit(""))
    head = F.concat_ws(" ", F.coalesce(text("type"), F.lit("ingress")), F.coalesce(text("protocol"), F.lit("-1")), F.concat_ws("-", F.coalesce(text("from_port"), F.lit("0")), F.coalesce(text("to_port"), F.lit("0"))))
    itself = F.when(text("self") == "true", F.array(text("security_group_id"))).otherwise(F.array().cast("array<string>"))
    sources = F.concat(Values.strings("cidr_blocks"), Values.strings("ipv6_cidr_blocks"), Values.strings("prefix_list_ids"), Values.strings("source_security_group_id"), itself)
    status = F.coalesce(F.get_json_object(F.element_at("vals", "versioning_configuration"), "$[0].status"), F.get_json_object(F.element_at("vals", "versioning_configuration"), "$.status"))
    found = (
        F.when(kind == "aws_route", F.array(one("route", text("route_table_id"), F.concat_ws(" ", dest, target)))).when(kind == "aws_security_group_rule", F.transform(sources, lambda s: one("rule", text("security_group_id"), F.concat_ws(" ", head, s))))
        .when(kind == "aws_iam_role_policy_attachment", F.array(one("policy", text("role"), text("policy_arn")))).when(kind == "aws_iam_policy_attachment", F.transform(Values.strings("roles"), lambda r: one("policy", r, text("policy_arn"))))
        .when(kind == "aws_s3_bucket_versioning", F.array(one("versioning", text("bucket"), F.when(status.isNotNull(), (status == "Enabled").cast("string"))))).otherwise(none)
    )
    sound = lambda c: c["parent"].isNotNull() & c["payload"].isNotNull() & ((c["kind"] != "route") | dest.isNotNull())
    return v.select("stack", F.explode(F.filter(found, sound)).alias("c")).select("stack", "c.*").distinct()


def placed(resources: DataFrame, references: DataFrame) -> DataFrame:
    """stack, address, region, account, by evidence of falling rank: the resource's own; what it points at, in the order of its
    references (stack, address, rank, id); the one region that its provider and module have; the one of the stack. Only
    what a target says of itself counts, so loops end. Stacks are added up before rows meet them, so that a large one is
    no task of its own."""
    own = resources.where("region IS NOT NULL").groupBy("stack", "id").agg(F.max_by(F.struct("region", "account"), "address").alias("t"))
    seen = references.join(own, ["stack", "id"]).groupBy("stack", "address").agg(F.min_by("t.region", F.when(F.col("t.region") != "global", F.col("rank"))).alias("r_region"), F.min_by("t.account", F.when(F.col("t.account").isNotNull(), F.col("rank"))).alias("r_account"))
    step = resources.join(seen, ["stack", "address"], "left").select("stack", "address", "grp", F.coalesce("region", "r_region").alias("region"), F.coalesce("account", "r_account").alias("account"))
    local = F.when(F.col("region") != "global", F.col("region"))
    only = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    by_group = step.groupBy("stack", "grp").agg(only(local).alias("g_region"))
    by_stack = step.groupBy("stack").agg(only(local).alias("s_region"), only(F.col("account")).alias("s_account"))
    out = step.join(by_group, ["stack", "grp"], "left").join(by_stack, "stack", "left")
    return out.select("stack", "address", F.coalesce("region", "g_region", "s_region").alias("region"), F.coalesce("account", "s_account").alias("account"))


def policy_hash(docs: DataFrame) -> DataFrame:
    """id, hash: documents (id, text) of equal meaning have equal hashes. Keys and lists have no order, a list of one is its
    item, and an account number under AWS is its root; null for text that is no JSON object.

    Equal texts are read once. Documents are taken apart level by level into rows, whatever they hold, and hashed from the
    leaves up: a level is one grouping, and there are as many as the deepest document has."""
    texts = settled(docs.where("text IS NOT NULL").select("text").distinct().select("text", F.monotonically_increasing_id().alias("id")))
    text = F.trim("text")
    plain = F.when(text.rlike("^%7[Bb]"), F.try_url_decode(text)).otherwise(text)
    whole = texts.select("id", F.try_parse_json(plain).alias("v"))
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    level = settled(whole.where(kind(F.col("v")) == "OBJECT").select("id", F.lit("$").alias("node"), F.lit("").alias("up"), F.lit("").alias("key"), F.lit("").alias("named"), "v"))
    levels = []
    while not level.isEmpty():
        levels.append(level.withColumn("kind", kind(F.col("v"))))
        level.createOrReplaceTempView("stratalog_level")
        child = level.sparkSession.sql("SELECT id, concat(node, '/', CAST(e.pos AS STRING)) AS node, node AS up, coalesce(e.key, '') AS key, coalesce(e.key, named) AS named, e.value AS v FROM stratalog_level, LATERAL variant_explode(v) AS e")
        level = settled(child)
    docs.sparkSession.catalog.dropTempView("stratalog_level")
    below = None
    for at in reversed(levels):
        said = F.when((F.col("named") == "AWS") & (F.col("kind") == "STRING") & F.col("v").cast("string").rlike(r"^\d{12}$"), F.concat(F.lit("arn:aws:iam::"), F.col("v").cast("string"), F.lit(":root"))).otherwise(F.col("v").cast("string"))
        rows = at.select("id", "node", "up", "key", "kind", F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.sha2(F.concat_ws(":", "kind", F.coalesce(said, F.lit("null"))), 256)).alias("leaf"))
        if below is not None:
            rows = rows.join(below, ["id", "node"], "left")
        else:
            rows = rows.withColumn("items", F.array().cast("array<struct<key:string,h:string>>"))
        items = F.coalesce("items", F.array().cast("array<struct<key:string,h:string>>"))
        inner = F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws("=", F.base64(F.encode(x["key"], "UTF-8")), x["h"])), ",")
        h = F.coalesce("leaf", F.when((F.col("kind") == "ARRAY") & (F.size(items) == 1), F.get(items, 0)["h"]).otherwise(F.sha2(F.concat_ws(":", "kind", inner), 256)))
        hashed = settled(rows.select("id", "node", "up", "key", h.alias("h")))
        below = hashed.groupBy("id", F.col("up").alias("node")).agg(F.collect_list(F.struct("key", "h")).alias("items"))
    if not levels:
        return docs.select("id", F.lit(None).cast("string").alias("hash"))
    roots = texts.join(hashed.where("node = '$'").select("id", F.col("h").alias("hash")), "id").select("text", "hash")
    return docs.select("id", "text").join(roots, "text", "left").select("id", "hash")


# Queries and their SQL

_TYPES = ["aws_subnet", "aws_instance", "aws_iam_role", "aws_s3_bucket", "aws_sqs_queue", "aws_db_instance", "aws_vpc", "aws_default_vpc", "aws_lb", "aws_strange", "aws_kms_key"]
_CHILD_TYPES = [*CHILDREN, "aws_security_group_rule"]
_N = "CAST(p_partkey AS VARCHAR(20))"


def _choose(by: str, options: list[str]) -> str:
    return f"CASE {by} % {len(options)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


def _quoted(options: list[str | None]) -> list[str]:
    return ["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in options]


_OWN = [
    f"""'{{"id":"subnet-' || {_N} || '","map_public_ip_on_launch":' || CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || ',"availability_zone":"eu-west-' || CAST(p_size % 2 + 1 AS VARCHAR(2)) || 'a","owner_id":"11112222333' || CAST(p_size % 2 AS VARCHAR(2)) || '"}}'""",
    f"""'{{"id":"i-' || {_N} || '","instance_type":"t' || CAST(p_size % 4 AS VARCHAR(2)) || '.micro","vpc_security_group_ids":["sg-2","sg-1","sg-2"],"tags":{{"Name":"web ' || {_N} || '"}},"user_data":"x","vpc_id":"vpc-' || CAST(p_size % 9 AS VARCHAR(2)) || '"}}'""",
    f"""'{{"id":"x","name":"role' || {_N} || '","arn":"arn:aws:iam::111122223333:role/r","assume_role_policy":"{{}}","managed_policy_arns":["b","a"]}}'""", f"""'{{"bucket":"b' || {_N} || '","region":"us-east-1","versioning":[{{"enabled":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || '}}]}}'""",
    f"""'{{"url":"https://sqs.eu-north-1.amazonaws.com/444455556666/q' || {_N} || '","name":"q"}}'""", f"""'{{"identifier":"db' || {_N} || '","arn":"arn:aws:rds:ap-south-1:111122223333:db:x","password":"p"}}'""", f"""'{{"id":"vpc-' || {_N} || '","tags_all":{{"Name":"","k":"v"}},"tags":{{"Name":"net"}}}}'""", f"""'{{"id":"vpc-' || {_N} || '"}}'""", "'{\"id\":\"\"}'", f"""'{{"id":"s' || {_N} || '"}}'""", "'not json'",
]
_MARKS = ["{}", "{}", '{"instance_type":true,"tags":{"Name":true}}', None, '{"map_public_ip_on_launch":[true]}', "{}", '{"versioning":[{"enabled":true}],"managed_policy_arns":[false]}']
STATE = f"SELECT CAST(p_size % 5 AS BIGINT) AS stack, 'm.r' || {_N} AS address, {_choose('p_partkey', _quoted(_TYPES))} AS type, 'p' || CAST(p_size % 3 AS VARCHAR(2)) AS grp, {_choose('p_partkey', _OWN)} AS vals_, {_choose('p_size', _quoted(_MARKS))} AS marks, p_partkey AS k, p_size AS z FROM $part"
_CHILD = [
    f"""'{{"route_table_id":"rtb-' || {_N} || '","destination_cidr_block":"10.0.0.0/8","gateway_id":"","nat_gateway_id":"nat-' || CAST(p_size AS VARCHAR(4)) || '"}}'""", """'{"security_group_id":"sg-1","type":"egress","protocol":"tcp","from_port":1,"to_port":2,"cidr_blocks":["0.0.0.0/0","10.0.0.0/8"],"self":true}'""",
    f"""'{{"role":"r' || {_N} || '","policy_arn":"p"}}'""", f"""'{{"roles":["a","b"],"policy_arn":"q' || {_N} || '"}}'""", f"""'{{"bucket":"b' || {_N} || '","versioning_configuration":[{{"status":"' || CASE WHEN p_size % 2 = 0 THEN 'Enabled' ELSE 'Suspended' END || '"}}]}}'""", f"""'{{"security_group_id":"sg-' || {_N} || '","source_security_group_id":"sg-9"}}'""",
]
CHILD_STATE = f"SELECT CAST(p_size % 5 AS BIGINT) AS stack, 'm.r' || {_N} AS address, {_choose('p_partkey', _quoted(_CHILD_TYPES))} AS type, 'p' AS grp, {_choose('p_partkey', _CHILD)} AS vals_, CASE WHEN p_size % 10 = 9 THEN NULL ELSE '{{}}' END AS marks, p_partkey AS k, p_size AS z FROM $part"
#: Places: most rows know nothing themselves; some point at others.
PLACES = "SELECT CAST(floor(c_custkey / 12) AS BIGINT) AS stack, 'r' || CAST(c_custkey AS VARCHAR(20)) AS address, 'g' || CAST(c_custkey % 3 AS VARCHAR(2)) AS grp, 'i' || CAST(c_custkey % 700 AS VARCHAR(20)) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'eu-' || CAST(c_custkey % 4 AS VARCHAR(2)) WHEN c_custkey % 11 = 1 THEN 'global' END AS region, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 11 = 1 THEN 'a' || CAST(c_custkey % 2 AS VARCHAR(2)) END AS account FROM $customer"
REFERENCES = "SELECT CAST(floor(c_custkey / 12) AS BIGINT) AS stack, 'r' || CAST(c_custkey AS VARCHAR(20)) AS address, CAST(k AS BIGINT) AS rank_, 'i' || CAST((c_custkey + k * 3 - 5) % 700 AS VARCHAR(20)) AS id FROM $customer, (VALUES (1), (2), (3)) AS x(k) WHERE c_custkey % 4 <> 2"
_DOCS = [
    '{"Version":"2012-10-17","Statement":[{"Effect":"Allow","Action":["s3:Get*","s3:List*"],"Resource":"*N","Principal":{"AWS":["111122223333","arn:aws:iam::444455556666:root"]}}]}', '{"Statement":{"Principal":{"AWS":["arn:aws:iam::444455556666:root","arn:aws:iam::111122223333:root"]},"Resource":["*N"],"Action":["s3:List*","s3:Get*"],"Effect":"Allow"},"Version":"2012-10-17"}',
    '{"Version":"2012-10-17","Statement":[{"Effect":"Allow","Action":["s3:Get*","s3:Lizt*"],"Resource":"*N","Principal":{"AWS":["111122223333","arn:aws:iam::444455556666:root"]}}]}', '{"Version":"2012-10-17","Statement":[{"Effect":"Allow","Action":["s3:Get*","s3:List*","s3:List*"],"Resource":"*N","Principal":{"AWS":["111122223333","arn:aws:iam::444455556666:root"]}}]}',
    '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":[{"j":"N"},1,true,null]}}}}}}}}}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":[null,1,{"j":["N"]},true]}}}}}}}}}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":[null,"1",{"j":["N"]},true]}}}}}}}}}', "[1]", "not json",
]
#: Numbers of documents that mean the same; none where there is no object.
_MEANING = [0, 0, 1, 2, 3, 3, 4, None, None]
PAIRS = f"SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % {len(_DOCS)} AS x, p_size % {len(_DOCS)} AS y, replace({_choose('p_partkey', _quoted(_DOCS))}, 'N', CAST(p_partkey % 7 AS VARCHAR(9))) AS one, replace({_choose('p_size', _quoted(_DOCS))}, 'N', CAST(p_partkey % 7 AS VARCHAR(9))) AS other FROM $part"


def _state(spark, sf_dir, sql):
    return derived(spark, sf_dir, sql).withColumnRenamed("vals_", "values")


def _shown(spark, sf_dir):
    s = reduced(_state(spark, sf_dir, STATE))
    pairs = F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return s.select("stack", "address", "family", "id", "name", "region", "account", F.array_join(pairs, ";").alias("settings"), F.array_join("hidden", ",").alias("hidden"), "unread")


def _norm(spark, sf_dir):
    p = derived(spark, sf_dir, PAIRS)
    both = p.select(F.concat(F.col("id").cast("string"), F.lit("a")).alias("id"), F.col("one").alias("text")).unionByName(p.select(F.concat(F.col("id").cast("string"), F.lit("b")).alias("id"), F.col("other").alias("text")))
    h = settled(policy_hash(both))
    side = lambda s, name: h.where(F.col("id").endswith(s)).select(F.regexp_replace("id", "[ab]$", "").cast("bigint").alias("id"), F.col("hash").alias(name))
    return side("a", "one").join(side("b", "other"), "id").select("id", (F.col("one") == F.col("other")).alias("same"), F.col("one").isNotNull().alias("readable"))


QUERIES = {
    "drift_state": _shown,
    "drift_children": lambda spark, sf_dir: children(_state(spark, sf_dir, CHILD_STATE)),
    "drift_place": lambda spark, sf_dir: placed(derived(spark, sf_dir, PLACES), derived(spark, sf_dir, REFERENCES).withColumnRenamed("rank_", "rank")),
    "drift_policy_norm": _norm,
}
_M = "CASE {} " + " ".join(f"WHEN {i} THEN {'NULL' if m is None else m}" for i, m in enumerate(_MEANING)) + " END"
_KEY = "CAST(k AS VARCHAR)"
ORACLES = {
    # Each kind of resource spelled out: t is its type's number, m its marks' number (2 hides the type and name tag, 3 everything, 4 the address flag, 6 the versioning).
    "drift_state": f"""WITH s AS (SELECT *, k % {len(_TYPES)} AS t, z % {len(_MARKS)} AS m FROM ({duck(STATE)})), x AS (SELECT *, m <> 3 AS open_ FROM s)
SELECT stack, address, CASE WHEN t = 7 THEN 'aws_vpc' ELSE type END AS family, CASE WHEN open_ THEN CASE t WHEN 0 THEN 'subnet-' || {_KEY} WHEN 1 THEN 'i-' || {_KEY} WHEN 2 THEN 'role' || {_KEY} WHEN 3 THEN 'b' || {_KEY} WHEN 4 THEN 'https://sqs.eu-north-1.amazonaws.com/444455556666/q' || {_KEY} WHEN 5 THEN 'db' || {_KEY} WHEN 6 THEN 'vpc-' || {_KEY} WHEN 7 THEN 'vpc-' || {_KEY} WHEN 9 THEN 's' || {_KEY} END END AS id,
CASE WHEN NOT open_ THEN '' ELSE CASE t WHEN 1 THEN CASE WHEN m = 2 THEN '' ELSE 'web ' || {_KEY} END WHEN 2 THEN 'role' || {_KEY} WHEN 3 THEN 'b' || {_KEY} WHEN 4 THEN 'q' WHEN 5 THEN 'db' || {_KEY} WHEN 6 THEN CASE WHEN m = 2 THEN '' ELSE 'net' END ELSE '' END END AS name,
CASE WHEN t = 2 THEN 'global' WHEN open_ THEN CASE t WHEN 0 THEN 'eu-west-' || (z % 2 + 1) WHEN 3 THEN 'us-east-1' WHEN 4 THEN 'eu-north-1' WHEN 5 THEN 'ap-south-1' END END AS region, CASE WHEN open_ THEN CASE t WHEN 0 THEN '11112222333' || (z % 2) WHEN 2 THEN '111122223333' WHEN 4 THEN '444455556666' WHEN 5 THEN '111122223333' END END AS account,
CASE WHEN NOT open_ THEN '' ELSE CASE t WHEN 0 THEN CASE WHEN m = 4 OR z % 3 = 2 THEN '' WHEN z % 3 = 0 THEN 'public_ip=true' ELSE 'public_ip=false' END WHEN 1 THEN CASE WHEN m = 2 THEN '' ELSE 'instance_type=t' || (z % 4) || '.micro;' END || 'security_groups=sg-1,sg-2' WHEN 2 THEN 'policies=a,b;trust={{}}' WHEN 3 THEN CASE WHEN m = 6 THEN '' WHEN z % 2 = 0 THEN 'versioning=true' ELSE 'versioning=false' END ELSE '' END END AS settings,
CASE t WHEN 0 THEN CASE WHEN m IN (3, 4) THEN 'public_ip' ELSE '' END WHEN 1 THEN CASE m WHEN 3 THEN 'instance_type,security_groups' WHEN 2 THEN 'instance_type' ELSE '' END WHEN 2 THEN CASE WHEN m = 3 THEN 'trust,policies' ELSE '' END WHEN 3 THEN CASE WHEN m IN (3, 6) THEN 'versioning' ELSE '' END ELSE '' END AS hidden, NOT open_ OR t IN (8, 9, 10) AS unread FROM x""",
    "drift_children": f"""WITH s AS (SELECT *, k % 6 AS t FROM ({duck(CHILD_STATE)}) WHERE z % 10 <> 9) SELECT stack, 'route' AS kind, 'rtb-' || k AS parent, '10.0.0.0/8 nat-' || z AS payload FROM s WHERE t = 0 UNION SELECT stack, 'rule', 'sg-1', 'egress tcp 1-2 ' || unnest(['0.0.0.0/0', '10.0.0.0/8', 'sg-1']) FROM s WHERE t = 1 UNION SELECT stack, 'rule', 'sg-' || k, 'ingress -1 0-0 sg-9' FROM s WHERE t = 5
UNION SELECT stack, 'policy', 'r' || k, 'p' FROM s WHERE t = 2 UNION SELECT stack, 'policy', unnest(['a', 'b']), 'q' || k FROM s WHERE t = 3 UNION SELECT stack, 'versioning', 'b' || k, CASE WHEN z % 2 = 0 THEN 'true' ELSE 'false' END FROM s WHERE t = 4""",
    "drift_place": f"""WITH p AS ({duck(PLACES)}), r AS ({duck(REFERENCES)}), o AS (SELECT stack, id, arg_max(region, address) AS region, arg_max(account, address) FILTER (account IS NOT NULL AND address = m) AS account FROM (SELECT *, max(address) OVER (PARTITION BY stack, id) AS m FROM p WHERE region IS NOT NULL) WHERE address = m GROUP BY ALL),
h AS (SELECT r.stack, r.address, arg_min(o.region, rank_) FILTER (o.region <> 'global') AS rr, arg_min(o.account, rank_) FILTER (o.account IS NOT NULL) AS ra FROM r JOIN o ON o.stack = r.stack AND o.id = r.id GROUP BY ALL), s AS (SELECT p.stack, p.address, grp, coalesce(region, rr) AS region, coalesce(account, ra) AS account FROM p LEFT JOIN h ON h.stack = p.stack AND h.address = p.address)
SELECT stack, address, coalesce(region, (SELECT CASE WHEN count(DISTINCT region) = 1 THEN max(region) END FROM s g WHERE g.stack = s.stack AND g.grp = s.grp AND g.region <> 'global'), (SELECT CASE WHEN count(DISTINCT region) = 1 THEN max(region) END FROM s g WHERE g.stack = s.stack AND g.region <> 'global')) AS region, coalesce(account, (SELECT CASE WHEN count(DISTINCT account) = 1 THEN max(account) END FROM s g WHERE g.stack = s.stack)) AS account FROM s""",
    "drift_policy_norm": f"SELECT id, {_M.format('x')} = {_M.format('y')} AS same, {_M.format('x')} IS NOT NULL AS readable FROM ({duck(PAIRS)})",
}
