"""Organisation trees out of snapshots: nodes, attachments and policies, with every node hung under the root.

A snapshot is one JSON text: organization, nodes, policies. Many are read at once, each under its own key. A node that
can't be followed up to the root, because a parent is missing or the way goes round, is put right under the root. Nodes
are mended in the order of the snapshot, and one that leads to a mended one is fine: so of a loop, or of all that hangs
under a missing parent, a node is mended exactly if it comes first of itself and everything above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from ..functions.rounds import settled
from ..operators.org import paths

KINDS = ("root", "ou", "account")
# Policy types that are evaluated, and how many nodes an organisation has at most before it is damaged.
POLICY_TYPES = ("SERVICE_CONTROL_POLICY", "RESOURCE_CONTROL_POLICY")
SHAPE = "organization struct<id:string,management_account:string>, nodes array<struct<id:string,kind:string,name:string,parent:string,status:string,policies:array<string>,assumed_policies:array<string>>>, policies array<struct<id:string,name:string,type:string,content:string>>"


def _parsed(files: DataFrame) -> DataFrame:
    return files.select("org", F.from_json("text", SHAPE).alias("s")).select("org", "s.*")


def _sound() -> Column:
    """One root, and every node with an id and a kind."""
    one = F.size(F.filter("nodes", lambda n: n["kind"] == "root")) == 1
    odd = F.exists("nodes", lambda n: F.coalesce(n["id"], F.lit("")).isin("") | ~F.coalesce(n["kind"].isin(*KINDS), F.lit(False)))
    return F.coalesce(F.col("organization").isNotNull() & one & ~odd, F.lit(False))


def rejects(files: DataFrame) -> DataFrame:
    """Snapshots (org) that are damaged, and what of them isn't whole is not used."""
    return _parsed(files).where(~_sound()).select("org")


def connected(nodes: DataFrame) -> DataFrame:
    """Nodes (org, ord, id, kind, parent, …) with ``guessed`` and the parent they end up with."""
    of = lambda c: F.concat_ws("\x1f", "org", c)
    n = settled(nodes.withColumn("parent", F.when(F.col("kind") != "root", F.nullif(F.col("parent"), F.lit("")))))
    # A node without a parent would be a root to the paths; only the root is.
    tree = n.select(of("id").alias("id"), F.when(F.col("kind") != "root", of(F.coalesce("parent", F.lit("\x1f")))).alias("parent"), "ord", F.col("kind") == F.lit("root"))
    above = paths(tree.select("id", "parent")).select("id", "node")
    marked = tree.select(F.col("id").alias("node"), F.col("ord").alias("n_ord"), F.col("parent").isNull().alias("top"))
    seen = above.join(marked, "node").groupBy("id").agg(F.bool_or("top").alias("reached"), F.min("n_ord").alias("first"))
    root = n.where("kind = 'root'").select("org", F.col("id").alias("root"))
    out = n.withColumn("key", of("id")).join(seen.withColumnRenamed("id", "key"), "key", "left").join(root, "org")
    stray = ~F.coalesce("reached", F.lit(False)) & (F.col("ord") == F.col("first"))
    return out.withColumn("guessed", stray).withColumn("parent", F.when(stray, F.col("root")).otherwise(F.col("parent"))).drop("key", "reached", "first", "root")


def organization_nodes(files: DataFrame) -> DataFrame:
    """org, id, kind, name, parent, status, guessed of every node of the sound snapshots. Of nodes with one id the last counts, in the place of the first."""
    each = _parsed(files).where(_sound()).select("org", F.posexplode("nodes").alias("ord", "n")).select("org", "ord", "n.*")
    once = each.groupBy("org", "id").agg(F.min("ord").alias("first"), F.max_by(F.struct("kind", "name", "parent", "status"), "ord").alias("n")).select("org", F.col("first").alias("ord"), "id", "n.*")
    return connected(once).select("org", "id", "kind", "name", "parent", "status", "guessed")


def organization_policies(files: DataFrame) -> DataFrame:
    """org, policy, name, type, readable of the policies that are evaluated; the last of one id counts."""
    p = _parsed(files).where(_sound()).select("org", F.posexplode("policies").alias("ord", "p")).select("org", "ord", "p.*").withColumn("type", F.coalesce("type", F.lit(POLICY_TYPES[0])))
    last = p.where(F.col("type").isin(*POLICY_TYPES) & (F.col("id") != "")).groupBy("org", F.col("id").alias("policy")).agg(F.max_by(F.struct(F.coalesce("name", "id").alias("name"), "type", "content"), "ord").alias("p"))
    return last.select("org", "policy", "p.name", "p.type", (F.coalesce("p.content", F.lit("")) != "").alias("readable"))


def organization_attachments(files: DataFrame) -> DataFrame:
    """org, node, policy, assumed: attached policies that the snapshot has."""
    tag = lambda c, assumed: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.struct(p.alias("policy"), F.lit(assumed).alias("assumed")))
    n = _parsed(files).where(_sound()).select("org", F.explode("nodes").alias("n"))
    each = n.select("org", F.col("n.id").alias("node"), F.explode(F.concat(tag(F.col("n.policies"), False), tag(F.col("n.assumed_policies"), True))).alias("a")).select("org", "node", "a.*").distinct()
    return each.join(organization_policies(files).select("org", "policy"), ["org", "policy"], "left_semi").select("org", "node", "policy", "assumed")


# Queries and their SQL

#: Organisations of fifty nodes: a tree by halves, with loops of one, two and three nodes, missing parents and what hangs below them.
NODES = """SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS org, CAST(c_custkey % 50 * 37 % 50 AS BIGINT) AS ord, 'n' || CAST(c_custkey % 50 AS VARCHAR(9)) AS id, CASE WHEN c_custkey % 50 = 0 THEN 'root' WHEN c_custkey % 50 > 25 THEN 'account' ELSE 'ou' END AS kind,
CASE c_custkey % 50 WHEN 0 THEN '' WHEN 5 THEN 'gone' WHEN 7 THEN '' WHEN 11 THEN 'n12' WHEN 12 THEN 'n13' WHEN 13 THEN 'n11' WHEN 8 THEN 'n9' WHEN 9 THEN 'n8' WHEN 6 THEN 'n6' ELSE 'n' || CAST(CAST(floor(c_custkey % 50 / 2) AS BIGINT) AS VARCHAR(9)) END AS parent FROM $customer"""


def _files(spark, sf_dir):
    n = derived(spark, sf_dir, NODES)
    policies = F.filter(F.array(F.concat(F.lit("p"), (F.col("ord") % 4).cast("string")), F.when(F.col("ord") % 9 == 0, F.lit("p9"))), lambda p: p.isNotNull())
    node = F.struct("ord", "id", "kind", F.upper("id").alias("name"), "parent", F.lit("ACTIVE").alias("status"), policies.alias("policies"), F.when(F.col("ord") % 5 == 0, F.array(F.lit("p1"))).alias("assumed_policies"))
    given = F.array(*(F.struct(F.lit(f"p{i}").alias("id"), F.lit(f"P{i}").alias("name"), F.lit(t).alias("type"), F.lit(c).alias("content")) for i, (t, c) in enumerate([(None, "{}"), ("RESOURCE_CONTROL_POLICY", "{}"), ("TAG_POLICY", "{}"), ("SERVICE_CONTROL_POLICY", "")])))
    whole = n.groupBy("org").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    texts = whole.select("org", F.to_json(F.struct(F.struct(F.lit("o").alias("id"), F.lit("n1").alias("management_account")).alias("organization"), "nodes", given.alias("policies"))).alias("text"))
    return settled(texts.unionByName(spark.createDataFrame([(-1, "not json"), (-2, '{"organization":{"id":"o"},"nodes":[{"id":"a","kind":"ou"}]}')], "org bigint, text string")))


QUERIES = {"src_org": lambda spark, sf_dir: organization_nodes(_files(spark, sf_dir)).select("org", "id", "kind", "parent", "guessed"), "src_org_attachments": lambda spark, sf_dir: organization_attachments(_files(spark, sf_dir))}
_WHOLE = "org IN (SELECT org FROM n WHERE kind = 'root')"
ORACLES = {
    "src_org": f"""WITH RECURSIVE n AS (SELECT org, ord, id, kind, nullif(parent, '') AS parent FROM ({duck(NODES)})), up(org, id, node) AS (SELECT org, id, id FROM n UNION SELECT up.org, up.id, n.parent FROM up JOIN n ON n.org = up.org AND n.id = up.node AND n.parent IS NOT NULL),
s AS (SELECT up.org, up.id, bool_or(m.kind = 'root') AS reached, min(m.ord) AS first FROM up JOIN n m ON m.org = up.org AND m.id = up.node GROUP BY ALL) SELECT org, id, kind, CASE WHEN NOT reached AND ord = first THEN 'n0' ELSE parent END AS parent, NOT reached AND ord = first AS guessed FROM n JOIN s USING (org, id) WHERE {_WHOLE}""",
    "src_org_attachments": f"WITH n AS ({duck(NODES)}) SELECT org, id AS node, 'p' || (ord % 4) AS policy, false AS assumed FROM n WHERE ord % 4 <> 2 AND {_WHOLE} UNION ALL SELECT org, id, 'p1', true FROM n WHERE ord % 5 = 0 AND {_WHOLE}",
}
