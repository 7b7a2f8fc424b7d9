"""Nodes and edges of an inventory: merging inputs, containment, stubs, sub-graphs, names covered by keyed hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import derived, duck
from ..functions.text import pseudonym
from .org import NODES, paths


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Rows of one id from several inputs become one: real rows before stubs, then the lower source, blanks filled."""
    order = F.struct(F.col("stub"), F.col("source"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return nodes.groupBy("id").agg(first("kind"), first("parent"), first("label"), F.bool_and("stub").alias("stub"), F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst", "kind").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("label"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Stubs for parents that no row has."""
    known = nodes.select(F.col("id").alias("parent"))
    return nodes.where("parent IS NOT NULL").select("parent").distinct().join(known, "parent", "left_anti").select(F.col("parent").alias("id"), F.lit("stub").alias("kind"))


def ancestors(nodes: DataFrame, kind: str) -> DataFrame:
    """(id, found): the nearest node of a kind at or above each node."""
    up = paths(nodes).join(nodes.select(F.col("id").alias("node"), "kind"), "node").where(F.col("kind") == kind)
    return nodes.select("id").join(up.groupBy("id").agg(F.max_by("node", "depth").alias("found")), "id", "left")


def subgraph(nodes: DataFrame, edges: DataFrame, roots: list[str], depth: int) -> DataFrame:
    """Edges under the picked roots, each end lifted to its nearest ancestor of at most ``depth``; loops vanish."""
    up = paths(nodes)
    kept = up.where(F.col("node").isin(*roots)).select("id").distinct()
    lifted = up.where(F.col("depth") <= depth).groupBy("id").agg(F.max_by("node", "depth").alias("to")).join(kept, "id", "left_semi")
    e = edges.join(lifted.select(F.col("id").alias("src"), F.col("to").alias("a")), "src").join(lifted.select(F.col("id").alias("dst"), F.col("to").alias("b")), "dst")
    return e.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("edges"))


def redact(edges: DataFrame, key: bytes) -> DataFrame:
    """Both ends under keyed hashes, so that the graph keeps its shape."""
    return edges.select(pseudonym(F.col("src"), key).alias("src"), pseudonym(F.col("dst"), key).alias("dst"), "kind")


EDGES = "SELECT DISTINCT 'a' || CAST(l_suppkey AS VARCHAR(20)) AS src, 'a' || CAST(l_partkey % 100 AS VARCHAR(20)) AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'route' ELSE 'trust' END AS kind, 'l' || CAST(l_linenumber AS VARCHAR(9)) AS label FROM $lineitem WHERE l_linenumber < 5"
INPUTS = "SELECT 'c' || CAST(c_custkey % 700 AS VARCHAR(20)) AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS kind, 'n' || CAST(c_nationkey + 5 AS VARCHAR(9)) AS parent, CASE WHEN c_custkey % 4 = 1 THEN c_name END AS label, c_custkey % 5 = 0 AS stub, c_custkey AS source, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich' END AS flag FROM $customer"
KEY = b"graph key"
QUERIES = {
    "graph_build": lambda spark, sf_dir: derived(spark, sf_dir, NODES).groupBy("kind").agg(F.count("*").alias("nodes"), F.countDistinct("parent").alias("parents")),
    "graph_merge": lambda spark, sf_dir: merge_nodes(derived(spark, sf_dir, INPUTS)),
    "graph_ancestors": lambda spark, sf_dir: ancestors(derived(spark, sf_dir, NODES), "ou"),
    "graph_orphans": lambda spark, sf_dir: orphans(derived(spark, sf_dir, INPUTS).select("id", "parent").unionByName(derived(spark, sf_dir, NODES).select("id", "parent").where("id <> 'n7'"))),
    "graph_subgraph": lambda spark, sf_dir: subgraph(derived(spark, sf_dir, NODES), derived(spark, sf_dir, EDGES), ["ou1", "ou2", "n0"], 2),
    "graph_redact": lambda spark, sf_dir: redact(derived(spark, sf_dir, EDGES).select("src", "dst", "kind").distinct(), KEY),
    "net_route_edges": lambda spark, sf_dir: merge_edges(derived(spark, sf_dir, EDGES)),
}
_hex = lambda x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex()
_PS = lambda c: f"'c' || sha256(unhex('{_hex(0x5C)}') || unhex(sha256(unhex('{_hex(0x36)}') || encode({c}))))[1:24]"
_N = f"WITH RECURSIVE n AS MATERIALIZED ({duck(NODES)}), up(id, node, steps) AS (SELECT id, id, 0 FROM n UNION ALL SELECT up.id, n.parent, steps + 1 FROM up JOIN n ON up.node = n.id WHERE n.parent IS NOT NULL), p AS (SELECT id, node, max(steps) OVER (PARTITION BY id) - steps AS depth FROM up), e AS ({duck(EDGES)}) "
ORACLES = {
    "graph_build": f"SELECT kind, count(*) AS nodes, count(DISTINCT parent) AS parents FROM ({duck(NODES)}) GROUP BY kind",
    "graph_merge": f"SELECT id, arg_min(kind, (stub, source)) FILTER (WHERE kind IS NOT NULL) AS kind, arg_min(parent, (stub, source)) FILTER (WHERE parent IS NOT NULL) AS parent, arg_min(label, (stub, source)) FILTER (WHERE label IS NOT NULL) AS label, bool_and(stub) AS stub, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS flags FROM ({duck(INPUTS)}) GROUP BY id",
    "graph_ancestors": _N + "SELECT n.id, arg_max(x.node, x.depth) AS found FROM n LEFT JOIN (SELECT p.id, p.node, p.depth FROM p JOIN n m ON m.id = p.node AND m.kind = 'ou') x ON x.id = n.id GROUP BY n.id",
    "graph_orphans": f"WITH i AS (SELECT id, parent FROM ({duck(INPUTS)}) UNION ALL SELECT id, parent FROM ({duck(NODES)}) WHERE id <> 'n7') SELECT DISTINCT parent AS id, 'stub' AS kind FROM i WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM i)",
    "graph_subgraph": _N + ", k AS (SELECT DISTINCT id FROM p WHERE node IN ('ou1', 'ou2', 'n0')), l AS (SELECT id, arg_max(node, depth) AS t FROM p WHERE depth <= 2 AND id IN (SELECT id FROM k) GROUP BY id) SELECT x.t AS a, y.t AS b, count(*) AS edges FROM e JOIN l x ON x.id = e.src JOIN l y ON y.id = e.dst WHERE x.t <> y.t GROUP BY ALL",
    "graph_redact": f"SELECT DISTINCT {_PS('src')} AS src, {_PS('dst')} AS dst, kind FROM ({duck(EDGES)})",
    "net_route_edges": f"SELECT src, dst, kind, string_agg(DISTINCT label, ', ' ORDER BY label) AS label FROM ({duck(EDGES)}) GROUP BY src, dst, kind",
}
