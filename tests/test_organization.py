"""Trees mended node by node in order, against the same done all at once."""

import json
import random

from stratalog.sources.organization import connected, organization_nodes, organization_policies, rejects


def mended(nodes):
    """(parent, guessed) by id, one node after the other."""
    parent = {i: (None if kind == "root" else p or None) for i, kind, p in nodes}
    root = next(i for i, kind, _ in nodes if kind == "root")
    guessed = {}
    for i, kind, _ in nodes:
        if kind == "root":
            continue
        seen, at = set(), i
        while at in parent and at != root and at not in seen:
            seen.add(at)
            at = parent[at]
        if at != root:
            parent[i], guessed[i] = root, True
    return {i: (parent[i], guessed.get(i, False)) for i in parent}


def test_mending_in_order(spark):
    draw, rows, want = random.Random(7), [], {}
    for org in range(40):
        ids = [f"x{k}" for k in range(draw.randint(2, 14))]
        nodes = [(i, "root" if k == 0 else "ou", "" if draw.random() < 0.1 else draw.choice([*ids, "gone"])) for k, i in enumerate(ids)]
        draw.shuffle(nodes)
        rows += [(org, k, *n) for k, n in enumerate(nodes)]
        want |= {(org, i): v for i, v in mended(nodes).items()}
    got = connected(spark.createDataFrame(rows, "org int, ord int, id string, kind string, parent string")).collect()
    assert {(r.org, r.id): (r.parent, r.guessed) for r in got} == want and len(got) == len(rows)


def test_a_long_chain_and_damaged_snapshots(spark):
    chain = [{"id": "r", "kind": "root"}] + [{"id": f"c{k}", "kind": "ou", "parent": f"c{k - 1}" if k else "r"} for k in range(300)]
    twice = [{"id": "r", "kind": "root"}, {"id": "a", "kind": "ou", "parent": "zz"}, {"id": "a", "kind": "account", "parent": "r"}]
    files = [(1, json.dumps({"organization": {"id": "o"}, "nodes": chain})), (2, json.dumps({"organization": {"id": "o"}, "nodes": twice, "policies": [{"id": "p"}, {"id": "q", "type": "TAG_POLICY"}]})), (3, "{"), (4, json.dumps({"organization": {}, "nodes": [{"id": "r", "kind": "root"}, {"id": "s", "kind": "root"}]})), (5, None)]
    df = spark.createDataFrame(files, "org int, text string")
    rows = organization_nodes(df).collect()
    assert sum(r.org == 1 for r in rows) == 301 and not any(r.guessed for r in rows)
    assert [(r.kind, r.parent) for r in rows if r.org == 2 and r.id == "a"] == [("account", "r")]
    assert sorted(r.org for r in rejects(df).collect()) == [3, 4, 5]
    assert [(r.policy, r.name, r.readable) for r in organization_policies(df).collect()] == [("p", "p", False)]
