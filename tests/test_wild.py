"""Wildcards against a matcher by tables, and crafted patterns against the clock."""

import itertools
import random
import time

from pyspark.sql import functions as F

from stratalog.functions.wild import arn_match, wild_match


def table_match(pattern, text, stays=False):
    """Dynamic programming over the pattern's characters; with ``stays`` wildcards don't pass a colon."""
    row = [True] + [False] * len(text)
    for p in pattern:
        if p == "*":
            for i, c in enumerate(text):
                row[i + 1] = row[i + 1] or row[i] and not (stays and c == ":")
        else:
            row = [False] + [row[i] and (p == c or p == "?" and not (stays and c == ":")) for i, c in enumerate(text)]
    return row[-1]


def arn_tokens(pattern, expand):
    """(kind, character) of each: kinds are plain, free and kept inside a part."""
    parts, out = pattern.split(":", 5), []
    for i, part in enumerate(parts):
        trailing = len(part) - len(part.rstrip("*"))
        for j, c in enumerate(part):
            free = i >= 5 or c == "*" and j >= len(part) - trailing and (expand or i == len(parts) - 1)
            out.append(("plain" if c not in "*?" else "free" if free else "kept", c))
        if i < len(parts) - 1:
            out.append(("plain", ":"))
    return out


def arn_brute(pattern, text, expand):
    if pattern and not pattern.strip("*"):
        return True
    if not pattern.startswith("arn:"):
        return table_match(pattern, text)
    row = [True] + [False] * len(text)
    for kind, p in arn_tokens(pattern, expand):
        ok = lambda c: kind == "free" or c != ":"  # noqa: E731, B023
        if kind != "plain" and p == "*":
            for i, c in enumerate(text):
                row[i + 1] = row[i + 1] or row[i] and ok(c)
        else:
            row = [False] + [row[i] and (p == c or kind != "plain" and p == "?" and ok(c)) for i, c in enumerate(text)]
    return row[-1]


def test_wildcards_by_table(spark):
    draw = random.Random(5)
    patterns = ["".join(draw.choice("ab*?.+(\\") for _ in range(draw.randint(0, 9))) for _ in range(400)] + ["*", "**", "a**b", "?*?", ""]
    texts = ["".join(draw.choice("ab.+(\\\n") for _ in range(draw.randint(0, 9))) for _ in range(40)] + ["", "a", "ab"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string").crossJoin(spark.createDataFrame([(t,) for t in texts], "t string"))
    for r in df.withColumn("m", wild_match(F.col("p"), F.col("t"))).collect():
        assert r.m == table_match(r.p, r.t), r


def test_resource_names_by_table(spark):
    draw = random.Random(6)
    piece = lambda chars, n: "".join(draw.choice(chars) for _ in range(draw.randint(0, n)))
    patterns = ["arn:" + ":".join(piece("xy*?", 4) for _ in range(draw.randint(1, 7))) for _ in range(500)] + ["*", "x*", "arn:*", "arn:*:y", "arn:x*y:*:*x*:z"]
    texts = ["arn:" + ":".join(piece("xy", 3) for _ in range(draw.randint(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in patterns], "p string").crossJoin(spark.createDataFrame([(t,) for t in texts], "t string"))
    hits = 0
    for r in df.select("p", "t", arn_match(F.col("p"), F.col("t")).alias("a"), arn_match(F.col("p"), F.col("t"), False).alias("b")).collect():
        assert (r.a, r.b) == (arn_brute(r.p, r.t, True), arn_brute(r.p, r.t, False)), r
        hits += r.a
    assert hits > 500


def test_crafted_patterns_end(spark):
    long = "a" * 300
    rows = [("*a" * 40 + "b", long, False), ("s3:*e" * 30 + "x", "s3:" + "e" * 300, False), ("*a" * 40, long, True), ("*a" * 40 + "b", long + "b", True)]
    names = [("arn:aws:s3:::" + "*a" * 40 + "b", "arn:aws:s3:::" + long, False), ("arn:" + "a*" * 30 + ":" + "a*" * 30 + ":b", "arn:" + ":".join([long] * 3), False), ("arn:" + "*a" * 40 + ":x:*", "arn:" + long + ":x:y", True), (":".join(["arn", *["a*"] * 4, "*a" * 20 + "b"]), "arn:" + ":".join([long] * 6), False)]
    many = [r for r, _ in itertools.product(rows, range(50))]
    spark.range(1).select(wild_match(F.lit("x*"), F.lit("xy"))).collect()
    began = time.monotonic()
    got = spark.createDataFrame(many, "p string, t string, want boolean").withColumn("m", wild_match(F.col("p"), F.col("t"))).collect()
    got += spark.createDataFrame(names, "p string, t string, want boolean").withColumn("m", arn_match(F.col("p"), F.col("t"))).collect()
    assert all(r.m == r.want for r in got) and time.monotonic() - began < 5
