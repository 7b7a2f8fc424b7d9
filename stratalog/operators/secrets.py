"""Scans of text lines for secrets: hits as block or warn, what is allowed, and where a value first came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import masked
from .redact import Options, find, likely, resolve

#: Categories that block; everything else found warns.
BLOCK = ("private_keys", "aws_keys", "tokens", "secret_values", "url_creds")
PLACEHOLDER = r"(?i)^(?:example|placeholder|changeme|dummy|your[_-]|xxx|<.*>|\$\{.*|\*+)"
SOFT_PATHS = r"(?i)(?:^|/)(?:tests?|docs?|examples?)/|\.md$"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "line")).select(key, (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def hits(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds one row per hit of a line: label, value, action (block or warn). Placeholders are left out. Lines that can have
    none go first, by plain tests."""
    found = rows.where(likely(F.col("line"), options)).withColumn("_f", find(F.col("line"), options))
    blocking = F.array_distinct(F.transform(F.filter("_f", lambda s: s["cat"].isin(*BLOCK)), lambda s: F.struct(s["start"], s["end"])))
    e = found.withColumn("_b", blocking).withColumn("_s", F.explode(resolve(F.col("_f"))))
    value = F.substring(F.col("line"), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    action = F.when(F.exists("_b", lambda b: (b["start"] == F.col("_s.start")) & (b["end"] == F.col("_s.end"))), "block").otherwise("warn")
    out = e.withColumns({"label": F.col("_s.label"), "value": value, "action": action, "start": F.col("_s.start")})
    return out.where(~F.col("value").rlike(PLACEHOLDER)).drop("_s", "_b", "_f")


def soften(found: DataFrame, path: str = "path") -> DataFrame:
    """In tests, docs and examples a block becomes a warning."""
    return found.withColumn("action", F.when(F.col(path).rlike(SOFT_PATHS), "warn").otherwise(F.col("action")))


def allowed(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """Hits whose value's hash is on the list, or whose line carries the mark, go."""
    left = found.withColumn("sha256", F.sha2("value", 256)).where(~F.col("line").contains("secrets-allow"))
    return left.join(hashes.select("sha256").distinct(), "sha256", "left_anti")


def shown(value: Column, label: Column) -> Column:
    """Both ends of a token; of a password only its length."""
    return F.when(label == "setting", F.format_string("(%d characters)", F.length(value))).otherwise(masked(value))


def history(found: DataFrame, current: DataFrame) -> DataFrame:
    """For each value the first commit that has it, and whether it is gone from the files now."""
    first = found.groupBy(F.sha2("value", 256).alias("sha256")).agg(F.min_by("commit", "seq").alias("commit"), F.min("seq").alias("seq"), F.count("*").alias("times"))
    now = current.select(F.sha2("value", 256).alias("sha256")).distinct().withColumn("here", F.lit(True))
    return first.join(now, "sha256", "left").select("sha256", "commit", "seq", "times", F.col("here").isNull().alias("gone"))


def _found(spark, sf_dir):
    return hits(lines(spark.read.parquet(f"{sf_dir}/documents.parquet")), Options(enabled=("secret_values", "tokens", "aws_keys")))


def _history(spark, sf_dir):
    f = _found(spark, sf_dir).withColumn("commit", F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string"))).withColumn("seq", F.col("doc_id"))
    return history(f, f.where("doc_id % 3 = 0"))


QUERIES = {
    "secrets_find": lambda spark, sf_dir: _found(spark, sf_dir).groupBy("doc_id", "line_no", "action").agg(F.count("*").alias("hits")),
    "secrets_placeholders": lambda spark, sf_dir: soften(_found(spark, sf_dir).withColumn("path", F.when(F.col("doc_id") % 2 == 0, "docs/a.md").otherwise("src/a.py"))).groupBy("action").agg(F.count("*").alias("hits")),
    "secrets_allow": lambda spark, sf_dir: allowed(_found(spark, sf_dir), _found(spark, sf_dir).where("doc_id % 2 = 0").select(F.sha2("value", 256).alias("sha256"))).select("doc_id", "sha256"),
    "secrets_history": _history,
}
_F = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
f AS (SELECT doc_id, line_no, line, regexp_extract(m, '[:=][ \t]*["'']?(.*)$', 1) AS value FROM (SELECT *, unnest(regexp_extract_all(line, '(?i)(?:api_key|apikey|credential|passphrase|passwd|password|private_key|privatekey|secret|token)s?["'']?[ \t]*[:=][ \t]*(?:"[^"\n]+|''[^''\n]+|[^\s"''&{\[(][^\s"''&]{5,})')) AS m FROM l)) """
ORACLES = {
    "secrets_find": _F + "SELECT doc_id, line_no, 'block' AS action, count(*) AS hits FROM f GROUP BY ALL",
    "secrets_placeholders": _F + "SELECT CASE WHEN doc_id % 2 = 0 THEN 'warn' ELSE 'block' END AS action, count(*) AS hits FROM f GROUP BY ALL",
    "secrets_allow": _F + "SELECT doc_id, sha256(value) AS sha256 FROM f WHERE value NOT IN (SELECT value FROM f WHERE doc_id % 2 = 0)",
    "secrets_history": _F + "SELECT sha256(value) AS sha256, arg_min('c' || (doc_id % 50), doc_id) AS commit, min(doc_id) AS seq, count(*) AS times, NOT bool_or(doc_id % 3 = 0) AS gone FROM f GROUP BY value",
}
