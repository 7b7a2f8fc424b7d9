"""The plain first test of texts: it lets pass whatever ``find`` finds something in, and few others."""

from pyspark.sql import functions as F

from stratalog.operators import redact, secrets

TEXTS = [
    "PassWord = hunter22", "x apİ_key: abcdefgh", "toKen=abcdefgh1", "ghp_" + "a1" * 18, "AKIA" + "A1" * 8, "ASIA" + "B2" * 8, "a" * 60 + "B1" * 30, "login -p secretword", "mysql -u x -phunter22", "--api-key=abc12345",
    "Authorization: Bearer abc.def", "IQoJb3JpZ2lu" + "aB1+" * 12, "Signature=abc123", "plain words only", "", "éèn ouçe 123",
]


def test_likely_keeps_all_that_is_found(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    for enabled in (("secret_values", "tokens", "aws_keys"), ("secret_values",), ("tokens",)):
        o = redact.Options(enabled=enabled)
        got = rows.select("doc_id", redact.likely(F.col("text"), o).alias("may"), F.size(redact.find(F.coalesce("text", F.lit("")), o)).alias("n")).collect()
        assert all(x["may"] for x in got if x["n"])
        assert not any(x["may"] for x in got if x["doc_id"] >= 13)
    assert sum(x["n"] > 0 for x in rows.select(F.size(redact.find(F.col("text"), redact.Options(enabled=("secret_values", "tokens", "aws_keys")))).alias("n")).collect()) > 5


def test_hits_try_likely_lines_only(spark):
    lines = spark.createDataFrame([(1, "password = hunter22"), (2, "plain")], "doc_id long, line string")
    plan = secrets.hits(lines, redact.Options(enabled=("secret_values",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?iu)(?=[" in plan
