"""Operator 10, quality rules: a cascade that stops at the first rule to reject a text.

Every rule is a native expression over one text. ``plan_cascade`` runs each rule several times over a sample of the
corpus, after a warm-up, and takes the median time less that of a job without a rule; it orders the rules by rejection
per cost. ``failed_rule`` evaluates them in that order inside one CASE, so that a rejected text pays only for the rules
up to the one that rejects it. The report has features
that its readers ask for of every text; what only rules need is still worked out in the cascade alone. The order never
changes which texts are kept.

Defined cases: a null or empty text has no words, so it is rejected as too short; ties in the order
are broken by the rules' names; repeated rows are judged alike; an empty table gives an empty result;
extra columns pass through, and the operator adds only the columns that it names.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, let, table, words

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 500
#: Timed runs of each rule.
RUNS = 3

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_TEN_WORDS = 3
MAX_DUP_LINE_PERCENT = 50
MAX_MEAN_WORD = 40
MAX_DIGIT_PERCENT = 70


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def n_digits(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9]")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(SPACED_WORD))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _windows(w: Column) -> Column:
    """(two hashes of 96 bits in all, place) of each window of three words, equal windows side by side."""
    hashed = F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.struct(*(h(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias(n) for h, n in ((F.xxhash64, "h"), (F.hash, "g"))), i.alias("i")),
    )
    return F.when(F.size(w) >= 3, F.sort_array(hashed))


def _repeated(s: Column) -> Column:
    """Places of the windows that occur at least twice, ascending."""
    same = lambda j, k: (F.get(s, j)["h"] == F.get(s, k)["h"]) & (F.get(s, j)["g"] == F.get(s, k)["g"])
    found = F.filter(s, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def _covered(d: Column) -> Column:
    """How many words the windows at these places cover."""
    step = lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
    return F.coalesce(F.aggregate(d, start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside a window of three words that the text holds twice or more."""
    return let(let(let(words(text), _windows), _repeated), _covered)


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_digits": n_digits,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function from a feature's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("too_short", lambda f: f("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words")),
    Rule("symbols", lambda f: 10 * f("n_symbols") > MAX_SYMBOLS_PER_TEN_WORDS * f("n_words")),
    Rule("repeated_lines", lambda f: 100 * f("n_dup_lines") > MAX_DUP_LINE_PERCENT * f("n_lines")),
    Rule("mostly_digits", lambda f: 100 * f("n_digits") > MAX_DIGIT_PERCENT * f("word_chars")),
    Rule("long_words", lambda f: f("word_chars") > MAX_MEAN_WORD * f("n_words")),
)
#: The rules that every user of the contract shares; the others are this cascade's own.
BASE = ("too_short", "repeated_words")


def _of(text: Column, known: dict[str, Column]) -> Callable[[str], Column]:
    """A feature's column: one that is worked out already, or its expression over the text."""
    return lambda name: known[name] if name in known else FEATURES[name](text)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by falling rejection per second on a sample of about ``rows`` rows: (rule, seconds, share rejected)."""
    total = docs.count()
    part = docs.select(F.col(text).alias("_text"))
    if total > rows:
        part = part.sample(fraction=rows / total, seed=7)
    part = part.persist()

    def timed(reject: Column) -> tuple[float, float]:
        took, hit = [], 0.0
        asked = part.agg(F.count_if(reject), F.count("*"))
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            found, n = asked.first()
            took.append(time.perf_counter() - began)
            hit = found / max(1, n)
        return statistics.median(took[1:]), hit

    try:
        part.count()
        empty, _ = timed(F.col("_text").isNull())
        measured = []
        for rule in rules:
            seconds, hit = timed(rule.rejects(_of(F.col("_text"), {})))
            measured.append((rule, max(seconds - empty, 1e-6), hit))
    finally:
        part.unpersist()
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[0].name))


def failed_rule(order: list[Rule], feature: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects the text, null if it passes all."""
    found: Column | None = None
    for rule in order:
        found = (F if found is None else found).when(rule.rejects(feature), F.lit(rule.name))
    return found


def quality_filter(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, all columns as they were. Words are split once; the cascade works out the rest."""
    order = [rule for rule, _, _ in plan_cascade(docs, text=text, rows=rows)]
    return docs.where(let(words(F.col(text)), lambda w: failed_rule(order, _of(F.col(text), _of_words(w)))).isNull())


def _of_words(w: Column) -> dict[str, Column]:
    """The features that an array of words gives."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_repeat_words": let(let(_windows(w), _repeated), _covered),
    }


#: Features that the report has of every text; the others are worked out by the cascade where it gets so far.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the features in REPORTED, and the rule of the cascade that rejects the text."""
    order = [rule for rule, _, _ in plan_cascade(docs, rows=rows)]
    text = F.coalesce(F.col("text"), F.lit(""))
    # One array of words feeds four features; each step is used more than once below, so it stays a step of its own.
    a = docs.select("doc_id", text.alias("_t"), words(text).alias("_w"), _lines(text).alias("_l"))
    a = a.select(
        "doc_id", "_t", "_l", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), n_symbols(F.col("_t")).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), _windows(F.col("_w")).alias("_s"),
    )
    a = a.withColumn("n_repeat_words", _covered(_repeated(F.col("_s"))))
    known = {c: F.col(c) for c in REPORTED} | {"n_lines": F.size("_l").cast("long")}
    return a.select("doc_id", *REPORTED, failed_rule(order, _of(F.col("_t"), known)).alias("failed_rule"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_report(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return q.select("doc_id", *REPORTED, base.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), tri AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_digits > 70 * word_chars OR word_chars > 40 * n_words) AS kept
FROM f
"""
