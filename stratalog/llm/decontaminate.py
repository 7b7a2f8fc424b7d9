"""Operator 7, benchmark decontamination: a prefix-filtered set join between item windows and documents.

An item's windows are its runs of ``WINDOW`` words. A document can only hold a window if it holds each of
its words, so one necessary word suffices as the window's prefix, and the rarest is the cheapest: the words
of the benchmark are counted over the whole corpus, each window takes its rarest word, and only document
words that are some window's prefix meet their windows. A meeting fixes where the window would have to
start, the window must fit into the document there (length and place), and the words are then compared.

Everything is DataFrame expressions. The prefix table is broadcast only while it is under
``BROADCAST_ROWS`` rows, which bounds its size. Beyond that, words are counted before they are joined, a bitmap of fixed
size keeps words that are no prefix inside their rows, what passes carries the words around it, and prefixes that the
corpus holds often are dealt over several keys, so the shuffle join has neither whole texts nor hot words.

Hits go back to their rows by doc_id, null or not, and by the text's length and two hashes of it, so a row gets the hits
of its own text only.

Defined cases: null and empty texts have no words and are never hit; an item without words has no window;
an item under ``WINDOW`` words is one window; equal items count once each; repeated documents are judged
alike, rows that share an id each by its own text, rows with null ids like others; empty tables give no hits; other
columns pass through where documents are filtered, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table, words

#: The contract's words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on a text whose A-Z may not have been lowered. Said as what
#: it holds, which Java tests faster than what it excludes.
ANY_CASE_WORD = r"[\p{Alnum}\x{80}-\x{10FFFF}]++"

WINDOW = 13
#: A document is contaminated when at least this part of its words is hit.
MIN_HIT_PERCENT = 5
#: Most rows of the window table (about 300 bytes each, so some 30 MB) that are sent to every executor.
BROADCAST_ROWS = 100_000
#: Bytes of the bitmap of prefixes beyond that, whatever their number, and the occurrences of a prefix that one key takes.
BITMAP_BYTES = 1 << 22
SALT_ROWS = 100_000


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), ANY_CASE_WORD)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) of each window."""
    w = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("win"))


def corpus_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often the corpus holds each word of the vocabulary, in any case."""
    each = docs.select(F.explode(words(F.col("text"), ANY_CASE_WORD)).alias("word")).select(F.lower("word").alias("word"))
    if vocabulary.count() <= BROADCAST_ROWS:
        found = each.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    else:  # a word is one row for each map task before any join
        found = each.groupBy("word").agg(F.count("*").alias("n"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(prefix, n, at, win, ids): each distinct window, its rarest word and the corpus' count of it, that word's first
    place in the window, the window's items."""
    wins = stored(item_windows(items, window).groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("ids")), "windows")
    placed = wins.select("win", F.posexplode("win").alias("at", "word")).withColumn("word", F.lower("word"))
    counts = corpus_counts(docs, stored(placed.select("word").distinct(), "vocabulary"))
    placed = placed.join(counts, "word")
    rarest = placed.groupBy("win").agg(F.min(F.struct("n", "word", "at")).alias("r"))
    return stored(wins.join(rarest, "win").select(F.col("r.word").alias("prefix"), "r.n", "r.at", "win", "ids"), "prefixes")


#: A row of documents: its id, and what tells its text from another with this id.
ROW = ("doc_id", "_size", "_h1", "_h2")


def _rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The four columns of ROW, text, and row (the columns to keep)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).alias("_size"), F.xxhash64(text).alias("_h1"), F.crc32(text).alias("_h2"), text.alias("text"), F.struct(*keep).alias("row"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    same = a["doc_id"].eqNullSafe(b["doc_id"])
    for c in ROW[1:]:
        same &= a[c] == b[c]
    return same


def _bitmap(pre: DataFrame) -> Column:
    """A literal of BITMAP_BYTES bytes; a byte is 1 where a prefix falls into it."""
    slot = F.pmod(F.xxhash64("prefix"), F.lit(BITMAP_BYTES)).cast("int")
    found = {r[0] for r in pre.select(slot).distinct().collect()}  # at most BITMAP_BYTES numbers
    return F.lit(bytes(i in found for i in range(BITMAP_BYTES)))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """ROW, start, length, ids of every place where a document holds a window; start counts words from 0."""
    pre = prefixes(docs, items, window).withColumn("win_text", F.array_join("win", " ")).withColumn("size", F.size("win")).drop("win")
    # The prefix is met in Unicode lower case, which is cheap for one word and coarser than the contract's; the few
    # words of a meeting are then compared in the contract's form.
    w = _rows(docs, ["doc_id"]).select(*ROW, words(F.col("text"), ANY_CASE_WORD).alias("w")).select(*ROW, "w", F.size("w").alias("n_words"))
    start = F.col("p") - F.col("at")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    found = [*ROW, start.alias("start"), F.col("size").alias("length"), "ids"]
    if pre.count() <= BROADCAST_ROWS:
        same = ascii_lower(F.array_join(F.slice("w", start + 1, F.col("size")), " ")) == F.col("win_text")
        # Generate, join and filter are one code-generated stage: no row with the whole array is ever written.
        each = w.select(*ROW, "w", "n_words", F.posexplode("w").alias("p", "word")).withColumn("prefix", F.lower("word"))
        return each.join(F.broadcast(pre), "prefix").where(inside & same).select(*found)
    # Places whose word may be a prefix, with the words around: ``lead`` of them stand before it.
    bitmap = _bitmap(pre)
    lower = F.transform("w", lambda x, i: F.struct(F.lower(x).alias("prefix"), i.alias("p")))
    passes = lambda x: F.substring(bitmap, F.pmod(F.xxhash64(x["prefix"]), F.lit(BITMAP_BYTES)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    each = w.select(*ROW, "w", "n_words", F.explode(F.filter(lower, passes)).alias("x")).select(*ROW, "n_words", "x.*", F.slice("w", F.greatest(F.col("x.p") - window + 2, F.lit(1)), F.lit(2 * window - 1)).alias("near"))
    lead = F.least(F.col("p"), F.lit(window - 1))
    # Counts add up to the corpus' words, so few prefixes are dealt over several keys, and only these come more than once.
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    hot = pre.where(F.col("n") > SALT_ROWS).select("prefix", salts.alias("salts")).distinct()
    keyed = pre.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts - 1, F.lit(0))))).drop("n")
    each = each.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "prefix", "left")
    each = each.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("_h1", "p"), F.col("salts")).cast("int"), F.lit(0)))
    same = ascii_lower(F.array_join(F.slice("near", lead - F.col("at") + 1, F.col("size")), " ")) == F.col("win_text")
    return each.join(keyed, ["prefix", "salt"]).where(inside & same).select(*found)


def _union_length(spans: Column) -> Column:
    """Words that sorted (start, end) spans cover."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def judged(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """row (the columns to keep), n_words, n_hit, spans, item_ids (sorted as strings), contaminated; one row per document row."""
    hit = occurrences(docs, items, window).groupBy(*ROW).agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("ids"))), lambda x: x.cast("string"))).alias("item_ids"),
    )
    n_words = F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long")
    rows = _rows(docs, keep).select(*ROW, n_words.alias("n_words"), "row")
    n_hit = F.coalesce(_union_length(F.col("spans")), F.lit(0)).cast("long")
    out = rows.join(hit, _same_row(rows, hit), "left").select("row", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_HIT_PERCENT * F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, spans, item_ids, contaminated; one row per document row."""
    return judged(docs, items, ["doc_id"], window).select("row.doc_id", "n_words", "n_hit", "spans", "item_ids", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, all columns as they were."""
    return judged(docs, items, docs.columns, window).where(~F.col("contaminated")).select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i : i + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT doc_id, i, k, w[i : i + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
