"""Operator 9, secret scans: fixed shapes, and character Markov models for strings that have none.

Three patterns give the base spans. Beyond them, what they leave of every run of key-like characters is scored by two
first-order character models, one of random strings and one of ordinary identifiers; their mean log-likelihood ratio
per character pair decides, whatever the run is made of. Both models are trained on labelled samples. Random ones are
the long values that the patterns found and ``SEEDED`` keys made of digests, so that the model knows alphabets that no
pattern has; ordinary ones are the other runs, without long ones that mix letters and digits, whose label is open. Only
pairs are counted, and the finished table, fixed in size by the alphabet, is a literal of the plan: every row is scanned
by itself, no row meets another.

Offsets come from ``split`` and ``regexp_extract_all``, which alternate over the text; only texts that hold
a match are cut up at all, and long lists of matches are placed block by block.

Defined cases: a null or empty text has no span; equal or overlapping spans of different kinds all stay;
added spans never touch a base span; a corpus without ordinary samples gets no model and so no added span; rows are
scanned one by one, so repeated and null ids change nothing; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: At least 20 and 24 characters: such a match is the whole run, as one with + and a later test of its length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: Runs that the models are trained on, and the least length of a run that is scored.
RUN = r"[A-Za-z0-9+/_-]{8,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
MIN_RUN = 16
MASK = "[SECRET]"
#: Kinds in the order of listing.
KINDS = ("assign", "access", "hex", "random")
#: Mean log ratio per character pair from which a candidate counts as random, in nats.
MIN_RATIO = 1.0
#: Keys made of digests that train the model of random strings besides those that the corpus holds.
SEEDED = 2000
#: Additive smoothing of single characters, the weight of a single character against pairs, and the symbols.
SMOOTHING = 0.5
BACKOFF = 5.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Matches that are placed by one fold.
BLOCK = 256
#: Up to so many spans a text is masked by substrings.
FEW = 64

SPAN = "array<struct<start:int,end:int,value:string>>"


def _placed(text: Column, pattern: str) -> Column:
    """(start, end, value) of each match, in code points."""

    def step(pieces: Column, found: Column):
        def run(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(found, i))
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("value"))).alias("out"))

        return run

    def cut(pieces: Column, found: Column) -> Column:
        size = F.size(found)
        blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
        long = lambda x, b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda n, v: n + F.length(v))
        # Where each block starts, then the places in each block.
        lead = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, b: F.struct((acc["at"] + long(pieces, b) + long(found, b)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )
        inside = lambda b, at: F.aggregate(
            F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, size) - 1),
            F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")),
            step(pieces, found),
            lambda acc: acc["out"],
        )
        return let(lead, lambda first: F.flatten(F.transform(blocks, lambda b: inside(b, F.get(first, b)))))

    def whole(pieces: Column) -> Column:
        # The piece behind the last match has no match of its own and must not be counted.
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(matches, lambda m: let(F.slice(pieces, F.lit(1), F.size(m)), lambda before: cut(before, m)))

    return F.when(text.rlike(pattern), let(F.split(text, pattern), whole)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    assign = F.filter(_placed(text, ASSIGN), lambda m: F.length(value(m)) >= MIN_VALUE)
    return {"assign": assign, "access": _placed(text, ACCESS), "hex": _placed(text, HEX)}


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes of all elements up to each one, in blocks so that no fold appends to a long array. ``step`` is
    associative, as a sum or a maximum, and ``zero`` changes nothing."""
    kind = lambda: F.slice(F.array(zero), F.lit(1), F.lit(0))

    def all_of(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))
        lead = F.aggregate(
            blocks,
            F.struct(zero.alias("at"), kind().alias("out")),
            lambda acc, b: F.struct(F.aggregate(part(b), acc["at"], step).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )

        def inside(b: Column, first: Column) -> Column:
            def put(acc: Column, v: Column) -> Column:
                return let(step(acc["at"], v), lambda now: F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out")))

            return F.aggregate(part(b), F.struct(first.alias("at"), kind().alias("out")), put, lambda acc: acc["out"])

        return let(lead, lambda firsts: F.flatten(F.transform(blocks, lambda b: inside(b, F.get(firsts, b)))))

    return let(values, lambda x: F.when(F.size(x) == 0, kind()).otherwise(all_of(x)))


def united(spans: Column) -> Column:
    """Sorted, disjoint (start, end) out of any spans: a union begins where a start lies behind every end before it, and
    ends with the furthest end before the next one begins."""

    def swept(x: Column, far: Column) -> Column:
        last = F.size(x) - 1
        heads = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(x, i)["start"] > F.get(far, i - 1)))
        until = lambda h: F.concat(F.transform(F.slice(h, F.lit(2), F.size(h)), lambda i: i - 1), F.array(last))
        return let(heads, lambda h: F.zip_with(h, until(h), lambda i, j: F.struct(F.get(x, i)["start"].alias("start"), F.get(far, j).alias("end"))))

    bare = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    far = lambda x: running(F.transform(x, lambda m: m["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
    return let(bare, lambda x: F.when(F.size(x) == 0, none).otherwise(let(far(x), lambda f: swept(x, f))))


def free_parts(runs: Column, base: Column, least: int = MIN_RUN) -> Column:
    """What united base spans leave of each run, where that has ``least`` characters.

    Runs and base spans are sorted and disjoint. Sorted into one list, a running count tells how many base spans begin
    before each run; those that can meet it lie between the last of them and the first behind the next run."""

    def parts(m: Column, near: Column) -> Column:
        met = F.filter(near, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        left = F.concat(F.array(m["start"]), F.transform(met, lambda b: b["end"]))
        right = F.concat(F.transform(met, lambda b: b["start"]), F.array(m["end"]))
        gaps = F.zip_with(left, right, lambda s, e: F.struct(s.alias("start"), e.alias("end"), F.substring(m["value"], s - m["start"] + 1, e - s).alias("value")))
        return F.filter(gaps, lambda g: g["end"] - g["start"] >= least)

    marked = lambda x, flag: F.transform(x, lambda m: F.struct(m["start"].alias("start"), F.lit(flag).alias("base")))

    def before(both: Column) -> Column:
        """How many base spans come before each run."""
        counted = running(F.transform(both, lambda m: m["base"]), F.lit(0), lambda a, b: a + b)
        at_runs = lambda n: F.filter(F.zip_with(both, n, lambda m, c: F.when(m["base"] == 0, c)), lambda c: c.isNotNull())
        return let(counted, at_runs)

    def cut(r: Column, b: Column) -> Column:
        def each(n: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                first = F.greatest(F.get(n, k), F.lit(1))
                until = F.coalesce(F.get(n, k + 1), F.size(b))
                return parts(m, F.slice(b, first, F.greatest(until - first + 1, F.lit(0))))

            return F.flatten(F.transform(r, one))

        return let(before(F.array_sort(F.concat(marked(r, 0), marked(b, 1)))), each)

    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(let(runs, lambda r: let(base, lambda b: cut(r, b))))


def located(docs: DataFrame) -> DataFrame:
    """row (all columns), assign, access, hex, and free: what base spans leave of the candidates."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    found = rows.select("row", *(c.alias(k) for k, c in base_spans(text).items()), _placed(text, CANDIDATE).alias("runs"))
    base = F.concat("assign", "access", "hex")
    return found.select("row", "assign", "access", "hex", let(united(base), lambda b: free_parts(F.col("runs"), b, MIN_RUN)).alias("free"))


# The models


def _pairs(value: Column) -> Column:
    """Every two neighbouring characters."""
    return F.regexp_extract_all(value, F.lit("(?=(..))"), F.lit(1))


def labelled(docs: DataFrame) -> DataFrame:
    """(value, random): the labelled samples of at least eight characters."""
    text = F.coalesce("text", F.lit(""))
    digit = lambda v: v.rlike("[0-9]")
    held = F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), *(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)))
    known = F.filter(F.transform(held, lambda v: F.regexp_extract(v, r"([A-Za-z0-9+/_-]+)$", 1)), lambda v: (F.length(v) >= MIN_RUN) & digit(v))
    is_open = lambda v: (F.length(v) >= MIN_RUN) & digit(v) & v.rlike("[A-Za-z]")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.filter(F.regexp_extract_all(bare, F.lit(RUN), F.lit(0)), lambda v: ~is_open(v))
    label = lambda values, x: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(x).alias("random")))
    # One list for both kinds, so that each text is taken apart once; no filter that Spark would push below and repeat.
    found = docs.select(F.explode(F.concat(label(known, True), label(ordinary, False))).alias("s")).select("s.*")
    digest = F.sha2(F.col("id").cast("string"), 256)
    seeds = docs.sparkSession.range(SEEDED).select(F.when(F.col("id") % 2 == 0, F.translate(F.base64(F.unhex(digest)), "=", "")).otherwise(digest).alias("value"), F.lit(True).alias("random"))
    return found.unionByName(seeds)


def train(samples: DataFrame) -> DataFrame:
    """(pair, ratio) from rows (value, random): log P(b | a) under random minus under ordinary.

    A pair's probability leans on its second character's own where the first is rare; the table has one row
    for each pair that either kind has. Map tasks hand on one row for each pair and kind.
    """
    k = len(ALPHABET)
    pairs = samples.select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(*(F.count_if(F.col("random") == x).alias(c) for x, c in ((True, "r"), (False, "o"))))
    counts = counts.select("pair", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"), "r", "o")

    def over(column: str) -> Column:
        # At most len(ALPHABET) ** 2 rows stand behind these windows.
        return F.sum(column).over(Window.partitionBy(F.lit(0)))

    def logp(x: str) -> Column:
        of_a, of_b = (F.sum(x).over(Window.partitionBy(c)) for c in "ab")
        single = (of_b + SMOOTHING) / (over(x) + SMOOTHING * k)
        return F.log((F.col(x) + BACKOFF * single) / (of_a + BACKOFF))

    return counts.select("pair", (logp("r") - logp("o")).alias("ratio"), over("o").alias("n_ordinary"))


def weights(model: DataFrame) -> Column | None:
    """The model as one literal array, by the codes of both characters; None where nothing ordinary trained it."""
    rows = model.collect()  # at most len(ALPHABET) ** 2
    if not rows or not rows[0]["n_ordinary"]:
        return None
    found = {r["pair"]: r["ratio"] for r in rows}
    every = (found.get(chr(a) + chr(b), 0.0) for a in range(128) for b in range(128))
    return F.split(F.lit(",".join(f"{x:.6g}" for x in every)), ",").cast("array<double>")


def mean_ratio(value: Column, weight: Column) -> Column:
    code = let(F.split(value, ""), lambda c: F.transform(c, F.ascii))

    def mean(c: Column) -> Column:
        last = F.length(value) - 1
        total = F.aggregate(F.sequence(F.lit(1), last), F.lit(0.0), lambda t, i: t + F.get(weight, F.get(c, i - 1) * 128 + F.get(c, i)))
        return total / last

    return let(code, mean)


def scan(docs: DataFrame) -> DataFrame:
    """row (all columns of the document), assign, access, hex, random: arrays of (start, end, value)."""
    weight = weights(train(labelled(docs)))
    random = F.array().cast(SPAN) if weight is None else F.filter("free", lambda m: mean_ratio(m["value"], weight) >= MIN_RATIO)
    return located(docs).select("row", "assign", "access", "hex", random.alias("random"))


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    def shown(k: str) -> Column:
        return F.transform(F.col(k), lambda m: F.struct(m["start"].alias("s"), F.lit(KINDS.index(k)).alias("o"), F.format_string(f"{k}:%d:%d", m["start"], m["end"]).alias("x")))

    spans = [shown(k) for k in kinds]
    return F.array_join(F.transform(F.array_sort(F.concat(*spans)), lambda x: x["x"]), ",")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``MASK``; n_chars, where there is one, is counted anew."""
    text = F.col("row.text")
    spans = scan(docs).select("row", united(F.concat(*KINDS)).alias("spans"))
    # What stands between the spans, joined by the mask. A substring is looked for from the text's start, so texts with many
    # spans are taken apart into characters once.
    left = F.concat(F.array(F.lit(0)), F.transform("spans", lambda m: m["end"]))
    right = F.concat(F.transform("spans", lambda m: m["start"]), F.array(F.length(text)))
    joined = lambda part: F.array_join(F.zip_with(left, right, part), MASK)
    few = joined(lambda s, e: F.substring(text, s + 1, e - s))
    many = let(F.split(text, ""), lambda chars: joined(lambda s, e: F.array_join(F.slice(chars, s + 1, e - s), "")))
    masked = F.when(F.size("spans") <= FEW, few).otherwise(many)
    out = spans.select("row", F.when(F.size("spans") > 0, masked).otherwise(text).alias("text"), (F.size("spans") > 0).alias("changed"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return s.select("row.doc_id", *counts, F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))
