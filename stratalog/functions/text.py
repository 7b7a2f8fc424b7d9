"""Column functions over text: spans, entropy, masks, keyed hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """Evaluate once, use many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that one fold appends to a list; longer lists are folded block by block, so that none is copied for each element.
BLOCK = 128


def swept(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``step`` puts out over all items in order: it gets a state and an item, and returns (at, add), the next state and
    an array of ``kind``."""
    empty = F.array().cast(f"array<{kind}>")

    def over(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))

        def inside(at: Column, b: Column) -> Column:
            one = lambda acc, v: let(step(acc["at"], v), lambda n: F.struct(n["at"].alias("at"), F.concat(acc["out"], n["add"]).alias("out")))
            return F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.struct(at.alias("at"), empty.alias("out")), one)

        put = lambda acc, b: let(inside(acc["at"], b), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["outs"], r["out"]).alias("outs")))
        return F.aggregate(blocks, F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("outs")), put, lambda acc: F.flatten(acc["outs"]))

    return let(items, lambda x: F.when(F.size(x) == 0, empty).otherwise(over(x)))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of each match in order; texts without a match are not cut up."""

    def cut(gaps: Column, found: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            start = at + F.length(F.get(gaps, i))
            end = start + F.length(F.get(found, i))
            return F.struct(end.alias("at"), F.array(F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("value"))).alias("add"))

        return swept(F.sequence(F.lit(0), F.size(found) - 1), F.lit(0), step, "struct<start:int,end:int,value:string>")

    both = let(F.split(text, pattern), lambda g: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: cut(g, m)))
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast(SPANS))


def between(text: Column, places: Column, joined: Callable[[Column], Column], few: int = 64) -> Column:
    """``joined`` of a function from (start, end) to the text there. A substring is looked for from the text's start, so for
    many places the text is taken apart into characters once."""
    short = lambda s, e: F.substring(text, s + 1, e - s)
    long = lambda chars: joined(lambda s, e: F.array_join(F.slice(chars, s + 1, F.greatest(e - s, F.lit(0))), ""))
    return F.when(F.size(places) <= few, joined(short)).otherwise(let(F.split(text, ""), long))


def entropy(value: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def mixed(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & ~digits.rlike(r"^(\d)\1*$") & F.call_function("luhn_check", digits)


def masked(value: Column, keep: int = 4) -> Column:
    """First and last characters with stars between; short values vanish."""
    return F.when(F.length(value) <= 2 * keep, "****").otherwise(F.concat(F.substring(value, 1, keep), F.lit("****"), F.right(value, F.lit(keep))))


def pseudonym(value: Column, key: bytes) -> Column:
    """``c`` and 24 hex digits of HMAC-SHA256 under the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(value, "UTF-8")), 256))
    return F.concat(F.lit("c"), F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 24))
