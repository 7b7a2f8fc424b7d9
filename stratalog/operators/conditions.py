"""One engine for policy conditions: all operators, their sets, IfExists, variables in values, results with three values.

A context is a map from a lower-case key to its values. A key with an empty list is known to be absent, a missing key is
unknown, and so is what a variable with such a key stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.wild import QUESTION, STAR, arn_match, wild_match

VERSION = "2012-10-17"
VARIABLE = r"\$\{([^}]*)\}"
# What each operator compares, before Not and after it.
KINDS = {
    "stringequals": "string", "stringnotequals": "string", "stringequalsignorecase": "caseless", "stringnotequalsignorecase": "caseless", "stringlike": "like", "stringnotlike": "like", "numericequals": "=", "numericnotequals": "=", "numericlessthan": "<", "numericlessthanequals": "<=",
    "numericgreaterthan": ">", "numericgreaterthanequals": ">=", "dateequals": "=", "datenotequals": "=", "datelessthan": "<", "datelessthanequals": "<=", "dategreaterthan": ">", "dategreaterthanequals": ">=", "bool": "bool", "binaryequals": "binary", "ipaddress": "ip", "notipaddress": "ip",
    "arnequals": "arn", "arnlike": "arn", "arnnotequals": "arn", "arnnotlike": "arn", "null": "null",
}
BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
CONDITION = "struct<op:string,key:string,values:array<string>>"


def any_of(values: Column) -> Column:
    """Kleene OR of an array."""
    return F.when(F.exists(values, lambda v: F.coalesce(v, F.lit(False))), True).when(F.exists(values, lambda v: v.isNull()), None).otherwise(False)


def all_of(values: Column) -> Column:
    """Kleene AND of an array."""
    return F.when(F.exists(values, lambda v: ~F.coalesce(v, F.lit(True))), False).when(F.exists(values, lambda v: v.isNull()), None).otherwise(True)


def filled(text: Column, context: Column, version: Column) -> Column:
    """(text, unknown, absent): the text with ``${key}``, ``${key, 'default'}``, ``${*}``, ``${?}`` and ``${$}`` filled in.
    Where a key has no value and no default, the first such key tells whether that is unknown or known to be absent, and
    the text is null. Other versions take the text as it is."""
    name = lambda inner: F.trim(F.substring_index(inner, ",", 1))

    def fill(inner: Column) -> Column:
        default = F.regexp_replace(F.regexp_extract(inner, r"(?s),(.*)$", 1), r"^[ '\"]+|[ '\"]+$", "")
        got = F.get(F.element_at(context, F.lower(name(inner))), 0)
        safe = F.replace(F.replace(got, F.lit("*"), F.lit(STAR)), F.lit("?"), F.lit(QUESTION))
        own = F.when(name(inner) == "*", STAR).when(name(inner) == "?", QUESTION).when(name(inner) == "$", "$")
        return F.coalesce(own, safe, F.when(inner.contains(","), default))

    def whole(names: Column) -> Column:
        values = F.transform(names, lambda n: fill(F.trim(n)))

        def put(v: Column) -> Column:
            missing = F.get(F.filter(F.zip_with(names, v, lambda n, x: F.when(x.isNull(), F.lower(name(F.trim(n))))), lambda n: n.isNotNull()), 0)
            joined = F.array_join(F.zip_with(F.split(text, VARIABLE), v, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
            absent = F.coalesce(F.size(F.element_at(context, missing)) == 0, F.lit(False))
            return F.struct(F.when(missing.isNull(), joined).alias("text"), (missing.isNotNull() & ~absent).alias("unknown"), (missing.isNotNull() & absent).alias("absent"))

        return let(values, put)

    plain = F.struct(text.alias("text"), F.lit(False).alias("unknown"), F.lit(False).alias("absent"))
    return F.when((version == VERSION) & text.contains("${"), let(F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(1)), whole)).otherwise(plain)


def moment(text: Column) -> Column:
    """Seconds since 1970 out of a number or an ISO time, which is UTC without a zone."""
    s = F.trim(text)
    return F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("double")).otherwise(F.unix_micros(F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), s))) / 1e6)


def address_bits(text: Column) -> Column:
    """The 32 or 128 bits of an address as text; null if it is none."""
    bits = lambda number, width, base: F.lpad(F.conv(number, base, 2), width, "0")
    four = F.when(text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), F.array_join(F.transform(F.split(text, r"\."), lambda p: bits(p, 8, 10)), ""))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(text, "::", 1)), F.when(text.contains("::"), groups(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
    held = F.size(left) + F.size(right)
    six = F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), 8 - held), right), lambda g: bits(g, 16, 16)), "")
    # One double colon at most, and no single one at an end.
    sound = text.rlike(r"^[0-9A-Fa-f:]+$") & text.contains(":") & ~text.rlike("::.*::|:::|^:[^:]|[^:]:$") & ~F.exists(F.concat(left, right), lambda g: F.length(g) > 4) & F.when(text.contains("::"), held < 8).otherwise(held == 8)
    return F.coalesce(four, F.when(sound, six))


def in_network(address: Column, network: Column) -> Column:
    plain = lambda x: address_bits(F.substring_index(F.trim(x), "/", 1))

    def inside(own: Column, block: Column) -> Column:
        n = F.when(network.contains("/"), F.substring_index(F.trim(network), "/", -1).try_cast("int")).otherwise(F.length(block))
        return (F.length(own) == F.length(block)) & n.between(0, F.length(block)) & (F.substring(own, F.lit(1), n) == F.substring(block, F.lit(1), n))

    return let(plain(address), lambda own: let(plain(network), lambda block: inside(own, block)))


def compared(kind: Column, date: Column, given: Column, wanted: Column) -> Column:
    """One value against one; a value of the wrong kind never matches."""
    literal = F.replace(F.replace(wanted, F.lit(STAR), F.lit("*")), F.lit(QUESTION), F.lit("?"))
    low, number = lambda x: F.lower(F.trim(x)), lambda x: F.when(date, moment(x)).otherwise(F.trim(x).try_cast("double"))
    sides = F.struct(number(given).alias("a"), number(wanted).alias("b"))
    ordered = let(sides, lambda s: F.when(kind == "=", s["a"] == s["b"]).when(kind == "<", s["a"] < s["b"]).when(kind == "<=", s["a"] <= s["b"]).when(kind == ">", s["a"] > s["b"]).otherwise(s["a"] >= s["b"]))
    # What isn't base64 to the last sign stands for its own bytes.
    raw = lambda x: F.when(F.trim(x).rlike(BASE64), F.try_to_binary(F.trim(x), F.lit("base64"))).otherwise(F.encode(F.trim(x), "UTF-8"))
    found = (
        F.when(kind == "string", given == literal).when(kind == "caseless", F.lower(given) == F.lower(literal)).when(kind == "like", wild_match(wanted, given)).when(kind == "arn", arn_match(wanted, given, expand=False))
        .when(kind == "bool", low(given) == low(wanted)).when(kind == "binary", raw(given) == raw(wanted)).when(kind == "ip", in_network(given, wanted)).otherwise(ordered)
    )
    return F.coalesce(found, F.lit(False))


def parsed(op: Column) -> Column:
    """What an operator's name says; its kind is null if it isn't known."""
    low = F.lower(F.trim(op))
    bare = F.regexp_replace(low, "^for(allvalues|anyvalue):", "")
    base = F.regexp_replace(bare, "(?<=.)ifexists$", "")
    marked = base != low
    kind = F.get(F.array(*map(F.lit, KINDS.values())), F.array_position(F.array(*map(F.lit, KINDS)), base).cast("int") - 1)
    return F.struct(
        F.when((base == "null") & marked, None).otherwise(kind).alias("kind"), low.startswith("forallvalues:").alias("every"), low.startswith("foranyvalue:").alias("some"), (base != bare).alias("optional"), base.contains("not").alias("negated"), base.startswith("date").alias("date"),
        (base.startswith("string") | base.startswith("arn")).alias("varies"),
    )


def condition(op: Column, key: Column, values: Column, context: Column, version: Column) -> Column:
    """(result, error): does the request meet the condition. An operator that isn't known is an error."""
    said = lambda word: F.exists(values, lambda v: F.lower(F.trim(v)) == word)
    plain = lambda v: F.struct(v.alias("text"), F.lit(False).alias("unknown"), F.lit(False).alias("absent"))

    def held(o: Column, given: Column) -> Column:
        absent = F.when(o["kind"] == "null", said("true")).when(o["optional"] | o["every"], True).when(o["some"], False).otherwise(o["negated"])
        wanted = F.transform(values, lambda v: F.when(o["varies"], filled(v, context, version)).otherwise(plain(v)))

        def met(w: Column) -> Column:
            one = lambda g: any_of_bound(F.transform(w, lambda v: F.when(v["unknown"], None).when(v["absent"], False).otherwise(compared(o["kind"], o["date"], g, v["text"]))))
            # A set operator negates value by value; without one, no value may match.
            turned = o["negated"] & (o["every"] | o["some"])
            hits = F.transform(given, lambda g: let(one(g), lambda x: F.when(turned, ~x).otherwise(x)))
            return let(hits, lambda h: F.when(o["every"], all_of(h)).when(o["some"], any_of(h)).otherwise(F.when(o["negated"], ~any_of(h)).otherwise(any_of(h))))

        return F.when(given.isNull(), None).when(F.size(given) == 0, absent).when(o["kind"] == "null", said("false")).otherwise(let(wanted, met))

    def both(o: Column) -> Column:
        result = let(F.element_at(context, F.lower(key)), lambda given: held(o, given))
        return F.struct(F.when(o["kind"].isNotNull(), result).otherwise(F.lit(False)).alias("result"), F.when(o["kind"].isNull(), F.concat(F.lit("operator "), op)).alias("error"))

    return let(parsed(op), both)


def any_of_bound(values: Column) -> Column:
    """``any_of`` of what is worked out once."""
    return let(values, any_of)
