"""Wildcards as regular expressions that never go back over what a star has passed.

Only * and ? are special. A star reaches to the first place where what follows it fits; for wildcards a later place is never
better, so every stretch but the last is an atomic group, and a pattern costs its stars times the text at most, not a
power of it. Patterns come from outside; a plain ``.*`` for each star lets one of them hold a task for ever."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand for a star and a question mark that came out of a variable and are no wildcards.
STAR, QUESTION = "\x01", "\x02"
#: Stand for a star that parts what is before it from what is behind it, and for any one character.
GAP, ONE = "\x03", "\x04"


def _quoted(pattern: Column) -> Column:
    marked = F.replace(F.regexp_replace(pattern, r"\*+", GAP), F.lit("?"), F.lit(ONE))
    plain = F.regexp_replace(marked, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.replace(F.replace(plain, F.lit(STAR), F.lit(r"\*")), F.lit(QUESTION), F.lit(r"\?"))


def _whole(joined: Column) -> Column:
    """The expression of stretches that gaps part."""

    def put(s: Column) -> Column:
        middle = F.array_join(F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: F.concat(F.lit("(?>.*?"), x, F.lit(")"))), "")
        return F.when(F.size(s) == 1, F.get(s, 0)).otherwise(F.concat(F.get(s, 0), F.when(F.size(s) > 2, middle).otherwise(F.lit("")), F.lit(".*"), F.element_at(s, -1)))

    return F.concat(F.lit("^(?s:"), F.element_at(F.transform(F.array(F.split(joined, GAP)), put), 1), F.lit(r")\z"))


def wild(pattern: Column) -> Column:
    """An anchored expression for a wildcard pattern."""
    return _whole(F.replace(_quoted(pattern), F.lit(ONE), F.lit(".")))


def arn_wild(pattern: Column, expand: bool = True) -> Column:
    """An anchored expression for a resource name of parts between colons. In the first five parts a wildcard stays inside
    its part; with ``expand`` a star that ends a part, and always one that ends a shorter pattern, may pass colons. From
    the sixth part on wildcards match anything."""

    def part(x: Column, i: Column, n: Column) -> Column:
        inside = F.replace(x, F.lit(ONE), F.lit("[^:]"))
        last = i == n - 1
        runs_on = x.endswith(GAP) & (last | F.lit(expand))

        def bounded(s: Column) -> Column:
            middle = F.array_join(F.transform(F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0))), lambda y: F.concat(F.lit("(?>[^:]*?"), y, F.lit(")"))), "")
            stays = F.concat(F.lit("(?>"), F.get(s, 0), middle, F.lit("[^:]*"), F.element_at(s, -1), F.lit("(?=:|\\z))"))
            passes = F.concat(F.lit("(?>"), F.get(s, 0), middle, F.lit(")"), F.lit(GAP))
            return F.when(F.size(s) == 1, F.get(s, 0)).when(runs_on, passes).otherwise(stays)

        cut = F.element_at(F.transform(F.array(F.split(inside, GAP)), bounded), 1)
        return F.when(i >= 5, F.replace(x, F.lit(ONE), F.lit("."))).otherwise(cut)

    parts = F.split(_quoted(pattern), ":", 6)
    joined = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(p, lambda x, i: part(x, i, F.size(p))), ":")), 1)
    return _whole(joined)


def wild_match(pattern: Column, value: Column) -> Column:
    return F.rlike(value, wild(pattern))


def arn_match(pattern: Column, value: Column, expand: bool = True) -> Column:
    """Patterns that don't begin with arn: are plain wildcards."""
    return F.when(pattern.rlike(r"^\*+$"), True).when(pattern.startswith("arn:"), F.rlike(value, arn_wild(pattern, expand))).otherwise(wild_match(pattern, value))
