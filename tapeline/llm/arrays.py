"""Array and text helpers as column expressions, none of which grows an array element by element over a whole text.

Prefix sums and running maxima go over blocks of about the square root of the array's size. Slices of a text go over
chunks of CHUNK code points, as a substring is found by counting from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, size: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of values (int), what came before it, from `first` on. step is associative."""
    none = F.expr("cast(array() as array<int>)")

    def inner(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocks(width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")), lambda b: F.slice(values, b * width + 1, width))
        return let(parts, lambda p: let(inner(F.transform(p, lambda part: F.aggregate(part, first, step)), first), lambda starts: F.flatten(F.zip_with(p, starts, inner))))

    return F.when(size > 0, let(F.ceil(F.sqrt(size)).cast("int"), blocks)).otherwise(none)


def running_sum(values: Column) -> Column:
    """Sum of the elements before each element of an array<int> without nulls."""
    return let(values, lambda v: _scan(v, F.size(v), F.lit(0), lambda a, x: a + x))


def running_max(values: Column) -> Column:
    """Largest of 0 and the elements before each element of an array<int> without nulls."""
    return let(values, lambda v: _scan(v, F.size(v), F.lit(0), lambda a, x: F.greatest(a, x)))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, a: Column, b: Column) -> Column:
    """Code points [a, b) of the text whose chunks are given."""
    whole = lambda x: F.floor(x / CHUNK).cast("int")
    i, j = whole(a), whole(b - 1)
    one = F.substr(F.get(parts, i), a % CHUNK + 1, b - a)
    more = F.concat(F.substr(F.get(parts, i), a % CHUNK + 1), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(F.get(parts, j), F.lit(1), (b - 1) % CHUNK + 1))
    return F.when(b <= a, F.lit("")).when(i == j, one).otherwise(more)
