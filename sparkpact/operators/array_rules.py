"""Rules on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Val, is_literal
from .rule import Rule


def _holds(v: Val, value: object) -> Column:
    return F.exists(v.get("array"), lambda x: is_literal(v.item(x), value))


def array_contains(values: list) -> Rule:
    values = [*values]

    def test(v: Val) -> Column:
        out = v.has("array")
        for x in values:
            out = out & _holds(v, x)
        return out

    return Rule("arrayContains", test, "array", {"values": values})


def array_not_contains(values: list) -> Rule:
    values = [*values]

    def test(v: Val) -> Column:
        out = v.has("array")
        for x in values:
            out = out & ~_holds(v, x)
        return out

    return Rule("arrayNotContains", test, "array", {"values": values})


def _size(v: Val) -> Column:
    return F.when(v.has("array"), F.size(v.get("array")))


def array_min_size(n: int) -> Rule:
    return Rule("arrayMinSize", lambda v: _size(v) >= n, "array", {"min": n})


def array_max_size(n: int) -> Rule:
    return Rule("arrayMaxSize", lambda v: _size(v) <= n, "array", {"max": n})


def identity(v: Val, place: Column) -> Column:
    """A text that is equal for equal plain values; objects and arrays are equal only to themselves."""
    number = v.get("number") + F.lit(0.0)  # -0 is 0
    return F.coalesce(
        F.concat(F.lit("s:"), v.get("string")), F.concat(F.lit("n:"), number.cast("string")), F.concat(F.lit("b:"), v.get("boolean").cast("string")),
        F.concat(F.lit("d:"), F.unix_micros(v.get("date")).cast("string")), F.when(v.null, F.lit("null")), F.concat(F.lit("o:"), place.cast("string")),
    )


def array_unique(identifier: Callable[[Val], Val] | None = None) -> Rule:
    """No element twice; with an identifier no two elements with one key."""

    def test(v: Val) -> Column:
        keys = F.transform(v.get("array"), lambda x, i: identity(identifier(v.item(x)) if identifier else v.item(x), i))
        return F.size(F.array_distinct(keys)) == _size(v)

    return Rule("arrayUnique", test, "array")


array_not_empty = Rule("arrayNotEmpty", lambda v: _size(v) > 0, "array")
