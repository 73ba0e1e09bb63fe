"""Rules on types, numbers, dates, plain values, objects and binary data."""

from __future__ import annotations

import enum
import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..functions.compat import at_most_decimals, is_finite
from ..functions.values import Val, is_literal, kind_of
from .rule import ASSERTS, Rule

is_string = Rule("isString", lambda v: v.has("string"))
is_boolean = Rule("isBoolean", lambda v: v.has("boolean"))
is_date = Rule("isDate", lambda v: v.has("date"))
is_array = Rule("isArray", lambda v: v.has("array"))
is_object = Rule("isObject", lambda v: v.has("object"))
is_uint8_array = Rule("isUint8Array", lambda v: v.has("binary"))
#: Regular expressions and functions are no data, so no value of a DataFrame is one.
is_reg_exp = Rule("isRegExp", lambda v: F.lit(False))
is_function = Rule("isFunction", lambda v: F.lit(False))
is_stateless_reg_exp = Rule("isStatelessRegExp", lambda v: F.lit(False))


def is_number(*, allow_nan: bool | None = None, allow_infinity: bool | None = None, max_decimal_places: int | None = None) -> Rule:
    def test(v: Val) -> Column:
        c = v.get("number")
        infinite = F.abs(c) == F.lit(float("inf"))
        finite = F.lit(True) if max_decimal_places is None else at_most_decimals(c, max_decimal_places)
        return v.has("number") & F.when(F.isnan(c), F.lit(bool(allow_nan))).when(infinite, F.lit(bool(allow_infinity))).otherwise(finite)

    given = {"allowNaN": allow_nan, "allowInfinity": allow_infinity, "maxDecimalPlaces": max_decimal_places}
    return Rule("isNumber", test, constraints={k: x for k, x in given.items() if x is not None})


is_int = Rule("isInt", lambda v: is_finite(v.get("number")) & (v.get("number") == F.rint(v.get("number"))), "number")


def _number(name: str, value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ContractError(f"{name}: the bound must be a finite number, not {value!r}")
    return float(value)


def _bound(name: str, key: str, value: float, exclusive: bool, test) -> Rule:
    n = _number(name, value)
    constraints = {key: value} | ({"exclusive": True} if exclusive else {})
    return Rule(name, lambda v: ~F.isnan(v.get("number")) & test(v.get("number"), F.lit(n)), "number", constraints)


def min_value(n: float, exclusive: bool = False) -> Rule:
    return _bound("min", "min", n, exclusive, (lambda c, b: c > b) if exclusive else (lambda c, b: c >= b))


def max_value(n: float, exclusive: bool = False) -> Rule:
    return _bound("max", "max", n, exclusive, (lambda c, b: c < b) if exclusive else (lambda c, b: c <= b))


is_positive = Rule("isPositive", lambda v: ~F.isnan(v.get("number")) & (v.get("number") > 0), "number", {"min": 0, "exclusive": True})
is_negative = Rule("isNegative", lambda v: v.get("number") < 0, "number", {"max": 0, "exclusive": True})


def is_divisible_by(n: float) -> Rule:
    if _number("isDivisibleBy", n) == 0:
        raise ContractError("isDivisibleBy: the divisor must not be 0")
    return Rule("isDivisibleBy", lambda v: F.try_mod(v.get("number"), F.lit(float(n))) == 0, "number", {"divisor": n})


def min_date(date: datetime) -> Rule:
    return Rule("minDate", lambda v: v.get("date") >= F.lit(date).cast("timestamp"), "date", {"min": date})


def max_date(date: datetime) -> Rule:
    return Rule("maxDate", lambda v: v.get("date") <= F.lit(date).cast("timestamp"), "date", {"max": date})


def _same(v: Val, value: object) -> Column:
    """Strict equality: NaN equals nothing."""
    if isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    return is_literal(v, value)


def equals(value: object) -> Rule:
    return Rule("equals", lambda v: _same(v, value), constraints={"value": value})


def not_equals(value: object) -> Rule:
    return Rule("notEquals", lambda v: ~_same(v, value), constraints={"value": value})


def _empty(v: Val) -> Column:
    return v.either_missing_or_null() | F.coalesce(v.get("string") == "", F.lit(False))


is_empty = Rule("isEmpty", _empty)
is_not_empty = Rule("isNotEmpty", lambda v: ~_empty(v))


def among(v: Val, values: list) -> Column:
    """Membership by kind: one IN list for the texts, one for the numbers, and so on."""
    out = F.lit(False)
    groups: dict[str, list] = {}
    for x in values:
        kind = "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "date"
        groups.setdefault(kind, []).append(x)
    for kind, own in groups.items():
        if kind == "null":
            hit = v.null
        elif kind == "number":
            plain = [float(x) for x in own if not math.isnan(x)]
            hit = v.get("number").isin(plain) if plain else F.lit(False)
            if len(plain) < len(own):
                hit = hit | F.isnan(v.get("number"))
        else:
            hit = v.get(kind).isin(own)
        out = out | F.coalesce(hit, F.lit(False))
    return out


def is_in(values: list) -> Rule:
    values = [*values]
    return Rule("isIn", lambda v: among(v, values), constraints={"values": values})


def is_not_in(values: list) -> Rule:
    values = [*values]
    return Rule("isNotIn", lambda v: ~among(v, values), constraints={"values": values})


def is_enum(entity: type[enum.Enum] | dict) -> Rule:
    """The values of an enum, or of a dict's keys that aren't numerals (a numeric enum may list its names backwards too)."""
    values = [m.value for m in entity] if isinstance(entity, type) else [x for k, x in entity.items() if not _numeral(k)]
    return Rule("isEnum", lambda v: among(v, values), constraints={"values": values})


def _numeral(key: object) -> bool:
    try:
        return not math.isnan(float(key))
    except (TypeError, ValueError):
        return False


def is_not_empty_object(*, nullable: bool | None = None) -> Rule:
    """At least one key; with ``nullable`` at least one value that isn't null."""

    def test(v: Val) -> Column:
        if isinstance(v.shape, T.StructType):
            c = v.get("object")
            if not nullable:
                return v.has("object") & F.lit(bool(v.shape.names))
            some = F.lit(False)
            for name in v.shape.names:
                some = some | c.getField(name).isNotNull()
            return v.has("object") & some
        if "object" not in v.kinds:
            return F.lit(False)
        if not nullable:
            return F.size(v.entries()) > 0
        return F.exists(v.entries(), lambda e: ~v.entry_item(e["value"]).either_missing_or_null())

    return Rule("isNotEmptyObject", test, "object", {"nullable": nullable} if nullable is not None else {})


def is_instance(contract: type) -> Rule:
    """An object whose type has all fields that a contract declares, each of the kind that its rules or its hint ask for and
    records of contracts down to their fields; decided from the column's type."""
    return Rule("isInstance", lambda v: v.has("object") & F.lit(_fits(contract, v.shape)), constraints={"type": contract.__name__})


def _fits(contract: type, shape: T.DataType | None) -> bool:
    from ..plans.field import declared

    return isinstance(shape, T.StructType) and all(f.input_name in shape.names and _holds(f, shape[f.input_name].dataType) for f in declared(contract).values() if f.takes_part("decode"))


def _holds(f, kind: T.DataType) -> bool:
    form = f.type.form if f.type is not None else "hint"
    if form in ("set", "records"):
        if not isinstance(kind, T.ArrayType):
            return False
        return f.type.union is not None or f.type.resolve() is None or _fits(f.type.resolve(), kind.elementType)
    if form == "map":
        return isinstance(kind, T.MapType) and (f.type.resolve() is None or _fits(f.type.resolve(), kind.valueType))
    if form == "record":
        return isinstance(kind, T.StructType) if f.type.union else _fits(f.type.resolve(), kind)
    asked = next((k for u in f.rules if not u.each and (k := u.rule.gate or ASSERTS.get(u.rule.name))), None) or (f.type.contract if f.type else None)
    return asked is None or bool(f.codecs) or kind_of(kind) == asked


def is_byte_size(minimum: int, maximum: int | None = None) -> Rule:
    def test(v: Val) -> Column:
        n = F.octet_length(v.get("binary"))
        return (n >= minimum) & (n <= maximum) if maximum is not None else n >= minimum

    return Rule("isByteSize", test, constraints={"min": minimum} | ({"max": maximum} if maximum is not None else {}))
