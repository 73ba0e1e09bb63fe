"""What a rule is: a named predicate on a value, its gate and its constraints."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..functions.compat import found
from ..functions.values import Val, truth, typed

GATES = ("string", "number", "boolean", "date", "array", "object")
#: Rules that assert a kind, and the kind.
ASSERTS = {"isString": "string", "isNumber": "number", "isInt": "number", "isBoolean": "boolean", "isDate": "date", "isArray": "array", "isObject": "object"}


@dataclass(frozen=True, eq=False)
class Rule:
    """name is the issue code. gate: the kind that the rule takes for granted once the field has been tested for it."""

    name: str
    test: Callable[[Val], Column]
    gate: str | None = None
    constraints: dict | None = None
    python: Callable | None = None

    def passes(self, value: Val) -> Column:
        """Two-valued."""
        return truth(self.test(value))

    def __call__(self, column: Column, kind: T.DataType | str = "string") -> Column:
        """The bare predicate on a column of the given type."""
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        return self.passes(typed(column, kind, null_as="null"))

    @property
    def constraints_json(self) -> str | None:
        return json.dumps(self.constraints, separators=(",", ":"), ensure_ascii=False, default=_plain) if self.constraints else None


def _plain(value: object) -> object:
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    raise TypeError(f"{value!r} can't be a constraint")


def on_text(name: str, test: Callable[[Column], Column], constraints: dict | None = None) -> Rule:
    return Rule(name, lambda v: test(v.get("string")), "string", constraints)


def pattern_rule(name: str, *patterns: str, flags: str = "", constraints: dict | None = None) -> Rule:
    """Passes if one of the patterns is found."""

    def test(c: Column) -> Column:
        hits = [found(c, p, flags) for p in patterns]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    return on_text(name, test, constraints)


def create_rule(name: str, test: Callable[[Val], Column] | None = None, *, python: Callable | None = None, constraints: dict | None = None, gate: str | None = None) -> Rule:
    """A rule of one's own: ``test`` builds a column from a value, or ``python`` judges one Python value at a time.

    A Python rule runs in Arrow batches. It sees nulls, and an error in it counts as a failure: Spark evaluates Python
    for all rows, whatever guards it.
    """
    if gate is not None and gate not in GATES:
        raise ContractError(f"rule {name}: unknown gate {gate!r}")
    if (test is None) == (python is None):
        raise ContractError(f"rule {name}: give either a column test or a Python function")
    if test is not None:
        return Rule(name, test, gate, constraints)

    def judge(value: object) -> bool:
        try:
            return bool(python(value))
        except Exception:  # noqa: BLE001  see above
            return False

    @F.pandas_udf(T.BooleanType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: judge(None if x is None or x is pd.NaT else x)).astype(bool)

    @F.pandas_udf(T.BooleanType())
    def run_json(values: pd.Series) -> pd.Series:
        return values.map(lambda x: judge(None if x is None else json.loads(x))).astype(bool)

    def by_udf(v: Val) -> Column:
        if isinstance(v.type, T.VariantType):
            return run_json(F.to_json(v.raw))
        return run(v.output())

    return Rule(name, by_udf, gate, constraints, judge)


def elements_by_python(rule: Rule, v: Val) -> Column:
    """A Python rule on every element of an array: an array of booleans. (Spark has no Python inside its array functions.)"""
    judge = rule.python

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda xs: None if xs is None else [judge(x.item() if hasattr(x, "item") else x) for x in xs])

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run_json(values: pd.Series) -> pd.Series:
        return values.map(lambda xs: None if xs is None else [judge(None if x is None else json.loads(x)) for x in xs])

    if isinstance(v.element, T.VariantType):
        return run_json(F.transform(v.plain_array(), lambda x: F.to_json(x)))
    return run(v.get("array"))
