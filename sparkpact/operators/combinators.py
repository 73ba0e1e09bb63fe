"""Rules made of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ContractError
from ..functions.values import Val
from .rule import Rule


def one_of(*rules: Rule) -> Rule:
    """At least one of the rules passes."""
    if not rules:
        raise ContractError("oneOf: at least one rule is needed")

    def test(v: Val) -> Column:
        out = F.lit(False)
        for r in rules:
            out = out | r.passes(v)
        return out

    return Rule("oneOf", test, constraints={"oneOf": [r.name for r in rules]})


def array_every(*rules: Rule) -> Rule:
    """An array whose every element passes all rules; one issue for the whole field."""
    if not rules:
        raise ContractError("arrayEvery: at least one rule is needed")
    if any(r.python for r in rules):
        raise ContractError("arrayEvery: Python rules can't run inside an array; use array_of")

    def test(v: Val) -> Column:
        def every(x: Column) -> Column:
            out = F.lit(True)
            for r in rules:
                out = out & r.passes(v.item(x))
            return out

        return v.has("array") & F.forall(v.get("array"), every)

    return Rule("arrayEvery", test, constraints={"arrayEvery": [r.name for r in rules]})
