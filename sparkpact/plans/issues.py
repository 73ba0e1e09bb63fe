"""Issues: what is wrong with a record, where, and by which rule."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<path:string,code:string,message:string,context:string,constraints:string>"
ISSUES = f"array<{ISSUE}>"
#: The same while recursion may leave nodes open: the issue that stands for one holds it.
HELD = f"array<{ISSUE[:-1]},node:variant>>"
#: Codes that are no rule's name: fixed values.
INVALID_INPUT, UNKNOWN_KEY, MISSING, BAD_TAG, NOT_CONVERTED, TOO_DEEP = "invalidInput", "whitelistViolation", "isDefined", "invalidDiscriminator", "conversionFailed", "depthExceeded"


def none(kind: str = ISSUES) -> Column:
    return F.array().cast(kind)


def text(value: Any) -> Column:
    """A text column: null, a plain text, or a column as it is."""
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def issue(path: Column, code: str, message: Any = None, context: Any = None, constraints: Any = None, *more: Column) -> Column:
    if context is not None and not isinstance(context, Column):
        context = json.dumps(context, separators=(",", ":"), ensure_ascii=False)
    return F.struct(path.alias("path"), F.lit(code).alias("code"), text(message).alias("message"), text(context).alias("context"), text(constraints).alias("constraints"), *more)


@dataclass(frozen=True)
class Maybe:
    """An issue under a condition; a condition that is null is no issue."""

    condition: Column
    issue: Column


def when(condition: Column, one: Column) -> Maybe:
    return Maybe(condition, one)


def gathered(maybe: list[Maybe], first: bool = False, kind: str = ISSUES) -> Column:
    """The issues whose conditions hold, or the first of them alone: then no later condition is looked at.

    A value without fault only costs its conditions: the issues are built where one of them holds.
    """
    if not maybe:
        return none(kind)
    if first:
        out = F.when(maybe[0].condition, F.array(maybe[0].issue))
        for m in maybe[1:]:
            out = out.when(m.condition, F.array(m.issue))
        return out.otherwise(none(kind))
    each = F.array_compact(F.array(*(F.when(m.condition, m.issue) for m in maybe)))
    return F.when(reduce(or_, (m.condition for m in maybe)), each).otherwise(none(kind))


def joined(lists: list[Column], first: bool = False, kind: str = ISSUES) -> Column:
    """All issues of the lists, or those of the first list that has any: then no later list is made."""
    if len(lists) < 2:
        return lists[0] if lists else none(kind)
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists[:-1]), lists[-1]) if first else F.concat(*lists)
