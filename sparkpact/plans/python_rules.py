"""Python rules on what arrays, sets and maps hold.

Spark runs no Python inside its array functions. So what such rules see is gathered beforehand, in the nested arrays that it
lies in; one Arrow call judges it all, rule by rule over the flat values, and gives the verdicts in arrays of the same shape;
the compiler takes each from there by the place of the element. Nothing is shuffled, and a row's verdicts stay in the row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Val
from .field import DECODE, FieldSpec, RuleUse, declared

if TYPE_CHECKING:
    from .compile import Compiler

#: The step of a scope that stands for any element.
ELEMENT = "[]"
#: About how many bytes of Arrow's values are Python's objects at a time.
SLICE = 1 << 20
Scope = tuple[str, ...]
#: A use of a rule at a place in the contract: the names that lead to it, and the use.
Key = tuple[Scope, int]


@dataclass(frozen=True)
class Site:
    """judge: the rule's function. levels: how many arrays its values lie in. as_json: they are JSON texts."""

    name: str
    judge: Callable
    levels: int
    as_json: bool


def in_arrays(cls: type, inside: bool = False) -> bool:
    """Whether a contract, which must not be recursive, has Python rules on what arrays, sets and maps hold."""
    from .compile import is_nested, nested

    for f in declared(cls).values():
        if any(u.rule.python and (inside or u.each) for u in f.rules):
            return True
        held = inside or is_nested(f) and (f.type.form != "record" or any(u.each for u in f.rules))
        if any(in_arrays(c, held) for c in nested(f)):
            return True
    return False


class Gathering:
    """What the Python rules of a contract see, and where."""

    def __init__(self, compiler: Compiler):
        self.compiler = compiler
        self.sites: dict[Key, Site] = {}

    def record(self, cls: type, v: Val, scope: Scope = (), levels: int = 0) -> Column:
        """A struct with a column for each site in the record, under the site's name."""
        own = [f for f in declared(cls).values() if f.takes_part(DECODE) and f.visible(DECODE, self.compiler.setting.groups)]

        def body(v: Val) -> Column:
            seen, below = {}, {}
            for f in own:
                x = self.compiler._taken(f, v, F.lit(""))[0]
                if f.type is None or f.type.form == "hint":
                    seen |= self._plain(f, x, scope, levels)
                else:
                    self._nested(f, x, (*scope, f.name), levels, seen, below)
            return self._merged(seen, below)

        return self.compiler.looked_up(own, v, body)

    def _merged(self, seen: dict[str, Column], below: dict[str, tuple[Column, list[str]]]) -> Column:
        """One struct of columns and of those of other structs. These are bound, since each is asked for several columns; so is
        the rest, as Spark does not find a Python function whose argument has an inner lambda that uses an outer one's variable."""
        if not below:
            return F.struct(F.lit(True).alias("is"), *(c.alias(n) for n, c in seen.items()))
        whole = F.struct(F.struct(F.lit(True).alias("is"), *(c.alias(n) for n, c in seen.items())).alias("own"), *(c.alias(f"below_{part}") for part, (c, _) in below.items()))
        held = {"own": ["is", *seen], **{f"below_{part}": names for part, (_, names) in below.items()}}
        return self.compiler._let(whole, lambda r: F.struct(*(r[part][n].alias(n) for part, names in held.items() for n in names)))

    def _site(self, scope: Scope, use: RuleUse, levels: int, column: Column, as_json: bool) -> dict[str, Column]:
        site = self.sites.setdefault((scope, id(use)), Site(f"p{len(self.sites)}", use.rule.python, levels, as_json))
        return {site.name: column}

    def _running(self, uses: list[RuleUse]) -> list[RuleUse]:
        return [u for u in uses if u.rule.python and self.compiler._runs(u)]

    def _plain(self, f: FieldSpec, v: Val, scope: Scope, levels: int) -> dict[str, Column]:
        v, gate, _, _, uses = self.compiler._judged(f, v)
        seen = {}
        for u in self._running(uses):
            seen |= self._site(scope, u, levels, *_shown(v, gate))
        if isinstance(v.shape, T.MapType) and "array" not in v.kinds:
            return seen | self._each(f, F.map_values(v.get("object")), v.entry_item, scope, levels)
        return seen | (self._each(f, v.get("array"), v.item, scope, levels) if "array" in v.kinds else {})

    def _each(self, f: FieldSpec, whole: Column, item: Callable[[Column], Val], scope: Scope, levels: int) -> dict[str, Column]:
        out = {}
        for use in self._running([u for u in f.rules if u.each]):
            told = []

            def one(e: Column) -> Column:
                column, as_json = _shown(item(e))
                told.append(as_json)  # noqa: B023
                return column

            column = _whole(F.transform(whole, one))
            out |= self._site(scope, use, levels + 1, column, told[0])
        return out

    def _nested(self, f: FieldSpec, v: Val, scope: Scope, levels: int, seen: dict[str, Column], below: dict) -> None:
        def held(x: Val, scope: Scope, levels: int) -> Column:
            if f.type.union:
                cases = {}
                for tag, cls in f.type.union.cases.items():
                    self._part(cases, tag, lambda: self.record(cls, x, (*scope, tag), levels))  # noqa: B023
                return self._merged({}, cases)
            return self.record(self.compiler._contract(f), x, scope, levels)

        form, each = f.type.form, any(u.each for u in f.rules)
        if form == "record" and not each:
            self._part(below, f.name, lambda: held(v, scope, levels))
            return
        if form == "map":
            if "object" not in v.kinds:
                return
            entries = v.entries()
            seen |= self._each(f, F.transform(entries, lambda e: e["value"]), v.entry_item, scope, levels)
            item = lambda e: v.entry_item(e["value"])
        else:
            for u in self._running([u for u in f.rules if not u.each]):
                seen |= self._site(scope, u, levels, *_shown(v))
            if "array" not in v.kinds:
                return
            entries, item = v.get("array"), v.item
            seen |= self._each(f, entries, item, scope, levels) if form == "set" else {}
        if f.type.union or f.type.resolve() is not None:
            self._part(below, f.name, lambda: _whole(F.transform(entries, lambda e: held(item(e), (*scope, ELEMENT), levels + 1))))

    def _part(self, parts: dict[str, tuple[Column, list[str]]], name: str, make: Callable[[], Column]) -> None:
        """Add what ``make`` gathers, unless it has no site."""
        before = len(self.sites)
        column = make()
        if names := [s.name for s in [*self.sites.values()][before:]]:
            parts[name] = column, names


def _whole(arrays: Column) -> Column:
    """An array that isn't there as an empty one."""
    return F.coalesce(arrays, F.array())


def _shown(v: Val, gate: str | None = None) -> tuple[Column, bool]:
    """What a rule sees of a value, and whether that is JSON text."""
    if isinstance(v.type, T.VariantType):
        return F.to_json(v.raw), True
    return v.output(gate if v.raw is None else None), False


def verdicts(gathering: Gathering, seen: Column) -> Column:
    """A struct of verdicts under the sites' names, each in arrays of the shape that its values came in."""
    sites = [*gathering.sites.values()]

    def shape(levels: int) -> T.DataType:
        return T.ArrayType(shape(levels - 1)) if levels else T.BooleanType()

    @F.arrow_udf(T.StructType([T.StructField(s.name, shape(s.levels)) for s in sites]))
    def run(rows: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_judged(rows.field(s.name), s.judge, s.levels, s.as_json) for s in sites], [s.name for s in sites])

    return run(seen)


def _judged(values: pa.Array, judge: Callable, levels: int, as_json: bool) -> pa.Array:
    if levels:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), _judged(values.flatten(), judge, levels - 1, as_json))
    parts = [pa.array([], pa.bool_())]
    step = max(1, len(values) * SLICE // max(1, values.nbytes))
    for start in range(0, len(values), step):
        plain = _as_python(values.slice(start, step))
        if as_json:
            plain = [None if x is None else json.loads(x) for x in plain]
        parts.append(pa.array([judge(x) for x in plain], pa.bool_()))
    return pa.concat_arrays(parts)


def _as_python(values: pa.Array) -> list:
    """The values as Python has them: records as dicts, times as the session's clock shows them. Column by column, since Arrow
    makes a scalar of every part of a record otherwise."""
    kind = values.type
    if pa.types.is_struct(kind):
        parts = [_as_python(part) for part in values.flatten()]
        names = [kind.field(i).name for i in range(kind.num_fields)]
        out = [dict(zip(names, row, strict=True)) for row in zip(*parts, strict=True)]
    elif pa.types.is_list(kind):
        flat, ends = _as_python(values.flatten()), np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)).tolist()
        out = [flat[start:end] for start, end in zip([0, *ends], ends)]  # noqa: B905
    elif pa.types.is_timestamp(kind):
        return [None if x is None else x.replace(tzinfo=None) for x in values.to_pylist()]
    elif pa.types.is_string(kind):
        return values.to_numpy(zero_copy_only=False).tolist()
    else:
        return values.to_pylist()
    return [x if there else None for x, there in zip(out, values.is_valid().to_pylist(), strict=True)] if values.null_count else out
