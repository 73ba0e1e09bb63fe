"""The engine: a set of contracts under one configuration, and their use on frames."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..functions.compat import strict_json
from ..functions.values import let, probed, typed, variant
from ..operators.table_rules import joined
from . import compile as C
from . import documents as D
from . import issues as I
from . import python_rules as P
from .field import DECODE, ENCODE, check, declared


@dataclass(frozen=True)
class Config:
    """auto_convert: convert values of another kind. allow_class_defaults: a missing key takes the field's default.
    stop_at_first_error: the first issue only; what comes after it is not looked at. forbid_unknown: keys that no field declares are issues.
    debug: ``explain`` names what was left out. null_as: what SQL's null stands for in typed columns, 'missing' or 'null'.
    max_depth: how many levels of a recursive contract a decoded document's value has as structs. What is deeper is judged like the
    rest, to any depth, and stands in the value as VARIANT, as it came.
    """

    auto_convert: bool = False
    allow_class_defaults: bool = False
    stop_at_first_error: bool = False
    forbid_unknown: bool = False
    debug: bool = False
    null_as: str = "missing"
    max_depth: int = 8


_RESULT = "__contract_result"
#: Where a class keeps what has been compiled of it, for all engines of equal options. It goes when the class goes.
_COMPILED = "__compiled_contract__"


class Engine:
    def __init__(self, config: Config | None = None, **options):
        known = {f.name for f in fields(Config)}
        if unknown := options.keys() - known:
            raise ContractError(f"unknown options: {', '.join(sorted(unknown))}")
        if config is not None and options:
            raise ContractError("give a Config or options, not both")
        self.config = config or Config(**options)
        if self.config.null_as not in ("missing", "null"):
            raise ContractError("null_as is 'missing' or 'null'")
        self._registered: dict[type, None] = {}
        self._sealed: set[type] = set()

    def contract(self, cls: type) -> type:
        """Class decorator: the class is a contract of this engine."""
        if not isinstance(cls, type):
            raise ContractError("a contract is a class")
        self._registered[cls] = None
        return cls

    def seal(self) -> "Engine":
        """Check all contracts and those they hold; if one is wrong, none is sealed. Sealing again does nothing new."""
        done: set[type] = set()
        waiting = [*self._registered]
        while waiting:
            cls = waiting.pop()
            if cls in done or cls in self._sealed:
                continue
            own = declared(cls)
            check(cls, own)
            done.add(cls)
            for f in own.values():
                for below in C.nested(f):
                    if not declared(below):
                        raise ContractError(f"{cls.__name__}.{f.name}: {below.__name__} declares no fields")
                    waiting.append(below)
        self._sealed |= done
        return self

    def _contract(self, cls: type) -> type:
        """The class itself or its nearest sealed base."""
        found = next((c for c in cls.__mro__ if c in self._sealed), None)
        if found is None:
            raise ContractError(f"{cls.__name__} is no sealed contract of this engine")
        return found

    def _compiled(self, cls: type) -> dict:
        """What has been compiled of a contract under this engine's options: plans, and the compilers that made them."""
        if _COMPILED not in vars(cls):
            setattr(cls, _COMPILED, {})
        return vars(cls)[_COMPILED].setdefault(self.config, {})

    def _compiler(self, groups: Iterable[str] | None, binds: bool = True, gathers: bool = False, max_depth: int | None = None, holds: bool = False) -> C.Compiler:
        if isinstance(groups, str) or groups is not None and not all(isinstance(g, str) for g in groups):
            raise ContractError("groups is a list of texts")
        c = self.config
        return C.Compiler(C.Setting(c.auto_convert, c.allow_class_defaults, c.forbid_unknown, frozenset(groups or ()), c.max_depth if max_depth is None else max_depth, binds, c.stop_at_first_error and not gathers, holds))

    def _below(self, cls: type, schema: T.StructType, groups: Iterable[str] | None, document: str | None, found: Column) -> Column:
        """The issues that ``_whole`` found, with what recursion left open judged. (A projection of its own, since Spark resolves
        nested lambdas one level at a time and bounds how often.)"""
        key, plans = (schema.json(), frozenset(groups or ()), document, "below"), self._compiled(self._contract(cls))
        if key not in plans:
            plans[key] = plans[(*key[:-1], "compiler")].judged_below(found)
        return plans[key]

    def _whole(self, cls: type, schema: T.StructType, groups: Iterable[str] | None, document: str | None) -> Column:
        """The result of a row, compiled once for each contract, schema and set of groups, by whichever engine of these options."""
        cls = self._contract(cls)
        # with a first issue alone, what recursion leaves open would hide what comes behind it: all are gathered there
        beforehand = not C.recursive(cls) and P.in_arrays(cls)
        binds, most = beforehand or not C.uses_python(cls), sys.maxsize if beforehand else self.config.max_depth
        kind = schema[document].dataType if document else schema
        holds = binds and (isinstance(kind, T.StringType) or '"variant"' in kind.json()) and C.deeper_than(cls, most)
        compiler = self._compiler(groups, binds, document is not None and C.recursive(cls), most, holds)
        key, plans = (schema.json(), compiler.setting.groups, document), self._compiled(cls)
        if key not in plans:
            if isinstance(kind, (T.VariantType, T.StringType)):
                plans[key] = self._document(compiler, cls, F.col(f"`{document}`"), isinstance(kind, T.StringType), beforehand)
            else:
                v = C.root([(f.name, f.dataType) for f in schema.fields], self.config.null_as) if document is None else typed(F.col(f"`{document}`"), kind, self.config.null_as)
                plans[key] = compiler.judged_beforehand(lambda g: g.record(cls, v), lambda: compiler.record(cls, v, F.lit(""))) if beforehand else compiler.whole(cls, v)
            plans[(*key, "compiler")] = compiler
        return plans[key]

    @staticmethod
    def _document(compiler: C.Compiler, cls: type, column: Column, is_text: bool, beforehand: bool) -> Column:
        """A document's result: its text must be one JSON value and nothing more; its keys are read in the text's order."""
        names = F.json_object_keys(column) if is_text else None
        parsed = strict_json(column) if is_text else column
        if not compiler.setting.binds:
            return compiler.record(cls, replace(variant(parsed), names=names), F.lit(""))

        def judged() -> Column:
            return let(let(parsed, probed), lambda p: compiler.record(cls, replace(variant(p["x"], p), names=names), F.lit("")))

        if not beforehand:
            return judged()
        return compiler.judged_beforehand(lambda g: let(let(parsed, probed), lambda p: g.record(cls, variant(p["x"], p))), judged)

    def columns(self, cls: type, schema: T.StructType, groups: Iterable[str] | None = None, document: str | None = None) -> tuple[Column, Column]:
        """(value, issues) for a frame of this schema. Rules on tables need a join, so they work in ``decode`` and ``check`` alone."""
        if any(C.uses_tables(f) for f in declared(self._contract(cls)).values()):
            raise ContractError(f"{cls.__name__} has rules on tables: use decode or check")
        whole = self._whole(cls, schema, groups, document)
        compiler = self._compiled(self._contract(cls))[(schema.json(), frozenset(groups or ()), document, "compiler")]
        found = compiler.judged_below(whole["issues"])
        return whole["value"], F.slice(found, 1, 1) if self.config.stop_at_first_error else found

    def decode(self, df: DataFrame, cls: type, *, groups: Iterable[str] | None = None, document: str | None = None, presence: bool = False) -> DataFrame:
        """df with ``value`` (the record; null if it has issues) and ``issues``.

        document: a column that holds whole records, as JSON text, VARIANT or a struct. Otherwise the frame's columns are
        the record's keys. presence: add ``presence``, which tells which keys were there; ``encode`` leaves the others out.
        """
        out = self._checked(df, cls, groups, document)
        if presence:
            out = out.withColumn("presence", F.when(F.size("issues") == 0, self._presence(df, cls, groups, document)))
        return out.withColumn("value", F.when(F.size("issues") == 0, F.col(_RESULT)["value"])).drop(_RESULT)

    def _presence(self, df: DataFrame, cls: type, groups: Iterable[str] | None, document: str | None) -> Column:
        """The flags of a row, compiled once like its result."""
        compiler, cls = self._compiler(groups), self._contract(cls)
        key, plans = (df.schema.json(), compiler.setting.groups, document, "presence"), self._compiled(cls)
        if key not in plans:
            plans[key] = self._flags(compiler, df, cls, document)
        return plans[key]

    def _flags(self, compiler: C.Compiler, df: DataFrame, cls: type, document: str | None) -> Column:
        kind = df.schema[document].dataType if document else None
        if isinstance(kind, (T.StringType, T.VariantType)):
            parsed = strict_json(F.col(f"`{document}`")) if isinstance(kind, T.StringType) else F.col(f"`{document}`")
            if not D.any_may_be_absent(compiler, cls):
                return F.lit(True)
            return let(let(parsed, probed), lambda p: D.presence(compiler, cls, variant(p["x"], p)))
        v = C.root([(f.name, f.dataType) for f in df.schema.fields], self.config.null_as) if document is None else typed(F.col(f"`{document}`"), kind, self.config.null_as)
        flags = D.presence(compiler, cls, v)
        return F.lit(True) if flags is None else flags

    def check(self, df: DataFrame, cls: type, *, groups: Iterable[str] | None = None, document: str | None = None) -> DataFrame:
        """df with ``is_valid`` and ``issues``."""
        return self._checked(df, cls, groups, document).drop(_RESULT).withColumn("is_valid", F.size("issues") == 0)

    def _checked(self, df: DataFrame, cls: type, groups: Iterable[str] | None, document: str | None) -> DataFrame:
        """df with the whole result as one column, from which issues and value are taken: Spark computes it once."""
        found = F.col(_RESULT)["issues"]
        schema, before = df.schema, df.columns
        whole = self._whole(cls, schema, groups, document)
        df = self._with_tables(df, self._contract(cls), groups, document)
        verdicts = [c for c in df.columns if c not in before]
        out = df.withColumn(_RESULT, whole).drop(*verdicts)
        found = self._below(cls, schema, groups, document, found)
        return out.withColumn("issues", F.slice(found, 1, 1) if self.config.stop_at_first_error else found)

    def _with_tables(self, df: DataFrame, cls: type, groups: Iterable[str] | None, document: str | None) -> DataFrame:
        """df with a column of verdicts for each of the contract's rules on tables."""
        if not any(C.uses_tables(f) for f in declared(cls).values()):
            return df
        kind = df.schema[document].dataType if document else None
        if document is None:
            v = C.root([(f.name, f.dataType) for f in df.schema.fields], self.config.null_as)
        elif isinstance(kind, T.StringType):
            v = variant(strict_json(F.col(f"`{document}`")))
        else:
            v = typed(F.col(f"`{document}`"), kind, self.config.null_as)
        for rule, value in self._compiler(groups).looked_up_in_tables(cls, v):
            if rule.verdict in df.columns:
                raise ContractError(f"{cls.__name__}: a rule on a table can be used once; make one for each field")
            df = joined(df, rule, value)
        return df

    def encode(self, df: DataFrame, cls: type, *, groups: Iterable[str] | None = None, column: str | None = None, form: str = "struct", presence: str | None = None) -> DataFrame:
        """df with ``record``: the fields under their outgoing names. column: a struct of the fields, else df's columns are they.

        form: 'struct', or a document as 'json' or 'variant', from which absent keys are left out: those that the column
        ``presence`` (of ``decode``) says were not there; without it, nulls of fields that are optional but not nullable.
        """
        if form not in ("struct", "json", "variant"):
            raise ContractError(f"form: {form!r} is none of 'struct', 'json' and 'variant'")
        if presence is not None and form == "struct":
            raise ContractError("a struct has all its fields: presence needs form='json' or 'variant'")
        cls, compiler = self._contract(cls), self._compiler(groups)
        if column is None:
            v = C.root([(f.name, f.dataType) for f in df.schema.fields], "null")
        else:
            if not isinstance(df.schema[column].dataType, T.StructType):
                raise ContractError(f"{column} is no struct")
            v = typed(F.col(f"`{column}`"), df.schema[column].dataType, "null")
        if form == "struct":
            record = compiler.encoded(cls, v)
        else:
            record = D.written(compiler, cls, v, *((F.col(f"`{presence}`"), df.schema[presence].dataType) if presence else (None, None)))
            record = F.parse_json(record) if form == "variant" else record
        return df.withColumn("record", record if column is None else F.when(F.col(f"`{column}`").isNotNull(), record))

    def uses_python(self, cls: type) -> bool:
        return C.uses_python(self._contract(cls))

    def explain(self, cls: type, groups: Iterable[str] | None = None) -> str:
        """What of the contract is in a plan; with debug also what is left out, and why."""
        setting, lines = self._compiler(groups).setting, []
        for f in declared(self._contract(cls)).values():
            for direction in (DECODE, ENCODE):
                reason = "excluded" if not f.takes_part(direction) else "hidden by groups" if not f.visible(direction, setting.groups) else ""
                if not reason:
                    rules = ", ".join(u.rule.name for u in f.rules) if direction == DECODE else ""
                    lines.append(f"{direction} {f.name} as {f.wire_name(direction)}" + (f": {rules}" if rules else ""))
                elif self.config.debug:
                    lines.append(f"{direction} {f.name}: {reason}")
        return "\n".join(lines)


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each issue, with its place in the list. (From a plain explode Spark infers a filter on the list's size, which
    it pushes below the projection that makes the list: every record would be judged again there.)"""
    return df.select(*keys, F.posexplode_outer("issues").alias("position", "issue")).where(F.col("position").isNotNull()).select(*keys, "position", "issue.*")


__all__ = ["Config", "Engine", "exploded", "I"]
