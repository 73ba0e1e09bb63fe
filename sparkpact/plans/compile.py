"""From a contract to columns: the decoded record, its issues, and the encoded record.

All of it is expressions over one row: no join, no shuffle, and no Python unless a rule or codec brings it. Groups and
configuration are settled here, so what they rule out is not in the plan at all.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..functions.compat import brackets_deep, iso_text, number_text, to_instant, to_number
from ..functions.values import Val, constant, kind_of, let, probed, truth, typed, variant
from ..operators.array_rules import identity
from ..operators.rule import ASSERTS, Rule, elements_by_python
from ..operators.table_rules import TableRule
from . import issues as I
from . import python_rules as P
from .field import DECODE, ENCODE, FieldSpec, RuleUse, declared, has_default

#: Asserters that test more than their kind.
_MORE_THAN_KIND = {"isNumber", "isInt"}
_CONVERTIBLE = {"string", "number", "boolean", "date"}
#: How many levels are judged at a time below ``max_depth``.
LEVELS_BELOW = 1
_SQL = {"string": "string", "number": "double", "boolean": "boolean", "date": "timestamp", "binary": "binary"}


@dataclass(frozen=True)
class Setting:
    auto_convert: bool
    allow_class_defaults: bool
    forbid_unknown: bool
    groups: frozenset[str]
    max_depth: int
    #: Whether what is looked up may be bound inside a lambda. Spark runs no Python there, so contracts with Python rules go without.
    binds: bool = True
    #: Only a record's first issue is asked for.
    first: bool = False
    #: Whether recursion may lead below ``max_depth``: an issue then has room for the node that it leaves open.
    holds: bool = False


def is_kind(v: Val, kind: str) -> Column:
    """The gate's test: the kind, and for numbers not NaN."""
    if kind == "number":
        return v.has("number") & F.coalesce(~F.isnan(v.get("number")), F.lit(False))
    return v.has(kind)


def convert(v: Val, kind: str, inside: bool = False) -> Val:
    """The value as the kind, where it can be converted. inside: of an array, whose own arrays become empty texts."""
    text, number, flag, date = (v.get(k) for k in ("string", "number", "boolean", "date"))
    own = F.when(is_kind(v, kind), v.get(kind))
    if kind == "string":
        other = F.coalesce(number_text(number), flag.cast("string"), iso_text(date), F.when(v.has("object"), F.lit("[object Object]")))
        if "array" in v.kinds and not inside:
            texts = F.transform(v.get("array"), lambda x: F.coalesce(convert(v.item(x), "string", True).get("string"), F.lit("")))
            other = F.coalesce(other, F.array_join(texts, ",", ""))
    elif kind == "number":
        other = F.coalesce(to_number(text), flag.cast("int").cast("double"), F.unix_millis(date).cast("double"))
    elif kind == "boolean":
        other = F.when(text.isin("true", "1") | (number == 1), F.lit(True)).when(text.isin("false", "0") | (number == 0), F.lit(False))
    else:
        whole = ~F.isnan(number) & (F.abs(number) <= 8.64e15)
        other = F.coalesce(to_instant(text), F.when(whole, F.timestamp_millis(F.when(whole, number).cast("long"))))
    return Val(v.kinds | {kind: F.coalesce(own, other)}, v.missing, v.null, element=v.element, shape=v.shape)


class Compiler:
    def __init__(self, setting: Setting):
        self.setting = setting
        #: The contracts (and the union tags allowed in them) that recursion leads to below ``max_depth``, in the order found.
        self.below: list[tuple[type, str | None]] = []
        #: The names that lead to the record in hand, and the verdicts of Python rules judged beforehand, by place and use.
        self.scope: P.Scope = ()
        self.verdicts: dict[P.Key, Column] = {}
        #: Whether nobody asks for values: below ``max_depth`` they stand as they came.
        self.issues_alone = False

    @contextmanager
    def _inside(self, name: str, at: Column | None = None):
        """In what is held under a name; at: in an element, whose verdicts lie at its place."""
        before = self.scope, self.verdicts
        self.scope = (*self.scope, name)
        if at is not None:
            self.verdicts = {k: F.get(v, at) if k[0][: len(self.scope)] == self.scope else v for k, v in self.verdicts.items()}
        try:
            yield
        finally:
            self.scope, self.verdicts = before

    def _passes(self, use: RuleUse, v: Val) -> Column:
        verdict = self.verdicts.get((self.scope, id(use)))
        return use.rule.passes(v) if verdict is None else truth(verdict)

    def judged_beforehand(self, seen, body) -> Column:
        """The body with the verdicts of Python rules at hand. seen: what a ``Gathering`` finds for them."""
        gathering = P.Gathering(self)
        found = seen(gathering)
        if not gathering.sites:
            return body()

        def with_verdicts(r: Column) -> Column:
            self.verdicts = {k: r[s.name] for k, s in gathering.sites.items()}
            try:
                return body()
            finally:
                self.verdicts = {}

        return let(P.verdicts(gathering, found), with_verdicts)

    def _issue(self, path: Column, code: str, message=None, context=None, constraints=None, node: Column | None = None) -> Column:
        more = [(F.lit(None).cast("variant") if node is None else node).alias("node")] if self.setting.holds else []
        return I.issue(path, code, message, context, constraints, *more)

    def _none(self) -> Column:
        return I.none(self._issues)

    @property
    def _issues(self) -> str:
        return I.HELD if self.setting.holds else I.ISSUES

    def _gathered(self, maybe: list[I.Maybe]) -> Column:
        return I.gathered(maybe, self.setting.first, self._issues)

    def _joined(self, lists: list[Column]) -> Column:
        return I.joined(lists, self.setting.first, self._issues)

    def _result(self, value: Column, found: Column | None) -> Column:
        return F.struct((F.lit(None) if self.issues_alone else value).alias("value"), (self._none() if found is None else found).alias("issues"))

    def _let(self, value: Column, body) -> Column:
        return let(value, body) if self.setting.binds else body(value)

    # ---- in ----
    # A result is a struct of a value and its issues. Documents are looked into once: what is found is bound by ``let``.

    def record(self, cls: type, v: Val, prefix: Column, depth: int = 0, tag: str | None = None) -> Column:
        """The result of a value that should be an object. tag: a key that belongs to a union."""
        fields = declared(cls)
        known = {f.input_name for f in fields.values()} | ({tag} if tag else set())
        own = [f for f in fields.values() if f.takes_part(DECODE) and f.visible(DECODE, self.setting.groups)]

        def body(v: Val) -> Column:
            return self._body(own, known, v, prefix, depth)

        return self.looked_up(own, v, body)

    def looked_up(self, own: list[FieldSpec], v: Val, body) -> Column:
        """The body of an object: a document's fields are looked up and probed once, and bound."""
        if not isinstance(v.shape, T.VariantType) or not own:
            return body(v)
        names = [*dict.fromkeys(f.input_name for f in own)]

        def probes(children: list[Column], is_object: Column) -> Column:
            return F.struct(*(c.alias(f"c{k}") for k, c in enumerate(children)), is_object.alias("is_object"))

        def found(s: Column) -> Column:
            return body(_Probed(v, {n: s[f"c{k}"] for k, n in enumerate(names)}, s["is_object"]))

        if not self.setting.binds:
            return found(probes([let(v.child(n).raw, probed) for n in names], v.has("object")))
        # (no inner lambda may use an outer one's variable here: see ``Gathering``)
        return let(let(v.members(names), lambda m: probes([probed(m[f"c{k}"]) for k in range(len(names))], m.isNotNull())), found)

    def _body(self, fields: list[FieldSpec], known: set[str], v: Val, prefix: Column, depth: int) -> Column:
        taken = {f.name: self._taken(f, v, prefix) for f in fields if is_nested(f)}

        def whole(below: Column | None) -> Column:
            lists, values = [self._unknown(known, v, prefix)] if self.setting.forbid_unknown else [], []
            for f in fields:
                if f.name in taken:
                    x, path, gone, skipped = taken[f.name]
                    value, found = self._guarded(f, v, x, path, gone, skipped, below[f.name]["value"], below[f.name]["issues"])
                else:
                    value, found = self._field(f, v, prefix)
                values.append(value.alias(f.name))
                if found is not None:
                    lists.append(found)
            found = F.when(~v.has("object"), F.array(self._issue(prefix, I.INVALID_INPUT))).otherwise(self._joined(lists))
            return self._result(F.struct(*values) if values else F.lit(None).cast("struct<>"), found)

        if not taken:
            return whole(None)
        return self._let(F.struct(*(self._inner(f, *taken[f.name][:2], depth).alias(f.name) for f in fields if f.name in taken)), whole)

    def _unknown(self, allowed: set[str], v: Val, prefix: Column) -> Column:
        if isinstance(v.shape, T.StructType):
            return self._gathered([I.when(F.lit(True), self._issue(F.concat(prefix, F.lit(k)), I.UNKNOWN_KEY)) for k in v.shape.names if k not in allowed])
        keys = F.filter(F.coalesce(v.keys(), F.array().cast("array<string>")), lambda k: ~k.isin(*allowed))
        return F.transform(keys, lambda k: self._issue(F.concat(prefix, k), I.UNKNOWN_KEY))

    def _taken(self, f: FieldSpec, record: Val, prefix: Column) -> tuple[Val, Column, Column | None, Column]:
        """The field's value after defaults and codecs, its path, what makes it not given, and what ends its treatment."""
        v = record.child(f.input_name)
        if self.setting.allow_class_defaults and has_default(f) and not f.optional:
            v = constant(f.default).chosen(v, v.missing)
        gone, skipped = self._guard(f, v)
        for use in f.codecs:
            v = use.codec.decode(v)
        return v, F.concat(prefix, F.lit(f.name)), gone, skipped

    def _guarded(self, f: FieldSpec, record: Val, v: Val, path: Column, gone: Column | None, skipped: Column, value: Column, found: Column | None) -> tuple[Column, Column | None]:
        value = F.when(~skipped, value)
        if gone is not None:
            missing = F.array(self._issue(path, I.MISSING, *self._extras(f, None, v)))
            found = F.when(gone, missing).when(skipped, self._none()).otherwise(found if found is not None else self._none())
        elif found is not None:
            found = F.when(skipped, self._none()).otherwise(found)
        if f.when is not None:
            on = F.coalesce(f.when(record), F.lit(False))
            value = F.when(on, value)
            found = None if found is None else F.when(on, found).otherwise(self._none())
        return value, found

    def _field(self, f: FieldSpec, record: Val, prefix: Column) -> tuple[Column, Column | None]:
        v, path, gone, skipped = self._taken(f, record, prefix)
        return self._guarded(f, record, v, path, gone, skipped, *self._plain(f, v, path))

    def _inner(self, f: FieldSpec, v: Val, path: Column, depth: int) -> Column:
        with self._inside(f.name):
            return (self._nested if f.type.form in ("record", "records") else self._collection)(f, v, path, depth)

    @staticmethod
    def _guard(f: FieldSpec, v: Val) -> tuple[Column | None, Column]:
        """(what makes the field count as not given, what ends its treatment): the four presence policies."""
        either = v.either_missing_or_null()
        if f.optional:
            return None, either
        return (v.missing if f.nullable else either), either

    def _extras(self, f: FieldSpec, use: RuleUse | None, value: Val) -> tuple:
        """An issue's message, context and constraints: the rule's own, else the field's."""
        message = use.message if use is not None and use.message is not None else f.message
        context = use.context if use is not None and use.context is not None else f.context
        constraints = use.rule.constraints_json if use is not None else None
        if callable(message):
            message = message(f.name, value.output(), (use.rule.constraints if use is not None else None) or {})
        return message, context, constraints

    def _runs(self, use: RuleUse) -> bool:
        """A rule's groups matter only to callers who name groups."""
        return not use.groups or not self.setting.groups or bool(self.setting.groups & {*use.groups})

    def _broken(self, f: FieldSpec, uses: list[RuleUse], v: Val, path: Column) -> list[I.Maybe]:
        return [I.when(~self._passes(use, v), self._issue(path, use.rule.name, *self._extras(f, use, v))) for use in uses if self._runs(use)]

    # ---- plain fields ----

    def _gate(self, f: FieldSpec) -> tuple[str | None, RuleUse | None, bool]:
        """The kind that a field's rules take for granted, the rule that asserts it, and whether values are converted to it."""
        single = [u for u in f.rules if not u.each]
        converts = self.setting.auto_convert and not f.codecs
        gate = next((u.rule.gate for u in single if u.rule.gate), None)
        general, asserter = [u for u in single if not u.rule.gate], None
        if gate:
            asserter = next((u for u in general if ASSERTS.get(u.rule.name) == gate), None)
        elif converts:
            asserter = next((u for u in general if u.rule.name in ASSERTS), None)
            gate = ASSERTS[asserter.rule.name] if asserter else f.type.contract if f.type and f.type.form == "hint" else None
        return gate, asserter, converts

    def looked_up_in_tables(self, cls: type, v: Val) -> list[tuple[TableRule, Val]]:
        """The rules on tables, each with the value that it judges: of fields, and of fields of single nested records."""
        found = []
        for f in declared(cls).values():
            if not f.takes_part(DECODE) or not f.visible(DECODE, self.setting.groups) or not uses_tables(f):
                continue
            if is_nested(f) and (f.type.form != "record" or f.type.union or any(u.each for u in f.rules)) or any(u.each and isinstance(u.rule, TableRule) for u in f.rules):
                raise ContractError(f"{f.name}: a rule on a table can't judge what is in an array, a set, a map or a union")
            x, _, _, _ = self._taken(f, v, F.lit(""))
            if is_nested(f):
                found += self.looked_up_in_tables(self._contract(f), x)
                continue
            gate, _, converts = self._gate(f)
            if gate and converts and gate in _CONVERTIBLE:
                x = convert(x, gate)
            found += [(u.rule, x) for u in f.rules if isinstance(u.rule, TableRule) and self._runs(u)]
        return found

    def _judged(self, f: FieldSpec, v: Val) -> tuple[Val, str | None, Column | None, RuleUse | None, list[RuleUse]]:
        """The value as the rules see it, the gate and whether the value passes it, the rule that stands for a failed gate (none
        where it is the conversion that fails), and the rules behind the gate in their order."""
        single = [u for u in f.rules if not u.each]
        gated, general = [u for u in single if u.rule.gate], [u for u in single if not u.rule.gate]
        gate, asserter, converts = self._gate(f)
        if not gate:
            return v, None, None, None, general
        uses = [asserter] if asserter is not None and asserter.rule.name in _MORE_THAN_KIND else []
        uses += [u for u in general if u is not asserter] + [u for u in gated if u not in uses]
        if converts and gate in _CONVERTIBLE:
            v = convert(v, gate)
            return v, gate, v.has(gate), None, uses
        return v, gate, is_kind(v, gate), asserter or gated[0], uses

    def _plain(self, f: FieldSpec, v: Val, path: Column) -> tuple[Column, Column | None]:
        v, gate, ok, stands, uses = self._judged(f, v)
        lists = []
        if gate:
            failed = self._issue(path, I.NOT_CONVERTED)
            if stands is not None:
                failed = self._issue(path, stands.rule.name, *self._extras(f, None if stands.rule.gate else stands, v))
            lists.append(F.when(~ok, F.array(failed)).otherwise(self._gathered(self._broken(f, uses, v, path))))
        elif uses:
            lists.append(self._gathered(self._broken(f, uses, v, path)))
        each = [u for u in f.rules if u.each]
        if each:
            lists.append(self._each(f, each, v, path))
        return self._output(f, v, gate, each), self._joined(lists) if lists else None

    # ---- sound records of known types ----

    def sound(self, cls: type, v: Val, depth: int = 0) -> tuple[Column, Column] | None:
        """Whether a record of known types has no issue, and its value if so; None where that isn't told apart.

        The test is one Boolean: it builds nothing, and outside of arrays nothing of it is interpreted.
        """
        fields = declared(cls)
        own = [f for f in fields.values() if f.takes_part(DECODE) and f.visible(DECODE, self.setting.groups)]
        if not isinstance(v.shape, T.StructType) or not own or self.setting.forbid_unknown and {*v.shape.names} - {f.input_name for f in fields.values()}:
            return None
        good, values = v.has("object"), []
        for f in own:
            x, path, gone, skipped = self._taken(f, v, F.lit(""))
            found = self._sound_nested(f, x, depth) if is_nested(f) else self._sound_plain(f, x)
            if found is None:
                return None
            ok = skipped | found[0]
            if gone is not None:
                ok = ~gone & ok
            if f.when is not None:
                ok = ~F.coalesce(f.when(v), F.lit(False)) | ok
            good = good & ok
            values.append(self._guarded(f, v, x, path, gone, skipped, found[1], None)[0].alias(f.name))
        return F.coalesce(good, F.lit(False)), F.struct(*values)

    def _sound_plain(self, f: FieldSpec, v: Val) -> tuple[Column, Column] | None:
        v, gate, ok, _, uses = self._judged(f, v)
        each = [u for u in f.rules if u.each]
        if any(u.rule.python for u in [*uses, *each]) or each and "array" not in v.kinds:
            return None
        tests = [ok] if gate else []
        tests += [u.rule.passes(v) for u in uses if self._runs(u)]
        good = reduce(and_, tests, F.lit(True))
        passing = [u.rule for u in each if self._runs(u)]
        if each:
            good = good & v.has("array")
        if passing:
            good = good & F.forall(v.get("array"), lambda x: reduce(and_, (rule.passes(v.item(x)) for rule in passing)))
        return good, self._output(f, v, gate, each)

    def _sound_nested(self, f: FieldSpec, v: Val, depth: int) -> tuple[Column, Column] | None:
        uses = [u for u in f.rules if not u.each]
        if f.type.union or f.type.form not in ("record", "records") or any(u.rule.python for u in f.rules):
            return None
        cls = self._contract(f)
        if f.type.form == "record" and not any(u.each for u in f.rules):
            return self.sound(cls, v, depth + 1)
        if "array" not in v.kinds or not isinstance(v.element, T.StructType):
            return None
        whole = v.get("array")
        if self.sound(cls, v.item(F.lit(None).cast(v.element)), depth + 1) is None:
            return None
        good = v.has("array") & reduce(and_, (u.rule.passes(v) for u in uses if self._runs(u)), F.lit(True))
        good = good & F.forall(whole, lambda x: self.sound(cls, v.item(x), depth + 1)[0])
        return good, whole if self._as_it_came(cls, v.element) else F.transform(whole, lambda x: self.sound(cls, v.item(x), depth + 1)[1])

    def _as_it_came(self, cls: type, shape: T.StructType) -> bool:
        """Whether a sound record's value is the very struct that came in."""
        own = [f for f in declared(cls).values() if f.takes_part(DECODE) and f.visible(DECODE, self.setting.groups)]
        if self.setting.auto_convert or [f.name for f in own] != shape.names:
            return False

        def same(f: FieldSpec, kind: T.DataType) -> bool:
            if f.input_name != f.name or f.codecs or f.when is not None or self.setting.allow_class_defaults and has_default(f):
                return False
            if is_nested(f):
                below = kind.elementType if f.type.form == "records" and isinstance(kind, T.ArrayType) else kind
                return f.type.form in ("record", "records") and isinstance(below, T.StructType) and self._as_it_came(self._contract(f), below)
            gives = self._kind(f)
            return not any(u.each for u in f.rules) and (gives is None or kind_of(kind) == gives)

        return all(same(f, shape[f.name].dataType) for f in own)

    def whole(self, cls: type, v: Val) -> Column:
        """The result of a record. Where it holds records of known types, sound ones are told by one test beforehand."""
        full = self.record(cls, v, F.lit(""))
        if not any(is_nested(f) for f in declared(cls).values()) or (quick := self.sound(cls, v)) is None:
            return full
        return F.when(quick[0], self._result(quick[1], None)).otherwise(full)

    def _each(self, f: FieldSpec, uses: list[RuleUse], v: Val, path: Column) -> Column:
        """Element rules: one pass over the elements for each rule."""
        if isinstance(v.shape, T.MapType) and "array" not in v.kinds:
            whole, item = F.map_values(v.get("object")), v.entry_item
        else:
            whole, item = v.get("array"), v.item
        if not v.kinds.keys() & {"array", "object"} or "array" not in v.kinds and not isinstance(v.shape, T.MapType):
            return F.array(self._issue(path, "isArray", *self._extras(f, None, v)))
        lists = [self._each_rule(f, use, v, whole, item, path) for use in uses if self._runs(use)]
        return F.when(whole.isNull(), F.array(self._issue(path, "isArray", *self._extras(f, None, v)))).otherwise(self._joined(lists))

    def _each_rule(self, f: FieldSpec, use: RuleUse, v: Val, whole: Column, item, path: Column) -> Column:
        def at(i: Column) -> Column:
            return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

        if use.rule.python:
            good = self.verdicts.get((self.scope, id(use)))
            good = elements_by_python(use.rule, v) if good is None else good
            return F.array_compact(F.transform(good, lambda ok, i: F.when(~ok, self._issue(at(i), use.rule.name, *self._extras(f, use, v)))))
        found = F.array_compact(F.transform(whole, lambda x, i: F.when(~use.rule.passes(item(x)), self._issue(at(i), use.rule.name, *self._extras(f, use, item(x))))))
        return F.when(F.exists(whole, lambda x: ~use.rule.passes(item(x))), found).otherwise(self._none())

    def _kind(self, f: FieldSpec) -> str | None:
        """The kind that a field's value has, by its rules, codecs or hint."""
        kind = self._gate(f)[0] or next((ASSERTS[u.rule.name] for u in f.rules if not u.each and u.rule.name in ASSERTS), None)
        return kind or next((u.codec.gives for u in f.codecs if u.codec.gives), None) or (f.type.contract if f.type and f.type.form == "hint" else None)

    def _output(self, f: FieldSpec, v: Val, gate: str | None, each: list[RuleUse]) -> Column:
        kind = self._kind(f)
        element = _kind_of_rules([u.rule for u in each])
        if (kind == "array" or each) and element and "array" in v.kinds and isinstance(v.element, T.VariantType):
            return F.transform(v.get("array"), lambda x: v.item(x).get(element))
        return v.output("array" if each and kind is None and "array" in v.kinds else kind)

    # ---- nested fields ----

    def _contract(self, f: FieldSpec) -> type:
        cls = f.type.resolve()
        if not isinstance(cls, type) or not declared(cls):
            raise ContractError(f"{f.name}: {cls!r} declares no fields")
        return cls

    def _deeper(self, f: FieldSpec, v: Val, prefix: Column, depth: int, tag: str | None = None, cls: type | None = None) -> Column:
        cls = cls or self._contract(f)
        if depth < self.setting.max_depth or v.raw is not None and isinstance(v.shape, T.StructType):  # a struct's type ends by itself
            return self.record(cls, v, prefix, depth + 1, tag)
        if not isinstance(v.shape, T.VariantType) or not self.setting.holds:
            return self._result(F.lit(None).cast("struct<>"), F.when(v.either_missing_or_null(), self._none()).otherwise(F.array(self._issue(prefix, I.TOO_DEEP))))
        if (cls, tag) not in self.below:
            self.below.append((cls, tag))
        node = v.raw if v.raw is not None else v.get("object")
        left = self._issue(prefix, I.TOO_DEEP, F.lit(str(self.below.index((cls, tag)))), node=node)
        return self._result(node, F.when(v.either_missing_or_null(), self._none()).otherwise(F.array(left)))

    def judged_below(self, found: Column) -> Column:
        """A record's issues with what recursion left open judged: each open place's issue, which holds the node, gives way to
        the node's own issues, again and again, as many times as the row's deepest node asks for."""
        if not self.setting.holds:
            return found
        start = max(0, self.setting.max_depth - LEVELS_BELOW)
        levels = self.setting.max_depth - start + 1

        def one(i: Column) -> Column:
            """An issue, or what the node that it stands for has in its place."""
            out, k = F.array(i), 0
            while k < len(self.below):  # compiling one may find others
                cls, tag = self.below[k]
                out = F.when(is_open(i) & (i["message"] == str(k)), let(probed(i["node"]), lambda p: self.record(cls, variant(p["x"], p), i["path"], start, tag)["issues"])).otherwise(out)  # noqa: B023
                k += 1
            return out

        def is_open(i: Column) -> Column:
            return i["node"].isNotNull()

        def parted(found: Column) -> Column:
            """The issues before the first open one, and those from it on."""
            at = F.array_min(F.transform(found, lambda i, k: F.when(is_open(i), k)))
            return let(F.coalesce(at, F.size(found)), lambda n: F.struct(F.slice(found, F.lit(1), n).alias("closed"), F.slice(found, n + 1, F.size(found)).alias("open")))

        def step(s: Column, _: Column) -> Column:
            # what is closed joins the others a round later: bound by ``let``, all of it would be copied
            last = let(F.flatten(F.transform(s["last"]["open"], one)), parted)
            return F.when(F.size(s["last"]["open"]) > 0, F.struct(F.concat(s["done"], s["last"]["closed"]).alias("done"), last.alias("last"))).otherwise(s)

        def rounds(found: Column) -> Column:
            most = F.array_max(F.transform(F.filter(found, is_open), lambda i: brackets_deep(F.to_json(i["node"]))))
            return F.sequence(F.lit(1), F.ceil(most / (self._brackets() * levels)).cast("int") + 1)

        def folded(found: Column) -> Column:
            first = F.struct(self._none().alias("done"), parted(found).alias("last"))
            return F.aggregate(rounds(found), first, step, lambda s: F.concat(s["done"], s["last"]["closed"]))

        def closed(found: Column) -> Column:
            return F.transform(found, lambda i: i.dropFields("node"))

        if not self.below:
            return closed(found)
        self.issues_alone = True
        try:
            return F.when(F.exists(found, is_open), closed(folded(found))).otherwise(closed(found))
        finally:
            self.issues_alone = False

    def _brackets(self) -> int:
        """How many brackets a level of what is judged below has at least."""
        seen, waiting = set(), [cls for cls, _ in self.below]
        while waiting:
            cls = waiting.pop()
            if cls not in seen:
                seen.add(cls)
                waiting += [c for f in declared(cls).values() for c in nested(f)]
        return 2 if all(f.type.form in ("records", "set", "map") for cls in seen for f in declared(cls).values() if is_nested(f)) else 1

    def _nested(self, f: FieldSpec, v: Val, path: Column, depth: int) -> Column:
        def one(x: Val, at: Column, below: Column) -> Column:
            return self._tagged(f, x, at, below, depth) if f.type.union else self._deeper(f, x, below, depth)

        if f.type.form == "record" and not any(u.each for u in f.rules):
            inner = one(v, path, F.concat(path, F.lit(".")))
            if f.type.union:
                return inner
            wrong = F.array(self._issue(path, "isObject", *self._extras(f, None, v)))
            return self._let(inner, lambda r: self._result(r["value"], F.when(v.has("object"), r["issues"]).otherwise(wrong)))
        own = self._broken(f, [u for u in f.rules if not u.each], v, path)
        return self._elements(f, v, path, own, one)

    def _elements(self, f: FieldSpec, v: Val, path: Column, own: list[I.Maybe], one) -> Column:
        wrong = F.array(self._issue(path, "isArray", *self._extras(f, None, v)))
        if "array" not in v.kinds:
            return self._result(F.lit(None).cast("string"), wrong)

        def at(i: Column) -> Column:
            return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

        def element(x: Column, i: Column) -> Column:
            with self._inside(P.ELEMENT, i):
                return one(v.item(x), at(i), F.concat(at(i), F.lit(".")))

        each = F.transform(v.get("array"), element)

        def whole(r: Column) -> Column:
            below = F.flatten(r["issues"])
            return self._result(r["value"], F.when(r.isNull(), wrong).otherwise(self._joined(([self._gathered(own)] if own else []) + [below])))

        return self._let(each, whole)

    def _tagged(self, f: FieldSpec, v: Val, at: Column, below: Column, depth: int) -> Column:
        """A union's value: a struct of the tag and one struct for each case, of which one is not null."""
        tag, cases = v.child(f.type.union.property).get("string"), f.type.union.cases
        received = F.coalesce(F.concat(F.lit('"received":'), _quoted(tag), F.lit(",")), F.lit(""))
        names = ",".join(f'"{n}"' for n in cases)
        context = F.concat(F.lit("{"), received, F.lit(f'"validSubTypes":[{names}]}}'))

        def case(name: str, cls: type) -> Column:
            with self._inside(name):
                return F.when(tag == name, self._deeper(f, v, below, depth, f.type.union.property, cls)).alias(name)

        inner = F.struct(tag.alias("tag"), *(case(n, cls) for n, cls in cases.items()))

        def whole(r: Column) -> Column:
            tag, values, found = r["tag"], [r["tag"].alias("tag")], F.when(F.lit(False), self._none())
            for name, cls in cases.items():
                value = r[name]["value"]
                if f.type.keep_tag and not self.issues_alone:
                    kept = [value[n].alias(n) for n in self.visible_names(cls) if n != f.type.union.property]
                    value = F.when(value.isNotNull(), F.struct(*kept, tag.alias(f.type.union.property)))
                values.append(value.alias(name))
                found = found.when(tag == name, r[name]["issues"])
            return self._result(F.struct(*values), found.otherwise(F.array(self._issue(at, I.BAD_TAG, None, context))))

        return self._let(inner, whole)

    def visible_names(self, cls: type) -> list[str]:
        return [f.name for f in declared(cls).values() if f.takes_part(DECODE) and f.visible(DECODE, self.setting.groups)]

    def _collection(self, f: FieldSpec, v: Val, path: Column, depth: int) -> Column:
        each = [u for u in f.rules if u.each]
        cls = f.type.resolve()
        if f.type.form == "set":
            own = self._broken(f, [u for u in f.rules if not u.each], v, path)
            if cls is not None:
                inner = self._elements(f, v, path, own, lambda x, at, below: self._deeper(f, x, below, depth))
                return self._let(inner, lambda r: self._result(r["value"], self._joined([r["issues"], self._each_of(f, each, v, path)]))) if each else inner
            wrong = F.array(self._issue(path, "isArray", *self._extras(f, None, v)))
            if "array" not in v.kinds:
                return self._result(F.lit(None).cast("string"), wrong)
            lists = ([self._gathered(own)] if own else []) + ([self._each_of(f, each, v, path)] if each else [])
            return self._result(self._distinct(v, each), F.when(~v.has("array"), wrong).otherwise(self._joined(lists)))
        wrong = F.array(self._issue(path, "isObject", *self._extras(f, None, v)))
        if "object" not in v.kinds:
            return self._result(F.lit(None).cast("string"), wrong)

        def one(e: Column, i: Column) -> Column:
            if cls is None:
                return self._result(v.entry_item(e["value"]).output(_kind_of_rules([u.rule for u in each])), self._none())
            with self._inside(P.ELEMENT, i):
                return self._deeper(f, v.entry_item(e["value"]), F.concat(path, F.lit("["), e["key"], F.lit("].")), depth)

        entries = F.transform(v.entries(), lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), one(e, i).alias("r")))

        def whole(r: Column) -> Column:
            value = F.map_from_entries(F.transform(r, lambda e: F.struct(e["key"], e["r"]["value"])))
            lists = [F.flatten(F.transform(r, lambda e: e["r"]["issues"]))] if cls is not None else []
            if each:
                lists.append(self._each_of(f, each, v, path, F.transform(r, lambda e: e["value"]), v.entry_item))
            return self._result(value, F.when(v.has("object"), self._joined(lists)).otherwise(wrong))

        return self._let(entries, whole)

    def _each_of(self, f: FieldSpec, uses: list[RuleUse], v: Val, path: Column, whole: Column | None = None, item=None) -> Column:
        whole, item = (v.get("array"), v.item) if whole is None else (whole, item)
        return F.coalesce(self._joined([self._each_rule(f, use, v, whole, item, path) for use in uses if self._runs(use)]), self._none())

    @staticmethod
    def _distinct(v: Val, each: list[RuleUse]) -> Column:
        whole, element = v.get("array"), _kind_of_rules([u.rule for u in each])
        if not isinstance(v.element, T.VariantType):
            return F.array_distinct(whole)
        if element:
            return F.array_distinct(F.transform(whole, lambda x: v.item(x).get(element)))
        keys = F.transform(whole, lambda x, i: identity(v.item(x), i))
        kept = F.filter(whole, lambda x, i: F.array_position(keys, identity(v.item(x), i)) == i + 1)
        return F.transform(kept, lambda e: e["x"])

    # ---- out ----

    def encoded(self, cls: type, v: Val) -> Column:
        """The record as it goes out: names, nested records and codecs. No rule runs."""
        out = []
        for f in declared(cls).values():
            if not f.takes_part(ENCODE) or not f.visible(ENCODE, self.setting.groups):
                continue
            x = v.child(f.name)
            if not x.kinds and x.raw is None:
                continue  # a recursive contract's type ends here, or the frame lacks the field
            out.append(self._encoded_field(f, x).alias(f.wire_name(ENCODE)))
        return F.struct(*out) if out else F.lit(None).cast("struct<>")

    def _encoded_field(self, f: FieldSpec, v: Val) -> Column:
        nested = f.type is not None and f.type.form != "hint"
        if nested and (f.type.union or f.type.resolve() is not None):
            v = self._encoded_nested(f, v)
        for use in reversed(f.codecs):
            v = use.codec.encode(v)
        return v.output()

    def _encoded_nested(self, f: FieldSpec, v: Val) -> Val:
        one = self._encoded_union if f.type.union else lambda f, x: self.encoded(self._contract(f), x)
        if f.type.form in ("records", "set") and isinstance(v.element, T.StructType):
            column = F.transform(v.get("array"), lambda x: F.when(x.isNotNull(), one(f, v.item(x))))
            kind = "array"
        elif f.type.form == "map" and isinstance(v.shape, T.MapType):
            column = F.transform_values(v.get("object"), lambda k, x: F.when(x.isNotNull(), one(f, v.entry_item(x))))
            kind = "object"
        elif isinstance(v.shape, T.StructType):
            column, kind = F.when(v.has("object"), one(f, v)), "object"
        else:
            return v
        return Val({kind: column}, v.missing, v.null, raw=column, null_as=v.null_as)

    def _encoded_union(self, f: FieldSpec, v: Val) -> Column:
        """By the tag; as a variant, since the cases' types differ."""
        tag, out = v.child("tag").get("string"), None
        for name, cls in f.type.union.cases.items():
            own = self.encoded(cls, v.child(name))
            if f.type.keep_tag:
                names = [g.wire_name(ENCODE) for g in declared(cls).values() if g.takes_part(ENCODE) and g.visible(ENCODE, self.setting.groups)]
                own = F.struct(*(own.getField(n).alias(n) for n in names if n != f.type.union.property), F.lit(name).alias(f.type.union.property))
            own = as_variant(own, [g for g in declared(cls).values() if g.optional])
            out = F.when(tag == name, own) if out is None else out.when(tag == name, own)
        wrong = F.concat(F.lit(f"{f.name}: no case of the union has the tag "), F.coalesce(tag, F.lit("null")))
        return out.otherwise(F.raise_error(wrong))


def is_nested(f: FieldSpec) -> bool:
    return f.type is not None and f.type.form != "hint"


def _quoted(text: Column) -> Column:
    """A text as JSON; null stays null."""
    inside = F.to_json(F.array(text))
    return F.when(text.isNotNull(), inside.substr(F.lit(2), F.length(inside) - F.lit(2)))


class _Probed(Val):
    """A document's object whose fields have been looked up and probed."""

    def __init__(self, v: Val, children: dict[str, Column], is_object: Column):
        object.__setattr__(self, "children", children)
        object.__setattr__(self, "is_object", is_object)
        super().__init__(v.kinds, v.missing, v.null, raw=v.raw, type=v.type, element=v.element, shape=v.shape, null_as=v.null_as, names=v.names)

    def has(self, kind: str) -> Column:
        return self.is_object if kind == "object" else super().has(kind)

    def child(self, key: str) -> Val:
        return variant(self.children[key]["x"], self.children[key]) if key in self.children else super().child(key)


def as_variant(record: Column, optional: list[FieldSpec]) -> Column:
    """A struct as a variant object; optional fields that are null are left out."""
    loose = [f.wire_name(ENCODE) for f in optional if f.takes_part(ENCODE)]
    if not loose:
        return F.to_variant_object(record)
    firm = F.to_json(record.dropFields(*loose), {"ignoreNullFields": "false"})
    rest = F.to_json(F.struct(*(record[n].alias(n) for n in loose)))
    parts = [F.nullif(x.substr(F.lit(2), F.length(x) - F.lit(2)), F.lit("")) for x in (firm, rest)]
    return F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def _kind_of_rules(rules: list[Rule]) -> str | None:
    return next((k for r in rules if (k := ASSERTS.get(r.name) or r.gate) in _SQL), None)


def uses_python(cls: type, seen: frozenset[type] = frozenset()) -> bool:
    """Whether a rule anywhere in the contract needs Python workers."""
    if cls in seen:
        return False
    return any(
        any(u.rule.python for u in f.rules) or any(uses_python(c, seen | {cls}) for c in nested(f))
        for f in declared(cls).values()
    )


def uses_tables(f: FieldSpec, seen: frozenset[type] = frozenset()) -> bool:
    """Whether a rule of the field, or of what it holds, is on a table."""
    if any(isinstance(u.rule, TableRule) for u in f.rules):
        return True
    return any(uses_tables(g, seen | {c}) for c in nested(f) if c not in seen for g in declared(c).values())


def recursive(cls: type, path: tuple[type, ...] = ()) -> bool:
    """Whether a contract can hold itself, or one that it holds can."""
    return cls in path or any(recursive(c, (*path, cls)) for f in declared(cls).values() for c in nested(f))


def deeper_than(cls: type, most: int) -> bool:
    """Whether a contract can hold records more than so many levels below it."""
    return recursive(cls) or any(most < 1 or deeper_than(c, most - 1) for f in declared(cls).values() for c in nested(f))


def nested(f: FieldSpec) -> list[type]:
    if f.type is None or f.type.form == "hint":
        return []
    if f.type.union:
        return [*f.type.union.cases.values()]
    cls = f.type.resolve()
    return [cls] if isinstance(cls, type) else []


def root(names_and_types: list[tuple[str, T.DataType]], null_as: str) -> Val:
    """A frame's row as one object."""
    shape = T.StructType([T.StructField(n, k) for n, k in names_and_types])
    columns = [F.col(f"`{n}`") for n, _ in names_and_types]
    return _Row(shape, columns, null_as)


class _Row(Val):
    """An object whose children are the frame's columns themselves, so that unused ones are pruned from the scan."""

    def __init__(self, shape: T.StructType, columns: list[Column], null_as: str):
        object.__setattr__(self, "columns", dict(zip(shape.names, columns, strict=True)))
        super().__init__({"object": F.lit(True)}, F.lit(False), F.lit(False), shape=shape, null_as=null_as)

    def child(self, key: str) -> Val:
        from ..functions.values import absent

        return typed(self.columns[key], self.shape[key].dataType, self.null_as) if key in self.columns else absent()


