"""How a contract's fields are declared, read from its class and its base classes, and checked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as plain, replace
from typing import Any

from ..errors import ContractError
from ..operators.codecs import Codec
from ..operators.rule import Rule

#: Names that no field, wire name or tag may have: fixed values.
RESERVED = {"__proto__", "constructor", "prototype"}
BOTH, DECODE, ENCODE = "both", "decode", "encode"


@dataclass(frozen=True, eq=False)
class RuleUse:
    rule: Rule
    each: bool = False
    groups: tuple[str, ...] = ()
    message: Any = None
    context: Any = None


@dataclass(frozen=True, eq=False)
class CodecUse:
    codec: Codec
    direction: str = BOTH


@dataclass(frozen=True)
class Expose:
    name: str | None
    direction: str = BOTH
    groups: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class Union:
    """A tagged union: the property that holds the tag, and a contract for each tag."""

    property: str
    cases: dict[str, type]


def union(property: str, **cases: type) -> Union:  # noqa: A002  the option's name
    return Union(property, cases)


@dataclass(frozen=True, eq=False)
class TypeSpec:
    """What a field holds: kind is one of hint, record, records, set, map."""

    kind: str
    contract: Any = None  # a class, a thunk of one, or the name of a hinted kind
    union: Union | None = None
    keep_tag: bool = False

    def _given(self) -> Any:
        c = self.contract
        return c() if callable(c) and not isinstance(c, type) else c

    @property
    def form(self) -> str:
        """The kind; a function that returns [contract] means records."""
        return "records" if self.kind == "record" and isinstance(self._given(), list) else self.kind

    def resolve(self) -> type | None:
        given = self._given()
        return given[0] if isinstance(given, list) else given


@dataclass(frozen=True, eq=False)
class Part:
    """One ``field(...)`` as it was written."""

    rules: tuple[RuleUse, ...]
    codecs: tuple[CodecUse, ...]
    exposes: tuple[Expose, ...]
    exclude: str | None
    type: TypeSpec | None
    optional: bool | None
    nullable: bool | None
    when: Callable | None
    message: Any
    context: Any
    default: Any


@dataclass(frozen=True, eq=False)
class FieldSpec:
    """A field with all its parts and all it inherits."""

    name: str
    rules: tuple[RuleUse, ...] = ()
    codecs: tuple[CodecUse, ...] = ()
    exposes: tuple[Expose, ...] = ()
    exclude: str | None = None
    type: TypeSpec | None = None
    optional: bool | None = None
    nullable: bool | None = None
    when: Callable | None = None
    message: Any = None
    context: Any = None
    default: Any = plain(default=None)

    def wire_name(self, direction: str) -> str:
        """The first name for just this direction, else the first for both, else the field's own."""
        named = [e for e in self.exposes if e.name]
        return next((e.name for d in (direction, BOTH) for e in named if e.direction == d), self.name)

    @property
    def input_name(self) -> str:
        return self.wire_name(DECODE)

    def takes_part(self, direction: str) -> bool:
        if self.exclude in (BOTH, direction):
            return False
        return not self.exposes or any(e.direction in (BOTH, direction) for e in self.exposes)

    def visible(self, direction: str, groups: frozenset[str]) -> bool:
        """A field whose every entry names groups is seen only by callers in one of them."""
        own = [e for e in self.exposes if e.direction in (BOTH, direction)]
        return not own or any(not e.groups for e in own) or any(groups & {*e.groups} for e in own)


class ArrayOf:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules


def array_of(*rules: Rule) -> ArrayOf:
    """Rules for the elements of an array, a set or a map."""
    if not rules:
        raise ContractError("array_of: at least one rule is needed")
    return ArrayOf(rules)


class Declaration:
    """A field's parts; ``a & b`` puts several declarations on one field."""

    def __init__(self, parts: tuple[Part, ...]):
        self.parts = parts

    def __and__(self, other: "Declaration") -> "Declaration":
        return Declaration(self.parts + other.parts)


_NO_DEFAULT = object()


def field(
    *rules: Rule | ArrayOf,
    type: Any = None,  # noqa: A002  options carry their plain names
    discriminator: Union | None = None,
    keep_discriminator_property: bool = False,
    set_value: Any = None,
    map_value: Any = None,
    optional: bool | None = None,
    nullable: bool | None = None,
    name: str | None = None,
    decode_name: str | None = None,
    encode_name: str | None = None,
    exclude: bool | str | None = None,
    groups: tuple[str, ...] | list[str] = (),
    when: Callable | None = None,
    transform: Codec | list[Codec] | None = None,
    message: Any = None,
    context: Any = None,
    extra_rules: list[Rule | ArrayOf] | None = None,
    default: Any = _NO_DEFAULT,
) -> Declaration:
    """Declare a field of a contract.

    type: a contract or [contract] (or a function that returns it, for recursion), set, map, or str, float, bool,
    'date' as a hint for conversion. transform: one codec or a list; they run from left to right on the way in and
    backwards on the way out. when: a function of the raw record (a ``Val``) that returns a column. exclude: True,
    'decode' or 'encode'. message: a text, or a function (field, value, constraints) -> column.
    """
    groups = tuple([groups] if isinstance(groups, str) else groups)
    if name and (decode_name or encode_name):
        raise ContractError("name can't be mixed with decode_name or encode_name")
    for n in (name, decode_name, encode_name):
        if n in RESERVED:
            raise ContractError(f"{n!r} is a reserved name")
    if exclude not in (None, False, True, DECODE, ENCODE):
        raise ContractError(f"exclude: {exclude!r} is none of True, 'decode' and 'encode'")
    uses = []
    for r in [*rules, *(extra_rules or [])]:
        own, each = (r.rules, True) if isinstance(r, ArrayOf) else ((r,), False)
        for x in own:
            if not isinstance(x, Rule):
                raise ContractError(f"{x!r} is no rule; a rule with options has to be called")
            uses.append(RuleUse(x, each, groups, message, context))
    exposes = []
    if decode_name or encode_name:
        if decode_name:
            exposes.append(Expose(decode_name, DECODE, groups))
        if encode_name:
            exposes.append(Expose(encode_name, ENCODE, groups))
    else:
        exposes.append(Expose(name, BOTH, groups))
    codecs = [] if transform is None else transform if isinstance(transform, list) else [transform]
    part = Part(
        tuple(uses), tuple(CodecUse(c) for c in codecs), tuple(exposes), BOTH if exclude is True else exclude or None,
        _type_spec(type, discriminator, keep_discriminator_property, set_value, map_value), optional, nullable, when, message, context, default,
    )
    return Declaration((part,))


_HINTS = {str: "string", int: "number", float: "number", bool: "boolean", "string": "string", "number": "number", "boolean": "boolean", "date": "date"}


def _type_spec(kind: Any, tagged: Union | None, keep: bool, set_value: Any, map_value: Any) -> TypeSpec | None:
    if kind is None and tagged is None:
        return None
    if tagged is not None:
        if not tagged.property or tagged.property in RESERVED:
            raise ContractError(f"a union's tag can't be named {tagged.property!r}")
        if not tagged.cases:
            raise ContractError("a union needs a case at least")
        return TypeSpec("records" if isinstance(kind, list) else "record", None, tagged, keep)
    if kind in (set, "set"):
        return TypeSpec("set", set_value)
    if kind in (dict, "map"):
        return TypeSpec("map", map_value)
    if isinstance(kind, list):
        if len(kind) != 1:
            raise ContractError("an array type has one element type")
        return TypeSpec("records", kind[0])
    if isinstance(kind, (type, str)) and kind in _HINTS:
        return TypeSpec("hint", _HINTS[kind])
    return TypeSpec("record", kind)


def _own(cls: type) -> dict[str, FieldSpec]:
    out = {}
    for name, declaration in vars(cls).items():
        if not isinstance(declaration, Declaration):
            continue
        if name in RESERVED:
            raise ContractError(f"{name!r} is a reserved name")
        parts = declaration.parts
        first = lambda key: next((x for p in parts if (x := getattr(p, key)) is not None), None)  # noqa: B023, E731
        default = next((p.default for p in parts if p.default is not _NO_DEFAULT), _NO_DEFAULT)
        out[name] = FieldSpec(
            name, *(tuple(x for p in parts for x in getattr(p, key)) for key in ("rules", "codecs", "exposes")),
            *(first(key) for key in ("exclude", "type", "optional", "nullable", "when", "message", "context")), default,
        )
    return out


def declared(cls: type) -> dict[str, FieldSpec]:
    """All fields of a contract: its own first, then what only its base classes have.

    Of a field that both have, the rules are joined by name with the child's winning; all else comes from the base only
    where the child says nothing.
    """
    out: dict[str, FieldSpec] = {}
    for base in cls.__mro__:
        for name, theirs in _own(base).items():
            if (mine := out.get(name)) is None:
                out[name] = theirs
                continue
            known = {(u.rule.name, u.each) for u in mine.rules}
            merged = {"rules": mine.rules + tuple(u for u in theirs.rules if (u.rule.name, u.each) not in known)}
            plain_exposes = all(e == Expose(None) for e in mine.exposes)
            merged["exposes"] = theirs.exposes if plain_exposes else mine.exposes
            merged["codecs"] = mine.codecs or theirs.codecs
            for key in ("exclude", "type", "optional", "nullable", "when", "message", "context"):
                merged[key] = getattr(theirs, key) if getattr(mine, key) is None else getattr(mine, key)
            merged["default"] = theirs.default if mine.default is _NO_DEFAULT else mine.default
            out[name] = replace(mine, **merged)
    return out


def has_default(spec: FieldSpec) -> bool:
    return spec.default is not _NO_DEFAULT


def check(cls: type, fields: dict[str, FieldSpec]) -> None:
    """What can be told to be wrong before any row is seen."""
    for f in fields.values():
        for i, a in enumerate(f.exposes):
            for b in f.exposes[i + 1 :]:
                same = a.direction == b.direction
                if same and (not a.groups and not b.groups or {*a.groups} & {*b.groups}):
                    raise ContractError(f"{cls.__name__}.{f.name}: two declarations name the same direction and groups")
        gates = {u.rule.gate for u in f.rules if not u.each and u.rule.gate}
        if len(gates) > 1:
            raise ContractError(f"{cls.__name__}.{f.name}: rules for different types: {', '.join(sorted(gates))}")
    for direction in (DECODE, ENCODE):
        names = [f.wire_name(direction) for f in fields.values() if f.takes_part(direction)]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ContractError(f"{cls.__name__}: several fields are named {', '.join(sorted(twice))}")
