"""Records that leave their absent keys out: which keys a record had, and documents written by that.

A struct holds all of its fields in every row, so a null in it may have been a null or no key at all. ``presence`` keeps that
apart: beside the value goes a struct of flags with the same shape, of only those fields that can be absent (optional ones and
conditional ones, and records that hold such). ``written`` makes a record's JSON text of both, without the keys that the flags
say were absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compat import is_finite, iso_text, number_text
from ..functions.values import Val, constant
from .compile import Compiler, is_nested, nested
from .field import DECODE, ENCODE, FieldSpec, declared, has_default

#: Within a nested field's flags: whether the field itself is there, and the flags of what it holds.
HERE, BELOW = "here", "below"


def presence(compiler: Compiler, cls: type, record: Val, depth: int = 0) -> Column | None:
    """The flags of a contract's record; None if none of its keys can be absent."""
    own = [f for f in declared(cls).values() if f.takes_part(DECODE) and f.visible(DECODE, compiler.setting.groups) and _may_be_absent(f, depth, compiler.setting.max_depth)]
    if not own:
        return None

    def body(v: Val) -> Column:
        return F.struct(*(_flag(compiler, f, v, depth).alias(f.name) for f in own))

    return compiler.looked_up(own, record, body)


def any_may_be_absent(compiler: Compiler, cls: type) -> bool:
    return any(_may_be_absent(f, 0, compiler.setting.max_depth) for f in declared(cls).values() if f.takes_part(DECODE) and f.visible(DECODE, compiler.setting.groups))


def _may_be_absent(f: FieldSpec, depth: int, most: int) -> bool:
    """Whether the field, or one of a record that it holds, can be absent."""
    if f.optional or f.when is not None:
        return True
    return depth < most and any(_may_be_absent(g, depth + 1, most) for cls in nested(f) for g in declared(cls).values() if g.takes_part(DECODE))


def _flag(compiler: Compiler, f: FieldSpec, record: Val, depth: int) -> Column:
    v = record.child(f.input_name)
    if compiler.setting.allow_class_defaults and has_default(f) and not f.optional:
        v = constant(f.default).chosen(v, v.missing)
    here = None
    if f.optional or f.when is not None:
        here = ~v.missing if f.nullable else ~v.either_missing_or_null()
        if f.when is not None:
            here = here & F.coalesce(f.when(record), F.lit(False))
    if not is_nested(f) or depth >= compiler.setting.max_depth:
        return here
    for use in f.codecs:
        v = use.codec.decode(v)
    below = _below(compiler, f, v, depth)
    if below is None:
        return F.lit(True) if here is None else here
    return F.struct(*([here.alias(HERE)] if here is not None else []), below.alias(BELOW))


def _below(compiler: Compiler, f: FieldSpec, v: Val, depth: int) -> Column | None:
    def one(x: Val) -> Column | None:
        if not f.type.union:
            return presence(compiler, f.type.resolve(), x, depth + 1)
        cases = {n: presence(compiler, cls, x, depth + 1) for n, cls in f.type.union.cases.items()}
        kept = [c.alias(n) for n, c in cases.items() if c is not None]
        return F.struct(*kept) if kept else None

    if not f.type.union and f.type.resolve() is None:
        return None
    if not any(_may_be_absent(g, depth + 1, compiler.setting.max_depth) for cls in nested(f) for g in declared(cls).values()):
        return None
    listed = f.type.form in ("records", "set") or any(u.each for u in f.rules) and f.type.form == "record"
    if listed:
        return F.transform(v.get("array"), lambda x: one(v.item(x))) if "array" in v.kinds else None
    if f.type.form == "record" or "object" not in v.kinds:
        return one(v) if "object" in v.kinds else None
    return F.map_from_entries(F.transform(v.entries(), lambda e: F.struct(e["key"], one(v.entry_item(e["value"])))))


def written(compiler: Compiler, cls: type, v: Val, mask: Column | None = None, shape: T.DataType | None = None) -> Column:
    """A struct of a contract's fields as JSON text. Without flags, null counts as absent for fields that are optional but not
    nullable, and as null elsewhere."""
    parts: list[Column] = []
    for f in declared(cls).values():
        if not f.takes_part(ENCODE) or not f.visible(ENCODE, compiler.setting.groups):
            continue
        x = v.child(f.name)
        if not x.kinds and x.raw is None:
            continue
        flag, flags = _flag_of(f.name, mask, shape)
        here = flag
        if isinstance(flags, T.StructType):
            here = flag[HERE] if HERE in flags.names else None
        if mask is None and f.optional and not f.nullable:
            here = ~x.either_missing_or_null()
        inner = (flag[BELOW], flags[BELOW].dataType) if isinstance(flags, T.StructType) and BELOW in flags.names else (None, None)
        text = F.concat(F.lit(_name(f.wire_name(ENCODE)) + ":"), F.coalesce(_value(compiler, f, x, *inner, mask is not None), F.lit("null")))
        parts.append(text if here is None else F.when(here, text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _flag_of(name: str, mask: Column | None, shape: T.DataType | None) -> tuple[Column | None, T.DataType | None]:
    if mask is None or not isinstance(shape, T.StructType) or name not in shape.names:
        return None, None
    return mask[name], shape[name].dataType


def _name(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def _value(compiler: Compiler, f: FieldSpec, v: Val, mask: Column | None, shape: T.DataType | None, masked: bool) -> Column:
    """A field's value as JSON text; null where it is null. Codecs on nested fields see the record's text as a VARIANT."""
    of_contract = is_nested(f) and (f.type.union or f.type.resolve() is not None)
    text = _records(compiler, f, v, mask, shape, masked) if of_contract else None
    if text is None or f.codecs:
        from ..functions.values import variant

        if text is not None:
            v = variant(F.parse_json(text))
        for use in reversed(f.codecs):
            v = use.codec.encode(v)
        text = plain_text(v)
    return text


def _records(compiler: Compiler, f: FieldSpec, v: Val, mask: Column | None, shape: T.DataType | None, masked: bool) -> Column | None:
    # what no flag speaks of is there: a mask without fields stands for that
    whole = F.lit(True) if masked else None

    def one(x: Val, m: Column | None, s: T.DataType | None) -> Column:
        if not f.type.union:
            return written(compiler, f.type.resolve(), x, whole if m is None else m, s)
        tag, out = x.child("tag").get("string"), F.lit(None).cast("string")
        for name, cls in f.type.union.cases.items():
            flag, flags = _flag_of(name, m, s)
            own = written(compiler, cls, x.child(name), whole if flag is None else flag, flags)
            if f.type.keep_tag:
                own = _with_tag(own, f.type.union.property, name)
            out = F.when(tag == name, own).otherwise(out)
        wrong = F.concat(F.lit(f"{f.name}: no case of the union has the tag "), F.coalesce(tag, F.lit("null")))
        return F.coalesce(out, F.raise_error(wrong).cast("string"))

    if f.type.form in ("records", "set") and isinstance(v.element, T.StructType):
        inner = shape.elementType if isinstance(shape, T.ArrayType) else None
        each = F.transform(v.get("array"), lambda x, i: F.when(x.isNotNull(), one(v.item(x), F.get(mask, i) if mask is not None else None, inner)))
        return F.concat(F.lit("["), F.array_join(each, ",", "null"), F.lit("]"))
    if f.type.form == "map" and isinstance(v.shape, T.MapType):
        inner = shape.valueType if isinstance(shape, T.MapType) else None
        entry = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.coalesce(F.when(e["value"].isNotNull(), one(v.entry_item(e["value"]), F.try_element_at(mask, e["key"]) if mask is not None else None, inner)), F.lit("null")))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(v.get("object")), entry), ","), F.lit("}"))
    if isinstance(v.shape, T.StructType):
        return F.when(v.has("object"), one(v, mask, shape))
    return None


def _with_tag(text: Column, key: str, tag: str) -> Column:
    rest = text.substr(F.lit(2), F.length(text) - F.lit(2))
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(rest, F.lit("")), F.lit(f"{_name(key)}:{_name(tag)}")), F.lit("}"))


def _quoted(c: Column) -> Column:
    inside = F.to_json(F.array(c))
    return F.when(c.isNotNull(), inside.substr(F.lit(2), F.length(inside) - F.lit(2)))


def plain_text(v: Val) -> Column:
    """A value that is no record of a contract as JSON text: numbers and instants as JavaScript writes them."""
    if isinstance(v.type, T.VariantType) and v.raw is not None:
        return F.to_json(v.raw)
    if v.only("number") and (v.raw is None or isinstance(v.type, (T.DoubleType, T.FloatType))):
        number = v.get("number")
        return F.when(number.isNotNull(), F.when(is_finite(number), number_text(number)).otherwise(F.lit("null")))
    if v.only("date"):
        return _quoted(iso_text(v.get("date")))
    out = v.output()
    if v.only("array") or v.only("object"):
        return F.to_json(out, {"ignoreNullFields": "false"})
    inside = F.to_json(F.array(out))
    return F.when(out.isNotNull(), inside.substr(F.lit(2), F.length(inside) - F.lit(2)))
