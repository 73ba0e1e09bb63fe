"""A value whose type may only be known row by row.

A ``Val`` holds one column for each kind it may have (string, number, boolean, date, array, object, binary), null in rows
where the value is of another kind, and the flags ``missing`` and ``null``. Columns of known type have one kind, decided
when the plan is built; VARIANT columns have all of JSON's kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("string", "number", "boolean", "date", "array", "object", "binary")


def kind_of(kind: T.DataType) -> str | None:
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.BinaryType):
        return "binary"
    return None


@dataclass(frozen=True)
class Val:
    kinds: dict[str, Column]
    missing: Column
    null: Column
    raw: Column | None = None  # the column as it came, where nothing has changed it
    type: T.DataType | None = None  # its type
    element: T.DataType | None = field(default=None)  # of the array
    shape: T.DataType | None = field(default=None)  # of the object
    null_as: str = "missing"
    names: Column | None = None  # the object's keys, where a better order is known than the variant's, which is sorted

    def has(self, kind: str) -> Column:
        """Two-valued: whether the value is of the kind."""
        return self.kinds[kind].isNotNull() if kind in self.kinds else F.lit(False)

    def get(self, kind: str) -> Column:
        types = {"string": "string", "number": "double", "boolean": "boolean", "date": "timestamp", "array": "array<void>", "object": "struct<>", "binary": "binary"}
        return self.kinds.get(kind, F.lit(None).cast(types[kind]))

    def only(self, kind: str) -> bool:
        return [*self.kinds] == [kind]

    def with_kinds(self, **kinds: Column) -> "Val":
        return replace(self, kinds=self.kinds | kinds, raw=None)

    def either_missing_or_null(self) -> Column:
        return self.missing | self.null

    def child(self, key: str) -> "Val":
        """The value under a key of the object."""
        if self.shape is None or isinstance(self.shape, T.VariantType):
            return variant(F.try_variant_get(self.get("object"), _path(key), "variant")) if "object" in self.kinds else absent()
        if isinstance(self.shape, T.StructType):
            if key not in self.shape.names:
                return absent()
            return typed(self.kinds["object"].getField(key), self.shape[key].dataType, self.null_as)
        return typed(F.try_element_at(self.kinds["object"], F.lit(key)), self.shape.valueType, self.null_as)

    def members(self, keys: list[str]) -> Column:
        """What a variant object has under some keys, as a struct of c0, c1 and so on, null where the value is no object: found in
        one pass, and without the exception that Spark's lookup of a single key leaves its loop by where there is no such key."""
        if not all(keys):  # a type has no field without a name
            return F.when(self.has("object"), F.struct(*(self.child(k).raw.alias(f"c{n}") for n, k in enumerate(keys))))
        shape = ", ".join(f"`{k.replace('`', '``')}`: variant" for k in keys)
        names = ", ".join(f"c{n}: variant" for n, _ in enumerate(keys))
        return F.try_variant_get(self.get("object"), "$", f"struct<{shape}>").cast(f"struct<{names}>")

    def item(self, column: Column) -> "Val":
        """An element of the array, inside a higher-order function: null counts as null, not as missing."""
        if self.element is None or isinstance(self.element, T.VariantType):
            return variant(column["x"], column)
        return typed(column, self.element, "null")

    def plain_array(self) -> Column:
        """The array with its elements as they are (inside a ``Val``, variants go with their type)."""
        whole = self.get("array")
        return F.transform(whole, lambda e: e["x"]) if isinstance(self.element, T.VariantType) else whole

    def keys(self) -> Column:
        """The object's keys: in their order in a text, sorted in a VARIANT."""
        if self.names is not None:
            return self.names
        if "object" not in self.kinds:
            return F.array().cast("array<string>")
        if self.shape is None or isinstance(self.shape, T.VariantType):
            return F.json_object_keys(F.to_json(self.kinds["object"]))
        if isinstance(self.shape, T.StructType):
            return F.array(*map(F.lit, self.shape.names)).cast("array<string>")
        return F.map_keys(self.kinds["object"])

    def entries(self) -> Column:
        """The object as an array of (key, value)."""
        if self.shape is None or isinstance(self.shape, T.VariantType):
            pairs = F.map_entries(F.try_variant_get(self.kinds["object"], "$", "map<string,variant>"))
            return F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), probed(e["value"]).alias("value")))
        if isinstance(self.shape, T.StructType):
            return F.map_entries(F.from_json(F.to_json(self.kinds["object"]), "map<string,string>"))
        return F.map_entries(self.kinds["object"])

    def entry_item(self, column: Column) -> "Val":
        if self.shape is None or isinstance(self.shape, T.VariantType):
            return variant(column["x"], column)
        return typed(column, self.shape.valueType if isinstance(self.shape, T.MapType) else T.StringType(), "null")

    def output(self, kind: str | None = None) -> Column:
        """The value as one column: as it came, or as the given or only kind."""
        if self.raw is not None and (kind is None or self.type is not None and kind_of(self.type) == kind):
            return self.raw
        if kind is None:
            kind = next(iter(self.kinds)) if len(self.kinds) == 1 else "string" if "string" in self.kinds else None
        if kind == "array":
            return self.plain_array()
        return self.get(kind) if kind else F.lit(None).cast("string")

    def chosen(self, otherwise: "Val", when: Column) -> "Val":
        """This value where ``when`` holds, else the other one."""
        kinds = {k: F.when(when, self.get(k)).otherwise(otherwise.get(k)) for k in KINDS if k in self.kinds or k in otherwise.kinds}
        return replace(otherwise, kinds=kinds, missing=F.when(when, self.missing).otherwise(otherwise.missing), null=F.when(when, self.null).otherwise(otherwise.null), raw=None)


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']" if "'" in key else f"$['{key}']"


def absent() -> Val:
    return Val({}, F.lit(True), F.lit(False))


def typed(c: Column, kind: T.DataType, null_as: str = "missing") -> Val:
    """A column of known type. SQL's null stands for a missing value, or for null with ``null_as='null'``."""
    if isinstance(kind, T.VariantType):
        return variant(c)
    gone = c.isNull()
    flags = {"missing": gone, "null": F.lit(False)} if null_as == "missing" else {"missing": F.lit(False), "null": gone}
    name = kind_of(kind)
    if name is None:
        return Val({}, raw=c, type=kind, null_as=null_as, **flags)
    value = c.cast("double") if name == "number" else c.cast("timestamp") if name == "date" else c
    return Val({name: value}, raw=c, type=kind, element=kind.elementType if name == "array" else None, shape=kind if name == "object" else None, null_as=null_as, **flags)


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")


def _kind_name(c: Column) -> Column:
    """A variant's type, of objects and arrays without what they hold: the whole type of a subtree takes a walk through it, at
    every level again."""
    held = F.when(F.try_variant_get(c, "$", "struct<>").isNotNull(), F.lit("OBJECT<>")).when(F.try_variant_get(c, "$", "array<struct<>>").isNotNull(), F.lit("ARRAY<>"))
    return held.otherwise(F.coalesce(F.schema_of_variant(c), F.lit("")))


def probed(c: Column) -> Column:
    """A variant with its type's name and its plain value; both are dear to find, so it is done once and handed on. c is looked at
    several times: bind it by ``let`` unless it is at hand. (No binding in here: Spark's analyser takes rounds for each.)"""
    kind, is_text = F.schema_of_variant(c), F.try_variant_get(c, "$", "binary").isNotNull()  # only a text, or bytes, can be read as bytes
    number, flag = F.try_variant_get(c, "$", "double"), F.try_variant_get(c, "$", "boolean")
    text = F.when(is_text & (kind == "STRING"), F.try_variant_get(c, "$", "string"))
    number = F.when(~is_text & number.isNotNull() & _is_number(kind), number)
    flag = F.when(~is_text & flag.isNotNull() & (kind == "BOOLEAN"), flag)
    return F.struct(c.alias("x"), _kind_name(c).alias("k"), text.alias("s"), number.alias("n"), flag.alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound: it is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def variant(c: Column, probe: Column | None = None) -> Val:
    """A VARIANT column, with what ``probed`` found if that is at hand: SQL's null is missing, a variant null is null."""
    kind = F.coalesce(F.schema_of_variant(c), F.lit("")) if probe is None else probe["k"]
    kinds = {
        "string": F.when(kind == "STRING", F.try_variant_get(c, "$", "string")) if probe is None else probe["s"],
        "number": F.when(_is_number(kind), F.try_variant_get(c, "$", "double")) if probe is None else probe["n"],
        "boolean": F.when(kind == "BOOLEAN", F.try_variant_get(c, "$", "boolean")) if probe is None else probe["b"],
        "date": F.when((kind == "DATE") | kind.startswith("TIMESTAMP"), F.try_variant_get(c, "$", "timestamp")),
        "array": F.when(kind.startswith("ARRAY<"), F.transform(F.try_variant_get(c, "$", "array<variant>"), probed)),
        "object": F.when(kind.startswith("OBJECT<"), c),
    }
    return Val(kinds, c.isNull(), kind == "VOID", raw=c, type=T.VariantType(), element=T.VariantType(), shape=T.VariantType())


def constant(value: object) -> Val:
    """A literal of Python's str, bool, int, float or None."""
    if value is None:
        return Val({}, F.lit(False), F.lit(True))
    if isinstance(value, bool):
        return Val({"boolean": F.lit(value)}, F.lit(False), F.lit(False))
    if isinstance(value, (int, float)):
        return Val({"number": F.lit(float(value))}, F.lit(False), F.lit(False))
    if isinstance(value, str):
        return Val({"string": F.lit(value)}, F.lit(False), F.lit(False))
    return Val({"date": F.lit(value).cast("timestamp")}, F.lit(False), F.lit(False))


def is_literal(v: Val, value: object) -> Column:
    """Whether the value is the literal: of the same kind and equal; NaN equals NaN here."""
    if value is None:
        return v.null
    other = constant(value)
    kind = next(iter(other.kinds))
    return F.coalesce(v.get(kind) == other.get(kind), F.lit(False))


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


Test = Callable[[Val], Column]
