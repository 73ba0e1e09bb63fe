"""Codecs: what is done to a value on the way in, before the rules, and on the way out.

A codec takes and gives a ``Val``. A value of another kind than the codec's passes through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compat import is_finite, iso_text, js_trim, number_text, to_instant, valid_json
from ..functions.values import Val, let, probed, variant

Step = Callable[[Val], Val]


@dataclass(frozen=True, eq=False)
class Codec:
    decode: Step
    encode: Step
    #: The kind that decoding aims at, which is the type of the decoded column.
    gives: str | None = None


def codec(decode: Step | None = None, encode: Step | None = None, gives: str | None = None) -> Codec:
    """A codec of one's own; a half that isn't given changes nothing."""
    return Codec(decode or (lambda v: v), encode or (lambda v: v), gives)


def _text(change: Callable[[Column], Column]) -> Codec:
    def step(v: Val) -> Val:
        return v.with_kinds(string=change(v.kinds["string"])) if "string" in v.kinds else v

    return Codec(step, step)


trim = _text(js_trim)
to_lower_case = _text(F.lower)
to_upper_case = _text(F.upper)


def round_to(decimals: int = 0) -> Codec:
    """Half up at a decimal place, of finite numbers: -2.5 becomes -2."""
    factor = float(10**decimals)

    def step(v: Val) -> Val:
        if "number" not in v.kinds:
            return v
        c = v.kinds["number"]
        # the double's own floor: a bigint floor would overflow
        scaled = c * F.lit(factor) + F.lit(0.5)
        floored = scaled - F.pmod(scaled, F.lit(1.0))
        return v.with_kinds(number=F.when(is_finite(c), floored / F.lit(factor)).otherwise(c))

    return Codec(step, step)


#: The instants that a date may be, in milliseconds from 1970: fixed value.
LAST_MILLIS = 8.64e15
#: What Spark's timestamps hold of them.
_SPARK_MILLIS = 9.2e15


def _unix(per_second: bool) -> Codec:
    def decode(v: Val) -> Val:
        if "number" not in v.kinds:
            return v
        c = v.kinds["number"]
        millis = c * F.lit(1000.0) if per_second else c
        ok = is_finite(c) & (F.abs(millis) <= LAST_MILLIS)
        # towards zero, as dates do
        instant = F.when(ok, F.timestamp_millis(F.when(ok, millis).cast("long")))
        return v.with_kinds(date=F.coalesce(v.get("date"), instant), number=F.when(~ok, c))

    def encode(v: Val) -> Val:
        if "date" not in v.kinds:
            return v
        c = v.kinds["date"]
        number = (F.unix_seconds(c) if per_second else F.unix_millis(c)).cast("double")
        return Val({k: x for k, x in v.kinds.items() if k != "date"} | {"number": F.coalesce(number, v.get("number"))}, v.missing, v.null)

    return Codec(decode, encode, "date")


unix_seconds, unix_millis = _unix(True), _unix(False)


def _parsed(v: Val) -> Val:
    if "string" not in v.kinds:
        return v
    instant = to_instant(v.kinds["string"])
    return v.with_kinds(date=F.coalesce(v.get("date"), instant), string=F.when(instant.isNull(), v.kinds["string"]))


def _printed(text: Callable[[Column], Column]) -> Step:
    def encode(v: Val) -> Val:
        if "date" not in v.kinds:
            return v
        return Val({k: x for k, x in v.kinds.items() if k != "date"} | {"string": F.coalesce(text(v.kinds["date"]), v.get("string"))}, v.missing, v.null)

    return encode


iso_string = Codec(_parsed, _printed(iso_text), "date")

#: Format tokens of the two date libraries as Spark's.
_LUXON = {"yyyy": "yyyy", "yy": "yy", "MM": "MM", "M": "M", "MMM": "MMM", "MMMM": "MMMM", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "a": "a", "EEE": "E", "EEEE": "EEEE", "ZZ": "xxx"}
_MOMENT = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "M": "M", "MMM": "MMM", "MMMM": "MMMM", "DD": "dd", "D": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "A": "a", "ddd": "E", "dddd": "EEEE", "Z": "xxx"}


def spark_format(pattern: str, tokens: dict[str, str]) -> str:
    """A date library's format as Spark's; other letters are taken literally."""
    out, k = "", 0
    while k < len(pattern):
        token = next((t for t in sorted(tokens, key=len, reverse=True) if pattern.startswith(t, k)), None)
        out += tokens[token] if token else f"'{pattern[k]}'" if pattern[k].isalpha() else pattern[k]
        k += len(token) if token else 1
    return out.replace("''", "")


def luxon(*, zone: str = "utc", format: str | None = None) -> Codec:  # noqa: A002  the option's name
    """ISO texts to instants; out as ISO text or in a format, in a zone."""
    zone = "UTC" if zone.lower() == "utc" else zone

    def text(c: Column) -> Column:
        return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz")), spark_format(format, _LUXON) if format else "yyyy-MM-dd'T'HH:mm:ss.SSS") if zone != "UTC" or format else iso_text(c)

    return Codec(_parsed, _printed(text), "date")


def moment(*, format: str | None = None) -> Codec:  # noqa: A002
    """ISO texts to instants; out as ISO text or in a format, in UTC."""
    return Codec(_parsed, _printed(lambda c: F.date_format(c, spark_format(format, _MOMENT)) if format else iso_text(c)), "date")


def csv(separator: str = ",") -> Codec:
    quoted = "\\Q" + separator + "\\E"

    def decode(v: Val) -> Val:
        if "string" not in v.kinds:
            return v
        parts = F.split(v.kinds["string"], quoted, -1)
        if "array" in v.kinds:  # elements of both origins as variants
            parts = F.coalesce(v.kinds["array"], F.transform(parts, lambda x: let(F.parse_json(F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - F.lit(2))), probed)))
            return replace(v.with_kinds(array=parts), kinds={k: c for k, c in (v.kinds | {"array": parts}).items() if k != "string"})
        return Val({k: x for k, x in v.kinds.items() if k != "string"} | {"array": parts}, v.missing, v.null, element=T.StringType(), shape=v.shape)

    def encode(v: Val) -> Val:
        if "array" not in v.kinds:
            return v
        texts = F.transform(v.kinds["array"], lambda x: _joined(v.item(x)))
        joined = F.when(v.kinds["array"].isNotNull(), F.array_join(texts, separator, ""))
        return Val({k: x for k, x in v.kinds.items() if k != "array"} | {"string": F.coalesce(joined, v.get("string"))}, v.missing, v.null)

    return Codec(decode, encode, "array")


def _joined(v: Val) -> Column:
    return F.coalesce(v.get("string"), number_text(v.get("number")) if "number" in v.kinds else F.lit(None).cast("string"), v.get("boolean").cast("string"), F.lit(""))


def _from_json(v: Val) -> Val:
    if "string" not in v.kinds:
        return v
    text = v.kinds["string"]
    ok = F.coalesce(valid_json(text), F.lit(False))
    parsed = variant(F.try_parse_json(F.when(ok, text)))
    kinds = {k: parsed.kinds[k] for k in parsed.kinds}
    kinds["string"] = F.coalesce(kinds["string"], F.when(~ok, text))
    return Val(kinds, v.missing, v.null | parsed.null, element=parsed.element, shape=parsed.shape)


def _to_json(v: Val) -> Val:
    own = [F.to_json(v.plain_array() if k == "array" else v.kinds[k]) for k in ("object", "array") if k in v.kinds]
    if not own:
        return v
    kinds = {k: c for k, c in v.kinds.items() if k not in ("object", "array")}
    return Val(kinds | {"string": F.coalesce(*own, v.get("string"))}, v.missing, v.null)


#: JSON texts to values; a text that is no JSON stays a text.
json = Codec(_from_json, _to_json)
