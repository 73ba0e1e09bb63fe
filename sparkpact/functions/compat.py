"""JavaScript's semantics of text, numbers and dates as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JavaScript's white space, as the inside of a Java character class: fixed values.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def java_pattern(pattern: str, flags: str = "") -> str:
    """A JavaScript pattern as a Java one: ``$`` is only the very end, ``\\s`` and ``.`` cover what JavaScript's do."""
    out, k, inside = [], 0, False
    pattern = pattern.replace(r"[\s\S]", r"(?s:.)")
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("(?s:.)", k) and not inside:
            out.append("(?s:.)")
            k += 6
            continue
        if c == "\\" and k + 1 < len(pattern):
            pair = pattern[k : k + 2]
            if pair == r"\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif pair == r"\S" and not inside:
                out.append(f"[^{SPACES}]")
            else:
                out.append(pair)
            k += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern.startswith("^", k + 1):
                out.append("^")
                k += 1
        elif c == "$" and "m" not in flags:
            out.append(r"\z")
        elif c == "." and "s" not in flags:
            out.append(r"[^\n\r\u2028\u2029]")
        else:
            out.append(c)
        k += 1
    kept = "".join(f for f in "ims" if f in flags) + ("u" if "u" in flags else "")
    return (f"(?{kept})" if kept else "") + "".join(out)


def found(c: Column, pattern: str, flags: str = "") -> Column:
    """Whether a JavaScript pattern is found in the text."""
    return c.rlike(java_pattern(pattern, flags))


def utf16_length(c: Column) -> Column:
    return F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A[{SPACES}]+|[{SPACES}]+\\z", "")


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def number_text(c: Column) -> Column:
    """A double as JavaScript prints it (exact for integers below 1e21 and for up to 18 decimals)."""
    whole = c.cast("decimal(38,0)").cast("string")
    plain = F.regexp_replace(c.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+\z", "")
    short = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), "E-", "e-")
    size = F.abs(c)
    return (
        F.when(F.isnan(c) | (size == F.lit(float("inf"))), c.cast("string"))
        .when((c == F.rint(c)) & (size < 1e21), F.regexp_replace(whole, r"\A-0\z", "0"))
        .when((size >= 1e-6) & (size < 1e17), plain)
        .otherwise(F.regexp_replace(short, "E", "e+"))
    )


def at_most_decimals(c: Column, n: int) -> Column:
    """Whether a double is whole, or is the nearest double to some number of n decimals."""
    factor = F.lit(float(10**n))
    return (F.rint(c) == c) | (F.rint(c * factor) / factor == c)


#: What a text must look like to be a number or a date when it is converted.
NUMBER_TEXT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
ISO_DATE = r"\A[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?\z"
ISO_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\z"


def _based(digits: Column, base: int, block: int) -> Column:
    """The nearest double of digits to a base that is a power of two. The first two blocks of digits are taken exactly, as a
    decimal; of what follows only the length counts, and whether it is zero."""
    digits = F.regexp_replace(digits, r"\A0+(?=.)", "")
    whole = lambda text: F.coalesce(F.conv(F.when(text != "", text), base, 10), F.lit("0")).cast("decimal(19,0)")
    high, low, rest = F.substring(digits, 1, block), F.substring(digits, block + 1, block), F.substring(digits, F.lit(2 * block + 1), F.length(digits))
    shift = F.pow(F.lit(float(base)), F.length(low)).cast("decimal(19,0)")
    head = (whole(high) * shift).cast("decimal(38,0)") + whole(low).cast("decimal(38,0)")
    odd = F.when(rest.rlike("[^0]") & (head % 2 == 0), F.lit(1)).otherwise(F.lit(0))
    return (head + odd).cast("double") * F.pow(F.lit(float(base)), F.length(rest))


def to_number(c: Column) -> Column:
    """Number(text): null where that is NaN. Blank texts are 0; hexadecimal, octal and binary forms count."""
    t = js_trim(c)
    based = F.lit(None).cast("double")
    for mark, digits, base, block in (("x", "0-9a-fA-F", 16, 15), ("o", "0-7", 8, 20), ("b", "01", 2, 60)):
        based = F.when(t.rlike(f"\\A0[{mark}{mark.upper()}][{digits}]+\\z"), _based(F.substring(t, F.lit(3), F.length(t)), base, block)).otherwise(based)
    infinite = F.when(t.isin("Infinity", "+Infinity"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(NUMBER_TEXT), t.try_cast("double")).otherwise(F.coalesce(infinite, based))


def to_instant(c: Column) -> Column:
    """Date(text) for ISO forms, in the session's zone where the text has none; null elsewhere. Milliseconds are kept."""
    padded = F.when(c.rlike(r"\A[0-9]{4}\z"), F.concat(c, F.lit("-01-01"))).when(c.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.concat(c, F.lit("-01"))).otherwise(c)
    return F.when(c.rlike(ISO_DATE) | c.rlike(ISO_TIME), F.date_trunc("MILLISECOND", padded.try_cast("timestamp")))


def iso_text(c: Column) -> Column:
    """An instant as ISO text in UTC with milliseconds (the session's zone must be UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def strict_json(c: Column) -> Column:
    """The JSON text as VARIANT; null where JSON.parse fails. Spark's parser overlooks what follows the first value: what is
    inside of two kinds of brackets shows it."""
    listed, keyed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return F.when(keyed.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def valid_json(c: Column) -> Column:
    """Whether JSON.parse takes the text."""
    return strict_json(c).isNotNull()


def brackets_deep(c: Column) -> Column:
    """How deep a JSON text's brackets are nested. The innermost pairs are taken out first, so that a long chain is one run of
    opening brackets and one of closing ones."""
    brackets = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"|[^\[\]{}"]+', "")
    runs = F.regexp_extract_all(F.regexp_replace(brackets, r"\[\]|\{\}", ""), F.lit(r"[\[{]+|[\]}]+"), F.lit(0))
    opened = lambda x: F.when(x.startswith("[") | x.startswith("{"), F.length(x)).otherwise(-F.length(x))
    step = lambda a, x: F.struct((a["at"] + opened(x)).alias("at"), F.greatest(a["most"], a["at"] + opened(x)).alias("most"))
    return F.when(brackets == "", F.lit(0)).otherwise(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda a: a["most"]) + 1)
