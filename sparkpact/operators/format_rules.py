"""Rules on widths, encodings, colours, addresses, places and other text formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..functions.compat import found, utf16_length, valid_json
from ..functions.values import Val
from .rule import Rule, on_text, pattern_rule

# ---- widths: each asks for at least one such character ----
_HALF = r"\x20-\x7E｡-ﾟ"
is_full_width = pattern_rule("isFullWidth", f"[^{_HALF}]")
is_half_width = pattern_rule("isHalfWidth", f"[{_HALF}]")
is_variable_width = on_text("isVariableWidth", lambda c: found(c, f"[^{_HALF}]") & found(c, f"[{_HALF}]"))
is_multibyte = pattern_rule("isMultibyte", r"[^\x00-\xFF]")
is_surrogate_pair = pattern_rule("isSurrogatePair", r"[\x{10000}-\x{10FFFF}]")

# ---- encodings ----
#: Digits of the bases.
_HEX = "[0-9a-fA-F]"
is_hexadecimal = pattern_rule("isHexadecimal", f"^{_HEX}+$")
is_octal = pattern_rule("isOctal", "^(0[oO])?[0-7]+$")
is_base58 = pattern_rule("isBase58", "^[1-9A-HJ-NP-Za-km-z]+$")


def is_base32() -> Rule:
    return on_text("isBase32", lambda c: (utf16_length(c) % 8 == 0) & found(c, "^[A-Z2-7]+=*$", "i"))


def is_base64(*, url_safe: bool | None = None) -> Rule:
    """Whole blocks of four; the url-safe alphabet may leave its padding out."""
    a, two, one = ("[A-Za-z0-9_-]", "(==)?", "=?") if url_safe else ("[A-Za-z0-9+/]", "==", "=")
    return pattern_rule("isBase64", f"^({a}{{4}})*({a}{{2}}{two}|{a}{{3}}{one}|{a}{{4}})$", constraints={"urlSafe": url_safe} if url_safe is not None else {})


# ---- colours ----
#: The parts of a colour.
_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PART = "(100|[0-9]{1,2})%"
_ALPHA = r"(0|0?\.[0-9]+|1(\.0+)?)"


def _call(name: str, *arguments: str) -> str:
    return rf"^{name}\(\s*" + r"\s*,\s*".join(arguments) + r"\s*\)$"


is_hex_color = pattern_rule("isHexColor", f"^#({_HEX}{{3,4}}|{_HEX}{{6}}|{_HEX}{{8}})$")


def is_rgb_color(include_percent: bool = False) -> Rule:
    forms = [_call("rgb", *[_BYTE] * 3), _call("rgba", *[_BYTE] * 3, _ALPHA)]
    if include_percent:
        forms += [_call("rgb", *[_PART] * 3), _call("rgba", *[_PART] * 3, _ALPHA)]
    return pattern_rule("isRgbColor", *forms, constraints={"includePercentValues": include_percent})


_HUE, _SHARE = "(360|3[0-5][0-9]|[12][0-9]{2}|[1-9]?[0-9])", "(100|[1-9]?[0-9])%"
is_hsl = pattern_rule("isHSL", _call("hsl", _HUE, _SHARE, _SHARE), _call("hsla", _HUE, _SHARE, _SHARE, _ALPHA))

# ---- addresses and names on networks ----
_LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_PORT_TEXT = "(6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3}|0)"


def is_email() -> Rule:
    # a fixed value
    return pattern_rule("isEmail", rf"^[a-zA-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@({_LABEL}\.)+[a-zA-Z]{{2,}}$", constraints={"format": "email"})


def is_url(*, protocols: list[str] | None = None) -> Rule:
    """scheme://host, then a port and a path; a query needs a path before it."""
    protocols = ["http", "https", "ftp"] if protocols is None else [*protocols]
    quoted = "|".join("".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in p) for p in protocols)
    return pattern_rule("isURL", rf"^({quoted})://{_LABEL}(\.{_LABEL})*(:{_PORT_TEXT})?(/[^\s]*)?$", constraints={"format": "uri", "protocols": protocols})


def is_uuid(version: int | str | None = None) -> Rule:
    if version not in (None, "all", 1, 2, 3, 4, 5):
        raise ContractError(f"isUUID: no version {version!r}")
    third, fourth = (f"{_HEX}{{4}}", f"{_HEX}{{4}}") if version in (None, "all") else (f"{version}{_HEX}{{3}}", f"[89abAB]{_HEX}{{3}}")
    return pattern_rule("isUUID", f"^{_HEX}{{8}}-{_HEX}{{4}}-{third}-{fourth}-{_HEX}{{12}}$", constraints={"version": version} if version is not None else {})


_IPV4 = rf"{_BYTE}(\.{_BYTE}){{3}}"
#: In IPv6 addresses, the four numbers may have leading zeros.
_IPV4_LOOSE = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}"


def _ipv6() -> list[str]:
    g = f"{_HEX}{{1,4}}"
    forms = [f"^({g}:){{7}}{g}$", f"^::({g}:){{0,6}}{g}$", f"^({g}:){{1,7}}:$", "^::$"]
    forms += [f"^({g}:){{1,{n}}}(:{g}){{1,{7 - n}}}$" for n in range(6, 0, -1)]
    return [*forms, f"^::(ffff(:0{{1,4}})?:)?{_IPV4_LOOSE}$", f"^({g}:){{1,4}}:{_IPV4_LOOSE}$"]


def is_ip(version: int | None = None) -> Rule:
    forms = {4: [f"^{_IPV4}$"], 6: _ipv6()}
    if version not in (None, *forms):
        raise ContractError(f"isIP: no version {version!r}")
    return pattern_rule("isIP", *(forms[version] if version else forms[4] + forms[6]), constraints={"version": version} if version else {})


def is_mac_address(*, no_separators: bool = False) -> Rule:
    forms = [f"^{_HEX}{{12}}$"] if no_separators else [f"^{_HEX}{{2}}({s}{_HEX}{{2}}){{5}}$" for s in ":-"]
    return pattern_rule("isMACAddress", *forms, constraints={"noSeparators": no_separators})


is_port = pattern_rule("isPort", f"^{_PORT_TEXT}$")


def is_fqdn(*, require_tld: bool = True, allow_underscores: bool = False, allow_trailing_dot: bool = False) -> Rule:
    part = "[a-zA-Z0-9_-]{1,63}" if allow_underscores else _LABEL

    def test(c: Column) -> Column:
        name = F.regexp_replace(c, r"\.\z", "") if allow_trailing_dot else c
        labels = F.split(name, r"\.", -1)
        ok = F.forall(labels, lambda x: x.rlike(rf"\A{part}\z"))
        return ok & (F.size(labels) > 1) & F.get(labels, F.size(labels) - 1).rlike(r"\A[a-zA-Z]{2,}\z") if require_tld else ok

    return on_text("isFQDN", test, {"requireTld": require_tld, "allowUnderscores": allow_underscores, "allowTrailingDot": allow_trailing_dot})


# ---- other formats ----
#: The formats as they are accepted.
is_jwt = pattern_rule("isJWT", r"^[\w-]+(\.[\w-]+){2}$")
is_locale = pattern_rule("isLocale", "^[a-zA-Z]{2,3}(-[a-zA-Z]{4})?(-([a-zA-Z]{2}|[0-9]{3}))?(-([a-zA-Z0-9]{5,8}|[0-9][a-zA-Z0-9]{3}))*$")
_MEDIA = r"[a-zA-Z0-9!#$&\-^_]+"
is_data_uri = pattern_rule("isDataURI", rf"^data:{_MEDIA}/{_MEDIA}(;[a-zA-Z0-9-]+=[a-zA-Z0-9-]+)*(;base64)?,[\s\S]*$")
is_mime_type = pattern_rule("isMimeType", r"^(application|audio|font|image|message|model|multipart|text|video)/[a-zA-Z0-9][a-zA-Z0-9!#$&\-^_.+]*(;.+)?$")
is_magnet_uri = pattern_rule("isMagnetURI", r"^magnet:\?xt=urn:[a-z0-9]+:[a-z0-9]{32,40}(&[a-z][a-z0-9.]*=[^&\s]*)*$", flags="i")
is_phone_number = pattern_rule("isPhoneNumber", r"^\+[1-9][0-9]{6,14}$")
is_json = on_text("isJSON", valid_json)


def is_byte_length(minimum: int, maximum: int | None = None) -> Rule:
    def test(c: Column) -> Column:
        return F.octet_length(c) >= minimum if maximum is None else F.octet_length(c).between(minimum, maximum)

    return on_text("isByteLength", test, {"min": minimum} | ({"max": maximum} if maximum is not None else {}))


def is_strong_password(*, min_length: int = 8, min_lowercase: int = 1, min_uppercase: int = 1, min_numbers: int = 1, min_symbols: int = 1) -> Rule:
    """Counts by ASCII class; whatever is no ASCII letter or digit is a symbol."""
    least = {"a-z": min_lowercase, "A-Z": min_uppercase, "0-9": min_numbers}

    def test(c: Column) -> Column:
        counts = [F.length(F.regexp_replace(c, f"[^{s}]", "")) >= n for s, n in least.items()]
        counts.append(utf16_length(F.regexp_replace(c, "[0-9A-Za-z]", "")) >= min_symbols)
        return reduce(lambda a, b: a & b, counts, utf16_length(c) >= min_length)

    return on_text("isStrongPassword", test)


#: Fixed values.
TAX_IDS = {
    "US": r"^\d{2}-\d{7}$", "KR": r"^\d{3}-\d{2}-\d{5}$", "DE": r"^\d{11}$", "FR": r"^[0-9]{13}$", "GB": r"^\d{10}$", "IT": r"(?i)^[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]$",
    "ES": r"(?i)^[0-9A-Z]\d{7}[0-9A-Z]$", "AU": r"^\d{11}$", "CA": r"^\d{9}$", "IN": r"(?i)^[A-Z]{5}\d{4}[A-Z]$",
}


def is_tax_id(locale: str) -> Rule:
    if locale not in TAX_IDS:
        raise ContractError(f"isTaxId: no locale {locale!r}")
    return pattern_rule("isTaxId", TAX_IDS[locale], constraints={"locale": locale})


# ---- places, money of the net, times ----
def is_lat_long() -> Rule:
    latitude, longitude = r"([1-8]?[0-9](\.[0-9]+)?|90(\.0+)?)", r"(180(\.0+)?|1[0-7][0-9](\.[0-9]+)?|[0-9]{1,2}(\.[0-9]+)?)"
    return pattern_rule("isLatLong", rf"^[-+]?{latitude},\s*[-+]?{longitude}$")


def _degrees(name: str, bound: float) -> Rule:
    """A number or a plain decimal text within the bound; NaN is outside."""

    def test(v: Val) -> Column:
        text = v.get("string")
        number = F.coalesce(v.get("number"), F.when(text.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), text.try_cast(T.DoubleType())))
        return ~F.isnan(number) & (F.abs(number) <= bound)

    return Rule(name, test)


is_latitude = _degrees("isLatitude", 90.0)
is_longitude = _degrees("isLongitude", 180.0)
#: The forms of the coins' addresses.
is_ethereum_address = pattern_rule("isEthereumAddress", f"^0x{_HEX}{{40}}$")
is_btc_address = pattern_rule("isBtcAddress", "^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$", "^(bc|tb)1[a-z0-9]{6,87}$", "^(BC|TB)1[A-Z0-9]{6,87}$")
#: Hex digits by algorithm: fixed values.
HASH_DIGITS = {
    "md5": 32, "md4": 32, "md2": 32, "sha1": 40, "sha256": 64, "sha384": 96, "sha512": 128, "ripemd128": 32, "ripemd160": 40,
    "tiger128,3": 32, "tiger128,4": 32, "tiger160,3": 40, "tiger160,4": 40, "tiger192,3": 48, "tiger192,4": 48, "crc32": 8, "crc32b": 8,
}


def is_hash(algorithm: str) -> Rule:
    if algorithm not in HASH_DIGITS:
        raise ContractError(f"isHash: no algorithm {algorithm!r}")
    return pattern_rule("isHash", f"^{_HEX}{{{HASH_DIGITS[algorithm]}}}$", constraints={"algorithm": algorithm})


#: The forms of times.
is_rfc3339 = pattern_rule("isRFC3339", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$", flags="i")
is_military_time = pattern_rule("isMilitaryTime", "^([01][0-9]|2[0-3]):[0-5][0-9]$")
