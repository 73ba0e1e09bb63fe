"""Rules with check digits, and money."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ContractError
from ..functions.compat import SPACES, found
from .rule import Rule, on_text, pattern_rule


def weighted_sum(digits: Column, n: int, weight: Callable[[Column], Column]) -> Column:
    """The sum of the first n characters' digits, each times the weight of its place (from 0); X counts 10."""
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def value(i: Column) -> Column:
        c = F.substr(digits, i + F.lit(1), F.lit(1))
        return F.when(c == "X", F.lit(10)).otherwise(F.ascii(c) - F.lit(48)) * weight(i)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda total, x: total + x)


def _without(c: Column, inside: str) -> Column:
    return F.regexp_replace(c, f"[{inside}]", "")


def _isbn10(s: Column) -> Column:
    return found(s, "^[0-9]{9}[0-9X]$") & (weighted_sum(s, 10, lambda i: F.lit(10) - i) % 11 == 0)


def _ean(s: Column, n: int) -> Column:
    """Weights 1 and 3 in turn, 1 for the last digit."""
    return found(s, f"^[0-9]{{{n}}}$") & (weighted_sum(s, n, lambda i: F.when((i + n) % 2 == 1, F.lit(1)).otherwise(F.lit(3))) % 10 == 0)


def is_isbn(version: int | None = None) -> Rule:
    if version not in (None, 10, 13):
        raise ContractError(f"isISBN: no version {version!r}")

    def test(c: Column) -> Column:
        s = _without(c, SPACES + r"\-")
        return _isbn10(s) if version == 10 else _ean(s, 13) if version == 13 else _isbn10(s) | _ean(s, 13)

    return on_text("isISBN", test, {"version": version} if version else {})


def _letters_as_numbers(c: Column) -> Column:
    """A to Z become 10 to 35."""
    out = c
    for k in range(26):
        out = F.replace(out, F.lit(chr(65 + k)), F.lit(str(10 + k)))
    return out


is_isin = on_text("isISIN", lambda c: found(c, "^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", _letters_as_numbers(c)))


def is_issn(*, require_hyphen: bool = True) -> Rule:
    def test(c: Column) -> Column:
        shape = "^[0-9]{4}-[0-9]{3}[0-9X]$" if require_hyphen else "^[0-9]{7}[0-9X]$"
        s = _without(c, r"\-")
        return found(c if require_hyphen else s, shape) & (weighted_sum(s, 8, lambda i: F.lit(8) - i) % 11 == 0)

    return on_text("isISSN", test, {"requireHyphen": require_hyphen})


is_ean = on_text("isEAN", lambda c: _ean(c, 8) | _ean(c, 13))
is_bic = pattern_rule("isBIC", "^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$", flags="i")


def is_currency() -> Rule:
    """One sign at most, before or after the dollar; thousands in threes; up to two decimals."""
    return pattern_rule("isCurrency", r"^([-+]?\$?|\$[-+]?)([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]{1,2})?$")


def _credit_card(c: Column) -> Column:
    s = _without(c, SPACES + r"\-")
    return found(s, "^[0-9]+$") & F.call_function("luhn_check", s)


is_credit_card = on_text("isCreditCard", _credit_card)

#: Length by country: fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}


def is_iban(*, allow_spaces: bool = False) -> Rule:
    def test(c: Column) -> Column:
        s = F.upper(_without(c, SPACES) if allow_spaces else c)
        lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
        long_enough = F.coalesce(F.try_element_at(lengths, F.substring(s, 1, 2)) == F.length(s), F.lit(True))
        turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
        digits = F.filter(F.split(_letters_as_numbers(turned), ""), lambda x: x != "")
        rest = F.aggregate(digits, F.lit(0), lambda r, d: (r * 10 + F.ascii(d) - F.lit(48)) % 97)
        return found(s, "^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & long_enough & (rest == 1)

    return on_text("isIBAN", test, {"allowSpaces": allow_spaces})


#: ISO 4217: fixed values.
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD "
    "EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL "
    "MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN "
    "SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA YER ZAR ZMW ZWL"
).split()
is_iso4217_currency_code = on_text("isISO4217CurrencyCode", lambda c: c.isin(*CURRENCIES))
