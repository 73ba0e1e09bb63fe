"""Rules by country: mobile phones, postal codes, identity cards and passports."""

from __future__ import annotations

from ..errors import ContractError
from .rule import Rule, pattern_rule

#: Patterns by locale: fixed values.
MOBILE_PHONES = {
    "ko-KR": r"^(\+?82|0)1[016789]\d{7,8}$",
    "en-US": r"^\+?1?[2-9]\d{2}[2-9]\d{6}$",
    "zh-CN": r"^(\+?86)?1[3-9]\d{9}$",
    "zh-TW": r"^(\+?886)?9\d{8}$",
    "ja-JP": r"^(\+?81)?0?[789]0[0-9]{8}$",
    "de-DE": r"^(\+?49)?1(5\d|6[0-9]|7[0-9])\d{8}$",
    "fr-FR": r"^(\+?33)?[67]\d{8}$",
    "en-GB": r"^(\+?44)?7[1-9]\d{8}$",
    "ru-RU": r"^(\+?7)?9\d{9}$",
    "pt-BR": r"^(\+?55)?[1-9]{2}9?\d{8}$",
    "in-IN": r"^(\+?91)?[6-9]\d{9}$",
    "ar-SA": r"^(\+?966)?5\d{8}$",
    "ar-EG": r"^(\+?20)?1[0125]\d{8}$",
    "vi-VN": r"^(\+?84)?[35789]\d{8}$",
    "th-TH": r"^(\+?66)?[689]\d{8}$",
    "id-ID": r"^(\+?62)?8\d{9,11}$",
    "ms-MY": r"^(\+?60)?1\d{8,9}$",
    "nl-NL": r"^(\+?31)?6\d{8}$",
    "it-IT": r"^(\+?39)?3\d{9}$",
    "es-ES": r"^(\+?34)?[67]\d{8}$",
    "pl-PL": r"^(\+?48)?[45789]\d{8}$",
}

#: Patterns by country: fixed values.
POSTAL_CODES = {
    "AD": r"^AD\d{3}$",
    "AT": r"^\d{4}$",
    "AU": r"^\d{4}$",
    "AZ": r"^\d{4}$",
    "BE": r"^\d{4}$",
    "BG": r"^\d{4}$",
    "BR": r"^\d{5}-?\d{3}$",
    "BY": r"^\d{6}$",
    "CA": r"(?i)^[ABCEGHJKLMNPRSTVXY]\d[ABCEGHJ-NPRSTV-Z] ?\d[ABCEGHJ-NPRSTV-Z]\d$",
    "CH": r"^\d{4}$",
    "CN": r"^\d{6}$",
    "CZ": r"^\d{3} ?\d{2}$",
    "DE": r"^\d{5}$",
    "DK": r"^\d{4}$",
    "EE": r"^\d{5}$",
    "ES": r"^\d{5}$",
    "FI": r"^\d{5}$",
    "FR": r"^\d{2} ?\d{3}$",
    "GB": r"(?i)^(GIR ?0AA|[A-PR-UWYZ]([0-9]{1,2}|([A-HK-Y][0-9]([0-9ABEHMNPRV-Y])?)|[0-9][A-HJKPSTUW]) ?[0-9][ABD-HJLNP-UW-Z]{2})$",
    "GR": r"^\d{3} ?\d{2}$",
    "HR": r"^\d{5}$",
    "HU": r"^\d{4}$",
    "ID": r"^\d{5}$",
    "IL": r"^\d{5}(\d{2})?$",
    "IN": r"^\d{6}$",
    "IS": r"^\d{3}$",
    "IT": r"^\d{5}$",
    "JP": r"^\d{3}-?\d{4}$",
    "KR": r"^\d{5}$",
    "LI": r"^(948[5-9]|949[0-7])$",
    "LT": r"^LT-\d{5}$",
    "LU": r"^\d{4}$",
    "LV": r"^LV-\d{4}$",
    "MX": r"^\d{5}$",
    "MT": r"(?i)^[A-Z]{3} ?\d{4}$",
    "MZ": r"^\d{4}$",
    "NL": r"(?i)^\d{4} ?[A-Z]{2}$",
    "NO": r"^\d{4}$",
    "NP": r"^\d{5}$",
    "NZ": r"^\d{4}$",
    "PH": r"^\d{4}$",
    "PK": r"^\d{5}$",
    "PL": r"^\d{2}-\d{3}$",
    "PR": r"^009\d{2}([ -]\d{4})?$",
    "PT": r"^\d{4}-\d{3}$",
    "RO": r"^\d{6}$",
    "RU": r"^\d{6}$",
    "SE": r"^\d{3} ?\d{2}$",
    "SG": r"^\d{6}$",
    "SI": r"^\d{4}$",
    "SK": r"^\d{3} ?\d{2}$",
    "TH": r"^\d{5}$",
    "TN": r"^\d{4}$",
    "TW": r"^\d{3}(\d{2})?$",
    "UA": r"^\d{5}$",
    "US": r"^\d{5}(-\d{4})?$",
    "ZA": r"^\d{4}$",
    "ZM": r"^\d{5}$",
}

#: Patterns by country: fixed values.
IDENTITY_CARDS = {
    "AF": r"^\d{8}$",
    "AL": r"(?i)^[A-Z]\d{8}[A-Z]$",
    "AR": r"^\d{7,8}$",
    "AZ": r"^AZE\d{8}$",
    "BE": r"^\d{11}$",
    "BG": r"^\d{10}$",
    "BR": r"^\d{9}$",
    "BY": r"(?i)^[A-Z]{2}\d{7}$",
    "CA": r"^\d{9}$",
    "CH": r"^756\d{10}$",
    "CN": r"^\d{15}(\d{2}[0-9xX])?$",
    "CY": r"(?i)^\d{7}[A-Z]$",
    "CZ": r"^\d{9,10}$",
    "DE": r"(?i)^[LITOUAEVBMNPRSZDFGHCK]{9}$",
    "DK": r"^\d{10}$",
    "EE": r"^\d{11}$",
    "ES": r"(?i)^[0-9X-Z]\d{7}[TRWAGMYFPDXBNJZSQVHLCKE]$",
    "FI": r"^\d{6}[+-A]\d{3}[0-9A-FHJ-NPR-Y]$",
    "FR": r"(?iu)^\d{8,9}[0-9Á-ÿ]{1}$",
    "GB": r"(?i)^[A-Z]{2}\d{6}[A-Z]$",
    "GR": r"(?i)^[A-Z]{2}\d{6}$",
    "HR": r"^\d{11}$",
    "HU": r"(?i)^\d{8}[A-Z]{2}$",
    "ID": r"^\d{16}$",
    "IE": r"^\d{7}[A-W][A-W]?$",
    "IL": r"^\d{9}$",
    "IN": r"^\d{12}$",
    "IR": r"^\d{10}$",
    "IS": r"^\d{10}$",
    "IT": r"(?i)^[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]$",
    "JP": r"^\d{12}$",
    "KR": r"^\d{6}-\d{7}$",
    "LT": r"^\d{11}$",
    "LU": r"^\d{13}$",
    "LV": r"^\d{6}-\d{5}$",
    "MK": r"^\d{13}$",
    "MX": r"(?i)^[A-Z]{4}\d{6}[HM][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9]\d$",
    "MT": r"(?i)^\d{7}[A-Z]$",
    "NL": r"^\d{9}$",
    "NO": r"^\d{11}$",
    "PL": r"^\d{11}$",
    "PT": r"(?i)^[1-9]\d{7}[0-9TV]$",
    "RO": r"^\d{13}$",
    "RS": r"^\d{13}$",
    "RU": r"^\d{10}$",
    "SE": r"^\d{10,12}$",
    "SI": r"^\d{13}$",
    "SK": r"^\d{9,10}$",
    "TH": r"^\d{13}$",
    "TR": r"^\d{11}$",
    "TW": r"(?i)^[A-Z]\d{9}$",
    "UA": r"^\d{9}$",
    "US": r"^\d{3}-\d{2}-\d{4}$",
    "ZA": r"^\d{13}$",
}

#: Patterns by country: fixed values.
PASSPORTS = {
    "AM": r"(?i)^[A-Z]{2}\d{7}$",
    "AR": r"(?i)^[A-Z]{3}\d{6}$",
    "AT": r"(?i)^[A-Z]\d{7}$",
    "AU": r"(?i)^[A-Z]\d{7}$",
    "AZ": r"^[Aa]\d{8}$",
    "BE": r"(?i)^[A-Z]{2}\d{6}$",
    "BG": r"^\d{9}$",
    "BH": r"(?i)^[A-Z]{2}\d{6}$",
    "BR": r"(?i)^[A-Z]{2}\d{6}$",
    "BY": r"(?i)^[A-Z]{2}\d{7}$",
    "CA": r"(?i)^[A-Z]{2}\d{6}$",
    "CH": r"(?i)^[A-Z]\d{7}$",
    "CN": r"^G\d{8}$",
    "CY": r"(?i)^[A-Z](\d{6}|\d{8})$",
    "CZ": r"^\d{8}$",
    "DE": r"(?i)^[CFGHJKLMNPRTVWXYZ0-9]{9}$",
    "DK": r"^\d{9}$",
    "EE": r"(?i)^([A-Z]\d{7}|[A-Z]{2}\d{7})$",
    "ES": r"(?i)^[A-Z0-9]{2}([A-Z0-9]?)\d{6}$",
    "FI": r"(?i)^[A-Z]{2}\d{7}$",
    "FR": r"(?i)^[A-Z0-9]{9}$",
    "GB": r"^\d{9}$",
    "GR": r"(?i)^[A-Z]{2}\d{7}$",
    "HR": r"^\d{9}$",
    "HU": r"(?i)^[A-Z]{2}(\d{6}|\d{7})$",
    "ID": r"(?i)^[A-C]\d{7}$",
    "IE": r"(?i)^[A-Z0-9]{2}\d{7}$",
    "IL": r"^\d{9}$",
    "IN": r"(?i)^[A-Z]\d{7}$",
    "IR": r"(?i)^[A-Z]\d{8}$",
    "IS": r"(?i)^(A)\d{7}$",
    "IT": r"(?i)^[A-Z0-9]{9}$",
    "JO": r"(?i)^[A-Z]{2}\d{7}$",
    "JP": r"(?i)^[A-Z]{2}\d{7}$",
    "KR": r"(?i)^[A-Z][A-Z0-9]\d{7}$",
    "KW": r"^\d{8}$",
    "KZ": r"(?i)^[A-Z]\d{8}$",
    "LI": r"(?i)^[A-Z]\d{6}X$",
    "LT": r"(?i)^[A-Z0-9]{8}$",
    "LU": r"(?i)^[A-Z0-9]{8}$",
    "LV": r"(?i)^[A-Z0-9]{2}\d{7}$",
    "LY": r"(?i)^[A-Z]{2}\d{7}$",
    "MA": r"(?i)^[A-Z0-9]{2}\d{7}$",
    "MD": r"(?i)^[A-Z]{2}\d{7}$",
    "ME": r"(?i)^[A-Z]{2}\d{7}$",
    "MK": r"(?i)^[A-Z]\d{7}$",
    "MT": r"^\d{7}$",
    "MX": r"(?i)^[A-Z]\d{8}$",
    "MY": r"(?i)^[AHK]\d{8}[A-Z]$",
    "NL": r"(?i)^[A-NP-Z]{2}[A-NP-Z0-9]{6}\d$",
    "NO": r"^\d{9}$",
    "NZ": r"(?i)^[A-Z]{2}\d{6}$",
    "PH": r"(?i)^[A-Z]\d{7}[A-Z]$",
    "PK": r"(?i)^[A-Z]{2}\d{7}$",
    "PL": r"(?i)^[A-Z]{2}\d{7}$",
    "PT": r"(?i)^[A-Z]\d{6}$",
    "RO": r"^\d{8}$",
    "RS": r"^\d{9}$",
    "RU": r"^\d{9}$",
    "SA": r"(?i)^[A-Z]\d{8}$",
    "SE": r"^\d{8}$",
    "SL": r"(?i)^(P)[A-Z]\d{7}$",
    "SK": r"(?i)^[0-9A-Z]\d{7}$",
    "TH": r"(?i)^[A-Z]{1,2}\d{6,7}$",
    "TN": r"^\d{8}$",
    "TR": r"(?i)^[A-Z]\d{8}$",
    "TW": r"(?i)^[A-Z]\d{9}$",
    "UA": r"(?i)^[A-Z]{2}\d{6}$",
    "US": r"^\d{9}$",
    "ZA": r"(?i)^[A-Z]\d{8}$",
}


def _by_locale(name: str, patterns: dict[str, str], locale: str) -> Rule:
    if locale not in patterns:
        raise ContractError(f"{name}: no locale {locale!r}")
    return pattern_rule(name, patterns[locale], constraints={"locale": locale})


def is_mobile_phone(locale: str) -> Rule:
    return _by_locale("isMobilePhone", MOBILE_PHONES, locale)


def is_postal_code(locale: str) -> Rule:
    return _by_locale("isPostalCode", POSTAL_CODES, locale)


def is_identity_card(locale: str) -> Rule:
    return _by_locale("isIdentityCard", IDENTITY_CARDS, locale)


def is_passport_number(locale: str) -> Rule:
    return _by_locale("isPassportNumber", PASSPORTS, locale)
