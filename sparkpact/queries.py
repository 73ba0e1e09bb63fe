"""The registered queries of the contract engine and their DuckDB equivalents.

Most queries judge one text a row. The texts are made from the tables' keys by SQL that both engines read; about half of
them are spoilt, so that every rule passes some rows and fails others. The DuckDB side states the rule anew where SQL can do so
in a line; for the formats whose rule is a long pattern it tells which texts were built sound and which were spoilt.
"""

from __future__ import annotations

import enum
import re
from collections.abc import Callable
from datetime import datetime
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as r
from .operators import format_rules, locale_rules
from .plans import Engine, array_of, field, union
from .plans.engine import exploded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(oracle: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if oracle:
            ORACLES[query.__name__] = oracle
        return query

    return add


# ---- contracts over the tables as they are ----
engine = Engine()


@engine.contract
class Order:
    o_orderkey = field(r.is_int)
    o_totalprice = field(r.is_number(), r.min_value(50_000), r.max_value(400_000))
    o_orderpriority = field(r.is_in(["1-URGENT", "2-HIGH", "3-MEDIUM"]))
    o_orderstatus = field(r.is_string, r.length(1, 1), r.matches("^[FO]$"))


@engine.contract
class Line:
    l_orderkey = field(r.is_int, r.is_positive)
    l_quantity = field(r.is_number(), r.min_value(5), r.max_value(45, exclusive=True), r.is_divisible_by(2))
    l_discount = field(r.is_number(max_decimal_places=2), r.max_value(0.08))
    l_returnflag = field(r.is_string, r.is_in(["A", "N"]), message="flag", context={"table": "lineitem"})
    l_shipdate = field(r.is_date, r.min_date(datetime(1994, 1, 1)), r.max_date(datetime(1997, 12, 31)))


engine.seal()
first_engine = Engine(stop_at_first_error=True)
first_engine.contract(Line)
first_engine.seal()


@register("""
SELECT code, path, count(*) AS n FROM (
  SELECT 'min' AS code, 'o_totalprice' AS path FROM orders WHERE o_totalprice < 50000
  UNION ALL SELECT 'max', 'o_totalprice' FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT 'isIn', 'o_orderpriority' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT 'matches', 'o_orderstatus' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
) GROUP BY ALL
""")
def contract_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.check(table(spark, sf_dir, "orders"), Order)
    return exploded(found, "o_orderkey").groupBy("code", "path").agg(F.count("*").alias("n"))


_LINE_ISSUES = """
WITH i AS (
  SELECT l_orderkey, l_linenumber, list_filter([
    CASE WHEN l_orderkey <= 0 THEN {'k': 0, 'path': 'l_orderkey', 'code': 'isPositive', 'constraints': '{"min":0,"exclusive":true}', 'message': NULL, 'context': NULL} END,
    CASE WHEN l_quantity < 5 THEN {'k': 1, 'path': 'l_quantity', 'code': 'min', 'constraints': '{"min":5}', 'message': NULL, 'context': NULL} END,
    CASE WHEN l_quantity >= 45 THEN {'k': 2, 'path': 'l_quantity', 'code': 'max', 'constraints': '{"max":45,"exclusive":true}', 'message': NULL, 'context': NULL} END,
    CASE WHEN l_quantity % 2 <> 0 THEN {'k': 3, 'path': 'l_quantity', 'code': 'isDivisibleBy', 'constraints': '{"divisor":2}', 'message': NULL, 'context': NULL} END,
    CASE WHEN l_discount > 0.08 THEN {'k': 4, 'path': 'l_discount', 'code': 'max', 'constraints': '{"max":0.08}', 'message': NULL, 'context': NULL} END,
    CASE WHEN l_returnflag NOT IN ('A', 'N') THEN {'k': 5, 'path': 'l_returnflag', 'code': 'isIn', 'constraints': '{"values":["A","N"]}', 'message': 'flag', 'context': '{"table":"lineitem"}'} END,
    CASE WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN {'k': 6, 'path': 'l_shipdate', 'code': 'minDate', 'constraints': '{"min":"1994-01-01T00:00:00.000Z"}', 'message': NULL, 'context': NULL} END,
    CASE WHEN l_shipdate > TIMESTAMP '1997-12-31' THEN {'k': 7, 'path': 'l_shipdate', 'code': 'maxDate', 'constraints': '{"max":"1997-12-31T00:00:00.000Z"}', 'message': NULL, 'context': NULL} END
  ], lambda x: x IS NOT NULL) AS s FROM lineitem
), n AS (
  SELECT l_orderkey, l_linenumber, position, s[position + 1].path AS path, s[position + 1].code AS code, s[position + 1].message AS message, s[position + 1].context AS context, s[position + 1].constraints AS constraints
  FROM (SELECT *, unnest(range(CAST(len(s) AS INT)))::INT AS position FROM i)
) SELECT * FROM n"""


@register(_LINE_ISSUES)
def issues_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(engine.check(table(spark, sf_dir, "lineitem"), Line), "l_orderkey", "l_linenumber")


@register(_LINE_ISSUES + " WHERE position = 0")
def issues_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(first_engine.check(table(spark, sf_dir, "lineitem"), Line), "l_orderkey", "l_linenumber")


@register("""
SELECT l_orderkey, l_linenumber, true AS is_int_key, l_extendedprice = round(l_extendedprice) AS is_int_price, round(l_extendedprice, 2) = l_extendedprice AS two_decimals,
       round(l_discount, 1) = l_discount AS one_decimal, l_discount >= 0.04 AS min_v, l_discount > 0.04 AS min_ex, l_tax <= 0.05 AS max_v, l_tax < 0.05 AS max_ex,
       l_discount > 0 AS positive, l_discount - l_tax < 0 AS negative, l_quantity % 3 = 0 AS divisible, true AS is_number
FROM lineitem
""")
def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flags = {
        "is_int_key": r.is_int(c("l_orderkey"), "bigint"), "is_int_price": r.is_int(c("l_extendedprice"), "double"), "two_decimals": r.is_number(max_decimal_places=2)(c("l_extendedprice"), "double"),
        "one_decimal": r.is_number(max_decimal_places=1)(c("l_discount"), "double"), "min_v": r.min_value(0.04)(c("l_discount"), "double"), "min_ex": r.min_value(0.04, True)(c("l_discount"), "double"),
        "max_v": r.max_value(0.05)(c("l_tax"), "double"), "max_ex": r.max_value(0.05, True)(c("l_tax"), "double"), "positive": r.is_positive(c("l_discount"), "double"),
        "negative": r.is_negative(c("l_discount") - c("l_tax"), "double"), "divisible": r.is_divisible_by(3)(c("l_quantity"), "double"), "is_number": r.is_number()(c("l_tax"), "double"),
    }
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(x.alias(n) for n, x in flags.items()))


class Status(enum.Enum):
    F = "F"
    O = "O"  # noqa: E741


@register("""
SELECT o_orderkey, s IN ('1-URGENT', '5-LOW') AS is_in, s IS NULL OR s NOT IN ('1-URGENT', '5-LOW') AS is_not_in, o_orderstatus IN ('F', 'O') AS is_enum, coalesce(s = '2-HIGH', false) AS equal,
       s IS NULL OR s <> '2-HIGH' AS unequal, coalesce(s, '') = '' AS empty, coalesce(s, '') <> '' AS filled, s IS NULL AS is_null_in, s IS NOT NULL AS text
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderpriority END AS s FROM orders)
""".replace("s IN ('1-URGENT', '5-LOW') AS is_in", "coalesce(s IN ('1-URGENT', '5-LOW'), false) AS is_in"))
def membership_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderpriority END")
    two = ["1-URGENT", "5-LOW"]
    flags = {"is_in": r.is_in(two)(s), "is_not_in": r.is_not_in(two)(s), "is_enum": r.is_enum(Status)(F.col("o_orderstatus")), "equal": r.equals("2-HIGH")(s), "unequal": r.not_equals("2-HIGH")(s), "empty": r.is_empty(s), "filled": r.is_not_empty(s), "is_null_in": r.is_in([None])(s), "text": r.is_string(s)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(x.alias(n) for n, x in flags.items()))


@register("""
SELECT doc_id, u >= 500 AS min_len, u <= 3000 AS max_len, u BETWEEN 500 AND 3000 AS len, strlen(text) >= 2000 AS byte_min, strlen(text) BETWEEN 100 AND 2000 AS byte_range,
       contains(text, 'the') AS has, NOT contains(text, 'the') AS has_not, lower(text) = text AS is_lower, upper(text) = text AS is_upper, regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii,
       regexp_matches(text, '[^\\x20-\\x7E\\x{FF61}-\\x{FF9F}]') AS full_w, regexp_matches(text, '[\\x20-\\x7E\\x{FF61}-\\x{FF9F}]') AS half_w,
       regexp_matches(text, '[^\\x20-\\x7E\\x{FF61}-\\x{FF9F}]') AND regexp_matches(text, '[\\x20-\\x7E\\x{FF61}-\\x{FF9F}]') AS variable_w,
       regexp_matches(text, '[^\\x00-\\xFF]') AS multibyte, regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]') AS surrogate, regexp_matches(text, 'li[ck]en[cs]e|[0-9]{3}') AS pattern
FROM (SELECT doc_id, text, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS u
      FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(128512) WHEN doc_id % 5 = 1 THEN chr(65440) ELSE '' END AS text FROM documents))
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit(chr(128512))).when(F.col("doc_id") % 5 == 1, F.lit(chr(65440))).otherwise(""))
    rules = {
        "min_len": r.min_length(500), "max_len": r.max_length(3000), "len": r.length(500, 3000), "byte_min": r.is_byte_length(2000), "byte_range": r.is_byte_length(100, 2000), "has": r.contains("the"), "has_not": r.not_contains("the"),
        "is_lower": r.is_lowercase, "is_upper": r.is_uppercase, "ascii": r.is_ascii, "full_w": r.is_full_width, "half_w": r.is_half_width, "variable_w": r.is_variable_width, "multibyte": r.is_multibyte,
        "surrogate": r.is_surrogate_pair, "pattern": r.matches("li[ck]en[cs]e|[0-9]{3}"),
    }
    return table(spark, sf_dir, "documents").select("doc_id", *(rule(t).alias(n) for n, rule in rules.items()))


# ---- one made text for each rule ----
# h is the key's md5, k the key, s the key modulo 4: 0 and 1 sound, 2 and 3 spoilt in different ways
def made(good: str, bad: str | None = None, worse: str | None = None) -> str:
    """SQL of a sound text, by default spoilt by a mark before it or by a line end behind it."""
    bad, worse = bad or f"'#' || {good}", worse or f"{good} || chr(10)"
    return f"CASE s WHEN 2 THEN {bad} WHEN 3 THEN {worse} ELSE {good} END"


_RX = lambda p: f"regexp_matches($x, '{p}')"
#: name: (rule, the text in SQL, the condition on the text $x in DuckDB)
FORMATS: dict[str, tuple[r.Rule, str, str]] = {
    "alpha": (r.is_alpha, made("translate(h, '0123456789', 'ghijklmnop')"), _RX("^[A-Za-z]+$")),
    "alphanumeric": (r.is_alphanumeric, made("h"), _RX("^[0-9A-Za-z]+$")),
    "http_token": (r.is_http_token, made("h || '!~*'", "h || '('"), _RX("^[-!#$%&''*+.^_`|~0-9A-Za-z]+$")),
    "boolean_string": (r.is_boolean_string, made("CASE WHEN k % 8 < 4 THEN 'true' ELSE '0' END", "'True'"), "$x IN ('true', 'false', '1', '0')"),
    "number_string": (r.is_number_string(), made("'-' || k || '.5'", "k || '.'", "'1e' || k"), _RX("^[+-]?([0-9]*[.])?[0-9]+$")),
    "number_string_plain": (r.is_number_string(no_symbols=True), made("'' || k", "'+' || k"), _RX("^[0-9]+$")),
    "decimal": (r.is_decimal(), made("'.' || k", "k || '.'"), _RX("^[-+]?([0-9]+([.][0-9]+)?|[.][0-9]+)$")),
    "hexadecimal": (r.is_hexadecimal, made("h", "h || 'g'"), _RX("^[0-9a-fA-F]+$")),
    "octal": (r.is_octal, made("'0o' || translate(k || '', '89', '01')", "'0x7'"), _RX("^(0[oO])?[0-7]+$")),
    "hex_color": (r.is_hex_color, made("'#' || substr(h, 1, 6)", "'#' || substr(h, 1, 5)"), _RX("^#([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")),
    "rgb": (r.is_rgb_color(), made("'rgb(' || k % 256 || ', 0,255)'", "'rgb(256,0,0)'"), "s < 2"),
    "rgba_percent": (r.is_rgb_color(True), made("'rgba(' || k % 101 || '%,0%,5%,.5)'", "'rgb(1%,2%,3%,.5)'"), "s < 2"),
    "hsl": (r.is_hsl, made("'hsl(' || k % 361 || ',50%,7%)'", "'hsl(1,2%,3%,1)'"), "s < 2"),
    "base32": (r.is_base32(), made("'MZXW6YQ='", "'MZXW6Y1='"), "$x = 'MZXW6YQ='"),
    "base58": (r.is_base58, made("replace(h, '0', 'z')", "h || '0'"), _RX("^[1-9A-HJ-NP-Za-km-z]+$")),
    "base64": (r.is_base64(), made("substr(h, 1, 4 * (k % 8 + 1))", "substr(h, 1, 5)"), "s < 2"),
    "base64_url": (r.is_base64(url_safe=True), made("substr(h, 1, 7) || '_'", "substr(h, 1, 5)"), "s < 2"),
    "email": (r.is_email(), made("'u' || k || '@mail' || k % 3 || '.example.com'", "'u' || k || '@-x.com'"), "s < 2"),
    "url": (r.is_url(), made("'https://x' || k || '.example.com:' || k % 65536 || '/a?b=c'", "'https://x.com?q=' || k"), "s < 2"),
    "uuid": (r.is_uuid("all"), made("substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)"), _RX("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
    "uuid4": (r.is_uuid(4), made("substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)"), _RX("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")),
    "ip4": (r.is_ip(4), made("'10.' || k % 300 || '.0.1'", "'10.01.0.1'"), "s < 2 AND k % 300 < 256"),
    "ip6": (r.is_ip(6), made("'2001:db8::' || substr(h, 1, 4)", "'2001:db8::1::2'"), "s < 2"),
    "ip": (r.is_ip(), made("CASE WHEN k % 8 < 4 THEN '::ffff:1.2.3.4' ELSE '1.2.3.4' END", "'1.2.3'"), "s < 2"),
    "mac": (r.is_mac_address(), made("substr(h,1,2) || ':' || substr(h,3,2) || ':' || substr(h,5,2) || ':' || substr(h,7,2) || ':' || substr(h,9,2) || ':' || substr(h,11,2)", "'00-11:22-33-44-55'"), "s < 2"),
    "mac_plain": (r.is_mac_address(no_separators=True), made("substr(h, 1, 12)", "'00:11:22:33:44:55'"), "s < 2"),
    "port": (r.is_port, made("'' || k * 37 % 70000", "'0' || k"), "s < 2 AND CAST($x AS INT) <= 65535"),
    "fqdn": (r.is_fqdn(), made("'a' || k || '.example.org'", "'a' || k || '-.example.org'"), "s < 2"),
    "fqdn_loose": (r.is_fqdn(require_tld=False, allow_underscores=True, allow_trailing_dot=True), made("'_a' || k || '.b.'", "'a..b'"), "s < 2"),
    "jwt": (r.is_jwt, made("h || '.' || h || '.x_-'", "h || '.' || h"), "s < 2"),
    "locale": (r.is_locale, made("CASE WHEN k % 8 < 4 THEN 'de-CH-1996' ELSE 'zh-Hant-TW' END", "'e-US'"), "s < 2"),
    "data_uri": (r.is_data_uri, made("'data:text/plain;charset=utf-8;base64,' || h", "'data:text,' || h", "'data:text/x,' || chr(10) || 'y'"), "s <> 2"),
    "mime": (r.is_mime_type, made("'application/vnd.x' || k || '+json; q=1'", "'app/json'"), "s < 2"),
    "magnet": (r.is_magnet_uri, made("'magnet:?xt=urn:btih:' || h || '&dn=a'", "'magnet:?xt=urn:btih:' || substr(h, 2)"), "s < 2"),
    "phone": (r.is_phone_number, made("'+1' || (5550000000 + k)", "'+0' || k"), "s < 2"),
    "origin": (r.is_origin, made("'https://a' || k || '.example.com'", "'https://a.com/'", "'http://a.com:80'"), "s < 2"),
    "cors_origin": (r.is_cors_origin, made("CASE WHEN k % 8 < 4 THEN '*' ELSE 'http://a.b:8080' END", "'**'"), "s < 2"),
    "json": (r.is_json, made("'{\"k\": [' || k || ', null]}'", "'{\"k\": ' || k", "'1 ' || k"), "json_valid($x)"),
    "password": (r.is_strong_password(), made("'Aa1!' || h", "'Aa1' || h", "'Aa!' || translate(h, '0123456789', 'abcdefghij')"), "s < 2"),
    "tax_us": (r.is_tax_id("US"), made("lpad('' || k % 100, 2, '0') || '-' || lpad('' || k, 7, '0')"), _RX("^[0-9]{2}-[0-9]{7}$")),
    "lat_long": (r.is_lat_long(), made("(k % 90) || '.5, -' || k % 180", "'91,0'"), "s < 2"),
    "latitude": (r.is_latitude, made("'-' || k % 120", "'+5'"), "s < 2 AND k % 120 <= 90"),
    "longitude": (r.is_longitude, made("k % 200 || '.25'", "'1e1'"), "s < 2 AND k % 200 < 180"),
    "ethereum": (r.is_ethereum_address, made("'0x' || h || substr(h, 1, 8)", "h || h"), "s < 2"),
    "btc": (r.is_btc_address, made("CASE WHEN k % 8 < 4 THEN 'bc1q' || h ELSE '1' || replace(h, '0', 'A') END", "'bc1Q' || h"), "s < 2"),
    "hash_md5": (r.is_hash("md5"), made("h", "substr(h, 2)"), "s < 2"),
    "hash_sha256": (r.is_hash("sha256"), made("upper(h || h)", "h"), "s < 2"),
    "rfc3339": (r.is_rfc3339, made("'2024-01-' || lpad('' || k % 60, 2, '0') || 't10:00:00.5z'", "'2024-01-01T10:00:00'"), "s < 2"),
    "military": (r.is_military_time, made("lpad('' || k % 30, 2, '0') || ':30'", "'9:30'"), "s < 2 AND k % 30 < 24"),
    "iso8601": (r.is_iso8601(), made("'2024-' || lpad('' || k % 20, 2, '0') || '-31T25:00:00+0100'", "'2024-1-1'"), "s < 2"),
    "iso8601_strict": (r.is_iso8601(strict=True), made("'2023-' || lpad('' || k % 14, 2, '0') || '-30T23:59:60Z'", "'2023-01-01T24:00:00Z'"), "s < 2 AND k % 14 BETWEEN 1 AND 12 AND k % 14 <> 2"),
    "isrc": (r.is_isrc, made("'US-S1Z-99-' || lpad('' || k % 100000, 5, '0')", "'us-S1Z-99-00001'"), "s < 2"),
    "alpha2": (r.is_iso31661_alpha2, made("CASE WHEN k % 8 < 4 THEN 'de' ELSE 'XX' END", "'DEU'"), "$x = 'de'"),
    "alpha3": (r.is_iso31661_alpha3, made("CASE WHEN k % 8 < 4 THEN 'fra' ELSE 'XYZ' END", "'FR'"), "$x = 'fra'"),
    "firebase": (r.is_firebase_push_id, made("substr(h, 1, 20)", "substr(h, 1, 19)"), "s < 2"),
    "sem_ver": (r.is_sem_ver, made("k || '.2.3-rc.1+b.' || k", "'01.2.3'"), "s < 2"),
    "mongo": (r.is_mongo_id, made("substr(h, 1, 24)", "substr(h, 1, 23)"), "s < 2"),
    "date_string": (r.is_date_string(), made("lpad('' || k % 10000, 4, '0') || '-02-29'", "'2024-02-30'"), "s < 2 AND k % 10000 % 4 = 0 AND (k % 10000 % 100 <> 0 OR k % 10000 % 400 = 0)"),
    "ulid": (r.is_ulid(), made("upper(substr(h, 1, 26))", "substr(h, 1, 26)"), "s < 2 OR s = 2 AND NOT regexp_matches(h[1:26], '[a-f]')"),
    "cuid2": (r.is_cuid2(), made("'c' || substr(h, 1, 25)", "'9' || substr(h, 1, 25)"), "s < 2"),
    "bic": (r.is_bic, made("'deutDEff' || CASE WHEN k % 8 < 4 THEN '500' ELSE '' END", "'DEUTDEFF5'"), "s < 2"),
    "currency": (r.is_currency(), made("'-$1,' || lpad('' || k % 1000, 3, '0') || '.5'", "'+-5'"), "s < 2"),
    "iso4217": (r.is_iso4217_currency_code, made("CASE WHEN k % 8 < 4 THEN 'EUR' ELSE 'eur' END", "'XXX'"), "$x = 'EUR'"),
    "phone_de": (r.is_mobile_phone("de-DE"), made("'+49151' || lpad('' || k % 100000000, 8, '0')", "'+4911'"), "s < 2"),
    "postal_gb": (r.is_postal_code("GB"), made("'sw1a 1aa'", "'SW1A1A'"), "s < 2"),
    "identity_es": (r.is_identity_card("ES"), made("lpad('' || k % 100000000, 8, '0') || 'Z'", "'1Z'"), "s < 2"),
    "passport_us": (r.is_passport_number("US"), made("lpad('' || k % 1000000000, 9, '0')", "'A12345678'"), "s < 2"),
}


def _format_query(names: list[str]) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "md5(cast(c_custkey AS string)) AS h", "c_custkey % 4 AS s")
        # the text first, so that it is made once whatever the rule asks of it
        texts = rows.select("k", *(F.expr(FORMATS[n][1]).alias(f"t_{n}") for n in names))
        return texts.select("k", *(FORMATS[n][0](F.col(f"t_{n}")).alias(n) for n in names))

    flags = ", ".join(f"({FORMATS[n][2].replace('$x', 't_' + n)}) AS {n}" for n in names)
    texts = ", ".join(f"{FORMATS[n][1]} AS t_{n}" for n in names)
    return query, f"SELECT k, {flags} FROM (SELECT k, h, s, {texts} FROM (SELECT c_custkey AS k, md5(CAST(c_custkey AS VARCHAR)) AS h, c_custkey % 4 AS s FROM customer))"


_GROUPS = {
    "character_rules": ["alpha", "alphanumeric", "http_token", "boolean_string", "number_string", "number_string_plain", "decimal"],
    "encoding_rules": ["hexadecimal", "octal", "hex_color", "rgb", "rgba_percent", "hsl", "base32", "base58", "base64", "base64_url"],
    "network_rules": ["email", "url", "uuid", "uuid4", "ip4", "ip6", "ip", "mac", "mac_plain", "port", "fqdn", "fqdn_loose", "origin", "cors_origin"],
    "format_rules": ["jwt", "locale", "data_uri", "mime", "magnet", "phone", "json", "password", "tax_us"],
    "place_and_coin_rules": ["lat_long", "latitude", "longitude", "ethereum", "btc", "hash_md5", "hash_sha256", "rfc3339", "military"],
    "identifier_rules": ["iso8601", "iso8601_strict", "isrc", "alpha2", "alpha3", "firebase", "sem_ver", "mongo", "date_string", "ulid", "cuid2"],
    "money_and_locale_rules": ["bic", "currency", "iso4217", "phone_de", "postal_gb", "identity_es", "passport_us"],
}
for _name, _members in _GROUPS.items():
    QUERIES[_name], ORACLES[_name] = _format_query(_members)
    QUERIES[_name].__name__ = _name


_NUMBER = r"^{head}\(\s*([0-9]+)\s*,\s*([0-9]+){unit}\s*,\s*([0-9]+){unit}\s*\)$"


def _three_numbers(head: str, unit: str, most: tuple[int, int, int]) -> str:
    """SQL: three numbers in brackets, without leading zeros, none above its bound."""
    parts = [f"regexp_extract($x, '{_NUMBER.format(head=head, unit=unit)}', {k})" for k in (1, 2, 3)]
    return " AND ".join(f"coalesce(TRY_CAST({x} AS BIGINT) <= {n}, false) AND ({x} = '0' OR NOT starts_with({x}, '0'))" for x, n in zip(parts, most, strict=True))


def _whole(pattern: str) -> str:
    return f"regexp_full_match($x, '{pattern}')"


#: What formats are, for DuckDB; the texts are those of FORMATS with one character more, less or another in four of five rows.
_DEFINED = {
    "rgb": _three_numbers("rgb", "", (255, 255, 255)), "hsl": _three_numbers("hsl", "%", (360, 100, 100)), "base64": "length($x) % 4 = 0 AND " + _whole("[A-Za-z0-9+/]+"),
    "mac": _whole("([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|([0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}"), "mac_plain": "length($x) = 12 AND " + _whole("[0-9A-Fa-f]*"),
    "jwt": "len(string_split($x, '.')) = 3 AND len(list_filter(string_split($x, '.'), lambda w: NOT regexp_full_match(w, '[A-Za-z0-9_-]+'))) = 0",
    "locale": _whole("[a-zA-Z]{2,3}(-[a-zA-Z]{4})?(-([a-zA-Z]{2}|[0-9]{3}))?(-([a-zA-Z0-9]{5,8}|[0-9][a-zA-Z0-9]{3}))*"), "magnet": _whole(r"(?i)magnet:\?xt=urn:[a-z0-9]+:[a-z0-9]{32,40}(&[a-z][a-z0-9.]*=[^&\s]*)*"),
    "phone": "starts_with($x, '+') AND length($x) BETWEEN 8 AND 16 AND " + _whole(r"\+[1-9][0-9]*"), "ethereum": "length($x) = 42 AND " + _whole("0x[0-9A-Fa-f]*"),
    "btc": _whole("[13][1-9A-HJ-NP-Za-km-z]{25,34}|(bc|tb)1[a-z0-9]{6,87}|(BC|TB)1[A-Z0-9]{6,87}"), "hash_md5": "length($x) = 32 AND " + _whole("[0-9A-Fa-f]*"), "hash_sha256": "length($x) = 64 AND " + _whole("[0-9A-Fa-f]*"),
    "rfc3339": _whole(r"(?i)\d{4}-\d\d-\d\d[t ]\d\d:\d\d:\d\d(\.\d+)?(z|[+-]\d\d:\d\d)"), "isrc": _whole(r"[A-Z]{2}-[A-Z0-9]{3}-\d{2}-\d{5}|[A-Z]{2}[A-Z0-9]{3}\d{7}"), "firebase": "length($x) = 20 AND " + _whole("[A-Za-z0-9_-]*"),
    "sem_ver": _whole(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-(0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(\.(0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*)?(\+[0-9a-zA-Z-]+(\.[0-9a-zA-Z-]+)*)?"),
    "mongo": "length($x) = 24 AND " + _whole("[0-9A-Fa-f]*"), "cuid2": "length($x) BETWEEN 24 AND 32 AND " + _whole("[a-z][a-z0-9]*"), "bic": "length($x) IN (8, 11) AND " + _whole("[A-Za-z]{6}[A-Za-z0-9]*"),
    "currency": _whole(r"([-+]?\$?|\$[-+]?)(\d{1,3}(,\d{3})+|\d+)(\.\d{1,2})?"), "mime": _whole(r"(application|audio|font|image|message|model|multipart|text|video)/[a-zA-Z0-9][a-zA-Z0-9!#$&^_.+-]*(;.+)?"),
    "password": "length($x) >= 8 AND regexp_matches($x, '[a-z]') AND regexp_matches($x, '[A-Z]') AND regexp_matches($x, '[0-9]') AND regexp_matches($x, '[^0-9A-Za-z]')",
    "fqdn": "len(string_split($x, '.')) > 1 AND len(list_filter(string_split($x, '.'), lambda w: length(w) > 63 OR NOT regexp_full_match(w, '[a-zA-Z0-9-]+') OR starts_with(w, '-') OR ends_with(w, '-'))) = 0 AND regexp_full_match(string_split($x, '.')[-1], '[a-zA-Z]{2,}')",
}


def _changed(text: str) -> str:
    at = f"((k * 31) % length({text}) + 1)"
    head, tail, after = f"substr({text}, 1, CAST({at} - 1 AS INT))", f"substr({text}, CAST({at} AS INT))", f"substr({text}, CAST({at} + 1 AS INT))"
    return f"CASE k % 5 WHEN 1 THEN {head} || {after} WHEN 2 THEN {head} || substr({tail}, 1, 1) || {tail} WHEN 3 THEN {head} || '0' || {after} WHEN 4 THEN {head} || '-' || {tail} ELSE {text} END"


def _changed_formats(names: list[str]) -> tuple[Query, str]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "md5(cast(c_custkey AS string)) AS h", "c_custkey % 4 AS s").select("k", *(F.expr(FORMATS[n][1]).alias(f"t_{n}") for n in names))
        rows = rows.select("k", *(F.expr(_changed(f"t_{n}")).alias(f"t_{n}") for n in names))
        return rows.select("k", *(FORMATS[n][0](F.col(f"t_{n}")).alias(n) for n in names))

    flags, texts = ", ".join(f"({_DEFINED[n].replace('$x', 't_' + n)}) AS {n}" for n in names), ", ".join(f"{FORMATS[n][1]} AS t_{n}" for n in names)
    changed = ", ".join(f"{_changed('t_' + n)} AS t_{n}" for n in names)
    return query, f"SELECT k, {flags} FROM (SELECT k, {changed} FROM (SELECT k, {texts} FROM (SELECT c_custkey AS k, md5(CAST(c_custkey AS VARCHAR)) AS h, c_custkey % 4 AS s FROM customer)))"


for _k, _members in enumerate(([*_DEFINED][:8], [*_DEFINED][8:16], [*_DEFINED][16:]), 1):
    QUERIES[f"changed_formats_{_k}"], ORACLES[f"changed_formats_{_k}"] = _changed_formats(_members)


#: Shapes of the texts that the tables by country judge: d is a digit and l a letter of the row, the rest stands for itself.
_SHAPES = (
    *("d" * n for n in range(3, 19)), *("l" * a + "d" * b for a in (1, 2, 3) for b in range(5, 10)), *("d" * n + "l" for n in (6, 7, 8, 9)), "dddddddll", "ddddddddll", "lddddddddl", "llddddddl", "ldddddddl", "ddddddddX", "ddddddddd",
    "ddd dd", "dd ddd", "ddddd-ddd", "dd-ddd", "dddd-ddd", "dddd ll", "ldl dld", "ld dll", "llldddd", "ADddd", "Addddddd", "Adddddddd", "lddddddX", "Addddddddl", "ddd-dd-ddddd", "LT-ddddd", "LV-dddd", "AZEdddddddd", "009dd", "009dd-dddd", "948d", "949d", "ddddddA", "ddd-dddd", "ddddd-dddd",
    "dddddd-ddddddd", "dddddd-ddddd", "ddd-dd-dddd", "dd-ddddddd", "756dddddddddd", "dddddd+dddl", "dddddd-dddd", "llllllddlddldddl", "llllddddddHllllldd", "llllddddddMllBCddd", "lllllddddl", "LITOUAEVB", "PLddddddd", "Gdddddddd", "Edddddddd", "Cdddddddd",
    "+8210dddddddd", "+1234ddddddd", "+8613ddddddddd", "+8869dddddddd", "+8190dddddddd", "+4915ddddddddd", "+336dddddddd", "+4475dddddddd", "+79ddddddddd", "+55119dddddddd", "+919ddddddddd", "+9665dddddddd", "+2010dddddddd", "+849dddddddd", "+668dddddddd",
    "+628dddddddddd", "+601ddddddddd", "+316dddddddd", "+393ddddddddd", "+346dddddddd", "+485dddddddd",
)


def _shaped(shape: str, digits: str, letters: str) -> str:
    """SQL for a text of the shape; digits and letters are columns."""
    parts, at = [], {"d": 1, "l": 1}
    for kind, run in groupby(shape, lambda c: c if c in "dl" else ""):
        n = len(list(run)) if kind else 0
        if kind:
            parts.append(f"substr({digits if kind == 'd' else letters}, {at[kind]}, {n})")
            at[kind] += n
        else:
            parts.append(None)
    literals = iter([x for x in re.split("[dl]+", shape) if x])
    return " || ".join(x if x else f"'{next(literals)}'" for x in parts)


_ROW = "'' || (c_custkey * 7919 + 1234567) % 900000007 || (c_custkey * 104729) % 1000003 || '4815162342'", "translate(md5(CAST(c_custkey AS {text})), '0123456789abcdef', 'BCEGHJKLMNPRSTVX')"
_SHAPED = f"CASE c_custkey % {len(_SHAPES)} " + " ".join(f"WHEN {k} THEN {_shaped(x, 'digits', 'letters')}" for k, x in enumerate(_SHAPES)) + " END"


def _country_query(name: str, patterns: dict[str, str], rule: Callable) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ROW[0]} AS digits", f"{_ROW[1].format(text='string')} AS letters").select("c_custkey", F.expr(_SHAPED).alias("t"))
        return rows.select("c_custkey", F.concat_ws(",", *(F.when(rule(x)(F.col("t")), F.lit(x)) for x in patterns)).alias("countries"))

    query.__name__ = name
    cases = ", ".join(f"CASE WHEN regexp_matches(t, '{p.replace('(?iu)', '(?i)')}') THEN '{x}' END" for x, p in patterns.items())
    register(f"SELECT c_custkey, concat_ws(',', {cases}) AS countries FROM (SELECT c_custkey, {_SHAPED} AS t FROM (SELECT c_custkey, {_ROW[0]} AS digits, {_ROW[1].format(text='VARCHAR')} AS letters FROM customer))")(query)


for _name, _patterns, _rule in (
    ("mobile_phones", locale_rules.MOBILE_PHONES, r.is_mobile_phone), ("postal_codes", locale_rules.POSTAL_CODES, r.is_postal_code), ("identity_cards", locale_rules.IDENTITY_CARDS, r.is_identity_card),
    ("passports", locale_rules.PASSPORTS, r.is_passport_number), ("tax_ids", format_rules.TAX_IDS, r.is_tax_id),
):
    _country_query(_name, _patterns, _rule)


def _luhn(x: str) -> str:
    return f"list_sum([CASE WHEN i % 2 = 0 THEN (CAST(reverse({x})[i] AS INT) * 2) // 10 + (CAST(reverse({x})[i] AS INT) * 2) % 10 ELSE CAST(reverse({x})[i] AS INT) END FOR i IN range(1, length({x}) + 1)]) % 10 = 0"


def _weighted(x: str, weights: str, n: int) -> str:
    return f"list_sum([CASE WHEN {x}[i] = 'X' THEN 10 ELSE CAST({x}[i] AS INT) END * ({weights}) FOR i IN range(1, {n + 1})])"


@register(f"""
WITH t AS (
  SELECT c_custkey AS k, lpad(CAST(c_custkey * 7919 AS VARCHAR), 16, '4') AS card, lpad(CAST(c_custkey * 31 % 100000000 AS VARCHAR), 8, '0') AS ean8, lpad(CAST(c_custkey * 104729 AS VARCHAR), 13, '978') AS ean13,
         lpad(CAST(c_custkey * 977 AS VARCHAR), 9, '0') || CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '5' END AS isbn10, lpad(CAST(c_custkey * 53 % 10000000 AS VARCHAR), 7, '0') || CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '1' END AS issn8,
         'US' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || CAST(c_custkey % 10 AS VARCHAR) AS isin, 'GB' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') || 'WEST' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS iban
  FROM customer
), e AS (
  SELECT *, list_aggregate([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END FOR c IN string_split(isin, '')], 'string_agg', '') AS isin_digits,
         list_aggregate([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END FOR c IN string_split(iban[5:] || iban[:4], '')], 'string_agg', '') AS iban_digits
  FROM t
)
SELECT k, {_luhn('card')} AS card, {_weighted('ean8', 'CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END', 8)} % 10 = 0 AS ean8, {_weighted('ean13', 'CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END', 13)} % 10 = 0 AS isbn13,
       {_weighted('isbn10', '11 - i', 10)} % 11 = 0 AS isbn10, ({_weighted('isbn10', '11 - i', 10)} % 11 = 0) AS isbn, {_weighted('issn8', '9 - i', 8)} % 11 = 0 AS issn, {_luhn('isin_digits')} AS isin,
       CAST(iban_digits AS HUGEINT) % 97 = 1 AS iban, CAST(iban_digits AS HUGEINT) % 97 = 1 AS iban_spaced
FROM e
""")
def checksum_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts have names of their own: inside a lambda, Spark takes a name for a column of the same select first
    k = "cast(k AS string)"
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr(
        "k", "lpad(cast(k * 7919 AS string), 16, '4') AS t_card", "lpad(cast(k * 31 % 100000000 AS string), 8, '0') AS t_ean8", "lpad(cast(k * 104729 AS string), 13, '978') AS t_ean13",
        "lpad(cast(k * 977 AS string), 9, '0') || CASE WHEN k % 3 = 0 THEN 'X' ELSE '5' END AS t_isbn10", "lpad(cast(k * 53 % 10000000 AS string), 7, '0') || CASE WHEN k % 3 = 0 THEN 'X' ELSE '1' END AS t_issn8",
        f"'US' || lpad({k}, 9, '0') || cast(k % 10 AS string) AS t_isin", f"'GB' || lpad(cast(k % 97 + 2 AS string), 2, '0') || 'WEST' || lpad({k}, 14, '0') AS t_iban",
    )
    flags = {
        "card": r.is_credit_card(F.concat(F.substring("t_card", 1, 4), F.lit("- "), F.substring("t_card", 5, 20))), "ean8": r.is_ean(F.col("t_ean8")), "isbn13": r.is_isbn(13)(F.concat(F.lit("-"), "t_ean13")), "isbn10": r.is_isbn(10)(F.col("t_isbn10")),
        "isbn": r.is_isbn()(F.col("t_isbn10")), "issn": r.is_issn()(F.concat(F.substring("t_issn8", 1, 4), F.lit("-"), F.substring("t_issn8", 5, 4))), "isin": r.is_isin(F.col("t_isin")), "iban": r.is_iban()(F.lower("t_iban")),
        "iban_spaced": r.is_iban(allow_spaces=True)(F.concat(F.substring("t_iban", 1, 4), F.lit(" "), F.substring("t_iban", 5, 30))),
    }
    return t.select("k", *(x.alias(n) for n, x in flags.items()))


@register("""
SELECT event_id, json_valid(props) AS is_json, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 AS big FROM events
""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Engine()

    @own.contract
    class Props:
        k = field(r.is_number(), r.min_value(50))

    own.seal()
    found = own.check(table(spark, sf_dir, "events"), Props, document="props")
    return found.select("event_id", r.is_json(F.col("props")).alias("is_json"), F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"), F.col("is_valid").alias("big"))


@register("""
SELECT vec_id, len(e) >= 3 AS min_size, len(e) <= 3 AS max_size, len(e) > 0 AS not_empty, len(list_distinct(e)) = len(e) AS uniq, list_contains(e, 5) AND list_contains(e, -5) AS has, NOT list_contains(e, -6) AND NOT list_contains(e, 6) AS has_not,
       len(list_filter(e, lambda x: x < 0)) = 0 AS every, len(e) >= 0 AS is_array, len(e) = 0 OR len(e) >= 3 AS either
FROM (SELECT vec_id, list_filter(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 20)), lambda x: abs(x) >= 5) AS e FROM embeddings)
""")
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the outlying elements of the whole embeddings, which are few or many."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint(x.cast("double") * 20)).alias("e"))
    e = e.withColumn("e", F.filter("e", lambda x: F.abs(x) >= 5))
    rules = {
        "min_size": r.array_min_size(3), "max_size": r.array_max_size(3), "not_empty": r.array_not_empty, "uniq": r.array_unique(), "has": r.array_contains([5, -5]), "has_not": r.array_not_contains([-6, 6]),
        "every": r.array_every(r.is_number(), r.min_value(0)), "is_array": r.is_array, "either": r.one_of(r.array_max_size(0), r.array_min_size(3)),
    }
    return e.select("vec_id", *(rule(F.col("e"), "array<double>").alias(n) for n, rule in rules.items()))


_TEXTS = """CASE event_id % 7 WHEN 1 THEN props || ' garbage' WHEN 2 THEN props || props WHEN 3 THEN '  ' || props || ' ' WHEN 4 THEN props || ','
 WHEN 5 THEN '[' || props || ']' WHEN 6 THEN props || ',"a":1' ELSE props END"""


class Props:
    k = field(r.is_number(), r.min_value(50))


strict = Engine()
strict.contract(Props)
strict.seal()


@register(f"""
SELECT event_id, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN CASE WHEN CAST(json_extract(CASE WHEN json_valid(t) THEN t END, '$.k') AS DOUBLE) >= 50 THEN '' ELSE 'k:min' END ELSE ':invalidInput' END AS codes
FROM (SELECT event_id, {_TEXTS} AS t FROM events)
""")
def strict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with something before or behind them: white space is fine, all else makes them no JSON."""
    found = strict.check(table(spark, sf_dir, "events").select("event_id", F.expr(_TEXTS).alias("doc")), Props, document="doc")
    return found.select("event_id", F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",").alias("codes"))


def _below(name: str, value: Column, constraints: dict) -> Column:
    return F.concat(F.lit(f"{name} of "), value.cast("string"), F.lit(f" is below {constraints.get('min')}"))


class Returned:
    l_quantity = field(r.is_number(), r.min_value(10), when=lambda o: o.child("l_returnflag").get("string") == "R", message=_below)
    # no rule asserts the kind: all of them report
    l_linenumber = field(r.min_value(3), r.is_divisible_by(2))


conditional = Engine()
conditional.contract(Returned)
conditional.seal()


@register("""
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 'min:l_quantity of ' || CAST(l_quantity AS VARCHAR) || ' is below 10' END,
       CASE WHEN l_linenumber < 3 THEN 'min:' END, CASE WHEN l_linenumber % 2 <> 0 THEN 'isDivisibleBy:' END) AS codes FROM lineitem
""")
def conditional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conditional.check(table(spark, sf_dir, "lineitem"), Returned)
    return out.select("l_orderkey", "l_linenumber", F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), F.coalesce(i["message"], F.lit("")))), ",").alias("codes"))


class Dated:
    a = field(r.is_date, transform=r.luxon(format="dd.MM.yyyy HH:mm"))
    b = field(r.is_date, transform=r.moment(format="YYYY/MM/DD"))
    c = field(r.is_date, transform=r.luxon())
    d = field(r.is_string, transform=r.codec(decode=lambda v: v.with_kinds(string=F.reverse(v.get("string")))))


dated = Engine()
dated.contract(Dated)
dated.seal()


@register("""
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS a, strftime(o_orderdate, '%Y/%m/%d') AS b, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS c, reverse(o_orderpriority) AS d FROM orders
""")
def date_library_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts through the two date libraries' codecs and out in a format; a codec of one's own that turns texts around."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("a"), text.alias("b"), text.alias("c"), F.col("o_orderpriority").alias("d"))
    return dated.encode(dated.decode(rows, Dated), Dated, column="value").select("o_orderkey", "record.*")


# ---- presence, conversion, projection ----
class Plain:
    v = field(r.is_string, r.min_length(6))


class Optional_:
    v = field(r.is_string, r.min_length(6), optional=True)


class Nullable:
    v = field(r.is_string, r.min_length(6), nullable=True)


class Both:
    v = field(r.is_string, r.min_length(6), optional=True, nullable=True)


presence = Engine()
for _c in (Plain, Optional_, Nullable, Both):
    presence.contract(_c)
presence.seal()

_DOC = "CASE o_orderkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{\"v\": null}' WHEN 2 THEN '{\"v\": 5}' ELSE '{\"v\": \"' || o_orderpriority || '\"}' END"


@register("""
SELECT o_orderkey, CASE WHEN m < 2 THEN 'isDefined' WHEN m = 2 THEN 'isString' WHEN short THEN 'minLength' ELSE '' END AS plain, CASE WHEN m < 2 THEN '' WHEN m = 2 THEN 'isString' WHEN short THEN 'minLength' ELSE '' END AS optional,
       CASE WHEN m = 0 THEN 'isDefined' WHEN m = 1 THEN '' WHEN m = 2 THEN 'isString' WHEN short THEN 'minLength' ELSE '' END AS nullable, CASE WHEN m < 2 THEN '' WHEN m = 2 THEN 'isString' WHEN short THEN 'minLength' ELSE '' END AS either
FROM (SELECT o_orderkey, o_orderkey % 4 AS m, length(o_orderpriority) < 6 AS short FROM orders)
""")
def presence_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DOC).alias("doc"))
    codes = {}
    for name, cls in (("plain", Plain), ("optional", Optional_), ("nullable", Nullable), ("either", Both)):
        _, found = presence.columns(cls, df.schema, document="doc")
        codes[name] = F.array_join(F.transform(found, lambda i: i["code"]), ",")
    return df.select("o_orderkey", *(c.alias(n) for n, c in codes.items()))


class Loose:
    n = field(r.is_number(), r.min_value(10))
    b = field(r.is_boolean)
    d = field(r.is_date)
    s = field(r.is_string)


converting = Engine(auto_convert=True)
converting.contract(Loose)
converting.seal()


@register("""
SELECT event_id, CASE WHEN m = 0 THEN 'conversionFailed@n' WHEN m = 1 THEN 'conversionFailed@b' WHEN m = 2 THEN 'conversionFailed@d' WHEN event_id % 40 < 10 THEN 'min@n' ELSE '' END AS codes,
       CASE WHEN m > 2 AND event_id % 40 >= 10 THEN CAST(event_id % 40 AS DOUBLE) END AS n, CASE WHEN m > 2 AND event_id % 40 >= 10 THEN event_id % 2 = 0 END AS b,
       CASE WHEN m > 2 AND event_id % 40 >= 10 THEN DATE_TRUNC('day', ts) END AS d, CASE WHEN m > 2 AND event_id % 40 >= 10 THEN CAST(user_id AS VARCHAR) END AS s
FROM (SELECT *, CASE WHEN event_id % 40 < 3 AND event_id % 40 <> 1 AND event_id % 40 <> 2 THEN 0 ELSE event_id % 11 END AS m0, CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS m FROM events)
""".replace(", CASE WHEN event_id % 40 < 3 AND event_id % 40 <> 1 AND event_id % 40 <> 2 THEN 0 ELSE event_id % 11 END AS m0", "")
    .replace("WHEN m = 1 THEN 'conversionFailed@b'", "WHEN m = 1 THEN CASE WHEN event_id % 40 < 10 THEN 'min@n,' ELSE '' END || 'conversionFailed@b'")
    .replace("WHEN m = 2 THEN 'conversionFailed@d'", "WHEN m = 2 THEN CASE WHEN event_id % 40 < 10 THEN 'min@n,' ELSE '' END || 'conversionFailed@d'"))
def conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 11 = 0 THEN 'x1' ELSE ' ' || event_id % 40 || ' ' END").alias("n"), F.expr("CASE WHEN event_id % 11 = 1 THEN 'yes' WHEN event_id % 2 = 0 THEN 'true' ELSE '0' END").alias("b"),
        F.expr("CASE WHEN event_id % 11 = 2 THEN 'now' ELSE date_format(ts, 'yyyy-MM-dd') END").alias("d"), F.col("user_id").alias("s"),
    )
    out = converting.decode(df, Loose)
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit("@"), i["path"])), ",")
    return out.select("event_id", codes.alias("codes"), *(F.col(f"value.{c}").alias(c) for c in "nbds"))


class Shown:
    id = field(r.is_int, name="o_orderkey")  # noqa: A003
    status = field(r.is_string, decode_name="o_orderstatus", encode_name="state")
    price = field(r.is_number(), name="o_totalprice", groups=["money"]) & field(r.min_value(100_000), groups=["audit"], decode_name="o_totalprice", encode_name="audited")
    secret = field(r.is_string, name="o_orderpriority", exclude="encode")
    when = field(r.is_date, r.min_date(datetime(1996, 1, 1)), name="o_orderdate", when=lambda o: o.child("o_orderstatus").get("string") == "F")


showing = Engine()
showing.contract(Shown)
showing.seal()


@register("""
SELECT o_orderkey, n_none, n_audit, price, state, audited FROM (
  SELECT o_orderkey, CASE WHEN late THEN 1 ELSE 0 END AS n_none, CASE WHEN late THEN 1 ELSE 0 END + CASE WHEN o_totalprice < 100000 THEN 1 ELSE 0 END AS n_audit,
         CASE WHEN NOT late AND o_totalprice >= 100000 THEN o_totalprice END AS price, o_orderstatus AS state, o_totalprice AS audited
  FROM (SELECT *, o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' AS late FROM orders))
""")
def groups_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    _, plain = showing.columns(Shown, df.schema)
    value, audit = showing.columns(Shown, df.schema, groups=["audit"])
    named = df.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), plain.alias("plain"), audit.alias("audit"), value.alias("value"))
    out = showing.encode(named, Shown, groups=["audit"])
    return out.select("o_orderkey", F.size("plain").alias("n_none"), F.size("audit").alias("n_audit"), F.when(F.size("audit") == 0, F.col("value.price")).alias("price"), F.col("record.state").alias("state"), F.col("record.audited").alias("audited"))


class Coded:
    name = field(r.is_string, r.is_lowercase, transform=[r.trim, r.to_lower_case])
    loud = field(r.is_string, transform=r.to_upper_case)
    price = field(r.is_number(), transform=r.round_to(1))
    at = field(r.is_date, transform=r.unix_seconds)
    at_ms = field(r.is_date, transform=r.unix_millis)
    day = field(r.is_date, transform=r.iso_string)
    parts = field(r.array_min_size(2), transform=r.csv(" "))
    doc = field(r.is_object, transform=r.json)


coding = Engine()
coding.contract(Coded)
coding.seal()


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "'  ' || upper(p_name) || chr(160) AS name", "p_name AS loud", "p_retailprice AS price", "p_partkey * 86401 AS at", "p_partkey * 1234567 AS at_ms",
        "CASE WHEN p_partkey % 5 = 0 THEN 'soon' ELSE '2024-02-' || lpad(cast(p_partkey % 28 + 1 AS string), 2, '0') END AS day", "p_name AS parts", "CASE WHEN p_partkey % 7 = 0 THEN '{' ELSE '{\"a\": ' || p_partkey || '}' END AS doc",
    )


_CODES = "CASE WHEN p_partkey % 5 = 0 THEN 'isDate' ELSE '' END || CASE WHEN p_partkey % 5 = 0 AND p_partkey % 7 = 0 THEN ',' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'isObject' ELSE '' END"
_CODED_SQL = f"""
SELECT p_partkey, codes, CASE WHEN codes = '' THEN lower(p_name) END AS name, CASE WHEN codes = '' THEN upper(p_name) END AS loud, CASE WHEN codes = '' THEN floor(p_retailprice * 10 + 0.5) / 10 END AS price,
       CASE WHEN codes = '' THEN make_timestamp(p_partkey * 86401 * 1000000) END AS at, CASE WHEN codes = '' THEN make_timestamp(p_partkey * 1234567 * 1000) END AS at_ms,
       CASE WHEN codes = '' THEN make_timestamp(2024, 2, p_partkey % 28 + 1, 0, 0, 0) END AS day, CASE WHEN codes = '' THEN len(string_split(p_name, ' ')) END AS parts
FROM (SELECT *, {_CODES} || CASE WHEN NOT contains(p_name, ' ') THEN 'arrayMinSize' ELSE '' END AS codes FROM part)
"""


@register(_CODED_SQL)
def codecs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coding.decode(_coded(spark, sf_dir), Coded)
    v = lambda c: F.col(f"value.{c}").alias(c)
    return out.select("p_partkey", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), v("name"), v("loud"), v("price"), v("at"), v("at_ms"), v("day"), F.when(F.col("value").isNotNull(), F.size("value.parts")).alias("parts"))


@register("""
SELECT p_partkey, lower(p_name) AS name, upper(p_name) AS loud, floor(p_retailprice * 10 + 0.5) / 10 AS price, CAST(p_partkey * 86401 AS DOUBLE) AS at, CAST(p_partkey * 1234567 AS DOUBLE) AS at_ms,
       '2024-02-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00.000Z' AS day, p_name AS parts, '{"a":' || p_partkey || '}' AS doc
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND contains(p_name, ' ')
""")
def codecs_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = coding.decode(_coded(spark, sf_dir), Coded).where(F.size("issues") == 0)
    return coding.encode(good, Coded, column="value").select("p_partkey", "record.*")


# ---- nested records ----
class Item:
    line = field(r.is_int)
    quantity = field(r.is_number(), r.max_value(40))
    flag = field(r.is_string, r.is_in(["A", "N"]))


class Priority:
    label = field(r.is_string, r.not_contains("LOW"))


class Cart:
    key = field(r.is_int)
    priority = field(type=Priority)
    items = field(r.array_min_size(2), type=[Item])
    flags = field(array_of(r.is_string, r.is_not_in(["R"])), type=set)
    by_line = field(type=dict, map_value=Item)


nesting = Engine()
nesting.contract(Cart)
nesting.seal()


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")).alias("item"))
    items = lines.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderpriority").alias("label")).alias("priority"))
    df = orders.join(items, "key")
    return df.withColumn("flags", F.transform("items", lambda i: i["flag"])).withColumn("by_line", F.map_from_entries(F.transform("items", lambda i, n: F.struct(F.concat(F.lit("l"), n.cast("string")), i))))


@register("""
WITH o AS (SELECT o_orderkey AS key, o_orderpriority AS label FROM orders), l AS (
  SELECT l_orderkey AS key, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS INT) AS i FROM lineitem
), s AS (
  SELECT key, 'priority.label' AS path, 'notContains' AS code FROM o WHERE contains(label, 'LOW') AND key IN (SELECT key FROM l)
  UNION ALL SELECT key, 'items', 'arrayMinSize' FROM l GROUP BY key HAVING count(*) < 2
  UNION ALL SELECT key, 'items[' || i || '].quantity', 'max' FROM l WHERE quantity > 40
  UNION ALL SELECT key, 'items[' || i || '].flag', 'isIn' FROM l WHERE flag NOT IN ('A', 'N')
  UNION ALL SELECT key, 'flags[' || i || ']', 'isNotIn' FROM l WHERE flag = 'R'
  UNION ALL SELECT key, 'by_line[l' || i || '].quantity', 'max' FROM l WHERE quantity > 40
  UNION ALL SELECT key, 'by_line[l' || i || '].flag', 'isIn' FROM l WHERE flag NOT IN ('A', 'N')
) SELECT key, path, code FROM s WHERE key IN (SELECT key FROM o)
""")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(nesting.check(carts(spark, sf_dir), Cart), "key").select("key", "path", "code")


class Card:
    digits = field(r.is_string, r.length(4, 4), decode_name="digits", encode_name="number")


class Transfer:
    iban = field(r.is_string)
    fee = field(r.is_number(), optional=True)


class Payment:
    key = field(r.is_int)
    pay = field(discriminator=union("kind", card=Card, transfer=Transfer), keep_discriminator_property=True)
    log = field(type=[object], discriminator=union("kind", card=Card, transfer=Transfer))


paying = Engine(forbid_unknown=True)
paying.contract(Payment)
paying.seal()

_CARD = "'{\"kind\": \"card\", \"digits\": \"' || k % 20000 || '\"}'"
_TRANSFER = "'{\"kind\": \"transfer\", \"iban\": \"X' || k || '\"' || CASE WHEN k % 5 = 0 THEN ', \"note\": 1' ELSE '' END || '}'"
_PAY = f"CASE k % 3 WHEN 0 THEN {_CARD} WHEN 1 THEN {_TRANSFER} ELSE '{{\"kind\": \"cash\"}}' END"


@register("""
WITH o AS (SELECT o_orderkey AS k, length(CAST(o_orderkey % 20000 AS VARCHAR)) <> 4 AS short, o_orderkey % 5 = 0 AS extra FROM orders),
p AS (SELECT k, CASE k % 3 WHEN 0 THEN CASE WHEN short THEN 'pay.digits:length' END WHEN 1 THEN CASE WHEN extra THEN 'pay.note:whitelistViolation' END ELSE 'pay:invalidDiscriminator' END AS a,
             CASE WHEN short THEN 'log[0].digits:length' END AS b, CASE WHEN extra THEN 'log[1].note:whitelistViolation' END AS c FROM o)
SELECT k, concat_ws(',', a, b, c) AS codes, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN CASE k % 3 WHEN 0 THEN '{"kind":"card","number":"' || k % 20000 || '"}' ELSE '{"iban":"X' || k || '","kind":"transfer"}' END END AS paid FROM p
""")
def tagged_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = f"'{{\"key\": ' || k || ', \"pay\": ' || {_PAY} || ', \"log\": [' || {_CARD} || ', ' || {_TRANSFER} || ']}}'"
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").select("k", F.expr(doc).alias("doc"))
    out = paying.encode(paying.decode(df, Payment, document="doc"), Payment, column="value")
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",")
    return out.select("k", codes.alias("codes"), F.to_json("record.pay").alias("paid"))


class Base:
    key = field(r.is_int, name="s_suppkey")
    name = field(r.is_string, r.min_length(3), name="s_name", message="base")


class Supplier(Base):
    name = field(r.min_length(18), message="child")
    balance = field(r.is_number(), r.min_value(0), name="s_acctbal")
    rating = field(r.is_int, default=3)


deriving = Engine(allow_class_defaults=True)
deriving.contract(Supplier)
deriving.seal()


@register("""
SELECT s_suppkey, concat_ws(',', CASE WHEN length(s_name) < 18 THEN 'minLength:child' END, CASE WHEN s_acctbal < 0 THEN 'min:' END) AS codes, CASE WHEN length(s_name) >= 18 AND s_acctbal >= 0 THEN CAST(3 AS DOUBLE) END AS rating FROM supplier
""")
def inheritance_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deriving.decode(table(spark, sf_dir, "supplier"), Supplier)
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), F.coalesce(i["message"], F.lit("")))), ",")
    return out.select("s_suppkey", codes.alias("codes"), F.col("value.rating").cast("double").alias("rating"))


even = r.create_rule("isEven", lambda v: F.try_mod(v.get("number"), F.lit(2.0)) == 0, gate="number")
short_word = r.create_rule("shortWord", python=lambda x: len(x) <= 5)


class Own:
    p_size = field(r.is_int, even)
    p_type = field(short_word)
    words = field(array_of(short_word))


owning = Engine()
owning.contract(Own)
owning.seal()


@register("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 <> 0 THEN 'p_size:isEven' END, CASE WHEN length(p_type) > 5 THEN 'p_type:shortWord' END,
       list_aggregate([CASE WHEN length(w[i]) > 5 THEN 'words[' || (i - 1) || ']:shortWord' END FOR i IN range(1, len(w) + 1)], 'string_agg', ',')) AS codes
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
""")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",")
    return owning.check(df, Own).select("p_partkey", codes.alias("codes"))


@register("""
SELECT o_orderkey, true AS string, true AS number, o_orderkey % 2 = 0 AS boolean, true AS date, true AS binary, strlen(o_orderpriority) BETWEEN 5 AND 8 AS sized, true AS object, true AS filled, true AS instance, false AS odd,
       o_orderdate >= TIMESTAMP '1995-06-01' AS min_date, o_orderdate <= TIMESTAMP '1996-06-01' AS max_date FROM orders
""")
def type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, pair = F.col, F.struct(F.col("o_orderkey").alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus"))
    shape = "struct<o_orderkey: bigint, o_totalprice: double, o_orderpriority: string, o_orderstatus: string>"
    flag = F.when(c("o_orderkey") % 2 == 0, F.lit(True))
    flags = {
        "string": r.is_string(c("o_orderstatus")), "number": r.is_number()(c("o_totalprice"), "double"), "boolean": r.is_boolean(flag, "boolean"), "date": r.is_date(c("o_orderdate"), "timestamp"),
        "binary": r.is_uint8_array(F.encode("o_orderpriority", "UTF-8"), "binary"), "sized": r.is_byte_size(5, 8)(F.encode("o_orderpriority", "UTF-8"), "binary"), "object": r.is_object(pair, shape), "filled": r.is_not_empty_object(nullable=True)(pair, shape),
        "instance": r.is_instance(Order)(pair, shape), "odd": r.is_reg_exp(c("o_orderstatus")) | r.is_function(c("o_orderstatus")) | r.is_stateless_reg_exp(c("o_orderstatus")),
        "min_date": r.min_date(datetime(1995, 6, 1))(c("o_orderdate"), "timestamp"), "max_date": r.max_date(datetime(1996, 6, 1))(c("o_orderdate"), "timestamp"),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", *(x.alias(n) for n, x in flags.items()))


# ---- absent keys ----
class Part:
    note = field(r.is_string, optional=True, nullable=True)
    size = field(r.is_number(), optional=True)


class Sparse:
    key = field(r.is_int, decode_name="key", encode_name="id")
    both = field(r.is_string, optional=True, nullable=True)
    some = field(r.is_number(), optional=True)
    null = field(r.is_string, nullable=True)
    late = field(r.is_string, when=lambda v: v.child("key").get("number") % 2 == 0)
    part = field(type=Part, optional=True, nullable=True)
    parts = field(type=[Part], optional=True)
    named = field(type=dict, map_value=Part, optional=True)
    pick = field(discriminator=union("kind", a=Part, b=Card), optional=True, keep_discriminator_property=True)


sparse = Engine()
sparse.contract(Sparse)
sparse.seal()


def _sparse(into: bool) -> str:
    """The documents, or what they are encoded to. Each key is missing, null or given by another digit of the row's number."""
    absent = "NULL" if into else "'null'"  # null of a field that is optional and not nullable leaves no key

    def part(k: str) -> str:
        note = f"CASE {k} % 3 WHEN 0 THEN NULL WHEN 1 THEN '\"note\":null' ELSE '\"note\":\"n\"' END"
        size = f"CASE ({k} // 3) % 3 WHEN 0 THEN NULL WHEN 1 THEN {'NULL' if into else repr(chr(34) + 'size' + chr(34) + ':null')} ELSE '\"size\":' || {k} END"
        return f"'{{' || concat_ws(',', {note}, {size}) || '}}'"

    def key(name: str, kind: str, none: str, given: str) -> str:
        null = f"'\"{name}\":null'" if none != "NULL" else "NULL"
        return f"CASE {kind} WHEN 0 THEN NULL WHEN 1 THEN {null} ELSE '\"{name}\":' || {given} END"

    parts = [
        f"'\"{'id' if into else 'key'}\":' || k", key("both", "k % 3", "'null'", "'\"b\"'"), key("some", "(k // 3) % 3", absent, "k"), "CASE WHEN k % 2 = 0 THEN '\"null\":null' ELSE '\"null\":\"x\"' END",
        "CASE WHEN k % 2 = 0 THEN '\"late\":\"l\"' END" if into else "'\"late\":\"l\"'", key("part", "(k // 9) % 3", "'null'", part("(k // 27)")), key("parts", "(k // 5) % 3", absent, f"'[' || {part('k')} || ',' || {part('(k + 4)')} || ']'"),
        key("named", "(k // 7) % 3", absent, f"'{{\"x\":' || {part('k')} || '}}'"),
        key("pick", "(k // 11) % 3", absent, "CASE WHEN k % 2 = 0 THEN " + (f"replace(replace({part('k')}, '}}', ',\"kind\":\"a\"}}'), '{{,', '{{') ELSE '{{\"number\":\"1234\",\"kind\":\"b\"}}' END".replace("{{", "{").replace("}}", "}") if into else "'{\"kind\":\"a\",' || replace(replace(" + part("k") + ", '{', ''), '}', '') || CASE WHEN " + part("k") + " = '{}' THEN '\"z\":1}' ELSE '}' END ELSE '{\"kind\":\"b\",\"digits\":\"1234\"}' END")),
    ]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


@register(f"SELECT k, {_sparse(True)} AS record FROM (SELECT o_orderkey AS k FROM orders)")
def absent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.expr(_sparse(False).replace("//", "div"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", document.alias("doc"))
    decoded = sparse.decode(docs, Sparse, document="doc", presence=True)
    return sparse.encode(decoded, Sparse, column="value", presence="presence", form="json").select("k", "record")

# ---- membership in tables ----
@register("""
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'l_orderkey:isIn' END,
  CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN 'l_partkey:isNotIn' END, CASE WHEN l_returnflag NOT IN (SELECT o_orderstatus FROM orders) THEN 'l_returnflag:isIn' END,
  CASE WHEN CAST(l_suppkey AS VARCHAR) NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) THEN 'of.supplier:isIn' END) AS codes
FROM lineitem
""")
def table_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, known = table(spark, sf_dir, "orders"), Engine()

    class Supplied:
        supplier = field(r.is_string, r.is_in_table(table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("string(s_suppkey) AS s"), "s"))

    @known.contract
    class Delivered:
        l_orderkey = field(r.is_int, r.is_in_table(orders.where("o_orderstatus = 'F'"), "o_orderkey"))
        l_partkey = field(r.is_not_in_table(table(spark, sf_dir, "part").where("p_size > 25"), "p_partkey"))
        l_returnflag = field(r.is_string, r.is_in_table(orders, "o_orderstatus"))
        of = field(type=Supplied)

    known.seal()
    lines = table(spark, sf_dir, "lineitem").withColumn("of", F.struct(F.col("l_suppkey").cast("string").alias("supplier")))
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",")
    return known.check(lines, Delivered).select("l_orderkey", "l_linenumber", codes.alias("codes"))

# ---- recursion ----
class Branch:
    v = field(r.is_int, r.is_positive)
    kids = field(type=lambda: [Branch], optional=True)


growing = Engine(max_depth=3)
growing.contract(Branch)
growing.seal()

#: A chain of k % 42 records with two kids each, whose first kid is sound in every other row; what it ends in is sound in a third.
_CHAIN = "repeat('{\"v\":1,\"kids\":[{\"v\":' || CASE WHEN k % 2 = 0 THEN '2' ELSE '-2' END || '},', CAST(k % 42 AS INT)) || CASE k % 3 WHEN 0 THEN '{\"v\":7}' WHEN 1 THEN '{\"v\":\"x\",\"kids\":[]}' ELSE '5' END || repeat(']}', CAST(k % 42 AS INT))"


@register("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 42 AS n FROM customer),
i AS (SELECT k, repeat('kids[1].', CAST(d AS INT)) || 'kids[0].v' AS path, 'isPositive' AS code FROM c, range(42) r(d) WHERE d < n AND k % 2 = 1
  UNION ALL SELECT k, repeat('kids[1].', CAST(n AS INT)) || CASE k % 3 WHEN 1 THEN 'v' ELSE '' END, CASE WHEN k % 3 = 1 THEN 'isInt' ELSE 'invalidInput' END FROM c WHERE k % 3 > 0)
SELECT k, path, code FROM i
""")
def recursive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key of eight bytes becomes a document with up to 83 records: keys are dealt over all cores, as Spark splits files by their size alone
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).repartition(4 * spark.sparkContext.defaultParallelism, "k").select("k", F.expr(_CHAIN).alias("doc"))
    return exploded(growing.check(docs, Branch, document="doc"), "k").select("k", "path", "code")

# ---- names of one direction, lists of rules, keys of elements, contracts known by their base ----
class Named:
    title = field(r.is_string, r.max_length(11), name="both") & field(decode_name="p_name")
    words = field(r.array_unique(lambda v: v.with_kinds(string=F.substring(v.get("string"), 1, 1))))
    size = field(r.is_int, extra_rules=[r.max_value(40), *(r.not_equals(n) for n in (7, 9))], decode_name="p_size", encode_name="size")
    shown = field(r.is_string, r.min_length(1000), encode_name="shown")


class NamedMore(Named):
    """Not registered: its nearest sealed base is its contract."""

    later = field(r.is_string)


naming = Engine()
naming.contract(Named)
naming.seal()


@register("""
SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) > 11 THEN 'title:maxLength' END, CASE WHEN len(list_distinct(list_transform(w, lambda x: substr(x, 1, 1)))) < len(w) THEN 'words:arrayUnique' END,
       CASE WHEN p_size IN (7, 9) THEN 'size:notEquals' END, CASE WHEN p_size > 40 THEN 'size:max' END) AS codes
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
""")
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    codes = F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",")
    return naming.check(df, NamedMore).select("p_partkey", codes.alias("codes"))


# ---- Python rules in arrays of arrays of records ----
class Token:
    word = field(r.is_string, r.create_rule("isNoPalindrome", python=lambda w: len(w) < 3 or not w.isascii() or w != w[::-1]))


class TextLine:
    tokens = field(r.create_rule("hasFewTokens", python=lambda tokens: len(tokens) <= 12), type=[Token])


class Paged:
    doc_id = field(r.is_int)
    lines = field(type=[TextLine])


paging = Engine()
paging.contract(Paged)
paging.seal()


@register("""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, string_split(unnest(x), ' ') AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, i, generate_subscripts(t, 1) - 1 AS j, unnest(t) AS w FROM l)
SELECT doc_id, 'lines[' || i || '].tokens' AS path, 'hasFewTokens' AS code FROM l WHERE len(t) > 12
UNION ALL SELECT doc_id, 'lines[' || i || '].tokens[' || j || '].word', 'isNoPalindrome' FROM w WHERE length(w) >= 3 AND regexp_full_match(w, '[\x01-\x7F]*') AND w = reverse(w)
""")
def python_rules_in_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.struct(F.transform(F.split(t, " "), lambda w: F.struct(w.alias("word"))).alias("tokens")))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return exploded(paging.check(docs, Paged), "doc_id").select("doc_id", "path", "code")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
