"""Every rule on texts and values that it takes and that it doesn't."""

import enum
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkpact import ContractError, rules as r

#: (name, rule, accepted, rejected)
TEXTS = [
    ("minLength", r.min_length(2), ["ab", "\U0001f600"], ["", "a"]),
    ("maxLength", r.max_length(2), ["", "\U0001f600", "ab"], ["abc", "\U0001f600a"]),
    ("length", r.length(1, 2), ["a", "\U0001f600"], ["", "abc"]),
    ("contains", r.contains("b."), ["ab.c"], ["abc", ""]),
    ("notContains", r.not_contains("b"), ["", "ac"], ["abc"]),
    ("matches", r.matches("^a.c$"), ["abc", "a\x85c"], ["abc\n", "a\nc", "a\u2028c", "xabc"]),
    ("matches i", r.matches("ABC", "gi"), ["xabcx"], ["ab"]),
    ("isLowercase", r.is_lowercase, ["abc1", "", "é"], ["aB", "É"]),
    ("isUppercase", r.is_uppercase, ["ABC1", "", "É"], ["Ab", "é"]),
    ("isAscii", r.is_ascii, ["", "a\n\x7f"], ["é"]),
    ("isAlpha", r.is_alpha, ["abZ"], ["", "a1", "é", "a\n"]),
    ("isAlphanumeric", r.is_alphanumeric, ["a1Z"], ["", "a-", "a1\n"]),
    ("isHttpToken", r.is_http_token, ["X-Header", "!#$%&'*+-.^_`|~"], ["", "a b", "a,b", "a\n"]),
    ("isOrigin", r.is_origin, ["null", "https://example.com", "http://a.b:8080", "http://127.0.0.1", "ws://x"], ["*", "https://example.com/", "http://a.b:80", "HTTP://a", "http://A.b", "a", "https://e.com\n", "http://1.2.3"]),
    ("isCorsOrigin", r.is_cors_origin, ["*", "https://example.com"], ["**", "https://example.com/x"]),
    ("isBooleanString", r.is_boolean_string, ["true", "false", "1", "0"], ["True", "", "yes"]),
    ("isNumberString", r.is_number_string(), ["1", "-1.5", "+.5", "00"], ["", "1.", "1e5", " 1", "0x1", "1\n"]),
    ("isNumberString plain", r.is_number_string(no_symbols=True), ["123"], ["-1", "1.5", ""]),
    ("isDecimal", r.is_decimal(), ["1", "1.5", ".5", "-0.1"], ["1.", "", "a", "1,5"]),
    ("isFullWidth", r.is_full_width, ["あ", "aあ", "Ａ"], ["abc", "ｱ", ""]),
    ("isHalfWidth", r.is_half_width, ["a", "ｱ", "aあ"], ["あ", ""]),
    ("isVariableWidth", r.is_variable_width, ["aあ"], ["a", "あ", ""]),
    ("isMultibyte", r.is_multibyte, ["あ", "aĀ"], ["é", "abc", ""]),
    ("isSurrogatePair", r.is_surrogate_pair, ["a\U0001f600"], ["あ", ""]),
    ("isHexadecimal", r.is_hexadecimal, ["09afAF"], ["", "0x1", "g", "a\n"]),
    ("isOctal", r.is_octal, ["017", "0o17", "0O7"], ["8", "", "0x7"]),
    ("isHexColor", r.is_hex_color, ["#fff", "#FFFF", "#a1b2c3", "#a1b2c3d4"], ["fff", "#ff", "#fffff", "#ggg"]),
    ("isRgbColor", r.is_rgb_color(), ["rgb(0,128,255)", "rgba(1, 2, 3, 0.5)", "rgba(1,2,3,1)"], ["rgb(256,0,0)", "rgb(1,2,3,0.5)", "rgba(1,2,3)", "rgb(1%,2%,3%)", "rgb(01,2,3)"]),
    ("isRgbColor percent", r.is_rgb_color(True), ["rgb(1%,2%,100%)", "rgba(1%,2%,3%,.5)", "rgb(1,2,3)"], ["rgb(1%,2%,3%,.5)", "rgb(101%,0%,0%)"]),
    ("isHSL", r.is_hsl, ["hsl(360,100%,0%)", "hsla(1, 2%, 3%, .5)"], ["hsl(361,1%,1%)", "hsl(1,2%,3%,.5)", "hsla(1,2%,3%)"]),
    ("isBase32", r.is_base32(), ["MZXW6YQ=", "mzxw6yq="], ["MZXW6Y", "MZXW6Y1=", ""]),
    ("isBase58", r.is_base58, ["3mJr7A"], ["0", "O", "I", "l", ""]),
    ("isBase64", r.is_base64(), ["Zm9v", "Zm8=", "Zg=="], ["Zm9", "Zg=", "", "Zm-v"]),
    ("isBase64 url", r.is_base64(url_safe=True), ["Zm-_", "Zm8", "Zg", "Zg=="], ["Z", "Zm+v", ""]),
    ("isEmail", r.is_email(), ["a@b.co", "a.b+c@d-e.org"], ["a@b", "@b.co", "a@-b.co", "a@b.c", "a b@c.de", "a@b.co\n"]),
    ("isURL", r.is_url(), ["http://a", "https://a.b:65535/x?y=z#", "ftp://a/"], ["a.b", "ssh://a", "http://a?x", "http://a:65536", "http://a/ b", "http://-a"]),
    ("isURL own", r.is_url(protocols=["a.b"]), ["a.b://x"], ["axb://x", "http://x"]),
    ("isUUID", r.is_uuid(), ["00000000-0000-0000-0000-000000000000"], ["0000", "g0000000-0000-0000-0000-000000000000"]),
    ("isUUID 4", r.is_uuid(4), ["9b1deb4d-3b7d-4bad-9bdd-2b0d7b3dcb6d"], ["9b1deb4d-3b7d-1bad-9bdd-2b0d7b3dcb6d", "9b1deb4d-3b7d-4bad-7bdd-2b0d7b3dcb6d"]),
    ("isIP 4", r.is_ip(4), ["0.0.0.0", "255.255.255.255"], ["256.0.0.1", "01.0.0.1", "1.2.3", "::1"]),
    ("isIP 6", r.is_ip(6), ["::", "::1", "1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7::", "fe80::1:2", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4::1.2.3.4"], ["1.2.3.4", ":::", "1::2::3", "1:2:3:4:5:6:7", "12345::", "::1\n"]),
    ("isIP", r.is_ip(), ["1.2.3.4", "::1"], ["x"]),
    ("isMACAddress", r.is_mac_address(), ["00:1A:2b:3c:4d:5e", "00-1A-2b-3c-4d-5e"], ["00:1A-2b:3c:4d:5e", "001A2b3c4d5e"]),
    ("isMACAddress plain", r.is_mac_address(no_separators=True), ["001A2b3c4d5e"], ["00:1A:2b:3c:4d:5e"]),
    ("isJWT", r.is_jwt, ["a.b.c", "a-_.B.1"], ["a.b", "a.b.c.d", "a..c", "a.b.c="]),
    ("isLocale", r.is_locale, ["en", "en-US", "zh-Hant-TW", "de-1996", "es-419"], ["e", "english", "en_US"]),
    ("isDataURI", r.is_data_uri, ["data:text/plain,", "data:image/png;base64,AA\n==", "data:text/x;a=b;base64,"], ["data:,x", "text/plain,x"]),
    ("isFQDN", r.is_fqdn(), ["a.co", "xn--x.example.org"], ["a", "a.c", "-a.co", "a-.co", "a..co", "a.co.", "a_b.co", ("x" * 64) + ".co", "a.1co", ""]),
    ("isFQDN loose", r.is_fqdn(require_tld=False, allow_underscores=True, allow_trailing_dot=True), ["a", "_a.b.", "-a"], ["", ".", "a..b", "a b"]),
    ("isPort", r.is_port, ["0", "80", "65535"], ["65536", "080", "-1", ""]),
    ("isJSON", r.is_json, ["1", "null", '"a"', "[1, 2]", ' {"a": {"b": null}} ', '{"a":1,"a":2}'], ["", "{", "1 2", "{'a':1}", "[1,]", "nul", '{"a":1} x']),
    ("isMimeType", r.is_mime_type, ["text/html", "application/vnd.api+json; charset=utf-8"], ["text", "foo/bar", "text/", "text/html;"]),
    ("isMagnetURI", r.is_magnet_uri, ["magnet:?xt=urn:btih:" + "a" * 40 + "&dn=x", "MAGNET:?XT=urn:sha1:" + "B" * 32], ["magnet:?dn=x", "magnet:?xt=urn:btih:abc"]),
    ("isByteLength", r.is_byte_length(2, 3), ["é", "abc"], ["a", "éé", ""]),
    ("isPhoneNumber", r.is_phone_number, ["+1234567", "+123456789012345"], ["1234567", "+0123456", "+123456", "+1234567890123456"]),
    ("isStrongPassword", r.is_strong_password(), ["aA1!aaaa", "aA1éaaaa"], ["aA1!", "aA1aaaaa", "aa1!aaaa", "AA1!AAAA", "aAa!aaaa"]),
    ("isTaxId", r.is_tax_id("IT"), ["RSSMRA85T10A562S", "rssmra85t10a562s"], ["RSSMRA85T10A562"]),
    ("isLatLong", r.is_lat_long(), ["90.0, -180", "-45.5,120.25", "+1,2"], ["91,0", "90.1,0", "1", "1,181", "1,2\n"]),
    ("isLatitude", r.is_latitude, ["90", "-90.0", "0"], ["90.1", "1e1", "+5", "x", ""]),
    ("isLongitude", r.is_longitude, ["180", "-180"], ["180.5", " 1"]),
    ("isEthereumAddress", r.is_ethereum_address, ["0x" + "aB" * 20], ["aB" * 20, "0x" + "a" * 39]),
    ("isBtcAddress", r.is_btc_address, ["1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "BC1QAR0SRRR7XF"], ["bc1QAR0srrr7", "2abc", "1short"]),
    ("isHash", r.is_hash("sha1"), ["a" * 40, "A" * 40], ["a" * 39, "g" * 40]),
    ("isRFC3339", r.is_rfc3339, ["2024-01-02T03:04:05Z", "2024-99-99 03:04:05.123+01:00", "2024-01-02t03:04:05z"], ["2024-01-02T03:04:05", "2024-01-02", "2024-01-02T03:04:05Z\n"]),
    ("isMilitaryTime", r.is_military_time, ["00:00", "23:59"], ["24:00", "9:30", "12:60"]),
    ("isISO8601", r.is_iso8601(), ["2024", "2024-13", "2024-01-32", "2024-01-02T25:61:61.5+0100"], ["24", "2024-1", "2024-01-02 03:04:05", "2024-01-02T03:04"]),
    ("isISO8601 strict", r.is_iso8601(strict=True), ["2024", "2024-12", "2024-02-29", "0000-02-29", "2024-01-02T23:59:60Z"], ["2024-13", "2023-02-29", "1900-02-29", "2024-04-31", "2024-00-10", "2024-01-00", "2024-01-02T24:00:00Z", "2024-01-02T00:60:00Z"]),
    ("isISRC", r.is_isrc, ["US-S1Z-99-00001", "USS1Z9900001"], ["us-S1Z-99-00001", "US-S1Z-9900001"]),
    ("isISO31661Alpha2", r.is_iso31661_alpha2, ["DE", "us"], ["XX", "DEU", ""]),
    ("isISO31661Alpha3", r.is_iso31661_alpha3, ["DEU", "usa"], ["XXX", "DE"]),
    ("isFirebasePushId", r.is_firebase_push_id, ["-Kz_0123456789abcdef"], ["short"]),
    ("isSemVer", r.is_sem_ver, ["1.0.0", "1.2.3-rc.1+b.5", "0.0.0-0a"], ["1.0", "01.0.0", "1.0.0-01", "v1.0.0"]),
    ("isMongoId", r.is_mongo_id, ["507f1f77bcf86cd799439011"], ["507f1f77bcf86cd79943901", "507f1f77bcf86cd79943901g"]),
    ("isDateString", r.is_date_string(), ["2024-02-29", "0000-02-29"], ["2023-02-29", "2024-04-31", "2024-1-1", "2024-01-01T", "2024-00-01", "2024-01-00", "0001-02-29"]),
    ("isULID", r.is_ulid(), ["01ARZ3NDEKTSV4RRFFQ69G5FAV"], ["01arz3ndektsv4rrffq69g5fav", "01ARZ3NDEKTSV4RRFFQ69G5FAI"]),
    ("isCUID2", r.is_cuid2(), ["tz4a98xxat96iws9zmbrgj3a"], ["Tz4a98xxat96iws9zmbrgj3a", "9z4a98xxat96iws9zmbrgj3a", "short"]),
    ("isISBN", r.is_isbn(), ["0-306-40615-2", "978-3-16-148410-0", "080442957X"], ["0306406153", "9783161484101", "X123456789", ""]),
    ("isISBN 10", r.is_isbn(10), ["0306406152"], ["9783161484100"]),
    ("isISBN 13", r.is_isbn(13), ["9783161484100", "978 3 16 148410 0"], ["0306406152"]),
    ("isISIN", r.is_isin, ["US0378331005", "AU0000XVGZA3"], ["US0378331006", "us0378331005"]),
    ("isISSN", r.is_issn(), ["0378-5955", "2434-561X"], ["03785955", "0378-5954"]),
    ("isISSN plain", r.is_issn(require_hyphen=False), ["03785955", "0378-5955"], ["03785954"]),
    ("isEAN", r.is_ean, ["4006381333931", "73513537"], ["4006381333932", "73513536", "123"]),
    ("isBIC", r.is_bic, ["DEUTDEFF", "deutdeff500"], ["DEUTDEF", "DEUTDEFF50", "DEU1DEFF"]),
    ("isCurrency", r.is_currency(), ["5", "-$5.25", "$-5", "1,234,567.8", "+5"], ["+-5", "5.123", "1,23", "-$-5", "$", ""]),
    ("isCreditCard", r.is_credit_card, ["4111 1111-1111 1111", "0"], ["4111111111111112", "", "a", "4111x"]),
    ("isIBAN", r.is_iban(), ["DE89370400440532013000", "gb82west12345698765432", "XX82WEST12345698765432"[:0] + "NO9386011117947"], ["DE89370400440532013001", "DE8937040044053201300", "GB82 WEST 1234 5698 7654 32", "DE"]),
    ("isIBAN spaces", r.is_iban(allow_spaces=True), ["GB82 WEST 1234 5698 7654 32"], ["GB82 WEST 1234 5698 7654 33"]),
    ("isISO4217CurrencyCode", r.is_iso4217_currency_code, ["EUR", "USD"], ["eur", "XYZ"]),
    ("isMobilePhone", r.is_mobile_phone("ko-KR"), ["01012345678", "+821012345678"], ["02-1234"]),
    ("isPostalCode", r.is_postal_code("US"), ["12345", "12345-6789"], ["1234", "12345\n"]),
    ("isIdentityCard FI", r.is_identity_card("FI"), ["010190-123A", "0101907123A"[:6] + "5" + "123A"], ["010190Z123A"]),
    ("isIdentityCard FR", r.is_identity_card("FR"), ["12345678é", "12345678É", "1234567890"], ["12345678x"]),
    ("isPassportNumber", r.is_passport_number("GB"), ["123456789"], ["12345678", "A12345678"]),
    ("isString", r.is_string, ["", "a"], []),
    ("equals", r.equals("a"), ["a"], ["b", ""]),
    ("notEquals", r.not_equals("a"), ["b"], ["a"]),
    ("isEmpty", r.is_empty, [""], [" ", "a"]),
    ("isNotEmpty", r.is_not_empty, [" ", "a"], [""]),
    ("isIn", r.is_in(["a", 1, None]), ["a"], ["1", "b"]),
    ("isNotIn", r.is_not_in(["a", 1]), ["1"], ["a"]),
    ("oneOf", r.one_of(r.is_email(), r.is_port), ["a@b.co", "80"], ["x"]),
]


def test_texts(spark):
    rows = [(k, t, good) for k, (_, _, yes, no) in enumerate(TEXTS) for t, good in [*((t, True) for t in yes), *((t, False) for t in no)]]
    df = spark.createDataFrame(rows, "k int, t string, good boolean")
    wrong = []
    for start in range(0, len(TEXTS), 24):  # one plan for all rules would be too large to compile
        judged = F.lit(None).cast("boolean")
        for k in range(start, min(start + 24, len(TEXTS))):
            judged = F.when(F.col("k") == k, TEXTS[k][1](F.col("t"))).otherwise(judged)
        part = df.where(F.col("k").between(start, start + 23)).withColumn("judged", judged)
        wrong += [(TEXTS[x.k][0], x.t, x.judged) for x in part.where("judged is null or judged <> good").collect()]
    assert wrong == []


def test_null_never_passes_a_text_rule(spark):
    df = spark.createDataFrame([(None,)], "t string")
    free = {"isEmpty", "notEquals", "isNotIn", "isIn"}
    flags = [rule(F.col("t")).alias(f"f{k}") for k, (name, rule, _, _) in enumerate(TEXTS) if name not in free][:40]
    assert not any(df.select(*flags).first())


NAN, INF = float("nan"), float("inf")


class Level(enum.Enum):
    LOW = 1
    HIGH = 2


NUMBERS = [
    (r.is_number(), [0.0, -1.5], [NAN, INF, -INF, None]),
    (r.is_number(allow_nan=True, allow_infinity=True), [NAN, INF, 1.0], [None]),
    (r.is_number(max_decimal_places=2), [1.25, 100.0, 1e21], [1.255, 0.1 + 0.2, 1e-7]),
    (r.is_int, [1.0, -5.0, 1e300], [1.5, NAN, INF]),
    (r.min_value(5), [5.0, INF], [4.9, NAN]),
    (r.min_value(5, exclusive=True), [5.1], [5.0, NAN]),
    (r.max_value(5), [5.0, -INF], [5.1, NAN]),
    (r.max_value(5, exclusive=True), [4.9], [5.0]),
    (r.is_positive, [0.1], [0.0, -1.0, NAN]),
    (r.is_negative, [-0.1], [0.0, 1.0, NAN]),
    (r.is_divisible_by(2.5), [5.0, -7.5, 0.0], [1.0, NAN]),
    (r.equals(1), [1.0], [2.0, NAN]),
    (r.equals(NAN), [], [NAN, 1.0]),
    (r.is_in([1, NAN]), [1.0, NAN], [2.0]),
    (r.is_enum(Level), [1.0, 2.0], [3.0]),
    (r.is_enum({"A": 1, "1": "A"}), [1.0], [2.0]),
    (r.is_latitude, [90.0, -90.0], [90.5, NAN]),
    (r.is_string, [], [1.0]),
    (r.is_boolean, [], [1.0]),
]


def test_numbers(spark):
    for k, (rule, yes, no) in enumerate(NUMBERS):
        df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "v double, good boolean").coalesce(1)
        assert [tuple(x) for x in df.select("v", rule(F.col("v"), "double").alias("j"), "good").where("j <> good").collect()] == [], (k, rule.name)


def test_dates_arrays_and_bytes(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), [1.0, None, 1.0], [0.0, -0.0], ["a", "b"], bytearray(b"abc"), {"k": None})], "d timestamp, a array<double>, z array<double>, s array<string>, b binary, m map<string,string>")
    checks = [
        (r.min_date(datetime(2024, 1, 1))(F.col("d"), "timestamp"), True), (r.max_date(datetime(2023, 12, 31))(F.col("d"), "timestamp"), False), (r.is_date(F.col("d"), "timestamp"), True),
        (r.array_contains([1, None])(F.col("a"), "array<double>"), True), (r.array_contains(["1"])(F.col("a"), "array<double>"), False), (r.array_not_contains([2])(F.col("a"), "array<double>"), True),
        (r.array_unique()(F.col("a"), "array<double>"), False), (r.array_unique()(F.col("z"), "array<double>"), False), (r.array_unique()(F.col("s"), "array<string>"), True),
        (r.array_unique(lambda v: v)(F.col("s"), "array<string>"), True), (r.array_min_size(3)(F.col("a"), "array<double>"), True), (r.array_max_size(2)(F.col("a"), "array<double>"), False),
        (r.array_not_empty(F.col("s"), "array<string>"), True), (r.array_every(r.is_string, r.min_length(1))(F.col("s"), "array<string>"), True), (r.array_every(r.is_number())(F.col("a"), "array<double>"), False),
        (r.is_array(F.col("s"), "array<string>"), True), (r.is_uint8_array(F.col("b"), "binary"), True), (r.is_byte_size(1, 2)(F.col("b"), "binary"), False), (r.is_byte_size(3)(F.col("b"), "binary"), True),
        (r.is_object(F.col("m"), "map<string,string>"), True), (r.is_not_empty_object()(F.col("m"), "map<string,string>"), True), (r.is_not_empty_object(nullable=True)(F.col("m"), "map<string,string>"), False),
    ]
    got = df.select(*(c.alias(f"c{k}") for k, c in enumerate(c for c, _ in checks))).first()
    assert [k for k, want in enumerate(w for _, w in checks) if got[k] is not want] == []


@pytest.mark.parametrize("wrong", [lambda: r.min_value(NAN), lambda: r.is_divisible_by(0), lambda: r.is_hash("nope"), lambda: r.is_tax_id("XX"), lambda: r.is_mobile_phone("xx"), lambda: r.one_of(), lambda: r.array_every(), lambda: r.is_uuid(9), lambda: r.is_isbn(11), lambda: r.create_rule("x"), lambda: r.create_rule("x", lambda v: v.null, gate="nope")])
def test_wrong_declarations(wrong):
    with pytest.raises(ContractError):
        wrong()


def test_iso_countries(spark):
    from sparkpact.operators.identifier_rules import iso_countries

    assert 240 < len(iso_countries(2)) < 260 and len(iso_countries(3)) == len(iso_countries(2))


def test_ipv6_hosts_of_origins_are_canonical(spark):
    import ipaddress
    import random

    rng = random.Random(6)
    hosts = [":::::", "1:2", "0:0:0:0:0:0:0:1", "::1", "::", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:0:0:2::3", "1::2:0:0:3", "1:0:2:3:4:5:6:7", "0:0:1::", "::1:0:0", "1::2::3", "01::1", "A::1", "12345::1", ":1", "1:", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6::7:8:9"]
    for _ in range(300):
        pieces = [rng.choice((0, 0, 0, 1, 0xAB)) for _ in range(8)]
        text = ":".join(f"{p:x}" for p in pieces)
        whole = str(ipaddress.IPv6Address(text))
        a, b = sorted((rng.randrange(9), rng.randrange(9)))
        other = ":".join(f"{p:x}" for p in pieces[:a]) + "::" + ":".join(f"{p:x}" for p in pieces[b:])
        hosts += [text, whole, other]

    def canonical(host):
        try:
            address = ipaddress.IPv6Address(host)
        except ValueError:
            return False
        # Python writes the same form, but for addresses that hold an IPv4 one, which it may write with dots
        return ":".join(f"{int(p, 16):x}" for p in address.exploded.split(":")) == host or host == str(address) if "." not in str(address) else None

    want = [(h, canonical(h)) for h in dict.fromkeys(hosts)]
    want = [(h, w and not (":0:0:" in f":{h}:" and "::" not in h)) for h, w in want if w is not None]
    df = spark.createDataFrame([(f"https://[{h}]{port}", w) for h, w in want for port in ("", ":8443")], "x string, want boolean")
    from sparkpact import rules

    wrong = df.where(rules.is_origin(F.col("x")) != F.col("want")).collect()
    assert not wrong
    assert df.where("want").count() > 100


def test_instances_have_the_types_of_their_contract(spark):
    from sparkpact import array_of, field

    class Inner:
        x = field(r.is_number())

    class Outer:
        a = field(r.is_string, name="A")
        b = field(r.min_value(1), optional=True)
        inner = field(type=Inner)
        many = field(type=[Inner])
        words = field(r.array_min_size(1), array_of(r.is_string))
        free = field()

    good = "struct<A:string,b:int,inner:struct<x:double>,many:array<struct<x:int>>,words:array<string>,free:date,more:int>"
    bad = [good.replace("A:string", "a:string"), good.replace("b:int", "b:string"), good.replace("inner:struct<x:double>", "inner:struct<y:double>"), good.replace("inner:struct<x:double>", "inner:struct<x:string>"), good.replace("array<struct<x:int>>", "struct<x:int>"),
           good.replace("array<struct<x:int>>", "array<struct<x:boolean>>"), good.replace("words:array<string>", "words:string"), "map<string,string>", "string"]
    for kind in [good, *bad]:
        df = spark.range(1).select(F.lit(None).cast(kind).alias("n"), F.from_json(F.lit("{}"), kind).alias("v") if kind.startswith("struct") else F.lit(None).cast(kind).alias("v"))
        got = df.select(r.is_instance(Outer)(F.col("v"), kind).alias("v"), r.is_instance(Outer)(F.col("n"), kind).alias("n")).first()
        assert (got.v, got.n) == (kind == good, False), kind
