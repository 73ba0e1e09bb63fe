"""Rules (predicates on a value) and codecs (decode and encode steps)."""

from .array_rules import array_contains, array_max_size, array_min_size, array_not_contains, array_not_empty, array_unique
from .codecs import Codec, codec, csv, iso_string, json, luxon, moment, round_to, to_lower_case, to_upper_case, trim, unix_millis, unix_seconds
from .combinators import array_every, one_of
from .finance_rules import is_bic, is_credit_card, is_currency, is_ean, is_iban, is_isbn, is_isin, is_iso4217_currency_code, is_issn
from .format_rules import (
    is_base32, is_base58, is_base64, is_btc_address, is_byte_length, is_data_uri, is_email, is_ethereum_address, is_fqdn, is_full_width, is_half_width, is_hash, is_hex_color,
    is_hexadecimal, is_hsl, is_ip, is_json, is_jwt, is_lat_long, is_latitude, is_locale, is_longitude, is_mac_address, is_magnet_uri, is_military_time, is_mime_type, is_multibyte,
    is_octal, is_phone_number, is_port, is_rfc3339, is_rgb_color, is_strong_password, is_surrogate_pair, is_tax_id, is_url, is_uuid, is_variable_width,
)
from .identifier_rules import is_cuid2, is_date_string, is_firebase_push_id, is_iso31661_alpha2, is_iso31661_alpha3, is_iso8601, is_isrc, is_mongo_id, is_sem_ver, is_ulid
from .locale_rules import is_identity_card, is_mobile_phone, is_passport_number, is_postal_code
from .rule import Rule, create_rule
from .table_rules import is_in_table, is_not_in_table
from .text_rules import (
    contains, is_alpha, is_alphanumeric, is_ascii, is_boolean_string, is_cors_origin, is_decimal, is_http_token, is_lowercase, is_number_string, is_origin, is_uppercase,
    length, matches, max_length, min_length, not_contains,
)
from .type_rules import (
    equals, is_array, is_boolean, is_byte_size, is_date, is_divisible_by, is_empty, is_enum, is_function, is_in, is_instance, is_int, is_negative, is_not_empty, is_not_empty_object,
    is_not_in, is_number, is_object, is_positive, is_reg_exp, is_stateless_reg_exp, is_string, is_uint8_array, max_date, max_value, min_date, min_value, not_equals,
)

__all__ = [name for name in dir() if not name.startswith("_")]
