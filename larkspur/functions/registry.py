"""Scalar functions of the dialect as Spark SQL templates.

A function has one template, or several of which the one that takes the given
number of arguments is used.  {0}, {1}... are the lowered arguments, {*} all of
them.  SAFE holds what SAFE.f(...) becomes where f can raise.
"""

from __future__ import annotations

import re

from .keysets import TEMPLATES as KEYSETS

I = "int({0})"  # noqa: E741


def indices(template: str) -> int | None:
    if "{*}" in template:
        return None
    return max((int(x) for x in re.findall(r"\{(\d)\}", template)), default=-1) + 1


def fill(templates: str | tuple[str, ...], args: list[str], name: str) -> str:
    for t in (templates,) if isinstance(templates, str) else templates:
        n = indices(t)
        if n is None or n == len(args):
            t = t.replace("{*}", ", ".join(args))
            return re.sub(r"\{(\d)\}", lambda m: args[int(m[1])], t)
    raise ValueError(f"{name} does not take {len(args)} arguments")


def _guard(cond: str, ok: str, message: str) -> str:
    return f"if({cond}, raise_error('{message}'), {ok})"


_LEN = "if({0} IS NULL, NULL, size({0}))"
_POS = "int(greatest({1}, 0))"

MATH = {
    "ABS": "abs({0})", "SIGN": "(CASE WHEN isnan(double({0})) THEN {0} ELSE sign({0}) END)", "ACOS": _guard("abs({0}) > 1", "acos({0})", "ACOS: argument out of range"),
    "ACOSH": _guard("{0} < 1", "acosh({0})", "ACOSH: argument out of range"), "ASIN": _guard("abs({0}) > 1", "asin({0})", "ASIN: argument out of range"), "ASINH": "asinh({0})",
    "ATAN": "atan({0})", "ATAN2": "atan2({0}, {1})", "ATANH": _guard("abs({0}) >= 1", "atanh({0})", "ATANH: argument out of range"), "CBRT": "cbrt({0})",
    "CEIL": "double(ceil({0}))", "CEILING": "double(ceil({0}))", "FLOOR": "double(floor({0}))", "COS": "cos({0})", "COSH": "cosh({0})", "COT": _guard("{0} = 0", "cot({0})", "COT: division by zero"),
    "COTH": _guard("{0} = 0", "(1D / tanh({0}))", "COTH: division by zero"), "CSC": _guard("{0} = 0", "csc({0})", "CSC: division by zero"), "CSCH": _guard("{0} = 0", "(1D / sinh({0}))", "CSCH: division by zero"),
    "SEC": "sec({0})", "SECH": "(1D / cosh({0}))", "SIN": "sin({0})", "SINH": "sinh({0})", "TAN": "tan({0})", "TANH": "tanh({0})", "DIV": "({0} div {1})", "MOD": "mod({0}, {1})",
    "EXP": _guard("{0} > 709.782712893384 AND {0} < double('Infinity')", "exp({0})", "EXP: overflow"), "LN": _guard("{0} <= 0", "ln({0})", "LN: argument must be positive"),
    "LOG": (_guard("{0} <= 0", "ln({0})", "LOG: argument must be positive"), _guard("{0} <= 0 OR {1} <= 0 OR {1} = 1", "log({1}, {0})", "LOG: argument out of range")), "LOG10": _guard("{0} <= 0", "log10({0})", "LOG10: argument must be positive"),
    "LOG2": "log2({0})", "PI": "pi()", "PI_NUMERIC": "CAST('3.141592654' AS DECIMAL(38, 9))", "PI_BIGNUMERIC": "CAST('3.14159265358979323846264338327950288420' AS DECIMAL(38, 37))", "POW": "pow({0}, {1})", "POWER": "pow({0}, {1})", "RAND": "rand()",
    "SQRT": _guard("{0} < 0", "sqrt({0})", "SQRT: argument must not be negative"), "IEEE_DIVIDE": "(CASE WHEN double({1}) <> 0 THEN double({0}) / double({1}) WHEN {1} IS NULL OR {0} IS NULL THEN NULL WHEN {0} = 0 OR isnan(double({0})) THEN double('NaN') WHEN {0} > 0 THEN double('Infinity') ELSE double('-Infinity') END)",
    "IS_INF": "(abs(double({0})) = double('Infinity'))", "IS_NAN": "isnan(double({0}))", "ROUND": ("round({0})", "round({0}, int({1}))"),
    "TRUNC": "(sign({0}) * floor(abs({0})))", "TRUNCATE": "(sign({0}) * floor(abs({0})))",
    "SAFE_ADD": "try_add({0}, {1})", "SAFE_SUBTRACT": "try_subtract({0}, {1})", "SAFE_MULTIPLY": "try_multiply({0}, {1})", "SAFE_DIVIDE": "try_divide({0}, {1})", "SAFE_NEGATE": "try_subtract(0L, {0})",
    "RANGE_BUCKET": "if({0} IS NULL OR {1} IS NULL, NULL, bigint(size(filter({1}, __b -> __b <= {0}))))", "DEGREES": "degrees({0})", "RADIANS": "radians({0})",
    "COSINE_DISTANCE": "(1D - aggregate(zip_with({0}, {1}, (__x, __y) -> double(__x) * double(__y)), 0D, (__s, __v) -> __s + __v) / (sqrt(aggregate({0}, 0D, (__s, __v) -> __s + double(__v) * double(__v))) * sqrt(aggregate({1}, 0D, (__s, __v) -> __s + double(__v) * double(__v)))))",
    "EUCLIDEAN_DISTANCE": "sqrt(aggregate(zip_with({0}, {1}, (__x, __y) -> pow(double(__x) - double(__y), 2)), 0D, (__s, __v) -> __s + __v))", "DOT_PRODUCT": "aggregate(zip_with({0}, {1}, (__x, __y) -> double(__x) * double(__y)), 0D, (__s, __v) -> __s + __v)",
    "MANHATTAN_DISTANCE": "aggregate(zip_with({0}, {1}, (__x, __y) -> abs(double(__x) - double(__y))), 0D, (__s, __v) -> __s + __v)", "L1_NORM": "aggregate({0}, 0D, (__s, __v) -> __s + abs(double(__v)))", "L2_NORM": "sqrt(aggregate({0}, 0D, (__s, __v) -> __s + double(__v) * double(__v)))",
}
for _n in ("COSINE_DISTANCE", "EUCLIDEAN_DISTANCE", "DOT_PRODUCT"):
    MATH["APPROX_" + _n] = MATH[_n]

#: Unicode white space.
BLANKS = "\\t\\n\\u000b\\u000c\\r \\u0085\\u00a0\\u1680" + "".join(f"\\u{x:04x}" for x in range(0x2000, 0x200B)) + "\\u2028\\u2029\\u202f\\u205f\\u3000"
_QUOTED = "concat('\\\\Q', {1}, '\\\\E')"
STRING = {
    "ASCII": "bigint(if({0} = '', 0, ascii({0})))", "UNICODE": "bigint(if({0} = '', 0, ascii({0})))", "BYTE_LENGTH": "bigint(octet_length({0}))", "OCTET_LENGTH": "bigint(octet_length({0}))", "CHAR_LENGTH": "bigint(char_length({0}))", "CHARACTER_LENGTH": "bigint(char_length({0}))", "LENGTH": "bigint(length({0}))",
    "BIT_LENGTH": "bigint(bit_length({0}))", "CHR": "(CASE WHEN {0} = 0 THEN '' ELSE decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32') END)", "CODE_POINTS_TO_BYTES": "unhex(array_join(transform({0}, __x -> lpad(hex(__x), 2, '0')), ''))",
    "CODE_POINTS_TO_STRING": "decode(unhex(array_join(transform({0}, __x -> lpad(hex(__x), 8, '0')), '')), 'UTF-32')", "COLLATE": "collate({0}, if({1} = 'und:ci', 'UTF8_LCASE', 'UTF8_BINARY'))", "CONCAT": "concat({*})",
    "EDIT_DISTANCE": ("bigint(levenshtein({0}, {1}))", "bigint(least(levenshtein({0}, {1}), {2}))"), "ENDS_WITH": "endswith({0}, {1})", "STARTS_WITH": "startswith({0}, {1})", "FROM_BASE64": "unbase64({0})", "TO_BASE64": "base64({0})", "FROM_HEX": "unhex({0})", "TO_HEX": "lower(hex({0}))",
    "INSTR": ("bigint(instr({0}, {1}))", "bigint(if({2} > 0, locate({1}, {0}, int({2})), lk_instr({0}, {1}, {2}, 1L)))", "lk_instr({0}, {1}, {2}, {3})"), "STRPOS": "bigint(instr({0}, {1}))", "LEFT": _guard("{1} < 0", "left({0}, int({1}))", "LEFT: length must not be negative"),
    "RIGHT": _guard("{1} < 0", "right({0}, int({1}))", "RIGHT: length must not be negative"), "LOWER": "lower({0})", "UPPER": "upper({0})", "LCASE": "lower({0})", "UCASE": "upper({0})", "LPAD": ("lpad({0}, int({1}))", "lpad({0}, int({1}), {2})"), "RPAD": ("rpad({0}, int({1}))", "rpad({0}, int({1}), {2})"),
    "LTRIM": (f"ltrim('{BLANKS}', {{0}})", "ltrim({1}, {0})"), "RTRIM": (f"rtrim('{BLANKS}', {{0}})", "rtrim({1}, {0})"), "TRIM": (f"btrim({{0}}, '{BLANKS}')", "btrim({0}, {1})"), "NORMALIZE": ("lk_normalize({0}, 'NFC', false)", "lk_normalize({0}, {1}, false)"), "NORMALIZE_AND_CASEFOLD": ("lk_normalize({0}, 'NFC', true)", "lk_normalize({0}, {1}, true)"),
    "REGEXP_CONTAINS": "({0} RLIKE {1})", "REGEXP_MATCH": "({0} RLIKE concat('^(?:', {1}, ')$'))", "REGEXP_LIKE": "({0} RLIKE {1})",
    "REGEXP_EXTRACT_ALL": "if({0} IS NULL OR {1} IS NULL, NULL, regexp_extract_all({0}, {1}, {g}))", "REPEAT": _guard("{1} < 0", "repeat({0}, int({1}))", "REPEAT: count must not be negative"), "REPLACE": "if({1} = '', {0}, replace({0}, {1}, {2}))", "REVERSE": "reverse({0})",
    "SAFE_CONVERT_BYTES_TO_STRING": "make_valid_utf8(CAST({0} AS STRING))", "SOUNDEX": "soundex({0})", "SPLIT": ("split({0}, ',')", f"if({{1}} = '', if({{0}} = '', array(''), filter(split({{0}}, ''), __c -> __c <> '')), split({{0}}, {_QUOTED}))"),
    "SUBSTR": ("(CASE WHEN {1} < 0 AND -{1} > length({0}) THEN {0} ELSE substring({0}, int({1})) END)", "(CASE WHEN {2} < 0 THEN raise_error('SUBSTR: length must not be negative') WHEN {1} < 0 AND -{1} > length({0}) THEN substring({0}, 1, int({2})) WHEN {1} = 0 THEN substring({0}, 1, int({2})) ELSE substring({0}, int({1}), int({2})) END)"),
    "TO_CODE_POINTS": "if({0} = '', array(), transform(filter(split({0}, ''), __c -> __c <> ''), __c -> bigint(ascii(__c))))", "TRANSLATE": "translate({0}, {1}, {2})", "SPLIT_SUBSTR": ("lk_split_substr({0}, {1}, {2}, 2147483647L)", "lk_split_substr({0}, {1}, {2}, {3})"), "INITCAP": ("lk_initcap({0}, NULL)", "lk_initcap({0}, {1})"), "FROM_BASE32": "lk_from_base32({0})", "TO_BASE32": "lk_to_base32({0})",
    "CONTAINS_SUBSTR": "contains(lk_normalize(CAST({0} AS STRING), 'NFKC', true), lk_normalize({1}, 'NFKC', true))", "CONCAT_WS": "concat_ws({*})", "HEX": "hex({0})", "UNHEX": "unhex({0})", "INSERT": "overlay({0} PLACING {3} FROM int({1}) FOR int({2}))", "LOCATE": ("bigint(locate({0}, {1}))", "bigint(locate({0}, {1}, int({2})))"), "POSITION": "bigint(position({0}, {1}))", "OCT": "conv({0}, 10, 8)", "SPACE": "space(int({0}))",
    "STRCMP": "bigint(CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 WHEN {0} = {1} THEN 0 END)", "SUBSTRING_INDEX": "substring_index({0}, {1}, int({2}))", "QUOTE": "concat(\"'\", replace(replace({0}, '\\\\', '\\\\\\\\'), \"'\", \"\\\\'\"), \"'\")", "CHAR": "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')", "ORD": "bigint(conv(hex(encode(left({0}, 1), 'UTF-8')), 16, 10))",
}
STRING["SUBSTRING"] = STRING["MID"] = STRING["SUBSTR"]

ARRAY = {
    "ARRAY_LENGTH": "bigint(" + _LEN + ")", "ARRAY_CONCAT": "concat({*})", "ARRAY_REVERSE": "reverse({0})", "ARRAY_TO_STRING": ("array_join({0}, {1})", "array_join({0}, {1}, {2})"), "ARRAY_FIRST": _guard("size({0}) = 0", "element_at({0}, 1)", "ARRAY_FIRST: the array is empty"), "ARRAY_LAST": _guard("size({0}) = 0", "element_at({0}, -1)", "ARRAY_LAST: the array is empty"),
    "ARRAY_FILTER": "filter({0}, {1})", "ARRAY_TRANSFORM": "transform({0}, {1})", "ARRAY_INCLUDES_ALL": "(size(array_except({1}, {0})) = 0)", "ARRAY_INCLUDES_ANY": "arrays_overlap({0}, {1})", "ARRAY_IS_DISTINCT": "(size(array_distinct({0})) = size({0}))", "ARRAY_MAX": "array_max({0})", "ARRAY_MIN": "array_min({0})",
    "ARRAY_SUM": "aggregate(filter({0}, __x -> __x IS NOT NULL), CAST(NULL AS {sum}), (__s, __x) -> coalesce(__s, 0) + __x)", "ARRAY_AVG": "(aggregate(filter({0}, __x -> __x IS NOT NULL), 0D, (__s, __x) -> __s + double(__x)) / nullif(size(filter({0}, __x -> __x IS NOT NULL)), 0))",
    "ARRAY_SLICE": "(CASE WHEN size({0}) = 0 THEN {0} ELSE (slice({0}, int(greatest(if({1} < 0, size({0}) + {1}, {1}), 0)) + 1, int(greatest(least(if({2} < 0, size({0}) + {2}, {2}), size({0}) - 1) - greatest(if({1} < 0, size({0}) + {1}, {1}), 0) + 1, 0)))) END)",
    "GENERATE_ARRAY": ("if({0} <= {1}, sequence({0}, {1}, 1), array())", "(CASE WHEN {2} = 0 THEN raise_error('GENERATE_ARRAY: step must not be 0') WHEN ({2} > 0 AND {0} > {1}) OR ({2} < 0 AND {0} < {1}) THEN array() ELSE transform(sequence(0, int(floor(({1} - {0}) / {2}))), __i -> {0} + __i * {2}) END)"),
    "FLATTEN": "flatten({0})", "ARRAY_OFFSET_": "array_position({0}, {1})",
}

HASH = {
    "MD5": "unhex(md5({0}))", "SHA1": "unhex(sha1({0}))", "SHA256": "unhex(sha2({0}, 256))", "SHA512": "unhex(sha2({0}, 512))", "SHA2": "sha2({0}, int({1}))", "FARM_FINGERPRINT": "lk_farm_fingerprint(CAST({0} AS BINARY))", "GENERATE_UUID": "uuid()", "NEW_UUID": "uuid()",
    "BIT_COUNT": "bigint(bit_count({0}))", "BIT_REVERSE": "lk_bit_reverse({0}, {1})", "BIT_CAST_TO_INT32": "bigint(pmod({0} + 2147483648L, 4294967296L) - 2147483648L)", "BIT_CAST_TO_INT64": "bigint(CASE WHEN {0} >= 9223372036854775808BD THEN {0} - 18446744073709551616BD ELSE {0} END)", "BIT_CAST_TO_UINT32": "pmod({0}, 4294967296L)", "BIT_CAST_TO_UINT64": "(CASE WHEN {0} < 0 THEN CAST({0} AS DECIMAL(20, 0)) + 18446744073709551616BD ELSE CAST({0} AS DECIMAL(20, 0)) END)",
    "SESSION_USER": "session_user()", "ERROR": "raise_error({0})", "ZSTD_COMPRESS": "lk_zstd(CAST({0} AS BINARY))", "ZSTD_DECOMPRESS_TO_BYTES": "lk_unzstd({0})", "ZSTD_DECOMPRESS_TO_STRING": "CAST(lk_unzstd({0}) AS STRING)",
}

CONDITIONAL = {
    "COALESCE": "coalesce({*})", "IF": "if({0}, {1}, {2})", "IFNULL": "ifnull({0}, {1})", "NULLIF": "nullif({0}, {1})", "ZEROIFNULL": "coalesce({0}, 0)", "NULLIFZERO": "nullif({0}, 0)",
}

DATES = {
    "DATE_FROM_UNIX_DATE": "date_from_unix_date(int({0}))", "UNIX_DATE": "bigint(unix_date({0}))", "UNIX_SECONDS": "unix_seconds({0})", "UNIX_MILLIS": "unix_millis({0})", "UNIX_MICROS": "unix_micros({0})", "TIMESTAMP_SECONDS": "timestamp_seconds({0})", "TIMESTAMP_MILLIS": "timestamp_millis({0})", "TIMESTAMP_MICROS": "timestamp_micros({0})",
    "TIMESTAMP_FROM_UNIX_SECONDS": "timestamp_seconds({0})", "TIMESTAMP_FROM_UNIX_MILLIS": "timestamp_millis({0})", "TIMESTAMP_FROM_UNIX_MICROS": "timestamp_micros({0})",
    "ADDDATE": "date_add({0}, int({1}))", "SUBDATE": "date_sub({0}, int({1}))", "DAY": "bigint(day({0}))", "DAYOFMONTH": "bigint(day({0}))", "DAYOFWEEK": "bigint(dayofweek({0}))", "DAYOFYEAR": "bigint(dayofyear({0}))", "DAYNAME": "date_format({0}, 'EEEE')", "MONTHNAME": "date_format({0}, 'MMMM')", "HOUR": "bigint(hour({0}))", "MINUTE": "bigint(minute({0}))", "SECOND": "bigint(second({0}))", "MICROSECOND": "bigint(unix_micros(timestamp({0})) % 1000000)", "MONTH": "bigint(month({0}))", "QUARTER": "bigint(quarter({0}))", "YEAR": "bigint(year({0}))", "WEEKDAY": "bigint(weekday({0}))", "WEEKOFYEAR": "bigint(weekofyear({0}))",
    "MAKEDATE": "date_add(make_date(int({0}), 1, 1), int({1}) - 1)", "TO_DAYS": "bigint(unix_date(date({0})) + 719528)", "FROM_DAYS": "date_from_unix_date(int({0} - 719528))", "TO_SECONDS": "((unix_date(date({0})) + 719528L) * 86400L + unix_seconds(timestamp({0})) % 86400L)", "PERIOD_ADD": "bigint(floor((({0} div 100) * 12 + {0} % 100 - 1 + {1}) / 12) * 100 + pmod(({0} div 100) * 12 + {0} % 100 - 1 + {1}, 12) + 1)", "PERIOD_DIFF": "((({0} div 100) * 12 + {0} % 100) - (({1} div 100) * 12 + {1} % 100))",
    "UNIX_TIMESTAMP": ("unix_seconds(now())", "unix_seconds(timestamp({0}))"), "FROM_UNIXTIME": "timestamp_seconds({0})", "UTC_DATE": "current_date()", "UTC_TIMESTAMP": "localtimestamp()", "SYSDATE": "localtimestamp()", "NOW": "now()", "LOCALTIME": "localtimestamp()", "LOCALTIMESTAMP": "localtimestamp()", "PENDING_COMMIT_TIMESTAMP": "current_timestamp()", "DATEDIFF": "bigint(datediff({0}, {1}))",
}

JSON = {
    "PARSE_JSON": "parse_json({0})", "TO_JSON": "to_variant_object({0})", "JSON_TYPE": "(CASE WHEN is_variant_null({0}) THEN 'null' ELSE (CASE WHEN schema_of_variant({0}) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant({0}) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant({0}) = 'STRING' THEN 'string' WHEN schema_of_variant({0}) = 'BOOLEAN' THEN 'boolean' ELSE 'number' END) END)",
    "INT64": "variant_get({0}, '$', 'bigint')", "FLOAT64": "variant_get({0}, '$', 'double')", "DOUBLE": "variant_get({0}, '$', 'double')", "FLOAT32": "variant_get({0}, '$', 'float')", "FLOAT": "variant_get({0}, '$', 'float')", "INT32": "variant_get({0}, '$', 'int')", "UINT32": "variant_get({0}, '$', 'bigint')", "UINT64": "variant_get({0}, '$', 'decimal(20,0)')", "BOOL": "variant_get({0}, '$', 'boolean')",
    "LAX_INT64": "try_variant_get({0}, '$', 'bigint')", "LAX_FLOAT64": "try_variant_get({0}, '$', 'double')", "LAX_DOUBLE": "try_variant_get({0}, '$', 'double')", "LAX_BOOL": "try_variant_get({0}, '$', 'boolean')", "LAX_STRING": "try_variant_get({0}, '$', 'string')", "LAX_INT32": "try_variant_get({0}, '$', 'int')", "LAX_UINT32": "try_variant_get({0}, '$', 'bigint')", "LAX_UINT64": "try_variant_get({0}, '$', 'decimal(20,0)')", "LAX_FLOAT": "try_variant_get({0}, '$', 'float')",
    "JSON_KEYS": "json_object_keys(to_json({0}))", "JSON_UNQUOTE": "variant_get(parse_json({0}), '$', 'string')",
}
for _name, _type in {"INT64": "bigint", "FLOAT64": "double", "DOUBLE": "double", "FLOAT32": "float", "FLOAT": "float", "INT32": "int", "UINT32": "bigint", "UINT64": "decimal(20,0)", "BOOL": "boolean", "STRING": "string"}.items():
    JSON[f"{_name}_ARRAY"] = f"CAST({{0}} AS ARRAY<{_type}>)"
    JSON[f"LAX_{_name}_ARRAY"] = f"transform(try_cast({{0}} AS ARRAY<VARIANT>), __v -> try_variant_get(__v, '$', '{_type}'))"

NET = {
    "NET.HOST": "lk_net_host({0})", "NET.PUBLIC_SUFFIX": "lk_net_suffix({0})", "NET.REG_DOMAIN": "lk_net_domain({0})", "NET.IP_FROM_STRING": "lk_ip_from_string({0}, false)", "NET.SAFE_IP_FROM_STRING": "lk_ip_from_string({0}, true)", "NET.IP_TO_STRING": "lk_ip_to_string({0})", "NET.IP_NET_MASK": "lk_ip_mask({0}, {1})", "NET.IP_TRUNC": "lk_ip_trunc({0}, {1})", "NET.IPV4_FROM_INT64": "unhex(lpad(hex(pmod({0}, 4294967296L)), 8, '0'))", "NET.IPV4_TO_INT64": "bigint(conv(hex({0}), 16, 10))", "NET.IP_IN_NET": "lk_ip_in_net({0}, {1})", "NET.FORMAT_IP": "lk_ip_to_string(unhex(lpad(hex({0}), 8, '0')))", "NET.PARSE_IP": "bigint(conv(hex(lk_ip_from_string({0}, false)), 16, 10))", "NET.FORMAT_PACKED_IP": "lk_ip_to_string({0})", "NET.PARSE_PACKED_IP": "lk_ip_from_string({0}, false)", "NET.MAKE_NET": "concat(lk_ip_to_string(lk_ip_trunc(lk_ip_from_string({0}, false), {1})), '/', {1})",
    "INET_ATON": "bigint(conv(hex(lk_ip_from_string({0}, true)), 16, 10))", "INET_NTOA": "lk_ip_to_string(unhex(lpad(hex({0}), 8, '0')))", "INET6_ATON": "lk_ip_from_string({0}, true)", "INET6_NTOA": "lk_ip_to_string({0})", "IS_IPV4": "coalesce(octet_length(lk_ip_from_string({0}, true)) = 4, false)", "IS_IPV6": "coalesce(octet_length(lk_ip_from_string({0}, true)) = 16, false)", "IS_IPV4_COMPAT": "coalesce(hex({0}) RLIKE '^0{24}(?!0000000[01]$)', false)", "IS_IPV4_MAPPED": "coalesce(hex({0}) RLIKE '^0{20}FFFF', false)",
    "IS_UUID": "({0} RLIKE '^[{]?[0-9a-fA-F]{08}-?[0-9a-fA-F]{04}-?[0-9a-fA-F]{04}-?[0-9a-fA-F]{04}-?[0-9a-fA-F]{12}[}]?$')", "UUID_TO_BIN": "unhex(replace({0}, '-', ''))", "BIN_TO_UUID": "lower(concat_ws('-', substring(hex({0}), 1, 8), substring(hex({0}), 9, 4), substring(hex({0}), 13, 4), substring(hex({0}), 17, 4), substring(hex({0}), 21)))",
}

RANGES = {
    "RANGE_START": "({0}).start", "RANGE_END": "({0}).end", "RANGE_IS_START_UNBOUNDED": "(({0}).start IS NULL)", "RANGE_IS_END_UNBOUNDED": "(({0}).end IS NULL)",
    "RANGE": "named_struct('start', {0}, 'end', if({0} >= {1}, raise_error('RANGE: start must be before end'), {1}))",
    "RANGE_OVERLAPS": "(coalesce(({0}).start < ({1}).end, true) AND coalesce(({1}).start < ({0}).end, true))",
    "RANGE_INTERSECT": "named_struct('start', greatest(({0}).start, ({1}).start), 'end', if(greatest(({0}).start, ({1}).start) >= least(({0}).end, ({1}).end), raise_error('RANGE_INTERSECT: the ranges are disjoint'), least(({0}).end, ({1}).end)))",
    "GENERATE_RANGE_ARRAY": (
        "transform(filter(sequence(({0}).start, ({0}).end, {1}), __d -> __d < ({0}).end), __d -> named_struct('start', __d, 'end', least(__d + {1}, ({0}).end)))",
        "transform(filter(sequence(({0}).start, ({0}).end, {1}), __d -> __d < ({0}).end AND ({2} OR __d + {1} <= ({0}).end)), __d -> named_struct('start', __d, 'end', least(__d + {1}, ({0}).end)))",
    ),
}

SKETCHES = {
    "HLL_COUNT.INIT": ("hll_sketch_agg({0}, 15)", "hll_sketch_agg({0}, int({1}))"), "HLL_COUNT.EXTRACT": "hll_sketch_estimate({0})", "HLL_COUNT.MERGE": "hll_sketch_estimate(hll_union_agg({0}, true))", "HLL_COUNT.MERGE_PARTIAL": "hll_union_agg({0}, true)",
    "KLL_QUANTILES.INIT_INT64": "kll_sketch_agg_bigint({0})", "KLL_QUANTILES.INIT_FLOAT64": "kll_sketch_agg_double({0})", "KLL_QUANTILES.EXTRACT_POINT_INT64": "kll_sketch_get_quantile_bigint({0}, double({1}))", "KLL_QUANTILES.EXTRACT_POINT_FLOAT64": "kll_sketch_get_quantile_double({0}, double({1}))", "KLL_QUANTILES.MERGE_POINT_INT64": "kll_sketch_get_quantile_bigint(kll_merge_agg_bigint({0}), double({1}))", "KLL_QUANTILES.MERGE_POINT_FLOAT64": "kll_sketch_get_quantile_double(kll_merge_agg_double({0}), double({1}))", "KLL_QUANTILES.MERGE_PARTIAL": "kll_merge_agg_double({0})",
}

AGGREGATES = {
    "SUM": "sum({0})", "AVG": "avg({0})", "MIN": "min({0})", "MAX": "max({0})", "COUNTIF": "count_if({0})", "LOGICAL_AND": "bool_and({0})", "LOGICAL_OR": "bool_or({0})", "BIT_AND": "bit_and({0})", "BIT_OR": "bit_or({0})", "BIT_XOR": "bit_xor({0})", "ANY_VALUE": "any_value({0})", "MAX_BY": "max_by({0}, {1})", "MIN_BY": "min_by({0}, {1})",
    "CORR": "corr({0}, {1})", "COVAR_POP": "covar_pop({0}, {1})", "COVAR_SAMP": "covar_samp({0}, {1})", "STDDEV": "stddev_samp({0})", "STDDEV_SAMP": "stddev_samp({0})", "STDDEV_POP": "stddev_pop({0})", "VARIANCE": "var_samp({0})", "VAR_SAMP": "var_samp({0})", "VAR_POP": "var_pop({0})", "APPROX_COUNT_DISTINCT": "approx_count_distinct({0})", "GROUPING": "grouping({0})",
    "ARRAY_CONCAT_AGG": "nullif(flatten(collect_list({0})), array())",
}

WINDOWS = {
    "ROW_NUMBER": "row_number()", "RANK": "rank()", "DENSE_RANK": "dense_rank()", "PERCENT_RANK": "percent_rank()", "CUME_DIST": "cume_dist()", "NTILE": "ntile(int({0}))", "LAG": ("lag({0})", "lag({0}, int({1}))", "lag({0}, int({1}), {2})"), "LEAD": ("lead({0})", "lead({0}, int({1}))", "lead({0}, int({1}), {2})"), "FIRST_VALUE": "first_value({0})", "LAST_VALUE": "last_value({0})", "NTH_VALUE": "nth_value({0}, int({1}))",
}

GEOGRAPHY = {f"ST_{n}": f"lk_st_{n.lower()}({{*}})" for n in "GEOGPOINT X Y ASTEXT ASGEOJSON DISTANCE DWITHIN LENGTH PERIMETER AREA NPOINTS NUMPOINTS GEOGFROMTEXT GEOGFROMGEOJSON GEOMETRYTYPE DIMENSION ISEMPTY ISCLOSED ISRING ISCOLLECTION NUMGEOMETRIES STARTPOINT ENDPOINT POINTN MAKELINE MAKEPOLYGON CENTROID CONTAINS COVERS WITHIN COVEREDBY INTERSECTS DISJOINT EQUALS AZIMUTH GEOHASH GEOGPOINTFROMGEOHASH SNAPTOGRID BOUNDINGBOX CONVEXHULL EXTERIORRING DUMPPOINTS MAXDISTANCE LINEINTERPOLATEPOINT LINELOCATEPOINT ASBINARY GEOGFROMWKB ASKML GEOGFROMKML GEOGFROM SIMPLIFY HAUSDORFFDISTANCE HAUSDORFFDWITHIN CLOSESTPOINT BUFFER BUFFERWITHTOLERANCE LINESUBSTRING TOUCHES BOUNDARY ANGLE INTERSECTSBOX ENVELOPE MAKEPOLYGONORIENTED INTERIORRINGS DUMP GEOMETRYN".split()}
GEOGRAPHY["S2_CELLIDFROMPOINT"] = ("lk_st_s2cell({0})", "lk_st_s2cell({0}, {1})")
#: Aggregates over points: centroid and extent.
GEOGRAPHY["ST_CENTROID_AGG"] = "lk_st_geogpoint(avg(lk_st_x(lk_st_centroid({0}))), avg(lk_st_y(lk_st_centroid({0}))))"
GEOGRAPHY["ST_EXTENT"] = "named_struct('xmin', min(lk_st_boundingbox({0}).xmin), 'ymin', min(lk_st_boundingbox({0}).ymin), 'xmax', max(lk_st_boundingbox({0}).xmax), 'ymax', max(lk_st_boundingbox({0}).ymax))"
#: Functions that ask a service: they exist once the session has a function registered under their name.
SERVICES = frozenset("AI.CLASSIFY AI.IF AI.SCORE AI.GENERATE ML.PREDICT OBJ.FETCH_METADATA OBJ.GET_READ_URL OBJ.GET_ACCESS_URL EXTERNAL_QUERY ST_REGIONSTATS".split())
SNIPPET = {
    "SNIPPET": "to_json(named_struct('snippets', if(contains(lower({0}), lower({1})), array(named_struct('snippet', substring({0}, greatest(instr(lower({0}), lower({1})) - 40, 1), 80 + length({1})))), array())))",
}

SEARCH = {
    "TOKENIZE_NUMBER": "array(CAST({0} AS STRING))", "TOKENIZE_BOOL": "array(if({0}, 'y', 'n'))", "DEBUG_TOKENLIST": "array_join({0}, ', ')", "SCORE": "double(size(filter({0}, __t -> array_contains(split(lower({1}), '[^\\\\p{{L}}\\\\p{{N}}]+'), __t))))",
    "SEARCH_NGRAMS": "arrays_overlap({0}, transform(sequence(1, greatest(length({1}) - 3, 1)), __i -> substring(lower({1}), __i, 4)))", "SCORE_NGRAMS": "(double(size(array_intersect({0}, transform(sequence(1, greatest(length({1}) - 3, 1)), __i -> substring(lower({1}), __i, 4))))) / greatest(length({1}) - 3, 1))",
}
SEARCH["SCORE"] = SEARCH["SCORE"].replace("{{", "{").replace("}}", "}")

SCALARS = MATH | STRING | ARRAY | HASH | CONDITIONAL | DATES | JSON | NET | RANGES | GEOGRAPHY | KEYSETS | SEARCH | SNIPPET

#: SAFE.f(...) where f can raise.
SAFE = {
    "LN": "if({0} <= 0, NULL, ln({0}))", "LOG": "if({0} <= 0, NULL, ln({0}))", "LOG10": "if({0} <= 0, NULL, log10({0}))", "SQRT": "if({0} < 0, NULL, sqrt({0}))", "DIV": "if({1} = 0, NULL, {0} div {1})", "MOD": "try_mod({0}, {1})", "ACOS": "if(abs({0}) > 1, NULL, acos({0}))", "ASIN": "if(abs({0}) > 1, NULL, asin({0}))", "COT": "if({0} = 0, NULL, cot({0}))", "CSC": "if({0} = 0, NULL, csc({0}))", "ATANH": "if(abs({0}) >= 1, NULL, atanh({0}))", "ACOSH": "if({0} < 1, NULL, acosh({0}))",
    "SUBSTR": ("(CASE WHEN {1} < 0 AND -{1} > length({0}) THEN {0} ELSE substring({0}, int({1})) END)", "if({2} < 0, NULL, substring({0}, int(if({1} = 0, 1, {1})), int({2})))"), "LEFT": "if({1} < 0, NULL, left({0}, int({1})))", "RIGHT": "if({1} < 0, NULL, right({0}, int({1})))", "REPEAT": "if({1} < 0, NULL, repeat({0}, int({1})))", "PARSE_JSON": "try_parse_json({0})", "FROM_HEX": "try_to_binary({0}, 'hex')", "FROM_BASE64": "try_to_binary({0}, 'base64')", "ARRAY_FIRST": "try_element_at({0}, 1)", "ARRAY_LAST": "try_element_at({0}, -1)", "ERROR": "nullif({0}, {0})",
    "INT64": "try_variant_get({0}, '$', 'bigint')", "FLOAT64": "try_variant_get({0}, '$', 'double')", "BOOL": "try_variant_get({0}, '$', 'boolean')", "EXP": "if({0} > 709.782712893384 AND {0} < double('Infinity'), NULL, exp({0}))", "NET.IP_FROM_STRING": "lk_ip_from_string({0}, true)", "RANGE": "if({0} >= {1}, NULL, named_struct('start', {0}, 'end', {1}))", "TIMESTAMP_SECONDS": "timestamp_seconds({0})",
}
SAFE["SUBSTRING"] = SAFE["SUBSTR"]
