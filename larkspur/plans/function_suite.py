"""Registered queries that exercise functions over whole tables, by family: dialect SQL and the DuckDB SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sql.session import Session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (dialect SQL, DuckDB SQL); None: the dialect SQL is DuckDB SQL as well.
DATES: dict[str, tuple[str, str | None]] = {
    "date_arithmetic": (
        "SELECT o_orderkey, DATE_SUB(DATE(o_orderdate), INTERVAL 3 MONTH) AS a, DATE_ADD(DATE(o_orderdate), INTERVAL 2 WEEK) AS b, DATE_FROM_UNIX_DATE(UNIX_DATE(DATE(o_orderdate)) + 1) AS c, PARSE_DATE('%Y%m%d', FORMAT_DATE('%Y%m%d', DATE(o_orderdate))) AS d, EXTRACT(ISOYEAR FROM DATE(o_orderdate)) AS e, EXTRACT(DAYOFWEEK FROM DATE(o_orderdate)) AS f, DATE_TRUNC(DATE(o_orderdate), QUARTER) AS g, DATE_BUCKET(DATE(o_orderdate), INTERVAL 7 DAY) AS h, LAST_DAY(DATE(o_orderdate), YEAR) AS i FROM orders",
        "SELECT o_orderkey, (d - INTERVAL 3 MONTH)::DATE AS a, d + 14 AS b, d + 1 AS c, d, isoyear(d) AS e, dayofweek(d) + 1 AS f, date_trunc('quarter', d)::DATE AS g, time_bucket(INTERVAL 7 DAY, d, DATE '1950-01-01') AS h, make_date(year(d), 12, 31) AS i FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
    ),
    "datetime_arithmetic": (
        "SELECT event_id, DATETIME_ADD(ts, INTERVAL 90 MINUTE) AS a, DATETIME_SUB(ts, INTERVAL 1 DAY) AS b, DATETIME_TRUNC(ts, HOUR) AS c, FORMAT_DATETIME('%Y-%m-%d %H:%M', ts) AS d, PARSE_DATETIME('%Y-%m-%d %H:%M', FORMAT_DATETIME('%Y-%m-%d %H:%M', ts)) AS e, DATETIME(EXTRACT(YEAR FROM ts), 2, 3, 4, 5, 6) AS f, DATETIME(DATE(ts), TIME(ts)) = ts AS g, EXTRACT(HOUR FROM ts) AS h, DATETIME_DIFF(ts, DATETIME '2024-01-01 00:00:00', SECOND) AS i FROM events",
        "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 1 DAY AS b, date_trunc('hour', ts) AS c, strftime(ts, '%Y-%m-%d %H:%M') AS d, date_trunc('minute', ts) AS e, make_timestamp(year(ts), 2, 3, 4, 5, 6) AS f, true AS g, hour(ts) AS h, date_diff('second', TIMESTAMP '2024-01-01', ts) AS i FROM events",
    ),
    "timestamp_functions": (
        "SELECT event_id, UNIX_MICROS(TIMESTAMP(ts)) AS a, UNIX_MILLIS(TIMESTAMP(ts)) AS b, UNIX_SECONDS(TIMESTAMP(ts)) AS c, UNIX_MICROS(TIMESTAMP_ADD(TIMESTAMP(ts), INTERVAL 5 HOUR)) AS d, UNIX_MICROS(TIMESTAMP_SUB(TIMESTAMP(ts), INTERVAL 30 SECOND)) AS e, UNIX_MICROS(TIMESTAMP_TRUNC(TIMESTAMP(ts), MINUTE)) AS f, FORMAT_TIMESTAMP('%F %T', TIMESTAMP(ts)) AS g, UNIX_SECONDS(PARSE_TIMESTAMP('%F %T', FORMAT_TIMESTAMP('%F %T', TIMESTAMP(ts)))) AS h, TIMESTAMP_DIFF(TIMESTAMP(ts), TIMESTAMP '2024-01-01 00:00:00+00', MILLISECOND) AS i, UNIX_MICROS(TIMESTAMP_BUCKET(TIMESTAMP(ts), INTERVAL 15 MINUTE)) AS j, EXTRACT(MINUTE FROM TIMESTAMP(ts)) AS k, SUBSTR(STRING(TIMESTAMP_TRUNC(TIMESTAMP(ts), SECOND)), 1, 19) AS l FROM events",
        "SELECT event_id, epoch_us(ts) AS a, epoch_us(ts) // 1000 AS b, epoch_us(ts) // 1000000 AS c, epoch_us(ts + INTERVAL 5 HOUR) AS d, epoch_us(ts - INTERVAL 30 SECOND) AS e, epoch_us(date_trunc('minute', ts)) AS f, strftime(ts, '%Y-%m-%d %H:%M:%S') AS g, epoch_us(ts) // 1000000 AS h, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS i, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1950-01-01')) AS j, minute(ts) AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS l FROM events",
    ),
    "timestamp_from_epoch": (
        "SELECT event_id, UNIX_MICROS(TIMESTAMP_SECONDS(event_id)) AS a, UNIX_MICROS(TIMESTAMP_MILLIS(event_id)) AS b, UNIX_MICROS(TIMESTAMP_MICROS(event_id)) AS c, UNIX_MICROS(TIMESTAMP_FROM_UNIX_SECONDS(event_id)) AS d, UNIX_MICROS(TIMESTAMP_FROM_UNIX_MILLIS(event_id)) AS e, UNIX_MICROS(TIMESTAMP_FROM_UNIX_MICROS(event_id)) AS f, UNIX_MICROS(FROM_UNIXTIME(event_id)) AS g, UNIX_TIMESTAMP(ts) AS h FROM events",
        "SELECT event_id, event_id * 1000000 AS a, event_id * 1000 AS b, event_id AS c, event_id * 1000000 AS d, event_id * 1000 AS e, event_id AS f, event_id * 1000000 AS g, epoch_us(ts) // 1000000 AS h FROM events",
    ),
    "time_functions": (
        "SELECT event_id, FORMAT_TIME('%H:%M:%S', TIME(ts)) AS a, FORMAT_TIME('%H:%M:%S', TIME_ADD(TIME(ts), INTERVAL 2 HOUR)) AS b, FORMAT_TIME('%H:%M:%S', TIME_SUB(TIME(ts), INTERVAL 45 MINUTE)) AS c, TIME_DIFF(TIME(ts), TIME '00:00:00', MINUTE) AS d, FORMAT_TIME('%H:%M', TIME_TRUNC(TIME(ts), HOUR)) AS e, PARSE_TIME('%H:%M:%S', FORMAT_TIME('%H:%M:%S', TIME(ts))) = TIME_TRUNC(TIME(ts), SECOND) AS f, FORMAT_TIME('%H:%M:%S', TIME(1, 2, 3)) AS g, EXTRACT(MINUTE FROM TIME(ts)) AS h FROM events",
        "SELECT event_id, strftime(ts, '%H:%M:%S') AS a, strftime(ts + INTERVAL 2 HOUR, '%H:%M:%S') AS b, strftime(ts - INTERVAL 45 MINUTE, '%H:%M:%S') AS c, hour(ts) * 60 + minute(ts) AS d, strftime(ts, '%H:00') AS e, true AS f, '01:02:03' AS g, minute(ts) AS h FROM events",
    ),
    "date_parts_short": (
        "SELECT o_orderkey, DAY(d) AS a, DAYOFMONTH(d) AS b, DAYOFWEEK(d) AS c, DAYOFYEAR(d) AS e, DAYNAME(d) AS f, MONTHNAME(d) AS g, MONTH(d) AS h, QUARTER(d) AS i, YEAR(d) AS j, WEEKDAY(d) AS k, WEEKOFYEAR(d) AS l, WEEK(d) AS m FROM (SELECT o_orderkey, DATE(o_orderdate) AS d FROM orders)",
        "SELECT o_orderkey, day(d) AS a, day(d) AS b, dayofweek(d) + 1 AS c, dayofyear(d) AS e, dayname(d) AS f, monthname(d) AS g, month(d) AS h, quarter(d) AS i, year(d) AS j, isodow(d) - 1 AS k, weekofyear(d) AS l, strftime(d, '%U')::INT AS m FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
    ),
    "date_short_arithmetic": (
        "SELECT o_orderkey, ADDDATE(d, 10) AS a, SUBDATE(d, 10) AS b, DATEDIFF(d, DATE '1995-06-01') AS c, MAKEDATE(YEAR(d), DAYOFYEAR(d)) AS e, TO_DAYS(d) - TO_DAYS(DATE '1970-01-01') AS f, FROM_DAYS(TO_DAYS(d)) AS g, DATE_FORMAT(o_orderdate, '%Y/%m/%d') AS h, STR_TO_DATE(FORMAT_DATE('%Y-%m-%d', d), '%Y-%m-%d') AS i, PERIOD_ADD(YEAR(d) * 100 + MONTH(d), 5) AS j, PERIOD_DIFF(YEAR(d) * 100 + MONTH(d), 199001) AS k FROM (SELECT o_orderkey, o_orderdate, DATE(o_orderdate) AS d FROM orders)",
        "SELECT o_orderkey, d + 10 AS a, d - 10 AS b, d - DATE '1995-06-01' AS c, d AS e, d - DATE '1970-01-01' AS f, d AS g, strftime(d, '%Y/%m/%d') AS h, d::TIMESTAMP AS i, strftime(d + INTERVAL 5 MONTH, '%Y%m')::INT AS j, (year(d) - 1990) * 12 + month(d) - 1 AS k FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
    ),
    "time_parts_short": (
        "SELECT event_id, HOUR(ts) AS a, MINUTE(ts) AS b, SECOND(ts) AS c, MICROSECOND(ts) AS d, TO_SECONDS(ts) - TO_SECONDS(DATETIME '1970-01-01 00:00:00') AS e FROM events",
        "SELECT event_id, hour(ts) AS a, minute(ts) AS b, second(ts) AS c, epoch_us(ts) % 1000000 AS d, epoch_us(ts) // 1000000 AS e FROM events",
    ),
    "current_moment": (
        "SELECT n_nationkey, CURRENT_DATE() = UTC_DATE() AS a, CURRENT_TIMESTAMP() = NOW() AS b, CURRENT_DATETIME() <= DATETIME '2999-01-01 00:00:00' AS c, CURRENT_TIME() <= TIME '23:59:59.999999' AS d, LOCALTIME() = LOCALTIMESTAMP() AS e, SYSDATE() = UTC_TIMESTAMP() AS f, PENDING_COMMIT_TIMESTAMP() = CURRENT_TIMESTAMP() AS g, UNIX_TIMESTAMP() >= 1700000000 AS h, RAND() < 1 AS i, LENGTH(GENERATE_UUID()) AS j, SESSION_USER() IS NOT NULL AS k FROM nation",
        "SELECT n_nationkey, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, 36 AS j, true AS k FROM nation",
    ),
    "timestamp_arrays": (
        "SELECT o_orderkey, ARRAY_LENGTH(GENERATE_TIMESTAMP_ARRAY(TIMESTAMP(o_orderdate), TIMESTAMP_ADD(TIMESTAMP(o_orderdate), INTERVAL 1 DAY), INTERVAL 6 HOUR)) AS a, ARRAY_LENGTH(GENERATE_DATE_ARRAY(DATE(o_orderdate), DATE_ADD(DATE(o_orderdate), INTERVAL 1 MONTH), INTERVAL 1 WEEK)) AS b FROM orders",
        "SELECT o_orderkey, 5 AS a, ((o_orderdate + INTERVAL 1 MONTH)::DATE - o_orderdate::DATE) // 7 + 1 AS b FROM orders",
    ),
    "interval_functions": (
        "SELECT o_orderkey, EXTRACT(DAY FROM JUSTIFY_HOURS(MAKE_INTERVAL(hour => k))) AS a, EXTRACT(HOUR FROM JUSTIFY_HOURS(MAKE_INTERVAL(hour => k))) AS b, EXTRACT(MONTH FROM JUSTIFY_DAYS(MAKE_INTERVAL(day => k))) AS c, EXTRACT(DAY FROM JUSTIFY_DAYS(MAKE_INTERVAL(day => k))) AS d, EXTRACT(MONTH FROM JUSTIFY_INTERVAL(MAKE_INTERVAL(day => 29, hour => k))) AS e, EXTRACT(DAY FROM JUSTIFY_INTERVAL(MAKE_INTERVAL(day => 29, hour => k))) AS f, EXTRACT(HOUR FROM JUSTIFY_INTERVAL(MAKE_INTERVAL(day => 29, hour => k))) AS g FROM (SELECT o_orderkey, MOD(o_orderkey, 200) AS k FROM orders)",
        "SELECT o_orderkey, k // 24 AS a, k % 24 AS b, (k // 30) % 12 AS c, k % 30 AS d, ((29 + k // 24) // 30) % 12 AS e, (29 + k // 24) % 30 AS f, k % 24 AS g FROM (SELECT o_orderkey, o_orderkey % 200 AS k FROM orders)",
    ),
}

STRINGS: dict[str, tuple[str, str | None]] = {
    "string_lengths": (
        "SELECT doc_id, BYTE_LENGTH(text) AS a, CHAR_LENGTH(text) AS b, CHARACTER_LENGTH(text) AS c, OCTET_LENGTH(text) AS d, BIT_LENGTH(text) AS e FROM documents",
        "SELECT doc_id, strlen(text) AS a, length(text) AS b, length(text) AS c, strlen(text) AS d, strlen(text) * 8 AS e FROM documents",
    ),
    "string_cutting": (
        "SELECT doc_id, LEFT(text, 7) AS a, RIGHT(text, 5) AS b, SUBSTRING(text, 3, 4) AS c, MID(text, 2, 3) AS d, LOWER(LEFT(text, 20)) AS e, UCASE(source) AS f, LCASE(source) AS g, LTRIM('xx' || source, 'x') AS h, RTRIM(source || '  ') AS i, RPAD(source, 8, '*') AS j, TRANSLATE(source, 'src', 'abc') AS k, INITCAP(LOWER(lang)) AS l, UNICODE(text) AS m FROM documents",
        "SELECT doc_id, left(text, 7) AS a, right(text, 5) AS b, substring(text, 3, 4) AS c, substring(text, 2, 3) AS d, lower(left(text, 20)) AS e, upper(source) AS f, lower(source) AS g, ltrim('xx' || source, 'x') AS h, source AS i, rpad(source, 8, '*') AS j, translate(source, 'src', 'abc') AS k, upper(lang[1]) || lower(lang[2:]) AS l, greatest(unicode(text), 0) AS m FROM documents",
    ),
    "string_search": (
        "SELECT doc_id, ENDS_WITH(source, '1') AS a, INSTR(source, 'r') AS b, INSTR('banana', 'a', 1, 2) AS c, LOCATE('c', source) AS d, POSITION('s' IN source) AS e, CONTAINS_SUBSTR(source, 'SRC') AS f, STRCMP(source, 'src1') AS g, SUBSTRING_INDEX('a.b.c', '.', 2) AS h, EDIT_DISTANCE(source, 'src0') AS i, SOUNDEX('Robert') AS j, SPLIT_SUBSTR('a.b.c', '.', 2, 1) AS k FROM documents",
        "SELECT doc_id, source LIKE '%1' AS a, strpos(source, 'r') AS b, 4 AS c, strpos(source, 'c') AS d, strpos(source, 's') AS e, source LIKE '%src%' AS f, CASE WHEN source < 'src1' THEN -1 WHEN source > 'src1' THEN 1 ELSE 0 END AS g, 'a.b' AS h, levenshtein(source, 'src0') AS i, 'R163' AS j, 'b' AS k FROM documents",
    ),
    "string_encodings": (
        "SELECT doc_id, TO_BASE64(CAST(source AS BYTES)) AS a, CAST(FROM_BASE64(TO_BASE64(CAST(lang AS BYTES))) AS STRING) AS b, CAST(FROM_HEX(TO_HEX(CAST(source AS BYTES))) AS STRING) AS c, HEX(source) AS d, CAST(UNHEX(HEX(source)) AS STRING) AS e, TO_BASE32(CAST('abc' AS BYTES)) AS f, CAST(FROM_BASE32(TO_BASE32(CAST(source AS BYTES))) AS STRING) AS g, CODE_POINTS_TO_STRING(TO_CODE_POINTS(LEFT(text, 9))) AS h, TO_HEX(CODE_POINTS_TO_BYTES([65, 255])) AS i, CHR(65 + MOD(doc_id, 26)) AS j, SAFE_CONVERT_BYTES_TO_STRING(CAST(source AS BYTES)) AS k, CHAR(97) AS l, ORD('a') AS m, OCT(doc_id) AS n, QUOTE('it') AS o FROM documents",
        "SELECT doc_id, base64(encode(source)) AS a, lang AS b, source AS c, hex(source) AS d, source AS e, 'MFRGG===' AS f, source AS g, left(text, 9) AS h, '41ff' AS i, chr((65 + doc_id % 26)::INT) AS j, source AS k, 'a' AS l, 97 AS m, printf('%o', doc_id) AS n, '''it''' AS o FROM documents",
    ),
    "string_normal_forms": (
        "SELECT doc_id, NORMALIZE(LEFT(text, 60)) AS a, NORMALIZE(LEFT(text, 60), NFD) = NORMALIZE(NORMALIZE(LEFT(text, 60)), NFD) AS b, NORMALIZE_AND_CASEFOLD('Straße') AS c, COLLATE(lang, 'und:ci') = UPPER(lang) AS d FROM documents",
        "SELECT doc_id, nfc_normalize(left(text, 60)) AS a, true AS b, 'strasse' AS c, true AS d FROM documents",
    ),
    "string_building": (
        "SELECT p_partkey, CONCAT_WS('-', p_brand, p_type) AS a, p_brand || '/' || p_name AS b, INSERT(p_brand, 1, 5, 'X') AS c, CONCAT('[', SPACE(2), ']') AS d, FORMAT('%d|%s|%5.1f|%05d', p_size, p_type, p_retailprice, p_partkey) AS e, REPEAT(p_type, 2) AS f FROM part",
        "SELECT p_partkey, concat_ws('-', p_brand, p_type) AS a, p_brand || '/' || p_name AS b, 'X' || substring(p_brand, 6) AS c, '[  ]' AS d, printf('%d|%s|%5.1f|%05d', p_size, p_type, p_retailprice, p_partkey) AS e, repeat(p_type, 2) AS f FROM part",
    ),
    "regexp_more": (
        "SELECT c_custkey, REGEXP_EXTRACT_ALL(c_name, r'0{2}')[SAFE_OFFSET(0)] AS a, REGEXP_INSTR(c_name, r'#') AS b, REGEXP_SUBSTR(c_name, r'[1-9]\\d*') AS c, REGEXP_EXTRACT_GROUPS(c_name, r'(?P<word>[A-Za-z]+)#(?P<num>\\d+)').num AS d, REGEXP_LIKE(c_name, r'9$') AS e, REGEXP_MATCH(c_mktsegment, r'[A-Z]+') AS f FROM customer",
        "SELECT c_custkey, CASE WHEN c_name LIKE '%00%' THEN '00' END AS a, strpos(c_name, '#') AS b, nullif(regexp_extract(c_name, '[1-9]\\d*'), '') AS c, regexp_extract(c_name, '#(\\d+)', 1) AS d, c_name LIKE '%9' AS e, regexp_full_match(c_mktsegment, '[A-Z]+') AS f FROM customer",
    ),
    "like_quantified": (
        "SELECT c_mktsegment LIKE ANY ('B%', '%Y') AS a, c_mktsegment LIKE ALL ('%E%', '%L%') AS b, c_mktsegment NOT LIKE 'A%' AS c, COUNT(*) AS n FROM customer GROUP BY a, b, c",
        "SELECT c_mktsegment LIKE 'B%' OR c_mktsegment LIKE '%Y' AS a, c_mktsegment LIKE '%E%' AND c_mktsegment LIKE '%L%' AS b, c_mktsegment NOT LIKE 'A%' AS c, count(*) AS n FROM customer GROUP BY 1, 2, 3",
    ),
    "trimmed_lines": (
        "SELECT doc_id, o, TRIM(line) AS t FROM documents, UNNEST(SPLIT(text, '\\n')) AS line WITH OFFSET AS o",
        "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS o, trim(unnest(string_split(text, chr(10))), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM documents",
    ),
}

MATH: dict[str, tuple[str, str | None]] = {
    "trigonometry": (
        "SELECT l_orderkey, l_linenumber, l_partkey, ROUND(SIN(x), 8) AS a, ROUND(COS(x), 8) AS b, ROUND(TAN(x), 6) AS c, ROUND(ASIN(y), 8) AS d, ROUND(ACOS(y), 8) AS e, ROUND(ATAN(x), 8) AS f, ROUND(ATAN2(x, y + 1), 8) AS g, ROUND(COT(x), 6) AS h, ROUND(CSC(x), 6) AS i, ROUND(SEC(y), 8) AS j, ROUND(DEGREES(y), 6) AS k, ROUND(RADIANS(x), 8) AS l FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount AS y FROM lineitem)",
        "SELECT l_orderkey, l_linenumber, l_partkey, round(sin(x), 8) AS a, round(cos(x), 8) AS b, round(tan(x), 6) AS c, round(asin(y), 8) AS d, round(acos(y), 8) AS e, round(atan(x), 8) AS f, round(atan2(x, y + 1), 8) AS g, round(cot(x), 6) AS h, round(1 / sin(x), 6) AS i, round(1 / cos(y), 8) AS j, round(degrees(y), 6) AS k, round(radians(x), 8) AS l FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount AS y FROM lineitem)",
    ),
    "hyperbolic": (
        "SELECT p_partkey, ROUND(SINH(x), 4) AS a, ROUND(COSH(x), 4) AS b, ROUND(TANH(x), 8) AS c, ROUND(ASINH(x), 8) AS d, ROUND(ACOSH(x), 8) AS e, ROUND(ATANH(1 / (x + 1)), 8) AS f, ROUND(COTH(x), 8) AS g, ROUND(CSCH(x), 8) AS h, ROUND(SECH(x), 8) AS i FROM (SELECT p_partkey, 1 + p_size / 10 AS x FROM part)",
        "SELECT p_partkey, round(sinh(x), 4) AS a, round(cosh(x), 4) AS b, round(tanh(x), 8) AS c, round(asinh(x), 8) AS d, round(acosh(x), 8) AS e, round(atanh(1 / (x + 1)), 8) AS f, round(1 / tanh(x), 8) AS g, round(1 / sinh(x), 8) AS h, round(1 / cosh(x), 8) AS i FROM (SELECT p_partkey, 1 + p_size / 10 AS x FROM part)",
    ),
    "powers_and_logs": (
        "SELECT p_partkey, ROUND(EXP(x / 10), 4) AS a, ROUND(LOG(x, 3), 8) AS b, ROUND(LOG10(x), 8) AS c, ROUND(LOG2(x), 8) AS d, ROUND(CBRT(x), 8) AS e, POWER(x, 2) AS f, CEILING(p_retailprice) AS g, ROUND(PI(), 6) AS h, LEAST(x, 10, 20) AS i, TRUNC(p_retailprice / 7, 2) AS j, TRUNCATE(p_retailprice / 7, 1) AS k, TRUNC(-p_retailprice / 7) AS l, TRUNC(0.29, 2) AS m FROM (SELECT p_partkey, p_retailprice, p_size + 1 AS x FROM part)",
        "SELECT p_partkey, round(exp(x / 10), 4) AS a, round(ln(x) / ln(3), 8) AS b, round(log10(x), 8) AS c, round(log2(x), 8) AS d, round(cbrt(x), 8) AS e, power(x, 2)::DOUBLE AS f, ceil(p_retailprice) AS g, 3.141593::DOUBLE AS h, least(x, 10, 20) AS i, trunc(round(p_retailprice / 7 * 100, 6)) / 100 AS j, trunc(round(p_retailprice / 7 * 10, 6)) / 10 AS k, trunc(-p_retailprice / 7) AS l, 0.29::DOUBLE AS m FROM (SELECT p_partkey, p_retailprice, p_size + 1 AS x FROM part)",
    ),
    "checked_arithmetic": (
        "SELECT o_orderkey, SAFE_ADD(9223372036854775807, MOD(o_orderkey, 2)) AS a, SAFE_SUBTRACT(o_orderkey, 5) AS b, SAFE_MULTIPLY(4611686018427387904, MOD(o_orderkey, 3)) AS c, SAFE_NEGATE(o_orderkey) AS d, IEEE_DIVIDE(o_totalprice, MOD(o_orderkey, 2)) > 1e300 AS e, IS_INF(IEEE_DIVIDE(1, MOD(o_orderkey, 2))) AS f, IS_NAN(IEEE_DIVIDE(0, MOD(o_orderkey, 2))) AS g, RANGE_BUCKET(o_totalprice, [0.0, 50000.0, 100000.0, 200000.0]) AS h, NULLIFERROR(DIV(1, MOD(o_orderkey, 2))) AS i, ISERROR(DIV(1, MOD(o_orderkey, 2))) AS j FROM orders",
        "SELECT o_orderkey, CASE WHEN k = 0 THEN 9223372036854775807 END AS a, o_orderkey - 5 AS b, CASE WHEN o_orderkey % 3 < 2 THEN 4611686018427387904 * (o_orderkey % 3) END AS c, -o_orderkey AS d, k = 0 AS e, k = 0 AS f, k = 0 AS g, CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 100000 THEN 2 WHEN o_totalprice < 200000 THEN 3 ELSE 4 END AS h, CASE WHEN k = 1 THEN 1 END AS i, k = 0 AS j FROM (SELECT *, o_orderkey % 2 AS k FROM orders)",
    ),
    "numeric_type": (
        "SELECT p_partkey, CAST(PARSE_NUMERIC(CAST(p_retailprice AS STRING)) * NUMERIC '2' AS FLOAT64) AS a, CAST(PARSE_BIGNUMERIC('1,234.5') AS FLOAT64) AS b, CAST(PI_NUMERIC() AS FLOAT64) AS c, CAST(ROUND(CAST(PI_BIGNUMERIC() AS NUMERIC), 6) AS FLOAT64) AS d, CAST(TRUNC(CAST(p_retailprice AS NUMERIC) / 7, 3) AS FLOAT64) AS e, TYPEOF(CEIL(CAST(p_retailprice AS NUMERIC))) AS f, CAST(FLOOR(CAST(p_retailprice AS NUMERIC)) AS FLOAT64) AS g, CAST(ROUND(CAST(p_size AS NUMERIC) / 4, 0, 'ROUND_HALF_EVEN') AS FLOAT64) AS h FROM part",
        "SELECT p_partkey, p_retailprice * 2 AS a, 1234.5::DOUBLE AS b, 3.141592654::DOUBLE AS c, 3.141593::DOUBLE AS d, trunc(round(p_retailprice / 7 * 1000, 5)) / 1000 AS e, 'NUMERIC' AS f, floor(p_retailprice) AS g, round_even(p_size / 4, 0) AS h FROM part",
    ),
    "bit_functions": (
        "SELECT o_orderkey, ~o_orderkey AS a, o_orderkey << 3 AS b, o_orderkey >> 2 AS c, o_orderkey & 12 AS d, o_orderkey | 5 AS e, o_orderkey ^ 9 AS f, BIT_CAST_TO_INT32(4294967295 - o_orderkey) AS g, BIT_CAST_TO_UINT32(-1 - o_orderkey) AS h, BIT_CAST_TO_INT64(o_orderkey) AS i, CAST(BIT_CAST_TO_UINT64(o_orderkey) AS INT64) AS j, BIT_REVERSE(BIT_REVERSE(o_orderkey, true), true) AS k FROM orders",
        "SELECT o_orderkey, ~o_orderkey AS a, o_orderkey << 3 AS b, o_orderkey >> 2 AS c, o_orderkey & 12 AS d, o_orderkey | 5 AS e, xor(o_orderkey, 9) AS f, -1 - o_orderkey AS g, 4294967295 - o_orderkey AS h, o_orderkey AS i, o_orderkey AS j, o_orderkey AS k FROM orders",
    ),
    "hash_more": (
        "SELECT doc_id, TO_HEX(SHA512(text)) = SHA2(text, 512) AS a, SHA2(text, 256) AS b, FARM_FINGERPRINT('foo') AS c, ZSTD_DECOMPRESS_TO_STRING(ZSTD_COMPRESS(text)) = text AS d, ZSTD_DECOMPRESS_TO_BYTES(ZSTD_COMPRESS(text)) = CAST(text AS BYTES) AS e FROM documents WHERE text IS NOT NULL",
        "SELECT doc_id, true AS a, sha256(text) AS b, 6150913649986995171 AS c, true AS d, true AS e FROM documents WHERE text IS NOT NULL",
    ),
    "vector_more": (
        "SELECT vec_id, ROUND(DOT_PRODUCT(embedding, embedding), 4) AS a, ROUND(APPROX_DOT_PRODUCT(embedding, embedding), 4) AS b, ROUND(APPROX_COSINE_DISTANCE(embedding, embedding), 4) + 0.0 AS c, ROUND(APPROX_EUCLIDEAN_DISTANCE(embedding, embedding), 4) AS d FROM embeddings",
        "SELECT vec_id, round(list_inner_product(e, e), 4) AS a, round(list_inner_product(e, e), 4) AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    ),
}


ARRAYS: dict[str, tuple[str, str | None]] = {
    "array_reductions": (
        "SELECT vec_id, ROUND(ARRAY_AVG(embedding), 5) AS a, ROUND(ARRAY_MAX(embedding), 6) AS b, ROUND(ARRAY_MIN(embedding), 6) AS c, ARRAY_IS_DISTINCT(embedding) AS d, ROUND(ARRAY_FIRST(embedding), 6) AS e, ROUND(ARRAY_LAST(embedding), 6) AS f, ARRAY_LENGTH(ARRAY_CONCAT(embedding, embedding)) AS g FROM embeddings",
        "SELECT vec_id, round(list_avg(e), 5) AS a, round(list_max(e), 6) AS b, round(list_min(e), 6) AS c, len(list_distinct(e)) = len(e) AS d, round(e[1], 6) AS e, round(e[-1], 6) AS f, 2 * len(e) AS g FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    ),
    "unnest_together": (
        "SELECT p_partkey, a, b FROM part, UNNEST([p_size, 1] AS a, [10, 20, 30] AS b)",
        "SELECT p_partkey, unnest([p_size, 1, NULL]) AS a, unnest([10, 20, 30]) AS b FROM part",
    ),
    "array_tests": (
        "SELECT p_partkey, ARRAY_INCLUDES([p_size, 3], 3) AS a, ARRAY_INCLUDES([p_size, 3], x -> x > 40) AS b, ARRAY_INCLUDES_ALL([p_size, 3, 4], [3, 4]) AS c, ARRAY_INCLUDES_ANY([p_size, 7], [1, 2, 3]) AS d, ARRAY_TO_STRING(ARRAY(SELECT CAST(x AS STRING) FROM UNNEST(FLATTEN([[p_size], [1, 2]])) AS x WITH OFFSET AS o ORDER BY o), ',') AS e, ARRAY_LENGTH(ARRAY_SLICE([p_size, 1, 2, 3], 1, 2)) AS f, [p_size, 9][ORDINAL(2)] AS g, [p_size, 9][SAFE_OFFSET(5)] AS h, [p_size, 9][SAFE_ORDINAL(1)] AS i, [p_size, 9][0] AS j FROM part",
        "SELECT p_partkey, true AS a, p_size > 40 AS b, true AS c, p_size IN (1, 2, 3) AS d, p_size || ',1,2' AS e, 2 AS f, 9 AS g, NULL::INT AS h, p_size AS i, p_size AS j FROM part",
    ),
    "array_concat_agg": (
        "SELECT p_brand, ARRAY_LENGTH(ARRAY_CONCAT_AGG([p_size, 1])) AS n, MIN(p_retailprice) AS lo, ARRAY_LENGTH(ARRAY_AGG(p_size IGNORE NULLS)) AS k FROM part GROUP BY p_brand",
        "SELECT p_brand, 2 * count(*) AS n, min(p_retailprice) AS lo, count(*) AS k FROM part GROUP BY 1",
    ),
    "array_agg_events": (
        "SELECT user_id, ARRAY_TO_STRING(ARRAY_AGG(event_type ORDER BY ts LIMIT 5), ',') AS first_types, STRING_AGG(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
        "SELECT user_id, array_to_string(list(event_type ORDER BY ts)[:5], ',') AS first_types, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1",
    ),
    "unnest_several": (
        "SELECT p_partkey, z.x AS a, z.y AS b FROM part, UNNEST(ARRAY_ZIP([p_size, 1] AS x, [10, 20] AS y)) AS z",
        "SELECT p_partkey, unnest([p_size, 1]) AS a, unnest([10, 20]) AS b FROM part",
    ),
}

JSON: dict[str, tuple[str, str | None]] = {
    "json_numbers": (
        "SELECT event_id, INT64(j.k) AS a, FLOAT64(j.k) AS b, DOUBLE(j.k) AS c, FLOAT(j.k) AS d, FLOAT32(j.k) AS e, INT32(j.k) AS f, UINT32(j.k) AS g, CAST(UINT64(j.k) AS INT64) AS h, LAX_INT64(j.k) AS i, LAX_FLOAT64(j.k) AS l, LAX_DOUBLE(j.k) AS m, LAX_FLOAT(j.k) AS n, LAX_INT32(j.k) AS o, LAX_UINT32(j.k) AS p, CAST(LAX_UINT64(j.k) AS INT64) AS q, LAX_STRING(j.k) AS r, JSON_TYPE(j.k) AS s FROM (SELECT event_id, PARSE_JSON(props) AS j FROM events WHERE props LIKE '%\"k\"%')",
        "SELECT event_id, k AS a, k::DOUBLE AS b, k::DOUBLE AS c, k::DOUBLE AS d, k::DOUBLE AS e, k AS f, k AS g, k AS h, k AS i, k::DOUBLE AS l, k::DOUBLE AS m, k::DOUBLE AS n, k AS o, k AS p, k AS q, k::VARCHAR AS r, 'number' AS s FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props LIKE '%\"k\"%')",
    ),
    "json_arrays": (
        "SELECT event_id, INT64_ARRAY(j)[0] AS a, FLOAT64_ARRAY(j)[1] AS b, DOUBLE_ARRAY(j)[1] AS c, FLOAT_ARRAY(j)[0] AS d, FLOAT32_ARRAY(j)[0] AS e, INT32_ARRAY(j)[0] AS f, UINT32_ARRAY(j)[0] AS g, CAST(UINT64_ARRAY(j)[0] AS INT64) AS h, ARRAY_LENGTH(LAX_INT64_ARRAY(j)) AS i, LAX_FLOAT64_ARRAY(j)[0] AS k, LAX_DOUBLE_ARRAY(j)[0] AS l, LAX_FLOAT_ARRAY(j)[0] AS m, LAX_INT32_ARRAY(j)[1] AS n, LAX_UINT32_ARRAY(j)[1] AS o, CAST(LAX_UINT64_ARRAY(j)[1] AS INT64) AS p, LAX_STRING_ARRAY(j)[0] AS q, STRING_ARRAY(JSON_ARRAY('x', event_type))[1] AS r, BOOL_ARRAY(JSON_ARRAY(true, user_id > 5))[1] AS s, LAX_BOOL_ARRAY(JSON_ARRAY(true))[0] AS t FROM (SELECT event_id, event_type, user_id, JSON_ARRAY(user_id, event_id) AS j FROM events)",
        "SELECT event_id, user_id AS a, event_id::DOUBLE AS b, event_id::DOUBLE AS c, user_id::DOUBLE AS d, user_id::DOUBLE AS e, user_id AS f, user_id AS g, user_id AS h, 2 AS i, user_id::DOUBLE AS k, user_id::DOUBLE AS l, user_id::DOUBLE AS m, event_id AS n, event_id AS o, event_id AS p, user_id::VARCHAR AS q, event_type AS r, user_id > 5 AS s, true AS t FROM events",
    ),
    "json_extraction": (
        "SELECT event_id, JSON_EXTRACT_SCALAR(t, '$.u') AS a, JSON_EXTRACT(t, '$.l') AS b, JSON_QUERY(t, '$.l[1]') AS c, JSON_EXTRACT_ARRAY(t, '$.l')[0] AS d, JSON_QUERY_ARRAY(t, '$.l')[1] AS e, JSON_EXTRACT_STRING_ARRAY(t, '$.s')[0] AS f, JSON_VALUE_ARRAY(t, '$.s')[1] AS g, JSON_VALUE(t, '$.l') AS h, JSON_VALUE(t, '$.o.p') AS i, JSON_PATH_EXISTS(PARSE_JSON(t), '$.o') AS j, JSON_PATH_EXISTS(PARSE_JSON(t), '$.zz') AS k FROM (SELECT event_id, CONCAT('{\"u\": ', CAST(user_id AS STRING), ', \"l\": [1, ', CAST(event_id AS STRING), '], \"s\": [\"x\", \"', event_type, '\"], \"o\": {\"p\": \"{q\"}}') AS t FROM events)",
        "SELECT event_id, user_id::VARCHAR AS a, '[1,' || event_id || ']' AS b, event_id::VARCHAR AS c, '1' AS d, event_id::VARCHAR AS e, 'x' AS f, event_type AS g, NULL::VARCHAR AS h, '{q' AS i, true AS j, false AS k FROM events",
    ),
    "json_building": (
        "SELECT event_id, TO_JSON_STRING(JSON_OBJECT('u', user_id, 't', event_type)) AS a, TO_JSON_STRING(JSON_ARRAY(user_id, event_type, NULL)) AS b, TO_JSON_STRING(STRUCT(user_id AS u)) AS c, STRING(TO_JSON(event_type)) AS d, INT64(SAFE_TO_JSON(user_id)) AS e, JSON_QUOTE(event_type) AS f, JSON_UNQUOTE(JSON_QUOTE(event_type)) AS g, BOOL(TO_JSON(user_id > 5)) AS h, LAX_BOOL(JSON 'true') AS i FROM events",
        "SELECT event_id, '{\"t\":\"' || event_type || '\",\"u\":' || user_id || '}' AS a, '[' || user_id || ',\"' || event_type || '\",null]' AS b, '{\"u\":' || user_id || '}' AS c, event_type AS d, user_id AS e, '\"' || event_type || '\"' AS f, event_type AS g, user_id > 5 AS h, true AS i FROM events",
    ),
    "json_editing": (
        "SELECT event_id, TO_JSON_STRING(JSON_SET(j, '$.b', 5)) AS a, TO_JSON_STRING(JSON_REMOVE(j, '$.l')) AS b, TO_JSON_STRING(JSON_STRIP_NULLS(JSON_OBJECT('u', user_id, 'z', NULL))) AS c, TO_JSON_STRING(JSON_ARRAY_APPEND(JSON_ARRAY(user_id), '$', 2)) AS d, TO_JSON_STRING(JSON_ARRAY_INSERT(JSON_ARRAY(user_id), '$[0]', 1)) AS e, JSON_CONTAINS(JSON_ARRAY(user_id, 1), JSON '1') AS f, ARRAY_LENGTH(JSON_FLATTEN(JSON_ARRAY(JSON_ARRAY(user_id, 2), 3))) AS g, ARRAY_TO_STRING(JSON_KEYS(j), ',') AS h FROM (SELECT event_id, user_id, JSON_OBJECT('l', 1, 'u', user_id) AS j FROM events)",
        "SELECT event_id, '{\"b\":5,\"l\":1,\"u\":' || user_id || '}' AS a, '{\"u\":' || user_id || '}' AS b, '{\"u\":' || user_id || '}' AS c, '[' || user_id || ',2]' AS d, '[1,' || user_id || ']' AS e, true AS f, 3 AS g, 'l,u' AS h FROM events",
    ),
    "json_subscripts": (
        "SELECT event_id, INT64(j.u) AS a, INT64(j['u']) AS b, INT64(j.l[1]) AS c FROM (SELECT event_id, PARSE_JSON(CONCAT('{\"u\": ', CAST(user_id AS STRING), ', \"l\": [1, ', CAST(event_id AS STRING), ']}')) AS j FROM events)",
        "SELECT event_id, user_id AS a, user_id AS b, event_id AS c FROM events",
    ),
}

NETWORK: dict[str, tuple[str, str | None]] = {
    "net_addresses": (
        "SELECT user_id, ip, TO_HEX(NET.IP_FROM_STRING(ip)) AS a, NET.IP_TO_STRING(NET.IP_FROM_STRING(ip)) AS b, TO_HEX(NET.SAFE_IP_FROM_STRING(ip)) AS c, NET.SAFE_IP_FROM_STRING('nothing') IS NULL AS d, NET.IPV4_TO_INT64(NET.IP_FROM_STRING(ip)) AS e, NET.IP_TO_STRING(NET.IPV4_FROM_INT64(167772160 + user_id)) AS f, NET.IP_TO_STRING(NET.IP_NET_MASK(4, 24)) AS g, NET.IP_TO_STRING(NET.IP_TRUNC(NET.IP_FROM_STRING(ip), 24)) AS h, NET.IP_IN_NET(ip, '10.0.0.0/24') AS i, NET.FORMAT_IP(167772160 + user_id) AS j, NET.PARSE_IP(ip) AS k, NET.FORMAT_PACKED_IP(NET.PARSE_PACKED_IP(ip)) AS l, NET.MAKE_NET(ip, 24) AS m FROM (SELECT DISTINCT user_id, CONCAT('10.0.', CAST(DIV(user_id, 256) AS STRING), '.', CAST(MOD(user_id, 256) AS STRING)) AS ip FROM events)",
        "SELECT DISTINCT user_id, ip, printf('0a00%02x%02x', user_id // 256, user_id % 256) AS a, ip AS b, printf('0a00%02x%02x', user_id // 256, user_id % 256) AS c, true AS d, 167772160 + user_id AS e, ip AS f, '255.255.255.0' AS g, '10.0.' || (user_id // 256) || '.0' AS h, user_id < 256 AS i, ip AS j, 167772160 + user_id AS k, ip AS l, '10.0.' || (user_id // 256) || '.0/24' AS m FROM (SELECT user_id, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip FROM events)",
    ),
    "inet_functions": (
        "SELECT user_id, INET_ATON(ip) AS a, INET_NTOA(167772160 + user_id) AS b, HEX(INET6_ATON('::1')) AS c, INET6_NTOA(INET6_ATON(ip)) AS d, IS_IPV4(ip) AS e, IS_IPV6(ip) AS f, IS_IPV4_COMPAT(INET6_ATON('::10.0.5.9')) AS g, IS_IPV4_MAPPED(INET6_ATON('::ffff:10.0.5.9')) AS h, IS_UUID('6ccd780c-baba-1026-9564-5b8c656024db') AS i, HEX(UUID_TO_BIN('6ccd780c-baba-1026-9564-5b8c656024db')) AS j, BIN_TO_UUID(UUID_TO_BIN('6ccd780c-baba-1026-9564-5b8c656024db')) AS k FROM (SELECT DISTINCT user_id, CONCAT('10.0.0.', CAST(MOD(user_id, 256) AS STRING)) AS ip FROM events)",
        "SELECT DISTINCT user_id, 167772160 + user_id % 256 AS a, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS b, '00000000000000000000000000000001' AS c, '10.0.0.' || (user_id % 256) AS d, true AS e, false AS f, true AS g, true AS h, true AS i, '6CCD780CBABA102695645B8C656024DB' AS j, '6ccd780c-baba-1026-9564-5b8c656024db' AS k FROM events",
    ),
    "net_domains": (
        "SELECT page_id, NET.HOST(url) AS a, NET.REG_DOMAIN(url) AS b, NET.PUBLIC_SUFFIX(url) AS c FROM pages",
        "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS a, regexp_extract(url, '://[^/]*?([^/.]+\\.[^/.]+)(/|$)', 1) AS b, regexp_extract(url, '://[^/]*\\.([^/.]+)(/|$)', 1) AS c FROM pages",
    ),
}

RANGES: dict[str, tuple[str, str | None]] = {
    "range_functions": (
        "SELECT o_orderkey, RANGE_START(r) AS a, RANGE_END(r) AS b, RANGE_CONTAINS(r, DATE '1995-06-15') AS c, RANGE_OVERLAPS(r, RANGE<DATE> '[1995-01-01, 1996-01-01)') AS d, RANGE_START(RANGE_INTERSECT(r, RANGE(DATE_ADD(RANGE_START(r), INTERVAL 3 DAY), NULL))) AS e, ARRAY_LENGTH(GENERATE_RANGE_ARRAY(r, INTERVAL 4 DAY)) AS f, RANGE_IS_START_UNBOUNDED(RANGE<DATE> '[UNBOUNDED, 2020-01-01)') AS g, RANGE_IS_END_UNBOUNDED(r) AS h FROM (SELECT o_orderkey, RANGE(DATE(o_orderdate), DATE_ADD(DATE(o_orderdate), INTERVAL 10 DAY)) AS r FROM orders)",
        "SELECT o_orderkey, d AS a, d + 10 AS b, d <= DATE '1995-06-15' AND DATE '1995-06-15' < d + 10 AS c, d < DATE '1996-01-01' AND d + 10 > DATE '1995-01-01' AS d, d + 3 AS e, 3 AS f, true AS g, false AS h FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
    ),
}

AGGREGATES: dict[str, tuple[str, str | None]] = {
    "sample_statistics": (
        "SELECT o_orderstatus, ROUND(STDDEV_SAMP(o_totalprice), 4) AS a, ROUND(VAR_SAMP(o_totalprice), 0) AS b, MIN(o_totalprice) AS c, MIN(o_orderdate) AS d FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS a, round(var_samp(o_totalprice), 0) AS b, min(o_totalprice) AS c, min(o_orderdate) AS d FROM orders GROUP BY 1",
    ),
    "approximate_aggregates": (
        "SELECT p_brand, APPROX_QUANTILES(p_size, 2)[OFFSET(0)] AS lo, APPROX_QUANTILES(p_size, 2)[OFFSET(2)] AS hi, APPROX_TOP_COUNT(p_type, 1)[OFFSET(0)].count AS n, APPROX_TOP_SUM(p_type, p_size, 1)[OFFSET(0)].sum AS s FROM part GROUP BY p_brand",
        "WITH t AS (SELECT p_brand, p_type, count(*) AS n, sum(p_size) AS s FROM part GROUP BY 1, 2) SELECT p.p_brand, min(p_size) AS lo, max(p_size) AS hi, (SELECT max(n) FROM t WHERE t.p_brand = p.p_brand) AS n, (SELECT max(s) FROM t WHERE t.p_brand = p.p_brand) AS s FROM part p GROUP BY 1",
    ),
    "hll_sketches": (
        "SELECT HLL_COUNT.EXTRACT(HLL_COUNT.MERGE_PARTIAL(s)) AS a, HLL_COUNT.MERGE(s) AS b, SUM(HLL_COUNT.EXTRACT(s)) AS c FROM (SELECT o_orderstatus, HLL_COUNT.INIT(o_orderpriority) AS s FROM orders GROUP BY o_orderstatus)",
        "SELECT (SELECT count(DISTINCT o_orderpriority) FROM orders) AS a, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS b, sum(n)::BIGINT AS c FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderstatus)",
    ),
    "distinct_by_group": (
        "SELECT o_custkey, APPROX_COUNT_DISTINCT(o_orderkey) > 0 AS some, HLL_COUNT.EXTRACT(HLL_COUNT.INIT(o_orderkey)) AS n FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, true AS some, count(*) AS n FROM orders GROUP BY 1",
    ),
    "kll_sketches": (
        "SELECT o_custkey, KLL_QUANTILES.EXTRACT_INT64(KLL_QUANTILES.INIT_INT64(o_orderkey), 2)[OFFSET(0)] AS a, KLL_QUANTILES.EXTRACT_INT64(KLL_QUANTILES.INIT_INT64(o_orderkey), 2)[OFFSET(2)] AS b, KLL_QUANTILES.EXTRACT_FLOAT64(KLL_QUANTILES.INIT_FLOAT64(o_totalprice), 4)[OFFSET(4)] AS c, KLL_QUANTILES.EXTRACT_POINT_INT64(KLL_QUANTILES.INIT_INT64(o_orderkey), 1) AS d, KLL_QUANTILES.EXTRACT_POINT_FLOAT64(KLL_QUANTILES.INIT_FLOAT64(o_totalprice), 0) AS e FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b, max(o_totalprice) AS c, max(o_orderkey) AS d, min(o_totalprice) AS e FROM orders GROUP BY 1",
    ),
    "kll_merges": (
        "SELECT KLL_QUANTILES.MERGE_INT64(i, 2)[OFFSET(2)] AS a, KLL_QUANTILES.MERGE_FLOAT64(f, 2)[OFFSET(0)] AS b, KLL_QUANTILES.MERGE_POINT_INT64(i, 0) AS c, KLL_QUANTILES.MERGE_POINT_FLOAT64(f, 1) AS d, KLL_QUANTILES.EXTRACT_POINT_FLOAT64(KLL_QUANTILES.MERGE_PARTIAL(f), 1) AS e FROM (SELECT p_brand, KLL_QUANTILES.INIT_INT64(p_partkey) AS i, KLL_QUANTILES.INIT_FLOAT64(p_retailprice) AS f FROM part GROUP BY p_brand)",
        "SELECT max(p_partkey) AS a, min(p_retailprice) AS b, min(p_partkey) AS c, max(p_retailprice) AS d, max(p_retailprice) AS e FROM part",
    ),
    "window_edges": (
        "SELECT o_orderkey, IS_FIRST(2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, IS_LAST() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, FIRST_VALUE(NULLIF(o_orderstatus, 'F') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, SUM(DISTINCT o_orderkey) OVER (PARTITION BY o_custkey) AS d FROM orders",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2 AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS b, first_value(nullif(o_orderstatus, 'F') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, sum(o_orderkey) OVER (PARTITION BY o_custkey)::BIGINT AS d FROM orders",
    ),
    "anti_join_orders": ("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)", None),
    "except_customers": ("SELECT o_custkey AS k FROM orders EXCEPT DISTINCT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000"),
    "join_cross_large": ("SELECT n_name, s_suppkey FROM nation CROSS JOIN supplier", None),
    "join_theta_large": ("SELECT n_name, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey < n_nationkey GROUP BY n_name", None),
    "distinct_on_error": (
        "SELECT o_orderkey, IFERROR(ERROR('no'), 'caught') AS a, COALESCE(NULLIF(o_orderstatus, 'F'), '-') AS b, o_orderstatus IS DISTINCT FROM 'F' AS c, o_orderstatus IS NOT DISTINCT FROM 'F' AS d, (o_orderstatus = 'F') IS TRUE AS e, (o_orderstatus = 'F') IS FALSE AS f, WITH(x AS o_orderkey + 1, y AS x * 2, x + y) AS g, TYPEOF(o_orderkey) AS h FROM orders",
        "SELECT o_orderkey, 'caught' AS a, coalesce(nullif(o_orderstatus, 'F'), '-') AS b, o_orderstatus IS DISTINCT FROM 'F' AS c, o_orderstatus IS NOT DISTINCT FROM 'F' AS d, o_orderstatus = 'F' AS e, o_orderstatus <> 'F' AS f, (o_orderkey + 1) * 3 AS g, 'INT64' AS h FROM orders",
    ),
    "cast_formats": (
        "SELECT o_orderkey, CAST(DATE(o_orderdate) AS STRING FORMAT 'YYYY-MM-DD') AS a, CAST(FORMAT_DATE('%d/%m/%Y', DATE(o_orderdate)) AS DATE FORMAT 'DD/MM/YYYY') AS b, CAST(CAST(o_orderstatus AS BYTES) AS STRING FORMAT 'HEX') AS c, CAST(o_totalprice AS INT64) AS d, CAST(o_orderkey AS STRING) AS e, CAST(CAST(o_totalprice AS STRING) AS FLOAT64) AS f, CAST(o_orderkey AS BOOL) AS g FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, o_orderdate::DATE AS b, lower(hex(o_orderstatus)) AS c, (CASE WHEN o_totalprice < 0 THEN -floor(-o_totalprice + 0.5) ELSE floor(o_totalprice + 0.5) END)::BIGINT AS d, o_orderkey::VARCHAR AS e, o_totalprice AS f, o_orderkey <> 0 AS g FROM orders",
    ),
    "table_sample": ("SELECT COUNT(*) AS n FROM lineitem TABLESAMPLE SYSTEM (100 PERCENT)", "SELECT count(*) AS n FROM lineitem"),
    "pipe_set_operations": (
        "FROM orders |> WHERE o_totalprice > 100000 |> SELECT o_custkey |> INTERSECT DISTINCT (FROM orders |> WHERE o_orderstatus = 'F' |> SELECT o_custkey)",
        "SELECT o_custkey FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    ),
}

TOKENS: dict[str, tuple[str, str | None]] = {
    "token_search": (
        "SELECT conv_id, turn, SEARCH_SUBSTRING(TOKENIZE_SUBSTRING(role), 'use') AS a, ARRAY_TO_STRING(TOKENIZE_BOOL(turn > 0), ',') AS b, ARRAY_TO_STRING(TOKENIZE_NUMBER(turn), ',') AS c, ARRAY_LENGTH(TOKENLIST_CONCAT([TOKEN(role), TOKEN('x')])) AS d, SCORE(TOKENIZE_FULLTEXT(role), 'user') AS e, SEARCH_NGRAMS(TOKENIZE_NGRAMS(role), 'user') AS f, DEBUG_TOKENLIST(TOKENIZE_FULLTEXT(role)) AS g, ARRAY_LENGTH(TOKENIZE_JSON(JSON '{\"a\": \"b c\"}')) AS h, SCORE_NGRAMS(TOKENIZE_NGRAMS(role), 'user') AS i FROM conversations",
        "SELECT conv_id, turn, role LIKE '%use%' AS a, CASE WHEN turn > 0 THEN 'y' ELSE 'n' END AS b, turn::VARCHAR AS c, 2 AS d, (role = 'user')::INT::DOUBLE AS e, role = 'user' AS f, role AS g, 3 AS h, (role = 'user')::INT::DOUBLE AS i FROM conversations",
    ),
    "encrypted_columns": (
        "WITH k AS (SELECT KEYS.KEYSET_FROM_JSON('{\"primaryKeyId\":7,\"key\":[{\"keyId\":7,\"value\":\"AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA=\"}]}') AS ks) SELECT c_custkey, AEAD.DECRYPT_STRING(ks, AEAD.ENCRYPT(ks, c_name, 'x'), 'x') AS a, CAST(AEAD.DECRYPT_BYTES(ks, AEAD.ENCRYPT(ks, CAST(c_name AS BYTES), 'x'), 'x') AS STRING) AS b, DETERMINISTIC_DECRYPT_STRING(ks, DETERMINISTIC_ENCRYPT(ks, c_name, 'x'), 'x') AS c, CAST(DETERMINISTIC_DECRYPT_BYTES(ks, DETERMINISTIC_ENCRYPT(ks, CAST(c_name AS BYTES), 'x'), 'x') AS STRING) AS d, DETERMINISTIC_ENCRYPT(ks, c_name, 'x') = DETERMINISTIC_ENCRYPT(ks, c_name, 'x') AS e, KEYS.KEYSET_LENGTH(ks) AS f FROM customer, k",
        "SELECT c_custkey, c_name AS a, c_name AS b, c_name AS c, c_name AS d, true AS e, 1 AS f FROM customer",
    ),
    "key_functions": (
        "SELECT n_nationkey, KEYS.KEYSET_LENGTH(KEYS.NEW_KEYSET('AEAD_AES_GCM_256')) AS a, KEYS.KEYSET_LENGTH(KEYS.ROTATE_KEYSET(KEYS.NEW_KEYSET('AEAD_AES_GCM_256'), 'AEAD_AES_GCM_256')) AS b, KEYS.KEYSET_LENGTH(KEYS.ADD_KEY_FROM_RAW_BYTES(KEYS.NEW_KEYSET('AEAD_AES_GCM_256'), 'AES_GCM', b'0123456789abcdef0123456789abcdef')) AS c, KEYS.KEYSET_LENGTH(KEYS.KEYSET_FROM_JSON(KEYS.KEYSET_TO_JSON(KEYS.NEW_KEYSET('AEAD_AES_GCM_256')))) AS d, DLP_DETERMINISTIC_DECRYPT(DLP_KEY_CHAIN('r', b'k'), DLP_DETERMINISTIC_ENCRYPT(DLP_KEY_CHAIN('r', b'k'), n_name, 'SUR'), 'SUR') AS e FROM nation",
        "SELECT n_nationkey, 1 AS a, 2 AS b, 2 AS c, 1 AS d, n_name AS e FROM nation",
    ),
}

POINTS = "SELECT s_suppkey, ST_GEOGPOINT(MOD(s_suppkey, 360) - 180, MOD(s_suppkey, 120) - 60) AS g, MOD(s_suppkey, 360) - 180 AS lon, MOD(s_suppkey, 120) - 60 AS lat FROM supplier"
PLACES = "SELECT s_suppkey, (s_suppkey % 360 - 180)::DOUBLE AS lon, (s_suppkey % 120 - 60)::DOUBLE AS lat FROM supplier"
GEOGRAPHY: dict[str, tuple[str, str | None]] = {
    "geo_points": (
        f"SELECT s_suppkey, ST_X(g) AS a, ST_Y(g) AS b, ST_ASTEXT(g) AS c, ST_ASTEXT(ST_GEOGFROMTEXT(ST_ASTEXT(g))) AS d, ST_ASTEXT(ST_GEOGFROMGEOJSON(ST_ASGEOJSON(g))) AS e, ST_ASTEXT(ST_GEOGFROMWKB(ST_ASBINARY(g))) AS f, ST_ASTEXT(ST_GEOGFROMKML(ST_ASKML(g))) AS g2, ST_ASTEXT(ST_GEOGFROM(ST_ASTEXT(g))) AS h, ST_DIMENSION(g) AS i, ST_GEOMETRYTYPE(g) AS j, ST_ISEMPTY(g) AS k, ST_NUMPOINTS(g) AS l, ST_NPOINTS(g) AS m, ST_NUMGEOMETRIES(g) AS n, ST_ISCOLLECTION(g) AS o, ST_EQUALS(g, ST_GEOGPOINT(lon, lat)) AS p, ST_DWITHIN(g, g, 1) AS q, ST_AREA(g) AS r, ST_LENGTH(g) AS s, ST_PERIMETER(g) AS t FROM ({POINTS})",
        f"SELECT s_suppkey, lon AS a, lat AS b, w AS c, w AS d, w AS e, w AS f, w AS g2, w AS h, 0 AS i, 'ST_Point' AS j, false AS k, 1 AS l, 1 AS m, 1 AS n, false AS o, true AS p, true AS q, 0.0::DOUBLE AS r, 0.0::DOUBLE AS s, 0.0::DOUBLE AS t FROM (SELECT *, 'POINT(' || lon::INT || ' ' || lat::INT || ')' AS w FROM ({PLACES}))",
    ),
    "geo_lines": (
        f"SELECT s_suppkey, ROUND(ST_LENGTH(l) / ST_LENGTH(ST_GEOGFROMTEXT('LINESTRING(0 0, 0 1)')), 4) AS a, ST_ASTEXT(ST_STARTPOINT(l)) AS b, ST_ASTEXT(ST_ENDPOINT(l)) AS c, ST_ASTEXT(ST_POINTN(l, 2)) AS d, ST_NUMPOINTS(l) AS e, ST_ISCLOSED(l) AS f, ST_ISRING(l) AS g2, ROUND(ST_Y(ST_LINEINTERPOLATEPOINT(l, 0.5)) - lat, 4) AS h, ROUND(ST_LINELOCATEPOINT(l, ST_GEOGPOINT(lon, lat + 1)), 4) AS i, ROUND(ST_LENGTH(ST_LINESUBSTRING(l, 0, 0.5)) / ST_LENGTH(l), 4) AS j, ARRAY_LENGTH(ST_DUMPPOINTS(l)) AS k, ROUND(ST_MAXDISTANCE(g, l) / ST_LENGTH(l), 4) AS m, ROUND(ST_HAUSDORFFDISTANCE(l, l), 4) AS n, ST_HAUSDORFFDWITHIN(l, l, 1) AS o, ROUND(ST_DISTANCE(ST_CLOSESTPOINT(l, g), g), 2) AS p, ROUND(ST_AZIMUTH(g, ST_GEOGPOINT(lon, lat + 2)), 4) AS q, ST_NUMPOINTS(ST_SIMPLIFY(l, 10)) AS r FROM (SELECT *, ST_MAKELINE(g, ST_GEOGPOINT(lon, lat + 2)) AS l FROM ({POINTS}))",
        f"SELECT s_suppkey, 2.0::DOUBLE AS a, 'POINT(' || lon::INT || ' ' || lat::INT || ')' AS b, 'POINT(' || lon::INT || ' ' || (lat + 2)::INT || ')' AS c, 'POINT(' || lon::INT || ' ' || (lat + 2)::INT || ')' AS d, 2 AS e, false AS f, false AS g2, 1.0::DOUBLE AS h, 0.5::DOUBLE AS i, 0.5::DOUBLE AS j, 2 AS k, 1.0::DOUBLE AS m, 0.0::DOUBLE AS n, true AS o, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 2 AS r FROM ({PLACES})",
    ),
    "geo_polygons": (
        f"SELECT s_suppkey, ST_CONTAINS(p, c) AS a, ST_COVERS(p, c) AS b, ST_WITHIN(c, p) AS d, ST_COVEREDBY(c, p) AS e, ST_INTERSECTS(p, c) AS f, ST_DISJOINT(p, ST_GEOGPOINT(lon, lat + 9)) AS h, ST_NUMPOINTS(ST_EXTERIORRING(p)) AS i, ST_DIMENSION(p) AS j, ST_GEOMETRYTYPE(p) AS k, ROUND(ST_X(ST_CENTROID(p)) - lon, 3) AS l, ST_BOUNDINGBOX(p).ymax - lat AS m, ST_INTERSECTSBOX(p, lon - 1, lat - 1, lon + 5, lat + 5) AS n, ROUND(ST_PERIMETER(p) / ST_LENGTH(ST_BOUNDARY(p)), 6) AS o, ST_AREA(p) > 0 AS q, ARRAY_LENGTH(ST_INTERIORRINGS(p)) AS r, ARRAY_LENGTH(ST_DUMP(p)) AS t, ST_TOUCHES(p, ST_GEOGPOINT(lon, lat)) AS u, ST_AREA(ST_CONVEXHULL(p)) > 0 AS v, ST_AREA(ST_MAKEPOLYGONORIENTED([ST_EXTERIORRING(p)])) > 0 AS w, ROUND(ST_AREA(ST_BUFFER(g, 1000, 64)) / 3141592.65, 1) AS x, ROUND(ST_AREA(ST_BUFFERWITHTOLERANCE(g, 1000, 1)) / 3141592.65, 1) AS y FROM (SELECT *, ST_MAKEPOLYGON(ST_GEOGFROMTEXT(CONCAT('LINESTRING(', x0, ' ', y0, ',', x1, ' ', y0, ',', x1, ' ', y1, ',', x0, ' ', y1, ',', x0, ' ', y0, ')'))) AS p, ST_GEOGPOINT(lon + 1, lat + 1) AS c FROM (SELECT *, CAST(lon AS STRING) AS x0, CAST(lat AS STRING) AS y0, CAST(lon + 2 AS STRING) AS x1, CAST(lat + 2 AS STRING) AS y1 FROM ({POINTS}) WHERE lon < 170))",
        f"SELECT s_suppkey, true AS a, true AS b, true AS d, true AS e, true AS f, true AS h, 5 AS i, 2 AS j, 'ST_Polygon' AS k, 1.0::DOUBLE AS l, 2.0::DOUBLE AS m, true AS n, 1.0::DOUBLE AS o, true AS q, 0 AS r, 1 AS t, true AS u, true AS v, true AS w, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y FROM ({PLACES}) WHERE lon < 170",
    ),
    "geo_cells": (
        f"SELECT s_suppkey, SUBSTR(ST_GEOHASH(g, 8), 1, 4) = ST_GEOHASH(g, 4) AS a, ROUND(ST_DISTANCE(ST_GEOGPOINTFROMGEOHASH(ST_GEOHASH(g, 12)), g), 0) AS b, ST_ASTEXT(ST_SNAPTOGRID(ST_GEOGPOINT(lon + 0.2, lat + 0.2), 1)) AS c, S2_CELLIDFROMPOINT(g) = S2_CELLIDFROMPOINT(ST_GEOGPOINT(lon, lat)) AS d, ROUND(ST_ANGLE(ST_GEOGPOINT(lon, 1), ST_GEOGPOINT(lon, 0), ST_GEOGPOINT(lon + 1, 0)), 3) IN (1.571, 4.712) AS e, ST_ASTEXT(ST_GEOMETRYN(g, 1)) = ST_ASTEXT(g) AS f, ST_DIMENSION(ST_ENVELOPE(ST_MAKELINE(g, ST_GEOGPOINT(lon + 1, lat + 1)))) AS h FROM ({POINTS}) WHERE lon < 170",
        f"SELECT s_suppkey, true AS a, 0.0::DOUBLE AS b, 'POINT(' || lon::INT || ' ' || lat::INT || ')' AS c, true AS d, true AS e, true AS f, 2 AS h FROM ({PLACES}) WHERE lon < 170",
    ),
    "geo_aggregates": (
        f"SELECT MOD(s_suppkey, 3) AS k, ROUND(ST_X(ST_CENTROID_AGG(g)), 4) AS a, ST_EXTENT(g).xmax AS b, ST_EXTENT(g).ymin AS c FROM ({POINTS}) GROUP BY k",
        f"SELECT s_suppkey % 3 AS k, round(avg(lon), 4) AS a, max(lon) AS b, min(lat) AS c FROM ({PLACES}) GROUP BY 1",
    ),
}

#: name -> (script of the dialect whose last statement gives the rows, DuckDB SQL): statements, scripts, definitions.
SCRIPTS: dict[str, tuple[str, str]] = {
    "insert_update_delete": (
        "CREATE TABLE t (k INT64, v FLOAT64, s STRING); INSERT INTO t SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders; INSERT INTO t (k, s) VALUES (-1, 'new'); UPDATE t SET v = v * 2, s = 'twice' WHERE MOD(k, 3) = 0 AND k >= 0; DELETE FROM t WHERE MOD(k, 5) = 0; SELECT k, ROUND(v, 2) AS v, s FROM t",
        "SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS v, CASE WHEN o_orderkey % 3 = 0 THEN 'twice' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -1, NULL, 'new'",
    ),
    "update_from": (
        "CREATE TABLE t AS SELECT c_custkey AS k, 0 AS n FROM customer; UPDATE t SET n = u.c FROM (SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey) AS u WHERE t.k = u.o_custkey; SELECT k, n FROM t",
        "SELECT c_custkey AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    ),
    "truncate_and_reload": ("CREATE TABLE t AS SELECT * FROM nation; TRUNCATE TABLE t; INSERT INTO t SELECT * FROM nation WHERE n_regionkey = 1; SELECT n_name FROM t", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "transactions": (
        "CREATE TABLE t AS SELECT o_orderkey AS k FROM orders; BEGIN TRANSACTION; DELETE FROM t WHERE true; ROLLBACK TRANSACTION; BEGIN TRANSACTION; DELETE FROM t WHERE MOD(k, 2) = 0; COMMIT TRANSACTION; SELECT k FROM t",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 1",
    ),
    "table_definitions": (
        "CREATE SCHEMA IF NOT EXISTS lab; CREATE TABLE lab.a (k INT64 NOT NULL, s STRING DEFAULT 'q', PRIMARY KEY (k) NOT ENFORCED); INSERT lab.a (k) SELECT n_nationkey FROM nation; ALTER TABLE lab.a ADD COLUMN extra STRING; CREATE OR REPLACE VIEW lab.v AS SELECT k + 1 AS k1, s, extra FROM lab.a; CREATE TABLE lab.gone AS SELECT 1 AS x; DROP TABLE lab.gone; DROP TABLE IF EXISTS lab.gone; CREATE OR REPLACE TABLE lab.b AS SELECT * FROM lab.v; CREATE VIEW lab.w AS SELECT 1 AS x; DROP VIEW lab.w; GRANT `roles/viewer` ON TABLE lab.a TO 'user:x@example.com'; SELECT k1, s, extra FROM lab.b",
        "SELECT n_nationkey + 1 AS k1, 'q' AS s, NULL::VARCHAR AS extra FROM nation",
    ),
    "information_schema_columns": (
        "CREATE SCHEMA lab; CREATE TABLE lab.inv (p STRING, q INT64 NOT NULL, r DATE); SELECT table_name, column_name, ordinal_position, is_nullable, data_type FROM lab.INFORMATION_SCHEMA.COLUMNS",
        "SELECT * FROM (VALUES ('inv', 'p', 1, 'YES', 'STRING'), ('inv', 'q', 2, 'NO', 'INT64'), ('inv', 'r', 3, 'YES', 'DATE')) t(table_name, column_name, ordinal_position, is_nullable, data_type)",
    ),
    "information_schema_tables": (
        "CREATE SCHEMA lab; CREATE TABLE lab.a (x INT64); CREATE VIEW lab.v AS SELECT 1 AS y; SELECT table_name, table_type FROM lab.INFORMATION_SCHEMA.TABLES",
        "SELECT * FROM (VALUES ('a', 'BASE TABLE'), ('v', 'VIEW')) t(table_name, table_type)",
    ),
    "information_schema_schemata": ("CREATE SCHEMA lab; SELECT schema_name FROM INFORMATION_SCHEMA.SCHEMATA WHERE schema_name = 'lab'", "SELECT 'lab' AS schema_name"),
    "wildcard_scan": (
        "CREATE SCHEMA lab; CREATE TABLE lab.o_f AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'; CREATE TABLE lab.o_o AS SELECT o_orderkey, o_totalprice, 'late' AS note FROM orders WHERE o_orderstatus = 'O'; SELECT _TABLE_SUFFIX AS sfx, COUNT(*) AS n, COUNT(note) AS notes, ROUND(SUM(o_totalprice), 2) AS s FROM lab.`o_*` GROUP BY sfx",
        "SELECT lower(o_orderstatus) AS sfx, count(*) AS n, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS notes, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    ),
    "control_flow": (
        "DECLARE i, s INT64 DEFAULT 0; DECLARE words STRING DEFAULT ''; WHILE i < 6 DO SET i = i + 1; IF i = 2 THEN CONTINUE; ELSEIF i = 5 THEN BREAK; END IF; SET s = s + i; END WHILE; LOOP SET i = i + 1; IF i > 8 THEN LEAVE; END IF; END LOOP; REPEAT SET i = i + 10; UNTIL i > 20 END REPEAT; FOR r IN (SELECT n_name FROM nation WHERE n_nationkey < 2 ORDER BY n_nationkey) DO SET words = CONCAT(words, r.n_name, ';'); END FOR; CASE WHEN i > 20 THEN SET s = s * 100; ELSE SET s = -1; END CASE; BEGIN SELECT ERROR('x'); EXCEPTION WHEN ERROR THEN SET s = s + 1; END; ASSERT s > 0 AS 'positive'; SELECT n_nationkey, i AS i, s AS s, words AS words FROM nation",
        "SELECT n_nationkey, 29 AS i, 801 AS s, (SELECT string_agg(n_name || ';', '' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 2) AS words FROM nation",
    ),
    "procedures": (
        "CREATE PROCEDURE add_up(IN a INT64, IN b INT64, OUT r INT64) BEGIN IF a < 0 THEN SET r = 0; RETURN; END IF; SET r = a + b; END; DECLARE q, z INT64; CALL add_up(4, 5, q); CALL add_up(-4, 5, z); SELECT n_nationkey, q AS q, z AS z FROM nation",
        "SELECT n_nationkey, 9 AS q, 0 AS z FROM nation",
    ),
    "dynamic_statements": (
        "DECLARE c STRING DEFAULT 'o_orderkey'; DECLARE n INT64; EXECUTE IMMEDIATE 'SELECT COUNT(*) FROM orders WHERE o_orderstatus = ?' INTO n USING 'F'; EXECUTE IMMEDIATE FORMAT('CREATE TEMP TABLE d AS SELECT %s AS k FROM orders WHERE o_totalprice > @p', c) USING 300000 AS p; SELECT k, n AS n FROM d",
        "SELECT o_orderkey AS k, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n FROM orders WHERE o_totalprice > 300000",
    ),
    "sql_functions": (
        "CREATE TEMP FUNCTION taxed(p FLOAT64, r FLOAT64) RETURNS FLOAT64 AS (p * (1 + r)); CREATE TEMP FUNCTION plus(a ANY TYPE, b ANY TYPE) AS (a + b); CREATE FUNCTION gone(x INT64) AS (x); DROP FUNCTION gone; CREATE TABLE FUNCTION upto(k INT64) AS (SELECT n_name, n_nationkey FROM nation WHERE n_nationkey <= k); SELECT n_name, ROUND(taxed(n_nationkey, 0.1), 6) AS t, plus(n_nationkey, 1) AS p, plus(0.5, n_nationkey) AS q FROM upto(10)",
        "SELECT n_name, round(n_nationkey * 1.1, 6)::DOUBLE AS t, n_nationkey + 1 AS p, n_nationkey + 0.5::DOUBLE AS q FROM nation WHERE n_nationkey <= 10",
    ),
    "system_variables": ("SET @@time_zone = 'UTC'; SELECT n_nationkey, @@time_zone AS tz FROM nation", "SELECT n_nationkey, 'UTC' AS tz FROM nation"),
    "struct_updates": (
        "CREATE TABLE t AS SELECT o_orderkey AS k, STRUCT(o_totalprice AS p, o_orderstatus AS s) AS b FROM orders; UPDATE t SET b.s = 'X' WHERE b.p > 200000; SELECT k, b.p AS p, b.s AS s FROM t",
        "SELECT o_orderkey AS k, o_totalprice AS p, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS s FROM orders",
    ),
    "export_and_load": (
        "EXPORT DATA OPTIONS (uri='{folder}/csv/*.csv', format='CSV', overwrite=true, header=true, compression='GZIP') AS SELECT o_orderkey, o_orderstatus FROM orders; EXPORT DATA OPTIONS (uri='{folder}/json/*.json', format='JSON', overwrite=true) AS SELECT o_orderkey AS k FROM orders; EXPORT DATA OPTIONS (uri='{folder}/pq/*.parquet', format='PARQUET', overwrite=true, compression='SNAPPY') AS SELECT o_orderkey AS k FROM orders; LOAD DATA INTO a (k INT64, s STRING) FROM FILES (format='CSV', uris=['{folder}/csv'], skip_leading_rows=1); LOAD DATA INTO b FROM FILES (format='PARQUET', uris=['{folder}/pq']); LOAD DATA INTO c FROM FILES (format='JSON', uris=['{folder}/json']); SELECT a.k AS k, a.s AS s FROM a JOIN b ON a.k = b.k JOIN c ON c.k = a.k",
        "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders",
    ),
    "graph_elements": (
        "CREATE TABLE person (id INT64, name STRING, PRIMARY KEY (id) NOT ENFORCED); INSERT person SELECT c_custkey, c_name FROM customer; CREATE TABLE lives (src INT64, dst INT64, PRIMARY KEY (src, dst) NOT ENFORCED); INSERT lives SELECT c_custkey, c_nationkey FROM customer; CREATE TABLE land (id INT64, name STRING, PRIMARY KEY (id) NOT ENFORCED); INSERT land SELECT n_nationkey, n_name FROM nation; CREATE PROPERTY GRAPH g NODE TABLES (person, land) EDGE TABLES (lives SOURCE KEY (src) REFERENCES person (id) DESTINATION KEY (dst) REFERENCES land (id)); GRAPH g MATCH p = (x:person)-[e:lives]->(y:land) RETURN x.id AS id, LABELS(x)[OFFSET(0)] AS a, ELEMENT_DEFINITION_NAME(y) AS b, PATH_LENGTH(p) AS c, ARRAY_TO_STRING(PROPERTY_NAMES(x), ',') AS d, ELEMENT_ID(x) = SOURCE_NODE_ID(e) AS f, ELEMENT_ID(y) = DESTINATION_NODE_ID(e) AS h, ARRAY_LENGTH(NODES(p)) AS i, ARRAY_LENGTH(EDGES(p)) AS j, IS_TRAIL(p) AS k, IS_ACYCLIC(p) AS l, ELEMENT_ID(PATH_FIRST(p)) = ELEMENT_ID(x) AS m, ELEMENT_ID(PATH_LAST(p)) = ELEMENT_ID(y) AS n",
        "SELECT c_custkey AS id, 'person' AS a, 'land' AS b, 1 AS c, 'id,name' AS d, true AS f, true AS h, 2 AS i, 1 AS j, true AS k, true AS l, true AS m, true AS n FROM customer",
    ),
    "sequences": (
        "CREATE SEQUENCE seq OPTIONS (sequence_kind = 'bit_reversed_positive'); CREATE TABLE t AS SELECT o_orderkey, GET_NEXT_SEQUENCE_VALUE(SEQUENCE seq) AS v FROM orders; SELECT COUNT(*) AS n, COUNT(DISTINCT v) AS d, MIN(v) > 0 AS p, GET_INTERNAL_SEQUENCE_STATE(SEQUENCE seq) >= MAX(v) AS st FROM t",
        "SELECT count(*) AS n, count(*) AS d, true AS p, true AS st FROM orders",
    ),
    "recursive_distinct": (
        "WITH RECURSIVE r AS (SELECT 1 AS n UNION DISTINCT SELECT MOD(n * 2, 11) FROM r) SELECT n FROM r",
        "WITH RECURSIVE r AS (SELECT 1 AS n UNION SELECT (n * 2) % 11 FROM r) SELECT n FROM r",
    ),
    "private_aggregates": (
        "SELECT o_orderstatus, n, ROUND(s) AS s, ROUND(a, 2) AS a, ROUND(v) AS v, ROUND(d, 2) AS d FROM (SELECT WITH ANONYMIZATION OPTIONS (epsilon = 1e15, delta = 1e-5) o_orderstatus, ANON_COUNT(*) AS n, ANON_SUM(o_orderkey CLAMPED BETWEEN 0 AND 100000000) AS s, ANON_AVG(o_orderkey CLAMPED BETWEEN 0 AND 100000000) AS a, ANON_VAR_POP(o_orderkey CLAMPED BETWEEN 0 AND 1000) AS v, ANON_STDDEV_POP(o_orderkey CLAMPED BETWEEN 0 AND 1000) AS d FROM orders GROUP BY o_orderstatus)",
        "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::DOUBLE AS s, round(avg(o_orderkey), 2) AS a, round(var_pop(least(o_orderkey, 1000))) AS v, round(stddev_pop(least(o_orderkey, 1000)), 2) AS d FROM orders GROUP BY 1",
    ),
    "vector_search_sql": (
        "CREATE TABLE q AS SELECT vec_id, embedding FROM embeddings WHERE MOD(vec_id, 100) = 7; SELECT query.vec_id AS q, COUNT(*) AS n, ROUND(MIN(distance), 4) AS nearest, ROUND(MAX(distance), 4) AS farthest FROM VECTOR_SEARCH(TABLE embeddings, 'embedding', TABLE q, top_k => 5, distance_type => 'EUCLIDEAN') GROUP BY q",
        "WITH d AS (SELECT q.vec_id AS q, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 7), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d) AS r FROM d) SELECT q, count(*) AS n, round(min(d), 4) AS nearest, round(max(d), 4) AS farthest FROM r WHERE r <= 5 GROUP BY q",
    ),
    "tf_idf_sql": (
        "SELECT item_id, w.term AS term, ROUND(w.tf_idf, 8) AS tf_idf FROM (SELECT item_id, TF_IDF(TEXT_ANALYZE(text)) OVER () AS ws FROM benchmark) AS x, UNNEST(x.ws) AS w",
        """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS c FROM w GROUP BY 1, 2),
n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT c.item_id, c.term, round(c / n * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1), 8) AS tf_idf FROM c JOIN n ON c.item_id = n.item_id JOIN d ON c.term = d.term""",
    ),
    "change_functions": (
        "CREATE TABLE t AS SELECT 1 AS a; SELECT n_nationkey, (SELECT COUNT(*) FROM APPENDS(TABLE t)) AS a, (SELECT COUNT(*) FROM CHANGES(TABLE t)) AS c, SNIPPET(n_name, 'nation') LIKE '%NATION%' AS s FROM nation",
        "SELECT n_nationkey, 0 AS a, 0 AS c, true AS s FROM nation",
    ),
    "table_options": (
        "CREATE SCHEMA lab; CREATE TABLE lab.t (x INT64) OPTIONS (description = 'words'); SELECT table_name, option_name FROM lab.INFORMATION_SCHEMA.TABLE_OPTIONS",
        "SELECT 't' AS table_name, 'description' AS option_name",
    ),
    "object_references": (
        "SELECT n_nationkey, OBJ.MAKE_REF(CONCAT('gs://b/', n_name), 'us.c').uri AS a, OBJ.MAKE_REF('gs://b/x', 'us.c').authorizer AS b FROM nation",
        "SELECT n_nationkey, 'gs://b/' || n_name AS a, 'us.c' AS b FROM nation",
    ),
    "gap_fill_sql": (
        "CREATE TABLE d AS SELECT event_type, DATETIME_TRUNC(ts, HOUR) AS h, COUNT(*) AS n FROM events GROUP BY event_type, h HAVING MOD(COUNT(*), 3) <> 0; SELECT h, event_type, n FROM GAP_FILL(TABLE d, ts_column => 'h', bucket_width => INTERVAL 1 HOUR, partitioning_columns => ['event_type'], value_columns => [('n', 'null')])",
        "WITH d AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) % 3 <> 0), b AS (SELECT event_type, min(h) AS lo, max(h) AS hi FROM d GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM b) SELECT g.h, g.event_type, d.n FROM g LEFT JOIN d ON d.event_type = g.event_type AND d.h = g.h",
    ),
    "range_sessionize_sql": (
        "SELECT user_id, RANGE_START(session_range) AS s, RANGE_END(session_range) AS e, COUNT(*) AS n FROM RANGE_SESSIONIZE((SELECT user_id, RANGE(ts, DATETIME_ADD(ts, INTERVAL 30 MINUTE)) AS r FROM events), 'r', ['user_id']) GROUP BY user_id, s, e",
        "WITH r AS (SELECT user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r), i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM m) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, sid",
    ),
}

def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and positional parameters, arrays among them."""
    s = Session(spark)
    s.register_table("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    s.sql("CREATE TABLE few AS SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > @p AND o_orderstatus IN UNNEST(@st)", named={"p": 100000, "st": ["F", "O"]})
    return s.sql("SELECT o_orderkey, o_totalprice + ? AS t, ? AS note FROM few", args=[1.5, "it's"])


def python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered Python function, also as the service behind a function that asks one."""
    s = Session(spark)
    s.register_table("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    s.register_function("twice", lambda x: x * 2, "INT64")
    s.register_function("AI.SCORE", lambda x: float(len(x)), "FLOAT64")
    return s.sql("SELECT n_name, twice(n_nationkey) AS t, AI.SCORE(n_name) AS s FROM nation")


def _streamed(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The events as a stream that ends, through files of the warehouse; tasks write a batch's result to files too, so the driver never holds it."""
        from ..streaming import windows

        s = Session(spark)
        events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type")
        events.write.parquet(f"{s.root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{s.root}/in")
        found = windows.bucket_counts(stream, "ts", "6 hours", "event_type") if text == "buckets" else windows.sessions(stream, "ts", "30 minutes", "user_id")
        out = f"{s.root}/out"  # of the last batch: each is the whole result so far
        q = found.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{s.root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        moments = [f"to_timestamp_ntz(CAST({c} AS STRING)) AS {c}" if c in ("bucket", "start", "end") else c for c in found.columns]
        return spark.read.schema(found.schema).parquet(out).selectExpr(*[m.replace("(end", "(`end`").replace("CAST(end", "CAST(`end`").replace("AS end", "AS `end`") for m in moments])

    return run


SQL = DATES | STRINGS | MATH | ARRAYS | JSON | NETWORK | RANGES | AGGREGATES | TOKENS | GEOGRAPHY


def _script(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(spark)
        for t in TABLES:
            if t in text:
                s.register_table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return s.sql(text.replace("{folder}", f"{s.root}/exports"))

    return run


RUN = {name: _script(text) for name, (text, _) in SCRIPTS.items()}
RUN_ORACLE = {name: oracle for name, (_, oracle) in SCRIPTS.items()}
RUN |= {"parameters": parameters, "python_function": python_function, "streaming_buckets": _streamed("buckets"), "streaming_sessions": _streamed("sessions")}
RUN_ORACLE |= {
    "parameters": "SELECT o_orderkey, o_totalprice + 1.5::DOUBLE AS t, 'it''s' AS note FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')",
    "python_function": "SELECT n_name, n_nationkey * 2 AS t, length(n_name)::DOUBLE AS s FROM nation",
    "streaming_buckets": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "streaming_sessions": """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
i AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, sid""",
}
