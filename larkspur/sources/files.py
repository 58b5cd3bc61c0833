"""EXPORT DATA and LOAD DATA through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FORMATS = {"CSV": "csv", "JSON": "json", "NEWLINE_DELIMITED_JSON": "json", "PARQUET": "parquet", "ORC": "orc", "TEXT": "text"}
#: Writers of further URI schemes: scheme -> f(frame, uri, options).
WRITERS: dict[str, Callable[[DataFrame, str, dict], None]] = {}


def register_writer(scheme: str, writer: Callable[[DataFrame, str, dict], None]) -> None:
    WRITERS[scheme] = writer


def export(df: DataFrame, options: dict) -> None:
    head, _, tail = options["uri"].rpartition("/")
    uri = head if "*" in tail else options["uri"]  # Spark names the files of a folder itself
    kind = str(options.get("format", "CSV")).upper()
    if kind not in FORMATS:
        raise ValueError(f"EXPORT DATA: format {kind} is not supported")
    scheme = uri.partition("://")[0]
    if scheme in WRITERS:
        return WRITERS[scheme](df, uri, options)
    w = df.write.mode("overwrite" if options.get("overwrite") else "errorifexists")
    if kind == "CSV":
        mark = options.get("field_delimiter", ",")
        if len(mark) != 1:
            raise ValueError("EXPORT DATA: field_delimiter must be one character")
        w = w.option("header", options.get("header", True)).option("sep", mark)
    zipped = str(options.get("compression", "NONE")).upper()
    if zipped not in ("NONE", "GZIP", "SNAPPY", "ZSTD"):
        raise ValueError(f"EXPORT DATA: compression {zipped} is not supported")
    if zipped != "NONE":
        w = w.option("compression", zipped.lower())
    w.format(FORMATS[kind]).save(uri)


def load(spark: SparkSession, options: dict, schema: str | None = None) -> DataFrame:
    kind = FORMATS[str(options.get("format", "PARQUET")).upper()]
    r = spark.read.format(kind)
    if schema:
        r = r.schema(schema)
    if kind == "csv":
        skip = int(options.get("skip_leading_rows", 0))
        if skip not in (0, 1):
            raise ValueError("LOAD DATA: skip_leading_rows must be 0 or 1")
        r = r.option("header", skip == 1).option("sep", options.get("field_delimiter", ","))
        if not schema:
            r = r.option("inferSchema", True)
    return r.load(list(options["uris"]))
