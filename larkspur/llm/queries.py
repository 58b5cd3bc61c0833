"""Queries over the driver's tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def model_bytes(path: str | None = None) -> bytes:
    """The SentencePiece model file; by default that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, count_kind, find_personal_data, spans_text

    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), model_bytes(), keep_ids=False)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_labels import classify

    return classify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_main_text": op7_main_text,
    "op8_line_dedup": op8_line_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM docs WHERE len(w) >= 20),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p:p+19], ' ')) AS h FROM starts),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS pos FROM late, range(20) AS t(i)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS kept, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos WHERE gone.pos IS NULL GROUP BY words.doc_id)
SELECT docs.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id""",
}
