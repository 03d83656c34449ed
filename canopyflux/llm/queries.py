"""The registered queries of the corpus operators and, where SQL can express them, the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_copies
from .html_text import extract_text
from .licences import scan_licences
from .packing import pack_documents
from .pii import find_personal_data
from .quality import judge
from .sentencepiece import encode_texts
from .simhash import near_duplicates
from .url_filter import filter_urls
from .warc import archive_round_trip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_filters": op5_url_filters,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op8_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             k AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS h FROM p),
             b AS (SELECT page_id, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM k),
             d AS (SELECT page_id, list_reduce(list_transform(range(0, 32), lambda i:
                     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INTEGER), lambda x, y: 2 * x + y), 1)), lambda x, y: x || y) AS digest FROM b)
        SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM k JOIN d USING (page_id)""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_SQUEEZED} AS content FROM documents),
             w AS (SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
                          first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM w""",
    "op9_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS s,
                          list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
             r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
             c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(5) AS q(j) GROUP BY doc_id),
             m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                          length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                          len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                            - len(list_distinct(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
                          coalesce(c.n, 0) AS n_repeat_words,
                          length(regexp_replace(s, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS letters,
                          len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS echoes
                   FROM w LEFT JOIN c USING (doc_id)),
             b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols / n_words > 0.3 OR coalesce(upper / nullif(letters, 0), 0) > 0.6 OR echoes / n_words > 0.3) AS kept
        FROM b""",
}
