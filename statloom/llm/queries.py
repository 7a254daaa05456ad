"""The queries of the corpus operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import alignment, html, language, line_dedup, mixing, neighbours, packing, positive_unlabelled, prefix_trie, quality, simhash, urls, warc
from statloom.llm.base import table

#: The site rules of the query.
URL_RULES = (
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
)
TOKENIZER = "word_bpe_49k.json"
#: The vocabulary of byte_bpe_50k.json as ranks, which gives the same ids at four times the speed, and the pieces.
ALIGNED = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
#: Names of unwanted sites, each listed under these parent domains.
SPAM_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SPAM_HOSTS = tuple(f"{n}.example.{t}" for n in SPAM_NAMES for t in ("com", "net", "org"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive_unlabelled.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, SPAM_HOSTS)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ALIGNED)
    return alignment.align(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_warc": op2_warc,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filters": op10_url_filters,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_alignment": op12_alignment,
    "op13_line_dedup": op13_line_dedup,
}

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _sql_rules() -> str:
    return ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)


def _sql_hosts() -> str:
    return ", ".join(f"('{h}')" for h in SPAM_HOSTS)


ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH rows AS (
            SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages
        ), digests AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM rows
        ), firsts AS (
            SELECT hex, min(page_id) AS first_id FROM digests GROUP BY hex
        )
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(d.hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM digests d JOIN firsts f ON d.hex = f.hex
    """,
    "op10_url_filters": f"""
        WITH rules(host, path, verdict) AS (VALUES {_sql_rules()}),
        blocked(host) AS (VALUES {_sql_hosts()}),
        parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        fits AS (
            SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
            FROM parts p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, f.rule,
            coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE ('.' || p.host) LIKE ('%.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
    """,
    "op11_prefix_trie": """
        WITH ordered AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), words AS (
            SELECT role, text, row_number() OVER (ORDER BY role, text) AS id, strlen(text) AS bytes FROM (SELECT DISTINCT role, text FROM ordered)
        ), convs AS (
            SELECT c, list(id ORDER BY pos) AS ids FROM ordered JOIN words USING (role, text) GROUP BY c
        ), lent AS (
            SELECT c, ids, c - c % 5 AS base FROM convs
        ), bytes_of AS (
            SELECT c, list_transform(range(1, CAST(length(CAST(c AS VARCHAR)) AS BIGINT) + 1), lambda i: ascii(substr(CAST(c AS VARCHAR), i, 1))) AS b FROM convs
        ), crc AS (
            SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda r, x: list_reduce(list_prepend(xor(r, x::BIGINT), range(0, 8)),
                lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h FROM bytes_of
        ), rebuilt AS (
            SELECT l.c, list_concat(coalesce(l2.ids, [])[1:h], l.ids[h + 1:]) AS ids FROM lent l JOIN crc USING (c) LEFT JOIN convs l2 ON l2.c = l.base
        ), prefixes AS (
            SELECT c, len(ids) AS total, d, ids[1:d] AS node, ids[d] AS last FROM (SELECT c, ids, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT d, node, min(c) AS conv_id, count(*) AS n, any_value(last) AS last, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (total = d), '')) AS ends
            FROM prefixes GROUP BY d, node
        ), sized AS (
            SELECT nodes.*, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * bytes END AS own FROM nodes LEFT JOIN words ON last = id
        ), kids AS (
            SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
        ), told AS (
            SELECT s.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent FROM sized s LEFT JOIN kids USING (d, node) LEFT JOIN nodes p ON s.d > 0 AND p.d = s.d - 1 AND p.node = s.node[1:s.d - 1]
        ), up AS (
            SELECT top AS d, node[1:top] AS node, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS top FROM told) GROUP BY ALL
        )
        SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
        FROM told JOIN up USING (d, node)
    """,
    "op13_line_dedup": r"""
        WITH lines AS (
            SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
        ), repeated AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (keeper <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated USING (k) GROUP BY r, doc_id
    """,
}
