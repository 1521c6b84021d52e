"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import html_text

    return html_text(table(spark, sf_dir, "pages", spread=True))


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality_knn import quality_votes

    held_out = (5, 0)
    judged = quality_votes(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"), held_out)
    return judged.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % held_out[0] == held_out[1]).alias("held_out"), "score", "predicted")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import bpe_ids

    return bpe_ids(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


#: The rule list that op2 applies: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import toxicity

    held_out = (3, 1)
    judged = toxicity(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"), held_out)
    return judged.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % held_out[0] == held_out[1]).alias("held_out"), "score", "predicted", "evidence")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", spread=True), width=4, percent=80)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import token_counts

    return token_counts(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import STATISTICS, quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *STATISTICS, "base_failed", "kept")


OP2_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES """ + ", ".join(str(r) for r in URL_RULES) + """),
parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS raw_host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
named AS (SELECT row_number() OVER () AS n, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM named LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""

OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id, d.doc_id = least_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

#: The pages hold nothing in their article element but its blocks, so a cut by patterns is what the operator must give there.
OP7_SQL = r"""
WITH article AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*$', '') AS h FROM pages),
parts AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')) AS ps FROM article),
decoded AS (SELECT page_id, url, list_transform(ps, lambda x: replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS ps FROM parts),
plain AS (SELECT page_id, url, list_filter(list_transform(ps, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM decoded),
texts AS (SELECT page_id, url, array_to_string(ps, chr(10)) AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""

#: Greedy longest match: every distinct word is walked from longest piece to longest piece.
_PIECES = rf"""
WITH RECURSIVE vocabulary AS (SELECT hex(from_base64(token)) AS t FROM read_csv('{public_tokenizers.path("byte_bpe_50k.tiktoken")}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
bytes AS (SELECT lpad(hex(b), 2, '0') AS t FROM range(0, 256) r(b)),
pieces AS (SELECT true AS starts, t[3:] AS t FROM vocabulary WHERE t[:2] = '20' AND length(t) > 2 UNION SELECT false, t FROM vocabulary WHERE t[:2] <> '20' UNION SELECT f, t FROM bytes, (VALUES (true), (false)) v(f)),
lengths AS (SELECT DISTINCT length(t) AS n FROM pieces),
words AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
each AS (SELECT row, unnest(ws) AS word FROM words),
different AS (SELECT DISTINCT word, hex(word) AS h FROM each),
walk(word, h, pos, steps) AS (
  SELECT word, h, 1::BIGINT, 0 FROM different
  UNION ALL
  SELECT word, h, pos + max(n), steps + 1 FROM (SELECT word, h, pos, steps, n, substr(h, pos, n) AS t, pos = 1 AS starts FROM walk JOIN lengths ON pos + n - 1 <= length(h)) tried JOIN pieces USING (starts, t) GROUP BY word, h, pos, steps),
word_pieces AS (SELECT word, max(steps) AS n FROM walk GROUP BY word),
totals AS (SELECT row, sum(n) AS n_tokens, max(n) AS longest FROM each JOIN word_pieces USING (word) GROUP BY row),
counted AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(longest, 0)::BIGINT AS longest FROM words LEFT JOIN totals USING (row))
"""

OP4_SQL = _PIECES + "SELECT doc_id, n_words, n_tokens, longest FROM counted"

#: What packing must give whatever its bins: every document's pieces and tokens.
PACKED_SQL = _PIECES + "SELECT doc_id, greatest(1, ceil(n_tokens / 2048))::BIGINT AS pieces, n_tokens FROM counted"

STATISTICS_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (SELECT row, unnest(range(1, len(ws) - 6)) AS i, ws FROM words WHERE len(ws) >= 8),
twice AS (SELECT row, list(i) AS places FROM (SELECT row, i, array_to_string(ws[i : i + 7], ' ') AS w FROM windows) GROUP BY row, w HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM (SELECT row, unnest(places) AS i FROM twice), range(0, 8) r(k) GROUP BY row),
lines AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM words),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (row) LEFT JOIN covered USING (row))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
"""

EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER o) AS after FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, length(t), sha256(t)))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) AS edited_sha256 FROM n
"""


def document_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_quality_rules that SQL can express: the statistics and what the base rules make of them."""
    from .quality_rules import STATISTICS

    return op5_quality_rules(spark, sf_dir).select("doc_id", *STATISTICS, "base_failed")


def document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_fingerprints that SQL can express: which document is next, and the edited text."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_best_fit_packing that SQL can express: how many pieces and tokens of each document stand in bins."""
    from pyspark.sql import functions as F

    placed = op6_best_fit_packing(spark, sf_dir).filter("bin_offset + piece_tokens <= 2048")
    return placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("n_tokens"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_url_filter": op2_url_filter, "op3_near_duplicates": op3_near_duplicates, "op4_token_counts": op4_token_counts, "op5_quality_rules": op5_quality_rules, "op6_best_fit_packing": op6_best_fit_packing, "op7_html_text": op7_html_text, "op8_quality_votes": op8_quality_votes, "op9_byte_bpe": op9_byte_bpe, "op10_fingerprints": op10_fingerprints}
QUERIES |= {"document_base_statistics": document_base_statistics, "document_edits": document_edits, "packed_documents": packed_documents}
ORACLES = {"op2_url_filter": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op4_token_counts": OP4_SQL, "op7_html_text": OP7_SQL}
ORACLES |= {"document_base_statistics": STATISTICS_SQL, "document_edits": EDITED_SQL, "packed_documents": PACKED_SQL}
