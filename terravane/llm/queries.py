"""The queries of this subpackage, one for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terravane.llm.common import documents
from terravane.llm.decontaminate import find_contamination
from terravane.llm.exact_dedup import exact_groups
from terravane.llm.language_id import language_id
from terravane.llm.line_dedup import dedup_lines
from terravane.llm.ngram_join import ngram_components
from terravane.llm.packing import pack
from terravane.llm.secrets import scan_secrets
from terravane.llm.token_count import token_counts
from terravane.llm.token_files import token_files
from terravane.llm.toxicity import score_toxicity, train_toxicity


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return scan_secrets(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document in the token files, read back from them."""
    return token_files(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, and the one that stays."""
    return exact_groups(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and what is left of its text."""
    return dedup_lines(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component of links."""
    return ngram_components(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language and a score for every document."""
    return language_id(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a prediction for every document."""
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of the benchmark, and the items they come from."""
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, boundary, batch, slot and padding of every document, by its token count."""
    return pack(token_counts(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_decontaminate, op4_token_files, op5_exact_dedup, op6_line_dedup, op7_ngram_join, op8_token_counts, op9_language_id, op10_packing)}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": r"""
        WITH low(doc_id, w) AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
            FROM documents
        ), items(item_id, w) AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
            FROM benchmark
        ), wins AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM items) WHERE n > 0)
        ), spots AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
        ), hits AS (SELECT doc_id, item_id, i, s.n FROM spots s JOIN wins USING (n, t)
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM low LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i AS ln, l[i] AS line,
                   list_filter(string_split(translate(lower(l[i]), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '') AS w
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
        ), classes AS (
            SELECT w, min(row(doc_id, ln)) AS o,
                   CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
            FROM lines WHERE len(w) > 0 GROUP BY w
        ), tokens AS (SELECT o, len(s) AS n, unnest(s) AS t FROM classes
        ), matched AS (
            SELECT DISTINCT o FROM (
                SELECT a.o FROM tokens a JOIN tokens b ON a.t = b.t AND b.o < a.o
                GROUP BY a.o, b.o, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*)))
        ), marked AS (
            SELECT l.doc_id, l.ln, l.line, c.o IS NOT NULL AND (row(l.doc_id, l.ln) <> c.o OR m.o IS NOT NULL) AS gone
            FROM lines l LEFT JOIN classes c ON l.w = c.w LEFT JOIN matched m ON c.o = m.o
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
        FROM documents d LEFT JOIN (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone) AS t
            FROM marked GROUP BY doc_id) x USING (doc_id)
    """,
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
            FROM w
        ), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.t = b.t AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach(x, y) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
        )
        SELECT sets.doc_id, len(s) AS n_shingles, c.component_id
        FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
    """,
}
