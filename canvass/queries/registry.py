"""Where queries register: a function from (spark, sf_dir) to a DataFrame, and SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parsed comments, in SQL.
COMMENTS = r"""
comments AS (
  SELECT doc_id::VARCHAR AS comment_id, doc_id, lang AS docket_id, source, text AS raw_text, n_chars,
         lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normalized_text,
         sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS text_hash
  FROM documents)"""
#: Clusters of equal texts with their members, in SQL.
EXACT = COMMENTS + r""",
groups AS (
  SELECT docket_id, text_hash, count(*) AS cluster_size, list_sort(list(comment_id)) AS ids,
         arg_min(comment_id, (-length(normalized_text), comment_id)) AS representative_comment_id
  FROM comments GROUP BY ALL HAVING count(*) >= 2),
clusters AS (
  SELECT sha256('v1_exact_hash|' || docket_id || '|' || text_hash || '|[''' || array_to_string(ids, ''', ''') || ''']') AS cluster_id, *
  FROM groups),
members AS (
  SELECT c.cluster_id, m.comment_id, m.docket_id, m.text_hash, c.cluster_size, m.comment_id = c.representative_comment_id AS is_representative,
         row_number() OVER (PARTITION BY c.cluster_id ORDER BY m.comment_id <> c.representative_comment_id, m.comment_id) AS membership_rank,
         m.raw_text, m.normalized_text, m.n_chars, m.source
  FROM comments m JOIN clusters c USING (docket_id, text_hash))"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views above in a WITH clause."""

    def add(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return f

    return add
