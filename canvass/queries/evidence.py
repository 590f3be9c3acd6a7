"""Attribution and migration: the benchmark items are the registry of phrases and the rule text."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import scores
from canvass.functions import text as X
from canvass.operators import evidence as V
from canvass.operators.clusters import exact_clusters
from canvass.operators.export import first_by
from canvass.queries.registry import query
from canvass.sources.testdata import comments, table


def clusters(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("cluster_id"), "text")


def registry(spark, d):
    item = F.col("item_id")
    return table(spark, d, "benchmark").select(F.concat(F.lit("entity"), (item % 10).cast("string")).alias("entity_name"), F.col("text").alias("phrase"), item.alias("ord"))


_HITS = r"""
c AS (SELECT doc_id::VARCHAR AS cluster_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
r AS (SELECT 'entity' || (item_id % 10) AS entity_name, text AS phrase, item_id AS ord, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM benchmark),
hits AS (SELECT cluster_id, entity_name, phrase, ord FROM c JOIN r ON contains(t, p))"""


@query("J8_exact_hits", f"WITH {_HITS} SELECT cluster_id, entity_name, ord FROM hits")
def exact_hits(spark, d):
    return V.phrase_hits(clusters(spark, d), registry(spark, d)).where("exact").select("cluster_id", "entity_name", "ord")


@query("M12_attributions", f"""
WITH {_HITS}, g AS (SELECT cluster_id, entity_name, count(*) AS n, arg_min(phrase, ord) AS phrase FROM hits GROUP BY 1, 2)
SELECT cluster_id, entity_name, 'exact_phrase_match' AS evidence_type, phrase AS matched_phrase, CASE WHEN n > 1 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence_score, 'high' AS confidence_label,
  sha256(cluster_id || chr(0) || entity_name || chr(0) || phrase || chr(0) || 'exact_phrase_match' || chr(0)) AS attribution_id FROM g""")
def attributions(spark, d):
    rows = V.attributions(clusters(spark, d), registry(spark, d)).where("evidence_type = 'exact_phrase_match'")
    return rows.select("cluster_id", "entity_name", "evidence_type", "matched_phrase", F.round("confidence_score", 6).alias("confidence_score"), "confidence_label", "attribution_id")


@query("M12_registry_only")
def registry_only(spark, d):
    rows = V.attributions(clusters(spark, d), registry(spark, d)).where("evidence_type <> 'exact_phrase_match'")
    return rows.groupBy("entity_name", "evidence_type", "confidence_label").agg(F.count(F.lit(1)).alias("n"))


@query("N5_best_attribution", f"""
WITH {_HITS}, g AS (SELECT cluster_id, entity_name, CASE WHEN count(*) > 1 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence_score FROM hits GROUP BY 1, 2)
SELECT cluster_id, entity_name, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence_score DESC, entity_name) AS r FROM g) WHERE r = 1""")
def best_attribution(spark, d):
    rows = attributions(spark, d).select("cluster_id", "entity_name", "confidence_score")
    return first_by(rows, "cluster_id", F.desc("confidence_score"), "entity_name")


@query("X13_excerpts", f"""
WITH {_HITS}, s AS (SELECT c.cluster_id, h.ord, c.text, h.phrase, instr(c.t, lower(trim(regexp_replace(h.phrase, '\\s+', ' ', 'g')))) - 1 AS i FROM hits h JOIN c USING (cluster_id)),
e AS (SELECT *, greatest(0, i - 120) AS a, least(length(text), i + length(phrase) + 120) AS b FROM s)
SELECT cluster_id, ord, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(text, a + 1, b - a), E' \\t\\n\\r') || CASE WHEN b < length(text) THEN '...' ELSE '' END AS excerpt FROM e""")
def excerpts(spark, d):
    hits = V.phrase_hits(clusters(spark, d), registry(spark, d)).where("exact")
    return hits.join(clusters(spark, d), "cluster_id").select("cluster_id", "ord", X.excerpt(F.col("text"), F.col("phrase")).alias("excerpt"))


def campaigns(spark, d):
    """Representative texts of the clusters of equal texts."""
    c = comments(spark, d)
    found, _ = exact_clusters(c)
    texts = c.select(F.col("comment_id").alias("representative_comment_id"), F.col("raw_text").alias("text"))
    return found.select("cluster_id", "representative_comment_id").join(texts, "representative_comment_id").select("cluster_id", "text")


def rules(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("Section "), F.col("item_id").cast("string")).alias("section"), F.col("text").alias("body"))


@query("J9_N10_rule_matches")
def rule_matches(spark, d):
    matches = V.rule_matches(campaigns(spark, d), rules(spark, d))
    return matches.select("cluster_id", "phrase_ord", "section", F.round("ratio", 6).alias("ratio"))


@query("M13_migrations")
def migrations(spark, d):
    rows = V.migrations(V.rule_matches(campaigns(spark, d), rules(spark, d)), "rule")
    return rows.select("migration_id", "cluster_id", "section", "match_type", "confidence_score", "confidence_label", "claim_scope")


@query("M13_bands", """
SELECT l_orderkey, l_linenumber, t AS match_type, s::DOUBLE AS score, CASE WHEN s < 0.5 THEN 'needs_review' WHEN s >= 0.75 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS label,
  CASE WHEN t = 'exact' AND l_quantity >= 12 THEN 'possible_influence' ELSE 'phrase_overlap' END AS scope
FROM (SELECT *, CASE t WHEN 'exact' THEN 0.80 WHEN 'near_exact' THEN 0.65 ELSE 0.45 END AS s FROM (SELECT *, CASE WHEN l_discount >= 0.06 THEN 'exact' WHEN l_discount >= 0.03 THEN 'near_exact' ELSE 'semantic' END AS t FROM lineitem))""")
def bands(spark, d):
    kind = scores.match_type(F.when(F.col("l_discount") >= 0.06, 1.0).when(F.col("l_discount") >= 0.03, 0.9).otherwise(0.5))
    score = scores.migration_score(kind)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", kind.alias("match_type"), score.alias("score"), scores.confidence_label(score, 0.75).alias("label"),
        scores.claim_scope(kind, F.col("l_quantity")).alias("scope"),
    )


@query("M11_attribution_bands", "SELECT event_id, CASE WHEN s < 0.5 THEN 'needs_review' WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS label FROM (SELECT event_id, (event_id % 100) / 100.0 AS s FROM events)")
def attribution_bands(spark, d):
    return table(spark, d, "events").select("event_id", scores.confidence_label((F.col("event_id") % 100) / 100.0).alias("label"))


@query("A23_by_label", f"WITH {_HITS}, g AS (SELECT cluster_id, entity_name, count(*) AS n FROM hits GROUP BY 1, 2) SELECT entity_name, count(*) AS n FROM g GROUP BY 1")
def by_label(spark, d):
    return attributions(spark, d).groupBy("entity_name").agg(F.count(F.lit(1)).alias("n"))
