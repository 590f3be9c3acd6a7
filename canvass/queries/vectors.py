"""Vectors: norms, similarity join, nearest neighbours, components, medoids and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions.udfs import mock_embedding
from canvass.operators import clusters as C
from canvass.operators import vectors as V
from canvass.queries.registry import query
from canvass.sources.shared import stored
from canvass.sources.testdata import table, vectors

#: The test vectors lie far apart; the closest pair to this cut is 1e-4 away from it.
THRESHOLD = 0.40

_PAIRS = f"""
v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
pairs AS (SELECT least(a.vec_id::VARCHAR, b.vec_id::VARCHAR) AS a, greatest(a.vec_id::VARCHAR, b.vec_id::VARCHAR) AS b, list_dot_product(a.v, b.v) AS similarity
  FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= {THRESHOLD})"""
_PARTS = _PAIRS + """,
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
parts AS (SELECT node AS comment_id, min(seen) AS component FROM reach GROUP BY node),
means AS (SELECT x.component, x.comment_id, round(avg(list_dot_product(p.v, q.v)), 9) AS m FROM parts x JOIN parts y USING (component)
  JOIN v p ON p.vec_id::VARCHAR = x.comment_id JOIN v q ON q.vec_id::VARCHAR = y.comment_id GROUP BY ALL),
centres AS (SELECT component, comment_id AS representative_comment_id FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY m DESC, comment_id) AS r FROM means) WHERE r = 1),
ranked AS (SELECT x.component, x.comment_id, c.representative_comment_id, round(list_dot_product(p.v, q.v), 9) AS s FROM parts x JOIN centres c USING (component)
  JOIN v p ON p.vec_id::VARCHAR = x.comment_id JOIN v q ON q.vec_id::VARCHAR = c.representative_comment_id)"""


def unit(spark, d):
    return V.normalized(vectors(spark, d))


def pairs(spark, d):
    return V.similar_pairs(unit(spark, d), THRESHOLD)


def ranked(spark, d):
    edges = stored(V.similar_links(unit(spark, d), THRESHOLD), "links")
    parts = stored(C.components_of(edges), "parts")
    return C.ranked(stored(C.medoids(parts.join(unit(spark, d).select("comment_id", "v"), "comment_id")), "medoids"))


@query("M1_unit_vectors", "SELECT vec_id::VARCHAR AS comment_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def unit_vectors(spark, d):
    return vectors(spark, d).select("comment_id", F.round(V.norm("v"), 6).alias("norm"))


@query("M10_valid_vectors", "SELECT count(*) AS rows, count(*) FILTER (WHERE len(embedding) = 64) AS valid FROM embeddings")
def valid_vectors(spark, d):
    return vectors(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_if(V.is_valid("v", 64)).alias("valid"))


@query("J10_similar_pairs", f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def similar_pairs(spark, d):
    return pairs(spark, d).withColumn("similarity", F.round("similarity", 6))


@query("J11_nearest", f"""
WITH {_PAIRS}, e AS (SELECT a AS comment_id, b AS neighbour_id, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)
SELECT comment_id, neighbour_id, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY similarity DESC, neighbour_id) AS r FROM e) WHERE r <= 3""")
def nearest(spark, d):
    return V.nearest_similar(unit(spark, d), 3, THRESHOLD).select("comment_id", "neighbour_id", "rank")


@query("M3_components", f"WITH RECURSIVE {_PARTS} SELECT comment_id, component FROM parts")
def components(spark, d):
    return C.components_of(stored(V.similar_links(unit(spark, d), THRESHOLD), "links"))


@query("N1_membership_ranks", f"WITH RECURSIVE {_PARTS} SELECT component, comment_id, representative_comment_id, round(s, 6) AS similarity_to_representative, row_number() OVER (PARTITION BY component ORDER BY s DESC, comment_id) AS membership_rank FROM ranked")
def membership_ranks(spark, d):
    return ranked(spark, d).withColumn("similarity_to_representative", F.round("similarity_to_representative", 6))


@query("N4_medoids", f"WITH RECURSIVE {_PARTS} SELECT component, representative_comment_id FROM centres")
def medoids(spark, d):
    return ranked(spark, d).select("component", "representative_comment_id").distinct()


@query("A3_cluster_statistics", f"WITH RECURSIVE {_PARTS} SELECT component, representative_comment_id, count(*) AS cluster_size, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS min_similarity, round(max(s), 6) AS max_similarity FROM ranked GROUP BY ALL")
def cluster_statistics(spark, d):
    rows = C.statistics(ranked(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_similarity", "min_similarity", "max_similarity")})


@query("A22_slice_sanity", "SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim, count(DISTINCT label) AS labels FROM embeddings")
def slice_sanity(spark, d):
    e = table(spark, d, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"), F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"), F.countDistinct("label").alias("labels"))


@query("M9_mock_embeddings")
def mock_embeddings(spark, d):
    return table(spark, d, "documents").select("doc_id", mock_embedding(8)("text").alias("v"))


@query("J15_neighbour_previews", f"""
WITH {_PAIRS} SELECT p.a, p.b, round(p.similarity, 6) AS similarity, substr(d.text, 1, 40) AS preview FROM pairs p LEFT JOIN documents d ON d.doc_id::VARCHAR = p.b""")
def neighbour_previews(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("b"), F.substring("text", 1, 40).alias("preview"))
    return pairs(spark, d).join(docs, "b", "left").select("a", "b", F.round("similarity", 6).alias("similarity"), "preview")
