"""Clusters of equal texts and the dashboard figures over them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import ids
from canvass.functions import text as X
from canvass.operators import clusters as C
from canvass.operators import export as E
from canvass.queries.registry import COMMENTS, EXACT, query
from canvass.sources.testdata import comments, table


def members_with_text(spark, d):
    c = comments(spark, d)
    clusters, members = C.exact_clusters(c)
    return clusters, members, members.join(c.select("comment_id", "raw_text", "normalized_text", "char_count", "source"), "comment_id")


@query("A1_exact_groups", f"WITH {COMMENTS} SELECT docket_id, text_hash, count(*) AS cluster_size FROM comments GROUP BY ALL HAVING count(*) >= 2")
def exact_groups(spark, d):
    return C.exact_groups(comments(spark, d))


@query("N2_exact_ranks", f"WITH {EXACT} SELECT cluster_id, comment_id, membership_rank, is_representative FROM members")
def exact_ranks(spark, d):
    return C.exact_clusters(comments(spark, d))[1].select("cluster_id", "comment_id", "membership_rank", "is_representative")


@query("N3_representatives", f"WITH {EXACT} SELECT cluster_id, docket_id, cluster_size, representative_comment_id FROM clusters")
def representatives(spark, d):
    return C.exact_clusters(comments(spark, d))[0].select("cluster_id", "docket_id", "cluster_size", "representative_comment_id")


@query("M5_run_id", f"""
WITH {COMMENTS} SELECT docket_id, sha256(docket_id || chr(0) || 'hash' || chr(0) || 'v1' || chr(0) || '1.00000000' || chr(0)
  || array_to_string(list_sort(list(comment_id)), chr(0)) || chr(0) || array_to_string(list_sort(list(text_hash)), chr(0)) || chr(0)) AS run_id FROM comments GROUP BY docket_id""")
def run_id(spark, d):
    return comments(spark, d).groupBy("docket_id").agg(
        ids.run_id(F.col("docket_id"), "hash", "v1", 1.0, F.collect_list("comment_id"), F.collect_list("text_hash")).alias("run_id")
    )


@query("A2_exact_match_ratio", f"""
WITH {COMMENTS}, g AS (SELECT docket_id AS cluster_id, text_hash, count(*) AS n FROM comments GROUP BY ALL)
SELECT cluster_id, round(max(n) / sum(n), 6) AS exact_match_ratio FROM g GROUP BY cluster_id""")
def exact_match_ratio(spark, d):
    rows = E.exact_match_ratio(comments(spark, d).withColumnRenamed("docket_id", "cluster_id"))
    return rows.select("cluster_id", F.round("exact_match_ratio", 6).alias("exact_match_ratio"))


@query("A4_cluster_summary", f"""
WITH {EXACT} SELECT docket_id, cluster_id, cluster_size, max(CASE WHEN is_representative THEN comment_id END) AS representative,
  max(CASE WHEN is_representative THEN substr(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), 1, 80) END) AS sample, count(DISTINCT source) AS sources
FROM members GROUP BY docket_id, cluster_id, cluster_size""")
def cluster_summary(spark, d):
    """Flagship: clusters of equal texts with their representatives and sizes."""
    clusters, _, rows = members_with_text(spark, d)
    rows = rows.join(clusters.select("cluster_id", "cluster_size"), "cluster_id")
    return rows.groupBy("docket_id", "cluster_id", "cluster_size").agg(
        F.max(F.when(F.col("is_representative"), F.col("comment_id"))).alias("representative"),
        F.max(F.when(F.col("is_representative"), F.substring(X.collapse(F.col("raw_text")), 1, 80))).alias("sample"),
        F.countDistinct("source").alias("sources"),
    )


@query("A5_docket_stats", f"""
WITH {EXACT}, s AS (SELECT docket_id, count(DISTINCT cluster_id) AS clusters, count(*) AS in_clusters, max(cluster_size) AS largest FROM members GROUP BY docket_id)
SELECT c.docket_id, count(*) AS comments, coalesce(any_value(s.clusters), 0) AS clusters, coalesce(any_value(s.in_clusters), 0) AS in_clusters,
  coalesce(any_value(s.largest), 0) AS largest, round(100.0 * coalesce(any_value(s.in_clusters), 0) / count(*), 2)::DOUBLE AS coverage_pct
FROM comments c LEFT JOIN s USING (docket_id) GROUP BY c.docket_id""")
def docket_stats(spark, d):
    c = comments(spark, d)
    clusters, members = C.exact_clusters(c)
    stats = clusters.groupBy("docket_id").agg(F.count(F.lit(1)).alias("clusters"), F.sum("cluster_size").alias("in_clusters"), F.max("cluster_size").alias("largest"))
    rows = c.groupBy("docket_id").agg(F.count(F.lit(1)).alias("comments")).join(stats, "docket_id", "left").fillna(0)
    return rows.withColumn("coverage_pct", F.round(100.0 * F.col("in_clusters") / F.col("comments"), 2))


@query("A6_pipeline_counts", f"""
WITH {EXACT} SELECT 'comments' AS stage, count(*) AS n FROM comments UNION ALL SELECT 'clusters', count(*) FROM clusters
UNION ALL SELECT 'memberships', count(*) FROM members UNION ALL SELECT 'dockets', count(DISTINCT docket_id) FROM comments""")
def pipeline_counts(spark, d):
    c = comments(spark, d)
    clusters, members = C.exact_clusters(c)
    one = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    out = one("comments", c).unionByName(one("clusters", clusters)).unionByName(one("memberships", members))
    return out.unionByName(c.agg(F.countDistinct("docket_id").alias("n")).select(F.lit("dockets").alias("stage"), "n"))


@query("A8_docket_rows", f"WITH {EXACT} SELECT docket_id, count(*) AS rows, count(DISTINCT cluster_id) AS clusters, max(cluster_size) AS largest FROM members GROUP BY docket_id")
def docket_rows(spark, d):
    clusters, _ = C.exact_clusters(comments(spark, d))
    return clusters.groupBy("docket_id").agg(F.sum("cluster_size").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.max("cluster_size").alias("largest"))


@query("A9_by_size", f"WITH {EXACT} SELECT cluster_size, count(*) AS clusters FROM clusters GROUP BY cluster_size")
def by_size(spark, d):
    return C.exact_groups(comments(spark, d)).groupBy("cluster_size").agg(F.count(F.lit(1)).alias("clusters"))


@query("A10_duplicate_stats", f"""
WITH {COMMENTS}, g AS (SELECT source AS cluster_id, text_hash, count(*) AS n FROM comments GROUP BY ALL)
SELECT cluster_id, count(*) AS unique_hashes, count(*) FILTER (WHERE n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_members,
  max(n) AS largest, sum(n)::BIGINT AS size FROM g GROUP BY cluster_id""")
def duplicate_stats(spark, d):
    return E.duplicate_stats(comments(spark, d).withColumnRenamed("source", "cluster_id"))


@query("X15_cluster_class", f"""
WITH {COMMENTS}, g AS (SELECT source, text_hash, count(*) AS n FROM comments GROUP BY ALL), s AS (SELECT source, sum(n) AS size, count(*) AS uniq, max(n) AS largest FROM g GROUP BY source)
SELECT source AS cluster_id, CASE WHEN size <= 1 THEN 'mixed' WHEN uniq >= 0.8 * size THEN 'paraphrase' WHEN largest >= 0.6 * size THEN 'exact_duplicate' ELSE 'mixed' END AS class FROM s""")
def cluster_class(spark, d):
    s = E.duplicate_stats(comments(spark, d).withColumnRenamed("source", "cluster_id"))
    return s.select("cluster_id", X.cluster_class(F.col("size"), F.col("unique_hashes"), F.col("largest")).alias("class"))


@query("A11_overview", """
SELECT count(*) AS rows, count(DISTINCT doc_id) AS unique_ids, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank,
  count(*) FILTER (WHERE doc_id % 3 = 0) AS with_attachments, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents""")
def overview(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("unique_ids"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("duplicate_ids"),
        F.count_if(X.blank(F.col("text"))).alias("blank"), F.count_if(F.col("doc_id") % 3 == 0).alias("with_attachments"),
        F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
    )


@query("A12_duplicate_texts", f"WITH {COMMENTS} SELECT text_hash, count(*) AS n, arg_min(raw_text, doc_id) AS sample FROM comments GROUP BY text_hash HAVING count(*) > 1")
def duplicate_texts(spark, d):
    c = comments(spark, d).withColumn("id", F.col("comment_id").cast("long"))
    groups = c.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1")
    return groups.join(c.select("id", F.col("raw_text").alias("sample")), "id").select("text_hash", "n", "sample")


@query("A14_value_counts", "SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def value_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("A18_repeated_sentences", r"""
WITH s AS (SELECT lang AS docket_id, doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s,
  generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM documents),
g AS (SELECT docket_id, trim(s, E' \t\n\r') AS sentence, count(*) AS n, min((doc_id, pos)) AS f FROM s WHERE length(trim(s, E' \t\n\r')) > 20 AND contains(trim(s, E' \t\n\r'), ' ') GROUP BY ALL)
SELECT docket_id, sentence, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY n DESC, f) AS rank FROM g) WHERE rank <= 5""")
def repeated_sentences(spark, d):
    c = comments(spark, d).withColumn("ord", F.col("comment_id").cast("long"))
    return E.repeated_sentences(c, "docket_id", "raw_text", "ord")


@query("A19_purity", r"""
WITH s AS (SELECT lang AS docket_id, doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s,
  generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM documents),
g AS (SELECT docket_id, trim(s, E' \t\n\r') AS sentence, count(*) AS n, min((doc_id, pos)) AS f FROM s WHERE length(trim(s, E' \t\n\r')) > 30 AND contains(trim(s, E' \t\n\r'), ' ') GROUP BY ALL),
b AS (SELECT docket_id, lower(sentence) AS q FROM (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY n DESC, f) AS r FROM g) WHERE r <= 3),
h AS (SELECT DISTINCT d.doc_id FROM documents d JOIN b ON b.docket_id = d.lang AND contains(lower(d.text), b.q))
SELECT lang AS docket_id, count(*) AS n, round(count(h.doc_id) / count(*), 4) AS purity FROM documents LEFT JOIN h USING (doc_id) GROUP BY lang""")
def purity(spark, d):
    return E.purity(comments(spark, d).withColumn("ord", F.col("comment_id").cast("long")), "docket_id", "raw_text", "ord")


@query("A20_benchmark", f"""
WITH {EXACT}, e AS (SELECT count(DISTINCT cluster_id) AS clusters, count(*) AS covered FROM members), t AS (SELECT count(*) AS n FROM comments)
SELECT n AS sampled, clusters, covered, round(100.0 * covered / n, 2)::DOUBLE AS coverage_pct, round(covered / greatest(covered, 1), 3)::DOUBLE AS lift,
  (n * (n - 1) // 2)::BIGINT AS all_pairs, (n * n * 4)::BIGINT AS matrix_bytes FROM e, t""")
def benchmark(spark, d):
    c = comments(spark, d)
    e = C.exact_groups(c).agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("covered"))
    rows = c.agg(F.count(F.lit(1)).alias("sampled")).join(e)
    n, k = F.col("sampled"), F.col("covered")
    return rows.withColumns({
        "coverage_pct": F.round(100.0 * k / n, 2), "lift": F.round(k / F.greatest(k, F.lit(1)), 3), "all_pairs": F.expr("sampled * (sampled - 1) div 2"), "matrix_bytes": n * n * 4
    })


@query("A21_null_shares", "SELECT 'text' AS col, count(*) - count(text) AS nulls, round(100.0 * (count(*) - count(text)) / count(*), 2)::DOUBLE AS pct FROM documents UNION ALL SELECT 'lang', count(*) - count(lang), round(100.0 * (count(*) - count(lang)) / count(*), 2) FROM documents")
def null_shares(spark, d):
    counts = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("text", "lang")])
    rows = counts.unpivot("n", ["text", "lang"], "col", "have")
    return rows.select("col", (F.col("n") - F.col("have")).alias("nulls"), F.round(100.0 * (F.col("n") - F.col("have")) / F.col("n"), 2).alias("pct"))


@query("N8_copies_in_cluster", f"WITH {EXACT} SELECT comment_id, count(*) OVER (PARTITION BY source, text_hash) AS copies FROM members")
def copies_in_cluster(spark, d):
    rows = members_with_text(spark, d)[2]
    return rows.select("comment_id", F.count(F.lit(1)).over(W.partitionBy("source", "text_hash")).alias("copies"))


@query("T1_select_clusters", f"WITH {EXACT} SELECT cluster_id, cluster_size FROM clusters ORDER BY cluster_size DESC, cluster_id LIMIT 10")
def select_clusters(spark, d):
    return C.exact_clusters(comments(spark, d))[0].orderBy(F.desc("cluster_size"), "cluster_id").limit(10).select("cluster_id", "cluster_size")


@query("T5_cluster_detail", f"WITH {EXACT} SELECT cluster_id, comment_id, row_number() OVER (PARTITION BY cluster_id ORDER BY is_representative DESC, n_chars, comment_id)::INTEGER AS place FROM members")
def cluster_detail(spark, d):
    rows = members_with_text(spark, d)[2]
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("is_representative"), "char_count", "comment_id"))
    return rows.select("cluster_id", "comment_id", place.alias("place"))


@query("J1_J5_review_export", f"""
WITH {EXACT}, r AS (SELECT cluster_id, max(n) / sum(n) AS ratio FROM (SELECT cluster_id, text_hash, count(*) AS n FROM members GROUP BY ALL) GROUP BY cluster_id)
SELECT m.cluster_id, m.comment_id, m.docket_id, m.cluster_size, m.membership_rank, m.is_representative, length(m.raw_text)::BIGINT AS char_count, round(r.ratio, 6) AS exact_match_ratio,
  CASE WHEN length(trim(regexp_replace(m.raw_text, '\\s+', ' ', 'g'))) <= 500 THEN trim(regexp_replace(m.raw_text, '\\s+', ' ', 'g')) ELSE substr(trim(regexp_replace(m.raw_text, '\\s+', ' ', 'g')), 1, 497) || '...' END AS text_preview
FROM members m LEFT JOIN r USING (cluster_id)""")
def review_export(spark, d):
    c = comments(spark, d)
    clusters, members = C.exact_clusters(c)
    rows = E.review_export(members.drop("is_representative"), clusters.drop("docket_id", "text_hash"), c)
    return rows.select(
        "cluster_id", "comment_id", "docket_id", "cluster_size", "membership_rank", "is_representative", "char_count",
        F.round("exact_match_ratio", 6).alias("exact_match_ratio"), "text_preview",
    )


@query("A25_similarity_rollup", f"WITH {EXACT} SELECT cluster_id, round(avg(1.0), 5)::DOUBLE AS mean_similarity, round(min(1.0), 5)::DOUBLE AS min_similarity FROM members GROUP BY cluster_id")
def similarity_rollup(spark, d):
    m = C.exact_clusters(comments(spark, d))[1]
    s = "similarity_to_representative"
    return m.groupBy("cluster_id").agg(F.round(F.avg(s), 5).alias("mean_similarity"), F.round(F.min(s), 5).alias("min_similarity"))


@query("A28_run_metadata", f"""
WITH {EXACT} SELECT c.docket_id, max(c.cluster_size) AS largest, round(avg(c.cluster_size), 6) AS mean_size,
  round(sum(c.cluster_size) / (SELECT count(*) FROM comments k WHERE k.docket_id = c.docket_id), 6) AS coverage FROM clusters c GROUP BY c.docket_id""")
def run_metadata(spark, d):
    c = comments(spark, d)
    rows = C.exact_groups(c).groupBy("docket_id").agg(F.max("cluster_size").alias("largest"), F.round(F.avg("cluster_size"), 6).alias("mean_size"), F.sum("cluster_size").alias("covered"))
    total = c.groupBy("docket_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(total, "docket_id").select("docket_id", "largest", "mean_size", F.round(F.col("covered") / F.col("n"), 6).alias("coverage"))
