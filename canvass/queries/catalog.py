"""Scans, catalog search, ids and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import ids, scores, search
from canvass.functions import text as X
from canvass.operators import clusters as C
from canvass.queries.registry import COMMENTS, EXACT, query
from canvass.sources import readers, tables
from canvass.sources.testdata import comments, table


@query("S1_S3_filtered_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND abs(l_tax - 0.02) <= 1e-9")
def filtered_scan(spark, d):
    return readers.scan(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], (("l_returnflag", "R"), ("l_tax", 0.02)))


@query("S4_missing_filter_column", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def missing_filter_column(spark, d):
    return readers.scan(table(spark, d, "nation"), ["n_nationkey"], (("n_regionkey", 1), ("docket_id", "x")), "ignore")


@query("S18_named_parameters", "SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars >= 500")
def named_parameters(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("canvass_documents")
    return spark.sql("SELECT doc_id FROM canvass_documents WHERE lang = :docket AND n_chars >= :least", args={"docket": "fr", "least": 500})


@query("S5_sample_folders", "SELECT r_regionkey FROM region")
def sample_folders(spark, d):
    return readers.first_existing(spark, [f"{d}/nowhere", f"{d}/region.parquet"]).select("r_regionkey")


@query("W9_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR o_orderstatus IS NULL")
def delete(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tables.scope_replaced(rows, rows.limit(0), F.col("o_orderstatus") == "P").select("o_orderkey")


@query("W18_partial_update", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'done' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def partial_update(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return tables.partial_update(c, F.col("c_custkey") == 7, {"c_mktsegment": F.lit("done")}, ("c_mktsegment",))


@query("P7_constant_columns", "SELECT doc_id, 'labor' AS topic_id, CASE lang WHEN 'en' THEN 'Regulations.gov' ELSE 'FCC ECFS' END AS source_label FROM documents")
def constant_columns(spark, d):
    label = F.when(F.col("lang") == "en", "Regulations.gov").otherwise("FCC ECFS")
    return table(spark, d, "documents").select("doc_id", F.lit("labor").alias("topic_id"), label.alias("source_label"))


@query("F1_docket", "SELECT doc_id FROM documents WHERE lang = 'de'")
def docket(spark, d):
    return table(spark, d, "documents").where(F.col("lang") == "de").select("doc_id")


@query("F3_not_mock", "SELECT vec_id FROM embeddings WHERE label <> 3")
def not_mock(spark, d):
    return table(spark, d, "embeddings").where("label <> 3").select("vec_id")


@query("F7_pending", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def pending(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error")).select("event_id")


@query("F12_headline_without_size", "SELECT p_partkey FROM part WHERE NOT (p_name LIKE '%' || (p_partkey % 10) || '%')")
def headline_without_size(spark, d):
    size = (F.col("p_partkey") % 10).cast("string")
    return table(spark, d, "part").where(~F.like(F.col("p_name"), F.concat(F.lit("%"), size, F.lit("%")))).select("p_partkey")


@query("F15_size_floors", "SELECT o_orderkey, o_totalprice >= 100000 AS featured FROM orders WHERE o_totalprice >= 10000")
def size_floors(spark, d):
    return table(spark, d, "orders").where("o_totalprice >= 10000").select("o_orderkey", (F.col("o_totalprice") >= 100000).alias("featured"))


@query("F16_allow_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def allow_list(spark, d):
    allowed = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey")


@query("J6_members_with_text", f"WITH {EXACT} SELECT cluster_id, comment_id, length(raw_text)::BIGINT AS n FROM members")
def members_with_text(spark, d):
    c = comments(spark, d)
    return C.exact_clusters(c)[1].join(c.select("comment_id", "char_count"), "comment_id", "left").select("cluster_id", "comment_id", F.col("char_count").alias("n"))


@query("J7_representative_texts", f"WITH {EXACT} SELECT c.cluster_id, coalesce(m.raw_text, '') AS text FROM clusters c LEFT JOIN comments m ON m.comment_id = c.representative_comment_id")
def representative_texts(spark, d):
    c = comments(spark, d)
    texts = c.select(F.col("comment_id").alias("representative_comment_id"), F.col("raw_text").alias("text"))
    return C.exact_clusters(c)[0].join(texts, "representative_comment_id", "left").select("cluster_id", F.coalesce("text", F.lit("")).alias("text"))


@query("J19_previews", r"SELECT l.doc_id, substr(coalesce(nullif(trim(d.text), ''), '-'), 1, 30) AS preview FROM labels l LEFT JOIN documents d USING (doc_id)")
def previews(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = table(spark, d, "labels").join(docs, "doc_id", "left")
    return rows.select("doc_id", F.substring(F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("-")), 1, 30).alias("preview"))


@query("A7_stage_counts", "SELECT 'documents' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'nowhere', -1")
def stage_counts(spark, d):
    """A stage whose table can't be read counts -1."""
    out = []
    for name in ("documents", "embeddings", "nowhere"):
        try:
            rows = table(spark, d, name).agg(F.count(F.lit(1)).alias("n"))
        except Exception as e:  # noqa: BLE001  only a missing path has a sentinel
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.range(1).select(F.lit(-1).cast("long").alias("n"))
        out.append(rows.select(F.lit(name).alias("stage"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("X20_match_score", """
WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS g, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS s, p_partkey::VARCHAR AS k FROM part),
h AS (SELECT *, contains(t, 'part')::INT + contains(t, '1')::INT AS th, contains(g, 'part')::INT + contains(g, '1')::INT AS gh, contains(s, 'part')::INT + contains(s, '1')::INT AS sh, contains(k, 'part')::INT + contains(k, '1')::INT AS kh FROM p)
SELECT p_partkey, round(80 * contains(t, 'part 1')::INT + 55 * contains(g, 'part 1')::INT + 30 * contains(s, 'part 1')::INT + 18 * th + 12 * gh + 5 * sh + 4 * kh
  + CASE WHEN th >= 2 THEN 35 ELSE 0 END + CASE WHEN th + gh >= 2 THEN 20 ELSE 0 END + least(8, log10(greatest(1, p_partkey)) * 2) + CASE WHEN p_partkey % 2 = 0 THEN 25 ELSE 0 END, 6)::DOUBLE AS score FROM h""")
def match_score(spark, d):
    agency = F.when(F.col("p_partkey") % 2 == 0, "FCC").otherwise("EPA")
    score = search.match_score(
        F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_partkey").cast("string"), F.col("p_partkey"), agency,
        F.lit("internet part 1"), F.array(F.lit("part"), F.lit("1")), F.array(F.lit("part 1")),
    )
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("X21_expansions", """
SELECT * FROM (VALUES
  ('Methane wage', 'EPA', 'Methane wage|methane wage|methane emissions|greenhouse gas emissions|epa methane|overtime wages|fair labor standards|dol overtime'),
  ('payday', 'CFPB', 'payday|payday lending|consumer finance|banking lending'),
  ('nothing', NULL, 'nothing'),
  ('consumer-protection', 'FTC', 'consumer-protection|consumer protection'),
  ('Non-Compete & the pricing rules', 'FTC', 'Non-Compete & the pricing rules|compete pricing|drug pricing|prescription drug prices|cms price transparency|non compete ban|non-compete clause|workplace freedom'),
  ('the FCC-rule', 'FCC', 'the FCC-rule|fcc')) t(q, hint, searches)""")
def expansions(spark, d):
    """Expected rows are worked out by hand: patterns see the query in lower case without punctuation."""
    given = ("Methane wage", "payday", "nothing", "consumer-protection", "Non-Compete & the pricing rules", "the FCC-rule")
    rows = spark.createDataFrame([(q,) for q in given], "q string")
    return rows.select("q", search.agency_hint(F.col("q")).alias("hint"), F.array_join(search.expansions(F.col("q")), "|").alias("searches"))


@query("X23_topic_routing", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'labor' WHEN 1 THEN 'climate' WHEN 2 THEN 'climate' ELSE 'the-economy' END AS topic FROM nation")
def topic_routing(spark, d):
    key = F.col("n_nationkey") % 4
    agency = F.when(key == 0, "dol").when(key == 1, "EPA").when(key == 2, "FCC").otherwise("BIS")
    return table(spark, d, "nation").select("n_nationkey", search.topic_of_agency(agency, key.cast("string"), {"2": "climate"}).alias("topic"))


@query("X27_redaction")
def redaction(spark, d):
    return table(spark, d, "pages").select("page_id", X.redact(F.concat(F.lit("failed at "), "url")).alias("message"))


@query("M2_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
def cosine(spark, d):
    """Rows of the cosine matrix: every vector whose id is divisible by 50, against all others."""
    from canvass.operators import vectors as V

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return V.cosine_rows(e.where("id % 50 = 0"), e).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("cosine", 6).alias("cosine"))


@query("M4_cluster_id", f"""
WITH {COMMENTS} SELECT docket_id, sha256('cluster' || chr(0) || docket_id || chr(0) || 'm' || chr(0) || 'v1' || chr(0) || '0.92000000' || chr(0) || array_to_string(list_sort(list(comment_id)), chr(0)) || chr(0)) AS cluster_id
FROM comments GROUP BY docket_id""")
def cluster_id(spark, d):
    return comments(spark, d).groupBy("docket_id").agg(ids.cluster_id(F.col("docket_id"), "m", "v1", 0.92, F.collect_list("comment_id")).alias("cluster_id"))


@query("M7_evidence_ids", "SELECT doc_id, sha256(doc_id::VARCHAR || chr(0) || lang || chr(0) || '' || chr(0) || source || chr(0)) AS attribution_id FROM documents")
def evidence_ids(spark, d):
    row = ids.attribution_id(F.col("doc_id"), F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    return table(spark, d, "documents").select("doc_id", row.alias("attribution_id"))


@query("M8_document_ids", "SELECT item_id, 'local_text_' || substr(sha256(text), 1, 12) AS document_id FROM benchmark")
def document_ids(spark, d):
    return table(spark, d, "benchmark").select("item_id", ids.local_document_id(F.col("text")).alias("document_id"))


@query("M22_projections", "SELECT lang, (n * (n - 1) // 2)::BIGINT AS pairs, (n * n * 4)::BIGINT AS bytes, round(n * (n - 1) / 2 / 500000, 6)::DOUBLE AS seconds FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def projections(spark, d):
    n = F.col("n")
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("lang", scores.pairs(n).alias("pairs"), (n * n * 4).alias("bytes"), F.round(n * (n - 1) / 2 / 500000, 6).alias("seconds"))


@query("M23_coverage", "SELECT lang, round(100.0 * count(l.doc_id) / count(*), 1)::DOUBLE AS pct FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.round(100.0 * F.count("l") / F.count(F.lit(1)), 1).alias("pct"))


@query("M10_renormalised", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM (SELECT vec_id, CASE WHEN abs(n - 1) > 1e-5 THEN list_transform(e, lambda x: x / n) ELSE e END AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings))")
def renormalised(spark, d):
    from canvass.operators import vectors as V

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("v", V.renormalized("v"))
    return e.select("vec_id", F.round(V.norm("v"), 6).alias("norm"))
