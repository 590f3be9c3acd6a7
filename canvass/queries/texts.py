"""Text functions, filters and projections over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import scores
from canvass.functions import text as X
from canvass.functions.udfs import clean_html, ratio_bound, similarity_ratio
from canvass.operators import joins
from canvass.operators import evidence as V
from canvass.queries.registry import COMMENTS, query
from canvass.sources import mappers
from canvass.sources.testdata import comments, table


@query("X1_normalize", f"WITH {COMMENTS} SELECT comment_id, normalized_text FROM comments")
def normalize(spark, d):
    return comments(spark, d).select("comment_id", "normalized_text")


@query("X2_normalize_variant", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS phrase FROM benchmark")
def normalize_variant(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.normalize(F.col("text")).alias("phrase"))


@query("X3_text_hash", f"WITH {COMMENTS} SELECT comment_id, text_hash FROM comments")
def text_hash(spark, d):
    return comments(spark, d).select("comment_id", "text_hash")


@query("X4_measures", f"WITH {COMMENTS} SELECT comment_id, length(raw_text)::BIGINT AS char_count, greatest(1, length(raw_text) // 4)::BIGINT AS token_estimate FROM comments")
def measures(spark, d):
    return comments(spark, d).select("comment_id", "char_count", "token_estimate")


@query("X5_html_text")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", clean_html("html").alias("text"))


@query("X6_truncate", r"""
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 500 THEN t ELSE substr(t, 1, 497) || '...' END AS preview
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("preview"))


@query("X7_sql_preview", r"SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), 1, 500) AS preview FROM documents")
def sql_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text"), F.lit(None).cast("string")).alias("preview"))


@query("X8_short_preview", r"""
SELECT doc_id, replace(CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 297) || '...' END, '|', '\|') AS preview
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def short_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.markdown_cell(X.short_preview(F.col("text"))).alias("preview"))


@query("X9_sentences", r"""
SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::BIGINT AS n,
       string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS first FROM documents""")
def sentences(spark, d):
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), s[0].alias("first"))


@query("X10_candidate_phrases")
def candidate_phrases(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("cluster_id"), "text")
    return V.candidate_phrases(rows).select(F.col("cluster_id").alias("doc_id"), F.col("phrase_ord").alias("ord"), "phrase")


@query("X11_sections", r"""
WITH lines AS (
  SELECT item_id, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) AS i FROM benchmark)
SELECT item_id, 'Section ' || i AS section, trim(line) AS body FROM lines WHERE trim(line) <> ''""")
def sections(spark, d):
    """Rule texts are made of the items: each sentence under a header of its own, after a comment line."""
    lines = F.split("text", r"\. ")
    rule = F.concat(F.lit("# a comment\n"), F.array_join(F.transform(lines, lambda s, i: F.concat(F.lit("## Section "), (i + 1).cast("string"), F.lit("\n"), s)), "\n"))
    rows = table(spark, d, "benchmark").select("item_id", F.explode(X.sections(rule)).alias("s"))
    return rows.select("item_id", F.col("s.name").alias("section"), F.col("s.body").alias("body"))


@query("X12_ratio")
def ratio(spark, d):
    """Pairs of items whose lengths allow a ratio of 0.85."""
    items = table(spark, d, "benchmark").select("item_id", X.normalize(F.col("text")).alias("t"))
    other = items.select(F.col("item_id").alias("other_id"), F.col("t").alias("u"))
    near = items.join(joins.small_side(other, "u"), (F.col("item_id") < F.col("other_id")) & (ratio_bound("t", "u") >= 0.85))
    return near.withColumn("ratio", similarity_ratio("t", "u")).select("item_id", "other_id", F.round("ratio", 6).alias("ratio"))


@query("X14_truncate_mark", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 117) || '...' END AS t FROM documents")
def truncate_mark(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cut(F.col("text"), 120).alias("t"))


@query("X16_slug", r"""
WITH s AS (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(substr(text, 1, 100)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS b FROM documents)
SELECT doc_id, CASE WHEN b <> '' THEN b || '-' || substr(sha256(doc_id::VARCHAR), 1, 6) ELSE 'finding-' || substr(sha256(doc_id::VARCHAR), 1, 6) END AS slug FROM s""")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug(F.substring("text", 1, 100), F.col("doc_id").cast("string")).alias("slug"))


@query("X17_date_range", """
SELECT user_id, CASE WHEN min(ts)::DATE = max(ts)::DATE THEN strftime(min(ts), '%Y-%m-%d') ELSE strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') END AS dates
FROM events GROUP BY user_id""")
def date_range(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(X.date_range(F.min("ts"), F.max("ts")).alias("dates"))


@query("X18_search_tokens", r"""
SELECT item_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2))::BIGINT AS n,
       array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('and','are','for','how','into','non','our','regulation','regulations','rule','rules','that','the','this','want','what','with')), ' ') AS tokens
FROM benchmark""")
def search_tokens(spark, d):
    c = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", F.size(X.search_tokens(c)).cast("long").alias("n"), F.array_join(X.search_tokens(c, 3, X.STOPWORDS), " ").alias("tokens")
    )


@query("X19_token_overlap", r"""
WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS t FROM benchmark),
k AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS w FROM documents),
u AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM q)
SELECT u.item_id, k.doc_id, round(count(*) / any_value(u.n), 6) AS overlap FROM u JOIN k USING (w) GROUP BY u.item_id, k.doc_id HAVING count(*) / any_value(u.n) >= 0.7""")
def token_overlap(spark, d):
    """The share for every item and document."""
    return _overlaps(table(spark, d, "benchmark"), table(spark, d, "documents"))


def _overlaps(items, docs):
    """Share of an item's tokens (repeats counted) that a document has, at 0.7 or more."""
    q = items.select("item_id", X.search_tokens(F.col("text")).alias("t"))
    q = q.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    k = docs.select("doc_id", F.explode(F.array_distinct(X.search_tokens(F.col("text")))).alias("w"))
    hits = k.join(joins.small_side(q, "w"), "w").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("hits"))
    return hits.where(F.col("hits") / F.col("n") >= 0.7).select("item_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("overlap"))


@query("X22_topic", """
SELECT p_partkey, CASE WHEN contains(t, 'steel') THEN 'x' ELSE 'none' END AS probe,
  CASE WHEN contains(t, 'methane') OR contains(t, 'climate') OR contains(t, 'emissions') OR contains(t, 'greenhouse') THEN 'oil_and_gas'
       WHEN contains(t, 'neutrality') OR contains(t, 'broadband') OR contains(t, 'common carrier') OR contains(t, 'telecom') THEN 'telecom'
       WHEN contains(t, 'payday') OR contains(t, 'installment') OR contains(t, 'loans') OR contains(t, 'custody') OR contains(t, 'asset') THEN 'finance'
       ELSE p_brand END AS topic
FROM (SELECT p_partkey, p_brand, lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' climate plan' WHEN 1 THEN ' Broadband and loans' WHEN 2 THEN ' Asset rule' ELSE '' END) AS t FROM part)""")
def topic(spark, d):
    key = F.col("p_partkey") % 5
    title = F.concat("p_name", F.when(key == 0, " climate plan").when(key == 1, " Broadband and loans").when(key == 2, " Asset rule").otherwise(""))
    return table(spark, d, "part").select(
        "p_partkey", F.when(F.contains(F.lower(title), F.lit("steel")), "x").otherwise("none").alias("probe"), X.topic(title, F.col("p_brand")).alias("topic")
    )


@query("X24_safe_path", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS path FROM pages")
def safe_path(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_path(F.col("url")).alias("path"))


@query("X25_agency", "SELECT c_custkey, upper(split_part(c_name, '#', 1)) AS agency FROM customer")
def agency(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.agency_of_docket(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("agency"))


@query("X26_phrase_probe", r"""
SELECT b.item_id, count(*)::BIGINT AS n FROM benchmark b JOIN documents d
  ON contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g')))) GROUP BY b.item_id""")
def phrase_probe(spark, d):
    phrases = table(spark, d, "benchmark").select("item_id", X.normalize(F.col("text")).alias("p"))
    texts = comments(spark, d).select("comment_id", F.col("normalized_text").alias("t"))
    return joins.containing(texts, phrases, ["comment_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("F2_substantive", "SELECT doc_id FROM documents WHERE n_chars >= 100 AND lang IN ('en', 'fr') AND source <> 'src3'")
def substantive(spark, d):
    return table(spark, d, "documents").where((F.col("n_chars") >= 100) & F.col("lang").isin("en", "fr") & (F.col("source") != "src3")).select("doc_id")


@query("F4_blank_skips", "SELECT lang AS docket_id, count(*) FILTER (WHERE text IS NULL OR trim(text) = '')::BIGINT AS skipped, count(*) FILTER (WHERE trim(text) <> '')::BIGINT AS kept FROM documents GROUP BY lang")
def blank_skips(spark, d):
    blank = X.blank(F.col("raw_text"))
    return comments(spark, d).groupBy("docket_id").agg(F.count_if(blank).alias("skipped"), F.count_if(~blank).alias("kept"))


@query("F5_not_enriched", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def not_enriched(spark, d):
    done = table(spark, d, "labels").where("quality = 1")
    return table(spark, d, "documents").join(done, "doc_id", "left_anti").select("doc_id")


@query("F6_changed_hash", f"""
WITH {COMMENTS}, cache AS (SELECT comment_id, CASE WHEN doc_id % 7 = 0 THEN 'old' WHEN doc_id % 11 = 0 THEN NULL ELSE text_hash END AS text_hash FROM comments WHERE doc_id % 2 = 0)
SELECT c.comment_id FROM comments c LEFT JOIN cache k USING (comment_id) WHERE k.text_hash IS DISTINCT FROM c.text_hash""")
def changed_hash(spark, d):
    c = comments(spark, d)
    id_ = F.col("comment_id").cast("long")
    old = F.when(id_ % 7 == 0, F.lit("old")).when(id_ % 11 == 0, F.lit(None)).otherwise(F.col("text_hash"))
    cache = c.where(id_ % 2 == 0).select("comment_id", old.alias("cached"))
    return c.join(cache, "comment_id", "left").where(~F.col("cached").eqNullSafe(F.col("text_hash"))).select("comment_id")


@query("F8_slice", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND (lang <> 'en' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
def slice_(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").where(F.col("lang").isin("en", "de"))
    allowed = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return docs.where("lang <> 'en'").union(docs.where("lang = 'en'").join(allowed, "doc_id", "left_semi"))


@query("F10_threshold_scope", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 1e-9")
def threshold_scope(spark, d):
    return table(spark, d, "lineitem").where(F.abs(F.col("l_discount") - 0.05) < 1e-9).select("l_orderkey", "l_linenumber")


@query("F11_any_token", "SELECT p_partkey FROM part WHERE p_name ILIKE '%blue%' OR p_brand ILIKE '%blue%' OR p_type ILIKE '%blue%' OR p_name ILIKE '%#2%' OR p_brand ILIKE '%#2%' OR p_type ILIKE '%#2%'")
def any_token(spark, d):
    tokens = F.array(F.lit("blue"), F.lit("#2"))
    return table(spark, d, "part").where(X.matches_any(tokens, F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey")


@query("F13_lookup", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def lookup(spark, d):
    return table(spark, d, "customer").where(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007"))).select("c_custkey", "c_name")


@query("F14_cover_notes", """
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Please SEE attached. ' || substr(text, 1, 20) WHEN 1 THEN 'Letter attached ' || text ELSE text END AS body, doc_id % 3 = 0 AS has FROM documents)
SELECT doc_id, has AND length(trim(body)) < 100 AND regexp_matches(lower(body), 'see attached|see attachment|attached please find|please find attached|attached file|submission attached|find attached|attached is my comment|see file|attached pdf|comments are attached|attached hereto|letter attached|document attached') AS cover FROM t""")
def cover_notes(spark, d):
    key = F.col("doc_id") % 4
    body = F.when(key == 0, F.concat(F.lit("Please SEE attached. "), F.substring("text", 1, 20))).when(key == 1, F.concat(F.lit("Letter attached "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.is_cover_note(body, F.col("doc_id") % 3 == 0).alias("cover"))


@query("P6_text_decision", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS body, CASE doc_id % 10 WHEN 0 THEN NULL ELSE 'Title ' || doc_id END AS title FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(body, '')) <> '' THEN 'detail_comment_text' WHEN title IS NOT NULL THEN 'title_only' ELSE 'missing' END AS text_source,
  CASE WHEN trim(coalesce(body, '')) <> '' THEN 'parsed' WHEN title IS NOT NULL THEN 'title_only' ELSE 'missing_text' END AS parse_status,
  coalesce(length(CASE WHEN trim(coalesce(body, '')) <> '' THEN body ELSE title END), 0)::BIGINT AS char_count,
  sha256(lower(trim(regexp_replace(CASE WHEN trim(coalesce(body, '')) <> '' THEN body ELSE title END, '\s+', ' ', 'g')))) AS normalized_text_hash
FROM t""")
def text_decision(spark, d):
    key = F.col("doc_id") % 5
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(key == 0, None).when(key == 1, "  ").otherwise(F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("title"), F.lit(False).alias("has_attachments"),
    )
    return mappers.text_decision(rows).select("doc_id", "text_source", "parse_status", "char_count", "normalized_text_hash")


@query("M14_quality", """
SELECT doc_id, round(CASE WHEN n_chars < 50 THEN greatest(0.1, n_chars / 50.0) WHEN n_chars > 4000 THEN greatest(0.1, 4000.0 / n_chars) ELSE 1.0 END, 6)::DOUBLE AS length_sanity,
  round(0.4 * CASE WHEN n_chars < 50 THEN greatest(0.1, n_chars / 50.0) WHEN n_chars > 4000 THEN greatest(0.1, 4000.0 / n_chars) ELSE 1.0 END + 0.6 * 0.95, 6)::DOUBLE AS quality FROM documents""")
def quality(spark, d):
    sanity = scores.length_sanity(F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", F.round(sanity, 6).alias("length_sanity"), F.round(scores.quality(sanity, F.lit(0.95)), 6).alias("quality"))


@query("T7_seeded_sample")
def seeded_sample(spark, d):
    """Three rows that are the same on every run."""
    return table(spark, d, "documents").orderBy(F.xxhash64("doc_id", F.lit(42))).limit(3).select("doc_id", "lang")
