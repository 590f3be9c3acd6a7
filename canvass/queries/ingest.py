"""Ingestion: API payloads built from driver rows, and what the mappers make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.queries.registry import query
from canvass.sources import mappers
from canvass.sources.testdata import table

AS_OF = "2024-06-01"


@query("P1_regulations", "SELECT doc_id::VARCHAR AS comment_id, 'D-1' AS docket_id, 'T' || doc_id AS title, text AS comment_text, doc_id % 2 = 0 AS has_attachments, TIMESTAMP '2024-01-02 03:04:05' AS posted_date FROM documents")
def regulations(spark, d):
    payload = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("comment"), F.lit("2024-01-02T03:04:05Z").alias("postedDate"),
        (F.col("doc_id") % 2 == 0).cast("string").alias("hasAttachments"), F.lit("EPA").alias("agencyId"),
    ).alias("attributes")))
    rows = mappers.regulations_comments(table(spark, d, "documents").select(payload.alias("json")), "D-1", F.lit(AS_OF).cast("timestamp"))
    return rows.select("comment_id", "docket_id", "title", "comment_text", "has_attachments", "posted_date")


@query("P2_ecfs", """
SELECT doc_id::VARCHAR AS comment_id, CASE WHEN doc_id % 3 = 0 THEN 'P2' ELSE 'P1' END AS ecfs_proceeding_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'A; B' END AS submitter_name,
  doc_id % 5 = 0 AS has_attachments, CASE WHEN doc_id % 2 = 0 THEN 30 END::BIGINT AS ecfs_submission_type_id, doc_id % 2 = 1 AS ecfs_express_comment FROM documents""")
def ecfs(spark, d):
    i = F.col("doc_id")
    person = lambda n: F.struct(F.lit(n).alias("name"))
    proceeding = lambda id_, n: F.struct(F.lit(id_).alias("id_proceeding"), n.alias("name"))
    payload = F.to_json(F.struct(
        i.cast("string").alias("id_submission"), F.when(i % 2 == 1, "1").otherwise("0").alias("express_comment"),
        F.struct(F.when(i % 2 == 0, "30").otherwise("x").alias("id")).alias("submissiontype"),
        F.array(proceeding("P1", F.lit("other")), proceeding("P2", F.when(i % 3 == 0, "D-7").otherwise("x"))).alias("proceedings"),
        F.when(i % 4 != 0, F.array(person("A"), person(""), person("B"))).alias("filers"),
        F.when(i % 5 == 0, F.array(F.create_map(F.lit("n"), F.lit("f")))).alias("documents"), F.lit("1").alias("_index"),
    ))
    rows = mappers.ecfs_comments(table(spark, d, "documents").select(payload.alias("json")), "D-7", F.lit(AS_OF).cast("timestamp"))
    return rows.select("comment_id", "ecfs_proceeding_id", "submitter_name", "has_attachments", "ecfs_submission_type_id", "ecfs_express_comment")


@query("P4_attachments", """
SELECT 'a' || page_id || '_' || f AS attachment_id, page_id::VARCHAR AS comment_id, f AS format, page_id * 10 AS size_bytes FROM pages, (VALUES ('pdf'), ('txt')) t(f) WHERE page_id % 3 <> 0""")
def attachments(spark, d):
    i = F.col("page_id")
    file = lambda f: F.struct(F.col("url").alias("fileUrl"), F.lit(f).alias("format"), (i * 10).alias("size"))
    included = F.array(F.struct(
        F.when(i % 3 != 0, F.concat(F.lit("a"), i.cast("string"))).otherwise("").alias("id"), F.lit("attachments").alias("type"),
        F.struct(F.lit("t").alias("title"), F.array(file("pdf"), file("txt"), file(""))  .alias("fileFormats")).alias("attributes"),
    ))
    rows = table(spark, d, "pages").select(i.cast("string").alias("comment_id"), F.lit("d").alias("docket_id"), F.to_json(F.struct(included.alias("included"))).alias("raw_detail_json"))
    return mappers.attachments(rows, F.lit(AS_OF).cast("timestamp")).select("attachment_id", "comment_id", "format", "size_bytes")


@query("P5_parsed_details")
def parsed_details(spark, d):
    """Pages are the details of comments: HTML bodies through the text decision."""
    pages = table(spark, d, "pages")
    raw = pages.select(F.col("page_id").cast("string").alias("comment_id"), F.col("url").alias("title"), F.lit(False).alias("has_attachments"))
    body = F.struct(F.struct(F.struct(F.col("html").alias("comment")).alias("attributes")).alias("data"))
    details = pages.select(F.col("page_id").cast("string").alias("comment_id"), F.to_json(body).alias("raw_detail_json"))
    return mappers.parse_details(raw, details).select("comment_id", "text_source", "parse_status", "char_count", "normalized_text_hash")


@query("P9_tags", "SELECT p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> ''), ',') AS tags FROM part")
def tags(spark, d):
    """Tags come as a JSON array or as text with separators; here half of them are each."""
    written = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.split("p_type", " "))).otherwise(F.replace("p_type", F.lit(" "), F.lit(", ")))
    parsed = F.coalesce(F.try_variant_get(F.try_parse_json(written), "$", "array<string>"), F.transform(F.split(written, ","), F.trim))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(parsed, lambda x: x != ""), ",").alias("tags"))


@query("A_json_props", "SELECT event_id, json_keys(props)[1] AS k, json_extract_string(props, '$.' || json_keys(props)[1]) AS v FROM events")
def json_props(spark, d):
    """The first key of each event's own properties, and its value."""
    key = F.get(F.json_object_keys("props"), F.lit(0))
    value = F.expr("get_json_object(props, concat('$.', get(json_object_keys(props), 0)))")
    return table(spark, d, "events").select("event_id", key.alias("k"), value.alias("v"))


@query("conversation_turns", "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_turns(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r")
    )
    return rows.select("conv_id", "turns", "user_turns", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))
