"""API payloads to rows of the contract, as column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions import text as X
from canvass.functions.udfs import clean_html

COMMENT = "id string, attributes map<string,string>"
FILING = (
    "id_submission string, date_received string, date_submission string, date_disseminated string, date_last_modified string, "
    "text_data string, express_comment string, submissiontype struct<description:string,id:string>, "
    "proceedings array<struct<id_proceeding:string,name:string>>, filers array<struct<name:string>>, lawfirms array<struct<name:string>>, "
    "documents array<map<string,string>>, attachments array<map<string,string>>"
)
DETAIL = (
    "data struct<id:string,attributes:struct<comment:string,title:string>>, "
    "included array<struct<id:string,type:string,attributes:struct<title:string,fileFormats:array<struct<fileUrl:string,format:string,size:bigint>>>>>"
)
#: Keys of the search engine that a filing's attributes leave out (fixed values).
FILING_STRIP = ("_index", "@timestamp", "@version")


def iso_timestamp(c: Column) -> Column:
    """ISO text with Z, an offset, or neither (UTC); anything else is null. The session's zone is UTC."""
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c))


def sorted_json(json: Column, without: tuple[str, ...] = ()) -> Column:
    """A JSON object's top-level members by key."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    kept = F.filter(pairs, lambda e: ~e["key"].isin(*without)) if without else pairs
    return F.to_json(F.map_from_entries(F.array_sort(kept)))


def regulations_comments(pages: DataFrame, docket_id: str, as_of: Column) -> DataFrame:
    """Raw comments from records (column ``json``) of the regulations API."""
    a = F.from_json("json", COMMENT)
    get = lambda k: a["attributes"][k]
    return pages.select(
        a["id"].alias("comment_id"), F.lit(docket_id).alias("docket_id"), F.lit("regulations_gov").alias("source"),
        get("documentType").alias("document_type"), get("title").alias("title"), iso_timestamp(get("postedDate")).alias("posted_date"),
        iso_timestamp(get("receivedDate")).alias("received_date"), iso_timestamp(get("lastModifiedDate")).alias("last_modified_date"),
        get("comment").alias("comment_text"), get("agencyId").alias("agency_id"),
        F.coalesce(get("hasAttachments").cast("boolean"), F.lit(False)).alias("has_attachments"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(a["attributes"])))).alias("attributes_json"), as_of.alias("ingested_at"),
    )


def ecfs_comments(filings: DataFrame, docket_id: str, as_of: Column) -> DataFrame:
    """Raw comments from filings (column ``json``): the proceeding of the docket's name or the first; filers joined; first law firm."""
    f = F.from_json("json", FILING)
    own = F.coalesce(F.get(F.filter(f["proceedings"], lambda p: p["name"] == docket_id), F.lit(0)), F.get(f["proceedings"], F.lit(0)))
    names = F.filter(F.transform(f["filers"], lambda x: x["name"]), lambda n: n.isNotNull() & (n != ""))
    express = F.when(f["express_comment"].isNotNull(), ~f["express_comment"].isin("0", "false", ""))
    count = lambda a: F.coalesce(F.size(a), F.lit(0))
    return filings.select(
        f["id_submission"].alias("comment_id"), F.lit(docket_id).alias("docket_id"), F.lit("ecfs").alias("source"),
        f["submissiontype"]["description"].alias("document_type"), iso_timestamp(f["date_disseminated"]).alias("posted_date"),
        iso_timestamp(f["date_received"]).alias("received_date"),
        F.coalesce(iso_timestamp(f["date_last_modified"]), iso_timestamp(f["date_submission"])).alias("last_modified_date"),
        f["text_data"].alias("comment_text"), F.nullif(F.array_join(names, "; "), F.lit("")).alias("submitter_name"),
        F.nullif(F.get(f["lawfirms"], F.lit(0))["name"], F.lit("")).alias("organization"), F.lit("FCC").alias("agency_id"),
        ((count(f["documents"]) > 0) | (count(f["attachments"]) > 0)).alias("has_attachments"),
        sorted_json(F.col("json"), FILING_STRIP).alias("attributes_json"), as_of.alias("ingested_at"),
        own["id_proceeding"].alias("ecfs_proceeding_id"), f["submissiontype"]["id"].try_cast("bigint").alias("ecfs_submission_type_id"),
        express.alias("ecfs_express_comment"),
    )


def attachments(details: DataFrame, as_of: Column) -> DataFrame:
    """A row for each attachment and file format with an id, an address and a format."""
    d = details.select("comment_id", "docket_id", F.explode(F.from_json("raw_detail_json", DETAIL)["included"]).alias("a"))
    d = d.where("a.type = 'attachments'").select("comment_id", "docket_id", "a.id", "a.attributes.title", F.explode("a.attributes.fileFormats").alias("f"))
    kept = d.where("id is not null and id <> '' and f.fileUrl is not null and f.fileUrl <> '' and f.format is not null and f.format <> ''")
    return kept.select(
        F.concat_ws("_", "id", "f.format").alias("attachment_id"), "comment_id", "docket_id", F.col("title").alias("file_name"),
        F.col("f.fileUrl").alias("file_url"), F.col("f.format").alias("format"), F.col("f.size").alias("size_bytes"),
        as_of.alias("detected_at"), F.lit("pending").alias("download_status"),
    )


def text_decision(rows: DataFrame, body: str = "body", title: str = "title", has_attachments: str = "has_attachments") -> DataFrame:
    """Adds ``text_source, parse_status, raw_text, is_cover_note`` and the text's measures: body, else title, else missing."""
    has_body, has_title = ~X.blank(F.col(body)), ~X.blank(F.col(title))
    cover = has_body & X.is_cover_note(F.col(body), F.col(has_attachments))
    source = F.when(cover, "detail_cover_note").when(has_body, "detail_comment_text").when(has_title, "title_only").otherwise("missing")
    raw = F.when(has_body, F.col(body)).when(has_title, F.col(title))
    rows = rows.withColumns({"text_source": source, "raw_text": raw, "is_cover_note": F.coalesce(cover, F.lit(False))})
    status = F.when(has_body, "parsed").when(has_title, "title_only").otherwise("missing_text")
    return rows.withColumns({
        "parse_status": status, "normalized_text": X.normalize(F.col("raw_text")), "char_count": X.char_count(F.col("raw_text")),
        "token_estimate": X.token_estimate(F.col("raw_text")),
    }).withColumn("normalized_text_hash", X.text_hash(F.col("normalized_text")))


def parse_details(raw: DataFrame, details: DataFrame) -> DataFrame:
    """Parsed comments from raw ones and their fetched details (HTML bodies)."""
    d = details.select("comment_id", clean_html(F.from_json("raw_detail_json", DETAIL)["data"]["attributes"]["comment"]).alias("body"))
    return text_decision(raw.join(d, "comment_id", "left")).drop("body")
