"""Readers: filtered scans, registries, rule texts and the docket list."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import text as X

#: Fields a docket entry must have, and those it may (fixed values).
DOCKET_REQUIRED = ("docket_id", "source", "topic_id", "agency_id", "title")
SOURCES = ("regulations_gov", "ecfs")


def scan(rows: DataFrame, columns: list[str] | None = None, filters: tuple[tuple[str, object], ...] = (), missing: str = "empty") -> DataFrame:
    """Columns and equality filters, both pushed into the scan.

    Floats are equal within 1e-9. Where a filter's column doesn't exist, ``missing`` says what happens:
    "empty" gives no rows, "ignore" leaves the filter out.
    """
    for name, value in filters:
        if name not in rows.columns:
            if missing == "empty":
                rows = rows.where(F.lit(False))
            continue
        rows = rows.where(F.abs(F.col(name) - F.lit(value)) <= 1e-9 if isinstance(value, float) else F.col(name) == F.lit(value))
    return rows.select(*columns) if columns else rows


def first_existing(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first of several folders that can be read."""
    jvm = spark.sparkContext._jvm
    for path in candidates:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(candidates))


def seed_registry(spark: SparkSession, path: str) -> DataFrame:
    """``docket_id, entity_name, entity_type, url, phrase, ord`` from JSON files; a file without ``sources`` is an error.

    Unknown entity types become "other"; entities without a phrase have one row with a null phrase.
    """
    from canvass.operators.evidence import ENTITY_TYPES

    source = "entity_name string, entity_type string, url string, template_phrases array<string>, notes string"
    rows = spark.read.schema(f"docket_id string, sources array<struct<{source.replace(' string', ':string').replace(' array', ':array')}>>").json(path, multiLine=True)
    checked = F.when(F.col("sources").isNotNull(), F.col("sources")).otherwise(F.raise_error(F.lit("the registry has no sources")))
    each = rows.select("docket_id", F.explode(checked).alias("s")).where(X.collapse(F.col("s.entity_name")) != "")
    kind = F.coalesce(F.nullif(F.col("s.entity_type"), F.lit("")), F.lit("unknown"))
    return each.select(
        "docket_id", X.strip(F.col("s.entity_name")).alias("entity_name"), F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("other").alias("entity_type"),
        F.nullif(F.col("s.url"), F.lit("")).alias("url"), F.posexplode_outer("s.template_phrases").alias("ord", "phrase"),
    )


def rule_text(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, text`` of whole text files; the id is the file's stem."""
    rows = spark.read.text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return rows.select(stem.alias("document_id"), F.col("value").alias("text"))


def rule_sections(rules: DataFrame) -> DataFrame:
    return rules.select("document_id", F.posexplode(X.sections(F.col("text"))).alias("ord", "s")).select("document_id", "ord", F.col("s.name").alias("section"), F.col("s.body").alias("body"))


def docket_registry(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The configured dockets, checked: required fields, known sources, each docket once."""
    seen: set[str] = set()
    for e in entries:
        if gone := [k for k in DOCKET_REQUIRED if not e.get(k)]:
            raise ValueError(f"{e.get('docket_id')}: missing {', '.join(gone)}")
        if e["source"] not in SOURCES:
            raise ValueError(f"{e['docket_id']}: unknown source {e['source']}")
        if e["docket_id"] in seen:
            raise ValueError(f"{e['docket_id']}: twice in the list")
        seen.add(e["docket_id"])
    return spark.createDataFrame([tuple(str(e[k]) for k in DOCKET_REQUIRED) for e in entries], ", ".join(f"{k} string" for k in DOCKET_REQUIRED))


def docket_list(text: str) -> list[dict]:
    """Entries of a docket list in the small part of YAML that such lists use: ``- key: value`` blocks, one nested ``date_window``.

    Quotes are dropped, ``null`` and nothing are null, whole numbers are numbers; comments and other lines are left out.
    """
    entries: list[dict] = []
    window = False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("- "):
            entries.append({})
            line, window = line[2:].strip(), False
        key, colon, value = line.partition(":")
        if line.startswith("#") or not colon or not entries:
            continue
        key, value = key.strip(), value.strip().strip("\"'")
        found = None if value.lower() in ("", "null") else int(value) if re.fullmatch(r"[+-]?\d+", value) else value
        if key == "date_window":
            entries[-1][key], window = {}, True
        elif window and key in ("start_date", "end_date"):
            entries[-1]["date_window"][key] = found
        else:
            entries[-1][key] = found
    return entries


def docket_file(spark: SparkSession, path: str) -> DataFrame:
    """The configured dockets of a list on disk, checked, with the dates of their window."""
    entries = docket_list(spark.read.text(path, wholetext=True).first()[0])
    dates = [(str(e.get("docket_id")), *((e.get("date_window") or {}).get(c) for c in ("start_date", "end_date"))) for e in entries]
    return docket_registry(spark, entries).join(spark.createDataFrame(dates, "docket_id string, start_date string, end_date string"), "docket_id")


def downloads_checked(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """Downloaded attachments in a folder against their rows: checksum and size, and whether they are there."""
    found = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract(F.col("path"), r"([^/]+)$", 1).alias("local_name"), F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("size_bytes_actual")
    )
    name = F.concat_ws(".", X.safe_path(F.col("attachment_id")), "format")
    rows = files.withColumn("local_name", name).join(found, "local_name", "left")
    return rows.withColumn("download_status", F.when(F.col("checksum_sha256").isNotNull(), "downloaded").otherwise("pending")).drop("local_name")
