"""Figures over days and hours of filings (events)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.operators import export as E
from canvass.queries.registry import query
from canvass.sources.mappers import iso_timestamp
from canvass.sources.testdata import table


@query("A13_per_day", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def per_day(spark, d):
    return E.per_day(table(spark, d, "events"), "ts")


@query("A15_hourly", "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly(spark, d):
    return E.hourly(table(spark, d, "events"), "event_type", "ts")


_CONCENTRATION = """
WITH b AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT user_id, n, n / sum(n) OVER (PARTITION BY user_id) AS p FROM b),
e AS (SELECT user_id, sum(n)::BIGINT AS n, count(*) AS k, sum(-p * log2(p)) AS h FROM p GROUP BY user_id)
SELECT user_id, n, k, round(1 - CASE WHEN k <= 1 THEN 0 ELSE h / log2(k) END, 6) + 0 AS temporal_score{more} FROM e"""


@query("A16_concentration", _CONCENTRATION.format(more=", round(greatest(0, least(1, 0.4 * 0.95 + 0.6 * (1 - CASE WHEN k <= 1 THEN 0 ELSE h / log2(k) END))), 6) AS confidence"))
def concentration(spark, d):
    rows = E.concentration(table(spark, d, "events"), "user_id", "ts")
    return rows.withColumn("confidence", F.round(E.campaign_confidence(F.lit(0.95), F.col("temporal_score")), 6)).withColumn(
        "temporal_score", F.round("temporal_score", 6)
    )


@query("A17_peak_hour", """
WITH h AS (SELECT event_type, hour(ts) AS hh, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1)
SELECT t.event_type, t.first, t.last, p.hh::INTEGER AS peak_hour FROM t JOIN (SELECT event_type, hh, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, hh) AS r FROM h) p ON p.event_type = t.event_type AND r = 1""")
def peak_hour(spark, d):
    e = table(spark, d, "events")
    hours = E.first_by(e.groupBy("event_type", F.hour("ts").alias("peak_hour")).agg(F.count(F.lit(1)).alias("n")), "event_type", F.desc("n"), "peak_hour")
    return e.groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).join(hours.drop("n"), "event_type")


@query("S13_stratified", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def stratified(spark, d):
    """The first five events of every day."""
    rank = F.row_number().over(W.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("r", rank).where("r <= 5").select("event_id")


@query("S13_manifest", "SELECT ts::DATE AS day, count(*) AS available, least(count(*), 5) AS taken FROM events GROUP BY 1")
def manifest(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("available")).withColumn("taken", F.least("available", F.lit(5).cast("long")))


@query("P3_iso_timestamps", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ts - CASE WHEN event_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def iso_timestamps(spark, d):
    """Times written with Z, with an offset, without either, and not at all."""
    key, text = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(key == 0, F.concat(text, F.lit("Z"))).when(key == 1, F.concat(text, F.lit("+02:00"))).when(key == 2, text).otherwise("soon")
    return table(spark, d, "events").select("event_id", iso_timestamp(written).alias("parsed"))


@query("M20_day_span", "SELECT user_id, (floor(abs(epoch(max(ts)) - epoch(min(ts))) / 86400) + 1)::BIGINT AS days FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")
def day_span(spark, d):
    from canvass.functions.scores import days_inclusive

    return table(spark, d, "events").groupBy("user_id").agg(days_inclusive(F.min("ts"), F.max("ts")).alias("days"))


@query("M21_eastern_cursor", "SELECT event_type, max(ts) AT TIME ZONE 'UTC' AT TIME ZONE 'US/Eastern' AS cursor FROM events GROUP BY event_type")
def eastern_cursor(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.from_utc_timestamp(F.max("ts"), "US/Eastern").alias("cursor"))
