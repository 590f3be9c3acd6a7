"""Incremental ingestion: landed JSON pages become raw comments, merged by key in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass import schemas
from canvass.sources import mappers
from canvass.sources.tables import Table, coerce


def landed(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """One row for each line of JSON that has landed in a folder."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "json")


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of the rows with a key, the last by ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*rows.columns)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def ingest(spark: SparkSession, path: str, root: str, docket_id: str, source: str, as_of: str, checkpoint: str) -> StreamingQuery:
    """Merge everything that has landed and not been read yet, then stop; running it again reads only new files.

    A page that is delivered twice changes nothing: merges are by key, and the checkpoint remembers files. The table has a
    folder for each docket, and a micro-batch writes only those it touches.
    """
    mapper = {"regulations_gov": mappers.regulations_comments, "ecfs": mappers.ecfs_comments}[source]
    table = Table.named(spark, root, "raw_comments", partition="docket_id")

    def merge(batch: DataFrame, _: int) -> None:
        rows = coerce(mapper(batch, docket_id, F.lit(as_of).cast("timestamp")), schemas.schema("raw_comments"))
        rows = latest(rows.where("comment_id is not null"), table.keys, "last_modified_date").persist()
        try:
            table.merge(rows)
        finally:
            rows.unpersist()

    return landed(spark, path).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_per_hour(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly counts of a stream of filings by type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The change feed between two versions of a table: rows of ``after`` with ``change`` insert or update, and rows that went with delete.

    Both have the same columns; a row changed if any of its values did, nulls being equal.
    """
    digest = lambda rows: F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    old = before.select(*keys, digest(before).alias("__old"))
    new = after.withColumn("__new", digest(after)).join(old, list(keys), "left")
    kind = F.when(F.col("__old").isNull(), "insert").when(F.col("__old") != F.col("__new"), "update")
    kept = new.withColumn("change", kind).where("change is not null").select(*after.columns, "change")
    return kept.unionByName(before.join(after.select(*keys), list(keys), "left_anti").withColumn("change", F.lit("delete")))


def sync(table: Table, seen: int | None, apply) -> int | None:
    """Give ``apply`` the changes of a table since version ``seen`` (None: all rows as inserts); the version to remember.

    For an index beside the table: applying the same changes twice must change nothing, as a failed run is run again.
    """
    now = table.version()
    if now is not None and now != seen:
        after = table.read(now)
        apply(changes(table.read(seen) if seen is not None else after.limit(0), after, table.keys))
    return now
