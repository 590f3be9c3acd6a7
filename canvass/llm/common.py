"""What several operators share."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.sources.shared import shared_root, stored

__all__ = ["ascii_lower", "first_of_each", "freeing", "joined_by_share", "sent_model", "shared_root", "small_batches", "small_broadcasts", "stored", "table", "word_count"]

#: Rows in an Arrow batch for operators on whole texts, unless the session asks for another number.
TEXT_BATCH = 1024
_DEFAULT_BATCH = "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, as some texts are very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


#: Bytes of a side that a join may broadcast in operators of many joins: the driver holds all sides until they are collected.
SIDE_BYTES = 1 << 20


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = SIDE_BYTES) -> Iterator[None]:
    """Joins run meanwhile broadcast sides of up to ``most`` bytes on their own, or less if the session says so."""
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    conf = spark._jsparkSession.sessionState().conf()
    now = conf.autoBroadcastJoinThreshold()
    was = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, str(min(now, most)))
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sent_model(spark: SparkSession, model: object) -> Callable[[], object]:
    """Broadcast a model of bounded size with its class; call the result on an executor to get it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches; at its end the worker gives the memory it no longer needs back to the system.

    Python workers are used again by later stages, beside whatever the executor runs then.
    """

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return out


def ascii_lower(text: str | Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: str) -> Column:
    """Number of runs other than U+0020 and U+0009 to U+000D; 0 for null."""
    bare = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


#: A key that holds more than one row in so many is joined by broadcast: there are fewer such keys than that.
HOT_SHARE = 1000


def joined_by_share(rows: DataFrame, by: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``by``, which has one row for each value of ``key`` and its number of rows, ``n``.

    Keys with much of the rows stay where they are, so no task gets a large group; the others are shuffled.
    """
    total = by.agg(F.sum(n)).first()[0] or 0
    hot = by.where(F.col(n) * HOT_SHARE > total)
    apart = rows.join(F.broadcast(hot.drop(n)), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(by.where(F.col(n) * HOT_SHARE <= total).drop(n), key)
    return apart.unionByName(rest)


def first_of_each(docs: DataFrame, rows: DataFrame, groups: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that come first in their group: one row of each, by the smallest id, nulls last.

    ``rows`` has ``key, doc_id`` of every row; ``groups`` has ``key, least, component`` of every distinct text, with
    its smallest id; ``keyed(docs)`` has ``row`` (a struct), ``own_id`` and ``own_key``. Ids that occur once
    name their rows, so the ids that go are joined and the texts stay where they are.
    """
    order = F.struct(F.col("least").isNull().alias("unnamed"), "least", "key")
    stays = stored(groups.groupBy("component").agg(F.min(order).alias("first")).select("first.*"), "stays")
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = rows.select("doc_id").join(stays.select(F.col("least").alias("doc_id")), "doc_id", "left_anti")
        return docs.join(stored(gone.select(F.col("doc_id").alias("gone_id")), "gone"), F.col("doc_id") == F.col("gone_id"), "left_anti")
    same = (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("least"))
    return keyed(docs).join(stays, same).dropDuplicates(["key"]).select(*[F.col(f"row.{c}") for c in docs.columns])
