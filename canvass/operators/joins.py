"""Joins of texts that contain or resemble each other by keys, and joins that the control plane needs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.udfs import alike_pairs, ratio_at_least, ratio_bound

#: A side of a join is broadcast up to this many bytes of text, with so many for each row beside them.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Words of the runs by which texts and phrases meet before they are compared.
RUN = 3
#: Pairs of texts in a batch that is given back.
PAIRS = 1 << 14


def _bytes(*texts: str) -> Column:
    """Bytes of a row with these columns."""
    return reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], F.lit(ROW_BYTES).cast("long"))


def small_side(rows: DataFrame, *texts: str) -> DataFrame:
    """``rows`` with a broadcast hint if the bytes of their columns ``texts`` allow it, else as they are: the join then shuffles."""
    return F.broadcast(rows) if (rows.agg(F.sum(_bytes(*texts))).first()[0] or 0) <= BROADCAST_BYTES else rows


def _words(text: str, f) -> Column:
    """``f`` of the words of a text column. As a lambda's argument they are split once; a column would be put in for each mention, also within loops."""
    return F.transform(F.array(F.split(text, " ")), f)[0]


def _runs(text: str, k: int) -> Column:
    """All runs of ``k`` of a text's words, each once."""

    def of(words: Column) -> Column:
        run = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
        every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - k), run))
        return F.when(F.size(words) >= k, every).otherwise(F.array().cast("array<string>"))

    return _words(text, of)


def _inner(words: Column) -> Column:
    """How many words, ``RUN`` at most, lie between the first and the last."""
    return F.least(F.greatest(F.size(words) - 2, F.lit(0)), F.lit(RUN))


def _longest_run(text: str) -> Column:
    """The longest run of ``_inner`` of a text's words but its first and last; null where there are none."""

    def of(words: Column) -> Column:
        k = _inner(words)
        runs = F.transform(F.sequence(F.lit(2), F.size(words) - k), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(k > 0, F.array_max(F.transform(runs, lambda run: F.struct(F.char_length(run).alias("n"), run.alias("run"))))["run"])

    return _words(text, of)


def containing(texts: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``texts`` (column ``t``) beside those of ``phrases`` (column ``p``) that they contain; both normalized.

    ``key`` names columns that tell the rows of ``texts`` apart and are not null. All words of a contained phrase but its first
    and last are whole words of the text, so the two meet by equal runs of them: the phrase by its longest such run, of up
    to ``RUN`` words, the text by all of its runs, which travel without it. Only phrases of one or two words are looked
    for in every text.
    """
    own = phrases.columns
    phrases = phrases.select("*", _words("p", _inner).alias("__k"), _longest_run("p").alias("__run"))
    short = phrases.where("__k = 0").select(*own)
    out = texts.join(small_side(short, "p"), F.contains(F.col("t"), F.col("p")))
    met = None
    for n in sorted(r["__k"] for r in phrases.select("__k").distinct().collect() if r["__k"]):  # RUN values at most
        runs = texts.select(*key, F.explode(_runs("t", n)).alias("__run"))
        found = runs.join(small_side(phrases.where(F.col("__k") == n), "p", "p"), "__run").select(*key, *own)
        met = found if met is None else met.unionByName(found)
    if met is not None:
        out = out.unionByName(texts.join(met, key).where(F.contains(F.col("t"), F.col("p"))))
    return out


def alike(a: DataFrame, b: DataFrame, x: str, y: str, threshold: float, few: str) -> DataFrame:
    """Rows of ``a`` beside those of ``b`` with ``ratio`` of texts ``x`` and ``y`` (normalized) at ``threshold`` or more.

    ``few`` names the column of the side with fewer texts. If its size allows, its different texts are sent to the executors, the rows
    of the other side stay where they are and each is compared with all of them at once. Else texts whose lengths don't allow
    the threshold never meet: they are dealt into classes of length, and only neighbours are joined.
    """
    widest = (2 - threshold) / threshold  # the longer text is at most this many times the shorter
    size, least, most = (b if few == y else a).agg(F.sum(_bytes(few)), F.min(F.char_length(few)), F.max(F.char_length(few))).first()
    if (size or 0) <= BROADCAST_BYTES:
        (many, text), some = ((a, x), b) if few == y else ((b, y), a)
        fits = F.char_length(text).between((least or 0) / widest - 1, (most or 0) * widest + 1)
        return _alike_to(many.where(fits), some, text, few, threshold, few == x).select(*a.columns, *b.columns, "ratio")
    of = lambda c: F.floor(F.log(F.greatest(F.char_length(c), F.lit(1)).cast("double")) / F.log(F.lit(widest * (1 + 1e-9)))).cast("long")
    near = lambda c: F.explode(F.array(*[of(c) + i for i in (-1, 0, 1)]))
    if few == x:
        a, b = a.withColumn("__class", near(x)), b.withColumn("__class", of(y))
    else:
        a, b = a.withColumn("__class", of(x)), b.withColumn("__class", near(y))
    pairs = a.join(b, "__class").drop("__class").where(ratio_bound(F.col(x), F.col(y)) >= threshold)
    return pairs.withColumn("ratio", ratio_at_least(threshold)(x, y)).where("ratio is not null")


def _alike_to(many: DataFrame, some: DataFrame, text: str, few: str, threshold: float, few_first: bool) -> DataFrame:
    """Rows of ``many`` beside those of ``some`` with ``ratio``; the different texts of ``some`` are held in memory."""
    texts = sorted(r[0] for r in some.where(F.col(few).isNotNull()).select(few).distinct().collect())
    sent, columns = many.sparkSession.sparkContext.broadcast(texts), [*many.columns, few, "ratio"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, known = pd.factorize(batch.column(batch.schema.get_field_index(text)).to_numpy(zero_copy_only=False))
            rows, first = np.argsort(codes, kind="stable"), np.searchsorted(np.sort(codes), np.arange(len(known) + 1))
            found = alike_pairs(known.tolist(), sent.value, threshold, few_first)
            while part := list(islice(found, PAIRS)):
                own, other, ratios = zip(*part)
                counts = np.diff(first)[list(own)]
                at = np.concatenate([rows[first[i] : first[i + 1]] for i in own])
                near = pa.array([sent.value[j] for j in other], pa.string()).take(pa.array(np.repeat(np.arange(len(part)), counts)))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, near, pa.array(np.repeat(ratios, counts))], columns)

    found = many.mapInArrow(compare, T.StructType([*many.schema.fields, T.StructField(few, T.StringType()), T.StructField("ratio", T.DoubleType())]))
    return found.join(small_side(some, few), few)


def without_active(rows: DataFrame, requests: DataFrame, key: str, active: Column) -> DataFrame:
    """Rows for which there is no request with ``active`` true."""
    return rows.join(requests.where(active).select(key), key, "left_anti")


def scope_or_fallback(rows: DataFrame, scope: str, kind: str, wanted: str) -> DataFrame:
    """In each scope the rows of the wanted kind; in scopes without any, all rows."""
    having = rows.where(F.col(kind) == wanted).select(scope).distinct().withColumn("__has", F.lit(True))
    return rows.join(having, scope, "left").where(F.col("__has").isNull() | (F.col(kind) == wanted)).drop("__has")


def with_prior(rows: DataFrame, prior: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which nulls of ``columns`` come from the prior row of the same key, if there is one."""
    old = prior.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    found = rows.join(old, key, "left")
    return found.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def watched(rows: DataFrame, watchlist: DataFrame, matches: Column) -> DataFrame:
    """Rows with at least one entry of the watchlist (a configured list) for which ``matches`` holds; each row once."""
    return rows.join(small_side(watchlist, *[c for c, t in watchlist.dtypes if t == "string"]), matches, "left_semi")
