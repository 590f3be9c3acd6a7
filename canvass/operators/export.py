"""The denormalised review export, and figures over texts and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import text as X


def exact_match_ratio(members: DataFrame) -> DataFrame:
    """Share of each cluster's rows that have its most frequent text hash; null hashes count only below the line."""
    per = members.groupBy("cluster_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cluster_id").agg(
        (F.coalesce(F.max(F.when(F.col("text_hash").isNotNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("exact_match_ratio")
    )


def review_export(members: DataFrame, clusters: DataFrame, parsed: DataFrame, best_attribution: DataFrame | None = None) -> DataFrame:
    """A row for each membership: cluster, comment, previews, best attribution if there is one."""
    c = clusters.select("cluster_id", "cluster_size", "representative_comment_id", F.col("mean_similarity").alias("confidence"), F.col("min_similarity").alias("purity"))
    p = parsed.select("comment_id", "raw_text", "normalized_text", "char_count")
    rows = members.join(c, "cluster_id").join(p, "comment_id", "left").join(exact_match_ratio(members), "cluster_id", "left")
    body = F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.col("normalized_text"))
    rows = rows.withColumns({
        "text_preview": X.truncate(body, 500), "is_representative": F.col("comment_id") == F.col("representative_comment_id"),
    })
    if best_attribution is not None:
        best = best_attribution.select("cluster_id", F.col("entity_name").alias("candidate_entity_name"), F.col("confidence_score").alias("attribution_score"))
        rows = rows.join(best, "cluster_id", "left")
    return rows.drop("raw_text", "normalized_text")


def per_day(rows: DataFrame, ts: str) -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def hourly(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).groupBy(key, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def concentration(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Temporal score of each key: 1 less the entropy of its hourly counts over the greatest possible; one hour gives 1."""
    counts = hourly(rows, key, ts)
    p = F.col("n") / F.sum("n").over(W.partitionBy(key))
    entropy = counts.withColumn("p", p).groupBy(key).agg(
        F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")
    )
    norm = F.when(F.col("k") <= 1, 0.0).otherwise(F.col("h") / F.log2("k"))
    return entropy.select(key, "n", "k", (1 - norm).alias("temporal_score"))


def campaign_confidence(mean_similarity: Column, temporal: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * mean_similarity + 0.6 * temporal))


def repeated_sentences(texts: DataFrame, key: str, text: str, order: str, top: int = 5, min_chars: int = 21) -> DataFrame:
    """The most frequent sentences of each key with ``min_chars`` characters or more and a space; first seen among equals."""
    rows = texts.select(key, order, F.posexplode(X.sentences(F.col(text))).alias("pos", "s")).withColumn("s", X.strip(F.col("s")))
    rows = rows.where((F.char_length("s") >= min_chars) & F.contains(F.col("s"), F.lit(" ")))
    found = rows.groupBy(key, "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select(key, F.col("s").alias("sentence"), "n", "rank")


def purity(texts: DataFrame, key: str, text: str, order: str, top: int = 3, min_chars: int = 31) -> DataFrame:
    """Share of each key's texts that contain one of its most repeated sentences, without regard to case."""
    best = repeated_sentences(texts, key, text, order, top, min_chars).groupBy(key).agg(F.collect_list(F.lower("sentence")).alias("best"))
    rows = texts.join(best, key, "left")
    hit = F.coalesce(F.exists("best", lambda s: F.contains(F.lower(text), s)), F.lit(False))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(hit) / F.count(F.lit(1)), 4).alias("purity"))


def duplicate_stats(members: DataFrame) -> DataFrame:
    """Of each cluster: unique hashes, groups of duplicates, their members, and the largest group."""
    per = members.where("text_hash is not null").groupBy("cluster_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("unique_hashes"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_members"), F.max("n").alias("largest"),
        F.sum("n").alias("size"),
    )


def first_by(rows: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key: DISTINCT ON."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def newest(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of a list by ``order``, as a catalog by priority or requests by their time."""
    return rows.orderBy(*order).limit(n)
