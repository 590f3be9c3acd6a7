"""Clusters of comments: groups of equal text, and components of similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import ids
from canvass.operators.components import connected_components


def exact_groups(comments: DataFrame, min_size: int = 2) -> DataFrame:
    """``docket_id, text_hash, cluster_size`` of texts that occur ``min_size`` times or more in a docket.

    Rows with a null hash or id belong to no group.
    """
    rows = comments.where("text_hash is not null and comment_id is not null")
    return rows.groupBy("docket_id", "text_hash").agg(F.count(F.lit(1)).alias("cluster_size")).where(F.col("cluster_size") >= min_size)


def exact_clusters(comments: DataFrame, min_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clusters and memberships of equal texts, with content-addressed ids.

    The representative has the longest normalized text, then the smallest id; it ranks first
    and the others follow by id. All similarities are 1.
    """
    rows = comments.where("text_hash is not null and comment_id is not null")
    first = F.struct((-F.char_length("normalized_text")).alias("n"), F.col("comment_id").alias("id"))
    groups = rows.groupBy("docket_id", "text_hash").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min(first)["id"].alias("representative_comment_id"),
        F.sort_array(F.collect_list("comment_id")).alias("ids"),
    ).where(F.col("cluster_size") >= min_size)
    clusters = groups.select(
        ids.exact_cluster_id(F.col("docket_id"), F.col("text_hash"), F.col("ids")).alias("cluster_id"),
        "docket_id", "text_hash", "cluster_size", "representative_comment_id",
        F.lit(1.0).alias("mean_similarity"), F.lit(1.0).alias("min_similarity"), F.lit(1.0).alias("max_similarity"),
    )
    is_first = F.col("comment_id") == F.col("representative_comment_id")
    joined = rows.select("comment_id", "docket_id", "text_hash").join(clusters, ["docket_id", "text_hash"])
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(is_first.desc(), "comment_id"))
    members = joined.select(
        "cluster_id", "comment_id", "docket_id", "text_hash", F.lit(1.0).alias("similarity_to_representative"),
        rank.cast("long").alias("membership_rank"), is_first.alias("is_representative"),
    )
    return clusters, members


def components_of(edges: DataFrame, min_size: int = 2) -> DataFrame:
    """``comment_id, component`` from edges ``a, b``; components below ``min_size`` are left out."""
    found = connected_components(edges).select(F.col("node").alias("comment_id"), "component")
    size = found.groupBy("component").count().where(F.col("count") >= min_size).drop("count")
    return found.join(size, "component").select("comment_id", "component")


def medoids(members: DataFrame) -> DataFrame:
    """Adds to ``component, comment_id, v`` (unit vectors) the mean similarity to all members, itself included.

    The sum of all inner products with a vector is its product with the sum of the vectors, so a
    component costs its size, not its square. ``centre`` is true for the highest mean (rounded
    to 9 places), then the smallest id.
    """
    at = members.select("component", F.posexplode("v").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
    total = at.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    mean = F.aggregate(F.zip_with("v", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    rows = members.join(total, "component").join(size, "component").withColumn("mean_to_members", F.round(mean, 9))
    rank = F.row_number().over(W.partitionBy("component").orderBy(F.desc("mean_to_members"), "comment_id"))
    return rows.withColumn("centre", rank == 1).drop("total")


def ranked(members: DataFrame) -> DataFrame:
    """Similarity to the representative, and rank by it and then by id; the representative's own is 1."""
    centre = members.where("centre").select("component", F.col("comment_id").alias("representative_comment_id"), F.col("v").alias("centre_v"))
    rows = members.join(centre, "component")
    similarity = F.aggregate(F.zip_with("v", "centre_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("similarity_to_representative", F.round(similarity, 9))
    rank = F.row_number().over(W.partitionBy("component").orderBy(F.desc("similarity_to_representative"), "comment_id"))
    return rows.select("component", "comment_id", "representative_comment_id", "similarity_to_representative", rank.cast("long").alias("membership_rank"))


def statistics(ranked_members: DataFrame) -> DataFrame:
    """Size and mean, least and greatest similarity to the representative of each component."""
    s = F.col("similarity_to_representative")
    return ranked_members.groupBy("component", "representative_comment_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.avg(s).alias("mean_similarity"), F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity")
    )
