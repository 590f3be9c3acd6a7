"""Evidence: template phrases in cluster texts, and cluster phrases in rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import ids, scores
from canvass.functions import text as X
from canvass.operators.joins import alike, containing, small_side
from canvass.sources.shared import stored

FUZZY_RATIO = 0.85
#: Entity types that a registry may name (fixed values); others are "other".
ENTITY_TYPES = ("trade_association", "advocacy_group", "company", "unknown", "other")
def phrase_hits(clusters: DataFrame, registry: DataFrame, fuzzy: float = FUZZY_RATIO) -> DataFrame:
    """Hits ``cluster_id, entity_name, phrase, ord, exact, ratio`` of registry phrases in cluster texts.

    ``clusters`` has ``cluster_id, text``; ``registry`` has ``entity_name, phrase, ord``. A phrase
    contained in the normalized text hits with ratio 1; others by the ratio of both texts,
    which is computed only where their lengths allow the threshold.
    """
    texts = clusters.select("cluster_id", X.normalize(F.col("text")).alias("t"))
    phrases = registry.select("entity_name", "phrase", "ord", X.normalize(F.col("phrase")).alias("p")).where("p <> ''")
    columns = ["cluster_id", "entity_name", "phrase", "ord"]
    exact = containing(texts, phrases, ["cluster_id"]).select(*columns, F.lit(True).alias("exact"), F.lit(1.0).alias("ratio"))
    rest = alike(phrases, texts, "p", "t", fuzzy, few="p").where(~F.contains(F.col("t"), F.col("p")))
    return exact.union(rest.select(*columns, F.lit(False), "ratio"))


def attributions(clusters: DataFrame, registry: DataFrame, fuzzy: float = FUZZY_RATIO, registry_only: bool = True) -> DataFrame:
    """One row for each cluster and entity with phrases: the best evidence, its score and label.

    Exact hits beat fuzzy ones; the first exact phrase, or the fuzzy one of highest ratio (first among
    equals), is named. Entities without any phrase give no row. By contract an entity without a hit is named as
    known from the registry only; with ``registry_only`` off such rows, clusters times entities, are left out.
    """
    hits = phrase_hits(clusters, registry, fuzzy)
    best = F.struct((-F.col("ratio")).alias("r"), "ord", "phrase")
    found = hits.groupBy("cluster_id", "entity_name").agg(
        F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_fuzzy"),
        F.min(F.when(F.col("exact"), F.struct("ord", "phrase")))["phrase"].alias("exact_phrase"),
        F.min(F.when(~F.col("exact"), best))["phrase"].alias("fuzzy_phrase"),
    )
    entities = registry.where("entity_name is not null and trim(entity_name) <> ''").groupBy("entity_name").agg(F.count("phrase").alias("n_phrases"))
    texts, entities = clusters.select("cluster_id", "text"), entities.where("n_phrases > 0")
    if registry_only:
        rows = texts.join(small_side(entities, "entity_name")).join(found, ["cluster_id", "entity_name"], "left").fillna(0, ["n_exact", "n_fuzzy"])
    else:
        rows = texts.join(found, "cluster_id").join(entities, "entity_name")
    kind = F.when(F.col("n_exact") > 0, "exact_phrase_match").when(F.col("n_fuzzy") > 0, "fuzzy_phrase_match").otherwise("known_campaign_registry")
    rows = rows.withColumns({
        "evidence_type": kind, "matched_phrase": F.when(F.col("n_exact") > 0, F.col("exact_phrase")).otherwise(F.col("fuzzy_phrase")),
        "confidence_score": scores.attribution_score(F.col("n_exact"), F.col("n_fuzzy")),
    })
    return rows.select(
        ids.attribution_id(F.col("cluster_id"), F.col("entity_name"), F.col("matched_phrase"), F.col("evidence_type")).alias("attribution_id"),
        "cluster_id", "entity_name", "evidence_type", "matched_phrase",
        X.excerpt(F.col("text"), F.col("matched_phrase")).alias("evidence_excerpt"),
        "confidence_score", scores.confidence_label(F.col("confidence_score")).alias("confidence_label"), "n_exact", "n_fuzzy",
    )


def candidate_phrases(clusters: DataFrame, min_words: int = 6, max_words: int = 30) -> DataFrame:
    """``cluster_id, phrase_ord, phrase, p`` (normalized): the first of each normalized form in a cluster's text."""
    every = clusters.select("cluster_id", F.posexplode(X.phrase_candidates(F.col("text"), min_words, max_words)).alias("phrase_ord", "phrase"))
    first = every.withColumn("p", X.normalize(F.col("phrase"))).where("p <> ''").groupBy("cluster_id", "p").agg(F.min(F.struct("phrase_ord", "phrase")).alias("x"))
    return first.select("cluster_id", "x.phrase_ord", "x.phrase", "p")


def rule_matches(clusters: DataFrame, rules: DataFrame, min_words: int = 6, max_words: int = 30, threshold: float = 0.6) -> DataFrame:
    """Best place in the rule text of every candidate phrase: ``cluster_id, phrase, section, rule_phrase, ratio``.

    ``rules`` has ``ord, section, body``. A phrase contained in a section's body matches the first such
    section exactly; otherwise the sentence of highest ratio, the earliest among equals, if it
    reaches ``threshold``.
    """
    phrases = stored(candidate_phrases(clusters, min_words, max_words), "phrases")
    bodies = rules.select("ord", "section", "body", X.normalize(F.col("body")).alias("b")).where("b <> ''")
    inside = containing(bodies.select("ord", "section", F.col("b").alias("t")), phrases, ["ord", "section"])
    exact = inside.groupBy("cluster_id", "phrase_ord", "phrase").agg(F.min(F.struct("ord", "section"))["section"].alias("section"))
    exact = stored(exact.select("cluster_id", "phrase_ord", "phrase", "section", F.col("phrase").alias("rule_phrase"), F.lit(1.0).alias("ratio")), "exact")
    sentences = bodies.select("ord", "section", F.posexplode(F.filter(F.transform(X.sentences(F.col("body")), X.strip), lambda s: s != "")).alias("sent_ord", "rule_phrase"))
    sentences = sentences.withColumn("s", X.normalize(F.col("rule_phrase")))
    left = phrases.join(exact.select("cluster_id", "phrase_ord"), ["cluster_id", "phrase_ord"], "left_anti")
    each = left.select("p").distinct().repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    first = F.struct((-F.col("ratio")).alias("r"), "ord", "sent_ord", "section", "rule_phrase")
    best = alike(each, sentences, "p", "s", threshold, few="s").groupBy("p").agg(F.min(first).alias("x"))
    fuzzy = left.join(best, "p").select("cluster_id", "phrase_ord", "phrase", F.col("x.section"), F.col("x.rule_phrase"), (-F.col("x.r")).alias("ratio"))
    return exact.unionByName(fuzzy)


def migrations(matches: DataFrame, document_id: str, per_cluster: int = 5) -> DataFrame:
    """The ``per_cluster`` best matches of each cluster, repeated ones dropped after that, with type, score, label and scope."""
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("ratio"), "phrase_ord"))
    top = matches.withColumn("rank", rank).where(F.col("rank") <= per_cluster)
    same = W.partitionBy("cluster_id", X.normalize(F.col("phrase")), X.normalize(F.col("rule_phrase"))).orderBy("rank")
    rows = top.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    rows = rows.withColumn("match_type", scores.match_type(F.col("ratio")))
    rows = rows.withColumn("confidence_score", scores.migration_score(F.col("match_type")))
    return rows.select(
        ids.migration_id(F.col("cluster_id"), F.lit(document_id), F.col("phrase"), F.col("rule_phrase")).alias("migration_id"),
        "cluster_id", "section", F.col("phrase").alias("cluster_phrase"), "rule_phrase", F.col("ratio").alias("similarity_score"), "match_type",
        "confidence_score", scores.confidence_label(F.col("confidence_score"), 0.75).alias("confidence_label"),
        scores.claim_scope(F.col("match_type"), F.size(X.words(F.col("phrase")))).alias("claim_scope"),
    )


def best_per_cluster(rows: DataFrame, id_column: str) -> DataFrame:
    """The row of highest confidence in each cluster, by id among equals."""
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("confidence_score"), id_column))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
