"""Scores and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base scores of evidence (fixed values).
EXACT, FUZZY, REGISTRY, SEVERAL, MOST = 0.85, 0.65, 0.35, 0.10, 0.95
#: Agencies that get a bonus (fixed values).
MONITORED = ("FCC", "EPA", "CFPB", "FTC")
#: Rows a minute of each stage by source: ingestion, parsing, embedding (fixed values).
STAGE_RATES = {"regulations_gov": (250, 17, 1200), "ecfs": (220, 4000, 1200)}
FIXED_MINUTES = {"setup": 4.0, "clustering": 4.0, "export": 2.0}


def confidence_label(score: Column, high: float = 0.80) -> Column:
    """Bands of evidence; migrations call it high from 0.75."""
    return F.when(score < 0.5, "needs_review").when(score >= high, "high").when(score >= 0.6, "medium").otherwise("low")


def attribution_score(exact: Column, fuzzy: Column) -> Column:
    """By the numbers of exact and fuzzy phrase hits."""
    several = F.least(F.lit(MOST), F.lit(EXACT) + SEVERAL)
    return F.when(exact > 1, several).when(exact == 1, F.lit(EXACT)).when(fuzzy > 0, F.lit(FUZZY)).otherwise(F.lit(REGISTRY))


def match_type(ratio: Column) -> Column:
    return F.when(ratio >= 1.0, "exact").when(ratio >= 0.90, "near_exact").otherwise("semantic")


def migration_score(kind: Column) -> Column:
    return F.when(kind == "exact", 0.80).when(kind == "near_exact", 0.65).otherwise(0.45)


def claim_scope(kind: Column, n_words: Column) -> Column:
    return F.when((kind == "exact") & (n_words >= 12), "possible_influence").otherwise("phrase_overlap")


def length_sanity(chars: Column) -> Column:
    return F.when(chars < 50, F.greatest(F.lit(0.1), chars / 50.0)).when(chars > 4000, F.greatest(F.lit(0.1), 4000.0 / chars)).otherwise(1.0)


def quality(sanity: Column, mean_similarity: Column) -> Column:
    return 0.4 * sanity + 0.6 * mean_similarity


def priority(comments: Column, last_date: Column, requests: Column, watched: Column, agency: Column, as_of: Column) -> Column:
    scale = 25.0 * F.least(F.lit(1.0), comments / 50000.0)
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last_date)) / 86400))
    recency = F.when(last_date.isNull(), 10.0).otherwise(25.0 * F.exp(-days / 30.0))
    interest = 30.0 * F.least(F.lit(1.0), requests / 10.0) + F.when(watched, 15.0).otherwise(0.0)
    bonus = F.when(agency.isin(*MONITORED), 5.0).otherwise(0.0)
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), scale + recency + interest + bonus)), 2)


def priority_on_request(comments: Column, requests: Column, agency: Column) -> Column:
    """The variant used when somebody asks for a docket: watched, of unknown age, in whole points."""
    scale = 25 * F.least(F.lit(1.0), comments / 50000.0)
    score = scale + 30 * F.least(F.lit(1.0), requests / 10.0) + 15 + 15 + F.when(agency.isin(*MONITORED), 5).otherwise(0)
    return F.least(F.lit(100.0), F.floor(score + 0.5).cast("double"))


def stage_minutes(source: Column, rows: Column) -> dict[str, Column]:
    scale = F.greatest(F.lit(1), F.floor(rows))
    out = {}
    for i, stage in enumerate(("ingestion", "parsing", "embedding")):
        rate = F.when(source == "ecfs", STAGE_RATES["ecfs"][i]).otherwise(STAGE_RATES["regulations_gov"][i])
        out[stage] = F.floor(scale / rate * 10 + 0.5) / 10
    fixed = {k: F.lit(v) for k, v in FIXED_MINUTES.items()}
    return {"setup": fixed["setup"], **out, "clustering": fixed["clustering"], "export": fixed["export"]}


def total_minutes(stages: dict[str, Column]) -> Column:
    return F.floor(sum(stages.values(), F.lit(0.0)) + 0.5).cast("long")


def bottleneck(stages: dict[str, Column]) -> Column:
    most = F.greatest(*stages.values())
    return F.coalesce(*[F.when(v == most, F.lit(k)) for k, v in stages.items()])


def projected_minutes(elapsed: Column, done: Column, planned: Column) -> Column:
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (done - 0.05) / 0.35))
    blended = planned * (1 - weight) + elapsed / done * weight
    return F.when((done < 0.05) | (elapsed < 0.5), planned).otherwise(F.greatest(elapsed, blended))


def projection_confidence(elapsed: Column, done: Column) -> Column:
    return F.when((done < 0.05) | (elapsed < 0.5), "low").when(done >= 0.4, "high").when(done >= 0.15, "medium").otherwise("low")


def fraction(n: Column, expected: Column) -> Column:
    return F.when((n < 0) | (expected <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / expected)))


def days_inclusive(start: Column, end: Column) -> Column:
    return (F.floor(F.abs(F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400) + 1).cast("long")


def pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def watch_coverage(status: Column) -> Column:
    return F.when(status == "analyzed", "Analyzed").when(status == "baseline_only", "Baseline Only").when(
        F.coalesce(status, F.lit("")) != "", "Monitoring Active"
    ).otherwise("No coverage")
