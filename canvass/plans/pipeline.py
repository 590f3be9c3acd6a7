"""The campaign pipeline as stages from tables to tables; each may run again without changing what it wrote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass import schemas
from canvass.functions import ids
from canvass.functions.embedding import Backend
from canvass.functions.embedding import embed as embedded
from canvass.operators import clusters as C
from canvass.operators import evidence as V
from canvass.operators import export as E
from canvass.operators import vectors as N
from canvass.sources import mappers
from canvass.sources.shared import stored
from canvass.sources.tables import Table, coerce, export

STAGES = ("parse", "embed", "exact", "cluster", "attribute", "migrate", "export")
#: Sources of text that count as a comment's own words (fixed values).
SUBSTANTIVE = ("detail_comment_text", "comment_text", "ecfs_text_data")
EXACT_MODEL, EXACT_VERSION = "exact_hash", "v1_exact_hash"


@dataclass
class Settings:
    root: str
    docket_id: str
    as_of: str
    embedding_model: str = "model"
    clustering_version: str = "v1"
    threshold: float = 0.92
    #: Blocks of the similarity join; by the docket's size if not given.
    blocks: int | None = None
    min_size: int = 2
    allow_mock: bool = False
    stages: tuple[str, ...] = STAGES
    registry: DataFrame | None = None
    #: What embeds texts; without one vectors are brought.
    backend: Backend | None = None
    #: Join only each vector's nearest neighbours (this many) instead of all similar pairs.
    neighbours: int | None = None
    #: Sections ``ord, section, body`` of the final rule, and its id.
    rules: DataFrame | None = None
    rule_document_id: str = ""
    done: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be over 0 and 1 at most")

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")


def parse(spark: SparkSession, s: Settings) -> int:
    """Raw comments that have no parsed row of their text yet."""
    raw = Table.named(spark, s.root, "raw_comments").read().where(F.col("docket_id") == s.docket_id)
    target = Table.named(spark, s.root, "parsed_comments")
    rows = mappers.text_decision(raw.withColumn("body", F.col("comment_text"))).withColumn("parsed_at", s.now())
    known = target.read().select("comment_id", F.struct(F.col("normalized_text_hash").alias("hash")).alias("old"))
    fresh = rows.join(known, "comment_id", "left").where(F.col("old").isNull() | ~F.col("old.hash").eqNullSafe(F.col("normalized_text_hash")))
    fresh = stored(coerce(fresh, schemas.schema("parsed_comments")), "parsed")
    counts = target.merge(fresh)
    return counts["inserted"] + counts["updated"]


def embed(spark: SparkSession, s: Settings) -> int:
    """Vectors of parsed comments that have none of their text by this model yet."""
    parsed = Table.named(spark, s.root, "parsed_comments").read().where((F.col("docket_id") == s.docket_id) & F.col("normalized_text_hash").isNotNull())
    target = Table.named(spark, s.root, "comment_embeddings")
    known = target.read().where(F.col("embedding_model") == s.backend.model_name).select("comment_id", F.struct(F.col("text_hash").alias("hash")).alias("old"))
    fresh = parsed.join(known, "comment_id", "left").where(F.col("old").isNull() | (F.col("old.hash") != F.col("normalized_text_hash")))
    rows = fresh.withColumns({
        "embedding_model": F.lit(s.backend.model_name), "backend": F.lit(s.backend.backend_name), "embedding_dim": F.lit(s.backend.dimension).cast("long"),
        "text_hash": F.col("normalized_text_hash"), "embedding_vector": embedded(s.backend)("normalized_text"), "embedded_at": s.now(),
    }).where("embedding_vector is not null")
    counts = target.merge(stored(coerce(rows, schemas.schema("comment_embeddings")), "embedded"))
    return counts["inserted"] + counts["updated"]


def _scope(s: Settings, model: str, version: str, threshold: float) -> Column:
    return (
        (F.col("docket_id") == s.docket_id) & (F.col("embedding_model") == model) & (F.col("clustering_version") == version)
        & (F.abs(F.col("similarity_threshold") - threshold) < 1e-9)
    )


def _write(spark: SparkSession, s: Settings, clusters: DataFrame, members: DataFrame, model: str, version: str, threshold: float, backend: str) -> int:
    """Replace the scope's clusters and memberships, also by nothing."""
    scope = _scope(s, model, version, threshold)
    more = {
        "docket_id": F.lit(s.docket_id), "embedding_model": F.lit(model), "embedding_backend": F.lit(backend), "clustering_version": F.lit(version),
        "similarity_threshold": F.lit(threshold), "created_at": s.now(), "updated_at": s.now(),
    }
    n = 0
    for name, rows in (("comment_clusters", clusters), ("comment_cluster_memberships", members)):
        rows = stored(coerce(rows.withColumns(more), schemas.schema(name)), name)
        Table.named(spark, s.root, name).replace_scope(rows, scope)
        n = n or rows.count()
    return n


def exact(spark: SparkSession, s: Settings) -> int:
    """Clusters of equal normalized text."""
    parsed = Table.named(spark, s.root, "parsed_comments").read().where(F.col("docket_id") == s.docket_id)
    rows = stored(parsed.select("comment_id", "docket_id", "normalized_text", F.col("normalized_text_hash").alias("text_hash")), "hashed")
    clusters, members = C.exact_clusters(rows, s.min_size)
    clusters = clusters.withColumn("representative_text_hash", F.col("text_hash"))
    return _write(spark, s, clusters, members, EXACT_MODEL, EXACT_VERSION, 1.0, EXACT_MODEL)


def cluster(spark: SparkSession, s: Settings) -> int:
    """Components of the similarity graph of embeddings, with medoids, ranks and statistics."""
    rows = Table.named(spark, s.root, "comment_embeddings").read().where((F.col("docket_id") == s.docket_id) & (F.col("embedding_model") == s.embedding_model))
    if not s.allow_mock:
        rows = rows.where("backend <> 'mock'")
    if rows.select("backend").distinct().limit(2).count() > 1:
        raise ValueError("vectors of more than one backend in a scope")
    rows = stored(N.normalized(rows.select("comment_id", "docket_id", "text_hash", "text_source", F.col("embedding_vector").cast("array<double>").alias("v"))), "unit")
    pairs = N.similar_pairs(rows, s.threshold, s.blocks)
    if s.neighbours:
        pairs = N.neighbour_edges(N.nearest(pairs, s.neighbours, s.threshold))
    parts = C.components_of(stored(pairs, "pairs"), s.min_size)
    placed = stored(C.medoids(parts.join(rows.select("comment_id", "v"), "comment_id")), "medoids")
    ranked = C.ranked(placed)
    stats = C.statistics(ranked)
    names = ranked.groupBy("component").agg(F.collect_list("comment_id").alias("ids"))
    key = ids.cluster_id(F.lit(s.docket_id), s.embedding_model, s.clustering_version, s.threshold, F.col("ids"))
    named = stored(stats.join(names, "component").withColumn("cluster_id", key).drop("ids"), "named")
    members = ranked.join(named.select("component", "cluster_id"), "component").join(rows.select("comment_id", "text_hash", "text_source"), "comment_id")
    return _write(spark, s, named, members, s.embedding_model, s.clustering_version, s.threshold, "model")


def _texts(spark: SparkSession, s: Settings) -> DataFrame:
    clusters = Table.named(spark, s.root, "comment_clusters").read().where(F.col("docket_id") == s.docket_id)
    parsed = Table.named(spark, s.root, "parsed_comments").read().select(F.col("comment_id").alias("representative_comment_id"), F.col("raw_text").alias("text"))
    return clusters.join(parsed, "representative_comment_id", "left").select("cluster_id", F.coalesce("text", F.lit("")).alias("text"))


def attribute(spark: SparkSession, s: Settings) -> int:
    """Candidate origins of each cluster; the docket's old rows always go."""
    if s.registry is None:
        return 0
    rows = V.attributions(_texts(spark, s), s.registry).withColumnRenamed("entity_name", "candidate_entity_name")
    rows = rows.withColumns({"docket_id": F.lit(s.docket_id), "reviewed_status": F.lit("unreviewed"), "created_at": s.now()})
    rows = stored(coerce(rows, schemas.schema("campaign_attributions")), "attributions")
    Table.named(spark, s.root, "campaign_attributions").replace_scope(rows, F.col("docket_id") == s.docket_id)
    return rows.count()


def migrate(spark: SparkSession, s: Settings) -> int:
    """Phrases of each cluster that the final rule has; the docket's old rows always go."""
    matches = V.rule_matches(_texts(spark, s), s.rules)
    rows = V.migrations(matches, s.rule_document_id).withColumnRenamed("section", "final_rule_section")
    rows = rows.withColumns({"docket_id": F.lit(s.docket_id), "final_rule_document_id": F.lit(s.rule_document_id), "created_at": s.now()})
    rows = stored(coerce(rows, schemas.schema("rule_migrations")), "migrations")
    Table.named(spark, s.root, "rule_migrations").replace_scope(rows, F.col("docket_id") == s.docket_id)
    return rows.count()


def review_export(spark: SparkSession, s: Settings) -> int:
    """The denormalised review table of the docket."""
    read = lambda name: Table.named(spark, s.root, name).read().where(F.col("docket_id") == s.docket_id)
    members = read("comment_cluster_memberships").select("cluster_id", "comment_id", "docket_id", "text_hash", "membership_rank", F.col("similarity_to_representative").alias("similarity"))
    best = V.best_per_cluster(read("campaign_attributions"), "attribution_id").withColumnRenamed("candidate_entity_name", "entity_name")
    rows = E.review_export(members, read("comment_clusters"), read("parsed_comments"), best)
    rows = stored(rows, "export")
    export(rows, f"{s.root}/cluster_review_export/{s.docket_id}", overwrite=True)
    return rows.count()


RUN = {"parse": parse, "embed": embed, "exact": exact, "cluster": cluster, "attribute": attribute, "migrate": migrate, "export": review_export}


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """The stages that ``s`` names, in order; rows each one wrote. Without a backend nothing embeds, without rules nothing migrates."""
    idle = {"embed"} if s.backend is None else set()
    idle |= {"migrate"} if s.rules is None else set()
    for name in STAGES:
        if name in s.stages and name not in idle:
            s.done[name] = RUN[name](spark, s)
    return s.done
