"""Content-addressed ids: SHA-256 over parts, each ended by a NUL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvass.functions.text import text_hash

NUL = "\0"


def hashed(*parts: Column) -> Column:
    """Null parts count as empty."""
    return text_hash(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit(NUL)) for p in parts]))


def threshold_key(threshold: float) -> str:
    return f"{threshold:.8f}"


def cluster_id(docket: Column, model: str, version: str, threshold: float, members: Column) -> Column:
    """``members`` is an array of ids in any order."""
    ids = F.array_join(F.sort_array(members), NUL)
    return hashed(F.lit("cluster"), docket, F.lit(model), F.lit(version), F.lit(threshold_key(threshold)), ids)


def run_id(docket: Column, model: str, version: str, threshold: float, members: Column, hashes: Column) -> Column:
    return hashed(
        docket, F.lit(model), F.lit(version), F.lit(threshold_key(threshold)),
        F.array_join(F.sort_array(members), NUL), F.array_join(F.sort_array(hashes), NUL),
    )


def exact_cluster_id(docket: Column, hash_: Column, members: Column) -> Column:
    """The list of ids is written as a Python list of strings."""
    listed = F.concat(F.lit("['"), F.array_join(F.sort_array(members), "', '"), F.lit("']"))
    return text_hash(F.concat_ws("|", F.lit("v1_exact_hash"), docket, hash_, listed))


def attribution_id(cluster: Column, entity: Column, phrase: Column, evidence: Column) -> Column:
    return hashed(cluster, entity, phrase, evidence)


def migration_id(cluster: Column, document: Column, phrase: Column, rule_phrase: Column) -> Column:
    return hashed(cluster, document, phrase, rule_phrase)


def local_document_id(text: Column) -> Column:
    return F.concat(F.lit("local_text_"), F.substring(text_hash(text), 1, 12))
