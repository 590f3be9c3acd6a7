"""Row contracts of the lakehouse tables: columns with types, and the key of each table."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns and types of every table (fixed values: the data contract).
DDL: dict[str, str] = {
    "raw_comments": "comment_id string, docket_id string, source string, document_type string, title string, posted_date timestamp, received_date timestamp, last_modified_date timestamp, comment_text string, submitter_name string, first_name string, last_name string, organization string, city string, state_province_region string, country string, agency_id string, has_attachments boolean, attributes_json string, ingested_at timestamp, ecfs_proceeding_id string, ecfs_submission_type_id bigint, ecfs_express_comment boolean",
    "parsed_comments": "comment_id string, docket_id string, title string, posted_date timestamp, last_modified_date timestamp, received_date timestamp, source_system_version string, parser_version string, text_source string, raw_text string, normalized_text string, normalized_text_hash string, token_estimate bigint, char_count bigint, has_attachments boolean, attachment_count bigint, parse_status string, parse_error string, parsed_at timestamp",
    "comment_details": "comment_id string, docket_id string, enrichment_status string, enrichment_error string, raw_detail_json string, extracted_at timestamp, api_version string, has_substantive_comment boolean, is_cover_note boolean",
    "comment_attachments": "attachment_id string, comment_id string, docket_id string, file_name string, file_url string, format string, size_bytes bigint, detected_at timestamp, download_status string, extracted_text_path string, local_path string, checksum_sha256 string, downloaded_at timestamp, download_error string, size_bytes_actual bigint",
    "comment_embeddings": "comment_id string, docket_id string, embedding_model string, embedding_dim bigint, text_hash string, text_source string, embedding_vector array<float>, embedded_at timestamp, backend string",
    "comment_clusters": "cluster_id string, clustering_run_id string, docket_id string, embedding_model string, embedding_backend string, clustering_version string, similarity_threshold double, candidate_count bigint, cluster_size bigint, representative_comment_id string, representative_text_hash string, mean_similarity double, min_similarity double, max_similarity double, created_at timestamp, updated_at timestamp",
    "comment_cluster_memberships": "cluster_id string, comment_id string, clustering_run_id string, docket_id string, embedding_model string, embedding_backend string, clustering_version string, similarity_threshold double, text_hash string, text_source string, similarity_to_representative double, membership_rank bigint, created_at timestamp, updated_at timestamp",
    "campaign_attributions": "attribution_id string, cluster_id string, docket_id string, candidate_entity_name string, candidate_entity_type string, candidate_url string, evidence_type string, matched_phrase string, evidence_excerpt string, confidence_score double, confidence_label string, reasoning_summary string, reviewed_status string, created_at timestamp, metadata_json string",
    "rule_migrations": "migration_id string, cluster_id string, docket_id string, final_rule_document_id string, final_rule_url string, final_rule_section string, cluster_phrase string, rule_phrase string, similarity_score double, match_type string, confidence_score double, confidence_label string, claim_scope string, caveat_text string, created_at timestamp, metadata_json string",
}

#: Key columns of every table.
KEYS: dict[str, tuple[str, ...]] = {
    "raw_comments": ("comment_id",),
    "parsed_comments": ("comment_id",),
    "comment_details": ("comment_id",),
    "comment_attachments": ("attachment_id",),
    "comment_embeddings": ("comment_id", "embedding_model"),
    "comment_clusters": ("cluster_id",),
    "comment_cluster_memberships": ("cluster_id", "comment_id"),
    "campaign_attributions": ("attribution_id",),
    "rule_migrations": ("migration_id",),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
