"""Tables of the engine as Spark DDL, and the closed vocabularies."""

METADATA = "struct<file_path string, uri string, url string, line int, start_line int, end_line int, line_range array<int>, page int, snippet string, evidence string, extraction_method string, is_example boolean, commit_sha string>"
SOURCES = "id string, external_id string, type string, name string, uri string, last_fetched_at timestamp, created_at timestamp, updated_at timestamp, trust_score double, metadata string"
CLAIMS = (
    "id string, external_id string, source_id string, subject string, predicate string, value string, value_type string, normalized_value string, "
    "confidence double, environment string, scope string, source_role string, is_historical boolean, valid_from timestamp, valid_until timestamp, "
    "value_constraint string, multi_value_context string, first_seen_at timestamp, last_seen_at timestamp, superseded_by string, observed_at timestamp, "
    f"created_at timestamp, metadata {METADATA}"
)
CLAIM_HISTORY = "id string, claim_id string, source_id string, value string, normalized_value string, observed_at timestamp, first_seen_at timestamp, last_seen_at timestamp, superseded_at timestamp, superseded_by string"
CONTRADICTIONS = "id string, claim_a_id string, claim_b_id string, contradiction_type string, severity string, confidence double, explanation string, status string, detected_at timestamp"
EVENTS = "contradiction_id string, seq long, action string, performed_by string, performed_at timestamp, reason string, chosen_claim_id string, notes string"

# The states and actions of a review.
STATUSES = ("OPEN", "REVIEWED", "RESOLVED", "DISMISSED")
ACTIONS = {"REVIEW": "REVIEWED", "RESOLVE": "RESOLVED", "DISMISS": "DISMISSED", "REOPEN": "OPEN"}
