"""Limits, thresholds and error codes in one place. Fixed values."""

MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_PAGE_COUNT = 50
MAX_EXTRACTED_CHARACTERS = 200_000
MAX_SEGMENT_COUNT = 2_000
MAX_SEGMENT_CHARACTERS = 800
MAX_QUERY_CHARACTERS = 200
MAX_REQUEST_BODY_BYTES = 4 * 1024 * 1024
MIN_SEGMENT_CHARACTERS = 40
SOFT_MAX_SEGMENT_CHARACTERS = 450
MAX_SEGMENTS_PER_BATCH = 4
MAX_CHARACTERS_PER_BATCH = 10_000
MAX_INPUT_TOKENS_PER_REQUEST = 64_000
MAX_STATE_TOKENS_PER_REQUEST = 32_000
MAX_CONCURRENT_REQUESTS = 24
SEARCH_DEADLINE_MS = 15_000
MAX_RESULTS = 3
DECLARED_SUBREQUEST_ALLOWANCE = 1_100
MATCHED = 0.65
UNCERTAIN = 0.35
PROBABILITY_SUM_TOLERANCE = 0.02
PARAGRAPH_GAP_RATIO = 1.6
HEADING_FONT_RATIO = 1.15
HEADING_LENGTH_RATIO = 0.6
COLUMN_GAP_RATIO = 3.0
MULTI_COLUMN_SHARE = 0.5
BASELINE_TOLERANCE = 0.4
EOL_TRUST_CEILING = 0.9
SPACE_GAP_RATIO = 0.25
EXTRACTION_CHARACTER_CEILING = 4 * MAX_EXTRACTED_CHARACTERS
PREVIEW_MARGIN = 60
TOKENS_PER_QUESTION = 261
TOKENS_PER_STATE_CHARACTER = 1.7
BUDGET_INPUT_TOKENS = 3_000_000
BUDGET_REQUESTS = 960
RATE_LIMIT = 20
RATE_PERIOD_SECONDS = 60
RETRY_DELAY_MS = 250
RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504, 529)
REVEAL_STEP = 50
STREAM_BUFFER_CHARACTERS = 8 * 1024 * 1024

#: (code, HTTP status, message). Fixed values.
ERRORS = (
    ("invalid_request", 400, "The search request was not valid."),
    ("query_empty", 400, "Enter a query before searching."),
    ("query_too_long", 400, "A query may be at most 200 characters."),
    ("segments_empty", 400, "The document has no searchable text."),
    ("too_many_segments", 400, "This document exceeds the 2000-segment limit."),
    ("malformed_segment_id", 400, "The search request was not valid."),
    ("duplicate_segment_id", 400, "The search request was not valid."),
    ("segment_text_empty", 400, "The search request was not valid."),
    ("segment_text_too_long", 400, "A segment may be at most 800 characters."),
    ("extracted_text_too_long", 400, "This document exceeds the 200,000-character limit."),
    ("request_body_too_large", 413, "The search request was too large."),
    ("challenge_failed", 403, "This search could not be verified as coming from a browser. Reload the page and try again."),
    ("rate_limited", 429, "Too many searches from this connection. Wait a few seconds and try again."),
    ("capacity_exhausted", 503, "The search service is busy. Try again in a moment."),
    ("provider_unavailable", 502, "The search could not be completed."),
    ("provider_timeout", 504, "The search could not be completed."),
    ("provider_malformed_response", 502, "The search could not be completed."),
    ("incomplete_evaluation", 502, "The search could not be completed."),
    ("internal_error", 500, "The search could not be completed."),
)
