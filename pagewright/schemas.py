"""DDL of the relations that operators exchange."""

PIECE = "struct<item_index: int, start: int, end: int, item_offset: int, item_length: int>"
RANGE = "struct<item_index: int, start_offset: int, end_offset: int, whole_item: boolean>"
LINE = f"struct<text: string, column: int, pieces: array<{PIECE}>, item_indexes: array<int>, x: double, y: double, font_size: double>"
ITEMS = "document_id long, page_number int, item_index int, str string, transform array<double>, width double, height double, has_eol boolean"
PAGE_LINES = f"document_id long, page_number int, font_size double, lines array<{LINE}>"
SEGMENT = f"struct<original_text: string, item_indexes: array<int>, ranges: array<{RANGE}>, context_before: string, context_after: string>"
ANSWERS = "document_id long, request_id string, segment_id string, score double, confidence double, probabilities map<string, double>"
RECORD = "struct<segment_id: string, score: double, relevant_probability: double, confidence: double>"
MESSAGE = f"document_id string, request_id string, type string, evaluated int, total int, results array<{RECORD}>, status string, evaluations array<{RECORD}>, evaluated_segment_count int, request_count int, model string, elapsed_ms double, error struct<code: string, message: string>"
