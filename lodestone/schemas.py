"""Schemas of the engine's tables."""

PAGES = "doc_id string, doc_name string, page_number int, text string"
CHUNKS = "chunk_id string, doc_id string, doc_name string, text string, page_start int, page_end int, section string, ordinal int, parent_id string, chunk_kind string"
QA_PAIRS = "qa_id string, question string, answer string, question_type string, difficulty string, evidence array<string>, paraphrases array<string>, keywords array<string>, chunk_id string, doc_id string, doc_name string, page_start int, page_end int, section string"
REVIEWS = "review_id string, query string, question string, answer string, route string, evidence array<string>, created_at string, updated_at string, source_qa_id string, chunk_id string, doc_id string, doc_name string, section string, question_type string, difficulty string, page_start int, page_end int, paraphrases array<string>, keywords array<string>"
METRICS = "ts double, kind string, route string, answered boolean, confidence double, groundedness double, elapsed double, ocr_pages int, questions int, chunks int"
