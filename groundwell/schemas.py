"""Row types shared by the operators."""

from __future__ import annotations

MANIFEST = (
    "doc_id string, title string, filename string, url string, publisher string, "
    "specialty string, version string, published string, license string, sha256 string"
)
LINE = (
    "doc_id string, line_no long, text string, page int, size double, bold boolean, block_lines int"
)
CHUNK = (
    "chunk_id string, doc_id string, title string, source_url string, publisher string, "
    "specialty string, section_path string, page_start int, page_end int, text string, "
    "n_tokens int, doc_version string, index_version string, ingested_at string"
)
CLAIMS = "array<struct<text:string,chunk_ids:array<string>>>"
PASSAGES = "array<struct<chunk_id:string,marker:string,text:string>>"
CITATIONS = (
    "array<struct<marker:string,chunk_id:string,doc_id:string,title:string,section:string,"
    "pages:string,source_url:string,rerank_score:double>>"
)
RESPONSE = (
    f"answered boolean, answer string, claims {CLAIMS}, citations {CITATIONS}, refusal_reason string, "
    "top_score double, disclaimer string, trace map<string,string>, degraded array<string>"
)
EVAL_CASE = (
    "id string, query string, bucket string, expect_source string, expect_text string, note string"
)
TURN = (
    "id string, user_id string, query string, answer string, answered boolean, "
    "refusal_reason string, top_score double, citations string, created_at string"
)
USER = (
    "id string, email string, created_at string, verified_at string, password_changed_at string"
)

# The labels results carry.
INTENTS = ("in_scope", "personalized_advice", "emergency", "out_of_domain")
ACTIONS = ("proceed", "correct", "refuse")
REFUSALS = (
    "personalized_advice", "emergency", "out_of_domain", "low_confidence",
    "model_declined", "ungrounded_output", "unsafe_output",
)
BUCKETS = ("answerable", "unanswerable", "personalized", "emergency", "out_of_domain")
