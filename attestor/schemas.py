"""Row types. Nothing is inferred from data; offsets are code points, half open."""

from __future__ import annotations

DOC_TEXT = "doc_id long, text string"
RAW_ITEM = "struct<str:string,transform:array<double>,width:double,height:double,has_eol:boolean>"
RAW_PAGE = f"doc_id long, page_no int, width double, height double, items array<{RAW_ITEM}>"
PAGE_ITEM = "struct<start:int,len:int,x:double,y:double,w:double,h:double>"
PAGE = f"doc_id long, page_no int, char_start int, char_end int, width double, height double, items array<{PAGE_ITEM}>"
CHUNK = "doc_id long, idx int, total int, char_start int, char_end int, text string"
VIEW = "struct<s:string,at:array<int>,source:array<int>>"
QUOTE = "quote_id long, doc_id long, text string, chunk_start int, chunk_end int"
CLAUSE = "doc_id long, ord int, number string, heading string, text string, start int, end int, confidence double, uncertain boolean"
CHANGE = "pair_id long, order_idx int, type string, similarity double, a_ord int, b_ord int"
EDIT = "edit_id long, doc_id long, target string, replacement string, reason string, context_before string, context_after string, passage string, expected_original string, actual_document_value string, pre_failed boolean, pre_failed_reason string"
CITATION = "document_id string, document_name string, page int, paragraph int, text string, score double"
ACTIVITY = "organization_id string, user_id string, action string, detail string, created_at timestamp"
SEARCH = "organization_id string, user_id string, query string, result_count int, created_at timestamp"
AUDIT = "organization_id string, user_id string, action string, resource_type string, resource_id string, detail string, metadata map<string,string>, ip_address string, created_at timestamp"
DOCUMENT = "document_id string, organization_id string, filename string, file_type string, file_size long, page_count int, chunk_count int, status string, error_message string, uploaded_at timestamp, processed_at timestamp, uploaded_by string, matter string, client string, tags array<string>"
#: One superset of the eight kinds of event of an answer's stream.
ANSWER_EVENT = "type string, stage string, message string, doc_id string, text string, ref string, status string, chunks_read int, chunks_total int, complete boolean, quotes array<struct<ref:string,doc_id:string,text:string,verified:boolean>>"
