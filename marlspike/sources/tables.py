"""Schemas of the stored tables."""

from __future__ import annotations

CHUNKS = "id string, document string, embedding array<float>, metadata map<string,string>, session_id string, user_id string, source_file_name string, ingest_seq bigint"
CHATS = "id bigint, user_id bigint, chat_name string, created_at timestamp"
CHAT_HISTORY = "id bigint, chat_id bigint, user_id bigint, input_data string, output_data string, created_at timestamp, updated_at timestamp, is_active boolean, title string"
USERS = "id bigint, full_name string, email string, phone_number string, password string, created_at timestamp"
UPLOADED_FILES = "id bigint, chat_session_id bigint, file_name string, file_size bigint, file_type string, upload_timestamp timestamp, user_id bigint"
PAGES = "page_number int, text string"
EXTRACTED = "path string, full_text string, page_texts array<struct<page_number: int, text: string>>, file_hash string, file_size bigint"
DELETES = "bucket bigint, bitmap binary"
MANIFEST = "file string, session_min string, session_max string, user_min string, user_max string, sessions array<string>"
