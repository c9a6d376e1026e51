"""Schemas of the tables."""

from __future__ import annotations

FILES = "path string, mtime string, size bigint, content string, error string"
CHUNK = (
    "repo string, branch string, commit_sha string, path string, language string, symbol_name string, symbol_kind string, symbol_path string, parent_symbol string, "
    "line_start int, line_end int, byte_start int, byte_end int, imports string, signature string, doc_comment string, chunk_text string, content_hash string, file_hash string, file_mtime string, file_size bigint"
)
STORED = f"chunk_id string, {CHUNK}, embedding_model string, embedding_version string, indexed_at string, embedding array<float>"
JOB_EVENTS = "job_id string, repo_name string, repo_root string, started_at string, seq bigint, kind string, name string, amount bigint"
#: Every vector written now has this version.
EMBEDDING_VERSION = "1"
