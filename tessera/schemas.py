"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def struct(ddl: str) -> T.StructType:
    """``name type, ...`` as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(","))])


SOURCE_FILES = struct(
    "repo string, file_path string, ext string, size long, mtime double, content binary, file_hash string"
)
CHUNKS = struct(
    "id string, repo string, file_path string, chunk_index int, start_line int, end_line int, content string, "
    "token_count int, vector array<float>, file_hash string, indexed_at double"
)
SYMBOLS = struct(
    "id string, repo string, name string, kind string, file_path string, start_byte int, end_byte int, "
    "docstring string, decorators array<string>, parent string"
)
OCCURRENCES = struct(
    "id string, repo string, name string, file_path string, start_byte int, end_byte int, line_number int, "
    "line_text string, kind string, enclosing_symbol_id string, is_test_file boolean"
)
FILES = struct("repo string, file_path string, file_hash string, version string")
INDEX_META = struct(
    "repo string, version string, files long, symbols long, occurrences long, updated_at double"
)
PROJECT_META = struct(
    "cache_key string, project_path string, updated_at double, alias_paths array<string>"
)
ZERO_CHUNK_FILES = struct("repo string, file_path string, file_hash string")
POSTINGS = struct("repo string, term string, shard int, id string, tf long, dl long")
POSTING_BLOCKS = struct("repo string, term string, shard int, entries long, max_tf long, min_dl long")
DOC_LENGTHS = struct("repo string, id string, dl long")
FILE_STATS = struct("repo string, file_path string, size long, mtime double, file_hash string")
TRIGRAMS = struct("repo string, file_path string, gram string")
PENDING_FILES = struct("repo string, file_path string, file_hash string, window long, known boolean")
VECTOR_BUCKETS = struct("repo string, bucket int, id string, vector array<float>, codes binary, indexed_at double")
VECTOR_CENTRES = struct("repo string, bucket int, centre array<float>")
VECTOR_BOOKS = struct("repo string, part int, code int, centre array<float>")
VECTOR_SETTINGS = struct("repo string, probes int, measured int, recall double, rows long, metric string")
JOBS = struct(
    "job_id string, tool string, status string, created_at double, started_at double, finished_at double, error string"
)
CHANGE_EVENTS = struct("file_path string, event_type string, ts timestamp, content binary")

OCCURRENCE_KINDS = ("call", "attribute", "import", "reference")
USAGE_FILTERS = ("production_first", "include_tests", "tests_only")
JOB_STATUSES = (
    "queued", "running", "finished", "failed", "cancel_requested", "cancelled", "abandoned",
    "finished_after_abandon", "failed_after_abandon",
)
INDEX_VERSION = "2.3"
UNVERSIONED = "2.0"
