"""Explicit schemas and the ordinals of enumerations. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = (
    "id string, content_id string, chunk_index int, content string, content_type string, source_path string, "
    "workspace_id string, embedding array<float>, metadata map<string,string>, created_at timestamp"
)
NODES = (
    "id string, node_type string, name string, full_name string, file_path string, line_number int, signature string, "
    "modifiers string, repository_path string, properties map<string,string>, embedding array<float>, indexed_at timestamp"
)
EDGES = "id string, edge_type string, source_id string, target_id string, properties map<string,string>"
INDEX_METADATA = (
    "workspace_path string, index_type string, indexed_at timestamp, commit_sha string, commit_at timestamp, "
    "files_indexed int, items_created int, stats string"
)
WORKSPACES = "id string, path string, alias string, tags array<string>, is_default boolean"
SOURCES = (
    "source_id string, source_type string, title string, authors array<string>, abstract string, url string, arxiv_id string, "
    "doi string, year int, citation_count int, status string, tags array<string>, created_at timestamp"
)
EXCERPTS = "excerpt_id string, source_id string, content string, page int, created_at timestamp"
CHANGES = "ts timestamp, change_type string, path string"
TRACE = "trace_id long, seq long, tool_name string, arguments string, result string"
INGESTED = "text string, chunk_type string, title string, language string, start_line int, end_line int"

#: The kinds of nodes and of edges, in the order that sorting by kind follows.
NODE_TYPES = (
    "Solution", "Project", "File", "Namespace", "Class", "Interface", "Record", "Struct", "Enum",
    "Method", "Property", "Field", "Event", "Constructor",
)
EDGE_TYPES = ("Contains", "Declares", "Inherits", "Implements", "References", "Calls", "Uses", "Overrides")
TYPE_KINDS = ("Class", "Interface", "Record", "Struct", "Enum")
MEMBER_KINDS = ("Method", "Property", "Field", "Event", "Constructor")


def ordinal(kind: Column, kinds: tuple[str, ...]) -> Column:
    """Place of a kind in its enumeration; null for none of them."""
    out = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(kinds))):
        out = F.when(kind == name, k).otherwise(out)
    return out
