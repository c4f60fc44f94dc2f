"""Fixed schemas, versions and the one exception class."""

from __future__ import annotations

SNAPSHOT_VERSION = "loomgraph.snapshot.v1"
CURSOR_VERSION = "loomgraph.cursor.v1"
MANIFEST_VERSION = "loomgraph.manifest.v1"

PLACE = "path string, line int, col int, end_line int, end_col int, section string, uri string"
#: metadata and details are compact JSON with sorted keys: comparable, distinct-able, read by get_json_object.
NODES = f"id string, kind string, label string, {PLACE}, text string, metadata string"
EDGES = f"id string, kind string, source_id string, target_id string, {PLACE}, metadata string"
OMITTED = "reason string, item_id string, details string"
MANIFEST = "path string, content_hash string, parser string, parser_version string, size_bytes long, file_kind string"

SYMBOL_KINDS = ("python_class", "python_function", "python_module", "symbol")
REFERENCE_EDGES = ("references_doc", "references_section")
GIT_EDGES = ("touches", "changes_path")
STATIC_EDGES = ("depends_on", "references_doc", "references_section", "defines", "parent_symbol", "contains")


class GraphError(Exception):
    """An error with a stable code, raised on the driver before a job starts where possible."""

    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details
