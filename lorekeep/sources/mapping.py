"""Which columns of well-known source tables become content, id and metadata."""

from __future__ import annotations

from collections.abc import Mapping

from lorekeep.operators.kb import KnowledgeBaseSpec

# Defaults of a one-off ingest. None means that content must be named.
INGEST_DEFAULTS = {
    "stories": (
        "title",
        {"story_id": "id", "time": "time", "score": "score", "descendants": "descendants"},
    ),
    "comments": ("text", {"comment_id": "id", "time": "time", "parent": "parent"}),
    "hnstories": (None, {"story_id": "id"}),
}

# Defaults of the incremental feed; other tables use the last entry.
FEED_DEFAULTS = {
    "stories": ("title", {"story_id": "id", "author": "by"}),
    "comments": ("text", {"comment_id": "id", "author": "by"}),
}
FEED_OTHER = ("text", {"original_id": "id"})


def ingest_spec(
    table: str,
    content: str | tuple[str, ...] | None = None,
    metadata: Mapping[str, str] | None = None,
    id_column: str = "id",
) -> KnowledgeBaseSpec:
    """Spec for a one-off ingest; explicit columns win over the table's defaults."""
    default_content, default_metadata = INGEST_DEFAULTS.get(table, (None, {}))
    content = content or default_content
    if content is None:
        raise ValueError(f"name the content column of table {table!r}")
    if metadata is not None and not all(isinstance(v, str) for v in metadata.values()):
        raise TypeError("a metadata map names one source column per entry")
    chosen = default_metadata if metadata is None else metadata
    columns = content if isinstance(content, tuple) else tuple(content.split(","))
    return KnowledgeBaseSpec(id_column, columns, dict(chosen))


def feed_spec(table: str) -> KnowledgeBaseSpec:
    """Spec for the incremental feed of a table."""
    content, metadata = FEED_DEFAULTS.get(table, FEED_OTHER)
    return KnowledgeBaseSpec("id", (content,), dict(metadata))
