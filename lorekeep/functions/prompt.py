"""``{{column}}`` templates rendered as one concat expression."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def render(template: str, columns: Collection[str]) -> Column:
    """Fill placeholders in a single pass: braces inside values stay as they are.

    NULL renders as the empty string; an unknown placeholder raises.
    """
    pieces = PLACEHOLDER.split(template)
    parts: list[Column] = []
    for position, piece in enumerate(pieces):
        if position % 2:
            if piece not in columns:
                raise ValueError(f"template names unknown column {piece!r}")
            parts.append(F.coalesce(F.col(f"`{piece}`").cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")
