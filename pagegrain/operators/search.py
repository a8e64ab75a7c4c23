"""Substring search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet


def search(blocks: DataFrame, q: str | None, limit: int | None = 20) -> DataFrame:
    """Blocks whose text has q as it is, upper and lower case alike (also beyond ASCII); an empty q finds nothing.

    The least ids come first, so that the result is the same each time. ``limit`` is the feature's own; None lists all.
    """
    q = (q or "").strip()
    found = blocks.where(F.lit(bool(q)) & F.contains(F.lower("text"), F.lower(F.lit(q))))
    return shown(found, limit)


def shown(found: DataFrame, limit: int | None) -> DataFrame:
    """Found blocks as a search lists them."""
    out = found.select("id", F.col("sourceDocId").alias("docId"), "page", "role", snippet(F.col("text")).alias("snippet"))
    return out.orderBy("id").limit(limit) if limit else out
