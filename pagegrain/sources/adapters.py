"""Blocks and other catalog shapes from general tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import map_role

#: Block ids have room for so many lines or turns of a document.
LINES = 1 << 32


def blocks_from_documents(docs: DataFrame) -> DataFrame:
    """A block for each line of a document: ten lines a page, types by place; tables have no text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kind = F.when(F.col("pos") == 0, "Title").when(F.col("pos") % 7 == 3, "ListItem").when(F.col("pos") % 11 == 5, "Table").otherwise("NarrativeText")
    top = F.col("pos") % 10 * 10
    lines = lines.withColumn("role", map_role(kind))
    return lines.select(
        (F.col("doc_id") * LINES + F.col("pos")).alias("id"), F.col("doc_id").alias("sourceDocId"), F.floor(F.col("pos") / 10).cast("int").alias("page"),
        F.format_string("[0,%d,100,%d]", top, top + 8).alias("bbox"), "role", F.when(F.col("role") != "table", F.col("line")).alias("text"), kind.alias("type"),
    )


def blocks_from_conversations(conversations: DataFrame) -> DataFrame:
    """A block for each turn, each on a page of its own."""
    return conversations.select((F.col("conv_id") * LINES + F.col("turn")).alias("id"), F.col("conv_id").alias("sourceDocId"), F.col("turn").cast("int").alias("page"), F.lit("[0,0,0,0]").alias("bbox"), "role", "text")


def elements_from_pages(pages: DataFrame) -> DataFrame:
    """An element for each opening tag of a page."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("pos", "type"))
    return tags.withColumn("role", map_role(F.col("type")))


def docs_from_documents(docs: DataFrame) -> DataFrame:
    """Documents as the catalog has them, their pages unknown."""
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("int").alias("pages"))


def docs_from_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy(F.col("conv_id").alias("id")).agg((F.max("turn") + 1).cast("int").alias("pages"))


def log_from_events(events: DataFrame) -> DataFrame:
    """Events as log records of a UTC day."""
    level = F.when(F.col("value") < 0, "error").otherwise("info")
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("t"), F.to_date("ts").alias("day"), F.col("event_type").alias("event"), level.alias("level"), "props")


def points_from_embeddings(embeddings: DataFrame, scale: float = 1.0) -> DataFrame:
    """A vector's neighbouring values as points: synthetic geometry."""
    n = F.floor(F.size("embedding") / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get("embedding", 2 * i).cast("double") * scale, F.get("embedding", 2 * i + 1).cast("double") * scale))
    return embeddings.select("vec_id", "label", F.when(n > 0, points).otherwise(F.array().cast("array<array<double>>")).alias("points"))


def mock_blocks(names: DataFrame) -> DataFrame:
    """Five fixed blocks for each file name (name)."""
    title = F.regexp_replace("name", r"\.[^.]+$", "")

    def block(page: int, box: list[int], role: str, text: Column, table: str | None = None) -> Column:
        return F.struct(F.lit(page).alias("page"), F.array(*(F.lit(float(x)) for x in box)).alias("bbox"), F.lit(role).alias("role"), text.cast("string").alias("text"), F.lit(table).cast("string").alias("tableJson"))

    # The blocks of an offline ingest.
    rows = F.array(
        block(1, [10, 10, 580, 60], "heading", title),
        block(1, [10, 80, 580, 140], "paragraph", F.concat(F.lit("Mock paragraph derived from "), F.col("name"))),
        block(1, [10, 150, 580, 220], "list", F.lit("• item one; • item two; • item three")),
        block(2, [10, 20, 560, 300], "table", F.lit(None), '{"rows":2,"cols":2,"data":[["A","B"],["C","D"]]}'),
        block(2, [10, 320, 560, 380], "paragraph", F.lit("Second page content (mock).")),
    )
    return names.select("name", F.posexplode(rows).alias("pos", "b")).select("name", "pos", "b.*")
