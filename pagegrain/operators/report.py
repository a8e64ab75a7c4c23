"""Per-document reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, js_round


def report(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each document with blocks. docs: id, pages (null or 0: unknown). blocks: sourceDocId, page, role, text.

    Roles are counted first, so that a document's blocks meet as a few partial rows.
    """
    per_role = blocks.groupBy("sourceDocId", "role").agg(
        F.count("*").alias("n"), F.count_if(is_blank(F.col("text"))).alias("empty"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.max("page").alias("top"), F.collect_set("page").alias("pages_seen")
    )
    total = per_role.groupBy("sourceDocId").agg(
        F.sum("n").alias("totalBlocks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("byRole"), F.sum(F.when(F.col("role") == "table", F.col("n")).otherwise(0)).alias("tablesCount"),
        F.sum("empty").alias("emptyTextBlocks"), F.sum("chars").alias("chars"), F.greatest(F.max("top"), F.lit(0)).alias("top"), F.array_distinct(F.flatten(F.collect_list("pages_seen"))).alias("seen"),
    )
    joined = total.join(docs.select(F.col("id").alias("sourceDocId"), F.col("pages").alias("known")), "sourceDocId")
    pages = F.when(F.col("known") > 0, F.col("known")).otherwise(F.col("top") + 1).cast("int")
    out = joined.withColumn("pages", pages).withColumn("emptyPages", F.when(F.col("pages") > 0, F.array_except(F.sequence(F.lit(0), F.col("pages") - 1), "seen")).otherwise(F.array().cast("array<int>")))
    return out.select(F.col("sourceDocId").alias("docId"), "totalBlocks", "byRole", "tablesCount", "emptyTextBlocks", "pages", "emptyPages", F.when(F.col("pages") > 0, F.size("emptyPages") / F.col("pages")).otherwise(0.0).alias("emptyPagesShare"), js_round(F.col("chars") / F.col("totalBlocks")).alias("avgBlockLen"))


def role_list(by_role: str = "byRole") -> Column:
    """A role map as text: role:count, in order of roles."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(by_role)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")


def doc_view(docs: DataFrame, blocks: DataFrame, fields: tuple[str, ...] = ("id", "page", "role", "text")) -> DataFrame:
    """Every document with its blocks in order of page and id; those without have an empty list and null pages."""
    own = blocks.groupBy(F.col("sourceDocId").alias("id")).agg(F.array_sort(F.collect_list(F.struct("page", "id", *(f for f in fields if f not in ("id", "page"))))).alias("blocks"), F.bool_or(F.lower("role") == "table").alias("hasTables"), F.min("page").alias("firstPageWithContent"), F.max("page").alias("lastPage"))
    out = docs.join(own, "id", "left")
    return out.withColumns({"blocks": F.coalesce("blocks", F.array()), "hasTables": F.coalesce("hasTables", F.lit(False)), "blockCount": F.coalesce(F.size("blocks"), F.lit(0)).cast("long")})


def compare(reports: DataFrame, a: int, b: int) -> DataFrame:
    """Two documents' reports, a row for each side; of one that is missing, the rest is null."""
    sides = reports.sparkSession.createDataFrame([("A", a), ("B", b)], "side string, docId long")
    return sides.join(reports.where(F.col("docId").isin(a, b)), "docId", "left").select(*reports.columns, "side")


def page_of(blocks: DataFrame, number: int) -> DataFrame:
    """The blocks of a page counted from 1."""
    return blocks.where(F.col("page") == number - 1)


def page_groups(blocks: DataFrame) -> DataFrame:
    """The block ids of each page, in order."""
    return blocks.groupBy("sourceDocId", "page").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def recent(docs: DataFrame, blocks: DataFrame, n: int = 6) -> DataFrame:
    """The newest documents with their block counts."""
    top = docs.orderBy(F.desc("id")).limit(n)
    counts = blocks.groupBy(F.col("sourceDocId").alias("id")).agg(F.count("*").alias("blocks"))
    return top.join(counts, "id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))


def top_roles(blocks: DataFrame, n: int = 10) -> DataFrame:
    return blocks.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(n)


def corpus_counts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents, blocks and blocks a document with two decimals, halves going up ('0' if there are none)."""
    both = docs.agg(F.count("*").alias("docs")).join(blocks.agg(F.count("*").alias("blocks")))
    return both.withColumn("avgBlocks", F.when(F.col("docs") > 0, F.format_string("%.2f", F.floor(F.col("blocks") / F.col("docs") * 100 + 0.5) / 100)).otherwise("0"))


def markdown(docs: int, blocks: int, recent_rows: list, role_rows: list) -> str:
    """A small report as Markdown, from collected top-k rows."""
    lines = ["# Ingest report", "", f"- Documents: {docs}", f"- Blocks: {blocks}", f"- Blocks a document: {blocks / docs:.2f}" if docs else "- Blocks a document: 0", "", "| id | title | blocks |", "|---|---|---|"]
    lines += [f"| {r['id']} | {r['title']} | {r['blocks']} |" for r in recent_rows] + ["", "| role | blocks |", "|---|---|"] + [f"| {r['role']} | {r['n']} |" for r in role_rows]
    return "\n".join(lines) + "\n"
