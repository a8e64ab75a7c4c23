"""Normalising raw extraction output into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox_from_bounds, bbox_from_points
from ..functions.text import extension, number_text, title_of

MAX_UPLOAD = 30 * 1024 * 1024
EXTENSIONS = (".pdf", ".png")
PROFILE = "PIK_BusinessModel_v5"
TRANSFORM = "struct<scaleX:double,scaleY:double,offsetX:double,offsetY:double,rotation:double,flipY:boolean>"
SUCCESS, FAILURE = ("done", "succeeded", "success", "finished", "ok"), ("failed", "error")  # fixed values


def map_role(kind: Column) -> Column:
    """heading, list, table or paragraph, the first that applies."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.contains("title") | k.contains("heading") | (k == "header"), "heading").when(k.contains("list"), "list").when(k.contains("table"), "table").otherwise("paragraph")


def page_from_one(*sources: Column) -> Column:
    """The first source that isn't null, as a number; 0 and no number count as 1; counted from 0, never below; 0 beyond 32 bits."""
    number = F.coalesce(*(s.cast("string") for s in sources), F.lit("1")).try_cast("double")
    number = F.when(number.isNull() | F.isnan(number) | (number == 0), F.lit(1.0)).otherwise(number)
    return F.greatest(F.lit(0), number.try_cast("int") - 1)


def block_hash(page: Column, role: Column, box: Column, text: Column) -> Column:
    """SHA-1 of page, role, box as JSON and text, one after another."""
    numbers = F.concat(F.lit("["), F.array_join(F.transform(box, number_text), ","), F.lit("]"))
    return F.sha1(F.concat(page.cast("string"), role, numbers, F.coalesce(text, F.lit(""))))


def from_elements(df: DataFrame) -> DataFrame:
    """Blocks of page-counted-from-one elements: columns type, category, text, text_as_html, points, and page candidates page_a, page_b, page_c."""
    role = map_role(F.coalesce(F.nullif("type", F.lit("")), "category"))
    box = bbox_from_points(F.col("points"))
    page = page_from_one(F.col("page_a"), F.col("page_b"), F.col("page_c"))
    table = F.when((role == "table") & (F.col("text_as_html") != ""), F.to_json(F.struct(F.col("text_as_html").alias("html"))))
    out = df.withColumns({"page": page, "bbox": box, "role": role, "tableJson": table})
    return out.withColumn("hash", block_hash(F.col("page"), F.col("role"), F.col("bbox"), F.col("text")))


def from_structured(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of structured elements (a variant e) with alternative spellings: page, Page, bounds, Bounds, bound, Boundary, type, Type, text, Text, table, Table.

    Pages and roles pass through; tables keep their JSON. Numbers of a box that are none count as 0. A text that is no string is none, and a page that is no number is
    0, as is one beyond 32 bits.
    """

    def found(kind: str, *names: str) -> Column:
        return F.coalesce(*(F.try_variant_get("e", f"$.{n}", kind) for n in names))

    role = F.coalesce(*(F.nullif(found("string", n), F.lit("")) for n in ("type", "Type")), F.lit("unknown"))
    bounds = F.transform(found("array<variant>", "bounds", "Bounds", "bound", "Boundary"), lambda x: F.try_variant_get(x, "$", "double"))
    box = F.coalesce(bbox_from_bounds(bounds), F.expr("array(0D, 0D, 0D, 0D)"))
    table = F.when(F.lower(role) == "table", found("string", "table", "Table"))

    def of_kind(kinds: str, cast: str, *names: str) -> Column:
        """The first of the names whose value is of one of these JSON kinds."""
        values = (F.try_variant_get("e", f"$.{n}", "variant") for n in names)
        return F.coalesce(*(F.when(F.schema_of_variant(v).rlike(kinds), F.try_variant_get(v, "$", cast)) for v in values))

    page = F.coalesce(of_kind("^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "double", "page", "Page").try_cast("int"), F.lit(0))
    text = of_kind("^STRING$", "string", "text", "Text")
    return df.select(*keep, page.alias("page"), box.alias("bbox"), role.alias("role"), text.alias("text"), table.alias("tableJson"))


def shaped_for_insert(blocks: DataFrame, doc: Column) -> DataFrame:
    """Blocks as the table stores them: the box as JSON text and no hash."""
    box = F.concat(F.lit("["), F.array_join(F.transform("bbox", number_text), ","), F.lit("]"))
    return blocks.select(doc.alias("sourceDocId"), "page", box.alias("bbox"), "role", "text", "tableJson", F.lit(None).cast("string").alias("hash"))


def admission(name: Column, size: Column) -> Column:
    """Why an upload is turned away; null if it isn't."""
    return F.when(name.isNull() | (name == ""), "no file").when(F.coalesce(size, F.lit(0)) <= 0, "empty file").when(size > MAX_UPLOAD, "file too large").when(~extension(name).isin(*EXTENSIONS), "unsupported type")


def engine_of(requested: Column, default: str = "unstructured") -> Column:
    """The engine that a document is read with: any name but the default's stands for the other one."""
    return F.when(engine_name(requested, default) == "unstructured", "unstructured").otherwise("adobe")


def engine_name(requested: Column, default: str = "unstructured") -> Column:
    """The engine's name as it is stored: the one given, in lower case."""
    return F.lower(F.coalesce(F.nullif(requested, F.lit("")), F.lit(default)))


def job_state(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin(*SUCCESS), "success").when(s.isin(*FAILURE), "failure").otherwise("running")


def observed_pages(blocks: DataFrame) -> DataFrame:
    """Pages of each document by its blocks: the greatest page and one."""
    return blocks.groupBy("sourceDocId").agg((F.max("page") + 1).alias("pages"))


def source_docs(uploads: DataFrame) -> DataFrame:
    """Documents as they are inserted: columns key, name, path, engine, profile, score and pages, which is null if it isn't known, and, if there, canvasTransform in JSON.

    A transform that is no such JSON is null, as is an empty one.
    """
    score = F.nullif(F.col("score").try_cast("double"), F.lit(0.0))
    given = F.from_json("canvasTransform", TRANSFORM)
    transform = [F.when(given["scaleX"].isNotNull(), given).alias("canvasTransform")] if "canvasTransform" in uploads.columns else []
    return uploads.select(
        "key", title_of(F.col("name")).alias("title"), F.coalesce(F.nullif(F.regexp_replace(extension(F.col("name")), r"^\.", ""), F.lit("")), F.lit("pdf")).alias("type"), "path",
        engine_name(F.col("engine")).alias("engine"), F.coalesce(F.nullif("profile", F.lit("")), F.lit(PROFILE)).alias("canvasProfileId"), score.alias("canvasMatchScore"), "pages", *transform,
    )
