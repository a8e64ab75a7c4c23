"""Readers of raw files and writers of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension
from ..operators.jsonsearch import first_string  # noqa: F401  a reader's search for links
from ..operators.normalize import admission, from_elements, from_structured
from .binary import unzipped  # noqa: F401  an archive's structured output

# The keys of page elements.
POINTS = "struct<points:array<array<double>>,page:string>"
ELEMENT = f"struct<type:string,category:string,text:variant,text_as_html:string,coordinates:{POINTS},bbox:{POINTS},metadata:struct<page_number:string>,page_number:string>"
PROFILE = "struct<id:string,name:string,canonical:struct<width:double,height:double>,zones:array<struct<id:string,name:string,polygon:array<array<double>>>>>"


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder, however deep, in order of their paths: path, name, length and extension; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "modificationTime")
    return files.withColumn("name", basename(F.col("path"))).withColumn("ext", extension(F.col("path"))).orderBy("path")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """A file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def uploads(files: DataFrame) -> DataFrame:
    """A listing with the reason why a file isn't admitted, or null."""
    return files.withColumn("rejected", admission(F.col("name"), F.col("length")))


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as text: path, json."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def zone_profile(spark: SparkSession, path: str) -> DataFrame:
    """The zones of a profile file."""
    return profile_zones(json_texts(spark, path))


def profile_zones(raw: DataFrame, json: str = "json") -> DataFrame:
    """The zones of profiles in JSON: profile, width, height, zone, name, polygon."""
    p = raw.select(F.from_json(json, PROFILE).alias("p")).select("p.id", "p.canonical.*", F.explode("p.zones").alias("z"))
    return p.select(F.col("id").alias("profile"), "width", "height", F.col("z.id").alias("zone"), "z.name", "z.polygon")


def elements(raw: DataFrame, json: str = "json") -> DataFrame:
    """Blocks of page elements: a JSON list, or an object's ``elements``; anything else has none. Other columns stay.

    An element's coordinates are taken whole, its bbox only if it has none. A text that is no string is dropped.
    """
    kept = [c for c in raw.columns if c != json]
    is_list = F.ltrim(F.col(json)).startswith("[")
    items = F.when(is_list, F.from_json(json, f"array<{ELEMENT}>")).otherwise(F.from_json(F.get_json_object(json, "$.elements"), f"array<{ELEMENT}>"))
    e = raw.select(*kept, F.posexplode(items).alias("pos", "e"))
    text = F.when(F.schema_of_variant("e.text") == "STRING", F.try_variant_get("e.text", "$", "string"))
    flat = e.select(
        *kept, "pos", "e.type", "e.category", text.alias("text"), "e.text_as_html", F.coalesce("e.coordinates", "e.bbox")["points"].alias("points"),
        F.col("e.metadata.page_number").alias("page_a"), F.col("e.page_number").alias("page_b"), F.col("e.coordinates.page").alias("page_c"),
    )
    return from_elements(flat).select(*kept, "pos", "page", "bbox", "role", "text", "tableJson", "hash")


def structured(raw: DataFrame, json: str = "json") -> DataFrame:
    """Blocks of structured extraction output: ``content`` if it is a list, or else ``elements``. Other columns stay."""
    kept = [c for c in raw.columns if c != json]
    items = F.coalesce(*(F.from_json(F.get_json_object(json, f"$.{k}"), "array<variant>") for k in ("content", "elements")))
    return from_structured(raw.select(*kept, F.posexplode(items).alias("pos", "e")), (*kept, "pos"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The images of a JSONL manifest; blank and malformed lines and those without an image are skipped."""
    return manifest_lines(spark.read.text(path))


def manifest_lines(lines: DataFrame) -> DataFrame:
    image = F.get_json_object(F.trim("value"), "$.image")
    return lines.where(F.trim("value") != "").select(image.alias("image")).where("image is not null")


def write_manifest(images: DataFrame, path: str, mode: str = "append") -> None:
    images.select("image").write.mode(mode).json(path)


def env_lines(lines: DataFrame) -> DataFrame:
    """key and value of NAME=value lines (value), quotes around values dropped. With a column ``pos``, the first line of a key counts."""
    rule = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    raw = F.regexp_extract("value", rule, 2)
    pairs = lines.where(F.col("value").rlike(rule)).withColumns({"key": F.regexp_extract("value", rule, 1), "value": F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")})
    if "pos" in lines.columns:
        return pairs.groupBy("key").agg(F.min_by("value", "pos").alias("value"))
    return pairs.select("key", "value")


def page_count(text: Column) -> Column:
    """The page count in a PDF tool's output; 0 if it has none."""
    return F.coalesce(F.regexp_extract(text, r"(?m)^Pages:\s+(\d+)", 1).try_cast("int"), F.lit(0))


def present(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted paths that exist, and those that don't."""
    there = files.select("path").distinct()
    return wanted.join(there, "path", "left_semi"), wanted.join(there, "path", "left_anti")


def file_ok(length: Column, least: int) -> Column:
    return F.coalesce(length >= least, F.lit(False))


def write_log(records: DataFrame, path: str) -> None:
    """Append log records (t and any others) as JSON lines, a folder for each UTC day."""
    records.withColumn("day", F.date_format("t", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def artifacts(blocks: DataFrame) -> DataFrame:
    """Normalised blocks as JSON, a row for each document: sourceDocId, json."""
    block = F.struct(*(c for c in blocks.columns if c != "sourceDocId"))
    return blocks.groupBy("sourceDocId").agg(F.to_json(F.array_sort(F.collect_list(block))).alias("json"))


def write_artifacts(raw: DataFrame, blocks: DataFrame, path: str) -> None:
    """Raw output (sourceDocId, json) and normalised blocks as JSON lines, a line for each document, in a folder each."""
    raw.select("sourceDocId", "json").write.mode("overwrite").json(f"{path}/raw")
    artifacts(blocks).write.mode("overwrite").json(f"{path}/normalized")


def write_regions(regions: DataFrame, path: str) -> None:
    """Regions (unit, bbox, text, image_b64) as JSON, a folder for each unit."""
    regions.select("unit", "bbox", "text", "image_b64").write.mode("overwrite").partitionBy("unit").json(path)


def image_bytes(regions: DataFrame) -> DataFrame:
    return regions.withColumn("image", F.unbase64("image_b64"))


def merged_values(old: Column, new: Column) -> Column:
    """A map after setting entries of another."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
