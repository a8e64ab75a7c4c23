"""Image regions, their files' units, and page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import apply_transform, fit, overlay_rect, parse_bbox, point_in_polygon
from ..functions.text import stem
from .catalog import ranked, stable

# Folders of rendered pages and raw frames, bounds of region picking.
PAGES_PLAYBOOKS, PAGES_FRAMES, FRAMES_RAW = "/content/pages_src/playbooks", "/content/pages_src/frames", "/content/src_gcs/frames"
MIN_AREA, TOP_REGIONS = 1000, 8
PLACEHOLDER = (0, 0, -1, -1)


def unit_of(path: Column) -> Column:
    """The unit that an image's regions are filed under, by the folder it lies in."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    doc = F.coalesce(F.get(parts, 3), stem(path))
    parent = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    raw = F.when((parent != "") & (parent != "frames"), F.concat(F.lit("frames/"), parent, F.lit("-"), stem(path))).otherwise(F.concat(F.lit("frames/"), stem(path)))
    return F.when(path.startswith(PAGES_PLAYBOOKS), F.concat(F.lit("playbooks/"), doc)).when(path.startswith(PAGES_FRAMES), F.concat(F.lit("frames-pdf/"), doc)).when(path.startswith(FRAMES_RAW), raw).otherwise("misc")


def top_regions(regions: DataFrame, n: int = TOP_REGIONS, min_area: int = MIN_AREA) -> DataFrame:
    """Of each image, the n largest regions over the least area and with positive sides; equal areas by id. Columns: image, id, x, y, w, h, area."""
    good = regions.where((F.col("area") > min_area) & (F.col("w") > 0) & (F.col("h") > 0))
    return ranked(good, [F.desc("area"), F.asc("id")], ["image"], n)


def mask_box(pixels: DataFrame) -> DataFrame:
    """Hull and area of masks given as pixels (mask, x, y; null x for an empty mask, whose hull is 0, 0, -1, -1)."""
    return pixels.groupBy("mask").agg(*(F.coalesce(f(c), F.lit(v)).alias(n) for f, c, v, n in ((F.min, "x", 0, "x0"), (F.min, "y", 0, "y0"), (F.max, "x", -1, "x1"), (F.max, "y", -1, "y1"))), F.count("x").alias("area"))


def overlays(blocks: DataFrame, width: float, height: float, scale: float = -1.0, flip: bool = True, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Boxes of blocks on screen, page by page; a scale of -1 fits the widest box of the page."""
    box = parse_bbox(F.col("bbox"))
    widest = blocks.groupBy("sourceDocId", "page").agg(F.greatest(F.max(F.get(box, 2)), F.lit(1.0)).alias("__w"))
    k = F.lit(scale) if scale > 0 else F.when(F.col("__w") > 1, F.lit(width) / F.col("__w")).otherwise(1.0)
    return blocks.join(widest, ["sourceDocId", "page"]).select("sourceDocId", "page", "id", "role", overlay_rect(box, k, F.lit(height), F.lit(flip), F.lit(dx), F.lit(dy)).alias("rect"))


def aligned(docs: DataFrame, profile: str, width: float, height: float) -> DataFrame:
    """Placeholder alignment: the fit of a page into the canvas, and a constant score."""
    return docs.select("id", F.lit(profile).alias("profileId"), fit(F.col("pageWidth"), F.col("pageHeight"), width, height).alias("transform"), F.lit(0.7).alias("matchScore"), "pageWidth", "pageHeight")


def by_zone(blocks: DataFrame, zones: list[tuple[str, list]], page_w: float, page_h: float, canvas: tuple[float, float]) -> DataFrame:
    """Extension: blocks with the first zone that has the centre of their box after the fit, or null. Zones are few and constant, so they are matched within each row.

    Boxes are parsed once; a zone's edges are looked at only where the centre is within its hull.
    """
    t = fit(F.lit(page_w), F.lit(page_h), *canvas)
    placed = blocks.withColumn("__box", parse_bbox(F.col("bbox")))
    placed = placed.withColumn("__box", apply_transform(F.col("__box"), t, F.lit(page_h)))
    placed = placed.withColumns({"__x": (F.get("__box", 0) + F.get("__box", 2)) / 2, "__y": (F.get("__box", 1) + F.get("__box", 3)) / 2}).drop("__box")
    x, y = F.col("__x"), F.col("__y")

    def hit(name: str, poly: list) -> Column:
        xs, ys = ([float(p[i]) for p in poly] for i in (0, 1))
        hull = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
        edges = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in zip(xs, ys, strict=True)))
        return F.when(hull, F.when(point_in_polygon(x, y, edges), F.lit(name)))

    return placed.withColumn("zone", F.coalesce(*(hit(name, poly) for name, poly in zones))).drop("__x", "__y")


def grid_cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """The cells (column, row) of a grid that a box touches."""

    def along(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(a / cell), F.floor(b / cell))

    return F.flatten(F.transform(along(x0, x1), lambda i: F.transform(along(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def in_zones(points: DataFrame, zones: DataFrame, cell: float = 100.0, per_task: int = 100_000) -> DataFrame:
    """Extension: points (profile, x, y and others) with the first zone of their profile that they are in, or null.

    zones: profile, pos (their order), zone, polygon (array of x, y). Of equal polygons of a profile only the first can be a point's, so the others are left out. A polygon is
    listed under each cell of a grid that its hull touches, and a point meets the polygons of its own cell by equal keys; each is then tested as it is. Where very many points share a cell, they are dealt to as many tasks as ``per_task`` says and the cell's
    polygons go to each. Polygons under three corners, points without coordinates and null profiles match nothing. Repeated points stay. cell: the side of a
    cell, best about that of a usual zone; a polygon has a row for each cell of its hull.
    """
    rows = stable(points.withColumn("__row", F.monotonically_increasing_id()))
    cell_of = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in ("x", "y")]
    at = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("__row", "profile", "x", "y", *cell_of)

    def axis(i: int) -> Column:
        return F.transform("polygon", lambda p: F.get(p, i))

    hull = [f(axis(i)) for f in (F.array_min, F.array_max) for i in (0, 1)]
    edges = ["x0", "y0", "x1", "y1"]
    firsts = zones.where(F.size("polygon") > 2).groupBy("profile", "polygon").agg(F.min(F.struct(F.col("pos").alias("__pos"), F.col("zone").alias("__zone"))).alias("z"))
    listed = firsts.select("profile", "z.__pos", "z.__zone", "polygon", *(h.alias(e) for h, e in zip(hull, edges, strict=True)))
    listed = listed.withColumn("c", F.explode(grid_cells(*map(F.col, edges), cell))).select("profile", "__pos", "__zone", "polygon", *edges, "c.cx", "c.cy")
    keys = ["profile", "cx", "cy"]
    # Fewer than a million cells have more than a millionth of all points, so that their shares can be broadcast.
    full = stable(at.groupBy(*keys).agg(F.count("*").alias("n")))
    total = full.agg(F.sum("n").alias("n")).first()["n"] or 0
    shares = F.ceil(F.col("n") / max(per_task, total // 1_000_000)).cast("int")
    hot = F.broadcast(full.select(*keys, shares.alias("shares")).where("shares > 1"))
    share = F.coalesce("shares", F.lit(1))
    left = at.join(hot, keys, "left").withColumn("share", F.pmod(F.xxhash64("__row"), share).cast("int")).drop("shares")
    right = listed.join(hot, keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0), share - 1))).drop("shares")
    met = left.join(right, [*keys, "share"]).where("x >= x0 and x <= x1 and y >= y0 and y <= y1")
    met = met.where(F.when(F.col("x").isNotNull(), point_in_polygon(F.col("x"), F.col("y"), F.col("polygon"))))
    first = met.groupBy("__row").agg(F.min(F.struct("__pos", "__zone")).alias("z"))
    return rows.join(first, "__row", "left").drop("__row").withColumn("zone", F.col("z.__zone")).drop("z")


def summary(files: DataFrame) -> DataFrame:
    """Counts of a run's region files (path): JSON, PNG and distinct units."""
    unit = F.regexp_extract("path", r"([^/]+/[^/]+)/[^/]+$", 1)
    return files.agg(F.count_if(F.col("path").endswith(".json")).alias("json"), F.count_if(F.col("path").endswith(".png")).alias("png"), F.countDistinct(F.when(F.col("path").endswith(".json"), unit)).alias("units"))


def sam_arch(name: Column) -> Column:
    return F.when(name.contains("vit_b"), "vit_b").when(name.contains("vit_l"), "vit_l").otherwise("vit_h")


def first_boxes(boxes: DataFrame, n: int = TOP_REGIONS) -> DataFrame:
    """Of each image, the first n boxes in the detector's order (pos), numbered from 1."""
    return ranked(boxes, [F.asc("pos")], ["image"], n).withColumn("region", F.row_number().over(Window.partitionBy("image").orderBy("pos")))


def newest_run(files: DataFrame) -> DataFrame:
    """The run (first folder of path) whose files changed last; of equals, the greatest name."""
    run = F.element_at(F.filter(F.split("path", "/"), lambda p: p != ""), 1)
    return files.groupBy(run.alias("run")).agg(F.max("modificationTime").alias("changed")).orderBy(F.desc("changed"), F.desc("run")).limit(1)


def sample_units(units: DataFrame, n: int = 10) -> DataFrame:
    """The first n different units in order."""
    return units.select("unit").distinct().orderBy("unit").limit(n)


def unit_of_page(path: Column) -> Column:
    """The unit by the folder alone: the document of a page's own folder (page-1/...) or of pages/<document>, else the file's stem."""
    parts = F.split(path, "/")
    parent, above = F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 3)
    return F.when(parent.startswith("page-"), above).when((parent != "") & (above == "pages"), parent).otherwise(stem(path))


def unit_of_region(path: Column) -> Column:
    """The unit of a region file: the folder above that of the regions."""
    parts = F.split(path, "/")
    return F.get(parts, F.size(parts) - 3)


def regions_or_whole(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions (image, region, x, y, w, h), and of images (image, width, height) without any, the whole image as region 1."""
    whole = images.join(regions.select("image").distinct(), "image", "left_anti")
    whole = whole.select("image", F.lit(1).alias("region"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return regions.select("image", "region", "x", "y", "w", "h").unionByName(whole)
