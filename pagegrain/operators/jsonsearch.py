"""The first string in nested JSON that fits, in the order of a search with a stack, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import stable


def values(node: Column) -> Column:
    """What an object or list in JSON holds, in order: key, raw (a string as it is, else JSON) and kind of each. Names that are whole numbers come first, as objects of scripts list them."""
    kinds = F.transform(F.map_values(F.from_json(node, "map<string,variant>")), F.schema_of_variant)
    raw = F.map_entries(F.from_json(node, "map<string,string>"))
    number = F.transform(raw, lambda e: F.when(e["key"].rlike("^(0|[1-9][0-9]{0,9})$") & (F.length(e["key"]) < 11), e["key"].try_cast("long")))

    def entry(e: Column, i: Column) -> Column:
        n = F.get(number, i)
        n = F.when(n < (1 << 32) - 1, n)
        return F.struct(n.isNull().alias("named"), F.coalesce(n, F.lit(0)).alias("n"), i.alias("i"), e["key"].alias("key"), e["value"].alias("raw"), F.get(kinds, i).alias("kind"))

    named = F.transform(F.array_sort(F.transform(raw, entry)), lambda e: F.struct(e["key"].alias("key"), e["raw"].alias("raw"), e["kind"].alias("kind")))
    listed = F.transform(items(node), lambda e, i: F.struct(i.cast("string").alias("key"), e["raw"].alias("raw"), e["kind"].alias("kind")))
    return F.when(F.ltrim(node).startswith("["), listed).otherwise(named)


def items(node: Column) -> Column:
    """What a list in JSON holds: raw and kind of each."""
    kinds = F.from_json(node, "array<variant>")
    return F.zip_with(F.from_json(node, "array<string>"), kinds, lambda raw, v: F.struct(raw.alias("raw"), F.schema_of_variant(v).alias("kind")))


def first_string(json: DataFrame, key_part: str | None, pattern: str, column: str = "json") -> DataFrame:
    """``found``: some string in nested JSON that matches a pattern (as rlike has it), under a key with a part in its lower-case name if one is given; else null.

    An object's strings and those in its lists are looked at in order, then the objects that it holds, the last one first and all within it before
    the next. Lists in lists count as objects whose names are numbers. Null and malformed JSON and JSON of one value have none; a name
    that an object has twice is looked at twice. Rows are independent; other columns stay.

    One step for each level of nesting: its values are exploded, and each carries the places on the way to it, so that the least of those that match is
    the first. What lies behind a match isn't opened.
    """
    kept = [c for c in json.columns if c != column]
    rows = stable(json.withColumn("__row", F.monotonically_increasing_id()))
    level = rows.select("__row", F.array().cast("array<bigint>").alias("path"), F.col(column).alias("node")).where("node is not null")
    best = None
    while True:
        outer = level.select("__row", "path", F.posexplode(values(F.col("node"))).alias("o", "v"))
        is_list = F.col("v.kind").startswith("ARRAY")
        inner = F.when(is_list, items(F.col("v.raw"))).otherwise(F.array(F.struct(F.col("v.raw").alias("raw"), F.col("v.kind").alias("kind"))))
        each = outer.select("__row", "path", F.col("o").cast("long").alias("o"), F.lower("v.key").alias("key"), F.posexplode(inner).alias("i", "x"))
        matches = (F.col("x.kind") == "STRING") & F.col("x.raw").rlike(pattern) & (F.contains("key", F.lit(key_part)) if key_part is not None else F.lit(True))
        holds = F.col("x.kind").startswith("OBJECT") | F.col("x.kind").startswith("ARRAY")
        each = each.select("__row", "path", "o", F.col("i").cast("long").alias("i"), F.col("x.raw").alias("raw"), holds.alias("holds"), matches.alias("matches"))
        each = stable(each.where("holds or matches"))
        seen = each.where("matches").select("__row", F.struct("path", "o", "i", "raw").alias("first"))
        best = (seen if best is None else best.unionByName(seen)).groupBy("__row").agg(F.min("first").alias("first"))  # of what is stable
        level = each.where("holds").select("__row", F.concat("path", F.array(-F.col("o"), -F.col("i"))).alias("path"), F.col("raw").alias("node"))
        level = level.join(best, "__row", "left").where(F.col("first").isNull() | (F.col("path") < F.col("first.path"))).drop("first")
        if level.isEmpty():
            break
    return rows.join(best.select("__row", F.col("first.raw").alias("found")), "__row", "left").select(*kept, "found")
