"""Catalog maintenance as functions of tables: they return what the table then holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows of new whose keys it lacks, one for each key; rows that are there stay as they are. Null keys equal each other."""
    return table.unionByName(absent(table, new, keys).select(*table.columns))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir. Where that is unset, a folder of this machine is set for it, on a local master alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagegrain-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """df as it is now, written to the checkpoint folder: reading it again gives the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def append_with_ids(table: DataFrame, new: DataFrame, id_: str = "id") -> DataFrame:
    """table and new rows numbered on from its greatest id."""
    return table.unionByName(numbered(table, new, id_).select(*table.columns))


def numbered(table: DataFrame, new: DataFrame, id_: str = "id") -> DataFrame:
    """new rows with ids that go on from the greatest of table."""
    return numbered_from(table.agg(F.coalesce(F.max(id_), F.lit(0))).first()[0], new, id_)


def numbered_from(last: int, new: DataFrame, id_: str = "id") -> DataFrame:
    """new rows with ids from last + 1 on.

    Rows of new are checkpointed, so that they are numbered as they were counted, and numbered within partitions, which start from a prefix sum of
    partition sizes: one small row for each partition, and no global sort.
    """
    spark = new.sparkSession
    marked = stable(new.withColumn("__m", F.monotonically_increasing_id())).withColumn("__p", F.shiftright("__m", 33))
    sizes = sorted((r["__p"], r["n"]) for r in marked.groupBy("__p").agg(F.count("*").alias("n")).collect())
    starts, at = [], last
    for p, n in sizes:
        starts.append((p, at))
        at += n
    base = F.broadcast(spark.createDataFrame(starts, "__p long, __s long"))
    return marked.join(base, "__p").withColumn(id_, F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m", "__p", "__s")


def filled(df: DataFrame, like: StructType) -> DataFrame:
    """The columns of a schema; those that df lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like))


def fresh(new_docs: DataFrame, new_blocks: DataFrame, last_doc: int, last_block: int) -> tuple[DataFrame, DataFrame]:
    """New documents (with a key) with ids from last_doc + 1 on, and their blocks (by that key) with ids of their own and their documents'. Blocks of no document are left out."""
    with_ids = stable(numbered_from(last_doc, new_docs))
    owned = new_blocks.join(with_ids.select("key", F.col("id").alias("sourceDocId")), "key")
    return with_ids, numbered_from(last_block, owned)


def ingest(docs: DataFrame, blocks: DataFrame, new_docs: DataFrame, new_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after an ingest: new documents (key and columns of docs) get ids, and their blocks (key and a stored block's columns) those of their documents.

    Columns that new rows lack are null. Blocks of no document are left out.
    """
    last = [t.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for t in (docs, blocks)]
    own_docs, own_blocks = fresh(new_docs, new_blocks, *last)
    return docs.unionByName(filled(own_docs, docs.schema)), blocks.unionByName(filled(own_blocks, blocks.schema))


def absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Those rows of new whose keys table lacks, one for each key. Null keys equal each other."""
    once = new.dropDuplicates(keys)
    condition = F.lit(True)
    for k in keys:
        condition = condition & once[k].eqNullSafe(table[k])
    return once.join(table, condition, "left_anti")


def seed(parents: DataFrame | None, table: DataFrame, new: DataFrame, keys: list[str], parent_key: str | None = None, parent_id: str | None = None) -> DataFrame:
    """table after a seed of one level: rows of new whose natural keys it lacks get ids that go on from its greatest.

    With parents (id and parent_key, the level above after its own seed), each new row's ``parent_key`` becomes ``parent_id``; rows of a parent that isn't
    there are left out. Rows that are there stay as they are, whatever new says of them, so that a second seed changes nothing.
    """
    rows = absent(table, new, keys)
    if parents is not None:
        rows = rows.join(parents.select(F.col(parent_key).alias("__k"), F.col("id").alias(parent_id)), F.col(parent_key) == F.col("__k")).drop("__k")
    return table.unionByName(filled(numbered(table, rows), table.schema))


def patch_canvas(docs: DataFrame, patch: DataFrame) -> DataFrame:
    """Documents after partial updates (id, transform, profile, score): the transform is always set, the profile if it isn't empty, the score if it is a number."""
    p = patch.select(F.col("id"), F.col("transform").alias("__t"), F.col("profile").alias("__p"), F.col("score").alias("__s"), F.lit(True).alias("__hit"))
    out = docs.join(p, "id", "left")
    return out.select(*(F.when(F.col("__hit"), F.col("__t")).otherwise(F.col(c)).alias(c) if c == "canvasTransform" else F.coalesce(F.nullif("__p", F.lit("")), c).alias(c) if c == "canvasProfileId" else F.coalesce("__s", c).alias(c) if c == "canvasMatchScore" else F.col(c) for c in docs.columns))


def cascade(child: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Children whose parent isn't deleted."""
    return child.join(deleted.select(F.col(deleted_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose key has no parent; null keys have none to look for."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reset(docs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Empty documents and blocks, and how many there were."""
    return docs.limit(0), blocks.limit(0), {"docs": docs.count(), "blocks": blocks.count()}


def hierarchy(methodologies: DataFrame, frames: DataFrame, fields: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Frames in order (null first) with their fields in order; of an empty table, the fallback."""
    listed = fields.groupBy("frameId").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("order", F.lit(-(1 << 31))).alias("o"), "id", "name"))).alias("f"))
    out = frames.join(methodologies.select(F.col("id").alias("methodologyId"), "title"), "methodologyId").join(listed, F.col("id") == F.col("frameId"), "left")
    out = out.select("title", "slug", F.col("name").alias("frame"), "order", F.coalesce(F.transform("f", lambda x: x["name"]), F.array()).alias("fields"))
    if fallback is not None and out.isEmpty():
        out = out.unionByName(fallback)
    return out.orderBy(F.col("order").asc_nulls_first(), "slug")


def new_manifest_rows(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """The images that a manifest lacks, once each."""
    return images.select("image").distinct().join(manifest.select("image").distinct(), "image", "left_anti")


def advice(step: Column, status: Column, error: Column) -> Column:
    """What to do about a health check's result; the first rule that applies."""
    # Rules and messages.
    rules = [
        (status == 0, "Network / DNS issue – verify connectivity & host resolution"),
        ((step == "token") & status.isin(401, 403), "Check client id/secret and project entitlements"),
        ((step == "token") & (status >= 500), "Service error – retry later"),
        ((step == "assets") & (status == 401), "Token invalid/expired – refresh credentials"),
        ((step == "assets") & (status == 403), "Insufficient permissions for assets scope"),
        ((step == "assets") & (status == 404), "Endpoint not found – confirm host/region"),
        ((step == "extract") & (status == 404), "Auth OK (invalid fake asset is expected)"),
        ((step == "extract") & (status == 400), "Auth OK (payload invalid – expected with dry run)"),
        ((step == "extract") & (status == 401), "Token rejected for extract operation"),
        ((step == "extract") & (status == 403), "Entitlement missing for extract operation"),
        (F.lower(F.coalesce(error, F.lit(""))).contains("timeout"), "Timeout – check network latency / firewall"),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("Inspect status and logs")


def batch_totals(results: DataFrame) -> DataFrame:
    """Totals of an ingest batch (seq, ok, blocks, docId): any success, blocks, first and last document of successes in order."""
    good = F.when(F.col("ok"), F.col("docId"))
    return results.agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.min_by(good, F.when(F.col("ok"), F.col("seq"))).alias("firstDocId"), F.max_by(good, F.when(F.col("ok"), F.col("seq"))).alias("lastDocId"))


def ranked(df: DataFrame, by: list[Column], within: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("__r") <= n).drop("__r")


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key: the filter reaches the scan."""
    return table.where(F.col(key) == F.lit(value))


def newest(table: DataFrame, key: str = "id") -> DataFrame:
    """All rows, the greatest key first."""
    return table.orderBy(F.desc(key))
