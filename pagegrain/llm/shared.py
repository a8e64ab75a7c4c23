"""Folders that driver and executors share, and small helpers for operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, with its scheme. Only on a local master a folder of its own is set where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pagegrain-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base.rstrip('/'))}/{uuid.uuid4().hex}"


_addresses: dict[str, str] = {}


def qualified(spark: SparkSession, base: str) -> str:
    """A folder with its scheme. One without is on Spark's default file system, which need not be local: a small table written there tells its whole address."""
    if SCHEME.match(base):
        return base
    if base not in _addresses:
        name = uuid.uuid4().hex
        spark.range(1).write.parquet(f"{base}/{name}")
        address = spark.read.parquet(f"{base}/{name}").inputFiles()[0]
        _addresses[base] = address[: address.index(f"/{name}/")]
    return _addresses[base]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for a while; the caller's own come back."""
    own = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def steps(spark: SparkSession) -> AbstractContextManager[None]:
    """For a step that is run at once: texts go to Python workers a few at a time, as one may be long, and the step's shuffle files go when its result is there."""
    own = {"spark__sql__execution__arrow__maxRecordsPerBatch": "512", "spark__sql__execution__arrow__maxBytesPerBatch": str(16 << 20)}
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **own)


def written(df: DataFrame, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, kind: str = "") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. Batches first go through ``change``, if given, which makes columns of ``kind``.

    In a mounted folder (file:), Python workers write the files, as Hadoop's local file system starts a process for each file and
    folder to set permissions. A task's file gets its name once it is whole, and the same name if the task is run again. As many
    files must be there as tasks wrote: a folder that only seems to be shared raises.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with steps(spark):
        schema = df.mapInArrow(change, kind).schema if change else df.schema
        if not path.startswith("file:"):
            (df.mapInArrow(change, kind) if change else df).write.option("compression", "zstd").parquet(path)
            return spark.read.schema(schema).parquet(path)
        folder = f"/{path.removeprefix('file:').lstrip('/')}"
        os.makedirs(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, waiting, size, writer = TaskContext.get(), [], 0, None
            temporary = f"{folder}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"

            def put() -> pq.ParquetWriter:
                out = writer or pq.ParquetWriter(temporary, waiting[0].schema, compression="zstd")
                out.write_table(pa.Table.from_batches(waiting))
                waiting.clear()
                return out

            for batch in change(batches) if change else batches:
                if batch.num_rows:
                    waiting.append(batch)
                    size += batch.nbytes
                if size > 16 << 20:
                    writer, size = put(), 0
            if waiting:
                writer = put()
            if writer:
                writer.close()
                os.rename(temporary, f"{folder}/part-{task.partitionId():06d}.parquet")
                yield pa.RecordBatch.from_pydict({"files": pa.array([1], pa.int64())})

        files = df.mapInArrow(run, "files long").agg(F.sum("files").alias("n")).first()["n"] or 0
    if not files:
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).parquet(f"file://{folder}")
    if (there := len(out.inputFiles())) != files:
        raise RuntimeError(f"executors wrote {files} files to {path}, and the driver finds {there}: the folder isn't shared")
    return out


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], size: str, hot: int = 1000) -> DataFrame:
    """rows and, by ``keys``, the columns of ``small`` (inner). small has a row for each key, with the number of rows that have it in ``size``.

    Keys of more than one in ``hot`` of all these rows are fewer than ``hot``, so they can be listed and broadcast, and their rows stay where
    they are. The others are shuffled, and none of them fills a task.
    """
    total = small.agg(F.sum(size).alias("n")).first()["n"] or 0
    is_hot = F.col(size) * hot > total
    few = small.where(is_hot)
    listed = few.select(*keys).collect()
    if not listed:
        return rows.join(small, keys)
    if len(keys) == 1:
        own = F.col(keys[0]).isin([r[0] for r in listed])
    else:
        kinds = [few.schema[k].dataType for k in keys]
        own = F.struct(*keys).isin([F.struct(*(F.lit(v).cast(kind).alias(k) for k, kind, v in zip(keys, kinds, r, strict=True))) for r in listed])
    return rows.where(own).join(F.broadcast(few), keys).unionByName(rows.where(~own).join(small.where(~is_hot), keys))


def new_columns(keep: tuple[str, ...], made: list[str]) -> None:
    """Refuses columns to keep that have the name of one that the operator makes."""
    if clash := sorted({k.lower() for k in keep} & {m.lower() for m in made}):
        raise ValueError(f"keep names columns that are made here: {', '.join(clash)}")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
