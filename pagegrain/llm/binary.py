"""Token ids as flat binary files.

A shard ``<name>`` is three files of little-endian numbers, with nothing else in them:

- ``<name>.bin``: the ids of its documents, one after another, as uint16 if the vocabulary
  fits and uint32 otherwise,
- ``<name>.off``: int64 offsets, one more than documents: document k of the shard has ids
  ``off[k]:off[k + 1]`` of the shard,
- ``<name>.doc``: their int64 doc_ids.

``manifest.json`` has the type of the ids and lists shards in order with the counts of documents and ids of all shards
before, so that any document's place in the whole is its shard's base plus its offset.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import library_encoder
from .words import slices

MANIFEST = "shard int, name string, n_docs long, n_ids long"
NULL_ID = -(1 << 63)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder. hdfs, s3 and gs need what pyarrow needs for them."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def id_type(tokenizer: str) -> str:
    """The smallest type that holds all ids of a tokenizer file."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if most < 1 << 16 else "<u4"


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, dtype: str | None = None) -> list[dict]:
    """Encode every whole text and write it to ``folder`` in ascending doc_id order; returns the manifest's shards.

    ``end_id`` is appended to each document (None: nothing). Null and empty texts have only that. Null
    doc_ids come first, written as the least int64. Equal doc_ids follow in the order of their
    texts. An empty table gives no shards. Columns beside doc_id and text are not read.

    Rows are dealt by ranges of doc_id and of the first 64 characters of their texts, and each task
    streams its rows to files that it renames at the end: a task that is run again, or twice at
    once, leaves one whole shard. Rows of one doc_id whose texts start alike stay in one task. Texts of any length are
    encoded as a whole. The driver gets a row per shard. dtype: of the ids; None takes the smallest that holds them.
    """
    spark = df.sparkSession
    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_id, by_text = F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    dealt = rows.repartitionByRange(parts, by_id, F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(by_id, by_text)
    kind = np.dtype(dtype or id_type(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        ends = int(end_id is not None)
        task = TaskContext.get()
        shard, name = task.partitionId(), f"shard-{task.partitionId():06d}"
        files, top = store(folder)
        files.create_dir(top, recursive=True)
        temporary = f"{top}/.{name}-{task.taskAttemptId()}"
        docs = total = 0
        with files.open_output_stream(f"{temporary}.bin") as ids_out, files.open_output_stream(f"{temporary}.off") as off_out, files.open_output_stream(f"{temporary}.doc") as doc_out:
            off_out.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for part in slices(batch):
                    flat, bounds = encoder.encode(part.column("text"))
                    flat = np.insert(flat, bounds[1:], end_id) if ends else flat
                    bounds = bounds + ends * np.arange(bounds.size)
                    ids_out.write(flat.astype(kind).tobytes())
                    off_out.write((total + bounds[1:]).astype("<i8").tobytes())
                    doc_out.write(part.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                    docs, total = docs + part.num_rows, total + int(bounds[-1])
        for ending in ("bin", "off", "doc"):
            if docs and files.get_file_info(f"{top}/{name}.{ending}").type == fs.FileType.NotFound:
                files.move(f"{temporary}.{ending}", f"{top}/{name}.{ending}")
            else:
                files.delete_file(f"{temporary}.{ending}")
        if docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    shards, doc_base, id_base = [], 0, 0
    for r in sorted(dealt.mapInArrow(run, MANIFEST).collect(), key=lambda r: r["shard"]):
        shards.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "doc_base": doc_base, "id_base": id_base})
        doc_base, id_base = doc_base + r["n_docs"], id_base + r["n_ids"]
    files, top = store(folder)
    files.create_dir(top, recursive=True)
    with files.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps({"dtype": kind.str, "shards": shards}).encode())
    return shards


class Shard:
    """One shard: memory-mapped, or in a remote store read a range at a time."""

    def __init__(self, folder: str, name: str, kind: np.dtype) -> None:
        self.files, self.path = store(folder)[0], f"{store(folder)[1]}/{name}"
        self.kinds = {"bin": kind, "off": np.dtype("<i8"), "doc": np.dtype("<i8")}
        local = isinstance(self.files, fs.LocalFileSystem)
        self.open = {e: self._mapped(e) if local else self.files.open_input_file(f"{self.path}.{e}") for e in self.kinds}
        self.n_docs = self.files.get_file_info(f"{self.path}.doc").size // 8

    def _mapped(self, ending: str) -> np.ndarray:
        path, kind = f"{self.path}.{ending}", self.kinds[ending]
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def numbers(self, ending: str, start: int, stop: int) -> np.ndarray:
        """The numbers start:stop of one of the files."""
        source, kind = self.open[ending], self.kinds[ending]
        if isinstance(source, np.ndarray):
            return source[start:stop]
        return np.frombuffer(source.read_at((stop - start) * kind.itemsize, start * kind.itemsize), kind)

    def close(self) -> None:
        for source in self.open.values():
            if not isinstance(source, np.ndarray):
                source.close()
        self.open = {}


def read(spark: SparkSession, folder: str, shards: list[dict] | None = None, dtype: str | None = None, ids: bool = True) -> DataFrame:
    """The documents in a folder, by its manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    files, top = store(folder)
    if shards is None or (shards and dtype is None):
        with files.open_input_stream(f"{top}/manifest.json") as source:
            manifest = json.loads(source.read())
        shards, dtype = manifest["shards"] if shards is None else shards, dtype or manifest["dtype"]
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["name"], s["id_base"]) for s in shards], "name string, base long").repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"], np.dtype(dtype))
                for at in range(0, shard.n_docs, 4096):
                    stop = min(at + 4096, shard.n_docs)
                    off, docs = np.array(shard.numbers("off", at, stop + 1)), np.array(shard.numbers("doc", at, stop))
                    found = [shard.numbers("bin", a, b).astype("<u4") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    columns = {
                        "doc_id": pa.array(docs, pa.int64(), mask=docs == NULL_ID), "start": pa.array(row["base"] + off[:-1], pa.int64()), "n_tokens": pa.array(np.diff(off), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    }
                    if ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)
                shard.close()

    return listed.mapInArrow(run, schema)
