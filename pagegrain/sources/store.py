"""Stored tables: folders of Parquet, split into buckets of a key and changed one commit at a time.

``<root>/data/<table>/<commit>/bucket=<k>/`` holds what a commit wrote, and ``<root>/versions/<n>.json`` lists, for each table, the folders that are its rows. A
commit writes the buckets that it touches into folders of its own, all tables first, and then publishes one new list by a rename. Until then readers see the
old one, and a run that fails or is killed leaves nothing but folders that no list names. Files of buckets that a commit doesn't touch stay where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..operators import catalog


class Table(NamedTuple):
    """Columns, the column whose hash picks a row's bucket, and that by which rows lie in a bucket."""

    columns: str
    key: str
    order: str = "id"


class Change(NamedTuple):
    """Rows to write and the buckets that they replace; None: they are added to what is there."""

    rows: DataFrame | None
    replaced: list[int] | None = None


class Conflict(RuntimeError):
    """Another commit came first; the change may be made again on what the tables now hold."""


#: Documents and their blocks, both by the document's id, so that a document's rows are in one bucket of each.
CATALOG = {"docs": Table(schema.SOURCE_DOC, "id"), "blocks": Table(schema.BLOCK, "sourceDocId")}
#: Templates by their natural keys.
TEMPLATES = {
    "methodologies": Table(schema.METHODOLOGY, "title"),
    "frames": Table(schema.FRAME, "slug"),
    "fields": Table(schema.FIELD, "slug"),
}


class Store:
    """Tables below a folder that all executors share. The number of buckets is fixed by the first commit."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table] = CATALOG, buckets: int = 64) -> None:
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        _, state = self._newest()
        self.buckets = state["buckets"] if state else buckets

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version}.json", wholetext=True).first()[0])

    def _newest(self) -> tuple[int, dict | None]:
        found = self._versions()
        return (found[-1], self._read(found[-1])) if found else (0, None)

    def _state(self) -> dict:
        """What the tables hold now, and in which version: for each, the last id and rows of bucket, commit and number of rows."""
        version, state = self._newest()
        return (state or {"buckets": self.buckets, "tables": {name: {"last": 0, "parts": []} for name in self.tables}}) | {"version": version}

    def _publish(self, state: dict) -> None:
        """The list of a version, under its name once it is whole; whoever has the name first wins."""
        name = f"{self.root}/versions/{state['version']}.json"
        draft = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(name), self._no_options)
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{name} is another commit's") from None
            raise

    @property
    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self._versions(), default=0)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of the first column's values."""
        return sorted(r[0] for r in keys.select(self.bucket(keys[keys.columns[0]])).distinct().collect())

    def read(self, name: str, buckets: Iterable[int] | None = None, state: dict | None = None) -> DataFrame:
        """A table as it is now, or those buckets of it; a commit that follows doesn't change what this reads."""
        columns = self.tables[name].columns
        wanted = None if buckets is None else set(buckets)
        parts = [p for p in (state or self._state())["tables"][name]["parts"] if wanted is None or p[0] in wanted]
        if not parts:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*(f"{self.root}/data/{name}/{commit}/bucket={b}" for b, commit, _ in parts))

    def counts(self) -> dict[str, int]:
        """Rows of each table, by the list alone."""
        return {name: sum(n for _, _, n in t["parts"]) for name, t in self._state()["tables"].items()}

    def _stage(self, name: str, rows: DataFrame, commit: str) -> list[list]:
        """Writes rows by bucket. Ranges of bucket and order may split a large bucket, so that a document of very many blocks has several files."""
        table, folder = self.tables[name], f"{self.root}/data/{name}/{commit}"
        like = StructType.fromDDL(table.columns)
        out = catalog.filled(rows, like).withColumn("bucket", self.bucket(F.col(table.key)))
        out.repartitionByRange("bucket", table.order).sortWithinPartitions("bucket", table.order).write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema("bucket int").parquet(folder).groupBy("bucket").agg(F.count("*").alias("n"))
        return [[r["bucket"], commit, r["n"]] for r in written.collect()]

    def commit(self, changes: Mapping[str, Change], state: dict | None = None) -> None:
        """All changes or none. state: what they were made from; if another commit came since, Conflict is raised and nothing changes."""
        state = state or self._state()
        commit = uuid.uuid4().hex
        after = {"version": state["version"] + 1, "buckets": self.buckets, "tables": dict(state["tables"])}
        for name, change in changes.items():
            old = state["tables"][name]
            staged = self._stage(name, change.rows, commit) if change.rows is not None else []
            gone = set(change.replaced or ())
            added = 0 if change.replaced is not None else sum(n for _, _, n in staged)
            after["tables"][name] = {"last": old["last"] + added, "parts": [p for p in old["parts"] if p[0] not in gone] + staged}
        self._publish(after)

    def ingest(self, new_docs: DataFrame, new_blocks: DataFrame) -> None:
        """New documents (with a key) and their blocks (by that key), with ids that go on from the last ones. Nothing that is stored is read or written again."""
        state = self._state()
        docs, blocks = catalog.fresh(new_docs, new_blocks, *(state["tables"][t]["last"] for t in ("docs", "blocks")))
        self.commit({"docs": Change(docs), "blocks": Change(blocks)}, state)

    def patch_canvas(self, patch: DataFrame) -> None:
        """Partial updates (id, transform, profile, score), one for each id. Only the buckets of these ids are read and written."""
        if not catalog.duplicate_keys(patch, ["id"]).isEmpty():
            raise ValueError("several patches for one id")
        state = self._state()
        touched = self.buckets_of(patch.select("id"))
        self.commit({"docs": Change(catalog.patch_canvas(self.read("docs", touched, state), patch), touched)}, state)

    def delete(self, ids: DataFrame) -> None:
        """Deletes documents by their ids, and their blocks. Only the buckets of these ids are read and written."""
        state = self._state()
        gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
        touched = self.buckets_of(gone)
        rows = {name: catalog.cascade(self.read(name, touched, state), self.tables[name].key, gone, "__gone") for name in ("docs", "blocks")}
        self.commit({name: Change(df, touched) for name, df in rows.items()}, state)

    def reset(self) -> dict[str, int]:
        """Empties all tables and says how many rows they had. Ids go on from where they were."""
        state, counts = self._state(), self.counts()
        self.commit({name: Change(None, list(range(self.buckets))) for name in self.tables}, state)
        return counts

    def insert_if_absent(self, name: str, new: DataFrame, keys: list[str]) -> None:
        """Rows whose keys (the bucket's among them) the table lacks, one for each key, with new ids. Only the buckets of new rows are read, and nothing there is written again."""
        if self.tables[name].key not in keys:
            raise ValueError(f"the keys of {name} must have {self.tables[name].key} among them, by which its buckets go")
        state = self._state()
        there = self.read(name, self.buckets_of(new.select(self.tables[name].key)), state)
        rows = catalog.absent(there, new, keys)
        self.commit({name: Change(catalog.numbered_from(state["tables"][name]["last"], rows))}, state)

    def seed(self, methodologies: DataFrame, frames: DataFrame, fields: DataFrame) -> None:
        """Three levels by natural keys, each a commit: methodologies (title, version), frames (title, version, slug and their own columns) and fields (frame, the slug of
        theirs, slug and their own columns). Rows that are there stay as they are; new ones get ids, and the ids of their parents, new or old. Rows without a parent are left out.
        """
        self.insert_if_absent("methodologies", methodologies, ["title", "version"])
        parents = self.read("methodologies").select("title", "version", F.col("id").alias("methodologyId"))
        self.insert_if_absent("frames", frames.join(parents, ["title", "version"]), ["slug"])
        parents = self.read("frames").select(F.col("slug").alias("frame"), F.col("id").alias("frameId"))
        self.insert_if_absent("fields", fields.join(parents, "frame"), ["slug"])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the lists before the last ``keep`` and all folders that the others don't name; returns how many folders went. Not while others read old versions or write."""
        found = self._versions()
        kept = [self._read(v) for v in found[-keep:]]
        for v in found[:-keep]:
            self._files.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        gone = 0
        for name in self.tables:
            named = {(commit, b) for state in kept for b, commit, _ in state["tables"][name]["parts"]}
            top = self._path(f"{self.root}/data/{name}")
            for commit in self._files.listStatus(top) if self._files.exists(top) else []:
                id_ = commit.getPath().getName()
                for part in self._files.listStatus(commit.getPath()):
                    folder = part.getPath().getName()
                    if folder.startswith("bucket=") and (id_, int(folder.removeprefix("bucket="))) not in named:
                        gone += self._files.delete(part.getPath(), True)
                if id_ not in {c for c, _ in named}:
                    self._files.delete(commit.getPath(), True)
        return gone
