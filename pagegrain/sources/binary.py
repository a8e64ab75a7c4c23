"""Files of any kind: written from executors, and archives of which one entry is read."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import duplicate_keys, stable

ENDING = "structureddata.json"
MOST = 256 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a file or folder with its scheme; others than file: need what pyarrow needs for them."""
    return (fs.LocalFileSystem(), f"/{uri.removeprefix('file:').lstrip('/')}") if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` (bytes) of each row under ``path``, relative to a folder that all executors share. Returns path and length of what was written.

    A file gets its name once it is whole, by a rename, so that a task that is run again, or twice at once, leaves one whole file; a file that was there
    is replaced. Paths out of the folder, empty and null ones and paths that come twice raise before anything is written. A null content is an empty file.
    """
    bad = F.col("path").isNull() | (F.col("path") == "") | F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda p: p.isin("", ".", ".."))
    if (wrong := files.where(bad).select("path").first()) is not None:
        raise ValueError(f"no path below the folder: {wrong['path']}")
    if (twice := duplicate_keys(files, ["path"]).first()) is not None:
        raise ValueError(f"several rows for one path: {twice['path']}")
    spark = files.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(top)
        task = TaskContext.get().taskAttemptId()
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                parent, _, name = f"{base}/{path}".rpartition("/")
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{parent}/.{name}.{task}") as out:
                    out.write(content or b"")
                store.move(f"{parent}/.{name}.{task}", f"{parent}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "length"])

    return stable(files.select("path", "content").mapInArrow(run, "path string, length long"))


def region_files(regions: DataFrame) -> DataFrame:
    """Files of regions (unit, region, bbox, text, image_b64), as write_files takes them: <unit>/region-<n>.json with box, text and image, and the image beside it as .png if there is one."""
    name = F.concat(F.col("unit"), F.lit("/region-"), F.col("region").cast("string"))
    as_json = F.to_json(F.struct("bbox", "text", "image_b64"), {"ignoreNullFields": "false"}).cast("binary")
    kinds = F.array(F.struct(F.lit(".json").alias("ending"), as_json.alias("content")), F.struct(F.lit(".png").alias("ending"), F.unbase64("image_b64").alias("content")))
    each = regions.select(name.alias("name"), F.explode(kinds).alias("f"))
    return each.select(F.concat("name", "f.ending").alias("path"), "f.content").where((F.col("path").endswith(".json")) | F.col("content").isNotNull())


def first_entry(file: BinaryIO, ending: str, most: int) -> tuple[str | None, bytes | None, str | None]:
    """Name and bytes of an archive's first entry with a name that ends so, in any case; or the reason why there are none.

    The list at the archive's end is read, and then that entry's bytes alone. Of entries of one name, the last one's bytes count.
    """
    try:
        with zipfile.ZipFile(file) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(ending)), None)
            if name is None:
                return None, None, "no such entry"
            if z.getinfo(name).file_size > most:
                return name, None, "entry too large"
            with z.open(name) as entry:
                content = entry.read(most + 1)
            return (name, None, "entry too large") if len(content) > most else (name, content, None)
    except (zipfile.BadZipFile, zlib.error, EOFError, ValueError) as e:
        return None, None, f"broken archive: {e}"
    except (RuntimeError, NotImplementedError) as e:  # encrypted, or a method that the library lacks
        return None, None, f"closed archive: {e}"
    except OSError as e:
        return None, None, f"unreadable: {type(e).__name__}"


def unzipped(files: DataFrame, ending: str = ENDING, most: int = MOST) -> DataFrame:
    """Of each ZIP (path), the text of the first entry with a name that ends so, in any case: path, name, json, reason.

    Archives of any size are read where they are, the list at the end and one entry, of ``most`` bytes at most: no content goes through Spark's rows but that entry's. Archives that
    are broken, encrypted or lack the entry, and those whose entry is larger, have a null json and a reason. Bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    store, own = place(path)
                    with store.open_input_file(own) as file:
                        name, content, reason = first_entry(file, ending, most)
                except (OSError, pa.ArrowInvalid) as e:
                    name, content, reason = None, None, f"unreadable: {type(e).__name__}"
                row = {"path": path, "name": name, "json": None if content is None else content.decode("utf-8", "replace"), "reason": reason}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.string()) for c in row]))

    return files.select("path").mapInArrow(run, "path string, name string, json string, reason string")
