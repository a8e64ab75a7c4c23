import io
import os
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagegrain.operators import catalog
from pagegrain.sources import binary, files


class Counted:
    """A file that counts the bytes that are read."""

    def __init__(self, file):
        self.file, self.read_bytes = file, 0

    def read(self, n=-1):
        out = self.file.read(n)
        self.read_bytes += len(out)
        return out

    def __getattr__(self, name):
        return getattr(self.file, name)


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
    return out.getvalue()


def test_large_archive_is_not_read_whole(spark, tmp_path):
    """Over two gigabytes in front of a small entry, in a file with a hole."""
    path = tmp_path / "in" / "large.zip"
    path.parent.mkdir()
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 12345)
        f.seek(0, os.SEEK_END)
        f.write(archive([("x/a.bin", bytes(100_000)), ("x/structuredData.JSON", '{"elements":[]}')]))
    with open(path, "rb") as f:
        counted = Counted(f)
        assert binary.first_entry(counted, binary.ENDING, 1000) == ("x/structuredData.JSON", b'{"elements":[]}', None)
    assert counted.read_bytes < 200_000
    listed = files.listing(spark, str(path.parent), "*.zip")
    row = binary.unzipped(listed).first()
    assert (row["json"], row["reason"]) == ('{"elements":[]}', None)
    assert listed.first()["length"] > 2 << 30


def test_broken_archives_give_reasons(spark, tmp_path):
    good = archive([("a.txt", "x"), ("One/StructuredData.json", "é"), ("two/structureddata.json", "later")])
    contents = {"good": good, "cut": good[:-10], "empty": b"", "text": b"no archive", "none": archive([("a.txt", "x")]), "large": archive([("structureddata.json", "y" * 5000)]), "bytes": archive([("structureddata.json", b"\xff")])}
    flipped = bytearray(archive([("structureddata.json", random.Random(1).randbytes(300))]))
    flipped[80] ^= 255
    contents["flipped"] = bytes(flipped)
    for name, content in contents.items():
        (tmp_path / f"{name}.zip").write_bytes(content)
    listed = files.listing(spark, str(tmp_path), "*.zip").select("path").union(spark.createDataFrame([(f"file://{tmp_path}/empty.zip",)], "path string"))  # Spark lists no empty files
    got = {r["path"].rpartition("/")[2][:-4]: r for r in binary.unzipped(listed, most=4000).collect()}
    assert got["good"]["json"] == "é" and got["good"]["name"] == "One/StructuredData.json"
    assert got["bytes"]["json"] == "�"
    assert {k: r["reason"].split(":")[0] for k, r in got.items() if r["reason"]} == {"cut": "broken archive", "empty": "broken archive", "text": "broken archive", "none": "no such entry", "large": "entry too large", "flipped": "broken archive"}
    missing = binary.unzipped(spark.createDataFrame([(f"file://{tmp_path}/absent.zip",)], "path string")).first()
    assert missing["json"] is None and missing["reason"].startswith("unreadable")


def test_files_come_back_byte_for_byte(spark):
    rows = [(f"d{i % 3}/f{i}.bin", os.urandom(i * 100)) for i in range(40)] + [("plain", b"x"), ("null", None)]
    folder = catalog.shared_folder(spark)
    for _ in range(2):  # again replaces
        assert binary.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(5), folder).count() == len(rows)
    top = Path(folder.removeprefix("file:"))
    assert {str(f.relative_to(top)): f.read_bytes() for f in top.rglob("*") if f.is_file()} == {p: c or b"" for p, c in rows}


@pytest.mark.parametrize("path", ["../x", "/x", "a//b", "a/./b", "", None])
def test_paths_stay_in_the_folder(spark, path):
    folder = catalog.shared_folder(spark)
    with pytest.raises(ValueError, match="below"):
        binary.write_files(spark.createDataFrame([("ok", b"1"), (path, b"2")], "path string, content binary"), folder)
    with pytest.raises(ValueError, match="several"):
        binary.write_files(spark.createDataFrame([("a", b"1"), ("a", b"2")], "path string, content binary"), folder)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_a_task_that_fails_leaves_no_half_file(spark):
    folder = catalog.shared_folder(spark)
    bad = spark.range(4).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") < 3, F.lit("x").cast("binary")).otherwise(F.raise_error(F.lit("lost"))).alias("content"))
    with pytest.raises(Exception, match="lost"):
        binary.write_files(bad, folder)
    top = folder.removeprefix("file:")
    assert all(os.path.getsize(f"{top}/{n}") == 1 for n in (os.listdir(top) if os.path.exists(top) else []) if not n.startswith("."))


def test_regions_with_images(spark):
    box = {"x": 0, "y": 0, "w": -1, "h": -1}
    df = spark.createDataFrame([("playbooks/d", 1, box, "t", "AAEC"), ("misc", 2, box, None, None)], "unit string, region int, bbox struct<x:int,y:int,w:int,h:int>, text string, image_b64 string")
    got = {r["path"]: bytes(r["content"]) for r in binary.region_files(df).collect()}
    assert set(got) == {"playbooks/d/region-1.json", "playbooks/d/region-1.png", "misc/region-2.json"}
    assert got["playbooks/d/region-1.png"] == b"\0\1\2"
    assert got["misc/region-2.json"].decode() == '{"bbox":{"x":0,"y":0,"w":-1,"h":-1},"text":null,"image_b64":null}'
