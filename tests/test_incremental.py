import os

import pytest

from pagegrain.operators import catalog
from pagegrain.sources import files
from pagegrain.sources.incremental import Seen, grown_manifest


def put(folder, name, content, time):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (time, time))


def test_each_change_comes_once(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(6):
        put(folder, f"d{i % 2}/f{i}.bin", b"x" * (i + 1), 1000)
    seen, got = Seen(spark, catalog.shared_folder(spark)), []

    def names():
        out = sorted(p.rpartition("/")[2] for part in got for p in part)
        got.clear()
        return out

    assert seen.run(str(folder), got.append, at_once=4) == 6
    assert [len(p) for p in got] == [4, 2] and names() == [f"f{i}.bin" for i in range(6)]
    assert seen.run(str(folder), got.append) == 0 and not got
    put(folder, "d0/f0.bin", b"x", 2000)  # another time
    put(folder, "d1/f1.bin", b"longer", 1000)  # another length
    put(folder, "d1/f9.bin", b"new", 500)  # new, though older than all others
    assert seen.run(str(folder), got.append) == 3
    assert names() == ["f0.bin", "f1.bin", "f9.bin"]
    assert Seen(spark, seen.state).run(str(folder), got.append) == 0
    assert seen.table().count() == 7


def test_what_failed_comes_again(spark, tmp_path):
    for i in range(4):
        put(tmp_path / "in", f"f{i}.bin", b"x", 1000)
    seen, got = Seen(spark, catalog.shared_folder(spark)), []

    def fails(paths):
        if len(got) == 1:
            raise OSError("lost")
        got.append(paths)

    with pytest.raises(OSError, match="lost"):
        seen.run(str(tmp_path / "in"), fails, at_once=2)
    assert seen.new(str(tmp_path / "in")).count() == 2
    assert seen.run(str(tmp_path / "in"), got.append) == 2
    assert sorted(p.rpartition("/")[2] for part in got for p in part) == [f"f{i}.bin" for i in range(4)]


def test_manifest_grows_by_new_images(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "in", f"a/{i}.png", b"x", 1000)
    put(tmp_path / "in", "a/other.txt", b"x", 1000)
    manifest, state = catalog.shared_folder(spark), catalog.shared_folder(spark)
    assert grown_manifest(spark, str(tmp_path / "in"), manifest, state) == 3
    assert grown_manifest(spark, str(tmp_path / "in"), manifest, state) == 0
    put(tmp_path / "in", "a/1.png", b"changed", 3000)
    put(tmp_path / "in", "b/7.png", b"x", 1000)
    assert grown_manifest(spark, str(tmp_path / "in"), manifest, state) == 2
    assert sorted(r["image"].rpartition("/")[2] for r in files.manifest(spark, manifest).collect()) == ["0.png", "1.png", "2.png", "7.png"]
