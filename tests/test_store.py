import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagegrain import schema
from pagegrain.operators import catalog, normalize
from pagegrain.sources.store import TEMPLATES, Change, Conflict, Store

PATCH = f"id long, transform {normalize.TRANSFORM}, profile string, score double"


def uploads(spark, first, n, per_doc=5):
    docs = spark.range(first, first + n).select(F.col("id").alias("key"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("pdf").alias("type"))
    blocks = spark.range(first * per_doc, (first + n) * per_doc).select(F.floor(F.col("id") / per_doc).alias("key"), (F.col("id") % per_doc).cast("int").alias("page"), F.lit("text").alias("role"), F.col("id").cast("string").alias("text"))
    return docs, blocks


def rows(store):
    """Titles with their blocks' texts."""
    docs, blocks = store.read("docs"), store.read("blocks")
    own = blocks.groupBy(F.col("sourceDocId").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("text").cast("int").alias("t")))).alias("b"))
    return {r["title"]: [x["t"] for x in r["b"] or []] for r in docs.join(own, "id", "full").collect()}


def expected(first, n, per_doc=5):
    return {f"t{k}": list(range(k * per_doc, (k + 1) * per_doc)) for k in range(first, first + n)}


def files(store, name):
    return set(store.read(name).inputFiles())


@pytest.fixture
def store(spark):
    made = Store(spark, catalog.shared_folder(spark), buckets=8)
    made.ingest(*uploads(spark, 0, 30))
    return made


def test_ingests_add_up(spark, store):
    before = files(store, "blocks")
    store.ingest(*uploads(spark, 30, 20))
    assert rows(store) == expected(0, 50)
    assert before < files(store, "blocks")
    ids = [r["id"] for r in store.read("docs").collect()]
    assert sorted(ids) == list(range(1, 51))
    assert sorted(r["id"] for r in store.read("blocks").select("id").collect()) == list(range(1, 251))
    assert store.counts() == {"docs": 50, "blocks": 250}


def test_failed_ingest_leaves_all_as_it_was(spark, store):
    docs, blocks = uploads(spark, 30, 20)
    bad = blocks.withColumn("text", F.when(F.col("text") == "170", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    before, version = files(store, "docs"), store.version
    with pytest.raises(Exception, match="lost"):
        store.ingest(docs, bad)
    assert (Store(spark, store.root).version, files(store, "docs"), rows(store)) == (version, before, expected(0, 30))
    store.ingest(docs, blocks)
    assert rows(store) == expected(0, 50)


def test_killed_before_it_publishes(spark, store):
    """A process of its own is killed once it has written all files."""
    code = f"""
import os, signal, sys
sys.path[:0] = {[str(Path(__file__).parent), str(Path(__file__).parents[1])]!r}
from pyspark.sql import SparkSession
from pagegrain.sources.store import Store
from test_store import uploads
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {os.path.dirname(store.root)!r}).getOrCreate()
store = Store(spark, {store.root!r})
store._publish = lambda state: os.kill(os.getpid(), signal.SIGKILL)
store.ingest(*uploads(spark, 30, 20))
"""
    done = subprocess.run([sys.executable, "-c", code], check=False, capture_output=True, timeout=300)
    assert done.returncode == -9, done.stderr[-2000:]
    left = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{store.root}/data").count()
    assert left > len(files(store, "docs")) + len(files(store, "blocks"))  # it has written
    assert rows(store) == expected(0, 30)
    store.ingest(*uploads(spark, 30, 20))
    assert rows(store) == expected(0, 50)
    assert store.vacuum() > 0
    assert rows(Store(spark, store.root)) == expected(0, 50)


def test_patch_and_delete_touch_their_buckets_alone(spark, store):
    ids = {r["title"]: r["id"] for r in store.read("docs").collect()}
    touched = store.buckets_of(spark.createDataFrame([(ids["t3"],)], "id long"))
    others = [{f for f in files(store, name) if f"bucket={touched[0]}/" not in f} for name in ("docs", "blocks")]
    for _ in range(2):  # twice changes no more than once
        store.patch_canvas(spark.createDataFrame([(ids["t3"], (2.0, 2.0, 0.0, 0.0, 0.0, True), "P", 0.5), (10**9, None, "X", None)], PATCH))
    patched = store.read("docs").where("title = 't3'").first()
    assert (patched["canvasProfileId"], patched["canvasTransform"]["scaleX"], patched["canvasMatchScore"]) == ("P", 2.0, 0.5)
    assert store.read("docs").where("canvasProfileId is not null").count() == 1
    for _ in range(2):
        store.delete(spark.createDataFrame([(ids["t3"],), (ids["t3"],)], "gone long"))
    assert rows(store) == {k: v for k, v in expected(0, 30).items() if k != "t3"}
    missing = store.buckets_of(spark.createDataFrame([(10**9,)], "id long"))
    assert others[1] <= files(store, "blocks") and {f for f in others[0] if f"bucket={missing[0]}/" not in f} <= files(store, "docs")
    with pytest.raises(ValueError, match="several"):
        store.patch_canvas(spark.createDataFrame([(1, None, "a", None), (1, None, "b", None)], PATCH))


def test_reset_twice(spark, store):
    assert store.reset() == {"docs": 30, "blocks": 150}
    assert store.reset() == {"docs": 0, "blocks": 0} == store.counts()
    assert store.read("docs").count() == store.read("blocks").count() == 0
    store.ingest(*uploads(spark, 0, 3))
    assert store.read("docs").agg(F.min("id")).first()[0] == 31  # ids aren't used again
    store.delete(spark.createDataFrame([], "id long"))
    store.ingest(*(df.limit(0) for df in uploads(spark, 0, 3)))
    assert rows(store) == expected(0, 3)


def test_readers_and_writers_at_once(spark, store):
    seen, state = store.read("blocks"), store._state()
    other = Store(spark, store.root)
    other.delete(other.read("docs").where("title < 't2'").select("id"))
    assert seen.count() == 150
    with pytest.raises(Conflict):
        store.commit({"docs": Change(None, [0, 1, 2])}, state)
    assert store.counts() == other.counts()


def test_a_large_document_has_several_files(spark):
    store = Store(spark, catalog.shared_folder(spark), buckets=2)
    docs, _ = uploads(spark, 0, 2)
    blocks = spark.range(200_000).select(F.when(F.col("id") % 100 > 0, 0).otherwise(1).alias("key"), F.col("id").cast("string").alias("text"))
    store.ingest(docs, blocks.withColumn("text", F.sha2("text", 512)))
    assert store.counts() == {"docs": 2, "blocks": 200_000}
    assert len(files(store, "blocks")) > 2


def test_templates_seeded_twice(spark):
    store = Store(spark, catalog.shared_folder(spark), TEMPLATES, buckets=4)
    methodologies = spark.createDataFrame([("PIK v5.0", "5.0")], "title string, version string")
    frames = spark.createDataFrame([("PIK v5.0", "5.0", name, slug, i) for i, (slug, name, _) in enumerate(schema.FRAMES)], "title string, version string, name string, slug string, `order` int")
    listed = [(slug, name, f"{slug}-{'-'.join(name.lower().split())}", j) for slug, _, names in schema.FRAMES for j, name in enumerate(names)]
    fields = spark.createDataFrame([*listed, ("no-frame", "x", "no-frame-x", 0)], "frame string, name string, slug string, `order` int")
    for _ in range(2):
        store.seed(methodologies, frames, fields)
        assert store.counts() == {"methodologies": 1, "frames": 5, "fields": 51}
    seen = store.read("fields").join(store.read("frames").select(F.col("id").alias("frameId"), F.col("slug").alias("frame")), "frameId")
    assert sorted((r["frame"], r["name"], r["slug"], r["order"]) for r in seen.collect()) == sorted(listed)
    assert store.read("fields").where("slug = 'platform-experience-key-expectations'").count() == 1
    with pytest.raises(ValueError, match="slug"):
        store.insert_if_absent("frames", frames, ["name"])


def test_levels_as_functions(spark):
    """The same without a folder: new parents' ids reach their children, old ones stay."""
    parents = spark.createDataFrame([(7, "a")], "id long, name string")
    children = spark.createDataFrame([(3, 7, "x")], "id long, parent long, name string")
    for _ in range(2):
        parents = catalog.seed(None, parents, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"), ["name"])
        new = spark.createDataFrame([("b", "y"), ("a", "x"), ("c", "z"), (None, "n")], "of string, name string")
        children = catalog.seed(parents.withColumnRenamed("name", "of"), children, new, ["name"], "of", "parent")
    assert sorted(tuple(r) for r in parents.collect()) == [(7, "a"), (8, "b")]
    assert sorted(tuple(r) for r in children.collect()) == [(3, 7, "x"), (4, 8, "y")]


def test_structured_texts_and_pages(spark):
    """A text that is no string and a page that is no number count for nothing."""
    from pagegrain.sources import files as f

    elements = '[{"text":5,"page":"3"},{"text":5,"Text":"t","page":null,"Page":2},{"text":"a","Text":"b","page":1,"Page":2},{"text":{"x":1},"page":true},{"text":"","page":2.0},{"Text":"","page":1e30}]'
    got = f.structured(spark.createDataFrame([(f'{{"content":{elements}}}',)], "json string")).orderBy("pos").collect()
    assert [(r["text"], r["page"]) for r in got] == [(None, 0), ("t", 2), ("a", 1), (None, 0), ("", 2), ("", 0)]


def test_engines_and_transforms_are_stored_as_given(spark):
    json = '{"scaleX":1,"scaleY":2,"offsetX":0,"offsetY":0,"rotation":0,"flipY":false}'
    given = [(1, "Adobe", json), (2, "", ""), (3, "My-Engine", "{oops"), (4, None, None), (5, "UNSTRUCTURED", "{}")]
    df = spark.createDataFrame([(k, "a.pdf", "/x", e, "", "0", t, 1) for k, e, t in given], "key long, name string, path string, engine string, profile string, score string, canvasTransform string, pages int")
    got = {r["key"]: r for r in normalize.source_docs(df).collect()}
    assert [got[k]["engine"] for k in range(1, 6)] == ["adobe", "unstructured", "my-engine", "unstructured", "unstructured"]
    assert tuple(got[1]["canvasTransform"]) == (1.0, 2.0, 0.0, 0.0, 0.0, False)
    assert all(got[k]["canvasTransform"] is None for k in range(2, 6))
