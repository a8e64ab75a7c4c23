import random

import pytest
from pyspark.sql import functions as F

from pagegrain.operators import catalog, search, textindex
from pagegrain.plans.queries import doc_blocks
from pagegrain.sources import adapters

SCHEMA = "id long, sourceDocId long, page int, role string, text string"


def made(spark, texts):
    return spark.createDataFrame([(i, i // 7, i % 3, "paragraph", t) for i, t in enumerate(texts)], SCHEMA)


def bytes_read(df):
    """Sizes of the files that a query's scans have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("filesSize"):
            scans.append(metrics.apply("filesSize").value())
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(scans)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    bits = ["a", "B", "ab", "abc", " ", "\n", "é", "É", "İ", "ß", "😀", "Σ", "ς", "x", "\0", "%", "_", "the "]
    blocks = made(spark, [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500))]).cache()
    path = catalog.shared_folder(spark)
    textindex.build(blocks, path, slots=8, parts=8)
    return blocks, textindex.Index(spark, path, slots=8)


@pytest.mark.parametrize("q", ["abc", "aB", "a", "é", "É", "İ", "the the", "😀", "x😀É", "ababab", "Σ", "aς", "%_", "\0a", " a b ", "", "   ", None, "not there", "zzz", "z", "B\nx", "abcabcabcabc"])
def test_same_rows_as_a_scan(corpus, q):
    blocks, index = corpus
    for limit in (None, 5):
        expected = [tuple(r) for r in search.search(blocks, q, limit).collect()]
        assert [tuple(r) for r in index.search(q, limit).orderBy("id").collect()] == sorted(expected)


def test_rare_queries_read_little(spark):
    """Under a tenth of what the texts take."""
    lines = spark.range(60_000).select(F.col("id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2((-F.col("id")).cast("string"), 256)).alias("text"))
    blocks = lines.select("id", F.floor(F.col("id") / 100).alias("sourceDocId"), F.lit(0).alias("page"), F.lit("p").alias("role"), F.when(F.col("id") == 41_234, F.concat("text", F.lit(" quiXotic Zebra"))).otherwise(F.col("text")).alias("text"))
    path = catalog.shared_folder(spark)
    textindex.build(blocks, path, slots=32, parts=32)
    texts = sum(r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/blocks").select("length").collect())
    found = textindex.Index(spark, path, slots=32).search("ixotic z", limit=None)
    assert [r["id"] for r in found.collect()] == [41_234]
    assert bytes_read(found) * 10 < texts


def test_hot_trigrams_and_documents_are_several_files(spark):
    blocks = spark.range(4000).select("id", F.lit(1).alias("sourceDocId"), F.lit(0).alias("page"), F.lit("p").alias("role"), F.lit("the same").alias("text"))
    blocks = blocks.withColumn("id", F.col("id") * 700)
    path = catalog.shared_folder(spark)
    textindex.build(blocks, path, slots=2, parts=8)
    index = textindex.Index(spark, path, slots=2)
    assert index.search("the", limit=None).count() == 4000
    assert len(spark.read.parquet(f"{path}/blocks").inputFiles()) > 4


def test_empty_table_and_given_documents(spark, sf_dir):
    empty = made(spark, ["a"]).limit(0)
    path = catalog.shared_folder(spark)
    textindex.build(empty, path)
    assert textindex.Index(spark, path).search("abc").count() == 0
    blocks = doc_blocks(spark, sf_dir)
    path = catalog.shared_folder(spark)
    textindex.build(blocks, path, slots=8, parts=8)
    index = textindex.Index(spark, path, slots=8)
    texts = [r["text"] for r in blocks.where("length(text) > 40").select("text").limit(3).collect()]
    for q in [t[5:30] for t in texts] + ["e", "qx"]:
        assert [tuple(r) for r in index.search(q, None).orderBy("id").collect()] == [tuple(r) for r in search.search(blocks, q, None).orderBy("id").collect()]
    assert adapters.LINES > textindex.NEAR


def test_postings_are_fewer_than_characters(spark):
    """A span gives a trigram once, however many of its blocks have it."""
    blocks = spark.range(20_000).select("id", F.lit(1).alias("sourceDocId"), F.lit(0).alias("page"), F.lit("p").alias("role"), F.concat(F.lit("some words that all have and "), F.col("id").cast("string")).alias("text"))
    path = catalog.shared_folder(spark)
    textindex.build(blocks, path, slots=4, parts=4)
    assert spark.read.parquet(f"{path}/grams").count() * 10 < blocks.selectExpr("sum(length(text))").first()[0]
    assert [r["id"] for r in textindex.Index(spark, path, slots=4).search("ND 12345", limit=None).collect()] == [12345]


def test_texts_over_a_megabyte(spark):
    long = "aB" * 800_000 + "the é end"
    blocks = made(spark, ["short é", long, "Xthe end", long + "z", "", None, "last the é end"]).repartition(1)
    path = catalog.shared_folder(spark)
    textindex.build(blocks, path, slots=2, parts=2)
    for q in ("the é", "BAB", "é", "dz", "absent"):
        assert sorted(r["id"] for r in textindex.Index(spark, path, slots=2).search(q, limit=None).collect()) == sorted(r["id"] for r in search.search(blocks, q, None).collect())
