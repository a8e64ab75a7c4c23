"""Queries over stored tables, indexes, archives and templates as tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import geometry, text
from ..operators import assign, catalog, containment, normalize, regions, report, textindex
from ..sources import adapters, binary, files
from ..sources.store import TEMPLATES, Store
from .queries import ASSIGN, LINES, NORM, SNIPPET, TEMPLATE, doc_blocks, query, read, turn_blocks


def uploaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as uploads with transforms of their own, and their turns as blocks, both by key."""
    k = F.col("key")
    pages = normalize.observed_pages(turn_blocks(spark, sf_dir)).select(F.col("sourceDocId").alias("key"), "pages")
    transform = F.concat(F.lit('{"scaleX":'), k.cast("string"), F.lit(',"scaleY":2,"offsetX":0,"offsetY":0.5,"rotation":0,"flipY":true}'))
    uploads = pages.select(
        "key", F.concat(F.lit("doc-"), k.cast("string"), F.when(k % 2 == 0, ".PDF").otherwise(".png")).alias("name"), F.lit("/x").alias("path"),
        F.when(k % 3 == 0, "Adobe").when(k % 3 == 1, "Own-OCR").otherwise("").alias("engine"), F.when(k % 4 == 0, "own").otherwise("").alias("profile"),
        (k % 5).cast("string").alias("score"), F.when(k % 2 == 0, transform).when(k % 7 == 0, "{broken").otherwise("").alias("canvasTransform"), "pages",
    )
    turns = read(spark, sf_dir, "conversations").withColumns({"page": F.col("turn").cast("int"), "bbox": F.expr("array(0D, 0D, 0D, 0D)"), "tableJson": F.lit(None).cast("string")})
    blocks = normalize.shaped_for_insert(turns, F.col("conv_id")).withColumnRenamed("sourceDocId", "key")
    return normalize.source_docs(uploads), blocks


def filled_store(spark: SparkSession, sf_dir: str, batches: int = 2) -> Store:
    """A new store into which all conversations went, some at a time."""
    store = Store(spark, catalog.shared_folder(spark), buckets=16)
    docs, blocks = uploaded(spark, sf_dir)
    for i in range(batches):
        store.ingest(docs.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i), blocks.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i))
    return store


STORED = """d AS (SELECT conv_id AS k, CAST(max(turn) + 1 AS INTEGER) AS pages, count(*) AS blocks FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {STORED} SELECT 'doc-' || k AS title, CASE WHEN k % 2 = 0 THEN 'pdf' ELSE 'png' END AS type, CASE k % 3 WHEN 0 THEN 'adobe' WHEN 1 THEN 'own-ocr' ELSE 'unstructured' END AS engine,
CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS scale, pages, blocks, CAST(0 AS BIGINT) AS repeated FROM d""")
def stored_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uploads, in two ingests, read back: each document with its blocks, and how many ids of either kind are there twice."""
    store = filled_store(spark, sf_dir)
    docs, blocks = store.read("docs"), store.read("blocks")
    repeated = catalog.duplicate_keys(docs, ["id"]).count() + catalog.duplicate_keys(blocks, ["id"]).count()
    counts = blocks.groupBy(F.col("sourceDocId").alias("id")).agg(F.count("*").alias("blocks"))
    return docs.join(counts, "id", "left").select("title", "type", "engine", F.col("canvasTransform.scaleX").alias("scale"), "pages", "blocks", F.lit(repeated).cast("long").alias("repeated"))


@query(f"""WITH {STORED} SELECT 'doc-' || k AS title, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'P' || k WHEN k % 4 = 0 THEN 'own' ELSE 'PIK_BusinessModel_v5' END AS profile,
CASE WHEN k % 3 = 0 THEN 9.0 WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS scale, CASE WHEN k % 3 = 0 THEN 0.25 WHEN k % 5 > 0 THEN CAST(k % 5 AS DOUBLE) END AS score FROM d""")
def stored_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document patched in place; an empty profile changes none."""
    store = filled_store(spark, sf_dir)
    k = F.substring_index("title", "-", -1).cast("long")
    transform = F.struct(F.lit(9.0).alias("scaleX"), F.lit(9.0).alias("scaleY"), *(F.lit(0.0).alias(c) for c in ("offsetX", "offsetY", "rotation")), F.lit(False).alias("flipY"))
    patch = store.read("docs").where(k % 3 == 0).select("id", transform.alias("transform"), F.when(k % 2 == 0, F.concat(F.lit("P"), k.cast("string"))).otherwise("").alias("profile"), F.lit(0.25).alias("score"))
    store.patch_canvas(patch)
    return store.read("docs").select("title", F.col("canvasProfileId").alias("profile"), F.col("canvasTransform.scaleX").alias("scale"), F.col("canvasMatchScore").alias("score"))


@query(f"""WITH {STORED} SELECT 'doc-' || k AS title, blocks FROM d WHERE k % 4 <> 1 UNION ALL SELECT 'all', CAST(coalesce(sum(blocks), 0) AS BIGINT) FROM d WHERE k % 4 <> 1""")
def stored_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when every fourth document has been deleted with its blocks; all blocks by the list of files."""
    store = filled_store(spark, sf_dir)
    store.delete(store.read("docs").where(F.substring_index("title", "-", -1).cast("long") % 4 == 1).select("id"))
    counts = store.read("blocks").groupBy(F.col("sourceDocId").alias("id")).agg(F.count("*").alias("blocks"))
    left = store.read("docs").join(counts, "id", "full").select("title", "blocks")
    return left.union(spark.range(1).select(F.lit("all"), F.lit(store.counts()["blocks"]).cast("long")))


@query("""SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS docs, (SELECT count(*) FROM conversations) AS blocks, 0::BIGINT AS left_, (SELECT count(DISTINCT conv_id) + 1 FROM conversations) AS next_id""")
def stored_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a reset, what is left, and the least id of an ingest after it."""
    store = filled_store(spark, sf_dir, batches=1)
    counts = store.reset()
    left = store.read("docs").select("id").union(store.read("blocks").select("id")).count()
    store.ingest(*uploaded(spark, sf_dir))
    return store.read("docs").agg(*(F.lit(counts[c]).cast("long").alias(c) for c in ("docs", "blocks")), F.lit(left).cast("long").alias("left_"), F.min("id").alias("next_id"))


@query("""WITH f AS (SELECT c_nationkey, c_name, c_mktsegment FROM customer) SELECT r_name AS methodology, n_name AS frame, count(*) AS fields, count(DISTINCT c_mktsegment) AS kinds, count(*) AS ids
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN f ON c_nationkey = n_nationkey GROUP BY ALL""")
def stored_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as methodologies, frames and fields, seeded twice and a third time with other names: by ids from level to level."""
    store = Store(spark, catalog.shared_folder(spark), TEMPLATES, buckets=4)
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    methodologies = region.select(F.col("r_name").alias("title"), F.lit("5.0").alias("version"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    frames = named.select(F.col("r_name").alias("title"), F.lit("5.0").alias("version"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.col("n_nationkey").alias("order"))
    own = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    fields = own.select(F.lower("n_name").alias("frame"), F.col("c_name").alias("name"), F.concat_ws("-", F.lower("n_name"), "c_name").alias("slug"), F.col("c_mktsegment").alias("description"))
    store.seed(methodologies, frames, fields)
    store.seed(methodologies, frames, fields)
    store.seed(methodologies, frames.withColumn("name", F.lit("another")), fields.withColumn("description", F.lit("another")))
    m, f, x = (store.read(t) for t in ("methodologies", "frames", "fields"))
    joined = x.join(f.select(F.col("id").alias("frameId"), "methodologyId", F.col("name").alias("frame")), "frameId").join(m.select(F.col("id").alias("methodologyId"), F.col("title").alias("methodology")), "methodologyId")
    return joined.groupBy("methodology", "frame").agg(F.count("*").alias("fields"), F.countDistinct("description").alias("kinds"), F.countDistinct("id").alias("ids"))


def indexed(spark: SparkSession, sf_dir: str) -> textindex.Index:
    path = catalog.shared_folder(spark)
    textindex.build(doc_blocks(spark, sf_dir), path, slots=16, parts=16)
    return textindex.Index(spark, path, slots=16)


@query(f"""WITH {LINES} SELECT id, src AS "docId", page, role, {SNIPPET} AS snippet FROM blocks WHERE contains(lower(text), 'ción')""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks with a text, by the trigrams in it."""
    return indexed(spark, sf_dir).search(" CIÓN ", limit=None)


@query(f"""WITH {LINES} SELECT 'top' AS kind, id, {SNIPPET} AS snippet FROM (SELECT * FROM blocks WHERE contains(lower(text), 'the') ORDER BY id LIMIT 20)
UNION ALL SELECT 'short', id, {SNIPPET} FROM blocks WHERE contains(lower(text), 'x7') UNION ALL SELECT 'one', id, {SNIPPET} FROM blocks WHERE contains(lower(text), 'ß')""")
def search_indexed_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 of a text that very many have, and all with two characters or one."""
    index = indexed(spark, sf_dir)
    parts = [index.search(q, n).select(F.lit(kind).alias("kind"), "id", "snippet") for kind, q, n in (("top", "The", 20), ("short", "X7", None), ("one", "ß", None))]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {LINES}, n AS (SELECT row_number() OVER (ORDER BY w) AS field, w FROM (SELECT DISTINCT list_sort(list_distinct(list_filter(string_split({NORM}, ' '), lambda w: w <> ''))) AS w
  FROM (SELECT p_partkey, p_name AS text FROM part UNION ALL SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 2, 1 + doc_id % 3), ' ') FROM documents)) WHERE len(w) > 0),
b AS (SELECT id, list_distinct(string_split({NORM}, ' ')) AS w FROM blocks WHERE text IS NOT NULL), bw AS (SELECT id, unnest(w) AS x FROM b), fw AS (SELECT field, w, unnest(w) AS x FROM n)
SELECT id, array_to_string(w, ' ') AS field FROM bw JOIN fw USING (x) GROUP BY id, field, w HAVING count(*) = len(w)""")
def contained_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and starts of documents as fields: each block with the fields of which it has all words."""
    parts = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    starts = read(spark, sf_dir, "documents").select(F.array_join(F.slice(F.split("text", " "), F.lit(2), (F.col("doc_id") % 3).cast("int")), " ").alias("name"))
    sorted_words = F.array_sort(F.array_distinct(text.words(text.normalize(F.col("name")))))
    fields = parts.union(starts).select(F.array_join(sorted_words, " ").alias("field")).distinct()
    blocks = doc_blocks(spark, sf_dir).select("id", text.words(text.normalize(F.col("text"))).alias("words"))
    return containment.contained(blocks, containment.field_words(fields, id_="field"))


@query(f"SELECT \"docId\", field, value, ids FROM ({ASSIGN}) WHERE ids <> ''")
def assigned_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignments that auto_assign finds, with the fields as a table that meets blocks by equal words."""
    names = spark.createDataFrame([(i, f) for i, (_, _, f) in enumerate(TEMPLATE)], "pos int, field string")
    found = assign.assign_fields(doc_blocks(spark, sf_dir), names)
    return found.join(names, "pos").select("docId", "field", "value", F.array_join(F.transform("evidence", lambda x: x["blockId"].cast("string")), ",").alias("ids"))


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive around each JSON, with another entry before it; those with ``kind`` 1 are cut short, those with 2 lack the JSON."""
    for batch in batches:
        paths, contents = [], []
        for row in batch.to_pylist():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("figures/a.bin", bytes(2000))
                if row["kind"] != 2:
                    z.writestr("out/StructuredData.json", row["json"])
            paths.append(row["path"])
            contents.append(out.getvalue()[: 200 if row["kind"] == 1 else None])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


@query("""SELECT page_id, CASE WHEN page_id % 7 = 3 THEN 'broken' WHEN page_id % 7 = 5 THEN 'no such entry' ELSE 'ok' END AS state,
CASE WHEN page_id % 7 NOT IN (3, 5) THEN page_id % 4 END AS page, CASE WHEN page_id % 7 NOT IN (3, 5) THEN url END AS text FROM pages""")
def zipped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each page, written from executors, listed and read back: blocks of those that are whole, reasons for the others."""
    n = F.col("page_id")
    kind = F.when(n % 7 == 3, 1).when(n % 7 == 5, 2).otherwise(0)
    element = F.struct((n % 4).alias("Page"), F.col("url").alias("text"), F.lit("P").alias("type"))
    made = read(spark, sf_dir, "pages").select(F.format_string("d%d/%d.zip", n % 10, n).alias("path"), F.to_json(F.struct(F.array(element).alias("elements"))).alias("json"), kind.alias("kind"))
    folder = catalog.shared_folder(spark)
    binary.write_files(made.mapInArrow(zipped, "path string, content binary"), folder)
    found = binary.unzipped(files.listing(spark, folder, "*.zip")).withColumn("page_id", F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("long"))
    blocks = files.structured(found.where("json is not null").select("page_id", "json")).select("page_id", F.lit("ok").alias("state"), F.col("page").cast("long").alias("page"), "text")
    lost = found.where("json is null").select("page_id", F.when(F.col("reason").startswith("broken"), "broken").otherwise(F.col("reason")), F.lit(None).cast("long"), F.lit(None).cast("string"))
    return blocks.union(lost)


@query("""SELECT page_id, 'u' || page_id % 5 AS unit, CAST(octet_length(encode(url)) AS BIGINT) AS png_bytes, CASE WHEN page_id % 3 > 0 THEN sha1(url) END AS png_sha1, url AS text FROM pages WHERE page_id % 3 > 0
UNION ALL SELECT page_id, 'u' || page_id % 5, NULL, NULL, url FROM pages WHERE page_id % 3 = 0""")
def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of each page as JSON and, for two in three, its image beside it, read back byte for byte."""
    n = F.col("page_id")
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("x", 1), ("y", 2), ("w", 3), ("h", 4))))
    image = F.when(n % 3 > 0, F.base64(F.col("url").cast("binary")))
    regions = read(spark, sf_dir, "pages").select(F.format_string("u%d", n % 5).alias("unit"), n.alias("region"), box.alias("bbox"), F.col("url").alias("text"), image.alias("image_b64"))
    folder = catalog.shared_folder(spark)
    binary.write_files(binary.region_files(regions), folder)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    whole = whole.select(F.regexp_extract("path", r"/(u\d)/region-\d+\.", 1).alias("unit"), F.regexp_extract("path", r"region-(\d+)\.", 1).cast("long").alias("page_id"), F.col("path").endswith(".png").alias("png"), "content")
    read_ = whole.where("not png").select("page_id", "unit", F.from_json(F.col("content").cast("string"), "text string, image_b64 string").alias("j"))
    images = whole.where("png").select("page_id", F.octet_length("content").cast("long").alias("png_bytes"), F.sha1("content").alias("png_sha1"))
    return read_.join(images, "page_id", "left").select("page_id", "unit", "png_bytes", "png_sha1", F.col("j.text").alias("text"))


@query("""WITH p AS (SELECT vec_id, i, label % 4 AS profile, CAST(embedding[2 * i + 1] AS DOUBLE) * 500 + 500 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 700 + 500 AS y FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding) // 2)) AS i)),
z AS (SELECT p_partkey % 4 AS profile, p_partkey AS pos, 'z' || p_partkey AS zone, CAST(p_partkey * 37 % 1000 AS DOUBLE) AS a, CAST(p_partkey * 91 % 1000 AS DOUBLE) AS b, CAST(p_size AS DOUBLE) AS s FROM part)
SELECT zone, count(*) AS n FROM (SELECT vec_id, i, (SELECT zone FROM z WHERE z.profile = p.profile AND x > a AND x < a + s AND y > b AND y < b + s ORDER BY pos LIMIT 1) AS zone FROM p) GROUP BY zone""")
def points_in_zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of vectors in zones made of parts, four profiles of them: the first zone of each point."""
    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("profile"), "embedding")
    pairs = F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1)
    points = e.select("profile", F.explode(F.transform(pairs, lambda i: F.struct(*(F.get("embedding", 2 * i + k).cast("double").alias(c) for k, c in ((0, "x"), (1, "y")))))).alias("p"))
    points = points.select("profile", (F.col("p.x") * 500 + 500).alias("x"), (F.col("p.y") * 700 + 500).alias("y"))
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    a, b = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")
    square = F.array(F.array(a, b), F.array(a + size, b), F.array(a + size, b + size), F.array(a, b + size))
    zones = read(spark, sf_dir, "part").select((k % 4).cast("int").alias("profile"), k.alias("pos"), F.concat(F.lit("z"), k.cast("string")).alias("zone"), square.alias("polygon"))
    return regions.in_zones(points, zones, cell=50.0).groupBy("zone").agg(F.count("*").alias("n"))


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of all pages as files: u<n>/in/<id>.html or .PNG, two levels deep."""
    n = F.col("page_id")
    name = F.format_string("u%d/in/%d.%s", n % 4, n, F.when(n % 2 == 0, "html").otherwise("PNG"))
    folder = catalog.shared_folder(spark)
    binary.write_files(read(spark, sf_dir, "pages").select(name.alias("path"), F.col("html").cast("binary").alias("content")), folder)
    return folder


@query("""SELECT page_id || '.PNG' AS name, '.png' AS ext, CAST(strlen(html) AS BIGINT) AS length, 'u' || page_id % 4 AS unit, CAST(CASE WHEN length(html) = 0 THEN 'empty file' END AS VARCHAR) AS rejected FROM pages WHERE page_id % 2 = 1""")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder, however deep, by a pattern, with what admission says."""
    found = files.uploads(files.listing(spark, page_files(spark, sf_dir), "*.PNG"))
    return found.select("name", "ext", "length", F.element_at(F.split("path", "/"), -3).alias("unit"), "rejected")


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS length, sha1(html) AS sha1 FROM pages")
def files_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's file, read back byte for byte."""
    found = files.whole(spark, f"{page_files(spark, sf_dir)}/*/in/*")
    return found.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("page_id"), "length", F.sha1("content").alias("sha1"))


@query("""WITH n AS (SELECT doc_id, lang || '.' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' ELSE '' END AS name, lang || CASE WHEN doc_id % 3 < 2 THEN '.' || doc_id ELSE '' END AS title FROM documents),
b AS (SELECT * FROM (VALUES (0, 1, 'heading', '10,10,580,60'), (1, 1, 'paragraph', '10,80,580,140'), (2, 1, 'list', '10,150,580,220'), (3, 2, 'table', '10,20,560,300'), (4, 2, 'paragraph', '10,320,560,380')) v(pos, page, role, bbox))
SELECT name, pos, page, role, bbox, CASE pos WHEN 0 THEN title WHEN 1 THEN 'Mock paragraph derived from ' || name WHEN 2 THEN '• item one; • item two; • item three' WHEN 4 THEN 'Second page content (mock).' END AS text,
CASE WHEN pos = 3 THEN '{"rows":2,"cols":2,"data":[["A","B"],["C","D"]]}' END AS "tableJson" FROM n, b""")
def mocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of an offline ingest, for a file named after each document."""
    k = F.col("doc_id") % 3
    names = read(spark, sf_dir, "documents").select(F.concat("lang", F.lit("."), F.col("doc_id").cast("string"), F.when(k == 0, ".pdf").when(k == 1, ".PNG").otherwise("")).alias("name"))
    return adapters.mock_blocks(names).withColumn("bbox", F.array_join(F.transform("bbox", text.number_text), ","))


@query("""SELECT '/img/' || page_id || '.png' AS image, 'second' AS run FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT '/img/' || page_id || '.png', 'all' FROM pages""")
def manifest_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that is written over, and one that is written in two parts, read back."""
    images = read(spark, sf_dir, "pages").select("page_id", F.format_string("/img/%d.png", "page_id").alias("image"))
    even, odd = images.where("page_id % 2 = 0"), images.where("page_id % 2 = 1")
    over, grown = catalog.shared_folder(spark), catalog.shared_folder(spark)
    files.write_manifest(odd, over, "overwrite")
    files.write_manifest(even, over, "overwrite")
    files.write_manifest(odd, grown)
    files.write_manifest(even, grown)
    return files.manifest(spark, over).withColumn("run", F.lit("second")).union(files.manifest(spark, grown).withColumn("run", F.lit("all")))


@query(f"""WITH {LINES}, n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM blocks) AS b),
r AS (SELECT string_agg('| ' || doc_id || ' | doc-' || doc_id || ' | ' || k || ' |' || chr(10), '' ORDER BY doc_id DESC) AS r FROM (SELECT doc_id, (SELECT count(*) FROM blocks WHERE src = doc_id) AS k FROM documents ORDER BY doc_id DESC LIMIT 6)),
o AS (SELECT string_agg('| ' || role || ' | ' || k || ' |' || chr(10), '' ORDER BY k DESC, role) AS o FROM (SELECT role, count(*) AS k FROM blocks GROUP BY role ORDER BY k DESC, role LIMIT 10))
SELECT '# Ingest report' || chr(10) || chr(10) || '- Documents: ' || d || chr(10) || '- Blocks: ' || b || chr(10) || '- Blocks a document: ' || printf('%.2f', b / d) || chr(10) || chr(10) || '| id | title | blocks |' || chr(10) || '|---|---|---|' || chr(10)
  || r || chr(10) || '| role | blocks |' || chr(10) || '|---|---|' || chr(10) || o AS markdown FROM n, r, o""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all documents as Markdown, written as a file and read back."""
    docs, blocks = adapters.docs_from_documents(read(spark, sf_dir, "documents")), doc_blocks(spark, sf_dir)
    n = report.corpus_counts(docs, blocks).first()
    made = report.markdown(n["docs"], n["blocks"], report.recent(docs, blocks).orderBy(F.desc("id")).collect(), report.top_roles(blocks).collect())
    folder = catalog.shared_folder(spark)
    binary.write_files(spark.createDataFrame([("report.md", made.encode())], "path string, content binary"), folder)
    return files.whole(spark, f"{folder}/report.md").select(F.col("content").cast("string").alias("markdown"))


@query("""WITH p AS (SELECT page_id, CAST(page_id % 300 + 100 AS DOUBLE) AS w, CAST(length(html) AS DOUBLE) AS h FROM pages), k AS (SELECT *, least(1000.0::DOUBLE / w, 1400.0::DOUBLE / h) AS k FROM p)
SELECT page_id, round(k, 9) AS scale, false AS flip, round(10.0 * k, 9) AS x0, round(20.0 * k, 9) AS y0, round(w * k, 9) AS x1, round(h * k, 9) AS y1, printf('%.1f', floor(page_id / 300.0 * 1000 + 0.5) / 10) || '%' AS share FROM k""")
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images fitted into the canvas: their boxes aren't flipped. Shares have one decimal."""
    pages = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 300 + 100).cast("double").alias("w"), F.length("html").cast("double").alias("h"))
    t = geometry.fit(F.col("w"), F.col("h"), *schema.CANVAS, image=True)
    box = geometry.apply_transform(F.array(F.lit(10.0), F.lit(20.0), F.col("w"), F.col("h")), t, F.col("h"))
    corners = [F.round(F.get("b", i), 9).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    out = pages.select("page_id", t.alias("t"), box.alias("b"))
    return out.select("page_id", F.round("t.scaleX", 9).alias("scale"), F.col("t.flipY").alias("flip"), *corners, text.percent(F.col("page_id") / 300.0, 1).alias("share"))
