"""Each query with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, streaming
from ..functions import geometry, text
from ..operators import assign, catalog, normalize, regions, report, search
from ..sources import adapters, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.blocks_from_documents(read(spark, sf_dir, "documents"))


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.blocks_from_conversations(read(spark, sf_dir, "conversations"))


LINES = r"""
lines AS (SELECT doc_id, u.pos - 1 AS pos, u.line AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos) u),
typed AS (SELECT *, CASE WHEN pos = 0 THEN 'Title' WHEN pos % 7 = 3 THEN 'ListItem' WHEN pos % 11 = 5 THEN 'Table' ELSE 'NarrativeText' END AS type FROM lines),
blocks AS (SELECT doc_id * 4294967296 + pos AS id, doc_id AS src, CAST(pos // 10 AS INTEGER) AS page, CAST(pos % 10 * 10 AS INTEGER) AS y,
  CASE type WHEN 'Title' THEN 'heading' WHEN 'ListItem' THEN 'list' WHEN 'Table' THEN 'table' ELSE 'paragraph' END AS role,
  CASE WHEN type = 'Table' THEN NULL ELSE line END AS text FROM typed)"""
TURNS = """
blocks AS (SELECT conv_id * 4294967296 + turn AS id, conv_id AS src, CAST(turn AS INTEGER) AS page, role, text FROM conversations)"""
REPORT = r"""
per AS (SELECT src, count(*) AS total, count(*) FILTER (role = 'table') AS tables, count(*) FILTER (text IS NULL OR regexp_full_match(text, '\s*')) AS empty, sum(coalesce(length(text), 0)) AS chars, greatest(max(page), 0) AS top, list(DISTINCT page) AS seen FROM blocks GROUP BY src),
roles AS (SELECT src, string_agg(role || ':' || n, ', ' ORDER BY role) AS roles FROM (SELECT src, role, count(*) AS n FROM blocks GROUP BY src, role) GROUP BY src),
known AS (SELECT *, CAST(CASE WHEN {known} > 0 THEN {known} ELSE top + 1 END AS INTEGER) AS pages FROM per JOIN roles USING (src)),
gaps AS (SELECT *, list_sort(list_filter(range(0, pages), lambda p: NOT list_contains(seen, p))) AS gap FROM known)
SELECT src AS "docId", total AS "totalBlocks", roles AS "byRole", tables AS "tablesCount", empty AS "emptyTextBlocks", pages, array_to_string(gap, ',') AS "emptyPages", CASE WHEN pages > 0 THEN len(gap) / pages ELSE 0.0 END AS "emptyPagesShare", CAST(floor(chars / total + 0.5) AS BIGINT) AS "avgBlockLen" FROM gaps"""


def flat_report(df: DataFrame) -> DataFrame:
    return df.withColumn("byRole", report.role_list()).withColumn("emptyPages", F.array_join(F.array_sort("emptyPages"), ","))


@query(f"WITH {LINES}, {REPORT.format(known='NULL')}")
def doc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.docs_from_documents(read(spark, sf_dir, "documents"))
    return flat_report(report.report(docs, doc_blocks(spark, sf_dir)))


@query(f"WITH {TURNS}, {REPORT.format(known='(top + 2)')}")
def conv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.docs_from_conversations(read(spark, sf_dir, "conversations")).withColumn("pages", F.col("pages") + 1)
    return flat_report(report.report(docs, turn_blocks(spark, sf_dir)))


def gapped(blocks: DataFrame) -> DataFrame:
    """All blocks, those of every third page from 1 on moved to the page before."""
    return blocks.withColumn("page", F.col("page") - (F.col("page") % 3 == 1).cast("int"))


@query(f"""WITH {TURNS}, odd AS (SELECT * FROM blocks WHERE page % 3 <> 1), top AS (SELECT src, max(page) AS top, list(page) AS seen FROM odd GROUP BY src)
SELECT src AS "docId", CAST(p AS INTEGER) AS page FROM (SELECT src, unnest(list_filter(range(0, top + 1), lambda x: NOT list_contains(seen, x))) AS p FROM top)""")
def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.docs_from_conversations(read(spark, sf_dir, "conversations")).withColumn("pages", F.lit(0))
    return report.report(docs, gapped(turn_blocks(spark, sf_dir))).select("docId", F.explode("emptyPages").alias("page"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role ORDER BY n DESC, role LIMIT 10")
def role_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_roles(turn_blocks(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id AS id, 'doc-' || doc_id AS title, (SELECT count(*) FROM blocks WHERE src = doc_id) AS blocks FROM documents ORDER BY doc_id DESC LIMIT 6")
def recent_docs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.docs_from_documents(read(spark, sf_dir, "documents"))
    return report.recent(docs, doc_blocks(spark, sf_dir)).select("id", "title", "blocks")


@query(f"""WITH {LINES} SELECT d.docs, b.blocks, printf('%.2f', floor(b.blocks / d.docs * 100 + 0.5) / 100) AS "avgBlocks" FROM (SELECT count(*) AS docs FROM documents) d, (SELECT count(*) AS blocks FROM blocks) b""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.corpus_counts(read(spark, sf_dir, "documents"), doc_blocks(spark, sf_dir))


SNIPPET = "CASE WHEN length(text) > 200 THEN substring(text, 1, 197) || '…' ELSE text END"


@query(f"""WITH {LINES} SELECT id, src AS "docId", page, role, {SNIPPET} AS snippet FROM blocks WHERE contains(lower(text), 'the') ORDER BY id LIMIT 20""")
def search_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(doc_blocks(spark, sf_dir), " The ")


@query(f"""WITH {LINES} SELECT id, src AS "docId", page, role, {SNIPPET} AS snippet FROM blocks WHERE contains(lower(text), 'ción')""")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(doc_blocks(spark, sf_dir), "CIÓN", limit=None)


@query("""WITH c AS (SELECT conv_id AS id FROM conversations UNION SELECT -1),
b AS (SELECT conv_id AS id, count(*) AS n, bool_or(lower(role) = 'table') AS t, CAST(min(turn) AS INTEGER) AS f, CAST(max(turn) AS INTEGER) AS l, string_agg(turn || ':' || role, ',' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)
SELECT c.id, coalesce(n, 0) AS "blockCount", coalesce(t, false) AS "hasTables", f AS "firstPageWithContent", l AS "lastPage", coalesce(s, '') AS blocks FROM c LEFT JOIN b USING (id)""")
def doc_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct().union(spark.range(-1, 0))
    out = report.doc_view(docs, turn_blocks(spark, sf_dir))
    return out.select("id", "blockCount", "hasTables", "firstPageWithContent", "lastPage", F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["page"], b["role"])), ",").alias("blocks"))


@query(f"""WITH {LINES}, {REPORT.format(known='NULL')} WHERE src IN (1, 7)""")
def compare_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.docs_from_documents(read(spark, sf_dir, "documents"))
    return flat_report(report.compare(report.report(docs, doc_blocks(spark, sf_dir)), 1, 7)).drop("side").where("totalBlocks is not null")


@query(f"""WITH {LINES} SELECT src AS "docId", page, string_agg(id, ',' ORDER BY id) AS ids FROM blocks GROUP BY src, page""")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_groups(doc_blocks(spark, sf_dir)).select(F.col("sourceDocId").alias("docId"), "page", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {LINES} SELECT id, CASE WHEN text IS NULL OR text = '' THEN '(no text)' WHEN length(text) > 150 THEN substring(text, 1, 147) || '…' ELSE text END AS snippet FROM blocks""")
def ui_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_blocks(spark, sf_dir).select("id", text.ui_snippet(F.col("text")).alias("snippet"))


NORM = r"trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"
TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
HEAD = f"""coalesce(text <> '' AND (lower(role) LIKE '%heading%' OR (length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 2 AND regexp_replace(text, '[^a-zA-Z]', '', 'g') = upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AND length({TRIM}) <= 80) OR (length({TRIM}) <= 60 AND regexp_matches({TRIM}, '^[A-Z]'))), false)"""


@query(f"WITH {LINES} SELECT id, {NORM} AS norm, CAST(len(list_filter(string_split({NORM}, ' '), lambda w: w <> '')) AS INTEGER) AS words FROM blocks")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalize(F.col("text"))
    return doc_blocks(spark, sf_dir).select("id", norm.alias("norm"), F.when(F.col("text").isNotNull(), F.size(text.words(norm))).alias("words"))


@query(f"WITH {LINES} SELECT id, {HEAD} AS head FROM blocks")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_blocks(spark, sf_dir).select("id", text.is_heading(F.col("role"), F.col("text")).alias("head"))


NEEDLES = ("the", "of and", "to in", "de la", "en", "absent word")


@query(f"""WITH {LINES}, n AS (SELECT unnest({list(NEEDLES)}) AS needle), w AS (SELECT id, string_split({NORM}, ' ') AS w FROM blocks WHERE text IS NOT NULL)
SELECT id, needle FROM w, n WHERE list_has_all(w, string_split(needle, ' '))""")
def word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = F.array(*(F.struct(F.lit(n).alias("needle"), F.array(*map(F.lit, n.split())).alias("words")) for n in NEEDLES))
    blocks = doc_blocks(spark, sf_dir).where("text is not null").select("id", text.words(text.normalize(F.col("text"))).alias("w"))
    return blocks.select("id", F.explode(F.filter(needles, lambda n: text.words_included(F.col("w"), n["words"]))).alias("n")).select("id", "n.needle")


TEMPLATE = tuple(("corpus", "Corpus", f) for f in ("The", "of and", "to in", "the and", "En", "de la", "absent word"))
ASSIGN = f"""WITH {LINES},
e AS (SELECT src, id, page, role, text, y AS y0, coalesce({NORM}, '') AS norm, {HEAD} AS head, text IS NULL OR regexp_full_match(text, '\\s*') AS blank, min(id) OVER (PARTITION BY src, page) AS rank FROM blocks),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY src, page ORDER BY y0, id) AS section FROM e),
f AS (SELECT *, sum((NOT head AND NOT blank)::INT) OVER (PARTITION BY src, page, section ORDER BY y0, id) AS nth FROM g),
fields AS (SELECT unnest({[f for _, _, f in TEMPLATE]}) AS field, unnest(range(0, {len(TEMPLATE)})) AS pos),
w AS (SELECT field, CAST(pos AS INTEGER) AS pos, string_split(lower(field), ' ') AS words FROM fields),
parts AS (SELECT src, page, section, string_agg({TRIM}, ' ' ORDER BY y0, id) AS value, string_agg(id, ',' ORDER BY y0, id) AS ids FROM f WHERE NOT head AND NOT blank AND nth <= 3 AND section > 0 GROUP BY src, page, section),
one AS (SELECT f.src, pos, coalesce(p.value, substring(f.text, 1, 120)) AS value, coalesce(p.ids, CAST(f.id AS VARCHAR)) AS ids, row_number() OVER (PARTITION BY f.src, pos ORDER BY f.rank, f.y0, f.id) AS k
  FROM f JOIN w ON f.head AND f.norm <> '' AND list_has_all(string_split(f.norm, ' '), w.words) LEFT JOIN parts p ON p.src = f.src AND p.page = f.page AND p.section = f.section),
two AS (SELECT src, pos, substring(text, 1, 160) AS value, CAST(id AS VARCHAR) AS ids, row_number() OVER (PARTITION BY src, pos ORDER BY id) AS k FROM e JOIN w ON norm <> '' AND list_has_all(string_split(norm, ' '), w.words)),
cells AS (SELECT src, w.field, w.pos FROM (SELECT DISTINCT src FROM blocks), w)
SELECT c.src AS "docId", c.field, coalesce(one.value, two.value) AS value, coalesce(one.ids, two.ids, '') AS ids FROM cells c LEFT JOIN one ON one.src = c.src AND one.pos = c.pos AND one.k = 1 LEFT JOIN two ON two.src = c.src AND two.pos = c.pos AND two.k = 1"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign.auto_assign(doc_blocks(spark, sf_dir), TEMPLATE)
    return out.select("docId", "field", "value", F.array_join(F.transform("evidence", lambda x: x["blockId"].cast("string")), ",").alias("ids"))


@query(f"SELECT \"docId\", field, value FROM ({ASSIGN})")
def auto_assign_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("docId", "field", "value")


@query(f"SELECT \"docId\", field, ids FROM ({ASSIGN})")
def auto_assign_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("docId", "field", "ids")


ROLE = "CASE WHEN contains(t, 'title') OR contains(t, 'heading') OR t = 'header' THEN 'heading' WHEN contains(t, 'list') THEN 'list' WHEN contains(t, 'table') THEN 'table' ELSE 'paragraph' END"


@query(f"SELECT type, {ROLE} AS role, count(*) AS n FROM (SELECT type, lower(type) AS t FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS type FROM pages)) GROUP BY ALL")
def map_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.elements_from_pages(read(spark, sf_dir, "pages")).groupBy("type", "role").agg(F.count("*").alias("n"))


HASH = "sha1(page || role || '[0,' || y || ',100,' || (y + 8) || ']' || coalesce(text, ''))"


@query(f"WITH {LINES} SELECT id, {HASH} AS hash FROM blocks")
def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.parse_bbox(F.col("bbox"))
    return doc_blocks(spark, sf_dir).select("id", normalize.block_hash(F.col("page"), F.col("role"), box, F.col("text")).alias("hash"))


@query(f"WITH {LINES} SELECT hash, count(*) AS n FROM (SELECT {HASH} AS hash FROM blocks) GROUP BY hash HAVING count(*) > 1")
def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_keys(block_hash(spark, sf_dir), ["hash"])


@query(r"""SELECT page_id, CASE WHEN size <= 0 THEN 'empty file' WHEN size > 31457280 THEN 'file too large' WHEN ext NOT IN ('.pdf', '.png') THEN 'unsupported type' END AS rejected
FROM (SELECT page_id, length(html) * (page_id % 5) * 2000 AS size, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.html' END AS ext FROM pages)""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    ext = F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".png").otherwise(".html")
    return pages.select("page_id", normalize.admission(F.concat(F.lit("f."), F.col("page_id").cast("string"), ext), F.length("html") * (F.col("page_id") % 5) * 2000).alias("rejected"))


@query(r"""SELECT page_id, TRY_CAST(regexp_extract(s, '^\s*([+-]?\d+)', 1) AS BIGINT) AS loose, CASE WHEN regexp_full_match(s, '\s*[+-]?\d+\s*') THEN TRY_CAST(trim(s) AS BIGINT) END AS strict
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id || 'abc' WHEN 1 THEN ' ' || page_id WHEN 2 THEN 'x' || page_id ELSE '-' || page_id END AS s FROM pages)""")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("page_id") % 4, F.col("page_id").cast("string")
    raw = F.when(n == 0, F.concat(s, F.lit("abc"))).when(n == 1, F.concat(F.lit(" "), s)).when(n == 2, F.concat(F.lit("x"), s)).otherwise(F.concat(F.lit("-"), s))
    return read(spark, sf_dir, "pages").select("page_id", text.parse_int(raw).alias("loose"), text.strict_int(raw).alias("strict"))


@query("SELECT page_id, 'p ' || page_id || '&' AS q, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("http://x/search?a=1&q=p%20"), F.col("page_id").cast("string"), F.lit("%26&b=2"))
    return read(spark, sf_dir, "pages").select("page_id", text.query_param(url, "q").alias("q"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def log_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.log_from_events(read(spark, sf_dir, "events"))
    return log.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN value < 0 THEN 'error' ELSE 'info' END AS level, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.log_from_events(read(spark, sf_dir, "events")).groupBy("level", "event").agg(F.count("*").alias("n"))


@query("SELECT event_id, len(json_keys(props)) AS keys, props ->> json_keys(props)[1] AS first FROM events WHERE props IS NOT NULL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    entries = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").where("props is not null").select("event_id", F.size(keys).cast("long").alias("keys"), F.try_element_at(entries, F.get(keys, 0)).alias("first"))


@query("""WITH new AS (SELECT * FROM (VALUES (2, 'OTHER'), (7, 'NORTH'), (7, 'NORTH'), (8, 'SOUTH')) v(k, n))
SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name FROM region UNION ALL SELECT DISTINCT k, n FROM new WHERE k NOT IN (SELECT r_regionkey FROM region)""")
def seed_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(2, "OTHER"), (7, "NORTH"), (7, "NORTH"), (8, "SOUTH")], "r_regionkey int, r_name string")
    return catalog.insert_if_absent(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), new, ["r_regionkey"])


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orphans(read(spark, sf_dir, "customer"), "c_nationkey", read(spark, sf_dir, "nation").where("n_regionkey <> 1"), "n_nationkey").select("c_custkey")


@query("""WITH gone AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT 'customer' AS child, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey <> 1""")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    gone = read(spark, sf_dir, "region").where("r_regionkey = 1")
    left = catalog.cascade(nation, "n_regionkey", gone, "r_regionkey")
    lost = nation.join(gone, nation["n_regionkey"] == gone["r_regionkey"], "left_semi")
    customers = catalog.cascade(read(spark, sf_dir, "customer"), "c_nationkey", lost, "n_nationkey")
    return customers.agg(F.lit("customer").alias("child"), F.count("*").alias("n")).union(left.agg(F.lit("nation"), F.count("*")))


@query("""WITH p AS (SELECT * FROM (VALUES (1, 2.0, 'P1', 0.5), (3, 3.0, '', NULL), (5, NULL, NULL, 0.9)) v(id, k, profile, score))
SELECT doc_id AS id, CASE WHEN p.id IS NOT NULL THEN CAST(p.k AS DOUBLE) ELSE 1.0 END AS scale, coalesce(nullif(p.profile, ''), lang) AS profile, coalesce(CAST(p.score AS DOUBLE), CAST(n_chars AS DOUBLE)) AS score FROM documents LEFT JOIN p ON p.id = doc_id""")
def patch_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("canvasTransform"), F.col("lang").alias("canvasProfileId"), F.col("n_chars").cast("double").alias("canvasMatchScore"))
    patch = spark.createDataFrame([(1, 2.0, "P1", 0.5), (3, 3.0, "", None), (5, None, None, 0.9)], "id long, transform double, profile string, score double")
    return catalog.patch_canvas(docs, patch).select("id", F.col("canvasTransform").alias("scale"), F.col("canvasProfileId").alias("profile"), F.col("canvasMatchScore").alias("score"))


@query("""SELECT r_name AS title, n_name AS frame, coalesce(c.fields, '') AS fields FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN
(SELECT c_nationkey, string_agg(c_name, ',' ORDER BY o NULLS FIRST, c_custkey) AS fields FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 7 END AS o FROM customer) GROUP BY 1) c ON c_nationkey = n_nationkey""")
def frames_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    methodologies = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("title"))
    frames = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("methodologyId"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.col("n_nationkey").alias("order"))
    fields = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("frameId"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 7).cast("int").alias("order"))
    return catalog.hierarchy(methodologies, frames, fields).select("title", "frame", F.array_join("fields", ",").alias("fields"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding) // 2)) AS i))
SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY vec_id""")
def to_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.points_from_embeddings(read(spark, sf_dir, "embeddings"))
    return points.select("vec_id", geometry.bbox_from_points(F.col("points")).alias("b")).select("vec_id", *(F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"WITH {LINES} SELECT id, 0.0::DOUBLE AS x0, (700.0 - (y + 8)) * 2.0 AS y0, 200.0::DOUBLE AS x1, (700.0 - y) * 2.0 AS y1 FROM (SELECT id, CAST(y AS DOUBLE) AS y FROM blocks)")
def bbox_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.lit(700.0)
    t = geometry.fit(F.lit(500.0), h, *schema.CANVAS)
    box = geometry.apply_transform(geometry.parse_bbox(F.col("bbox")), t, h)
    return doc_blocks(spark, sf_dir).select("id", *(box[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"WITH {LINES} SELECT id, 0.0::DOUBLE AS x, (800.0 - (y + 8)) * 6.0 AS y, 600.0::DOUBLE AS w, 48.0::DOUBLE AS h FROM (SELECT id, CAST(y AS DOUBLE) AS y FROM blocks)")
def overlay_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlays(doc_blocks(spark, sf_dir), 600.0, 800.0).select("id", "rect.x", "rect.y", "rect.w", "rect.h")


SCALE = "(CAST(embedding[2 * i + 1] AS DOUBLE) * 500 + 500) AS x, (CAST(embedding[2 * i + 2] AS DOUBLE) * 700 + 500) AS y"


@query(f"""WITH p AS (SELECT vec_id, {SCALE} FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding) // 2)) AS i)),
z AS (SELECT * FROM (VALUES ('core-services', 60, 260, 460, 520), ('core-value-proposition', 540, 260, 940, 520), ('value-capture', 60, 560, 460, 800), ('cost-structure', 540, 560, 940, 800)) v(zone, x0, y0, x1, y1))
SELECT vec_id, zone, count(*) AS n FROM p JOIN z ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY ALL""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.points_from_embeddings(read(spark, sf_dir, "embeddings")).select("vec_id", F.explode("points").alias("p"))
    points = points.select("vec_id", (F.col("p")[0] * 500 + 500).alias("x"), (F.col("p")[1] * 700 + 500).alias("y"))
    zones = F.array(*(F.struct(F.lit(z).alias("zone"), F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in poly)).alias("poly")) for z, _, poly in schema.ZONES))
    hits = points.select("vec_id", F.explode(F.filter(zones, lambda z: geometry.point_in_polygon(F.col("x"), F.col("y"), z["poly"]))).alias("z"))
    return hits.groupBy("vec_id", "z.zone").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey AS image, l_linenumber AS id, CAST(l_quantity AS INTEGER) - 5 AS w, CAST(l_quantity AS INTEGER) % 40 + 1 AS h FROM lineitem), a AS (SELECT *, w * h * 2 AS area FROM r)
SELECT image, id, w, h, area FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, id) AS k FROM a WHERE area > 1000 AND w > 0 AND h > 0) WHERE k <= 2""")
def region_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("id"), (q - 5).alias("w"), (q % 40 + 1).alias("h"))
    return regions.top_regions(boxes.withColumn("area", F.col("w") * F.col("h") * 2), n=2)


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'playbooks/d' || page_id WHEN 1 THEN 'frames-pdf/d' || page_id WHEN 2 THEN 'frames/p' || page_id WHEN 3 THEN 'frames/x-p' || page_id ELSE 'misc' END AS unit FROM pages""")
def unit_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit(f"{regions.PAGES_PLAYBOOKS}/d"), s, F.lit("/page-1.png"))).when(k == 1, F.concat(F.lit(f"{regions.PAGES_FRAMES}/d"), s, F.lit("/page-1.png")))
        .when(k == 2, F.concat(F.lit(f"{regions.FRAMES_RAW}/p"), s, F.lit(".png"))).when(k == 3, F.concat(F.lit(f"{regions.FRAMES_RAW}/x/p"), s, F.lit(".png"))).otherwise(F.concat(F.lit("/tmp/p"), s, F.lit(".png")))
    )
    return read(spark, sf_dir, "pages").select("page_id", regions.unit_of(path).alias("unit"))


@query("SELECT DISTINCT '/img/' || source || '-' || (doc_id % 50) || '.png' AS image FROM documents WHERE doc_id % 50 >= 20")
def manifest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 50
    lines = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"image": "/img/'), F.col("source"), F.lit("-"), n.cast("string"), F.lit('.png"}')).alias("value"))
    broken = lines.where("doc_id % 7 = 0").withColumn("value", F.lit("{not json")).union(lines.where("doc_id % 7 = 1").withColumn("value", F.lit("  ")))
    return catalog.new_manifest_rows(files.manifest_lines(lines.where(n < 20)), files.manifest_lines(lines.union(broken)))


@query(r"SELECT p_partkey, 'part-' || regexp_replace(lower(p_name), '\s+', '-', 'g') AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(F.lit("part"), F.col("p_name")).alias("slug"))


@query("""WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'token' WHEN 1 THEN 'assets' ELSE 'extract' END AS step, CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 503 ELSE 200 END AS status, CASE WHEN event_id % 8 = 6 THEN 'Read TIMEOUT' END AS error FROM events)
SELECT step, status, CASE WHEN status = 0 THEN 'Network / DNS issue – verify connectivity & host resolution' WHEN step = 'token' AND status IN (401, 403) THEN 'Check client id/secret and project entitlements' WHEN step = 'token' AND status >= 500 THEN 'Service error – retry later'
WHEN step = 'assets' AND status = 401 THEN 'Token invalid/expired – refresh credentials' WHEN step = 'assets' AND status = 403 THEN 'Insufficient permissions for assets scope' WHEN step = 'assets' AND status = 404 THEN 'Endpoint not found – confirm host/region'
WHEN step = 'extract' AND status = 404 THEN 'Auth OK (invalid fake asset is expected)' WHEN step = 'extract' AND status = 400 THEN 'Auth OK (payload invalid – expected with dry run)' WHEN step = 'extract' AND status = 401 THEN 'Token rejected for extract operation' WHEN step = 'extract' AND status = 403 THEN 'Entitlement missing for extract operation'
WHEN contains(lower(error), 'timeout') THEN 'Timeout – check network latency / firewall' ELSE 'Inspect status and logs' END AS advice, count(*) AS n FROM e GROUP BY ALL""")
def status_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 8
    status = F.when(k == 0, 0).when(k == 1, 400).when(k == 2, 401).when(k == 3, 403).when(k == 4, 404).when(k == 5, 503).otherwise(200)
    step = F.when(F.col("event_id") % 3 == 0, "token").when(F.col("event_id") % 3 == 1, "assets").otherwise("extract")
    e = read(spark, sf_dir, "events").select(step.alias("step"), status.alias("status"), F.when(k == 6, "Read TIMEOUT").alias("error"))
    return e.groupBy("step", "status", catalog.advice(F.col("step"), F.col("status"), F.col("error")).alias("advice")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(abs(embedding[3]) AS DOUBLE) AS c, CAST(abs(embedding[4]) AS DOUBLE) AS d FROM embeddings),
p AS (SELECT vec_id, CASE WHEN greatest(a, b, c, d) <= 1.01 THEN [a * 640, b * 480, c * 640, d * 480] ELSE [a, b, c, d] END AS p FROM b),
q AS (SELECT vec_id, list_transform(p, lambda x: greatest(CAST(trunc(x) AS INTEGER), 0)) AS q FROM p)
SELECT vec_id, q[1] AS x, q[2] AS y, q[3] - q[1] AS w, q[4] - q[2] AS h FROM q""")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.get("embedding", i).cast("double") for i in range(4)]
    box = geometry.to_pixels(F.array(e[0], e[1], F.abs(e[2]), F.abs(e[3])), F.lit(640), F.lit(480))
    return read(spark, sf_dir, "embeddings").select("vec_id", geometry.clip_xywh(box).alias("r")).select("vec_id", "r.x", "r.y", "r.w", "r.h")


@query("""SELECT count(*) FILTER (page_id % 2 = 0) AS json, count(*) FILTER (page_id % 2 = 1) AS png, count(DISTINCT page_id % 7) FILTER (page_id % 2 = 0) AS units FROM pages""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    path = F.concat(F.lit("/out/frames/u"), (n % 7).cast("string"), F.lit("/region-"), n.cast("string"), F.when(n % 2 == 0, ".json").otherwise(".png"))
    return regions.summary(read(spark, sf_dir, "pages").select(path.alias("path")))


@query("""SELECT bool_or(ok) AS ok, CAST(sum(blocks) AS BIGINT) AS blocks, min_by(doc, seq) FILTER (ok) AS "firstDocId", max_by(doc, seq) FILTER (ok) AS "lastDocId" FROM (SELECT doc_id AS seq, n_chars % 3 <> 0 AS ok, n_chars AS blocks, doc_id * 7 AS doc FROM documents)""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), (F.col("n_chars") % 3 != 0).alias("ok"), F.col("n_chars").alias("blocks"), (F.col("doc_id") * 7).alias("docId"))
    return catalog.batch_totals(rows)


@query("SELECT user_id % 2 + 3000 AS port, bool_and(value > 0) AS ok, count(*) AS n FROM events GROUP BY ALL")
def health_by_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % 2 + 3000).alias("port")).agg(F.bool_and(F.col("value") > 0).alias("ok"), F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 'failure' WHEN o_orderstatus = 'O' THEN 'success' ELSE 'running' END AS state, count(*) AS n FROM orders GROUP BY ALL""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    orders = read(spark, sf_dir, "orders").withColumn("raw", F.when(s == "F", "FAILED").when(s == "O", "Succeeded").otherwise(s))
    return orders.groupBy(s.alias("status"), normalize.job_state(F.col("raw")).alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, CAST(i * 5 + j AS INTEGER) AS k, round(CAST([0.1, 0.3, 0.5, 0.7, 0.9][j + 1] * (640 + page_id % 10) AS DOUBLE), 6) AS x, round(CAST([0.1, 0.3, 0.5, 0.7, 0.9][i + 1] * length(html) AS DOUBLE), 6) AS y
FROM pages, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for each page as an image: five by five points."""
    pages = read(spark, sf_dir, "pages").select("page_id", (640 + F.col("page_id") % 10).alias("w"), F.length("html").alias("h"), F.posexplode(geometry.grid()).alias("k", "p"))
    return pages.select("page_id", "k", F.round(F.get("p", 0) * F.col("w"), 6).alias("x"), F.round(F.get("p", 1) * F.col("h"), 6).alias("y"))


@query("SELECT page_id, base64(encode(url)) AS image_b64, CAST(octet_length(encode(url)) AS INTEGER) AS bytes FROM pages")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.base64(F.col("url").cast("binary")), r"\s", "").alias("image_b64"))
    return files.image_bytes(rows).select("page_id", "image_b64", F.octet_length("image").alias("bytes"))


@query(f"WITH {LINES} SELECT type, role, count(*) AS n, count(DISTINCT page) AS pages FROM (SELECT b.*, type FROM blocks b JOIN typed ON b.id = typed.doc_id * 4294967296 + typed.pos) GROUP BY ALL")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_blocks(spark, sf_dir).groupBy("type", "role").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))


@query(f"""WITH {LINES} SELECT src AS "docId", CAST(id % 4294967296 AS INTEGER) AS pos, page, role, text FROM blocks""")
def elements_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = doc_blocks(spark, sf_dir)
    element = F.struct((F.col("id") % adapters.LINES).alias("pos"), F.struct(F.col("type"), F.col("text"), F.struct((F.col("page") + 1).alias("page_number")).alias("metadata")).alias("e"))
    raw = blocks.groupBy(F.col("sourceDocId").alias("docId")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(element)), lambda x: x["e"])).alias("json"))
    raw = raw.withColumn("json", F.when(F.col("docId") % 2 == 0, F.col("json")).otherwise(F.concat(F.lit('{"elements":'), F.col("json"), F.lit("}"))))
    return files.elements(raw).select("docId", "pos", "page", "role", "text")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://h/' || page_id END AS found FROM pages""")
def json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    body = F.concat(F.lit('{"job":{"outputs":[{"assetID":"urn:x"},{"'), F.when(n % 2 == 0, "downloadUri").otherwise("other"), F.lit('":"https://h/'), n.cast("string"), F.lit('"}]},"status":"done"}'))
    return files.first_string(read(spark, sf_dir, "pages").select("page_id", body.alias("json")), "download", "^https?://")


@query("SELECT page_id, CAST(CASE WHEN page_id % 4 = 3 THEN 0 ELSE page_id END AS INTEGER) AS pages FROM pages")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    out = F.when(n % 4 == 3, F.lit("Syntax error")).otherwise(F.concat(F.lit("Title: x\nPages:          "), n.cast("string"), F.lit("\nEncrypted: no\n")))
    return read(spark, sf_dir, "pages").select("page_id", files.page_count(out).alias("pages"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.windowed_counts(read(spark, sf_dir, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT 'dup' AS rule, count(*) AS n FROM (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = catalog.duplicate_keys(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]).agg(F.lit("dup").alias("rule"), F.count("*").alias("n"))
    lost = catalog.orphans(read(spark, sf_dir, "nation"), "n_regionkey", read(spark, sf_dir, "region"), "r_regionkey").agg(F.lit("orphan"), F.count("*"))
    return dup.union(lost)


@query(f"""WITH {LINES}, z AS (SELECT id, 100.0 AS x, (700.0 - y - 4) * 2.0 AS y FROM blocks) SELECT id, CASE WHEN y > 260 AND y < 520 THEN 'core-services' WHEN y > 560 AND y < 800 THEN 'value-capture' END AS zone FROM z""")
def blocks_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.by_zone(doc_blocks(spark, sf_dir), [(z, p) for z, _, p in schema.ZONES], 500.0, 700.0, schema.CANVAS).select("id", "zone")


@query("SELECT doc_id AS id, 'doc-' || doc_id AS title FROM documents WHERE doc_id = 7")
def doc_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(adapters.docs_from_documents(read(spark, sf_dir, "documents")), "id", 7).select("id", "title")


@query("SELECT conv_id * 4294967296 + turn AS id, CAST(turn AS INTEGER) AS page, role, text FROM conversations WHERE conv_id = 5")
def blocks_of_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(turn_blocks(spark, sf_dir), "sourceDocId", 5).select("id", "page", "role", "text")


@query(f"WITH {LINES} SELECT id, role FROM blocks WHERE page = 1")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_of(doc_blocks(spark, sf_dir), 2).select("id", "role")


# Written out apart from the code's own templates.
FRAME_FIELDS = """f AS (SELECT * FROM (VALUES
  (0, 'platform-experience', 'Platform Experience', ['Stakeholder', 'Services', 'Key Expectations', 'Motivation', 'Key Resources', 'Alternatives', 'Satisfaction Drivers Success Factors', 'Attract', 'Touchpoints', 'CRM', 'Key Insights', 'Basic', 'Delight']),
  (1, 'ecosystem-forces-scan', 'Ecosystem Forces Scan', ['Environment', 'Market', 'Macroeconomic', 'Value Chain', 'Emerging Needs']),
  (2, 'platform-business-model', 'Platform Business Model', ['Mission', 'Core Services', 'Core Value Proposition', 'Core Network Effects', 'Consumers', 'Producers', 'Value Capture', 'Cost Structure', 'Key People Skills', 'Key Data',
    'Key Infrastructure', 'Supporters', 'Investors', 'Suppliers', 'USP', 'TAM', 'SAM', 'SOM']),
  (3, 'nfx-reinforcement-engines', 'NFX Reinforcement Engines', ['Demand Side', 'Supply Side', 'Core Value', 'Brand Loyalty', 'Tech Infrastructure', 'Economy of Scale', 'Experience Personal Social', 'Ecosystem Sustainability', 'Data Intelligence']),
  (4, 'platform-value-network', 'Platform Value Network', ['Consumers', 'Producers', 'Partners', 'Owners', 'Value Propositions', 'Transactions'])) v(frame_pos, slug, frame, fields)),
t AS (SELECT frame_pos, slug, frame, u.i AS field_pos, u.field FROM f, LATERAL (SELECT unnest(range(0, len(fields))) AS i, unnest(fields) AS field) u)"""


@query(f"WITH {FRAME_FIELDS} SELECT frame_pos, slug, frame, CAST(field_pos AS INTEGER) AS field_pos, field, count(doc_id) AS docs, max(doc_id) AS newest FROM t LEFT JOIN documents ON doc_id % 5 = frame_pos AND doc_id % 19 >= field_pos GROUP BY ALL")
def frame_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template fields with the documents that are dealt to them, by frame and up to a place in it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("frame_pos"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 19).cast("int"))).alias("field_pos"))
    dealt = docs.groupBy("frame_pos", "field_pos").agg(F.count("*").alias("docs"), F.max("doc_id").alias("newest"))
    out = schema.frame_fields(spark).join(dealt, ["frame_pos", "field_pos"], "left")
    return out.select("frame_pos", "slug", "frame", "field_pos", "field", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), "newest")


@query(f"""WITH {FRAME_FIELDS}, w AS (SELECT DISTINCT slug, frame, field_pos, field, unnest(string_split(lower(field), ' ')) AS w FROM t WHERE slug IN ('platform-experience', 'platform-business-model')),
n AS (SELECT w, count(DISTINCT conv_id) AS n FROM (SELECT conv_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), ' ')) AS w FROM conversations) GROUP BY w)
SELECT slug, frame, CAST(field_pos AS INTEGER) AS field_pos, field, CAST(sum(coalesce(n, 0)) AS BIGINT) AS conversations FROM w LEFT JOIN n USING (w) GROUP BY ALL""")
def target_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that assignment looks for, with how many conversations have each of their words, added up."""
    t = schema.target_fields(spark).select("slug", "frame", "field_pos", "field", F.explode(F.array_distinct(text.words(text.normalize(F.col("field"))))).alias("w"))
    turns = turn_blocks(spark, sf_dir).select("sourceDocId", F.explode(text.words(text.normalize(F.col("text")))).alias("w"))
    n = turns.groupBy("w").agg(F.countDistinct("sourceDocId").alias("n"))
    return t.join(n, "w", "left").groupBy("slug", "frame", "field_pos", "field").agg(F.sum(F.coalesce("n", F.lit(0).cast("long"))).alias("conversations"))


@query("SELECT r_name AS profile, 'zone-' || n_nationkey AS zone, n_name AS name, CAST(n_nationkey AS DOUBLE) AS x0 FROM region JOIN nation ON n_regionkey = r_regionkey")
def zone_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    polygon = F.array(F.array(n, F.lit(0)), F.array(n, F.lit(9)), F.array(F.lit(99), F.lit(9)))
    zone = F.struct(F.concat(F.lit("zone-"), n.cast("string")).alias("id"), F.col("n_name").alias("name"), polygon.alias("polygon"))
    per_region = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(zone).alias("zones"))
    joined = read(spark, sf_dir, "region").join(per_region, F.col("r_regionkey") == F.col("n_regionkey"))
    canvas = F.struct(F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    raw = joined.select(F.to_json(F.struct(F.col("r_name").alias("id"), F.col("r_name").alias("name"), canvas.alias("canonical"), "zones")).alias("json"))
    return files.profile_zones(raw).select("profile", "zone", "name", F.col("polygon")[0][0].alias("x0"))


@query("""SELECT conv_id AS "docId", CAST(turn AS INTEGER) AS page, CASE WHEN turn % 3 = 0 THEN 'Table' WHEN turn % 3 = 1 THEN role ELSE 'unknown' END AS role, text,
CASE WHEN turn % 3 = 0 THEN '{"n":' || turn || '}' END AS "tableJson", CASE WHEN turn % 2 = 0 THEN '0,0,0,0' ELSE '1,2,' || turn || ',4' END AS box FROM conversations""")
def structured_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured output with both spellings of its keys; odd turns have boxes."""
    t = F.col("turn")
    table = F.map_from_arrays(F.array(F.lit("n")), F.array(t))
    entries = {
        "page": F.when(t % 2 == 0, t), "Page": F.when(t % 2 == 1, t), "bounds": F.when(t % 4 == 1, F.array(F.lit(1), F.lit(2), t, F.lit(4), F.lit(5))), "Boundary": F.when(t % 4 == 3, F.array(F.lit(1), F.lit(2), t, F.lit(4))),
        "type": F.when(t % 3 == 0, "Table"), "Type": F.when(t % 3 == 1, F.col("role")), "text": F.when(t % 5 < 3, F.col("text")), "Text": F.when(t % 5 >= 3, F.col("text")), "Table": table,
    }
    listed_in_json = {k: F.to_json(F.array(c)) for k, c in entries.items()}
    named = F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), F.substring(j, F.lit(2), F.length(j) - 2))) for (k, c), j in zip(entries.items(), listed_in_json.values(), strict=True)))
    element = F.concat(F.lit("{"), F.array_join(F.filter(named, lambda x: x.isNotNull()), ","), F.lit("}"))
    listed = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("docId")).agg(F.array_join(F.collect_list(element), ",").alias("l"))
    raw = listed.select("docId", F.concat(F.when(F.col("docId") % 2 == 0, '{"content":[').otherwise('{"elements":['), "l", F.lit("]}")).alias("json"))
    box = F.array_join(F.transform("bbox", text.number_text), ",")
    return files.structured(raw).select("docId", "page", "role", "text", "tableJson", box.alias("box"))


@query("""WITH d AS (SELECT conv_id, max(turn) + 1 AS pages FROM conversations GROUP BY conv_id)
SELECT 'doc-' || conv_id AS title, CASE WHEN conv_id % 2 = 0 THEN 'pdf' ELSE 'png' END AS type, CASE WHEN conv_id % 3 = 0 THEN 'adobe' ELSE 'unstructured' END AS engine, CASE WHEN conv_id % 4 = 0 THEN 'own' ELSE 'PIK_BusinessModel_v5' END AS profile,
CASE WHEN conv_id % 5 > 0 THEN CAST(conv_id % 5 AS DOUBLE) END AS score, CAST(pages AS INTEGER) AS pages, (SELECT count(*) FROM conversations c WHERE c.conv_id = d.conv_id) AS blocks FROM d""")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations go into empty tables; each document then has its blocks by its new id."""
    turns = read(spark, sf_dir, "conversations")
    k = F.col("key")
    pages = normalize.observed_pages(turn_blocks(spark, sf_dir)).select(F.col("sourceDocId").alias("key"), "pages")
    uploads = pages.select(
        "key", F.concat(F.lit("doc-"), k.cast("string"), F.when(k % 2 == 0, ".PDF").otherwise(".png")).alias("name"), F.lit("/x").alias("path"), F.when(k % 3 == 0, "ADOBE").otherwise("").alias("engine"),
        F.when(k % 4 == 0, "own").otherwise("").alias("profile"), (k % 5).cast("string").alias("score"), "pages",
    )
    shaped = normalize.shaped_for_insert(turns.select(F.col("conv_id").alias("k"), F.col("turn").cast("int").alias("page"), F.expr("array(0D, 0D, 0D, 0D)").alias("bbox"), "role", "text", F.lit(None).cast("string").alias("tableJson")), F.col("k"))
    empty = [spark.createDataFrame([], s) for s in (schema.SOURCE_DOC, schema.BLOCK)]
    docs, blocks = catalog.ingest(*empty, normalize.source_docs(uploads), shaped.withColumnRenamed("sourceDocId", "key"))
    counts = blocks.groupBy("sourceDocId").agg(F.count("*").alias("blocks"))
    out = docs.join(counts, F.col("id") == F.col("sourceDocId"))
    return out.select("title", "type", "engine", F.col("canvasProfileId").alias("profile"), F.col("canvasMatchScore").alias("score"), "pages", "blocks")


@query(f"""WITH {LINES} SELECT src AS "sourceDocId", count(*) AS n, string_agg(role, ',' ORDER BY id) AS roles FROM blocks GROUP BY src""")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised blocks as JSON documents, read again."""
    made = files.artifacts(doc_blocks(spark, sf_dir).select("sourceDocId", "id", "page", "role", "text"))
    back = made.select("sourceDocId", F.from_json("json", "array<struct<id:bigint,page:int,role:string,text:string>>").alias("b"))
    return back.select("sourceDocId", F.size("b").cast("long").alias("n"), F.array_join(F.col("b")["role"], ",").alias("roles"))


@query("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM conversations) AS blocks, 0::BIGINT AS left_")
def reset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, blocks, counts = catalog.reset(read(spark, sf_dir, "documents"), turn_blocks(spark, sf_dir))
    left = docs.select("doc_id").union(blocks.select("id")).agg(F.count("*").alias("left_"))
    return left.select(F.lit(counts["docs"]).cast("long").alias("docs"), F.lit(counts["blocks"]).cast("long").alias("blocks"), "left_")


@query(r"SELECT page_id, 'a.' || page_id AS title, nullif(page_id % 3, 0) AS rest FROM pages")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("a."), F.col("page_id").cast("string"), F.lit(".pdf"))
    return read(spark, sf_dir, "pages").select("page_id", text.title_of(name).alias("title"), text.null_if_zero(F.col("page_id") % 3).alias("rest"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'table' ELSE 'paragraph' END AS role, CASE WHEN page_id % 2 = 0 THEN '{"html":"<table>' || page_id || '</table>"}' END AS "tableJson" FROM pages""")
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    element = F.struct(F.when(n % 2 == 0, "Table").otherwise("Text").alias("type"), F.concat(F.lit("<table>"), n.cast("string"), F.lit("</table>")).alias("text_as_html"))
    raw = read(spark, sf_dir, "pages").select("page_id", F.to_json(F.array(element)).alias("json"))
    return files.elements(raw).select("page_id", "role", "tableJson")


@query(f"""WITH {LINES} SELECT src AS "sourceDocId", max(page) + 1 AS pages FROM blocks GROUP BY src""")
def observed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.observed_pages(doc_blocks(spark, sf_dir))


@query("""WITH p AS (SELECT l_orderkey AS mask, CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_quantity AS INTEGER) END AS x, CASE WHEN l_orderkey % 5 > 0 THEN l_linenumber END AS y FROM lineitem)
SELECT mask, coalesce(min(x), 0) AS x0, coalesce(min(y), 0) AS y0, coalesce(max(x), -1) AS x1, coalesce(max(y), -1) AS y1, count(x) AS area FROM p GROUP BY mask""")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.col("l_orderkey") % 5 > 0
    pixels = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mask"), F.when(there, F.col("l_quantity").cast("int")).alias("x"), F.when(there, F.col("l_linenumber")).alias("y"))
    return regions.mask_box(pixels)


@query("SELECT doc_id AS id, 'doc-' || doc_id AS title FROM documents ORDER BY doc_id DESC")
def docs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest(adapters.docs_from_documents(read(spark, sf_dir, "documents"))).select("id", "title")


@query(f"""WITH {LINES} SELECT id, src AS "docId", page, role, {SNIPPET} AS snippet FROM blocks WHERE contains(lower(text), 'the') ORDER BY id LIMIT 10""")
def search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(doc_blocks(spark, sf_dir), "the", limit=10)


@query("SELECT l_orderkey AS image, l_linenumber AS pos, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS region FROM lineitem QUALIFY region <= 3")
def first_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("pos"))
    return regions.first_boxes(boxes, 3)


@query("SELECT DISTINCT 'u' || (page_id % 30) AS unit FROM pages ORDER BY unit LIMIT 10")
def sample_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/out/u"), (F.col("page_id") % 30).cast("string"), F.lit("/regions/region-1.json"))
    return regions.sample_units(read(spark, sf_dir, "pages").select(regions.unit_of_region(path).alias("unit")))


@query("SELECT 'run' || (user_id % 9) AS run FROM events ORDER BY ts DESC, run DESC LIMIT 1")
def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/run"), (F.col("user_id") % 9).cast("string"), F.lit("/f"))
    return regions.newest_run(read(spark, sf_dir, "events").select(path.alias("path"), F.col("ts").alias("modificationTime"))).select("run")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'd' || page_id WHEN 1 THEN 'e' || page_id ELSE 'p' || page_id END AS unit FROM pages")
def unit_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("page_id") % 3, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/x/d"), s, F.lit("/page-2/a.png"))).when(k == 1, F.concat(F.lit("/x/pages/e"), s, F.lit("/page-1.png"))).otherwise(F.concat(F.lit("/x/y/p"), s, F.lit(".png")))
    return read(spark, sf_dir, "pages").select("page_id", regions.unit_of_page(path).alias("unit"))


@query("""SELECT page_id AS image, CAST(CASE WHEN page_id % 3 = 0 THEN page_id ELSE 640 END AS INTEGER) AS w, 1 AS region FROM pages""")
def regions_or_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "pages").select(F.col("page_id").alias("image"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    own = images.where("image % 3 = 0").select("image", F.lit(1).alias("region"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("image").cast("int").alias("w"), F.lit(9).alias("h"))
    return regions.regions_or_whole(images, own).select("image", "w", "region")


@query("SELECT page_id AS id, 0.7::DOUBLE AS score, least(1000.0::DOUBLE / (page_id + 1), 1400.0::DOUBLE / 700) AS k FROM pages")
def aligned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") + 1).cast("double").alias("pageWidth"), F.lit(700.0).alias("pageHeight"))
    return regions.aligned(docs, normalize.PROFILE, *schema.CANVAS).select("id", F.col("matchScore").alias("score"), F.col("transform.scaleX").alias("k"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract(millisecond FROM ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, strftime(ts, '%H%M') AS hhmm, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, epoch_us(ts) // 1000 - 5000 AS since FROM events""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", text.iso_time(t).alias("iso"), F.date_format(t, "HHmm").alias("hhmm"), F.unix_seconds(t).alias("seconds"), text.duration_ms(F.timestamp_millis(F.lit(5000)), t).alias("since"))


@query("""SELECT page_id, 'a%20b%26' || page_id || '!' AS uri, CAST(floor(page_id / 300.0 * 100 + 0.5) AS INTEGER) || '%' AS share FROM pages""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", text.uri_encoded(F.concat(F.lit("a b&"), n.cast("string"), F.lit("!"))).alias("uri"), text.percent(n / 300.0).alias("share"))


@query("""SELECT 'there' AS kind, count(*) AS n FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'missing', count(*) FROM pages WHERE page_id % 2 = 1""")
def existing_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "pages").select(F.concat(F.lit("/f"), F.col("page_id").cast("string")).alias("path"), "page_id")
    there, missing = files.present(wanted.where("page_id % 2 = 0").select("path"), wanted.select("path"))
    return there.agg(F.lit("there").alias("kind"), F.count("*").alias("n")).union(missing.agg(F.lit("missing"), F.count("*")))


@query("SELECT page_id, length(html) >= 2000 AS ok, CASE page_id % 3 WHEN 0 THEN 'vit_b' WHEN 1 THEN 'vit_l' ELSE 'vit_h' END AS arch FROM pages")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    name = F.when(k == 0, "sam_vit_b_01.pth").when(k == 1, "sam_vit_l.pth").otherwise("other.pth")
    return read(spark, sf_dir, "pages").select("page_id", files.file_ok(F.length("html"), 2000).alias("ok"), regions.sam_arch(name).alias("arch"))


@query("SELECT 'K' || (page_id % 40) AS key, 'v ' || min(page_id) AS value FROM pages GROUP BY page_id % 40")
def env_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    lines = read(spark, sf_dir, "pages").select(n.alias("pos"), F.concat(F.lit("K"), (n % 40).cast("string"), F.lit(" = 'v "), n.cast("string"), F.lit("' ")).alias("value"))
    return files.env_lines(lines)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'adobe' ELSE 'unstructured' END AS engine FROM pages")
def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    return read(spark, sf_dir, "pages").select("page_id", normalize.engine_of(F.when(k == 0, "Adobe").when(k == 1, "")).alias("engine"))


@query("SELECT p_partkey, 'a' || p_partkey || 'b' || p_size AS merged FROM part")
def merged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    old = F.create_map(F.lit("a"), F.col("p_partkey"), F.lit("b"), F.lit(0).cast("long"))
    out = part.select("p_partkey", files.merged_values(old, F.create_map(F.lit("b"), F.col("p_size").cast("long"))).alias("m"))
    return out.select("p_partkey", F.concat(F.lit("a"), F.col("m")["a"].cast("string"), F.lit("b"), F.col("m")["b"].cast("string")).alias("merged"))


from . import stored  # noqa: E402, F401  registers more queries
