import compare
import pytest

from pagegrain.plans import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert compare.difference(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name]) is None


def test_assignment_isnt_vacuous(spark, sf_dir):
    rows = queries.assigned(spark, sf_dir).collect()
    assert any(r["value"] is None for r in rows)
    assert any(r["ids"].count(",") == 2 for r in rows)
    assert any(r["ids"] and "," not in r["ids"] for r in rows)


def test_entry_names_match_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.SQL) == set(queries.QUERIES)


def test_all_lines_go_through_elements(spark, sf_dir):
    lines = sum(len((r["text"] or "").split("\n")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect())
    assert queries.QUERIES["elements_json"](spark, sf_dir).count() == lines


def test_manifest_is_what_drops_images(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.catalog, "new_manifest_rows", lambda manifest, images: seen.append((manifest, images)) or images)
    queries.manifest_dedupe(spark, sf_dir)
    manifest, images = ({r["image"] for r in df.select("image").distinct().collect()} for df in seen[0])
    assert manifest and manifest < images


def test_gaps_keep_all_turns(spark, sf_dir, monkeypatch):
    seen, real = [], queries.report.report
    monkeypatch.setattr(queries.report, "report", lambda docs, blocks: seen.append(blocks) or real(docs, blocks))
    queries.empty_pages(spark, sf_dir)
    assert seen[0].count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
