import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagegrain.llm import fim
from pagegrain.llm.queries import op12_fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "a b c d e", "é 😀  x\n\n", "a\x00b c\x85 \x1cd", "has <P> mark", "<S>", "a <M> b", "<P <S <M a< b<P", "\r\n", "x" * 3000 + " y", "​ ​  ﻿"]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    hexa = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    bits = ["a", "bc", " ", "  ", "\n", "\t", "é", "😀", "<", "P>", "<S", " ", "\x0b", "."]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return [(i, t) for i in range(60) for t in ODD[i % len(ODD) : i % len(ODD) + 1]] + [(k, t) for k in range(1000, 1020) for t in ODD] + made + [(None, "a b c d")] * 2 + [(7, "a b c d")] * 3


def test_as_brute_force_and_restored(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, output string, n int")
    got = fim.transform(df, digests=True)
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows)
    for (d, t), r in zip(rows, back, strict=True):
        n, form, first, inner, out = brute(d, t)
        assert (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (d, n, form, first, inner, out)
        assert r["back"] == (t or "") == fim.restore(out, form)
        assert (r["output_sha256"], r["restored_sha256"]) == (digest(out), digest(t or ""))
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_long_text_in_pieces(monkeypatch):
    from tokenizers import Regex, pre_tokenizers

    rng = random.Random(5)
    text = "".join(rng.choice(["a", "bb", " ", "   ", "\n", "é"]) for _ in range(4000)) + " " * 500 + "z" * 700 + "  "
    splitter = pre_tokenizers.Split(Regex(fim.UNIT), "isolated")
    whole = [m.end() for m in UNIT.finditer(text)]
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(fim, "PIECE", size)
        assert fim.unit_ends(text, splitter).tolist() == whole


def test_other_plans_and_names(spark):
    df = spark.createDataFrame([(i, f"one two three {i}") for i in range(400)], "doc_id long, body string")
    plan = fim.Plan(seed=7, percent=100, suffix_first=0, prefix="[a]", suffix="[b]", middle="[c]")
    got = fim.transform(df, plan, text="body", keep=("doc_id", "body"))
    assert got.where(F.col("form") != "psm").count() == 0
    assert got.where(fim.restored(F.col("output"), F.col("form"), plan) != F.col("body")).count() == 0
    assert got.select("prefix_chars", "middle_chars").distinct().count() > 5
    with pytest.raises(ValueError, match="form"):
        fim.transform(df.withColumn("form", F.lit(1)), text="body", keep=("form",))


def test_empty_table_and_query(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(empty, digests=True).count() == 0
    got = op12_fill_in_middle(spark, sf_dir)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.join(texts, "doc_id").where(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col("restored_sha256")).count() == texts.count()
