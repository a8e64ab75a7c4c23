import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from pagegrain.llm import periods
from pagegrain.llm.queries import looped, op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, length=6, exponent=4):
    """Every period is tried over the whole document."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def looped_words(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(words):
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return found, best, left


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def made(seed, count):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        words = [rng.choice("abcd"[: rng.randint(1, 4)]) * rng.choice([1, 1, 20]) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.5 and words:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words = [words[k] if k < a else words[a + (k - a) % min(p, len(words) - a)] for k in range(len(words))]
        out.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    return out


def test_runs_of_many_documents_at_once():
    rng = random.Random(2)
    for _ in range(200):
        docs = [[w.encode() for w in t.split()] for _, t in made(rng.random(), rng.randint(1, 6))]
        number = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        first = np.cumsum([0] + [len(d) for d in docs])
        for length, exponent in ((6, 4), (2, 2), (5, 3), (9, 6)):
            begin, end, q = periods.runs(np.array([number[w] for d in docs for w in d], np.int64), first, periods.Rules(length, exponent))
            got = [[(int(s - a), int(e - s), int(p)) for s, e, p in zip(begin, end, q, strict=True) if a <= s < b] for a, b in zip(first[:-1], first[1:], strict=True)]
            assert got == [brute(d, length, exponent) for d in docs]


def test_as_brute_force(spark, sf_dir):
    odd = [(None, "a a a a a a a b"), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "a b " * 40), (9, "a b " * 40), (10, "x x " * 9), (11, "é 😀 " * 7), (12, "w" * 70 + " " + ("v" * 70 + " ") * 8)]
    rows = odd + [(i + 100, t) for i, t in made(4, 300)] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, __id string")
    got = periods.find(looped(df), digests=True).collect()
    assert len(got) == len(rows)
    for (d, t), r in zip(rows, got, strict=True):
        found, best, left = expected(looped_words(d, t))
        assert [tuple(x) for x in r["runs"]] == found and r["collapsed"] == left
        assert (r["doc_id"], r["n_runs"]) == (d, len(found))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert (r["runs_sha256"], r["collapsed_sha256"]) == (sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(left))
    assert sum(r["n_runs"] > 0 for r in got) > 50
    assert any(len(r["runs"]) > 1 for r in got)


def test_ties_take_the_first_run():
    assert periods.strongest([(0, 8, 2), (3, 4, 1), (20, 8, 2)]) == (0, 8, 2, 4000)
    assert periods.strongest([(0, 9, 2), (3, 5, 1), (20, 10, 2)]) == (3, 5, 1, 5000)
    assert periods.strongest([]) == (None,) * 4


def test_one_word_over_and_over_takes_no_square():
    took = []
    for n in (20_000, 160_000):
        t = time.perf_counter()
        begin, end, q = periods.runs(np.zeros(n, np.int64), np.array([0, n]))
        took.append(time.perf_counter() - t)
        assert (begin.tolist(), end.tolist(), q.tolist()) == ([0], [n], [1])
    assert took[1] < 32 * took[0]


def test_names_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a " * 9, 2)], "doc_id long, body string, runs int")
    assert periods.find(df, text="body").first()["runs"] == [(0, 9, 1)]
    with pytest.raises(ValueError, match="runs"):
        periods.find(df, text="body", keep=("runs",))
    with pytest.raises(ValueError, match="exponent"):
        periods.Rules(exponent=1)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.find(looped(empty), digests=True).count() == 0


def test_query(spark, sf_dir):
    got = op11_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
