import os
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagegrain.llm import language_model, minhash, substrings, toxicity
from pagegrain.llm.queries import op3_toxicity, op5_substring_dedup, op8_lm_score, op10_minhash_dedup

DOC = "doc_id long, text string"
SEPARATED = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(SEPARATED, t or "")


def table(spark, rows, extra="x int"):
    return spark.createDataFrame([(*r, 1) for r in rows], f"{DOC}, {extra}")


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def deduplicated(rows, k):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1 if d is not None else 0):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1 if d is not None else 0) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 50)
            w += b[a : a + rng.randint(1, 40)] + [str(rng.random()) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.2:
            w = [rng.choice("ab") for _ in range(30)]
        rows.append((rng.choice([i, i, i, i, 3, None]), rng.choice([" ".join(w), "\n".join(w), None if rng.random() < 0.2 else " ".join(w)])))
    rows += rows[:3]
    for k in (8, 7):
        got = substrings.dedup(table(spark, rows, "owner int"), k).collect()
        assert sorted(str(tuple(r)) for r in got) == deduplicated(rows, k)


def test_substrings_on_documents(spark, sf_dir):
    got = op5_substring_dedup(spark, sf_dir).collect()
    assert sorted(str(tuple(r)) for r in got) == deduplicated(documents(spark, sf_dir), 50)
    assert sum(r["n_removed"] for r in got) > 0


def test_substrings_of_copies_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(i, text) for i in range(300)] + [(1000, text + " end"), (1001, "a " * 20000)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(table(spark, rows), 50).collect()}
    assert got == {0: 0, **dict.fromkeys(range(1, 300), 200), 1000: 200, 1001: 0}
    assert substrings.dedup(table(spark, rows).limit(0)).count() == 0


def components(rows, percent):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j, n in Counter(j for g in s for j in having[g] if j < i and rows[j][0] is not None).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(rows[i][0]), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(str((d, len(s), None if d is None else root(d), d is None or root(d) == d)) for (d, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_components_against_brute_force(spark, seed, percent):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 300)) for _ in range(rng.randint(3, 200))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = str(rng.random())
            rows.append((len(rows) * 3 % 1001, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(None, "a b c d e f"), (2000, "a b c d e f"), (2001, None), (2002, "  "), (2003, "a b"), (2004, "A  b"), (2004, "A  b"), (2005, "a"), (2006, "v " * 30000)]
    rng.shuffle(rows)
    got = minhash.components(table(spark, rows, "keys int"), percent).collect()
    assert sorted(str(tuple(r)) for r in got) == components(rows, percent)


def test_components_on_documents(spark, sf_dir):
    got = op10_minhash_dedup(spark, sf_dir).collect()
    assert sorted(str(tuple(r)) for r in got) == components(documents(spark, sf_dir), 85)
    assert sum(not r["kept"] for r in got) > 0
    assert minhash.components(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_tables_lose_few_pairs():
    for percent in (80, 85):
        m, p = minhash.collections(percent, 3), (percent / 100) ** 3
        assert (1 - p) ** m + m * p * (1 - p) ** (m - 1) <= minhash.MISS


def test_language_model_base(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "A a B"), (None, "a"), (3, "A a B"), (4, "zz " * 30000)] + documents(spark, sf_dir)
    tokens = [words(lower(t)) + [None] for _, t in rows]
    c = Counter(x for (d, _), ts in zip(rows, tokens, strict=True) if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for x in ts)
    n, v = sum(c.values()), len(c)
    expected = Counter((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), 5)) for (d, _), ts in zip(rows, tokens, strict=True))
    out = language_model.score(table(spark, rows, "block int"), block_bytes=100_000).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == expected
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in out)


def test_language_model_is_interpolation(spark):
    """Scores against the same model in plain Python, but for the grid on which mixtures are learned."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("a b", "a c", "d", f"u{rng.randint(0, 40)}")) for _ in range(20))) for i in range(200)]
    out = {r["doc_id"]: r for r in language_model.score(table(spark, rows), block_bytes=1000).collect()}
    train = [(d, ["<s>", *words(t), "</s>"]) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    one, two = Counter(x for _, ts in train for x in ts[1:]), Counter(p for _, ts in train for p in zip(ts, ts[1:], strict=False))
    context = Counter(x for _, ts in train for x in ts[:-1])
    n, v = sum(one.values()), len(one)
    # The most that any mixture of the three estimates could give is a bound, and the uniform share the least.
    for d, t in rows:
        ts = ["<s>", *words(t), "</s>"]
        best = sum(math.log10(max(two[p] / context[p[0]] if context[p[0]] else 0, one[p[1]] / n, 1 / (v + 1))) for p in zip(ts, ts[1:], strict=False))
        assert best >= out[d]["score"] - 1e-9
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2]
    assert sum(out[d]["score"] for d in held) > sum(out[d]["base_score"] for d in held)


def test_mixture_finds_weights():
    rng = np.random.default_rng(1)
    p2, p1, truth = rng.uniform(0, 1, 20000), rng.uniform(0, 0.3, 20000), np.array([0.6, 0.3, 0.1])
    # Tokens in proportion to the true mixture's probability make that mixture the most likely one.
    cells = np.column_stack([np.full(20000, 3), p2, p1, truth[0] * p2 + truth[1] * p1 + truth[2] * 0.01])
    w = language_model.mixture(cells, 0.01, turns=2000)
    like = lambda x: (cells[:, 3] * np.log(cells[:, 1] * x[0] + cells[:, 2] * x[1] + 0.01 * x[2])).sum()
    assert like(w[3]) >= max(like(truth), like([1 / 3] * 3), like([0.9, 0.05, 0.05])) - 1e-6
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


def test_language_model_of_nothing(spark, sf_dir):
    assert language_model.score(table(spark, [(1, "a")]).limit(0)).count() == 0
    untrained = language_model.score(table(spark, [(None, "a b")])).first()
    assert (untrained["train_tokens"], untrained["n_known"], untrained["base_score"]) == (0, 0, 0.0)
    assert op8_lm_score(spark, sf_dir).count() == len(documents(spark, sf_dir))


def test_toxicity_held_out():
    """Planted words in windows: nearly all marked documents over all others."""
    rng = random.Random(5)
    common = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    bad = ["worthlessly", "disgusting", "scumbags"]
    at = toxicity.Limits()

    def text(mark):
        return " ".join(rng.choice(bad) if mark and rng.random() < 0.06 else rng.choice(common) for _ in range(150))

    def cut(docs):
        return [w for t in docs for w in toxicity.windows(t, at.sample_words)]

    ready = [toxicity.loaded(r) for r in toxicity.trained(cut([text(True) for _ in range(300)]), cut([text(False) for _ in range(300)]), at)]
    x = toxicity.figures(ready, [text(i % 2) for i in range(400)], at.scales)
    y = np.arange(400) % 2
    w = toxicity.fitted(x[:200], y[:200].astype(float), np.ones(200))
    z = x[200:] @ w[1:] + w[0]
    assert ((z >= 0) == y[200:]).mean() > 0.95


def test_toxicity_phrases_of_common_words():
    """Planted phrases of words that ordinary documents have as often: no single word tells the classes apart."""
    rng = random.Random(7)
    common = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = [rng.sample(common, 5) for _ in range(12)]
    at = toxicity.Limits()

    def text(mark):
        return " ".join(x for _ in range(150) for x in (rng.choice(bad) if mark and rng.random() < 0.03 else [rng.choice(common)]))

    def cut(docs):
        return [w for t in docs for w in toxicity.windows(t, at.sample_words)]

    samples = cut([text(True) for _ in range(400)]), cut([text(False) for _ in range(400)])
    ready = [toxicity.loaded(r) for r in toxicity.trained(*samples, at)]
    x = toxicity.figures(ready, [text(i % 2) for i in range(600)], at.scales)
    y = np.arange(600) % 2
    w = toxicity.fitted(x[:300], y[:300].astype(float), np.ones(300))
    assert ((x[300:] @ w[1:] + w[0] >= 0) == y[300:]).mean() > 0.9


def test_toxicity_scores_are_those_of_the_dictionaries(spark):
    """Score against plain compression with the model's two dictionaries."""
    import zstandard

    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def text(i):
        return " ".join(rng.choice(["scumbags", "worthlessly"]) if i % 3 == 0 and rng.random() < 0.1 else rng.choice(common) for _ in range(60))

    rows = [(i, text(i)) for i in range(400)] + [(1000, None), (1001, "")]
    docs = table(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int"))

    def size(raw, part):
        at = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=4, window_log=17, hash_log=15, chain_log=16, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=at).compress(part))

    def expected(t):
        z = model["weights"][0]
        weights = iter(model["weights"][1:])
        for i, k in enumerate(model["scales"]):
            ordinary, toxic = model["dictionaries"][2 * i : 2 * i + 2]
            words = (t or "").lower().encode().split()
            cut = [b" ".join(words[i : i + k]) for i in range(0, len(words), k)] or [b""]
            gain = [size(ordinary, w) - size(toxic, w) for w in cut]
            over = [sum(g >= at for g in gain) for at in toxicity.THRESHOLDS]
            x = [sum(gain) / len(gain), max(gain) / 10, *(10 * o / len(gain) for o in over), *(float(o > 0) for o in over[1:])]
            z += sum(a * b for a, b in zip(x, weights, strict=False))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    for d, t in rows[::10] + rows[-2:]:
        assert abs(got[d][0] - expected(t)) < 1e-9 and got[d][1] == (got[d][0] >= 0.5)
    right = [got[d][1] == (d % 3 == 0) for d, _ in rows[:400] if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(right) > 0.9 * len(right)


def test_toxicity_rows(spark, sf_dir):
    out = op3_toxicity(spark, sf_dir).collect()
    assert len(out) == len(documents(spark, sf_dir))
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    docs = table(spark, [(1, "a"), (None, None), (5, "")], "score int")
    assert toxicity.fit(docs, labels) is None
    assert [(r["score"], r["predicted"]) for r in toxicity.score(docs, None).collect()] == [(0.0, 0)] * 3
    both = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, [(i, "vile words" if i % 2 else None) for i in range(60)]), both)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    from pagegrain.llm import secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = p.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert len(rows) < len(before)
    near = p.near_duplicates(spark, kept, sf_dir)
    least = {eval(x)[0] for x in components(rows, 80) if eval(x)[3]}
    assert {r["doc_id"] for r in near.collect()} == least
    clean = p.decontamination(spark, near, sf_dir)
    assert clean.columns == docs.columns and clean.count() < near.count()
    redacted = {r["doc_id"]: r for r in p.secret_scan(spark, clean, sf_dir).collect()}
    for d, r in redacted.items():
        text = before[d]["text"]
        assert r["text"] == secrets.redact(text, secrets.scan(text)) and r["n_chars"] == len(r["text"])
        assert not secrets.scan(r["text"]) or secrets.scan(text)
    out = p.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(redacted)
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "bpe_tokens"]


def test_decontamination_goes_by_row(spark, sf_dir):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(d, t, None, None, None) for d, t in [(None, item), (None, "clean"), (1, item), (1, "clean too"), (2, None)]]
    left = p.decontamination(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == sorted(map(str, [(None, "clean"), (1, "clean too"), (2, None)]))


def test_stages_take_nothing(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None)], docs.schema)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
        stage(spark, odd, sf_dir).collect()


def area(scores, truth):
    """The area under the ROC curve, by ranks; ties count half."""
    order = sorted(range(len(scores)), key=scores.__getitem__)
    rank, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in order[i:j]:
            rank[k] = (i + j + 1) / 2
        i = j
    n = sum(truth)
    return (sum(r for r, y in zip(rank, truth, strict=True) if y) - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_toxicity_on_given_labels(spark):
    """Held-out documents of a table that no setting was chosen by. The floor was fixed beforehand, by cross-validation among the documents that may be learned from (0.741)."""
    given = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")
    got = op3_toxicity(spark, given).where("held_out").join(spark.read.parquet(f"{given}/labels.parquet").where("toxic in (0, 1)"), "doc_id").collect()
    assert area([r["score"] for r in got], [r["toxic"] for r in got]) > 0.7
    assert area([0.1, 0.2, 0.2, 0.9], [0, 0, 1, 1]) == 0.875
