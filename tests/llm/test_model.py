"""The language model against the same one in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import language_model as lm

DOC = "doc_id long, text string"


def plain_model(rows, held, order):
    """Scores by dictionaries; weights learned as the operator does it, on its grid."""
    training = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    texts = [(t or "").lower().split() + ["</s>"] for _, t in rows]
    counts = {x: [Counter() for _ in range(order)] for x in ("all", "main")}
    docs, n = Counter(), Counter()

    def grams(tokens, i, k):
        return (*["<s>"] * max(0, k - i - 1), *tokens[max(0, i - k + 1) : i + 1])

    for (d, _), tokens, is_training in zip(rows, texts, training, strict=True):
        for kind in ("all", "main") if is_training else ():
            if kind == "main" and d in held:
                continue
            docs[kind] += 1
            n[kind] += len(tokens)
            for i in range(len(tokens)):
                for k in range(1, order + 1):
                    counts[kind][k - 1][grams(tokens, i, k)] += 1
    types = len(counts["all"][0])
    uniform = 1 / (types + 1)

    def estimates(tokens, i, kind):
        out = []
        for k in range(1, order + 1):
            g = grams(tokens, i, k)
            context = n[kind] if k == 1 else docs[kind] if i == 0 else counts[kind][k - 2][g[:-1]]
            out.append((counts[kind][k - 1][g] / context if context else 0.0, 1 if k == 1 else context.bit_length() if context else 0))
        return out

    def probability(found, shares):
        p = uniform
        for (f, b), share in zip(found, shares, strict=False):
            p = share[b] * f + (1 - share[b]) * p
        return p

    def rounded(p):
        return 10.0 ** (-round(-math.log10(max(p, 1e-14)) * lm.GRID) / lm.GRID) if p > 0 else 0.0

    own = [estimates(tokens, i, "main") for (d, _), tokens, is_training in zip(rows, texts, training, strict=True) if is_training and d in held for i in range(len(tokens))]
    single = [[tuple((float(np.float32(f)), b) for f, b in e) for e in own]][0]
    shares = []
    for k in range(order):
        cells = Counter((e[k][1], rounded(e[k][0]), rounded(probability(e, shares)) if k else 0) for e in single)
        table = np.array([[b, f, *([low] if k else []), c] for (b, f, low), c in cells.items()], float).reshape(-1, 4 if k else 3)
        w = lm.mixture(table, 0.0 if k else uniform)
        shares.append(w[:, 0] / (w[:, 0] + w[:, 1]))
    return [sum(math.log10(probability(estimates(tokens, i, "all"), shares)) for i in range(len(tokens))) for tokens in texts], n["all"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_plain_python(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(("a b", "A c", "d e f", "d e g", f"u{rng.randint(0, 30)}")) for _ in range(rng.randint(0, 30)))) for i in range(250)]
    rows += [(1, rows[1][1]), (5, None), (6, ""), (None, "a b")]
    df = spark.createDataFrame(rows, DOC)
    held = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(lm.HELD)) == 0).collect()}
    expected, n = plain_model(rows, held, order)
    for size in (1 << 20, 800):
        got = lm.score(df, order=order, block_bytes=size, range_bytes=3000).collect()
        assert {r["train_tokens"] for r in got} == {n}
        key = lambda x: (str(x[0]), x[1])
        pairs = zip(sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(((d, x) for (d, _), x in zip(rows, expected, strict=True)), key=key), strict=True)
        for (d, a), (e, b) in pairs:
            assert d == e and abs(a - b) < 2e-3 * max(1.0, abs(b))
