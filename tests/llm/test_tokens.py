import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagegrain.llm import binary, bpe, tokens
from pagegrain.llm.queries import BYTE_BPE
from pagegrain.llm.shared import shared_dir

DOC = "doc_id long, text string"
ODD = ["", " ", "  a  b ", "a\n b\t", "<|endoftext|>x <|endoftext|>", "it's I'LL we'll", "é ß 😀 一二", "x" * 5000, "ab" * 3000 + " c", "\x1c\x85 a", " 　 b", "1½²", "don''t", "'s", "a b c"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100).collect()]


@pytest.mark.parametrize("make", [bpe.worker_encoder, bpe.library_encoder])
def test_ids_as_the_library(make, library, texts):
    encoder = make(BYTE_BPE)
    encoder.clear()
    for t, ids in zip(texts, encoder.encode_texts(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert encoder.v.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_random_strings(library):
    rng = random.Random(1)
    bits = ["a", "the", "ing", " ", "  ", "\n", "'s", "é", "<|endoftext|>", "\x1c", "\x85", " ", "1", "½", "一", "́", "....", "\t", "😀", "'LL", "_", "​"]
    strings = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    own = bpe.worker_encoder(BYTE_BPE).encode_texts(strings)
    assert [x.tolist() for x in own] == [library.encode(s, add_special_tokens=False).ids for s in strings]


def test_every_character(library):
    strings = [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    own = bpe.worker_encoder(BYTE_BPE).encode_texts(strings)
    assert [x.tolist() for x in own] == [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]


def test_pair_check_equals_exact_merging():
    """A pair is compatible if and only if merging its bytes gives it back."""
    v = bpe.worker_encoder(BYTE_BPE).v
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 50000, 4000)
    expected = [v.merged_long(np.frombuffer(v.pieces[x] + v.pieces[y], np.uint8)) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert v.compatible(a, b).tolist() == expected
    assert 50 < sum(expected) < 3950  # both kinds are there


def test_greedy_fails_and_is_mended(library):
    v = bpe.worker_encoder(BYTE_BPE).v
    words = [f" {w}".encode() for w in ("thntreon", "ererat", "onblehe", "achlich")]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    greedy, of = v.greedy(data, ends - [len(w) for w in words], ends)
    exact, counts = v.encode_words(data, ends - [len(w) for w in words], ends)
    assert greedy.tolist() != exact.tolist()
    assert exact.tolist() == [i for w in words for i in library.encode(w.decode(), add_special_tokens=False).ids]
    assert counts.sum() == exact.size and of.max() == 3


def test_cache_is_bounded():
    encoder = bpe.Encoder(bpe.worker_encoder(BYTE_BPE).v, cache_pieces=50)
    for i in range(20):
        encoder.encode_texts([f"w{i}x{j} y" for j in range(10)])
        assert encoder.cache.size < 80


def test_encode_rows(spark, library):
    rows = [(1, t) for t in ODD] + [(None, None), (2, "a"), (2, "a")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{DOC}, n_tokens int, ids string")
    out = tokens.encode(df, BYTE_BPE, digests=True).collect()
    for (d, t), r in zip(rows, out, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) == (d, len(ids), ids, t or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert tokens.encode(df.limit(0), BYTE_BPE).count() == 0


def test_files_round_trip(spark, library, texts):
    rng = random.Random(4)
    rows = [(rng.choice((7, 7, i)), t) for i, t in enumerate(texts)] + [(None, None), (-5, "z")]
    folder = shared_dir(spark)
    shards = binary.write(spark.createDataFrame([(*r, 1) for r in rows], f"{DOC}, start int").repartition(5), folder, BYTE_BPE)
    assert len(shards) > 1
    got = binary.read(spark, folder, shards).orderBy("start", "n_tokens").collect()
    expected, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert [tuple(r) for r in got] == expected
    again = binary.write(spark.createDataFrame(rows, DOC), folder, BYTE_BPE)  # files are there already: they stay whole
    assert sum(s["n_ids"] for s in again) == at


def test_files_of_nothing(spark):
    folder = shared_dir(spark)
    assert binary.write(spark.createDataFrame([], DOC), folder, BYTE_BPE) == []
    assert binary.read(spark, folder, []).count() == 0


def test_starts_follow_one_another(spark, sf_dir):
    from pagegrain.llm.queries import op9_token_files

    rows = op9_token_files(spark, sf_dir).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
