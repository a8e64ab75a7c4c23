"""Texts that collide under polynomial hashes modulo 2 ** 64, whatever the base: a Thue-Morse word and its complement."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagegrain.llm import binary, bpe, language_model, minhash, quality, substrings, tiling, tokens, words
from pagegrain.llm.queries import BYTE_BPE
from pagegrain.llm.shared import new_columns, qualified, settings, shared_dir, spread_join
from pagegrain.llm.words import NOT_ALPHANUMERIC, Texts, span_codes

DOC = "doc_id long, text string"


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 1024, 2048)]


def texts_of(*texts):
    raw = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@pytest.mark.parametrize("pair", PAIRS)
def test_words(pair):
    t = texts_of(*pair, pair[0])
    low, high = t.codes
    assert (low[0], high[0]) == (low[2], high[2]) != (low[1], high[1])
    assert t.numbers().tolist() in ([0, 1, 0], [1, 0, 1])
    words = [" ".join("yx"[c == "a"] for c in w) for w in pair]
    t = texts_of(*words)
    n = len(pair[0])
    for lane in (0, 1):
        a, b = t.ranges(np.array([0, n]), np.array([n, 2 * n]), lane).tolist()
        assert a != b
        assert len(set(t.windows(n, lane)[0][[0, n]].tolist())) == 2


def test_codes_are_the_bytes():
    data = np.frombuffer(b"abc\0\0abc" + bytes(range(200, 230)), np.uint8)
    starts, ends = np.array([0, 0, 0, 5, 8, 8, 8]), np.array([3, 4, 5, 8, 23, 24, 24])
    codes = list(zip(*(x.tolist() for x in span_codes(data, starts, ends)), strict=True))
    assert codes[0] == codes[3] and codes[5] == codes[6]
    assert len({*codes}) == 5


def test_numbers_of_one_hash():
    """Words whose 64-bit hashes are equal still get numbers of their own."""
    t = texts_of("a b a c b a")
    t._lanes[0] = np.zeros(6, np.uint64)
    n = t.numbers().tolist()
    assert n[0] == n[2] == n[5] and n[1] == n[4] and len(set(n)) == 3


@pytest.mark.parametrize("make", [bpe.worker_encoder, bpe.library_encoder])
def test_ids(make):
    library = Tokenizer.from_file(BYTE_BPE)
    encoder = make(BYTE_BPE)
    for pair in PAIRS:
        for t, ids in zip(pair, encoder.encode_texts(list(pair)), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
            assert encoder.v.decode(ids.tolist()) == t


def test_token_rows_and_files(spark):
    rows = [(i, t) for i, t in enumerate(x for p in PAIRS for x in p)]
    df = spark.createDataFrame(rows, DOC)
    digests = {hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    assert {r["decoded_sha256"] for r in tokens.encode(df, BYTE_BPE, digests=True).collect()} == digests
    folder = shared_dir(spark)
    assert len({r["ids_crc32"] for r in binary.read(spark, folder, binary.write(df, folder, BYTE_BPE)).collect()}) == 6


def test_windows_are_told_apart(spark):
    for a, b in PAIRS:
        rows = [(1, " ".join([*(f"w{i}" for i in range(25)), a, *(f"v{i}" for i in range(24))])), (2, " ".join([*(f"w{i}" for i in range(25)), b, *(f"v{i}" for i in range(24))]))]
        assert [r["n_removed"] for r in substrings.dedup(spark.createDataFrame(rows, DOC)).collect()] == [0, 0]
    spelt = [(i, " ".join("yx"[c == "a"] for c in t)) for i, t in enumerate(PAIRS[1])]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(spark.createDataFrame(spelt, DOC), k=1024).collect()}
    assert got == {0: 0, 1: 0}


def test_sets_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(x for p in PAIRS for x in p)]
    assert all(r["kept"] for r in minhash.components(spark.createDataFrame(rows, DOC)).collect())


def test_lines_and_counts(spark):
    a, b = PAIRS[1]
    df = spark.createDataFrame([(1, f"{a}\n{b}\n{a}")], DOC)
    assert [(r["n_dup_lines"], r["longest_repeat"]) for r in quality.rate(df).collect()] == [(1, 1)]
    scored = {r["doc_id"]: r["n_known"] for r in language_model.score(spark.createDataFrame([(1, a), (3, a), (5, b)], DOC)).collect()}
    assert scored == {1: 2, 3: 2, 5: 2}
    totals = language_model.counted(_block(a, a, b), 1)
    assert sorted(totals.c.tolist()) == [1, 2, 3]


def _block(*texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": list(texts), "training": [True] * len(texts)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def test_counts_are_wide():
    k = language_model.Keys(np.array([5, 5], np.uint64), None)
    assert language_model.summed(k, np.array([3_000_000_000, 3_000_000_000])).c.tolist() == [6_000_000_000]
    big = np.array([6_000_000_000, 1 << 40], np.uint64)
    assert language_model.unpacked(language_model.packed(big, big), 2)[1].tolist() == big.tolist()


def test_items_are_told_apart(spark):
    for a, b in PAIRS:
        items = spark.createDataFrame([(1, f"one two {a} three four five")], "item_id long, text string")
        docs = spark.createDataFrame([(1, f"one two {b} three four five")], DOC)
        assert tiling.leaks(docs, items).count() == 0


def test_scripts_without_spaces():
    raw = "日本語 text ไทย x漢a b".encode()
    t = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), space=NOT_ALPHANUMERIC, alone=True)
    assert [w.decode() for w in t.words()] == ["日", "本", "語", "text", "ไ", "ท", "ย", "x", "漢", "a", "b"]


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    minhash.components(spark.createDataFrame([(1, "a")], DOC)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_folders_get_their_scheme(spark, tmp_path):
    assert qualified(spark, "hdfs://name/folder") == "hdfs://name/folder"
    assert qualified(spark, str(tmp_path / "plain")) == f"file://{tmp_path / 'plain'}"
    assert shared_dir(spark).startswith("file:")


def test_files_that_do_not_arrive(spark, monkeypatch):
    """Workers write to a folder that the driver doesn't see: here, the driver's own list of files is one short."""
    from pagegrain.llm import shared

    kind = type(spark.range(1))
    real = kind.inputFiles
    monkeypatch.setattr(kind, "inputFiles", lambda self: real(self)[1:])
    with pytest.raises(RuntimeError, match="isn't shared"):
        shared.written(spark.range(10).repartition(3))


def test_spread_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 2500)], "k long, v long")
    small = spark.createDataFrame([(1, "x", 3000)] + [(i, "y", 1) for i in range(2, 2400)], "k long, name string, n long")
    got = spread_join(rows, small, ["k"], "n")
    assert got.count() == 3000 + 2398
    assert {tuple(r) for r in got.select("k", "name").distinct().collect() if r["k"] < 4} == {(1, "x"), (2, "y"), (3, "y")}


def test_names_that_clash():
    with pytest.raises(ValueError, match="n_words"):
        new_columns(("doc_id", "N_words"), ["n_words"])


def unmixed(x):
    """The inverse of words.mix."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        y = x
        for _ in range(64 // shift + 1):
            y = x ^ (y >> np.uint64(shift))
        x = y * np.uint64(pow(factor, -1, 1 << 64))
    return x


def same_lane(word, rng, tries=200_000):
    """Another word of 15 printable bytes with the same hash in lane 0, by solving for its first eight."""
    target = (unmixed(texts_of(word).lane(0)) - words._SIZE[0])[0]
    tail = rng.integers(0x61, 0x7B, (tries, 7), np.uint8)
    padded = np.concatenate([tail, np.full((tries, 1), 15, np.uint8)], 1)
    high = np.ascontiguousarray(padded).view("<u8").ravel()
    left = (target - words.mix(high + words._LEFT[0]) * words._RIGHT[0]) * np.uint64(pow(int(words._LEFT[0]), -1, 1 << 64))
    low = unmixed(left) - words._SIZE[0]
    raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)
    good = ((raw > 0x20) & (raw < 0x7F) & ((raw < 0x41) | (raw > 0x5A))).all(1)
    return [bytes(a).decode() + bytes(b).decode() for a, b in zip(raw[good], tail[good], strict=True)]


def test_words_of_one_lane_are_not_linked(spark):
    """Shingles that agree in a 64-bit hash alone are different."""
    rng = np.random.default_rng(6)
    pairs = [("abcdefghijklmno", "'p(s)v?ff)07h37"), *(("abcdefghijklmno", w) for w in same_lane("abcdefghijklmno", rng)), *(("zyxwvutsrqponml", w) for w in same_lane("zyxwvutsrqponml", rng))]
    assert len(pairs) > 5
    rows = []
    for a, b in pairs:
        assert texts_of(a).lane(0)[0] == texts_of(b).lane(0)[0]
        rows += [(len(rows) + i, f"{w} one two three four") for i, w in enumerate((a, b))]
        long = [f"{len(rows)}w{i} {w} x{i} y{i} z{i}" for w in (a, b) for i in range(12)]
        rows += [(len(rows), " ".join(long[:12])), (len(rows) + 1, " ".join(long[12:]))]
    first = {}
    for doc_id, text in rows:
        first.setdefault(text, doc_id)
    got = {r["doc_id"]: r["component_id"] for r in minhash.components(spark.createDataFrame(rows, DOC), percent=85).collect()}
    assert got == {doc_id: first[text] for doc_id, text in rows}
    pair = spark.createDataFrame([(0, 1), (2, 3)], "x long, y long")
    assert minhash.linked(pair, spark.createDataFrame(rows, "rep long, text string"), 1).count() == 0


def test_shingles_of_one_hash(monkeypatch):
    """Shingles are told apart by their words even if all hashes are equal."""
    monkeypatch.setattr(Texts, "windows", lambda self, k, which=0, real=Texts.windows: (np.zeros_like(real(self, k, which)[0]), real(self, k, which)[1]))
    t = texts_of("a b c d e f a b c d e", "b c d e f a", "a b c d e a b c d e", "x y", "y x", "x y", "")
    numbers, first = minhash.sets(t)
    got = [set(numbers[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(g) for g in got] == [6, 2, 5, 1, 1, 1, 0]
    assert got[3] == got[5] != got[4]
    assert len(got[0] & got[1]) == 2 and len(got[0] & got[2]) == 1
