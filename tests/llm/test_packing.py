import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegrain.llm import packing
from pagegrain.llm.queries import WORD_BPE, op13_best_fit_packing
from pagegrain.llm.word_tokens import WordEncoder

ODD = [None, "", " \n", "Hello  World", "a b　c", "Σας ΟΔΟΣ", "é é ́x", "<|endoftext|>x a<|startoftext|> b", "it's I'LL'D", "\x1c\x85 a", "İ ﬁ ½", "x" * 3000, "word " * 40, "​ b", "1234 5.6", "don''t 's"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def one_by_one(lengths, room):
    """Sequences that best fit, the longest first, takes."""
    rooms, n = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect_left(rooms, size)
        left = rooms.pop(i) if i < len(rooms) else room
        n += left == room
        insort(rooms, left - size)
    return n


def check_places(rows, room):
    """No gap, no overlap, no longer than room, all numbers from 0; returns how many sequences there are."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= room
    assert sorted(by) == list(range(len(by)))
    return len(by)


def check_pieces(rows, texts, library, room, end_id):
    """Every document's pieces hold its ids; texts: (doc_id, text) with ids of their own."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        parts = sorted(by.pop(doc_id), key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), room))
        for r in parts:
            own = np.array(ids[r["start"] : r["start"] + room], "<u4")
            assert (r["length"], r["ids_crc32"]) == (own.size, zlib.crc32(own.tobytes()))
            assert "ids" not in r or r["ids"] == own.tolist()
    assert not by


def test_words_as_the_library(library):
    encoder, rng = WordEncoder(WORD_BPE), random.Random(1)
    bits = ["a", "the", "ing", " ", "  ", "\n", "'s", "é", "É", "<|endoftext|>", "\x1c", "\x85", " ", "1", "½", "一", "́", "....", "\t", "😀", "'LL", "_", "​", "Σ", "İ", "ﬁ", "가", "ᄀ", "ᅡ"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    expected = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode_texts(texts)] == expected
    assert [x.tolist() for x in encoder.encode_texts(texts)] == expected  # from the cache


def test_word_cache_is_bounded():
    encoder = WordEncoder(WORD_BPE, cache_pieces=50)
    for i in range(20):
        assert [x.size for x in encoder.encode_texts([f"w{i}x{j} y" for j in range(10)])]
        assert encoder.cache.size < 80


def test_plan_is_best_fit():
    rng = random.Random(4)
    for _ in range(400):
        room = rng.choice([1, 5, 10, 64, 100])
        lengths = [rng.randint(1, rng.choice([room, 1 + room // 3])) for _ in range(rng.randint(1, 200))]
        planned, seen, rank = packing.plan(Counter(lengths), room), Counter(), []
        for size in lengths:
            rank.append(seen[size])
            seen[size] += 1
        sequence, offset = packing.slots(planned, np.array(lengths), np.array(rank))
        rows = [{"sequence_id": s, "offset": o, "length": n} for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths, strict=True)]
        assert check_places(rows, room) == one_by_one(lengths, room)


def test_plan_does_not_grow_with_the_documents():
    rng = random.Random(9)
    counts = {size: rng.randint(1, 30) for size in range(1, 513)}
    sizes = [len(packing.plan({k: n * times for k, n in counts.items()}, 512)) for times in (1, 1000, 10**9)]
    assert max(sizes) <= 4 * 512 * 10 and sizes[2] < 2 * sizes[0]
    assert len(packing.plan({}, 512)) == 0


def test_odd_texts_and_sequences(spark, library):
    texts = [(i, t) for i, t in enumerate(ODD * 3)] + [(1000 + i, "tick tock " * i) for i in range(40)]
    df = spark.createDataFrame([(*t, "x", 5) for t in texts], "doc_id long, text string, offset string, length int").repartition(5)
    got = packing.pack(df, WORD_BPE, room=16, end_id=1, ids=True)
    rows = [r.asDict() for r in got.collect()]
    check_pieces(rows, texts, library, 16, 1)
    assert check_places(rows, 16) == one_by_one([r["length"] for r in rows], 16)
    made = packing.sequences(got).collect()
    own = {(r["doc_id"], r["piece"]): r["ids"] for r in rows}
    for s in made:
        assert s["n_tokens"] == len(s["ids"]) <= 16
        assert s["ids"] == [i for p in s["parts"] for i in own[p["doc_id"], p["piece"]]]
    assert sum(len(s["parts"]) for s in made) == len(rows)


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)] * 30, "doc_id long, text string")
    rows = [r.asDict() for r in packing.pack(df, WORD_BPE, room=3).collect()]
    assert Counter((r["doc_id"], r["length"]) for r in rows) == {(1, 3): 60, (None, 2): 30, (None, 1): 30}
    assert check_places(rows, 3) == 90
    assert packing.pack(df.limit(0), WORD_BPE).count() == 0
    assert packing.pack(df.where("text is null"), WORD_BPE, end_id=None).count() == 0
    with pytest.raises(ValueError, match="offset"):
        packing.pack(df.withColumn("offset", F.lit(1)), WORD_BPE, keep=("offset",))
    with pytest.raises(ValueError, match="room"):
        packing.pack(df, WORD_BPE, room=0)


def test_ranks_stay_when_partitions_are_many(spark):
    """One length holds nearly all rows, over many tasks."""
    df = spark.range(5000, numPartitions=40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "a b c").otherwise("d").alias("text"))
    rows = [r.asDict() for r in packing.pack(df, WORD_BPE, room=10).collect()]
    assert check_places(rows, 10) == one_by_one([r["length"] for r in rows], 10)


def test_query_as_brute_force(spark, sf_dir, library):
    got = op13_best_fit_packing(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = [r.asDict() for r in got.collect()]
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(rows, texts, library, 4096, 1)
    assert check_places(rows, 4096) == one_by_one([r["length"] for r in rows], 4096)
