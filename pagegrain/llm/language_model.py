"""An n-gram language model with deleted interpolation.

The probability of a token after a context mixes the maximum-likelihood estimate of that n-gram with the probability after the context
shortened by one word, down to single words, which are mixed with a uniform estimate. The mixtures depend on how often the context
was seen, in buckets of doubling width, and are learned by expectation-maximisation, order by order, on counts of
held-out training documents that the mixed estimates leave out.

Counts are of all training documents. There are no rows by the token: each task deals its documents to blocks of bounded size, held-out
ones apart, and a block is one row from then on. A block counts its own n-grams; only their distinct keys travel,
sorted and packed by ranges of keys, to where all blocks' counts are summed. What goes back to a block are the sums alone, in the
order of its own keys, which it finds again by counting its documents again.

A range is as large as a task can sum, so ranges grow in number with the corpus, as blocks do. Packs that would be empty
aren't sent: their number is that of blocks times ranges while a block has many keys for each, and never more than that of keys. Raise
``block_bytes`` and ``range_bytes`` with the memory of the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, written
from .words import Texts, joined, slices, utf8

_U = np.uint64
END, BEGIN = (_U(0x5851F42D4C957F2D), _U(0x2545F4914F6CDD1D)), _U(0x14057B7EF767814F)
HELD = 10  # one training document in so many is held out for the mixtures
BUCKETS = 40
FLOOR = 1e-6
GRID = 8  # steps a decade by which held-out probabilities are summed up for a mixture
LEVELS = 14 * GRID + 2  # at most BUCKETS * LEVELS ** 2 sums go to the driver
FIGURES = ("types", "n_train", "n_held", "docs_train", "docs_held")


class Keys(NamedTuple):
    """Keys of n-grams: 64 bits with the lowest 0, and for single words 128 that tell words apart for certain."""

    key: np.ndarray
    more: np.ndarray | None


class Events:
    """The tokens of some documents: each document's words and one end, with the keys of the n-grams that end there."""

    def __init__(self, t: Texts, order: int) -> None:
        n = t.doc.size + t.n
        self.first = t.first + np.arange(t.n + 1)
        self.counts = np.diff(self.first)
        is_end = np.zeros(n, bool)
        is_end[self.first[1:] - 1] = True
        token, more = np.empty(n, _U), np.empty(n, _U)
        for lane, out in enumerate((token, more)):
            out[~is_end], out[is_end] = t.lane(lane), END[lane]
        self.grams = [Keys(token, more)]
        begin = BEGIN
        for _ in range(order - 1):
            self.grams.append(Keys(joined(self.behind(self.grams[-1].key, begin), token) & ~_U(1), None))
            begin = joined(np.array([begin]), np.array([BEGIN]))[0]

    def behind(self, values: np.ndarray, first: int | np.ndarray) -> np.ndarray:
        """The values of the token before; ``first`` for a document's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first[:-1]] = first
        return out


class Counts(NamedTuple):
    """Distinct keys, ascending, with counts."""

    key: np.ndarray
    more: np.ndarray | None
    c: np.ndarray
    d: np.ndarray


def summed(k: Keys, c: np.ndarray, d: np.ndarray | None = None) -> Counts:
    """Counts by key, ascending. Without d, it is 0."""
    order = np.argsort(k.key)
    key = k.key[order]
    new = np.append(True, key[1:] != key[:-1])[: key.size]
    more = None
    if k.more is not None:
        more = k.more[order]
        if ((more[1:] != more[:-1]) & ~new[1:]).any():  # two words of one key
            order = np.lexsort((k.more, k.key))
            key, more = k.key[order], k.more[order]
        new[1:] |= more[1:] != more[:-1]
    starts = np.flatnonzero(new)
    total = [np.add.reduceat(x[order], starts) if starts.size and x is not None else np.zeros(starts.size, np.int64) for x in (c, d)]
    return Counts(key[starts], None if more is None else more[starts], *total)


def merged(parts: list[Counts]) -> Counts:
    key, c, d = (np.concatenate([getattr(p, x) for p in parts]) for x in ("key", "c", "d"))
    return summed(Keys(key, None if parts[0].more is None else np.concatenate([p.more for p in parts])), c, d)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, so that their zeros lie together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(values.size, -1).T.tobytes() if values.size else b""


def packed(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(planes(x.astype("<u8", copy=False)) for x in columns), 1)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    """``n`` columns of 64-bit numbers."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw]


def dealt(block_bytes: int):
    """Rows of blocks: block, held, size of the texts, and the documents as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        sizes, made = {False: 0, True: 0}, 0

        def block(held: bool) -> pa.RecordBatch:
            nonlocal made
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[held][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in waiting[held]:
                    out.write_batch(b)
            number = TaskContext.get().partitionId() << 32 | made
            row = [pa.array([number], pa.int64()), pa.array([held]), pa.array([sizes[held]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            waiting[held], sizes[held], made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(row, names=["block", "held", "size", "data"])

        for batch in batches:
            for part in slices(batch, size=block_bytes):
                for held in (False, True):
                    own = part.filter(pa.compute.equal(part.column("held"), held)).drop_columns(["held"])
                    if own.num_rows:
                        waiting[held].append(own)
                        sizes[held] += int(utf8(own.column("text"))[1][-1]) + own.num_rows
                    if sizes[held] >= block_bytes:
                        yield block(held)
        for held in (False, True):
            if waiting[held]:
                yield block(held)

    return run


def documents(data: bytes) -> Iterator[pa.RecordBatch]:
    """A block's documents, a slice at a time."""
    for batch in pa.ipc.open_stream(data):
        yield from slices(batch)


def counted(data: bytes, n: int) -> Counts:
    """A block's own counts of n-grams in training documents.

    Words are few and are summed slice by slice. Of longer n-grams, all keys are sorted together, their lowest bit saying whether the document is a training one.
    """
    words: list[Counts] = []
    grams: list[np.ndarray] = []
    for part in documents(data):
        e = Events(Texts(*utf8(part.column("text")), lower=True), n)
        c = np.repeat(part.column("training").to_numpy(zero_copy_only=False).astype(np.int64), e.counts)
        if n > 1:
            grams.append(e.grams[-1].key | c.astype(_U))
            continue
        words.append(summed(e.grams[0], c))
        if len(words) == 8:
            words = [merged(words)]
    if n == 1:
        return merged(words)
    every = np.concatenate(grams)
    grams.clear()
    every.sort()
    key = every & ~_U(1)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return Counts(key[starts], None, np.add.reduceat((every & _U(1)).astype(np.int64), starts), np.zeros(starts.size, np.int64))


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one for each doubling."""
    return np.where(context_count > 0, np.minimum(np.frexp(np.maximum(context_count, 1).astype(float))[1], BUCKETS - 1), 0)


def mixture(cells: np.ndarray, uniform: float, turns: int = 60) -> np.ndarray:
    """Weights (each estimate, uniform) by bucket, by expectation-maximisation.

    cells: rows of (bucket, estimates, held-out tokens). Buckets without tokens get the weights of all.
    """
    k = cells.shape[1] - 1
    weights = np.full((BUCKETS + 1, k), 1 / k)
    for b in range(BUCKETS + 1):
        own = cells if b == BUCKETS else cells[cells[:, 0] == b]
        if not len(own):
            continue
        p = np.column_stack([own[:, 1:-1], np.full(len(own), uniform)])
        for _ in range(turns):
            share = p * weights[b]
            total = share.sum(axis=1, keepdims=True)
            weights[b] = (share / np.maximum(total, 1e-300) * own[:, -1:]).sum(axis=0) / own[:, -1].sum()
    for b in range(BUCKETS):
        if not (cells[:, 0] == b).any():
            weights[b] = weights[BUCKETS]
    weights[0, 1:] += weights[0, 0] / (k - 1)
    weights[0, 0] = 0
    weights = np.maximum(weights, [0, *[FLOOR] * (k - 1)])
    return (weights / weights.sum(axis=1, keepdims=True))[:BUCKETS]


def mixed(f: list[np.ndarray], b: list[np.ndarray], shares: list[np.ndarray], uniform: float) -> np.ndarray:
    """Probabilities: of each order's estimates f, the share by bucket b, the rest of the order below."""
    p = np.full(f[0].size, uniform)
    for estimate, own, share in zip(f, b, shares, strict=False):
        p = share[own] * estimate + (1 - share[own]) * p
    return p


def steps_of(p: np.ndarray) -> np.ndarray:
    """Probabilities on the grid: 0 for 0, else 1 and on."""
    return np.where(p > 0, np.minimum(1 + np.round(-np.log10(np.maximum(p, 1e-14)) * GRID), LEVELS - 1), 0).astype(np.int64)


def value_of(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 10.0 ** (-(step - 1) / GRID), 0.0)


def places(every: Counts, own: Counts) -> np.ndarray:
    """Where a block's keys are among all of a range."""
    found = np.searchsorted(every.key, own.key)
    if own.more is not None:
        while (other := np.flatnonzero(every.more[found] != own.more)).size:
            found[other] += 1
    return found


class Block:
    """A block's documents with what came back for its keys: of each order, every token's count in training documents, without held-out ones if ``main``."""

    def __init__(self, data: bytes, back: pa.Table, order: int, main: bool) -> None:
        self.parts, self.events = [], []
        for part in documents(data):
            e = Events(Texts(*utf8(part.column("text")), lower=True), order)
            self.parts.append(part.drop_columns(["text"]))
            self.events.append(e)
        self.bounds = np.cumsum([0, *(e.first[-1] for e in self.events)])
        self.c = []
        for i in range(order):
            place, n = self.place([e.grams[i] for e in self.events])
            got = [np.zeros(0, np.int64)]
            for blob in back.filter(pa.compute.equal(back.column("n"), i + 1)).sort_by("part").column("pack").to_pylist():
                c, d = unpacked(blob, 2)
                got.append((c - d if main else c).view(np.int64))
            sums = np.concatenate(got)
            if sums.size != n:
                raise ValueError("counts have come back for other keys than the block's own")
            self.c.append(sums[place])
            del got, sums, place
            for e in self.events:
                e.grams[i] = None

    @staticmethod
    def place(grams: list[Keys]) -> tuple[np.ndarray, int]:
        """Of each token, the place of its n-gram among the block's distinct ones in order; and how many there are."""
        key = np.concatenate([g.key for g in grams])
        order = np.argsort(key)
        new = np.append(False, key[order][1:] != key[order][:-1])
        if grams[0].more is not None:
            more = np.concatenate([g.more for g in grams])
            if (~new[1:] & (more[order][1:] != more[order][:-1])).any():
                order = np.lexsort((more, key))
                new = np.append(False, (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1]))
        number = np.cumsum(new)
        out = np.empty(key.size, np.int32)
        out[order] = number
        return out, int(number[-1]) + 1

    def __iter__(self) -> Iterator[tuple[pa.RecordBatch, Events, list[np.ndarray]]]:
        for part, e, a, b in zip(self.parts, self.events, self.bounds[:-1], self.bounds[1:], strict=True):
            yield part, e, [c[a:b] for c in self.c]


def score(df: DataFrame, text: str = "text", folds: int = 7, held_fold: int = 2, block_bytes: int = 4 << 20, order: int = 2, range_bytes: int = 4 << 20) -> DataFrame:
    """Score every whole text by a model of those whose crc32 of doc_id, modulo ``folds``, isn't ``held_fold``.

    Tokens are words in lower case (A-Z) and one end. Columns: doc_id, held_out, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (add-one unigrams) and score (the interpolated model of up to ``order`` words), both sums
    of log10 over the tokens.

    Null and empty texts are one end. Rows with a null doc_id are scored, but neither trained on nor held out. Repeated rows count
    and are scored each. Without training documents all counts are 0. Columns other than doc_id and text are dropped. Texts are read
    whole; a text longer than ``block_bytes`` is a block by itself, and its worker holds some 20 numbers a word of it.

    Words are told apart by 128 bits, from their own bytes up; longer n-grams are counted by 64-bit hashes of words so told apart.
    Counts are 64 bits wide. range_bytes: of texts, for each range of keys.
    """
    spark = df.sparkSession
    docs = df.select(df["doc_id"].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    in_fold = fold(docs["doc_id"], folds)
    docs = docs.withColumn("held_out", F.coalesce(in_fold == held_fold, F.lit(False))).withColumn("training", F.coalesce(in_fold != held_fold, F.lit(False)))
    docs = docs.withColumn("held", F.col("training") & (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(HELD)) == 0))
    blocks = written(docs, dealt(block_bytes), "block long, held boolean, size long, data binary")
    size = blocks.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    parts = max(1, -(-(size["bytes"] or 0) // range_bytes))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size["n"] // 2)
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(_U)

    def count(n: int):
        """Packs of each block's keys and counts of n-grams, by range."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, held, data in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "data")), strict=True):
                    x = counted(data, n)
                    cut = np.concatenate([[0], np.searchsorted(x.key, edges), [x.key.size]])
                    used = np.flatnonzero(np.diff(cut))
                    blobs = []
                    for a, b in zip(cut[used].tolist(), cut[used + 1].tolist(), strict=True):
                        key = np.diff(x.key[a:b], prepend=_U(0))
                        blobs.append(packed(key, x.c[a:b]) if x.more is None else packed(key, x.c[a:b], x.more[a:b]))
                    same = [pa.array(used, pa.int32()), pa.array([block] * used.size, pa.int64()), pa.array([held] * used.size, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(blobs, pa.binary())], names=["part", "block", "held", "pack"])

        return run

    def total(n: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            """Sums of one range of keys: for each block those of its own keys, in their order, and the number of trained words."""
            own, figures = [], [0] * 5
            for is_held, blob in zip(table.column("held").to_pylist(), table.column("pack").to_pylist(), strict=True):
                step, c, *more = unpacked(blob, 2 if n > 1 else 3)
                c = c.view(np.int64)
                own.append(Counts(np.cumsum(step, dtype=_U), more[0] if more else None, c, c if is_held else np.zeros_like(c)))
            every = merged(own)
            if n == 1:
                end = np.flatnonzero((every.key == END[0]) & (every.more == END[1]))
                figures = [int(x) for x in ((every.c > 0).sum(), every.c.sum(), every.d.sum(), every.c[end].sum(), every.d[end].sum())]
            at = (places(every, x) for x in own)
            back = pa.array([packed(every.c[k].view(np.uint64), every.d[k].view(np.uint64)) for k in at], pa.binary())
            rows = {"block": table.column("block"), "part": pa.array([key[0].as_py()] * table.num_rows, pa.int32()), "n": pa.array([n] * table.num_rows, pa.int32()), "pack": back}
            return pa.table({**rows, **{f: pa.array([x] + [0] * (table.num_rows - 1), pa.int64()) for f, x in zip(FIGURES, figures, strict=True)}})

        return run

    back = None
    for n in range(1, order + 1):  # one after the other, so that only one order's keys are on the way
        counts = blocks.select("block", "held", "data").mapInArrow(count(n), "part int, block long, held boolean, pack binary").repartition(parts, "part")
        sums = written(counts.groupBy("part").applyInArrow(total(n), "block long, part int, n int, pack binary" + "".join(f", {f} long" for f in FIGURES)))
        if n == 1:
            types, n_train, n_held, docs_train, docs_held = (x or 0 for x in sums.agg(*(F.sum(f) for f in FIGURES)).first())
        sums = sums.select("block", "part", "n", "pack")
        back = sums if back is None else back.unionByName(sums)
    uniform = 1 / (types + 1)

    def estimates(e: Events, c: list[np.ndarray], main: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each token, by order: its estimate and its context's bucket; with main, held-out counts have been left out."""
        f, b = [], []
        for i in range(order):
            own = c[i]
            if i:
                context = e.behind(above, docs_train - docs_held if main else docs_train)
            else:
                context = np.full(own.size, n_train - n_held if main else n_train)
            b.append(bucket(context) if i else np.ones(own.size, np.int64))
            f.append(np.where(context > 0, own / np.maximum(context, 1), 0.0))
            above = own
        return f, b

    def held_estimates(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        blobs = []
        for data in table.column("data").to_pylist():
            for _, e, c in Block(data, back, order, True):
                f, b = estimates(e, c, True)
                blobs.append(zstandard.compress(np.concatenate(f).astype("<f4").tobytes() + np.concatenate(b).astype(np.uint8).tobytes(), 1))
        return pa.table({"data": pa.array(blobs, pa.binary())})

    def cells(shares: list[np.ndarray]):
        """How many held-out tokens have which bucket, estimate and probability of the order below, for the next order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    raw = zstandard.decompress(data)
                    n = len(raw) // (5 * order)
                    f = list(np.frombuffer(raw, "<f4", n * order).reshape(order, n).astype(float))
                    b = list(np.frombuffer(raw, np.uint8, offset=4 * n * order).reshape(order, n))
                    k = len(shares)
                    below = steps_of(mixed(f, b, shares, uniform)) if k else 0
                    cell, times = np.unique((b[k].astype(np.int64) * LEVELS + steps_of(f[k])) * LEVELS + below, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(times)], names=["cell", "n"])

        return run

    own = blocks.where("held").select("block", "data")
    held_back = back.join(F.broadcast(own.select("block")) if size["n"] <= 100_000 else own.select("block"), "block", "left_semi")
    pair = own.repartition(tasks, "block").groupBy("block").cogroup(held_back.repartition(tasks, "block").groupBy("block"))
    held = written(pair.applyInArrow(held_estimates, "data binary"))
    shares: list[np.ndarray] = []
    for k in range(order):
        found = held.mapInArrow(cells(shares), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        got = np.array([(r["cell"], r["n"]) for r in found], np.int64).reshape(-1, 2)
        cell, n = got[:, 0], got[:, 1]
        columns = [cell // LEVELS // LEVELS, value_of(cell // LEVELS % LEVELS), *([value_of(cell % LEVELS)] if k else []), n]
        weights = mixture(np.column_stack(columns).astype(float), 0.0 if k else uniform)
        shares.append(weights[:, 0] / (weights[:, 0] + weights[:, 1]))

    def judge(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for data in table.column("data").to_pylist():
            for part, e, c in Block(data, back, order, False):
                f, b = estimates(e, c, False)
                c = c[0]
                sums_of = [np.add.reduceat(x, e.first[:-1]) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (n_train + types + 1)), np.log10(mixed(f, b, shares, uniform)))]
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(e.counts, pa.int64()), pa.array(sums_of[0]), pa.array(np.full(part.num_rows, n_train), pa.int64()), *map(pa.array, sums_of[1:])]
                out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)

    pair = blocks.select("block", "data").repartition(tasks, "block").groupBy("block").cogroup(back.repartition(tasks, "block").groupBy("block"))
    return pair.applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
