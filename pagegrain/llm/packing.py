"""Packing of token ids into sequences of bounded length, by a plan over the histogram of lengths.

Documents become pieces of ``room`` tokens at most. How many pieces have each length is all that a plan needs: best fit, the longest first, over counts
instead of pieces. It says which slots each length gets, as ranges of sequences. A piece then takes the slot of its rank among those of its length: its rank in
the task that made it, and the number of such pieces in the tasks before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_columns, written
from .word_tokens import word_encoder
from .words import slices

MADE = "piece int, start long, length long, ids_crc32 long"
FIELDS = ("length", "rank", "n", "sequence", "each", "used")


def plan(counts: dict[int, int], room: int = 4096) -> np.ndarray:
    """Slots for ``counts[length]`` pieces of each length, as rows of FIELDS: ``n`` pieces of a length, from a rank on, go ``each`` to a sequence, the first
    behind the ``used`` tokens that are in it.

    Best fit: a piece goes where least room is left that it fits in, or into a new sequence. Sequences with equal room are handled together, as ranges. A
    length opens two new ranges at most and splits one, and a range that takes pieces is left with less than half of its room, so
    there are at most 4 * room * (1 + log2(room)) rows, however many pieces there are.
    """
    rows: list[tuple[int, ...]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # by room that is left: ranges of sequences, as first and number
    rooms: list[int] = []
    total = 0

    def leave(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in open_:
                open_[left] = []
                insort(rooms, left)
            open_[left].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, last = 0, counts[length]

        def put(left: int, first: int, number: int, length: int = length, last: int = last) -> int:
            """Puts pieces into a range of sequences, as many as there are or fit; returns how many sequences have got one."""
            nonlocal rank
            each = left // length
            full = min(number, (last - rank) // each)
            rest = last - rank - full * each if full < number else 0
            if full:
                rows.append((length, rank, full * each, first, each, room - left))
                leave(left - each * length, first, full)
                rank += full * each
            if rest:
                rows.append((length, rank, rest, first + full, rest, room - left))
                leave(left - rest * length, first + full, 1)
                rank += rest
            return full + bool(rest)

        for left in rooms[bisect_left(rooms, length) :]:
            if rank == last:
                break
            ranges = open_.pop(left)
            rooms.pop(bisect_left(rooms, left))
            for first, number in ranges:
                got = put(left, first, number) if rank < last else 0
                leave(left, first + got, number - got)
        if rank < last:
            total += put(room, total, last - rank)
    return np.array(rows, np.int64).reshape(-1, len(FIELDS))


def slots(planned: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their lengths and ranks."""
    order = np.lexsort((planned[:, 1], planned[:, 0]))
    lengths, ranks, _, sequence, each, used = planned[order].T
    by = np.unique(lengths, return_index=True)
    own = by[1][np.searchsorted(by[0], length)]  # where the rows of a length start
    last = np.append(by[1][1:], lengths.size)[np.searchsorted(by[0], length)]
    while (wide := last - own > 1).any():  # halve each piece's range of rows
        middle = (own + last) // 2
        right = wide & (ranks[middle] <= rank)
        own, last = np.where(right, middle, own), np.where(wide & ~right, middle, last)
    at = rank - ranks[own]
    return sequence[own] + at // each[own], used[own] + at % each[own] * length


def pieces(df: DataFrame, tokenizer: str, room: int = 4096, end_id: int | None = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """The pieces of every whole text, written to the shared folder: keep, piece, start, length, ids_crc32, ids if asked, and their task and rank there."""
    plain = df.select(*keep, df[text].cast("string").alias("__text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)])
    kind += f", {MADE}, __task int, __rank long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                flat, bounds = encoder.encode(part.column("__text"))
                if end_id is not None:
                    flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(bounds.size)
                flat = flat.astype("<u4")
                of = -(-np.diff(bounds) // room)
                doc = np.repeat(np.arange(of.size), of)
                number = np.arange(doc.size) - np.repeat(np.cumsum(of) - of, of)
                first = bounds[doc] + number * room
                stop = np.minimum(first + room, bounds[doc + 1])
                length = stop - first
                order = np.argsort(length, kind="stable")
                groups = np.bincount(length, minlength=room + 1)
                rank = np.empty(length.size, np.int64)
                rank[order] = np.arange(length.size) - (np.cumsum(groups) - groups)[length[order]]
                rank += seen[length]
                seen += groups
                raw = memoryview(flat).cast("B")
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                columns = [c.take(pa.array(doc)) for c in part.columns[: len(keep)]]
                columns += [pa.array(number, pa.int32()), pa.array(number * room, pa.int64()), pa.array(length, pa.int64()), pa.array(checks, pa.int64())]
                columns += [pa.array(np.full(doc.size, task), pa.int32()), pa.array(rank)]
                if ids:  # pieces of a batch follow one another
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, flat.size), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "piece", "start", "length", "ids_crc32", "__task", "__rank", *["ids"] * ids])
        encoder.clear()

    return written(plain, run, kind)


def pack(df: DataFrame, tokenizer: str, room: int = 4096, end_id: int | None = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """All whole texts as token ids in sequences of at most ``room`` tokens, in few sequences.

    Args:
        tokenizer: path of a file that WordEncoder fits, which every executor has.
        end_id: appended to each document (None: nothing).
        keep: columns to pass on; others, whatever their names, are dropped.
        ids: return each piece's ``ids array<int>``.

    A row for each piece: piece (from 0), start (the document's ids before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), sequence_id (from 0,
    no number left out) and offset (its place there; the pieces of a sequence leave no gap). Only documents of more than ``room`` ids, end_id included, are cut, into
    pieces of ``room``, the last one shorter. Null and empty texts have end_id alone, or without one no piece. Repeated rows and ids are documents of
    their own; null ids stay null. An empty table gives no rows. Names in ``keep`` that are made here raise.

    Texts are encoded once, as a whole, and never shuffled. What is shuffled are counts by task and length, and a small row a piece (with its ids if asked).
    The driver gets the histogram, of ``room`` rows at most, and the plan, whose size is bounded by ``room`` alone (see plan).
    Ranks are written with the pieces, so that each slot is taken once even if tasks run again.
    """
    if room < 1:
        raise ValueError("room for less than one token")
    new_columns(keep, ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "__task", "__rank"])
    cut = pieces(df, tokenizer, room, end_id, text, keep, ids)
    per_task = written(cut.groupBy("__task", "length").agg(F.count("*").alias("n")))
    planned = plan({r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per_task.select("__task", "length", before.alias("__before")).hint("shuffle_hash")  # it grows with the tasks
    ranked = cut.join(base, ["__task", "length"])
    own = [c for c in cut.columns if c not in ("__task", "__rank")]
    ranked = ranked.select(*own, (F.col("__before") + F.col("__rank")).alias("__rank"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema[:-1]) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = slots(planned, batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, kind)


def sequences(packed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The sequences themselves, of pack(..., ids=True): sequence_id, n_tokens, ids, and ``parts`` (keep, piece, offset, length) in order. A sequence has no more than a room's tokens."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "piece", *keep, "ids"))).alias("p"))
    parts = F.transform("p", lambda x: F.struct(*(x[k].alias(k) for k in keep), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return rows.select("sequence_id", F.size(ids).alias("n_tokens"), ids.alias("ids"), parts.alias("parts"))
