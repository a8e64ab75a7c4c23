"""Exact substring dedup: level-wise doubling of repeated word windows.

Lengths double from ``start`` words up to the full window (13, 25, 50 for 50). At each length but the last, every full
window that is still a candidate is owned by the least-hashed window of that length in it, the leftmost of
equals, so equal full windows have equal owners in equal places. Only owners are gathered, each as one row for all
the full windows that it owns, which follow one another (its run). Windows whose owner stands in one document alone are
no candidates any longer; those of the others are looked at again at twice the length, until no candidates survive.

What survives the last length below the full one is settled run by run: runs that are equal as a whole have all their windows
start in the smallest document of their class. What is left, one run for each class whose owner is also in another
class, is unfolded into full windows. As every window belongs to one owner, nothing is lost.

Owners only propose; runs and full windows are compared by 128 bits, from words' own bytes up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, written
from .words import Texts, slices, utf8

_U = np.uint64
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def levels(k: int, start: int) -> list[int]:
    """Lengths up to k, each at most twice the one before, from ``start`` or somewhat more on; two of them at least, if k allows it."""
    out = [k]
    while (half := (out[0] + 1) // 2) >= start or (len(out) == 1 and k > 1):
        out.insert(0, half)
        if half == 1:
            break
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values is, the leftmost of equals."""
    at, span = np.arange(values.size), 1
    while 2 * span <= width:
        a, b = at[:-span], at[span:]
        at, span = np.where(values[b] < values[a], b, a), 2 * span
    a, b = at[: values.size - width + 1], at[width - span :][: values.size - width + 1]
    return np.where(values[b] < values[a], b, a)


def runs(t: Texts, k: int, length: int, alive: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of k-word windows with one owner of ``length`` words, among those that are ``alive`` (by start word; None: all).

    The owner's hash, its place, the run's document, first window (over all documents) and count.
    """
    hashes, _ = t.windows(length)
    width = k - length + 1
    if hashes.size < width:
        empty = np.zeros(0, np.int64)
        return {"owner": empty, "place": empty, "doc": empty, "lo": empty, "n": empty}
    owner = least(hashes, width)
    valid = t.doc[: owner.size] == t.doc[k - 1 :]
    if alive is not None:
        valid &= alive[: owner.size]
    start = valid.copy()
    start[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(start)
    ends = np.flatnonzero(valid & ~np.append(valid[1:] & (owner[1:] == owner[:-1]), False)) + 1
    return {"owner": hashes[owner[lo]].view(np.int64), "place": owner[lo], "doc": t.doc[lo], "lo": lo, "n": ends - lo}


def whole(t: Texts, lo: np.ndarray, n: np.ndarray, place: np.ndarray, k: int) -> list[np.ndarray]:
    """128 bits of all words of runs, and of where their owners stand in them."""
    out = []
    for lane in (0, 1):
        shape = ((place - lo).astype(_U) << _U(32)) + n.astype(_U)
        out.append((t.ranges(lo, lo + n - 1 + k, lane) ^ shape).view(np.int64))
    return out


def gather(k: int, length: int, last: bool) -> Batches:
    """Rows of runs: owner, doc_id, lo, n and, at the last length, the whole run's hash a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(*utf8(part.column("text")))
                alive = None
                if "parts" in part.schema.names:
                    row, (lo, n) = listed(part.column("parts"), 2)
                    inside = lo + n - 1 + k <= t.counts[row]
                    alive = spans(t, row[inside], lo[inside], n[inside])
                r = runs(t, k, length, alive)
                columns = [pa.array(r["owner"]), part.column("doc_id").take(pa.array(r["doc"])), pa.array(r["lo"] - t.first[r["doc"]], pa.int32()), pa.array(r["n"], pa.int32())]
                columns += map(pa.array, whole(t, r["lo"], r["n"], r["place"], k)) if last else []
                yield pa.RecordBatch.from_arrays(columns, names=["owner", "doc_id", "lo", "n", *["a", "b"] * last])

    return run


def listed(parts: pa.Array, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a list column, and the structs' fields."""
    counts = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    return np.repeat(np.arange(len(parts)), counts), [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(fields)]


def spans(t: Texts, row: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words some span [lo, lo + size) of a row covers."""
    depth = np.zeros(t.doc.size + 1, np.int64)
    np.add.at(depth, lo + t.first[row], 1)
    np.add.at(depth, lo + t.first[row] + size, -1)
    return np.cumsum(depth[:-1]) > 0


def dedup(df: DataFrame, k: int = 50, text: str = "text", kept_text: bool = False, start: int = 13) -> DataFrame:
    """Remove each word covered by a k-word window whose words also start, in this order, in a document of smaller doc_id.

    Windows are judged on the input, so a window in three documents stays in the first alone. Columns: doc_id, n_words,
    n_removed, kept_sha256 (of kept words joined by one space, lowercase hex) and, if asked, kept.

    Null and empty texts have no words; texts under k words lose none. Rows with a null doc_id lose none and
    take none away. Rows of one doc_id are judged apart, but never against each other. Columns other than doc_id
    and text are dropped. A text is worked on as a whole, however long: a worker holds some 20 numbers a word of it.

    Keys that hold much of all rows (a passage in a third of the documents) are joined where their rows are.
    """
    docs = df.select(df["doc_id"].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    source, lengths = docs.where("doc_id is not null"), levels(k, start)
    rows = None
    for length in lengths[:-1] or [k]:
        last = length == lengths[max(0, len(lengths) - 2)]
        found = written(source, gather(k, length, last), "owner long, doc_id long, lo int, n int" + ", a long, b long" * last)
        repeated = written(found.groupBy("owner").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.count("*").alias("size")).where("p < q").select("owner", "size"))
        rows = written(spread_join(found, repeated, ["owner"], "size").drop("size"))
        if last or rows.isEmpty():
            break
        alive = rows.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("parts"))
        source = docs.join(alive.hint("shuffle_hash"), "doc_id")
    if not last:  # no candidate has survived so far
        rows = rows.select("*", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    run = ["owner", "a", "b"]
    classes = written(rows.groupBy(*run).agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    settled = written(spread_join(rows, classes, run, "size").drop("size"))
    part = F.struct("lo", "n", "a", "b").alias("part")
    all_of_run = settled.where("first < doc_id").select("doc_id", part)

    # Owners with several classes: one representative each, unfolded into windows.
    several = written(classes.groupBy("owner").agg(F.count("*").alias("size")).where("size > 1"))
    unfold = spread_join(settled.where("first = doc_id"), several, ["owner"], "size").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "a", "b")).alias("parts"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                t = Texts(*utf8(piece.column("text")))
                row, lo, n = chosen(t, piece.column("parts"), k, lengths)
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                doc = np.repeat(row, n)
                at = at + t.first[doc]
                hashes = [pa.array(t.ranges(at, at + k, lane).view(np.int64)) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays([*hashes, piece.column("doc_id").take(pa.array(doc)), pa.array(at - t.first[doc], pa.int32())], names=["a", "b", "doc_id", "lo"])

    single = written(docs.join(unfold.hint("shuffle_hash"), "doc_id"), windows, "a long, b long, doc_id long, lo int")
    firsts = written(single.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("q"), F.count("*").alias("size")).where("first < q").drop("q"))
    one = spread_join(single, firsts, ["a", "b"], "size").where("first < doc_id").select("doc_id", F.struct("lo", F.lit(0).alias("n"), "a", "b").alias("part"))
    removed = written(all_of_run.unionByName(one).groupBy("doc_id").agg(F.collect_list("part").alias("parts")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                t = Texts(*utf8(piece.column("text")))
                row, lo, n = chosen(t, piece.column("parts"), k, lengths)
                keep = ~spans(t, row, lo, n - 1 + k)
                words, stays = t.words(), keep.tolist()
                kept = [b" ".join(words[i] for i in range(a, b) if stays[i]) for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)]
                left = np.concatenate([[0], np.cumsum(keep)])
                lost = t.counts - (left[t.first[1:]] - left[t.first[:-1]])
                columns = [piece.column("doc_id"), pa.array(t.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                columns += [pa.array(kept, pa.binary()).cast(pa.string())] * kept_text
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * kept_text])

    return docs.join(removed.hint("shuffle_hash"), "doc_id", "left").mapInArrow(judge, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text)


def chosen(t: Texts, parts: pa.Array, k: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the listed runs (n > 0) and windows (n = 0), those that are this very text's: row, first window, count.

    Rows of one doc_id get each other's lists; hashes tell whose they are.
    """
    row, (lo, n, a, b) = listed(parts, 4)
    inside = lo + np.maximum(n, 1) - 1 + k <= t.counts[row]
    row, lo, n, a, b = row[inside], lo[inside], n[inside], a[inside], b[inside]
    at = lo + t.first[row]
    right = np.zeros(row.size, bool)
    alone = np.flatnonzero(n == 0)
    right[alone] = (t.ranges(at[alone], at[alone] + k).view(np.int64) == a[alone]) & (t.ranges(at[alone], at[alone] + k, 1).view(np.int64) == b[alone])
    many = np.flatnonzero(n > 0)
    if many.size:
        length = lengths[max(0, len(lengths) - 2)]
        hashes, _ = t.windows(length)
        place = least(hashes, k - length + 1)[at[many]]
        own = whole(t, at[many], n[many], place, k)
        right[many] = (own[0] == a[many]) & (own[1] == b[many])
    return row[right], lo[right], np.maximum(n[right], 1)
