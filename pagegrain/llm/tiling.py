"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case; in scripts without spaces, each character is one. Karp-Rabin hashes of every ``seed``
words of a document are looked up among those of the benchmark, each different one once; items whose found seeds could cover enough of their words
are tiled. Of a document and an item, the longest match is marked as a tile again and again, leaving out what is marked already, until no
match of ``seed`` words is left. As tiles may lie in any order, passages that have been cut up and reordered are covered too. An item counts as
leaked if tiles cover enough of its words. Items shorter than a seed are one seed as a whole.

Hashes only propose: before they are tiled, words are compared by their codes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_columns
from .words import NOT_ALPHANUMERIC, Texts, covered, joined, mix, slices, utf8

SCHEMA = "n_tokens long, n_matched long, n_tiles long, longest_tile long, coverage double"


class Items:
    """Some benchmark items: of each seed length, the ascending hashes with the items and places that have them."""

    def __init__(self, texts: list[str | None], seed: int) -> None:
        self.t = t = words_of(pa.array(texts, pa.string()))
        self.size, self.seeds = t.counts, {}
        for length in sorted({min(seed, int(n)) for n in self.size if n}):
            hashes, inside = t.windows(length)
            places = np.flatnonzero(inside)
            places = places[(self.size >= seed)[t.doc[places]] if length == seed else (self.size == length)[t.doc[places]]]
            order = np.argsort(hashes[places], kind="stable")
            places = places[order]
            different, first = np.unique(hashes[places], return_index=True)
            self.seeds[length] = different, np.append(first, places.size), t.doc[places], places - t.first[t.doc[places]]


def words_of(texts: pa.Array) -> Texts:
    return Texts(*utf8(texts), lower=True, space=NOT_ALPHANUMERIC, alone=True)


def tiles(matches: list[tuple[int, int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of matches (place in document, place in item, length): longest first, of equals that first in the item, then in the document."""
    heap = [(-n, i, d) for d, i, n in matches]
    heapq.heapify(heap)
    used_d: set[int] = set()
    used_i: set[int] = set()
    out = []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [k for k in range(-n) if d + k not in used_d and i + k not in used_i]
        if len(free) == -n:
            out.append((d, i, -n))
            used_d.update(range(d, d - n))
            used_i.update(range(i, i - n))
            continue
        start = prev = None
        for k in [*free, None]:
            if start is not None and (k is None or k != prev + 1):
                if prev - start + 1 >= seed:
                    heapq.heappush(heap, (start - prev - 1, i + start, d + start))
                start = None
            if start is None:
                start = k
            prev = k
    return out


def free_from(used: np.ndarray) -> np.ndarray:
    """From each place, how many places on are unused."""
    n = used.size
    stops = np.append(np.flatnonzero(used), n)
    return stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)


def searched(d: np.ndarray, i: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same tiles as of all matches, by running Karp-Rabin over word numbers (-1: none of the item's), in time and memory that grow with the lengths and not with the number of matches.

    Windows of 1, 2, 4, ... words are hashed once; two of them make a window of any length. The longest length with a common free window is
    found by halving; of that length, windows are marked first in the item, then in the document, as long as they are free.
    """
    ladder = [[mix(x.astype(np.uint64) + np.uint64(1)) for x in (d, i)]]
    while 2 << (len(ladder) - 1) <= i.size:
        span = 1 << (len(ladder) - 1)
        ladder.append([joined(h[:-span], h[span:]) if h.size > span else h[:0] for h in ladder[-1]])
    used_d, used_i = d < 0, np.zeros(i.size, bool)

    def windows(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Free places and hashes, of document and item."""
        level = length.bit_length() - 1
        out = []
        for h, used in zip(ladder[level], (used_d, used_i), strict=True):
            at = np.flatnonzero(free_from(used) >= length)
            out.append((at, joined(h[at], h[at + length - (1 << level)])))
        return out

    found, most = [], i.size
    while True:
        low, high = seed - 1, most  # a common window of low words is there, of more than high isn't
        while low < high:
            length = (low + high + 1) // 2
            (_, a), (_, b) = windows(length)
            low, high = (length, high) if np.isin(b, a).any() else (low, length - 1)
        if low < seed:
            return found
        (at_d, a), (at_i, b) = windows(low)
        order = np.argsort(a, kind="stable")
        a, at_d = a[order], at_d[order]
        lo, hi = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
        taken = False
        for k in np.flatnonzero(lo < hi).tolist():
            y = int(at_i[k])
            if used_i[y : y + low].any():
                continue
            free = at_d[lo[k] : hi[k]]
            free = free[free_from(used_d)[free] >= low]
            for x in free.tolist():
                if (d[x : x + low] == i[y : y + low]).all():
                    used_d[x : x + low] = used_i[y : y + low] = taken = True
                    found.append((x, y, low))
                    break
        most = low if taken else low - 1


PAIRS = 1 << 16  # seeds of a document and an item that are paired at once


def tiled(t: Texts, doc: int, items: Items, item: int, seed: int) -> list[tuple[int, int, int]]:
    """Tiles of a document and an item."""
    own, other = slice(t.first[doc], t.first[doc + 1]), slice(items.t.first[item], items.t.first[item + 1])
    low, high = (np.concatenate([x[own], y[other]]) for x, y in zip(t.codes, items.t.codes, strict=True))
    order = np.lexsort((low, high))
    number = np.empty(order.size, np.int64)
    number[order] = np.cumsum(np.append(False, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
    n = own.stop - own.start
    d, i = np.where(np.isin(number[:n], number[n:]), number[:n], -1), number[n:]
    # Only runs of the item's words that are long enough can match; one foreign word between them is as good as many.
    long = covered(*runs_of(d >= 0, seed), n)
    keep = np.flatnonzero(long | np.append(False, long[:-1]))
    place, d = keep, np.where(long[keep], d[keep], -1)
    a, b = (np.lib.stride_tricks.sliding_window_view(x, seed) if x.size >= seed else np.zeros((0, seed), np.int64) for x in (d, i))
    good = np.flatnonzero((a >= 0).all(axis=1))
    _, same = np.unique(np.concatenate([a[good], b]), axis=0, return_inverse=True)
    x, y = same[: good.size], same[good.size :]
    by = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[by], x, "left"), np.searchsorted(y[by], x, "right")
    pairs = hi - lo
    if pairs.sum() > PAIRS:
        return [(int(place[p]), q, k) for p, q, k in searched(d, i, seed)]
    dd = np.repeat(good, pairs)
    ii = by[np.repeat(lo - np.cumsum(pairs) + pairs, pairs) + np.arange(pairs.sum())]
    by = np.lexsort((ii, dd - ii))
    dd, ii = dd[by], ii[by]
    run = np.ones(dd.size, bool)
    run[1:] = (dd[1:] != dd[:-1] + 1) | (ii[1:] != ii[:-1] + 1)
    starts = np.flatnonzero(run)
    lengths = np.diff(np.append(starts, dd.size)) + seed - 1
    return [(int(place[p]), q, k) for p, q, k in tiles(list(zip(dd[starts].tolist(), ii[starts].tolist(), lengths.tolist(), strict=True)), seed)]


def runs_of(flag: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` flags."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    long = ends - starts >= least
    return starts[long], ends[long]


def matched(t: Texts, items: Items, seed: int, percent: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, tiled words, tiles, longest tile) of all pairs with enough of the item covered."""
    for length, (different, first, of_item, at_item) in items.seeds.items():
        hashes, inside = t.windows(length)
        if not hashes.size:
            continue
        at = np.minimum(np.searchsorted(different, hashes), different.size - 1)
        found = np.flatnonzero(inside & (different[at] == hashes))
        # Each different seed of a document once, with all its places in items.
        once = np.unique(t.doc[found] * different.size + at[found])
        doc, which = once // different.size, once % different.size
        n = first[which + 1] - first[which]
        k = np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc, item, i = np.repeat(doc, n), of_item[k], at_item[k]
        order = np.lexsort((i, item, doc))
        doc, item, i = doc[order], item[order], i[order]
        if not doc.size:
            continue
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
        gain = np.full(doc.size, length)
        gain[1:] = np.where(new[1:], length, np.minimum(length, i[1:] - i[:-1]))
        bounds = np.flatnonzero(new)
        for a, most in zip(bounds.tolist(), np.add.reduceat(gain, bounds).tolist(), strict=True):
            size = int(items.size[item[a]])
            if 100 * most < percent * size:  # what all seeds cover together bounds what tiles can
                continue
            found_tiles = tiled(t, int(doc[a]), items, int(item[a]), length)
            total = sum(x[2] for x in found_tiles)
            if found_tiles and 100 * total >= percent * size:
                yield int(doc[a]), int(item[a]), total, len(found_tiles), max(x[2] for x in found_tiles)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, seed: int = 5, text: str = "text", block_bytes: int = 16 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of a document and a benchmark item whose tiles in the whole document cover ``percent`` of its words or more.

    Columns: those in ``keep``, item_id, n_tokens (the item's words), n_matched, n_tiles, longest_tile, coverage. One row for each pair of
    rows, so repeated rows give repeated pairs; null ids stay null. Null texts and texts without words, on either side, match nothing. An item of
    fewer than ``seed`` words matches where it stands as a whole, word by word. Of matches of one length, that first in the item, then in the document is
    marked first. Columns other than ids, texts and those to keep are dropped; names in ``keep`` that are made here raise. Texts of any length are tiled as a whole.

    The benchmark goes to the executors in blocks of about ``block_bytes`` of text, by a hash of its rows, each with a
    pass over docs, so that a large one costs passes and not memory. Needs no shuffle of docs.
    """
    spark = docs.sparkSession
    made = ["item_id", "n_tokens", "n_matched", "n_tiles", "longest_tile", "coverage"]
    new_columns(keep, made)
    rows = docs.select(*((docs[k].cast("long") if k == "doc_id" else docs[k]).alias(k) for k in keep), docs[text].cast("string").alias("__text"))
    own_kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = f"{own_kinds}, item_id long, {SCHEMA}"

    def against(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in own], Items([r["text"] for r in own], seed)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for batch in batches:
                for part in slices(batch, "__text"):
                    t = words_of(part.column("__text"))
                    found = list(matched(t, index, seed, percent))
                    sizes = [int(index.size[x[1]]) for x in found]
                    at = pa.array([x[0] for x in found], pa.int64())
                    columns = [c.take(at) for c in part.columns[: len(keep)]] + [pa.array([ids[x[1]] for x in found], pa.int64()), pa.array(sizes, pa.int64())]
                    columns += [pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4)]
                    columns.append(pa.array([x[2] / s for x, s in zip(found, sizes, strict=True)], pa.float64()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

        return rows.mapInArrow(run, schema)

    out = against(0)
    for block in range(1, blocks):
        out = out.unionByName(against(block))
    return out
