"""Periodic runs in documents: stretches of words that repeat with a period, by divide and conquer after Main and Lorentz.

Each document is halved at a midpoint, and so is each half. A run of the exponent e that crosses a midpoint has e/2 of its periods on one side of it. So
for each period q that fits there, two values of Z-functions tell it: how far the right half agrees with itself q words later, or the left half, read
backwards, with itself q words before. What agrees for e/2 periods is extended both ways as far as the document goes. A run whole within a half is found there.
All midpoints of a level, of many documents, are worked on at once.

Words are interned: equal numbers for equal words alone. Z-functions are read off numbers of windows of 1, 2, 4, ... words, which too are equal for equal
windows alone and are made only as far as something agrees, so that no text, not even one word over and over, takes more than n log n numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import new_columns
from .words import Texts, covered, slices, utf8


@dataclass(frozen=True)
class Rules:
    """A run has ``length`` words or more and its period ``exponent`` times or more (2 at least)."""

    length: int = 6
    exponent: int = 4

    def __post_init__(self) -> None:
        if self.exponent < 2:
            raise ValueError("an exponent under 2 is no repetition")

    def beyond(self, period: np.ndarray) -> np.ndarray:
        """How many words must agree with those a period away on one side of a midpoint."""
        return -(-self.exponent * period // 2) - period


class Windows:
    """Numbers of the windows of 1, 2, 4, ... words that start at each place."""

    def __init__(self, words: np.ndarray) -> None:
        self.levels = [words]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, span = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, half.size - span)
            base = int(half.max()) + 1 if half.size else 1
            self.levels.append(np.unique(half[:n] * base + half[span : span + n], return_inverse=True)[1])
        return self.levels[k]

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many words from a and from b on are the same, ``limit`` at most: onwards (step 1), or backwards from the words before them (step -1)."""
        out = np.zeros(a.size, np.int64)
        top = np.zeros(a.size, np.int64)

        def grow(rows: np.ndarray, k: int) -> np.ndarray:
            """Of rows, those that agree for 2^k words more, which are counted."""
            rows = rows[out[rows] + (1 << k) <= limit[rows]]
            at = out[rows] if step > 0 else -out[rows] - (1 << k)
            numbers = self.level(k) if rows.size else self.levels[0]
            rows = rows[numbers[a[rows] + at] == numbers[b[rows] + at]]
            out[rows] += 1 << k
            return rows

        rows, k = np.arange(a.size), 0
        while rows.size:
            top[rows] = k
            rows, k = grow(rows, k), k + 1
        for k in reversed(range(int(top.max()) + 1 if top.size else 0)):
            grow(np.flatnonzero(top >= k), k)
        return out


def candidates(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and whole numbers from 1 to count[row]."""
    row = np.repeat(np.arange(count.size), count)
    return row, np.arange(row.size) - np.repeat(np.cumsum(count) - count, count) + 1


def runs(words: np.ndarray, first: np.ndarray, rules: Rules = Rules()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all maximal runs, in order of starts and periods.

    words: numbers of the words of documents one after another; first: where each document starts, and the end of all.
    """
    windows = Windows(words)
    lo, hi = first[:-1], first[1:]
    start, stop = lo, hi  # of the document that a part belongs to
    found = [np.zeros((0, 3), np.int64)]
    least = max(rules.length, rules.exponent)
    while True:
        long = hi - lo >= least
        lo, hi, start, stop = lo[long], hi[long], start[long], stop[long]
        if not lo.size:
            break
        mid = (lo + hi) // 2
        for side, half in ((1, hi - mid), (-1, mid - lo)):
            part, q = candidates(2 * half // rules.exponent)
            there = mid[part] + np.minimum(side, 0)  # the word next to the midpoint
            beyond = rules.beyond(q)
            for share in (0, 2, 1):  # of the words that must agree, the first, the last and the middle one: most differ in one of these
                place = np.maximum(beyond - 1, 0) * share // 2
                other = np.minimum(there + side * (place + q), words.size - 1)
                same = (beyond == 0) | (words[there + side * place] == words[other])
                part, q, there, beyond = part[same], q[same], there[same], beyond[same]
            m = mid[part]
            a, b = (m, m + q) if side > 0 else (m - q, m)
            onwards, backwards = ((stop[part] - b), a - start[part])
            z = windows.agree(a, b, onwards, 1) if side > 0 else windows.agree(a, b, backwards, -1)
            good = z >= beyond
            a, b, q, z, onwards, backwards = a[good], b[good], q[good], z[good], onwards[good], backwards[good]
            other = windows.agree(a, b, backwards, -1) if side > 0 else windows.agree(a, b, onwards, 1)
            begin, end = (a - other, b + z) if side > 0 else (a - z, b + other)
            enough = end - begin >= np.maximum(rules.length, rules.exponent * q)
            found.append(np.stack([begin, end, q], 1)[enough])
        found = [distinct(np.concatenate(found))]
        lo, hi, start, stop = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(start, 2), np.tile(stop, 2)
    begin, end, q = found[0].T
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def distinct(found: np.ndarray) -> np.ndarray:
    """Of equal stretches, that with the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(found.shape[0], bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def strongest(listed: list[tuple[int, int, int]]) -> tuple[int | None, ...]:
    """Of runs (start, length, period) in order, the first with the greatest quotient of length and period, and that quotient in thousandths."""
    if not listed:
        return (None,) * 4
    best = listed[0]
    for run in listed[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return (*best, 1000 * best[1] // best[2])


def find(
    df: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",), listed: bool = True, collapsed: bool = True, digests: bool = False
) -> DataFrame:
    """The periodic runs of every whole text, and the text without the repetitions.

    A run is a stretch of words, numbered from 0, in which those a period apart are the same, with no smaller period, and which no neighbouring word
    extends; rules tell how long it must be. Words are what white space (ASCII) separates, unchanged. Runs may overlap.

    Args:
        keep: columns to pass on; others, whatever their names, are dropped.
        listed: return ``runs``, all of them by start, then period.
        collapsed: return ``collapsed``: each word that some run has after its first period is dropped, the others are joined by one space.
        digests: return runs_sha256 (of each run's start,length,period and a line feed) and collapsed_sha256, lowercase hex of UTF-8.

    Columns beside: n_runs, and of the run with the greatest quotient of length and period (of equals, that which starts first, then has the
    smallest period) start, length, period and exponent_milli, nulls without runs. Null and empty texts and those under rules.length words have no runs. Rows are
    independent: repeated rows and null ids stay as they are. Names in ``keep`` that are made here raise. No shuffle.

    A text is worked on as a whole, however long: a worker holds some 20 numbers a word of it, and one more for each doubling of what repeats in it.
    """
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    new_columns(keep, [*numbers, "runs", "collapsed", "runs_sha256", "collapsed_sha256"])
    plain = df.select(*keep, df[text].cast("string").alias("__text"))
    own = [*numbers, *["runs"] * listed, *["collapsed"] * collapsed, *["runs_sha256", "collapsed_sha256"] * digests]
    run = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
    kinds = {c: pa.int64() for c in numbers} | {"runs": pa.list_(run)}
    names = {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>"} | dict.fromkeys(numbers, "bigint")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)]), *(f"{c} {names.get(c, 'string')}" for c in own)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                t = Texts(*utf8(part.column("__text")))
                begin, end, q = runs(t.numbers(), t.first, rules)
                stays = ~covered(begin + q, end, t.doc.size)
                whole = t.counts == np.bincount(t.doc[stays], minlength=t.n)
                bounds = np.searchsorted(begin, t.first)
                words, stays = t.words(), stays.tolist()
                rows = []
                for i, (a, b, x, y) in enumerate(zip(t.first[:-1].tolist(), t.first[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own_runs = list(zip((begin[x:y] - a).tolist(), (end[x:y] - begin[x:y]).tolist(), q[x:y].tolist(), strict=True))
                    left = b" ".join(words[a:b] if whole[i] else [words[k] for k in range(a, b) if stays[k]])
                    row = [y - x, *strongest(own_runs), *[own_runs] * listed, *[left.decode()] * collapsed]
                    if digests:
                        row += [hashlib.sha256("".join("%d,%d,%d\n" % r for r in own_runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
                    rows.append(row)
                columns = []
                for name, c in zip(own, zip(*rows, strict=True), strict=True):
                    values = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in c] if name == "runs" else c
                    columns.append(pa.array(values, kinds.get(name, pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*keep, *own])

    return plain.mapInArrow(work, schema)
