"""Quality rules on repetition within a document, by suffix arrays.

The words of many documents are sorted by suffix at once, by prefix doubling; a document's number
is part of each first rank, so that suffixes of different documents never share a prefix. The
longest common prefixes of neighbours in that order give every maximal repeated substring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import new_columns
from .words import Texts, covered, per_doc, slices, span_codes, utf8

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True  # fixed values
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Rules:
    """A document is rejected for fewer than min_words words, if repeats of repeat_words words or more cover over
    max_repeat_percent of its words, or if any substring of more than max_repeat words occurs twice."""

    min_words: int = 10
    repeat_words: int = 5
    max_repeat_percent: int = 20
    max_repeat: int = 100


def suffixes(key: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of concatenated documents and the common prefix, in words, of each suffix with the one before.

    key: a number for each word; doc: its document; stop: where its document ends. Ranks of prefixes of
    1, 2, 4, ... words are kept, as long as two suffixes of a document share one; from the longest down, they
    give the common prefixes. Only suffixes with equal ranks are sorted again.
    """
    n = key.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, size = [], 1
    while not new.all():
        levels.append(rank)
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        rows = order[at]
        beyond = rows + size
        inside = beyond < stop[rows]
        second = np.where(inside, rank[np.where(inside, beyond, 0)], -1)
        first = rank[rows]
        resort = np.lexsort((second, first))
        rows, first, second = rows[resort], first[resort], second[resort]
        order[at] = rows
        differs = np.ones(at.size, bool)
        differs[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new = new.copy()
        new[at] = differs
        rank = rank.copy()
        rank[rows] = at[np.maximum.accumulate(np.where(differs, np.arange(at.size), 0))]
        size *= 2
    shared = np.zeros(n, np.int64)
    if levels:
        a, b = order[:-1].copy(), order[1:].copy()
        for level in reversed(range(len(levels))):
            r = levels[level]
            both = (a < stop[order[:-1]]) & (b < stop[order[1:]])
            same = both & (r[np.where(both, a, 0)] == r[np.where(both, b, 0)]) & (doc[order[:-1]] == doc[order[1:]])
            step = np.where(same, 1 << level, 0)
            a += step
            b += step
        shared[1:] = a - order[:-1]
    return order, shared


def measures(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """The figures of each document, as whole numbers."""
    t = Texts(data, offsets)
    n = t.doc.size
    order, shared = suffixes(t.numbers(), t.doc, t.first[1:][t.doc] if n else np.zeros(0, np.int64))
    longest = np.zeros(n, np.int64)
    if n:
        longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    at = np.flatnonzero(longest >= rules.repeat_words)
    repeats = covered(at, at + longest[at], n)
    best = np.zeros(t.n, np.int64)
    np.maximum.at(best, t.doc, longest)

    def bytes_per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    ends = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], ends + 1]))
    starts = starts[starts <= data.size]
    stops = np.sort(np.concatenate([ends, offsets[1:]]))
    worded = np.searchsorted(t.starts, stops) > np.searchsorted(t.starts, starts)
    starts, stops = starts[worded], stops[worded]
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    low, high = span_codes(data, starts, stops)
    lines = np.bincount(line_doc, minlength=t.n)
    by = np.lexsort((low, high, line_doc))
    fresh = np.ones(by.size, bool)
    if by.size:
        fresh[1:] = (low[by][1:] != low[by][:-1]) | (high[by][1:] != high[by][:-1]) | (line_doc[by][1:] != line_doc[by][:-1])
    return {
        "n_words": t.counts,
        "word_chars": bytes_per_doc(((data & 0xC0) != 0x80) & ~_SPACE[data]),
        "n_symbols": bytes_per_doc(SYMBOLS[data]),
        "n_dup_lines": lines - np.bincount(line_doc[by][fresh], minlength=t.n),
        "n_repeat_words": per_doc(repeats, t.first),
        "longest_repeat": best,
    }


def rate(df: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Figures and verdict of every whole text.

    Columns: those in ``keep``, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words in repeats of rules.repeat_words or more, first occurrences
    included), longest_repeat (words), base_failed (too few words or too much repeated) and kept (not base_failed,
    and no repeat over rules.max_repeat). Null and empty texts have figures of 0 and are not kept. Rows
    are independent: repeated rows and null ids stay as they are. Columns not in ``keep`` are dropped; names in it that are made here raise. No shuffle.

    A text is worked on as a whole, however long: a worker holds some 20 numbers a word of it, and one more for each doubling of its longest repeat.
    Words and lines are compared by their bytes (beyond 15, by 120 bits of BLAKE2b).
    """
    plain = df.select(*keep, df[text].cast("string").alias("__text"))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
    new_columns(keep, [*numbers, "base_failed", "kept"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)]) + "".join(f", {c} long" for c in numbers) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                m = measures(*utf8(part.column("__text")), rules)
                failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
                columns = list(part.columns[: len(keep)]) + [pa.array(m[c], pa.int64()) for c in numbers] + [pa.array(failed), pa.array(~failed & (m["longest_repeat"] <= rules.max_repeat))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *numbers, "base_failed", "kept"])

    return plain.mapInArrow(run, schema)
