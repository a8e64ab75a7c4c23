"""Fill-in-middle: texts cut at unit bounds into prefix, middle and suffix, put in another order.

A unit is a word with the white space before it, or white space at the end. The Split pre-tokenizer of the
tokenizers library, which needs no training, finds them: each match is isolated, and its offsets count code points.
How many offsets there are is n; the two ranks that are drawn among them give the slices.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .shared import new_columns
from .words import slices

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PIECE = 1 << 16  # code points that go to the pre-tokenizer at once, about
_BOUND = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a unit always ends here


@dataclass(frozen=True)
class Plan:
    """Of the texts, ``percent`` in a hundred are cut, and of these ``suffix_first`` in a hundred have the suffix in front. A text with a mark in it isn't cut."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def unit_ends(text: str, splitter: pre_tokenizers.Split) -> np.ndarray:
    """Where units end, in code points. A long text goes in pieces that end where a unit does, so that no more than a piece's matches are held at once."""
    if len(text) <= PIECE:
        return np.array([b for _, (_, b) in splitter.pre_tokenize_str(text)], np.int64)
    ends, at = [], 0
    while at < len(text):
        bound = _BOUND.search(text, at + PIECE)
        stop = bound.start() if bound else len(text)
        ends.append(at + np.array([b for _, (_, b) in splitter.pre_tokenize_str(text[at:stop])], np.int64))
        at = stop
    return np.concatenate(ends)


def arrange(text: str, doc_id: object, ends: np.ndarray, plan: Plan) -> tuple[str, str, int | None, int | None]:
    """Form, output, and the code points of prefix and middle (none if plain)."""
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, cut, order = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or cut % 100 >= plan.percent or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)):
        return "plain", text, None, None
    ranks = sorted(x % (ends.size + 1) for x in (a, b))
    low, high = (int(ends[r - 1]) if r else 0 for r in ranks)
    prefix, middle, suffix = plan.prefix + text[:low], plan.middle + text[low:high], plan.suffix + text[high:]
    first = order % 100 < plan.suffix_first
    return ("spm", suffix + prefix + middle, low, high - low) if first else ("psm", prefix + suffix + middle, low, high - low)


def restore(output: str, form: str, plan: Plan = Plan()) -> str:
    """The text that an output was made of. Each mark is in it once, as texts with a mark stay plain."""
    if form == "plain":
        return output
    front, middle = output.split(plan.middle)
    if form == "psm":
        prefix, suffix = front.removeprefix(plan.prefix).split(plan.suffix)
    else:
        suffix, prefix = front.removeprefix(plan.suffix).split(plan.prefix)
    return prefix + middle + suffix


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """As restore, for columns."""

    def behind(mark: str) -> Column:
        rest = F.substring_index(output, mark, -1)
        for other in {plan.prefix, plan.suffix, plan.middle} - {mark}:
            rest = F.substring_index(rest, other, 1)
        return rest

    return F.when(form == "plain", output).otherwise(F.concat(behind(plan.prefix), behind(plan.middle), behind(plan.suffix)))


def transform(
    df: DataFrame, plan: Plan = Plan(), text: str = "text", id_: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), output: bool = True, digests: bool = False
) -> DataFrame:
    """Every whole text, cut and put in order.

    Args:
        id_: the column that the draws go by, as its decimal text after the plan's seed; rows of one id have the same draws.
        keep: columns to pass on; others, whatever their names, are dropped.
        output: return the text that was made.
        digests: return the SHA-256 (lowercase hex) of that text, and of the one that restore makes of it again.

    Columns beside: n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain).
    Null and empty texts have no units and are plain; the output of a null text is empty. A null id draws by the seed alone.
    Rows are independent: repeated rows come out as often as they went in. A text with a mark in it is plain, so that outputs can
    be taken apart again. Names in ``keep`` that are made here raise. A text of any length is cut as a whole, and held a few times over. No shuffle.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", *["output"] * output, *["output_sha256", "restored_sha256"] * digests]
    new_columns(keep, ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
    plain = df.select(*keep, df[id_].cast("string").alias("__id"), df[text].cast("string").alias("__text"))
    kinds = {"n": "long", "prefix_chars": "long", "middle_chars": "long"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)]), *(f"{c} {kinds.get(c, 'string')}" for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = pre_tokenizers.Split(Regex(UNIT), "isolated")
        for batch in batches:
            for part in slices(batch, "__text"):
                rows = []
                for key, t in zip(part.column("__id").to_pylist(), part.column("__text").to_pylist(), strict=True):
                    t = t or ""
                    ends = unit_ends(t, splitter)
                    form, out, first, inner = arrange(t, key, ends, plan)
                    row = [ends.size, form, first, inner, *[out] * output]
                    row += [hashlib.sha256(x.encode()).hexdigest() for x in (out, restore(out, form, plan))] if digests else []
                    rows.append(row)
                columns = [pa.array(c, pa.int64() if kinds.get(name) else pa.string()) for name, c in zip(made, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*keep, *made])

    return plain.mapInArrow(run, schema)
