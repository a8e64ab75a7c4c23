"""BPE encoding and decoding of a text column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import worker_encoder
from .shared import new_columns
from .words import slices


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """Token ids of every whole text, by greedy proposal, pair checks and exact merging of failing words.

    Args:
        tokenizer: path of a byte-level BPE file that every executor has.
        keep: columns to pass on; other columns, whatever their names, are dropped.
        ids: return ``ids array<int>`` and ``decoded string``.
        digests: return ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
            ``decoded_sha256``, lowercase hex.

    Null and empty texts have no tokens. Rows are independent: repeated rows and ids come out as often as
    they went in, null ids stay null. Added tokens' strings in a text become those tokens. A text of any length is encoded as a
    whole, and held a few times over. Names in ``keep`` that are made here raise. Needs no shuffle.
    """
    new_columns(keep, ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])
    plain = df.select(*keep, df[text].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)])
    schema += ", n_tokens long" + ", ids array<int>, decoded string" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        decode = encoder.v.decode
        for batch in batches:
            for part in slices(batch, "__text"):
                flat, bounds = encoder.encode(part.column("__text"))
                found = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                back = [decode(x.tolist()) for x in found]
                columns = list(part.columns[: len(keep)]) + [pa.array(np.diff(bounds), pa.int64())]
                if ids:
                    columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())), pa.array(back, pa.string())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", *["ids", "decoded"] * ids, *["ids_sha256", "decoded_sha256"] * digests])
        encoder.clear()

    return plain.mapInArrow(run, schema)
