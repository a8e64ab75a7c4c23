"""Toxicity by compression distance.

zstandard dictionaries are trained in pairs, one on windows of toxic documents and one on windows of ordinary ones. A window that
the first compresses into fewer bytes than the second is more like toxic text. Both start with one part in common, trained on one half of
the ordinary windows, so that ordinary language comes out alike; each goes on with a part trained on its own class.

There is a pair for each of two lengths of windows. For long ones, a class's part is trained on all its windows, and holds phrases, also of words that
both classes have. For short ones it is to hold single words, but most windows of a toxic document are ordinary: so a class's part is trained on those of its windows that
the common part compresses worst, and the toxic part then again, on those toxic windows alone that it compresses better by so
many bytes as few ordinary windows do. What a document's windows gain is summed up in a few figures, whose weights and threshold are fitted on
further labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, new_columns, written
from .words import slices

THRESHOLDS = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Limits:
    """Bounds of the labelled sample, and sizes.

    The sample is the first ``train_docs`` and ``calibration_docs`` of each class by a hash of doc_id, and of the former's windows the first ``windows`` of
    each class by a hash. The common part of the dictionaries is ``shared_bytes`` long, a class's own one ``class_bytes`` for words and ``phrase_bytes`` for phrases.
    Windows count as unlike the common part if they compress worse than a share ``usual`` of ordinary ones, and as toxic if they gain more than all but
    ``chance`` of them, in each of ``turns``.
    """

    train_docs: int = 1500
    calibration_docs: int = 1500
    windows: int = 60_000
    sample_words: int = 10
    class_words: int = 5
    scales: tuple[int, ...] = (6, 16)
    shared_bytes: int = 32_768
    class_bytes: int = 2_048
    phrase_bytes: int = 4_096
    usual: float = 0.7
    chance: float = 0.01
    turns: int = 2
    level: int = 12


def windows(text: str | None, k: int) -> list[bytes]:
    """The whole text in lower case, k words at a time; an empty text is one empty window."""
    words = (text or "").lower().encode().split()
    return [b" ".join(words[i : i + k]) for i in range(0, len(words), k)] or [b""]


def dictionary(samples: list[bytes], size: int, level: int, **how: int) -> bytes:
    """What zstandard finds worth keeping of samples; all of them if they fit. A zstandard that finds too little to count is asked for less, down to nothing."""
    every = b" ".join(samples)
    if len(every) <= size:
        return every
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, level=level, **how).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def loaded(raw: bytes) -> zstandard.ZstdCompressor:
    """A compressor that searches a dictionary well also for windows of a few words."""
    at = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=4, window_log=17, hash_log=15, chain_log=16, write_content_size=False, write_dict_id=False, write_checksum=False)
    data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=at)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=at)


def gains(ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    """Bytes by which the toxic dictionary beats the ordinary one, by window."""
    a, b = (np.fromiter(map(len, map(c.compress, parts)), np.int64, len(parts)) for c in (ordinary, toxic))
    return (a - b).astype(float)


def figures(pairs: list[zstandard.ZstdCompressor], texts: list[str | None], scales: tuple[int, ...]) -> np.ndarray:
    """A row for each document: what its windows' gains of each length come to. pairs: for each length, an ordinary and a toxic compressor."""
    out = []
    for i, k in enumerate(scales):
        cut = [windows(t, k) for t in texts]
        first = np.cumsum([0, *map(len, cut[:-1])]) if cut else np.zeros(0, np.int64)
        n = np.array([len(c) for c in cut])
        gain = gains(*pairs[2 * i : 2 * i + 2], [w for c in cut for w in c])
        over = [np.add.reduceat((gain >= t).astype(float), first) for t in THRESHOLDS] if n.size else []
        if n.size:
            out += [np.add.reduceat(gain, first) / n, np.maximum.reduceat(gain, first) / 10, *(o / n * 10 for o in over), *((o > 0).astype(float) for o in over[1:])]
    return np.column_stack(out) if out else np.zeros((0, 0))


def trained(toxic: list[bytes], ordinary: list[bytes], at: Limits) -> tuple[bytes, bytes, bytes, bytes]:
    """The dictionaries: ordinary and toxic for words, ordinary and toxic for phrases."""
    half = len(ordinary) // 2
    shared = dictionary(ordinary[:half] or ordinary, at.shared_bytes, at.level)
    phrases = [shared + dictionary(ws, at.phrase_bytes, at.level)[-at.phrase_bytes :] for ws in (ordinary[half:], toxic)]
    bad, good = ([p for w in ws for p in windows(w.decode("utf-8", "replace"), at.class_words)] for ws in (toxic, ordinary[half:]))
    good, fresh = good[::2], good[1::2] or good
    plain = loaded(shared)

    def cost(parts: list[bytes]) -> np.ndarray:
        return np.array([len(plain.compress(p)) / max(1, len(p)) for p in parts])

    def own(parts: list[bytes]) -> bytes:
        return shared + dictionary(parts, at.class_bytes, at.level, k=16, d=6)[-at.class_bytes :]

    usual = cost(good)
    limit = np.quantile(usual, at.usual)
    words = [own([p for p, c in zip(good, usual, strict=True) if c > limit] or good), own([p for p, c in zip(bad, cost(bad), strict=True) if c > limit] or bad)]
    for _ in range(at.turns):
        pair = [loaded(raw) for raw in words]
        least = np.quantile(gains(*pair, fresh), 1 - at.chance)
        if marked := [p for p, gain in zip(bad, gains(*pair, bad), strict=True) if gain > max(0, least)]:
            words[1] = own(marked)
    return *words, *phrases


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a logistic model by Newton's method with a small ridge, shifted so that 0.5 is the score where F1 is largest."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hit, picked = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (picked + (weight * y).sum())
    best = int(np.argmax(f1))
    w[0] -= (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    return w


def fit(docs: DataFrame, labels: DataFrame, at: Limits = Limits()) -> dict | None:
    """A model from the labelled rows of docs that aren't held out; None if a class has no document.

    labels has doc_id and toxic (0 or 1; other values and nulls are left out). Bounded by ``at``, whatever the
    table's size: the driver gets ids, windows and figures of so many documents at most. Of several rows of one doc_id, that of the least text is taken.
    """
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(fold(known["doc_id"], 5) != 0).withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    prior = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = [known.where((F.col("toxic") == c) & (F.pmod("h", F.lit(2)) == part)).orderBy("h", "doc_id").limit(n).withColumn("part", F.lit(part)) for c in (0, 1) for part, n in ((0, at.train_docs), (1, at.calibration_docs))]
    sample = {r["doc_id"]: (r["toxic"], r["part"]) for p in picks for r in p.select("doc_id", "toxic", "part").collect()}
    if not sample or len({c for c, _ in sample.values()}) < 2:
        return None
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i, *v) for i, v in sample.items()], "doc_id long, toxic int, part int")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = written(texts.groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")))  # the one pass over docs; of an id's rows, the least text
    k = at.sample_words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = zip(part.column("toxic").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                found = [(c, w, i) for c, i, t in rows for w in windows(t, k)]
                columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "w", "doc_id"])

    cut_up = texts.where("part = 0").mapInArrow(cut, "toxic int, w binary, doc_id long").withColumn("h", F.xxhash64("w", "doc_id"))
    lists = [[bytes(r["w"]) for r in cut_up.where(F.col("toxic") == c).orderBy("h", "w").limit(at.windows).select("w").collect()] for c in (1, 0)]
    if not all(lists):
        return None
    raw = trained(*lists, at)
    model = {"dictionaries": raw, "scales": at.scales, "weights": None}
    rows = score(texts.where("part = 1"), model, keep=("doc_id", "toxic"), details=True).collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not rows or y.min() == y.max():
        return None
    share = {c: prior[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    model["weights"] = fitted(np.array([r["figures"] for r in rows]), y, weight * len(y) / weight.sum()).tolist()
    return model


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), details: bool = False) -> DataFrame:
    """Every whole text's score (0 to 1) and predicted (1 if score >= 0.5); with details, its figures.

    Null and empty texts are one empty window. Without a model every score is 0. Rows are independent: repeated
    rows and null ids stay as they are. Columns not in ``keep`` are dropped; names in it that are made here raise. Texts of any length are cut up whole. The model (four dictionaries of bounded
    size and a few weights) goes to the workers with the function. Needs no shuffle.
    """
    new_columns(keep, ["score", "predicted", "figures"])
    plain = docs.select(*keep, docs[text].cast("string").alias("__text"))
    names = [*keep, "score", "predicted", *["figures"] * details]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keep)]) + ", score double, predicted int" + ", figures array<double>" * details

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = None
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").to_pylist()
                if model is None:
                    found, scores = [[] for _ in texts], np.zeros(len(texts))
                else:
                    ready = ready or list(map(loaded, model["dictionaries"]))
                    found = figures(ready, texts, model["scales"])
                    z = found @ model["weights"][1:] + model["weights"][0] if model["weights"] else np.zeros(len(texts))
                    scores, found = 1 / (1 + np.exp(-np.clip(z, -30, 30))), found.tolist()
                columns = list(part.columns[: len(keep)]) + [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.list_(pa.float64()))] * details, names=names)

    return plain.mapInArrow(run, schema)
