"""Substring search by an index of character trigrams, without a scan of all texts.

Below the index's folder: ``blocks/part=<p>`` has the blocks, those of neighbouring ids in one part, as spans of some hundred rows; ``grams/slot=<s>`` has a row for each span and
trigram of its texts in lower case, in order of trigrams and spans; ``counts/slot=<s>`` has how many spans have each trigram. A text's last two trigrams are filled up, so that each
character starts one, and queries of one or two characters are prefixes of trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import shown

FILL = "\0"
NEAR = 1024  # ids that may share a part
SPAN = 1024  # blocks of a span
CHARS = 1 << 20  # characters of a span that are looked at together
SPREAD = 4  # tasks, and files, of a slot or part
FEW = 100_000  # candidates that may be broadcast
ENOUGH = 4  # spans of a trigram that need no second one
MOST = 3  # trigrams that are intersected at most


def trigrams(texts: list[str]) -> list[str]:
    """The distinct trigrams of texts that aren't empty."""
    codes = np.frombuffer("".join(t + FILL + FILL for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    own = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) + 2 for t in texts])
    own[ends - 1] = own[ends - 2] = False
    found = np.unique((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[own[:-2]])
    chars = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [chars[i : i + 3] for i in range(0, len(chars), 3)]


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trigrams of each span (part, span, text in lower case), whose rows follow each other. A span of very long texts, or one that is read by two tasks, may have one twice."""
    own, texts, size = None, [], 0

    def made() -> pa.RecordBatch:
        grams = trigrams(texts)
        return pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), "span": pa.array(np.full(len(grams), own[1])), "part": pa.array(np.full(len(grams), own[0], np.int32))})

    for batch in batches:
        rows = zip(batch["part"].to_pylist(), batch["span"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True)
        for part, span, text in rows:
            if texts and ((part, span) != own or size > CHARS):
                yield made()
                texts, size = [], 0
            own = (part, span)
            texts.append(text.decode("utf-8", "replace"))
            size += len(texts[-1])
    if texts:
        yield made()


def slot_of(gram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def build(blocks: DataFrame, path: str, slots: int = 256, parts: int = 256) -> None:
    """Indexes blocks (id, sourceDocId, page, role, text) into a new folder. Blocks without text are never found, so they are left out.

    A document's blocks are in many parts, and parts and a slot's postings are dealt to several tasks, so that neither a document of very many blocks nor a
    trigram that all spans have is one task's. Texts are shuffled once; a span gives each of its trigrams once, so that postings are far fewer than characters.
    """
    near = F.floor(F.col("id") / NEAR)
    own = blocks.where("text != ''").select("id", "sourceDocId", "page", "role", "text", F.pmod(F.xxhash64(near), F.lit(parts)).cast("int").alias("part"))
    ordered = own.repartition("part", F.pmod(F.xxhash64(near, F.lit("spread")), F.lit(SPREAD))).sortWithinPartitions("part", "id")
    ordered.withColumn("span", F.floor(F.monotonically_increasing_id() / SPAN)).write.partitionBy("part").parquet(f"{path}/blocks")
    stored = blocks.sparkSession.read.schema("text string, span long, part int").parquet(f"{path}/blocks")
    grams = stored.select("part", "span", F.lower("text").alias("text")).mapInArrow(postings, "gram string, span long, part int").withColumn("slot", slot_of(F.col("gram"), slots))
    dealt = grams.repartition("slot", F.pmod("span", F.lit(SPREAD))).sortWithinPartitions("slot", "gram", "span")
    dealt.write.option("parquet.writer.version", "PARQUET_2_0").partitionBy("slot").parquet(f"{path}/grams")
    written = blocks.sparkSession.read.schema("gram string, slot int").parquet(f"{path}/grams")
    counts = written.groupBy("slot", "gram").agg(F.count("*").alias("n"))
    counts.repartition("slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/counts")


class Index:
    """An index that build has made, with the same numbers of slots and parts."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 256) -> None:
        self.spark, self.path, self.slots = spark, path, slots

    def _table(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}")

    def _of(self, table: DataFrame, grams: list[str]) -> DataFrame:
        """The rows of some trigrams: the slots they are in are all that is read."""
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(slot_of(F.col("gram"), self.slots)).distinct().collect()
        return table.where(F.col("slot").isin([r[0] for r in wanted]) & F.col("gram").isin(grams))

    def candidates(self, q: str) -> tuple[DataFrame, int]:
        """Spans (span, part) that may have q, which is in lower case, and a bound of their number: those with its rarest trigrams, or for a short q those with a trigram that it starts."""
        postings = self._table("grams", "gram string, span long, part int, slot int")
        if len(q) < 3:
            found = postings.where(F.col("gram").startswith(q))
            n = self._table("counts", "gram string, n long, slot int").where(F.col("gram").startswith(q)).agg(F.sum("n").alias("n")).first()["n"]
            return found.select("span", "part").distinct(), n or 0
        grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        counted = {r["gram"]: r["n"] for r in self._of(self._table("counts", "gram string, n long, slot int"), grams).collect()}
        if len(counted) < len(grams):
            return postings.select("span", "part").limit(0), 0
        rare = sorted(grams, key=lambda g: (counted[g], g))[:MOST]
        rare = rare[:1] if counted[rare[0]] <= ENOUGH else rare
        found = self._of(postings, rare).select("span", "part", "gram").distinct()
        found = found.groupBy("span", "part").agg(F.count("*").alias("n")).where(F.col("n") == len(rare))
        return found.select("span", "part"), counted[rare[0]]

    def search(self, q: str | None, limit: int | None = 20) -> DataFrame:
        """As search.search: the same rows, of which the least ids come first. The texts of candidates are looked at, in the parts that they are in."""
        q = self.spark.range(1).select(F.lower(F.lit((q or "").strip())).alias("q")).first()["q"]
        blocks = self._table("blocks", "id long, sourceDocId long, page int, role string, text string, span long, part int")
        if not q:
            return shown(blocks.limit(0), limit)
        found, bound = self.candidates(q)
        parts = [r["part"] for r in found.select("part").distinct().collect()] if bound else []
        found = F.broadcast(found) if bound <= FEW else found
        near = blocks.where(F.col("part").isin(parts)).join(found, ["span", "part"])
        return shown(near.where(F.contains(F.lower("text"), F.lit(q))), limit)
