"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct five-word shingles. Instead of many wide bands, each with hashes of its own,
a few small collections of minhashes are computed, and every pair of collections is one table: its key combines
both collections' hashes. ``m`` collections of ``r`` minhashes give m(m-1)/2 tables of 2r minhashes each, so that
the minhashes to compute grow with the square root of the tables. Two documents meet in a table if two of their
collections agree. m is the least for which a pair just at the threshold meets nowhere with a probability of
``MISS`` at most.

Documents with equal sets form one class and go on as one. Those that meet become candidates, and candidates
become links only after their full sets have been compared. Pairs that known links connect aren't compared: first
every class is compared with one leader, the most met of those in its table entries. Copies by the thousand
need a comparison each. Classes of entries that aren't in one component then are compared across components, as far as
their rarest shingles leave it open whether they are similar enough: an exact join by prefix and position, so that no link
goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import spread_join, written
from .words import Texts, mix, slices, utf8

_U = np.uint64
SHINGLE = 5
MISS = 2e-5
GROUP = 256
TOKEN = ["token", "other"]  # both lanes of a shingle's hash


def collections(percent: int, r: int) -> int:
    """The least m of which two collections agree, for a pair at the threshold, with a probability of 1 - MISS."""
    p, m = (percent / 100) ** r, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > MISS:
        m += 1
    return m


def shingles(t: Texts, k: int = SHINGLE, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """Distinct shingles of all documents, by ascending hash within each, and each document's first (one more at the end).

    A hash of 64 bits, or with two lanes 128 in two arrays. With 1 to k - 1 words, the whole sequence is the one shingle.
    """
    inside = t.windows(k)[1]
    short = np.flatnonzero((t.counts > 0) & (t.counts < k))
    doc = np.concatenate([t.doc[: inside.size][inside], short])
    both = [np.concatenate([t.windows(k, lane)[0][inside], t.ranges(t.first[short], t.first[short + 1], lane)]) for lane in range(lanes)]
    order = np.lexsort((*reversed(both), doc))
    both, doc = [h[order] for h in both], doc[order]
    new = np.ones(doc.size, bool)
    new[1:] = doc[1:] != doc[:-1]
    for h in both:
        new[1:] |= h[1:] != h[:-1]
    return *(h[new] for h in both), np.searchsorted(doc[new], np.arange(t.n + 1))


def sets(t: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles as numbers, ascending, and each document's first (one more at the end). Equal numbers mean the same words.

    Shingles are sorted by hash, and the words of neighbours with one hash are compared. Should they differ, all are sorted by their words.
    """
    word = np.append(t.numbers(), np.full(k, -1))
    inside = t.windows(k)[1]
    short = np.flatnonzero((t.counts > 0) & (t.counts < k))
    at = np.concatenate([np.flatnonzero(inside), t.first[short]])
    size = np.concatenate([np.full(at.size - short.size, k), t.counts[short]])
    words = [np.where(size > i, word[at + i], -1) for i in range(k)]
    hashes = np.concatenate([t.windows(k)[0][inside], t.ranges(t.first[short], t.first[short + 1])])
    order = np.argsort(hashes, kind="stable")

    def fresh(order: np.ndarray) -> np.ndarray:
        new = np.zeros(order.size, bool)
        new[:1] = True
        for w in words:
            new[1:] |= w[order][1:] != w[order][:-1]
        return new

    new = fresh(order)
    hashes = hashes[order]
    if (new[1:] & (hashes[1:] == hashes[:-1])).any():  # different shingles of one hash may take turns
        order = np.lexsort(words)
        new = fresh(order)
    number = np.empty(order.size, np.int64)
    number[order] = np.cumsum(new) - 1
    doc = t.doc[at]
    by = np.lexsort((number, doc))
    number, doc = number[by], doc[by]
    once = np.ones(by.size, bool)
    once[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    return number[once], np.searchsorted(doc[once], np.arange(t.n + 1))


def signatures(docs: DataFrame, percent: int, r: int) -> DataFrame:
    """doc_id, the set's size n and digest (a, b), and a key of each collection. Empty sets have n = 0."""
    m = collections(percent, r)
    seeds = mix(np.arange(1, m * r + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
    odd = mix(seeds) | _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, other, first = shingles(Texts(*utf8(part.column("text")), lower=True), lanes=2)
                n = np.diff(first)
                full = np.flatnonzero(n)
                keys = np.zeros((part.num_rows, m), _U)
                sums = np.zeros((part.num_rows, 2), _U)
                if full.size:
                    starts = first[:-1][full]
                    for c in range(m):
                        key = np.zeros(full.size, _U)
                        for j in range(c * r, (c + 1) * r):
                            x = (h ^ seeds[j]) * odd[j]
                            key = mix(key + np.minimum.reduceat(x ^ (x >> _U(32)), starts))
                        keys[full, c] = key
                    sums[full, 0], sums[full, 1] = np.add.reduceat(mix(h), starts), np.add.reduceat(mix(other), starts)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), m).cast(pa.list_(pa.int64()))
                digest = [pa.array(sums[:, lane].copy().view(np.int64)) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *digest, flat], names=["doc_id", "n", "a", "b", "keys"])

    return written(docs, run, "doc_id long, n long, a long, b long, keys array<long>")


def with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str, most: int = 256) -> DataFrame:
    """rows, one for each of pairs, with the text t_x or t_y of ``side``. texts: rep, text.

    A rep with more than ``most`` pairs and a thousandth of all has its text sent to as many tasks as it needs. Such reps are fewer than a thousand,
    so that they can be broadcast; all others have few pairs.
    """
    total = max(1, pairs.count())
    sizes = pairs.groupBy(side).agg(F.count("*").alias("size"))
    hot = sizes.where((F.col("size") > most) & (F.col("size") * 1000 > total)).select(side, F.ceil(F.col("size") / max(most, total // 1000)).cast("int").alias("shares"))
    hot = F.broadcast(written(hot))
    shares = F.coalesce("shares", F.lit(1))
    dealt = rows.join(hot, side, "left").withColumn("share", F.pmod(F.xxhash64("x", "y"), shares).cast("int")).drop("shares")
    sent = texts.select(F.col("rep").alias(side), F.col("text").alias(f"t_{side}")).join(hot, side, "left")
    sent = sent.select(side, f"t_{side}", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    return sent.join(dealt.hint("shuffle_hash"), [side, "share"]).drop("share")


def linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y), each listed once, whose full sets are similar enough. texts: rep, text."""
    both = with_text(with_text(pairs, pairs, texts, "y"), pairs, texts, "x").select("x", "y", "t_x", "t_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t_x"):
                for piece in slices(part, "t_y"):
                    at, texts_of, row = [], [], []
                    for side in ("x", "y"):  # the slice's different reps
                        _, first, own = np.unique(piece.column(side).to_numpy(), return_index=True, return_inverse=True)
                        row.append(own + len(at))
                        at += first.tolist()
                        texts_of.append(piece.column(f"t_{side}").take(pa.array(first)))
                    numbers, first = sets(Texts(*utf8(pa.concat_arrays(texts_of)), lower=True))
                    found = []
                    for i, j in zip(row[0].tolist(), row[1].tolist(), strict=True):
                        x, y = numbers[first[i] : first[i + 1]], numbers[first[j] : first[j + 1]]
                        common = int((x[np.minimum(np.searchsorted(x, y), x.size - 1)] == y).sum()) if x.size else 0
                        found.append(common > 0 and 100 * common >= percent * (x.size + y.size - common))
                    yield piece.select(["x", "y"]).filter(pa.array(found, pa.bool_()))

    return written(both, run, "x long, y long")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) after joining the components that links (x, y) connect; comp is each component's least rep.

    Contracts: components that links connect hook on to their least neighbour, hooks are shortened until they point to
    roots, and links between roots go into the next turn.
    """
    a, b = labels.select(F.col("rep").alias("x"), F.col("comp").alias("cx")), labels.select(F.col("rep").alias("y"), F.col("comp").alias("cy"))
    edges = written(links.join(a, "x").join(b, "y").select(F.least("cx", "cy").alias("lo"), F.greatest("cx", "cy").alias("hi")).where("lo < hi").distinct())
    while not edges.isEmpty():
        up = written(edges.groupBy("hi").agg(F.min("lo").alias("to")))
        while True:
            nxt = up.select(F.col("hi").alias("to"), F.col("to").alias("further"))
            longer = written(up.join(nxt, "to", "left").select("hi", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            up = longer.select("hi", "to")
            if longer.where("moved").isEmpty():
                break
        labels = written(labels.join(up.withColumnRenamed("hi", "comp"), "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")))
        lo, hi = up.select(F.col("hi").alias("lo"), F.col("to").alias("l2")), up.select("hi", F.col("to").alias("h2"))
        edges = edges.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("l2", "lo").alias("p"), F.coalesce("h2", "hi").alias("q"))
        edges = written(edges.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).where("lo < hi").distinct())
    return labels


def possible(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of members (rep, n, comp) of different components that may be similar enough; no others are.

    With shingles ordered from rare to common, similar sets share one among the first n - ceil(n * percent / 100) + 1 of
    each, and what may be common behind the first such one bounds their intersection. Shingles of one member alone are only
    counted, as they come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, other, first = shingles(Texts(*utf8(part.column("text")), lower=True), lanes=2)
                rep = part.column("rep").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(first))))
                yield pa.RecordBatch.from_arrays([rep, pa.array(h.view(np.int64)), pa.array(other.view(np.int64))], names=["rep", *TOKEN])

    tokens = written(texts.join(members.select("rep").distinct().hint("shuffle_hash"), "rep").select("rep", "text").mapInArrow(run, "rep long, token long, other long").distinct())
    common = written(tokens.groupBy(*TOKEN).agg(F.count("*").alias("df")).where("df > 1"))
    per_rep = Window.partitionBy("rep")
    ranked = spread_join(tokens, common, TOKEN, "df").withColumn("k", F.row_number().over(per_rep.orderBy("df", *TOKEN))).withColumn("of", F.count("*").over(per_rep))
    sizes = tokens.groupBy("rep").agg(F.count("*").alias("n")).join(members.select("rep", "comp").distinct(), "rep")
    placed = ranked.join(sizes, "rep").withColumn("at", F.col("n") - F.col("of") + F.col("k"))
    prefix = written(placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select(*TOKEN, "rep", "n", "comp", "at"))
    # Tokens of several components. Their members are dealt to groups of some hundred, and each member meets one group in a task.
    mixed = prefix.groupBy(*TOKEN).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    mixed = written(mixed.select(*TOKEN, "size", F.ceil(F.col("size") / GROUP).cast("int").alias("groups")))
    left = written(spread_join(prefix, mixed, TOKEN, "size").drop("size"))
    right = left.select(*TOKEN, *(F.col(c).alias(f"{c}_") for c in ("rep", "n", "comp", "at")), F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("group"))
    left = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    most = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_")) + 1
    met = left.join(right, [*TOKEN, "group"]).where((F.col("rep") < F.col("rep_")) & (F.col("comp") != F.col("comp_")) & (most * (100 + percent) >= (F.col("n") + F.col("n_")) * percent))
    return met.select(F.col("rep").alias("x"), F.col("rep_").alias("y")).distinct()


def components(df: DataFrame, percent: int = 80, text: str = "text", r: int = 3) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id and kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of five-word shingles (A-Z in lower
    case; with fewer words, the whole sequence). component_id is the least doc_id reachable by links, and kept
    says that it is the document's own.

    Null texts and texts without words have empty sets, which are linked with nothing. Rows with a null doc_id
    are linked with nothing either: component_id is null, kept is true. Rows of one doc_id with equal sets get the same
    result; with different sets, each is linked by its own. Columns other than doc_id and text are dropped. A text is worked on
    as a whole, however long: a worker holds some 20 numbers a word of it.

    Links are confirmed by the words of the shingles (beyond 15 bytes of a word, by 120 bits of BLAKE2b); sets are told apart, and shingles
    counted for the search, by 128 bits.
    """
    docs = df.select(df["doc_id"].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    sigs = signatures(docs, percent, r)
    classes = written(sigs.where("n > 0 and doc_id is not null").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    by_key = classes.select("rep", "n", F.posexplode("keys").alias("i", "key"))
    shared = by_key.groupBy("i", "key").agg(F.min("rep").alias("p"), F.max("rep").alias("q")).where("p < q").select("i", "key")
    some = written(by_key.join(shared, ["i", "key"]).groupBy("rep", "n").agg(F.collect_list(F.struct("i", "key")).alias("c")).where(F.size("c") > 1))
    pair = F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y["i"] > x["i"]), lambda y: F.xxhash64(x["i"], y["i"], x["key"], y["key"])))
    entries = some.select("rep", "n", F.explode(F.flatten(pair)).alias("entry"))
    full = written(entries.groupBy("entry").agg(F.count("*").alias("size")).where("size > 1"))
    members = written(spread_join(entries, full, ["entry"], "size"))
    reps = written(members.groupBy("rep").agg(F.sum("size").alias("met")))
    own = docs.join(reps.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("rep"), "text")
    own = written(own.groupBy("rep", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h"))  # repeated rows once
    known = members.join(reps, "rep")
    leader = written(known.groupBy("entry").agg(F.max(F.struct("met", (-F.col("rep")).alias("rep"))).alias("top"), F.count("*").alias("size")))
    first = spread_join(members.select("entry", "rep"), leader, ["entry"], "size").groupBy("rep").agg(F.max("top").alias("top")).select(F.col("rep").alias("y"), (-F.col("top")["rep"]).alias("x")).where("x != y")
    labels = joined(reps.select("rep", F.col("rep").alias("comp")), linked(written(first), own, percent))
    placed = written(members.select("entry", "rep").join(labels, "rep"))
    mixed = written(placed.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("entry", "size"))
    rest = written(spread_join(placed, mixed, ["entry"], "size").select("rep", "comp").distinct())
    labels = joined(labels, linked(written(possible(rest, own, percent)), own, percent))
    rep_of = classes.select("a", "b", "n", "rep").join(labels, "rep", "left").select("a", "b", "n", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc_id", "n", "a", "b").join(rep_of, ["a", "b", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
