"""Exact Jaccard join of documents on their sets of word n-grams.

The join is a sparse product of the document by n-gram incidence matrix with its
transpose, done in blocks and thinned by bounds that follow from set sizes:

- Documents with equal sets are one row, a class.
- Columns are ordered from rare to frequent. For a similarity of t, only the
  first n - ceil(t n) + 1 entries of a row are multiplied. Products of rows whose
  sizes can't link are left out, and a pair is dropped when its accumulated
  overlap is below what a linked pair of these sizes has at least.
- What is left has its full overlap counted, row against row.

A group of near copies would give all its pairs. So the first products take, for
each column and band of sizes, only the pairs with one chosen member; links
found there join classes into components. The last product takes all pairs of
different components. Pairs inside one component are connected already, so no
component changes by leaving them out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.llm.common import bitmap, discard, in_bitmap, join_counted, materialize, scratch, table
from runweave.llm.components import components
from runweave.llm.text import U64, blocks, mix, shingles, utf8, word_hashes, words

#: Words of a shingle and the least similarity, in per cent.
WIDTH, PERCENT = 3, 90
#: Products with one member of each column at most, and members tried for each class in one.
STAR_ROUNDS, STAR_TRIES = 6, 3
#: Pairs are tried there if they share this part of the columns that links need, as the columns have other chosen members too.
STAR_SHARE = 4
#: They end when at most one in so many pairs tried is a link; the last product finds all that is left.
STAR_STOP = 20
#: Or when the last product has so many products for each entry at most.
FEW_PAIRS = 64
#: Counters of n-gram frequency, which only order the columns, and the slots in one row of them.
SLOTS, SLOT_ROW = 1 << 20, 1 << 13
_SIGN = 1 << 63


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A to Z lower-cased."""
    buf, offsets = utf8(batch.column("text"))
    starts, ends, first = words(buf, offsets)
    values, at = shingles(word_hashes(buf, starts, ends, lower=True), first, width)
    for i in range(batch.num_rows):
        yield np.unique(values[at[i] : at[i + 1]])


def _class_id(values: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = int(mix(mix(values ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True) ^ U64(len(values)))[0])
    return total - 2 * (total & _SIGN)


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """For each slot, the bit length of the number of n-grams in all documents that fall there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in blocks(batches):
            buf, offsets = utf8(batch.column("text"))
            starts, ends, first = words(buf, offsets)
            values, _ = shingles(word_hashes(buf, starts, ends, lower=True), first, width)
            total += np.bincount((values & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if total.any():
            for i, row in enumerate(total.reshape(-1, SLOT_ROW)):
                yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(row.astype("<i8").tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(counts), dtype="<i8")
        for i, row in sums.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([i], pa.int32()), "counts": pa.array([np.frexp(row.astype(float))[1].astype(np.uint8).tobytes()], pa.binary())})

    schema = "row int, counts binary"
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), dtype=np.uint8)
    for r in docs.select("text").mapInArrow(count, schema).repartition("row").mapInArrow(add, schema).collect():  # SLOTS bytes in all
        out[r["row"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.reshape(-1)


def _prefix_length(n: int, percent: int) -> int:
    """How many first columns a set of size n shows."""
    return n - -(-percent * n // 100) + 1


def _rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, the class and the first columns of each document; n is 0 without words."""
    frequency = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = frequency.value
        for batch in blocks(batches):
            sizes, ids, firsts = [], [], []
            for values in _sets(batch, width):
                n = len(values)
                rank = slots[(values & U64(SLOTS - 1)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[: _prefix_length(n, percent) if n else 0]
                sizes.append(n)
                ids.append(_class_id(values))
                firsts.append(values[order].view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(x) for x in firsts])))
            tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "cid": pa.array(ids, pa.int64()), "tokens": tokens})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cid long, tokens array<long>")


def _needed_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, members) for each class of `wanted` (cid, first_id), and a few others.

    The texts aren't shuffled: a bitmap of the wanted classes' first documents
    tells which texts to take up.
    """
    count = wanted.count()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("first_id")), count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(shared.value, batch.column("spot").to_numpy())
            for part in blocks(iter([batch.filter(pa.array(hit))])):
                sets = list(_sets(part, width))
                yield pa.RecordBatch.from_pydict({"cid": pa.array([_class_id(x) for x in sets], pa.int64()), "members": pa.array([x.tobytes() for x in sets], pa.binary())})

    return docs.select("text", F.xxhash64(F.col("doc_id").cast("long")).alias("spot")).mapInArrow(run, "cid long, members binary")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs of classes (a, b) that are linked, by their full overlap."""
    wanted = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct().join(classes.select("cid", "first_id"), "cid")
    wanted = materialize(wanted, "jaccard-wanted", small=True)
    sets = _needed_sets(docs, wanted, width)
    discard(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                at = np.searchsorted(two, one)
                at[at == len(two)] = 0
                overlap = int(np.count_nonzero(two[at] == one))
                keep.append(100 * overlap >= percent * (len(one) + len(two) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # merged at every size: to broadcast the pairs of a small input only makes a large one behave otherwise.
    # Both joins take the sets from one shuffle.
    with_b = pairs.hint("merge").join(sets.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")
    both = with_b.hint("merge").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links", small=True)


def _may_link(percent: int) -> Column:
    """Whether classes of sizes n1 and n2 that have `shared1` and `shared2` columns in common with any others may link."""
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    return (F.lit(100) * small >= F.lit(percent) * large) & (F.least("shared1", "shared2") >= _least_shared(percent))


def _alike(percent: int) -> Column:
    """Whether entries 1 and 2 of a column are of different components, and their classes may link."""
    return (F.col("component1") != F.col("component2")) & _may_link(percent)


def _first_shared(percent: int) -> Column:
    """Whether this may be the first column that the two sets share: then the overlap is at most this and what follows."""
    most = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n1") + F.col("n2"))


def _least_shared(percent: int) -> Column:
    """Columns that a linked pair shows in common at least.

    One of the two sets shows p columns up to where the other's end as well. It
    has n - overlap others than the shared ones at most, so p - n + overlap of
    them are shared.
    """
    overlap = F.ceil(F.lit(percent) * (F.col("n1") + F.col("n2")) / F.lit(100 + percent))
    least = overlap + 1 - F.ceil(F.lit(percent) * F.greatest("n1", "n2") / F.lit(100))
    return F.greatest(F.lit(1), least)


def _side(entries: DataFrame, k: int, *keys: str) -> DataFrame:
    return entries.select(*keys, *(F.col(c).alias(f"{c}{k}") for c in ("cid", "n", "pos", "shared", "component")))


def _star(known: DataFrame, turn: int, percent: int, entries: int) -> DataFrame:
    """Pairs (a, b) of a class with one member of a column; the members that it meets most often.

    At first that is the member with the fewest rarer n-grams, as it differs
    least from the others and links with most of them; later a random one.
    """
    drawn = F.xxhash64("token", "cid", F.lit(turn)) if turn else F.col("pos") / F.col("n")
    # two placements of the bands, so that close sizes are in one band of either
    place = F.log("n") / F.lit(math.log(200 / (100 + percent)))
    rows = known.withColumn("band", F.explode(F.array(2 * F.floor(place), 2 * F.floor(place + 0.5) + 1)))
    heads = rows.groupBy("token", "band").agg(F.min(F.struct(drawn.alias("drawn"), "cid", "n", "pos", "shared", "component")).alias("head"), F.count(F.lit(1)).alias("times")).select("token", "band", "times", "head.*")
    met = join_counted(_side(rows, 1, "token", "band"), _side(heads, 2, "token", "band", "times"), ["token", "band"], "times", 2 * entries).drop("times").where(_alike(percent)).groupBy("cid1", "cid2", "n1", "n2").agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("cid1").orderBy(F.desc("times"), F.xxhash64("cid2", F.lit(turn)))
    chosen = met.where(F.col("times") * STAR_SHARE >= _least_shared(percent)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= STAR_TRIES)
    return chosen.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct()


def _labelled(entries: DataFrame, label: DataFrame) -> DataFrame:
    """The entries with the component of their class."""
    known = entries.join(label.select(F.col("node").alias("cid"), "component").hint("merge"), "cid", "left")
    return materialize(known.withColumn("component", F.coalesce("component", "cid")), "jaccard-open")


def _few_pairs(known: DataFrame) -> bool:
    """Whether the columns have few pairs of entries of different components, for the number of entries."""
    sizes = known.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    got = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs"), F.sum("n").alias("entries")).first()
    return (got["pairs"] or 0) <= FEW_PAIRS * (got["entries"] or 0)


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of (doc_id, text).

    Two documents link when 100 * overlap >= percent * union; component_id is
    the smallest doc_id reachable by links. A text that is null or without words
    has an empty set, links with nothing and is its own component. With fewer
    words than `width` the whole sequence is the one shingle. Repeated rows and
    ids are rows of their own. A null id counts as no id when the smallest is
    sought. Sets are told apart by 64 bits; so are shingles.
    """
    rows = materialize(_rows(docs, width, percent), "jaccard-rows")
    with scratch("jaccard-answer"):
        answer = _answer(docs, rows, width, percent)
    out = rows.where("n > 0").select("doc_id", "n", "cid").join(answer, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def _answer(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(cid, component_id) of every class of `rows`."""
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = materialize(classes, "jaccard-classes")
    entries = classes.select("cid", "n", F.posexplode("tokens").alias("pos", "token"))
    total = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # of columns that two classes show at least; a class has as many as it shows columns at most
    entries = join_counted(entries, shared, ["token"], "times", total).drop("times").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("cid")))
    entries = materialize(entries, "jaccard-entries")

    known, links, total = entries.withColumn("component", F.col("cid")), [], entries.count()
    for turn in range(STAR_ROUNDS):
        tried = materialize(_star(known, turn, percent, total), "jaccard-star", small=True)
        links.append(_linked(docs, classes, tried, width, percent))
        label = components(reduce(DataFrame.unionAll, links), "jaccard-components")
        if turn:
            discard(known)
        known = _labelled(entries, label)
        if links[-1].count() * STAR_STOP <= tried.count() or _few_pairs(known):
            break
    # of a pair, the smaller set stands in its band of sizes and the next one, the larger in its own
    place = F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-9)).cast("long")
    small = _side(known.withColumn("band", F.explode(F.array(place, place + 1))), 1, "token", "band")
    large = _side(known.withColumn("band", place), 2, "token", "band")
    once = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("cid1") < F.col("cid2")))
    rest = small.join(large.hint("merge"), ["token", "band"]).where(once & _alike(percent) & _first_shared(percent))
    rest = materialize(rest.select("cid1", "cid2", "n1", "n2").distinct(), "jaccard-candidates")
    shown = known.select("cid", "token")
    rest = rest.join(shown.toDF("cid1", "token"), "cid1").join(shown.toDF("cid2", "token"), ["cid2", "token"])
    rest = rest.groupBy("cid1", "cid2", "n1", "n2").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= _least_shared(percent)).select(F.col("cid1").alias("a"), F.col("cid2").alias("b"))
    links.append(_linked(docs, classes, materialize(rest, "jaccard-rest", small=True), width, percent))
    label = components(reduce(DataFrame.unionAll, links), "jaccard-components")

    named = classes.select("cid", "first_id").join(label.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("times"))
    return materialize(join_counted(named, lowest, ["component"], "times", classes.count()).select("cid", "component_id"), "jaccard-answer")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
