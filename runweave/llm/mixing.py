"""Mixing sources to target weights.

Documents get hash-random keys. Within each source they are ordered by key over
ranges of the key space, the word counts of the ranges are summed, and running
totals over ranges and inside each range tell where a source's budget ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.llm.common import join_counted, materialize, partitions, table
from runweave.llm.text import blocks, utf8, word_counts, words

#: Weights of the sources in order, repeating, and how often a source's words may be taken.
WEIGHTS, MAX_EPOCHS = (5.0, 2.0, 1.0), 3.0
#: Bytes of the sources' names, and 64 for each, up to which a table of them is broadcast; a larger one is joined by its sources.
MOST_SOURCE_BYTES = 16 << 20


def sized(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `size`, the number of words of `text`; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n = pa.array(word_counts(batch.column("text")), pa.int64())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), n], names=[*kept, "size"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*rest, "size long"]))


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Shares of `total` by weight, none above `max_epochs` times its size; the excess goes on by weight to the others.

    What exceeds the limits of all sources is not given out.
    """
    out = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > max_epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = max_epochs * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _keyed(docs: DataFrame) -> Column:
    """A random key of 63 bits for each row, from its id, source and text."""
    return F.xxhash64("doc_id", "source", "text").bitwiseAND(F.lit((1 << 63) - 1))


def _named(docs: DataFrame) -> Column:
    """The source as a name that is never null."""
    return F.coalesce(F.concat(F.lit("+"), docs["source"].cast("string")), F.lit("-"))


def _budgets(light: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> tuple[DataFrame, int, bool]:
    """A row for each source with its `target`, the number of rows, and whether the sources are few enough to be broadcast.

    As `targets`, but the sources stay a table: in each round the sources at
    their limits are summed for each weight, and what they leave is shared anew,
    until no further source is above its limit. Sums are of whole numbers, so
    reruns agree.
    """
    spark = light.sparkSession
    sums = light.groupBy("source", "s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # numbers of rows grow along the order, with gaps between partitions
    found = materialize(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    split = found.groupBy(F.shiftright("place", 33).alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("source_size").alias("size"), F.sum(F.length("s") + 64).alias("bytes"))
    split = sorted(split.collect(), key=lambda r: r["p"])  # a row for each partition
    before, offsets = 0, []
    for r in split:
        offsets.append((r["p"], before))
        before += r["rows"]
    rank = F.broadcast(spark.createDataFrame(offsets, "p long, before long"))
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = found.join(rank, F.shiftright("place", 33) == F.col("p")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("weight", weight)
    n, total = sum(r["n"] for r in split), share * sum(r["size"] for r in split)
    left, open_, seen = total, 0.0, -1
    full = F.lit(False)
    while True:
        parts = ranked.where("source_size > 0").groupBy("weight").agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"), F.count(F.when(full, 1)).alias("full"), F.count(F.when(~full, 1)).alias("open"))
        parts = sorted(parts.collect(), key=lambda r: r["weight"])  # a row for each weight
        if (done := sum(r["full"] for r in parts)) == seen:
            break
        seen, left, open_ = done, total - max_epochs * sum(r["size"] for r in parts), sum(r["weight"] * r["open"] for r in parts)
        if not open_:
            full = F.lit(True)
            break
        full = F.lit(left) * F.col("weight") / F.lit(open_) > F.lit(max_epochs) * F.col("source_size")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(max_epochs) * F.col("source_size")).otherwise(F.lit(left) * F.col("weight") / F.lit(open_ or 1.0))
    per_range = max(64, n // (8 * partitions(spark)))
    out = ranked.select("s", F.col("n").alias("rows"), "source_size", target.alias("target"), F.greatest(F.lit(1), F.ceil(F.col("n") / per_range)).alias("n_ranges"))
    return materialize(out, "mix-budgets", small=True), n, sum(r["bytes"] for r in split) <= MOST_SOURCE_BYTES


def _join_sources(rows: DataFrame, sources: DataFrame, n: int, few: bool) -> DataFrame:
    """`rows` with the columns of their source."""
    return rows.join(F.broadcast(sources), "s") if few else join_counted(rows, sources, ["s"], "rows", n)


def _cut_source(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> tuple[DataFrame, int, bool]:
    """Documents with their place in their source: `start` is the words before them, `rank` their number among equal rows; and as `_budgets`."""
    light = materialize(sized(docs.select("doc_id", "text", "source", _named(docs).alias("s"), _keyed(docs).alias("key"))), "mix-sizes")
    budgets, n, few = _budgets(light, weights, share, max_epochs)
    keyed = _join_sources(light, budgets, n, few)
    keyed = keyed.withColumn("range", F.floor(F.shiftright("key", 32) * F.col("n_ranges") / F.lit(float(1 << 31))))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("s", "range").agg(F.sum("size").alias("words")).select("s", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    # at most 8 ranges for each shuffle partition and one for each source
    placed = keyed.join(F.broadcast(ranges) if few else ranges.hint("merge"), ["s", "range"])
    inside = Window.partitionBy("s", "range").orderBy("key", "doc_id", "size")
    alike = Window.partitionBy("s", "range", "key").orderBy("doc_id", "size")
    placed = (
        placed.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rank", F.row_number().over(alike))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    return placed, n, few


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, a row for each row of (doc_id, text, source).

    Sources in order of code point, null last, have `weights` in turn and get
    `share` of all words together. A source whose target is e times its size and
    a rest is taken e times whole; the rest goes to its first documents by key,
    and the one at the cut gives only its first words, so a source's taken words
    are its target rounded down. `taken` counts words with repeats. Keys hash
    the id, source and text, so reruns agree; equal rows share a key, and which
    of them stands first makes no difference. A document without words is taken
    with 0. Extra columns are ignored; an empty table gives an empty result.
    """
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return _cut_source(docs, weights, share, max_epochs)[0].select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def _first_words(count: str):
    """Cut each text after as many words as the column `count` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = []
            for text, n in zip(batch.column("text").to_pylist(), batch.column(count).to_pylist(), strict=True):
                texts.append(text.encode()[: int(words(*utf8(pa.array([text])))[1][n - 1])].decode())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus, with the columns of `docs`: a row for each time that a document is taken.

    As `plan_mix` says. Only the cut of each source, one row, is joined to the
    texts, which aren't shuffled. The document at the cut keeps its first words
    up to the budget and what separates them; n_chars, if there, follows the
    text. Documents without words are part of no mix. Any further columns may have any names.
    """
    names = docs.columns
    tag = "__"
    while any(c.lower().startswith(tag) for c in names):
        tag += "_"
    key, cut, rank, whole, part, n, times, i = (tag + c for c in ("key", "cut", "rank", "whole", "part", "n", "times", "i"))
    placed, rows_n, few = _cut_source(docs, weights, share, max_epochs)
    cuts = placed.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size")))
    cuts = cuts.select(F.col("s").alias(tag + "s"), F.col("key").alias(cut), F.col("rank").alias(rank), F.col("whole").alias(whole), (F.col("rest") - F.col("start")).alias(part), F.col("rows").alias(tag + "rows"))
    cuts = materialize(cuts, "mix-cuts", small=True)
    rows = docs.withColumn(tag + "s", _named(docs)).withColumn(key, _keyed(docs)).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    # a row for each source with words: few are broadcast, and of many those with the most rows
    rows = rows.join(F.broadcast(cuts), tag + "s") if few else join_counted(rows, cuts, [tag + "s"], tag + "rows", rows_n)
    same = F.col(key) == F.col(cut)
    apart = rows.where(~same).withColumn(times, (F.col(whole) + (F.col(key) < F.col(cut)).cast("long")).cast("int"))
    at_cut = rows.where(same).withColumn(n, F.row_number().over(Window.partitionBy(tag + "s", key).orderBy("doc_id")))
    at_cut = at_cut.withColumn(times, (F.col(whole) + (F.col(n) < F.col(rank)).cast("long")).cast("int"))
    taken = apart.select(*names, times).unionByName(at_cut.select(*names, times)).withColumn(i, F.explode(F.array_repeat(F.lit(0), F.col(times))))
    first = at_cut.where((F.col(n) == F.col(rank)) & (F.col(part) > 0)).select(*names, F.col(part))
    first = first.mapInArrow(_first_words(part), first.schema)
    if "n_chars" in names:
        first = first.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return taken.select(*names).unionByName(first.select(*names))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))
