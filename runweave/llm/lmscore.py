"""Cross-entropy difference of a target and a background language model.

Both are bigram models over words, backed off to unigrams, and matched: one
vocabulary, one order, one smoothing, and background counts scaled to as many
words as the target has. The vocabulary is all words of all documents; words and
bigrams are told apart by 64 bits, and every one of every document is counted. A
document's score is the mean over its words of the loss under the target model
less that under the background model, so that what reads like the target is
below 0 (Moore and Lewis, 2010).

The counts grow with the corpus and are never in one place. Texts are cut into
blocks; a block counts its own keys, sorted, and deals them by ranges of keys,
whose number follows the words. Each range adds up its blocks' counts and
answers each block with what others have of its keys, in its order, without the keys. A
key that is common everywhere so has one entry for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from runweave.llm.common import bitmap, in_bitmap, materialize, table
from runweave.llm.text import U64, blocks, mix, utf8, word_counts, word_hashes, words

#: Bytes of text in a block, and words of all texts for each range of bigrams; ranges of words are FEWER times fewer.
TEXT_BYTES, RANGE_WORDS, FEWER = 1 << 22, 1 << 20, 4
#: What is added to each word's count, and the weight of the unigram estimate in counts of a bigram's first word.
FLOOR, BACKOFF = 0.1, 2.0


def _slots(batch: pa.RecordBatch | pa.Table, vocabulary: int | None, bigrams: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its key, that of the word before it (0 at a document's start), and the bigram's; and where documents begin.

    Keys are 64-bit hashes, or slots if `vocabulary` and `bigrams` give their numbers.
    """
    buf, offsets = utf8(batch.column("text"))
    starts, ends, first = words(buf, offsets)
    own = word_hashes(buf, starts, ends)
    if vocabulary:
        own = own % U64(vocabulary - 1) + U64(1)  # slot 0 is the start
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    pair = mix(before * U64(0x9E3779B97F4A7C15) + own)
    if bigrams:
        pair &= U64(bigrams - 1)
    return own.astype(np.int64), before.astype(np.int64), pair.astype(np.int64), first


def _in_text(doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each word, how often its slot comes up in its text."""
    _, which, count = np.unique(doc << 32 | slot, return_inverse=True, return_counts=True)
    return count[which]


def _blocks(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each block: its id, how many words targets have and all texts, and its rows of doc_id, is_target and text, compressed.

    The texts of targets, let through by a bitmap of their ids, are the only
    ones that are shuffled.
    """
    hits = docs.sparkSession.sparkContext.broadcast(bitmap(targets.select(F.xxhash64("doc_id")), targets.count()))

    def through(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                likely = in_bitmap(hits.value, batch.column("spot").to_numpy()) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(likely == hit)).select(["doc_id", "text"])

        return docs.withColumn("spot", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for i, part in enumerate(blocks(batches, limit=TEXT_BYTES)):
            n, flag = word_counts(part.column("text")), part.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_pydict({"block": pa.array([at + i], pa.int64()), "n_target": pa.array([int(n[flag].sum())], pa.int64()), "n_all": pa.array([int(n.sum())], pa.int64()), "data": pa.array([_packed(part)], pa.binary())})

    # always by merging: a small side that is broadcast at first would make the texts' shuffle come later
    joined = through(True).join(targets.withColumn("is_target", F.lit(True)).hint("merge"), "doc_id", "left")
    flagged = through(False).withColumn("is_target", F.lit(False)).unionByName(joined.withColumn("is_target", F.coalesce("is_target", F.lit(False))))
    flagged = flagged.select("doc_id", "is_target", "text")
    return materialize(flagged.mapInArrow(cut, "block long, n_target long, n_all long, data binary"), "lm-blocks")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _spelled(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all; only the upper bytes compress."""
    steps = np.diff(keys, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return steps[:6].tobytes() + zstandard.compress(steps[6:].tobytes())


def _keys(data: bytes, n: int) -> np.ndarray:
    """The n keys of `_spelled`."""
    steps = np.frombuffer(data[: 6 * n] + zstandard.decompress(data[6 * n :]), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8")[:, 0], dtype=U64)


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts that are mostly small, byte by byte of all."""
    return zstandard.compress(counts.astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes())


def _counts(data: bytes, n: int) -> np.ndarray:
    """Rows of n counts of `_squeezed`."""
    flat = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(flat.T).view("<i8").reshape(-1, n)


def _own(found: _Keys, places: list[np.ndarray], flag: np.ndarray) -> np.ndarray:
    """For each thing that is counted two rows of a block's counts of its keys: those in targets and all."""
    return np.stack([np.bincount(x, minlength=len(found.keys)) for at in places for x in (at[flag], at)])


class _Keys:
    """Keys in a block: sorted, for each one given its place, and where ranges begin."""

    def __init__(self, slots: np.ndarray, ranges: int):
        self.keys, self.at = np.unique(slots.view(U64), return_inverse=True)
        of = (self.keys >> U64(32)) * U64(ranges) >> U64(32)
        self.cuts = np.searchsorted(of, np.arange(ranges + 1, dtype=U64))

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """Those that have keys, each with the places of its first key and behind its last."""
        for r in np.flatnonzero(np.diff(self.cuts)):
            yield int(r), int(self.cuts[r]), int(self.cuts[r + 1])


def _places(block: pa.Table, ranges: tuple[int, int], vocabulary: int | None, bigrams: int | None) -> tuple[np.ndarray, list[tuple[_Keys, list[np.ndarray]]]]:
    """Numbers of words of a block's texts; and its keys of words and of bigrams, each with the places of what is counted: words and words before, bigrams."""
    own, before, pair, first = _slots(block, vocabulary, bigrams)
    word, both = _Keys(np.concatenate([own, before]), ranges[0]), _Keys(pair, ranges[1])
    return np.diff(first), [(word, [word.at[: len(own)], word.at[len(own) :]]), (both, [both.at])]


def _sums(texts: DataFrame, ranges: tuple[int, int], vocabulary: int | None, bigrams: int | None) -> DataFrame:
    """(block, part, counts) for each block and range of keys: the counts in targets and in all texts of other blocks of the block's keys in this range.

    A row without block gives the number of distinct words or bigrams of each
    part, `n`. Parts are the ranges of words, then those of bigrams; a word has
    its counts as the first of a bigram besides.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                rows = _unpacked(data.as_buffer())
                n, kinds = _places(rows, ranges, vocabulary, bigrams)
                flag = np.repeat(rows.column("is_target").to_numpy().astype(bool), n)
                for offset, (found, places) in zip((0, ranges[0]), kinds, strict=True):
                    counts = _own(found, places, flag)
                    got = list(found.ranges())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([offset + r for r, _, _ in got], pa.int32()),
                            "block": pa.array([block] * len(got), pa.int64()),
                            "size": pa.array([b - a for _, a, b in got], pa.int64()),
                            "keys": pa.array([_spelled(found.keys[a:b]) for _, a, b in got], pa.binary()),
                            "counts": pa.array([_squeezed(counts[:, a:b]) for _, a, b in got], pa.binary()),
                        }
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = defaultdict(list)
        for batch in batches:
            for part, *got in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "size", "keys", "counts")), strict=True):
                parts[part].append(got)
        while parts:
            part, got = parts.popitem()
            sizes = [n for _, n, _, _ in got]
            distinct, at = np.unique(np.concatenate([_keys(keys, n) for _, n, keys, _ in got]), return_inverse=True)
            counts = np.concatenate([_counts(c, n) for _, n, _, c in got], axis=1)
            sums = np.stack([np.bincount(at, weights=c, minlength=len(distinct)) for c in counts]).astype(np.int64)
            ends = np.cumsum(sizes)
            answers = [_squeezed(sums[:, at[b - n : b]] - counts[:, b - n : b]) for n, b in zip(sizes, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([*(block for block, *_ in got), None], pa.int64()),
                    "part": pa.array([part] * (len(got) + 1), pa.int32()),
                    "counts": pa.array([*answers, None], pa.binary()),
                    "n": pa.array([None] * len(got) + [int(np.count_nonzero(sums[1]))], pa.int64()),
                }
            )

    dealt = texts.select("block", "data").mapInArrow(count, "part int, block long, size long, keys binary, counts binary").repartition(sum(ranges), "part")
    return materialize(dealt.mapInArrow(add, "block long, part int, counts binary, n long"), "lm-sums")


def score(docs: DataFrame, targets: DataFrame, vocabulary: int | None = None, bigrams: int | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row of (doc_id, text).

    `targets` has the ids, column doc_id, of the documents that the target model
    learns from; all others, those without id too, are background. Losses are
    means over a text's words, in nats; a text that is null or has no words has
    0 tokens and null losses and score. A document's own words are taken out of
    the counts of its model before it is scored, but not those of its copies.
    Without target words, or without background words, that model is uniform.
    Extra columns are ignored, repeated rows count each. `vocabulary` and
    `bigrams` fold words and bigrams into so many slots; by default none are.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    targets = targets.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull()).distinct()
    texts = _blocks(docs, targets)
    got = texts.agg(F.sum("n_target").alias("target"), F.sum("n_all").alias("all")).first()
    totals = {True: got["target"] or 0, False: (got["all"] or 0) - (got["target"] or 0)}
    scale = totals[True] / totals[False] if totals[True] and totals[False] else 1.0
    most = 1 + (got["all"] or 0) // RANGE_WORDS
    ranges = (1 + most // FEWER, most)
    sums = _sums(texts, ranges, vocabulary, bigrams)
    size_of_all = vocabulary or sums.where(F.col("block").isNull() & (F.col("part") < ranges[0])).agg(F.sum("n").alias("n")).first()["n"] or 0

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _unpacked(block.column("data")[0].as_buffer())
        n, kinds = _places(rows, ranges, vocabulary, bigrams)
        doc = np.repeat(np.arange(len(n)), n)
        is_target = rows.column("is_target").to_numpy().astype(bool)
        answer = dict(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        inside, counts = [], {True: [], False: []}
        for offset, (found, places) in zip((0, ranges[0]), kinds, strict=True):
            others = [_counts(answer[offset + r], b - a) for r, a, b in found.ranges()]
            sums = np.concatenate([*others, np.zeros((2 * len(places), 0), dtype=np.int64)], axis=1) + _own(found, places, is_target[doc])
            for at, target, every in zip(places, sums[::2], sums[1::2], strict=True):
                inside.append(_in_text(doc, at))
                counts[True].append(target[at])
                counts[False].append((every - target)[at])
        losses = []
        for kind in (True, False):
            size = 1.0 if kind else scale
            own = is_target == kind  # the text's own words are taken out
            word, context, both = (size * np.maximum(x - own[doc] * mine, 0) for x, mine in zip(counts[kind], inside, strict=True))
            plain = (word + FLOOR) / (size * np.maximum(totals[kind] - own * n, 0)[doc] + FLOOR * size_of_all)
            # where slots of bigrams are shared, a bigram may seem more frequent than its first word
            chance = (np.minimum(both, context) + BACKOFF * plain) / (context + BACKOFF)
            losses.append(pa.array(np.bincount(doc, weights=-np.log(chance), minlength=len(n)) / np.maximum(n, 1), pa.float64(), mask=n == 0))
        return pa.table([rows.column("doc_id"), pa.array(n, pa.int64()), *losses], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    answers = sums.where(F.col("block").isNotNull()).select("block", "part", "counts")
    losses = texts.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return losses.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target are those with a label of quality 1."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good)
