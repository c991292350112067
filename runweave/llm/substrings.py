"""Removal of repeated passages, found from difference-cover anchors.

A passage is a window of WINDOW consecutive words. Anchors, shorter windows of
WINDOW - PERIOD + 1 words, are hashed only where the position modulo PERIOD lies
in a difference cover: any two residues have a common shift, below PERIOD, that
takes both into the cover. So two equal windows, wherever they start, hold an
equal anchor at the same place within both, and every repeated window contains
an anchor that occurs elsewhere. Each such anchor is extended to the windows
around it, whose 128-bit hashes are then compared exactly.

Anchors and windows that repeat within a task are decided there, and one of
them goes on, so that a passage that many documents share makes no hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import bitmap, in_bitmap, join_counted, materialize, partitions, table
from runweave.llm.text import U64, _power_table, blocks, mix, utf8, word_hashes, words

WINDOW, PERIOD = 35, 21
#: Every residue modulo 21 is a difference of two of these.
COVER = (0, 1, 4, 14, 16)
#: Occurrences that a task compares at once, and texts that it remembers.
FLUSH, REMEMBERED = 1 << 20, 1 << 20
#: Occurrences that a task gets to compare, in expectation.
PER_TASK = 2_000_000
_WINDOW_BASE = 0xD6E8FEB86659FD93 | 5
#: What an occurrence needs: to be compared; to be compared, and known to repeat; nothing, it repeats.
_SINGLE, _REPEATED, _DECIDED = 0, 1, 2


def _seen_before(seen: set[int], keys: np.ndarray) -> np.ndarray:
    """Which of the keys came up earlier; the set is emptied when it is large, which only costs work."""
    out = np.zeros(len(keys), dtype=bool)
    for i, key in enumerate(keys.tolist()):
        out[i] = key in seen
        seen.add(key)
    if len(seen) > REMEMBERED:
        seen.clear()
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `keys` and, for each in that order, whether its key equals the one before."""
    order = np.lexsort(keys.T[::-1])
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    return order, same


class _Gather:
    """Occurrences (hash columns, text, place) of one task, thinned before they are sent."""

    def __init__(self, hashes: int):
        self.width = hashes
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: list[np.ndarray], text: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.stack([*(h.view(np.int64) for h in hashes), text, place], axis=1))
        self.size += len(text)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rows = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        order, same = _runs(rows[:, : self.width])
        rows = rows[order]
        again = same.copy()
        again[:-1] |= same[1:]
        kind = np.where(again & ~same, _REPEATED, _SINGLE)
        decided = rows[again].copy()
        # what is decided needs no meeting place; it is dealt evenly
        decided[:, 0] = mix((decided[:, self.width] ^ (decided[:, self.width + 1] << 20)).view(U64)).view(np.int64)
        sent = rows[~same].copy()
        sent[:, -1] = sent[:, -1] * 4 + kind[~same]
        decided[:, -1] = decided[:, -1] * 4 + _DECIDED
        yield _batch(np.concatenate((sent, decided)))


def _names(hashes: int) -> list[str]:
    return [*(f"hash{i}" for i in range(hashes)), "h", "ref"]


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=_names(rows.shape[1] - 2))


def _schema(hashes: int) -> str:
    return ", ".join(f"{n} long" for n in _names(hashes))


def _repeats(occurrences: DataFrame, hashes: int, n: int) -> DataFrame:
    """(h, places) of all occurrences that have an equal elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            done = rows[:, -1] & 3 == _DECIDED
            if done.any():
                yield pa.RecordBatch.from_pydict({"h": pa.array(rows[done, -2]), "place": pa.array(rows[done, -1] >> 2)})
            parts.append(rows[~done])
        if not parts:
            return
        rows = np.concatenate(parts)
        rows = rows[np.lexsort(rows[:, ::-1].T)]  # by hash, text, place and need
        if not len(rows):
            return
        change = (rows[1:, :hashes] != rows[:-1, :hashes]).any(axis=1)
        first = np.concatenate(([True], change))
        other = np.concatenate(([False], ~change & ((rows[1:, -2] != rows[:-1, -2]) | (rows[1:, -1] >> 2 != rows[:-1, -1] >> 2))))
        run_of = np.cumsum(first) - 1
        repeated = np.bincount(run_of, weights=other | (rows[:, -1] & 3 == _REPEATED)) > 0
        out = rows[repeated[run_of] & (rows[:, -1] & 3 == _SINGLE)]
        yield pa.RecordBatch.from_pydict({"h": pa.array(out[:, -2]), "place": pa.array(out[:, -1] >> 2)})

    return occurrences.repartition(n, "hash0").mapInArrow(run, "h long, place long").groupBy("h").agg(F.collect_list("place").alias("places"))


def _summary(texts: DataFrame) -> DataFrame:
    """doc_id, h, n_words and the hash of all words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shas = [], []
            for text in batch.column("text"):
                parts = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes are split at the six separators
                n.append(len(parts))
                shas.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n_words": pa.array(n, pa.int64()), "sha": pa.array(shas, pa.string())})

    return texts.mapInArrow(run, "doc_id long, h long, n_words long, sha string")


def _anchors(texts: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    width = window - period + 1
    in_cover = np.zeros(period, dtype=bool)
    in_cover[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather, seen = _Gather(1), set()
        for batch in blocks(batches):
            keys = batch.column("h").to_numpy()
            fresh = ~_seen_before(seen, keys)
            buf, offsets = utf8(batch.column("text"))
            starts, ends, first = words(buf, offsets)
            hashes = word_hashes(buf, starts, ends)
            count = np.diff(first)
            doc = np.repeat(np.arange(len(keys)), count)
            place = np.arange(len(hashes)) - first[doc]
            at = np.flatnonzero(in_cover[place % period] & (place + width <= count[doc]) & (count >= window)[doc] & fresh[doc])
            total = np.zeros(len(at), dtype=U64)
            for k in range(width):
                total = total * U64(_WINDOW_BASE) + hashes[at + k]
            yield from gather.add([mix(total)], keys[doc[at]], place[at])
        yield from gather.flush()

    return texts.select("h", "text").mapInArrow(run, _schema(1))


def _windows(found: DataFrame, window: int, period: int) -> DataFrame:
    """Occurrences of the windows around the anchors `places` of each text."""
    inverse = pow(_WINDOW_BASE, -1, 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather, seen = _Gather(2), set()
        for batch in blocks(batches):
            keys = batch.column("h").to_numpy()
            fresh = ~_seen_before(seen, keys)
            buf, offsets = utf8(batch.column("text"))
            starts, ends, first = words(buf, offsets)
            n = np.diff(first)
            sums = []
            for seed in (0, 1):
                total = np.zeros(len(starts) + 1, dtype=U64)
                np.cumsum(word_hashes(buf, starts, ends, seed) * _power_table(_WINDOW_BASE, len(starts)), out=total[1:])
                sums.append(total)
            places = batch.column("places")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            anchor = places.flatten().to_numpy() + first[doc]
            # windows that start up to PERIOD - 1 words before an anchor, and lie within the text
            mark = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(mark, np.maximum(anchor - period + 1, first[doc]), 1)
            np.add.at(mark, anchor + 1, -1)
            near = np.cumsum(mark[:-1]) > 0
            doc = np.repeat(np.arange(batch.num_rows), n)
            place = np.arange(len(starts)) - first[doc]
            at = np.flatnonzero(near & (place + window <= n[doc]) & fresh[doc])
            scale = _power_table(inverse, len(starts))[at]
            yield from gather.add([mix((total[at + window] - total[at]) * scale) for total in sums], keys[doc[at]], place[at])
        yield from gather.flush()

    return found.mapInArrow(run, _schema(2))


def _kept(found: DataFrame, window: int) -> DataFrame:
    """h, n_removed and kept_sha256 of texts with the starts `places` of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            removed, shas = [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                parts = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                at = places.values.to_numpy()
                mark = np.zeros(len(parts) + 1, dtype=np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                removed.append(len(parts) - len(keep))
                shas.append(hashlib.sha256(b" ".join([parts[i] for i in keep.tolist()])).hexdigest())
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return found.mapInArrow(run, "h long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of (doc_id, text).

    Every word is removed that a window covers whose word sequence also starts
    elsewhere in the table, in the same text or another row; all are judged on
    the input. A null text has no words. Repeated rows are copies of each other
    and lose all words, if they have `window` or more. Extra columns are
    ignored. Texts are told apart by 64 bits, windows by 128.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or window <= period:
        raise ValueError("the cover doesn't cover all differences, or the window is too short")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    light = materialize(_summary(texts), "substrings-texts")
    total = light.agg(F.sum("n_words")).first()[0] or 0
    n = max(partitions(spark), total * len(cover) // period // PER_TASK)
    n_windows = max(partitions(spark), total // PER_TASK)  # as if all windows were near a repeated anchor
    anchors = materialize(_repeats(_anchors(texts, window, period, cover), 1, n), "substrings-anchors")
    shared = spark.sparkContext.broadcast(bitmap(anchors.select("h"), anchors.count()))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("h").to_numpy()
            hit = in_bitmap(shared.value, keys)
            hit[hit] = ~_seen_before(seen, keys[hit])
            yield batch.filter(pa.array(hit))

    # each text once for each task that has it
    candidates = texts.select("h", "text").mapInArrow(wanted, "h long, text string")
    repeats = _repeats(_windows(candidates.join(anchors, "h"), window, period), 2, n_windows)
    kept = _kept(candidates.join(repeats, "h"), window).dropDuplicates(["h"])
    copies = light.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    known = join_counted(light, copies, ["h"], "copies", light.count(), "left")
    none, no_words = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    # a text with copies loses all or nothing; only others, of which each is alone, need the words that were kept
    whole = F.col("n_words") >= window
    copied = known.where("copies is not null").select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(none).alias("n_removed"), F.when(whole, no_words).otherwise(F.col("sha")).alias("kept_sha256"))
    alone = known.where("copies is null").join(kept, "h", "left")
    return copied.unionAll(alone.select("doc_id", "n_words", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
