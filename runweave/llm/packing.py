"""Packing tokenised documents into windows by best fit decreasing.

Documents longer than a window are first cut into full windows. What is left of
each is packed, longest first, into the open window whose remaining capacity is
the smallest that suffices; a segment tree over capacities finds it. Documents
are dealt by hash to buckets of bounded size and each bucket is packed alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import join_counted, materialize, table
from runweave.llm.text import blocks
from runweave.llm.tokens import DEFAULT, encoder

#: Tokens of a window, the id after each document, and documents of a bucket in expectation.
WINDOW, END_ID, BUCKET_DOCS = 1024, 0, 4096


class CapacityTree:
    """Open windows by remaining capacity, with the number of them above each node of a segment tree."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = self.size + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window with room for `length`."""
        node, count = self.size + length, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.open[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, none over `window`; equal lengths go in order."""
    tree = CapacityTree(window)
    place, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            got = window, opened
            opened += 1
        capacity, place[i] = got
        offset[i] = window - capacity
        if capacity > n:
            tree.add(capacity - n, place[i])
    return place, offset


def tokenized(docs: DataFrame, window: int = WINDOW, tokenizer: str = DEFAULT, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens and the checksum of each piece of `window` ids, for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], dtype="<u4")
        for batch in blocks(batches):
            sizes, sums = [], []
            for ids in encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.concatenate((ids, end))
                sizes.append(len(ids))
                sums.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, len(ids), window)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "doc_tokens": pa.array(sizes, pa.int64()), "crcs": pa.array(sums, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = DEFAULT, end_id: int = END_ID, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every row of `docs` is packed, repeated ids as well. A null or empty text is
    the end id alone. A document's pieces are full windows, each a sequence of
    its own, and a rest. `sequence_id` holds the bucket above bit 40. Extra
    columns are ignored; an empty table gives an empty result.
    """
    light = materialize(tokenized(docs, window, tokenizer, end_id), "pack-tokens")
    n_buckets = max(1, light.count() // bucket_docs)

    def run(group: pa.Table) -> pa.Table:
        # of rows that are alike in all of these it makes no difference which comes first
        group = group.sort_by([("doc_tokens", "ascending"), ("doc_id", "ascending"), ("sum", "ascending")])
        sizes = group["doc_tokens"].to_numpy()
        crcs = group["crcs"].combine_chunks().flatten().to_numpy()
        pieces = -(-sizes // window)
        row = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        length = np.minimum(sizes[row] - start, window)
        rest = length < window
        place, offset = np.empty(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        place[rest], offset[rest] = best_fit_decreasing(length[rest], window)
        opened = place[rest].max(initial=-1) + 1
        place[~rest] = opened + np.arange(np.count_nonzero(~rest))
        bucket = group["bucket"][0].as_py() if len(group) else 0
        return pa.table(
            {
                "doc_id": group["doc_id"].take(pa.array(row)),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
                "doc_tokens": pa.array(sizes[row], pa.int64()),
                "sequence_id": pa.array(place + (bucket << 40), pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
        )

    # rows that are alike are dealt by their number among these, else they would share a bucket
    light = light.withColumn("sum", F.xxhash64("doc_id", "doc_tokens", "crcs"))
    many = light.groupBy("sum").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > bucket_docs)
    spread = join_counted(light, many, ["sum"], "copies", light.count(), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    part = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("copies") / bucket_docs))
    dealt = spread.withColumn("bucket", F.pmod(F.xxhash64("sum", part), F.lit(n_buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
