"""Document fingerprints: the k smallest distinct hashes of word shingles.

Fingerprints of parts merge into that of the whole: join, keep the k smallest.
From two of them follow estimates of resemblance (Jaccard), containment and the
number of distinct shingles. A fingerprint is spelled in base64, eight bytes in
big-endian order for each hash, smallest first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runweave.llm.common import partitions, table
from runweave.llm.text import U64, shingles, utf8, word_hashes, words

#: Words of a shingle and hashes of a fingerprint.
WIDTH, K = 5, 128
#: Texts that are hashed at once have so many bytes at most, unless one is longer.
BLOCK = 1 << 19
#: Keys whose fingerprints a task merges at once.
MERGED = 4096
#: Rows of the sample, for each partition, from which the ranges of ids are taken.
SAMPLE = 64


def bottom_k(texts: list[str], width: int = WIDTH, k: int = K) -> list[np.ndarray]:
    """The sorted k smallest distinct shingle hashes of each text."""
    buf, offsets = utf8(pa.array(texts, pa.large_string()))
    starts, ends, first = words(buf, offsets)
    values, at = shingles(word_hashes(buf, starts, ends), first, width)
    out = []
    for i in range(len(texts)):
        part = values[at[i] : at[i + 1]]
        if len(part) > 4 * k:  # copies may stand among the smallest, so more than k are sorted
            few = np.unique(np.partition(part, 2 * k)[: 2 * k])
            part = few if len(few) >= k else np.unique(part)
        else:
            part = np.unique(part)
        out.append(part[:k])
    return out


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The fingerprint of the union."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, dtype=U64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.concatenate(([True], ~twice))
    place = np.cumsum(distinct)
    size = min(k, int(place[-1]))
    return float(np.count_nonzero(twice & (place[1:] <= size)) / size)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of a that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    both = distinct_count(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * both / distinct_count(a, k))


def spell(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def parse(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").astype(U64)


def fingerprint(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """The rows of `docs` with `fingerprint` of `text`; null is empty, and so is a text without words.

    A text of fewer words than `width` has its whole sequence as one shingle.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [x for block in _by_size(texts) for x in bottom_k(block, width, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([spell(x) for x in found], pa.string())], names=[*names, "fingerprint"])

    return docs.mapInArrow(run, _with(docs, "fingerprint string"))


def _with(docs: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), more])


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield texts[at:]


def merge_fingerprints(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint, distinct) of the union of all `fingerprint` rows with a key.

    Tasks merge what they read before anything is sent, MERGED keys at a time,
    so that a frequent key has few rows where its parts meet. There they come in
    order of the key, and one is held at a time. A null key is a key.
    """
    kind, arrow_kind = parts.schema[key].dataType.simpleString(), to_arrow_type(parts.schema[key].dataType)

    def rows(found: list[tuple[object, np.ndarray]]) -> list[pa.Array]:
        return [pa.array([name for name, _ in found], arrow_kind), pa.array([spell(x) for _, x in found], pa.string())]

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = parse(text or "")
                sums[name] = merge([sums[name], got], k) if name in sums else got
                if len(sums) >= MERGED:
                    yield pa.RecordBatch.from_arrays(rows(list(sums.items())), names=[key, "fingerprint"])
                    sums.clear()
        if sums:
            yield pa.RecordBatch.from_arrays(rows(list(sums.items())), names=[key, "fingerprint"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(found: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows(found), pa.array([distinct_count(x, k) for _, x in found], pa.float64())], names=[key, "fingerprint", "distinct"])

        done: list[tuple[object, np.ndarray]] = []
        held: tuple[object, np.ndarray] | None = None
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = parse(text)
                if held is not None and held[0] == name:
                    held = name, merge([held[1], got], k)
                    continue
                if held is not None:
                    done.append(held)
                held = name, got
            if len(done) >= MERGED:
                yield answer(done)
                done = []
        if held is not None:
            yield answer([*done, held])

    sent = parts.select(key, "fingerprint").mapInArrow(before, f"`{key}` {kind}, fingerprint string")
    return sent.repartition(partitions(parts.sparkSession), key).sortWithinPartitions(key).mapInArrow(met, f"`{key}` {kind}, fingerprint string, distinct double")


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as many first characters of `following`, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bounds(keys: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a, tie) that cut the table into about n equal ranges, from a sample of bounded size."""
    rows = keys.count()
    if rows > SAMPLE * n:
        keys = keys.where(F.pmod(F.xxhash64("a", "tie", F.lit(1)), F.lit(1 << 30)) < F.lit(int((1 << 30) * SAMPLE * n / rows)))
    drawn = keys.toArrow()  # 16 bytes for each of SAMPLE * n rows, in expectation
    a, tie = drawn["a"].to_numpy(), drawn["tie"].to_numpy()
    order = np.lexsort((tie, a))
    cuts = np.unique(order[len(order) * np.arange(1, n) // n]) if len(order) else order
    cuts = np.unique(np.stack([a[cuts], tie[cuts]]), axis=1)
    return cuts[0], cuts[1]


def _part(bounds: tuple[np.ndarray, np.ndarray], a: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of bounds at or below each key."""
    low, high = np.searchsorted(bounds[0], a, side="left"), np.searchsorted(bounds[0], a, side="right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(bounds[1][low[i] : high[i]], tie[i], side="right")
    return low


def compare_edits(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, for every row of (doc_id, text).

    Rows are taken by descending id, null ids last, equal ids by a hash of the
    text; each row's next is the one after it, the last one's is the first. With
    one row that is the row itself. The edited text ends with the beginning of
    the next. Returned: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and next_id. A null text is
    empty, extra columns are ignored.

    Rows are dealt by ranges of that order. The first row of each range also
    goes to the range before it, as the next of its last row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1)).alias("a"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("a", "tie")
    n = max(partitions(spark), rows.rdd.getNumPartitions())
    bounds = _bounds(keys, n)

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part(bounds, batch.column("a").to_numpy(), batch.column("tie").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("a"), batch.column("tie")], names=["part", "a", "tie"])

    found = keys.mapInArrow(first_of_each, "part int, a long, tie long").groupBy("part").agg(F.min(F.struct("a", "tie")).alias("head")).collect()  # a row for each range
    used = np.array(sorted(r["part"] for r in found), dtype=np.int64)
    head_a, head_tie, before = (np.zeros(len(bounds[0]) + 1, dtype=np.int64) for _ in range(3))
    for r in found:
        head_a[r["part"]], head_tie[r["part"]] = r["head"]["a"], r["head"]["tie"]
    before[used] = np.roll(used, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, tie = batch.column("a").to_numpy(), batch.column("tie").to_numpy()
            part = _part(bounds, a, tie)
            yield batch.append_column("part", pa.array(part, pa.int32())).append_column("extra", pa.array(np.zeros(len(a), dtype=np.int32)))
            first = (a == head_a[part]) & (tie == head_tie[part])
            if first.any():
                to = before[part[first]]
                yield batch.filter(pa.array(first)).append_column("part", pa.array(to, pa.int32())).append_column("extra", pa.array([1] * len(to), pa.int32()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        ended = False

        def answer(block: int) -> pa.RecordBatch:
            """Of the first `block` rows; the row after them is there."""
            changed = [edited(texts[i], texts[i + 1]) for i in range(block)]
            own = bottom_k(texts[: block + 1], width, k)
            other = bottom_k(changed, width, k)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids[:block], pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts[:block]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                    "fingerprint": [spell(x) for x in own[:block]],
                    "edited_fingerprint": [spell(x) for x in other],
                    "near_edited": pa.array([resemblance(own[i], other[i], k) for i in range(block)], pa.float64()),
                    "near_next": pa.array([resemblance(own[i], own[i + 1], k) for i in range(block)], pa.float64()),
                    "next_id": pa.array(ids[1 : block + 1], pa.int64()),
                }
            )

        size = 0
        for batch in batches:
            for doc_id, text, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("extra").to_pylist(), strict=True):
                if ended:
                    continue
                ended = extra == 1
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > BLOCK and len(texts) > 1:
                    yield answer(len(texts) - 1)
                    del ids[:-1], texts[:-1]
                    size = len(texts[0])
        if len(texts) > 1:
            yield answer(len(texts) - 1)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long"
    dealt = rows.mapInArrow(deal, "doc_id long, a long, tie long, text string, part int, extra int").repartitionById(len(bounds[0]) + 1, F.col("part"))
    return dealt.sortWithinPartitions("extra", "a", "tie").select("doc_id", "text", "extra").mapInArrow(compare, schema)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
