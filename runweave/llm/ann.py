"""Approximate nearest neighbours by largest inner product.

An inverted file: k-means centroids cut the vectors into lists, what is left of
a vector after its centroid is product-quantised. A query probes the lists whose
centroids have the largest product with it. With a table of its products with
all codewords it ranks their rows, and the best are ranked again exactly on the
original vectors. Long lists are cut into chunks, and what is asked of a list into parts,
of bounded size, so that a task meets a block of rows with a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import materialize, table

#: Rows from which centroids and codewords are learned, in expectation; all rows are indexed.
TRAIN_ROWS = 32_768
#: Rows of a list on average, lists at most, and parts of a vector with 256 codewords each.
LIST_ROWS, MOST_LISTS, PARTS = 1024, 4096, 16
#: Rows of a chunk; a query ranks that many of them exactly at least.
CHUNK_ROWS, LEAST_RERANK = 2048, 64
#: Neighbours of TRIALS sampled rows that probing, and then ranking by codes, must find; lists probed at least.
GOAL, TRIALS, LEAST_PROBES = 0.98, 128, 4
NEIGHBOURS, QUERY_STEP = 20, 20
#: Queries of a list that a task takes, in expectation.
PART_QUERIES = 2048
#: Groups in which what chunks have found for a query is merged first.
MERGES = 32
#: Bytes of the vectors that are ranked exactly at once.
_RERANK_BYTES = 32 << 20


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that can take part, in float64, and their row numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    rows = np.flatnonzero((sizes == width) & (width > 0))
    values = pc.fill_null(column.take(pa.array(rows)).flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), -1 if len(rows) else max(width, 1))
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return np.ascontiguousarray(values[good]), rows[good]


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, the first of equals."""
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centers.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centres, the same for the same rows."""
    x = np.unique(x, axis=0)
    centers = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _nearest(x, centers)
        count = np.bincount(near, minlength=len(centers))
        sums = np.stack([np.bincount(near, weights=c, minlength=len(centers)) for c in x.T], axis=1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


@dataclass
class Quantizer:
    """Centroids and, for each part of a vector, its columns and codewords."""

    centers: np.ndarray
    columns: list[np.ndarray]
    words: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(x, self.centers)
        rest = x - self.centers[lists]
        return lists, np.stack([_nearest(rest[:, c], w) for c, w in zip(self.columns, self.words, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each part, the products of all queries with its codewords."""
        return [queries[:, c] @ w.T for c, w in zip(self.columns, self.words, strict=True)]


def train(sample: np.ndarray, lists: int, parts: int = PARTS) -> Quantizer:
    centers = _k_means(sample, lists)
    rest = sample - centers[_nearest(sample, centers)]
    columns = [c for c in np.array_split(np.arange(sample.shape[1]), parts) if len(c)]
    return Quantizer(centers, columns, [_k_means(rest[:, c], 256) for c in columns])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of the components, so that equal rows give equal sums."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest scores of each row; of equal ones at the edge, the first."""
    size = scores.shape[1]
    if size <= n:
        return np.tile(np.arange(size), (len(scores), 1))
    top = np.argpartition(scores, size - n, axis=1)[:, size - n :]
    edge = np.take_along_axis(scores, top, axis=1).min(axis=1)
    for i in np.flatnonzero((scores >= edge[:, None]).sum(axis=1) > n):
        above = np.flatnonzero(scores[i] > edge[i])
        top[i] = np.concatenate((above, np.flatnonzero(scores[i] == edge[i])[: n - len(above)]))
    return top


def calibrate(model: Quantizer, sample: np.ndarray, k: int, goal: float = GOAL) -> tuple[float, float]:
    """The share of lists to probe, and the share of a list to rank exactly, that reach the goal on the sample."""
    lists, codes = model.encode(sample)
    asked = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(int))
    queries = sample[asked]
    exact = queries @ sample.T
    exact[np.arange(len(asked)), asked] = -np.inf
    true = _top(exact, min(k, len(sample)))
    place = np.argsort(np.argsort(-(queries @ model.centers.T), axis=1, kind="stable"), axis=1)
    probes = (np.take_along_axis(place, lists[true], axis=1) + 1) / len(model.centers)
    near = np.zeros_like(exact)
    for j, t in enumerate(model.tables(queries)):
        near += t[:, codes[:, j]]
    depth = np.empty(true.shape)
    for i in range(len(asked)):
        for c, v in enumerate(true[i]):
            same = lists == lists[v]
            depth[i, c] = np.count_nonzero(near[i][same] >= near[i][v]) / np.count_nonzero(same)
    return float(np.quantile(probes, goal, method="higher")), float(np.quantile(depth, goal, method="higher"))


def search(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = NEIGHBOURS, goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every query.

    `vectors` has (vec_id, embedding); queries are the rows whose vec_id is
    divisible by `query_step`, candidates of each all other rows. Rows with
    a null id, or whose vector is null, zero, or has a null or non-finite
    component or another length than most, take no part. Scores are inner
    products in double precision; equal ones go to the smaller vec_id. A query
    with fewer candidates than k gets all. Rows that repeat an id are rows of
    their own: each is a candidate of the others, and a query with ranks from 1.
    Extra columns are ignored; an empty table gives an empty result.

    How many lists are probed and how many rows ranked exactly follows from the
    `goal` on the sample, on which the search is tried against an exact one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    count = rows.count()
    share = min(1.0, TRAIN_ROWS / max(1, count))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    sample, _ = _matrix(drawn.orderBy("vec_id").select("embedding").toArrow()["embedding"])
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    model = train(sample, max(1, min(MOST_LISTS, count // LIST_ROWS)))
    shared = spark.sparkContext.broadcast(model)
    width = sample.shape[1]
    probe_share, rank_share = calibrate(model, sample, k, goal)
    rerank = max(LEAST_RERANK, 2 * k, int(np.ceil(rank_share * CHUNK_ROWS)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column("embedding"), width)
            if len(x):
                lists, codes = shared.value.encode(x)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(pa.array(at)), "list": pa.array(lists, pa.int32()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "vector": pa.array([v.tobytes() for v in x], pa.binary())})

    # written, so that a row keeps its number
    indexed = materialize(rows.mapInArrow(index, "vec_id long, list int, codes binary, vector binary").withColumn("row", F.monotonically_increasing_id()), "ann-index")
    sizes = np.zeros(len(model.centers), dtype=np.int64)
    for r in indexed.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK_ROWS))
    least = max(LEAST_PROBES, int(np.ceil(probe_share * len(sizes))))

    def probed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The lists to probe for each vector: at least `least`, and as many as hold k others."""
        x = np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, width)
        order = np.argsort(-(x @ shared.value.centers.T), axis=1, kind="stable")
        for lists in order:
            yield lists[: max(least, int(np.searchsorted(np.cumsum(sizes[lists]), k + 1)) + 1)]

    def demand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sizes), dtype=np.int64)
        for batch in batches:
            for lists in probed(batch) if batch.num_rows else ():
                total[lists] += 1
        yield pa.RecordBatch.from_pydict({"list": pa.array(np.arange(len(total)), pa.int32()), "n": pa.array(total)})

    asked = indexed.where(F.col("vec_id") % query_step == 0)
    parts = np.ones(len(sizes), dtype=np.int64)
    for r in asked.select("vector").mapInArrow(demand, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # MOST_LISTS rows at most
        parts[r["list"]] = max(1, -(-r["n"] // PART_QUERIES))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, lists in enumerate(probed(batch)):
                row, vector = batch.column("row")[i].as_py(), batch.column("vector")[i].as_py()
                to = np.repeat(lists, chunks[lists])
                chunk = np.concatenate([np.arange(c) for c in chunks[lists]])
                part = (row * 0x9E3779B1 >> 7) % parts[to]
                yield pa.RecordBatch.from_pydict({"query_row": pa.array([row] * len(to), pa.int64()), "query": pa.array([vector] * len(to), pa.binary()), "list": pa.array(to, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "part": pa.array(part, pa.int32())})

    block = max(1, min(128, _RERANK_BYTES // (8 * width * rerank)))

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of one chunk for each query that probes its list."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, rows = left["vec_id"].to_numpy(), left["row"].to_numpy()
            x = np.frombuffer(b"".join(left["vector"].to_pylist())).reshape(-1, width)
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            askers = right["query_row"].to_numpy()
            queries = np.frombuffer(b"".join(right["query"].to_pylist())).reshape(-1, width)
            for at in range(0, len(askers), block):
                few, own = queries[at : at + block], askers[at : at + block]
                near = np.zeros((len(few), len(ids)))
                for j, t in enumerate(shared.value.tables(few)):
                    near += t[:, codes[:, j]]
                near[rows == own[:, None]] = -np.inf
                top = _top(near, rerank)
                # products of the best by codes; those near the k-th are summed in order, as scores are given
                exact = np.matmul(x[top], few[:, :, None])[:, :, 0]
                exact[rows[top] == own[:, None]] = -np.inf
                edge = np.partition(exact, max(0, exact.shape[1] - k), axis=1)[:, max(0, exact.shape[1] - k)]
                which, place = np.nonzero((exact >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & (exact > -np.inf))
                spot = top[which, place]
                score, found = _product(few[which], x[spot]), ids[spot]
                order = np.lexsort((found, -score, which))
                first = np.searchsorted(which[order], np.arange(len(few)))
                order = order[np.arange(len(order)) - first[which[order]] < k]
                out.append((own[which[order]], found[order], score[order]))
        q, v, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3))
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
        found = pa.StructArray.from_arrays([pa.array(-s.astype(np.float64)), pa.array(v.astype(np.int64))], names=["order", "vec_id"])
        return pa.table({"query_row": pa.array(q[first].astype(np.int64)), "found": pa.ListArray.from_arrays(pa.array(np.append(first, len(q)), pa.int32()), found)})

    of_list = lambda numbers: F.get(F.array(*(F.lit(int(c)) for c in numbers)), F.col("list"))
    dealt = indexed.withColumn("chunk", F.pmod(F.xxhash64("row", "codes"), of_list(chunks).cast("long")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), of_list(parts) - 1)))
    queries = asked.select("row", "vector").mapInArrow(probe, "query_row long, query binary, list int, chunk int, part int")
    keys = ["list", "chunk", "part"]
    found = dealt.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(best, "query_row long, found array<struct<order:double,vec_id:long>>")
    merged = lambda rows: F.slice(F.array_sort(F.flatten(F.collect_list(rows))), 1, k)
    few = found.groupBy("query_row", F.pmod(F.xxhash64("found"), F.lit(MERGES))).agg(merged("found").alias("found")).groupBy("query_row").agg(merged("found").alias("found"))
    named = few.join(asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row")
    return named.select("query_id", F.posexplode("found").alias("place", "one")).select("query_id", (F.col("place") + 1).alias("rank"), "one.vec_id", (-F.col("one.order")).alias("score"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
