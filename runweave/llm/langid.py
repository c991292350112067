"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language in Spark; the matrix of log
probabilities, `dims` x languages, is broadcast and scores Arrow batches in
numpy, where a document is the sparse row of the n-grams that it has.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import discard, materialize, table
from runweave.llm.text import U64, blocks, mix

#: Slots of hashed n-grams, their orders, and documents of each language that training takes in expectation.
DIMS, ORDERS, TRAIN_DOCS = 1 << 16, (1, 2, 3, 4), 20_000
#: Bytes of a broadcast matrix at most; more languages than it holds are learned and scored in blocks, one after the other.
MAX_MODEL_BYTES = 64 << 20
UNDETERMINED = "und"
#: Bytes of text whose n-grams are held at once, unless one text is longer.
BLOCK = 1 << 16
#: Places in a text whose n-grams are held at once.
STEP = 1 << 17


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter (general category L)."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


class _Features:
    """The n-grams of texts. They are lower-cased, and each is enclosed by a border character, which also keeps n-grams from reaching over two of them."""

    def __init__(self, texts: list[str | None], orders: tuple[int, ...], dims: int):
        parts = ["" if t is None else t.lower() for t in texts]
        self.points = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)  # the border after each text
        self.orders, self.dims = orders, dims
        #: Which texts have a letter.
        self.letters = np.zeros(len(parts), dtype=bool)

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slots of the n-grams and the text of each, for STEP places at a time, so that a long text needs no more than these."""
        border = np.zeros(len(self.points), dtype=bool)
        border[0] = True
        border[self.ends] = True
        for at in range(0, len(self.points), STEP):
            wide = self.points[at : at + STEP + max(self.orders) - 1].astype(U64)
            inner = ~border[at : at + len(wide)]
            here = np.flatnonzero(inner[:STEP])
            self.letters[np.searchsorted(self.ends, at + here[_letters()[self.points[at + here]]])] = True
            slots, docs = [], []
            for n in self.orders:
                m = min(len(wide) - n + 1, STEP)
                if m <= 0:
                    continue
                total = np.full(m, n, dtype=U64)
                for k in range(n):
                    total = total * U64(0x100000001B3) + wide[k : k + m]
                # borders may stand at either end of an n-gram, not within it
                ok = np.ones(m, dtype=bool) if n > 1 else inner[:m].copy()
                for k in range(1, n - 1):
                    ok &= inner[k : k + m]
                if n == 2:
                    ok &= inner[:m] | inner[1 : 1 + m]
                found = np.flatnonzero(ok)
                slots.append((mix(total[found]) & U64(self.dims - 1)).astype(np.int64))
                docs.append(np.searchsorted(self.ends, at + found + (~inner[found]), side="left"))
            yield np.concatenate(slots), np.concatenate(docs)


def _counts(dims: int, orders: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in blocks(batches, limit=BLOCK):
            places, which = np.unique(batch.column("place").to_numpy(), return_inverse=True)
            for slots, docs in _Features(batch.column("text").to_pylist(), orders, dims).slices():
                sums = np.bincount(which[docs] * dims + slots, minlength=len(places) * dims).reshape(len(places), dims)
                for place, row in zip(places.tolist(), sums, strict=True):
                    total[place] = total.get(place, 0) + row
        for place, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.full(len(at), place), pa.int32()), "slot": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})

    return count


def _most(dims: int) -> int:
    """Languages of a block."""
    return max(1, MAX_MODEL_BYTES // (4 * dims))


def train(docs: DataFrame, dims: int = DIMS, orders: tuple[int, ...] = ORDERS, train_docs: int = TRAIN_DOCS, smoothing: float = 0.5, after: str | None = None) -> tuple[list[str], np.ndarray]:
    """Fit the classifier on (doc_id, text, lang); returns languages and log probabilities.

    Languages are the first by code point behind `after`, as many as
    MAX_MODEL_BYTES hold. Rows with a null text or lang are left out. Of each
    language, documents enter by a hash of id and length, as many as
    `train_docs` in expectation (all where there are fewer); this bound is what
    keeps the cost of training apart from the size of the corpus. Languages are
    equally likely beforehand. With no rows to learn from there are no languages.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    if after is not None:
        known = known.where(F.col("lang") > after)
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(_most(dims)).collect()
    langs = [r["lang"] for r in sizes]
    if not langs:
        return [], np.zeros((dims, 0), dtype=np.float32)
    shares = docs.sparkSession.createDataFrame([(r["lang"], i, min(1.0, train_docs / r["n"])) for i, r in enumerate(sizes)], "lang string, place int, share double")
    drawn = (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("share")
    rows = known.join(F.broadcast(shares), "lang").where(drawn).select("text", "place").mapInArrow(_counts(dims, orders), "place int, slot int, n long")
    rows = rows.groupBy("place", "slot").agg(F.sum("n").alias("n")).toArrow()  # dims rows for each language at most
    counts = np.zeros((dims, len(langs)))
    counts[rows["slot"].to_numpy(), rows["place"].to_numpy()] = rows["n"].to_numpy()
    counts += smoothing
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _score(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], orders: tuple[int, ...], names: tuple[str, str, str], before: bool) -> DataFrame:
    """Columns `keep` with the likeliest language, its log likelihood, and the sum of all likelihoods over that one's.

    Null, 0 and 0 where there is none. `before` says that `docs` has these
    columns for other languages, which come first and are taken into account.
    """
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    fields = [docs.schema[c] for c in keep]
    lang, best, odds = names
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{lang}` string, `{best}` double, `{odds}` double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        dims = logs.shape[0]
        known = np.array([*langs, None], dtype=object)
        for batch in blocks(batches, limit=BLOCK):
            n = batch.num_rows
            found, most, total = np.full(n, None, dtype=object), np.zeros(n), np.zeros(n)
            if langs:
                features = _Features(batch.column("text").to_pylist(), orders, dims)
                sums = np.zeros((n, len(langs)))
                for slots, doc in features.slices():
                    for j in range(len(langs)):
                        sums[:, j] += np.bincount(doc, weights=logs[:, j][slots], minlength=n)
                letters = features.letters
                found = known[np.where(letters, sums.argmax(axis=1), len(langs))]
                most = np.where(letters, sums.max(axis=1), 0.0)
                total = np.where(letters, np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            if before:
                was, was_most, was_total = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
                # a text has letters for all languages or for none
                high = np.maximum(most, was_most)
                total = total * np.exp(most - high) + was_total * np.exp(was_most - high)
                found, most = np.where(most > was_most, found, was), high
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(most, pa.float64()), pa.array(total, pa.float64())], names=[*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text", *(names if before else ())])).mapInArrow(score, schema)


def _names(taken: list[str]) -> tuple[str, str, str]:
    tag = "_"
    while any(c.lower().startswith(tag) for c in taken):
        tag += "_"
    return tag + "lang", tag + "best", tag + "odds"


def _answer(scored: DataFrame, keep: list[str], names: tuple[str, str, str]) -> DataFrame:
    sure = F.when(F.col(names[2]) > 0, 1 / F.col(names[2])).otherwise(F.lit(0.0))
    return scored.select(*keep, F.coalesce(names[0], F.lit(UNDETERMINED)).alias("lang_pred"), sure.alias("score"))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Columns `keep` of `docs`, with lang_pred and score, its probability among the languages.

    A text that is null, empty or without a letter is `und` with score 0, as is
    every text where the model knows no language. Equal probabilities go to the
    first language by code point. Only the text is looked at.
    """
    names = _names([*keep, "text"])
    return _answer(_score(docs, model, keep, orders, names, False), keep, names)


def label(docs: DataFrame, learned: DataFrame, keep: list[str], dims: int = DIMS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """As `predict`, by what is learned from the rows of `learned`, whatever the number of languages.

    Where one block doesn't hold them, rows go through the blocks with the best
    so far, and are written between two of them, so that one matrix is in use at
    a time.
    """
    model = train(learned, dims, orders)
    if len(model[0]) < _most(dims):
        return predict(docs, model, keep, orders)
    carried = list(dict.fromkeys([*keep, "text"]))
    names = _names(carried)
    scored = materialize(_score(docs, model, carried, orders, names, False), "langid-scored")
    while (model := train(learned, dims, orders, after=model[0][-1]))[0]:
        last, scored = scored, materialize(_score(scored, model, carried, orders, names, True), "langid-scored")
        discard(last)
        if len(model[0]) < _most(dims):
            break
    return _answer(scored, keep, names)


def held_out() -> Column:
    """Whether a document is kept from training; one without id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of (doc_id, text, lang).

    Repeated rows each get their row; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return label(docs, docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), ["doc_id", "held_out"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
