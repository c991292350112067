import numpy as np
import pytest

from runweave.llm import ann


def product(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):  # sum() would compensate for rounding
        total += a * b
    return total


def brute(rows, step, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % step == 0 and q not in out:
            scored = sorted((-product(x, y), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[20][1]) for i in range(300)]  # one very common vector
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [1.0] * 15 + [None]), (4060, [1.0] * 15 + [float("nan")]), (4080, [1.0] * 3), (None, [1.0] * 16), (4100, [float("inf")] * 16), (4120, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    want = brute(rows, 20, 20)
    got = {}
    for r in ann.search(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    hit, vectors = 0, dict(rows)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        listed = [found[i] for i in range(1, 21)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        assert all(product(np.array(vectors[q]), np.array(vectors[i])) == s for i, s in listed)
        hit += len({i for i, _ in listed} & {i for i, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], kind)).collect() == []
    assert ann.search(spark.createDataFrame([(20, None)], kind)).collect() == []
    rows = [(i, [float(i % 3), 1.0]) for i in range(5)]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 4, 1.0)]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_top_takes_the_first_of_equals(n):
    scores = np.array([[1.0, 3, 2, 3, 3, 0, 2, 1], [5.0] * 8])
    got = ann._top(scores, n)
    assert sorted(got[1].tolist()) == list(range(n))
    assert set(got[0].tolist()) == set(np.lexsort((np.arange(8), -scores[0]))[:n].tolist())


@pytest.mark.parametrize("part", [1, 2048])
def test_repeated_ids_are_rows_of_their_own(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART_QUERIES", part)
    rows = [(20, [1.0, 2.0]), (20, [3.0, 1.0]), (21, [1.0, 1.0]), (40, [2.0, 2.0]), (40, [2.0, 2.0])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect())
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-product(np.array(x), np.array(y)), v) for j, (v, y) in enumerate(rows) if j != i)
            want += [(q, place + 1, v, -s) for place, (s, v) in enumerate(scored[:3])]
    assert got == sorted(want)
