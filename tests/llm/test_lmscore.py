import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from runweave.llm import lmscore

VOCABULARY, BIGRAMS = 1 << 15, 1 << 15


def slots(text):
    own, before, pair, _ = lmscore._slots(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())}), VOCABULARY, BIGRAMS)
    return own.tolist(), before.tolist(), pair.tolist()


def brute(rows, targets):
    model = {True: [Counter(), Counter(), Counter()], False: [Counter(), Counter(), Counter()]}
    for doc_id, text in rows:
        for counter, found in zip(model[doc_id in targets], slots(text), strict=True):
            counter.update(found)
    total = {kind: sum(model[kind][0].values()) for kind in model}
    scale = {True: 1.0, False: total[True] / total[False] if total[True] and total[False] else 1.0}
    out = []
    for doc_id, text in rows:
        found = slots(text)
        own = [Counter(f) for f in found]
        loss = {}
        for kind in (True, False):
            mine = (doc_id in targets) == kind
            value = lambda i, x: scale[kind] * (model[kind][i][x] - (own[i][x] if mine else 0))  # noqa: B023, E731
            words = scale[kind] * (total[kind] - (len(found[0]) if mine else 0))
            losses = []
            for w, b, p in zip(*found, strict=True):
                plain = (value(0, w) + lmscore.FLOOR) / (words + lmscore.FLOOR * VOCABULARY)
                losses.append(-math.log((min(value(2, p), value(1, b)) + lmscore.BACKOFF * plain) / (value(1, b) + lmscore.BACKOFF)))
            loss[kind] = sum(losses) / len(losses) if losses else None
        out.append((doc_id, len(found[0]), loss[True], loss[False]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table", ["clashing", "nothing"])
@pytest.mark.parametrize("ids", [range(-20, 150, 3), []])
def test_against_brute_force(request, spark, table, ids):
    frame = request.getfixturevalue(table)
    targets = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "doc_id long")
    got = sorted((tuple(r) for r in lmscore.score(frame, targets, VOCABULARY, BIGRAMS).select("doc_id", "n_tokens", "target_loss", "background_loss").collect()), key=lambda r: repr(r[:2]))
    want = sorted(brute([(r["doc_id"], r["text"]) for r in frame.collect()], set(ids)), key=lambda r: repr(r[:2]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for column in (2, 3):
        for g, w in zip(got, want, strict=True):
            assert (g[column] is None) == (w[column] is None)
        pairs = [(g[column], w[column]) for g, w in zip(got, want, strict=True) if w[column] is not None]
        # rows with equal id and size may come in another order
        assert np.allclose(sorted(p[0] for p in pairs), sorted(p[1] for p in pairs), rtol=1e-4)


def test_what_reads_like_the_target_scores_lower(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * 3) % 40}" for j in range(50))) for i in range(40)] + [(100 + i, " ".join(f"v{(i * 5 + j * 3) % 40}" for j in range(50))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lmscore.score(frame, spark.createDataFrame([(i,) for i in range(0, 30)], "doc_id long"), VOCABULARY, BIGRAMS).collect()}
    assert max(found[i] for i in range(30, 40)) < min(found[i] for i in range(100, 140))


def test_counts_grow_with_the_corpus(spark, monkeypatch):
    """More words than any fixed number of slots, over many blocks and ranges: an unseen word has one loss, whatever the others are."""
    monkeypatch.setattr(lmscore, "TEXT_BYTES", 1 << 16)
    monkeypatch.setattr(lmscore, "RANGE_WORDS", 1 << 15)
    rows = [(i, " ".join(f"w{i * 2000 + j}" for j in range(2000))) for i in range(300)]
    found = lmscore.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")).collect()
    assert len(found) == 300
    vocabulary = 600_000
    for r in found:
        # every word is only in its own text, so both models know none of them; only a text's start has a context
        mine, theirs = 300_000 - 2000 + lmscore.FLOOR * vocabulary, 300_000 + lmscore.FLOOR * vocabulary
        plain = {True: lmscore.FLOOR / mine, False: lmscore.FLOOR / theirs}
        start = {True: 149, False: 150}
        want = {k: (-2000 * math.log(plain[k]) - math.log(lmscore.BACKOFF) + math.log(start[k] + lmscore.BACKOFF)) / 2000 for k in plain}
        target = r["doc_id"] % 2 == 0
        assert math.isclose(r["target_loss"], want[target], rel_tol=1e-9) and math.isclose(r["background_loss"], want[not target], rel_tol=1e-9)
