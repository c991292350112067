import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from runweave.llm import langid


def corpus(spark, n=400):
    rng = random.Random(5)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["stra", "uff", "ing"], "cc": ["zü", "ñe", "qo"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(12)), lang) for i in range(n) for lang in [rng.choice(list(sounds))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(spark):
    frame, truth = corpus(spark)
    got = langid.identify(frame).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_not_learned(spark):
    frame, _ = corpus(spark)
    from pyspark.sql import functions as F

    changed = frame.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(frame).collect()} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(changed).collect()}


def grams(text, orders):
    """All n-grams of a text as strings."""
    bordered = f"\n{text.lower()}\n"
    return [bordered[i : i + n] for n in orders for i in range(len(bordered) - n + 1) if bordered[i : i + n].strip("\n")]


@pytest.mark.parametrize("step", [1, 5, 1 << 17])
def test_counts_against_brute_force(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    texts, dims, orders = ["Ab", None, "", "é b", "lOng ünd x" * 9], 1 << 12, (1, 2, 3)
    features = langid._Features(texts, orders, dims)
    found = list(features.slices())
    slots, docs = (np.concatenate(x) for x in zip(*found, strict=True))
    assert [int((docs == i).sum()) for i in range(5)] == [len(grams(t or "", orders)) if t else 0 for t in texts]
    assert features.letters.tolist() == [True, False, False, True, True]
    again = langid._Features(["ab"], orders, dims)
    assert sorted(slots[docs == 0].tolist()) == sorted(np.concatenate([x for x, _ in again.slices()]).tolist())


def test_predictions_against_brute_force(spark):
    """Naive Bayes over the n-grams themselves; with so many slots as here none of them share one."""
    frame, _ = corpus(spark, 60)
    dims, orders, smoothing = 1 << 20, (1, 2, 3), 0.5
    rows = frame.collect()
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = langid.train(spark.createDataFrame(learned, frame.schema), dims, orders, smoothing=smoothing)
    counts = {lang: Counter(g for r in learned if r["lang"] == lang for g in grams(r["text"], orders)) for lang in {r["lang"] for r in learned}}
    assert len({g for c in counts.values() for g in c}) == int((model[1] > model[1].min(axis=0)).any(axis=1).sum())
    short = [(1000 + i, " ".join(r["text"].split()[i % 7 :][:2]), None) for i, r in enumerate(rows)]
    asked = {r[0]: r[1] for r in [*map(tuple, rows), *short]}
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(i, t) for i, t in asked.items()], "doc_id long, text string"), model, ["doc_id"], orders).collect()}
    assert len(got) == len(asked)
    for i, text in asked.items():
        logs = {lang: sum(math.log((c[g] + smoothing) / (sum(c.values()) + smoothing * dims)) for g in grams(text, orders)) for lang, c in counts.items()}
        best = max(logs.values())
        assert got[i]["lang_pred"] == min(lang for lang, x in logs.items() if x == best)
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - best) for x in logs.values()), abs=1e-3)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_blocks_of_languages(spark, monkeypatch, most):
    """Languages in blocks give the predictions of one model; a text without letters stays undetermined."""
    frame, _ = corpus(spark, 80)
    frame = frame.unionByName(spark.createDataFrame([(900, "12 34", None), (901, None, "aa")], frame.schema))
    want = sorted(langid.label(frame, frame, ["doc_id", "text"]).collect(), key=lambda r: r["doc_id"])
    monkeypatch.setattr(langid, "MAX_MODEL_BYTES", most * 4 * langid.DIMS)
    got = sorted(langid.label(frame, frame, ["doc_id", "text"]).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["text"], r["lang_pred"]) for r in got] == [(r["doc_id"], r["text"], r["lang_pred"]) for r in want]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-9)
    assert {r["lang_pred"] for r in got[-2:]} == {"und"} and got[-1]["score"] == 0


def test_odd_rows(spark, documents, clashing, nothing):
    assert langid.identify(nothing).collect() == []
    got = langid.identify(clashing).collect()
    assert len(got) == documents.count()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in got:
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    unlabelled = spark.createDataFrame([(1, "abc", None), (None, "abc", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert {(r["held_out"], r["lang_pred"]) for r in langid.identify(unlabelled).collect()} == {(False, "und")}


def test_a_very_long_text(spark, monkeypatch):
    frame, truth = corpus(spark, 60)
    model = langid.train(frame)
    text = " ".join(r["text"] for r in frame.collect() if r["lang"] == "aa")
    long = spark.createDataFrame([(1, (text + " ") * 400), (2, text)], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(long, model, ["doc_id"]).collect()} == {("aa", 1.0)}
