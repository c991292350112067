import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runweave.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def size(text):
    return len(WORD.findall(text or ""))


@pytest.mark.parametrize("table", ["documents", "clashing"])
@pytest.mark.parametrize("share", [1.0, 0.3, 2.5])
def test_against_brute_force(request, table, share):
    frame = request.getfixturevalue(table)
    got = mixing.plan_mix(frame, share=share).collect()
    rows = frame.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], size(r["text"])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], share * sum(sizes.values()), 3.0), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(goal[s] + 1e-9) for s in names)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan_mix(frame.repartition(2), share=share).collect()), key=repr)


def test_mixed_texts_follow_the_plan(documents):
    plan, mixed = mixing.plan_mix(documents).collect(), mixing.mix(documents)
    assert mixed.columns == documents.columns
    want, got, texts = defaultdict(int), defaultdict(int), {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in plan:
        want[r["doc_id"]] += r["taken"]
    for r in mixed.collect():
        got[r["doc_id"]] += size(r["text"])
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert dict(got) == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_many_sources_are_joined_by_key(spark, monkeypatch, seed):
    """More sources than a broadcast may hold give the same mix: sizes vary a lot, so that limits are met in several rounds."""
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(int(3 ** (6 * rng.random())))), None if i % 60 == 7 else f"s{i % 60}" if i % 3 else "hot") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__key", F.lit("x")).withColumn("__s", F.lit(1))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(sizes.values()), 3.0), strict=True))
    few = sorted(mixing.plan_mix(frame).select("doc_id", "size", "taken", "target").collect())
    mixed = sorted(mixing.mix(frame).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCE_BYTES", 0)
    many = mixing.plan_mix(frame)
    assert sorted(many.select("doc_id", "size", "taken", "target").collect()) == few and sorted(mixing.mix(frame).collect()) == mixed
    source = {i: s for i, _, s in rows}
    assert all(r["target"] == pytest.approx(goal[source[r["doc_id"]]]) for r in few)
    words = defaultdict(int)
    for r in mixed:
        words[source[r["doc_id"]]] += size(r["text"])
    assert all(words[s] == int(goal[s] + 1e-9) for s in names)


def test_targets():
    assert mixing.targets([100, 100], [1, 1], 200, 3) == [100, 100]
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210, 3) == [30, 120, 60]
    assert mixing.targets([1, 1], [5, 2], 100, 3) == [3, 3] and mixing.targets([0, 5], [5, 2], 5, 3) == [0, 5] and mixing.targets([], [], 0, 3) == []


def test_empty_and_wordless(spark, nothing):
    assert mixing.plan_mix(nothing).collect() == [] and mixing.mix(nothing).collect() == []
    frame = spark.createDataFrame([(1, None, "a", 0), (2, " ", None, 1)], nothing.select("doc_id", "text", "source", "n_chars").schema)
    assert [r["taken"] for r in mixing.plan_mix(frame).collect()] == [0, 0] and mixing.mix(frame).collect() == []
