import hashlib
import re

import pytest

from runweave.llm import fingerprints as f

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    parts = WORD.findall(text or "")
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)} if len(parts) >= 5 else ({tuple(parts)} if parts else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("table", ["documents", "clashing"])
def test_edits_against_brute_force(request, table):
    frame = request.getfixturevalue(table)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), reverse=True)
    want = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), likeness(shingles(text), shingles(changed)), likeness(shingles(text), shingles(following))))
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in f.compare_edits(frame).collect()), key=lambda r: r[:3])
    want.sort(key=lambda r: r[:3])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3] == pytest.approx(w[3], abs=0.2) and g[4] == pytest.approx(w[4], abs=0.2)


def test_equal_texts_have_equal_fingerprints(documents):
    found = {}
    for r in f.compare_edits(documents).select("doc_id", "fingerprint").join(documents.select("doc_id", "text"), "doc_id").collect():
        found.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in found.values())


def test_small_tables(spark, nothing):
    assert f.compare_edits(nothing).collect() == []
    one = f.compare_edits(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["next_id"], r["near_next"]) for r in one] == [(3, 3, 1.0)]
    unnamed = f.compare_edits(spark.createDataFrame([(None, "a"), (2, None), (1, "b c"), (None, "d")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in unnamed) == [(False, 1), (False, 2), (True, 0), (True, 0)]
    assert {r["doc_id"]: r["next_id"] for r in unnamed}[2] == 1


def test_estimates_and_merging(spark, documents):
    texts = [r["text"] or "" for r in documents.collect()]
    sketches = f.bottom_k(texts)
    for text, sketch in zip(texts, sketches, strict=True):
        n = len(shingles(text))
        assert f.distinct_count(sketch) == (n if n < f.K else pytest.approx(n, rel=0.35))
        assert f.parse(f.spell(sketch)).tolist() == sketch.tolist()
    union = set().union(*(shingles(t) for t in texts))
    assert f.distinct_count(f.merge(sketches)) == pytest.approx(len(union), rel=0.35)
    part = f.bottom_k([texts[0] + " " + texts[4], texts[0]])
    assert f.containment(part[1], part[0]) == pytest.approx(1.0, abs=0.1)
    named = f.fingerprint(documents.selectExpr("source", "text"))
    by_source = {r["source"]: r["fingerprint"] for r in f.merge_fingerprints(named, "source").collect()}
    for source in by_source:
        assert by_source[source] == f.spell(f.merge(f.bottom_k([r["text"] or "" for r in documents.collect() if r["source"] == source])))
