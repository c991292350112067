import hashlib
import random
import re
from collections import Counter

import pytest

from runweave.llm import substrings

from .conftest import sentence

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(frame):
    got = sorted((tuple(r) for r in substrings.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in frame.collect()])


@pytest.mark.parametrize("table", ["clashing", "nothing"])
def test_odd_tables(request, table):
    check(request.getfixturevalue(table))


def test_lengths_and_shifts_around_the_window(spark):
    rng = random.Random(8)
    passage = sentence(rng, 120, 4000).split()
    rows = []
    for i in range(60):
        a = rng.randrange(40)
        part = passage[a : a + rng.choice([33, 34, 35, 36, 37, 50])]
        rows.append((i, " ".join([*sentence(rng, rng.randrange(45), 4000).split(), *part, *sentence(rng, rng.randrange(9), 4000).split()])))
    rows += [(90, " ".join(["r"] * 36)), (91, "u " * 35), (92, " ".join(passage[:34])), (93, " ".join(["p", "q"] * 30)), (None, None), (None, " ".join(passage))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_cover_is_checked(nothing):
    with pytest.raises(ValueError):
        substrings.remove_repeats(nothing, cover=(0, 1, 3))
