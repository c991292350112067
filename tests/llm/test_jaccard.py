import random
import re
from collections import Counter, defaultdict

import pytest

from runweave.llm import jaccard
from runweave.llm.components import components

from .conftest import sentence

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, percent=90):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    seen = defaultdict(list)
    for i, own in enumerate(sets):
        overlap = Counter(j for s in own for j in seen[s])
        for j, c in overlap.items():
            if 100 * c >= percent * (len(own) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                group[b] = a
        for s in own:
            seen[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(((doc_id, len(sets[i]), least.get(top(i))) for i, (doc_id, _) in enumerate(rows)), key=repr)


def check(frame, percent=90):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(frame, percent=percent).collect()), key=repr)
    assert got == brute(rows, percent)


@pytest.mark.parametrize("table", ["clashing", "nothing"])
def test_odd_tables(request, table):
    check(request.getfixturevalue(table))


def test_near_copies_around_the_bound(spark):
    """A fuzzy group, chains, a shared passage and short texts, where many pairs fall to either side."""
    rng = random.Random(11)
    base, passage = sentence(rng, 200, 4000).split(), sentence(rng, 30, 4000)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = list(base[:90])
    for i in range(12):
        chain[7 * i] = f"c{i}"
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, f"{passage} {sentence(rng, i % 5, 4000)}") for i in range(25)]
    rows += [(300 + i, sentence(rng, rng.randrange(1, 5), 2)) for i in range(30)]
    rows += [(None, rows[0][1]), (None, None), (None, "lonely text without an id"), (400, rows[0][1]), (400, "same id other text")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_other_similarity(spark):
    rng = random.Random(2)
    base = sentence(rng, 80, 4000).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"z{rng.randrange(999)}" for w in base)) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4040)] + [(7, 7), (None, 3)]
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            group[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in group}
