import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from runweave.llm import text as t

WORD = re.compile("[^\x20\x09-\x0d]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\u00a0\u0085é漢", max_size=30)), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    buf, offsets = t.utf8(pa.array(texts, pa.string()))
    starts, ends, first = t.words(buf, offsets)
    got = [[bytes(buf[starts[j] : ends[j]]).decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(x or "") for x in texts]


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "ba", "abc", "Ab", "b"]) for _ in range(rng.randrange(9))) for _ in range(50)]
    buf, offsets = t.utf8(pa.array(texts))
    starts, ends, _ = t.words(buf, offsets)
    spelled = [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)]
    plain, lower = t.word_hashes(buf, starts, ends), t.word_hashes(buf, starts, ends, lower=True)
    assert len({(w, h) for w, h in zip(spelled, plain.tolist(), strict=True)}) == len(set(spelled)) == len(set(plain.tolist()))
    assert len(set(lower.tolist())) == len({w.lower() for w in spelled})


def test_long_words_and_blocks():
    texts = ["x" * (t.BLOCK_BYTES + 5) + " end", "end", "a b"]
    buf, offsets = t.utf8(pa.array(texts))
    starts, ends, first = t.words(buf, offsets)
    hashes = t.word_hashes(buf, starts, ends)
    assert first.tolist() == [0, 2, 3, 5] and hashes[1] == hashes[2]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    assert [b.num_rows for b in t.blocks(iter([batch, batch.slice(0, 0)]))] == [1, 2]


def test_shingles():
    texts = ["a b c d", "a b c", "a b", "", "b c d e", "a b"]
    buf, offsets = t.utf8(pa.array(texts))
    starts, ends, first = t.words(buf, offsets)
    values, at = t.shingles(t.word_hashes(buf, starts, ends), first, 3)
    assert np.diff(at).tolist() == [2, 1, 1, 0, 2, 1]
    assert values[0] == values[at[1]] and values[1] == values[at[4]] and values[at[2]] == values[at[5]]
    assert len(set(values.tolist())) == 4
