import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from runweave.llm import packing
from runweave.llm.tokens import Encoder, encoder

SAMPLES = ["", "  \n\n x y", "don't I'LL we've", "½²٣ 漢字🙂 é", "\x00\x1f ", "a <|endoftext|> b<|endoftext|>", "word " * 50, "a" * 3000, "\t\t tab\r\n\r\n", "1234 5,678.9"]


def test_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(0)
    texts = SAMPLES + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), 32, 10])) for _ in range(80)) for _ in range(200)]
    fast = encoder()
    assert fast._fast is not None
    assert [x.tolist() for x in fast.encode(texts)] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    other = Encoder("word_bpe_49k.json")
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(SAMPLES, add_special_tokens=False)
    assert other._fast is None and [x.tolist() for x in other.encode(SAMPLES)] == [e.ids for e in want]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    window = 64
    lengths = rng.integers(1, window + 1, 300)
    place, offset = packing.best_fit_decreasing(lengths, window)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            assert window - offset[i] == min(fits)
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            assert offset[i] == 0
            room.append(window - lengths[i])
    assert place.max() + 1 == len(room)


@pytest.mark.parametrize("table", ["documents", "clashing"])
def test_pieces(request, table):
    frame = request.getfixturevalue(table)
    rows = frame.collect()
    got = packing.pack(frame, bucket_docs=16).collect()
    want = []
    for r, ids in zip(rows, encoder().encode([r["text"] or "" for r in rows]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        want += [(r["doc_id"], at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024)]
    assert sorted(tuple(g)[:5] for g in got) == sorted(want)
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_reruns_and_empty(documents, nothing):
    first = sorted(map(tuple, packing.pack(documents).collect()))
    assert first == sorted(map(tuple, packing.pack(documents.repartition(5)).collect()))
    assert packing.pack(nothing).collect() == []
