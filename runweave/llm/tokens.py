"""Token ids of the public byte-level tokenizer files.

The ids are those of the `tokenizers` library with add_special_tokens=False.
Files of plain byte-level BPE with the usual word pattern are run by `tiktoken`
on the same vocabulary, which is several times as fast and gives the same ids;
any other file is run by `tokenizers` itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

DEFAULT = "byte_bpe_50k.json"


def _locate(file: str) -> str:
    """A path as it is, or a file of the installed public tokenizers by name."""
    if os.path.dirname(file):
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE spells bytes as characters: printable Latin-1 as itself, the others from 256 on in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts with one tokenizer file."""

    def __init__(self, file: str = DEFAULT):
        path = _locate(file)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._slow = self._fast = None
        self._special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if self._plain(spec):
            import public_tokenizers
            import tiktoken

            of = _byte_of_char()
            ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self._special}
            self._fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._special)
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._slow = Tokenizer.from_file(path)

    @staticmethod
    def _plain(spec: dict) -> bool:
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain_special = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in spec.get("added_tokens", []))
        prefix = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        return before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not prefix and not model.get("ignore_merges") and plain_special

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a special token's string in a text is that token."""
        if self._slow is not None:
            return [np.array(e.ids, dtype="<u4") for e in self._slow.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if any(s in text for s in self._special):
                ids = self._fast.encode(text, allowed_special="all")
            else:
                ids = self._fast.encode_ordinary(text)
            out.append(np.array(ids, dtype="<u4"))
        return out


@lru_cache(4)
def encoder(file: str = DEFAULT) -> Encoder:
    """The encoder of a file, loaded once in each worker."""
    return Encoder(file)
