"""Secret scanning through nested encodings.

Each text starts a worklist of layers. A layer is searched by three patterns,
then every encoded part of it becomes a further layer: percent escapes and
backslash-u escapes are decoded in place, so that what surrounds them stays;
base64 runs become layers of their own, after decompression where the bytes
begin like a compressed stream. The list is worked off until no new layer
appears; a layer whose content and place were seen before is not taken up
again, which ends cycles. Each character of a layer knows the span of the
original text that it came from, so finds map back to the original.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm.common import table
from runweave.llm.text import blocks, utf8, words

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # longest runs, so the same as filtering all runs by length
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
#: Escapes of an escape's own first character, one inside the other; more than NESTED of them become so many at once.
NESTED = 4
_DEEP_PERCENT = re.compile(r"%%(?:25){%d,}(?=[0-9A-Fa-f]{2})" % (NESTED + 1))
_DEEP_ESCAPE = re.compile(r"\\(?:u005[cC]|x5[cC]|u\{5[cC]\}|U0000005[cC]){%d,}(?=[uUx])" % (NESTED + 1))
_INNER = re.compile(r"25|u005[cC]|x5[cC]|u\{5[cC]\}|U0000005[cC]")
#: Shortest base64 run that is tried; 16 characters hold the 12 bytes that the shortest assignment needs.
MIN_BASE64 = 16
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: A run over line ends, as base64 is wrapped.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+" % MIN_BASE64)
_PART = re.compile(r"[^/_-]+")
#: Starts of compressed streams that are sought behind what precedes them in a run.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd", re.DOTALL)
#: A compressed layer that is longer is searched in windows of this many bytes that overlap, and the row marked `truncated`.
MAX_LAYER_BYTES, OVERLAP = 64 << 20, 1 << 16

_IN_BASE64 = np.zeros(256, dtype=bool)
_IN_BASE64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_IN_HEX = np.zeros(256, dtype=bool)
_IN_HEX[list(b"0123456789abcdef")] = True


@dataclass
class Layer:
    """A decoded text. Character i came from [start[i], end[i]) of the original, or all of it from `whole`."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    whole: tuple[int, int] | None = None
    #: Whether base64 is sought in it; not in what doesn't read as text.
    guess: bool = True
    #: Further windows of the same stream.
    rest: Iterator[Layer] | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where characters a to b, at least one, came from."""
        if self.whole is not None:
            return self.whole
        if self.start is None:
            return a, b
        return int(self.start[a]), int(self.end[b - 1])

    def sources(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is not None:
            return np.full(b - a, self.whole[0]), np.full(b - a, self.whole[1])
        if self.start is None:
            return np.arange(a, b), np.arange(a + 1, b + 1)
        return self.start[a:b], self.end[a:b]


def find(text: str, hex_runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns in one text, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hex_runs:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _texts(data: bytes) -> list[tuple[str, np.ndarray | None, bool]]:
    """The bytes as text, whatever they are: each reading, the byte behind each character (None: one each), and whether it is mostly printable.

    Bytes that aren't UTF-8 stay as surrogates. Where many bytes are 0, every
    other byte is read as well, which gives the ASCII of UTF-16.
    """
    text = data.decode("utf-8", "surrogateescape")
    ends = None if text.isascii() else np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogateescape")) for c in text), dtype=np.int64, count=len(text)))
    out = [(text, ends)]
    if data.count(0) * 4 >= len(data) > 0:
        out += [(data[k::2].decode("latin-1"), np.arange(k, len(data), 2) + 1) for k in (0, 1)]
    return [(t, e, t.isprintable() or 10 * sum(c.isprintable() or c.isspace() for c in t) >= 9 * len(t)) for t, e in out if t]


def _member(data: bytes):
    """What decompresses the stream that the bytes begin with; None if there is none."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _pieces(data: bytes) -> Iterator[bytes]:
    """What compressed streams after each other hold, as far as they can be read, in pieces."""
    try:
        while (d := _member(data)) is not None:
            if data[:1] == b"\x28":  # its output can't be bounded, so its input is
                at = 0
                while at < len(data) and not d.eof:
                    yield d.decompress(data[at : at + 1024])
                    at += 1024
                data = d.unused_data + data[at:] if d.eof else b""
                continue
            while not d.eof:
                out = d.decompress(data, MAX_LAYER_BYTES)
                yield out
                data = getattr(d, "unconsumed_tail", b"")
                if not out and not data and not d.eof:
                    return
            data = d.unused_data.lstrip(b"\0")  # padding
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _windows(data: bytes) -> Iterator[bytes]:
    """The same in windows of MAX_LAYER_BYTES at most, that overlap."""
    held, fresh = b"", False
    for piece in _pieces(data):
        held += piece
        fresh |= bool(piece)
        while len(held) > MAX_LAYER_BYTES:
            yield held[:MAX_LAYER_BYTES]
            held = held[MAX_LAYER_BYTES - min(OVERLAP, MAX_LAYER_BYTES // 2) :]
    if fresh:
        yield held


def _from_bytes(data: bytes, whole: tuple[int, int]) -> tuple[list[Layer], bool]:
    """The layers inside compressed bytes, through as many compressions as there are; whether they have more than one window.

    What is compressed inside of several windows is not unwrapped further.
    """
    seen, out = set(), []
    while True:
        windows = _windows(data)
        if (data := next(windows, None)) is None:
            return out, False
        key = hashlib.sha256(data).digest()
        if key in seen:
            return out, False
        seen.add(key)
        out = [Layer(text, whole=whole, guess=guess) for text, _, guess in _texts(data)]
        if (second := next(windows, None)) is not None:
            out[0].rest = (Layer(text, whole=whole, guess=guess) for window in chain([second], windows) for text, _, guess in _texts(window))
            return out, True


def _base64_at(layer: Layer, at: np.ndarray, run: str) -> tuple[list[Layer], bool, bool]:
    """The layers in base64 digits, those at places `at` of a layer; whether one was cut; whether they read as a text or a stream from the start."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        data = binascii.a2b_base64(run.replace("-", "+").replace("_", "/") + "==")
    except (binascii.Error, ValueError):
        return [], False, False
    whole = layer.span(int(at[0]), int(at[len(run) - 1]) + 1)
    out, cut = _from_bytes(data, whole)
    if out:
        return out, cut, True
    for m in _MAGIC.finditer(data):
        inner, more = _from_bytes(data[m.start() :], whole)
        out += inner
        cut |= more
    at = at[: len(run)]
    if layer.whole is not None:
        start, end = np.full(len(at), layer.whole[0]), np.full(len(at), layer.whole[1])
    elif layer.start is None:
        start, end = at, at + 1
    else:
        start, end = layer.start[at], layer.end[at]
    found = _texts(data)
    for text, last, guess in found:
        last = np.arange(1, len(text) + 1) if last is None else last
        first = np.concatenate(([0], last[:-1]))
        # bytes [first, last) hold the character; byte i is in digits i * 8 // 6 to (i * 8 + 7) // 6
        out.append(Layer(text, start[first * 8 // 6], end[np.minimum((last * 8 - 1) // 6, len(run) - 1)], guess=guess))
    return out, cut, bool(found) and found[0][2]


def _base64(layer: Layer, a: int, b: int) -> tuple[list[Layer], bool]:
    """The layers in the base64 run from a to b (without padding) of a layer, which may go over line ends.

    If it doesn't read from its first digit, what precedes may be no base64: then
    the three other phases are tried, and the parts between / - and _.
    """
    text = layer.text[a:b]
    at = np.arange(a, b)
    if "\n" in text:
        at = at[np.array([not c.isspace() for c in text])]
        text = "".join(text.split())
    out, cut, reads = _base64_at(layer, at, text)
    if reads:
        return out, cut
    places = [(k, len(text)) for k in (1, 2, 3)] + [m.span() for m in _PART.finditer(text) if m.end() - m.start() < len(text)]
    for x, y in places:
        if y - x >= MIN_BASE64 - 4:
            more, was_cut, _ = _base64_at(layer, at[x:y], text[x:y])
            out += more
            cut |= was_cut
    return out, cut


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> tuple[Layer | None, list[Layer], bool]:
    """The layer with every match decoded, and layers of matches that hold compressed bytes."""
    parts, starts, ends, inner, cut, at = [], [], [], [], False, 0
    exact = layer.whole is None  # else all has one span
    for m in pattern.finditer(layer.text):
        pieces = decode(m[0])
        if pattern is _PERCENT:
            found, more = _from_bytes(bytes.fromhex(m[0].replace("%", "")), layer.span(m.start(), m.end()))
            cut |= more
            inner += found
        parts.append(layer.text[at : m.start()])
        parts += [char for char, _, _ in pieces]
        if exact:
            s, e = layer.sources(at, m.start())
            starts.append(s)
            ends.append(e)
            spans = [layer.span(m.start() + a, m.start() + b) for _, a, b in pieces]
            starts.append(np.array([s for s, _ in spans], dtype=np.int64))
            ends.append(np.array([e for _, e in spans], dtype=np.int64))
        at = m.end()
    if not at:
        return None, inner, cut
    text = "".join(parts) + layer.text[at:]
    if not exact:
        return Layer(text, whole=layer.whole), inner, cut
    s, e = layer.sources(at, len(layer.text))
    return Layer(text, np.concatenate([*starts, s]), np.concatenate([*ends, e])), inner, cut


def _shallow(run: str) -> list[tuple[str, int, int]]:
    """An escape nested in itself, with its last NESTED levels only."""
    at = [m.start() for m in _INNER.finditer(run, 1)][-NESTED]
    return [(run[0], 0, at), *((run[i], i, i + 1) for i in range(at, len(run)))]


def _percent(run: str) -> list[tuple[str, int, int]]:
    """The characters of a run of percent escapes and where each stands."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    out, at = [], 0
    for char in text:
        n = 3 * len(char.encode("utf-8", "surrogateescape"))
        out.append((char, at, at + n))
        at += n
    return out


def _escapes(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in _ONE_ESCAPE.finditer(run):
        code = int(next(x for x in m.groups() if x), 16)
        if code > 0x10FFFF:
            out += [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]
        elif 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + (ord(high) - 0xD800) * 0x400 + code - 0xDC00), a, m.end()))
        else:
            out.append((chr(code), m.start(), m.end()))
    return out


def _children(layer: Layer, base64_runs: list[tuple[int, int]] | None) -> tuple[list[Layer], bool]:
    out, cut = [], False
    for mark, deep, pattern, decode in (("%", _DEEP_PERCENT, _PERCENT, _percent), ("\\", _DEEP_ESCAPE, _ESCAPE, _escapes)):
        if mark in layer.text:
            # each level of a deep nest would be a layer of its own, and cost all of its text
            if deep.search(layer.text):
                pattern, decode = deep, _shallow
            child, inner, more = _in_place(layer, pattern, decode)
            cut |= more
            out += inner + ([child] if child else [])
    if not layer.guess:
        return out, cut
    if base64_runs is None:
        base64_runs = [(m.start(), m.start() + len(m[0].rstrip("="))) for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        base64_runs = base64_runs + [m.span() for m in _WRAPPED.finditer(layer.text)]
    for a, b in base64_runs:
        children, more = _base64(layer, a, b)
        cut |= more
        out += children
    return out, cut


def scan(text: str | None, hex_runs: bool = True, base64_runs: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """Base spans and all spans, as sorted (start, kind, end); layers below the text; whether one was cut.

    `hex_runs` and `base64_runs` may pass on what is known of the text itself.
    """
    if not text:
        return [], [], 0, False
    top = Layer(text)
    base = sorted(find(text, hex_runs))
    spans = set(base)
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest() + b"0"}
    work, cut = _children(top, base64_runs)
    layers = 0
    while work:
        layer = work.pop()
        if layer.rest is not None and (following := next(layer.rest, None)) is not None:
            following.rest = layer.rest
            work.append(following)
        key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest() + repr(layer.span(0, len(layer.text))).encode() if layer.text else b""
        if not key or key in seen:
            continue
        seen.add(key)
        layers += 1
        for a, kind, b in find(layer.text):
            s, e = layer.span(a, b)
            spans.add((s, kind, e))
        more, was_cut = _children(layer, None)
        cut |= was_cut
        work += more
    return base, sorted(spans), layers, cut


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, kind, b = spans[i]
        while i < len(spans) and spans[i][0] < b or i < len(spans) and spans[i][0] == a:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{KINDS[kind]}]"]
        at = b
    return "".join([*out, text[at:]])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None], list]]:
    """Batches with the texts and finds of their rows; runs of the texts themselves are found for a block at once."""
    for batch in blocks(batches):
        buf, offsets = utf8(batch.column("text"))
        texts = batch.column("text").to_pylist()
        starts, ends, _ = words(buf, offsets, _IN_HEX)
        long = starts[ends - starts >= 32]
        has_hex = np.zeros(len(texts), dtype=bool)
        has_hex[np.searchsorted(offsets, long, side="right") - 1] = True
        starts, ends, _ = words(buf, offsets, _IN_BASE64)
        keep = ends - starts >= MIN_BASE64
        starts, ends = starts[keep], ends[keep]
        doc = np.searchsorted(offsets, starts, side="right") - 1
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        starts, ends = points[starts] - points[offsets[doc]], points[ends] - points[offsets[doc]]
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
            runs[d].append((a, b))
        yield batch, texts, [scan(t, has_hex[i], runs[i]) for i, t in enumerate(texts)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of (doc_id, text); extra columns are ignored, repeated rows answered each.

    n_assign, n_access, n_hex and base_sha256 tell of the text itself, `spans`
    of all layers, `n_layers` counts decoded layers and `truncated` is true where
    a compressed layer was longer than MAX_LAYER_BYTES and searched in windows. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _scanned(batches):
            base = [x[0] for x in found]
            count = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(3)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    **{f"n_{kind}": pa.array(n, pa.int64()) for kind, n in zip(KINDS, count, strict=True)},
                    "base_sha256": [hashlib.sha256(spelled(spans).encode()).hexdigest() for spans in base],
                    "spans": [spelled(x[1]) for x in found],
                    "n_layers": pa.array([x[2] for x in found], pa.int64()),
                    "truncated": pa.array([x[3] for x in found], pa.bool_()),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, truncated boolean")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows with every secret in `text` replaced; other columns stay, n_chars follows the text if it is there."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found in _scanned(batches):
            clean = [redact(t, f[1]) if f[1] else t for t, f in zip(texts, found, strict=True)]
            yield batch.set_column(names.index("text"), "text", pa.array(clean, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
