import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib

import zstandard

from runweave.llm import secrets

PATTERNS = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
ODD = [
    "password=abcdefg", "PassWord='abcdefgh' apikey: api_key=12345678", "paſſword=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 11, "xAKIA" + "B" * 12 + " é AKIA" + "0" * 30,
    "g" + "0" * 32 + "g", "0" * 31, "token = " + "ab" * 20, "漢" * 5 + " secret : \"zzzzzzzz\"", None, "", "token=password=abcdefgh", "%", "\\u", "%zz \\uzzzz %e9 \\ud800 x",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            if not (kind == 0 and len(m[2]) < 8 or kind == 1 and len(m[0]) < 16 or kind == 2 and len(m[0]) < 32):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_against_brute_force(spark, clashing):
    rng = random.Random(9)
    pieces = ["password", "token", "=", ": ", '"', "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", " ", "é", "api_key", "%41", "\\u0041", "zz"]
    texts = [*ODD, *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300))]
    for frame in (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), clashing):
        of = {}
        for r in frame.collect():
            of.setdefault(r["doc_id"], []).append(r["text"])
        got = secrets.find_secrets(frame).collect()
        assert len(got) == frame.count()
        for r in got:
            want = brute(of[r["doc_id"]][0])
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in want) for kind in range(3)]
            assert r["base_sha256"] == hashlib.sha256(secrets.spelled(want).encode()).hexdigest()
            assert set(filter(None, secrets.spelled(want).split(","))) <= set(r["spans"].split(","))


def wrapped(text, layers, rng):
    for layer in layers:
        data = text.encode()
        if layer == "url":
            text = "".join(f"%{b:02X}" for b in data)
        elif layer == "unicode":
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif layer == "base64":
            text = base64.b64encode(data).decode()
        else:
            pack = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress}[layer]
            text = base64.b64encode(pack(data)).decode()
    return text


def test_planted_layers():
    rng = random.Random(1)
    for layers in (["url"], ["unicode"], ["base64"], ["gzip"], ["zlib"], ["bz2"], ["xz"], ["zstd"], ["url", "base64"], ["base64", "url"], ["unicode", "url", "base64"], ["base64", "base64", "base64"], ["gzip", "gzip"], ["base64", "zlib", "unicode"]):
        hidden = wrapped("password=hunter2hunter2", layers, rng)
        text = f"é before {hidden} after"
        base, spans, found, cut = secrets.scan(text)
        inside = [(a, b) for a, _, b in spans if 9 <= a and b <= 9 + len(hidden)]
        assert found >= len(set(layers)) > 0 and inside and not cut, layers
        assert "hunter" not in secrets.redact(text, spans)


def test_spans_are_exact_in_place():
    text = "x %70assword=abcdefgh y \\u0074oken:12345678 z"
    _, spans, _, _ = secrets.scan(text)
    assert {text[a:b] for a, _, b in spans} == {"%70assword=abcdefgh", "\\u0074oken:12345678"}
    inner = base64.b64encode(b"12 token=abcdefgh 34").decode()
    _, spans, _, _ = secrets.scan(f"__ {inner} __")
    (a, _, b), = spans
    assert b"token=abcdefgh" in base64.b64decode(f"__ {inner} __"[a - (a - 3) % 4 : b + (-(b - 3)) % 4])


def test_cycles_and_bombs_end(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER_BYTES", 1000)
    bomb = base64.b64encode(gzip.compress(b"token=abcdefgh " + b" " * 100_000)).decode()
    _, spans, _, cut = secrets.scan(bomb)
    assert cut and spans
    assert secrets.scan("%25" * 50)[2] <= 60  # each layer unwraps to the next until none is left


def test_redaction(spark, documents, nothing):
    frame = spark.createDataFrame([(1, "a password=abcdefgh b", "k", 5), (2, None, "k", None), (3, "clean", None, 5)], "doc_id long, text string, source string, n_chars long")
    assert sorted(tuple(r) for r in secrets.redact_secrets(frame).collect()) == [(1, "a [assign] b", "k", 12), (2, None, "k", 0), (3, "clean", None, 5)]
    assert secrets.redact_secrets(nothing).collect() == [] and secrets.redact("ab", [(0, 2, 2), (0, 0, 1)]) == "[hex]"


def test_layers_that_do_not_read_as_text():
    secret = "password=hunter2hunter2"
    plain = [f"\ufeff{secret}".encode(), f"prix\u00a0: {secret}".encode(), f"\x1b[31m{secret}\x1b[0m".encode(), f"\0\0{secret}\0".encode(), secret.encode("utf-16"), f"é {secret}".encode("latin-1"), bytes(range(128, 200)) + secret.encode()]
    for data in plain:
        hidden = [base64.b64encode(data).decode(), base64.b64encode(gzip.compress(data)).decode(), "".join(f"%{b:02X}" for b in data)]
        for text in hidden[: 2 if b"p\0a" in data else 3]:
            _, spans, _, cut = secrets.scan(f"x {text} y")
            assert spans and not cut and "assign" in secrets.redact(f"x {text} y", spans), data


def test_base64_over_lines_and_behind_other_characters():
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz \n") for _ in range(400))
    secret = f"{noise} password=hunter2hunter2 {noise}".encode()
    for data in (secret, gzip.compress(secret), bz2.compress(secret), lzma.compress(secret), zstandard.compress(secret)):
        for end in ("\n", "\r\n"):
            run = base64.b64encode(data).decode()
            lines = end.join(run[i : i + 76] for i in range(0, len(run), 76))
            for before in ("", "/path/", "id_", "data-", "x", "xy"):
                for hidden in (before + run, before + lines):
                    text = f"see {hidden} end"
                    _, spans, _, _ = secrets.scan(text)
                    assert any(k == 0 and 4 <= a and b <= 4 + len(hidden) for a, k, b in spans), (before, end, data[:4])
    pad = base64.b64encode(b"." * 40 + b" token=abcdefgh ").decode()  # over the line end
    text = pad[:64] + "\n" + pad[64:]
    (a, _, b), = secrets.scan(text)[1]
    assert a < 64 < b and "\n" in text[a:b]


def test_streams_are_read_to_their_end(monkeypatch):
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for after in (b"", b"junk"):
            hidden = base64.b64encode(pack(b"first member, ") + pack(b"second password=hunter2hunter2") + after).decode()
            _, spans, _, cut = secrets.scan(hidden)
            assert spans and not cut, (pack, after)
    monkeypatch.setattr(secrets, "MAX_LAYER_BYTES", 1000)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for at in (10, 985, 1490, 1990, 50_000):
            _, spans, _, cut = secrets.scan(base64.b64encode(pack(b" " * at + b"token=abcdefgh" + b" " * 3000)).decode())
            assert spans and cut, (pack, at)


def test_deep_nests_take_one_pass():
    began = time.process_time()
    for text in ("%" + "25" * 500_000 + "74oken=abcdefgh", "\\" + "u005c" * 200_000 + "u0074oken=abcdefgh", "\\" + "x5C" * 200_000 + "x74oken=abcdefgh", "%25" * 300_000 + "token=abcdefgh"):
        _, spans, layers, cut = secrets.scan(text)
        assert any(k == 0 and b == len(text) for _, k, b in spans) and layers < 60 and not cut
    assert time.process_time() - began < 120


def test_nests_against_plain_unwrapping():
    """Every depth, and several depths in one text, finds what decoding level by level with the standard library does."""
    rng = random.Random(8)
    for depth in range(1, 14):
        other = rng.randrange(1, 14)
        text = f"a %{'25' * (depth - 1)}74oken=abcdefgh b %{'25' * (other - 1)}70assword=abcdefgh c"
        seen, plain = text, set()
        while True:
            plain |= {m[0] for m in re.finditer(PATTERNS[0], seen)}
            if seen == (seen := urllib.parse.unquote(seen)):
                break
        assert plain == {"token=abcdefgh", "password=abcdefgh"}
        assert {text[a:b] for a, k, b in secrets.scan(text)[1] if k == 0} == {text[2 : text.index(" b")], text[text.index(" b") + 3 : -2]}, text
