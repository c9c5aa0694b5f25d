"""Nested escapes, further encodings, long compressed data."""

import base64
import gzip
import random
import time
import urllib.parse
import zlib

import pytest

from offerloom.llm import secrets

SECRET = "password=abcdef123456XY"


def packed(data):
    return base64.b64encode(data).decode()


def nested(times):
    return "p%" + "25" * times + "61ssword=abcdef123456XY"


def test_long_chains_take_linear_time():
    for text in ("%" + "25" * 50_000 + "41", "\\" + "u005c" * 20_000 + "u0041", "&#38;" + "#38;" * 25_000):
        begin = time.perf_counter()
        base, spans, unopened = secrets.find(text)
        assert time.perf_counter() - begin < 3 and len(spans) <= len(base) + 2 * secrets.ROUNDS and not unopened


@pytest.mark.parametrize("times", [0, 1, 2, 3, 4, 5, 6, 9, 40, 1000])
def test_nested_escapes_are_unwrapped_to_the_end(times):
    text = f"é {nested(times)} end"
    assert (2, len(text) - 4, 0) in secrets.find(text)[1]
    assert secrets.redact(text) == "é [SECRET] end"


def test_chains_of_mixed_escapes():
    text = SECRET
    for quote in [lambda c: f"%{ord(c):02x}", lambda c: f"\\u{ord(c):04X}", lambda c: f"&#{ord(c)};"] * 3:
        text = "".join(quote(c) if c in "p%\\&" else c for c in text)
    assert (0, len(text), 0) in secrets.find(text)[1]


FORMS = {
    "utf-16": packed(SECRET.encode("utf-16")),
    "utf-16-be": packed(SECRET.encode("utf-16-be")),
    "bytes": "".join(f"\\x{ord(c):02x}" for c in SECRET),
    "long": "".join(f"\\U{ord(c):08x}" for c in SECRET),
    "braces": "".join(f"\\u{{{ord(c):x}}}" for c in SECRET),
    "percent-u": "".join(f"%u{ord(c):04x}" for c in SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "hex entities": "".join(f"&#x{ord(c):X};" for c in SECRET),
    "deflate": packed(zlib.compress(SECRET.encode() * 3)[2:-4]),
    "cut off": packed(gzip.compress(SECRET.encode() * 50)[:-9]),
}


@pytest.mark.parametrize("form", FORMS)
def test_other_encodings(form):
    text = f"some text, {FORMS[form]}, more"
    base, spans, unopened = secrets.find(text)
    assert base == [] and {kind for _, _, kind in spans} == {0} and not unopened
    assert FORMS[form] not in secrets.redact(text)


def test_long_compressed_data_are_searched_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_INFLATED", 1 << 21)
    filler = b"plain words of a text " * (secrets.MOST_INFLATED // 22)
    for data in (filler + SECRET.encode() + filler, filler + filler + gzip.compress(packed(SECRET.encode()).encode())):
        text = packed(gzip.compress(data, 9))
        assert {kind for _, _, kind in secrets.find(text)[1]} == {0}
        assert secrets.redact(f"a {text} b") == "a [SECRET] b"
    assert secrets.find(packed(gzip.compress(filler + filler, 9))) == ([], [], 0)


def test_secrets_across_the_ends_of_windows(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_INFLATED", 1 << 10)
    monkeypatch.setattr(secrets, "SHARED", 1 << 7)
    for at in range(1000, 1050):
        assert secrets.find(packed(zlib.compress(b"." * at + b" " + SECRET.encode() + b" " + b"." * 3000)))[1]
    hidden = gzip.compress(random.Random(1).randbytes(5000) + SECRET.encode())
    text = packed(gzip.compress(hidden))
    assert secrets.find(text)[2] == 1 and secrets.redact(text) == "[SECRET]"


def test_ranges_of_decoded_text_are_those_of_the_original():
    drawn = random.Random(3)
    for _ in range(200):
        before, after = ("".join(drawn.choices("xyz é%%\\\u4e00", k=drawn.randrange(30))) + " " for _ in range(2))
        coded = "".join(drawn.choice([c, f"%{ord(c):02X}", f"\\u{ord(c):04x}", urllib.parse.quote(f"%{ord(c):02x}")]) for c in SECRET)
        assert (len(before), len(before) + len(coded), 0) in secrets.find(f"{before}{coded} {after}")[1]
