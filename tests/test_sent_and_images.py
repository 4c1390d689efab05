"""Events out of fragments against a parser of the whole text; sizes out of built headers."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from lodestar.functions import images
from lodestar.operators import sent


def plain(text, most):
    """(event, data, error) by one pass."""
    if text.endswith("\r"):
        text = text[:-1]
    lines = re.split("\r\n|\n|\r", text)[:-1]
    out, name, data = [], "", []
    for line in lines:
        if len(line) > most:
            return [*out, (None, None, "frame too large")]
        if line == "":
            if data:
                out.append((name or "message", "\n".join(data), None))
            name, data = "", []
        elif not line.startswith(":"):
            field, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if field == "event":
                name = value
            elif field == "data":
                data.append(value)
                if sum(map(len, data)) > most:
                    return [*out, (None, None, "event too large")]
    return out


def test_cut_anywhere_is_the_whole(spark, monkeypatch):
    monkeypatch.setattr(sent, "RANGE", 5)
    rng = random.Random(2)
    bits = ["event: a", "event:b", "event", "data: x", "data:", "data: é😀 y", "data:  two", ": note", "other: z", "", "", "datax: 1", "data: " + "w" * 30]
    streams = ["".join(rng.choice(bits) + rng.choice(["\n", "\r\n", "\r", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["", "data: end", "data: a\n\n", "data: a\r\r", "\n\n\n", "data: q\r\n\r\n"]
    rows = []
    for s, text in enumerate(streams):
        seq = 0
        while text or not seq:
            n = rng.randint(0, 6)
            rows.append((s, seq, text[:n] or (None if rng.random() < 0.3 else "")))
            text, seq = text[n:], seq + 1
    got = {}
    for r in sent.parsed(spark.createDataFrame(rows, "stream int, seq int, text string").repartition(3), 40).collect():
        got.setdefault(r.stream, []).append((r.n, r.event, r.data, r.error))
    for s, text in enumerate(streams):
        assert sorted(got.get(s, []), key=lambda x: x[0]) == [(i + 1, *e) for i, e in enumerate(plain(text, 40))], (s, text)
    assert any(e[3] for x in got.values() for e in x)


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\x08\x02"


def jpeg(w, h, before=b"\xff\xe0\0\x10JFIF\0aaaaaaaaa\xff\xff\xfe\0\x06\xff\xc0zz"):
    return b"\xff\xd8" + before + b"\xff\xc2\0\x11\x08" + struct.pack(">HH", h, w) + b"\x03"


def webp(kind, rest):
    return b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(rest)) + rest


@pytest.mark.parametrize("raw, want", [
    (png(10, 20), ("png", 10, 20)), (jpeg(640, 480), ("jpeg", 640, 480)), (webp(b"VP8X", b"\0\0\0\0" + (299).to_bytes(3, "little") + (99).to_bytes(3, "little")), ("webp", 300, 100)),
    (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 33 | 1 << 14, 44)), ("webp", 33, 44)), (webp(b"VP8L", b"\x2f" + (16 | 8 << 14).to_bytes(4, "little") + b"\0"), ("webp", 17, 9)),
    (png(1, 1)[:20], None), (jpeg(1, 1)[:-4], None), (b"\xff\xd8\xff\xe0\0\x10", None), (b"GIF89a", None), (b"", None), (None, None), (webp(b"ABCD", b"0" * 30), None),
])
def test_sizes_of_headers(raw, want):
    assert images.measured(raw) == want


def test_pixels_are_bound(spark):
    rows = [(0, bytearray(png(100, 100))), (1, bytearray(png(100_000, 100_000))), (2, bytearray(b"x")), (3, None), (4, bytearray(jpeg(8000, 5000)))]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, content binary").select("i", images.image_verdict(F.col("content")).alias("v")).collect()}
    assert got == {0: "accepted", 1: "too_many_pixels", 2: "unsupported", 3: "unsupported", 4: "accepted"}
