"""Width and height of images from their headers, without decoding them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that an image may have.
MOST_PIXELS = 50_000_000
#: Segments that hold a JPEG's size, and those without a length.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xDA)}


def _jpeg(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            return None
        marker = raw[at + 1]
        if marker == 0xFF:  # filling
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in FRAMES:
            return (int.from_bytes(raw[at + 7 : at + 9]), int.from_bytes(raw[at + 5 : at + 7])) if at + 9 <= len(raw) else None
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    return None


def _webp(raw: bytes) -> tuple[int, int] | None:
    kind = raw[12:16]
    if kind == b"VP8X" and len(raw) >= 30:  # extended: two numbers of 24 bits, less one
        return int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1
    if kind == b"VP8 " and len(raw) >= 30 and raw[23:26] == b"\x9d\x01\x2a":  # lossy: 14 bits each
        return int.from_bytes(raw[26:28], "little") & 0x3FFF, int.from_bytes(raw[28:30], "little") & 0x3FFF
    if kind == b"VP8L" and len(raw) >= 25 and raw[20] == 0x2F:  # lossless: 14 bits each in one number, less one
        bits = int.from_bytes(raw[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None


def measured(raw: bytes | None) -> tuple[str, int, int] | None:
    """(family, width, height); None of what is no image of a known family or is cut short."""
    raw = raw or b""
    family, size = None, None
    if raw.startswith(b"\x89PNG\r\n\x1a\n") and raw[12:16] == b"IHDR" and len(raw) >= 24:
        family, size = "png", (int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24]))
    elif raw.startswith(b"\xff\xd8\xff"):
        family, size = "jpeg", _jpeg(raw)
    elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        family, size = "webp", _webp(raw)
    return (family, *size) if size else None


def image_size(content: Column) -> Column:
    """A struct (family, width, height), null where there is none."""
    kind = pa.struct({"family": pa.string(), "width": pa.int32(), "height": pa.int32()})

    @F.arrow_udf("family string, width int, height int")
    def run(raws: pa.Array) -> pa.Array:
        found = [measured(x.as_py()) for x in raws]
        return pa.array([None if f is None else dict(zip(("family", "width", "height"), f)) for f in found], kind)

    return run(content)


def image_verdict(content: Column, most: int = MOST_PIXELS) -> Column:
    """accepted, unsupported or too_many_pixels."""
    size = image_size(content)
    pixels = size["width"].cast("long") * size["height"]
    return F.when(size["family"].isNull(), "unsupported").when(pixels > most, "too_many_pixels").otherwise("accepted")
