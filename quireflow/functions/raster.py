"""Sizes of JPEG, WebP and AVIF images from their bytes, as folds in the JVM; no pixel is decoded.

A JPEG is a chain of segments and an AVIF a tree of boxes, each with its own length. The fold's state is a position in the bytes,
and a step goes from one segment or box to the next, until the one that holds the size. A few steps do for almost all
files; only a file that is not done then is folded again, with as many steps as it has bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions.markup import let

STEPS = 48
Step = Callable[[Column, Column], Column]


def big_endian(content: Column, start: Column | int, count: int) -> Column:
    """An unsigned number at a place counted from 1; null beyond the end."""
    raw = F.substring(content, start, count)
    return F.when(F.octet_length(raw) == count, F.conv(F.hex(raw), 16, 10).cast("long"))


def little_endian(content: Column, start: int, count: int) -> Column:
    return sum(big_endian(content, start + k, 1) * 256**k for k in range(count))


def _state(pos: Column, width: Column, height: Column, done: Column) -> Column:
    return F.struct(pos.cast("long").alias("pos"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.coalesce(done, F.lit(True)).alias("done"))


def _walk(content: Column, start: int, step: Step) -> Column:
    none = F.lit(None).cast("int")
    begin = _state(F.lit(start), none, none, F.lit(False))

    def fold(state: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), steps), state, lambda s, _: F.when(s["done"], s).otherwise(step(content, s)))

    def size(s: Column) -> Column:
        return F.struct(s["width"].alias("width"), s["height"].alias("height"))

    whole = F.greatest(F.octet_length(content), F.lit(1))
    return let(fold(begin, F.lit(STEPS)), lambda s: F.when(s["done"], size(s)).otherwise(let(fold(s, whole), size)))


def _jpeg_step(content: Column, s: Column) -> Column:
    """From one marker to the next; the frame's own marker holds height and width."""
    pos = s["pos"]
    lead, kind = big_endian(content, pos, 1), big_endian(content, pos + 1, 1)
    size = big_endian(content, pos + 2, 2)
    frame = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
    alone = (kind == 0x01) | kind.between(0xD0, 0xD7)
    ends = (lead != 0xFF) | kind.isin(0xD9, 0xDA) | (~alone & (kind != 0xFF) & (size < 2))
    after = F.when(kind == 0xFF, pos + 1).when(alone, pos + 2).otherwise(pos + 2 + size)
    here = _state(pos, big_endian(content, pos + 7, 2), big_endian(content, pos + 5, 2), F.lit(True))
    further = _state(after, s["width"], s["height"], ends | after.isNull())
    return F.when((lead == 0xFF) & frame, here).otherwise(further)


# Types of boxes, as numbers: those whose children are walked, and the one with an item's size.
_META, _IPRP, _IPCO, _ISPE = (int.from_bytes(name, "big") for name in (b"meta", b"iprp", b"ipco", b"ispe"))


def _box_step(content: Column, s: Column) -> Column:
    """From one box to the next, or into it. Of several sizes the largest counts: the others are its tiles."""
    pos = s["pos"]
    short, kind = big_endian(content, pos, 4), big_endian(content, pos + 4, 4)
    size = F.when(short == 1, big_endian(content, pos + 8, 8)).otherwise(short)
    after = F.when(kind == _META, pos + 12).when(kind.isin(_IPRP, _IPCO), pos + 8).otherwise(pos + size)
    wide, high = big_endian(content, pos + 12, 4), big_endian(content, pos + 16, 4)
    larger = (kind == _ISPE) & (wide * high > F.coalesce(s["width"].cast("long") * s["height"], F.lit(-1)))
    ends = (size < 8) | (after > F.octet_length(content)) | after.isNull()
    return _state(after, F.when(larger, wide).otherwise(s["width"]), F.when(larger, high).otherwise(s["height"]), ends)


def jpeg_size(content: Column) -> Column:
    return _walk(content, 3, _jpeg_step)


def avif_size(content: Column) -> Column:
    return _walk(content, 1, _box_step)


def webp_size(content: Column) -> Column:
    """The three kinds of first chunk: lossy, lossless, extended."""
    kind = F.hex(F.substring(content, 13, 4))
    packed = little_endian(content, 22, 4)
    lossy, lossless, extended = kind == "56503820", kind == "5650384C", kind == "56503858"
    width = F.when(lossy, little_endian(content, 27, 2) % 16384).when(lossless, packed % 16384 + 1).when(extended, little_endian(content, 25, 3) + 1)
    height = F.when(lossy, little_endian(content, 29, 2) % 16384).when(lossless, F.shiftright(packed, 14) % 16384 + 1).when(extended, little_endian(content, 28, 3) + 1)
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def raster_format(content: Column) -> Column:
    """jpeg, webp or avif by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    brands = F.hex(F.substring(content, 9, 40))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when((F.substring(head, 9, 8) == "66747970") & (brands.contains("61766966") | brands.contains("61766973")), "avif")
    )


def raster_size(content: Column) -> Column:
    """struct(format, width, height); the size is null where the bytes break off before it. Null for other formats."""

    def sized(c: Column, kind: Column) -> Column:
        size = F.when(kind == "jpeg", jpeg_size(c)).when(kind == "webp", webp_size(c)).when(kind == "avif", avif_size(c))
        return let(size, lambda s: F.struct(kind.alias("format"), s["width"].alias("width"), s["height"].alias("height")))

    # Bound once: the bytes may be the value of a long expression.
    return let(content, lambda c: let(raster_format(c), lambda kind: F.when(kind.isNotNull(), sized(c, kind))))
