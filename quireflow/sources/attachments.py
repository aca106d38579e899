"""Attachments: by relative path, from data URLs, and the size of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions.hashing import digest
from quireflow.functions.markup import let
from quireflow.functions.raster import raster_size
from quireflow.functions.mime import with_content_type
from quireflow.functions.refs import id_from_path, id_from_url
from quireflow.operators.joins import key_join

DATA_URL = r"(?s)^data:([^,]*?)(;\s*base64)?\s*,(.*)$"


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of all files below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content", "length")


def normal_path(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``; a leading slash stays."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def beside(document: Column, src: Column) -> Column:
    """The path ``src`` means when written in ``document``."""
    folder = F.regexp_replace(document, "[^/]*$", "")
    return normal_path(F.when(src.startswith("/"), src).otherwise(F.concat(folder, src)))


def join_files(refs: DataFrame, document: str, src: str, files: DataFrame) -> DataFrame:
    """References with (path, derived_id, content_type, length, content_hash, found).

    ``files`` needs ``path``, ``content`` and ``length``. Only digest and length cross the
    shuffle, never the content. A file may be used by very many documents, so the
    reference side is balanced.
    """
    wanted = refs.withColumn("path", beside(F.col(document), F.col(src))).withColumn(
        "derived_id", id_from_path(F.col(src))
    )
    known = files.select(
        normal_path(F.col("path")).alias("path"),
        F.col("length").cast("bigint").alias("length"),
        digest(F.col("content")).alias("content_hash"),
        F.lit(True).alias("found"),
    )
    joined = key_join(wanted, known, ["path"], "left")
    return with_content_type(
        joined.withColumn("found", F.coalesce("found", F.lit(False))), F.col("path")
    )


def data_url(src: Column) -> Column:
    """struct(content_type, body, derived_id, error) of a ``data:`` URL; null for others.

    A URL without a media type is plain ASCII text, as its standard says.
    """
    return let(src, _data_url)


def _data_url(src: Column) -> Column:
    kind = F.trim(F.regexp_extract(src, DATA_URL, 1))
    payload = F.regexp_extract(src, DATA_URL, 3)
    # try_url_decode reads a plus as a blank, as in forms; here it is a plus.
    plain = F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B")))
    body = F.when(
        F.regexp_extract(src, DATA_URL, 2) != "", F.try_to_binary(plain, F.lit("base64"))
    ).otherwise(plain.cast("binary"))
    return F.when(
        src.rlike(DATA_URL),
        F.struct(
            F.when(kind == "", "text/plain;charset=US-ASCII").otherwise(kind).alias("content_type"),
            body.alias("body"),
            id_from_url(src).alias("derived_id"),
            F.when(body.isNull(), "DecodeDataUrl").alias("error"),
        ),
    )


def _be(content: Column, start: int, count: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, count)), 16, 10).cast("int")


def _le16(content: Column, start: int) -> Column:
    return _be(content, start, 1) + _be(content, start + 1, 1) * 256


def _bmp_side(content: Column, place: int) -> Column:
    """Width (place 0) or height (1) of a bitmap: 32 bits, 16 in the oldest headers; rows from the top down have a negative height."""
    start = 19 + 4 * place
    wide = sum(_be(content, start + k, 1).cast("long") * 256**k for k in range(4))
    signed = F.abs(F.when(wide >= 2**31, wide - 2**32).otherwise(wide)).cast("int")
    oldest = F.hex(F.substring(content, 15, 4)) == "0C000000"
    return F.when(oldest, _le16(content, 19 + 2 * place)).otherwise(signed)


_NUMBER = r"""\s*=\s*["']\s*([0-9]*\.?[0-9]+)(?:px)?\s*["']"""


def _svg_root(svg: Column) -> Column:
    return F.regexp_extract(svg, r"(?is)<svg\b[^>]*>", 0)


def _root_size(root: Column) -> Column:
    """Width and height of an SVG's root tag, from its own attributes, else from its viewBox."""
    own = [F.regexp_extract(root, rf"(?is)\s{n}{_NUMBER}", 1) for n in ("width", "height")]
    box = r"""(?is)\sviewBox\s*=\s*["']\s*[-0-9.]+[\s,]+[-0-9.]+[\s,]+([0-9.]+)[\s,]+([0-9.]+)\s*["']"""
    of_box = [F.regexp_extract(root, box, i) for i in (1, 2)]

    def number(a: Column, b: Column) -> Column:
        return F.floor(F.coalesce(a.try_cast("double"), b.try_cast("double"))).cast("int")

    return F.struct(
        number(own[0], of_box[0]).alias("width"), number(own[1], of_box[1]).alias("height")
    )


def image_size(content: Column) -> Column:
    """struct(format, width, height) from an image's header bytes; no pixel is decoded.

    PNG, GIF, BMP, JPEG, WebP, AVIF and SVG (any bytes that are UTF-8 text with an ``svg`` tag). Other formats
    come out null here; ``decoded_sizes`` reads them through Spark's image source.
    """

    def sized(c: Column) -> Column:
        root = _svg_root(F.try_validate_utf8(c.cast("string")))
        return let(root, lambda r: let(raster_size(c), lambda raster: _image_size(c, r, raster)))

    return let(content, sized)


def _image_size(content: Column, root: Column, raster: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    svg = _root_size(root)
    png, gif, bmp = head == "89504E470D0A1A0A", head.startswith("474946383"), head.startswith("424D")
    vector = ~(png | gif | bmp) & raster.isNull() & (root != "")
    return F.struct(
        F.when(png, "png").when(gif, "gif").when(bmp, "bmp").when(vector, "svg").otherwise(raster["format"]).alias("format"),
        F.when(png, _be(content, 17, 4))
        .when(gif, _le16(content, 7))
        .when(bmp, _bmp_side(content, 0))
        .when(vector, svg["width"])
        .otherwise(raster["width"])
        .alias("width"),
        F.when(png, _be(content, 21, 4))
        .when(gif, _le16(content, 9))
        .when(bmp, _bmp_side(content, 1))
        .when(vector, svg["height"])
        .otherwise(raster["height"])
        .alias("height"),
    )


def decoded_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height) of raster images of any format Spark's image source reads."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    return images.select(
        F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image.width", "image.height"
    )
