"""Content types by file extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.refs import extension

DEFAULT_TYPE = "application/octet-stream"

# Registered media types of common file extensions.
CONTENT_TYPES = {
    "avif": "image/avif",
    "bmp": "image/bmp",
    "css": "text/css",
    "csv": "text/csv",
    "gif": "image/gif",
    "gz": "application/gzip",
    "htm": "text/html",
    "html": "text/html",
    "ico": "image/x-icon",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "text/javascript",
    "json": "application/json",
    "md": "text/markdown",
    "mjs": "text/javascript",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "ogg": "audio/ogg",
    "otf": "font/otf",
    "pdf": "application/pdf",
    "png": "image/png",
    "svg": "image/svg+xml",
    "tar": "application/x-tar",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "toml": "text/x-toml",
    "ttf": "font/ttf",
    "txt": "text/plain",
    "wasm": "application/wasm",
    "wav": "audio/wav",
    "webm": "video/webm",
    "webp": "image/webp",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "xml": "text/xml",
    "yaml": "text/x-yaml",
    "yml": "text/x-yaml",
    "zip": "application/zip",
}


def with_content_type(df: DataFrame, path: Column, name: str = "content_type") -> DataFrame:
    """Add the content type of ``path`` by a broadcast of the fixed table above."""
    rows = ", ".join(f"('{ext}', '{kind}')" for ext, kind in CONTENT_TYPES.items())
    types = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(__mime_ext, __mime_type)")
    return (
        df.withColumn("__mime_ext", extension(path))
        .join(F.broadcast(types), "__mime_ext", "left")
        .withColumn(name, F.coalesce(F.col("__mime_type"), F.lit(DEFAULT_TYPE)))
        .drop("__mime_ext", "__mime_type")
    )
