"""Document corpora as DataFrames."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions.hashing import document_hash


def anchored(glob: str, base: str) -> str:
    """A glob counts from the configuration's folder unless it is absolute."""
    if glob.startswith("/") or "://" in glob:
        return glob
    return posixpath.join(base, glob)


def scan(spark: SparkSession, folder: str, pattern: str = "*", config_text: str = "") -> DataFrame:
    """(source_entry, text, doc_hash), one row per file below ``folder``, each read as a whole.

    ``pattern`` tests file names. Files are listed and read by Spark, many small ones to a
    task; unreadable or vanished files are left out. Pack a corpus of very many files once (``pack``) and scan the shards.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("ignoreMissingFiles", "true")
        .text(folder, wholetext=True)
    )
    return files.select(
        F.col("_metadata.file_path").alias("source_entry"),
        F.col("value").alias("text"),
        document_hash(config_text, F.col("value")).alias("doc_hash"),
    )


#: Rows of a shard: where the document came from, and its whole text.
SHARD = "source_entry string, text string"


#: Size of a shard of a large corpus.
SHARD_BYTES = 128 << 20


def pack(documents: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, shards_wanted: int | None = None) -> int:
    """Write documents (source_entry, text) as shards of about ``shard_bytes`` each, and tell how many there are.

    Instead of more than ``shards_wanted`` shards come larger ones, up to ``SHARD_BYTES``: a stream takes shards by number, so shards
    of one small size would make its batches, each with its fixed cost, as many as the corpus is large.

    A corpus of many small files costs a listing, an open and a split for each of them; shards are planned by
    their total size. Documents are dealt by a hash of their place, so that a retried task deals them alike; none is cut.
    """
    size = documents.agg(F.sum(F.octet_length("text") + F.octet_length("source_entry"))).first()[0] or 0
    if shards_wanted is not None:
        shard_bytes = max(shard_bytes, min(SHARD_BYTES, -(-size // shards_wanted)))
    shards = max(1, -(-size // shard_bytes))
    documents.select("source_entry", "text").repartition(shards, "source_entry").write.mode("append").parquet(folder)
    return shards


def scan_shards(spark: SparkSession, folder: str, pattern: str = "*", config_text: str = "") -> DataFrame:
    """What ``scan`` gives, of documents in shards; ``pattern`` tests the names of the packed files."""
    documents = spark.read.schema(SHARD).parquet(folder).where(F.regexp(_file_name(F.col("source_entry")), F.lit(_glob(pattern))))
    return documents.withColumn("doc_hash", document_hash(config_text, F.col("text")))


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def _glob(pattern: str) -> str:
    """A file name pattern with ``*`` and ``?`` as a regular expression for whole names."""
    parts = [{"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern]
    return "^" + "".join(parts) + "$"


# The separators of YAML and TOML frontmatter.
YAML_MARK = r"---\s*\n"
TOML_MARK = r"\+\+\+\s*\n"


def _between(mark: str) -> str:
    """First separator anywhere, at least one character, second separator, body.

    Atomic groups keep the first separators found; otherwise the match would go on to later ones.
    """
    return rf"(?s)\A(?>.*?(?:^|\n){mark})(?>(.+?)\n{mark})(.*)\z"


def frontmatter(text: Column) -> Column:
    """struct(syntax, front, body, error) of a Markdown document.

    YAML separators are looked for first, then TOML ones; a document without any is all
    body. Text before the first separator is dropped. A frontmatter that is not closed is an
    error; an empty one counts as not closed.
    """

    def has(mark: str) -> Column:
        return text.rlike(rf"(?:^|\n){mark}")

    def part(mark: str, group: int) -> Column:
        return F.regexp_extract(text, _between(mark), group)

    yaml, toml = has(YAML_MARK), has(TOML_MARK)
    closed = F.when(yaml, text.rlike(_between(YAML_MARK))).when(toml, text.rlike(_between(TOML_MARK)))
    return F.struct(
        F.when(yaml, "yaml").when(toml, "toml").alias("syntax"),
        F.when(~closed, None)
        .when(yaml, part(YAML_MARK, 1))
        .when(toml, part(TOML_MARK, 1))
        .alias("front"),
        F.when(~closed, None)
        .when(yaml, part(YAML_MARK, 2))
        .when(toml, part(TOML_MARK, 2))
        .otherwise(text)
        .alias("body"),
        F.when(~closed, "UnclosedFrontmatter").alias("error"),
    )
