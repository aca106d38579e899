"""Fence tokens of the known code languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = "plain"

# The tokens of each language, in any case; others are plain text.
LANGUAGES = {
    "rust": ("rust", "rs"),
    "python": ("python", "py"),
    "go": ("go", "golang"),
    "c": ("c", "h"),
    "cpp": ("cpp", "c++", "cc", "cxx", "hpp"),
    "java": ("java",),
    "json": ("json", "jsonc"),
    "css": ("css",),
    "html": ("html", "htm"),
    "bash": ("bash", "sh", "shell", "zsh"),
    "ruby": ("ruby", "rb"),
    "csharp": ("csharp", "c#", "cs"),
    "toml": ("toml",),
    "yaml": ("yaml", "yml"),
    "lua": ("lua",),
    "scala": ("scala", "sbt"),
    "haskell": ("haskell", "hs"),
    "ocaml": ("ocaml", "ml"),
    "elixir": ("elixir", "ex", "exs"),
    "regex": ("regex",),
    "markdown": ("markdown", "md"),
    "javascript": ("javascript", "js", "jsx", "mjs", "cjs"),
    "typescript": ("typescript", "ts"),
    "tsx": ("tsx", "typescriptreact"),
    "php": ("php",),
    "sql": ("sql",),
    "xml": ("xml",),
    "nix": ("nix",),
    "zig": ("zig",),
    "svelte": ("svelte",),
    "swift": ("swift",),
}


def with_language(df: DataFrame, token: Column, name: str = "language") -> DataFrame:
    """Add the language of a fence token by a broadcast of the fixed table above."""
    rows = ", ".join(f"('{t}', '{lang}')" for lang, tokens in LANGUAGES.items() for t in tokens)
    known = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(__token, __lang)")
    return (
        df.withColumn("__token", F.lower(token))
        .join(F.broadcast(known), "__token", "left")
        .withColumn(name, F.coalesce("__lang", F.lit(PLAIN)))
        .drop("__token", "__lang")
    )
