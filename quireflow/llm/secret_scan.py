"""Secret scans: known patterns, and a battery of randomness tests on unknown tokens.

Unknown tokens are runs of 16 or more characters of ``[A-Za-z0-9+/_-]`` that mix letters with digits or cases. For
the alphabet their characters suggest (hex, base32, base64) each gets a p-value for being uniformly random: Fisher's combination of a
chi-squared test of uniformity, a runs test about the middle of the alphabet and a test of lag-one serial
correlation. What plain letters of the same length class score is the empirical null: long words of all texts, and the letters of one
passage of each text. A token's second p-value is the share of them that look as random. Benjamini-Hochberg within each length
class keeps the false-discovery rate at ``q``. A class with few such scores borrows those of shorter classes, which look more random.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; added spans that touch a
base span are dropped; repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import map_rows, quoted, settle

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs of any length that reach 16
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KINDS = ("assign", "access", "hex", "random")

# Alphabets in the order of their values; fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SAME = str.maketrans("-_", "+/")
#: Least length of each length class; null scores fall into bins of a tenth of -log10(p), capped by the last.
CLASSES, BINS = (16, 20, 28, 40, 64), 128


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def alphabet_of(token: str) -> str:
    if not set(token.lower()) - set(ALPHABETS["hex"]):
        return "hex"
    return "base32" if not set(token) - set(ALPHABETS["base32"]) else "base64"


def _upper_chi2(value: float, freedom: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    z = ((value / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float:
    """Combined p-value for the token being uniform over its inferred alphabet; near 0 for plain words."""
    kind = alphabet_of(token)
    text = token.lower() if kind == "hex" else token.translate(SAME)
    size = len(ALPHABETS[kind])
    x = np.array([ALPHABETS[kind].index(c) for c in text], dtype=np.float64)
    n = len(x)
    counts = np.bincount(x.astype(np.int64), minlength=size)
    p_uniform = _upper_chi2(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    high = x >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread / math.sqrt(2))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    p_serial = math.erfc(abs(float((d[1:] * d[:-1]).sum()) / power) * math.sqrt(n) / math.sqrt(2)) if power else 2.0 ** (1 - n)
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)  # chi-squared tail with 6 degrees of freedom


def score_bin(token: str) -> int:
    return min(BINS - 1, int(-10 * math.log10(max(randomness(token), 1e-300))))


def length_class(token: str) -> int:
    return sum(len(token) >= c for c in CLASSES) - 1


def unknown_tokens(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, bool]]:
    """Start, end, token and whether it is a plain word, for plain words and for candidates clear of ``spans``."""
    for m in RUN.finditer(text):
        token = m[0]
        if PLAIN.fullmatch(token):
            yield m.start(), m.end(), token, True
        elif not token.isdigit() and MIXED.search(token) and not any(s < m.end() and m.start() < e for s, e, _ in spans):
            yield m.start(), m.end(), token, False


def plain_passage(text: str) -> str | None:
    """Letters of plain words at one place of the text, as many as a length class asks for; the text tells which."""
    draw = zlib.crc32(text.encode())
    least = CLASSES[draw % len(CLASSES)]
    at = draw // len(CLASSES) % max(1, len(text) - 4 * least)
    words = text[at : at + 4 * least].split()[1:-1]  # the first and the last may be cut
    letters = "".join(w for w in (w.strip(".,;:!?") for w in words) if PLAIN.fullmatch(w))
    return letters[:least] if len(letters) >= least else None


class _Bins(dict):
    """Score bins of tokens, kept for tokens that come again."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = got = length_class(token) * BINS + score_bin(token)
        return got


def _scan(batches: Iterator[dict]) -> Iterator[dict]:
    bins = _Bins()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("starts", "ends", "kinds", "found", "null")}
        for text in batch["text"]:
            spans = base_spans(text or "")
            tokens = [(s, e, bins[token], plain) for s, e, token, plain in unknown_tokens(text or "", spans)]
            for k, name in enumerate(("starts", "ends", "kinds")):
                out[name].append([s[k] for s in spans])
            out["found"].append([{"start": s, "end": e, "bin": b} for s, e, b, plain in tokens if not plain])
            passage = plain_passage(text or "")
            own = [length_class(passage) * BINS + score_bin(passage)] if passage else []
            out["null"].append([b for _, _, b, plain in tokens if plain] + own)
        yield {"doc_id": batch["doc_id"]} | out


def discoveries(found: dict[int, int], null: dict[int, int], q: float = 0.01, enough: int = 200) -> list[int]:
    """Benjamini-Hochberg per length class over binned scores: the bins that count as secrets.

    A low bin is a high p-value for randomness, so bins are accepted from 0 upwards.
    """
    accepted = []
    for c in range(len(CLASSES)):
        lowest = c
        while lowest and sum(n for b, n in null.items() if lowest <= b // BINS <= c) < enough:
            lowest -= 1
        pool = [sum(null.get(k * BINS + i, 0) for k in range(lowest, c + 1)) for i in range(BINS)]
        mine = [found.get(c * BINS + i, 0) for i in range(BINS)]
        total, seen, hits, last = sum(mine), 0, 0, -1
        for i in range(BINS):
            seen, hits = seen + mine[i], hits + pool[i]
            if seen and (1 + hits) / (1 + sum(pool)) <= q * seen / total:
                last = i
        accepted += [c * BINS + i for i in range(last + 1)]
    return accepted


def _scanned(docs: DataFrame, q: float) -> tuple[DataFrame, list[int]]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "doc_id long, starts array<int>, ends array<int>, kinds array<string>, "
        "found array<struct<start:int,end:int,bin:int>>, null array<int>"
    )
    scanned = settle(map_rows(rows, schema, _scan), "secrets-scanned")

    def tally(bins: str) -> dict[int, int]:
        return {r.bin: r["count"] for r in scanned.select(F.explode(bins).alias("bin")).groupBy("bin").count().collect()}

    return scanned, discoveries(tally("found.bin"), tally("null"), q)


def secret_scan(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """doc_id and ``spans`` (start, rank, end, kind) of each row, sorted by start, then by kind as in KINDS.

    Base spans are exact; ``random`` spans are the battery's discoveries over all documents.
    """
    scanned, accepted = _scanned(docs, q)
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    base = F.transform(
        F.arrays_zip("starts", "ends", "kinds"),
        lambda s: F.struct(s["starts"].alias("start"), rank[s["kinds"]].alias("rank"), s["ends"].alias("end"), s["kinds"].alias("kind")),
    )
    good = F.array(*map(F.lit, accepted)).cast("array<int>")
    added = F.transform(
        F.filter("found", lambda s: F.array_contains(good, s["bin"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind")),
    )
    return scanned.select("doc_id", F.array_sort(F.concat(base, added)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", q: float = 0.01) -> DataFrame:
    """The documents with every span of ``secret_scan`` replaced by ``mark`` and n_chars counted anew.

    Overlapping spans become one mark. Texts without spans, null texts and other columns stay as they are.
    """
    accepted = set(_scanned(docs, q)[1])
    names = docs.columns

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bins = _Bins()
        for batch in batches:
            texts = []
            for text in batch["text"]:
                spans = base_spans(text or "")
                spans += [(s, e, "random") for s, e, token, plain in unknown_tokens(text or "", spans) if not plain and bins[token] in accepted]
                parts, at = [], 0
                for s, e, _ in sorted(spans):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                texts.append("".join([*parts, text[at:]]) if spans else text)
            yield batch | {"text": texts}

    out = map_rows(docs, docs.schema, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(quoted, names)) if "n_chars" in names else out


def digest(scans: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scans.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
