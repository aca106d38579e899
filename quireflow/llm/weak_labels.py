"""A quality classifier from weak labels.

Overlapping heuristics each call a document good, bad or abstain. Expectation-maximisation estimates how often
each is right on good and on bad documents, from the counts of vote patterns over all documents (there are at most 3 to
the number of heuristics, whatever the corpus). Posterior labels train a linear scorer on hashed features: shapes of
characters in threes, and the heuristics' own measures in steps. All documents are scored.

The scorer is fitted on a bounded sample, about ``sample`` documents drawn by a hash of their ids; patterns and accuracies cover all.

Defined cases: null and empty texts score 0 and are not kept; repeated rows are scored one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import map_rows, settle
from quireflow.llm.quality_rules import text_stats

DIMS = 1024

# Measures in thousandths of the text's words, characters or lines; a heuristic calls bad above the first value and good
# below the second, and abstains between. Fixed values.
HEURISTICS = {
    "symbols": (40, 5),
    "repeats": (150, 20),
    "dup_lines": (300, 20),
    "upper": (300, 100),
    "marks": (50, 15),
    "mean_word": (11_000, 8_000),
    "few_words": (100, 30),
    "no_stops": (900, 500),
}


def measures(text: str) -> list[float]:
    n_words, chars, symbols, dup_lines, repeats, upper, marks, lines = text_stats(text)
    words, letters = max(n_words, 1), max(chars, 1)
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        1000 * symbols / letters,
        1000 * repeats / words,
        1000 * dup_lines / max(lines, 1),
        1000 * upper / letters,
        1000 * marks / letters,
        1000 * chars / words,
        1000 / words,
        1000 * max(0.0, 1 - 20 * stops / words),
    ]


def votes_of(values: list[float]) -> int:
    """Votes as digits to base 3: 0 bad, 1 good, 2 abstain."""
    code = 0
    for value, (bad, good) in zip(values, HEURISTICS.values()):
        code = 3 * code + (0 if value > bad else 1 if value < good else 2)
    return code


def _votes(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        yield {"doc_id": batch["doc_id"], "votes": [votes_of(measures(t)) if t else None for t in batch["text"]]}


def expectation_maximisation(counts: dict[int, int], rounds: int = 100, slips: float = 0.02) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good documents, chances [labeller, class, vote], and the posterior of each pattern.

    Starts from the votes, a bad one counting more since most heuristics see one kind of junk only. One
    pseudo-document per cell keeps every chance above 0; ``slips`` bounds the share of good documents called bad.
    """
    codes = sorted(counts)
    k = len(HEURISTICS)
    votes = np.array([[c // 3 ** (k - 1 - i) % 3 for i in range(k)] for c in codes])
    weight = np.array([counts[c] for c in codes], dtype=np.float64)
    good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
    post = (good + 0.5) / (good + 15 * bad + 1)
    chance, prior = np.ones((k, 2, 3)) / 3, 0.5
    for _ in range(rounds):
        by_class = np.stack([weight * (1 - post), weight * post])
        prior = (by_class[1].sum() + 1) / (weight.sum() + 2)
        for v in range(3):
            chance[:, :, v] = ((votes == v).T[:, None, :] * by_class[None]).sum(2) + 1
        chance /= chance.sum(2, keepdims=True)
        # What a heuristic is asked to be: wrong about few good documents. Kinds of junk share no other trait.
        over = np.maximum(chance[:, 1, 0] - slips, 0)
        chance[:, 1, 0] -= over
        chance[:, 1, 1] += over
        logs = np.log(chance)
        score = np.log(prior / (1 - prior)) + sum(logs[i, 1, votes[:, i]] - logs[i, 0, votes[:, i]] for i in range(k))
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, chance, dict(zip(codes, post.tolist()))


# Shapes: lower, upper, digit, space, line end, full stop or comma, other marks each for themselves.
_SHAPE = np.array(
    [
        0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (32, 9, 13) else 4 if b == 10 else 5 if b in (44, 46) else b
        for b in range(256)
    ],
    dtype=np.uint32,
)


def features(text: str) -> np.ndarray:
    x = _SHAPE[np.frombuffer(text.encode(), dtype=np.uint8)]
    out = np.zeros(DIMS, dtype=np.float32)
    if len(x) >= 3:
        code = (x[:-2] * np.uint32(128) + x[1:-1]) * np.uint32(128) + x[2:]
        out += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=DIMS)
        out = np.log1p(out * (1000 / len(x)))
        out /= max(float(np.sqrt((out * out).sum())), 1e-6)
    for i, value in enumerate(measures(text)):
        step = int(min(15, np.log2(1 + value)))
        out[((i * 16 + step + 1) * 0x85EBCA77 & 0xFFFFFFFF) >> 22] += 0.5
    return out


def _features(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        yield {"votes": [votes_of(measures(t)) for t in batch["text"]], "x": [features(t).astype(np.float16).tobytes() for t in batch["text"]]}


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1e-4, rounds: int = 300, step: float = 4.0) -> np.ndarray:
    """Logistic regression on soft targets by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * ((p - target) @ x / len(x) + ridge * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


def quality_classifier(docs: DataFrame, sample: int = 6000, least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and kept of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    votes = settle(map_rows(rows, "doc_id long, votes int", _votes), "weak-votes")
    counts = {r.votes: r["count"] for r in votes.where("votes is not null").groupBy("votes").count().collect()}
    weights = np.zeros(DIMS + 1, dtype=np.float32)
    if counts:
        posterior = expectation_maximisation(counts)[2]
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
        some = rows.where((F.length("text") > 0) & (draw <= min(1.0, sample / sum(counts.values())))).limit(2 * sample)
        fitted = map_rows(some, "votes int, x binary", _features).collect()
        if fitted:
            x = np.frombuffer(b"".join(r.x for r in fitted), dtype=np.float16).reshape(len(fitted), DIMS).astype(np.float32)
            weights = fit_linear(x, np.array([posterior.get(r.votes, 0.5) for r in fitted], dtype=np.float32))

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for at in range(0, len(batch["text"]), 256):
                texts = batch["text"][at : at + 256]
                x = np.stack([features(t or "") for t in texts])
                p = 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]).astype(np.float64)))
                out += [float(v) if t else 0.0 for t, v in zip(texts, p)]
            yield {"doc_id": batch["doc_id"], "score": out, "kept": [s >= least for s in out]}

    return map_rows(rows, "doc_id long, score double, kept boolean", score)
