"""Risk-controlled quality rules.

Rules are cutoffs on text statistics. One half of the labelled documents proposes, for each
stratum, a ladder of cutoff vectors from lenient to strict; the other half, the holdout, certifies them.
A vector passes if the exact (Clopper-Pearson) upper bound of its false rejection of good documents is at
most ``alpha``. The ladder is tested in order and stops at the first failure, so it needs no correction
within a stratum; the error is split evenly (Bonferroni) over strata. With probability 1 - ``delta`` no
stratum loses more than a share ``alpha`` of good documents.

Defined cases: a null or empty text has no words and fails the base rule; a document without label neither proposes nor
certifies; a stratum without enough labels rejects nothing; a document labelled several times counts as good only
if every label says so. Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import SPACES, crc_fold, map_rows, settle

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"

# Each rule: a share per thousand, and the cutoffs it may take, from lenient to strict. Fixed values.
GRID = (1000, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 35, 25, 15, 10)
RULES = {
    "symbols": "1000 * n_symbols / greatest(word_chars, 1)",
    "repeats": "1000 * n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines / greatest(n_lines, 1)",
    "upper": "1000 * n_upper / greatest(word_chars, 1)",
    "marks": "1000 * n_marks / greatest(word_chars, 1)",
    "long_words": "20 * word_chars / greatest(n_words, 1)",
}
# Steps of the ladder: largest share of good proposing documents that one rule may hit.
LADDER = (0.0, 0.0005, 0.001, 0.002, 0.004)


def repeated_words(words: list, span: int = 5) -> int:
    """Number of words inside windows of ``span`` words that occur at least twice."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    windows = lambda: zip(*(words[i:] for i in range(span)))
    seen: set = set()
    twice = set()
    if len(set(windows())) == n:
        return 0
    for w in windows():
        (twice if w in seen else seen).add(w)
    covered = end = 0
    for i, w in enumerate(windows()):
        if w in twice:
            covered += i + span - max(i, end)
            end = i + span
    return covered


def text_stats(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, UPPER)),
        text.count("!") + text.count("?"),
        len(lines),
    )


def _stats(batches: Iterator[dict]) -> Iterator[dict]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        cells = zip(*map(text_stats, batch["text"]))
        yield {"doc_id": batch["doc_id"], "stratum": batch["stratum"]} | dict(zip(names, cells))


def with_stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the statistics of each row's whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), "text")
    return map_rows(rows, f"doc_id long, stratum string, {STATS}", _stats)


def upper_bound(hits: int, trials: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which ``hits`` or fewer still have probability ``error``."""
    if trials == 0 or hits >= trials:
        return 1.0

    def tail(rate: float) -> float:
        logs = [
            math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1)
            + k * math.log(rate) + (trials - k) * math.log1p(-rate)
            for k in range(hits + 1)
        ]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = hits / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > error else (low, mid)
    return high


def _levels(rule: str):
    """How many cutoffs of the grid a row exceeds: at level k it fails the k most lenient ones."""
    value = F.expr(RULES[rule])
    return sum((value > cut).cast("int") for cut in GRID)


def certify(stats: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, max_strata: int = 256) -> dict:
    """Cutoff levels of each stratum that the holdout certifies: ``{stratum: [level of each rule]}``.

    Level k fires on rows past the k-th cutoff of GRID; a level beyond the grid never fires. The
    ``max_strata`` - 1 strata with most labels stand for themselves, all others are one stratum (key None).
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality is not null")
    seen = stats.where("doc_id is not null").join(good, "doc_id").select(
        "stratum", (F.col("quality") == 1).alias("good"), crc_fold("doc_id", 2).alias("fold"), *[_levels(r).alias(r) for r in RULES]
    )
    seen = settle(seen, "rules-labelled")
    largest = seen.groupBy("stratum").count().where("stratum is not null").orderBy(F.desc("count"), "stratum").limit(max_strata - 1)
    own = [r.stratum for r in largest.collect()]
    seen = seen.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("level")) for i, r in enumerate(RULES)]))
    counts: dict = {}
    for r in seen.where("fold = 0 and good").select("stratum", kinds.alias("x")).groupBy("stratum", "x.rule", "x.level").count().collect():
        counts.setdefault(r.stratum, {}).setdefault(r.rule, {})[r.level] = r["count"]
    ladders = {}
    for stratum, rules in counts.items():
        total = sum(rules[0].values())
        ladders[stratum] = []
        for share in LADDER:
            cuts = []
            for i in range(len(RULES)):
                hit, level = 0, len(GRID) + 1
                while level > 1 and hit + rules[i].get(level - 1, 0) <= share * total:
                    level -= 1
                    hit += rules[i].get(level, 0)
                cuts.append(level)
            ladders[stratum].append(cuts)
    never = [len(GRID) + 1] * len(RULES)
    chosen = dict.fromkeys([*own, None], never)
    if not ladders:
        return chosen
    fires = [
        F.sum(F.coalesce(_fires({s: steps[k] for s, steps in ladders.items()}), F.lit(False)).cast("long")).alias(f"x{k}")
        for k in range(len(LADDER))
    ]
    held = {r.stratum: r for r in seen.where("fold = 1 and good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *fires).collect()}
    for stratum, steps in ladders.items():
        for k, cuts in enumerate(steps):
            if stratum not in held or upper_bound(held[stratum][f"x{k}"], held[stratum]["n"], delta / len(ladders)) > alpha:
                break
            chosen[stratum] = cuts
    return chosen


def _fires(chosen: dict):
    """True where a row is past a cutoff of its stratum; needs columns stratum and one level per rule."""
    out = F.lit(False)
    for stratum, cuts in chosen.items():
        hit = F.lit(False)
        for rule, cut in zip(RULES, cuts):
            hit = hit | (F.col(rule) >= cut) if cut <= len(GRID) else hit
        out = F.when(F.col("stratum").eqNullSafe(F.lit(stratum)), hit).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Statistics of each document, whether the base rule fails, and the certified verdict ``kept``."""
    stats = settle(with_stats(docs, stratum), "rules-stats")
    chosen = certify(stats, labels, alpha, delta)
    named = [s for s in chosen if s is not None]
    judged = stats.withColumn("own_stratum", F.col("stratum")).withColumn(
        "stratum", F.when(F.col("stratum").isin(named), F.col("stratum")) if named else F.lit(None).cast("string")
    )
    judged = judged.select("*", *[_levels(r).alias(r) for r in RULES])
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~_fires(chosen)).alias("kept"), F.col("own_stratum").alias("stratum"),
    )
