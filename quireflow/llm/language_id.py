"""Language identification with string kernels.

A text is the set of its letter n-grams of 1 to 4 bytes (a blended spectrum, presence not counts), hashed into
``DIMS`` bits. Two texts compare by the size of the common set over the geometric mean of their sizes. Nyström landmarks
turn this kernel into a short vector; one-versus-rest kernel ridge regression in that space predicts. Whole
texts are scored in batches, as two matrix products.

The model is fitted on a bounded sample: at most ``per_lang`` documents of each label, drawn by a hash of their ids, from the
documents whose crc32(doc_id) mod 5 is not 0. Each label is bounded by itself, so a label needs one document to be learned, however many
labels there are; in all these are at most ``per_lang * max_langs`` documents (600,000), of which the driver sees the landmarks alone.

``accept`` asks more than the nearest label: the best value must not be negative (else every language says no), and the best value, its
lead over the second and the length of the text's landmark vector must each reach half of what all but one percent of the rightly told,
labelled documents that were held out reach, of which none is left out. Without such a document only the sign of the best value counts.

Defined cases: null texts and texts without letter are ``und`` with score 0; without any learned label
every text is ``und``; ties go to the label that sorts first; a null doc_id has crc 0, so it is held out; repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import crc_fold, map_rows, settle

DIMS = 1 << 13
FOLDS = 5
OWN_MARKS = 4  # landmarks of each label, at least, as far as it has documents
# ASCII bytes that are not letters become one separator; A-Z become a-z.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint32)


def gram_set(text: str) -> np.ndarray:
    """Presence of hashed 1- to 4-grams as a boolean vector."""
    x = _LETTERS[np.frombuffer(f" {text} ".encode(), dtype=np.uint8)]
    out = np.zeros(DIMS, dtype=bool)
    gram = x
    for n in range(1, 5):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x9E3779B1) + x[n - 1 :] * np.uint32(0x85EBCA77) + np.uint32(n)
        out[(gram * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 13)] = True
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text)))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # DIMS x m, each column of unit length
    weights: np.ndarray  # m x languages

    floors: tuple[float, float, float] = (0.0, 0.0, 0.0)  # least best value, lead and length of a text that counts as told

    def embed(self, sets: np.ndarray) -> np.ndarray:
        x = sets.astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x @ self.landmarks

    def decide(self, sets: np.ndarray) -> np.ndarray:
        """One row per text, one regression value per language."""
        return self.embed(sets) @ self.weights

    def measures(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label of each text, and its value, its lead over the second and the length of the landmark vector."""
        phi = self.embed(sets)
        values = phi @ self.weights
        ranked = np.sort(values, axis=1)
        lead = ranked[:, -1] - ranked[:, -2] if len(self.langs) > 1 else np.full(len(values), np.inf)
        return values.argmax(1), np.stack([ranked[:, -1], lead, np.linalg.norm(phi, axis=1)], axis=1)


def _sets(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        yield {
            "lang": batch["lang"],
            "doc_id": batch["doc_id"],
            "drawn": batch["drawn"],
            "bits": [np.packbits(gram_set(t)).tobytes() for t in batch["text"]],
        }


def _unit(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def _sample(usable: DataFrame, per_lang: int, max_langs: int) -> DataFrame:
    """lang, turn and bits of at most ``per_lang`` documents of each label; turns count a label's documents from 1."""
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not sizes:
        return usable.limit(0).select("lang", F.lit(0).alias("turn"), F.col("text").cast("binary").alias("bits"))
    # Somewhat more than per_lang are drawn, so that the count below it decides.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.2 * (per_lang + 50) / n))])
    draw = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / F.lit(1_000_003.0)
    drawn = usable.where(F.col("lang").isin(list(sizes)) & (draw < share[F.col("lang")]))
    drawn = drawn.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.lit(7)).alias("drawn"), "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id", "bits"))
    turns = map_rows(drawn, "lang string, doc_id long, drawn long, bits binary", _sets).withColumn("turn", turn)
    return turns.where(F.col("turn") <= per_lang).select("lang", "turn", "bits")


def _sums(points: np.ndarray, langs: list[str], sizes: dict[str, int], block: int = 512):
    """This task's share of the weighted Gram matrix and of each label's mean."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        gram, means = np.zeros((points.shape[1],) * 2), np.zeros((points.shape[1], len(langs)))
        place = {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            for at in range(0, len(batch["lang"]), block):
                some = batch["lang"][at : at + block]
                phi = (_unit(batch["bits"][at : at + block]) @ points).astype(np.float64)
                light = phi / np.array([sizes[x] for x in some])[:, None]
                gram += light.T @ phi
                np.add.at(means.T, [place[x] for x in some], light)
        yield {"gram": [gram.tobytes()], "means": [means.tobytes()]}

    return run


def fit(docs: DataFrame, per_lang: int = 1500, landmarks: int = 256, ridge: float = 1e-3, max_langs: int = 400) -> Model:
    """Fit on at most ``per_lang`` labelled documents of each of the ``max_langs`` commonest labels.

    There are ``landmarks`` landmarks, or ``OWN_MARKS`` for each label if that is more.
    """
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold("doc_id", FOLDS) != 0))
    sample = settle(_sample(usable, per_lang, max_langs), "lang-sample")
    sizes = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((DIMS, 0)), np.zeros((0, 0)))
    # Landmarks in turn from each language, so that none is without.
    marks = sample.orderBy("turn", "lang").limit(max(landmarks, OWN_MARKS * len(langs))).select("bits").collect()
    z = _unit([r.bits for r in marks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    solid = values > 1e-6 * values[-1]
    into = (vectors[:, solid] / np.sqrt(values[solid])).astype(np.float32)
    points = z.T @ into
    # Each label weighs as much as any other; only sums go through the driver.
    parts = map_rows(sample.select("lang", "bits").coalesce(8), "gram binary, means binary", _sums(points, langs, sizes)).collect()
    gram = sum(np.frombuffer(p.gram).reshape((points.shape[1],) * 2) for p in parts)
    means = sum(np.frombuffer(p.means).reshape(points.shape[1], -1) for p in parts)
    targets = 2 * means - means.sum(1, keepdims=True)  # own label 1, all others -1
    weights = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), targets)
    return Model(langs, points, weights.astype(np.float32))


def low_values(rows: DataFrame, columns: list[str], share: float, bins: int = 1024) -> list[float | None]:
    """Of each column the largest value, to a millionth of its range, that at least all but ``share`` of the rows reach; null without rows.

    Counts of ``bins`` equal bins, then of the bins of the one that holds it: all rows are counted, and only counts go through the driver.
    """
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("low", F.min), ("high", F.max))]).first()
    if not ends["n"]:
        return [None] * len(columns)
    most_below = int(share * ends["n"])
    low, high = ([ends[f"{c}_{name}"] for c in columns] for name in ("low", "high"))
    for _ in range(2):
        step = [0.0 if x == h else (h - x) / bins for x, h in zip(low, high)]
        # Bin 0 is what lies below the range, so what is below a bin's lower end is the sum of the bins before it.
        place = [
            F.when(F.col(c) < x, 0).when(F.lit(s <= 0), 1).otherwise(F.least(F.floor((F.col(c) - x) / (s or 1.0)), F.lit(bins)) + 1).cast("int")
            for c, x, s in zip(columns, low, step)
        ]
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("at")) for k, p in enumerate(place)])).alias("cell")
        counts = np.zeros((len(columns), bins + 2), dtype=np.int64)
        for r in rows.select(cells).groupBy("cell.k", "cell.at").count().collect():
            counts[r["k"], r["at"]] = r["count"]
        for k in range(len(columns)):
            below = np.concatenate([[0], np.cumsum(counts[k])[:-1]])
            at = max(1, int(np.flatnonzero(below <= most_below)[-1]))
            low[k], high[k] = low[k] + (at - 1) * step[k], low[k] + at * step[k]
    return low


def with_floors(model: Model, docs: DataFrame) -> Model:
    """The model with its floors set on all held-out documents that have a label it has learned."""
    if not model.langs:
        return model
    held = docs.select("lang", "text").where(F.col("lang").isin(model.langs) & F.col("text").isNotNull() & (crc_fold("doc_id", FOLDS) == 0))

    def run(batches: Iterator[dict], block: int = 256) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, len(batch["text"]), block):
                best, found = model.measures(np.stack([gram_set(t) for t in batch["text"][at : at + block]]))
                right = np.array([model.langs[k] == lang for k, lang in zip(best, batch["lang"][at : at + block])], dtype=bool)
                yield {c: found[right, i].astype(np.float64) for i, c in enumerate(("value", "lead", "length"))}

    told = settle(map_rows(held.where(F.col("text").rlike(r"\p{L}")), "value double, lead double, length double", run), "lang-told")
    low = low_values(told, ["value", "lead", "length"], 0.01)
    return replace(model, floors=tuple(0.0 if x is None else max(0.0, x / 2) for x in low))


def _tell(model: Model, texts: list[str | None], block: int = 256) -> tuple[list[str], list[float], list[bool]]:
    """Label and score of each text, and whether it reaches the model's floors."""
    lang, score, told = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    usable = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    for at in range(0, len(usable), block):
        some = usable[at : at + block]
        best, found = model.measures(np.stack([gram_set(texts[i]) for i in some]))
        for i, b, f in zip(some, best, found):
            lang[i], score[i] = model.langs[b], float(np.clip((1 + f[0]) / 2, 0, 1))
            told[i] = bool((f >= model.floors).all())
    return lang, score, told


def _predictor(model: Model):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            lang, score, _ = _tell(model, batch["text"])
            yield batch | {"lang_pred": lang, "score": score}

    return run


def language_id(docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learns from ``docs`` itself."""
    model = fit(docs, **fitting)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = map_rows(rows, "doc_id long, text string, lang_pred string, score double", _predictor(model))
    return out.select("doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.2, **fitting) -> DataFrame:
    """The documents, all columns kept, whose language is told with a score of at least ``least`` and beyond the model's floors; ``und`` goes."""
    model = with_floors(fit(docs, **fitting), docs)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            _, score, told = _tell(model, batch["text"])
            good = [i for i, s in enumerate(score) if told[i] and s >= least]
            yield {name: [values[i] for i in good] for name, values in batch.items()}

    return map_rows(docs, docs.schema, run)
