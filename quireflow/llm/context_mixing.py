"""LM scoring by logistic context mixing.

The model spells each word bit by bit, to a closing blank; the empty word ends a text. Bit predictors are counts of zeros and ones
that followed a context: the last 1 to 3 bytes of the word (hashed into tables of fixed size), and the whole
beginning of the word, whose counts are exact and grow with the vocabulary. Their log-odds are combined by weights that two gates
choose, place and bit in the word and the depth of context that was seen, and the result is refined by an adaptive map from
predicted to observed chances. Weights and map are learned from every occurrence of every training word, in one pass over
the edges of the vocabulary's prefix trees in which the occurrence itself is taken out of the counts. Within a text, words that came before gain weight: before word t, a word seen n times has chance
(n + CACHE * p) / (t + CACHE). Every step is normalised, so a text's score is a log-probability: total bits, also given per byte.

A word of ``DEEP`` bytes or more is spelled in pieces: its first DEEP bytes, then pieces that each bring the bytes before them as context,
so that every byte of it is counted, learned from and mixed like any other.

How it runs: texts become blocks of word numbers and a list of the block's distinct words. Words are counted over all training
documents by a shuffle, in one row per distinct word; each distinct word is spelled once and its chance goes back to
the blocks that hold it. Only tables of fixed size go through the driver.

Defined cases: a null or empty text is the end token alone; a null doc_id has crc 0, so it is learned from; past the ``DEEP``-th byte of
a word its beginning is that of the piece, from ``LEAD`` - 1 bytes before it; without any training document all counts are 0.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import crc_fold, map_rows, settle

FOLDS, HELD = 7, 2
BLOCK_BYTES = 12 << 20
ORDERS = (1, 2, 3)
ANCHOR, DEEP = 4, 64  # bytes of a word's beginning that a table holds; bytes of a piece
MARK, LEAD = b"\xff", 8  # first byte of a later piece, which no UTF-8 text holds; bytes of it that are not its own
TABLE_BITS = (16, 18, 20, 20)  # one per order, then for beginnings shorter than ANCHOR
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
PREDICTORS = len(TABLE_BITS)
CHUNKS = 64
CACHE = 1500.0
INPUTS, PLACES, DEPTHS, STEPS = PREDICTORS + 1, 6, PREDICTORS + 2, 33
RARE, TRUST = 20, 100.0
HELD_EDGES = 1 << 18  # edges that a learner holds before it learns from them
GATES = PLACES * 8 * DEPTHS
LEARNERS = 12  # parts that even a small vocabulary is dealt into
_PRIOR = np.float32(0.3)


# ---------------------------------------------------------------- words to contexts


def pieces(word: bytes) -> list[bytes]:
    """A word as pieces of at most DEEP bytes: the first, then MARK, the LEAD - 1 bytes before and the piece's own bytes.

    Each byte is one piece's own. Only the last piece is shorter than DEEP, and so brings the close.
    """
    out = [word[:DEEP]]
    at = DEEP
    while len(out[-1]) == DEEP:
        out.append(MARK + word[at - LEAD + 1 : at + DEEP - LEAD])
        at += DEEP - LEAD
    return out


def family(word: bytes) -> bytes:
    """The beginning whose words meet in one task and one tree."""
    return word[: LEAD if word[:1] == MARK else ANCHOR]


class Tree:
    """Sorted distinct words as the edges of their prefix tree: one row per distinct beginning and next byte.

    A word is its first DEEP bytes and, if it is shorter, the closing blank, which no word holds. Of later pieces, which never
    share a tree with words, the first LEAD bytes are context alone.
    """

    def __init__(self, words: list[bytes], weight: np.ndarray):
        raw = [w[:DEEP] + b" " if len(w) < DEEP else w[:DEEP] for w in words]
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        n, width = len(raw), int(self.sizes.max(initial=1))
        inside = np.arange(width) < self.sizes[:, None]
        self.lead = LEAD if words and words[0][:1] == MARK else 0
        table = np.zeros((n, width), dtype=np.uint8)
        table[inside] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        differs = table[1:] != table[:-1]
        common = np.where(differs.any(1), differs.argmax(1), width)
        self.common = np.concatenate([[0], common])  # bytes shared with the word before
        own = inside & (np.arange(width) >= self.common[:, None])
        # Edges by place, then by word, so that those of one beginning stand together.
        self.place, self.word = np.nonzero(own.T)
        self.byte = table[self.word, self.place]
        self.edge = np.zeros((n, width), dtype=np.int64)  # the edge of each word at each place
        self.edge[self.word, self.place] = np.arange(len(self.word))
        self.edge = np.maximum.accumulate(self.edge, axis=0)
        self.inside = inside & (np.arange(width) >= self.lead)
        # An edge's weight is that of the words from its first to the next edge of its place.
        total = np.concatenate([[0.0], np.cumsum(weight)])
        last = np.concatenate([self.place[1:] != self.place[:-1], [True]]) if n else np.zeros(0, dtype=bool)
        end = np.where(last, n, np.concatenate([self.word[1:], [n]]) if n else 0)
        closed = np.zeros((width + 1, n + 1))
        short = np.where(inside, 0.0, weight[:, None])
        closed[:-1, 1:] = np.cumsum(short, axis=0).T  # weight of words already closed at a place
        self.weight = total[end] - total[self.word] - (closed[self.place, end] - closed[self.place, self.word])
        self.first = np.concatenate([[True], self.place[1:] != self.place[:-1]]) | (self.common[self.word] < self.place)
        back = [np.where(self.place >= k, table[self.word, np.maximum(self.place - k, 0)].astype(np.uint32) + 1, 0).astype(np.uint32) for k in ORDERS]
        self.contexts = contexts(back, self.place)

    def depths(self, place: np.ndarray) -> np.ndarray:
        """Places in the word, for the gates; those of later pieces are all deep."""
        return place + DEEP if self.lead else place

    def bits(self, rows=slice(None)) -> np.ndarray:
        return (self.byte[rows, None] >> np.arange(7, -1, -1, dtype=np.uint8)) & 1

    def slots(self, rows) -> np.ndarray:
        return slots(self.byte[rows], [c[rows] for c in self.contexts])

    def counts(self) -> np.ndarray:
        """Weights [edge, bit, value] of what follows each edge's beginning and the bits before."""
        out = np.empty((len(self.byte), 8, 2), dtype=np.float32)
        bits, new = self.bits(), self.first.copy()
        for b in range(8):
            group = np.cumsum(new) - 1
            both = np.bincount(group * 2 + bits[:, b], weights=self.weight, minlength=2 * (group[-1] + 1 if len(group) else 0))
            out[:, b] = both.reshape(-1, 2)[group]
            new[1:] |= bits[1:, b] != bits[:-1, b]
        return out


def contexts(back: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    """A hash for each order, from the bytes before (0 before the word), and one for the word's beginning."""
    out, h = [], np.zeros(len(place), dtype=np.uint32)
    for k, byte in zip(ORDERS, back):
        h = (h ^ (byte + np.uint32(1000 * k))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        out.append(h)
    return [*out, (h ^ np.minimum(place, ANCHOR).astype(np.uint32)) * np.uint32(0xC2B2AE35)]


def slots(byte: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
    """Table slots [predictor, byte, bit]: a context and the byte's bits before this one."""
    node = ((np.uint32(256) | byte.astype(np.uint32))[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) * np.uint32(0x9E3779B1)
    out = np.empty((PREDICTORS, len(byte), 8), dtype=np.int32)
    for k, bits in enumerate(TABLE_BITS):
        h = (context[k][:, None] ^ node) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x297A2D39)
        out[k] = (h >> np.uint32(32 - bits)) + np.uint32(STARTS[k])
    return out


# ---------------------------------------------------------------- mixing


def log_odds(n: np.ndarray) -> np.ndarray:
    return np.log((n[..., 1] + _PRIOR) / (n[..., 0] + _PRIOR))


class Mixer:
    """Weights by gate (place in the word, bit, depth of context) and the adaptive map.

    Learned online by Newton steps: each gate keeps the curvature of all it has seen, so every occurrence counts alike
    in the end, and the learners of several tasks merge as sums.
    """

    def __init__(self):
        # At first a context seen often is believed, and shorter ones the more, the less is known.
        start = np.full((DEPTHS, INPUTS), 0.3)
        start[-1], start[-2] = [0, 0, 0, 1, 0], [0, 0.1, 0.3, 0.5, 0]
        self.weights = np.tile(start, (PLACES * 8, 1))
        self.curve = np.tile(TRUST * np.eye(INPUTS), (GATES, 1, 1))
        self.seen = np.zeros((DEPTHS * 8, STEPS, 3))  # weight, weight of ones, sum of predictions

    @staticmethod
    def depth(x: np.ndarray, often: np.ndarray) -> np.ndarray:
        """How many predictors know their context, and one more if the word's beginning was seen often."""
        return (x[:PREDICTORS] != 0).sum(0) + (often & (x[PREDICTORS - 1] != 0))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32).T
        odds = weights[-1][gate]
        for k in range(PREDICTORS):
            odds += weights[k][gate] * x[k]
        return np.clip(odds, -14, 14)

    @staticmethod
    def cell(gate: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Place of the adaptive map: depth, bit and the prediction's step."""
        step = np.clip(np.rint(odds + STEPS // 2), 0, STEPS - 1).astype(np.int32)
        return (gate % DEPTHS * 8 + gate // DEPTHS % 8) * STEPS + step

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-self.mixed(x, gate).astype(np.float64)))
        x = np.vstack([x, np.ones((1, x.shape[1]))])
        err, power = weight * (bit - p), weight * np.maximum(p * (1 - p), 1e-3)
        slope = np.stack([np.bincount(gate, weights=err * x[i], minlength=GATES) for i in range(INPUTS)], axis=1)
        for i in range(INPUTS):
            for j in range(i, INPUTS):
                more = np.bincount(gate, weights=power * x[i] * x[j], minlength=GATES)
                self.curve[:, i, j] += more
                if i != j:
                    self.curve[:, j, i] += more
        self.weights += np.linalg.solve(self.curve, slope[:, :, None])[:, :, 0]

    def tally(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """Add to the adaptive map what was predicted and what came."""
        odds = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-odds.astype(np.float64)))
        cell = self.cell(gate, odds)
        for i, what in enumerate((weight, weight * bit, weight * p)):
            self.seen[:, :, i] += np.bincount(cell, weights=what, minlength=DEPTHS * 8 * STEPS).reshape(-1, STEPS)

    def corrections(self) -> np.ndarray:
        """By how much the odds at a gate and step were off, on average."""
        n, ones, p = (self.seen[:, :, i] for i in range(3))
        expected = np.clip(p / np.maximum(n, 1e-9), 1e-7, 1 - 1e-7)
        observed = np.clip((ones + 10 * expected) / (n + 10), 1e-7, 1 - 1e-7)
        logit = lambda r: np.log(r / (1 - r))
        return np.where(n > 0, logit(observed) - logit(expected), 0).astype(np.float32).ravel()

    def chance(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Chance of each true bit, refined by half of what the predictions were off."""
        odds = self.mixed(x, gate)
        odds += off[self.cell(gate, odds)] / 2
        return 1 / (1 + np.exp(np.where(bit == 1, -odds, odds)))


def gates(place: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Gate of each bit of each byte."""
    by_place = np.minimum(place, PLACES - 1)[:, None].astype(np.int32) * 8 + np.arange(8, dtype=np.int32)
    return by_place.ravel() * DEPTHS + depth


# ---------------------------------------------------------------- passes


def _blocks(batches: Iterator[dict]) -> Iterator[dict]:
    """Documents as numbers of their block's words, then the words with their training counts."""
    names = ("block", "doc_id", "held_out", "ids", "n_bytes", "word", "idx", "n")

    def row_set(size: int, **cells) -> dict:
        return {c: cells.get(c, [None] * size) for c in names}

    blocks = count(TaskContext.get().partitionId() << 32)

    def close(docs: list, vocabulary: dict) -> Iterator[dict]:
        block = next(blocks)
        n = np.zeros(len(vocabulary), dtype=np.int64)
        for _, held, ids, _ in docs:
            if not held:
                n += np.bincount(ids, minlength=len(n))
        for at in range(0, len(docs), 1000):
            part = docs[at : at + 1000]
            yield row_set(len(part), block=[block] * len(part), doc_id=[d[0] for d in part], held_out=[d[1] for d in part],
                          ids=[d[2].tobytes() for d in part], n_bytes=[d[3] for d in part])
        words = list(vocabulary)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            yield row_set(len(part), block=[block] * len(part), word=part, idx=range(at, at + len(part)), n=n[at : at + len(part)])

    docs, size, vocabulary = [], 0, defaultdict(count().__next__)
    for batch in batches:
        for doc, held, text in zip(batch["doc_id"], batch["held_out"], batch["text"]):
            raw = (text or "").encode().lower()
            words = raw.split()
            words.append(b"")
            ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.uint32, count=len(words))
            docs.append((doc, held, ids, len(raw)))
            size += len(raw) + 64
            if size > BLOCK_BYTES:
                yield from close(docs, vocabulary)
                docs, size, vocabulary = [], 0, defaultdict(count().__next__)
    if docs:
        yield from close(docs, vocabulary)


def _tables(batches: Iterator[dict]) -> Iterator[dict]:
    """This task's counts of all hashed contexts, in chunks."""
    total = np.zeros((2, STARTS[-1]))
    for words, n in _families(batches):
        tree = Tree(words, n)
        counts = tree.counts()
        for at in range(0, len(tree.byte), 100_000):
            rows = slice(at, at + 100_000)
            slot = tree.slots(rows)
            # Each group of edges that share a node counts once: at the first edge that differs from the one before.
            once = np.empty((len(tree.byte[rows]), 8), dtype=bool)
            bits, new = tree.bits(rows), tree.first[rows].copy()
            new[0] |= at == 0
            if at:
                new[0] = tree.first[at]
            fresh = new.copy()
            for b in range(8):
                once[:, b] = fresh
                fresh[1:] |= bits[1:, b] != bits[:-1, b]
                if at:
                    fresh[0] |= bits[0, b] != (tree.byte[at - 1] >> (7 - b)) & 1
            once &= (tree.place[rows] >= tree.lead)[:, None]
            for k, width in enumerate(TABLE_BITS):
                for value in (0, 1):
                    got = np.bincount(slot[k][once] - STARTS[k], weights=counts[rows][once][:, value], minlength=1 << width)
                    total[value, STARTS[k] : STARTS[k + 1]] += got
    if total.any():
        yield {"chunk": range(CHUNKS), "counts": [part.tobytes() for part in np.array_split(total.T, CHUNKS)]}


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.float64) for c in frame["counts"])
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [total.tobytes()]})


def _sum_tables(vocabulary: DataFrame) -> np.ndarray:
    """All tasks' tables added up, in two levels so that no task adds more than a share of them."""
    parts = map_rows(vocabulary, "chunk int, counts binary", _tables)
    some = parts.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("chunk", "turn").applyInPandas(_add, "chunk int, counts binary")
    rows = some.groupBy("chunk").applyInPandas(_add, "chunk int, counts binary").collect()
    if not rows:
        return np.zeros((STARTS[-1], 2), dtype=np.float32)
    rows.sort(key=lambda r: r.chunk)
    return np.frombuffer(b"".join(r.counts for r in rows), dtype=np.float64).reshape(-1, 2).astype(np.float32)


def _families(batches: Iterator[dict], least: int = 8192) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Sorted words and counts in groups that never part a family, and never join words with later pieces."""
    words, n = [], []

    def split(words: list[bytes], n: list) -> Iterator[tuple[list[bytes], np.ndarray]]:
        later = np.array([w[:1] == MARK for w in words], dtype=bool)
        for some in (~later, later):
            at = np.flatnonzero(some)
            if len(at):
                yield [words[i] for i in at], np.array(n, dtype=np.float64)[at]

    for batch in batches:
        words += batch["word"]
        n += batch["c"]
        while len(words) > least:
            stop = len(words) - 1
            while stop and family(words[stop]) == family(words[stop - 1]):
                stop -= 1
            if not stop:
                break
            yield from split(words[:stop], n[:stop])
            words, n = words[stop:], n[stop:]
    if words:
        yield from split(words, n)


def _cut(batches: Iterator[dict]) -> Iterator[dict]:
    """Distinct pieces of each word, under a digest of the word."""
    for batch in batches:
        for word, c in zip(batch["word"], batch["c"]):
            times = Counter(pieces(word))
            of, some = hashlib.sha256(word).digest(), list(times)
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                yield {"of": [of] * len(part), "word": part, "times": [times[x] for x in part], "c": [c * times[x] for x in part]}


def _examples(tree: Tree, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, gates, bits and weight of every edge that training words take.

    What predicts a byte depends on the edge alone, so an edge weighs as much as all occurrences of all its words, and none is left out.
    """
    counts = tree.counts()
    rows = np.flatnonzero((tree.weight > 0.5) & (tree.place >= tree.lead))
    place, bit = tree.place[rows], tree.bits(rows)
    c = tables[tree.slots(rows)]
    c[-1] = np.where((place >= ANCHOR)[:, None, None], counts[rows], c[-1])
    # The occurrence itself is taken out of the counts that predict it.
    c = np.maximum(c - (bit[:, :, None] == np.arange(2)), 0)
    x = log_odds(c).reshape(PREDICTORS, -1).astype(np.float32)
    gate = gates(tree.depths(place), Mixer.depth(x, c[-1].sum(-1).ravel() > RARE)).astype(np.int16)
    return x.reshape(PREDICTORS, -1, 8), gate.reshape(-1, 8), bit, tree.weight[rows]


def _learner(tables):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        mixer, held, size = Mixer(), [], 0
        rng = np.random.default_rng(5)

        def learn() -> None:
            x, gate, bit, weight = np.concatenate([h[0] for h in held], axis=1), *(np.concatenate(part) for part in list(zip(*held))[1:])
            # Words come sorted; what is learned online must come in any order, and what weighs much in several turns.
            turns = 1 + np.log2(np.maximum(weight / RARE, 1)).astype(np.int64)
            order = rng.permutation(np.repeat(np.arange(len(weight)), turns))
            for at in range(0, len(order), 4096):
                own = order[at : at + 4096]
                mixer.learn(x[:, own].reshape(PREDICTORS, -1), gate[own].ravel(), bit[own].ravel(), np.repeat(weight[own] / turns[own], 8))
            for at in range(0, len(weight), 8192):
                own = slice(at, at + 8192)
                mixer.tally(x[:, own].reshape(PREDICTORS, -1), gate[own].ravel(), bit[own].ravel(), np.repeat(weight[own], 8))

        for words, n in _families(batches):
            held.append(_examples(Tree(words, n), tables.value))
            size += len(held[-1][3])
            if size > HELD_EDGES:
                learn()
                held, size = [], 0
        if size:
            learn()
        if mixer.seen.any():
            pull = (mixer.curve @ mixer.weights[:, :, None])[:, :, 0]
            yield {"curve": [mixer.curve.ravel().tolist()], "pull": [pull.ravel().tolist()], "seen": [mixer.seen.ravel().tolist()]}

    return run


def _scorer(tables, weights: np.ndarray | None, seen: np.ndarray | None):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        mixer, odds = Mixer(), log_odds(tables.value)
        often_slot = tables.value.sum(1) > RARE
        if weights is not None:
            mixer.weights = weights
            mixer.seen = seen.reshape(mixer.seen.shape)
        off = mixer.corrections()
        for words, n in _families(batches):
            tree = Tree(words, n)
            counts = tree.counts()
            edge = np.empty(len(tree.byte))
            for at in range(0, len(edge), 8192):
                rows = slice(at, at + 8192)
                slot = tree.slots(rows)
                x = odds[slot]
                late = (tree.place[rows] >= ANCHOR)[:, None]
                x[-1] = np.where(late, log_odds(counts[rows]), x[-1])
                often = np.where(late, counts[rows].sum(2) > RARE, often_slot[slot[-1]])
                x = x.reshape(PREDICTORS, -1)
                gate = gates(tree.depths(tree.place[rows]), mixer.depth(x, often.ravel()))
                chance = mixer.chance(x, gate, tree.bits(rows).ravel(), off)
                edge[rows] = np.log10(chance.reshape(-1, 8).prod(1, dtype=np.float64))
            score = np.where(tree.inside, edge[tree.edge], 0).sum(1)
            yield {"word": words, "c": n.astype(np.int64), "spelled": score}

    return run


def _texts(train_tokens: int, known_words: int):
    rest = math.log10(train_tokens + known_words + 1)

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(words), dtype=np.int64)
        spelled = np.zeros(len(words))
        at = words["idx"].to_numpy()
        c[at], spelled[at] = words["c"].to_numpy(), words["spelled"].to_numpy()
        p = 10.0**spelled
        base = np.log10(c + 1) - rest
        out = []
        for doc, held, raw, n_bytes in zip(docs["doc_id"], docs["held_out"], docs["ids"], docs["n_bytes"]):
            ids = np.frombuffer(raw, dtype=np.uint32)
            n = len(ids)
            order = np.argsort(ids, kind="stable")
            same = ids[order]
            start = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            before = np.empty(n)
            before[order] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
            # The chance of a long word is too small for a double, so a word not seen before stays a logarithm.
            own = np.where(before > 0, np.log10(np.maximum(before, 1) + CACHE * p[ids]), math.log10(CACHE) + spelled[ids])
            score = (own - np.log10(np.arange(n) + CACHE)).sum()
            bits = -score * math.log2(10) / max(1, n_bytes)
            out.append((doc, held, n, int((c[ids] > 0).sum()), train_tokens, base[ids].sum(), score, bits))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        return pd.DataFrame(out, columns=names)

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Base and model log10 probabilities of each row's whole text; learns from the documents that are not held out."""
    spark = docs.sparkSession
    # Ids travel as text: a large one beside a null would lose digits in pandas.
    fold = crc_fold("doc_id", FOLDS) == HELD
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), fold.alias("held_out"), "text")
    schema = "block long, doc_id string, held_out boolean, ids binary, n_bytes long, word binary, idx int, n long"
    blocks = settle(map_rows(rows, schema, _blocks), "lm-blocks")
    words = blocks.where("word is not null").select("block", "word", "idx", "n")
    vocabulary = settle(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-vocabulary")
    train_tokens, known_words = vocabulary.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # Long words are spelled in pieces, each distinct piece once.
    is_long = F.octet_length("word") >= DEEP
    cut = settle(map_rows(vocabulary.where(is_long), "of binary, word binary, times long, c long", _cut), "lm-cut")
    n_cut = cut.count()
    spelt = vocabulary.where(~is_long).unionByName(cut.groupBy("word").agg(F.sum("c").alias("c"))) if n_cut else vocabulary
    # Words with one beginning meet in one task, sorted.
    # As many parts as the vocabulary asks for: learners and their sums are the same on any number of cores.
    parts = max(LEARNERS, (vocabulary.count() + n_cut) // 200_000)
    start = F.when(F.substring("word", 1, 1) == F.lit(MARK), F.substring("word", 1, LEAD)).otherwise(F.substring("word", 1, ANCHOR))
    sorted_ = spelt.repartition(parts, start if n_cut else F.substring("word", 1, ANCHOR)).sortWithinPartitions("word")
    tables = spark.sparkContext.broadcast(_sum_tables(sorted_))
    learned = map_rows(sorted_, "curve array<double>, pull array<double>, seen array<double>", _learner(tables)).collect()
    weights = seen = None
    if learned:
        curve = sum(np.array(r.curve) for r in learned).reshape(GATES, INPUTS, INPUTS)
        weights = np.linalg.solve(curve, sum(np.array(r.pull) for r in learned).reshape(GATES, INPUTS, 1))[:, :, 0]
        seen = sum(np.array(r.seen) for r in learned)
    scored = map_rows(sorted_, "word binary, c long, spelled double", _scorer(tables, weights, seen))
    if n_cut:
        scored = settle(scored, "lm-scored")
        sums = cut.join(scored.select("word", "spelled"), "word").groupBy("of").agg(F.sum(F.col("times") * F.col("spelled")).alias("spelled"))
        of = F.unhex(F.sha2("word", 256)).alias("of")
        long_words = vocabulary.where(is_long).select("word", "c", of).join(sums, "of").select("word", "c", "spelled")
        scored = scored.where(~is_long & (F.substring("word", 1, 1) != F.lit(MARK))).unionByName(long_words)
    back = words.select(F.col("block").alias("home"), "word", "idx").join(scored, "word").select("home", "idx", "c", "spelled")
    texts = blocks.where("word is null").select("block", "doc_id", "held_out", "ids", "n_bytes")
    schema = (
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )
    scores = texts.groupBy("block").cogroup(back.groupBy("home")).applyInPandas(_texts(int(train_tokens), int(known_words)), schema)
    return scores.withColumn("doc_id", F.col("doc_id").cast("long"))
