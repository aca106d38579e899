"""Best-fit decreasing packing of tokenized documents.

Documents become token ids and an end id; only those longer than a sequence are cut. Pieces are dealt by a hash
into blocks of about ``block`` pieces; each block is packed longest first, every piece into the open sequence
that it fills best. A segment tree over the remaining capacities (1 to ``capacity``) finds that sequence in
logarithmic time. Blocks are large against a sequence, so what they lose by not sharing open sequences is below
one sequence each.

Texts are tokenized word by word: the tokenizer splits at white space first, so a text's ids are those of its words in turn,
and words that come again are looked up. The ids themselves stay in the tasks unless asked for.

Defined cases: null and empty texts are the end id alone; a null doc_id is kept; rows with the same id are packed one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import map_rows, settle

WORD = re.compile(r"[^ \t\n\r]+")
CONTROL = re.compile("[\x1c-\x1f]")
CAPACITY = 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    White space ends every token, so a text's ids are those of its words. Ids of recent words are kept, in two
    generations of up to ``keep`` words: a word used in the younger one survives when the older one goes.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.keep = keep
        size = self.tokenizer.get_vocab_size()
        # Tokens that end a run of letters; only they carry the vocabulary's end-of-word mark.
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _encode(self, entries: list[str]) -> dict[str, bytes]:
        """Ids of new entries. Runs of letters are one token group each, so one call does many and the end marks part them."""
        got: dict[str, bytes] = {}
        plain, rest = [], []
        for w in entries:
            (plain if w.isalpha() else rest).append(w)
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a letter that is more than letters in lower case
                rest += some
                continue
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, (4 * stops).tolist()):
                got[w] = raw[start:stop]
                start = stop
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            got[w] = np.array(e.ids, dtype="<u4").tobytes()
        return got

    def _known(self, entries: list[str]) -> list[bytes]:
        """Ids of distinct entries."""
        young, old = self.young, self.old
        missing = [w for w in entries if w not in young]
        if missing:
            again = {w: old[w] for w in missing if w in old}
            young |= again
            young |= self._encode([w for w in missing if w not in again])
        return list(map(young.__getitem__, entries))

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.young, self.old = {"": b""}, self.young
        column = pa.array(texts, pa.string())
        # Splitting at blanks also splits at the four control characters that the tokenizer takes for text.
        odd = np.flatnonzero(pc.match_substring_regex(column, CONTROL.pattern).to_numpy(zero_copy_only=False))
        by_text = pc.utf8_split_whitespace(column)
        words = by_text.flatten().dictionary_encode()
        # A plain word with marks after it is the word's ids, then the marks'; most words are a known one in other letters or with other marks.
        whole = words.dictionary
        core = pc.utf8_rtrim(whole, characters=".,!?")
        low = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        plain = pc.utf8_is_alpha(core)
        cores = pc.if_else(plain, low, whole).dictionary_encode()
        marked = np.flatnonzero(pc.and_(plain, pc.less(pc.binary_length(core), pc.binary_length(whole))).to_numpy(zero_copy_only=False))
        marks = [w[len(c) :] for w, c in zip(whole.take(marked).to_pylist(), core.take(marked).to_pylist(), strict=True)]
        known = {"": 0} | {m: k + 1 for k, m in enumerate(dict.fromkeys(marks))}
        of_mark = np.zeros(len(whole), dtype=np.int64)
        of_mark[marked] = [known[m] for m in marks]
        # One list of ids for each core, then one for each kind of marks; each word is two of them.
        ids = self._known(cores.dictionary.to_pylist() + list(known))
        ends = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))
        pair = np.stack([cores.indices.to_numpy().astype(np.int64), of_mark + len(cores.dictionary)], axis=1)
        told = lists.take(pa.array(pair[words.indices.to_numpy()].ravel()))
        raw = told.flatten().to_numpy().tobytes()
        places = 4 * told.offsets.to_numpy().astype(np.int64)[2 * by_text.offsets.to_numpy().astype(np.int64)]
        out = [raw[start:stop] for start, stop in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
        for k in odd.tolist():
            found = WORD.findall(texts[k])
            distinct = list(dict.fromkeys(found))
            some = dict(zip(distinct, (e.ids for e in self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False)), strict=True))
            out[k] = np.array([i for w in found for i in some[w]], dtype="<u4").tobytes()
        return out


def blocks_of(texts: list[str], rows: int, chars: int) -> Iterator[slice]:
    """Slices of at most ``rows`` texts, closed once they hold ``chars`` characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= chars or k + 1 - start == rows:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_TEXT_IDS: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One per Python worker, so that tasks that follow each other share what it keeps."""
    if path not in _TEXT_IDS:
        _TEXT_IDS[path] = TextIds(path)
    return _TEXT_IDS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, block: int = 2048, chars: int = 8_000_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids as bytes if asked for."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, stop = text_ids(path), end.to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            whole = [t or "" for t in batch["text"]]
            for part in blocks_of(whole, block, chars):
                out: dict[str, list] = {n: [] for n in names}
                for doc, ids in zip(batch["doc_id"][part], ids_of.of(whole[part])):
                    ids += stop
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k : k + 4 * capacity]
                        row = (doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), piece)
                        for n, v in zip(names, row):
                            out[n].append(v)
                yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run)


class Capacities:
    """Open sequences by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, sequence: int) -> None:
        self.open[left].append(sequence)
        node = self.leaves + left
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest sequence with room for ``need``, and its room; None if there is none."""
        node, count = self.leaves + need, self.count
        if not count[node]:
            # Up to the first subtree on the right that is not empty, then down its left edge.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        left = node - self.leaves
        sequence = self.open[left].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return left, sequence


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, packed longest first (ties in the given order)."""
    open_, n = Capacities(capacity), 0
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = open_.take(lengths[i])
        if got is None:
            got, n = (capacity, n), n + 1
        left, sequence[i] = got
        offset[i] = capacity - left
        if left > lengths[i]:
            open_.add(left - lengths[i], sequence[i])
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = 20_000) -> DataFrame:
    """``rows`` (settled, with a column length) and their sequence_id and offset."""
    blocks = max(1, -(-rows.count() // block))
    order = [c for c in rows.columns if c != "ids"]
    # Only what packing needs goes through Arrow as numbers; an id beside nulls would lose digits as a float.
    texts = {c: F.col(c).cast("string") for c in order if c != "length"}
    kinds = {f.name: f.dataType for f in rows.schema}

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        sequence, offset = best_fit(part["length"].tolist(), capacity)
        return part.assign(sequence_id=[(int(key[0]) << 32) + s for s in sequence], offset=offset).drop(columns="__block")

    schema = ", ".join(f"`{n}` {'string' if n in texts else kinds[n].simpleString()}" for n in rows.columns) + ", sequence_id long, offset long"
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks))).withColumns(texts)
    packed = dealt.groupBy("__block").applyInPandas(run, schema)
    return packed.withColumns({c: F.col(c).cast(kinds[c]) for c in texts})


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents with the sequence each is in and its offset there.

    ``with_ids`` carries the token ids of each piece, so that a sequence is its pieces' ids by offset.
    """
    return pack(settle(pieces(docs, tokenizer, capacity, with_ids=with_ids), "packing-pieces"), capacity)
