"""Operators over the whole corpus, against brute force."""

from __future__ import annotations

import collections
import math
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quireflow.llm import ORACLES, context_mixing, near_duplicates, nn_descent, packing, source_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, width=4, percent=80):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(doc, []).append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in ids}


def test_near_duplicates_match_brute_force(docs, make, odd):
    words = " ".join(f"w{i}" for i in range(60))
    # A chain in which only neighbours are similar, and a star of near copies of one text.
    chain = [(3000 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 80))) for i in range(12)]
    star = [(4000 + i, f"{words} extra{i}") for i in range(40)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + chain + star + [r[:2] for r in odd if r[0] is not None]
    want = brute_components(rows)
    out = near_duplicates.near_duplicates(make(rows + [(None, "a b c d e")]), width=4).collect()
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])
    assert near_duplicates.near_duplicates(make([])).count() == 0


def test_least_matches_bound_the_miss_chance():
    need = near_duplicates.least_matches(80)
    rng = np.random.default_rng(0)
    hits = (rng.random((20_000, near_duplicates.HASHES)) < 0.8).cumsum(1)[:, near_duplicates.BATCH - 1 :: near_duplicates.BATCH]
    assert (hits >= need).all() and need == sorted(need) and need[-1] > 60


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500)], "a long, b long")
    got = {r.node: r.component for r in near_duplicates.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_near_duplicates_deal_steps_by_rows_not_by_shuffle_partitions(spark, make, monkeypatch):
    """Many shuffle partitions with few rows each: no step makes a task or a file for each of them."""
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    files, settle = {}, near_duplicates.settle

    def counted(rows, purpose):
        out = settle(rows, purpose)
        files.setdefault(purpose, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_duplicates, "settle", counted)
    rows = [(3 * i, " ".join(f"f{i // 4}w{j}" for j in range(60)) + f" end{i % 4}") for i in range(400)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = near_duplicates.near_duplicates(make(rows), width=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in out} == {3 * i: 12 * (i // 4) for i in range(400)}
    assert len(files["links"]) > 2 and max(max(n) for n in files.values()) <= spark.sparkContext.defaultParallelism, files


# ---------------------------------------------------------------- language model


def test_scores_match_brute_counts(spark, docs, make, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [r[:2] for r in odd]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total = sum(counts.values())
    want = collections.defaultdict(list)
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10(counts[x] + 1) - math.log10(total + len(counts) + 1) for x in w)
        want[d].append((held(d), len(w), sum(x in counts for x in w), total, pytest.approx(base)))
    out = context_mixing.score_texts(make(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) in want[None if r.doc_id != r.doc_id else r.doc_id]
        assert r.score < 0 and math.isfinite(r.score)
    assert context_mixing.score_texts(make([])).count() == 0


def test_chances_of_all_words_sum_to_one_at_most():
    words = sorted({bytes([a, b]) for a in range(97, 105) for b in range(97, 105)} | {b"", b"a" * 70})
    n = np.arange(1.0, len(words) + 1)
    cell = type("Cell", (), {})()
    tables = np.zeros((context_mixing.STARTS[-1], 2), dtype=np.float32)
    cell.value = tables
    out = list(context_mixing._scorer(cell, None, None)(iter([{"word": words, "c": n.tolist()}])))
    assert sum(10.0 ** s for o in out for s in o["spelled"]) <= 1


def test_tree_counts_are_exact():
    words = sorted([b"", b"a", b"ab", b"abc", b"abd", b"b", b"ba", "é".encode(), b"x" * 70])
    n = np.arange(1.0, len(words) + 1)
    tree = context_mixing.Tree(words, n)
    counts = tree.counts()
    closed = [w[: context_mixing.DEEP] + b" " if len(w) < context_mixing.DEEP else w[: context_mixing.DEEP] for w in words]
    bits = ["".join(f"{b:08b}" for b in w) for w in closed]
    for i, w in enumerate(closed):
        for place in range(len(w)):
            edge = tree.edge[i, place]
            for b in range(8):
                at = 8 * place + b
                for value in "01":
                    want = sum(n[j] for j in range(len(words)) if bits[j][:at] == bits[i][:at] and bits[j][at : at + 1] == value)
                    assert counts[edge, b, int(value)] == want


def test_mixing_is_learned_from_every_occurrence(monkeypatch):
    rng = np.random.default_rng(9)
    words = sorted({bytes(rng.integers(97, 101, rng.integers(1, 9), dtype=np.uint8)) for _ in range(3000)} | {b""})
    n = rng.choice([0, 1, 1, 2, 3, 40, 3000], len(words))
    cell = type("Cell", (), {"value": np.zeros((context_mixing.STARTS[-1], 2), dtype=np.float32)})()
    want = 8 * sum(int(k) * (len(w) + 1) for w, k in zip(words, n))
    for held in (context_mixing.HELD_EDGES, 100):
        monkeypatch.setattr(context_mixing, "HELD_EDGES", held)
        batches = [{"word": words[at : at + 500], "c": n[at : at + 500].tolist()} for at in range(0, len(words), 500)]
        (out,) = context_mixing._learner(cell)(iter(batches))
        weight = np.array(out["seen"][0]).reshape(-1, 3)
        assert weight[:, 0].sum() == want and 0 < weight[:, 1].sum() < want and np.isfinite(out["pull"][0]).all()


def test_pieces_hold_every_byte_once():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 119, 120, 121, 500):
        word = bytes(rng.integers(97, 123, size, dtype=np.uint8))
        got = context_mixing.pieces(word)
        assert b"".join(p[context_mixing.LEAD :] if p[:1] == context_mixing.MARK else p for p in got) == word
        assert all(len(p) == context_mixing.DEEP for p in got[:-1]) and len(got[-1]) < context_mixing.DEEP


def test_long_words_are_learned_to_their_end(make):
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    known, strange = letters(3000), letters(3000)
    held = [d for d in range(1, 200) if zlib.crc32(str(d).encode()) % 7 == 2][:4]
    # What was learned stands only past the first DEEP bytes, under other beginnings than those of the scored words.
    rows = [(1000 + i, letters(70) + known) for i in range(40) if zlib.crc32(str(1000 + i).encode()) % 7 != 2]
    rows += [(held[0], letters(71) + known), (held[1], letters(71) + strange), (held[2], letters(64)), (held[3], "é" * 32)]
    out = {r.doc_id: r for r in context_mixing.score_texts(make(rows)).collect()}
    assert len(out) == len(rows) and all(math.isfinite(r.score) for r in out.values())
    assert out[held[0]].bits_per_byte < 2 and out[held[1]].bits_per_byte > 4


# ---------------------------------------------------------------- packing


def test_packing_round_trip(docs, make, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    special = [(800, "a\x1cb \x85 c\xa0d İstanbul 'S don't é １２ ½ <|x|> naïve,.!?  x"), (801, "A" * 9000), (802, "o'clock's WE'LL")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + special + [r[:2] for r in odd]
    want = collections.Counter()
    for d, t in rows:
        want[d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    out = packing.pack_documents(make(rows), with_ids=True).collect()
    got = collections.defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id, r.piece].append((r.start, tuple(ids.tolist())))
    for (d, ids), n in want.items():
        for k in range(0, len(ids), 2048):
            assert got[d, k // 2048].count((k, ids[k : k + 2048])) == n
    assert sum(map(len, got.values())) == sum(n * -(-len(ids) // 2048) for (_, ids), n in want.items())
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(make([])).count() == 0


def test_best_fit_matches_a_plain_scan():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 60, 200).tolist()
        sequence, offset = packing.best_fit(lengths, 64)
        left = []
        for i in sorted(range(200), key=lambda i: -lengths[i]):
            fits = [r for r in left if r >= lengths[i]]
            room = min(fits) if fits else 64
            assert offset[i] == 64 - room
            if fits:
                left.remove(room)
            left.append(room - lengths[i])


# ---------------------------------------------------------------- mixture


def test_mix_matches_sql(make, odd):
    rows = [(d, t, "en", s) for d, (t, s) in enumerate([("one two three", "a"), ("four", None), ("x " * 50, "b"), ("y " * 40, "b"), ("", "c")] * 9)]
    table = make(rows + odd)
    documents = table.toArrow()  # noqa: F841
    want = duckdb.sql(ORACLES["op6_source_mix"]).fetchall()
    out = source_mix.mix(table).drop("source")
    got = [tuple(r) for r in out.select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r[4] <= 2 * r[1] for r in got)
    copies = source_mix.mixed_documents(table)
    assert copies.columns == table.columns
    assert sum(len((r.text or "").split()) for r in copies.collect()) == pytest.approx(sum(r[4] for r in got), rel=0.2)
    assert source_mix.mix(make([])).count() == 0


def test_mix_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in source_mix.targets(sizes).collect()}
    budget, weight, most = 1.5 * 1115, {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 2000, "c": 200, None: 10}
    full = set()
    while True:
        level = (budget - sum(most[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in weight if s not in full and level * weight[s] > most[s]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: most[s] if s in full else level * weight[s] for s in weight})


# ---------------------------------------------------------------- neighbours


def brute_nearest(rows, k=10):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    ids = np.array([r[0] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in rows.collect()])
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    true = {q: dict(near) for q, near in want.items()}
    assert all(s == pytest.approx(true[q][v], abs=1e-12) for q in got for v, s in got[q] if v in true[q])


def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 140)]
    bad = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 2.0, 3.0]), (500, [1.0, float("nan"), 2.0, 3.0]), (600, [float("inf")] * 4),
           (None, [1.0] * 4), (700, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows + rows[:5] + bad], "vec_id long, embedding array<double>, label int, node string")
    out = nn_descent.nearest(table).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows)
    assert {r.query_id for r in out} == set(want)
    for q, near in want.items():
        assert [(r.vec_id, r.score) for r in out if r.query_id == q] == [(v, pytest.approx(d)) for v, d in near]
    assert nn_descent.nearest(table.limit(0)).count() == 0
    assert nn_descent.nearest(table.where("vec_id = 100")).count() == 0


def test_search_goes_on_until_nothing_near_is_left(spark):
    # Each node of a path is nearer to the query than the one before it.
    place = [0.0, *(31.0 - i for i in range(1, 31))]
    nodes = spark.createDataFrame([(i, bytearray(np.array([x, 1.0]).tobytes())) for i, x in enumerate(place)], "node long, x binary")
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    found = nn_descent.search(nodes, path, spark.createDataFrame([(0,)], "q long")).collect()
    assert {(r.node, r.d) for r in found} == set(enumerate(place))
    assert nn_descent.trees(2_000) == nn_descent.TREES < nn_descent.trees(50_000) < nn_descent.trees(10_000_000)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_hand_on_documents(spark, docs):
    rows = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.settle(stage(spark, rows, SF), f"test-{name}")
        assert rows.dtypes == docs.dtypes, name
        kept[name] = rows.collect()
    ids = lambda name: [r.doc_id for r in kept[name]]
    told = {r.doc_id: r.text for r in kept["language"]}
    want = brute_components(list(told.items()), width=5)
    assert sorted(ids("near_duplicates")) == sorted(d for d, c in want.items() if d == c)
    assert sorted(ids("secrets")) == sorted(ids("near_duplicates"))
    assert set(ids("mixture")) <= set(ids("secrets")) and max(collections.Counter(ids("mixture")).values()) <= 2
    out = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == collections.Counter(ids("mixture"))
