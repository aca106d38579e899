"""Personal data: fixed patterns against plain regular expressions, selection against known cases."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from quireflow.llm import boosting, pii
from quireflow.llm.quality_rules import upper_bound

SF = "/root/testdata/sf0.001"


def brute_base(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v // 10 + v % 10
        return total % 10 == 0

    digits = lambda s: "".join(c for c in s if c in "0123456789")
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    spans = []
    for rank, (kind, (pattern, good)) in enumerate(checks.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if good(m[0])]
    return [(s, e, k) for s, _, e, k in sorted(spans)]


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    pieces = ["a", ".", "@", "-", "+", " ", "(", ")", "1", "23", "255", "256", "0001", "x.y", "@b.c", "1.2.3.4", "4111111111111111", "+1 212", "555-0147", "é", "４", "\n", "%", "a@b", ".."]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_long_texts_are_scanned_in_linear_time():
    for piece in ("1", "a", "a@", "12 ", "1.", "+1 ", "ab.", "ABCD ", "12:", "(1"):
        text = piece * (200_000 // len(piece))
        start = time.perf_counter()
        pii.proposals(text, pii.base_spans(text))
        assert time.perf_counter() - start < 20, piece


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.fit(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    flat = boosting.fit(x[:10], np.ones(10))
    assert (flat.probability(x[:10]) > 0.99).all() and len(flat.probability(x[:0])) == 0


def test_overlapping_spans_are_resolved_by_rank():
    rng = random.Random(2)
    for _ in range(300):
        ranked = [(s := rng.randrange(40), s + rng.randrange(1, 9), "card") for _ in range(12)]
        want = []
        for span in ranked:
            if all(span[1] <= s or e <= span[0] for s, e, _ in want):
                want.append(span)
        assert pii.clear_of_each_other(ranked) == sorted(want)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]


def test_scan(make, corpus, odd):
    planted = {
        9_000_001: ("write to jo.doe (at) mail (dot) example (dot) org today", "jo.doe (at) mail (dot) example (dot) org"),
        9_000_002: ("SSN: 123-45-6789.", "123-45-6789"),
        9_000_003: ("reached from 2001:db8:85a3:1:2:8a2e:370:7334 again", "2001:db8:85a3:1:2:8a2e:370:7334"),
        9_000_004: ("IBAN DE89 3704 0044 0532 0130 00 here", "DE89 3704 0044 0532 0130 00"),
        9_000_005: ("99.114.106.61 4080166431094600 and more", "4080166431094600"),
    }
    clean = {
        9_100_000 + k: f"the event {x} was noted"
        for k, x in enumerate(["on 2024-03-17", "12:30:45", "1,299,000.00", "version 1.12.3", "978-3-16-148410-0", "1999-2004", "12345678", "300.400.500.60"])
    }
    rows = corpus + [(d, t) for d, (t, _) in planted.items()] + list(clean.items()) + [r[:2] for r in odd]
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    told = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    table = make(rows)
    found = pii.report(pii.pii_scan(table)).collect()
    assert len(found) == len(rows)
    for r in found:
        want = [brute_base(t) for t in texts[r.doc_id]]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) in [tuple(sum(s[2] == k for s in w) for k in pii.KINDS[:4]) for w in want]
        assert r.base_sha256 in [hashlib.sha256(told(w).encode()).hexdigest() for w in want]
        assert any(set(filter(None, told(w).split(","))) <= set(r.spans.split(",")) for w in want)
    spans = {r.doc_id: r.spans for r in found}
    for d, (text, body) in planted.items():
        assert f":{text.index(body)}:{text.index(body) + len(body)}" in spans[d], (d, spans[d])
    assert not [spans[d] for d in clean if spans[d]]
    again = {r.doc_id: r.spans for r in pii.report(pii.pii_scan(table.repartition(7))).collect()}
    assert again == spans
    gone = {r.doc_id: r for r in pii.redact(table).collect()}
    assert gone[9_000_002].text == "SSN: [SSN]." and gone[9_000_002].kept == "x" and gone[1].text is None
    assert pii.pii_scan(table.limit(0)).count() == 0 and pii.redact(table.limit(0)).columns == table.columns


def test_most_made_examples_are_told_apart(corpus):
    around = sorted({(t[max(0, s - 40) : s], t[s:e], k, t[e : e + 20]) for _, t in corpus if t for s, e, k in pii.base_spans(t)})
    assert len(around) > 50
    model = pii.fit(around[::2])
    right = wrong = total = 0
    for row in around[1::2]:
        x, y = pii.examples(*row)
        if x:
            x = np.array(x, dtype=float)
            chosen = model.trees.probability(x) >= np.array(model.thresholds)[x[:, 0].astype(int)]
            right, wrong, total = right + int((chosen & y).sum()), wrong + int((chosen & ~np.array(y)).sum()), total + sum(y)
    assert right > 0.7 * total and wrong < 0.1 * (right + wrong)


def test_counted_rows_weigh_as_many_as_they_are():
    rng = np.random.default_rng(3)
    x, n = rng.integers(0, 40, (300, 4)).astype(float), rng.integers(1, 9, 300)
    y = (x[:, 0] + rng.normal(0, 9, 300) > x[:, 2]).astype(float)
    one, many = boosting.fit(x, y, n), boosting.fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and np.allclose(one.leaf, many.leaf)
    column = np.repeat(x[:, 0], n)
    shares = np.linspace(0, 1, 33)[1:-1]
    assert (boosting.quantiles(x[:, 0], n, shares) == np.unique(np.quantile(column, shares, method="lower"))).all()


def test_the_bound_is_that_of_clopper_and_pearson():
    for trials in (0, 1, 5, 29, 30, 400):
        for hits in range(0, trials + 1, 1 + trials // 60):
            assert pii.surely_below(hits, trials, 0.1, 0.05) == (upper_bound(hits, trials, 0.05) <= 0.1)
    assert pii.surely_below(99_000, 1_000_000, 0.1, 0.05) and not pii.surely_below(99_990, 1_000_000, 0.1, 0.05)


def test_trees_learn_from_all_surroundings(make):
    """More surroundings than the 2000 that were drawn before: each makes its examples, and copies make none."""
    rows = [(k, f"item {k * 7919 % 100_003} mail to user{k}@host{k % 91}.example.org, thanks {k}") for k in range(2600)]
    scanned = pii._scanned(make(rows + rows[:50]))
    model = pii.learned(scanned, 0.1)
    around = {(t[max(0, s - 40) : s], t[s:e], k, t[e : e + 20]) for _, t in rows for s, e, k in pii.base_spans(t) if e - s <= 80}
    assert len(around) >= 2600
    want = pii.fit(sorted(around))
    assert model.thresholds == want.thresholds
    assert all((getattr(model.trees, c) == getattr(want.trees, c)).all() for c in ("feature", "cut", "leaf"))
