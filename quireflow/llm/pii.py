"""Personal data: fixed patterns, and boosted trees that choose among overlapping proposals.

Generators with high recall propose spans that the fixed patterns miss: addresses written with "(at)", telephone numbers without a plus, card
numbers beside other digits, IPv6 addresses, social security numbers and IBANs. Proposals may overlap. Each is described by its format
(lengths, groups, separators, check digits) and its context (neighbouring characters, cue words before it). Boosted trees give
it a probability, and a threshold for each kind selects.

There are no labelled spans, so the training examples are made: what the fixed patterns verify is taken with its
surroundings out of the corpus, written in other ways (the generator should find exactly that span), or replaced with things that
only look alike, such as dates, prices, versions and article numbers. The trees learn on three quarters of these surroundings, and on
the last quarter the lowest threshold is chosen whose false share, by an exact binomial bound, stays below ``false_share``. A kind for which there is
no such threshold selects nothing. Surroundings are all distinct ones of the whole corpus, so neither copies of a document nor the
layout of the table matter; a few written-out ones are always among them.

Of selected spans that overlap, the most probable stays (ties: the earlier, then the longer, then the kind as listed).
A proposal that touches a span of the fixed patterns is dropped.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; repeated rows are scanned
one by one; very long texts are scanned whole in linear time; other columns are not looked at (``redact`` hands them on). An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import boosting
from quireflow.llm.common import map_rows, settle

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
Span = tuple[int, int, str]

# ------------------------------------------------------------------ fixed patterns

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def digits_of(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    doubled = sum(v * 2 - 9 * (v > 4) for v in values[1::2])
    return (sum(values[::2]) + doubled) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def mod97(text: str) -> bool:
    compact = text.replace(" ", "")
    value = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
    return int(value) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost addresses: the run of local characters before an at sign, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            done = found.end()
        else:
            # What stands before this sign can belong to no later address.
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then by kind as listed."""
    spans = list(emails(text))
    spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# ------------------------------------------------------------------ proposals

_AT, _DOT = r" ?(?:@|[(\[{]at[)\]}]) ?", r"(?:\.| ?[(\[{]dot[)\]}] ?)"
_NAME, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
#: Each is tried at every place, so that proposals may overlap.
GENERATORS = [
    (kind, re.compile(f"(?=({pattern}))", flags))
    for kind, pattern, flags in (
        ("email", f"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,5}}", re.I),
        ("email", f"{_NAME} at {_LABEL}(?: dot {_LABEL}){{1,5}}(?![A-Za-z0-9])", re.I),
        ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])", 0),
        ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])", 0),
        ("card", r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])", 0),
        ("card", r"(?<![0-9A-Za-z])[0-9]{4}[ .-]?[0-9]{4,6}[ .-]?[0-9]{4,5}(?:[ .-]?[0-9]{3,4})?(?![0-9A-Za-z])", 0),
        ("phone", r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])", 0),
        ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])", 0),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0),
    )
]
#: What every generator's spans hold.
NUMBERS, SIGNS = re.compile(r"[0-9]"), re.compile(r"@|[(\[{]at[)\]}]| at .{1,64} dot ", re.I)


def proposals(text: str, taken: list[Span] = ()) -> list[Span]:
    """Spans that the generators propose, none of which touches ``taken``."""
    numbers, signs = NUMBERS.search(text), SIGNS.search(text)
    found: dict[Span, None] = {}
    for kind, pattern in GENERATORS:
        if signs if kind == "email" else numbers:
            for m in pattern.finditer(text):
                if kind != "phone" or 7 <= len(digits_of(m[1])) <= 15:
                    found[m.start(1), m.end(1), kind] = None
    out, blocks, k = [], sorted((s, e) for s, e, _ in taken), 0
    reach: list[int] = []
    for s, e in blocks:
        reach.append(max(e, reach[-1] if reach else 0))
    for span in sorted(found):
        while k < len(blocks) and reach[k] <= span[0]:
            k += 1
        if k == len(blocks) or blocks[k][0] >= span[1]:
            out.append(span)
    return out


CUES = (
    re.compile(r"(?:e-?mail|mail|contact|write)\W*$", re.I),
    re.compile(r"(?:phone|tel|telefon|t[eé]l[eé]fono?|call|mobile|fax|cell)\W*$", re.I),
    re.compile(r"(?:card|visa|mastercard|amex|credit|cc)\W*(?:no|number|nr)?\W*$", re.I),
    re.compile(r"(?:ssn|social security|national id|id number)\W*(?:no|number)?\W*$", re.I),
    re.compile(r"(?:iban|account|konto)\W*(?:no|number)?\W*$", re.I),
    re.compile(r"(?:\bip|host|server|address)\W*$", re.I),
    re.compile(r"(?:version|v|page|date|on|total|order|isbn|price|issue|build|year|ref|no|id|at|from|code)\W*$", re.I),
)
DATE = re.compile(r"(?:[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{2,4})$")


def _kind_of(char: str) -> int:
    if not char or char.isspace():
        return 0
    return 3 if char.isdigit() else 2 if char.isalpha() else 4 if char in "$€£%#=" else 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    start, end, kind = span
    body, digits = text[start:end], digits_of(text[start:end])
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    before = text[max(0, start - 28) : start]
    compact = body.replace(" ", "")
    return [
        KINDS.index(kind), len(body), len(digits), sum(c.isalpha() for c in body), len(groups), max(groups), min(groups), groups[0], groups[-1],
        body.count(" "), body.count("-"), body.count("."), body.count("/"), body.count(":"), body.startswith("+"), body.startswith("00"), "(" in body,
        len(set(digits)), 12 <= len(digits) <= 19 and luhn(digits), kind == "iban" and mod97(compact), kind == "ip" and "." in body and octets(body),
        bool(DATE.match(body)), digits[:1] == "0", "@" in body, len(re.split(r"[.)\]} ]+", body)[-1]), _kind_of(text[start - 1 : start]), _kind_of(text[end : end + 1]),
        _kind_of(text[end + 1 : end + 2]), *[bool(c.search(before)) for c in CUES],
    ]


# ------------------------------------------------------------------ training examples

#: Surroundings that are always trained on: left, a verified span, its kind, right.
WRITTEN_OUT = [
    (left, span, kind, right)
    for left, right in (("", ""), ("Please see ", " for more."), ("\n", "\n"), ("and so it was (", "), as before"), ("... ", ", "))
    for kind, span in (("email", "jo.doe@mail.example.org"), ("phone", "+1 (212) 555-0147"), ("card", "4111111111111111"), ("ip", "192.0.2.17"))
]
#: Times that each of those is trained on, with other texts.
COPIES = 32
#: Texts made from one surrounding with personal data, and as many with what only looks alike.
VERSIONS = 4
#: Words that may stand before a span of the kind, and before what only looks alike.
BEFORE = {
    "email": ("Email: ", "mail ", "contact "), "phone": ("Phone: ", "Tel. ", "call "), "card": ("card ", "Visa: ", "credit card no "),
    "ip": ("IP ", "host ", "server "), "ssn": ("SSN ", "SSN: ", "social security number "), "iban": ("IBAN ", "IBAN: ", "account "),
}
BEFORE_OTHERS = ("version ", "page ", "Date: ", "total ", "order ", "ISBN ", "price ", "build ", "ref ", "no. ")


def rewritten(kind: str, span: str, draw: random.Random) -> tuple[str, str]:
    """Another way to write the span, or data of a kind that no fixed pattern finds, and which kind that is."""
    kind = draw.choice([kind, kind, "ssn", "iban"])
    digits = digits_of(span)
    number = lambda n: "".join(draw.choices("0123456789", k=n))
    if kind == "email":
        local, domain = span.split("@", 1)
        at, dot = draw.choice([("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "."), (" @ ", ".")])
        return local + at + domain.replace(".", dot), "email"
    if kind == "phone":
        a, b, c = digits[-10:-7] or "212", digits[-7:-4], digits[-4:]
        sep = draw.choice("- .")
        lead = draw.choice(["", "", "1" + sep, "+1 ", "001 "])
        return draw.choice([f"{lead}{a}{sep}{b}{sep}{c}", f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{lead}({a}) {b}-{c}", f"0{a[:2]} {b}{c}", f"+49 {a} {b}{c}", f"00{a[:2]} {b} {c}"]), "phone"
    if kind == "ip":
        return (":".join(f"{draw.randrange(65536):x}" for _ in range(8)) if draw.random() < 0.6 else span), "ip"
    if kind == "ssn":
        return f"{draw.randrange(1, 773):03}-{draw.randrange(1, 100):02}-{draw.randrange(1, 10000):04}", "ssn"
    if kind == "iban":
        country, account = draw.choice(["DE", "GB", "FR", "ES", "NL"]), number(draw.randrange(12, 21))
        check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        flat = f"{country}{check:02}{account}"
        return (" ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if draw.random() < 0.5 else flat), "iban"
    sep = draw.choice(["", "", " ", "-"])
    return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), "card"


def lookalike(draw: random.Random) -> str:
    """Something that is no personal data but has digits or signs like it."""
    n = lambda k: draw.randrange(10 ** (k - 1), 10**k)
    wrong = str(n(16))
    if luhn(wrong):
        wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    return draw.choice([
        f"{draw.randrange(1900, 2100)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}", f"{draw.randrange(1, 29)}.{draw.randrange(1, 13)}.{draw.randrange(1900, 2100)}",
        f"{draw.randrange(24):02}:{draw.randrange(60):02}:{draw.randrange(60):02}", f"{draw.randrange(20)}.{draw.randrange(20)}.{draw.randrange(99)}",
        f"{n(1)},{n(3)},{n(3)}.{n(2)}", f"{n(3)}.{n(3)}.{n(3)},{n(2)}", str(n(draw.randrange(5, 12))), f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", wrong,
        " ".join(wrong[i : i + 4] for i in range(0, 16, 4)), f"{n(3)}.{n(3)}.{draw.randrange(256, 999)}.{n(2)}", f"{draw.randrange(1900, 2000)}-{draw.randrange(2000, 2100)}",
        f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{n(1)}.{n(7)}", f"{n(3)} {n(3)} {n(3)} {n(3)}", f"{n(4)}-{n(4)}", f"{draw.randrange(1900, 2100)}{draw.randrange(1, 13):02}{draw.randrange(1, 29):02}",
        "user@host", "we met at noon dot that was it", f"{n(2)}/{n(2)}/{n(4)}", f"{n(3)} {n(4)} {n(2)} {n(5)}", f"AB{n(2)} {n(4)} {n(4)} {n(4)}", f"{n(3)}-{n(4)}-{n(2)}",
    ])


def examples(left: str, span: str, kind: str, right: str, copy: int = 0) -> tuple[list[list[float]], list[bool]]:
    """Features and labels of the proposals in texts made from one surrounding; another copy makes other texts."""
    draw = random.Random(zlib.crc32(f"{copy}|{left}|{span}|{right}".encode()))
    x, y = [], []
    for good in (True, False) * VERSIONS:
        body, its_kind = rewritten(kind, span, draw) if good else (lookalike(draw), "")
        cue = draw.choice(BEFORE[its_kind] if good else BEFORE_OTHERS) if draw.random() < 0.4 else ""
        head = left + cue
        text = head + body + right
        for found in proposals(text):
            # What else stands in the surroundings is not labelled.
            if found[0] < len(head) + len(body) and found[1] > len(head):
                x.append(features(text, found))
                y.append(good and found == (len(head), len(head) + len(body), its_kind))
    return x, y


@dataclass(frozen=True)
class Model:
    trees: boosting.Boosted
    thresholds: tuple[float, ...]

    def select(self, found: list[Span], x: np.ndarray) -> list[Span]:
        """Selected spans that do not overlap, by start."""
        if not found:
            return []
        chance = self.trees.probability(x)
        ranked = sorted((-p, s, s - e, KINDS.index(k), e) for p, (s, e, k) in zip(chance.tolist(), found, strict=True) if p >= self.thresholds[KINDS.index(k)])
        return clear_of_each_other([(s, e, KINDS[k]) for _, s, _, k, e in ranked])


def clear_of_each_other(ranked: list[Span]) -> list[Span]:
    """The spans that overlap no earlier one of the list, by start."""
    import bisect

    starts: list[int] = []
    kept: list[Span] = []
    for span in ranked:
        k = bisect.bisect_left(starts, span[0])
        if (k == 0 or kept[k - 1][1] <= span[0]) and (k == len(kept) or kept[k][0] >= span[1]):
            starts.insert(k, span[0])
            kept.insert(k, span)
    return kept


def surely_below(hits: int, trials: int, rate: float, error: float) -> bool:
    """Whether the upper Clopper-Pearson bound is at most ``rate``: ``hits`` or fewer of ``trials`` have probability ``error`` at most there."""
    if hits >= trials * rate:
        return False
    log = math.lgamma(trials + 1) - math.lgamma(hits + 1) - math.lgamma(trials - hits + 1) + hits * math.log(rate) + (trials - hits) * math.log1p(-rate)
    term = total = 1.0
    for k in range(hits, 0, -1):
        term *= k * (1 - rate) / ((trials - k + 1) * rate)
        total += term
        if term < 1e-17 * total:
            break
    return log + math.log(total) <= math.log(error)


Example = tuple[tuple[float, ...], bool, bool]


def labelled(rows: Iterable[tuple[str, str, str, str]], copy: int = 0) -> Iterator[Example]:
    """Features, label and whether it is held out, of every example made from the surroundings."""
    for row in rows:
        held = zlib.crc32(f"{copy}|{row}".encode()) % 4 == 0
        for x, y in zip(*examples(*row, copy), strict=True):
            yield tuple(map(float, x)), bool(y), held


def fit(surroundings: Iterable[tuple[str, str, str, str]], false_share: float = 0.1, error: float = 0.05) -> Model:
    return fit_counted(Counter(labelled(surroundings)), false_share, error)


def fit_counted(counts: Counter[Example], false_share: float = 0.1, error: float = 0.05) -> Model:
    """Trees learned on three quarters of the surroundings, thresholds chosen on the last.

    ``counts`` says how often each distinct example occurs, so the work goes by the distinct ones, and every one counts as often as it occurs.
    """
    counts = counts.copy()
    for copy in range(COPIES):
        counts.update(labelled(WRITTEN_OUT, copy))
    told: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for held in (True, False):
        mine = sorted((x, y, n) for (x, y, h), n in counts.items() if h == held)
        told[held] = np.array([m[0] for m in mine], dtype=np.float64), np.array([m[1] for m in mine]), np.array([m[2] for m in mine])
    x, y, n = told[False]
    trees = boosting.fit(x, y.astype(np.float64), n)
    test, right, times = told[True]
    chance = trees.probability(test)
    thresholds = []
    for kind in range(len(KINDS)):
        mine = np.flatnonzero(test[:, 0] == kind)
        mine = mine[np.argsort(-chance[mine], kind="stable")]
        ranked, wrong, all_ = chance[mine], np.cumsum(~right[mine] * times[mine]), np.cumsum(times[mine])
        lowest = 2.0
        for i in range(len(mine) - 1, -1, -1):
            whole = i + 1 == len(mine) or ranked[i + 1] < ranked[i]
            if whole and ranked[i] >= 0.5 and surely_below(int(wrong[i]), int(all_[i]), false_share, error):
                # No held-out proposal lies between this one and the next, so the middle is as well certified.
                lowest = max(0.5, float(ranked[i] + (ranked[i + 1] if i + 1 < len(mine) else 0.0)) / 2)
                break
        thresholds.append(lowest)
    return Model(trees, tuple(thresholds))


# ------------------------------------------------------------------ over a table

SCANNED = (
    "doc_id long, base array<struct<start:int,end:int,kind:int>>, found array<struct<start:int,end:int,kind:int>>, "
    "described array<float>, around array<struct<left:string,span:string,kind:string,right:string>>"
)
SPANS = "doc_id long, spans array<struct<start:int,rank:int,end:int,kind:string>>, base array<struct<start:int,rank:int,end:int,kind:string>>"


def _structs(spans: list[Span]) -> list[dict]:
    return [{"start": s, "end": e, "kind": KINDS.index(k)} for s, e, k in spans]


def _scan(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("base", "found", "described", "around")}
        for text in batch["text"]:
            text = text or ""
            base = base_spans(text)
            found = proposals(text, base)
            out["base"].append(_structs(base))
            out["found"].append(_structs(found))
            out["described"].append([float(v) for span in found for v in features(text, span)])
            out["around"].append([{"left": text[max(0, s - 40) : s], "span": text[s:e], "kind": k, "right": text[e : e + 20]} for s, e, k in base if e - s <= 80])
        yield {"doc_id": batch["doc_id"]} | out


def _labelled(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        made = list(labelled(zip(batch["left"], batch["span"], batch["kind"], batch["right"], strict=True)))
        yield {"x": [m[0] for m in made], "y": [m[1] for m in made], "held": [m[2] for m in made]}


def learned(scanned: DataFrame, false_share: float) -> Model:
    """A model of all distinct surroundings of verified spans.

    The examples made from them are counted by a shuffle. Their features are small numbers, so that most examples are alike
    (65,421 of 51,282 documents are 4,147 distinct ones); the trees are fitted in one task on the distinct ones and their counts.
    """
    around = scanned.select(F.explode("around").alias("a")).select("a.*").distinct()
    spans = scanned.agg(F.coalesce(F.sum(F.size("around")), F.lit(0))).first()[0]
    parts = max(scanned.sparkSession.sparkContext.defaultParallelism, spans // 10_000)
    made = map_rows(around.repartition(parts, "left", "span", "kind", "right"), "x array<float>, y boolean, held boolean", _labelled)
    counted = made.groupBy("x", "y", "held").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter({(tuple(x), y, held): n for b in batches for x, y, held, n in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_counted(counts, false_share))], pa.binary())], names=["model"])

    rows = counted.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(rows[0].model)) if rows else fit([], false_share)


def _scanned(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(map_rows(rows, SCANNED, _scan), "pii-scanned")


def pii_scan(docs: DataFrame, false_share: float = 0.1) -> DataFrame:
    """doc_id, all ``spans`` and the ``base`` ones of each row, by start, then by kind as in KINDS.

    The trees are fitted on all distinct surroundings of verified spans; patterns, proposals and selection cover all texts.
    """
    scanned = _scanned(docs)
    model = learned(scanned, false_share)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            spans, bases = [], []
            for base, found, described in zip(batch["base"], batch["found"], batch["described"], strict=True):
                proposed = [(f["start"], f["end"], KINDS[f["kind"]]) for f in found]
                added = model.select(proposed, np.array(described, dtype=np.float64).reshape(len(proposed), -1)) if proposed else []
                known = [(b["start"], b["end"], KINDS[b["kind"]]) for b in base]
                told = lambda all_spans: [
                    {"start": s, "rank": r, "end": e, "kind": KINDS[r]} for s, r, e in sorted((s, KINDS.index(k), e) for s, e, k in all_spans)
                ]
                spans.append(told(known + added))
                bases.append(told(known))
            yield {"doc_id": batch["doc_id"], "spans": spans, "base": bases}

    return map_rows(scanned.select("doc_id", "base", "found", "described"), SPANS, run)


def redact(docs: DataFrame, false_share: float = 0.1) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, as ``[EMAIL]``; overlapping spans become one mark.

    Texts without spans, null texts and other columns stay as they are.
    """
    model = learned(_scanned(docs), false_share)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield batch | {"text": [redacted(text, model) if text else text for text in batch["text"]]}

    return map_rows(docs, docs.schema, run)


def redacted(text: str, model: Model) -> str:
    base = base_spans(text)
    found = proposals(text, base)
    spans = base + (model.select(found, np.array([features(text, s) for s in found], dtype=np.float32).astype(np.float64)) if found else [])
    parts, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def report(scans: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scans.select("doc_id", *map(count, KINDS[:4]), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
