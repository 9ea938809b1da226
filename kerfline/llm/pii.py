r"""Personal data: fixed patterns, and boosted trees over further candidates.

Base spans come from four fixed patterns and always stay. Beside them, generators of high recall propose spans
that may overlap: digit groups with separators, spelled-out mail addresses, account numbers. Gradient boosted trees
score each by features of its form and of the words around it; scores are calibrated by isotonic regression on
examples not trained on, on which also each kind gets its own threshold: the least probability from which on the share of personal spans is at least
``precision``. What reaches its kind's threshold is selected, best first, without overlap among themselves or with a base span.

There is no labelled table of personal data. The trees learn from examples that ``examples`` makes by rule: numbers
and addresses of known kind set among words that speak for or against personal data.

Spans count code points, end exclusive. Defined results: a null text counts as empty and has no spans; rows that
repeat an id are scanned each for itself; texts may be of any length; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("m_number", "m_mail", "m_account")
KINDS = BASE + MORE

# Fixed values of the contract, with possessive runs where giving back cannot help.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Generators.
NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,17}(?![0-9])")
MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
MAIL_AT = re.compile(r"[\[(] ?at| at ", re.IGNORECASE | re.ASCII)  # what every match of MAIL holds
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# Words of context that the features count.
FOR = ("phone", "tel", "call", "mobile", "cell", "fax", "ssn", "social security", "iban", "account", "mail", "contact", "reach", "write to", "whatsapp", "telefon", "mobil", "anruf", "appel", "llam")
AGAINST = ("order", "invoice", "isbn", "version", "page", "date", "year", "build", "serial", "part no", "revision", "figure", "section", "total", "price")
PRECISION = 0.95
REACH = 32  # characters of context on either side


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the mail pattern, found from each ``@``, in linear time."""
    at, stop = text.find("@"), 0
    while at >= 0:
        start = at
        while start > stop and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            stop = found.end()
            yield start, stop
        at = text.find("@", max(at + 1, stop))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if max(int(p) if len(p) < 9 else 999 for p in (x.lstrip("0") or "0" for x in m.group().split("."))) <= 255]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` that the generators propose; they may overlap."""
    out: list[tuple[int, int, int]] = []
    if DIGIT.search(text):
        out += [(4, *m.span()) for m in NUMBER.finditer(text)]
        out += [(6, *m.span()) for m in ACCOUNT.finditer(text)]
    if MAIL_AT.search(text):
        out += [(5, *m.span()) for m in MAIL.finditer(text)]
    return out


FEATURES = 20


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    body = text[start:end]
    digits = "".join(c for c in body if c in "0123456789")
    groups = re.findall("[0-9]+", body)
    before, after = text[max(0, start - REACH) : start].lower(), text[end : end + REACH].lower()
    lengths = [len(g) for g in groups] or [0]
    shape = "-".join(map(str, lengths))
    return [
        kind == 4, kind == 5, kind == 6, len(body), len(digits), len(groups), max(lengths), min(lengths),
        body.count("-"), body.count(" "), body.count("."), body.count("("),
        shape in ("3-3-4", "3-2-4", "3-4", "1-3-3-4", "2-4-4", "2-3-4", "4-3-3", "4-6"), shape in ("4-2-2", "2-2-4", "4-2-2-2-2", "8"),
        luhn(digits) if digits else 0, (before[-1:].isalnum() or after[:1].isalnum()),
        sum(w in before for w in FOR), sum(w in before for w in AGAINST), sum(w in after for w in FOR), sum(w in after for w in AGAINST),
    ]


@dataclass
class Trees:
    """Gradient boosting of log loss with trees of fixed depth over quantile bins, calibrated by isotonic regression."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    trees: list = field(default_factory=list)
    prior: float = 0.0
    edges: np.ndarray | None = None
    steps: np.ndarray | None = None
    levels: np.ndarray | None = None
    cuts: dict[int, float] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
        """Rows where ``held`` is true calibrate, the others train."""
        a, b = x[~held], y[~held].astype("f8")
        self.prior = float(np.log(b.mean() / (1 - b.mean())))
        cuts = [np.unique(np.quantile(a[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(a.shape[1])]
        raw = np.full(len(b), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(a, b - p, p * (1 - p), np.arange(len(b)), cuts, self.depth)
            self.trees.append(tree)
            raw += self._walk(tree, a)
        self._calibrate(self.raw(x[held]), y[held].astype("f8"))
        return self

    def _grow(self, x, g, h, rows, cuts, depth):
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        if depth and len(rows) >= 20:
            base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for j, edge in enumerate(cuts):
                at = np.searchsorted(edge, x[rows, j], "right")
                gs, hs = np.cumsum(np.bincount(at, g[rows], len(edge) + 1))[:-1], np.cumsum(np.bincount(at, h[rows], len(edge) + 1))[:-1]
                if not len(gs):
                    continue
                gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - base
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, edge[i])
        if best[1] is None:
            return value
        left = x[rows, best[1]] < best[2]
        return best[1], best[2], *(self._grow(x, g, h, rows[s], cuts, depth - 1) for s in (left, ~left))

    def _walk(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] < tree[1]
        out = np.empty(len(x))
        for side, part in ((left, tree[2]), (~left, tree[3])):
            if side.any():
                out[side] = self._walk(part, x[side])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # pool adjacent violators: [sum, count, least score]
        for s, v in zip(raw[order], y[order], strict=True):
            blocks.append([v, 1, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                v2, n2, _ = blocks.pop()
                blocks[-1][0] += v2
                blocks[-1][1] += n2
        self.steps = np.array([b[2] for b in blocks])
        self.levels = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])  # shrunk, so small blocks are not certain

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.steps, self.raw(x), "right") - 1
        return np.where(at < 0, self.levels[0], self.levels[np.maximum(at, 0)])


def examples(n: int = 4000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of made-up candidates."""
    rng = np.random.default_rng(seed)
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda items: items[int(rng.integers(len(items)))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    personal = (
        lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}",
        lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"0{number(3)} {number(6)}",
    )
    spelled = (lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}.{word()} (at) {word()}.org", lambda: f"{word()} at {word()} dot net")
    account = (lambda: f"{pick(('DE', 'FR', 'ES', 'GB'))}{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}", lambda: f"DE{number(20)}")
    other = (
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: number(int(rng.integers(7, 18))),
        lambda: f"{number(3)} {number(3)} {number(3)}", lambda: f"{number(1)}.{number(2)}.{number(4)}", lambda: f"{number(4)}-{number(4)}-{number(4)}",
        lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"{number(4)} {number(4)} {number(3)}",
    )
    x, y = [], []
    while len(y) < n:
        mine = bool(rng.random() < 0.5)
        body = (pick((*personal, *personal, *spelled, *account)) if mine else pick((*other, *personal)))()
        cue = f"{pick(FOR)} {pick(('', 'is ', ': ', 'me on ', 'number '))}" if mine else pick(("", "", f"{pick(AGAINST)} ", f"{pick(AGAINST)} {pick(('no ', 'number ', ': '))}"))
        text = f"{word()} {word()} {cue.strip()} {body}{pick(('.', ',', ' ', ''))} {word()} {word()}"
        for kind, s, e in candidates(text):
            if text[s:e].strip() and s < text.index(body) + len(body) and e > text.index(body):
                x.append(features(text, kind, s, e))
                y.append(mine)
    return np.array(x, "f8"), np.array(y)


def train(n: int = 4000, seed: int = 3, precision: float = PRECISION) -> Trees:
    x, y = examples(n, seed)
    held = np.arange(len(y)) % 3 == 0
    model = Trees().fit(x, y, held)
    p = model.probability(x[held])
    for kind in range(len(BASE), len(KINDS)):
        own = x[held][:, kind - len(BASE)] > 0
        level, hits = p[own], y[held][own]
        order = np.argsort(-level, kind="stable")
        share = np.cumsum(hits[order]) / np.arange(1, len(order) + 1)
        last = np.append(np.diff(level[order]) != 0, True)  # of equal probabilities all or none
        good = np.flatnonzero(last & (share >= precision))
        model.cuts[kind] = float(level[order][good[-1]]) if len(good) else 2.0
    return model


class Spans:
    """A set of stretches of text; those that meet are one."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        """Of a stretch that meets none."""
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def select(text: str, base: list[tuple[int, int, int]], model: Trees) -> list[tuple[int, int, int]]:
    """Spans that the model adds."""
    taken = Spans((s, e) for _, s, e in base)
    free = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
    if not free:
        return []
    p = model.probability(np.array([features(text, *c) for c in free], "f8"))
    chosen: list[tuple[int, int, int]] = []
    for i in np.lexsort(([c[1] for c in free], -p)):
        if p[i] >= model.cuts[free[i][0]] and not taken.meets(free[i][1], free[i][2]):
            taken.add(free[i][1], free[i][2])
            chosen.append(free[i])
    return sorted(chosen)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, precision: float = PRECISION, redacted: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_<base kinds>, base_sha256, spans``, and the redacted text if asked for."""
    model = train(precision=precision)
    schema = docs.select("doc_id").schema
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    if redacted:
        schema = schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = base + select(text, base, model)
                counts = [0] * len(BASE)
                for k, _, _ in base:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), *([redact(text, spans)] if redacted else [])))
            types = [pa.int64()] * len(BASE) + [pa.string()] * (2 + redacted)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
