"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

The base kinds email, ip, card and phone are found by fixed patterns and checks,
leftmost and non-overlapping in each kind; a match that fails its check is dropped
and not tried again. Those spans always stay.

Beyond them, generators propose spans that may overlap: phone numbers without a
plus, emails written out ("name at host dot com"), national identity numbers,
IBANs, cards with odd separators, and credentials (keys, tokens, passwords). A gradient-boosted ensemble of regression
trees scores each by its format (lengths, digits, separators, checksums) and its context
(cue words before it, characters around it). It is trained here, on texts that a seeded
generator composes with known spans. Each kind has a threshold of its own: the smallest
whose precision on composed candidates of that kind that training has not seen is at least
``precision``, and a half at least.
Spans that pass and overlap no base span are added, best first where they overlap
one another.

Null and empty texts have no spans. Texts are scanned whole. The runs of digits or
of address characters that a text holds are each read once, and spans are kept in order, so
time grows with the text and the logarithm of its candidates.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, id_and_text

KINDS = ("email", "ip", "card", "phone", "national_id", "iban", "secret")
_BASE = KINDS[:4]
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans, by start and then by kind in the order of KINDS."""
    out = _emails(text) if "@" in text else []
    if _HAS_DIGIT(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_HAS_DIGIT = re.compile("[0-9]").search

# -- candidates -------------------------------------------------------------------
#: Kind and pattern; they may overlap, and most of what they propose is not personal.
GENERATORS: list[tuple[str, re.Pattern]] = [
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,6}){1,4}(?![0-9A-Za-z])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}[\x20]?(?:\[at\]|\(at\)|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\[dot\]|\(dot\)|[\x20]dot[\x20]|\.)[\x20]?[A-Za-z]{2,24}){1,3}(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[0-9A-Z]{4}){3,7}(?:[\x20]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[.\x20/_-]{1,2}[0-9]{4}){2,3}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,128}(?![A-Za-z0-9_+/-])")),
    # of a named value the value alone is the span
    ("secret", re.compile(r"(?i)(?:passw(?:or)?d|passwort|pwd|secret|token|key)[\x20]?[:=][\x20]?[\"']?([^\s\"']{6,128})")),
]
CUES = [
    re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp)\b"),
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b"),
    re.compile(r"(?i)\b(?:ssn|social security|national id|identity|dni|insurance number|personalausweis)\b"),
    re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|credit|debit|kreditkarte|tarjeta|carte)\b"),
    re.compile(r"(?i)(?:passw(?:or)?d|passwort|pwd|secret|token|key|credentials?)[\x20]?[:=]?[\x20]?[\"']?\Z"),
    re.compile(r"(?i)\b(?:version|order|invoice|ref|isbn|part|serial|page|pages|chapter|section|years?|date|total|price|lot|look|meet|room)\b"),
]


def _mod97(s: str) -> bool:
    s = re.sub(r"\s", "", s)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall("[0-9]+", s)
    year = any(1900 <= int(g) <= 2099 for g in groups if len(g) == 4)
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), s.count("-"), s.count("."), s.count(" "), s.count("/"), float("(" in s),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(kind == "iban" and _mod97(s)), float(year), float(len(set(digits)) <= 2), float(digits[:1] == "0"),
        sum(map(str.isupper, s)), sum(map(str.islower, s)), len(set(s)), sum(a.isdigit() != b.isdigit() for a, b in itertools.pairwise(s)),
        *(float(bool(c.search(before))) for c in CUES), float(before[-1:] in "#$€£" and before[-1:] != ""), float(before[-2:] == ": "), float(after[:1] in "%€$°" and after[:1] != ""), float("dot" in s or "." in s),
    ]


def candidates(text: str) -> list[Span]:
    numeric = _HAS_DIGIT(text) is not None
    out = []
    for kind, pattern in GENERATORS:
        if kind == "email":
            # the pattern needs one of these, so many texts need no scan
            if " at " in text or "[at]" in text or "(at)" in text:
                out += [(kind, *m.span()) for m in pattern.finditer(text)]
        elif kind == "secret" and not pattern.groups:
            if numeric:  # a long word without a digit is no key
                out += [(kind, *m.span()) for m in pattern.finditer(text) if _HAS_DIGIT(m[0])]
        elif kind == "secret":
            if ":" in text or "=" in text:
                out += [(kind, *m.span(1)) for m in pattern.finditer(text)]
        elif numeric:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return list(dict.fromkeys(out))


# -- boosted trees ------------------------------------------------------------------
class Trees:
    """Gradient boosting of depth-limited regression trees on the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.trees: list[list] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        z = np.full(len(y), self.base)
        cuts = [np.unique(c)[:-1] for c in x.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            z += self.rate * np.array([self._leaf(tree, row) for row in x])
        return self

    def _grow(self, x, g, h, rows, cuts, depth):
        gain_of = lambda a, b: a * a / (b + self.ridge)
        total = gain_of(g[rows].sum(), h[rows].sum())
        best = (1e-6, None, None)
        for j, values in enumerate(cuts if depth and len(rows) > 10 else []):
            for v in values[:: max(1, len(values) // 32)]:
                left = x[rows, j] <= v
                if left.any() and not left.all():
                    a, b = rows[left], rows[~left]
                    gain = gain_of(g[a].sum(), h[a].sum()) + gain_of(g[b].sum(), h[b].sum()) - total
                    if gain > best[0]:
                        best = (gain, j, float(v))
        if best[1] is None:
            return float(g[rows].sum() / (h[rows].sum() + self.ridge))
        left = x[rows, best[1]] <= best[2]
        return [best[1], best[2], self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1)]

    @staticmethod
    def _leaf(tree, row) -> float:
        while isinstance(tree, list):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def probability(self, row: list[float]) -> float:
        z = self.base + self.rate * sum(self._leaf(t, row) for t in self.trees)
        return float(1 / (1 + np.exp(-z)))


def compose(n: int, seed: int) -> list[tuple[str, str, int, int, bool]]:
    """Kind, text, start, end and truth of n composed candidates."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdeghilmnorstuv") for _ in range(r.randint(2, 9)))

    def card(sep: str) -> str:
        body = r.choice("3456") + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(full[k : k + 4] for k in range(0, 16, 4))

    def iban() -> str:
        country, rest = r.choice(["DE", "FR", "ES", "GB", "NL"]), d(18)
        check = 98 - int(rest + "".join(str(int(c, 36)) for c in country) + "00") % 97
        s = f"{country}{check:02d}{rest}"
        return s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def secret() -> str:
        mixed = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
        upper, lower, hexadecimal = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
        return r.choice([mixed(upper, 4) + mixed(upper, r.randint(12, 20)), mixed(lower, 2) + "_" + mixed(upper + lower, r.randint(20, 40)), mixed(hexadecimal, r.choice([16, 18, 20, 32, 40, 64])), mixed(upper + lower + "+/", r.randint(24, 64)), mixed(upper + lower, r.randint(10, 18)) + d(2)])

    def plain() -> str:  # long words that are no keys
        return r.choice(["-".join(word() for _ in range(4)) + f"-{d(2)}", "/".join(word() for _ in range(4)) + f"/{d(4)}", f"{word()}_{word()}_{word()}_{d(1)}", word() + word(), d(r.randint(16, 24)), f"{word()}{word()}{word()}{d(1)}"])

    personal = {
        "phone": (["phone: ", "call ", "tel. ", "mobile ", "Telefon ", "fax: "], lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(6)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        "email": (["email: ", "contact ", "write to ", "mail ", "reach me: "], lambda: word() + r.choice([" at ", "[at]", " (at) "]) + word() + r.choice([" dot ", "[dot]", " (dot) ", "."]) + r.choice(["com", "org", "net", "de"])),
        "national_id": (["SSN ", "social security ", "national id: ", "SSN: "], lambda: f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"),
        "iban": (["IBAN ", "account ", "bank: ", "Konto "], iban),
        "secret": (["key ", "token = ", "password=", "secret: ", "api_key: ", 'token = "', ""], secret),
        "card": (["card ", "Visa: ", "credit card no. ", "Kreditkarte "], lambda: card(r.choice([" ", "-", ".", "/", " - "]))),
    }
    other = {
        "phone": (["version ", "order ", "on date ", "pages ", "years ", "total ", "price ", "# ", "$", "section ", ""], lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{d(2)}.{d(2)}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(3)} {d(3)}", f"{d(2)}/{d(2)}/{r.randint(1950, 2030)}", f"{d(3)}-{d(2)}", f"{d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        "email": (["look ", "they meet ", "we were ", "left it ", ""], lambda: f"{word()} at {word()}.{r.choice(['then', 'it', 'so', 'the'])}"),
        "national_id": (["part ", "order ", "serial ", "ref ", "lot ", "isbn ", ""], lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        "iban": (["serial ", "part ", "ref ", "lot ", ""], lambda: "".join(r.choice("ABCDEFGH") for _ in range(2)) + d(18)),
        "secret": (["file ", "see ", "path ", "the ", "section ", "key: ", "password: ", ""], plain),
        "card": (["serial ", "part ", "order ", "invoice ", ""], lambda: r.choice(" -./").join(d(4) for _ in range(4))),
    }
    out = []
    while len(out) < n:
        truth = r.random() < 0.45
        kind = r.choice(list(personal))
        cue, make = (personal if truth else other)[kind]
        lead = " ".join(word() for _ in range(r.randint(0, 6))) + " " + r.choice(cue)
        text = f"{lead}{make()} {word()}{r.choice(['.', ',', ''])} {word()}"
        out += [(k, text, a, b, truth and k == kind and a >= len(lead)) for k, a, b in candidates(text)]
    return out[:n]


@functools.cache
def model(seed: int = 7, rows: int = 4000, precision: float = 0.99) -> tuple[Trees, dict[str, float]]:
    """The trees, and by kind the threshold that gives this precision on unseen composed texts."""
    shown = compose(rows, seed)
    trees = Trees().fit(np.array([describe(*x[:4]) for x in shown]), np.array([float(x[4]) for x in shown]))
    unseen = compose(rows, seed + 1)
    thresholds = {}
    for kind in KINDS:
        own = [x for x in unseen if x[0] == kind]
        p, y = np.array([trees.probability(describe(*x[:4])) for x in own]), np.array([x[4] for x in own], float)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        passing = np.flatnonzero((right >= precision) & np.append(np.diff(p[order]) < 0, True)) if len(own) else []
        thresholds[kind] = max(0.5, float(p[order][passing[-1]])) if len(passing) else 1.1
    return trees, thresholds


def find(text: str | None, trees: Trees, thresholds: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with what the trees add."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    # what is taken, as disjoint intervals in order
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in base:
        if starts and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    scored = [(trees.probability(describe(k, text, a, b)), k, a, b) for k, a, b in candidates(text)]
    for p, kind, start, end in sorted(scored, key=lambda x: (-x[0], x[2] - x[3], x[2], KINDS.index(x[1]))):
        if p < thresholds[kind]:
            continue
        at = bisect.bisect_right(ends, start)
        if at == len(starts) or starts[at] >= end:
            starts.insert(at, start)
            ends.insert(at, end)
            added.append((kind, start, end))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, as [KIND] of its first."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if spans else text


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans of each row and how
    many these are."""
    bounded_batches(df.sparkSession)
    trees, thresholds = model()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, trees, thresholds) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in _BASE]
            sha = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, pa.array([written(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(df, id_col, text_col).mapInArrow(scan, SCHEMA)


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df``, all rows and columns, with the spans of its texts redacted and, if it has
    the column, the length in code points renewed."""
    bounded_batches(df.sparkSession)
    trees, thresholds = model()
    names = df.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text_col)
            texts = [redact(t, find(t, trees, thresholds)[1]) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if length_col in names:
                k = names.index(length_col)
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(k).type))
            yield batch

    return df.mapInArrow(rewrite, df.schema)
