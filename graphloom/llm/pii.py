"""Personal data: overlapping candidate spans of high recall, judged by gradient-boosted trees.

Four exact kinds (email, ip, card, phone) are always kept.  Looser generators propose further spans: written
or spelt-out addresses and numbers, accounts, identity numbers, names after a title or an introduction,
streets, dates of birth, handles, hardware and long network addresses.  Boosted trees over their format and
context decide, at thresholds by kind that are calibrated on texts of another generator: other cues, other
sentences, other filler words.  Both generators are seeded, as no table labels personal data.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, table
from graphloom.llm._training import sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the trees can accept, in the order of the span list.
EXTRA = ("mail_words", "loose_phone", "account", "national_id", "iban", "number_words", "name", "street", "birth", "handle", "long_ip", "hardware")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)"
_PROPER = r"[A-ZÀ-ÖØ-Þ][\w'’-]{1,30}"
_LOOSE = {
    "mail_words": re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63} ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,12}\b", re.I),
    "loose_phone": re.compile(r"(?<![\w.+])(?!\d{1,3}(?:\.\d{1,3}){3}(?!\d))(?:\(\d{2,5}\)|\d{2,5})[ ./-]{1,2}\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w.])"),
    "account": re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){11,18}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "number_words": re.compile(rf"\b{_DIGIT_WORD}(?:[ ,-]{{1,2}}{_DIGIT_WORD}){{6,14}}\b", re.I),
    "name": re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Madame|Monsieur|Señora?|(?:[Mm]y name is|[Nn]ame:|I am called|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Ss]igned,?))\.? {{1,2}}({_PROPER}(?: {_PROPER}){{0,2}})"),
    "street": re.compile(
        rf"\b\d{{1,5}}[a-z]?,? (?:{_PROPER} ){{1,4}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Way|Court|Square)\b"
        r"|\b[A-ZÄÖÜ][\wäöüß-]{2,30}(?:straße|strasse|weg|platz|gasse|allee) \d{1,4}[a-z]?\b"
        rf"|\b\d{{1,4}},? (?:rue|avenue|boulevard|chemin|quai) (?:de |du |des |la |le )*{_PROPER}|\b(?:Calle|Avenida|Paseo|Plaza) (?:de |del |la |los )*{_PROPER},? \d{{1,4}}\b"
    ),
    "birth": re.compile(r"(?<![\w./-])(?:\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d{2}|(?:19|20)\d{2}-\d{2}-\d{2})(?![\w/-])"),
    "handle": re.compile(r"(?<![\w@.%+-])@[A-Za-z_][A-Za-z0-9_]{2,30}(?![\w@.])"),
    "long_ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "hardware": re.compile(r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"),
}
_DIGIT = re.compile("[0-9]")
_SPELT_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
_SPELT = re.compile(r" ?[\[(] ?(?:at|dot) ?[\])] ?", re.I)
_TITLED = re.compile(r"Mr|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Ma?dame|Monsieur|Señor|name|called|heiße|appelle|llamo|igned|\b(?:Calle|Avenida|Paseo|Plaza) ")
_SPELT_DIGITS = re.compile(rf"\b{_DIGIT_WORD}[ ,-]{{1,2}}{_DIGIT_WORD}\b", re.I)
#: What must be found in a text before a generator looks at it; the others need a digit.
_GATES = {"mail_words": _SPELT_AT, "name": _TITLED, "number_words": _SPELT_DIGITS, "handle": re.compile("@"), "long_ip": re.compile("(?::[0-9A-Fa-f]{1,4}){3}"), "hardware": re.compile("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]")}
#: Words that follow "at" in prose and name no host.
_FUNCTION_WORDS = frozenset("a all an any best both dawn dusk each either every first former her his it its last least most my night no noon once one our present some such that the their them these this those times us what which whom worst your".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the run of local characters before it, the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The exact spans of each kind (code points, end exclusive)."""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in _CARD.finditer(text) if 14 <= len(d := digits(m)) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 10 <= len(digits(m)) <= 15] if "+" in text else [],
    }


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Loose candidates of all generators, overlapping ones included; of a name only the name itself."""
    digits, out = bool(_DIGIT.search(text)), []
    for kind, pattern in _LOOSE.items():
        gate = _GATES.get(kind)
        if bool(gate.search(text)) if gate else digits or (kind == "street" and bool(_TITLED.search(text))):
            out += [(*m.span(1 if kind == "name" else 0), kind) for m in pattern.finditer(text)]
    return out


#: Characters of context on each side.
CONTEXT = 48
_WORD = re.compile(r"[^\W\d_]{2,}")


def context(text: str, start: int, end: int) -> list[str]:
    """The words beside a span, marked by their side."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    return [f"<{w}" for w in _WORD.findall(before.lower())[-5:]] + [f">{w}" for w in _WORD.findall(after.lower())[:3]]


@dataclass
class Evidence:
    """What the words of the context say for a kind of span: log-odds learnt from examples; unknown words say nothing.

    A word that examples of the kind don't show says what it says for all kinds; words that differ in their
    ending alone share what their first five letters say.
    """

    words: dict[tuple[str, str], float]

    @classmethod
    def learn(cls, rows: list[tuple[str, list[str], float]]) -> Evidence:
        counts: dict[tuple[str, str], list[float]] = {}
        for kind, found, y in rows:
            for w in {u for w in found for u in (w, w[:6] + "*")}:
                for of in (kind, ""):
                    counts.setdefault((of, w), [0.0, 0.0])[int(y)] += 1
        return cls({k: math.log((b + 1) / (a + 1)) for k, (a, b) in counts.items() if a + b >= 8})

    def __call__(self, kind: str, found: list[str]) -> tuple[float, float]:
        """The strongest word for and the strongest word against."""
        says = [next((self.words[of, u] for of in (kind, "") for u in (w, w[:6] + "*") if (of, u) in self.words), 0.0) for w in found]
        return max([0.0, *says]), min([0.0, *says])


def features(text: str, start: int, end: int, kind: str, evidence: Evidence) -> list[float]:
    """Format of the span and its context."""
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    groups = [len(g) for g in re.findall(r"\d+", span)]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    check = 0.0
    if kind == "iban":
        value = "".join(str(int(c, 36)) for c in span[4:] + span[:4] if c.isalnum() and c.isascii())
        check = float(int(value) % 97 == 1) if value else 0.0
    elif kind in ("account", "loose_phone"):
        check = float(luhn("".join(digits)))
    prose = kind == "mail_words" and _SPELT.split(span)[1].lower() in _FUNCTION_WORDS
    number = "".join(digits)
    clock = kind == "account" and len(number) == 13 and number[0] == "1"  # milliseconds of a clock
    book = len(number) == 13 and number[:3] in ("978", "979")
    year = next((int(g) for g in re.findall(r"\d+", span) if len(g) == 4), 0) if kind == "birth" else 0
    day = sum(0 < int(g) <= 31 for g in re.findall(r"\d+", span) if len(g) <= 2) if kind == "birth" else 0
    said, denied = evidence(kind, context(text, start, end))
    return [
        float(EXTRA.index(kind)), len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, groups[0] if groups else 0,
        span.count("."), span.count("-"), span.count(" "), span.count("/"), float("(" in span), check, float(len(set(digits)) <= 2), said, denied,
        float(before[-1:] in "#$€£=" and bool(before)), float(after[:1] in "%€$" and bool(after)), float(prose), float(clock), float(book), float(year), float(day),
        float(span.count(" ") + 1 if kind == "name" else 0), float(number[:1] == "0"), float(len(number) == 16),
    ]


class BoostedTrees:
    """Gradient boosting of small regression trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, least: int = 10) -> None:
        self.depth, self.rate = depth, rate
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list = []
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = sigmoid(score)
            tree = self._grow(x, y - p, p * (1 - p), depth, least)
            self.trees.append(tree)
            score += rate * self._apply(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int):
        value = g.sum() / (h.sum() + 1.0)
        best, found = 1e-6, None
        if depth and len(g) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for k in range(x.shape[1]):
                order = np.argsort(x[:, k], kind="stable")
                v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
                gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - whole
                ok = np.flatnonzero(v[:-1] < v[1:])
                ok = ok[(ok + 1 >= least) & (ok + 1 <= len(g) - least)]
                if len(ok) and gain[ok].max() > best:
                    at = ok[gain[ok].argmax()]
                    best, found = gain[at], (k, (v[at] + v[at + 1]) / 2)
        if found is None:
            return value
        left = x[:, found[0]] <= found[1]
        return (*found, self._grow(x[left], g[left], h[left], depth - 1, least), self._grow(x[~left], g[~left], h[~left], depth - 1, least))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._apply(tree[2], x[left]), self._apply(tree[3], x[~left])
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.start + self.rate * sum((self._apply(t, x) for t in self.trees), np.zeros(len(x))))


@dataclass(frozen=True)
class Maker:
    """What one generator of examples draws from; cues speak for a kind of span or against it."""

    letters: str
    cues: dict[str, tuple[str, ...]]
    against: tuple[str, ...]
    frames: tuple[str, ...]  # sentences: {c} the cue, {s} the span, {w} any word


_TRAIN = Maker(
    "abcdefghilmnoprstu",
    {
        "loose_phone": ("phone", "call", "tel.", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp", "ring"), "account": ("account", "card number", "konto", "compte", "cuenta", "customer number", "kundennummer", "policy"),
        "national_id": ("ssn", "social security", "id number", "passport", "ausweis", "dni"), "iban": ("iban", "bank", "konto", "transfer to"), "number_words": ("call", "phone", "dial", "reach me at"),
        "birth": ("born", "birth", "dob", "birthday", "geboren", "née le", "nacido", "né le"), "name": ("dear", "met", "contact"), "street": ("address", "lives at", "wohnt in", "adresse", "visit"), "handle": ("follow", "dm", "twitter", "instagram"),
        "long_ip": ("host", "server"), "hardware": ("device", "mac"), "mail_words": ("mail", "write"),
    },
    ("version", "order", "invoice", "page", "isbn", "serial", "part", "price", "total", "build", "chapter", "score", "sku", "table", "released", "published", "updated", "meeting", "timestamp", "epoch", "ticket", "checksum", "born to", "deadline"),
    ("{w} {w} {c} {s} {w} {w}.", "{w} {c}: {s}, {w} {w}", "{c} {s}", "{w} {w} {s} {c} {w}", "{c} is {s} {w}"),
)
#: The generator that thresholds are set on: none of its sentences, and not all of its cues, are those of the training.
_CALIBRATE = Maker(
    "bdefgjkmnoqrvwxyz",
    {
        "loose_phone": ("phone", "telephone", "cell", "call us", "hotline", "mobil", "portable", "llame"), "account": ("account no", "acct", "card", "cuenta bancaria", "member number", "kontonummer"), "national_id": ("ssn", "social", "insurance id", "passport no"),
        "iban": ("iban", "sepa", "bank details"), "number_words": ("phone", "call now", "my number"), "birth": ("born", "date of birth", "geb.", "birthdate", "nacida"), "name": ("hello", "met", "regards"), "street": ("address", "residing at", "anschrift", "home"),
        "handle": ("follow", "tweet", "profile"), "long_ip": ("server", "peer"), "hardware": ("mac", "adapter"), "mail_words": ("email", "write"),
    },
    ("version", "orders", "invoice", "pages", "serial", "parts", "price", "total", "builds", "table", "release", "published", "meeting", "timestamp", "tickets", "sku", "checksum", "batch"),
    ("{c} - {s} - {w} {w} {w}", "{w}, {c} {s}; {w}", "({c}: {s})", "{w} {w} {w} {c} = {s}\n{w}", "{w} {c} {w} {s} {w}"),
)
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "museum", "online", "product", "then", "matrix", "so")


def _spelt_out(rng: random.Random, word, positive: bool) -> str:
    """An address in words, or prose of the same form: what tells them apart is a function word where the host stands.

    Local parts, brackets, gaps, case and endings are drawn alike for both.
    """
    local = rng.choice((word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}-{word()}", f"{word()}{rng.randint(0, 99)}", rng.choice(sorted(_FUNCTION_WORDS))))
    host = rng.choice((word(), f"{word()}-{word()}", f"{word()}{rng.randint(0, 99)}")) if positive else rng.choice(sorted(_FUNCTION_WORDS))
    opened, closed = rng.choice(("[]", "()"))
    gap, inner, case = rng.choice(("", " ")), rng.choice(("", "", " ")), rng.choice((str.lower, str.upper))
    at, dot = (f"{gap}{opened}{inner}{case(w)}{inner}{closed}{gap}" for w in ("at", "dot"))
    return f"{local}{at}{host}{dot}{rng.choice(_ENDINGS)}"


def _example(rng: random.Random, maker: Maker) -> tuple[str, int, str]:
    """A made text, whether the span in it is personal data, and the span.

    Where the form alone doesn't tell, the label is that of the cue: no cue leaves a number of sixteen digits,
    a phone's usual form or a title's name personal, and a date or an unusual form not.
    """
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(maker.letters) for _ in range(rng.randint(2, 9)))
    proper = lambda: word().capitalize() + "x"
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    kind, cued = rng.choice(EXTRA), rng.choice(("for", "for", "none", "against"))
    personal, sep = cued == "for", rng.choice(" -")
    if kind == "mail_words":
        personal = rng.random() < 0.5
        span, cued = _spelt_out(rng, word, personal), rng.choice(("for", "against", "none"))
    elif kind == "loose_phone":
        usual = rng.random() < 0.6
        span = rng.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(3)} {n(3)} {n(4)}"))
        if not usual:
            span = rng.choice((f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(2)} {n(2)} {n(2)}", f"{n(5)}-{n(4)}-{n(2)}", f"{n(3)}/{n(3)}/{n(3)}"))
        personal = usual and cued != "against"
    elif kind == "account":
        form = rng.choice(("sixteen", "grouped", "other", "clock", "book"))
        span = {"sixteen": n(16), "grouped": sep.join(n(4) for _ in range(4)), "other": n(rng.choice((12, 14, 15, 17, 18, 19))), "clock": "1" + n(12), "book": rng.choice(("978", "979")) + n(10)}[form]
        personal = cued != "against" if form in ("sixteen", "grouped") else cued == "for" and form == "other"
    elif kind == "national_id":
        dashed = rng.random() < 0.6
        span = f"{n(3)}-{n(2)}-{n(4)}" if dashed else f"{n(3)} {n(2)} {n(4)}"
        personal = cued != "against" if dashed else cued == "for"
    elif kind == "iban":
        body = f"{n(4)}{n(4)}{n(4)}{n(4)}"
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        personal = rng.random() < 0.5
        span = f"DE{check:02d}{body}" if personal else f"{rng.choice(('AB', 'XK', 'QR'))}{n(2)} {n(4)} {n(4)}"
    elif kind == "number_words":
        span = " ".join(rng.choice(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")) for _ in range(rng.randint(7, 12)))
        personal = cued != "against"
    elif kind == "name":
        title = rng.choice(("Mr", "Mrs.", "Dr.", "Herr", "Frau", "Mme", "Señora", "my name is", "Je m'appelle"))
        span, personal = f"{title} {proper()}" + (f" {proper()}" if rng.random() < 0.6 else ""), True
    elif kind == "street":
        span = rng.choice((f"{n(2)} {proper()} Street", f"1{n(2)} {proper()} {proper()} Road", f"{proper()}straße {n(2)}", f"{n(2)} rue de {proper()}", f"Calle {proper()} {n(2)}"))
        personal = cued != "against"
    elif kind == "birth":
        span = rng.choice((f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/19{n(2)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(0, 25):02d}", f"19{n(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"))
    elif kind == "handle":
        span, personal = "@" + word() + rng.choice(("_", "")) + word(), True
    elif kind == "long_ip":
        span, personal = ":".join(hexes(4) for _ in range(8)), cued != "against"
    else:
        span, personal = rng.choice(":-").join(hexes(2) for _ in range(6)), cued != "against"
    cue = rng.choice(maker.cues[kind]) if cued == "for" else rng.choice(maker.against) if cued == "against" else word()
    fill = re.sub(r"\{w\}", lambda m: word(), rng.choice(maker.frames))
    return fill.replace("{c}", cue).replace("{s}", span), int(personal), span


class _Taken:
    """Disjoint spans in order, so that a text with very many of them costs little more for each."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):  # base spans of different kinds may overlap: they are merged
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take a span if it overlaps none that is taken."""
        k = bisect.bisect_right(self.starts, a)
        if (k and self.ends[k - 1] > a) or (k < len(self.starts) and self.starts[k] < b):
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


@dataclass
class Detector:
    """thresholds: least score of each kind that is accepted."""

    trees: BoostedTrees
    evidence: Evidence
    thresholds: dict[str, float]

    def spans(self, text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str]]]:
        """Base spans by kind, and all spans in order; an accepted candidate that overlaps a better span is left out."""
        base = base_spans(text)
        found = [(a, b, kind) for kind in KINDS for a, b in base[kind]]
        proposed = candidates(text)
        if proposed:
            scores = self.trees(np.array([features(text, *c, self.evidence) for c in proposed], float))
            taken = _Taken(found)
            for score, (a, b, kind) in sorted(zip(-scores, proposed, strict=True)):
                if -score >= self.thresholds[kind] and taken.add(a, b):
                    found.append((a, b, kind))
        order = (*KINDS, *EXTRA)
        return base, sorted(found, key=lambda s: (s[0], order.index(s[2]), s[1]))


def examples(maker: Maker, count: int, seed: int) -> list[tuple[str, int, int, str, int]]:
    """count judged candidates of made texts: text, start, end, kind, label; candidates that don't touch the span are no personal data."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        text, label, span = _example(rng, maker)
        at = text.find(span)
        # a candidate has the span's label if it covers most of it (a title isn't part of a name)
        out += [(text, a, b, kind, int(label and 2 * (min(b, at + len(span)) - max(a, at)) >= len(span) - 12)) for a, b, kind in candidates(text)]
    return out[:count]


@lru_cache(1)
def detector(count: int = 16000, precision: float = 0.9, seed: int = 11) -> Detector:
    """Trees fitted on made examples; for each kind the lowest threshold with that precision on the other generator's examples (1.01, which accepts nothing, if there is none)."""
    train, calibrate = examples(_TRAIN, count, seed), examples(_CALIBRATE, count // 3, seed + 1)
    # the evidence is learnt from one half and used on the other, as it will be used on texts it hasn't seen
    evidence = Evidence.learn([(k, context(t, a, b), y) for t, a, b, k, y in train[::2]])
    shape = lambda rows: (np.array([features(t, a, b, k, evidence) for t, a, b, k, _ in rows], float), np.array([y for *_, y in rows], float))
    trees = BoostedTrees(*shape(train[1::2]))
    x, y = shape(calibrate)
    scores, kinds, thresholds = trees(x), np.array([k for *_, k, _ in calibrate]), {}
    for kind in EXTRA:
        s, right = scores[kinds == kind], y[kinds == kind]
        order = np.argsort(-s, kind="stable")
        ends = np.append(s[order][1:] < s[order][:-1], True)  # rows of equal score go together
        good = np.flatnonzero((np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision) & ends) if len(order) else []
        thresholds[kind] = float(max(0.5, s[order][good[-1]])) if len(good) else 1.01
    return Detector(trees, evidence, thresholds)


def _found(model: Detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            base_out, all_out = [], []
            for text in batch.column("_text").to_pylist():
                if not ("@" in text or _DIGIT.search(text) or _SPELT_AT.search(text) or _TITLED.search(text) or _SPELT_DIGITS.search(text)):
                    base_out.append([])
                    all_out.append([])
                    continue
                base, spans = model.spans(text)
                rows = sorted(((a, b, k) for k in KINDS for a, b in base[k]), key=lambda s: (s[0], KINDS.index(s[2])))
                base_out.append([dict(zip(("start", "stop", "kind"), r, strict=True)) for r in rows])
                all_out.append([dict(zip(("start", "stop", "kind"), r, strict=True)) for r in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_out, kinds), pa.array(all_out, kinds)], [*batch.schema.names, "base_spans", "pii_spans"])

    return run


def find_pii(docs: DataFrame, model: Detector | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text, base_spans and pii_spans (start, stop, kind in code points of the whole text).

    Null texts count as empty and have no spans; repeated rows are each searched; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    spans = "array<struct<start: long, stop: long, kind: string>>"
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(_found(model or detector()), f"doc_id {kind}, _text string, base_spans {spans}, pii_spans {spans}").withColumnRenamed("_text", "text")


def redact_pii(found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """doc_id and the text of find_pii with each span (merged where they overlap) replaced by its kind."""
    def step(acc: F.Column, s: F.Column) -> F.Column:
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))
        return F.when(s["start"] < acc["at"], inside).otherwise(F.struct(F.concat(acc["out"], gap, F.format_string(mask.replace("{}", "%s"), s["kind"])).alias("out"), s["stop"].alias("at")))

    done = F.aggregate("pii_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    rest = F.substring("text", (F.col("_r.at") + 1).cast("int"), F.length("text"))
    return found.withColumn("_r", done).select("doc_id", F.concat(F.col("_r.out"), rest).alias("text"))


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("pii_spans").alias("spans"))
