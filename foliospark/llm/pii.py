"""Personal data: base patterns, high-recall candidates, and boosted trees that choose among them."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import only

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits can't match where the run's start doesn't, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Candidates beyond the base: written-out addresses, groups of digits without a plus sign, longer digit strings in any
#: grouping, and four numbers with written-out or bracketed dots.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_DIGITS = re.compile(r"(?<![\w+.@-])\(?[0-9]{1,4}\)?(?:[ .()/-]{1,2}[0-9]{2,5}){1,6}(?![\w@])")
_GROUPED = re.compile(r"(?<![\w+.@-])[0-9](?:[ ./-]?[0-9]){12,18}(?![\w@])")
_OCTETS = re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\]|\{\.\}| dot ) ?[0-9]{1,3}){3}(?!\w)")


def luhn(digits: str) -> bool:
    """Whether the check digit of a digit string holds."""
    total = 0
    for place, char in enumerate(reversed(digits)):
        n = ord(char) - 48
        if place % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern; matches that fail their test are dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-12:]) <= 255 for p in found[0].split(".")):
            out.append(("ip", *found.span()))
    for found in _CARD.finditer(text):
        digits = _only_digits(found[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= len(_only_digits(found[0])) <= 15:
                out.append(("phone", *found.span()))
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    """By start, then by kind as listed."""
    return span[1], KINDS.index(span[0]), span[2]


def candidates(text: str) -> list[Span]:
    """High-recall spans beyond the base; they may overlap each other and base spans."""
    out: list[Span] = []
    if "at" in text or "AT" in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    for m in _DIGITS.finditer(text):
        n = len(_only_digits(m[0]))
        if 7 <= n <= 15:
            out.append(("phone", *m.span()))
        if 13 <= n <= 19:
            out.append(("card", *m.span()))
    known = set(out)
    out += [c for m in _GROUPED.finditer(text) if (c := ("card", *m.span())) not in known]
    out += [("ip", *m.span()) for m in _OCTETS.finditer(text)]
    return out


_CUES = {"phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "dial"), "email": ("mail", "contact", "write", "reach"), "card": ("card", "visa", "payment", "credit", "iban", "account"), "ip": ("ip", "host", "server", "address", "ping")}
_FALSE = ("order", "invoice", "isbn", "version", "page", "section", "token", "id", "no.", "$", "date", "from", "to", "between")


def features(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 8]
    digits = _only_digits(body)
    groups = re.findall(r"[0-9]+", body)
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(bool(digits) and luhn(digits)), float(body.count("(") + body.count("[") + body.count("{")), float(body.count("-")), float(body.count(".")), float(body.count(" ")), float(body.count("/")),
        float(any(c in before for c in _CUES.get(kind, ()))), float(any(c in before[-16:] for c in _FALSE)), float(bool(re.search(r"(?:\(at\)|\[at\]|\{at\})", body))),
        float(bool(re.search(r"(?:\(dot\)|\[dot\]|\{dot\}| dot )", body))), float(before.endswith((": ", ":", "= ", "="))), float(after[:1] in ("%", "$", "€")), float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./][0-9]{2}[-./][0-9]{2}", body))),
        float(len(set(digits))), float(digits[0]) if digits else -1.0, float(max(map(int, groups), default=0) <= 255),
    ]


class BoostedTrees:
    """Gradient boosting of two-level trees with logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, rate: float = 0.2) -> None:
        self.rounds, self.rate, self.base, self.trees = rounds, rate, 0.0, []

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        best = (0.0, -1, 0.0)
        total = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
                left = x[:, f] <= cut
                if 10 <= left.sum() <= len(left) - 10:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - total
                    if gain > best[0] + 1e-9:
                        best = (gain, f, float(cut))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(0.99, max(0.01, float(y.mean())))
        self.base = math.log(p / (1 - p))
        score = np.full(len(y), self.base)
        leaf = lambda g, h: float(self.rate * g.sum() / (h.sum() + 1.0))
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            _, f, cut = self._split(x, g, h)
            if f < 0:
                break
            sides = []
            for side in (x[:, f] <= cut, x[:, f] > cut):
                _, f2, cut2 = self._split(x[side], g[side], h[side])
                if f2 < 0:
                    v = leaf(g[side], h[side])
                    sides.append((0, math.inf, v, v))
                else:
                    low = side & (x[:, f2] <= cut2)
                    high = side & ~low
                    sides.append((f2, cut2, leaf(g[low], h[low]), leaf(g[high], h[high])))
            self.trees.append((f, cut, *sides))
            score = score + self._tree(self.trees[-1], x)
        return self

    @staticmethod
    def _tree(tree: tuple, x: np.ndarray) -> np.ndarray:
        """One tree's values of all rows."""
        f, cut, low, high = tree
        side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        return np.where(x[:, f] <= cut, side(low), side(high))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all rows at once."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(tree, x)
        return 1 / (1 + np.exp(-score))


def _examples(seed: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: personal data in common spellings, and what only looks like it."""
    rng = random.Random(seed)
    groups = lambda text, sizes, sep: sep.join(text[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    shapes = {13: ((4, 3, 3, 3), (13,)), 15: ((4, 6, 5),), 16: ((4, 4, 4, 4), (16,)), 19: ((4, 4, 4, 4, 3),)}
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghinorstuw") for _ in range(rng.randint(3, 8)))
    lead = lambda cues: rng.choice([f"{word()} {word()} ", *[f"{word()} {c}: " for c in cues], *[f"{word()} {c} " for c in cues]])
    x, y = [], []

    def add(head: str, body: str, kind: str | None) -> None:
        text = f"{head}{body} {word()} {word()}"
        for span in candidates(text):
            if span[2] > len(head) and span[1] < len(head) + len(body):
                x.append(features(text, span))
                y.append(int(span[0] == kind))

    def card(first: str, valid: bool) -> str:
        number = rng.choice(sorted(shapes))
        start = rng.choice(first) + digits(number - 2)
        check = next(d for d in "0123456789" if luhn(start + d))
        body = start + (check if valid else rng.choice([d for d in "0123456789" if d != check]))
        return groups(body, rng.choice(shapes[number]), rng.choice("./- "))

    def octets(most: int) -> str:
        numbers = [str(rng.randint(0, most)) for _ in range(4)]
        if most > 255:
            numbers[rng.randrange(4)] = str(rng.randint(256, most))
        return rng.choice(["(dot)", "[dot]", "{dot}", " dot ", " (dot) ", " [dot] ", "[.]", "(.)", "{.}"]).join(numbers)

    for _ in range(number):
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), (" (at) ", " (dot) "), (" at ", " dot ")])
        add(lead(_CUES["email"]), f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net'])}", "email")
        add(lead(()), f"{word()} at {word()}.", None)
        add(f"{word()} ", f"{word()} at {word()}. {word().title()}", None)
        add(lead(_CUES["phone"]) if rng.random() < 0.8 else f"{word()}, ", rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"]), "phone")
        add(lead(_FALSE[:9]), rng.choice([f"{digits(4)} {digits(4)}", f"{digits(5)}-{digits(5)}", f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}-{digits(3)}"]), None)
        add(lead(_CUES["card"] if rng.random() < 0.5 else ()), card("3456", True), "card")
        add(lead(_CUES["card"]), card("0123456789", False), None)
        add(lead(_FALSE[:9]), card("0123456789", rng.random() < 0.5), None)
        add(lead(()), rng.choice([f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"1{digits(12)}"]), None)
        add(lead(_CUES["ip"] if rng.random() < 0.5 else ()), octets(255), "ip")
        add(lead(_CUES["ip"]), octets(999), None)
    return np.array(x), np.array(y, float)


#: Least share of true spans among those chosen from the calibration examples.
PRECISION = 0.98


@lru_cache(maxsize=4)
def chooser(seed: int = 11, number: int = 400) -> tuple[BoostedTrees, dict[str, float]]:
    """The boosted trees, and for each kind the lowest threshold that keeps ``PRECISION`` on other examples."""
    model = BoostedTrees().fit(*_examples(seed, number))
    x, y = _examples(seed + 1, number)
    p = model.probability(x)
    limits = {}
    for n, kind in enumerate(KINDS):
        mine = x[:, 0] == n
        limits[kind] = 2.0
        for cut in np.linspace(0.5, 0.99, 50):
            picked = mine & (p >= cut)
            if picked.sum() >= 20 and y[picked].mean() >= PRECISION:
                limits[kind] = float(cut)
                break
    return model, limits


def find_spans(text: str, model: BoostedTrees, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and the chosen candidates, the likeliest first, that overlap none chosen before."""
    base, found = base_spans(text), candidates(text)
    if not found:
        return base, base
    likely = model.probability(np.array([features(text, s) for s in found]))
    ranked = sorted(((-p, order(s), s) for p, s in zip(likely.tolist(), found, strict=True) if p >= limits[s[0]]))
    starts, ends = _merged(base)
    chosen = list(base)
    for *_, span in ranked:
        at = bisect.bisect_left(ends, span[1] + 1)
        if at == len(starts) or span[2] <= starts[at]:
            chosen.append(span)
            starts.insert(at, span[1])
            ends.insert(at, span[2])
    return base, sorted(chosen, key=order)


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, disjoint and in order."""
    starts, ends = [], []
    for start, end in sorted((a, b) for _, a, b in spans):
        if starts and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def written(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], model: BoostedTrees, limits: dict[str, float]) -> Iterator[pa.RecordBatch]:
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for text in batch.column(1):
            base, full = find_spans(text.as_py() or "", model, limits)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            for column, value in zip(out, [*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(full)], strict=True):
                column.append(value)
        kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["doc_id", *names])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans always stay; counts and digest are of them. ``spans`` adds candidates whose boosted-tree
    probability reaches their kind's calibrated threshold and that overlap no other span. Positions are code points, ends
    exclusive. Null counts as empty text, which has no spans. Repeated rows give equal rows. Extra columns are
    ignored; an empty table gives no rows. Rows are independent of each other, so nothing is shuffled.
    """
    model, limits = chooser()
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(lambda it: _scan(it, model, limits), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=order):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])
