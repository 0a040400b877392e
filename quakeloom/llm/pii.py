"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap: the base formats (e-mail, IP address, payment card, phone)
before their checks, and looser forms of each. Boosted trees score a proposal by its format and by the words
around it; a threshold calibrated on proposals that were kept out of the fit selects redactions.

The trees are trained on the proposals of a sample of documents. Those that pass the base checks are positive, and so are rewritings
of them in the looser forms where they stand (an e-mail with its signs spelled out, a card in dotted groups, a phone without its country, an
IPv6 address). Proposals that touch a passing span are left out, the rest is negative. The features leave out what the checks test
(Luhn sum, octet range), so what the trees learn is how such data looks and what stands around it. Spans that pass the base checks are always kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, materialize, sampling_rate, small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base formats. Fixed values of the contract.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches without quadratic scans of long runs: a match of the ip format takes whole runs of digits, an e-mail's name the whole run before the sign.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
NAME_CHARS, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Looser forms, and what a text must hold to be searched for them.
LOOSE = {
    "email": (re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\})\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[\w-]{2,63})+", re.I), re.compile(r"[@(\[{]")),
    "ip": (re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"), re.compile(r"[0-9A-Fa-f][.:][0-9A-Fa-f]")),
    "card": (re.compile(r"(?<!\d)\d{4}(?:[ .-]\d{4}){2,3}(?!\d)"), re.compile(r"\d{4}[ .-]\d{4}")),
    "phone": (re.compile(r"(?<![\w+])(?:\+|00)?\(?\d{2,4}\)?[ ./-]\(?\d{2,4}\)?[ ./-]\d{2,4}(?:[ ./-]?\d{2,4})?(?!\w)"), re.compile(r"\d[ )./-]+\d")),
}
#: Documents whose proposals are fitted on (in expectation; a hash of the id picks them), proposals fitted on (in expectation, a hash of the features picks them), precision that the threshold must reach on those kept out.
TRAIN_DOCUMENTS, TRAIN_PROPOSALS, PRECISION = 4000, 20_000, 0.98
HINTS = re.compile(r"mail|contact|write|reach|call|phone|tel|fax|mobile|card|visa|pay|account|ip|host|server|address|token|key|secret|id|no|version", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def passes(kind: str, span: str) -> bool:
    """The base check of a match of the base format."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in span.split("."))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start, m = at, DOMAIN.match(text, at + 1)
        if m:
            while start > end and text[start - 1] in NAME_CHARS:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of all matches of the base formats, per kind leftmost and non-overlapping."""
    out = [("email", s, e, True) for s, e in _emails(text)]
    for kind, pattern in (("ip", IP), ("card", BASE["card"]), ("phone", BASE["phone"])):
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end(), passes(kind, m[0])) for m in pattern.finditer(text)]
    return out


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """Base matches of some length and the looser forms, which may overlap them."""
    out = {(k, s, e): ok for k, s, e, ok in base_spans(text) if e - s >= 7}
    for kind, (pattern, need) in LOOSE.items():
        if need.search(text):
            for m in pattern.finditer(text):
                out.setdefault((kind, m.start(), m.end()), False)
    return [(*k, ok) for k, ok in out.items()]


def rewritten(kind: str, span: str) -> list[str]:
    """Looser forms of a span that passed its base check, from its own characters."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host}", f"{name} @ {host}"]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, 16, 4))] if len(digits) == 16 else []
    if kind == "phone":
        return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"] if len(digits) >= 10 else []
    marks = hashlib.md5(span.encode()).hexdigest()
    return [":".join(marks[i : i + 4] for i in range(0, 32, 4))]


def labelled(text: str) -> Iterator[tuple[int, list[float]]]:
    """(label, features) of what the text has to train on."""
    own = proposals(text)
    passing = [(k, s, e) for k, s, e, ok in own if ok]
    for kind, start, end, ok in own:
        if ok:
            yield 1, features(text, kind, start, end)
            for form in rewritten(kind, text[start:end]):
                around = text[max(0, start - 40) : start] + form + text[end : end + 40]
                at = min(start, 40)
                yield 1, features(around, kind, at, at + len(form))
        elif all(end <= a or start >= b for _, a, b in passing):
            yield 0, features(text, kind, start, end)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = sum(c.isdigit() for c in span)
    groups = re.findall(r"\d+", span)
    hint = HINTS.search(before)
    return [
        float(KINDS.index(kind)), float(end - start), float(digits), float(sum(c.isalpha() for c in span)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(span.count(".")), float(span.count(" ")),
        float(span.count("-")), float(span.startswith("+")), float("@" in span), float("(" in span or "[" in span), float(":" in span),
        float(before[-1:].isalnum() or before[-1:] in tuple("._-:/@")), float(after[:1].isalnum() or after[:1] in tuple("_-:/@")),
        float(hint is not None), float(len(before) - hint.end() if hint else 30), float(sum(c.isdigit() for c in before + after)), float(len(span.rsplit(".", 1)[-1])),
    ]


@dataclass
class Trees:
    """Boosted trees of depth ``depth`` on features cut into bins; logistic loss."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    depth: int = 3

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.25, least: float = 5.0) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        bins, width = self._bins(x), 33
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        raw = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, which, cut = np.zeros(len(y), np.int64), np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                gain = np.full((n, x.shape[1], width), -np.inf)
                for f in range(x.shape[1]):
                    at = (node - first) * width + bins[:, f]
                    gs, hs = (np.bincount(at, v, n * width).reshape(n, width).cumsum(1) for v in (g, h))
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    score = gs**2 / (hs + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain[:, f] = np.where((hs * 4 >= least) & (hr * 4 >= least), score, -np.inf)
                best = gain.reshape(n, -1).argmax(1)
                good = gain.reshape(n, -1).max(1) > 1e-9
                which[first : first + n], cut[first : first + n] = best // width, np.where(good, best % width, width)
                node = 2 * node + 1 + (bins[np.arange(len(y)), which[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((which, cut, value))
            raw += value[leaf]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins, raw = self._bins(x), np.full(len(x), self.start)
        for which, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[np.arange(len(x)), which[node]] > cut[node])
            raw += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-raw))


@dataclass
class Model:
    trees: Trees | None
    threshold: float


def calibrated(score: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest threshold from which on precision holds; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] < score[order][:-1], True)
    fits = np.nonzero(last & (right >= precision))[0]
    return float(max(score[order][fits[-1]], 0.5)) if len(fits) else 1.1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on the proposals of about ``most`` documents that hold a digit or an at sign; without both classes no span is added."""
    own = docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t"))
    picked = own.where(hashed_share(F.coalesce(F.col("k").cast("string"), F.lit("")), sampling_rate(docs.select(id_col), most), seed=23)).where("t rlike '[0-9@]'")

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["t"]:
                yield pd.DataFrame(list(labelled(t)), columns=["y", "x"])

    small_batches(docs.sparkSession)
    found = materialize(picked.select("t").mapInPandas(proposed, "y int, x array<double>"), "proposals")
    rows = found.where(hashed_share(F.xxhash64("x", "y"), sampling_rate(found, TRAIN_PROPOSALS), seed=31)).toPandas()
    if rows["y"].nunique() < 2 or len(rows) < 40:
        return Model(None, 1.1)
    rows = rows.assign(k=rows["x"].map(lambda v: tuple(map(float, v)))).sort_values(["k", "y"], ignore_index=True)
    x, y = np.array(rows["k"].tolist()), rows["y"].to_numpy(float)
    out = np.arange(len(y)) % 5 == 0
    trees = Trees().fit(x[~out], y[~out])
    return Model(trees, calibrated(trees.probability(x[out]), y[out]))


def find_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base ones and what the trees add where no base span is, surest first."""
    base = [(k, s, e) for k, s, e, ok in base_spans(text) if ok]
    added: list[tuple[str, int, int]] = []
    if model.trees is not None and model.threshold <= 1:
        rest = [(k, s, e) for k, s, e, ok in proposals(text) if not ok and all(e <= a or s >= b for _, a, b in base)]
        if rest:
            p = model.trees.probability(np.array([features(text, *c) for c in rest]))
            for score, c in sorted(zip(p.tolist(), rest, strict=True), key=lambda v: (-v[0], v[1][1], KINDS.index(v[1][0]))):
                if score >= model.threshold and all(c[2] <= a or c[1] >= b for _, a, b in added):
                    added.append(c)
    order = lambda v: (v[1], KINDS.index(v[0]), v[2])
    return sorted(base, key=order), sorted(base + added, key=order)


SPAN = "array<struct<kind:string,start:int,end:int>>"


def annotate(docs: DataFrame, model: Model, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``docs`` with ``found_col``: base spans and all spans of every whole text, in code points, end exclusive. Null counts as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"base {SPAN}, spans {SPAN}")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [find_spans(t, model) if "@" in t or re.search(r"[0-9]", t) or "(" in t or "[" in t else ([], []) for t in texts]
        return pd.DataFrame({n: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r[i]] for r in rows] for i, n in enumerate(("base", "spans"))})

    return docs.withColumn(found_col, found(text_or_empty(text_col)))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced. Null stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t, find_spans(t, model)[1]))

    return docs.withColumn(text_col, clean(text_col))
