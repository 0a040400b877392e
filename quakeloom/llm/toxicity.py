"""Toxicity by a gap-weighted subsequence-kernel support vector machine with Nyström landmarks.

A sentence is compared word by word: the kernel of two words counts the three-character subsequences
they share, each weighted by ``DECAY`` to the power of the characters it spans, so gaps and inserted characters
weaken a match without losing it. Landmark words give each word a Nyström vector K(x, Z) K(Z, Z)^-1/2, on which a linear
machine with squared hinge loss is trained. A sentence scores as its highest word, a document as its highest
sentence, and a logistic curve fitted on training documents makes it a probability.

Training sentences carry their document's label: all sentences of a clean document are clean, one at least
of a toxic one is not, so each round takes the highest sentence of each toxic document, and in it the highest words, as its witnesses.

The trained machine is linear in the subsequences of the landmarks, so it is folded into one weight per
subsequence and scoring needs no landmark: exact, and the same for any number of landmarks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, sampling_rate, small_batches, text_or_empty

#: Codes of characters, characters a subsequence may span, weight per character spanned.
CODES, SPAN, DECAY = 64, 5, 0.6
#: Longer words are taken as overlapping windows of this many characters.
WINDOW = 20
#: Labelled documents that are fitted on at most (in expectation; a hash of the id picks them), landmarks, and words of either class.
TRAIN_DOCUMENTS, LANDMARKS, TRAIN_WORDS = 3000, 256, 6_000
WORD = re.compile(r"\w+")
#: Rows of a matrix that training works on at once: the driver's memory is bounded by it.
BLOCK = 256
#: Where a sentence ends.
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Single characters set apart by single others, as in "i d i o t" or "i.d.i.o.t".
SPELLED = re.compile(r"(?<!\w)(?:\w[^\w\n]){2,}\w(?!\w)")


def words_of(text: str) -> set[str]:
    """The distinct words of a text, lower-cased; spelled-out words joined; long ones as windows."""
    low = text.lower()
    words = set(WORD.findall(low))
    words.update(re.sub(r"\W", "", m) for m in SPELLED.findall(low))
    for long in [w for w in words if len(w) > WINDOW]:
        words.discard(long)
        words.update(long[i : i + WINDOW] for i in range(0, len(long) - WINDOW // 2, WINDOW // 2))
    return words


def sentences_of(text: str) -> list[set[str]]:
    """The words of each sentence. No word goes across a sentence's end, so together they are the text's words."""
    return [w for w in map(words_of, SENTENCE.split(text)) if w]


def _code(words: list[str]) -> np.ndarray:
    """Codes of words of one length, with a mark before and after."""
    points = np.array(["".join(words)]).view(np.uint32).reshape(len(words), -1).astype(np.int64)
    letters = (points >= 97) & (points <= 122)
    codes = np.where(letters, points - 96, 27 + points % (CODES - 28))
    edge = np.zeros((len(words), 1), np.int64)
    return np.hstack([edge, codes, edge + CODES - 1])


def _subsequences(n: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for i, j, k in combinations(range(n), 3) if k - i < SPAN]


def _norm(n: int) -> float:
    return float(np.sqrt(sum(DECAY ** (2 * (k - i + 1)) for i, _, k in _subsequences(n)))) or 1.0


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of the words of each length."""
    groups = defaultdict(list)
    for place, w in enumerate(words):
        groups[len(w)].append(place)
    for places in groups.values():
        yield np.array(places), _code([words[p] for p in places])


@dataclass
class Model:
    """``weight`` per subsequence, ``bias`` of a word; ``slope, offset`` of the logistic curve; ``floor``: the score where there is no word."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    floor: float

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.floor)
        for places, code in by_length(words):
            total = np.zeros(len(places), np.float32)
            high, mid = code * CODES * CODES, code * CODES
            for i, j, k in _subsequences(code.shape[1]):
                total += np.float32(DECAY ** (k - i + 1)) * self.weight[high[:, i] + mid[:, j] + code[:, k]]
            out[places] = total / _norm(code.shape[1]) + self.bias
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def _features(words: list[str], index: dict[int, int]) -> np.ndarray:
    """Kernel feature vectors over the subsequences in ``index``."""
    out = np.zeros((len(words), len(index)), np.float32)
    lookup = np.full(CODES**3, -1, np.int64)
    lookup[list(index)] = list(index.values())
    for places, code in by_length(words):
        for i, j, k in _subsequences(code.shape[1]):
            at = lookup[code[:, i] * CODES * CODES + code[:, j] * CODES + code[:, k]]
            out[places[at >= 0], at[at >= 0]] += np.float32(DECAY ** (k - i + 1) / _norm(code.shape[1]))
    return out


def _triples(word: str) -> set[int]:
    code = _code([word])[0]
    return {int(code[i] * CODES * CODES + code[j] * CODES + code[k]) for i, j, k in _subsequences(len(code))}


def _squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 2000.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of the L2 machine by Newton steps; ``share``: weight of each row."""
    size = x.shape[1] + 1
    w = np.zeros(size)
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(size)
        for at in range(0, len(x), BLOCK):
            rows = np.column_stack([x[at : at + BLOCK], np.ones(len(x[at : at + BLOCK]))])
            inside = y[at : at + BLOCK] * (rows @ w) < 1
            rows, a = rows[inside], rows[inside] * (cost * share[at : at + BLOCK][inside])[:, None]
            left += a.T @ rows
            right += a.T @ y[at : at + BLOCK][inside]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def _backing(x: np.ndarray, counts: np.ndarray, alike: float = 0.7) -> np.ndarray:
    """Weights of the witnesses, the first rows of ``x``: how many documents' witnesses are like each, for one and the clean words (the other rows) that are."""
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    n, out = len(counts), []
    for at in range(0, n, BLOCK):
        near = unit[at : min(at + BLOCK, n)] @ unit.T >= alike
        out.append((near[:, :n] @ counts - 1) / (1 + near[:, n:].sum(1)))
    return np.log1p(np.maximum(np.concatenate(out), 0)) + 0.1


def _logistic(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve with his smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([score, np.ones(len(score))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(documents: list[list[Collection[str]]], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 3) -> Model:
    """Fit on the sentences (distinct words) of labelled documents. With one class only, every score is that class's share, smoothed."""
    y = np.array(labels)
    none = Model(np.zeros(CODES**3, np.float32), 0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5 + 1))), 0.0)
    toxic, clean = [d for d, l in zip(documents, labels, strict=True) if l == 1 and d], [d for d, l in zip(documents, labels, strict=True) if l == 0 and d]
    if not toxic or not clean:
        return none
    seen = set().union(*(s for d in clean for s in d))
    # The first witnesses: words whose subsequences many toxic documents have and few clean ones.
    every = sorted(set().union(*(s for d in documents for s in d)))
    memo: dict[str, np.ndarray] = {}
    for places, code in by_length(every):
        code, (i, j, k) = code.astype(np.int32), np.array(_subsequences(code.shape[1])).T
        own = ((code[:, i] * CODES + code[:, j]) * CODES + code[:, k])
        memo.update(zip([every[p] for p in places.tolist()], own, strict=True))

    def with_triple(docs: list[list[Collection[str]]], but: set[str]) -> np.ndarray:
        """In how many documents each subsequence is."""
        out = np.zeros(CODES**3)
        for d in docs:
            own = [memo[w] for w in set().union(*d) if w not in but]
            if own:
                out[np.unique(np.concatenate(own))] += 1
        return out

    in_toxic, in_clean = with_triple(toxic, seen), with_triple(clean, set())
    a, b = len(toxic), len(clean)
    odds = in_toxic / a * np.log(((in_toxic + 0.5) / (a + 1)) / ((in_clean + 0.5) / (b + 1)))

    def top(d: list[Collection[str]], score: dict) -> list[str]:
        """The highest words of the highest sentence."""
        ranked = [sorted((w for w in s if w not in seen), key=lambda w: (score[w], w), reverse=True)[:3] for s in d]
        return max((r for r in ranked if r), key=lambda r: (score[r[0]], r[0]), default=[])

    score = {w: float(np.sort(odds[np.unique(memo[w])])[-3:].mean()) for d in toxic for s in d for w in s if w not in seen}
    rng = np.random.default_rng(5)
    background = sorted(seen)
    background = [background[i] for i in rng.permutation(len(background))[:TRAIN_WORDS]]
    for _ in range(rounds):
        picked = Counter()
        for d in toxic:
            best = top(d, score)
            picked.update(w for w in best if score[w] >= 0.6 * score[best[0]] or w == best[0])
        positive = [w for w, _ in sorted(picked.items(), key=lambda v: (-v[1], v[0]))[:TRAIN_WORDS]]
        if not positive:
            return none
        marks = positive[: landmarks // 2]
        marks += background[: landmarks - len(marks)]
        index = {t: n for n, t in enumerate(sorted(set().union(*(memo[w].tolist() for w in marks))))}
        z = _features(marks, index)
        values, vectors = np.linalg.eigh(z @ z.T)
        keep = values > 1e-5 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        fold = z.T @ whiten
        words = positive + background
        x = np.vstack([_features(words[i : i + BLOCK], index) @ fold for i in range(0, len(words), BLOCK)])
        sign = np.array([1.0] * len(positive) + [-1.0] * len(background))
        counts = np.array([picked[w] for w in positive], float) * _backing(x, np.array([picked[w] for w in positive], float))
        share = np.concatenate([0.5 * counts / counts.sum(), np.full(len(background), 0.5 / max(1, len(background)))])
        w = _squared_hinge(x, sign, share)
        weight = np.zeros(CODES**3, np.float32)
        weight[list(index)] = fold @ w[:-1]
        model = Model(weight, float(w[-1]), 1.0, 0.0, -1.5)
        of_toxic = sorted(set().union(*(s for d in toxic for s in d)))
        score = dict(zip(of_toxic, model.words(of_toxic).tolist(), strict=True))
        hard = sorted(seen)
        risen = np.array(hard, dtype=object)[np.argsort(-model.words(hard))[: TRAIN_WORDS // 4]].tolist()
        background = list(dict.fromkeys(risen + background))[:TRAIN_WORDS]
    score = dict(zip(every, model.words(every).tolist(), strict=True))
    best = np.array([max((score[w] for s in d for w in s), default=model.floor) for d in documents])
    model.slope, model.offset = _logistic(best, y)
    return model


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on about ``most`` labelled documents that aren't held out; a hash of the id picks them. Rows without a label are left out."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("y is not null and k is not null").where(~held_out("k"))
    picked = known.where(hashed_share(F.col("k"), sampling_rate(known, most))).dropDuplicates(["k"]).limit(2 * most)  # bounded, so it is broadcast
    rows = docs.join(F.broadcast(picked), docs[id_col] == picked.k).select(text_or_empty(docs[text_col]).alias("t"), picked.y.alias("label")).toPandas()
    rows = rows.sort_values(["t", "label"], ignore_index=True)
    once: dict[str, str] = {}  # one object for all places of a word
    return fit([[tuple(once.setdefault(w, w) for w in s) for s in sentences_of(t)] for t in rows["t"]], rows["label"].tolist())


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, a probability, over every word of every text. Null and empty texts score as having no word."""
    small_batches(docs.sparkSession)
    known: dict[str, float] = {}

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 250):
            sets = [words_of(t) for t in texts.iloc[at : at + 250]]
            new = [w for w in set().union(*sets) if w not in known]
            if len(known) + len(new) > 150_000:
                known.clear()
                new = list(set().union(*sets))
            known.update(zip(new, model.words(new).tolist(), strict=True))
            out += [max(map(known.__getitem__, s), default=model.floor) for s in sets]
        return pd.Series(model.probability(np.array(out, float)))

    return docs.withColumn(score_col, scored(text_or_empty(text_col)))
