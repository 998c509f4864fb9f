"""Quality of documents by a linear-chain conditional random field over their lines.

Every line gets figures of its own (letters, capitals, digits, symbols, word lengths, repetition) and those of its
neighbours; a two-state chain over the lines gives each a marginal probability of being good by the forward-backward
algorithm over the whole document. The mean of the marginals, weighted by line length, says how much of the document
is good, and a logistic curve over that gives the score.

Learning needs line labels, but only documents are labelled. First every line takes its document's label and a
per-line classifier is fitted; in bad documents, lines it finds clearly good are then labelled good, unless none would
be left bad. The chain is fitted to these labels. Learning cuts long documents into runs of lines; scoring does not.

Null texts count as empty; an empty text is one empty line. Repeated rows give repeated results. Null, repeated or
contradicting labels: see ``labelled_sample``. Without labels of both classes every text scores 1, so that nothing is
rejected without reason.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame

from nearfield.llm.tasks import keep_rows, labelled_sample, logistic, map_rows, probability, text_rows

# Labelled documents of each class used to learn from; a documented bound.
LEARN_PER_CLASS = 1500
# Lines in a row that a training sequence holds at most.
RUN = 64
# A score from which a document counts as good.
GOOD = 0.7

LOWER, UPPER, DIGIT, SPACE, BREAK, POINT, SYMBOL, MARK = range(8)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, made once per worker."""
    if not _CLASSES:
        table = np.full(0x110000, SYMBOL, dtype=np.uint8)
        kinds = {"Lu": UPPER, "Lt": UPPER, "L": LOWER, "M": MARK, "N": DIGIT, "Z": SPACE}
        for point in range(0x30000):
            kind = unicodedata.category(chr(point))
            table[point] = kinds.get(kind, kinds.get(kind[0], SYMBOL))
        for point in map(ord, ".,;:?!'\"()-’“”«»…"):
            table[point] = POINT
        for point in map(ord, "\t\r\f\v"):
            table[point] = SPACE
        table[ord("\n")] = BREAK
        _CLASSES.append(table)
    return _CLASSES[0]


def line_figures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of figures per line, and the lines' lengths."""
    kinds = classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    breaks = kinds == BREAK
    line = np.cumsum(breaks) - breaks
    lines = text.split("\n")
    n = len(lines)
    count = np.bincount(line.astype(np.int64) * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(np.float64)
    length = count.sum(1) - count[:, BREAK]
    split = [x.split() for x in lines]
    words = np.array([len(x) for x in split], dtype=np.float64)
    distinct = np.array([len(set(x)) for x in split], dtype=np.float64)
    short = np.array([sum(len(w) <= 3 for w in x) for x in split], dtype=np.float64)
    bars = np.array([x.count("|") for x in lines], dtype=np.float64)
    times = Counter(lines)
    copies = np.array([times[x] - 1 for x in lines], dtype=np.float64)
    shouts = np.array([x.count("!") for x in lines], dtype=np.float64)
    full, some = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(count[:, LOWER] + count[:, UPPER], 1)
    figures = np.stack([
        np.log1p(length), np.log1p(words), count[:, UPPER] / letters, count[:, DIGIT] / full,
        count[:, SYMBOL] / full, np.minimum(count[:, SYMBOL] / some, 4), count[:, POINT] / full, shouts / some,
        bars / some, np.minimum(length / some, 30) / 10, distinct / some, (words - distinct) / (some + 20), short / some,
        np.log1p(copies), (length == 0).astype(np.float64),
    ], axis=1)
    return figures, length


#: Figures, by place, that a line also takes from its neighbours.
NEIGHBOURS = [2, 4, 5, 7, 8, 10, 13]


def observations(figures: np.ndarray) -> np.ndarray:
    """A line's figures, its neighbours' (zero beyond the ends), and whether it is first or last."""
    near = figures[:, NEIGHBOURS]
    none = np.zeros((1, near.shape[1]))
    first, last = np.zeros((len(figures), 1)), np.zeros((len(figures), 1))
    first[0], last[-1] = 1, 1
    return np.hstack([figures, np.vstack([none, near[:-1]]), np.vstack([near[1:], none]), first, last])


@dataclass
class Chain:
    """Weights for the state good against bad, and the chance in logarithm that neighbours agree."""

    weights: np.ndarray
    constant: float
    agree: float
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def marginals(self, seen: np.ndarray) -> np.ndarray:
        """Probability of good for every line, over the whole sequence."""
        odds = np.clip(seen @ self.weights + self.constant, -30, 30)
        # e: how far a message keeps its strength when it passes to a neighbour
        ahead, back = np.zeros_like(odds), np.zeros_like(odds)
        pass_on = _passing(self.agree)
        message = 0.0
        for i, o in enumerate(odds.tolist()):
            ahead[i] = message
            message = pass_on(message + o)
        message = 0.0
        for i in range(len(odds) - 1, -1, -1):
            back[i] = message
            message = pass_on(message + odds[i])
        return 1 / (1 + np.exp(-np.clip(odds + ahead + back, -30, 30)))


def _passing(agree: float):
    """Log odds that reach the neighbour of a line with log odds x, when agreeing weighs ``agree`` more than not."""
    from math import exp, log

    a = exp(agree)

    def pass_on(x: float) -> float:
        e = exp(min(max(x, -30.0), 30.0))
        return log((a * e + 1) / (e + a))

    return pass_on


def fit_chain(runs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam; ``runs`` are observations and labels (1 good) of sequences of lines."""
    runs = sorted(runs, key=lambda r: -len(r[1]))
    n, steps, d = len(runs), len(runs[0][1]), runs[0][0].shape[1]
    x, y, there = np.zeros((n, steps, d)), np.zeros((n, steps)), np.zeros((n, steps), dtype=bool)
    for i, (seen, labels) in enumerate(runs):
        x[i, : len(labels)], y[i, : len(labels)], there[i, : len(labels)] = seen, labels, True
    middle = x[there].mean(0)
    spread = x[there].std(0) + 1e-6
    x = (x - middle) / spread * there[..., None]
    total = there.sum()
    w, first, second = np.zeros(d + 2), np.zeros(d + 2), np.zeros(d + 2)
    pairs = there[:, 1:] & there[:, :-1]
    same = ((y[:, 1:] == y[:, :-1]) & pairs).sum()
    for k in range(1, rounds + 1):
        good, agreeing = _expected(x, there, pairs, w[:d], w[d], w[d + 1])
        gap = (y - good) * there
        gradient = np.append(np.tensordot(gap, x, 2), [gap.sum(), same - agreeing]) / total
        gradient[:d] -= penalty * w[:d]
        gradient[d + 1] -= penalty * w[d + 1]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    weights = w[:d] / spread
    return Chain(weights, float(w[d] - (weights * middle).sum()), float(w[d + 1]))


def _expected(x, there, pairs, weights, constant, agree):
    """Marginals of good per line and the expected number of agreeing neighbours, for all sequences at once."""
    n, steps = there.shape
    odds = np.where(there, np.clip(x @ weights + constant, -30, 30), 0.0)

    def pass_on(m):
        e = np.exp(np.clip(m, -30, 30))
        return np.log((np.exp(agree) * e + 1) / (e + np.exp(agree)))

    ahead, back = np.zeros((n, steps)), np.zeros((n, steps))
    for t in range(1, steps):
        ahead[:, t] = np.where(pairs[:, t - 1], pass_on(ahead[:, t - 1] + odds[:, t - 1]), 0.0)
    for t in range(steps - 2, -1, -1):
        back[:, t] = np.where(pairs[:, t], pass_on(back[:, t + 1] + odds[:, t + 1]), 0.0)
    good = 1 / (1 + np.exp(-np.clip(odds + ahead + back, -30, 30)))
    left = np.clip((ahead + odds)[:, :-1], -30, 30)
    right = np.clip((back + odds)[:, 1:], -30, 30)
    both = np.exp(agree) * (np.exp(left + right) + 1)
    differ = np.exp(left) + np.exp(right)
    return good, (both / (both + differ) * pairs).sum()


def summary(marginals: np.ndarray, lengths: np.ndarray) -> list[float]:
    """Share of good text by length, and the share of lines that are good."""
    weights = np.maximum(lengths, 1)
    share = float((marginals * weights).sum() / weights.sum())
    return [share, float(np.clip(np.log((share + 1e-4) / (1 - share + 1e-4)), -9, 9)), float(marginals.mean())]


def learn(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = LEARN_PER_CLASS) -> Chain | None:
    """Fit on labelled documents for which ``use`` (a condition on labels) holds; None without both classes."""
    sample = labelled_sample(docs, labels, "quality", use, per_class, "quality-sample")

    def measure(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, label in rows:
            figures, lengths = line_figures(text)
            yield label, figures.astype(np.float32).tobytes(), lengths.astype(np.float32).tobytes()

    rows = map_rows(sample.select("text", "label"), measure, "label int, figures binary, lengths binary").collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    seen, lengths = [], []
    for r in rows:
        lengths.append(np.frombuffer(r["lengths"], dtype=np.float32).astype(np.float64))
        figures = np.frombuffer(r["figures"], dtype=np.float32).astype(np.float64)
        seen.append(observations(figures.reshape(len(lengths[-1]), -1)))
    documents = np.array([r["label"] for r in rows])
    line_labels = np.concatenate([np.full(len(s), y) for s, y in zip(seen, documents)])
    each = logistic(np.vstack(seen), line_labels)
    runs = []
    for s, y in zip(seen, documents):
        found = np.full(len(s), y, dtype=np.float64)
        if not y:
            clearly = probability(s, each) > 0.8
            if not clearly.all():
                found[clearly] = 1
        runs += [(s[i : i + RUN], found[i : i + RUN]) for i in range(0, len(s), RUN)]
    chain = fit_chain(runs)
    chain.curve = logistic(np.array([summary(chain.marginals(s), n) for s, n in zip(seen, lengths)]), documents)
    return chain


def line_marginals(text: str, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good and length of every line of a text."""
    figures, lengths = line_figures(text)
    return chain.marginals(observations(figures)), lengths


def score_text(text: str, chain: Chain | None) -> float:
    if chain is None:
        return 1.0
    return float(probability(np.array(summary(*line_marginals(text, chain))), chain.curve))


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id and score of every whole text. A map: no shuffle."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((doc_id, score_text(text, chain)) for doc_id, text in rows)

    return map_rows(text_rows(docs), each, "doc_id bigint, score double")


def good_only(docs: DataFrame, chain: Chain | None, threshold: float = GOOD) -> DataFrame:
    """``docs`` without the rows whose texts score less than ``threshold``."""
    return keep_rows(docs, lambda: lambda text: score_text(text, chain) >= threshold)
