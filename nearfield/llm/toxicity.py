"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of symbols: insult, threat, target, negation, reported speech, other. Five small
transducers read it side by side; each keeps a state and answers every symbol with a factor and an amount. They are
composed into one machine whose state is the tuple of theirs, built as its arcs are met. What a clause scores is the
sum of the weights of its insults times all factors, plus the amounts: "you idiot" scores more than "idiot", "not an
idiot" and "they said idiot" less, "kill you" scores though neither word does alone. Words alone never reject a text:
the matched clauses of the whole text give a few figures, and a logistic curve over those gives the score.

Insult words and stems with their weights are learnt from labelled rows, beside a short list of common ones; so are
the curve's weights. The other word lists and the factors are parameters below.

Null texts count as empty; an empty text has no clauses and scores what the curve gives for none. Repeated rows give
repeated results. Null, repeated or contradicting labels: see ``labelled_sample``. Without labels of both classes
nothing can be learnt, and every text scores 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tasks import keep_rows, labelled_sample, logistic, map_rows, probability, text_rows
from nearfield.session import materialize

# Labelled documents of each class used to learn from; a documented bound, the larger tables have more.
LEARN_PER_CLASS = 3000
# Words and stems kept from those, and the least number and share of the toxic documents one must occur in.
LEXICON, SUPPORT, SUPPORT_SHARE = 400, 5, 0.008
# Lengths of word beginnings tried as stems besides whole words.
STEMS = (4, 6, 8)
# Least ratio of document shares (toxic to other) for a word to count as an insult.
RATIO = 5.0
# Words whose reading a task keeps, and words counted by a task before they are passed on.
KEPT_WORDS, COUNTED_WORDS = 150_000, 150_000
# A score from which a document counts as toxic.
TOXIC = 0.5

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORDS = {
    THREAT: "kill hurt destroy beat punch stab shoot burn attack murder töten schlagen tuer frapper matar golpear",
    TARGET: "you your yourself u ya du dich dir dein ihr euch tu toi vous ton ta te ti usted ustedes vosotros",
    NEGATION: "not no never nor none without cannot nicht kein keine nie niemals pas jamais aucun ni nunca jamás sin",
    REPORT: "said says say told tells called calls claims claimed quoted reported wrote sagte sagt nannte dit disait "
            "appelé dijo dice llamó",
}
# Common insults, and their weight as long as labels give no other.
INSULTS = ("idiot moron stupid dumb fool loser scum trash garbage filth pathetic worthless useless disgusting clown "
           "imbecile cretin jerk pig vermin dummkopf trottel abschaum arschloch crétin imbécile connard ordure idiota "
           "imbécil estúpido basura escoria")
INSULT_WEIGHT = 4.0
TOKEN = re.compile(r"\w+|[.!?;:\n|]")
ENDS = frozenset(".!?;:\n|")


class Machine:
    """A weighted transducer: per state and symbol the next state, a factor on the symbol's weight, and an amount."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, float, float]], otherwise: dict[int, tuple[int, float]]):
        self.arcs, self.otherwise = arcs, otherwise

    def step(self, state: int, symbol: int) -> tuple[int, float, float]:
        found = self.arcs.get((state, symbol))
        if found is None:
            following, factor = self.otherwise.get(state, (state, 1.0))
            found = following, factor, 0.0
        return found


def within(symbol: int, reach: int, factor: float) -> Machine:
    """Weights of the next ``reach`` symbols after ``symbol`` are multiplied."""
    arcs = {(s, symbol): (reach, 1.0, 0.0) for s in range(reach + 1)}
    return Machine(arcs, {s: (s - 1, factor) for s in range(1, reach + 1)} | {0: (0, 1.0)})


def rest_of_clause(symbol: int, factor: float) -> Machine:
    return Machine({(0, symbol): (1, 1.0, 0.0), (1, symbol): (1, factor, 0.0)}, {0: (0, 1.0), 1: (1, factor)})


def followed_by(first: int, second: int, reach: int, amount: float) -> Machine:
    """An amount when ``second`` comes within ``reach`` symbols after ``first``."""
    arcs = {(s, first): (reach, 1.0, 0.0) for s in range(reach + 1)}
    arcs |= {(s, second): (0, 1.0, amount) for s in range(1, reach + 1)}
    return Machine(arcs, {s: (s - 1, 1.0) for s in range(1, reach + 1)} | {0: (0, 1.0)})


def repeated(symbol: int, factor: float) -> Machine:
    """From the second on, ``symbol`` weighs more."""
    return Machine({(0, symbol): (1, 1.0, 0.0), (1, symbol): (1, factor, 0.0)}, {0: (0, 1.0), 1: (1, 1.0)})


GRAMMAR = (
    repeated(INSULT, 1.2),
    followed_by(THREAT, TARGET, 3, 2.0),
    followed_by(INSULT, TARGET, 3, 0.5),
    within(TARGET, 3, 1.3),
    within(NEGATION, 3, 0.6),
    rest_of_clause(REPORT, 0.6),
)


class Composed:
    """The product of machines; its arcs are made when first taken."""

    def __init__(self, machines: tuple[Machine, ...]) -> None:
        self.machines, self.start = machines, (0,) * len(machines)
        self._arcs: dict[tuple, tuple[tuple, float, float]] = {}

    def clause(self, symbols: list[int], weights: list[float]) -> float:
        state, total = self.start, 0.0
        for symbol, weight in zip(symbols, weights):
            arc = self._arcs.get((state, symbol))
            if arc is None:
                steps = [m.step(s, symbol) for m, s in zip(self.machines, state)]
                arc = tuple(s[0] for s in steps), math.prod(s[1] for s in steps), sum(s[2] for s in steps)
                self._arcs[state, symbol] = arc
            state, factor, amount = arc
            total += weight * factor + amount
        return total


@dataclass
class Model:
    """Weights of insult words ("word$") and stems, and of the curve; small enough to travel with every task."""

    lexicon: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = ()


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.machine = model, Composed(GRAMMAR)
        self._fixed = {w: (symbol, 0.0) for symbol, words in WORDS.items() for w in words.split()}
        self._kept: dict[str, tuple[int, float]] = {}
        self._kept.update(self._fixed)

    def _read(self, token: str) -> tuple[int, float]:
        """Symbol and weight of a word: the fixed lists come first, then its own weight if it was learnt, then its
        longest stem's."""
        lexicon = self.model.lexicon
        weight = lexicon.get(token + "$")
        if weight is None:
            for n in sorted(STEMS, reverse=True):
                if len(token) >= n and (weight := lexicon.get(token[:n])) is not None:
                    break
        found = (INSULT, weight) if weight is not None else (OTHER, 0.0)
        if len(self._kept) >= KEPT_WORDS:
            self._kept.clear()
            self._kept.update(self._fixed)
        if len(token) <= 40:
            self._kept[token] = found
        return found

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses that match at all, and the number of words of the text."""
        tokens = TOKEN.findall(text.lower())
        kept, read = self._kept.get, self._read
        marks = [kept(t) or read(t) for t in tokens]
        words = len(tokens)
        if not any(m[0] in (INSULT, THREAT) for m in marks):
            return [], words
        scores, symbols, weights, matters = [], [], [], False
        for token, (symbol, weight) in zip(tokens, marks):
            if token in ENDS:
                if matters and (score := self.machine.clause(symbols, weights)) > 0:
                    scores.append(score)
                symbols, weights, matters = [], [], False
            else:
                symbols.append(symbol)
                weights.append(weight)
                matters = matters or symbol in (INSULT, THREAT)
        if matters and (score := self.machine.clause(symbols, weights)) > 0:
            scores.append(score)
        return scores, words

    def features(self, text: str) -> list[float]:
        scores, words = self.clauses(text)
        total = sum(scores)
        share = total / (words + 20)
        return [math.log1p(total), math.sqrt(share), max(scores, default=0.0), math.log1p(len(scores)),
                math.sqrt(len(scores) / (words + 20))]

    def score(self, text: str) -> float:
        if not self.model.curve:
            return 0.0
        return float(probability(np.array(self.features(text)), np.array(self.model.curve)))


def learn(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = LEARN_PER_CLASS) -> Model:
    """Lexicon and curve from labelled documents for which ``use`` (a condition on labels) holds.

    Of near copies in the sample, those that share the least hash of their word runs, only one is counted, so that a
    passage copied between toxic documents does not become a list of insults.
    """
    sample = labelled_sample(docs, labels, "toxic", use, per_class, "toxicity-sample")

    def mark(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, label in rows:
            words = text.lower().split()
            runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
            yield doc_id, text, label, min(xxhash.xxh64_intdigest(r) for r in runs) >> 1

    marked = materialize(map_rows(sample.select("doc_id", "text", "label"), mark,
                                  "doc_id bigint, text string, label int, run bigint"), "toxicity-marked")
    single = marked.groupBy("run", "label").agg(F.min("doc_id").alias("doc_id"))
    single = materialize(marked.join(F.broadcast(single.select("doc_id")), "doc_id", "left_semi"), "toxicity-single")
    sizes = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()

    def grams(rows: Iterator[tuple]) -> Iterator[tuple]:
        toxic, other = Counter(), Counter()
        for text, label in rows:
            words = {w for w in TOKEN.findall(text.lower()) if 3 <= len(w) <= 24}
            (toxic if label else other).update({w + "$" for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n})
            if len(toxic) + len(other) > COUNTED_WORDS:
                yield from ((g, toxic[g], other[g]) for g in toxic.keys() | other.keys())
                toxic, other = Counter(), Counter()
        yield from ((g, toxic[g], other[g]) for g in toxic.keys() | other.keys())

    counted = map_rows(single.select("text", "label"), grams, "gram string, toxic bigint, other bigint")
    ratio = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("other") + 0.5) / (sizes[0] + 1))
    best = (counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
            # words of the fixed lists are never read as insults
            .where(~F.col("gram").isin([w + "$" for words in WORDS.values() for w in words.split()]))
            .where((F.col("toxic") >= max(SUPPORT, SUPPORT_SHARE * sizes[1])) & (ratio >= RATIO))
            .select("gram", F.log(ratio).alias("weight"), (F.log(ratio) * F.col("toxic")).alias("gain"))
            .orderBy(F.desc("gain"), "gram").limit(LEXICON).collect())
    model = Model({w + "$": INSULT_WEIGHT for w in INSULTS.split()} | {r["gram"]: r["weight"] for r in best})

    def measure(rows: Iterator[tuple]) -> Iterator[tuple]:
        scorer = Scorer(model)
        return ((label, scorer.features(text)) for text, label in rows)

    rows = map_rows(marked.select("text", "label"), measure, "label int, features array<double>").collect()
    model.curve = tuple(logistic(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])).tolist())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text. A map: no shuffle."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        one = Scorer(model).score
        return ((doc_id, one(text)) for doc_id, text in rows)

    return map_rows(text_rows(docs), each, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """``docs`` without the rows whose texts score ``threshold`` or more."""

    def keep():
        one = Scorer(model).score
        return lambda text: one(text) < threshold

    return keep_rows(docs, keep)
