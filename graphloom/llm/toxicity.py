"""Toxicity by a weighted finite-state pattern grammar.

Five weighted transducers read the tokens of a clause as symbols and mark or weigh them: reported speech,
negation, targets, threats and insults.  They are composed into one machine; the best path through it gives
the clause its evidence, so what scores is a matched clause and not an isolated word: a threat without a
target weighs nothing, a negated or reported insult weighs less, one aimed at somebody more.  The lexicon
and the factors on the arcs are learnt from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, discard, materialise, table
from graphloom.llm._training import SAMPLE_ROWS, Logistic, held_out, sigmoid, training_rows

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_CLAUSE_END = frozenset(".!?;\n")
#: Seeds of the grammar; labels change the weights of those that they show.
INSULTS = "idiot moron stupid scum loser imbecile pathetic worthless disgusting dumb idiota estúpido imbécile dummkopf trottel crétin".split()
THREATS = "kill hurt destroy murder beat shoot stab töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yourself he she they him her them du dich dein dir ihr euch tu te toi vous il elle usted ustedes él ella".split()
NEGATIONS = "not no never neither nor nicht kein keine nie pas jamais ni nunca tampoco".split()
REPORTS = "said says say wrote writes claimed claims called according sagte sagt schrieb dit disait écrit dijo dice escribió".split()
INTENTS = "will gonna shall should must going werde wirst soll vais va devrait voy vas debería".split()
SEED_WEIGHT = 2.0

#: Symbols that the transducers read, and marks that they add to them.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
AIMED, NEGATED, REPORTED, MEANT = 8, 16, 32, 64
#: Tokens that a target, a negation or an intent covers.
REACH = 3
#: Factors on the arcs before any label is seen, and how many documents this counts for.
FACTORS = {"aimed": 1.5, "negated": 0.4, "reported": 0.5, "threat": 1.0}
_TRUST = 20
#: What the labels can make of a factor; a negated or reported insult never weighs as much as a plain one.
_LIMITS = {"aimed": (1.0, 3.0), "negated": (0.05, 0.9), "reported": (0.05, 0.9), "threat": (0.1, 2.0)}
_MEANT = 1.5

Moves = Callable[[tuple, int], Iterable[tuple[int, float, tuple]]]


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol]: output, factor and next state of every arc; state 0 is the start.

    A path weighs the sum, over its symbols, of the symbol's own weight times the factor of the arc.
    """

    arcs: tuple[dict[int, tuple[tuple[int, float, int], ...]], ...]
    final: frozenset[int]

    @classmethod
    def build(cls, start: tuple, alphabet: Iterable[int], moves: Moves, final: Callable[[tuple], bool]) -> Transducer:
        """The machine of all states that can be reached from start."""
        numbers, order, arcs, alphabet = {start: 0}, [start], [], list(alphabet)
        for state in order:  # grows on the way
            found = {}
            for symbol in alphabet:
                out = []
                for output, factor, to in moves(state, symbol):
                    if to not in numbers:
                        numbers[to] = len(order)
                        order.append(to)
                    out.append((output, factor, numbers[to]))
                if out:
                    found[symbol] = tuple(out)
            arcs.append(found)
        return cls(tuple(arcs), frozenset(k for k, state in enumerate(order) if final(state)))

    @property
    def outputs(self) -> list[int]:
        return sorted({output for state in self.arcs for arcs in state.values() for output, _, _ in arcs})

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: other reads what this machine writes; factors multiply."""

        def moves(state: tuple, symbol: int) -> Iterator[tuple[int, float, tuple]]:
            for middle, f, a in self.arcs[state[0]].get(symbol, ()):
                for output, g, b in other.arcs[state[1]].get(middle, ()):
                    yield output, f * g, (a, b)

        alphabet = sorted({symbol for state in self.arcs for symbol in state})
        return Transducer.build((0, 0), alphabet, moves, lambda s: s[0] in self.final and s[1] in other.final)

    def best(self, symbols: Iterable[tuple[int, float]]) -> list[tuple[int, float]]:
        """Output and weight of every symbol of the heaviest path that weighs something."""
        beam: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for symbol, weight in symbols:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (total, path) in beam.items():
                for output, factor, to in self.arcs[state].get(symbol, ()):
                    value = total + factor * weight
                    if to not in after or value > after[to][0]:
                        after[to] = (value, (path, output, factor * weight) if weight else path)
            beam = after
        ends = [v for state, v in beam.items() if state in self.final]
        path = max(ends, key=lambda v: v[0])[1] if ends else None
        out = []
        while path:
            out.append((path[1], path[2]))
            path = path[0]
        return out[::-1]


def _evidence(symbol: int) -> bool:
    return symbol & 7 in (INSULT, THREAT)


def reported_speech(factor: float) -> Transducer:
    """What follows a verb of report in a clause is somebody else's word."""

    def moves(state: tuple, symbol: int) -> Iterator[tuple[int, float, tuple]]:
        said = state[0]
        yield (symbol | REPORTED, factor, state) if said and _evidence(symbol) else (symbol, 1.0, (said or symbol == REPORT,))

    return Transducer.build((False,), range(7), moves, lambda s: True)


def negation(alphabet: Iterable[int], factor: float) -> Transducer:
    """A negation covers the REACH tokens after it."""

    def moves(state: tuple, symbol: int) -> Iterator[tuple[int, float, tuple]]:
        left = max(0, state[0] - 1)
        yield (symbol | NEGATED, factor, (left,)) if state[0] and _evidence(symbol) else (symbol, 1.0, (REACH if symbol == NEGATION else left,))

    return Transducer.build((0,), alphabet, moves, lambda s: True)


def targets(alphabet: Iterable[int], factor: float) -> Transducer:
    """Evidence is aimed if a target stands within REACH tokens before it, or after it (a guess that only a target redeems)."""

    def moves(state: tuple, symbol: int) -> Iterator[tuple[int, float, tuple]]:
        behind, owed = state
        if symbol == TARGET:
            yield symbol, 1.0, (REACH, 0)
            return
        if owed == 1:  # the guess was wrong
            return
        after = (max(0, behind - 1), max(0, owed - 1))
        if not _evidence(symbol):
            yield symbol, 1.0, after
        elif behind or owed:
            yield symbol | AIMED, factor, after
        else:
            yield symbol, 1.0, after
            yield symbol | AIMED, factor, (after[0], REACH + 1)

    return Transducer.build((0, 0), alphabet, moves, lambda s: not s[1])


def threats(alphabet: Iterable[int], factor: float) -> Transducer:
    """A threat counts if it is aimed at somebody, and more within REACH tokens after a word of intent."""

    def moves(state: tuple, symbol: int) -> Iterator[tuple[int, float, tuple]]:
        left = max(0, state[0] - 1)
        if symbol & 7 == THREAT:
            meant = state[0] > 0
            yield symbol | MEANT * meant, (factor * (_MEANT if meant else 1.0) if symbol & AIMED else 0.0), (left,)
        else:
            yield symbol, 1.0, (REACH if symbol == INTENT else left,)

    return Transducer.build((0,), alphabet, moves, lambda s: True)


def insults(alphabet: Iterable[int]) -> Transducer:
    """Insults pass with their own weight."""
    return Transducer.build((), alphabet, lambda state, symbol: [(symbol, 1.0, state)], lambda s: True)


def composed(factors: dict[str, float]) -> Transducer:
    """The five transducers as one."""
    makers = [lambda a: negation(a, factors["negated"]), lambda a: targets(a, factors["aimed"]), lambda a: threats(a, factors["threat"]), insults]
    return reduce(lambda machine, make: machine @ make(machine.outputs), makers, reported_speech(factors["reported"]))


def kind_of(output: int) -> str:
    """Class of a piece of evidence by its marks."""
    if output & REPORTED:
        return "reported"
    if output & NEGATED:
        return "negated"
    if output & 7 == THREAT:
        return "threat"
    return "aimed" if output & AIMED else "plain"


#: Letters of a stem.
_STEMS = (4, 5, 6)


@dataclass
class Grammar:
    """insults and threats: words with weights (log-odds); stems: beginnings of insults; factors: of the arcs."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, SEED_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    @cached_property
    def machine(self) -> Transducer:
        return composed(self.factors)

    @cached_property
    def _roles(self) -> dict[str, tuple[int, float]]:
        roles = {}
        for words, symbol in ((INTENTS, INTENT), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET)):
            roles.update(dict.fromkeys(words, (symbol, 0.0)))
        roles.update({w: (THREAT, v) for w, v in self.threats.items()})
        return roles | {w: (INSULT, v) for w, v in self.insults.items()}

    def symbol(self, token: str) -> tuple[int, float]:
        """Symbol and weight of a token."""
        found = self._roles.get(token)
        if found is None:
            weight = max((self.stems.get(token[:n], 0.0) for n in _STEMS if len(token) > n), default=0.0) if self.stems else 0.0
            found = (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        return found

    def clause(self, tokens: list[str]) -> list[tuple[str, float]]:
        """Class and weight of each piece of evidence in a clause."""
        symbols = [self.symbol(t) for t in tokens]
        return [(kind_of(output), weight) for output, weight in self.machine.best(symbols)] if any(w for _, w in symbols) else []

    def matched(self, text: str) -> list[tuple[str, list[tuple[str, float]]]]:
        """The matched clauses of a text with their evidence."""
        tokens = _TOKEN.findall(text.lower())
        if not any(self.symbol(t)[1] for t in set(tokens)):
            return []
        out, clause = [], []
        for token in [*tokens, "."]:
            if token not in _CLAUSE_END:
                clause.append(token)
            elif clause:
                if found := [e for e in self.clause(clause) if e[1] > 0]:
                    out.append((" ".join(clause), found))
                clause = []
        return out

    def features(self, text: str) -> list[float]:
        """Total weight of the matched clauses (log scale), and the heaviest clause (log scale)."""
        weights = [sum(w for _, w in found) for _, found in self.matched(text)]
        return [math.log1p(sum(weights)), math.log1p(max(weights, default=0.0))]


def _units(text: str) -> set[str]:
    """Words and stems ('stem*') of a text."""
    words = {t for t in _TOKEN.findall(text.lower()) if len(t) > 2}
    return words | {f"{w[:n]}*" for w in words for n in _STEMS if len(w) > n}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each label a unit occurs, by batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for unit in _units(text):
                counts.setdefault(unit, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["unit", "clean", "toxic"]
        )


#: Units that a learnt lexicon holds at most (the strongest ones); a bound of the model, not of the texts.
LEXICON = 20_000


def learn_lexicon(rows: DataFrame, most: int = LEXICON, least_odds: float = 1.5) -> Grammar:
    """A grammar whose insults are the units that mark label 1: the lower bound of their log-odds is at least least_odds.

    rows: text, label.  A seed that the labels show is weighed by them as well; a stem stays only if it marks
    documents beside those of any one word with it.
    """
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    units = rows.mapInArrow(_counted, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    low = (F.col("t") - 1.64 * F.sqrt("t")) / toxic
    high = (F.col("c") + 1.64 * F.sqrt("c") + 1) / clean
    odds = F.log(low / high)
    seed = F.col("unit").isin(INSULTS + THREATS)
    strong = (F.col("t") >= 4) & (low > 0) & (odds >= least_odds) & (F.col("t") / toxic >= 8 * F.col("c") / clean)
    found = units.where(strong | seed).select("unit", "c", "t", odds.alias("odds"), strong.alias("strong")).orderBy(F.desc("strong"), F.desc("odds"), "unit").limit(most).collect()
    grammar = Grammar()
    explained: dict[str, int] = {}
    for r in found:
        if r["unit"] in grammar.insults or r["unit"] in grammar.threats:
            words = grammar.insults if r["unit"] in grammar.insults else grammar.threats
            seen = max(0.0, math.log((r["t"] + 0.5) / toxic / ((r["c"] + 0.5) / clean)))
            words[r["unit"]] = (5 * SEED_WEIGHT + (r["c"] + r["t"]) * seen) / (5 + r["c"] + r["t"])
        elif r["strong"] and not r["unit"].endswith("*"):
            grammar.insults[r["unit"]] = r["odds"]
        for k in _STEMS:
            if len(r["unit"]) > k and not r["unit"].endswith("*"):
                explained[r["unit"][:k]] = max(explained.get(r["unit"][:k], 0), r["t"])
    grammar.stems = {s: r["odds"] for r in found if r["strong"] and r["unit"].endswith("*") and r["t"] - explained.get(s := r["unit"][:-1], 0) >= 4}
    return grammar


def _by_kind(grammar: Grammar):
    """kind (of a document all whose evidence is of one kind; none: without evidence), label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [{k for _, found in grammar.matched(t) for k, _ in found} for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["none" if not k else k.pop() if len(k) == 1 else "mixed" for k in kinds], pa.string()), batch.column(1)], ["kind", "label"])

    return run


def learn_factors(grammar: Grammar, rows: DataFrame) -> Grammar:
    """The grammar with factors between those it has and what documents with evidence of a single kind show, by their number.

    A kind's log-odds of label 1 beyond those of documents without evidence, against the same for plain evidence.
    """
    counts = {r["kind"]: (r["n"], r["t"]) for r in rows.mapInArrow(_by_kind(grammar), "kind string, label int").groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("t")).collect()}

    def odds(kind: str) -> float:
        n, t = counts.get(kind, (0, 0))
        return math.log((t + 0.5) / (n - t + 0.5))

    gain, factors = odds("plain") - odds("none"), dict(grammar.factors)
    for kind, (low, high) in _LIMITS.items():
        n = counts.get(kind, (0, 0))[0]
        if n and gain > 0:
            seen = min(high, max(low, (odds(kind) - odds("none")) / gain))
            factors[kind] = (_TRUST * grammar.factors[kind] + n * seen) / (_TRUST + n)
    return Grammar(grammar.insults, grammar.threats, grammar.stems, factors)


@dataclass
class ToxicityModel:
    grammar: Grammar
    calibration: Logistic | None

    def scores(self, column: pa.Array) -> np.ndarray:
        x = np.array([self.grammar.features(t.as_py() or "") for t in column], float).reshape(-1, 2)
        if self.calibration is None:
            return 1 - np.exp(-np.expm1(x[:, 1]) / 4)
        return self.calibration(x)


class Rising:
    """Logistic scale on one of the features or both, so that more evidence never lowers a score."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        for use in ([0, 1], [0], [1]):
            fitted = Logistic(x[:, use], y)
            slope = fitted.weights[:-1] / fitted.scale
            if (slope > 0).all():
                break
        self.slope = np.zeros(2)
        self.slope[use] = np.maximum(slope, 0.05)
        self.shift = float(fitted.weights[-1] - fitted.mean @ slope)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.slope + self.shift)


def _featured(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn the lexicon, the factors of the arcs and the scale from at most `rows` labelled texts outside the held-out third.

    Without labels of both kinds the seed grammar scores by its heaviest clause.
    """
    bounded_batches(docs.sparkSession)
    known = materialise(training_rows(docs, labels, "toxic", rows), "training")
    grammar = learn_factors(learn_lexicon(known), known)
    frame = known.mapInArrow(_featured(grammar), "x array<double>, label int").toPandas()  # `rows` rows at most
    discard(known)
    if frame["label"].nunique() < 2:
        return ToxicityModel(grammar, None)
    frame = np.array(sorted((*x, y) for x, y in zip(frame["x"], frame["label"], strict=True)))
    return ToxicityModel(grammar, Rising(frame[:, :-1], frame[:, -1]))


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "toxicity_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.scores(batch.column("text")), pa.float64())], [*keep, "toxicity_score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (with a column text) and toxicity_score (0 to 1); replaces a column of that name.  Null texts count as empty; no other column is read."""
    bounded_batches(docs.sparkSession)
    df = docs.drop("toxicity_score")
    return df.mapInArrow(_scored(model), df.withColumn("toxicity_score", F.lit(0.0)).schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.7).cast("int").alias("predicted"))
