"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows labelled 1; the unlabelled texts are all documents.  Both meet the
risk only through sums over their features (with the squared loss the risk is a quadratic form), so one
pass over the whole corpus gives the exact risk, whatever its size, and no negative is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, discard, materialise, slices, table, texts
from graphloom.llm._training import SAMPLE_ROWS, held_out, training_rows
from graphloom.llm._words import LOWER, NOT_SPACE, byte_class, words_of

_UPPER = byte_class((0x41, 0x5A))
_DIGIT = byte_class((0x30, 0x39))
_SYMBOL = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_PLAIN = byte_class((0x2C, 0x2C), (0x2E, 0x2E))  # comma and full stop
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: What `features` measures, in order.
FEATURES = (
    "log words", "mean word length", "longest word (log)", "share of upper case", "share of digits", "share of symbols but , and .", "share of , and .",
    "share of words without a letter", "share of words like the one before", "share of different words (of sqrt)", "share of the commonest word", "words a line (log)", "share of non-ASCII",
)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text (null: empty)."""
    out = np.zeros((len(column), len(FEATURES)))
    for low, high in slices(column):
        buf, off = texts(column.slice(low, high - low))
        n_bytes = np.maximum(np.diff(off), 1)
        words = words_of(buf, off, NOT_SPACE, LOWER)
        n = np.diff(words.first)
        some = np.maximum(n, 1)

        def share(kind: np.ndarray, buf=buf, off=off, n_bytes=n_bytes) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(kind[buf], dtype=np.int64)])[off]) / n_bytes

        def per_doc(flags: np.ndarray, words=words, n=n) -> np.ndarray:
            return np.bincount(words.doc, flags, minlength=len(n)) if len(flags) else np.zeros(len(n))

        length = words.ends - words.starts
        longest = np.zeros(len(n))
        np.maximum.at(longest, words.doc, length)
        letters = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
        same = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])])[: len(words.doc)]
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
        at = np.flatnonzero(new)
        commonest = np.zeros(len(n))
        np.maximum.at(commonest, d[at], np.diff(np.append(at, len(h))))
        distinct = np.bincount(d[at], minlength=len(n)) if len(at) else np.zeros(len(n))
        lines = 1 + np.diff(np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int64)])[off])
        out[low:high] = np.column_stack([
            np.log1p(n), per_doc(length) / some, np.log1p(longest), share(_UPPER), share(_DIGIT), share(_SYMBOL & ~_PLAIN), share(_PLAIN),
            per_doc(letters[words.ends] == letters[words.starts]) / some, per_doc(same) / some, distinct / some**0.85, commonest / some, np.log1p(n / lines), share(byte_class((0x80, 0xFF))),
        ])
    return out


#: Quantiles of every feature over all documents, between which the model is constant.
QUANTILES = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99)
#: Cells of the histograms that the class prior is estimated from.
CELLS = 2000
_RIDGE = 1e-3


@dataclass
class Steps:
    """A row of features as indicators, one of each feature's intervals; knots: bounds of each feature's intervals."""

    knots: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(len(k) + 1 for k in self.knots) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, -1], at, rows = 1.0, 0, np.arange(len(x))
        for k, bounds in enumerate(self.knots):
            out[rows, at + np.searchsorted(bounds, x[:, k])] = 1.0
            at += len(bounds) + 1
        return out


@dataclass
class Moments:
    """n rows, the sum of their indicators and of the products of pairs of them."""

    n: float
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray) -> Moments:
        return cls(len(z), z.sum(0), z.T @ z)

    def squares(self, w: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean of (1 + sign * z w)^2 / 4 and its gradient."""
        mean, pairs = self.first / self.n, self.second / self.n
        return float(1 + 2 * sign * mean @ w + w @ pairs @ w) / 4, (sign * mean + pairs @ w) / 2


def minimise(positive: Moments, unlabelled: Moments, prior: float, steps: int = 3000, rate: float = 0.02) -> np.ndarray:
    """Weights of the least non-negative risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), squared loss, a small ridge.

    It starts at the least of the unbiased risk, which has a closed form.  Where the second part is below
    zero there, its gradient is turned round until it isn't (Adam steps on the exact risk).
    """
    k = len(unlabelled.first)
    ridge = _RIDGE * np.eye(k)
    w = np.linalg.solve(unlabelled.second / unlabelled.n / 2 + ridge, prior * positive.first / positive.n - unlabelled.first / unlabelled.n / 2)
    m, v = np.zeros(k), np.zeros(k)
    for step in range(1, steps + 1):
        (_, plus), (ru, gu), (rp, gp) = positive.squares(w, -1), unlabelled.squares(w, 1), positive.squares(w, 1)
        below = ru - prior * rp < 0
        g = -(gu - prior * gp) if below else prior * plus + gu - prior * gp + ridge @ w
        if not below and np.abs(g).max() < 1e-7:
            break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) / np.sqrt(step)
    return w


def density_ratio(positive: Moments, unlabelled: Moments) -> np.ndarray:
    """Weights of the least-squares fit of the density of positives over that of all documents."""
    return np.linalg.solve(unlabelled.second / unlabelled.n + _RIDGE * np.eye(len(unlabelled.first)), positive.first / positive.n)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from histograms (cell counts) of a score over positives and over all documents.

    Above any cut the share of all documents is at least the prior times the share of positives, so the
    least ratio of the two, with an allowance for sampling error, bounds the prior from above; it is met where
    a cut leaves positives alone.
    """
    over = lambda counts: np.cumsum(counts[::-1])[::-1]
    n_p, n_u = positive.sum(), unlabelled.sum()
    q_p, q_u = over(positive) / n_p, over(unlabelled) / n_u
    error = np.sqrt(np.log(20.0) / (2 * n_p)) + np.sqrt(np.log(20.0) / (2 * n_u))
    use = q_p > 0.2
    best = int(np.argmin(np.where(use, (q_u + error) / np.maximum(q_p, 1e-9), np.inf)))
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.99))


def choose_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> int:
    """The cell from which on documents count as positive: in the middle of the cuts whose non-negative risk of counting errors is least but for sampling error."""
    over = lambda counts: np.append(np.cumsum(counts[::-1])[::-1], 0) / counts.sum()
    q_p, q_u = over(positive), over(unlabelled)
    risk = prior * (1 - q_p) + np.maximum(0.0, q_u - prior * q_p)
    least = np.flatnonzero(risk <= risk.min() + 0.25 / np.sqrt(positive.sum()))
    return int(least[len(least) // 2])


@dataclass
class QualityModel:
    """weights of the steps; cut: what the fitted value of a document with equal chances is."""

    steps: Steps
    weights: np.ndarray
    cut: float
    prior: float

    def value(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; 0.5 at the cut, and straight lines to the ends of the values' range on both sides."""
        v = np.clip(self.value(x), -1.5, 1.5)
        return np.where(v >= self.cut, 0.5 + 0.5 * (v - self.cut) / (1.5 - self.cut), 0.5 * (v + 1.5) / (self.cut + 1.5))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes x, its features."""
    for batch in batches:
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(list(features(batch.column(batch.num_columns - 1))), pa.list_(pa.float64()))], [*names, "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _moments(steps: Steps):
    """Sums of this task: k (place in the flat list of n, first and second) and s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(1 + steps.width + steps.width**2)
        for batch in batches:
            m = Moments.of(steps(_matrix(batch.column(0))))
            flat += np.concatenate([[m.n], m.first, m.second.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["k", "s"])

    return run


def _cell(value: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((value - low) / max(high - low, 1e-12) * CELLS, 0, CELLS - 1).astype(np.int64)


def _histogram(value: Callable[[np.ndarray], np.ndarray], low: float, high: float):
    """Cell counts of this task: k and s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS)
        for batch in batches:
            counts += np.bincount(_cell(value(_matrix(batch.column(0))), low, high), minlength=CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["k", "s"])

    return run


def _summed(x: DataFrame, run, size: int) -> np.ndarray:
    """What the tasks return, added up by place: `size` numbers reach the driver."""
    out = np.zeros(size)
    found = x.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").toArrow()
    out[found.column("k").to_numpy()] = found.column("s").to_numpy()
    return out


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and x, the features of the whole text (null: empty), in a scratch table."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(_featured, rows.drop("text").withColumn("x", F.array(F.lit(0.0))).schema), "features")


def fit_features(unlabelled: DataFrame, positive: np.ndarray) -> QualityModel | None:
    """Fit on the features of trusted positives (in no order that tells of them) and of all documents (column x); None without either.

    The intervals of the features come from quantiles over all documents, the class prior from the ratio of
    densities of positives and of all documents, the cut from the non-negative risk.
    """
    x = unlabelled.select("x")
    if not len(positive) or x.isEmpty():
        return None
    quantiles = x.agg(*[F.percentile_approx(F.get("x", F.lit(k)), list(QUANTILES), 1000).alias(f"q{k}") for k in range(len(FEATURES))]).first()
    steps = Steps([np.unique(q) for q in quantiles])
    z, k = steps(positive), steps.width
    flat = _summed(x, _moments(steps), 1 + k + k * k)
    p, u = Moments.of(z), Moments(flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k))

    def histograms(w: np.ndarray, z: np.ndarray = z) -> tuple[np.ndarray, np.ndarray, float, float]:
        ends = [(w[a:b].min(), w[a:b].max()) for a, b in zip(bounds, bounds[1:], strict=False)]
        low, high = (float(w[-1] + sum(e[j] for e in ends)) for j in (0, 1))
        spread = np.bincount(_cell(z @ w, low, high), minlength=CELLS).astype(float)
        return spread, _summed(x, _histogram(lambda rows: steps(rows) @ w, low, high), CELLS), low, high

    bounds = np.concatenate([[0], np.cumsum([len(b) + 1 for b in steps.knots])])
    # half of the positives fit the ratio and the other half measure it, as a fit flatters its own rows
    halves = [(z[::2], z[1::2]), (z[1::2], z[::2])] if len(z) > 1 else [(z, z)]
    prior = float(np.mean([estimate_prior(*histograms(density_ratio(Moments.of(a), u), b)[:2]) for a, b in halves]))
    w = minimise(p, u, prior)
    of_p, of_u, low, high = histograms(w)
    cut = low + choose_cut(of_p, of_u, prior) * (high - low) / CELLS
    return QualityModel(steps, w, float(np.clip(cut, -1.4, 1.4)), prior)


def positives_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Features of the trusted positives among at most `rows` labelled texts outside the held-out third, in an order that doesn't depend on the table's."""
    known = training_rows(docs, labels, "quality", rows).where("label = 1").select("text").mapInArrow(_featured, "x array<double>")
    found = [r["x"] for r in known.collect()]
    return np.random.default_rng(5).permutation(np.array(sorted(found)).reshape(-1, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Fit on at most `rows` labelled texts, of which only those labelled 1 are used, and on all documents; None without positives."""
    bounded_batches(docs.sparkSession)
    positive = positives_of(docs, labels, rows)
    if not len(positive):
        return None
    unlabelled = with_features(docs)
    model = fit_features(unlabelled, positive)
    discard(unlabelled)
    return model


def _scored(model: QualityModel | None, of: str):
    """quality_score from the features (of: x) or from the text (of: text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = model(_matrix(batch.column("x")) if of == "x" else features(batch.column("text")))
            keep = [c for c in batch.schema.names if c not in ("quality_score", *([of] if of == "x" else []))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64())], [*keep, "quality_score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """docs (with a column text) and quality_score, 0 to 1 and 0.5 where good and bad are as likely; replaces a column of that name.

    Null texts are scored as empty ones; without a model every score is 0.5.  No other column is read.
    """
    bounded_batches(docs.sparkSession)
    df = docs.drop("quality_score")
    return df.mapInArrow(_scored(model, "text"), df.withColumn("quality_score", F.lit(0.0)).schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the quality of every document; features are measured once, for the fit and for the scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = with_features(docs, "doc_id")
    model = fit_features(measured, positives_of(docs, table(spark, sf_dir, "labels")))
    scored = measured.mapInArrow(_scored(model, "x"), measured.drop("x").withColumn("quality_score", F.lit(0.0)).schema)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
