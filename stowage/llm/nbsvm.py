"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of hashed n-grams: byte n-grams, and n-grams of word shapes (case, symbols, repetition).
Indicators are scaled by the classes' log-count ratios; a linear hinge-loss model over them is fitted by dual coordinate
descent; a logistic curve over cross-fitted margins turns a margin into a probability.

Defined cases: a null or empty text has no indicators, so its score is the intercept's; repeated rows score alike;
texts of any length are read whole; an empty table gives an empty table; without labels of both classes every score is
the prior (0.5 without any label). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held_out, mapped, table
from .labelled import in_parts, logistic, sample
from .vectext import SPACE, SYMBOL, Pieces, Texts, chunks, hashes, mix, repeats

BITS = 18
BYTE_NGRAMS = (1, 2, 3)
SHAPE_NGRAMS = (1, 2, 3, 4)

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 4
_CLASS[SYMBOL] = 8
_CLASS[[ord(c) for c in "!?"]] = 16
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 32


def indicators(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the feature numbers of all texts in order, and where each text's begin. A feature may repeat within a text."""
    out = []

    def add(code: np.ndarray, row: np.ndarray) -> None:
        feature = (mix(code) & np.uint64((1 << BITS) - 1)).astype(np.int32)
        out.append((feature, np.searchsorted(row, np.arange(texts.n + 1))))

    data, row = texts.data, texts.rows()
    grown = data.astype(np.uint64)
    for n in BYTE_NGRAMS:
        m = len(data) - n + 1
        if m <= 0:
            break
        code = grown[:m]
        for k in range(1, n):
            code = (code << np.uint64(8)) | grown[k : k + m]
        ok = row[:m] == row[n - 1 :]
        add(code[ok] + (np.uint64(n) << np.uint64(40)), row[:m][ok])
    p = Pieces(texts, ~SPACE[data])
    if len(p):
        shape = np.bitwise_or.reduceat(_CLASS[data], p.start).astype(np.uint64)  # bytes between words have class 0
        first = ((_CLASS[data[p.start]] == 2).astype(np.uint64)) << np.uint64(6)
        h = hashes(data, p)
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (p.row[1:] == p.row[:-1])))
        shape |= first | (same.astype(np.uint64) << np.uint64(7))
        again = np.zeros(len(h), np.uint64)  # whether the three words from here on stand in the text elsewhere
        inside = np.flatnonzero(p.row[:-2] == p.row[2:])
        trio = h[inside] * np.uint64(3) + h[inside + 1] * np.uint64(5) + h[inside + 2] * np.uint64(7)
        again[inside] = repeats(trio, p.row[inside])[1]
        shape |= again << np.uint64(8)
        for n in SHAPE_NGRAMS:
            m = len(shape) - n + 1
            if m <= 0:
                break
            code = shape[:m]
            for k in range(1, n):
                code = (code << np.uint64(9)) | shape[k : k + m]
            ok = p.row[:m] == p.row[n - 1 :]
            add(code[ok] + (np.uint64(n + 100) << np.uint64(48)), p.row[:m][ok])
    return out


class Distinct:
    """The distinct features of a text in linear time: a scratch table remembers who wrote last."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        i = np.arange(len(f), dtype=np.int32)
        self.last[f] = i
        return f[self.last[f] == i]

    def rows(self, texts: Texts):
        """The distinct features of each text."""
        kinds = [(f, at.tolist()) for f, at in indicators(texts)]
        for i in range(texts.n):
            yield self(np.concatenate([f[at[i] : at[i + 1]] for f, at in kinds])) if kinds else np.zeros(0, np.int32)


@dataclass
class Model:
    """A linear model over indicators scaled by the ratios, each text's row brought to unit length, as it was when the model was fitted."""

    weights: np.ndarray  # of the indicators: the model's weights times the ratios
    squares: np.ndarray  # of the ratios
    slope: float
    offset: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))

    def margins(self, texts: Texts) -> np.ndarray:
        return np.array([margin(f, self.weights, self.squares) for f in Distinct().rows(texts)])


def margin(f: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> float:
    """The margin of a text with the features f."""
    return float(weights[f].sum() / (np.sqrt(squares[f].sum()) + 1e-9))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 0.05, rounds: int = 20, least: float = 1e-4) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model over unit rows x, proportional to r at each row's features, times r; classes weigh alike."""
    norm = [1 / (np.sqrt((r[f] ** 2).sum()) + 1e-9) for f in rows]
    w = np.zeros(len(r))
    alpha = np.zeros(len(rows))
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, s = rows[i], norm[i]
            rf = r[f]
            g = y[i] * (w[f] * rf).sum() * s - 1
            new = min(max(alpha[i] - g, 0.0), cost[i])  # x'x is 1
            if (d := new - alpha[i]) != 0:
                alpha[i] = new
                w[f] += d * y[i] * s * rf
                moved = max(moved, abs(d))
        if moved < least:
            break
    return w * r


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratios of the indicators, with one count added."""
    out = []
    for sign in (1, -1):
        n = np.ones(1 << BITS)
        for f, t in zip(rows, y):
            if t == sign:
                n[f] += 1
        out.append(n / n.sum())
    return np.log(out[0] / out[1])


def fit(examples: list[tuple[str, int]]) -> Model:
    """The model, and its curve from margins of the third of the examples that each of three models hasn't seen."""
    y = np.array([1 if label else -1 for _, label in examples])
    if len(set(y.tolist())) < 2:
        prior = {1: 4.0, -1: -4.0}.get(int(y[0]) if len(y) else 0, 0.0)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 1.0, prior)
    rows = [f for part in in_parts([t for t, _ in examples]) for f in Distinct().rows(Texts(pa.array(part, pa.large_string())))]

    def train(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = [rows[i] for i in which]
        r = _ratios(part, y[which])
        return dual_descent(part, y[which], r).astype(np.float32), (r * r).astype(np.float32)

    fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        w, squares = train(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = margin(rows[i], w, squares)
    slope, offset = logistic(margins[:, None], (y > 0).astype(float))
    return Model(*train(np.arange(len(y))), float(slope), float(offset))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs (its columns `carry`, all by default) with score and predicted of each whole text."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB: two numbers for each of 2^18 features

    def each(batch: pa.RecordBatch):
        for part in chunks(batch, "__text", 1 << 20):
            s = sent.value.score(sent.value.margins(Texts(part.column(part.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    frame = docs.select(*[docs[c] for c in kept], docs["text"].cast("string").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return mapped(frame, each, f"{fields}score double, predicted int")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, carry: list[str] | None = None) -> DataFrame:
    """docs scored by a model fitted on the labels of sf_dir."""
    return score(docs, fit(sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")), carry)


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    out = quality(spark, docs, sf_dir, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")

