"""Toxicity: a linear-chain conditional random field tags toxic spans; forward-backward marginals add up to document scores.

Labels are of whole documents, so the labelled tokens that the chain learns from come by distant supervision, from
learnable rows only: words and word beginnings that are far more usual in toxic texts become a lexicon, picked one
after the other while texts already explained by earlier picks count less; in texts labelled toxic the words of the
lexicon are tagged toxic, everything else isn't. The score is a logistic curve over the noisy-or and the sum of the marginals.

Defined cases: a null or empty text has no tokens and gets the curve's value at zero; repeated rows score alike; a score
at the threshold counts as toxic; very long texts are tagged whole; an empty table gives an empty table; without labels of both classes scores are the prior (0.5 without
any label). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import crf
from .common import ended, held_out, mapped, table
from .labelled import in_parts, logistic, sample
from .vectext import WORDY, Pieces, chunks, hashes, lowered, mix

#: Score from which a document is called toxic, and the marginal from which a token belongs to an offending span.
THRESHOLD = 0.7
SPAN_AT = 0.5
#: Fitting: positions around a lexicon word, and windows at most.
WINDOW = 48
#: How much more usual in toxic texts a word of the lexicon is, at least.
RATIO = 9.0
#: Words whose marginals are computed at once in the fit.
TOGETHER = 1 << 20
_BLOOM = 20
_BUCKETS = 20
#: Word beginnings that are features, in bytes; a word must be longer.
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Model:
    known: np.ndarray  # sorted features that have a weight
    weights: np.ndarray
    rest: float  # emission of every word besides
    chain: crf.Chain
    curve: np.ndarray  # of what gathered() gives, and 1

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        e = np.full(len(features[0]), self.rest)
        if len(self.known):
            seen = np.zeros(1 << _BLOOM, np.bool_)
            seen[(self.known >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True
            for f in features:
                maybe = np.flatnonzero(seen[(f >> np.uint64(64 - _BLOOM)).astype(np.int64)])
                i = np.minimum(np.searchsorted(self.known, f[maybe]), len(self.known) - 1)
                hit = self.known[i] == f[maybe]
                e[maybe[hit]] += self.weights[i[hit]]
        return e

    def document(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of documents from the marginals of their tokens."""
        x = np.column_stack((gathered(p, at), np.ones(len(at) - 1)))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def gathered(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each document: the logs of 1 + the evidence that some token is toxic (minus the log of noisy-or's complement), and of 1 + the expected number."""
    full = np.flatnonzero(np.diff(at))

    def run(x: np.ndarray) -> np.ndarray:  # each document alone, so that equal texts get equal sums
        out = np.zeros(len(at) - 1)
        if len(full):
            out[full] = np.add.reduceat(x, at[:-1][full])
        return out

    return np.log1p(np.column_stack((run(-np.log1p(-np.minimum(p, 1 - 1e-4))), run(p))))


def _evidence(parts: Iterable[tuple[np.ndarray, np.ndarray]], chain: crf.Chain) -> Iterator[np.ndarray]:
    """What gathered() gives for parts of emissions and words of each text, about TOGETHER words at once: the chain takes a step in all texts together."""

    def run() -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in held]))))
        return gathered(crf.marginals(np.concatenate([e for e, _ in held]), at, chain), at)

    held, size = [], 0
    for e, n in parts:
        held.append((e, n))
        size += len(e)
        if size >= TOGETHER:
            yield run()
            held, size = [], 0
    if held:
        yield run()


def _tokens(column: pa.Array):
    """Texts, words, and the words' features: the word, and its beginnings (0 where it is too short)."""
    texts = lowered(column)
    p = Pieces(texts, WORDY[texts.data])
    features, code, size = [hashes(texts.data, p)], np.zeros(len(p), np.uint64), p.stop - p.start
    for k in range(1, max(PREFIXES) + 1):
        longer = size > k
        code[longer] = (code[longer] << np.uint64(8)) | texts.data[p.start[longer] + k - 1]
        if k in PREFIXES:
            features.append(np.where(longer, mix(code ^ np.uint64(k << 60)), np.uint64(0)))
    return texts, p, features


def least(n_toxic: int) -> float:
    """The toxic texts that a word of the lexicon is in, at least."""
    return max(2.0, 0.03 * n_toxic)


def odds(df1: np.ndarray, df0: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How much more usual features are in toxic texts; df1 and df0 count the toxic and other texts that have them."""
    return ((df1 + 0.5) / (int(toxic.sum()) + 1)) / ((df0 + 0.5) / (int((~toxic).sum()) + 1))


def lexicon(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """Sorted features of toxic words; (doc, feature) are the distinct pairs, toxic the documents' labels."""
    names, where = np.unique(feature, return_inverse=True)
    df1, df0 = np.bincount(where, toxic[doc], len(names)), np.bincount(where, ~toxic[doc], len(names))
    enough = least(int(toxic.sum()))
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], np.arange(len(names) + 1))
    members = {int(k): doc[order[first[k] : first[k + 1]]] for k in np.flatnonzero((df1 >= enough) & (odds(df1, df0, toxic) >= ratio)) if names[k]}
    worth, picked = np.where(toxic, 1.0, -0.5), []
    while members:
        gain = {k: worth[d].sum() for k, d in members.items()}
        best = max(gain, key=lambda k: (gain[k], -k))
        if gain[best] < enough:
            break
        mine = members.pop(best)
        picked.append(best)
        worth[mine[toxic[mine]]] *= 0.75
    return np.sort(names[picked]) if picked else names[:0]


def fit(examples: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in examples], np.bool_)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -3.0, crf.Chain(), np.array([0.0, 0.0, 0.0 if not len(y) else 4.0 if y[0] else -4.0]))
    unique = sorted({t: label for t, label in examples}.items())
    y = np.array([label for _, label in unique], np.bool_)
    texts, often = [t for t, _ in unique], least(int(y.sum()))

    def parts():
        """Of each part of the sample, one after the other: its first text, where each text's words begin, the words' texts and features. Only one part is held: the driver has little room."""
        first = 0
        for part in in_parts(texts):
            _, pieces, features = _tokens(pa.array(part, pa.large_string()))
            yield first, pieces.at, pieces.row, features
            first += len(part)
            del pieces, features
            ended()

    def pairs(wanted):
        """Distinct (text, feature) of each part where wanted(text, feature) holds."""
        for first, _, row, features in parts():
            both, doc = np.concatenate(features), np.tile(row, len(features))
            once = np.unique(mix(both + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            doc, both = (doc[once] + first).astype(np.int32), both[once]
            ok = wanted(doc, both)
            yield doc[ok], both[ok]

    bucket = lambda f: (f >> np.uint64(64 - _BUCKETS)).astype(np.int64)
    full = np.zeros(1 << _BUCKETS, np.int32)  # toxic texts by bucket of their features; never less than a feature's own
    for _, f in pairs(lambda doc, f: y[doc]):
        full += np.bincount(bucket(f), minlength=len(full)).astype(np.int32)
    full = full >= often
    names, df = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)  # texts with either label, of features in full buckets
    for doc, f in pairs(lambda doc, f: full[bucket(f)]):
        more, where = np.unique(np.concatenate((names, f)), return_inverse=True)
        df = np.stack([np.bincount(where, np.concatenate((df[k], y[doc] == k)), len(more)) for k in (0, 1)])
        names = more
    names = names[(df[1] >= often) & (odds(df[1], df[0], y) >= RATIO)]  # only these can enter the lexicon
    found = list(pairs(lambda doc, f: np.isin(f, names)))
    words = lexicon(np.concatenate([d for d, _ in found]), np.concatenate([f for _, f in found]), y)
    del full, df, found
    # windows: around all of the lexicon's words, be they tagged or not, and one in the middle of each text
    around, middle, known = [], [], [words]
    for first, at, row, features in parts():
        hit = np.zeros(len(row), np.bool_)
        for f in features:
            hit |= np.isin(f, words)
        label = hit & y[row + first]
        known.extend(np.unique(f[label]) for f in features)
        n = np.diff(at)
        for windows, centre in ((around, np.flatnonzero(hit)), (middle, at[:-1][n > 0] + n[n > 0] // 2)):
            low = np.maximum(centre - WINDOW // 2, at[row[centre]])
            size = np.minimum(centre + WINDOW // 2, at[row[centre] + 1]) - low
            pos = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            windows.append((size, label[pos], [f[pos] for f in features]))
    windows = around + middle
    known = np.unique(np.concatenate(known))
    known = known[known > 0]

    def number(f: np.ndarray) -> np.ndarray:
        i = np.searchsorted(known, f)
        return np.where(np.append(known, 0)[i] == f, i, len(known) + 1)

    label = np.concatenate([x for _, x, _ in windows]).astype(np.float64)
    columns = [np.concatenate([number(f[k]) for _, _, f in windows]) for k in range(len(PREFIXES) + 1)] + [np.full(len(label), len(known))]
    at = np.concatenate(([0], np.cumsum(np.concatenate([size for size, _, _ in windows]))))
    del windows, around, middle
    # numbers: known features, then one for every word, then one for unknown features, which gets no weight
    weights, chain = crf.fit(columns, len(known) + 1, at, label, rounds=200, rate=0.2, ridge=1e-6)
    model = Model(known, weights[:-1], float(weights[-1]), chain, np.zeros(3))
    del columns, label
    model.curve = logistic(np.concatenate(list(_evidence(((model.emissions(features), np.diff(at)) for _, at, _, features in parts()), chain))), y.astype(float))
    return model


def tag(docs: DataFrame, model: Model, carry: list[str] | None = None, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """docs (its columns `carry`, all by default) with score, predicted and, if asked for, spans: [start, end) code points of offending runs."""
    out = ("score", "predicted", "spans")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample

    def each(batch: pa.RecordBatch):
        m = sent.value
        for part in chunks(batch, "__text", 2 << 20):
            texts, pieces, features = _tokens(part.column(part.num_columns - 1))
            p = crf.marginals(m.emissions(features), pieces.at, m.chain)
            s = m.document(p, pieces.at)
            columns = [*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            if spans:
                columns.append(_spans(texts, pieces, p))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *out[: 2 + spans]])

    frame = docs.select(*[docs[c] for c in kept], docs["text"].cast("string").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return mapped(frame, each, f"{fields}score double, predicted int" + ", spans array<array<int>>" * spans)


def _spans(texts, pieces, p) -> pa.Array:
    """Runs of offending tokens as code point offsets (of the lower-case text)."""
    bad = p >= SPAN_AT
    i = np.flatnonzero(bad)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(i) > 1) | (np.diff(pieces.row[i]) > 0)))) if len(i) else i
    first, last = i[cut], i[np.concatenate((cut[1:], [len(i)])) - 1] if len(i) else i
    points = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    base = points[texts.at[pieces.row[first]]]
    begin, end = points[pieces.start[first]] - base, points[pieces.stop[last]] - base
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * 2, pa.int32()), pa.array(np.column_stack((begin, end)).ravel(), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pieces.row[first], np.arange(texts.n + 1)), pa.int32()), inner)


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """The model fitted on the labels of sf_dir."""
    return fit(sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic"))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, with the offending offsets."""
    tagged = tag(table(spark, sf_dir, "documents"), model_of(spark, sf_dir), ["doc_id"])
    return tagged.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")
