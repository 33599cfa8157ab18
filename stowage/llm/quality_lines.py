"""Quality rules: word and repetition counts, then line labelling by a linear-chain conditional random field.

Each line with a word is a position of the chain; its features are bins of simple shares (symbols, upper case, repeated
words, shouting, length, being a repeated line or inside repeated windows). The labels of the sample's texts say nothing of
single lines, so lines of the texts that pass the base rules are labelled in two steps: a model of single lines is fitted on the texts' labels; then a line of a
bad text that it calls content counts as content (but for the text's worst line), and a line of a good text that it calls
boilerplate as boilerplate (but for the best). The chain is fitted on splices of one to three of these texts, so that it
sees content turn into boilerplate and back. Viterbi decoding marks each line; a text is kept if at least half of its
words stand in content lines.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows get the same row each; texts
are read whole; ties in decoding go to boilerplate; an empty table gives an empty table; without labels of both classes
every line is content. Extra columns are ignored; a carried column named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import crf
from .common import mapped, table
from .labelled import in_parts, sample
from .vectext import SPACE, SYMBOL, Pieces, Texts, chunks, counts, hashes, mix, per_row, repeats

#: Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
#: Texts in a chain of the fit, in turn.
SPLICES = (1, 2, 1, 3)
#: Share of words in content lines from which a text is kept.
CONTENT_SHARE = 0.5

_UPPER = np.zeros(256, np.bool_)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, np.bool_)
_LOWER[0x61:0x7B] = True
_BANG = np.zeros(256, np.bool_)
_BANG[[0x21, 0x3F]] = True
SHARES = np.array([0.0, 0.05, 0.15, 0.3, 0.5, 0.8])
SIZES = np.array([1, 2, 4, 8, 16, 32, 64, 128])
#: Numbers of features: five shares, two sizes, two flags, one for every line.
FIRST = -2  # the place of the flag for a text's first line
N_FEATURES = 5 * (len(SHARES) + 1) + 2 * (len(SIZES) + 1) + 2 * 2 + 1
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@dataclass
class Lines:
    at: np.ndarray  # the first line of each row; only lines with a word
    words: np.ndarray
    features: list[np.ndarray]
    base: dict[str, np.ndarray]


def read(texts: Texts) -> Lines:
    """Base counts of each text, and its lines with their features."""
    data = texts.data
    word = Pieces(texts, ~SPACE[data])
    line = Pieces(texts, data != 0x0A)
    first = np.searchsorted(word.start, line.start)  # words of line i: first[i] to last[i]
    last = np.searchsorted(word.start, line.stop)
    full = np.flatnonzero(last > first)
    whole = hashes(data, line)[full]
    row = line.row[full]
    earlier = repeats(whole, row)[0] > 0
    h = hashes(data, word)
    trio = np.zeros(len(h), np.uint64)
    ok = np.zeros(len(h), np.bool_)
    if len(h) > 2:
        trio[:-2] = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        ok[:-2] = word.row[:-2] == word.row[2:]
    windows = np.flatnonzero(ok)
    twice = windows[repeats(trio[windows], word.row[windows])[1]]
    repeated = np.zeros(len(h), np.bool_)
    for k in range(3):
        repeated[twice + k] = True
    continuation = (data & 0xC0) == 0x80
    base = {
        "n_words": np.diff(word.at),
        "word_chars": per_row(~SPACE[data] & ~continuation, texts.at),
        "n_symbols": per_row(SYMBOL[data], texts.at),
        "n_dup_lines": np.bincount(row[earlier], minlength=texts.n),
        "n_repeat_words": per_row(repeated, word.at),
    }
    at = np.searchsorted(row, np.arange(texts.n + 1))
    f, t = first[full], last[full]
    n = t - f

    def share(flag: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flag)))
        return np.searchsorted(SHARES, (run[t] - run[f]) / np.maximum(n, 1), "left")

    same = np.zeros(len(h), np.bool_)
    same[1:] = (h[1:] == h[:-1]) & (word.row[1:] == word.row[:-1])
    upper, lower = counts(_UPPER[data], word), counts(_LOWER[data], word)
    shares = [share(counts(SYMBOL[data], word) > 0), share((upper > 1) & (upper > lower)), share(counts(_BANG[data], word) > 0), share(same), share(repeated)]
    chars = (line.stop - line.start)[full]
    features, base_number = [], 0
    for x, size in [*((x, len(SHARES) + 1) for x in shares), (np.searchsorted(SIZES, n, "right"), len(SIZES) + 1), (np.searchsorted(SIZES, chars // np.maximum(n, 1), "right"), len(SIZES) + 1), (earlier.astype(np.int64), 2), (np.isin(np.arange(len(full)), at[:-1]).astype(np.int64), 2), (np.zeros(len(full), np.int64), 1)]:
        features.append(x + base_number)
        base_number += size
    return Lines(at, n, features, base)


@dataclass
class Model:
    weights: np.ndarray
    chain: crf.Chain

    def content_share(self, lines: Lines) -> np.ndarray:
        """The share of each text's words that stand in content lines; 0 for a text without words."""
        e = sum(self.weights[f] for f in lines.features) if len(lines.words) else np.zeros(0)
        content = crf.viterbi(e, lines.at, self.chain)
        total = np.maximum(per_row(lines.words, lines.at), 1)
        return per_row(np.where(content, lines.words, 0), lines.at) / total


def fit(examples: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in examples], np.float64)
    if len(set(y.tolist())) < 2:
        w = np.zeros(N_FEATURES)
        w[-1] = 5.0
        return Model(w, crf.Chain())
    # good and bad texts mixed, in the same order every time
    order = np.argsort(mix(np.arange(1, len(y) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    y = y[order]
    parts = [read(Texts(pa.array(part, pa.large_string()))) for part in in_parts([examples[i][0] for i in order])]
    features = [np.concatenate(f) for f in zip(*(p.features for p in parts))]
    many = np.concatenate([np.diff(p.at) for p in parts])
    failed = np.concatenate([base_failed(p.base) for p in parts])
    if len(set(y[~failed & (many > 0)].tolist())) == 2:  # the base rules decide the others
        features = [f[np.repeat(~failed, many)] for f in features]
        y, many = y[~failed], many[~failed]
    y, many = y[many > 0], many[many > 0]
    if not len(many):
        return fit([])
    start, row = np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)
    lines = line_labels(features, start, row, y)
    splice = np.cumsum(np.resize(SPLICES, len(many)))
    heads = start[np.concatenate(([0], splice[splice < len(many)]))]
    at = np.append(heads, len(row))
    features[FIRST] = N_FEATURES - 3 + np.isin(np.arange(len(row)), heads)
    return Model(*crf.fit(features, N_FEATURES, at, lines, rounds=200, rate=0.2, ridge=1e-5))


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels count alike."""
    good = y.sum()
    return np.where(y > 0, len(y) / (2 * max(1.0, good)), len(y) / (2 * max(1.0, len(y) - good)))


def line_labels(features: list[np.ndarray], start: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for content, 0 for boilerplate, of each line of texts that begin at `start` and have the labels y."""
    of = y[row]
    w, alone = crf.fit(features, N_FEATURES, np.arange(len(row) + 1), of, _balance(of), rounds=80, rate=0.2, ridge=1e-4)
    e = sum(w[f] for f in features) + alone.begin
    best, worst = np.maximum.reduceat(e, start)[row], np.minimum.reduceat(e, start)[row]
    return np.where(of > 0, (e > 0) | (e == best), (e > 0) & (e != worst)).astype(np.float64)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each text is too short or says too much twice."""
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def label(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns `carry`, all by default) with the base counts, base_failed, kept and content_share."""
    out = (*OUT, "content_share")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # under a hundred numbers

    def each(batch: pa.RecordBatch):
        for part in chunks(batch, "__text"):
            lines = read(Texts(part.column(part.num_columns - 1)))
            b, s = lines.base, sent.value.content_share(lines)
            failed = base_failed(b)
            columns = [*part.columns[:-1], *(pa.array(b[c].astype(np.int64)) for c in OUT[:5]), pa.array(failed), pa.array(~failed & (s >= CONTENT_SHARE)), pa.array(s)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *out])

    frame = docs.select(*[docs[c] for c in kept], docs["text"].cast("string").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return mapped(frame, each, fields + ", ".join(f"{c} long" for c in OUT[:5]) + ", base_failed boolean, kept boolean, content_share double")


def op7_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    docs = table(spark, sf_dir, "documents")
    return label(docs, fit(sample(docs, table(spark, sf_dir, "labels"), "quality")), ["doc_id"])
