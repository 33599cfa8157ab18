"""A bounded sample of labelled texts for fitting, drawn the same way every time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ended, held_out, written

#: Labelled texts that a model is fitted on at most, and characters of them: the documented bounds of every fit here.
FIT_ROWS = 4000
FIT_CHARS = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most `rows` labelled documents with at most `chars` characters together, by the smallest hash of the id.

    Held-out rows, null labels and null ids never count. Only the ids of the sample (a bounded number) are broadcast; the
    documents are read once and not shuffled but for the sample. A document that occurs twice gives the first of its texts;
    one with both labels gives an example of each. Whole texts only: those beyond `chars` are left out.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("__y"))
    ids = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    got = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__y").agg(F.min("__text").alias("__text"))
    got = written(got.withColumn("__size", F.length("__text")), "labelled")
    fit, total = set(), 0
    for r in got.select("doc_id", "__y", "__size").orderBy(F.xxhash64("doc_id"), "doc_id", "__y").collect():
        total += r["__size"]
        if total <= chars or not fit:
            fit.add((r["doc_id"], r["__y"]))
    if total > chars:
        got = got.where(F.col("doc_id").isin([i for i, _ in fit]))
    found = got.select("doc_id", "__y", "__text").collect()
    ended()  # what an earlier fit has freed in the driver
    return [(r["__text"], r["__y"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["__y"])) if (r["doc_id"], r["__y"]) in fit]


def in_parts(texts: list[str], most: int = 1 << 20):
    """Lists of texts with about `most` characters each, so that fitting needs little memory at once."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def logistic(x, y, weight=None, rounds: int = 200, ridge: float = 1e-3):
    """Slopes and intercept of a small logistic regression by Newton's method."""
    import numpy as np

    x = np.column_stack((x, np.ones(len(y))))
    b = np.zeros(x.shape[1])
    w = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b
