"""Quality classifier: supervised subword embeddings.

Every whitespace-separated word gives hashed features: the word itself, the character n-grams
of ``<word>`` and how many words ago the same word stood (to the next power of two, as
n-grams of words cannot tell it of words that training has not seen). A document is the
average of its features' learned vectors, each kind of feature with the same share; a
softmax over two outputs gives the score. Training is plain stochastic gradient descent in
numpy on whole texts of at most ``max_train`` labelled documents, ``max_bytes`` together. As the score is linear in the average, scoring needs one
number for each bucket, so the model that goes to the executors has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIMS = 1 << 15, 16
#: Bounds on the labelled documents that training reads, taken in the order of a hash of their ids, and on the bytes of their texts.
MAX_TRAIN, MAX_BYTES = 3000, 16_000_000
EPOCHS, RATE, SEED = 4, 0.5, 7


def _spread(h: np.ndarray, seed: int) -> np.ndarray:
    """32-bit hashes to buckets."""
    h = (h ^ np.uint32(seed)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def _since(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many words ago the same word stood in the same text, to the next power of two; 0: it did not."""
    key = words.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(words), np.uint32)
    out[order[1:][same]] = 1 + np.ceil(np.log2((order[1:] - order[:-1])[same])).astype(np.uint32)
    return out


def gram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a few whole texts: per kind of feature (positions, buckets). Positions are offsets in the texts joined by one blank each, see ``starts_of``."""
    cp = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    gap = (cp == 32) | ((cp >= 9) & (cp <= 13))
    cp[gap] = 32
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if not len(first):
        return
    at = np.arange(len(cp), dtype=np.uint32)
    begin = np.zeros(len(cp), np.uint32)
    begin[first] = first
    within = at - np.maximum.accumulate(begin)
    letters = (cp + np.uint32(1)) * np.uint32(0x9E3779B1) ^ within * np.uint32(0x85EBCA77)
    letters = (letters ^ (letters >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
    letters[gap] = 0
    words = np.add.reduceat(letters, first, dtype=np.uint32)
    yield first, _spread(words, 1)
    yield first, _spread(_since(words, np.searchsorted(starts_of(texts), first, "right")), 2)
    poly, inside = cp, np.zeros(len(cp), bool)
    for n in range(2, 6):
        poly = poly[:-1] * np.uint32(0x01000193) + cp[n - 1 :]
        if n > 2:
            inside = inside[:-1] | gap[n - 2 : len(gap) - 1]
            at_n = np.flatnonzero(~inside)
            yield at_n, _spread(poly[at_n], n)
        else:
            inside = inside[:-1]


def starts_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and the share of each; all kinds of features together have the same share."""
    found = [buckets for _, buckets in gram_buckets([text or ""]) if len(buckets)]
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    shares = np.bincount(np.concatenate(found), weights=np.concatenate([np.full(len(x), 1 / (len(x) * len(found))) for x in found]))
    at = np.flatnonzero(shares)
    return at.astype(np.int32), shares[at].astype(np.float32)


def log_odds(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Of each text the log-odds of label 1."""
    total, kinds = np.zeros(len(texts)), np.zeros(len(texts))
    starts = starts_of(texts)
    for at, buckets in gram_buckets(texts):
        bounds = np.searchsorted(at, np.append(starts, np.iinfo(np.int64).max))
        sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
        number = np.diff(bounds)
        total += np.divide(sums[bounds[1:]] - sums[bounds[:-1]], number, out=np.zeros(len(texts)), where=number > 0)
        kinds += number > 0
    return bias + np.divide(total, kinds, out=np.zeros(len(texts)), where=kinds > 0)


def _by_size(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of some 400,000 characters together, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 400_000:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    texts = [t or "" for t in texts]
    z = [log_odds(texts[i:j], weights, bias) for i, j in _by_size(texts)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.empty(0)]), -500, 500)))


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """From (label, buckets, shares): what each bucket adds to the log-odds of label 1, and the bias.

    With one class only, or none, there is nothing to learn: the bias alone gives the share
    of label 1 (with one example of each class added), one half for no examples.
    """
    ones = sum(y for y, _, _ in examples)
    bias = float(np.log((ones + 1) / (len(examples) - ones + 1)))
    if ones in (0, len(examples)):
        return np.zeros(BUCKETS), bias
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out, steps, step = np.zeros((DIMS, 2), np.float32), EPOCHS * len(examples), 0
    offset = np.zeros(2, np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            y, ids, shares = examples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = shares @ table[ids]
            z = hidden @ out + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient of the softmax loss
            back = out @ p
            out -= rate * np.outer(hidden, p)
            offset -= rate * p
            table[ids] -= rate * np.outer(shares * min(len(ids), 100), back)  # shares are small: average over up to 100 features
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(offset[1] - offset[0])


def train(docs: DataFrame, labels: DataFrame, target: str, usable: Column, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_train`` of the ``labels`` rows (doc_id, target) for which ``usable`` holds, and at most ``max_bytes`` of text."""
    known = (
        labels.filter(usable & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .groupBy("doc_id").agg(F.min(target).cast("int").alias("label"))
    )
    got = C.labelled_texts(docs, known, max_train, max_bytes)
    return fit([(y, *document_features(t)) for y, t in zip(got.column("label").to_pylist(), got.column("text").to_pylist())])


def _scorer(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            rated = scores(batch.column(1).to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rated, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``; null and empty texts score by the bias."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scorer(*model), "doc_id long, score double"
    )


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id written as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Only labels 0 and 1 of rows with crc32(doc_id) mod 4 <> 2 teach; a document that is
    labelled more than once counts with the smaller label; documents without id are scored,
    never held out. No labels: all documents score one half. Other columns are not read.
    """
    model = train(docs, labels, "quality", remainder(4) != 2, max_train)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, reject_below: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``reject_below``; labels that ``classify`` holds out do not teach here either."""
    weights, bias = train(docs, labels, "quality", remainder(4) != 2, max_train)

    @F.pandas_udf("double")
    def rated(text):
        return pd.Series(scores(list(text), weights, bias))

    return docs.filter(rated(F.col("text").cast("string")) >= reject_below)
