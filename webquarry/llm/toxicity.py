"""Toxicity: a linear-chain conditional random field tags toxic words.

Words of a line are a chain with two labels. Emissions are sums of learned weights of hashed
features: the word, its beginnings and end, its neighbours. Labels are given for documents
only, so words are labelled first: features that are far more frequent in toxic training
documents and explain documents that others do not yet explain (a greedy cover) mark the
toxic words. The chain is trained on all lines of a bounded sample of whole texts by
gradient steps with forward-backward marginals in numpy. A document's score is a logistic
function of the marginals of all its words; the words whose marginal is at least one half
are the offending spans.

Forward and backward messages are products of 2x2 matrices. Many lines, whatever their
lengths, are one sequence of them in which the first word of a line forgets what was
before: its pieces are multiplied side by side, then walked side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import remainder

BITS = 20
KINDS = 7
#: Bounds of training: labelled documents of either class, and bytes of text of either class.
MAX_TOXIC, MAX_OTHER, MAX_BYTES = 1200, 2400, 6_000_000
#: How many times more frequent among the words of toxic documents a marking feature is, in how many of them at least, what it explains at least.
RATIO, LEAST, EXPLAINS = 15.0, 5, 3.0
EPOCHS, RATE, SEED = 3, 0.4, 5
#: Words of a gradient step.
STEP_WORDS = 8000

_LINES = bytearray(C.WORD_BYTES)
_LINES[10] = 10
_LINES = bytes(_LINES)
_WORD = re.compile(C.WORD_PATTERN)


def _spread(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [words, KINDS], line of each word, first word of each text and the end) of a few whole texts.

    Kinds: the word, its first 4, 5 and 6 bytes, its last 4, the word before and the one
    after it in its line.
    """
    data = np.frombuffer(b"\n".join(texts).translate(_LINES) + b"\n", np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    letter = (data != 32) & (data != 10)
    change = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    first, end = change[::2], change[1::2]
    bounds = np.searchsorted(first, edge)
    if not len(first):
        return np.empty((0, KINDS), np.uint32), np.empty(0, np.int64), bounds
    line = np.cumsum(data == 10)[first]
    at = np.arange(len(data), dtype=np.uint32)
    begin = np.zeros(len(data), np.uint32)
    begin[first] = first
    within = at - np.maximum.accumulate(begin)
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) ^ within * np.uint32(0x85EBCA77)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
    h[~letter] = 0
    words = np.add.reduceat(h, first, dtype=np.uint32)
    out = np.empty((len(first), KINDS), np.uint32)
    out[:, 0] = _spread(words, 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    poly = np.zeros(len(first), np.uint32)
    for j in range(6):
        poly = poly * np.uint32(0x01000193) + np.where(first + j < end, padded[first + j], 0).astype(np.uint32)
        if j >= 3:
            out[:, j - 2] = _spread(poly, j - 1)
    poly = np.zeros(len(first), np.uint32)
    for j in range(1, 5):
        poly = poly * np.uint32(0x01000193) + np.where(end - j >= first, padded[end - j], 0).astype(np.uint32)
    out[:, 4] = _spread(poly, 5)
    same = line[1:] == line[:-1]
    before, after = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
    before[1:][same] = words[:-1][same]
    after[:-1][same] = words[1:][same]
    out[:, 5], out[:, 6] = _spread(before, 6), _spread(after, 7)
    return out, line, bounds


def evidence(marginals: np.ndarray) -> tuple[float, float, float]:
    """Of a document: the largest marginal, and what is expected of toxic words, in all and in a hundred words (logarithms)."""
    total = float(marginals.sum())
    return float(marginals.max(initial=0)), float(np.log1p(total)), float(np.log1p(100 * total / (len(marginals) + 20)))


def _messages(m: np.ndarray) -> np.ndarray:
    """Of the row vectors s[t] = s[t - 1] m[:, t] the share of their second entry; matrices are (m00, m01, m10, m11), the first one's rows are equal."""
    n = m.shape[1]
    steps = max(1, int(n**0.5) // 3)
    columns = -(-n // steps)
    whole = np.zeros((4, columns * steps))
    whole[0, n:] = whole[3, n:] = 1
    whole[:, :n] = m
    g = np.ascontiguousarray(whole.reshape(4, columns, steps).transpose(2, 0, 1))
    p = g[0]
    for q in g[1:]:
        left, right = p[[0, 2]], p[[1, 3]]
        p = np.stack((left * q[0] + right * q[2], left * q[1] + right * q[3]), axis=1).reshape(4, columns)
        p /= p.sum(axis=0)
    x, begins = 0.5, []
    for a, b, c, d in p.T.tolist():
        begins.append(x)
        one = (1 - x) * b + x * d
        x = one / (one + (1 - x) * a + x * c)
    x, out = np.array(begins), np.empty((steps, columns))
    for t, q in enumerate(g):
        y = 1 - x
        one = y * q[1] + x * q[3]
        x = out[t] = one / (one + y * q[0] + x * q[2])
    return out.T.ravel()[:n]


def forward_backward(u: np.ndarray, line: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of label 1, shares of label 1 in the messages from before and from behind, emission factors) of words with the lines they stand in."""
    a, e = np.exp(change), np.exp(np.clip(u, -30, 30))
    begin = np.diff(line, prepend=-1) != 0
    m = np.stack((np.where(begin, 1.0, a[0, 0]), np.where(begin, e, a[0, 1] * e), np.where(begin, 1.0, a[1, 0]), np.where(begin, e, a[1, 1] * e)))
    f = _messages(m)
    # from behind: the word behind speaks, and nothing behind the last of a line
    end = np.append(begin[1:], True)
    e1 = np.append(e[1:], 1.0)
    m = np.stack((np.where(end, 1.0, a[0, 0]), np.where(end, 1.0, a[1, 0]), np.where(end, 1.0, a[0, 1] * e1), np.where(end, 1.0, a[1, 1] * e1)))
    b = _messages(m[:, ::-1])[::-1]
    p = f * b
    return p / (p + (1 - f) * (1 - b)), f, b, e


class Model:
    """weights: of each feature for label 1 over label 0; bias; change: log-potentials [before, after]; scale: of the document score."""

    def __init__(self, weights: np.ndarray, bias: float, change: np.ndarray, scale: tuple[float, ...] = (-3.0, 1.0, 1.0, 1.0)):
        self.weights, self.bias, self.change, self.scale = weights.astype(np.float32), bias, change, scale

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1, dtype=np.float64) + self.bias

    def tag(self, features: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Marginals of label 1 of all words."""
        return forward_backward(self.emissions(features), line, self.change)[0] if len(features) else np.empty(0)

    def score(self, marginals: np.ndarray) -> float:
        z = float(np.dot(self.scale, (1.0, *evidence(marginals))))
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of some MB together, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 1_000_000:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def marking_features(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """From (label, distinct features of words and beginnings, their counts): the features that mark toxic words."""
    toxic = [f for y, f, _ in examples if y]
    counts, holds = [np.zeros(1 << BITS), np.zeros(1 << BITS)], np.zeros(1 << BITS, np.int64)
    for y, f, n in examples:
        counts[y][f] += n
        if y:
            holds[f] += 1
    n1 = len(toxic)
    odds = (counts[1] + 0.5) / (counts[1].sum() + 1) * (counts[0].sum() + 1) / (counts[0] + 0.5)
    good = (holds >= LEAST) & (odds >= RATIO)
    holders: dict[int, list[int]] = {}
    for i, f in enumerate(toxic):
        for x in f[good[f]].tolist():
            holders.setdefault(x, []).append(i)
    if not holders:
        return np.empty(0, np.int64)
    keys = sorted(holders)
    where = [np.array(holders[k]) for k in keys]
    flat, at = np.concatenate(where), np.concatenate([[0], np.cumsum([len(w) for w in where])[:-1]])
    weight, out, left = np.ones(n1), [], np.ones(len(keys), bool)
    while left.any():
        gain = np.add.reduceat(weight[flat], at) * left
        best = int(gain.argmax())
        if gain[best] < EXPLAINS:
            break
        out.append(keys[best])
        left[best] = False
        weight[where[best]] /= 2
    return np.array(sorted(out))


def fit(features: np.ndarray, line: np.ndarray, tags: np.ndarray) -> Model:
    """By AdaGrad steps on the likelihood of the tags; a step takes whole lines, chosen at random."""
    seen = np.bincount(features.ravel(), minlength=1 << BITS) > 0
    kinds, features = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[features]
    weights, power = np.zeros(len(kinds)), np.full(len(kinds), 1e-2)
    bias, change = -2.0, np.zeros((2, 2))
    small = np.full((2, 3), 1.0)
    rng = np.random.default_rng(SEED)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(first, len(line)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(first))
        ends = np.flatnonzero(np.diff(np.cumsum(size[order]) // STEP_WORDS, prepend=0)) + 1
        for some in np.split(order, ends):
            if not len(some):
                continue
            words = np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
            f, y, own = features[words], tags[words], np.repeat(np.arange(len(some)), size[some])
            p, before, behind, e = forward_backward(weights[f].sum(axis=1) + bias, own, change)
            error = y - p
            # expected and seen changes from one word to the next of its line
            t = np.flatnonzero(own[1:] == own[:-1])
            a = np.exp(change)
            left = np.stack((1 - before[t], before[t]))
            right = np.stack((1 - behind[t + 1], e[t + 1] * behind[t + 1]))
            pair = left[:, None] * a[:, :, None] * right[None]
            expected = (pair / pair.sum(axis=(0, 1))).sum(axis=2)
            seen = np.bincount(2 * y[t].astype(np.int64) + y[t + 1].astype(np.int64), minlength=4).reshape(2, 2)
            step = np.bincount(f.ravel(), weights=np.repeat(error, KINDS), minlength=len(kinds))
            used = np.flatnonzero(np.bincount(f.ravel(), minlength=len(kinds)))
            step = step[used] - 1e-3 * weights[used]
            power[used] += step * step
            weights[used] += RATE * step / np.sqrt(power[used])
            g = np.array([[(seen - expected)[0, 1], (seen - expected)[1, 0], (seen - expected)[1, 1]], [error.sum(), 0, 0]])
            small += g * g
            g = RATE / 4 * g / np.sqrt(small)
            change = np.clip(change + np.array([[0, g[0, 0]], [g[0, 1], g[0, 2]]]), -4, 4)
            bias += g[1, 0]
    every = np.zeros(1 << BITS)
    every[kinds] = weights
    return Model(every, float(bias), change)


def fit_scale(rows: list[tuple[int, tuple[float, ...]]]) -> tuple[float, ...]:
    """Logistic regression of the label on ``evidence``, by Newton steps with a small ridge."""
    y = np.array([r[0] for r in rows], float)
    x = np.array([(1.0, *r[1]) for r in rows])
    w = np.zeros(x.shape[1])
    ridge = 0.1 * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, (y - p) @ x - ridge @ w)
    return tuple(float(v) for v in w)


def learn(texts: list[bytes], labels: list[int]) -> Model | float:
    """The model from whole texts, or the share of toxic labels (one of each class added) if they hold one class only."""
    if sum(labels) in (0, len(labels)):
        return (sum(labels) + 1) / (len(labels) + 2)
    parts, lines, bounds, seen = [], [], [np.zeros(1, np.int64)], 0
    for lo, hi in _groups(texts):
        f, line, at = word_features(texts[lo:hi])
        parts.append(f)
        lines.append(line + seen)
        bounds.append(at[1:] + bounds[-1][-1])
        seen += sum(t.count(b"\n") + 1 for t in texts[lo:hi])
    features, line, at = np.concatenate(parts), np.concatenate(lines), np.concatenate(bounds)
    own = [slice(at[i], at[i + 1]) for i in range(len(texts))]
    marks = marking_features([(y, *np.unique(features[own[i], :4], return_counts=True)) for i, y in enumerate(labels)])
    hot = np.zeros(1 << BITS, bool)
    hot[marks] = True
    toxic = np.repeat(np.array(labels, bool), np.diff(at))
    model = fit(features, line, hot[features[:, :4]].any(axis=1) & toxic)
    marginals = model.tag(features, line)
    model.scale = fit_scale([(y, evidence(marginals[own[i]])) for i, y in enumerate(labels)])
    return model


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER, max_bytes: int = MAX_BYTES) -> Model | float:
    """The model of a sample of the labelled documents: at most ``max_toxic`` and ``max_other`` of them and ``max_bytes`` of text of either class."""
    known = (
        labels.filter((remainder(3) != 1) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    got = C.labelled_texts(docs, known, {1: max_toxic, 0: max_other}, max_bytes)
    return learn([t or b"" for t in C.text_bytes(got.column("text").combine_chunks())], got.column("label").to_pylist())


def _spans(model: Model | float):
    one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            texts = [t or b"" for t in C.text_bytes(batch.column(1))]
            scores, spans = [], []
            for lo, hi in _groups(texts):
                if isinstance(model, float):
                    scores += [model] * (hi - lo)
                    spans += [[]] * (hi - lo)
                    continue
                f, line, bounds = word_features(texts[lo:hi])
                p = model.tag(f, line)
                for i in range(hi - lo):
                    own = p[bounds[i] : bounds[i + 1]]
                    scores.append(model.score(own))
                    if len(bad := np.flatnonzero(own >= 0.5)):
                        places = [m.span() for m in _WORD.finditer(texts[lo + i].decode("utf-8", "surrogatepass"))]
                        spans.append([{"start": places[j][0], "end": places[j][1], "probability": float(own[j])} for j in bad])
                    else:
                        spans.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(one))], names=["doc_id", "score", "spans"])

    return run


def toxic_spans(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, spans), one for each row of ``docs``.

    Labels teach only where crc32(doc_id) mod 3 <> 1; of contradicting labels toxic counts.
    ``spans`` are the offending words (code points, marginal). Null and empty texts score by
    the logistic function's offset; without labels of both classes all documents score the
    share of toxic labels. Documents without id are scored, never held out.
    """
    model = train(docs, labels)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _spans(model), "doc_id long, score double, spans array<struct<start:long,end:long,probability:double>>"
    )
    return made.select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans",
    )
