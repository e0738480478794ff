from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from webquarry.llm import toxicity as X

from .conftest import passage

BAD = ("gurbleX", "fnordy", "mupples", "snargs")


def corpus(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = passage(i, 60).split()
        if i % 3 == 0:
            for _ in range(rng.randrange(4, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) if i % 2 else "zilch" + rng.choice(["a", "e", "o", "u", "ko"]))
        rows.append((i, " ".join(words[:30]) + ".\n" + ", ".join(words[30:]), "s"))
    return rows


def test_learns_and_marks_spans(spark, documents):
    rows = corpus()
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxic_spans(documents(rows, extra=True), labels.selectExpr("*", "'x' AS text")).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    texts = {i: t for i, t, _ in rows}
    marked = [texts[r.doc_id][s.start : s.end] for r in held for s in r.spans]
    assert marked and np.mean([w in BAD or w.startswith("zilch") for w in marked]) > 0.9


def test_edges(spark, documents):
    rows = [(1, None, None), (2, "", "s"), (None, "a b", "s"), (3, "..\n..", "s"), (4, "z" * 300_000, "s"), (4, "z", "s")]
    none = spark.createDataFrame([(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = X.toxic_spans(documents(rows), none).collect()
    assert len(got) == 6 and all(r.score == 0.5 and r.predicted == 0 and r.spans == [] for r in got)
    assert X.toxic_spans(documents([]), none).count() == 0


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(20):
        change, sizes = rng.normal(size=(2, 2)) * 2, rng.integers(1, 7, rng.integers(1, 9))
        u = rng.normal(size=sizes.sum()) * 2
        got, _, _, _ = X.forward_backward(u, np.repeat(np.arange(len(sizes)) * 3, sizes), change)  # lines side by side
        at = 0
        for n in sizes:
            weights = {}
            for y in itertools.product((0, 1), repeat=int(n)):
                weights[y] = np.exp(sum(a for a, b in zip(u[at : at + n], y) if b) + sum(change[i, j] for i, j in zip(y, y[1:])))
            total = sum(weights.values())
            want = [sum(w for y, w in weights.items() if y[t]) / total for t in range(n)]
            assert np.allclose(got[at : at + n], want)
            at += n


def brute_marginals(u, change):
    """Forward and backward over one line, word by word, as logarithms."""
    f, b = np.zeros((len(u), 2)), np.zeros((len(u), 2))
    for t in range(len(u)):
        for j in (0, 1):
            f[t, j] = j * u[t] + (np.logaddexp(f[t - 1, 0] + change[0, j], f[t - 1, 1] + change[1, j]) if t else 0)
    for t in range(len(u) - 2, -1, -1):
        for i in (0, 1):
            b[t, i] = np.logaddexp(change[i, 0] + b[t + 1, 0], change[i, 1] + u[t + 1] + b[t + 1, 1])
    z = f + b
    return np.exp(z[:, 1] - np.logaddexp(z[:, 0], z[:, 1]))


def test_marginals_of_long_lines():
    rng = np.random.default_rng(6)
    change = np.clip(rng.normal(size=(2, 2)) * 3, -4, 4)
    sizes = [1, 5000, 2, 700, 1]
    u = np.clip(rng.normal(size=sum(sizes)) * 9, -30, 30)
    got, _, _, _ = X.forward_backward(u, np.repeat(np.arange(5), sizes), change)
    want = np.concatenate([brute_marginals(x, change) for x in np.split(u, np.cumsum(sizes)[:-1])])
    assert np.allclose(got, want, atol=1e-9)


def test_every_word_counts():
    model = X.Model(np.zeros(1 << X.BITS), -3.0, np.zeros((2, 2)))
    f, line, _ = X.word_features([b"word " * 1000])
    assert np.isclose(model.tag(f, line).sum(), 1000 / (1 + np.exp(3)))
    assert model.tag(*X.word_features([b""])[:2]).sum() == 0


def test_training_is_bounded_and_reads_whole_texts(spark, documents, monkeypatch):
    rows = [(i, f"text {i} " * 20, "s") for i in range(40)] + [(7, "text 7 again", "s")] * 30 + [(50, "long " * 100_000, "s")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in [*range(40), 50]], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(X, "learn", lambda texts, y: seen.append((texts, y)) or 0.5)
    X.train(documents(rows), labels, 5, 8, 100_000)
    X.train(documents(rows), labels, 100, 100, 1000)
    (a, ya), (b, _) = seen
    usable = {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1}
    texts = {min(t for j, t, _ in rows if j == i).encode() for i in usable}
    assert ya.count(1) == 5 and ya.count(0) in (7, 8) and len(set(a)) == len(a) and set(a) <= texts
    assert sum(map(len, b)) <= 2000 and len(b) > 5 and set(b) <= texts


def test_words_are_those_of_the_pattern():
    text = "Héllo, World! a-b c_d 12x\n\nÜber\tx\u00a0y"
    f, line, bounds = X.word_features([text.encode(), b"", b"Hello"])
    assert list(bounds) == [0, len(X._WORD.findall(text)), len(X._WORD.findall(text)), len(f)]
    again, _, _ = X.word_features([text.encode()])
    assert (f[: len(again)] == again).all()
