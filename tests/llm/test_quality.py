from __future__ import annotations

import zlib

import numpy as np

from webquarry.llm import quality as Q

from .conftest import passage


def corpus(n=160):
    rows = []
    for i in range(n):
        good = passage(i, 40)
        bad = [" ".join(w.upper() + "!!" for w in good.split()), " ".join([f"x{i}"] * 60)][i % 2]
        rows.append((i, good if i % 4 else bad, "s"))
    return rows


def test_learns_and_holds_out(spark, documents):
    rows = corpus()
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(documents(rows, extra=True), labels.selectExpr("*", "1 AS label", "'x' AS text")).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    kept = Q.keep_good(documents(rows, extra=True), labels)
    assert kept.columns == documents(rows, extra=True).columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, _, _ in rows if i % 4}


def test_held_out_labels_do_not_matter(spark, documents):
    rows = corpus(60)
    label = lambda flip: spark.createDataFrame(
        [(i, int(i % 4 > 0) ^ int(flip and zlib.crc32(str(i).encode()) % 4 == 2), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int"
    )
    a, b = (sorted((r.doc_id, r.score) for r in Q.classify(documents(rows), label(f)).collect()) for f in (False, True))
    assert a == b


def test_edges(spark, documents):
    rows = [(1, None, None), (2, "", "s"), (None, "a b", "s"), (3, "   ", "s"), (4, "z" * 500_000, "s"), (4, "z", "s")]
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(documents(rows), labels).collect()
    assert len(got) == 6 and all(r.score == 0.5 and r.predicted == 0 and r.held_out is not None for r in got)
    assert Q.classify(documents([]), labels).count() == 0


def test_scores_do_not_depend_on_neighbours():
    weights = np.random.default_rng(0).normal(size=Q.BUCKETS)
    texts = ["a a a b", None, "", "Ünïcode words", "b c d " * 50, "a"]
    together = Q.scores(texts, weights, 0.1)
    assert np.allclose(together, [Q.scores([t], weights, 0.1)[0] for t in texts], atol=1e-9)
    brute = lambda t: sum(s * weights[i] for i, s in zip(*Q.document_features(t)))
    assert np.allclose(together, [1 / (1 + np.exp(-0.1 - brute(t))) for t in texts], atol=1e-5)


def test_distances_to_the_same_word():
    words = "a b a a c b a a".split()
    own = np.array([1, 1, 1, 1, 2, 2, 2, 2])
    code = np.array([ord(w) for w in words], np.uint32)
    want = []
    for i, w in enumerate(words):
        before = [j for j in range(i) if words[j] == w and own[j] == own[i]]
        want.append(1 + int(np.ceil(np.log2(i - before[-1]))) if before else 0)
    assert Q._since(code, own).tolist() == want == [0, 0, 2, 1, 0, 0, 0, 1]


def test_training_rows_and_bytes_are_bounded(spark, documents, monkeypatch):
    rows = [(i, f"text {i} " * 20, "s") for i in range(30)] + [(3, "text 3 again", "s")] * 50 + [(3, "a text 3", "s")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*range(30), 3, 3]], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda examples: seen.append(len(examples)) or (np.zeros(Q.BUCKETS), 0.0))
    Q.train(documents(rows), labels, "quality", Q.F.lit(True), max_train=7)
    Q.train(documents(rows), labels, "quality", Q.F.lit(True), max_train=2)
    Q.train(documents(rows), labels, "quality", Q.F.lit(True), max_train=1000)
    Q.train(documents(rows), labels, "quality", Q.F.lit(True), max_bytes=1000)
    assert seen[:3] == [7, 2, 30] and 4 <= seen[3] <= 8
