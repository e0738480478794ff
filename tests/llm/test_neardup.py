from __future__ import annotations

import random

import numpy as np
import pytest

from webquarry.llm import neardup as N
from webquarry.llm.common import HashedWords, connected_components

from .conftest import passage


def brute(rows, k, percent):
    sets, out = {}, {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    for i in ids:
        out[i] = (len(sets[i]), top(i), top(i) == i)
    return out


def edited(text, rng, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text.split())


def rows_with_groups():
    rng = random.Random(3)
    base = passage(1, 150)
    rows = [(i, edited(base, rng, rng.random() * 0.06)) for i in range(60)]  # links run through some of them only
    rows += [(100 + i, passage(2, 60)) for i in range(5)] + [(200, passage(2, 60).upper())]
    rows += [(300 + i, passage(10 + i, 40)) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "One  two"), (405, "one"), (406, "a b c d"), (407, "a b c d")]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, documents, k, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 16)  # large groups are compared in pairs of blocks
    rows = rows_with_groups()
    got = N.near_duplicates(documents([(i, t, "s") for i, t in rows], extra=True), k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, k, 80)
    assert len(got) == len(rows)


def test_large_groups_are_settled_by_their_parents(spark, documents, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 16)
    labels, written = [], N.C.written
    monkeypatch.setattr(N.C, "written", lambda df, label: labels.append(label) or written(df, label))
    base = passage(5, 200).split()
    copies = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(100)]  # each 0.9 like the others
    chain = [(1000 + 2 * i, " ".join(passage(60, 400).split()[8 * i : 8 * i + 100])) for i in range(30)]  # each like its neighbours only
    other = [(2000 + i, " ".join(passage(60, 400).split()[: 60 + i])) for i in range(20)]
    for rows, settled in ((copies, True), (copies + chain + other, False)):
        labels.clear()
        got = {r.doc_id: r.component_id for r in N.near_duplicates(documents([(i, t, "s") for i, t in rows])).collect()}
        assert got == {i: c for i, (_, c, _) in brute(rows, 5, 80).items()}
        assert "groups" in labels and not (settled and "blocks" in labels)


def test_nulls_repeats_and_empty_tables(spark, documents):
    assert N.near_duplicates(documents([])).count() == 0
    rows = [(None, passage(1, 50), "a"), (1, passage(1, 50), None), (1, passage(1, 50), "a"), (2, passage(1, 50), "b")]
    got = N.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    left = N.drop_near_duplicates(documents(rows, extra=True))
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1]
    assert left.columns == documents(rows, extra=True).columns


def test_sketch_estimates_similarity_and_fills_every_bin():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 400):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[: n // 5] = rng.integers(0, 2**63, n // 5).astype(np.uint64)
            x, y = N.sketch(a), N.sketch(b)
            assert x.max() < np.iinfo(np.uint64).max
            same = n - n // 5
            errors.append((x == y).mean() - same / (2 * n - same))
        assert abs(np.mean(errors)) < 0.03


def test_sketch_does_not_depend_on_order():
    a = np.random.default_rng(2).integers(0, 2**63, 30).astype(np.uint64)
    assert (N.sketch(a) == N.sketch(a[::-1].copy())).all()


def test_shingles():
    words = HashedWords()
    assert len(N.shingle_set(b"a b c d e", 4, words)) == 2
    assert len(N.shingle_set(b"a b a b a b a b", 2, words)) == 2
    assert (N.shingle_set("É a b".encode(), 4, words) != N.shingle_set("é a b".encode(), 4, words)).all()  # only A-Z change


def test_similar_pairs_small_and_large_agree():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    large = set(map(tuple, map(lambda p: (int(p[0]), int(p[1])), N.similar_pairs(sets, 50))))
    small = {(i, j) for i in range(12) for j in range(i + 1, 12) for _ in N.similar_pairs([sets[i], sets[j]], 50)}
    assert large == small and large


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0
