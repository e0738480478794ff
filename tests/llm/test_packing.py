from __future__ import annotations

import random

from webquarry.llm import packing as B


def check(rows, got, capacity, per_source):
    bins, covered = {}, {}
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert 0 <= r.offset and r.offset + r.size <= capacity
        bins.setdefault((r.shard, r.bin), []).append(r)
        covered.setdefault(r.doc_id, []).append((r.start, r.size))
    for items in bins.values():
        spans = sorted((r.offset, r.size) for r in items if r.size)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        for s in {r.source for r in items}:
            assert sum(r.source == s for r in items) <= per_source
        t = [texts[r.doc_id] for r in items]
        assert len(set(t)) == len(t)
    return bins, covered


def test_packs_everything_without_conflicts(spark, documents, monkeypatch):
    monkeypatch.setattr(B, "SHARD_ITEMS", 150)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{i}" for _ in range(rng.choice([1, 5, 20, 60, 99, 100, 130, 450]))), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(300)]
    rows += [(1000 + i, "the same text in all of these", "hot") for i in range(80)] + [(2000, None, None), (2001, "", "s")]
    got = B.pack(documents(rows, extra=True), capacity=100, per_source=3).collect()
    _, covered = check(rows, got, 100, 3)
    for i, t, _ in rows:
        n = len((t or "").split())
        assert sorted(covered[i]) == [(s, min(100, n - s)) for s in range(0, max(n, 1), 100)]


def test_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    packer, bins = B.Packer(50, 2), []  # bins: [residual, sources, clusters]
    for _ in range(2000):
        size, source, cluster = rng.randrange(0, 51), 1 << rng.randrange(6), rng.choice([0, 1 << rng.randrange(30)])
        fits = [b for b, (r, s, c) in enumerate(bins) if r >= size and s.count(source) < 2 and not c & cluster]
        b, offset = packer.add(size, source, cluster)
        if not fits:
            assert b == len(bins) and offset == 0
            bins.append([50, [], 0])
        else:
            assert bins[b][0] == min(bins[x][0] for x in fits) and b in fits and offset == 50 - bins[b][0]
        bins[b][0] -= size
        bins[b][1].append(source)
        bins[b][2] |= cluster


def test_repeats_and_empty(spark, documents):
    got = B.pack(documents([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)])).collect()
    assert len(got) == 3 and len({(r.shard, r.bin) for r in got if r.doc_id == 1}) == 2
    assert B.pack(documents([])).count() == 0
