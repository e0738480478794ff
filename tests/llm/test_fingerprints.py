from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from webquarry.llm import fingerprints as G

from .conftest import passage


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(G._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert G.gear(data).tolist() == want


def brute_chunks(data):
    """Byte by byte."""
    out, at, h = [], 0, [int(x) for x in G.gear(np.frombuffer(data, np.uint8))] if data else []
    while at < len(data):
        end = min(len(data), at + G.MOST)
        for i in range(at + G.LEAST, end):
            mask = int(G.HARD if i < at + G.NORMAL else G.EASY)
            if h[i - 1] & mask == 0:
                end = i
                break
        if len(data) - at <= G.LEAST:
            end = len(data)
        out.append(data[at:end])
        at = end
    return out


def test_chunks_match_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 64, 65, 255, 256, 257, 1000, 20_000):
        data = rng.randbytes(n) if n % 2 else (b"ab cd " * n)[:n]
        got = G.chunks(data)
        assert b"".join(got) == data and got == brute_chunks(data)


def test_an_edit_changes_few_chunks():
    data = passage(1, 2000).encode()
    a, b = G.fingerprint(data), G.fingerprint(b"some words before " + data)
    assert G.likeness(a, b) > 0.95 and G.likeness(b, a) > 0.95
    assert G.likeness(G.fingerprint(b""), G.fingerprint(b"")) == 1.0 and G.likeness({}, a) == 0.0


@pytest.mark.parametrize("size,first,scale", [(4000, 2000, 3), (7, 2000, 3), (2, 10, 3), (7, 2000, 2**57 + 1)])
def test_matches_brute_force(spark, documents, monkeypatch, size, first, scale):
    monkeypatch.setattr(G, "RANGE_DOCS", size)
    monkeypatch.setattr(G, "FIRST_RANGES", first)
    rows = [(i * scale if i < 60 else i * 3 - 1000, passage(i, 5 + i % 40) + "é" * (i % 3), "s") for i in range(90)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "x", "s"), (503, passage(3, 9000), "s"), (504, passage(0, 5), "s")]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in G.fingerprints(documents(rows, extra=True)).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(order)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == G.as_text(G.fingerprint(t.encode())) and r.edited_fingerprint == G.as_text(G.fingerprint(changed.encode()))
        assert r.near_edited == G.likeness(G.fingerprint(t.encode()), G.fingerprint(changed.encode()))
        assert r.near_next == G.likeness(G.fingerprint(t.encode()), G.fingerprint(after.encode()))


def test_repeats_nulls_and_small_tables(spark, documents):
    got = G.fingerprints(documents([(1, "b", "s"), (1, "b", "s"), (1, "a", "s"), (None, "z" * 50, None), (2, "c", "s")])).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 1
    one = G.fingerprints(documents([(7, "abcdef", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert G.fingerprints(documents([])).count() == 0
