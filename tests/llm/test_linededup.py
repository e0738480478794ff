from __future__ import annotations

import random
import time

from webquarry.llm import linededup as L

from .conftest import passage


def brute_chain(pairs):
    best = [[] for _ in pairs]
    for i, (_, b) in enumerate(pairs):
        best[i] = max((best[j] for j in range(i) if pairs[j][1] < b), key=len, default=[]) + [pairs[i]]
    return max(map(len, best), default=0)


def test_chain_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        perm = list(range(rng.randrange(1, 12)))
        rng.shuffle(perm)
        pairs = list(enumerate(perm))
        chain = L._chain(pairs)
        assert len(chain) == brute_chain(pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert L.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert L.patience([5, 1, 5], [5, 5]) == [(0, 0), (2, 1)]
    same = [rng.randrange(5) for _ in range(50)]
    assert L.patience(same, same) == [(i, i) for i in range(50)]


def test_moved_blocks_are_found_too():
    words = [40, 40, 5, 5, 40]
    assert L.common_blocks([1, 2, 3, 4, 5], [5, 1, 9, 2, 3], [40, 40, 5, 40, 5], 30) == [0, 1, 3, 4]
    assert L.common_blocks([3, 4, 1], [1, 7, 3, 4], [40, 9, 13, 13], 30) == [0]
    assert L.common_blocks([1, 2], [2, 1], words, 50) == []


def runs_in_common(a, b, words, min_words):
    """Places in ``b`` of all runs of lines that ``a`` has too, consecutive in both, by dynamic programming over all places of both."""
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gone = set()
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if a[i - 1] == b[j - 1]:
                length[i][j] = length[i - 1][j - 1] + 1
                run = range(j - length[i][j], j)
                if sum(words[x] for x in run) >= min_words:
                    gone |= set(run)
    return gone


def brute(rows, min_words):
    """Each document against each earlier one, over whole texts."""
    docs = sorted((i, t.split("\n")) for i, t in rows if t is not None)
    out = {}
    for n, (i, lines) in enumerate(docs):
        at = [p for p, x in enumerate(lines) if x.split()]
        gone = set()
        for _, old in docs[:n]:
            a, b = [x.strip(" ") for x in old if x.split()], [lines[p].strip(" ") for p in at]
            gone |= {at[j] for j in runs_in_common(a, b, [len(lines[p].split()) for p in at], min_words)}
        out[i] = gone
    return out


def test_blocks_of_a_pair_match_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 16))] for _ in range(2))
        size = [rng.choice((3, 8, 14, 31)) for _ in range(6)]
        words = [size[x] for x in b]
        assert set(L.common_blocks(a, b, words, 30)) == runs_in_common(a, b, words, 30)


def test_many_equal_lines_take_seconds():
    began = time.time()
    n = 100_000
    assert L.common_blocks([1] * n, [1] * (n - 7), [1] * (n - 7), 30) == list(range(n - 7))
    assert len(L.common_blocks([1, 2] * (n // 2), [2, 1] * (n // 2), [4] * n, 30)) == n
    assert L.common_blocks([1], [1] * n, [30] * n, 30) == list(range(n))
    rng = random.Random(8)
    lines = [rng.randrange(n // 3) for _ in range(n)]
    moved = lines[n // 2 :] + lines[: n // 2]
    assert len(L.common_blocks(lines, moved, [5] * n, 30)) == n
    assert time.time() - began < 30


def test_partners_of_rare_and_of_common_lines():
    held = [{"at": 0, "n": 2, "first": 3, "second": 9}, {"at": 1, "n": 3, "first": 3, "second": 4}, {"at": 3, "n": 2, "first": 1, "second": 9}]
    held += [{"at": i, "n": L.RARE + 1, "first": 1, "second": 0} for i in (5, 6)]
    old, shown = L.partners(9, [10, 11, 12, 13, 14, 15, 16], [20, 20, 20, 20, 20, 20, 20], held, 30)
    assert old == {3, 4}  # line 3 is rare, but its run is too short
    assert shown == {hash((15, 16))}  # the window without rare lines


def corpus():
    boiler, shared, other = passage(900, 13), passage(901, 60), passage(902, 20)
    rows = [(0, passage(0, 30)), (1, "\n".join([boiler, passage(1, 30), shared])), (2, "\n".join([passage(2, 25), "", shared, boiler])), (3, "\n".join([boiler, passage(3, 40)]))]
    rows += [(4 + i, "\n".join([passage(4 + i, 12), shared, passage(50 + i, 9)])) for i in range(30)]
    rows += [(100, "\n".join([other, passage(903, 25)])), (101, "\n".join([passage(60, 8), other, passage(903, 25), passage(61, 8)])), (102, "\n".join([other, passage(62, 5), passage(903, 25)]))]
    return rows + [(200 + i, rows[2][1]) for i in range(5)] + [(300, rows[0][1]), (301, boiler)]


def test_matches_brute_force(spark, documents):
    rows = corpus()
    got = {r.doc_id: r for r in L.line_dedup(documents([(i, t, "s") for i, t in rows], extra=True)).collect()}
    want, texts = brute(rows, 30), dict(rows)
    assert len(got) == len(rows)
    for i, gone in want.items():
        lines = texts[i].split("\n")
        left = [x for p, x in enumerate(lines) if p not in gone]
        assert got[i].text == ("\n".join(left) if any(x.split() for x in left) else "") and got[i].removed_lines == len(gone)
    assert [got[i].removed_lines for i in (0, 1, 3, 301)] == [0, 0, 0, 0]  # first holders and short common lines stay
    assert got[2].removed_words == 60 and got[200].text == ""


def test_edges(spark, documents):
    p = passage(1, 50)
    rows = [(1, p, "a"), (2, None, "a"), (3, "", None), (None, p, "a"), (4, "\n\n", "a"), (5, p + "\nrest", "a"), (5, "other text", "a"), (6, p, "a"), (6, p, "a")]
    df = documents(rows, extra=True)
    got = sorted(((r.doc_id or -1, r.text, r.removed_lines) for r in L.line_dedup(df).collect()), key=str)
    # of the rows with id 5 the one with the smaller hash of its first line stands for the id
    first, other = spark.sql(f"SELECT xxhash64('{p}'), xxhash64('other text')").first()
    five = (5, "rest", 1) if first < other else (5, p + "\nrest", 0)
    assert got == sorted([(1, p, 0), (2, None, 0), (3, "", 0), (-1, p, 0), (4, "\n\n", 0), five, (5, "other text", 0), (6, "", 1), (6, "", 1)], key=str)
    kept = L.without_duplicate_blocks(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 not in ids and ids.count(5) == 2 and None in ids
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())
    assert L.line_dedup(documents([])).count() == 0


def test_windows_cover_every_block():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 12)
        lines, words = rng.sample(range(1000), n), [rng.choice((1, 2, 9, 15, 29, 31, 60)) for _ in range(n)]
        shared = [rng.random() < 0.85 for _ in range(n)]
        got = {h for h, _ in L.windows(lines, words, shared, 30)}
        for i in range(n):
            for j in range(i + 1, n + 1):
                if all(shared[i:j]) and sum(words[i:j]) >= 30:  # each line of a block lies in a window within the block
                    inside = [(a, b) for a in range(i, j) for b in range(a + 1, j + 1) if hash(tuple(lines[a:b])) in got]
                    assert set(range(i, j)) == {x for a, b in inside for x in range(a, b)}
                    assert all(sum(words[a:b]) >= 30 for a, b in inside)


def test_blocks_whose_lines_stood_alone_before(spark, documents):
    l1, l2, l3 = (passage(920 + i, 20) for i in range(3))
    rows = [(1, l1), (2, l2), (3, "\n".join([passage(70, 12), l3])), (5, "\n".join([l1, l2, l3, passage(71, 9)])), (9, "\n".join([passage(72, 9), l1, l2, l3]))]
    rng = random.Random(5)
    pool = [passage(930 + i, rng.choice((7, 12, 20))) for i in range(12)]
    for n in range(60):  # frequent lines, which blocks share in part
        some = [pool[(at := rng.randrange(12)) : at + rng.randrange(1, 6)] for _ in range(2)]
        rows.append((20 + n, "\n".join([*some[0], passage(100 + n, 11), *some[1]])))
    got = {r.doc_id: r for r in L.line_dedup(documents([(i, t, "s") for i, t in rows])).collect()}
    assert got[9].text == passage(72, 9) and got[9].removed_words == 60 and got[5].removed_lines == 0
    assert {i: got[i].removed_lines for i, _ in rows} == {i: len(gone) for i, gone in brute(rows, 30).items()}
