from __future__ import annotations

import itertools
import random
import re
import time

import pytest

from webquarry.llm import licenses as L


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "Released under the MIT License.", "under-the_MIT\nlicense under the mit license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "cc by nc cc by nc", "thunder the mit license", "under the mitt license", "apache license version 20", "Apache License Version 2", "no license here", None, "", "...", "é under the mit licenseé",
    "under the mit license apache license version 2 cc by nc", "SPDX-License-Identifier: GPL-3.0-or-later",
]


def test_base_matches_brute_force(spark, documents):
    rng = random.Random(1)
    vocabulary = "under the mit license apache version 2 cc by nc x".split()
    texts = TEXTS + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(200)] + ["under the mit license " * 20_000]
    got = {r.doc_id: r for r in L.license_scan(documents([(i, t, None) for i, t in enumerate(texts)], extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa"}), ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc", "cc-by-nc-sa"}),
    ("Distributed under the Boost Software License, Version 1.0.", {"bsl-1"}), ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Released under the BSD 3-Clause License", {"bsd-3-clause"}), ("nothing to see", set()), ("the MIT campus", set()),
])
def test_rules(text, labels):
    _, found = L.Scanner().scan(text.encode())
    assert {m[3] for m in found} == labels


def test_contained_matches_are_suppressed_but_base_ones():
    outer, inner, base = (5, 0, 10, "a", 1.0, False), (9, 2, 6, "b", 1.0, False), (0, 3, 5, "c", 1.0, True)
    across = (9, 8, 12, "d", 1.0, False)
    assert L.resolve([inner, across, outer, base]) == [base, outer, across]
    assert L.resolve([inner]) == [inner]


def brute_resolve(found):
    accepted = []
    for m in sorted(found, key=lambda m: (m[0], m[1] - m[2], m[1], m[3])):
        if m[5] or not any(a[1] <= m[1] and m[2] <= a[2] for a in accepted):
            accepted.append(m)
    return accepted


def test_resolution_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(0, 25)):
            a = rng.randrange(30)
            found.append((rng.randrange(4), a, a + rng.randrange(1, 12), rng.choice("abc"), 0.5, rng.random() < 0.1))
        assert L.resolve(found) == brute_resolve(found)


def test_whole_results_match_brute_force(spark, documents):
    """Every rule on every text, without gates, words counted one by one."""
    rng = random.Random(6)
    around = [texts_of(form % "NAME")[0] for _, _, form, _ in L.TEMPLATES]
    pieces = [texts_of(p)[0] for _, _, _, p, _ in L.SENTENCES] + [f.replace("NAME", texts_of(n)[0]) for (_, _, n), f in zip(L.NAMES, itertools.cycle(around))]
    texts = [", ".join(rng.choice(pieces) if rng.random() < 0.4 else rng.choice(["some", "Words", "under the MIT License", "and"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    got = {r.doc_id: r for r in L.license_scan(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        line, found = " " + " ".join(words) + " ", []
        for r in L.rules():
            for m in r.find(line.encode()):
                a, b = m.span(1) if r.base else m.span()
                found.append((r.priority, len(line[:a].split()), len(line[:b].split()), r.label, r.certainty, r.base))
        stand = brute_resolve(found)
        assert got[i].labels == ",".join(sorted({m[3] for m in stand}))
        assert sorted((d.label, d.first, d.last + 1, d.certainty) for d in got[i].detections) == sorted((m[3], m[1], m[2], m[4]) for m in stand)


def test_many_grants_in_one_text_take_seconds():
    began = time.time()
    n, found = L.Scanner().scan(b"released under the bsd 3 clause license, " * 100_000)
    assert n == 700_000 and len(found) >= 100_000 and {m[3] for m in found} == {"bsd-3-clause"}
    assert time.time() - began < 60


def test_hundreds_of_rules_each_gated():
    rules = L.rules()
    assert len({p for _, _, _, p, _ in L.SENTENCES}) == len(L.SENTENCES) > 200
    assert len(rules) > 500 and all(r.keywords for r in rules) and [r.priority for r in rules] == sorted(r.priority for r in rules)


def test_empty(spark, documents):
    assert L.license_scan(documents([])).count() == 0
    assert L.license_scan(documents([(None, "under the mit license", None)])).first().n_base == 1


def texts_of(pattern):
    """One text for each branch of an expression; repeats as few times as they may be, and once more."""
    from re import _parser

    def one(op, arg):
        if op is _parser.LITERAL:
            return [chr(arg)]
        if op in (_parser.ANY, _parser.NOT_LITERAL):
            return ["x"]
        if op is _parser.IN:
            return [chr(a if o is _parser.LITERAL else a[0]) for o, a in arg]
        if op is _parser.BRANCH:
            return [t for branch in arg[1] for t in every(branch)]
        if op is _parser.SUBPATTERN:
            return every(arg[-1])
        if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            low, high, body = arg
            return [t for n in sorted({low, min(low + 1, high)}) for t in every(list(body) * n)]
        assert op is _parser.ASSERT_NOT
        return [""]

    def every(items):
        out = [""]
        for op, arg in items:
            out = [a + b for a in out for b in one(op, arg)]
        return out

    return every(_parser.parse(pattern))


def test_gates_open_for_every_branch():
    scanner, shut = L.Scanner(), []
    names = [(label, t, form % f"(?:{name})", form, name) for label, _, name in L.NAMES for t, _, form, _ in L.TEMPLATES]
    around = {form: texts_of(form % "NAME")[0] for _, _, form, _ in L.TEMPLATES}
    texts = {(label, t, pattern): [around[form].replace("NAME", x) for x in texts_of(name)] for label, t, pattern, form, name in names}
    texts |= {(label, "sentence", pattern): texts_of(pattern) for label, _, _, pattern, _ in L.SENTENCES}
    texts |= {(label, "base", phrase): [phrase] for phrase, label in L.BASE}
    finds = {}
    for r in scanner.rules:
        finds.setdefault((r.label, r.name), []).append(r)
    for (label, name, pattern), some in texts.items():
        for text in some:
            line = f" {text} ".encode()
            off = [r for r in finds[label, name] if any(r.find(line))]
            assert off, (label, name, text)
            opened = scanner.opened(line.split())
            shut += [(r.label, r.name, text) for r in off if r not in opened]
    assert not shut, shut[:20]


@pytest.mark.parametrize("text,label", [
    ("subject to the terms of the Common Development and Distribution License", "cddl-1"), ("Server Side Public License, version 1, as published by MongoDB", "sspl-1"),
    ("Licensed under the Open Database License", "odbl"), ("Licensed under Creative Commons Attribution-Non-Commercial 4.0", "cc-by-nc"),
    ("Licensed under Creative Commons Attribution-Non-Commercial-Share-Alike 4.0", "cc-by-nc-sa"), ("Creative Commons Attribution-No-Derivs 3.0 license", "cc-by-nd"),
    ("released under Apache2", "apache-2"), ("released under LGPL3", "lgpl-3"), ("License: AGPL3", "agpl-3"), ("License: MPL2", "mpl-2"), ("under the terms of the European Union Public Licence 1.2", "eupl-1.2"),
    ("licensed under the Universal Permissive License", "upl-1"), ("the Open Software License 3.0 license", "osl-3"), ("licensed under the Community Data License Agreement - Sharing", "cdla-sharing"),
    ("licensed under the Open Data Commons Attribution License", "odc-by"), ("released under the Open Data Commons Public Domain Dedication", "pddl"), ("released under FreeBSD license", "bsd-2-clause"),
    ("released under the apache2 license", "apache-2"), ("licensed under the agpl3", "agpl-3"), ("licensed under the mpl2", "mpl-2"), ("epl2 license", "epl-2"), ("lgpl3 license", "lgpl-3"),
    ("creative commons attribution no derivs license", "cc-by-nd"), ("the freebsd license", "bsd-2-clause"), ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("https://opensource.org/licenses/MIT", "mit"), ("This product includes software developed by the Apache Group", "apache-1"), ("under the same terms as Perl itself", "perl"),
])
def test_names_spelled_out_or_glued(text, label):
    assert label in {m[3] for m in L.Scanner().scan(text.encode())[1]}
