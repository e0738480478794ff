"""Small text expressions that the others build on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: keeps expressions that use it repeatedly from growing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode whitespace at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def has_any(c: Column, words) -> Column:
    """Whether ``c`` holds one of ``words``; stays within generated code."""
    return reduce(or_, [c.contains(w) for w in words])


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_of(pattern: str) -> tuple[str, bool]:
    """The longest text that every match of a pattern holds, and whether the pattern is nothing but it."""
    from re import _parser

    runs, run, plain = [], "", True
    for op, arg in _parser.parse(pattern):
        if op is _parser.LITERAL:
            run += chr(arg)
        else:
            runs.append(run)
            run, plain = "", False
    return max([*runs, run], key=len), plain


def matches(c: Column, patterns, flags: str = "d") -> Column:
    """Whether one of ``patterns`` occurs; ``.`` ends at a newline only. What a pattern needs in any case is looked for first, as that is cheap."""
    def one(p: str) -> Column:
        need, plain = literal_of(p)
        test = c.rlike(f"(?{flags}){p}")
        return c.contains(need) if plain else c.contains(need) & test if need else test

    return reduce(or_, map(one, patterns))


def distinct_first(items: Column, key) -> Column:
    """Array without items whose ``key(item)`` an earlier item has."""
    def first(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["k"])
        return F.transform(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["x"])

    return let(F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x"))), first)


def clean_text(c: Column, most: int = 200) -> Column:
    """Stripped; null below two characters; cut to ``most`` characters and stripped at the right."""
    cut = lambda t: F.when(F.length(t) < 2, F.lit(None)).when(F.length(t) > most, F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+$", "")).otherwise(t)
    return let(strip(c), cut)
