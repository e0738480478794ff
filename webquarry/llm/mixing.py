"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``x`` times its size takes each document floor(x) times, and once
more with probability x - floor(x). The fractions are rounded dependently: two open
documents trade words (not documents), in a random direction chosen so that no expectation
changes, until one of them is settled at 0 or 1. The words a source takes therefore never
move, except at the very last document. Blocks of a source's documents, dealt by a hash of
their ids, run this one after the other and leave one open document each; those meet in a
reduction tree. All random numbers are hashes of ids, so reruns agree on any cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_DOCS = 2_000
#: Open documents that meet in a node of the reduction tree.
FAN_IN = 64
#: Fractions this near to 0 or 1 are settled.
EPS = 1e-12


def _uniform(seed: int, *ids) -> float:
    return (xxhash.xxh3_64_intdigest(repr(ids).encode(), seed=seed) >> 11) / 2**53


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size): (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess is reshared by
    weight until none is above. The one-task windows see one row for each source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("n", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)"))
    ranked = ranked.withColumn("w", F.element_at(cycle, (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # the level at which capped targets and weighted rest add up: the first source, by cap over weight, that stays below its cap
    by = "OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranked = ranked.selectExpr(
        "*", f"coalesce(sum(cap) {by}, 0) AS below", f"coalesce(sum(w) {by}, 0) AS gone",
        "sum(w) OVER () AS all_w", f"sum(source_size) OVER () * {float(share)}D AS goal",
    )
    ranked = ranked.withColumn("level", (F.col("goal") - F.col("below")) / (F.col("all_w") - F.col("gone")))
    ranked = ranked.withColumn("final", F.expr("min(CASE WHEN cap / w >= level THEN struct(cap / w AS r, n, level) END) OVER ()").getField("level"))
    target = F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def round_block(ids: list, sizes: list[int], p: list[float], seed: int) -> tuple[list[int], int, float]:
    """Settle fractions ``p`` in order; words are the currency. Returns (0 or 1 each, index of the open one or -1, its fraction)."""
    out = [0] * len(ids)
    open_at, f = -1, 0.0
    for i in range(len(ids)):
        g = p[i]
        if g <= EPS or g >= 1 - EPS:
            out[i] = int(g > 0.5)
            continue
        if open_at < 0:
            open_at, f = i, g
            continue
        a, b = sizes[open_at], sizes[i]
        up = min((1 - f) * a, g * b)  # words that the open one can win from this one
        down = min(f * a, (1 - g) * b)
        if _uniform(seed, ids[open_at], ids[i]) * (up + down) < down:
            f, g, won = f + up / a, g - up / b, (1 - f) * a <= g * b
            settled_open = won
        else:
            settled_open = f * a <= (1 - g) * b
            f, g = f - down / a, g + down / b
        if settled_open:
            out[open_at] = int(f > 0.5)
            open_at, f = i, g
            if f <= EPS or f >= 1 - EPS:
                out[i] = int(f > 0.5)
                open_at, f = -1, 0.0
        else:
            out[i] = int(g > 0.5)
            if f <= EPS or f >= 1 - EPS:
                out[open_at] = int(f > 0.5)
                open_at, f = -1, 0.0
    return out, open_at, f


_SCHEMA = "doc_id long, size long, source_n long, p double, extra int"


def _round(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # from large to small: neighbours are alike in size, so a large one is soon settled and the last open one is small
        pdf = pdf.sort_values(["size", "mix", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first")
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        extra, at, f = round_block(ids, pdf["size"].tolist(), pdf["p"].tolist(), seed)
        p = np.full(len(pdf), np.nan)
        if at >= 0:
            p[at] = f
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"], "size": pdf["size"], "source_n": pdf["source_n"], "p": p, "extra": np.array(extra, "int32")}
        )

    return run


def _plan(docs: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, size), and of each source (s, source_size, target, docs, source_n, x): ``x`` is how often it takes a document on average."""
    sized = C.written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            C.word_count(F.col("text").cast("string")).alias("size"),
        ),
        "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(sums, weights, share, most).join(sums.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s")))
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a scan of known size: broadcast only if it is small
    return sized, C.written(plan.select(F.col("source").alias("s"), "source_size", "target", "docs", F.xxhash64("source").alias("source_n"), x.alias("x")), "targets")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """Rows (doc_id, size, source_size, target, copies, taken), one for each row of ``docs``.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0), ``copies`` is how
    often the mix takes the document, ``taken = size * copies``. Documents without words are
    taken zero times. Rows that repeat an id are documents of their own. Null ids and sources
    take part (null sources are one source, the last). An empty table gives no rows.
    """
    return _mix(*_plan(docs, weights, share, most), seed)


def _mix(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    whole = F.floor(F.col("x") + EPS)
    planned = planned.select(
        "doc_id", "size", "source_n", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("x") - whole)).otherwise(0.0).alias("p"),
        F.xxhash64("doc_id", "size", F.lit(seed)).alias("mix"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).alias("blocks"),
    )
    planned = planned.withColumn("block", F.pmod(F.xxhash64("mix"), F.col("blocks")))
    level, done = 0, None
    todo = planned
    while True:
        rounded = C.written(todo.groupBy("source_n", "block").applyInPandas(_round(seed + level), _SCHEMA), "round")
        settled = rounded.filter("p IS NULL OR isnan(p)").select("doc_id", "size", "source_n", "extra")
        done = settled if done is None else done.union(settled)
        still = rounded.filter("p IS NOT NULL AND NOT isnan(p)")
        most_open = still.groupBy("source_n").count().agg(F.max("count")).first()[0] or 0
        if most_open <= 1:
            # the last open document of a source, by its own chance
            one = F.when(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.col("p") * (1 << 30), 1).otherwise(0)
            done = done.union(still.select("doc_id", "size", "source_n", one.cast("int").alias("extra")))
            break
        level += 1
        todo = still.select("doc_id", "size", "source_n", "p", F.xxhash64("doc_id", "size", F.lit(seed + level)).alias("mix"))
        todo = todo.withColumn("block", F.pmod(F.xxhash64("mix"), F.lit(max(1, -(-most_open // FAN_IN)))))
    out = done.join(plan.select("source_n", "source_size", "target", "x"), "source_n")
    copies = F.when(F.col("size") > 0, F.floor(F.col("x") + EPS) + F.col("extra")).otherwise(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Documents without words stay as they are: they cost no words. Rows without id are taken
    floor(x) times, where x is target over size of their source, as no id tells them apart.
    Of rows that repeat an id each is taken as often as the one of them that is taken most.
    """
    sized, plan = _plan(docs, weights, share, most)
    taken = _mix(sized, plan, seed).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    whole = plan.select(F.col("s").alias("__s"), F.floor(F.col("x") + EPS).alias("__whole"))
    named = docs.filter("doc_id IS NOT NULL").join(taken.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"))
    nameless = docs.filter("doc_id IS NULL").join(whole, F.col("source").cast("string").eqNullSafe(F.col("__s")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = named.select(*columns, F.col("__copies").alias("__n")).union(nameless.select(*columns, F.col("__whole").alias("__n")))
    times = F.when(C.word_count(F.col("text").cast("string")) == 0, F.lit(1)).otherwise(F.col("__n")).cast("int")
    rows = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*columns)
