"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks cut points; normalised chunking asks for more zero
bits before the wanted chunk size and fewer after it, with a least and a largest size. The
fingerprint is the set of chunk digests with the bytes they cover, so an edit changes only
the chunks it touches and a shift none behind it. Likeness is containment: the bytes of a
fingerprint's chunks that the other one holds too, over all of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST, NORMAL, MOST = 16, 64, 256
#: Bits that must be zero before and after ``NORMAL`` bytes.
HARD, EASY = np.uint32(0xFF000000), np.uint32(0xF0000000)
#: Documents that stand in one range of ids, how many ranges there are at most, and how many come out of the first look at the ids.
RANGE_DOCS, MOST_RANGES, FIRST_RANGES = 4000, 20_000, 2000

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2024) for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Of each byte the hash of it and the 31 before: sum of gear[b] << distance, in 5 doubling steps."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    return h


def chunks(data: bytes) -> list[bytes]:
    """Consecutive chunks that make up ``data``."""
    n = len(data)
    if n <= LEAST:
        return [data] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    easy = np.flatnonzero(h & EASY == 0)
    hard = easy[h[easy] & HARD == 0] + 1
    easy = (easy + 1).tolist()
    hard = hard.tolist()
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        least, normal, most = at + LEAST, at + NORMAL, min(n, at + MOST)
        while i < len(hard) and hard[i] < least:
            i += 1
        if i < len(hard) and hard[i] < min(normal, most):
            end = hard[i]
        else:
            while j < len(easy) and easy[j] < normal:
                j += 1
            end = easy[j] if j < len(easy) and easy[j] < most else most
        out.append(data[at:end])
        at = end
    if at < n:
        out.append(data[at:])
    return out


def fingerprint(data: bytes) -> dict[int, int]:
    """40-bit digest of each distinct chunk to the bytes it covers."""
    out: dict[int, int] = {}
    for c in chunks(data):
        d = xxhash.xxh3_64_intdigest(c) >> 24
        out[d] = out.get(d, 0) + len(c)
    return out


def as_text(print_: dict[int, int]) -> str:
    """``digest:bytes`` in the order of the digests, blank-separated."""
    return " ".join(f"{d:010x}:{print_[d]}" for d in sorted(print_))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of ``a``'s bytes in chunks that ``b`` has too; equal fingerprints: 1; an empty one is in nothing else."""
    if a == b:
        return 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values()) if a else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before, out = None, []  # the row that waits for its next: range, doc_id, text, fingerprint, whether it is its own range's
    for batch in C.slices(batches, 64):
        for span, ahead, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("span", "ahead", "doc_id", "text"))):
            text = text or ""
            if before and before[0] != span:
                before = None
            mine = fingerprint(text.encode("utf-8", "surrogatepass"))
            if before and not before[4]:
                _, i, t, p, _ = before
                changed = edited(t, text).encode("utf-8", "surrogatepass")
                other = fingerprint(changed)
                out.append((i, len(t), hashlib.sha256(changed).hexdigest(), as_text(p), as_text(other), likeness(p, other), likeness(p, mine)))
            before = (span, doc_id, text, mine, ahead)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
            out = []


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of ``docs``.

    The next document is that of the next larger id (after the last: the first). Null texts
    count as empty. Rows that repeat an id follow each other in the order of their texts; rows
    without id come last. A table of one row is its own next. An empty table gives no rows.

    The texts move once: ranges of ids are dealt out, each with a copy of the first document
    of the next range. One look at the ids finds the ranges (a second one in tables of more
    than ``FIRST_RANGES`` ranges): approximate quantiles are ids of the table, so that the
    first documents are known with them. All rows of one id stand in one range.
    """
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def quantiles(n: int) -> F.Column:
        parts = ", ".join(f"{i / n!r}D" for i in range(1, n))
        return F.expr(f"percentile_approx(doc_id, array({parts}), {10 * n})")

    seen = given.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), quantiles(FIRST_RANGES).alias("q")).first()
    ranges = max(1, min(MOST_RANGES, -(-seen.n // RANGE_DOCS)))
    if ranges > FIRST_RANGES:
        found = given.agg(quantiles(ranges).alias("q")).first().q
    else:
        found = [seen.q[i * FIRST_RANGES // ranges - 1] for i in range(1, ranges)] if seen.q else []
    # at most MOST_RANGES numbers
    edges = np.array(sorted({x for x in found if x > seen.first}), np.int64)

    @F.pandas_udf("int")
    def span_of(ids):
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype("int32"))

    dealt = given.withColumn("span", span_of("id") if len(edges) else F.lit(0))
    heads = [(0, seen.first), *enumerate(edges.tolist(), 1)]
    if seen.low is not None and max(-seen.low, seen.high) >= 2**53:  # quantiles are doubles: these need not be ids of the table
        heads = sorted((r.span, r.head) for r in dealt.select("span", "id").groupBy("span").agg(F.min("id").alias("head")).collect())
    ahead = docs.sparkSession.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], "head long, previous int")
    marked = dealt.join(F.broadcast(ahead), F.col("id") == F.col("head"), "left")
    places = F.when(F.col("previous").isNull(), F.array(F.struct(F.col("span").alias("span"), F.lit(False).alias("ahead")))).otherwise(
        F.array(F.struct(F.col("span").alias("span"), F.lit(False).alias("ahead")), F.struct(F.col("previous").alias("span"), F.lit(True).alias("ahead")))
    )
    rows = marked.select("id", "doc_id", "text", F.explode(places).alias("at")).select("at.span", "at.ahead", "id", "doc_id", "text")
    return (
        rows.repartition(C.partitions(docs.sparkSession), "span")
        .sortWithinPartitions("span", "ahead", "id", "text")
        .mapInArrow(_prints, _SCHEMA)
    )
