"""What the operators of this subpackage share: shared-folder tables, batches, words, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written as written  # operators write their tables through this module

#: Rows that a Python worker turns into objects at a time.
SLICE_ROWS = 256
#: Entries after which a per-task cache of words is dropped and started anew.
CACHE_WORDS = 400_000

#: Bytes to the words' alphabet: A-Z in lower case, 0-9, a-z and all bytes of non-ASCII characters; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in text, as a pattern.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class HashedWords(dict):
    """Word to its 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def labelled_texts(docs: DataFrame, known: DataFrame, limits: int | dict[int, int], max_bytes: int) -> pa.Table:
    """A bounded sample of labelled whole texts on the driver: (doc_id, label, text), sorted by doc_id.

    ``known`` has one row (doc_id, label) for each labelled id. The ids with the smallest
    hashes are taken, at most ``limits`` of them (or of each label in ``limits``), and of
    these, in the same order, as long as their texts (of that label) have at most
    ``max_bytes`` bytes together. A text that is longer than that alone is passed over. Of
    rows that repeat an id the smallest text counts.
    """
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    parts = [(known.filter(F.col("label") == y), n) for y, n in limits.items()] if isinstance(limits, dict) else [(known, limits)]
    some = reduce(DataFrame.union, (part.orderBy(*order).limit(n) for part, n in parts))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    # broadcast: at most the limits' rows of two numbers
    rows = texts.join(F.broadcast(some), F.col("id") == F.col("doc_id")).groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = written(rows, "sample")
    sizes = rows.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), order[0].alias("h")).collect()
    left, chosen = {}, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        of = r.label if isinstance(limits, dict) else None
        if r.size <= max_bytes:
            left[of] = left.get(of, max_bytes) - r.size
            if left[of] >= 0:
                chosen.append((r.doc_id,))
    if not chosen:
        return rows.limit(0).toArrow()
    ids = docs.sparkSession.createDataFrame(chosen, "id long")
    return rows.join(F.broadcast(ids), F.col("id") == F.col("doc_id"), "left_semi").toArrow().sort_by("doc_id")


def word_count(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, comp): of each node of ``edges`` the smallest node that it reaches.

    Alternates large-star and small-star steps until nothing changes (some log2 of the
    longest path rounds); each round is a written table, so no lineage builds up. Rows
    stay linear in the edges; self-links and repeated edges do no harm; no edges: no rows.
    """
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc"
    )
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = state(e)
    while last[0]:
        both = e.union(e.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(lowest.select("u", "m")).filter("u <> v").distinct(), "cc")
        now = state(e)
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(e.select("v", "v").distinct())
