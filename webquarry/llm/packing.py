"""Best-fit packing under conflicts.

Items are whole documents, or pieces of documents longer than a bin. Shards of items, dealt
by a hash, are packed by best-fit-decreasing. A shard's open bins stand in the order of
their residual; each carries a bitmap of its sources and one of its duplicate clusters. An
item goes to the first bin, in residual order from its own size up, whose bitmaps do not
conflict with it: the tightest compatible bin. It opens a new bin only if there is none.
A bin takes one item of a duplicate cluster and at most ``per_source`` of a source.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ITEMS = 10_000


class Packer:
    """Bins of one shard. Sources and clusters are small numbers: their bits."""

    def __init__(self, capacity: int, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []  # sorted, with the bins beside
        self.bins: list[int] = []
        self.sources: list[list[int]] = []  # of a bin: bitmaps of the sources it holds at least 1, 2, ... times
        self.clusters: list[int] = []

    def fits(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for an item; source and cluster are bits, cluster 0 conflicts with nothing."""
        i = bisect_left(self.residuals, size)
        while i < len(self.bins) and not self.fits(self.bins[i], source, cluster):
            i += 1  # the next tightest
        if i < len(self.bins):
            residual, b = self.residuals.pop(i), self.bins.pop(i)
        else:
            residual, b = self.capacity, len(self.clusters)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        for n in range(self.per_source):
            if not self.sources[b][n] & source:
                self.sources[b][n] |= source
                break
        self.clusters[b] |= cluster
        offset = self.capacity - residual
        at = bisect_left(self.residuals, residual - size)
        self.residuals.insert(at, residual - size)
        self.bins.insert(at, b)
        return b, offset


def _pack(capacity: int, per_source: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sources = {s: 1 << i for i, s in enumerate(sorted(set(pdf["source"]), key=lambda s: (s is None, s or "")))}
        seen = pdf["cluster"].value_counts()
        # clusters with one item here conflict with nothing
        clusters = {c: 1 << i for i, c in enumerate(sorted(seen.index[seen > 1]))}
        packer, bins, offsets = Packer(capacity, per_source), [], []
        for size, source, cluster in zip(pdf["size"].tolist(), pdf["source"], pdf["cluster"].tolist()):
            b, at = packer.add(size, sources[source], clusters.get(cluster, 0))
            bins.append(b)
            offsets.append(at)
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"], "piece": pdf["piece"], "source": pdf["source"], "start": pdf["start"], "size": pdf["size"],
             "shard": pdf["shard"], "bin": pd.Series(bins, dtype="int64"), "offset": pd.Series(offsets, dtype="int64")}
        )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster: F.Column | None = None) -> DataFrame:
    """Rows (doc_id, piece, source, start, size, shard, bin, offset): where each piece of each document goes.

    Sizes are words ``[^\\x20\\x09-\\x0D]+``. Piece i of a document covers its words
    [start, start + size) and lies at ``offset`` of bin (shard, bin). A document without
    words is one item of size 0. ``cluster`` names a row's duplicate cluster; by default equal
    texts are one, so copies and the pieces of one document lie in different bins. Null ids
    and sources are packed as they are; repeated rows are items of their own. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    cluster = F.xxhash64(F.col("text").cast("string")) if cluster is None else cluster
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        C.word_count(F.col("text").cast("string")).alias("words"), cluster.cast("long").alias("cluster"),
    )
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("words") / capacity) - 1)
    items = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    items = items.withColumn("start", F.col("piece") * capacity)
    items = C.written(items.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start"))).drop("words"), "items")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    # a hot source or cluster is dealt over all shards
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        _pack(capacity, per_source),
        "doc_id long, piece long, source string, start long, size long, shard long, bin long, offset long",
    )
