"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds 64-bit hashes of its distinct word shingles. Each set gets a sketch
of ``t`` coordinates: in round i < t every element falls into a hashed bin with a hashed
value, and in round t + j all elements fall into bin j, so that every bin is filled; a bin
keeps its smallest (round, value), and the rounds end once all bins are full. Bands of
``rows`` coordinates make candidates. Equal sets are one node before banding, so groups of
exact copies cost one row each. A node's candidates are the smallest nodes of its bands
(never all pairs); the smallest of these is its parent, and the components are found among
the band heads alone. A component that fits into a block is compared on whole sets inside one
task. A larger one is first compared in blocks of nodes of one parent, each block with the
parent, which settles groups of near copies in time linear in them. Only where several
classes are left are blocks compared in pairs, and the blocks of the largest class only with
the others. Each task returns a spanning forest of the true links. Similarity counts
exactly: ``100 * inter >= percent * union``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: 40 bands of 5: at similarity 0.8 a pair misses all bands with probability 1.2e-7.
BANDS, ROWS = 40, 5
T = BANDS * ROWS
#: Nodes and set elements of a block; a pair of blocks is compared in one task's memory.
BLOCK_NODES, BLOCK_ELEMENTS = 512, 1_000_000

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, 2 * T + 1, dtype=_U) * _MULT[0])
_BAND_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=_U) * _MULT[1])
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(1, ROWS + 1)], _U)


def shingle_set(text: bytes | None, k: int, words: C.HashedWords) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; of fewer words, one for the whole sequence; none: empty."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, _U)
    if len(found) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], _U)
    ids = np.fromiter(map(words.__getitem__, found), _U, len(found))
    n = len(ids) - k + 1
    h = ids[:n].copy()
    for i in range(1, k):
        h = _mix(h) + ids[i : i + n] * _MULT[i % 5]
    return np.unique(_mix(h))


def sketch(items: np.ndarray) -> np.ndarray:
    """The ``T`` coordinates of a set that is not empty."""
    out = np.full(T, np.iinfo(_U).max, _U)
    n, at = len(items), 0
    while at < T:
        rounds = np.arange(at, min(T, at + max(1, 1600 // n)), dtype=np.int64)
        h = _mix(items[None, :] ^ _SEEDS[rounds][:, None])
        bins = ((h >> _U(32)) * _U(T)) >> _U(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((h & _U(0xFFFFFFFFFFF)) | (rounds.astype(_U) << _U(44))[:, None]).ravel())
        at = int(rounds[-1]) + 1
        if out.max() < _U(T) << _U(44):
            return out
    left = np.flatnonzero(out == np.iinfo(_U).max)
    if len(left):  # only sets much smaller than T come here
        h = _mix(items[None, :] ^ _SEEDS[T + left][:, None]) & _U(0xFFFFFFFFFFF)
        out[left] = h.min(axis=1) | ((T + left).astype(_U) << _U(44))
    return out


def band_keys(items: np.ndarray) -> np.ndarray:
    keys = (_mix(sketch(items).reshape(BANDS, ROWS)) * _POWERS).sum(axis=1, dtype=_U)
    return _mix(keys ^ _BAND_SEEDS).view(np.int64)


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = C.HashedWords()
        for batch in C.slices(batches):
            sizes, keys, bands = [], [], []
            seen: dict[bytes, np.ndarray] = {}
            for text in C.text_bytes(batch.column(1)):
                items = shingle_set(text, k, words)
                sizes.append(len(items))
                keys.append(key := set_key(items))
                if len(items) and key not in seen:
                    seen[key] = band_keys(items)
                bands.append(seen.get(key))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = C.HashedWords(), None
        for batch in C.slices(batches):
            keep, data = [], []
            for i, (node, text, key) in enumerate(zip(batch.column(0).to_pylist(), C.text_bytes(batch.column(3)), batch.column(4).to_pylist())):
                if node == last:  # repeated rows stand together behind a merge
                    continue
                items = shingle_set(text, k, words)
                if set_key(items) == key:
                    keep.append(i)
                    data.append(items.tobytes())
                    last = node
            rest = batch.select([0, 1, 2]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(data, pa.binary())], names=["node", "comp", "parent", "items"])

    return run


def similar_pairs(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs i < j with ``100 * inter >= percent * union``, from whole sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                small, large = sorted((int(sizes[i]), int(sizes[j])))
                if 100 * small >= percent * large:
                    inter = small + large - len(np.union1d(sets[i], sets[j]))
                    if 100 * inter >= percent * (small + large - inter):
                        yield i, j
        return
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    mine = shared[column]
    owner, column = owner[mine], rank[column[mine]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((m, m), np.float32)  # counts below 2**24 are exact
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    ok = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    yield from zip(*np.nonzero(np.triu(ok, 1)))


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> list[int]:
    """Of each index the smallest that it is linked with."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        i, j = sorted((top(int(i)), top(int(j))))
        up[j] = i
    return [top(i) for i in range(n)]


def _verify(percent: int):
    names = ["a", "b"]

    def group(rows: list[tuple]) -> list[tuple]:
        rows = list({r[0]: r for r in sorted(rows, key=lambda r: r[0])}.values())  # repeated rows are one node
        sets = [np.frombuffer(r[1], _U) for r in rows]
        roots = _forest(similar_pairs(sets, percent), len(rows))
        return [(rows[i][0], rows[j][0]) for i, j in enumerate(roots) if i != j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in C.slices(batches, 64):
            columns = [batch.column(n).to_pylist() for n in ("node", "items", "comp", "lo", "hi")]
            for row in zip(*columns):
                if (new := row[2:]) != key:
                    out += group(rows)
                    key, rows = new, []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)
                out = []
        if out := group(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    return run


def _verified(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside each group (comp, lo, hi) of rows (node, items, comp, lo, hi): a forest of the true ones."""
    parts = C.partitions(dealt.sparkSession)
    rows = dealt.select("node", "items", *[F.col(c).cast("long").alias(c) for c in ("comp", "lo", "hi")])
    links = rows.repartition(parts, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInArrow(_verify(percent), "a long, b long")
    return C.written(links, "links")


def _blocks(n: str = "n") -> F.Column:
    """Blocks that some nodes with ``n`` elements each fill."""
    return F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(n) / BLOCK_ELEMENTS)).cast("long")


def _large_components(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Rows (node, comp): the classes of true links of rows (node, comp, parent, items) whose components fill more than a block."""
    near = sets.select("node", "comp", "parent").join(nodes, "node")
    groups = C.written(near.groupBy("parent").agg(_blocks().alias("blocks")), "groups")
    with_parent = sets.join(groups, "parent").select(
        "node", "items", F.col("parent").alias("comp"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("lo"), F.lit(0).alias("hi")
    )
    parents = sets.join(groups.withColumnRenamed("parent", "head"), F.col("node") == F.col("head")).select(
        "node", "items", F.col("head").alias("comp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("lo"), F.lit(0).alias("hi")
    )
    links = _verified(with_parent.union(parents), percent)
    classes = C.connected_components(links).withColumnRenamed("comp", "class")
    known = C.written(near.join(classes, "node", "left").select("node", "comp", "n", F.coalesce("class", "node").alias("class")), "classes")
    each = known.groupBy("comp", "class").agg(F.count("*").alias("size"))
    largest = each.groupBy("comp").agg(F.max(F.struct("size", F.negative("class").alias("class"))).alias("x"), F.count("*").alias("classes"))
    largest = C.written(largest.filter("classes > 1").select("comp", F.negative("x.class").alias("largest")), "unsettled")
    if largest.isEmpty():
        return classes.withColumnRenamed("class", "comp")
    left = known.join(largest, "comp").withColumn("large", F.col("class") == F.col("largest"))
    count = left.groupBy("comp", "large").agg(_blocks().alias("blocks")).groupBy("comp").agg(
        F.max(F.when(F.col("large"), F.col("blocks"))).alias("l"), F.max(F.when(~F.col("large"), F.col("blocks"))).alias("s")
    )
    left = left.join(C.written(count, "blocks"), "comp").select("node", "large", "l", "s")
    # the blocks of the largest class come first, and meet all others but each other
    block = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.col("l"))).otherwise(F.col("l") + F.pmod(F.xxhash64("node"), F.col("s")))
    dealt = sets.join(left, "node").withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("large"), F.col("l")).otherwise(F.lit(0).cast("long")), F.col("l") + F.col("s") - 1)))
    dealt = dealt.select("node", "items", "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return C.connected_components(links.union(_verified(dealt, percent)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. ``component_id`` is the smallest
    id reachable over links; ``kept`` tells whether it is the row's own. Null and empty texts
    have no shingles and no links. A row without id links with nothing, has no component and
    is kept. Rows that repeat an id share its component if their texts link, each row counting
    with its own text. Other columns are not read; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = C.written(
        given.mapInArrow(_signatures(k), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketch"
    )
    nodes = (
        sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    nodes = C.written(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last").select("band", "head")
    heads = C.written(heads, "heads")  # a table, so that Spark can split a band that many nodes have
    # at most BANDS heads of a node
    near = banded.join(heads, "band").groupBy("node").agg(F.collect_set("head").alias("heads"))
    near = C.written(near.select("node", "heads", F.array_min("heads").alias("parent")), "candidates")
    tops = C.connected_components(near.select(F.explode("heads").alias("a"), F.col("parent").alias("b")))
    tops = C.written(tops.select(F.col("node").alias("top"), "comp"), "tops")
    near = near.join(tops, F.col("parent") == F.col("top"), "left").select("node", F.coalesce("comp", "parent").alias("comp"), "parent")
    sets = near.join(nodes.select("node", "set_key"), "node").join(given, F.col("node") == F.col("doc_id")).select("node", "comp", "parent", "text", "set_key")
    sets = C.written(sets.mapInArrow(_sets(k), "node long, comp long, parent long, items binary"), "sets")
    sizes = near.join(nodes.select("node", "n"), "node").groupBy("comp").agg(_blocks().alias("blocks"))
    large = C.written(sizes.filter("blocks > 1").select(F.col("comp").alias("big")), "large")
    found = _verified(
        sets.join(large, F.col("comp") == F.col("big"), "left_anti").select("node", "items", "comp", F.lit(0).alias("lo"), F.lit(0).alias("hi")), percent
    )
    labels = found.select(F.col("a").alias("node"), F.col("b").alias("comp"))  # complete within a task
    if not large.isEmpty():
        some = sets.join(large, F.col("comp") == F.col("big"), "left_semi")
        labels = labels.union(_large_components(some, nodes.select("node", "n"), percent))
    reps = nodes.select("set_key", "node").join(labels.filter("node <> comp"), "node", "left")
    reps = reps.select(F.col("set_key").alias("key"), F.coalesce("comp", "node").alias("component"))
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return (
        sig.select("doc_id", "n_shingles", "set_key")
        .join(reps, F.col("set_key") == F.col("key"), "left")
        .select("doc_id", "n_shingles", own.cast("long").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that represent their group: that of the smallest id, once.

    Empty texts and rows without id stay. Rows that agree in id and text count once.
    """
    found = near_duplicates(docs, k, percent)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    repeated = not found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not repeated:
        return left
    some = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return some.unionByName(left.filter("doc_id IS NULL"))
