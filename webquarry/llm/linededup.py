"""Line dedup by pairwise alignment.

Every line gets a hash and the number of documents that hold it. A line that at most
``RARE`` documents hold is rare: a document pairs with each earlier holder of its rare lines.
Where lines are common, windows of them decide: consecutive shared lines, as few as have
``min_words`` words from a line on or up to a line. A window without a rare line pairs its
document with the first document that holds the whole window. A block of ``min_words`` words
that some earlier document has is covered by windows, so each of its lines has a partner
that shows it: a true holder of the block through a rare line, a true holder of the window
otherwise. Pairs stay linear in the lines and no group of copies is paired within itself.

Each pair is aligned by patience diff over whole documents: lines that both have exactly once
anchor the longest increasing chain, and the gaps between anchors are aligned the same way.
Aligned blocks of at least ``min_words`` words are deleted from the later document, whoever
holds them first keeps them. An alignment keeps the order of lines; blocks that moved or
repeat are settled by the windows that both texts have.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words that an aligned block has at least.
MIN_WORDS = 30
#: Documents that hold a rare line, at most: what min, max and xor of their ids tell apart.
RARE = 3


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ordered by their first, with increasing second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at:
            back[i] = ends[at - 1]
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _anchors(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Positions (in b, in a) of the rarest lines that both gaps have, occurrence by occurrence."""
    na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    times = {x: max(n, nb[x]) for x, n in na.items() if x in nb}
    if not times:
        return []
    least = min(times.values())
    rarest = {x for x, n in times.items() if n == least}
    nth: Counter = Counter()
    place = {}
    for i in range(alo, ahi):
        if (x := a[i]) in rarest:
            place[x, nth[x]] = i
            nth[x] += 1
    nth.clear()
    out = []
    for j in range(blo, bhi):
        if (x := b[j]) in rarest:
            if (x, nth[x]) in place:
                out.append((j, place[x, nth[x]]))
            nth[x] += 1
    return out


def patience(a: list, b: list, words: list[int] | None = None, min_words: int = 0) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of equal lines, increasing in both.

    Lines that stand once in both anchor; where there are none, the rarest common ones do,
    the first with the first and so on. With ``words`` of b's lines, gaps of b that hold fewer
    than ``min_words`` words are left: no block fits into them.
    """
    sums = list(accumulate(words, initial=0)) if words else None
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi or (sums and sums[bhi] - sums[blo] < min_words):
            continue
        chain = [(i, j) for j, i in _chain(_anchors(a, b, alo, ahi, blo, bhi))]
        if not chain:
            continue
        before = (alo - 1, blo - 1)
        for i, j in [*chain, (ahi, bhi)]:
            if i > before[0] + 1 and j > before[1] + 1:
                todo.append((before[0] + 1, i, before[1] + 1, j))
            before = (i, j)
        out += chain
    return sorted(out)


def _blocks(pairs: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Runs of positions in ``b`` that are consecutive in both."""
    run: list[int] = []
    before = (-9, -9)
    for i, j in pairs:
        if run and (i, j) != (before[0] + 1, before[1] + 1):
            yield run
            run = []
        run.append(j)
        before = (i, j)
    if run:
        yield run


def _runs(shared: list[bool]) -> Iterator[list[int]]:
    run: list[int] = []
    for j, x in enumerate(shared):
        if x:
            run.append(j)
        elif run:
            yield run
            run = []
    if run:
        yield run


def windows(lines: list[int], words: list[int], shared: list[bool], min_words: int) -> Iterator[tuple[int, list[int]]]:
    """(hash, positions) of the shortest windows of shared lines with at least ``min_words`` words, up to each line and from each line on."""
    for run in _runs(shared):
        for step in (1, -1):
            lo = size = 0
            order = run[::step]
            for n, i in enumerate(order):
                size += words[i]
                while size - words[order[lo]] >= min_words:
                    size -= words[order[lo]]
                    lo += 1
                if size >= min_words:
                    some = order[lo : n + 1][::step]
                    yield hash(tuple([lines[k] for k in some])), some


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions in ``b`` of blocks, consecutive in both, of at least ``min_words`` words: aligned ones, then moved and repeated ones."""
    known = set(a)
    shared = [x in known for x in b]
    if sum(w for w, x in zip(words, shared) if x) < min_words:
        return []
    out: set[int] = set()
    for run in _blocks(patience(a, b, words, min_words)):
        if sum(words[j] for j in run) >= min_words:
            out.update(run)
    if len(out) < sum(shared):
        size = dict(zip(b, words))
        both = {h for h, _ in windows(a, [size.get(x, 0) for x in a], [x in size for x in a], min_words)}
        for h, some in windows(b, words, shared, min_words):
            if h in both:
                out.update(some)
    return sorted(out)


def partners(doc_id: int, lines: list[int], words: list[int], held: list[dict], min_words: int) -> tuple[set[int], set[int]]:
    """Earlier holders of the rare lines of one document, and its windows without rare lines.

    ``held``: of each line that other documents have too its position ``at``, the number ``n``
    of its holders, and of rare ones the first and the second holder. Runs of such lines with
    fewer than ``min_words`` words can hold no block.
    """
    shared, rare = [False] * len(lines), [False] * len(lines)
    holders: dict[int, list[int]] = {}
    for h in held:
        shared[h["at"]] = True
        if h["n"] <= RARE:
            rare[h["at"]] = True
            holders[h["at"]] = [x for x in (h["first"], h["second"]) if x < doc_id]
    earlier = {x for run in _runs(shared) if sum(words[j] for j in run) >= min_words for j in run for x in holders.get(j, ())}
    before = list(accumulate(rare, initial=0))
    return earlier, {h for h, some in windows(lines, words, shared, min_words) if before[some[-1] + 1] == before[some[0]]}


def _partners(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            ids, earlier, hashes = [], [], []
            for doc_id, lines, words, held in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lines", "words", "held"))):
                old, shown = partners(doc_id, lines, words, held, min_words)
                ids += [doc_id] * (len(old) + len(shown))
                earlier += [*old, *[None] * len(shown)]
                hashes += [*[None] * len(old), *shown]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, earlier, hashes)], names=["doc_id", "earlier", "window"])

    return run


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            ids, marks, gone = [], [], []
            for later, mark, a, b, words, places in zip(*(batch.column(n).to_pylist() for n in ("later", "mark", "a", "b", "words", "places"))):
                if found := common_blocks(a, b, words, min_words):
                    ids.append(later)
                    marks.append(mark)
                    gone.append([places[j] for j in found])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["later", "mark", "gone"]
                )

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its lost places, sorted, and whether each line up to the last of them is lost."""
    for batch in C.slices(batches):
        gone, masks = [], []
        for some in batch.column(2).to_pylist():
            gone.append(sorted({x for places in some for x in places}))
            mask = [False] * (gone[-1][-1] + 1)
            for x in gone[-1]:
                mask[x] = True
            masks.append(mask)
        arrays = [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["later", "mark", "gone", "mask"])


def duplicated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (later, mark, gone, mask): documents that lose lines, a hash of their text, the places of these lines (from 0) and which lines they are."""
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    listed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"),
        F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("place"), F.xxhash64(F.trim(x)).alias("line"), C.word_count(x).cast("int").alias("words"))).alias("l"),
    )
    # lines without words are not aligned
    listed = listed.select("doc_id", "mark", F.filter("l", lambda x: x["words"] > 0).alias("l")).select(
        "doc_id", "mark", F.col("l.line").alias("lines"), F.col("l.words").alias("words"), F.col("l.place").alias("places")
    )
    # rows that repeat an id: the one with the smallest lines stands for it
    listed = listed.groupBy("doc_id").agg(F.min(F.struct("lines", "words", "places", "mark")).alias("l")).select("doc_id", "l.*")
    listed = C.written(listed, "lines")
    once = listed.select("doc_id", F.explode(F.array_distinct("lines")).alias("line"))
    holders = once.groupBy("line").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bit_xor("doc_id").alias("x")
    ).filter("n > 1")
    between = F.when(F.col("n") == 2, F.col("last")).otherwise(F.col("x").bitwiseXOR(F.col("first")).bitwiseXOR(F.col("last")))
    holders = holders.select("line", F.least("n", F.lit(RARE + 1)).cast("int").alias("n"), "first", between.alias("second"))
    holders = C.written(holders, "holders")  # a line that many documents have: Spark can split its side of the join, as the other is a table
    each = listed.select("doc_id", F.posexplode("lines").alias("at", "line"))
    held = each.join(holders, "line").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "first", "second")).alias("held"))
    shown = held.join(listed, "doc_id").select("doc_id", "lines", "words", "held").mapInArrow(_partners(min_words), "doc_id long, earlier long, window long")
    shown = C.written(shown, "partners")
    by_line = shown.filter("earlier IS NOT NULL").select(F.col("doc_id").alias("later"), "earlier")
    shown = shown.filter("window IS NOT NULL").select("doc_id", "window")
    firsts = shown.groupBy("window").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last")).filter("earlier < last")
    firsts = C.written(firsts.select("window", "earlier"), "firsts")  # as with lines
    by_window = shown.join(firsts, "window").filter("earlier < doc_id").select(F.col("doc_id").alias("later"), "earlier")
    pairs = C.written(by_line.union(by_window).distinct(), "pairs")
    old = listed.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("a"))
    new = listed.select(F.col("doc_id").alias("later"), F.col("lines").alias("b"), "words", "places", "mark")
    aligned = pairs.join(old, "earlier").join(new, "later").select("later", "mark", "a", "b", "words", "places")
    found = aligned.mapInArrow(_align(min_words), "later long, mark long, gone array<int>")
    lost = found.groupBy("later", "mark").agg(F.collect_list("gone").alias("gone"))
    return lost.mapInArrow(_masks, "later long, mark long, gone array<int>, mask array<boolean>")


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` beside __text, __removed, __words and __count."""
    gone = C.written(duplicated_lines(docs, min_words), "gone").select(F.col("later").alias("__later"), F.col("mark").alias("__mark"), F.col("mask").alias("__gone"))
    # merged at every size: a broadcast that ends with the input's growth would hide what the texts' way costs
    same = (docs["doc_id"].cast("long") == F.col("__later")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__mark"))
    rows = docs.join(gone.hint("merge"), same, "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.coalesce(F.get("__gone", i), F.lit(False)))
    lost = F.filter(lines, lambda x, i: F.coalesce(F.get("__gone", i), F.lit(False)))
    hit = F.col("__gone").isNotNull() & F.col("text").isNotNull()
    keep = F.array_join(left, "\n")
    out = {
        "__text": F.when(hit, F.when(F.forall(left, lambda x: C.word_count(x) == 0), F.lit("")).otherwise(keep)).otherwise(F.col("text")),
        "__removed": F.when(hit, F.size(lost)).otherwise(0).cast("long"),
        "__words": F.when(hit, F.aggregate(lost, F.lit(0).cast("long"), lambda s, x: s + C.word_count(x))).otherwise(F.lit(0).cast("long")),
        "__count": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
    }
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for n, c in out.items()])


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, text, line_count, removed_lines, removed_words), one for each row of ``docs``; ``text`` is without its duplicated blocks.

    Earlier means a smaller doc_id; lines are what lies between newlines, compared without
    the blanks around them. Rows without id or text stay as they are. Rows that repeat an id
    count with the text of the one of them whose lines are smallest; those with another text
    stay as they are. A text of which no words are left becomes empty. Other columns are not read. An
    empty table gives no rows.
    """
    rows = _cleaned(docs.select("doc_id", "text"), min_words)
    return rows.select(
        "doc_id", F.col("__text").alias("text"), F.col("__count").alias("line_count"), F.col("__removed").alias("removed_lines"), F.col("__words").alias("removed_words")
    )


def without_duplicate_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with cleaned texts (and ``n_chars`` to match); documents of which nothing is left go."""
    cleaned = _cleaned(docs, min_words).filter("NOT (__removed > 0 AND __text = '')")
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col("__removed") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars"))
        new["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
