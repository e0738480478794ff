from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from webquarry.llm import common, mixing, neardup

from .conftest import passage
from .test_neardup import brute as groups
from .test_neardup import edited


def corpus():
    rng = random.Random(1)
    shared = passage(500, 60)
    rows = []
    for i in range(120):
        body = "\n".join(passage(1000 + 3 * i + j, 25) for j in range(3))
        rows.append((i, body + ("\n" + shared if i % 10 == 0 else ""), f"s{i % 4}"))
    rows += [(200 + i, edited(rows[1][1].replace("\n", " "), rng, 0.01), "s1") for i in range(6)]
    rows += [(300 + i, rows[5][1], "s0") for i in range(6)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in passage(i, 50).split()), "s2") for i in range(40)]
    return rows


def test_stages_take_effect(spark, documents, tmp_path):
    rows = corpus()
    sf = str(tmp_path)
    documents([(i, t, s) for i, t, s in rows]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [f.__name__ for _, f in CP.STAGES] == ["quality_stage", "line_dedup_stage", "near_dedup_stage", "mixing_stage", "packing_stage"]
    docs, kept = common.table(spark, sf, "documents"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(CP.STAGES):
        out = common.written(stage(spark, docs, sf), f"test{i}")
        kept[name] = out
        if i < 4:
            assert out.columns == columns
        docs = out
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in kept.items()}
    assert set(ids["quality classifier"]) == {i for i, _, _ in rows if i < 400}  # clean documents stay, junk goes
    lines = {r.doc_id: r.text for r in kept["line dedup"].collect()}
    assert not set(lines) & {300 + i for i in range(6)} and passage(500, 60) in lines[0] and passage(500, 60) not in lines[10]
    near = groups(list(lines.items()), 5, 80)
    assert sorted(ids["minhash near-dedup"]) == sorted(i for i, (_, _, keep) in near.items() if keep)
    taken = {r.doc_id: r.copies for r in mixing.mix(kept["minhash near-dedup"]).collect()}
    assert sorted(ids["mixing"]) == sorted(i for i, n in taken.items() for _ in range(n))
    bins = {}
    for r in kept["best-fit packing"].collect():
        bins.setdefault((r.shard, r.bin), []).append(r.doc_id)
    assert all(len(set(x)) == len(x) for x in bins.values())
    assert sorted(x for b in bins.values() for x in b) == sorted(ids["mixing"])


def test_run_joins_the_stages(spark, documents, tmp_path):
    sf = str(tmp_path)
    documents([(i, passage(i, 30), "s") for i in range(20)]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert {r.doc_id for r in CP.run(spark, sf).collect()} <= set(range(20))


def test_empty_documents(spark, documents, tmp_path):
    sf = str(tmp_path)
    documents([]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert CP.run(spark, sf).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_near_copies_go(spark, size):
    """Of the documents that near-dedup alone would drop, line dedup and near-dedup together drop 0.9 or more, and no document without a near copy or a shared block loses its row."""
    sf = f"/root/testdata/{size}"
    docs = common.table(spark, sf, "documents")
    alone = common.written(neardup.near_duplicates(docs, k=5, percent=80).filter("NOT kept").select("doc_id"), "alone")
    lines = common.written(CP.line_dedup_stage(spark, docs, sf), "lines")
    both = common.written(CP.near_dedup_stage(spark, lines, sf).select("doc_id"), "both")
    copies, stay = alone.count(), alone.join(both, "doc_id", "left_semi").count()
    assert copies and stay <= 0.1 * copies
    untouched = lines.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").filter("text = whole").select("doc_id")
    assert untouched.join(alone, "doc_id", "left_anti").join(both, "doc_id", "left_anti").isEmpty()
