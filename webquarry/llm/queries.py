"""The ten operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import fingerprints, licenses, linededup, mixing, neardup, packing, pii, quality, topk, toxicity
from .common import table


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.feistel_pseudonyms(table(ship(spark), sf_dir, "documents"), pii.key_of(spark))


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(ship(spark), sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(ship(spark), sf_dir, "documents"), k=4, percent=80)


def op5_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(table(ship(spark), sf_dir, "documents"))
    return found.select("doc_id", "text", "line_count", "removed_lines", "removed_words")


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(ship(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_spans(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(ship(spark), sf_dir, "documents"))


def op9_cdc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(ship(spark), sf_dir, "documents"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(ship(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms, op2_pivot_topk, op3_subword_quality, op4_fast_sketch_dedup, op5_patience_line_dedup,
        op6_pivotal_mix, op7_crf_toxicity, op8_bestfit_packing, op9_cdc_fingerprints, op10_license_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_pivot_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
    """,
    "op4_fast_sketch_dedup": r"""
        WITH RECURSIVE w AS MATERIALIZED (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w
          FROM documents
        ), s AS MATERIALIZED (
          SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' '))
            WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS shingle
          FROM w
        ), n AS MATERIALIZED (
          SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), links AS MATERIALIZED (
          SELECT p.a, p.b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
          ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
          WHERE 100 * p.inter >= 80 * (na.n + nb.n - p.inter)
        ), reach AS (
          SELECT doc_id AS a, doc_id AS b FROM documents
          UNION
          SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), comp AS (
          SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
        FROM w JOIN comp c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
    """,
}
