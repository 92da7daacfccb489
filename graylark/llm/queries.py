"""The pN_ queries of the text operators and the SQL checks of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graylark.llm import confusable, leakage, mixing, mojibake, neardup, overlap, pii, replies, sentences

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (table, key, column) of what problems 5 and 6 cover.
P5_PARTS = (("dataset", "record_id", "text"), ("risk_assessment", "assessment_id", "from_address"))
P6_PARTS = (("dataset", "record_id", "text"), ("risk_assessment", "assessment_id", "from_address"), ("domain_analysis", "assessment_id", "sender_domain"))


def _united(spark: SparkSession, sf_dir: str, parts: tuple, operator: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """``(tab, row_key, ...)``: an operator's rows over several columns."""
    frames = [operator(_table(spark, sf_dir, tab), key, column).withColumnRenamed(key, "row_key") for tab, key, column in parts]
    return functools.reduce(DataFrame.unionByName, [f.select(F.lit(tab).alias("tab"), *f.columns) for f, (tab, _, _) in zip(frames, parts)])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged_records(_table(spark, sf_dir, "dataset"), "record_id", "text")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(_table(spark, sf_dir, "dataset"), "record_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.foreign_rows(_table(spark, sf_dir, "dataset"), "record_id", "text")


def p2_own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.own_texts(_table(spark, sf_dir, "dataset"), "record_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.similar_pairs(_table(spark, sf_dir, "dataset"), "record_id", "text", 0.7)
    return pairs.selectExpr("id_a AS record_id_a", "id_b AS record_id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(_table(spark, sf_dir, "dataset"), "record_id", "text", 0.7)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _table(spark, sf_dir, "val"), _table(spark, sf_dir, "test")
    found = overlap.overlaps(_table(spark, sf_dir, "train"), val.unionByName(test), "row_id", "text", 0.7)
    splits = val.selectExpr("row_id AS eval_id", "'val' AS split").unionByName(test.selectExpr("row_id AS eval_id", "'test' AS split"))
    return found.join(splits, "eval_id").selectExpr("split", "eval_id AS eval_row_id", "train_id AS train_row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = {name: _table(spark, sf_dir, name) for name in ("val", "test")}
    return overlap.overlap_report(_table(spark, sf_dir, "train"), splits, "row_id", "text", "source", 0.7)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [pii.mention_rows(_table(spark, sf_dir, tab), key, column, tab, pii.FIVE) for tab, key, column in P5_PARTS]
    return frames[0].unionByName(frames[1])


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _united(spark, sf_dir, P5_PARTS, pii.redacted)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [confusable.cases(_table(spark, sf_dir, tab), key, column, tab) for tab, key, column in P6_PARTS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _united(spark, sf_dir, P6_PARTS, confusable.unify)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), "doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), "doc_id", "item_id")


def p8_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.manifest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_rows(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def _word_sets(source: str, key: str, extra: str = "") -> str:
    """Distinct words per row, as problem 3 defines them."""
    return f"SELECT {key} AS id{extra}, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) AS ws FROM {source} WHERE text IS NOT NULL"


def _shingles(source: str, key: str, words: int = 8) -> str:
    """Distinct runs of words per row, as problem 7 defines them."""
    ws = f"SELECT {key} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {source} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT id, array_to_string(ws[i:i + {words - 1}], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - {words - 2})) AS i FROM ({ws}))"


_EVALUATION = "(SELECT *, 'val' AS split FROM val UNION ALL SELECT *, 'test' AS split FROM test)"


def oracle_sql() -> dict[str, str]:
    """Plain forms of the queries that SQL can express, over whole tables."""
    return {
        "p3_found": f"""WITH s AS MATERIALIZED ({_word_sets('dataset', 'record_id')}), w AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM s),
c AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id)
SELECT x AS record_id_a, y AS record_id_b FROM c WHERE 10 * common >= 7 * (nx + ny - common)""",
        "p3_groups": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM ({_word_sets('dataset', 'record_id')}) WHERE len(ws) > 0), w AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM s),
c AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id),
p AS MATERIALIZED (SELECT x, y FROM c WHERE 10 * common >= 7 * (nx + ny - common)), e AS MATERIALIZED (SELECT x AS a, y AS b FROM p UNION ALL SELECT y, x FROM p),
r(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT s.id, coalesce(m.least_id, s.id) AS class_id, coalesce(l.n, 0) AS n_links FROM s LEFT JOIN (SELECT id, min(other) AS least_id FROM r GROUP BY id) m ON s.id = m.id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON s.id = l.a""",
        "p4_found": f"""WITH e AS MATERIALIZED ({_word_sets(_EVALUATION, 'row_id', ', split')}), t AS MATERIALIZED ({_word_sets('train', 'row_id')}),
ew AS (SELECT id, split, len(ws) AS n, unnest(ws) AS word FROM e), tw AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM t),
c AS (SELECT split, a.id AS x, b.id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM ew a JOIN tw b ON a.word = b.word GROUP BY split, a.id, b.id)
SELECT split, x AS eval_row_id, y AS train_row_id FROM c WHERE 10 * common >= 7 * (nx + ny - common)""",
        "p7_found": f"WITH d AS ({_shingles('documents', 'doc_id')}), i AS ({_shingles('eval_items', 'item_id')}) SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i USING (g)",
    }
