"""Evaluation aggregates over frames of truth ``y`` and prediction ``p``.

Every figure comes from the counts of the distinct (y, p), a handful of rows: predictions are computed once per row,
combined before the shuffle, and whatever expression made them stands in the plan once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graylark.functions.constants import LABELS


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, *columns: str) -> DataFrame:
    """``(*columns, n)`` with the columns as numbers; ``y`` and ``p`` by default."""
    columns = columns or ("y", "p")
    return df.groupBy(*[F.col(c).cast("int").alias(c) for c in columns]).agg(F.count("*").alias("n"))


def _summed(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def confusion(df: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """Dense matrix ``(y, p, n)`` over all labels.

    A join to a grid of labels would push null checks, and with them the whole prediction, into the scan once more.
    """
    cells = [(y, p) for y in labels or sorted(LABELS) for p in labels or sorted(LABELS)]
    one = pair_counts(df).agg(*[_summed((F.col("y") == y) & (F.col("p") == p)).alias(f"n{i}") for i, (y, p) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(p).alias("p"), F.col(f"n{i}").alias("n")) for i, (y, p) in enumerate(cells)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def row_normalised(matrix: DataFrame) -> DataFrame:
    """Each cell over its row's sum (at least one)."""
    from pyspark.sql import Window

    return matrix.select("y", "p", (F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("y")), F.lit(1))).alias("share"))


def per_class(df: DataFrame, names: Mapping[int, str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label of the map; a zero denominator gives zero."""
    return _per_class(pair_counts(df), names or LABELS)


def _per_class(counts: DataFrame, names: Mapping[int, str]) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    sums = [_summed(c).alias(f"{f}{k}") for k in names for f, c in (("t", (y == k) & (p == k)), ("p", p == k), ("y", y == k))]
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("name"), *[F.col(f"{c}{k}").alias(c) for c in "tpy"]) for k, v in names.items()])
    long = counts.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
    out = long.withColumn("precision", _ratio(F.col("t"), F.col("p"))).withColumn("recall", _ratio(F.col("t"), F.col("y")))
    out = out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("label", "name", "precision", "recall", "f1", F.col("y").alias("support"), F.col("p").alias("predicted"))


def accuracy(df: DataFrame) -> DataFrame:
    known = F.col("y").isNotNull() & F.col("p").isNotNull()
    share = _summed(F.col("y") == F.col("p")) / F.nullif(_summed(known), F.lit(0))
    return pair_counts(df).agg(F.coalesce(share, F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def macro_scores(df: DataFrame, names: Mapping[int, str] | None = None) -> DataFrame:
    """Unweighted means over the labels that occur in truth or prediction."""
    present = per_class(df, names).where("support > 0 or predicted > 0")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}")
    return present.agg(mean("precision"), mean("recall"), mean("f1"))


def binary_scores(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall and F1 with 1 as the positive class."""
    return _binary(pair_counts(df.select(F.col(y).alias("y"), F.col(p).alias("p"))))


def _binary(counts: DataFrame) -> DataFrame:
    a, b = F.col("y"), F.col("p")
    one = counts.agg(_summed((a == 1) & (b == 1)).alias("t"), _summed(b == 1).alias("p"), _summed(a == 1).alias("y"))
    out = one.withColumn("precision", _ratio(F.col("t"), F.col("p"))).withColumn("recall", _ratio(F.col("t"), F.col("y")))
    return out.select("precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def class_recalls(df: DataFrame) -> DataFrame:
    """Recall of the three fixed labels, one row each."""
    return per_class(df).select("label", "recall")


def layer_comparison(df: DataFrame) -> DataFrame:
    """Binary F1 of the model, the rules and either of them; null for the last two without a ``rules_pred`` column."""
    if "rules_pred" not in df.columns:
        empty = df.sparkSession.createDataFrame([("rules_only", None), ("fused", None)], "layer string, f1 double")
        return binary_scores(df).select(F.lit("model_only").alias("layer"), "f1").unionByName(empty)
    counts = pair_counts(df, "y", "p", "rules_pred")
    ways = {"model_only": F.col("p"), "rules_only": F.col("rules_pred"), "fused": F.greatest("p", "rules_pred")}
    long = counts.select("y", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), v.alias("p")) for k, v in ways.items()])).alias("w")).select("y", "n", "w.layer", "w.p")
    a, b = F.col("y"), F.col("p")
    one = long.groupBy("layer").agg(_summed((a == 1) & (b == 1)).alias("t"), _summed(b == 1).alias("p"), _summed(a == 1).alias("y"))
    named = one.sparkSession.createDataFrame([(k,) for k in ways], "layer string").join(F.broadcast(one), "layer", "left")
    return named.select("layer", F.coalesce(_ratio(2 * F.col("t"), F.col("p") + F.col("y")), F.lit(0.0)).alias("f1"))


def metrics_document(df: DataFrame, names: Mapping[int, str] | None = None) -> dict:
    """All figures of a prediction frame as one nested document (a handful of numbers)."""
    names = names or LABELS
    acc = accuracy(df).first()
    macro = macro_scores(df, names).first()
    binary = df.select((F.col("y") > 0).cast("int").alias("y"), (F.col("p") > 0).cast("int").alias("p"), *(["rules_pred"] if "rules_pred" in df.columns else []))
    return {
        "accuracy": acc.accuracy,
        "macro": {"precision": macro.macro_precision, "recall": macro.macro_recall, "f1": macro.macro_f1},
        "per_class": {r["name"]: {"precision": r.precision, "recall": r.recall, "f1": r.f1, "support": r.support} for r in per_class(df, names).collect()},
        "binary_f1": {r.layer: r.f1 for r in layer_comparison(binary).collect()},
        "n_test": acc.n,
    }


def report_lines(classes: DataFrame) -> DataFrame:
    """Table lines of a Markdown report, three decimals."""
    return classes.select("label", F.format_string("| %s | %.3f | %.3f | %.3f | %d |", "name", "precision", "recall", "f1", "support").alias("line"))
