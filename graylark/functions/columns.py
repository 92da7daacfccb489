"""Column helpers whose results follow Python's, bit for bit, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graylark.functions.constants import BLANKS


def strip(c: Column) -> Column:
    """Python's ``str.strip``."""
    return F.regexp_replace(c, f"\\A[{BLANKS}]+|[{BLANKS}]+\\z", "")


def collapse_blanks(c: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return strip(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def with_round_tenth(df: DataFrame, name: str, x: Column) -> DataFrame:
    """Adds Python's ``round(x, 1)`` for 0 <= x <= 100: half-even on the exact binary value.

    The double is an integer over a power of two; quotient and remainder of ten times that integer decide exactly.
    The steps are columns, so that no step's expression is repeated in the next.
    """
    out = df.withColumn("_rx", x).withColumn("_rm", F.when(F.col("_rx") < 1, F.lit(1 << 59).cast("bigint")).otherwise(F.lit(1 << 52).cast("bigint")))
    out = out.withColumn("_rn", F.floor(F.col("_rx") * F.col("_rm").cast("double")).cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)"))
    out = out.withColumn("_rq", F.expr("_rn div cast(_rm as decimal(20,0))"))
    out = out.withColumn("_rr", ((F.col("_rn") - F.col("_rq") * F.col("_rm").cast("decimal(20,0)")) * 2).cast("decimal(38,0)"))
    up = (F.col("_rr") > F.col("_rm")) | ((F.col("_rr") == F.col("_rm")) & (F.col("_rq") % 2 == 1))
    return out.withColumn(name, (F.col("_rq") + F.when(up, 1).otherwise(0)) / F.lit(10.0)).drop("_rx", "_rm", "_rn", "_rq", "_rr")


def count_contained(c: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in ``c``."""
    total = F.lit(0)
    for t in terms:
        total = total + F.when(F.contains(c, F.lit(t)), 1).otherwise(0)
    return total


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def list_text(c: Column) -> Column:
    """An array of strings the way Python prints a list of plain strings."""
    return F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))
