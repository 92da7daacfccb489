"""Roll-ups of verdicts and the small display mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT = 12


def verdict_counts(df: DataFrame, verdict: str = "final_verdict") -> DataFrame:
    """Six counters over the few rows of a count by verdict, so the verdict is computed once per message."""
    v = F.col(verdict)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return df.groupBy(v).agg(F.count("*").alias("n")).agg(
        n(F.lit(True))("total"), n(v == "ai_phish")("ai_phish"), n(v == "phishing")("phishing_human"), n(v.isin("phishing", "ai_phish"))("phishing_all"),
        n(v == "suspicious")("suspicious"), n(v == "clean")("clean"),
    )


def verdict_shares(counts: DataFrame) -> DataFrame:
    """Percentages of the three segments, zero for an empty set."""
    share = lambda c: F.coalesce(100.0 * F.col(c) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias(f"{c}_pct")
    return counts.select(share("phishing_all"), share("suspicious"), share("clean"))


def recent(df: DataFrame, order: list[Column], limit: int = RECENT) -> DataFrame:
    """The newest results (a top-k, not a full sort), score rounded half up, dashes for missing fields."""
    dash = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "—").otherwise(F.col(c))
    return df.orderBy(*order).limit(limit).withColumn("score", F.floor(F.col("final_risk_score") + 0.5).cast("bigint")).withColumn("sender", dash("from_address")).withColumn("title", dash("subject"))


def verdict_class(v: Column) -> Column:
    """Display class of the React-like view: anything unknown shows as clean."""
    return F.when(v.isin("phishing", "ai_phish"), "phishing").when(v == "suspicious", "suspicious").otherwise("clean")


def verdict_title(v: Column) -> Column:
    return F.when(v == "ai_phish", "AI-generated phishing").when(v == "phishing", "Phishing").when(v == "suspicious", "Suspicious").when(v == "clean", "Clean").otherwise("Unknown")


def verdict_colour(v: Column) -> Column:
    """Colour of the other view: anything unknown is grey."""
    return F.when(v.isin("phishing", "ai_phish"), "red").when(v == "suspicious", "amber").when(v == "clean", "green").otherwise("grey")


def auth_chip(result: Column) -> Column:
    return F.when(result.eqNullSafe("pass"), "pass").when(result.eqNullSafe("fail"), "fail").otherwise("unknown")


def decision_path(layer2_ran: Column) -> Column:
    return F.when(layer2_ran, "Layer 1 + Layer 2").otherwise("Layer 1 only")


def percent(p: Column) -> Column:
    return F.format_string("%.1f", p * 100)


def score_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def score_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")
