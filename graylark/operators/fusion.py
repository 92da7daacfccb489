"""The gates between the layers and the fused score and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graylark.functions.columns import is_blank, with_round_tenth
from graylark.functions.constants import PHISHING_FROM, REVIEW_FROM, SUSPICIOUS_FROM
from graylark.operators.rules import auth_all_pass


def gate(ensemble: bool = False) -> Column:
    """Whether layer two runs: not for a low score with everything authenticated, unless the ensemble is wanted; never for blank text."""
    quiet = (F.col("infra_risk_score") < REVIEW_FROM) & auth_all_pass(F.col("spf"), F.col("dkim"), F.col("dmarc"))
    return (F.lit(ensemble) | ~quiet) & ~is_blank(F.col("full_text"))


def had_data() -> Column:
    """Whether layer one saw anything: an authentication verdict or a reason."""
    return F.col("spf").isNotNull() | F.col("dkim").isNotNull() | F.col("dmarc").isNotNull() | (F.size("reasons") > 0)


def phish_probability(probabilities: Column) -> Column:
    """One minus the probability of ham, in four places; a missing ham class counts as zero."""
    return F.round(1 - F.coalesce(F.element_at(probabilities, "ham"), F.lit(0.0)), 4)


def with_fused_score(df: DataFrame, l1: str, p: str, had: str, to: str) -> DataFrame:
    """Adds the fused score: layer one alone where ``p`` is null; else the mean of both, raised to what either layer demands by itself."""
    s = F.col(p) * 100
    blend = 0.5 * F.col(l1) + 0.5 * s
    x = F.when(F.col(had), F.greatest(blend, F.col(l1), 0.9 * s)).otherwise(F.greatest(blend, 0.75 * s))
    out = with_round_tenth(df, "_rounded", F.coalesce(F.least(x, F.lit(100.0)), F.lit(0.0)))
    return out.withColumn(to, F.when(F.col(p).isNull(), F.col(l1)).otherwise(F.col("_rounded"))).drop("_rounded")


def verdict_of(score: Column) -> Column:
    return F.when(score >= PHISHING_FROM, "phishing").when(score >= SUSPICIOUS_FROM, "suspicious").otherwise("clean")


def with_final_verdict(df: DataFrame, score: str, had: str, label: str, to: str) -> DataFrame:
    """Adds the verdict: without layer-one data phishing is demoted to suspicious; phishing that reads machine-written is named so."""
    out = df.withColumn("_base", verdict_of(F.col(score)))
    phishing = F.col("_base") == "phishing"
    named = F.when(phishing & ~F.col(had), "suspicious").when(phishing & F.col(label).eqNullSafe("ai_phish"), "ai_phish").otherwise(F.col("_base"))
    return out.withColumn(to, named).drop("_base")


def fused(df: DataFrame) -> DataFrame:
    """Adds the fused columns to a frame with layer-one columns and, where layer two ran, its prediction."""
    out = df.withColumn("layer1_had_data", had_data())
    out = out.withColumn("layer2_phish_probability", F.when(F.col("layer2_ran"), phish_probability(F.col("probabilities"))))
    out = out.withColumn("layer2_predicted_label", F.when(F.col("layer2_ran"), F.col("predicted_label")))
    out = with_fused_score(out, "infra_risk_score", "layer2_phish_probability", "layer1_had_data", "final_risk_score")
    return with_final_verdict(out, "final_risk_score", "layer1_had_data", "layer2_predicted_label", "final_verdict")


def attribution_gate() -> Column:
    """Layer three looks at plain phishing only."""
    return F.col("final_verdict") == "phishing"
