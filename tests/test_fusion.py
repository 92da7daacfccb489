"""Goldens of gates, rounding and fusion."""

import random

import pytest
from pyspark.sql import functions as F

from graylark.functions.columns import with_round_tenth
from graylark.operators import fusion


@pytest.mark.parametrize(
    "l1, had, ham, label, score, verdict",
    [
        (0.0, True, None, None, 0.0, "clean"), (0.0, True, 0.05, "phishing", 85.5, "phishing"), (0.0, True, 0.05, "ai_phish", 85.5, "ai_phish"), (0.0, False, 0.0, "phishing", 75.0, "suspicious"),
        (0.0, False, 0.0, "ai_phish", 75.0, "suspicious"), (0.0, False, 0.65, "phishing", 26.2, "clean"), (65.0, True, 1.0, "ham", 65.0, "phishing"), (27.0, True, 0.671, "ham", 29.9, "clean"), (29.0, True, 0.691, "ham", 29.9, "clean"),
    ],
)
def test_truth_table(spark, l1, had, ham, label, score, verdict):
    df = spark.createDataFrame([(l1, had, ham, label)], "l1 double, had boolean, ham double, label string").withColumn("p", F.round(1 - F.col("ham"), 4))
    out = fusion.with_final_verdict(fusion.with_fused_score(df, "l1", "p", "had", "s"), "s", "had", "label", "v").first()
    assert (out.s, out.v) == (score, verdict)


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    xs = [0.0, 100.0, 0.05, 0.15, 0.25, 26.25, 29.95, 0.35, 99.95] + [rng.randrange(0, 10**6) / 10**4 for _ in range(20000)] + [0.5 * a + 50 * (1 - b / 1000) for a in range(0, 101, 7) for b in range(0, 1001, 13)]
    xs = [x for x in xs if 0 <= x <= 100]
    rows = with_round_tenth(spark.createDataFrame([(x,) for x in xs], "x double"), "r", F.col("x")).collect()
    assert [r.r for r in rows] == [round(r.x, 1) for r in rows]


def test_gate(spark):
    df = spark.createDataFrame(
        [(0.0, "pass", "pass", "pass", "t"), (0.0, "pass", "pass", None, "t"), (15.0, "pass", "pass", "pass", "t"), (50.0, None, None, None, " \n")],
        "infra_risk_score double, spf string, dkim string, dmarc string, full_text string",
    )
    assert [r[0] for r in df.select(fusion.gate()).collect()] == [False, True, True, False]
    assert [r[0] for r in df.select(fusion.gate(True)).collect()] == [True, True, True, False]


def test_missing_ham_counts_as_phishing(spark):
    row = spark.sql("select map('class_1', 0.4D) m").select(fusion.phish_probability(F.col("m")).alias("p")).first()
    assert row.p == 1.0
