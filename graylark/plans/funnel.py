"""The scoring funnel as one plan: parse, rules, gate, classifier, fusion, attribution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graylark.operators.attribution import Provider, attributed
from graylark.operators.fusion import fused, gate
from graylark.operators.parse import parsed, subject_and_body, with_body
from graylark.operators.rules import scored, signals
from graylark.operators.scorer import lexical_scorer, predicted

Scorer = Callable[[DataFrame, str], DataFrame]
LAYER1 = ("message_id", "from_address", "sender_domain", "infra_risk_score", "verdict", "reasons")


def assessed(df: DataFrame, raw: str = "raw_eml", ages: DataFrame | None = None) -> DataFrame:
    """Layer one for a frame of raw messages; nothing leaves the JVM but multipart messages."""
    out = scored(signals(with_body(parsed(df, raw), raw), ages))
    return out.withColumn("full_text", subject_and_body(F.col("subject"), F.col("body_text")))


def classified(df: DataFrame, scorer: Scorer = lexical_scorer, ensemble: bool = False) -> DataFrame:
    """Layer two for the rows that pass the gate; a scorer sees a null instead of the text of any other row."""
    marked = df.withColumn("layer2_ran", gate(ensemble)).withColumn("_l2", F.when(F.col("layer2_ran"), F.col("full_text")))
    out = predicted(scorer(marked, "_l2"), "_l2")
    return out.withColumn("error", F.when(F.col("layer2_ran"), F.col("error"))).drop("_l2")


def verdicts(df: DataFrame, raw: str = "raw_eml", scorer: Scorer = lexical_scorer, ensemble: bool = False, ages: DataFrame | None = None) -> DataFrame:
    """Layer one, gate, layer two and fusion."""
    return fused(classified(assessed(df, raw, ages), scorer, ensemble))


def analyze(df: DataFrame, raw: str = "raw_eml", scorer: Scorer = lexical_scorer, ensemble: bool = False, run_layer3: bool = False, provider: Provider | None = None, model: str = "none", ages: DataFrame | None = None) -> DataFrame:
    """The whole funnel with nested layer results, one row per message."""
    out = attributed(verdicts(df, raw, scorer, ensemble, ages), provider, model, run_layer3)
    given = [c for c in df.columns if c != raw]
    layer2 = F.when(F.col("layer2_ran"), F.struct("predicted_label", "confidence", "probabilities", "text_preview", "error"))
    return out.select(
        *given, "final_verdict", "final_risk_score", "layer2_phish_probability", "layer2_predicted_label", "layer1_had_data", "layer2_ran", "layer3_ran",
        F.struct(*LAYER1).alias("layer1"), layer2.alias("layer2"), "layer3",
    )


def health(spark: SparkSession, models: str | None = None, url: str | None = None, model: str = "llama3.2") -> dict:
    """State of the service: a session, the model that would be loaded, and whether a model server can attribute."""
    from graylark.operators.attribution import probe
    from graylark.sources.writers import default_model

    try:
        loaded = default_model(models) if models else None
    except FileNotFoundError:
        loaded = None
    return {"status": "ok" if spark is not None else "down", "model_loaded": loaded, "layer3_available": probe(url, model)[0] if url else False}


def analyze_one(spark: SparkSession, raw: str, models: str | None = None, model: str | None = None, ensemble: bool = False, run_layer3: bool = False, provider: Provider | None = None) -> tuple[int, dict]:
    """The service form for one message: a status like that of HTTP, and the result or a detail.

    503 if models are wanted and there is none, 500 if one can't be loaded or the analysis fails, else 200.
    """
    import json

    from graylark.operators.scorer import mllib_scorer
    from graylark.sources.readers import from_text
    from graylark.sources.writers import default_model, json_document, load_model

    scorer: Scorer = lexical_scorer
    if models or model:
        try:
            fitted, labels = load_model(model or f"{models}/{default_model(models)}")
        except FileNotFoundError as e:
            return 503, {"detail": str(e)}
        except Exception as e:
            return 500, {"detail": f"the model can't be loaded: {e}"[:500]}
        scorer = lambda df, text: mllib_scorer(df, text, fitted, labels)
    try:
        out = analyze(from_text(spark, raw), scorer=scorer, ensemble=ensemble, run_layer3=run_layer3, provider=provider).drop("email_id")
        return 200, json.loads(out.select(json_document(*out.columns).alias("j")).first().j)
    except Exception as e:
        return 500, {"detail": f"the analysis failed: {e}"[:500]}
