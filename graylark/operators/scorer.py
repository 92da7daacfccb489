"""Layer two: text scorers behind one interface.

A scorer adds ``probabilities map<string,double>`` (rounded to four places) for a text column; label, confidence and
preview follow from it.  Three come with the package: a lexical softmax in plain expressions (a demo), an MLlib pipeline, and an
adapter for an outside model that scores Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graylark.functions.columns import count_contained, is_blank
from graylark.functions.constants import BINARY_LABELS, LABELS

PREVIEW = 120
MAX_TOKENS = 256
#: Words of the demo scorer: a stand-in that needs no training, not a classifier to rely on.
PHISH_TERMS = ("verify", "password", "account", "confirm", "suspended", "locked", "click", "refund", "gift card", "mailbox", "urgent", "invoice", "overdue", "claim")
AI_TERMS = ("at your convenience", "kindly", "furthermore", "please be advised", "we would like to", "ensure", "as discussed", "do not hesitate")
HAM_TERMS = ("lunch", "train", "survey", "review", "backup", "tracking", "thanks", "regards", "team", "office")
WEIGHTS = {"ham": (1.0, 0.55), "phishing": (0.4, 0.6), "ai_phish": (0.1, 0.5)}


TERMS = {"ham": HAM_TERMS, "phishing": PHISH_TERMS, "ai_phish": AI_TERMS}


def lexical_scorer(df: DataFrame, text: str) -> DataFrame:
    """Softmax over counts of words that speak for each class; blank texts get no probabilities.

    Every step is a column of its own; Catalyst keeps such steps apart as long as nothing is filtered by the outcome.
    """
    names = list(LABELS.values())
    out = df.withColumn("_low", F.lower(F.col(text)))
    out = out.withColumns({f"_l_{k}": F.lit(WEIGHTS[k][0]) + count_contained(F.col("_low"), TERMS[k]) * F.lit(WEIGHTS[k][1]) for k in names})
    out = out.withColumn("_top", F.greatest(*[f"_l_{k}" for k in names]))
    out = out.withColumns({f"_e_{k}": F.exp(F.col(f"_l_{k}") - F.col("_top")) for k in names})
    out = out.withColumn("_sum", F.col(f"_e_{names[0]}") + F.col(f"_e_{names[1]}") + F.col(f"_e_{names[2]}"))
    values = F.create_map(*[x for k in names for x in (F.lit(k), F.round(F.col(f"_e_{k}") / F.col("_sum"), 4))])
    out = out.withColumn("probabilities", F.when(~is_blank(F.col(text)), values))
    return out.drop("_low", "_top", "_sum", *[f"_{x}_{k}" for k in names for x in "le"])


def lexical_batch(texts: list[str]) -> list[dict[str, float]]:
    """The lexical scorer as a plain function over a batch, for :func:`batch_scorer`."""
    import math

    out = []
    for text in texts:
        low = text.lower()
        logits = {k: WEIGHTS[k][0] + sum(t in low for t in TERMS[k]) * WEIGHTS[k][1] for k in LABELS.values()}
        top = max(logits.values())
        powers = {k: math.exp(v - top) for k, v in logits.items()}
        out.append({k: v / sum(powers.values()) for k, v in powers.items()})
    return out


def preview(text: Column, size: int = PREVIEW) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.concat(F.left(text, F.lit(size)), F.when(F.length(text) > size, "…").otherwise(""))


def label_name(index: Column, labels: dict[int, str] | None = None) -> Column:
    """Name of a class index; without a label map the index gets a generic name."""
    if not labels:
        return F.concat(F.lit("class_"), index.cast("string"))
    out = F.when(F.lit(False), F.lit(""))
    for k, v in labels.items():
        out = out.when(index == k, v)
    return out.otherwise(F.concat(F.lit("class_"), index.cast("string")))


def predicted(df: DataFrame, text: str, probabilities: str = "probabilities") -> DataFrame:
    """Adds ``predicted_label``, ``confidence``, ``text_preview`` and, for blank texts, ``error``."""
    p = F.col(probabilities)
    best = F.array_max(F.map_values(p))
    return (
        df.withColumn("confidence", best)
        .withColumn("predicted_label", F.element_at(F.map_keys(p), F.array_position(F.map_values(p), best).cast("int")))
        .withColumn("text_preview", F.when(p.isNotNull(), preview(F.col(text))))
        .withColumn("error", F.when(is_blank(F.col(text)), "empty text"))
    )


def collapse_label(label: Column) -> Column:
    """Phishing of any kind against the rest."""
    return (label > 0).cast("int")


def class_weights(df: DataFrame, label: str, classes: list[int] | None = None) -> DataFrame:
    """``(label, class_weight)``: rows over classes times the class count; a class without rows counts as one row."""
    classes = classes if classes is not None else sorted(LABELS)
    grid = df.sparkSession.createDataFrame([(c,) for c in classes], "label int")
    counts = df.where(F.col(label).isin(classes)).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    joined = grid.join(F.broadcast(counts), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the few rows of the grid
    return joined.select("label", F.col("n").alias("class_rows"), (total / (F.lit(float(len(classes))) * F.greatest("n", F.lit(1)))).alias("class_weight"))


def text_pipeline(features: int = 1 << 16, reg: float = 1e-4, iterations: int = 30) -> Pipeline:
    """Tokens (the first 256 of a text), hashed counts, IDF and a weighted multinomial regression."""
    from pyspark.ml.feature import SQLTransformer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_all", pattern=r"[^\p{L}\p{N}]+"),
            SQLTransformer(statement=f"SELECT *, slice(_all, 1, {MAX_TOKENS}) AS _tokens FROM __THIS__"),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="label", weightCol="class_weight", family="multinomial", regParam=reg, maxIter=iterations),
        ]
    )


def train(df: DataFrame, reg: float = 1e-4, iterations: int = 30, binary: bool = False) -> PipelineModel:
    """Fit on ``(text, label)``; rows with a null are left out, classes are weighted by their rarity."""
    rows = df.select("text", F.col("label").cast("int").alias("label")).dropna()
    if binary:
        rows = rows.withColumn("label", collapse_label(F.col("label")))
    weights = class_weights(rows, "label", sorted(BINARY_LABELS if binary else LABELS)).select("label", "class_weight")
    return text_pipeline(reg=reg, iterations=iterations).fit(rows.join(F.broadcast(weights), "label"))


def select_model(train_df: DataFrame, validation: DataFrame, regs: tuple[float, ...] = (1e-4, 1e-2), binary: bool = False) -> tuple[PipelineModel, float]:
    """The model with the best validation score: recall of phishing for two classes, macro F1 for more."""
    from graylark.operators.metrics import binary_scores, macro_scores

    best: tuple[float, PipelineModel, float] | None = None
    for reg in regs:
        model = train(train_df, reg, binary=binary)
        rows = validation.select("text", F.col("label").cast("int").alias("label")).dropna()
        if binary:
            rows = rows.withColumn("label", collapse_label(F.col("label")))
        pairs = model.transform(rows).select(F.col("label").alias("y"), F.col("prediction").cast("int").alias("p"))
        score = binary_scores(pairs).first()["recall"] if binary else macro_scores(pairs).first()["macro_f1"]
        if best is None or score > best[0]:
            best = (score, model, reg)
    return best[1], best[2]


def mllib_scorer(df: DataFrame, text: str, model: PipelineModel, labels: dict[int, str] | None = None) -> DataFrame:
    """Adds ``probabilities`` from a fitted pipeline."""
    names = labels or {i: f"class_{i}" for i in range(model.stages[-1].numClasses)}
    out = model.transform(df.withColumn("text", F.coalesce(F.col(text), F.lit("")))).withColumn("_p", vector_to_array("probability"))
    values = F.create_map(*[x for k, v in names.items() for x in (F.lit(v), F.round(F.col("_p")[k], 4))])
    return out.withColumn("probabilities", F.when(~is_blank(F.col(text)), values)).select(*df.columns, "probabilities")


def batch_scorer(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]) -> DataFrame:
    """Adds ``probabilities`` from an outside model; ``load`` runs once per Python worker and returns a batch function."""

    @F.pandas_udf("map<string,double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            given = [t for t in texts if t and t.strip()]
            scores = iter(model(given)) if given else iter(())
            yield pd.Series([{k: round(float(v), 4) for k, v in next(scores).items()} if t and t.strip() else None for t in texts])

    return df.withColumn("probabilities", score(F.col(text)))
