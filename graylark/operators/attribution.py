"""Layer three: attribution of confirmed phishing by a language model behind a provider interface."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graylark.functions.constants import OBJECTIVES, SOPHISTICATION, TRIGGERS
from graylark.operators.fusion import attribution_gate

DISCLAIMER = "Machine-made hypothesis for analysts; verify before acting on it."
ANSWER_SCHEMA = (
    "primary_objective string, psychological_triggers array<string>, target_persona string, sophistication string, key_indicators array<string>, illustrative_generation_prompt string, analyst_summary string"
)
RAW_KEPT = 500
TIMEOUT_S, PROBE_S = 120, 2
#: Model calls that one task has open at a time.
CALLS = 4

#: Takes a prompt, returns the model's text; raises to report an error.
Provider = Callable[[str], str]


#: What each key of the answer may hold, as the prompt states it.
KEYS = {
    "primary_objective": "one of " + ", ".join(OBJECTIVES), "psychological_triggers": "a list of some of " + ", ".join(TRIGGERS), "target_persona": "the role this mail is aimed at, in a few words", "sophistication": "one of " + ", ".join(SOPHISTICATION),
    "key_indicators": "a list of the cues in wording and structure that you relied on", "illustrative_generation_prompt": "an example, marked as a guess, of an instruction that could have produced such a text", "analyst_summary": "one or two sentences for an analyst",
}
INSTRUCTION = (
    "The mail below is confirmed phishing. Describe how it works for the analysts who defend against it. Use only what the mail holds; invent no names, addresses or links.\n"
    "Answer with one JSON object and nothing else. Its keys:\n" + "\n".join(f"- {k}: {v}" for k, v in KEYS.items())
)


def prompt() -> Column:
    """Instruction with the allowed values, the mail, and what the rules found."""
    verdicts = [F.concat(F.lit(f"{m}="), F.coalesce(m, F.lit("unknown"))) for m in ("spf", "dkim", "dmarc")]
    return F.concat(
        F.lit(INSTRUCTION + "\n\nSubject: "), F.col("subject"), F.lit("\n\n"), F.col("body_text"), F.lit("\n\nEvidence of the rules\n- authentication: "), F.concat_ws(", ", *verdicts), F.lit("\n- sender: "), F.col("from_address"),
        F.lit("\n- findings: "), F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise("none"),
    )


def json_object(answer: Column) -> Column:
    """The whole answer if it is a JSON object, else what stands between its first { and last }; null if neither parses."""
    whole = F.regexp_extract(answer, r"(?s)\A\s*(\{.*\})\s*\z", 1)
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when((F.length(c) > 0) & F.try_parse_json(c).isNotNull(), c) if hasattr(F, "try_parse_json") else c
    return F.coalesce(ok(whole), ok(inner))


def envelope(answer: Column, status: Column, detail: Column, model: str) -> Column:
    """Struct (answer, meta): ok, unavailable, error, or parse_error with the start of the raw text; always the disclaimer."""
    found = json_object(answer)
    state = F.when(status != "ok", status).when(found.isNull(), "parse_error").otherwise("ok")
    meta = F.struct(
        state.alias("status"), detail.alias("detail"), F.lit(DISCLAIMER).alias("disclaimer"), F.lit(model).alias("model"),
        F.when(state == "parse_error", F.left(answer, F.lit(RAW_KEPT))).alias("raw"),
    )
    return F.struct(F.when(state == "ok", F.from_json(found, ANSWER_SCHEMA)).alias("answer"), meta.alias("meta"))


def probe(url: str, model: str, timeout: float = PROBE_S) -> tuple[bool, str]:
    """Whether a local model server answers and lists the model (by part of its name)."""
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=timeout) as r:
            names = [m.get("name", "") for m in json.load(r).get("models", [])]
    except (urllib.error.URLError, OSError) as e:
        return False, f"model server unreachable: {e}"
    except ValueError as e:
        return False, f"unexpected answer: {e}"
    return (True, "ok") if any(model in n for n in names) else (False, f"model {model!r} isn't installed")


def http_provider(url: str, model: str, timeout: float = TIMEOUT_S) -> Provider:
    """A provider for a local model server that speaks the generate protocol."""

    def ask(text: str) -> str:
        body = json.dumps({"model": model, "prompt": text, "stream": False, "format": "json", "options": {"temperature": 0.3}}).encode()
        request = urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.load(r).get("response", "")

    return ask


def _asked(provider: Provider, prompt_text: str | None) -> tuple[str | None, str | None, str | None]:
    """(status, detail, answer) of one call; a failed call is a row with its error."""
    if prompt_text is None:
        return None, None, None
    try:
        return "ok", None, provider(prompt_text)
    except Exception as e:
        return "error", str(e)[:RAW_KEPT], None


def attributed(df: DataFrame, provider: Provider | None = None, model: str = "none", enabled: bool = True, calls: int = CALLS) -> DataFrame:
    """Adds ``layer3`` and ``layer3_ran``: null for what the gate leaves out, an envelope for the rest.

    The provider gets the prompts of gated rows only (Python sees nulls for the others), at most ``calls`` at a time in each
    task; without a provider, and in a plan without layer three, no Python runs at all.
    """
    chosen = F.coalesce(attribution_gate(), F.lit(False)) & F.lit(enabled)
    out = df.withColumn("_chosen", chosen)
    if provider is None:
        out = out.withColumn("_a", F.struct(F.lit("unavailable").alias("status"), F.lit("no model configured").alias("detail"), F.lit(None).cast("string").alias("answer")))
    else:

        @F.pandas_udf("status string, detail string, answer string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(calls) as pool:
                for prompts in batches:
                    yield pd.DataFrame(list(pool.map(lambda p: _asked(provider, p), prompts)), columns=["status", "detail", "answer"])

        out = out.withColumn("_a", ask(F.when(F.col("_chosen"), prompt())))
    out = out.withColumn("layer3", F.when(F.col("_chosen"), envelope(F.col("_a.answer"), F.col("_a.status"), F.col("_a.detail"), model)))
    return out.withColumn("layer3_ran", F.coalesce(F.col("layer3.meta.status") == "ok", F.lit(False))).drop("_a", "_chosen")
