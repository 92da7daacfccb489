"""Layer one: infrastructure signals, their score, the reasons and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graylark.functions.columns import list_text, literals
from graylark.functions.constants import (
    CONFUSABLE_FROM, CONFUSABLE_TO, ESCALATE_FROM, FREEMAIL_DOMAINS, LOOKALIKE_SCORED_FROM, POINTS, REVIEW_FROM, URGENCY_KEYWORDS, WATCHED_BRANDS, YOUNG_DOMAIN_DAYS,
)
from graylark.operators.parse import address, domain, link_domains


def is_freemail(dom: Column) -> Column:
    return dom.isin(*FREEMAIL_DOMAINS)


def fold_confusables(c: Column) -> Column:
    return F.translate(F.lower(c), CONFUSABLE_FROM, CONFUSABLE_TO)


def lookalike(dom: Column) -> Column:
    """Struct (score, brand) of the closest watched brand, null if none.

    Only the first label counts.  Within two edits of a brand (as written or folded) the score is one minus edits over the
    longer length; a folded label that contains a brand scores by its surplus length, 0.75 at least.  The first brand
    wins ties; a label that is or folds to the brand itself doesn't count.
    """
    root = F.substring_index(F.lower(dom), ".", 1)
    norm = fold_confusables(root)

    def scored(brand: Column) -> Column:
        edits = F.least(F.levenshtein(root, brand), F.levenshtein(norm, brand))
        close = F.when((edits > 0) & (edits <= 2), 1 - edits / F.greatest(F.length(brand), F.length(root)).cast("double")).otherwise(F.lit(0.0))
        inside = F.when(F.contains(norm, brand) & (norm != brand), F.greatest(F.lit(0.75), 1 - (F.length(norm) - F.length(brand)) / (3.0 * F.length(brand)))).otherwise(F.lit(0.0))
        return F.when((root == brand) | (F.length(root) == 0), F.lit(0.0)).otherwise(F.greatest(close, inside))

    ranked = F.array_sort(F.transform(literals(WATCHED_BRANDS), lambda b, i: F.struct((-scored(b)).alias("neg"), i.alias("rank"), b.alias("brand"))))
    best = F.element_at(ranked, 1)
    return F.when(best["neg"] < 0, F.struct(F.round(-best["neg"], 2).alias("score"), best["brand"].alias("brand")))


def reply_to_mismatch(reply_to: Column, dom: Column) -> Column:
    theirs = domain(address(reply_to))
    return (F.length(reply_to) > 0) & (F.length(theirs) > 0) & (theirs != dom)


def display_name_mismatch(display: Column, dom: Column) -> Column:
    low = F.lower(display)
    return (F.length(display) > 0) & F.exists(literals(WATCHED_BRANDS), lambda b: F.contains(low, b) & ~F.contains(dom, b))


def urgency_hits(subject: Column) -> Column:
    low = F.lower(subject)
    return F.filter(literals(URGENCY_KEYWORDS), lambda k: F.contains(low, k))


def link_mismatch(links: Column, dom: Column) -> Column:
    return (F.size(links) > 0) & (F.length(dom) > 0) & ~F.exists(links, lambda x: F.contains(x, dom) | F.contains(dom, x))


def auth_all_pass(spf: Column, dkim: Column, dmarc: Column) -> Column:
    return spf.eqNullSafe("pass") & dkim.eqNullSafe("pass") & dmarc.eqNullSafe("pass")


def auth_any_fail(spf: Column, dkim: Column, dmarc: Column) -> Column:
    return spf.eqNullSafe("fail") | dkim.eqNullSafe("fail") | dmarc.eqNullSafe("fail")


def signals(df: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Adds the signal columns to a parsed frame with bodies; ``ages (sender_domain, domain_age_days)`` is an optional dimension."""
    dom = F.col("sender_domain")
    out = df.withColumn("is_freemail", is_freemail(dom)).withColumn("_look", lookalike(dom))
    out = out.withColumn("lookalike_of", F.col("_look.brand")).withColumn("lookalike_score", F.coalesce(F.col("_look.score"), F.lit(0.0))).drop("_look")
    out = out.withColumn("reply_to_mismatch", reply_to_mismatch(F.col("reply_to"), dom))
    out = out.withColumn("display_name_mismatch", display_name_mismatch(F.col("from_display"), dom))
    out = out.withColumn("urgency_hits", urgency_hits(F.col("subject")))
    out = out.withColumn("link_domains", link_domains(F.col("_link_text")))
    out = out.withColumn("link_domain_mismatch", link_mismatch(F.col("link_domains"), dom))
    if ages is None:
        return out.withColumn("domain_age_days", F.lit(None).cast("int")).withColumn("domain_age_source", F.lit("unavailable"))
    known = ages.select("sender_domain", F.col("domain_age_days").cast("int").alias("domain_age_days"))
    return out.join(known, "sender_domain", "left").withColumn("domain_age_source", F.when(F.col("domain_age_days").isNull(), "unavailable").otherwise("table"))


def _fired() -> list[tuple[Column, Column, Column]]:
    """(condition, points, reason) of every signal, in the order of the reasons."""
    hits = F.size("urgency_hits")
    fixed = lambda name: F.lit(POINTS[name])
    return [
        (F.col("dmarc").eqNullSafe("fail"), fixed("dmarc_fail"), F.lit("DMARC fail")),
        (F.col("dmarc").eqNullSafe("none"), fixed("dmarc_none"), F.lit("No DMARC policy")),
        (F.col("spf").eqNullSafe("fail"), fixed("spf_fail"), F.lit("SPF fail")),
        (F.col("dkim").eqNullSafe("fail"), fixed("dkim_fail"), F.lit("DKIM fail")),
        (F.col("lookalike_of").isNotNull() & (F.col("lookalike_score") >= LOOKALIKE_SCORED_FROM), fixed("lookalike"),
         F.concat(F.lit("Lookalike domain of '"), F.col("lookalike_of"), F.lit("' (similarity "), F.col("lookalike_score").cast("string"), F.lit(")"))),
        (F.col("display_name_mismatch"), fixed("display"), F.lit("Display name impersonates a known brand not matching sender domain")),
        (F.col("reply_to_mismatch"), fixed("reply_to"), F.lit("Reply-To domain differs from From domain")),
        (F.col("link_domain_mismatch"), fixed("links"), F.lit("Embedded links point to a domain different from the sender")),
        (hits > 0, F.least(F.lit(POINTS["urgency_most"]), hits * POINTS["urgency_each"]), F.concat(F.lit("Urgency/coercion language in subject: "), list_text(F.col("urgency_hits")))),
        (F.coalesce(F.col("domain_age_days") < YOUNG_DOMAIN_DAYS, F.lit(False)), fixed("young_domain"),
         F.concat(F.lit("Sender domain registered "), F.col("domain_age_days").cast("string"), F.lit(" days ago"))),
    ]


def scored(df: DataFrame) -> DataFrame:
    """Adds ``infra_risk_score``, ``reasons`` and the layer-one ``verdict``."""
    fired = _fired()
    total = sum((F.when(c, p).otherwise(0) for c, p, _ in fired), F.lit(0))
    out = df.withColumn("infra_risk_score", F.least(total, F.lit(100)).cast("double"))
    out = out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, r) for c, _, r in fired])))
    score = F.col("infra_risk_score")
    return out.withColumn("verdict", F.when(score >= ESCALATE_FROM, "escalate_to_layer2").when(score >= REVIEW_FROM, "needs_review").otherwise("clean"))
