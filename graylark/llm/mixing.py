"""Problem 8: mix sources to target shares of the total size in tokens.

Method: Pfair scheduling.  A source's records, in hash order and repeated as often as its target asks (never beyond its
cap), form a stream that is cut into blocks of ``block_tokens``.  Block j of a source of weight w is released at slot
floor(j / w) and due at slot ceil((j + 1) / w); earliest deadline first gives every block a slot, so at each slot every
source is less than one block away from its exact share.  Records are never cut: one belongs to the block that its first token
falls into, and one longer than a block leaves the next blocks to itself, so in tokens a source is less than one block and one
record away.  Weights are whole parts of ``PERIOD``, and the schedule
repeats after ``PERIOD`` slots: the table of one period is all that a task needs, whatever the size of the corpus.

Positions within a source come from two levels of running sums (over hash ranges, then within a range), so no task
sees a whole source.

Decisions: a source that can't fill its share within its cap gives all it may give and the others aren't inflated for it;
the report shows wanted and actual sizes and shares.  The record at the end of a stream is used if at least half of it
fits.  Sources without documents get no slot filled.  Null and blank texts have no tokens and are not used; documents of
other or no source stay out, yet count in the size of the corpus.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graylark.llm.batches import spread
from graylark.llm.stored import stored

#: Ranks file of the public byte-level tokenizer for many languages; its split pattern is the public one of that family.
TOKENIZER = os.environ.get("GRAYLARK_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 4096
PERIOD = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, n_tokens)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "source", "n_tokens"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return spread(rows, "id").mapInArrow(run, "id bigint, source string, n_tokens bigint")


def pfair_slots(parts: dict[str, int], period: int = PERIOD) -> dict[str, list[int]]:
    """Slot of each block of one period per source, by earliest deadline among the released blocks."""
    if sum(parts.values()) > period:
        raise ValueError("the weights exceed the period")
    release: dict[int, list[tuple[int, str, int]]] = {}
    for s, n in parts.items():
        for j in range(n):
            release.setdefault(j * period // n, []).append((-(-(j + 1) * period // n), s, j))
    slots = {s: [0] * n for s, n in parts.items()}
    ready: list[tuple[int, str, int]] = []
    for t in range(period):
        for job in release.get(t, ()):
            heapq.heappush(ready, job)
        if ready:
            due, s, j = heapq.heappop(ready)
            assert due > t
            slots[s][j] = t
    assert not ready
    return slots


def _plan_rows(plans: DataFrame) -> list[dict]:
    """Plans as driver rows: their number is fixed by who writes them, a few per source."""
    return [r.asDict() for r in plans.select("plan_id", "source", "target_share", "max_repeats", "size_ratio").collect()]


def _placed(tokens: DataFrame) -> DataFrame:
    """Each record with the tokens before it in the hash order of its source, and the source's total."""
    rows = tokens.where("n_tokens > 0 and source is not null").withColumn("h", F.xxhash64("id")).withColumn("range", F.shiftrightunsigned("h", 52))
    per_range = rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("range")
    starts = per_range.select("source", "range", (F.sum("t").over(upto) - F.col("t")).alias("start"), F.sum("t").over(Window.partitionBy("source")).alias("available"))
    within = Window.partitionBy("source", "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inner.join(starts, ["source", "range"]).select("source", "id", "n_tokens", (F.col("start") + F.col("inner")).alias("before"), "available")


def _wanted(spark, plans: list[dict], total: int) -> DataFrame:
    rows = [(p["plan_id"], p["source"], float(p["target_share"]), int(p["max_repeats"]), float(p["target_share"]) * float(p["size_ratio"]) * total) for p in plans]
    return spark.createDataFrame(rows, "plan_id string, source string, target_share double, max_repeats int, wanted double")


def manifest(docs: DataFrame, plans: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(plan_id, slot, source, doc_id, pass, n_tokens)``: every use of a record, in the order of ``slot`` within its plan."""
    return _manifest(stored(token_counts(docs, key, text, source, tokenizer)), _plan_rows(plans), block_tokens)


def _manifest(tokens: DataFrame, plans: list[dict], block_tokens: int) -> DataFrame:
    spark = tokens.sparkSession
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    uses = _placed(tokens).join(F.broadcast(_wanted(spark, plans, total)), "source")
    full = F.least(F.col("max_repeats").cast("bigint"), F.floor(F.col("wanted") / F.col("available")))
    rest = F.when(full < F.col("max_repeats"), F.col("wanted") - full * F.col("available")).otherwise(F.lit(0.0))
    times = full + F.when(F.col("before") + F.col("n_tokens") / 2 <= rest, 1).otherwise(0)
    used = uses.withColumn("_times", times.cast("int")).where("_times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    used = used.withColumn("block", F.floor((F.col("pass") * F.col("available") + F.col("before")) / block_tokens).cast("bigint"))
    table = []
    by_plan: dict[str, dict[str, int]] = {}
    for p in plans:
        by_plan.setdefault(p["plan_id"], {})[p["source"]] = max(1, int(round(float(p["target_share"]) * PERIOD)))
    for plan, parts in by_plan.items():
        over = sum(parts.values()) - PERIOD
        if over > 0:  # rounding
            parts[max(parts, key=parts.get)] -= over
        table += [(plan, s, len(slots), slots) for s, slots in pfair_slots(parts).items()]
    slots = spark.createDataFrame(table, "plan_id string, source string, parts int, slots array<int>")
    placed = used.join(F.broadcast(slots), ["plan_id", "source"])
    slot = F.floor(F.col("block") / F.col("parts")) * PERIOD + F.element_at("slots", (F.col("block") % F.col("parts")).cast("int") + 1)
    return placed.select("plan_id", slot.cast("bigint").alias("slot"), "source", F.col("id").alias("doc_id"), "pass", "n_tokens")


def report(docs: DataFrame, plans: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per plan and source: target and actual share, wanted, available and used tokens, uses, repeats and whether the cap bound."""
    spark = docs.sparkSession
    tokens = stored(token_counts(docs, key, text, source, tokenizer))
    rows = _plan_rows(plans)
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    used = _manifest(tokens, rows, block_tokens).groupBy("plan_id", "source").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("repeats"))
    have = tokens.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    out = F.broadcast(_wanted(spark, rows, total)).join(have, "source", "left").join(used, ["plan_id", "source"], "left").na.fill(0, ["available", "used", "uses", "repeats"])
    size = Window.partitionBy("plan_id")
    return out.select(
        "plan_id", "source", "target_share", F.coalesce(F.col("used") / F.nullif(F.sum("used").over(size), F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.col("wanted").alias("wanted_tokens"), F.col("available").alias("available_tokens"), F.col("used").alias("used_tokens"), "uses", "repeats", "max_repeats",
        (F.col("wanted") > F.col("available") * F.col("max_repeats")).alias("cap_bound"),
    )
