"""Prefix filter: candidates for a bound on word-set similarity, complete by proof.

Two sets of sizes m and n that reach the similarity t share at least t * max(m, n) words.  If words have one order, the
first ``n - ceil(t * n) + 1`` words of either set then have a word in common, for the words behind them are too few.
The order puts rare words first (counts from a sketch; any order is complete, a good one gives few candidates).

Candidates are thinned by two further proven bounds only: the sizes, and a parity bitmap, in which every word flips one
of ``BITS`` bits: bitmaps differ in no more bits than the sets differ in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graylark.llm.stored import counts_of, stored, word_hashes

#: Longs of the parity bitmap, and its bits.
LONGS = 4
#: Records in one block of a bucket.  Words that may stand in more records are kept apart: their buckets are divided.
BLOCK = 2048
BITS = 64 * LONGS
PARITY = tuple(f"s{i}" for i in range(LONGS))
PREFIX_SCHEMA = "id bigint, set_a bigint, set_b bigint, n int, keys array<int>, hot array<int>, " + ", ".join(f"{c} bigint" for c in PARITY)
#: With the place of each prefix word in the order of its record.
PLACED_SCHEMA = PREFIX_SCHEMA.replace("keys array<int>, hot array<int>", "keys array<int>, keys_at array<int>, hot array<int>, hot_at array<int>")


def prefix_length(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def _rows(ids: list, texts: list, counts: np.ndarray, threshold: float, block: int, places: bool = False) -> pa.RecordBatch:
    sets = [word_hashes(t) for t in texts]
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    with np.errstate(over="ignore"):
        one = np.add.reduceat(flat * np.uint64(0x9E3779B97F4A7C15) ^ flat >> np.uint64(7), starts)
        two = np.bitwise_xor.reduceat((flat ^ flat >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F), starts)
    owner = np.repeat(np.arange(len(sets)), lengths)
    held_by = counts_of(counts, flat)
    order = np.lexsort((flat, held_by, owner))
    wanted = np.array([prefix_length(n, threshold) for n in lengths.tolist()])
    # counts are never too small: a word counted once joins nothing; half of each hash does, as a chance hit adds only a candidate
    place = np.arange(len(flat)) - starts[owner]
    kept = (place < wanted[owner]) & (held_by[order] > 1)
    bit = (flat >> np.uint64(50)) % np.uint64(BITS)
    columns = {"id": pa.array(ids, pa.int64()), "set_a": pa.array(one.view(np.int64)), "set_b": pa.array(two.view(np.int64)), "n": pa.array(lengths, pa.int32())}
    for name, some in (("keys", kept & (held_by[order] <= block)), ("hot", kept & (held_by[order] > block))):
        keys, ends = flat[order][some], np.cumsum(np.bincount(owner[some], minlength=len(sets)))
        ends = pa.array(np.concatenate([[0], ends]), pa.int32())
        columns[name] = pa.ListArray.from_arrays(ends, pa.array((keys >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        if places:
            columns[f"{name}_at"] = pa.ListArray.from_arrays(ends, pa.array(place[some], pa.int32()))
    for i, c in enumerate(PARITY):
        flips = np.where(bit // np.uint64(64) == i, np.uint64(1) << bit % np.uint64(64), np.uint64(0))
        columns[c] = pa.array(np.bitwise_xor.reduceat(flips, starts).view(np.int64))
    return pa.RecordBatch.from_pydict(columns)


def prefixes(docs: DataFrame, counts: np.ndarray, threshold: float, block: int | None = None, places: bool = False) -> DataFrame:
    """Prefix words (those that the sketch has in at most ``block`` texts, and others), size, parity bitmap and word-set hash per record of ``(id, text)`` with non-blank texts."""

    block = block or BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 2048):
                yield _rows(ids[i : i + 2048], texts[i : i + 2048], counts, threshold, block, places)

    return docs.mapInArrow(run, PLACED_SCHEMA if places else PREFIX_SCHEMA)


def may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and bitmaps of two records allow the bound."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    differing = F.lit(0)
    for c in PARITY:
        differing = differing + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return (F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9) & (differing * (1 + threshold) <= (m + n) * (1 - threshold) + 1e-6)


def divided(rows: DataFrame) -> DataFrame:
    """``(key, _blocks)`` of the buckets of ``rows (key, ...)`` with more than ``BLOCK`` rows: counts combine before they are shuffled."""
    large = rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    return stored(large.select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")))
