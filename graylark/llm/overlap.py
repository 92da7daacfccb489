"""Problem 4: the same or nearly the same records on both sides of a split.

Method: a prefix filter finds the pairs, winnowing describes them.  Texts on both sides that share one of their rarest words,
as many of them as the bound asks for, are candidates (see ``prefixes``; every pair at or above the bound is one, whatever
its length and word order), and are kept if their exact word similarity reaches the bound.  Every kept text becomes a
sequence of hashed word pairs; of each window of ``WINDOW`` of them the smallest is kept, rare ones counting as smaller;
collinear seeds that both texts keep are chained, the chain is extended by alignment into the gaps between seeds, and
the pair's coverage and similarity are reported.

Identical texts are collapsed before and expanded after the join, so a text that many rows share costs as one.

Defined results: null and blank texts overlap with nothing; rows of the same table are never compared with each other;
null sources are reported as null; texts of any length are processed whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graylark.llm import prefixes as P
from graylark.llm.batches import spread
from graylark.llm.neardup import with_copies
from graylark.llm.prefixes import PARITY, divided, may_reach, prefixes
from graylark.llm.stored import count_table, distinct_texts, frequent_table, is_frequent, stored, words

WINDOW = 3
#: Word pairs in more than this share of all texts are kept last.
FREQUENT = 0.005


def pair_hashes(text: str) -> np.ndarray:
    """Hashes of adjacent word pairs, in order; a single word stands for itself."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words(text)), dtype=np.uint64)
    if len(h) < 2:
        return h
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(1)
        return x ^ x >> np.uint64(32)


def winnow(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the window minima (the last of equals)."""
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    order = (hashes >> np.uint64(8)) | np.where(is_frequent(frequent, hashes), np.uint64(1 << 60), np.uint64(0))
    if len(hashes) <= WINDOW:
        at = np.array([len(hashes) - 1 - int(np.argmin(order[::-1]))])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(order, WINDOW)
        at = np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1))
    return at, hashes[at]


def collapse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the smallest id of each text, and ``(rep, id, _blocks)`` of the others."""
    keyed = docs.select("id", F.unhex(F.md5("text")).alias("digest"))
    reps = keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.ceil(F.count("*") / P.BLOCK).cast("int").alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = stored(keyed.join(reps, "digest").where("id <> rep").select("rep", "id", "_blocks"))
    return docs.join(copies.select("id"), "id", "left_anti"), copies


def candidates_of(t: DataFrame, e: DataFrame, threshold: float) -> DataFrame:
    """``(e, t)`` of the records of two tables of prefixes that share a prefix word and whose sizes and bitmaps allow the bound.

    Words that the sketch has in few texts are joined as they are.  The others are counted on both sides; large buckets
    are divided into a grid of blocks, so that no task gets more than a block of either side.
    """
    member = F.struct("id", "n", *PARITY)

    def rows(df: DataFrame, keys: str) -> DataFrame:
        return df.select(F.explode(keys).alias("key"), member.alias("m"))

    left, right = rows(t, "hot"), rows(e, "hot")
    grid = divided(left).withColumnRenamed("_blocks", "_x").join(divided(right).withColumnRenamed("_blocks", "_y"), "key", "full")
    grid = stored(grid.select("key", F.coalesce("_x", F.lit(1)).alias("_x"), F.coalesce("_y", F.lit(1)).alias("_y")))

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, against every block of the other side."""
        some = df.join(grid, "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
        return some.select("key", "m", F.pmod(F.xxhash64("m.id"), F.col(own)).cast("int").alias(f"{own}k"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}k"))

    few = rows(e, "keys").withColumnRenamed("m", "p").join(rows(t, "keys").withColumnRenamed("m", "q"), "key")
    many = placed(right, "_y", "_x").withColumnRenamed("m", "p").join(placed(left, "_x", "_y").withColumnRenamed("m", "q"), ["key", "_xk", "_yk"])
    pairs = few.select("p", "q").unionByName(many.select("p", "q")).where(may_reach("p", "q", threshold))
    return pairs.select(F.col("p.id").alias("e"), F.col("q.id").alias("t")).distinct()


def chain(a: np.ndarray, b: np.ndarray, frequent: np.ndarray) -> list[tuple[int, int]]:
    """The longest chain of seeds that ascend in both texts, as word positions."""
    pa_, ha = winnow(a, frequent)
    pb, hb = winnow(b, frequent)
    at: dict[int, list[int]] = {}
    for p, h in zip(pb.tolist(), hb.tolist()):
        at.setdefault(h, []).append(p)
    seeds = [(p, q) for p, h in zip(pa_.tolist(), ha.tolist()) for q in reversed(at.get(h, ()))]
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, q) in enumerate(seeds):
        k = bisect_left(tails, q)
        if k == len(tails):
            tails.append(q)
            last.append(i)
        else:
            tails[k], last[k] = q, i
        back[i] = last[k - 1] if k else -1
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def _lcs(x: list, y: list) -> int:
    """Length of the longest common subsequence of two word lists (bit-parallel)."""
    masks: dict = {}
    for i, w in enumerate(y):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(y)) - 1
    row = full
    for w in x:
        m = row & masks.get(w, 0)
        row = (row + m | row - m) & full
    return len(y) - bin(row).count("1")


def compare(left: str, right: str, frequent: np.ndarray) -> tuple[float, float, float, int]:
    """Exact word similarity, covered shares of both texts, and the number of chained seeds."""
    x, y = words(left), words(right)
    sx, sy = set(x), set(y)
    both = len(sx & sy)
    similarity = both / (len(sx) + len(sy) - both)
    seeds = chain(pair_hashes(left), pair_hashes(right), frequent)
    matched, i, j = 0, 0, 0
    for p, q in [*seeds, (len(x), len(y))]:
        if p >= i and q >= j:
            matched += _lcs(x[i:p], y[j:q])
            i, j = p, q
    return similarity, matched / len(x), matched / len(y), len(seeds)


def overlaps(train: DataFrame, evaluation: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``(eval_id, train_id, similarity, eval_covered, train_covered, n_seeds)`` of every pair at or above the bound.

    Ids must not occur in both tables.  Only sketches of fixed size reach the driver; pairs are written once.
    """
    t, e = spread(distinct_texts(train, key, text), "id"), spread(distinct_texts(evaluation, key, text), "id")
    frequent = frequent_table(t.unionByName(e), "text", FREQUENT, pair_hashes)
    t, t_copies = collapse(t)
    e, e_copies = collapse(e)
    counts, _ = count_table(t.unionByName(e), "text")
    candidates = stored(candidates_of(stored(prefixes(t, counts, threshold)), stored(prefixes(e, counts, threshold)), threshold))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                sx, sy = set(words(x)), set(words(y))
                both = len(sx & sy)
                if both >= threshold * (len(sx) + len(sy) - both):
                    rows.append((i, j, *compare(x, y, frequent)))
            if rows:
                names = ("e", "t", "similarity", "eval_covered", "train_covered", "n_seeds")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], names)

    texts = candidates.join(e.select(F.col("id").alias("e"), F.col("text").alias("x")), "e").join(t.select(F.col("id").alias("t"), F.col("text").alias("y")), "t").select("e", "t", "x", "y")
    pairs = stored(texts.mapInArrow(verify, "e bigint, t bigint, similarity double, eval_covered double, train_covered double, n_seeds bigint"))
    return with_copies(with_copies(pairs, "e", e_copies), "t", t_copies).withColumnsRenamed({"e": "eval_id", "t": "train_id"})


def overlap_report(train: DataFrame, splits: dict[str, DataFrame], key: str, text: str, source: str, threshold: float = 0.8) -> DataFrame:
    """Per split and source of the evaluation row: rows, rows with an overlap, pairs, mean coverage."""
    rows = None
    for name, frame in splits.items():
        part = frame.select(F.lit(name).alias("split"), F.col(key).cast("bigint").alias("eval_id"), F.col(source).alias("source"), F.col(text).alias("_t"))
        rows = part if rows is None else rows.unionByName(part)
    found = overlaps(train, rows.select(F.col("eval_id").alias(key), F.col("_t").alias(text)), key, text, threshold)
    per_row = found.groupBy("eval_id").agg(F.count("*").alias("pairs"), F.max("eval_covered").alias("covered"))
    joined = rows.drop("_t").join(per_row, "eval_id", "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("pairs").alias("rows_found"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.round(F.coalesce(F.avg("covered"), F.lit(0.0)), 6).alias("mean_covered"))
