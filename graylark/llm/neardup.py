"""Problem 3: pairs and groups of records whose word sets are similar, over tables too large for pairwise comparison.

Method: a prefix filter (see ``prefixes``).  Records that share one of their rarest words, as many of them as the bound
asks for, are candidates; every pair at or above the bound is one.  Sizes, places of the first common word and parity
bitmaps, which only rule out what can't reach the bound, thin the candidates, and the rest is compared exactly.  No step
is probabilistic: bands of minima (b-bit MinHash) lose links near the bound in groups that are a large part of the table.

Shape of the work: records with the same word set are represented by one of them, so that copies never multiply
candidates; hot buckets are divided into blocks before their rows meet, so that no task holds a whole one; pairs of
representatives are expanded to records at the end, again in blocks.  Only sketches of fixed size reach the driver.

Similarity: shared distinct words over distinct words of either text, words being the non-empty pieces of the
lower-cased text between spaces, tabs, CR and LF.  Defined results: null and blank texts pair with nothing, equal
texts pair at 1.0, an id that occurs twice is one record per row (pairs of an id with itself are left out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graylark.llm import prefixes as P
from graylark.llm.batches import spread
from graylark.llm.prefixes import PARITY, may_reach, prefixes
from graylark.llm.stored import count_table, discard, distinct_texts, stored, word_hashes

#: Bits of the cell number in the word counts: far more cells than the few hundred thousand words that many texts share, so
#: that rare words stay ahead of these in the order however large the table is (small counters fill up: then any order results).
COUNT_BITS = 21
#: Blocks of :data:`prefixes.BLOCK` records that meet as one group of a word; larger groups are divided.
GROUP_BLOCKS = 8
#: What a member of a group may be in a pair.
EITHER, SHORTER, LONGER = 0, 1, 2
#: Rows that are paired in one go (with the rest of their last group), and pairs that are looked at in one go.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 20


def cells_of(rows: DataFrame, bucket: str, member: str) -> DataFrame:
    """``(bucket, x, y, ms)``: the members of two blocks of a bucket, for every pair of blocks of ``rows (bucket, member, _blocks)``.

    Members of a bucket are spread over its blocks and every pair of blocks is a key of its own, so a hot bucket is divided
    among tasks, each of which holds two blocks at a time.
    """
    placed = rows.select(bucket, F.col(member).alias("m"), "_blocks", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int").alias("k"))
    spread_rows = placed.select(bucket, "m", "k", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o"))
    return spread_rows.groupBy(bucket, F.least("k", "_o").alias("x"), F.greatest("k", "_o").alias("y")).agg(F.collect_list(F.struct("m", "k")).alias("ms"))


def cell_pairs(rows: DataFrame, bucket: str, member: str) -> DataFrame:
    """``(p, q)``, p < q, for all members that share a bucket, each pair once for each bucket."""
    one = cells_of(rows, bucket, member).where(F.size("ms") > 1).select(F.explode("ms").alias("p"), "ms", "x", "y")
    return one.select("p", F.explode("ms").alias("q"), "x", "y").where("p.m < q.m and (x = y or p.k <> q.k)").select(F.col("p.m").alias("p"), F.col("q.m").alias("q"))


def furthest(n, at, threshold: float):
    """The largest size of a record that can reach the bound with one of size ``n`` if their first common word is at the place ``at`` of the latter.

    Only the words from there on can be shared: ``n - at`` of them must be ``threshold / (1 + threshold)`` of both sizes.
    """
    return (n - at) * ((1 + threshold) / threshold) - n + 1e-6


def pairs_in(groups: np.ndarray, ids: np.ndarray, meta: np.ndarray, bitmaps: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(a, b)``, a < b, of members of a group (equal numbers in ``groups``, which ascend) whose sizes, places and bitmaps allow the bound.

    A pair meets at the shorter record: of the members sorted by size, only the run between its own size and the furthest
    is looked at, so that a frequent word, which comes late in the order, costs next to nothing.
    """
    start = np.concatenate([[True], groups[1:] != groups[:-1]])
    alone = start & np.concatenate([start[1:], [True]])
    group = np.cumsum(start)
    n, at, role = meta >> 32, (meta & 0xFFFFFFFF) >> 2, meta & 3
    most = np.minimum(furthest(n, at, threshold), 2**31 - 1).astype(np.int64)
    members = np.flatnonzero(~alone & (role != SHORTER))
    place = group[members] << 32 | n[members]
    order = np.argsort(place, kind="stable")
    members, place = members[order], place[order]
    left_over = (n - at) * (1 + threshold) - threshold * n + 1e-6
    there, id_there, n_there = left_over[members], ids[members], n[members]
    bits_there = [x[members] for x in bitmaps]
    short = np.flatnonzero(~alone & (role != LONGER) & (most >= n))
    low = np.searchsorted(place, group[short] << 32 | n[short], "left")
    runs = np.searchsorted(place, group[short] << 32 | most[short], "right") - low
    until = np.cumsum(runs)
    first = 0
    while first < len(short):
        last = max(first + 1, int(np.searchsorted(until, (until[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
        some, length = short[first:last], runs[first:last]
        total = int(length.sum())
        p = np.repeat(np.arange(first, last), length)
        q = np.arange(total) + np.repeat(low[first:last] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        near = there[q] >= np.repeat(threshold * n[some], length)
        p, q = short[p[near]], q[near]
        a, b = ids[p], id_there[q]
        near = np.where(n[p] == n_there[q], a < b, a != b)
        p, q, a, b = p[near], q[near], a[near], b[near]
        differing = sum(np.bitwise_count((x[p] ^ y[q]).view(np.uint64)).astype(np.int64) for x, y in zip(bitmaps, bits_there))
        near = differing * (1 + threshold) <= (n[p] + n_there[q]) * (1 - threshold) + 1e-6
        if near.any():
            a, b = a[near], b[near]
            yield np.minimum(a, b), np.maximum(a, b)
        first = last


def prefix_pairs(own: DataFrame, threshold: float) -> DataFrame:
    """Candidates ``(a, b)``, a < b: pairs with a common prefix word whose sizes, places of that word and bitmaps allow the bound.

    The members of a word are sorted next to each other and paired in one pass (see :func:`pairs_in`).  Those of words that
    the sketch has in many texts are counted first (combining before the shuffle); the large ones become a grid of groups,
    a block of the members that can be the shorter record of a pair by a block of all.
    """
    block = GROUP_BLOCKS * P.BLOCK
    half = len(PARITY) // 2  # a word flips one bit of the folded bitmap too: a bound as well, in half the shuffle
    folded = [F.col(PARITY[i]).bitwiseXOR(F.col(PARITY[i + half])).alias(f"f{i}") for i in range(half)]
    bitmaps = [f"f{i}" for i in range(half)]

    def rows(keys: str) -> DataFrame:
        return own.select("id", "n", *folded, F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(f"{keys}_at").alias("at"))).alias("w")).select(F.col("w.key").alias("key"), "id", "n", F.col("w.at").alias("at"), *bitmaps)

    def entries(df: DataFrame, group, role: int) -> DataFrame:
        meta = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("bigint"), 2)).bitwiseOR(F.lit(role).cast("bigint"))
        return df.select(group.cast("bigint").alias("g"), "id", meta.alias("meta"), *bitmaps)

    frequent, shorter = rows("hot"), furthest(F.col("n"), F.col("at"), threshold) >= F.col("n")
    counts = frequent.groupBy("key").agg(F.count("*").alias("_n"), F.count_if(shorter).alias("_i")).where(F.col("_n") > block)
    grid = stored(counts.select("key", F.ceil(F.col("_i") / block).cast("int").alias("_x"), F.ceil(F.col("_n") / block).cast("int").alias("_y")))
    placed = frequent.join(grid, "key", "left")
    many = placed.where("_x > 0")  # where no member can be the shorter one there is no pair

    def cells(df: DataFrame, own_blocks: str, other_blocks: str, role: int) -> DataFrame:
        at = {own_blocks: F.pmod(F.xxhash64("id"), F.col(own_blocks)).cast("int"), other_blocks: F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))}
        wide = df.select("key", "id", "n", "at", *bitmaps, at["_x"].alias("x"), at["_y"].alias("y"))
        return entries(wide, F.xxhash64("key", "x", "y"), role)

    few = entries(rows("keys"), F.col("key"), EITHER).unionByName(entries(placed.where("_x is null"), F.col("key"), EITHER))
    every = few.unionByName(cells(many.where(shorter), "_x", "_y", SHORTER)).unionByName(cells(many, "_y", "_x", LONGER))

    def paired(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in pairs_in(*columns[:3], columns[3:], threshold):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(x[0]) for x in held) < ROWS_AT_ONCE or held[0][0][0] == held[-1][0][-1]:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            end = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last group may go on
            yield from paired([x[:end] for x in columns])
            held = [[x[end:] for x in columns]]
        if held:
            yield from paired([np.concatenate(x) for x in zip(*held)])

    near = every.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint").distinct()
    whole = F.struct("n", *PARITY)  # the whole bitmaps rule out most of what the folded ones let through, before word sets are shuffled
    p, q = own.select(F.col("id").alias("a"), whole.alias("p")), own.select(F.col("id").alias("b"), whole.alias("q"))
    return near.join(p, "a").join(q, "b").where(may_reach("p", "q", threshold)).select("a", "b").distinct()


def exact_pairs(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of the candidate pairs that reach the bound, from the texts of ``docs (id, text)``.

    Only texts that occur in a pair are shuffled, once each; every pair then gets its two word sets.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    needed = docs.join(ends.select("id").distinct(), "id", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [word_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            if ws:
                offsets = np.concatenate([[0], np.cumsum([len(w) for w in ws])])
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "ws": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ws)))})

    sets = needed.mapInArrow(hashed, "id bigint, ws array<bigint>")
    a = pairs.join(sets.select(F.col("id").alias("a"), F.col("ws").alias("wa")), "a")
    both = a.join(sets.select(F.col("id").alias("b"), F.col("ws").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def copies_of(sk: DataFrame) -> DataFrame:
    """``(rep, id, _blocks)`` of every record whose word set a record with a smaller id has too, and in how many blocks they are expanded."""
    sets = sk.select("id", "set_a", "set_b")
    reps = sets.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.ceil(F.count("*") / P.BLOCK).cast("int").alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return sets.join(reps, ["set_a", "set_b"]).where("id <> rep").select("rep", "id", "_blocks")


def similar_representatives(df: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``(a, b, similarity)`` between representatives, copies ``(rep, id)``, and the prefixes of all records."""
    docs = distinct_texts(df, key, text)
    counts, _ = count_table(docs, "text", bits=COUNT_BITS, rows=1)
    sk = stored(prefixes(spread(docs, "id"), counts, threshold, GROUP_BLOCKS * P.BLOCK, places=True))
    copies = stored(copies_of(sk))
    own = sk.join(copies.select("id"), "id", "left_anti")
    return exact_pairs(stored(prefix_pairs(own, threshold)), docs, threshold), copies, sk


def with_copies(pairs: DataFrame, side: str, copies: DataFrame) -> DataFrame:
    """Each pair once more for every copy of the record on one side; many copies meet the pair in blocks."""
    blocks = copies.groupBy(F.col("rep").alias(side)).agg(F.max("_blocks").alias("_blocks"))
    placed = copies.select(F.col("rep").alias(side), F.col("id").alias("_copy"), F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("_block"))
    wide = pairs.join(blocks, side).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    more = wide.join(placed, [side, "_block"]).withColumn(side, F.col("_copy")).select(*pairs.columns)
    return pairs.unionByName(more)


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``(id_a, id_b, similarity)``, id_a < id_b: all pairs of records at or above the bound, copies expanded."""
    pairs, copies, _ = similar_representatives(df, key, text, threshold)
    pairs = stored(pairs)
    between = with_copies(with_copies(pairs, "a", copies), "b", copies)
    groups = copies.unionByName(copies.select("rep", F.col("rep").alias("id"), "_blocks").distinct())
    within = cell_pairs(groups, "rep", "id").select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("similarity"))
    both = between.unionByName(within)
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity")


def similar_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``(id, class_id, n_links)``: every non-blank record with the smallest id of its connected group and its number of links.

    A link of a representative counts once for each record it stands for.
    """
    pairs, copies, sk = similar_representatives(df, key, text, threshold)
    pairs = stored(pairs)
    classes = components(pairs)
    size = copies.groupBy("rep").agg((F.count("*") + 1).alias("size"))
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    links = ends.join(size, ends.other == size.rep, "left").groupBy("id").agg(F.sum(F.coalesce("size", F.lit(1))).alias("outer_links"))
    every = sk.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = every.join(classes.withColumnRenamed("id", "rep"), "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(size, "rep", "left")
    return out.select("id", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("outer_links", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("bigint").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, class_id)`` for the ends of ``edges (a, b)``: the smallest id in each connected component.

    Alternating large-star and small-star steps; every round is written to the shared folder, so plans stay short and a
    lost executor costs one round.  Each step is a grouped minimum, which combines before it shuffles.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        last, links = links, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    pairs = links.groupBy("u").agg(F.min("v").alias("class_id")).withColumnRenamed("u", "id")
    return pairs.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())
