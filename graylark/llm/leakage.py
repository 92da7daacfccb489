"""Problem 7: corpus documents that hold passages of held-out items.

Method: q-gram lemma filtering.  Documents and items are reduced to words (maximal runs of letters and digits of the
lower-cased text) joined by one blank.  All q-grams of a block of items form a sorted table; one vectorised pass over
a batch of documents finds every shared q-gram, counts the hits of each (document, item) in overlapping diagonal
bands, and keeps the hits of all bands whose count reaches what the lemma asks of a passage within the edit budget.
Every kept region is verified by alignment.  With no edits allowed (:func:`leaks`) that is the exact run along one
diagonal, cut to whole words.  With edits (:func:`passages`) the exact runs of the band are chained, what lies between
two of them is aligned, and the longest stretches within the budget are the passages: a region may hold several, and
neither a stray hit nor a rewritten middle hides the others.

The items are the query set.  They are taken in blocks of at most ``BLOCK_CHARS`` characters, so what each task holds
doesn't grow; the corpus is scanned once per block and never shuffled.  With more than one block, each block's rows are
written to the shared folder and its broadcast is destroyed before the next is built.

Defined results: null and blank texts hold nothing; items with fewer than ``min_words`` words leak nowhere; an item
that equals another is reported for both; documents of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graylark.llm.batches import spread
from graylark.llm.stored import stored

Q = 12
MIN_WORDS = 8
MIN_CHARS = 120
EDIT_SHARE = 0.05
BLOCK_CHARS = 4_000_000
BAND = 32
#: Characters of documents per vectorised step.
STEP_CHARS = 400_000
NOT_WORD = re.compile(r"[\W_]+")
FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """The words of a text, joined by blanks, with a blank at both ends."""
    return " " + NOT_WORD.sub(" ", text.lower()).strip() + " "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h = c[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, Q):
            h *= _BASE
            h += c[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class ItemBlock:
    """The q-gram table of a block of items; built on the driver, sent to the tasks."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = np.array(ids, dtype=np.int64)
        self.plain = [plain(t) for t in texts]
        grams = [_grams(_codes(p)) for p in self.plain]
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.items = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.positions = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order]
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pair, position, diagonal)`` of every q-gram that a document and an item share, by document and position.

        ``pair`` is document * items + item, ``diagonal`` the position in the document less that in the item.
        """
        none = np.zeros(0, np.int64)
        ends = np.cumsum([len(d) + 1 for d in docs])
        starts = np.concatenate([[0], ends[:-1]])
        h = _grams(_codes("\x01".join(docs) + "\x01"))
        hit = np.nonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
        lo = np.searchsorted(self.hashes, h[hit], "left")
        n = np.searchsorted(self.hashes, h[hit], "right") - lo
        hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
        if not len(hit):
            return none, none, none
        at = np.repeat(hit, n)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc = np.searchsorted(ends, at, "right")
        position = at - starts[doc]
        return doc.astype(np.int64) * len(self.ids) + self.items[entry], position, position - self.positions[entry]

    def regions(self, docs: list[str], least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the hits in each band with at least ``least`` of them, and all hits.  Bands overlap by half."""
        pair, position, diagonal = self.hits(docs)
        found = []
        for shift in (0, BAND // 2) if len(pair) else ():
            key = pair << np.int64(26) | ((diagonal + (1 << 25) + shift) // BAND) & np.int64((1 << 26) - 1)
            order = np.argsort(key, kind="stable")
            edges = np.concatenate([[0], np.nonzero(np.diff(key[order]))[0] + 1, [len(order)]])
            found += [order[edges[g] : edges[g + 1]] for g in np.nonzero(np.diff(edges) >= least)[0]]
        return found, pair, position, diagonal


def exact_runs(pair: np.ndarray, position: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pair, start, end, diagonal)`` of the maximal runs of hits along one diagonal; ``end`` is exclusive, in characters."""
    order = np.lexsort((position, diagonal, pair))
    p, x, d = pair[order], position[order], diagonal[order]
    first = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)])
    last = np.concatenate([first[1:], [True]])
    return p[first], x[first], x[last] + Q, d[first]


def needed_grams(chars: int, edits: int) -> int:
    """The q-gram lemma: a passage of ``chars`` with ``edits`` edits keeps at least so many q-grams."""
    return max(1, chars + 1 - Q * (edits + 1))


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[ItemBlock]:
    """Blocks of bounded size, in the order of the ids."""
    ids, texts, size = [], [], 0
    for row in items.select(key, text).orderBy(key).toLocalIterator():
        if row[0] is None or not row[1] or not row[1].strip():
            continue
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield ItemBlock(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemBlock(ids, texts)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    keys, docs, size = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if not t:
            continue
        keys.append(k)
        docs.append(plain(t))
        size += len(t)
        if size >= STEP_CHARS:
            yield keys, docs
            keys, docs, size = [], [], 0
    if keys:
        yield keys, docs


def _searched(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, found: Callable[[ItemBlock, list[str]], list[tuple]], names: str) -> DataFrame:
    """``(doc_id, item_id, *names)``: ``found`` gives rows (document, item, ...) of a step of documents against a block of items."""
    spark = docs.sparkSession
    source = spread(docs.select(doc_key, text), doc_key)
    columns = ["doc_id", "item_id", *names.split()]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * len(names.split())]
    schema = ", ".join(f"{c} {'bigint' if k == pa.int64() else 'int'}" for c, k in zip(columns, kinds))

    def scanned(block: ItemBlock) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                rows = [(keys[d], int(block.ids[i]), *more) for keys, texts in _steps(batch) for d, i, *more in found(block, texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

        return source.mapInArrow(run, schema), shared

    blocks = item_blocks(items, item_key, text)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], schema)
    out, shared = scanned(block)
    if following is None:
        return out
    out = stored(out)
    while following is not None:
        shared.destroy()
        part, shared = scanned(following)
        out, following = out.unionByName(stored(part)), next(blocks, None)
    shared.destroy()
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, item_id)`` of every document and item that share ``min_words`` consecutive words."""
    # the shortest such passage: min_words one-letter words and the blanks between and around them
    least = needed_grams(2 * min_words + 1, 0)

    def found(block: ItemBlock, texts: list[str]) -> list[tuple]:
        regions, *hits = block.regions(texts, least)
        if not regions:
            return []
        kept = np.unique(np.concatenate(regions))
        out = set()
        for pair, a, b, diagonal in zip(*(x.tolist() for x in exact_runs(*(x[kept] for x in hits)))):
            if b - a > 2 * min_words:
                d, i = divmod(pair, len(block.ids))
                # whole words stand between blanks; comparing the two stretches rules chance hashes out
                if (d, i) not in out and (shared := texts[d][a:b]).count(" ") > min_words and shared == block.plain[i][a - diagonal : b - diagonal]:
                    out.add((d, i))
        return sorted(out)

    return _searched(docs, items, doc_key, item_key, text, found, "")


def distance(a: str, b: str) -> int:
    """Edits (insertions, deletions, replacements) between two strings, bit-parallel over the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    n = len(a)
    full, high = (1 << n) - 1, 1 << n - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score = full, 0, n
    for c in b:
        eq = masks.get(c, 0)
        diagonal = ((eq & up) + up ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        score += bool(plus & high) - bool(minus & high)
        plus = plus << 1 | 1
        up = (minus << 1 | ~(diagonal | plus)) & full
        down = plus & diagonal & full
    return score


def chained(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs ``(start, end, diagonal)`` that ascend in both texts, longest first, cut where they overlap."""
    chain: list[tuple[int, int, int]] = []
    for a, b, d in sorted(runs, key=lambda r: (r[0] - r[1], r)):
        k = bisect_left(chain, (a, b, d))
        if k:
            _, e, f = chain[k - 1]
            a = max(a, e, e - f + d)
        if k < len(chain):
            s, _, f = chain[k]
            b = min(b, s, s - f + d)
        if b - a >= Q // 2:
            chain.insert(k, (a, b, d))
    return chain


def stretches(ends: list[tuple[int, int]], edits: list[int], share: float, min_chars: int) -> list[tuple[int, int]]:
    """``(first, last)`` runs of the longest stretch within the budget, then of the longest left and right of it, and so on.

    ``ends`` has the start and end of each run, ``edits`` the edits before each run.
    """
    out, todo = [], [(0, len(ends))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi or ends[hi - 1][1] - ends[lo][0] < min_chars:
            continue
        opens: list[int] = []  # starts that no earlier start dominates
        for i in range(lo, hi):
            if not opens or share * ends[i][0] - edits[i] < share * ends[opens[-1]][0] - edits[opens[-1]]:
                opens.append(i)
        best, size = None, min_chars - 1
        for j in range(hi - 1, lo - 1, -1):
            while opens and share * ends[j][1] - edits[j] >= share * ends[opens[-1]][0] - edits[opens[-1]] - 1e-9:
                i = opens.pop()
                if i <= j and ends[j][1] - ends[i][0] > size:
                    best, size = (i, j), ends[j][1] - ends[i][0]
        if best is not None:
            out.append(best)
            todo += [(lo, best[0]), (best[1] + 1, hi)]
    return out


def aligned(doc: str, item: str, runs: list[tuple[int, int, int]], share: float, min_chars: int) -> list[tuple[int, int, int, int]]:
    """``(start, end, edits, shared q-grams)`` of the passages in a region, by alignment between its chained runs."""
    chain = [r for r in chained(runs) if doc[r[0] : r[1]] == item[r[0] - r[2] : r[1] - r[2]]]
    if not chain:
        return []
    budget = share * (chain[-1][1] - chain[0][0])
    edits = [0]
    for (_, e, f), (s, _, d) in zip(chain, chain[1:]):
        x, y = doc[e:s], item[e - f : s - d]
        # every edit destroys Q of the q-grams that this gap doesn't share: beyond the region's budget no passage spans it
        least = max(abs(len(x) - len(y)), (max(len(x), len(y)) - Q) // Q)
        edits.append(edits[-1] + (least if least > budget else distance(x, y)))
    out = []
    for i, j in stretches([(a, b) for a, b, _ in chain], edits, share, min_chars):
        out.append((chain[i][0], chain[j][1], edits[j] - edits[i], sum(max(0, b - a - Q + 1) for a, b, _ in chain[i : j + 1])))
    return out


def passages(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", min_chars: int = MIN_CHARS, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``(doc_id, item_id, shared_grams, first_char, last_char, edits)`` of all passages within the edit budget.

    A passage has at least ``min_chars`` characters (of the words joined by blanks, to which the positions refer too) and at
    most ``edit_share`` edits for each of its characters.  Passages of one item inside a longer one of it are left out.
    """
    least = needed_grams(min_chars, int(min_chars * edit_share))

    def found(block: ItemBlock, texts: list[str]) -> list[tuple]:
        regions, pair, position, diagonal = block.regions(texts, least)
        by_pair: dict[tuple[int, int], set[tuple[int, int, int, int]]] = {}
        for hits in regions:
            d, i = divmod(int(pair[hits[0]]), len(block.ids))
            _, a, b, diagonals = exact_runs(pair[hits], position[hits], diagonal[hits])
            runs = list(zip(a.tolist(), b.tolist(), diagonals.tolist()))
            by_pair.setdefault((d, i), set()).update(aligned(texts[d], block.plain[i], runs, edit_share, min_chars))
        out = []
        for (d, i), some in sorted(by_pair.items()):
            reached = 0
            for a, b, edits, grams in sorted(some, key=lambda x: (x[0], -x[1], x[2])):
                if b > reached:
                    out.append((d, i, grams, a, b, edits))
                    reached = b
        return out

    return _searched(docs, items, doc_key, item_key, text, found, "shared_grams first_char last_char edits")
