"""Periodic runs of words: longest common extensions on Ukkonen trees, Lyndon roots extended both ways."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run holds its period so often, and so many words, at least.
REPEATS, LEAST = 4, 6
#: Entries of an Euler tour that share one entry of the table of minima.
TOUR_BLOCK = 32

_RUNS = "array<struct<start bigint, length bigint, period bigint>>"


class SuffixTree:
    """The suffix tree of numbers from 1 up, by Ukkonen's algorithm, with an end mark 0.

    ``kids`` lists all children, ordered by parent and first symbol; those of a node begin at
    ``first[node]``. Leaves are numbered by their suffixes in ``suffix``.
    """

    def __init__(self, symbols: Sequence[int]) -> None:
        s = [*symbols, 0]
        n, width = len(s), max(s) + 1
        to: dict[int, int] = {}
        start, stop, link, leaves = [0], [0], [0], []
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    span = min(stop[child], i + 1) - begin
                    if length >= span:
                        node, length, edge = child, length - span, edge + span
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    to[key] = split
                    to[split * width + c] = split + 1
                    to[split * width + s[begin + length]] = child
                    leaves.append(split + 1)
                    start += (begin, i)
                    stop += (begin + length, n)
                    link += (0, 0)
                    start[child] = begin + length
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.size = n
        keys = np.fromiter(to.keys(), np.int64, len(to))
        order = np.argsort(keys)
        self.kids = np.fromiter(to.values(), np.int64, len(to))[order].tolist()
        symbols_in_order = keys[order] % width
        parents = keys[order] // width
        bounds = np.searchsorted(parents, np.arange(len(start) + 1))
        self.first = bounds.tolist()
        self.marked = (symbols_in_order == 0).tolist()
        self.span = (np.array(stop) - np.array(start)).tolist()
        self.suffix = np.full(len(start), -1)
        self.suffix[leaves] = np.arange(n)

    def ranks(self, descending: bool = False) -> list[int]:
        """The rank of every suffix among the sorted ones; the end mark is least in both orders."""
        kids, first, marked = self.kids, self.first, self.marked
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            a, b = first[node], first[node + 1]
            if a == b:
                order.append(node)
            elif descending:
                begin = a + marked[a]
                stack += kids[begin:b]
                stack += kids[a:begin]
            else:
                stack += kids[a:b][::-1]
        found = np.empty(self.size, np.int64)
        found[self.suffix[order]] = np.arange(self.size)
        return found.tolist()

    def extensions(self) -> Extensions:
        """Longest common extensions by lowest common ancestors on the Euler tour."""
        kids, first, span = self.kids, self.first, self.span
        after, tour, place = self.first[:-1], [0], [0] * len(span)
        stack, depths = [0], [0]
        while stack:
            node = stack[-1]
            at = after[node]
            if at < first[node + 1]:
                after[node] = at + 1
                child = kids[at]
                place[child] = len(tour)
                stack.append(child)
                depths.append(depths[-1] + span[child])
                tour.append(depths[-1])
            else:
                stack.pop()
                depths.pop()
                if stack:
                    tour.append(depths[-1])
        where = np.empty(self.size, np.int64)
        is_leaf = self.suffix >= 0
        where[self.suffix[is_leaf]] = np.array(place)[is_leaf]
        return Extensions(np.array(tour), where)


class Extensions:
    """How long suffixes agree: the least depth of the tour between their leaves, in constant time.

    The tour is cut in blocks. A query takes the rest of its first block, the start of its last
    one, and two overlapping power-of-two stretches of whole blocks between.
    """

    def __init__(self, tour: np.ndarray, where: np.ndarray) -> None:
        blocks = -(-len(tour) // TOUR_BLOCK)
        depth = np.full(blocks * TOUR_BLOCK, tour.max() + 1, np.int32)
        depth[:len(tour)] = tour
        cut = depth.reshape(blocks, TOUR_BLOCK)
        self.depth, self.where = depth, where
        self.to_here = np.minimum.accumulate(cut, axis=1).ravel()
        self.from_here = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [cut.min(axis=1)]
        reach = 1
        while 2 * reach <= blocks:
            low = self.table[-1]
            self.table.append(np.minimum(low[:-reach], low[reach:]))
            reach *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length on which the suffixes at i and j agree; they are different ones."""
        x, y = self.where[i], self.where[j]
        x, y = np.minimum(x, y), np.maximum(x, y)
        one, two = x // TOUR_BLOCK, y // TOUR_BLOCK
        found = np.minimum(self.from_here[x], self.to_here[y])
        far = np.flatnonzero(two - one > 1)
        if len(far):
            a, b = one[far] + 1, two[far]
            level = np.frexp(b - a)[1] - 1
            for k in np.unique(level):
                now = level == k
                row, at = self.table[k], far[now]
                found[at] = np.minimum(found[at], np.minimum(row[a[now]], row[b[now] - (1 << int(k))]))
        near = np.flatnonzero(one == two)
        if len(near):
            a, b = x[near], y[near]
            least = self.depth[a]
            for step in range(1, TOUR_BLOCK):
                least = np.minimum(least, self.depth[np.minimum(a + step, b)])
            found[near] = least
        return found


def _next_smaller(rank: list[int]) -> np.ndarray:
    """The next place of a smaller rank, or the end: there the longest Lyndon word from a place ends."""
    n = len(rank)
    found, stack = [n] * n, []
    for i in range(n):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found)


def runs_of(symbols: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of every run of numbers from 1 up, by start and period.

    A run's root is, in one of the two orders of the symbols, the longest Lyndon word at each
    of its places in the run. A run of three periods or more holds it twice on end, so a
    longest Lyndon word counts that is followed by its like, and of such words on end the first.
    """
    if repeats < 3:
        raise ValueError(f"runs of {repeats} periods are not found by repeated roots")
    n = len(symbols)
    tree = SuffixTree(symbols.tolist())
    found = []
    for descending in (False, True):
        ends = _next_smaller(tree.ranks(descending)[:n])
        period = ends - np.arange(n)
        starts = np.flatnonzero(ends < n)
        starts = starts[period[ends[starts]] == period[starts]]
        found.append(starts * (n + 1) + period[starts])
    roots = np.unique(np.concatenate(found))
    i, p = roots // (n + 1), roots % (n + 1)
    ahead = tree.extensions().of(i, i + p)
    del tree
    alike = ahead >= p
    roots, i, p, ahead = roots[alike], i[alike], p[alike], ahead[alike]
    first = ~np.isin(roots - p * (n + 1), roots)
    i, p, ahead = i[first], p[first], ahead[first]
    if not len(i):
        return []
    back = SuffixTree(symbols[::-1].tolist()).extensions()
    left = i > 0
    behind = np.zeros(len(i), np.int64)
    behind[left] = back.of(n - i[left], n - i[left] - p[left])  # the suffixes of the reversal from i-1 and i+p-1
    start, length = i - behind, behind + p + ahead
    long = length >= np.maximum(least, repeats * p)
    rows = np.unique(np.stack([start[long], p[long], length[long]]), axis=1)
    return [(int(a), int(c), int(b)) for a, b, c in rows.T]


def _stretches(ids: np.ndarray, repeats: int, least: int) -> list[tuple[int, int]]:
    """start and end of the parts that can hold a run.

    Every word of a run, and a word that would prolong one, stands in it once a period, so a
    word with fewer places in a part than ``repeats`` cuts it, and what is left is counted anew.
    """
    open_parts, done = [(0, len(ids))], []
    while open_parts:
        a, b = open_parts.pop()
        if b - a < least:
            continue
        _, known, count = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        often = count[known] >= repeats
        if often.all():
            done.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False]))))
        open_parts += [(a + int(x), a + int(y)) for x, y in zip(edges[::2], edges[1::2])]
    return sorted(done)


def word_runs(words: Sequence[bytes], repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of every run of words, by start and period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = []
    for a, b in _stretches(ids, repeats, least):
        symbols = np.unique(ids[a:b], return_inverse=True)[1] + 1
        found += [(a + start, length, period) for start, length, period in runs_of(symbols, repeats, least)]
    return found


def without_repeats(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, stays in zip(words, kept.tolist()) if stays]


def _searcher(repeats: int, least: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()  # at \x20 and \x09-\x0D
                found = word_runs(words, repeats, least)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), run)) for run in found])
                texts.append(b" ".join(without_repeats(words, found)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return search


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    repeats: int = REPEATS, least: int = LEAST,
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed of every row.

    A run is a stretch of words with smallest period p that repeats it ``repeats`` times (3 or
    more) and has ``least`` words or more, as long as it goes on at both sides. In ``collapsed``
    the words of a run after its first period are missing; the kept ones are joined by one
    space. Words are compared as they are.

    Only stretches in which every word is frequent enough are searched, and they are cut
    exactly: no run reaches over their ends. Their work and memory grow in proportion to
    their words, about one kilobyte each while they are searched, whatever the periods. Rows
    are independent, so nothing is shuffled. A null or empty text, or one of white space,
    has no words and no runs; a null id stays null, and rows that repeat an id are separate
    rows. An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(
        _searcher(repeats, least), f"doc_id bigint, n_words bigint, runs {_RUNS}, collapsed string")
