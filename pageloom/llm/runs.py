"""Periodic runs of words, by internal pattern matching in each text.

The texts of a batch stand one after another as numbers, equal only for equal words of one text, so nothing
crosses from text to text. Prefix doubling gives the suffix array and, on the way, a name for every
substring of 2^k words. A block is such a substring at a multiple of half its length. A stretch of
period q and length n has a block of at least a third of n - q words in its first n - q words, which occurs again q words
later, so occurrences of every block are asked for in the three windows after it. Those of one block
are a range of the suffix array, and a wavelet tree over that array tells how many lie before a place and
which comes next. Within a window they form an arithmetic progression: its first member, difference and number give
the candidate periods. A candidate is extended both ways by the names, which gives its maximal stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Least length of a run in words.
LEAST = 12
# Bytes of short texts looked at together, and candidates extended at once; only memory depends on them.
TOGETHER, AT_ONCE = 1 << 20, 1 << 19
# log2 of the words in the shortest block: one of 4 words at every second place fits into 6 words.
SHORTEST = 2


def substring_names(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ..: a name per place of the 2^k words there, which is the number of suffixes sorting before all that begin so.

    The last list has all names distinct. A substring that the end cuts short is like no other.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.append(True, np.diff(codes[order]) != 0)
    names = np.empty(n, np.int32)
    names[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, step = [names], 1
    shared = np.flatnonzero(np.bincount(names, minlength=n)[names] > 1)  # only these are sorted again
    while len(shared):
        after = np.full(len(shared), -1, np.int64)
        inside = shared + step < n
        after[inside] = names[shared[inside] + step]
        key = names[shared].astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        shared, key = shared[order], key[order]
        group = names[shared]
        places = np.arange(len(shared))
        first = places[np.append(True, np.diff(group) != 0)][np.cumsum(np.append(True, np.diff(group) != 0)) - 1]
        new = np.append(True, np.diff(key) != 0)
        part = places[new][np.cumsum(new) - 1]
        names = names.copy()
        names[shared] = group + (part - first)
        levels.append(names)
        sizes = np.diff(np.append(places[new], len(shared)))
        shared = shared[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


class WaveletTree:
    """Counts and finds values in ranges of an array, a bit of the value per level; works on arrays of questions."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def count_below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are below `bound`."""
        top = self.levels[0][0] + 1 if self.levels else 0
        over, found = bound >> top > 0, np.zeros(len(lo), np.int64)
        whole = hi - lo
        for bit, zeros, n_zeros in self.levels:
            left_lo, left_hi = zeros[lo], zeros[hi]
            right = (bound >> bit & 1).astype(bool)
            found += np.where(right, left_hi - left_lo, 0)
            lo = np.where(right, n_zeros + lo - left_lo, left_lo)
            hi = np.where(right, n_zeros + hi - left_hi, left_hi)
        return np.where(over, whole, found)

    def at_rank(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value that `rank` others of [lo, hi) lie below: with `count_below`, the successor of a bound."""
        found = np.zeros(len(lo), np.int64)
        for bit, zeros, n_zeros in self.levels:
            left_lo, left_hi = zeros[lo], zeros[hi]
            right = rank >= left_hi - left_lo
            found |= np.where(right, 1 << bit, 0)
            rank = np.where(right, rank - (left_hi - left_lo), rank)
            lo = np.where(right, n_zeros + lo - left_lo, left_lo)
            hi = np.where(right, n_zeros + hi - left_hi, left_hi)
        return found


def _stretches(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretch around each place that keeps the period."""
    n = len(levels[0])
    right, left = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = right + period + (1 << k) <= n
        i = np.where(inside, right, 0)
        right += np.where(inside & (levels[k][i] == levels[k][np.where(inside, right + period, 0)]), 1 << k, 0)
        inside = left >= 1 << k
        i = np.where(inside, left - (1 << k), 0)
        left -= np.where(inside & (levels[k][i] == levels[k][i + np.where(inside, period, 0)]), 1 << k, 0)
    return left, right + period


def find_runs(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run in `codes`, sorted; a row each.

    A run has at least `least` elements and two periods, `least` being 12 or more; its period is the smallest it has, and
    no neighbour continues it.
    """
    none = np.empty((0, 3), np.int64)
    assert least >= 3 << SHORTEST, "the blocks are too long for shorter runs"
    if len(codes) < least:
        return none
    levels = substring_names(codes)
    n, found = len(codes), []
    if len(levels) <= SHORTEST + 1:  # no block occurs twice
        return none
    # Only suffixes whose first block occurs elsewhere take part.
    sizes = np.bincount(levels[SHORTEST], minlength=n)
    repeated = sizes[levels[SHORTEST]] > 1
    sorted_suffixes = np.empty(n, np.int64)
    sorted_suffixes[levels[-1]] = np.arange(n)
    part = repeated[sorted_suffixes]
    place = np.append(0, np.cumsum(part))
    tree = WaveletTree(sorted_suffixes[part])
    for k in range(SHORTEST, len(levels) - 1):
        width = 1 << k
        sizes = np.bincount(levels[k], minlength=n)
        blocks = np.arange(0, n - width + 1, width // 2)
        blocks = blocks[sizes[levels[k][blocks]] > 1]
        for at in range(0, len(blocks), AT_ONCE // 8):
            found.extend(_of_blocks(levels, tree, place, sizes, blocks[at : at + AT_ONCE // 8], k, least))
    rows = np.concatenate([none, *found])
    if not len(rows):
        return none
    rows = np.unique(rows, axis=0)  # by start, end and period: the first of a stretch has its smallest
    rows = rows[np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))]
    out = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _of_blocks(
    levels: list[np.ndarray], tree: WaveletTree, place: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, k: int, least: int,
) -> Iterator[np.ndarray]:
    """(start, end, period) of the stretches that candidates of these blocks of 2^k words belong to."""
    width = 1 << k
    names = levels[k][blocks]
    lo, hi = place[names], place[names + sizes[names]]

    def keep(at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = _stretches(levels, at, period)
        good = end - start >= np.maximum(least, 2 * period)
        return np.stack([start[good], end[good], period[good]], axis=1), end

    before = tree.count_below(lo, hi, blocks + 1)
    own_end = np.zeros(len(blocks), np.int64)  # where the stretch with the block's own period ends, if it is near
    for window in range(3):
        upto = tree.count_below(lo, hi, blocks + (window + 1) * width + 1)
        number = upto - before
        has = np.flatnonzero(number > 0)
        first = tree.at_rank(lo[has], hi[has], before[has])
        if window == 0:
            rows, own_end[has] = keep(blocks[has], first - blocks[has])  # later members are multiples of this period
            yield rows
        else:
            several = np.flatnonzero(number[has] > 1)
            step = np.zeros(len(has), np.int64)
            step[several] = tree.at_rank(lo[has[several]], hi[has[several]], before[has[several]] + 1) - first[several]
            # Members within the block's own stretch are multiples of its period again.
            known = np.maximum(0, own_end[has] - width - first + 1)
            skip = np.where(step > 0, -(-known // np.maximum(step, 1)), np.minimum(known, 1))
            left = np.maximum(number[has] - skip, 0)
            ends = np.cumsum(left)
            done = 0
            while done < len(has):
                upper = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
                some = slice(done, upper)
                count = left[some]
                member = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(skip[some], count)
                at = np.repeat(blocks[has[some]], count)
                yield keep(at, np.repeat(first[some], count) + member * np.repeat(step[some], count) - at)[0]
                done = upper
        before = upto


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: ASCII white space only


def runs_of_texts(texts: list[str | None], least: int = LEAST) -> Iterator[tuple[np.ndarray, str]]:
    """Runs of each text and its words, each run cut to its first period, joined by spaces."""
    lists = [_split(text) for text in texts]
    codes: list[int] = []
    starts = [0]
    for words in lists:  # a word's number is the place of its first occurrence in its text
        first: dict[bytes, int] = {}
        codes.extend(map(first.setdefault, words, range(starts[-1], starts[-1] + len(words))))
        starts.append(starts[-1] + len(words))
    rows = find_runs(np.array(codes, np.int64), least)
    cuts = np.searchsorted(rows[:, 0], starts)
    for words, at, lo, hi in zip(lists, starts, cuts, cuts[1:], strict=False):
        own = rows[lo:hi] - [at, 0, 0]
        if len(own):
            open_ = np.zeros(len(words) + 1, np.int64)
            np.add.at(open_, own[:, 0] + own[:, 2], 1)
            np.add.at(open_, own[:, 0] + own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(open_[:-1]) == 0).tolist()]
        yield own, b" ".join(words).decode()


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The columns `keep` of `docs`, `runs` (array of start, length, period; by start, then period) and `collapsed`.

    Words are separated by ASCII white space and numbered from 0; a run is a maximal stretch of `least` words or more (12 at
    least) that holds its smallest period twice. `collapsed` has the words not in a run beyond its first period. Null, empty and
    blank texts have no runs and an empty `collapsed`; columns of those names are replaced. Rows neither
    move nor change their number; memory goes with the longest text.
    """
    keep = tuple(c for c in keep if c not in ("runs", "collapsed"))

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        lo, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(len(keep))).fill_null(0).to_pylist()):
            if held and held + size > TOGETHER:
                yield lo, i
                lo, held = i, 0
            held += size
        if batch.num_rows > lo:
            yield lo, batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in groups(batch):
                found = list(runs_of_texts(batch.column(len(keep))[lo:hi].to_pylist(), least))
                flat = np.concatenate([rows for rows, _ in found])
                ends = np.cumsum([0, *(len(rows) for rows, _ in found)])
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), lists, pa.array([t for _, t in found], pa.string())], [*names, "runs", "collapsed"])

    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]
    schema = ", ".join([*kinds, "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])
    return docs.select(*keep, text).mapInArrow(run, schema).toDF(*keep, "runs", "collapsed")
