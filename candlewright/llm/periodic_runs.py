"""Runs of words that repeat with a period, found by a dictionary of basic factors.

The dictionary names the stretches of 1, 2, 4, ... words: two of one length have one name exactly if their words agree. A
run of period q holds, for the power m = 2^k with m <= q < 2m, a stretch of m words that comes again q words later, so
within twice its length. Occurrences of a stretch at most m / 2 apart form arithmetic progressions; the distances between
two neighbouring progressions form one too, and these are the periods proposed. The dictionary then tells how far each
proposed period holds to both sides, and of equal runs the one with the smallest period stays.

All documents of a batch are searched together, as one series of words in which no document's words equal another's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, small_batches, with_results

#: Least words of a run; it also holds its period twice.
LEAST_WORDS = 12
#: Bytes of text searched at once.
BATCH_BYTES = 4 << 20
RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

#: (ids, word counts) -> (first looped word, period) of each document; a period of 0 loops nothing.
Loops = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


def dictionary(words: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words that begin at each position; a stretch that comes once, or leaves the
    series, has a negative name of its own. The last level has nothing that comes twice."""
    levels, n = [], len(words)
    at, keys = np.arange(n), words.astype(np.int64)
    while True:
        names, distinct = pd.factorize(keys)
        again = np.bincount(names, minlength=len(distinct))[names] > 1
        level = -1 - np.arange(n)
        level[at[again]] = names[again]
        levels.append(level)
        m = 1 << len(levels) - 1
        first = np.flatnonzero(level[: max(n - m, 0)] >= 0)
        at = first[level[first + m] >= 0]
        if not len(at):
            return levels
        keys = level[at] * n + level[at + m]


def proposals(names: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) with m <= period < 2m: the stretch of m words there comes again a period later."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    name = names[at]
    near = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= m)
    first = np.flatnonzero(np.concatenate([[True], ~near])) if len(at) else at  # where a progression begins
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    step = np.where(last > first, at[np.minimum(first + 1, len(at) - 1)] - at[first], 1) if len(at) else at
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(1, 5):  # progressions are over m / 2 apart
        c, d = np.arange(max(len(first) - t, 0)), np.arange(t, max(len(first), t))
        gap = at[first[d]] - at[last[c]]
        use = (name[first[c]] == name[first[d]]) & (gap < 2 * m)
        if not use.any():
            break
        c, d, gap = c[use], d[use], gap[use]
        n_c, n_d = last[c] - first[c], last[d] - first[d]  # steps to the left and to the right
        by = np.where(n_c > 0, step[c], step[d])
        # of two progressions with a step each, the steps are equal: both are the least period of the stretch
        lo, hi = np.maximum(-(-(m - gap) // by), 0), np.minimum((2 * m - 1 - gap) // by, n_c + n_d)
        sizes = np.maximum(hi - lo + 1, 0)
        row = np.repeat(np.arange(len(c)), sizes)
        k = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[row]
        found.append((at[last[c[row]]] - np.minimum(k, n_c[row]) * by[row], gap[row] + k * by[row]))
    if not found:
        return at[:0], at[:0]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from i and j on agree; or, not ahead, before i and j. Each level fits once, as the last never does."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        m, names = 1 << k, levels[k]
        a, b = (i + out, j + out) if ahead else (i - out - m, j - out - m)
        fits = np.flatnonzero((np.minimum(a, b) >= 0) & (np.maximum(a, b) < n))
        out[fits[names[a[fits]] == names[b[fits]]]] += m
    return out


def find_runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, one a row, ordered by start, then period. words: equal numbers for equal words."""
    levels, found = dictionary(words), [np.zeros((0, 3), np.int64)]
    for k, names in enumerate(levels):
        i, period = proposals(names, 1 << k)
        left, right = extended(levels, i, i + period, False), extended(levels, i, i + period, True)
        length = left + right + period
        found.append(np.stack([i - left, length, period], axis=1)[length >= np.maximum(2 * period, LEAST_WORDS)])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    least = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]) if len(runs) else np.zeros(0, bool)
    runs = runs[least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _searched(ids: list, texts: pa.Array, loops: Loops | None) -> pa.StructArray:
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(trimmed)
    sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)  # split into one empty word
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)[np.repeat(~blank, sizes)]
    sizes = np.where(blank, 0, sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if loops:
        start, period = loops(ids, sizes)
        place = np.arange(len(codes)) - edges[doc]
        start, period = start[doc], period[doc]
        looped = (period > 0) & (place >= start)
        place[looped] = (start + (place - start) % np.maximum(period, 1))[looped]
        codes = codes[edges[doc] + place]
    runs = find_runs(doc * max(len(coded.dictionary), 1) + codes)
    of = doc[runs[:, 0]]
    # words after a run's first period go
    over = np.zeros(len(codes) + 1, np.int64)
    np.add.at(over, runs[:, 0] + runs[:, 2], 1)
    np.add.at(over, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(over[:-1]) == 0
    kept_edges = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(sizes)))])
    words = coded.dictionary.cast(pa.large_string()).take(pa.array(codes[kept]))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_edges), words), pa.scalar(" ", pa.large_string()))
    rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - edges[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
    run_edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(run_edges), rows), collapsed.cast(pa.string())], ["runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: Loops | None = None) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) in words, by start and period, and `collapsed`: the words that
    no run covers after its first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. A null, empty or blank text has no runs and collapses to an empty text. Repeated rows get
    equal results, ids matter to `loops` only, and no ties arise, as no two runs share their words and period. Each text is
    searched whole, however long: time grows with its words times the levels of the dictionary that hold repeats. An empty
    table gives an empty result. Columns named like the results, in whatever case, are replaced; all others stay.

    loops: rewrites documents before the search; a word i from the first looped one, a, on becomes word a + (i - a) mod period.
    """
    own = own_prefix(docs)

    @F.arrow_udf(RESULT)
    def searched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            parts = small_batches([pa.RecordBatch.from_arrays([ids, texts], ["id", "t"])], "t", BATCH_BYTES)
            yield pa.concat_arrays([_searched(b.column("id").to_pylist() if loops else [], b.column("t"), loops) for b in parts])

    rows = docs.withColumn(f"{own}found", searched(F.col(id_col), F.col(text_col)))
    return with_results(rows, own, {c: F.col(f"{own}found.{c}") for c in ("runs", "collapsed")})
