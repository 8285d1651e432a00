"""Runs of repeated words, by divide and conquer over the middles of ever shorter stretches.

A run is a stretch of words that repeats itself at a distance, its period, at least once in full. A run in
a stretch of text lies in one of its halves or crosses its middle, so texts are halved until what is left
is shorter than a run. At each middle two Z-functions tell how far the text agrees with itself: that of
the words from the middle on against all earlier and later starts, and that of the words before the
middle, read backwards. A run of period p that crosses the middle holds the middle and the word p before
it, or the last word before the middle and the one p after it, so each p has two places to look at, and
the two values there give the whole extent of the agreement.

All middles of one level, over all texts of a portion, are taken at once. Since both values together
must reach half the shortest run, one of them reaches a quarter: hashes of three words tell which places
can matter (with runs of twelve words), and only there the values are computed, by halving over prefix
hashes of word numbers. Extents reach beyond the stretch to the ends of the text, so each is the whole run; equal
ones are found again at other middles and at multiples of the period, and the smallest period stays.
Every run is compared word by word in the end, so that no hash decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywheel.llm.words import mixed, run_hashes

MIN_WORDS = 12
_PORTION = 1 << 21  # characters of texts that are taken at once
_MOST = 1 << 20  # words that are numbered at most before the numbers start anew
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


class _Text:
    """Numbers of the words of several texts, one text after the other with a number of its own between them, and their prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        self.power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(words.view(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64)))

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether so many words from i and from j (beyond i) on are the same, by their hashes; false beyond the ends."""
        n = len(self.words)
        fits = (i >= 0) & (j + length <= n)
        i, j, length = np.where(fits, i, 0), np.where(fits, j, 0), np.where(fits, length, 0)
        return fits & ((self.prefix[i + length] - self.prefix[i]) * self.power[j - i] == self.prefix[j + length] - self.prefix[j])

    def agreement(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from i on are those from j on, and how many before i are those before j."""
        ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        step = 1 << max(0, int(len(self.words)).bit_length() - 1)
        while step and len(i):
            ahead += np.where(self.same(i + ahead, j + ahead, np.int64(step)), step, 0)
            behind += np.where(self.same(i - behind - step, j - behind - step, np.int64(step)), step, 0)
            step >>= 1
        return ahead, behind


def _crossing(text: _Text, grams: np.ndarray, size: int, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs that cross the middles of these stretches."""
    words, found = text.words, []
    for start, end, fixed in ((lo, mid, mid), (mid, hi, mid - 1)):
        n = end - start
        at = np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)
        hold = lambda values, by, n=n, fixed=fixed: np.repeat(values[fixed - by], n)
        near = (grams[at] == hold(grams, 0)) | (grams[at - size] == hold(grams, size)) & (words[at] == hold(words, 0))
        place, other = at[near], np.repeat(fixed, n)[near]
        found.append((np.minimum(place, other), np.maximum(place, other)))
    i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    period = j - i
    need = np.maximum(period, least - period)
    half = (need + 1) // 2
    likely = text.same(i, j, half) | text.same(i - half, j - half, half)
    i, j, period, need = i[likely], j[likely], period[likely], need[likely]
    ahead, behind = text.agreement(i, j)
    whole = (ahead + behind >= need) & (ahead > 0)
    start = (i - behind)[whole]
    return start, start + (ahead + behind + period)[whole], period[whole]


def _alike(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the run is one, word by word, and goes no further."""
    inside = bool((words[start : end - period] == words[start + period : end]).all())
    return inside and words[start - 1] != words[start - 1 + period] and words[end] != words[end - period]


def _plain(words: np.ndarray, lo: int, hi: int, least: int) -> list[tuple[int, int, int]]:
    """All runs between two places, each period for itself; taken where hashes have failed."""
    best: dict[tuple[int, int], int] = {}
    for p in range(1, (hi - lo) // 2 + 1):
        differ = np.flatnonzero(words[lo : hi - p] != words[lo + p : hi]) + lo
        edges = np.concatenate(([lo - 1], differ, [hi - p]))
        for s, e in zip((edges[:-1] + 1).tolist(), (edges[1:] + p).tolist(), strict=True):
            if e - s >= max(least, 2 * p):
                best.setdefault((s, e), p)
    return [(s, e, p) for (s, e), p in best.items()]


def runs(lists: list[list[int]], least: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs by start and period, from the numbers of its words (0 and above)."""
    pad = max(4, least)
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = pad + np.concatenate(([0], np.cumsum(sizes + 1)))
    words = -1 - np.arange(int(starts[-1]) + pad, dtype=np.int64)  # numbers that occur once
    for s, x in zip(starts.tolist(), lists, strict=False):
        words[s : s + len(x)] = x
    size = max(1, (least + 1) // 2 // 2)
    grams = np.full(len(words), 0, np.uint64)
    hashed = run_hashes(mixed(words.view(np.uint64)), size)
    grams[: len(hashed)] = hashed
    text, found = _Text(words), []
    lo, hi = starts[:-1], starts[:-1] + sizes
    while len(lo):
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        mid = (lo + hi) // 2
        if len(lo):
            found.append(_crossing(text, grams, size, lo, mid, hi, least))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    if not found:
        return out
    start, end, period = (np.concatenate([x[k] for x in found]) for k in range(3))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    failed = set()
    for s, e, p, t in zip(start[first].tolist(), end[first].tolist(), period[first].tolist(), (np.searchsorted(starts, start[first], "right") - 1).tolist(), strict=True):
        if not _alike(words, s, e, p):
            failed.add(t)
        out[t].append((s - int(starts[t]), e - s, p))
    for t in failed:
        a = int(starts[t])
        out[t] = [(s - a, e - s, p) for s, e, p in _plain(words, a, a + int(sizes[t]), least)]
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of a run its first period stays."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in found:
        change[s + p] += 1
        change[s + n] -= 1
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()

        def rows(ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
            found = runs([list(map(numbers.__getitem__, x)) for x in lists], least)
            if len(numbers) > _MOST:
                numbers.clear()
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, lists), pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(map(collapsed, lists, found), pa.binary())], schema=_OUT)

        for b in batches:
            ids, lists, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or b""
                ids.append(i)
                lists.append(text.split())  # bytes know only ASCII blanks
                size += len(text)
                if size >= _PORTION:
                    yield rows(ids, lists)
                    ids, lists, size = [], [], 0
            if ids:
                yield rows(ids, lists)

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (structs of start, length and period by start and period) and collapsed_text for every row of ``docs``.

    A run is a stretch of ``min_words`` words or more, and of two periods or more, in which words a period
    apart are identical, that can't be extended; its period is its smallest. Words are numbered from 0.
    collapsed_text has the words that remain when each run keeps its first period only, joined by a space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are judged one by
    one, whatever their id (null or repeated); a text of any length is taken whole. An empty table gives
    no rows; other columns of ``docs`` are not carried.
    """
    if min_words < 2:
        raise ValueError("a run has two words at least")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    found = texts.mapInArrow(_scan(min_words), "id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed binary")
    return found.selectExpr("id AS doc_id", "n_words", "runs", "CAST(collapsed AS string) AS collapsed_text")
