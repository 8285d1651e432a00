"""Packing documents into sequences by large-item matching and best fit.

Pieces longer than a third of a sequence can share it with at most one more such piece unless both
are gone beyond that, so they are matched greedily: the longest first, each with the longest partner
that still fits. Shorter pieces then fill the tightest gap that takes them, longest first.

Both steps look only at lengths. Lengths are whole numbers up to the capacity, so the plan is made on
a histogram of at most ``capacity`` rows, whatever the size of the corpus, and says how many sequences
of each make-up there are. Each piece finds its place from its rank among the pieces of its length.
Ranks come from counts by task and length, so no length has to pass through a single task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.llm.common import settled
from tallywheel.llm.encoder import default_tokenizer, encoder

#: A run of ``count`` sequences alike: the lengths in each, in order.
Run = tuple[int, tuple[int, ...]]


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs of equal sequences that take every piece of ``histogram`` (length: count)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is outside 1..capacity")
    third = capacity // 3
    runs: list[Run] = []
    large = {n: c for n, c in left.items() if n > third}
    for n in sorted(large, reverse=True):
        while large[n]:
            fits = [m for m in large if large[m] - (m == n) > 0 and m <= min(n, capacity - n)]
            if not fits:
                runs.append((large[n], (n,)))
                large[n] = 0
                continue
            m = max(fits)
            k = large[n] // 2 if m == n else min(large[n], large[m])
            runs.append((k, (n, m)))
            large[n] -= k
            large[m] -= k
    gaps: dict[int, list[Run]] = defaultdict(list)
    for k, held in runs:
        gaps[capacity - sum(held)].append((k, held))
    for n in sorted((x for x in left if x <= third), reverse=True):
        c = left[n]
        # Tightest gap first. A sequence that took one piece may take another, so it is looked at
        # again under its smaller gap before any larger gap is.
        waiting, parked = sorted(g for g in gaps if gaps[g]), []
        heap = list(waiting)
        heapq.heapify(heap)
        while c and heap:
            g = heapq.heappop(heap)
            if g < n or not gaps[g]:
                continue
            k, held = gaps[g].pop()
            if gaps[g]:
                heapq.heappush(heap, g)
            take = min(k, c)
            if take < k:
                parked.append((g, (k - take, held)))
            c -= take
            gaps[g - n].append((take, (*held, n)))
            heapq.heappush(heap, g - n)
        for g, run in parked:
            gaps[g].append(run)
        if c:
            each = capacity // n
            if c // each:
                gaps[capacity - each * n].append((c // each, (n,) * each))
            if c % each:
                gaps[capacity - (c % each) * n].append((1, (n,) * (c % each)))
    return [run for g in sorted(gaps) for run in gaps[g]]


def slots(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, sequence ids at them, and offsets; all rise with the rank."""
    at: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for k, held in runs:
        offset = 0
        for n in held:
            at[n].append((used[n], base, offset))
            used[n] += k
            offset += n
        base += k
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in at.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local_rank", pa.int64())])


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    schema = _PIECES_ARROW.append(pa.field("ids", pa.binary())) if with_ids else _PIECES_ARROW

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rank = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            doc_ids = b.column(0).to_pylist()
            for at, stop, ids, offsets in encoder(path).encode(b.column(1), end_id):
                raw, bounds = memoryview(ids.astype("<u4")).cast("B"), offsets.tolist()
                for doc_id, begin, end in zip(doc_ids[at:stop], bounds[:-1], bounds[1:], strict=True):
                    first, start, piece = (end - begin - 1) % capacity + 1, 0, 0
                    while begin + start < end:
                        n = capacity if piece else first
                        part = raw[4 * (begin + start) : 4 * (begin + start + n)]
                        for column, v in zip(out, (doc_id, piece, start, n, zlib.crc32(part), task, rank[n], part), strict=False):
                            column.append(v)
                        rank[n] += 1
                        start, piece = start + n, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return pieces


def _place(found: dict, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                firsts, ids, offsets = found[n]
                k = np.searchsorted(firsts, rank[at], side="right") - 1
                seq[at], off[at] = ids[k] + rank[at] - firsts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids are those of its whole text and ``end_id``; one with more than ``capacity`` ids
    is cut into pieces of ``capacity``, of which the first may be shorter. Null and empty texts give
    one piece with the end id. Each row of ``docs`` counts as a document, repeated ids included; a
    null id stays null. Other columns of ``docs`` are not carried. Equal lengths are told apart by
    their order in the scan, which decides places and nothing else. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    pieces = settled(texts.mapInArrow(_cut(path, capacity, end_id, with_ids), _PIECES + ", ids binary" * with_ids), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    found = slots(plan_packing(histogram, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(before, ["length", "task"]).select(*names, (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(_place(found, names), "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long")
