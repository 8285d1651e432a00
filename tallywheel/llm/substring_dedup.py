"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the fifteen six-word runs in each window of twenty words, the one with
the smallest hash (the last of equals). Equal windows choose the same anchor, so documents that share
a passage of twenty words or more meet under at least one anchor; an eighth of all words starts one.
Each occurrence of an anchor carries the extensions that it stands for: hashes of the windows that
chose it, which reach up to fourteen words to the left and to the right. Under an anchor, occurrences are
taken in the order of (document, position), and a window that was seen before is part of a repeat.
Windows of consecutive anchors overlap, so their union is the maximal repeat.

Occurrences with the same anchor and the same windows are folded before the shuffle: all but the first
in a portion of a task's rows are repeats whatever other tasks hold. A passage in a third of all
documents thus sends one row for each portion. Windows are told apart by 64 bits of the anchor, the
place in it and 48 bits more.

A short passage that many documents hold in other surroundings would still bring all of them to one
anchor. So a first pass counts occurrences by 16 bits of the anchor. Under those that have many times
their share each window is sent by itself, dealt by its own hash; of equal ones a task sends the first and
those that come before what it has sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm.common import width
from tallywheel.llm.words import mixed, portions, run_hashes, word_hashes, word_lists

_LAST = 2**63 - 1
_SEED = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int32()), ("place", pa.int32()), ("windows", pa.binary())])
_SEED_DDL = "anchor long, id long, text_key int, start int, place int, windows binary"
_MARK = pa.schema([("id", pa.int64()), ("text_key", pa.int32()), ("ranges", pa.binary())])
_MARK_DDL = "id long, text_key int, ranges binary"
_BYTES = 6
_GROUPS = 1 << 16
#: A group of anchors is hot with so many times the mean of all groups, and so many occurrences at least.
HOT_TIMES, HOT_LEAST = 8, 1000
_SENT = 200_000  # windows under hot anchors that a task remembers


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of an (n, width) byte table, so many of them in each binary value."""
    ends = np.concatenate(([0], np.cumsum(counts) * values.shape[1])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(texts: list[str | None], least: int):
    """Runs of windows under one anchor: anchor hash, text, first window, its place, count, and all windows' hashes."""
    anchor = max(1, 3 * least // 10)
    flat, offsets = word_hashes(word_lists(texts, lower=False))
    n = len(flat) - least + 1
    if n <= 0:
        return None
    seeds = run_hashes(flat, anchor)
    best, arg = seeds[:n].copy(), np.zeros(n, np.int32)
    for o in range(1, least - anchor + 1):
        other = seeds[o : o + n]
        lower = other <= best
        best[lower] = other[lower]
        arg[lower] = o
    whole = seeds[:n].copy()
    with np.errstate(over="ignore"):
        for o in [*range(anchor, least - anchor, anchor), least - anchor]:  # runs that cover the window between them
            whole *= np.uint64(0x9E3779B97F4A7C15)
            whole += seeds[o : o + n]
        whole = mixed(whole)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    at = np.flatnonzero(text[:n] == text[least - 1 :])
    if not len(at):
        return None
    place = arg[at]
    chosen = at + place
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    counts = np.diff(np.concatenate((first, [len(at)])))
    t = text[at[first]]
    return best[at[first]], t, (at[first] - offsets[t]).astype(np.int32), place[first], counts, whole[at]


def _counted(least: int):
    """Occurrences of anchors by group, one batch at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_GROUPS, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in portions(texts, 2 << 20):
                if (found := _runs(texts[part], least)) is not None:
                    total += np.bincount((found[0] % np.uint64(_GROUPS)).astype(np.int64), minlength=_GROUPS)
        group = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(total[group])], names=["group", "n"])

    return run


def hot_groups(texts: DataFrame, least: int) -> np.ndarray:
    """For each group of anchors whether it is hot; at most one in ``HOT_TIMES`` is."""
    rows = texts.mapInArrow(_counted(least), "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()  # 65536 rows at most
    total = np.zeros(_GROUPS, np.int64)
    total[[r["group"] for r in rows]] = [r["n"] for r in rows]
    return total > max(HOT_LEAST, HOT_TIMES * total.sum() / _GROUPS)


def _apart(found, hot: np.ndarray):
    """``found`` (as of ``_runs``) with runs under hot anchors divided into single windows, dealt by their own hash; and which these are."""
    anchor, t, start, place, counts, windows = found
    warm = hot[(anchor % np.uint64(_GROUPS)).astype(np.int64)]
    if not warm.any():
        return (*found, warm)
    run = np.repeat(np.arange(len(anchor)), counts)
    k = (np.arange(len(windows)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    keep = warm[run] | (k == 0)  # a row for each window under a hot anchor, and one for each other run
    row, own = run[keep], k[keep]
    single = warm[row]
    at = place[row] - own
    with np.errstate(over="ignore"):
        spread = mixed(mixed(windows[keep] + anchor[row] * np.uint64(0x9E3779B97F4A7C15)) + at.astype(np.uint64))
    return np.where(single, spread, anchor[row]), t[row], start[row] + own, at.astype(np.int32), np.where(single, 1, counts[row]), windows, single


def _seeds(least: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, tuple[int, int]] = {}
        for b in batches:
            all_ids, all_keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = b.column(2).to_pylist()
            for part in portions(texts, 2 << 20):
                if (found := _runs(texts[part], least)) is None:
                    continue
                anchor, t, start, place, counts, windows, single = _apart(found, hot)
                ids, keys = all_ids[part][t], all_keys[part][t]
                begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
                with np.errstate(over="ignore"):
                    spread = mixed(windows + np.arange(len(windows), dtype=np.uint64) - np.repeat(begins, counts).astype(np.uint64))
                    own = mixed(np.add.reduceat(spread, begins) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + counts.astype(np.uint64))
                order = np.lexsort((start, ids, own, anchor))
                same = np.concatenate(([False], (anchor[order][1:] == anchor[order][:-1]) & (own[order][1:] == own[order][:-1])))
                lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = order[same & ((ids[order] != ids[lead]) | (start[order] != start[lead]))]
                send = order[~same]
                if single.any():
                    past = np.zeros(len(anchor), bool)
                    for i in send[single[send]].tolist():
                        key, here = int(anchor[i]), (int(ids[i]), int(start[i]))
                        before = sent.get(key)
                        if before is not None and before < here:
                            past[i] = True
                        elif before is not None or len(sent) < _SENT:
                            sent[key] = here
                    later, send = np.concatenate((later, send[past[send]])), send[~past[send]]
                which = np.repeat(begins[send], counts[send]) + np.arange(int(counts[send].sum())) - np.repeat(np.cumsum(counts[send]) - counts[send], counts[send])
                low = windows[which].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[send].view(np.int64)), pa.array(ids[send]), pa.array(keys[send]), pa.array(start[send]), pa.array(place[send]), _binary(low, counts[send])], schema=_SEED)
                if len(later):
                    later = later[np.lexsort((start[later], keys[later], ids[later]))]
                    pairs = np.stack((start[later], counts[later]), axis=1).astype("<i4").view(np.uint8).reshape(-1, 8)
                    head = np.flatnonzero(np.concatenate(([True], (ids[later][1:] != ids[later][:-1]) | (keys[later][1:] != keys[later][:-1]))))
                    of_text = later[head]
                    size = np.diff(np.concatenate((head, [len(later)])))
                    yield pa.RecordBatch.from_arrays([pa.array(mixed(ids[of_text].view(np.uint64)).view(np.int64)), pa.array(ids[of_text]), pa.array(keys[of_text]), pa.array(np.zeros(len(head), np.int32)), pa.array(np.full(len(head), -1, np.int32)), _binary(pairs, size)], schema=_SEED)

    return run


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of a binary column, and the number in each row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :_BYTES] = raw
    return wide.view("<u8").ravel(), np.diff(ends) // _BYTES


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that occurred before; rows come sorted by anchor, id and start."""
    held: pa.Table | None = None
    last, seen = None, np.empty(0, np.uint64)

    def resolve(rows: pa.Table):
        nonlocal last, seen
        anchor = rows["anchor"].to_numpy()
        group = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]).astype(np.int64))))
        size = np.bincount(group)
        old = last == anchor[0]
        need = size > 1
        need[0] |= old
        need[-1] = True  # its windows may be met again in the next batch
        index = np.flatnonzero(need[group])
        rows, group = rows.take(pa.array(index)).combine_chunks(), group[index]
        windows, counts = _windows(rows["windows"].chunk(0))
        row = np.repeat(np.arange(len(index)), counts)
        k = np.arange(len(windows)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = windows | ((rows["place"].to_numpy()[row] - k).astype(np.uint64) << np.uint64(48))
        ids, start, g = rows["id"].to_numpy(), rows["start"].to_numpy(), group[row]
        order = np.lexsort((key, g))  # stable, so equals stay in the order of id and start
        new = np.concatenate(([True], (g[order][1:] != g[order][:-1]) | (key[order][1:] != key[order][:-1])))
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = np.zeros(len(order), bool)
        a, b = row[order], row[lead]
        again[order] = (ids[a] != ids[b]) | (start[a] + k[order] != start[b] + k[lead])
        if old:
            of_old = g == 0
            again[of_old] |= np.isin(key[of_old], seen)
        at_end = g == group[-1]
        fresh = np.unique(key[at_end])
        seen = np.union1d(seen, fresh) if old and group[-1] == 0 else fresh
        last = anchor[-1]
        hit = np.flatnonzero(again)
        if len(hit):
            cut = np.flatnonzero(np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (k[hit][1:] != k[hit][:-1] + 1))))
            r, begin, count = row[hit[cut]], k[hit[cut]], np.diff(np.concatenate((cut, [len(hit)])))
            pairs = np.stack((start[r] + begin, count), axis=1).astype("<i4").view(np.uint8).reshape(-1, 8)
            return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(rows["text_key"].to_numpy()[r]), _binary(pairs, np.ones(len(r), np.int64))], schema=_MARK)
        return None

    for b in batches:
        place = b.column(4).to_numpy()
        if (place < 0).any():
            ready = b.filter(pa.array(place < 0))
            yield pa.RecordBatch.from_arrays([ready.column(1), ready.column(2), ready.column(5)], schema=_MARK)
            b = b.filter(pa.array(place >= 0))
        rows = pa.Table.from_batches([b])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        if not len(rows):
            continue
        anchor, ids, start = (rows[c].to_numpy() for c in ("anchor", "id", "start"))
        tail = (anchor == anchor[-1]) & (ids == ids[-1]) & (start == start[-1])
        stop = len(rows) - int(tail.sum())
        held = rows.slice(stop)
        if stop and (out := resolve(rows.slice(0, stop))) is not None:
            yield out
    if held is not None and len(held) and (out := resolve(held)) is not None:
        yield out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])


def _remove(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _OUT]
            for doc_id, text, marks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                (words,) = word_lists([text], lower=False)
                spans, kept = [], words
                if marks:
                    ranges = np.frombuffer(b"".join(marks), "<i4").reshape(-1, 2)
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, ranges[:, 0], 1)
                    np.add.at(steps, ranges[:, 0] + ranges[:, 1] - 1 + least, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    spans = edge.reshape(-1, 2).tolist()
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                for column, v in zip(out, (doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), spans), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and spans (removed [start, end) in words) of every row.

    A window is ``min_words`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. A word goes if a
    window over it also starts earlier: in a document with a smaller id, or before in the same one.
    Windows are judged on the input. Null, empty and blank texts have no words; texts shorter than a
    window lose none. A null id counts as the largest. Rows that repeat an id count as one document:
    equal windows at the same place are not earlier than each other. An empty table gives no rows;
    other columns are not carried.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("id"), F.hash(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    hot = hot_groups(texts.select("text"), min_words)
    seeds = texts.select("id", "text_key", "text").mapInArrow(_seeds(min_words, hot), _SEED_DDL)
    met = seeds.repartition(width(spark), "anchor").sortWithinPartitions("anchor", "id", "start")
    marks = met.mapInArrow(_extend, _MARK_DDL).groupBy("id", "text_key").agg(F.collect_list("ranges").alias("marks"))
    return texts.join(marks, ["id", "text_key"], "left").select("doc_id", "text", "marks").mapInArrow(_remove(min_words), "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<int>>")
