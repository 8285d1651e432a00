"""Exact deduplication by Grace hashing.

Records are dealt by a hash of their content. A task that cannot hold the distinct contents dealt to
it splits them further by other bits of the hash into spill files, again and again, until each bucket
fits an open-addressing table; the table compares complete contents, never hashes alone. Before the
shuffle every task folds its own copies by the same table, so of a text that makes up a third of all
rows each task sends one record and not all of them.

Spill files lie in the shared folder (``spark.checkpoint.dir``) under a name of the task attempt's
own, and go when the task ends; no other task reads them, so a lost executor costs a retry.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm.common import free_name, scratch, squeezed, width

_SCHEMA = pa.schema([("bucket", pa.int64()), ("text_sha256", pa.string()), ("content", pa.string()), ("code_points", pa.int32()), ("best_id", pa.int64()), ("group_size", pa.int64())])
_DDL = "bucket long, text_sha256 string, content string, code_points int, best_id long, group_size long"
_FANOUT_BITS = 4
_BATCH_BYTES = 4 << 20


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of a distinct content."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.mask = 1023
        self.hashes: list[int] = []
        self.rows: list[list] = []  # sha, content, code points, id that stays, count
        self.held = 0

    def add(self, h: int, sha: str, content: str, points: int, doc_id: int, count: int) -> None:
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and (row := self.rows[k])[1] == content:
                row[4] += count
                if (-points, doc_id) < (-row[2], row[3]):
                    row[2], row[3] = points, doc_id
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.rows)
        self.hashes.append(h)
        self.rows.append([sha, content, points, doc_id, count])
        self.held += len(content) + 200
        if 2 * len(self.rows) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k

    def batches(self) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for h, row in zip(self.hashes, self.rows, strict=True):
            part.append((h, row))
            size += len(row[1])
            if size > _BATCH_BYTES:
                yield _as_batch(part)
                part, size = [], 0
        if part:
            yield _as_batch(part)


def _as_batch(part: list) -> pa.RecordBatch:
    signed = np.array([h for h, _ in part], np.uint64).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed), *(pa.array([r[i] for _, r in part], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())))], schema=_SCHEMA)


def _hash(content: str) -> int:
    return xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass"))


class _Spill:
    """Files of one task attempt in the shared folder, one for each bucket of a level."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(uri)
        self.root = f"{root}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)

    def writer(self):
        path = f"{self.root}/{uuid.uuid4().hex}"
        return path, self.fs.open_output_stream(path)

    def records(self, path: str) -> Iterator[tuple]:
        with self.fs.open_input_stream(path) as f:
            while head := f.read(4):
                (n,) = struct.unpack("<I", head)
                body = f.read(n)
                h, points, doc_id, count, sha_n = struct.unpack_from("<QiqqH", body)
                at = 30
                yield h, body[at : at + sha_n].decode(), body[at + sha_n :].decode("utf-8", "surrogatepass"), points, doc_id, count
        self.fs.delete_file(path)

    def close(self) -> None:
        self.fs.delete_dir(self.root)


def _pack(h: int, sha: str, content: str, points: int, doc_id: int, count: int) -> bytes:
    s, c = sha.encode(), content.encode("utf-8", "surrogatepass")
    body = struct.pack("<QiqqH", h, points, doc_id, count, len(s)) + s + c
    return struct.pack("<I", len(body)) + body


def grace(records: Iterator[tuple], budget: int, spill_uri: str) -> Iterator[pa.RecordBatch]:
    """Fold records ``(hash, sha, content, code points, id, count)`` into one row per content.

    ``budget`` bounds the characters that one table holds. A level splits by the next four bits of
    the hash; contents that share a whole hash stay together and are told apart by the table.
    """
    spill: list[_Spill] = []

    def level(stream: Iterator[tuple], depth: int) -> Iterator[pa.RecordBatch]:
        table, last = ContentTable(), 64 - _FANOUT_BITS * (depth + 1) <= 20
        for r in stream:
            table.add(*r)
            if table.held > budget and not last:
                break
        else:
            yield from table.batches()
            return
        if not spill:
            spill.append(_Spill(spill_uri))
        shift = 64 - _FANOUT_BITS * (depth + 1)
        files = [spill[0].writer() for _ in range(1 << _FANOUT_BITS)]
        held = ((h, *row) for h, row in zip(table.hashes, table.rows, strict=True))
        for source in (held, stream):
            for r in source:
                files[(r[0] >> shift) & ((1 << _FANOUT_BITS) - 1)][1].write(_pack(*r))
        del table
        for _, f in files:
            f.close()
        for path, _ in files:
            yield from level(spill[0].records(path), depth + 1)

    try:
        yield from level(iter(records), 0)
    finally:
        for s in spill:
            s.close()


def _before_shuffle(budget: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for b in batches:
            for doc_id, sha, content, points in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                table.add(_hash(content), sha, content, points, doc_id, 1)
                if table.held > budget:
                    yield from table.batches()
                    table = ContentTable()
        yield from table.batches()

    return fold


def _after_shuffle(budget: int, spill_uri: str):
    def records(batches):
        for b in batches:
            for h, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield h & 0xFFFFFFFFFFFFFFFF, *r

    return lambda batches: grace(records(batches), budget, spill_uri)


def content_groups(keyed: DataFrame, table_chars: int = 48 << 20) -> DataFrame:
    """One row per distinct content of ``keyed`` (id, text_sha256, content, code_points).

    Returns text_sha256, keep_id (most code points, then smallest id) and group_size.
    """
    spark = keyed.sparkSession
    folded = keyed.mapInArrow(_before_shuffle(table_chars // 2), _DDL)
    dealt = folded.repartition(width(spark), "bucket")
    return dealt.mapInArrow(_after_shuffle(table_chars, scratch(spark, "grace")), _DDL).select("text_sha256", F.col("best_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_chars: int = 48 << 20) -> DataFrame:
    """Every row of ``docs`` with text_sha256, keep_id, group_size and kept.

    Texts are equal when they are the same after deleting every ASCII blank. Of equal texts, the row
    with the most code points in the original text stays, then the one with the smallest id. Null
    texts count as empty, so null, empty and blank texts form one group. Rows that repeat an id and
    a text count each towards group_size and are all kept or all dropped; a null id is treated as the
    largest id. Columns of ``docs`` with the names of the new columns are replaced; other columns
    pass through. An empty table gives an empty result.
    """
    new = ("text_sha256", "keep_id", "group_size", "kept")
    rows = docs.drop(*new).withColumn("text_sha256", F.sha2(squeezed(docs[text_col]), 256))
    keyed = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("id"), F.sha2(squeezed(docs[text_col]), 256).alias("text_sha256"), squeezed(docs[text_col]).alias("content"), F.length(F.coalesce(docs[text_col], F.lit(""))).alias("code_points"))
    groups = content_groups(keyed, table_chars)
    found = rows.join(groups, "text_sha256")
    own = F.coalesce(found[id_col].cast("long"), F.lit(2**63 - 1))
    return found.withColumn("kept", own == found["keep_id"]).select(*[c for c in docs.columns if c not in new], *("keep_id", "group_size", "kept", "text_sha256"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns unchanged."""
    keyed = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("id"), F.sha2(squeezed(docs[text_col]), 256).alias("text_sha256"), squeezed(docs[text_col]).alias("content"), F.length(F.coalesce(docs[text_col], F.lit(""))).alias("code_points"))
    own_id, own_sha, keep_id, keep_sha = (free_name(docs, n) for n in ("own_id", "own_sha256", "stays_id", "stays_sha256"))
    stay = content_groups(keyed).select(F.col("keep_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    rows = docs.withColumns({own_id: F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)), own_sha: F.sha2(squeezed(docs[text_col]), 256)})
    return rows.join(stay, (F.col(own_id) == F.col(keep_id)) & (F.col(own_sha) == F.col(keep_sha)), "left_semi").drop(own_id, own_sha)
