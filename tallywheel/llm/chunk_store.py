"""Content-addressed store for token ids.

A document's id stream is cut where a rolling hash over the last sixteen ids says so, so the same
passage is cut alike wherever it stands. A chunk is named by the SHA-256 of its ids (little-endian
unsigned 32-bit) and stored once. A store is a folder:

    data/kind=chunk/   digest, n_ids, payload: the ids as zstd-compressed 16-bit or 32-bit integers
    recipes/           number, doc_id, start, n_tokens, digests, root; files and rows in ascending doc_id order
    manifest/          level, number, start, documents, ids, root: Merkle nodes over 65536 nodes below, up to one

A document's root is the Merkle root over the digests of its chunks. Level 1 of the manifest has a node for
each 65536 documents in a row, level 2 one for each 65536 nodes of level 1, and so on; the last root names
the store. It depends on the documents alone, not on how they were dealt out. Readers recompute every level
from the recipes, every document's root and every chunk's digest, so what is lost or altered is found.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywheel.llm.common import removed, scratch, width
from tallywheel.llm.encoder import default_tokenizer, encoder

MIN_IDS, CUT_BITS, MAX_IDS = 128, 9, 2048
_BLOCK = 1 << 16
_STAGE = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("digest", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("digests", pa.binary())])
_STAGE_DDL = "kind string, bucket long, digest binary, n_ids int, payload binary, doc_id long, digests binary"
_LOCAL_DDL = "part int, row long, before long, doc_id long, n_tokens long, digests binary, root binary"
_LOCAL = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("root", pa.binary())])
_NODE_DDL = "number long, start long, documents long, ids long, root binary"
_NODE = pa.schema([("number", pa.int64()), ("start", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())])
FAN = 65536


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over 32-byte leaves; an odd last node moves up unchanged, no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the hash over the last sixteen ids starts with zero bits.

    Sums of products over 2, 4, 8 and at last 16 ids, in blocks that stay in the processor's cache.
    """
    found = []
    for at in range(0, len(ids), _BLOCK):
        begin = max(0, at - 15)
        h = (ids[begin : at + _BLOCK] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        factor = 0x85EBCA6B
        for step in (1, 2, 4, 8):
            if len(h) > step:
                h[step:] += h[:-step] * np.uint32(factor)
            factor = factor * factor % 2**32
        found.append(np.flatnonzero(h[at - begin :] < 1 << 32 - CUT_BITS) + at + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _ends(marks: list[int], at: int, stop: int) -> list[int]:
    """Ends of the chunks between two places. The first sixteen ids decide nothing, as a chunk has MIN_IDS at least."""
    ends = []
    for m in marks:
        while m - at > MAX_IDS:
            at += MAX_IDS
            ends.append(at)
        if m - at >= MIN_IDS:
            at = m
            ends.append(at)
    while stop - at > MAX_IDS:
        at += MAX_IDS
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return _ends(_marks(ids).tolist(), 0, len(ids))


def pack_ids(raw) -> bytes:
    """Ids (little-endian unsigned 32-bit) as a width byte and zstd-compressed integers of that width."""
    ids = np.frombuffer(raw, "<u4")
    narrow = ids.astype("<u2")
    return _packed(narrow.data if (narrow == ids).all() else None, raw)


def _packed(narrow, raw) -> bytes:
    return b"\x04" + _zip().compress(raw) if narrow is None else b"\x02" + _zip().compress(narrow)


def unpack_ids(payload: bytes) -> bytes:
    raw = zstandard.ZstdDecompressor().decompress(payload[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if payload[0] == 2 else raw


@functools.cache
def _zip():
    return zstandard.ZstdCompressor(level=1, write_checksum=False)


def _chunked(path: str, end_id: int, remembered: int = 200_000):
    """Recipes of all documents, and each chunk that the task has not sent yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, last, ids, offsets in encoder(path).encode(b.column(1), end_id):
                rows, bounds = [], offsets.tolist()
                raw, marks = memoryview(ids.astype("<u4")).cast("B"), _marks(ids)
                narrow = memoryview(ids.astype("<u2")).cast("B") if not len(ids) or ids.max() < 65536 else None
                spots = np.searchsorted(marks, offsets, side="right").tolist()
                for k, doc_id in enumerate(doc_ids[first:last]):
                    begin, end = bounds[k], bounds[k + 1]
                    at, named = begin, []
                    for stop in _ends(marks[spots[k] : spots[k + 1]].tolist(), begin, end):
                        part = raw[4 * at : 4 * stop]
                        digest = hashlib.sha256(part).digest()
                        named.append(digest)
                        if digest not in sent:
                            if len(sent) >= remembered:
                                sent.clear()
                            sent.add(digest)
                            rows.append(("chunk", int.from_bytes(digest[:8], "little", signed=True), digest, stop - at, pack_ids(part) if narrow is None else _packed(narrow[2 * at : 2 * stop], part), None, None))
                        at = stop
                    own = int.from_bytes(hashlib.blake2b(b"%d" % (doc_id or 0), digest_size=8).digest(), "little", signed=True)
                    rows.append(("recipe", own, None, end - begin, None, doc_id, b"".join(named)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STAGE, strict=True)], schema=_STAGE)

    return run


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes with their Merkle root, their row within the task, and the ids before them in it."""
    part, row, before = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        rows = []
        for doc_id, n, digests in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            rows.append((part, row, before, doc_id, n, digests, merkle_root([digests[i : i + 32] for i in range(0, len(digests), 32)])))
            row, before = row + 1, before + n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LOCAL, strict=True)], schema=_LOCAL)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merkle nodes over FAN nodes below; a task gets the nodes of a parent together and in order."""
    parent, start, documents, ids, roots = None, 0, 0, 0, []

    def node():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((parent, start, documents, ids, merkle_root(roots)), _NODE, strict=True)], schema=_NODE)

    for b in batches:
        for number, at, docs, n, root in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in _NODE.names), strict=True):
            if number // FAN != parent:
                if roots:
                    yield node()
                parent, start, documents, ids, roots = number // FAN, at, 0, 0, []
            if number != parent * FAN + len(roots) or at != start + ids:
                raise ValueError(f"the store is incomplete or altered before node {number}")
            documents, ids = documents + docs, ids + n
            roots.append(root)
    if roots:
        yield node()


def _nodes(recipes: DataFrame) -> DataFrame:
    return recipes.select("number", "start", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("ids"), "root")


def _above(nodes: DataFrame, count: int) -> DataFrame:
    """The Merkle nodes one level up from so many: each over FAN at most, so that no task holds more roots than that of one parent."""
    parent = F.floor(F.col("number") / FAN)
    return nodes.repartition(max(1, min(width(nodes.sparkSession), -(-count // FAN))), parent).sortWithinPartitions("number").mapInArrow(_folded, _NODE_DDL)


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None) -> str:
    """Encode every text of ``docs``, append ``end_id`` to each, and write a store at ``path``.

    Null and empty texts have the end id only. A repeated doc_id gives a recipe for each of its rows
    (ordered by length and content), a null doc_id comes first; columns besides the two are ignored.
    An empty table gives a store without rows. The root of the store is returned.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    staged = texts.mapInArrow(_chunked(tokenizer or default_tokenizer(), end_id), _STAGE_DDL)
    # A bucket is eight bytes of the digest; of equal chunks, which follow one another in it, the first stays.
    before = F.lag("digest").over(Window.partitionBy("kind", "bucket").orderBy("digest"))
    once = staged.repartition(width(spark), "bucket").withColumn("before", before).where("kind = 'recipe' OR before IS NULL OR before <> digest")
    once.drop("bucket", "before").write.partitionBy("kind").option("compression", "none").parquet(f"{path}/data")
    stored = spark.read.schema(_STAGE_DDL).parquet(f"{path}/data")
    recipes = stored.where("kind = 'recipe'").select("doc_id", F.col("n_ids").cast("long").alias("n_tokens"), "digests")
    order = ("doc_id", "n_tokens", "digests")
    local = f"{path}/_local"
    recipes.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).mapInArrow(_rooted, _LOCAL_DDL).write.parquet(local)
    read = spark.read.schema(_LOCAL_DDL).parquet(local)
    totals = sorted(tuple(r) for r in read.groupBy("part").agg(F.count("*"), F.sum("n_tokens")).collect())  # one row for each task
    documents = ids = 0
    rows = []
    for part, n, size in totals:
        rows.append((part, documents, ids))
        documents, ids = documents + n, ids + size
    parts = spark.createDataFrame(rows, "part int, rows_before long, ids_before long")
    numbered = read.join(F.broadcast(parts), "part").select((F.col("rows_before") + F.col("row")).alias("number"), "doc_id", (F.col("ids_before") + F.col("before")).alias("start"), "n_tokens", "digests", "root")
    numbered.repartitionByRange(width(spark), "number").sortWithinPartitions("number").write.parquet(f"{path}/recipes")
    removed(spark, local)
    removed(spark, f"{path}/data/kind=recipe")
    nodes, level, left = _nodes(spark.read.parquet(f"{path}/recipes")), 0, documents
    while not level or left > 1:
        above = _above(nodes, left)
        level, left = level + 1, -(-left // FAN)
        above.withColumn("level", F.lit(level)).write.mode("append").parquet(f"{path}/manifest")
        nodes = _manifest(spark, path).where(F.col("level") == level)
    top = nodes.select("root").head(1)
    return (top[0][0] if top else merkle_root([])).hex()


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODE_DDL + ", level int").parquet(f"{path}/manifest")


def verify_store(spark: SparkSession, path: str, root: str | None = None) -> None:
    """Raise ValueError unless the manifest follows from the recipes, level by level, and ends in ``root`` if given.

    This finds recipes and nodes that are lost, added, altered or out of place. Chunks and the roots
    of documents are checked where they are read.
    """
    said = _manifest(spark, path)
    sizes = {r["level"]: (r["n"], r["d"]) for r in said.groupBy("level").agg(F.count("*").alias("n"), F.sum("documents").alias("d")).collect()}  # one row for each level
    nodes, level, left = _nodes(spark.read.parquet(f"{path}/recipes")), 0, sizes.get(1, (0, 0))[1]
    while level < max(sizes, default=1):
        level += 1
        at = said.where(F.col("level") == level).drop("level")
        both = _above(nodes, left).withColumn("side", F.lit(1)).unionAll(at.withColumn("side", F.lit(-1)))
        if both.groupBy(*at.columns).agg(F.sum("side").alias("side")).where("side <> 0").head(1):
            raise ValueError(f"the store at {path} differs from its manifest")
        nodes, left = at, sizes.get(level, (0, 0))[0]
    tops = nodes.select("root").head(2)
    if len(tops) > 1 or root and root != (tops[0][0] if tops else merkle_root([])).hex():
        raise ValueError(f"the store at {path} hasn't the root that was asked for")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, ns, crcs = b.column(0).to_pylist(), [], []
        for digest, payload in zip(digests, b.column(1).to_pylist(), strict=True):
            raw = unpack_ids(payload)
            if hashlib.sha256(raw).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            ns.append(len(raw) // 4)
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ns, pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "n_ids", "crc"])


@functools.cache
def _shift(n_bytes: int) -> tuple[int, ...]:
    """The linear map that appending so many zero bytes applies to a CRC-32, as 32 columns."""
    columns = []
    zero = zlib.crc32(b"\0" * n_bytes, 0)
    for bit in range(32):
        columns.append(zlib.crc32(b"\0" * n_bytes, 1 << bit) ^ zero)
    return tuple(columns)


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two strings one after the other, from the CRC-32 of each."""
    out, columns, bit = second, _shift(second_bytes), 0
    while first:
        if first & 1:
            out ^= columns[bit]
        first >>= 1
        bit += 1
    return out


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, start, n_tokens, root, chunks in zip(*(c.to_pylist() for c in b.columns), strict=True):
            chunks.sort(key=lambda c: c["pos"])
            crc = n = 0
            for c in chunks:
                if c["crc"] is None:
                    raise ValueError(f"a chunk of document {doc_id} is missing")
                crc = joined_crc(crc, c["crc"], 4 * c["n_ids"])
                n += c["n_ids"]
            if n != n_tokens or merkle_root([c["digest"] for c in chunks]) != root:
                raise ValueError(f"document {doc_id} differs from its manifest")
            out.append((doc_id, start, n, crc))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _links(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    numbers = F.sequence(F.lit(0), (F.length("digests") / 32).cast("int") - 1)
    return recipes.select("number", "doc_id", "start", "n_tokens", "root", "digests", F.explode(numbers).alias("pos")).withColumn("digest", F.expr("substring(digests, 32 * pos + 1, 32)")).drop("digests")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STAGE_DDL).parquet(f"{path}/data").where("kind = 'chunk'").select("digest", "payload")


def read_documents(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store, from its files.

    The recipes are held against the manifest (and ``root``, if given) first. Every chunk is read, unpacked
    and checked once; a document's figures are put together from its chunks' (a CRC-32 of joined strings
    follows from those of the parts), so shared payloads are not sent to each document that holds them.
    A lost or altered chunk, recipe or node raises.
    """
    verify_store(spark, path, root)
    facts = _chunks(spark, path).mapInArrow(_facts, "digest binary, n_ids int, crc long")
    joined = _links(spark, path).join(facts, "digest", "left")
    grouped = joined.groupBy("number").agg(*(F.first(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root")), F.collect_list(F.struct("pos", "digest", "n_ids", "crc")).alias("chunks"))
    return grouped.drop("number").mapInArrow(_assembled, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _whole(doc_id: int | None, chunks: list[dict]) -> np.ndarray:
    """The ids of a document from its chunks, each held against its digest."""
    parts = []
    for c in sorted(chunks, key=lambda c: c["pos"]):
        if c["payload"] is None:
            raise ValueError(f"a chunk of document {doc_id} is missing")
        raw = unpack_ids(c["payload"])
        if hashlib.sha256(raw).digest() != c["digest"]:
            raise ValueError(f"chunk {c['digest'].hex()} of document {doc_id} is damaged")
        parts.append(raw)
    return np.frombuffer(b"".join(parts), "<u4")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [_whole(i, chunks) for i, chunks in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "start", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of every document of a store, after the same check of its recipes; a lost or altered chunk raises."""
    verify_store(spark, path)
    links = _links(spark, path).join(_chunks(spark, path), "digest", "left")
    grouped = links.groupBy("number").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.collect_list(F.struct("pos", "digest", "payload")).alias("chunks"))
    return grouped.drop("number").mapInArrow(_restored, "doc_id long, start long, ids array<long>")


def store_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write a store in the shared folder and return what ``read_documents`` finds in it."""
    path = scratch(docs.sparkSession, "store")
    root = write_store(docs, path, **options)
    return read_documents(docs.sparkSession, path, root)
