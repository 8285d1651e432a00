"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two values of a signature, its minimum and its maximum,
so 182 evaluations give 364 values. Seven values make a band, minima and maxima in bands of their own:
at a similarity of 0.85 a pair shares one of the 52 bands but for two cases in 10^9, at 0.8 but for
five in 10^6. Candidates are first held against each other by sketches. One has the parities of the
numbers of shingles in 2048 bins; sets differ by at least as many shingles as parities, so what it
refuses is never similar enough. The other has one bit of each of the first 320 signature values, and
refuses what differs by seven standard deviations more than the threshold leads to expect. All others
are confirmed on full shingle sets.

Documents with equal shingle sets form a class, which goes on under a number of its own and is mapped to
its smallest id at the end; classes that have an id in common are linked by it. In a band's bucket each
class is first held against the most central one, whose buckets hold most classes in all; it is often
the text that others were made from, so that large groups join by a number of pairs in proportion to
their size. After that only classes of one bucket that are still in different components
are held against each other: pairs within a component can't change anything, and every other candidate
pair is confirmed or refused, so no link is lost to a group's size. Large buckets, as those of a family of
texts on one template that are alike but not enough, are dealt once more by the members' rarest shingles:
linked sets share one of so many of them, others mostly don't, and the work doesn't grow with the square.

The second sketch refuses a pair at the threshold in four cases of 10^10 at 0.85 and in one at 0.8 (the
tail of a binomial count beyond seven standard deviations); the first never does.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.llm.common import free_name, settled, width
from tallywheel.llm.components import components
from tallywheel.llm.words import mixed, portions, run_hashes, word_hashes, word_lists

PERMUTATIONS, BAND_ROWS, SHINGLE = 182, 7, 5
#: 64-bit words of the two sketches: parities of shingles by bin, and one bit of each signature value.
PARITIES, BITS = 32, 5
_BLOCK = 2048
_LARGE = _BLOCK  # members of a bucket that are held against each other as they are: one block of them
_SIG = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text's whole sequence is its only one."""
    lists = word_lists(texts, lower=True)
    flat, offsets = word_hashes(lists)
    runs, out = run_hashes(flat, width), []
    for at, words in zip(offsets.tolist(), lists, strict=False):
        n = len(words)
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64))
    return out


def factors(permutations: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(sets: list[np.ndarray], permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """One row of band hashes, and one of sketch words, for each (nonempty) set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    low = np.empty((permutations, len(sets)), np.uint64)
    high = np.empty((permutations, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(factors(permutations)):
            h = flat * a
            low[k] = np.minimum.reduceat(h, starts)
            high[k] = np.maximum.reduceat(h, starts)
        values, bands = np.concatenate((low, high)), []
        for b in range(2 * permutations // rows):
            h = np.full(len(sets), b + 1, np.uint64)
            for v in values[b * rows : (b + 1) * rows]:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + v)
            bands.append(h)
        bits = mixed(values[: 64 * BITS]) & np.uint64(1)
        words = [np.bitwise_or.reduce(bits[64 * i : 64 * i + 64] << np.arange(64, dtype=np.uint64)[:, None], axis=0) for i in range(BITS)]
    bins = 64 * PARITIES
    odd = np.stack([np.packbits((np.bincount((mixed(s) % np.uint64(bins)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).view(np.int64) for s in sets])
    return np.stack(bands, axis=1).view(np.int64), np.concatenate((odd, np.stack(words, axis=1).view(np.int64)), axis=1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, keys = b.column(0), b.column(1).to_pylist(), b.column(2)
        for part in portions(texts):
            sets = shingle_sets(texts[part])
            full = [s for s in sets if len(s)]
            bands, sketches = band_hashes(full) if full else ((), ())
            rows, words = iter(np.asarray(bands).tolist()), iter(np.asarray(sketches).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(part.start, part.stop - part.start),
                    keys.slice(part.start, part.stop - part.start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    pa.array([next(words) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                schema=_SIG,
            )


def _confirm(percent: int):
    """Pairs (a, b, text_a, text_b) that are linked; those with equal a come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b, text_a, text_b = (batch.column(i) for i in range(4))
            ids, texts, keep = a.to_pylist(), text_b.to_pylist(), []
            for part in portions(texts):
                for i, other in zip(range(part.start, part.stop), shingle_sets(texts[part]), strict=True):
                    if ids[i] != last:
                        last, (known,) = ids[i], shingle_sets([text_a[i].as_py()])
                    common = len(np.intersect1d(known, other, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(known) + len(other) - common))
            yield pa.RecordBatch.from_arrays([a, b], names=["v", "m"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough.

    A class has the text of its ``id`` and ``text_key``; an id alone can stand for texts of several classes.
    """
    needed = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = classes.select("rep", "id", "text_key").join(needed, "rep", "left_semi")
    held = settled(texts.join(wanted, ["id", "text_key"]).dropDuplicates(["rep"]).select("rep", "text"), "texts")
    one = pairs.join(held.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(held.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "v long, m long")


def _same_id(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (v, m) of classes that have an id in common: each of an id's classes with one of them."""
    several = linked.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("id", "lo")
    keys = linked.select("id", "set_key").join(several, "id").where("set_key <> lo").select("set_key", "lo").distinct()
    numbers = classes.select("set_key", "rep")
    one = keys.join(numbers.withColumnRenamed("rep", "v"), "set_key")
    return one.join(numbers.select(F.col("set_key").alias("lo"), F.col("rep").alias("m")), "lo").select("v", "m")


def _near(percent: int):
    """Condition that a pair, with columns as ``_sketched`` names them, can be similar enough."""
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    differ = [F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(PARITIES + BITS)]
    odd, bits = reduce(operator.add, differ[:PARITIES]), reduce(operator.add, differ[PARITIES:])
    few = (100 + percent) * odd <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return sizes & few & (bits <= _limits(percent))


def _sketched(side: str) -> list:
    """Number, set size and sketch words of one side of a pair; columns of their own keep the join's code small enough to be compiled."""
    return [F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), *[F.get("sketch", i).alias(f"s{i}_{side}") for i in range(PARITIES + BITS)]]


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    five-word shingles (A-Z in lower case; a text with fewer words has its whole sequence as its only
    shingle). component_id is the smallest id that links lead to, kept says that it is the own one.
    Null, empty and blank texts have an empty set and are linked with nothing; a null id is linked
    with nothing and kept. Rows that repeat an id share its component. An empty table gives no rows;
    other columns of ``docs`` are not carried.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_key"))
    signed = settled(texts.mapInArrow(_signatures, "id long, text_key long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"), "signatures")
    linked = signed.where("n_shingles > 0 AND id IS NOT NULL")
    grouped = linked.groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = settled(grouped.select("set_key", F.monotonically_increasing_id().alias("rep"), "least.id", "least.text_key", "n", "bands", "sketch"), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    shared = settled(buckets.join(sizes, "bucket"), "shared")
    central = shared.groupBy("rep").agg(F.sum("c").alias("weight"))
    shared = settled(shared.join(central, "rep").select("bucket", "rep", "weight"), "buckets")
    leads = shared.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("lead"))
    met = shared.join(leads, "bucket").where("lead <> rep").select(F.greatest("lead", "rep").alias("b"), F.least("lead", "rep").alias("a")).distinct()
    stars = settled(met.join(classes.select(*_sketched("a")), "a").join(classes.select(*_sketched("b")), "b").where(_near(percent)).select("a", "b"), "stars")
    edges = settled(_linked(stars, classes, texts, percent).unionAll(_same_id(linked, classes)), "links")
    first = components(edges)
    rest = _across(shared, classes, texts, first, stars, percent)
    more = settled(_linked(rest, classes, texts, percent), "links")
    final = components(first.unionAll(more)) if more.take(1) else first
    of = classes.select("set_key", "rep", "id").join(final, F.col("rep") == F.col("v"), "left").select("set_key", "id", F.coalesce("m", "rep").alias("m"))
    label = of.join(of.groupBy("m").agg(F.min("id").alias("component")), "m").select("set_key", "component")
    found = signed.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(label, "set_key", "left")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def _limits(percent: int) -> int:
    """Most bits in which the second sketches of linked sets may differ."""
    apart = (1 - percent / 100) / 2
    return math.ceil(64 * BITS * apart + 7 * math.sqrt(64 * BITS * apart * (1 - apart)))


def _pairs_in_blocks(percent: int):
    """Pairs of classes in different components that can be similar enough, from rows sorted by bucket, lo and hi.

    A group has the members of two blocks of a bucket (or of one block), a few thousand rows; only
    pairs that pass the sketches leave it.
    """
    most = _limits(percent)

    def near(rep, comp, block, n, sketch, lo, hi):
        left, right = (np.flatnonzero(block == k) for k in (lo, hi))
        step = max(1, (1 << 21) // (len(right) * sketch.shape[1]))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            differ = np.bitwise_count(sketch[i][:, None, :] ^ sketch[right][None, :, :])
            odd, bits = differ[:, :, :PARITIES].sum(axis=2, dtype=np.int64), differ[:, :, PARITIES:].sum(axis=2, dtype=np.int64)
            n_i, n_j = n[i][:, None], n[right][None, :]
            fit = (comp[i][:, None] != comp[right][None, :]) & (bits <= most) & ((100 + percent) * odd <= (100 - percent) * (n_i + n_j)) & (100 * np.minimum(n_i, n_j) >= percent * np.maximum(n_i, n_j))
            if lo == hi:
                fit &= rep[i][:, None] < rep[right][None, :]
            x, y = np.nonzero(fit)
            if len(x):
                u, v = rep[i[x]], rep[right[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(rows: pa.Table, whole: bool):
            nonlocal held
            rows = rows.combine_chunks()
            key = np.stack([rows[c].to_numpy() for c in ("bucket", "lo", "hi")])
            starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [rows.num_rows]))
            done = len(starts) - 1 if whole else len(starts) - 2
            held = None if whole else rows.slice(int(starts[done]))
            rep, comp, block, n = (rows[c].to_numpy() for c in ("rep", "comp", "block", "n"))
            sketch = rows["sketch"].chunk(0).flatten().to_numpy().reshape(len(rep), -1)
            for s, e in zip(starts[:done].tolist(), starts[1 : done + 1].tolist(), strict=True):
                if e - s > 1:
                    yield from near(rep[s:e], comp[s:e], block[s:e], n[s:e], sketch[s:e], key[1, s], key[2, s])

        for b in batches:
            if b.num_rows:
                new = pa.Table.from_batches([b])
                yield from groups(new if held is None else pa.concat_tables([held, new]), False)
        if held is not None and held.num_rows:
            yield from groups(held, True)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for part in portions(texts):
            sets = shingle_sets(texts[part])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rep", "tokens"])


def _prefixes(members: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """bucket (a shingle) and rep for the rarest shingles of each member, as many as two linked sets can't both avoid.

    Sets of which one has n shingles share percent * n / 100 of them at least. So with all shingles in
    one order, the rarest among the members first, linked sets share one of their first
    n - ceil(percent * n / 100) + 1. Members of a family that is alike but not linked have words of
    their own there and meet nobody.
    """
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "id", "text_key", "n")
    held = texts.join(wanted, ["id", "text_key"]).dropDuplicates(["rep"])
    tokens = settled(held.select("rep", "text").mapInArrow(_tokens, "rep long, tokens array<long>"), "tokens").select("rep", F.explode("tokens").alias("bucket"))
    shared = tokens.groupBy("bucket").agg(F.count("*").alias("df")).where("df > 1")
    met = tokens.join(shared, "bucket").join(wanted.select("rep", "n"), "rep")
    own = Window.partitionBy("rep")
    alone = F.col("n") - F.count("*").over(own)  # shingles that no other member has come first
    place = alone + F.row_number().over(own.orderBy("df", "bucket"))
    reach = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    return met.withColumn("place", place).where(F.col("place") <= reach).select("bucket", "rep")


def _across(shared: DataFrame, classes: DataFrame, texts: DataFrame, first: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of one bucket in different components that weren't tried yet.

    The members of buckets with more than ``_LARGE`` are dealt by their rarest shingles instead, which
    pair nobody who can't be linked by more than those. What is still large is dealt into blocks, and
    each pair of blocks is a group of its own.
    """
    spark = shared.sparkSession
    of = first.select(F.col("v").alias("rep"), F.col("m").alias("comp"))
    at = settled(shared.join(of, "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp")), "members")
    sizes = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    large = settled(at.join(sizes.where(F.col("c") > _LARGE).select("bucket"), "bucket").select("rep", "comp").distinct(), "large")
    at = at.join(sizes.where(F.col("c") <= _LARGE).select("bucket"), "bucket")
    if large.take(1):
        at = settled(at.unionByName(_prefixes(large, classes, texts, percent).join(large, "rep")), "members")
    mixed_up = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / F.lit(_BLOCK)).cast("int").alias("blocks")).where("lo < hi").select("bucket", "blocks")
    members = at.join(mixed_up, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = members.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "comp").join(classes.select("rep", "n", "sketch"), "rep")
    dealt = dealt.select("bucket", "lo", "hi", "block", "rep", "comp", "n", "sketch").repartition(width(spark), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    pairs = dealt.mapInArrow(_pairs_in_blocks(percent), "a long, b long").distinct()
    return settled(pairs.join(tried, ["a", "b"], "left_anti"), "across")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, columns unchanged."""
    name = free_name(docs, "gone")
    gone = near_duplicates(docs, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
