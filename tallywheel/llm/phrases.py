"""Phrase collocations by hierarchical pair naming.

Words that occur often enough get a number, one for each language and word. A phrase of k words is then
a pair: the phrases of k - 1 words that start at its first and at its second word. Only where both have a
number can it be often enough itself; such pairs are counted over all texts and those that pass get a
number in turn, by a join of the whole corpus, and take the place of the numbers below. The two numbers
of a pair are its parents: its beginnings and ends, and so the counts of both parts at every cut, follow
from theirs by one lookup a level, and a phrase lies inside a longer one exactly if it is a parent of it
or of one between them, which is at least as frequent.

The corpus goes along as blocks of about two million words. A block holds its sequence with numbers of
its own, and a list of what they stand for with a count of each, so that what is shuffled is one row for
a block and distinct phrase, once for each level: a phrase has no more rows than there are blocks, which
are summed where they meet and carry the lowest of their places as its number from then on. Those that
proved frequent return to their blocks, which are rewritten a level higher; what can't be part of a longer
phrase shrinks to one separator. Pairs are dealt to buckets by a hash of both parts, so that no part's pairs
meet in one task; they and the numbers of frequent ones travel packed, a row for each block and bucket or
task. What a level needed is removed when the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.llm.common import removed, settled_at, width
from tallywheel.llm.words import mixed

#: A piece ends at one of these characters; the other blanks separate words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_END = bytes.maketrans(PIECE_ENDS, b"\n" * len(PIECE_ENDS))
_END = b"\xff"  # a byte that no UTF-8 text has
BLOCK_WORDS = 1 << 21
#: A place is a block's number followed by so many bits for an entry of its list; a block's number is a task's followed by so many for its blocks.
_LOCAL, _OWN = 28, 12

#: Numbers that a task packs at once.
_HELD = 1 << 22

_WORDS = pa.schema([("at", pa.int64()), ("seq", pa.binary()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
_PAIRS = pa.schema([("at", pa.int64()), ("seq", pa.binary()), ("bucket", pa.int64()), ("pairs", pa.binary())])
_NUMBERS = pa.schema([("of", pa.int64()), ("numbers", pa.binary())])
_FREQUENT = pa.schema([*_NUMBERS, ("id", pa.int64()), ("a", pa.int64()), ("left", pa.int64()), ("right", pa.int64())])
_WORDS_DDL = "at long, seq binary, lang string, word binary, n long"
_PAIRS_DDL = "at long, seq binary, bucket long, pairs binary"
_NUMBERS_DDL = "of long, numbers binary"
_FREQUENT_DDL = "of long, numbers binary, id long, a long, left long, right long"


class _Numbers(dict):
    """Numbers of one language's words in a block; all languages of a block draw from one list."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        self.lang, self.names = lang, names
        self[_END] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.names)
        self.names.append((self.lang, word))
        return k


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with a mark where a piece ends."""
    return (text or b"").lower().translate(_TO_END).replace(b"\n", b" " + _END + b" ").split()


def _packed(seq: np.ndarray, kind: type = np.int32) -> bytes:
    """A sequence byte by byte: all lowest bytes, then the next ones; early numbers are the frequent words', so the upper ones are mostly alike."""
    planes = np.ascontiguousarray(seq.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(seq: bytes, kind: type = np.int32) -> np.ndarray:
    planes = pa.decompress(seq[8:], decompressed_size=int.from_bytes(seq[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _columns(rising: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of equal length as one sequence, the first one by its steps."""
    return _packed(np.concatenate((np.diff(rising, prepend=0), *others)), np.int64)


def _of_columns(data: bytes, n: int) -> list[np.ndarray]:
    rising, *others = _unpacked(data, np.int64).reshape(n, -1)
    return [np.cumsum(rising), *others]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where one of the columns differs from the row before, the first included; there must be a row."""
    return np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1))


def _rows(schema: pa.Schema, block: int, seq: np.ndarray, places: np.ndarray, listed: list[pa.Array], entries: int) -> pa.Table:
    """A block's list, entries at their places, and one row with its sequence."""
    if entries >> _LOCAL or block >> 63 - _LOCAL:
        raise ValueError(f"no places for {entries} distinct phrases in block {block}")
    rows = [pa.array((block << _LOCAL) + places), pa.nulls(len(places), pa.binary()), *listed]
    own = [pa.array([block << _LOCAL], pa.int64()), pa.array([_packed(seq)], pa.binary()), *[pa.nulls(1, f.type) for f in list(schema)[2:]]]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=schema) for x in (rows, own)])


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names, by_lang, held, n = TaskContext.get().partitionId() << _OWN, [], {}, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            seq = np.concatenate(held)
            listed = [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.binary()), pa.array(np.bincount(seq[seq >= 0], minlength=len(names)).astype(np.int64))]
            yield from _rows(_WORDS, number, seq, np.arange(len(names)), listed, len(names)).to_batches()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = tokens(text.as_py())
                if lang not in by_lang:
                    by_lang[lang] = _Numbers(lang, names)
                held.append(np.fromiter(map(by_lang[lang].__getitem__, words), np.int32, len(words)))
                held.append(np.array([-1], np.int32))
                n += len(words)
                if n >= most:
                    yield from block()
                    number, names, by_lang, held, n = number + 1, [], {}, [], 0
        if n:
            yield from block()

    return run


def _by_block(at: np.ndarray, number: np.ndarray) -> list[pa.Array]:
    """Places and numbers of frequent entries, packed for each of their blocks."""
    order = np.argsort(at)
    at, number = at[order], number[order]
    starts = _starts(at >> _LOCAL)
    ends = np.append(starts[1:], len(at))
    packed = [_columns(at[i:j] & ((1 << _LOCAL) - 1), number[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [pa.array(at[starts] >> _LOCAL), pa.array(packed, pa.binary())]


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at and id of frequent entries as one row for each of their blocks."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_by_block(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))), schema=_NUMBERS)

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= _HELD:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def _raised(buckets: int):
    """A block one level higher: its pairs of neighbours that are both frequent, from its sequence and the numbers of the frequent entries of its list."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        seq = _unpacked(left["seq"][0].as_py())
        local, known = (np.concatenate(x) for x in zip(*[_of_columns(x.as_py(), 2) for x in right["numbers"]], strict=True))
        number = np.full(max(int(seq.max()), int(local.max())) + 1, -1, np.int64)
        number[local] = known
        seq = np.where((seq >= 0) & (number[seq] >= 0), seq, -1).astype(np.int64)
        at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
        if not len(at):
            return _PAIRS.empty_table()
        pairs, inverse, n = np.unique(seq[at] << 32 | seq[at + 1], return_inverse=True, return_counts=True)
        first, rest = number[pairs >> 32], number[pairs & 0xFFFFFFFF]
        with np.errstate(over="ignore"):
            bucket = (mixed(mixed(first.view(np.uint64)) + rest.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((first, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        above = np.full(len(seq), -1, np.int64)
        above[at] = place[inverse]
        above = above[(above >= 0) | np.concatenate(([False], above[:-1] >= 0))]
        first, rest, bucket, n = first[order], rest[order], bucket[order], n[order]
        starts = _starts(bucket)
        ends = np.append(starts[1:], len(order))
        listed = [pa.array(bucket[starts]), pa.array([_columns(first[i:j], rest[i:j], n[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())]
        return _rows(_PAIRS, left["block"][0].as_py(), above, starts, listed, len(order))

    return run


def _summed(min_count: int):
    """The frequent pairs of a bucket, from the lists of all blocks: one row for each pair, and one with all numbers for each block.

    An entry's place is its list's and its place there; the lowest one is the pair's number.
    """

    def run(lists: pa.Table) -> pa.Table:
        columns = [_of_columns(x.as_py(), 3) for x in lists["pairs"]]
        left, right, n = (np.concatenate(x) for x in zip(*columns, strict=True))
        at = np.concatenate([start + np.arange(len(x[0])) for start, x in zip(lists["at"].to_pylist(), columns, strict=True)])
        order = np.lexsort((at, right, left))
        left, right, n, at = left[order], right[order], n[order], at[order]
        starts = _starts(left, right)
        size, a = np.diff(np.append(starts, len(at))), np.add.reduceat(n, starts)
        often = np.repeat(a >= min_count, size)
        if not often.any():
            return _FREQUENT.empty_table()
        own, kept = starts[a >= min_count], a[a >= min_count]
        phrases = [pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary()), *map(pa.array, (at[own], kept, left[own], right[own]))]
        packed = _by_block(at[often], np.repeat(at[starts], size)[often])
        numbers = [*packed, *[pa.nulls(len(packed[0]), pa.int64())] * 4]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=_FREQUENT) for x in (phrases, numbers)])

    return run


def _frequent(listed: DataFrame, keys: list[str], min_count: int, k: int) -> tuple[DataFrame, str]:
    """at, id and a of all entries that stand for a word with ``min_count`` or more occurrences in all blocks, and their folder.

    The entries of a word meet, at most one a block; the one whose place is the number keeps the keys.
    """
    same = Window.partitionBy(*keys)
    summed = listed.select("at", *keys, F.sum("n").over(same).alias("a"), F.min("at").over(same).alias("id")).where(F.col("a") >= min_count)
    return settled_at(summed.select("at", "id", "a", *[F.when(F.col("at") == F.col("id"), F.col(c)).alias(c) for c in keys]), f"frequent{k}")


def _frequent_pairs(rows: DataFrame, min_count: int, k: int) -> tuple[DataFrame, str]:
    """The frequent pairs of all blocks and their numbers, and their folder; one bucket of pairs is in memory at a time."""
    lists = rows.where("pairs IS NOT NULL").select("at", "bucket", "pairs")
    return settled_at(lists.groupBy("bucket").applyInArrow(_summed(min_count), _FREQUENT_DDL), f"frequent{k}")


def _next(rows: DataFrame, numbers: DataFrame, k: int) -> tuple[DataFrame, str]:
    """All blocks one level higher, where pairs stand for phrases of k words, and the folder they lie in."""
    seqs = rows.where("seq IS NOT NULL").select(F.shiftright("at", _LOCAL).alias("block"), "seq")
    buckets = 2 * width(rows.sparkSession)
    return settled_at(seqs.groupBy("block").cogroup(numbers.groupBy("of")).applyInArrow(_raised(buckets), _PAIRS_DDL), f"phrases{k}")


def _named(frequent: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """The frequent phrases of k words with numbers and parents; ``heads`` and ``tails`` count their beginnings and ends of 1 to k words."""
    counted = frequent.where("id IS NOT NULL").select("id", "left", "right", "a")
    first = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), F.col("heads").alias("over"))
    rest = below.select(F.col("id").alias("right"), "last", F.col("tails").alias("under"))
    both = counted.join(first, "left").join(rest, "right")
    own = F.array("a")
    return settled_at(both.select("id", "left", "right", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "last", "a", F.concat("over", own).alias("heads"), F.concat("under", own).alias("tails"), F.lit(k).alias("k")), f"named{k}")[0]


def _cut(k: int, scale: int):
    """The lowest score over all cuts of a phrase of k words, with the cut's place and both counts; of equal ones the first."""
    score = "CAST({} AS decimal(20,0)) * a div (CAST(heads[{}] AS decimal(20,0)) + tails[{}])"  # exact: decimals of 38 digits
    cuts = [F.struct(F.expr(score.format(scale, j - 1, k - j - 1)).alias("score"), F.lit(j).alias("cut"), F.get("heads", F.lit(j - 1)).alias("l"), F.get("tails", F.lit(k - j - 1)).alias("r")) for j in range(1, k)]
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, percent: int = 80, top: int = 2000, scale: int = 2_000_000, lang_col: str = "lang", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, words and cut.

    Texts are split at ``. , ; : ! ?`` and line ends into pieces and these at spaces and tabs into words,
    with A-Z in lower case. Phrases have 2 to ``max_words`` words of one piece and occur ``min_count``
    times or more (a, overlaps included). A cut divides a phrase into two parts that occur l and r times;
    the cut with the lowest floor(scale * a / (l + r)) counts, of equal ones the first. A phrase inside a
    longer one that is ``percent`` as frequent is left out. n counts all words of the language.

    A null or empty text has no words, a null language is ``und``; a language without a phrase has no
    row, and an empty table gives none. Equal rows count each time. Other columns aren't carried.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("binary").alias("text"))
    spark = docs.sparkSession
    rows, folder = settled_at(texts.mapInArrow(_blocks(block_words), _WORDS_DDL), "words")
    listed = rows.where("n IS NOT NULL")
    totals = settled_at(listed.groupBy("lang").agg(F.sum("n").alias("n")), "totals")[0]
    frequent, used = _frequent(listed, ["lang", "word"], min_count, 1)
    text, own = F.col("word").cast("string"), F.array("a")
    level = settled_at(frequent.where("at = id").select("id", "lang", text.alias("phrase"), text.alias("last"), "a", own.alias("heads"), own.alias("tails")), "named1")[0]
    numbers = frequent.select("at", "id").mapInArrow(_bundled, _NUMBERS_DDL)
    found = []
    for k in range(2, max_words + 1):
        rows, above = _next(rows, numbers, k)
        for folder in (folder, used):
            removed(spark, folder)
        frequent, used = _frequent_pairs(rows, min_count, k)
        numbers = frequent.where("numbers IS NOT NULL").select("of", "numbers")
        level, folder = _named(frequent, level, k), above
        found.append(level)
    for folder in (folder, used):
        removed(spark, folder)
    kept = []
    for k, phrases in enumerate(found, 2):
        if k < max_words:
            longer = found[k - 1]
            within = longer.select(F.col("left").alias("id"), F.col("a").alias("most")).unionAll(longer.select(F.col("right").alias("id"), F.col("a").alias("most"))).groupBy("id").agg(F.max("most").alias("most"))
            phrases = phrases.join(within, "id", "left").where(f"most IS NULL OR CAST(most AS decimal(20,0)) * 100 < CAST(a AS decimal(20,0)) * {int(percent)}")
        kept.append(phrases.select("lang", "phrase", "a", "k", _cut(k, scale).alias("at")))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionAll(more)
    every = every.select("lang", "phrase", "a", F.col("k").alias("words"), "at.score", "at.cut", "at.l", "at.r")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(width(spark)))
    dealt = every.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("place") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "cut")
