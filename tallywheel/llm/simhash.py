"""Near-duplicates by SimHash fingerprints, linked through their segments' bit counts.

A fingerprint is cut into 16 segments of four bits, and the number of set bits of each makes a point
with 16 coordinates. The Manhattan distance of two points is at most the number of bits in which the
fingerprints differ, so linked fingerprints, with two such bits or fewer, have points at a distance of two
or less. The points lie on a grid; each reaches its own cell and those one step away, 33 at most, so two
points at a distance of two or less have a cell in common, and a cell that a single fingerprint reaches
is done with.

In the other cells linked fingerprints are found exactly and without pairs. Each member of a cell names
those 64-bit values of the cell that differ from it in one bit at most. Members that name the same value
differ in two bits or fewer, and those that do so name a common one: the value halfway, whose point is
one step from both. At most 65 fingerprints name one value, so a family of thousands of near copies costs
rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm.common import settled
from tallywheel.llm.components import components

SHINGLE, SEED, SEGMENTS = 3, 42, 16
_ONES = 0x1111111111111111
_STEP = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included, A-Z in lower case; 0 without words."""
    words = (text or b"").lower().split()  # bytes know only ASCII case and blanks
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        bits = np.unpackbits(hashes[at : at + _STEP].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], names=["id", "fp"])


def _point(fp):
    """Bit counts of the 16 segments, four bits each in one number: at most 4, so sums never carry."""
    ones = F.lit(_ONES)
    return sum((F.shiftrightunsigned(fp, i).bitwiseAND(ones) for i in range(1, 4)), fp.bitwiseAND(ones))


def _met(fingerprints: DataFrame) -> DataFrame:
    """fp, cell and point for each cell that a fingerprint shares with another one."""
    steps = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("by")), *[F.struct(F.lit(4 * s).alias("s"), F.lit(by).alias("by")) for s in range(SEGMENTS) for by in (-1, 1)]))
    points = fingerprints.select("fp", _point(F.col("fp")).alias("point"), steps.alias("to")).select("fp", "point", "to.s", "to.by")
    set_bits = F.expr("shiftrightunsigned(point, s) & 15")
    reached = points.where((F.col("by") == 0) | ((F.col("by") < 0) & (set_bits > 0)) | ((F.col("by") > 0) & (set_bits < 4))).selectExpr("fp", "point + by * shiftleft(1L, s) AS cell")
    crowded = reached.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1").select("cell")
    return reached.join(crowded.hint("merge"), "cell").select("fp", "cell", _point(F.col("fp")).alias("point"))


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (v, m) whose links join what two differing bits or fewer join, from distinct ``fp``.

    The joins here and of the components are told to merge: estimates of size come from the files and know
    nothing of the 33 cells of a row, so that cells were broadcast through the driver.
    """
    met = _met(fingerprints)
    # a cell one step away differs in one segment: four bits, of which those that are clear (or set) lead there
    segment = "sequence(bit_count(abs(cell - point) - 1), bit_count(abs(cell - point) - 1) + 3)"
    flipped = f"filter(transform({segment}, i -> shiftleft(1L, i)), b -> (fp & b <> 0) = (cell < point))"
    values = settled(met.select("fp", F.explode(F.expr(f"CASE WHEN cell = point THEN array(fp) ELSE transform({flipped}, b -> fp ^ b) END")).alias("value")), "values")
    shared = values.groupBy("value").agg(F.min("fp").alias("m"), F.max("fp").alias("hi")).where("m < hi").select("value", "m")
    found = values.join(shared.hint("merge"), "value").where("fp <> m").select(F.col("fp").alias("v"), "m").distinct()
    return found.where(F.bit_count(F.col("v").bitwiseXOR(F.col("m"))) <= 2)


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept and group_size for every row of ``docs``.

    Two rows are linked if their fingerprints differ in two bits or fewer. component_id is the smallest id
    that links lead to, group_size the number of rows there, kept says that it is the own one.

    Null, empty and blank texts have fingerprint zero and are linked like any other; a text of fewer than
    three words has its whole sequence as its only shingle. Links are between fingerprints: rows that
    repeat an id are rows of their own, a row with a null id links as others do, and its component is
    null only if no row there has an id (kept is then true). An empty table gives no rows; other columns
    of ``docs`` are not carried.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    marked = settled(texts.mapInArrow(_fingerprints, "id long, fp long"), "fingerprints")
    classes = settled(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    joined = components(links(classes.select("fp")))
    of = classes.join(joined.hint("merge"), F.col("fp") == F.col("v"), "left").select("fp", "least", "n", F.coalesce("m", "fp").alias("m"))
    label = of.groupBy("m").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    found = marked.join(of.select("fp", "m").join(label.hint("merge"), "m").hint("merge"), "fp")
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull()).alias("kept"), "group_size")
