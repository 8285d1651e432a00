"""Labelled texts for fitting classifiers: all of them as a table, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def usable_labels(labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """_id and _label of all ids outside the held-out fold; of contradictory labels of an id the lesser counts."""
    fits = labels[label].isin(0, 1) & labels[id_col].isNotNull() & (fold(labels[id_col], modulus) != held_out)
    return labels.where(fits).select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).groupBy("_id").agg(F.min("_label").alias("_label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _label and _text (null is empty) of all rows of ``docs`` with a usable label."""
    texts = docs.where(fold(docs[id_col], modulus) != held_out).select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    return texts.join(usable_labels(labels, label, modulus, held_out, id_col).hint("merge"), "_id").select("_id", "_label", "_text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most ``most`` texts of each label from rows outside the held-out fold, and their labels.

    The rows with the least hash of their id are taken, so a sample doesn't depend on the partitioning.
    Rows without a label or an id aren't used; of contradictory labels of an id the lesser counts.
    """
    usable = usable_labels(labels, label, modulus, held_out, id_col)
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    found = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(picked), "_id").select("_id", "_label", "_text")  # 2 * most rows are sent
    rows = sorted(found.collect(), key=lambda r: (r["_id"], r["_text"] or ""))  # a bounded sample
    return [r["_text"] or "" for r in rows], [r["_label"] for r in rows]


def threshold_of(scores, labels) -> float:
    """The cut that classifies most of the given scores rightly; of equals the middle of the widest gap."""
    import numpy as np

    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores, float)[order], np.asarray(labels)[order]
    if not len(s) or y.min() == y.max():
        return 0.0
    right = np.concatenate(([y.sum()], y.sum() + np.cumsum(1 - 2 * y)))
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    best = np.flatnonzero(right == right.max())
    gaps = edges[best + 1] - edges[best]
    k = best[int(np.argmax(gaps))]
    return float((edges[k] + edges[k + 1]) / 2)
