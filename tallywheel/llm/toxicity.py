"""Toxicity by a convolutional text classifier, trained in numpy on all labelled rows.

A word is the sum of two rows of a hashed embedding table, one for the word and one for its first four
characters, so that forms of a known word are met too. Filters one, two and three words wide run over the
whole text, each filter's largest response is kept, and a logistic layer turns these into a score.
What few training texts hold shares one row, so that a text's rare words can't be learnt by heart.
Each language gets a threshold of its own on held-back training rows. The language is guessed from
function words in the text; the scale of a language is shifted so that its threshold lies at 0.7.

Training is iterative parameter mixing: rows are dealt by id to shares of some thousands. In each round
every share goes over its rows once, from the same network, and the mean of what the shares changed is
the next network; a row of the table counts for those shares only that met it. What a round brings to
the driver is one network. Words are counted in all texts, and thresholds stand on all held-back rows, by
counts of scores.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm.common import removed, settled_at
from tallywheel.llm.labelled import labelled_rows
from tallywheel.llm.words import portions

WIDTHS = (1, 2, 3)
_PAD, _RARE = 0, 1
#: Frequent function words of each language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that was for it with as on be at by this are",
    "fr": "le la les de des et un une que qui est pour dans du sur par au en",
    "de": "der die das und in zu den von mit sich des auf für ist nicht als auch ein",
    "es": "el la los de que en un una por con se del las para su al lo como",
}
_LANGS = tuple(FUNCTION_WORDS)
_CLEAN = bytes(range(128)).lower() + bytes(range(128, 256))
_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in _CLEAN)


def plain_words(texts: list[str | None]) -> list[list[bytes]]:
    """Words in lower case without ASCII punctuation."""
    return [(t or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split() for t in texts]


class _Codes(dict):
    """Words to packed codes: row of the word, row of its beginning, and languages it is a function word of."""

    def __init__(self, known: np.ndarray, buckets: int):
        super().__init__()
        self.known, self.buckets = frozenset(known.tolist()), buckets
        self.marks: dict[bytes, int] = {}
        for i, words in enumerate(FUNCTION_WORDS.values()):
            for w in words.split():
                self.marks[w.encode()] = self.marks.get(w.encode(), 0) | 1 << i

    def row(self, h: int) -> int:
        return h % (self.buckets - 2) + 2 if h in self.known else _RARE

    def __missing__(self, word: bytes) -> int:
        whole, start = word_keys(word)
        self[word] = code = self.row(whole) | self.row(start) << 24 | self.marks.get(word, 0) << 48
        return code


def word_keys(word: bytes) -> tuple[int, int]:
    """Hashes of a word and of its first four characters."""
    return xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word.decode("utf-8", "surrogatepass")[:4].encode("utf-8", "surrogatepass"), seed=1)


def languages(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the language with most function words in it; the first of equals."""
    counts = []
    for i in range(len(_LANGS)):
        hit = np.concatenate(([0], np.cumsum((codes >> (48 + i)) & 1)))
        counts.append(hit[offsets[1:]] - hit[offsets[:-1]])
    return np.argmax(np.stack(counts), axis=0)


@dataclass
class Network:
    table: np.ndarray  # buckets x size
    filters: dict[int, np.ndarray]  # width: (width, size, filters)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    known: np.ndarray  # sorted hashes of words with a row of their own
    shifts: np.ndarray  # by language

    def codes(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words one after the other, and the offset of each text (one more at the end)."""
        seen = self.__dict__.get("_seen")
        if seen is None or len(seen) > 500_000:
            seen = self.__dict__["_seen"] = _Codes(self.known, len(self.table))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        return np.fromiter(map(seen.__getitem__, itertools.chain.from_iterable(lists)), np.int64, int(offsets[-1])), offsets

    def rows(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all words (of the word, of its beginning) with padding after each text, and where each text starts.

        A filter starts at a word or at the first place after the last; what it covers then is the text's own or padding.
        """
        gap, n = max(WIDTHS) + 1, len(offsets) - 1
        out = np.full((len(codes) + gap * n, 2), _PAD, np.int32)
        at = np.arange(len(codes)) + gap * np.repeat(np.arange(n), np.diff(offsets))
        out[at, 0], out[at, 1] = codes & 0xFFFFFF, (codes >> 24) & 0xFFFFFF
        return out, offsets[:-1] + gap * np.arange(n)

    def responses(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        out = {}
        for w in WIDTHS:
            n = len(rows) - w + 1
            y = x[:n] @ self.filters[w][0]
            for k in range(1, w):
                y += x[k : n + k] @ self.filters[w][k]
            out[w] = y + self.biases[w]
        return out

    def logits(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, starts = self.rows(codes, offsets)
        if not len(starts):
            return np.empty(0, np.float32)
        bounds = np.stack((starts, starts + np.diff(offsets) + 1), axis=1).ravel()  # every other stretch lies between two texts
        pooled = [np.maximum(np.maximum.reduceat(r, bounds, axis=0)[::2], 0) for r in self.responses(rows).values()]
        return np.concatenate(pooled, axis=1) @ self.out + self.out_bias


class _Adam:
    def __init__(self, *shapes, rate=0.01):
        self.m, self.v, self.t, self.rate = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes], 0, rate

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Fit:
    """A network with the state of its optimiser."""

    def __init__(self, net: Network):
        self.net = net
        self.bias, self.moments = np.array([net.out_bias], np.float32), np.zeros(net.table.shape, np.float32)
        self.dense = _Adam(*[x.shape for x in self.weights()])

    def weights(self) -> list[np.ndarray]:
        return [*[self.net.filters[w] for w in WIDTHS], *[self.net.biases[w] for w in WIDTHS], self.net.out, self.bias]

    def small(self) -> list[np.ndarray]:
        """All arrays but the table and its moments."""
        return [*self.weights(), *self.dense.m, *self.dense.v]


def train(texts: list[str], labels: list[int], buckets: int = 1 << 15, size: int = 8, n_filters: int = 8, epochs: int = 8, least_texts: int = 8, seed: int = 7) -> Network:
    """Fit a network; a quarter of the rows is held back for the languages' thresholds."""
    rng = np.random.default_rng(seed)
    lists, y = plain_words(texts), np.asarray(labels, np.float32)
    keys = [np.unique(np.array([k for w in set(x) for k in word_keys(w)], np.uint64)) for x in lists]
    order = rng.permutation(len(texts))
    back, fit = order[: len(order) // 4], order[len(order) // 4 :]
    seen, in_texts = np.unique(np.concatenate([keys[i] for i in fit]) if len(fit) else np.empty(0, np.uint64), return_counts=True)
    net = fresh(seen[in_texts >= least_texts], buckets, size, n_filters, rng)
    if len(fit):
        begun(net, len(fit), int(y[fit].sum()))
    if len(fit) and 0 < y[fit].sum() < len(fit):
        state = Fit(net)
        for _ in range(epochs):
            epoch(state, [net.codes([lists[i]])[0] for i in fit], y[fit], rng)
    if len(back):
        codes, offsets = net.codes([lists[i] for i in back])
        net.shifts = thresholds(*languages_and_counts(net, codes, offsets, y[back].astype(int)))
    return net


def fresh(known: np.ndarray, buckets: int, size: int, n_filters: int, rng) -> Network:
    """A network before it has learnt anything."""
    scale = 0.5 / math.sqrt(size)
    net = Network(
        (rng.normal(0, scale, (buckets, size))).astype(np.float32),
        {w: rng.normal(0, 1 / math.sqrt(w * size), (w, size, n_filters)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(n_filters, np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, len(WIDTHS) * n_filters).astype(np.float32),
        0.0,
        known,
        np.zeros(len(_LANGS)),
    )
    net.table[_PAD] = 0
    net.table[_RARE] = 0
    return net


def begun(net: Network, n: int, ones: int) -> None:
    """Set the bias by the share of ones; without both labels nothing but the bias decides."""
    if 0 < ones < n:
        net.out_bias = math.log(ones / (n - ones))
    else:
        net.out[:] = 0
        net.out_bias = 4.0 if ones else -4.0


_STEPS = 256  # scores of held-back rows are counted in such parts of one


def languages_and_counts(net: Network, codes: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score (in steps) and label of held-back texts."""
    return languages(codes, offsets), np.rint(net.logits(codes, offsets).astype(np.float64) * _STEPS).astype(np.int64), y


def thresholds(lang: np.ndarray, score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """The threshold of each language that has 20 texts of each label, else that of all; ``n`` texts stand behind each entry."""
    n = np.ones(len(y), np.int64) if n is None else n

    def cut(pick: np.ndarray) -> float:
        steps, at = np.unique(score[pick], return_inverse=True)
        ones = np.bincount(at, n[pick] * y[pick], len(steps))
        zeros = np.bincount(at, n[pick] * (1 - y[pick]), len(steps))
        if not len(steps) or not ones.sum() or not zeros.sum():
            return 0.0
        right = np.concatenate(([ones.sum()], ones.sum() + np.cumsum(zeros - ones)))
        edges = np.concatenate(([steps[0] - 1], steps, [steps[-1] + 1])) / _STEPS
        best = np.flatnonzero(right == right.max())
        k = best[int(np.argmax(edges[best + 1] - edges[best]))]
        return float((edges[k] + edges[k + 1]) / 2)

    everywhere, out = cut(np.ones(len(y), bool)), np.zeros(len(_LANGS))
    for k in range(len(_LANGS)):
        mine = lang == k
        enough = min((n * y)[mine].sum(), (n * (1 - y))[mine].sum()) >= 20
        out[k] = cut(mine) if enough else everywhere
    return out


def epoch(state: Fit, coded: list[np.ndarray], y: np.ndarray, rng) -> None:
    """One pass over texts in a random order."""
    net, bias, moments, batch = state.net, state.bias, state.moments, 32
    order = rng.permutation(len(coded))
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        offsets = np.concatenate(([0], np.cumsum([len(coded[i]) for i in pick])))
        rows, starts = net.rows(np.concatenate([coded[i] for i in pick]), offsets)
        ends = starts + np.diff(offsets) + 1
        got = net.responses(rows)
        where = {w: np.stack([s + np.argmax(got[w][s:e], axis=0) for s, e in zip(starts, ends, strict=True)]) for w in WIDTHS}
        pooled = {w: np.take_along_axis(got[w], where[w], axis=0) for w in WIDTHS}
        full = np.concatenate([np.maximum(pooled[w], 0) for w in WIDTHS], axis=1)
        p = 1 / (1 + np.exp(-np.clip(full @ net.out + bias[0], -30, 30)))
        d = ((p - y[pick]) / len(pick)).astype(np.float32)
        g_out, g_bias = full.T @ d + 1e-4 * net.out, np.array([d.sum()], np.float32)
        back = d[:, None] * net.out[None, :] * (full > 0)
        g_filters, g_biases, touched, changes = [], [], [], []
        for j, w in enumerate(WIDTHS):
            b = back[:, j * net.out.size // len(WIDTHS) : (j + 1) * net.out.size // len(WIDTHS)]
            g = np.zeros_like(net.filters[w])
            for k in range(w):
                r = rows[where[w] + k]  # texts x filters x 2
                g[k] = np.einsum("tfe,tf->ef", net.table[r[..., 0]] + net.table[r[..., 1]], b) + 1e-4 * net.filters[w][k]
                change = (b[:, :, None] * net.filters[w][k].T[None]).reshape(-1, net.table.shape[1])
                for part in (0, 1):
                    touched.append(r[..., part].ravel())
                    changes.append(change)
            g_filters.append(g)
            g_biases.append(b.sum(axis=0))
        state.dense.step(state.weights(), [*g_filters, *g_biases, g_out, g_bias])
        ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        grad = np.zeros((len(ids), net.table.shape[1]), np.float32)
        np.add.at(grad, inverse, np.concatenate(changes))
        own = ids > _RARE
        moments[ids[own]] += grad[own] ** 2
        net.table[ids[own]] -= 0.1 * grad[own] / (np.sqrt(moments[ids[own]]) + 1e-6)
    net.out_bias = float(bias[0])


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """Scores between 0 and 1; the threshold of each text's language lies at 0.7."""
    codes, offsets = net.codes(plain_words(texts))
    z = net.logits(codes, offsets) - net.shifts[languages(codes, offsets)] + math.log(0.7 / 0.3)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


_SLICES = 64  # of a network, where the shares' changes meet


def _packed(state: Fit, start: Fit, share: int) -> Iterator[tuple]:
    """share, slice, changes and which rows of the table were met; the last slice holds all that isn't the table."""
    change = np.concatenate((state.net.table - start.net.table, state.moments - start.moments), axis=1)
    met = (state.moments != start.moments).any(axis=1)
    for k, (c, m) in enumerate(zip(np.array_split(change, _SLICES), np.array_split(met, _SLICES), strict=True)):
        yield share, k, c.tobytes(), m.tobytes()
    small = np.concatenate([(a - b).ravel() for a, b in zip(state.small(), start.small(), strict=True)])
    yield share, _SLICES, small.tobytes(), np.ones(1, bool).tobytes()


_CHANGES = "share long, slice int, change binary, met binary, steps long"


_SHARE_DDL = "share long, labels binary, sizes binary, codes binary"


def _share(part: pa.Table) -> pa.Table:
    """All rows of a share as one, in an order that doesn't depend on the partitioning."""
    part = part.sort_by([("_id", "ascending"), ("_label", "ascending"), ("codes", "ascending")])
    codes = [c.as_py() for c in part["codes"]]
    cells = [part["_label"].to_numpy().astype(np.float32).tobytes(), np.array([len(c) // 8 for c in codes], np.int64).tobytes(), b"".join(codes)]
    return pa.table([part["share"].slice(0, 1), *[pa.array([c], pa.binary()) for c in cells]], names=["share", "labels", "sizes", "codes"])


def _round(sent, seed: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                share, start = b.column(0)[i].as_py(), sent.value
                y, sizes, codes = (np.frombuffer(b.column(j)[i].as_buffer(), kind) for j, kind in ((1, np.float32), (2, np.int64), (3, np.int64)))
                mine = pickle.loads(pickle.dumps(start))
                epoch(mine, np.split(codes, np.cumsum(sizes)[:-1]), y, np.random.default_rng((seed, k, share)))
                out = list(zip(*_packed(mine, start, share), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array([mine.dense.t] * len(out[0]), pa.int64())], names=["share", "slice", "change", "met", "steps"])

    return run


def _mean(part: pa.Table) -> pa.Table:
    """The mean of one slice's changes, of each row over the shares that met it, in the shares' order."""
    part = part.sort_by("share")
    total, n = None, None
    for change, met in zip(part["change"], part["met"], strict=True):
        m = np.frombuffer(met.as_buffer(), bool)
        c = np.frombuffer(change.as_buffer(), np.float32).reshape(len(m), -1)
        total, n = (c.astype(np.float64), m.astype(np.int64)) if total is None else (total + c, n + m)
    mean = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
    return pa.table({"slice": part["slice"].slice(0, 1), "change": pa.array([mean.tobytes()], pa.binary()), "steps": pa.array([max(part["steps"].to_pylist())], pa.int64())})


def _mixed(state: Fit, rows: list) -> None:
    """Add the mean changes of all slices."""
    by = {r["slice"]: r for r in rows}
    size = state.net.table.shape[1]
    change = np.concatenate([np.frombuffer(by[k]["change"], np.float32).reshape(-1, 2 * size) for k in range(_SLICES)])
    state.net.table += change[:, :size]
    state.moments += change[:, size:]
    np.maximum(state.moments, 0, out=state.moments)
    small, at = np.frombuffer(by[_SLICES]["change"], np.float32), 0
    for a in state.small():
        a += small[at : at + a.size].reshape(a.shape)
        at += a.size
    for v in state.dense.v:
        np.maximum(v, 0, out=v)
    state.dense.t = by[_SLICES]["steps"]
    state.net.out_bias = float(state.bias[0])


def train_on(rows: DataFrame, share_rows: int = 6000, most_words: int = 1 << 18, buckets: int = 1 << 15, size: int = 8, n_filters: int = 8, epochs: int = 8, least_texts: int = 8, seed: int = 7) -> Network:
    """Fit a network on all of ``rows`` (_id, _label, _text); an id's hash decides whether it is held back, and its share.

    Words in fewer than ``least_texts`` texts share one row; where more than ``most_words`` would have a row of
    their own, the least frequent ones share it, too.
    """
    spark = rows.sparkSession
    dealt, texts_at = settled_at(rows.select("_id", "_label", "_text", F.pmod(F.xxhash64("_id"), F.lit(4)).alias("_part")), "labelled")
    sizes = {(r["_part"] == 0, r["_label"]): r["n"] for r in dealt.groupBy((F.col("_part") == 0).alias("_part"), "_label").agg(F.count("*").alias("n")).collect()}  # four rows
    n, ones = sizes.get((False, 0), 0) + sizes.get((False, 1), 0), sizes.get((False, 1), 0)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in portions(texts):
                found = [np.unique(np.array([k for w in set(x) for k in word_keys(w)], np.uint64)) for x in plain_words(texts[part])]
                key, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

    counted, words_at = settled_at(dealt.where("_part <> 0").select("_text").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least_texts), "words")
    least, words = least_texts, 0
    for r in counted.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():  # 65 536 rows at most
        words += r["words"]
        if words > most_words:
            least = r["n"] + 1
            break
    known = np.sort(np.array([r[0] for r in counted.where(F.col("n") >= least).select("key").collect()], np.int64).view(np.uint64))  # at most ``most_words``
    rng = np.random.default_rng(seed)
    net = fresh(known, buckets, size, n_filters, rng)
    if n:
        begun(net, n, ones)
    state = Fit(net)
    words_of = spark.sparkContext.broadcast(net)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for part in portions(texts):
                codes, offsets = words_of.value.codes(plain_words(texts[part]))
                at = slice(part.start, part.stop)
                own = b.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), pa.array([codes[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["_id", "_label", "_part", "codes"])

    table, coded_at = settled_at(dealt.mapInArrow(coded, "_id long, _label int, _part long, codes binary"), "coded")
    shares = max(1, -(-n // share_rows))
    removed(spark, texts_at)
    fit, fit_at = settled_at(table.where("_part <> 0").select("_id", "_label", "codes", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(shares)).alias("share")).groupBy("share").applyInArrow(_share, _SHARE_DDL), "shares")  # the rounds shuffle no rows
    for k in range(epochs if 0 < ones < n else 0):
        sent = spark.sparkContext.broadcast(state)
        changes = fit.mapInArrow(_round(sent, seed, k), _CHANGES)
        _mixed(state, changes.groupBy("slice").applyInArrow(_mean, "slice int, change binary, steps long").collect())  # one network
        sent.unpersist()
    trained = spark.sparkContext.broadcast(net)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                codes = [np.frombuffer(c.as_buffer(), np.int64) for c in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(c) for c in codes], dtype=np.int64)))
                found = languages_and_counts(trained.value, np.concatenate(codes), offsets, part.column(0).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["lang", "score", "y"])

    held = table.where("_part = 0").select("_label", "codes").mapInArrow(judged, "lang long, score long, y long").groupBy("lang", "score", "y").agg(F.count("*").alias("n")).collect()  # a row for each step of the scores
    for path in (fit_at, words_at, coded_at):
        removed(spark, path)
    if held:
        net.shifts = thresholds(*np.array([[r["lang"], r["score"], r["y"], r["n"]] for r in held], np.int64).T)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (all columns but one named score) with its toxicity score.

    The network learns from all rows with a value of ``labels.toxic`` outside the fold ``held_out`` of
    ``modulus``. Only the text decides a score. Null and empty texts have no words and get the score of
    padding alone. Without labels of both values the score is the same for all texts. An empty table
    gives no rows.
    """
    rows = labelled_rows(docs, labels, "toxic", modulus, held_out, id_col, text_col)
    net = docs.sparkSession.sparkContext.broadcast(train_on(rows))  # size set by the parameters of `train_on`
    return with_scores(docs, text_col, lambda part: score_texts(net.value, part))


def with_scores(docs: DataFrame, text_col: str, score) -> DataFrame:
    names = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            found = [score(texts[part]) for part in portions(texts)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(np.concatenate(found) if found else [], pa.float64())], names=[*names, "score"])

    schema = docs.select(*names).schema.add("score", "double")
    return docs.select(*names).mapInArrow(run, schema)
