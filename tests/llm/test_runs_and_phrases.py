"""Phrases, SimHash links and periodic runs against brute force, with nulls, blanks, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tallywheel.llm import periodic_runs as periods
from tallywheel.llm import phrases, registry, simhash

RNG = random.Random(13)
BLANK = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, id string, fp string, word string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", "id", None, "w", "n") for i, t, x in rows], SCHEMA).repartition(3)


# ---- phrases ----


def phrases_by_hand(rows, least, top, percent=80):
    """{lang: [(phrase, a, l, r, score)]} in order, and words of each language."""
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + k] for g, a in often.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= percent * counts[g[i : i + k]]}
        found = []
        for g, a in often.items():
            if g not in gone:
                score, cut = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                found.append((" ".join(g), a, counts[g[:cut]], counts[g[cut:]], score))
        out[lang] = sorted(found, key=lambda x: (-x[4], -x[1], x[0].encode()))[:top]
    return out, n


def phrase_rows():
    common = ["of", "the", "New", "york", "CITY", "hall", "Grüße", "und", "a", "\U0001f600", "é b", "x y"]
    say = lambda n: "".join(RNG.choice(common[: RNG.choice([3, 6, 12])]) + RNG.choice([" ", " ", "\t", "  ", ", ", ".", "\n", " ", "\x0b"]) for _ in range(n))
    rows = [(i, say(RNG.randint(0, 60)), RNG.choice(["en", "de", None, "und", ""])) for i in range(120)]
    rows += [(i, "new york city hall", "en") for i in range(200, 240)] + [(None, None, "en"), (7, "", None), (7, " \t\n", "fr"), (8, say(3000), "en"), (8, "aa bb aa bb aa " * 9, "tie")]
    return rows


@pytest.mark.parametrize(("least", "top", "block"), [(3, 2000, 150), (5, 7, 1 << 21), (30, 2000, 1)])
def test_phrases(spark, least, top, block):
    rows = phrase_rows()
    want, n = phrases_by_hand(rows, least, top)
    got = defaultdict(list)
    for r in sorted(phrases.collocations(table(spark, rows), min_count=least, top=top, block_words=block).collect(), key=lambda r: (r["lang"], r["rank"])):
        assert r["n"] == n[r["lang"]] and r["rank"] == len(got[r["lang"]]) + 1
        got[r["lang"]].append((r["phrase"], r["a"], r["l"], r["r"], r["score"]))
    assert dict(got) == {lang: x for lang, x in want.items() if x}


def test_phrases_of_nothing(spark):
    assert phrases.collocations(table(spark, [(1, "a b", "en")]).where("false")).count() == 0
    assert phrases.collocations(table(spark, [(1, None, "en"), (2, "", None)])).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    a = 2**62
    row = spark.createDataFrame([(a, [a + 1, a], [a + 3, a])], "a long, heads array<long>, tails array<long>").select(phrases._cut(2, 2_000_000).alias("c")).first()["c"]
    assert row["score"] == Fraction(2_000_000 * a, 2 * a + 4).__floor__() and row["cut"] == 1


# ---- SimHash ----


def print_by_hand(text):
    words = BLANK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    """{row: smallest id reachable} from (row, id, fingerprint), all pairs compared."""
    lead = list(range(len(prints)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for x, (_, a) in enumerate(prints):
        for y, (_, b) in enumerate(prints[:x]):
            if (a ^ b).bit_count() <= 2:
                lead[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(prints):
        least[find(x)] = min((v for v in (least.get(find(x)), i) if v is not None), default=None)
    return [least[find(x)] for x in range(len(prints))]


def test_simhash(spark):
    words = [f"W{i}" for i in range(90)]
    base = [" ".join(RNG.choice(words) for _ in range(RNG.randint(1, 200))) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(base, 100)]
    for k in range(150):
        w = base[k % 25].split()
        w[RNG.randrange(len(w))] = "changed" + str(k % 3)
        rows.append((300 + k, " ".join(w), "en"))
    rows += [(5, base[0].lower() + "\n", "en"), (5, None, None), (None, "", None), (None, base[3], None), (2, "\t \n", None), (6, "One two", None), (6, "one\x0btwo", None), (9, " ".join(base) * 9, "en")]
    want = [print_by_hand(t) for _, t, _ in rows]
    comp = components_by_hand([(i, f) for (i, _, _), f in zip(rows, want, strict=True)])
    expected = Counter((i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, want, comp, strict=True))
    got = simhash.simhash_duplicates(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected
    sizes = Counter(comp)
    assert all(r["group_size"] == sizes[r["component_id"]] for r in got if r["component_id"] is not None)
    assert len(set(comp)) < len(set(want))


def test_links_of_dense_families(spark):
    """Fingerprints around a few centres, at all distances up to six, with bits at both ends."""
    family = {0, 1, 1 << 63, 3 << 62, 7, 2**64 - 1, 2**63 - 1}
    for _ in range(6):
        centre = RNG.getrandbits(64)
        for _ in range(70):
            family.add(centre ^ sum(1 << b for b in RNG.sample(range(64), RNG.randint(0, 6))))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in family)
    edges = {(r["v"], r["m"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges)
    lead = {f: f for f in signed}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        lead[find(a)] = find(b)
    want = components_by_hand([(f, f & (2**64 - 1)) for f in signed])
    groups, wanted = defaultdict(set), defaultdict(set)
    for f, w in zip(signed, want, strict=True):
        groups[find(f)].add(f)
        wanted[w].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_of_nothing(spark):
    assert simhash.simhash_duplicates(table(spark, [(1, "a", "en")]).where("false")).count() == 0


# ---- periodic runs ----


def runs_by_hand(words, least=12):
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def sequences():
    out = [[], [0], [0] * 11, [0] * 12, [0] * 300, [0, 1] * 40, list(range(50)), [0, 1, 2, 3, 4, 5] * 2, [1, 0, 1, 2, 3, 4, 5] * 2 + [1, 0]]
    fib = [[0], [0, 1]]
    for _ in range(11):
        fib.append(fib[-1] + fib[-2])
    out += [fib[-1], [bin(i).count("1") % 2 for i in range(4096)]]  # words with very many runs; prefix hashes modulo 2^64 fail on the second
    for k in range(300):
        n, letters = RNG.randint(0, 260), RNG.choice([1, 2, 2, 3, 30])
        x = [RNG.randrange(letters) for _ in range(n)]
        if n > 20 and k % 2:
            p = RNG.randint(1, n // 2)
            a = RNG.randrange(n)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        out.append(x)
    return out


def test_runs_of_sequences():
    lists = sequences()
    assert periods.runs(lists) == [runs_by_hand(x) for x in lists]
    assert periods.runs(lists, 2) == [runs_by_hand(x, 2) for x in lists]
    assert periods.runs(lists[:40], 5) == [runs_by_hand(x, 5) for x in lists[:40]]


def test_runs_where_hashes_fail():
    lists = sequences()[:40]
    for x in lists:
        words = np.array([-1, *x, -2], np.int64)
        assert sorted(periods._plain(words, 1, 1 + len(x), 12)) == sorted((s + 1, s + 1 + n, p) for s, n, p in runs_by_hand(x))


def test_query_of_periodic_runs(spark, tmp_path):
    texts = [" ".join(f"w{v}" for v in x) for x in sequences()[:120]] + [None, "", " \n", "lone", "  é x\ty  \x0b z " * 9, "a b c d " * 4000]
    ids = [*range(len(texts) - 2), None, 3]
    rows = [(i, t, "en") for i, t in zip(ids, texts, strict=True)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in registry.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t, _ in rows:
        words = BLANK.findall(t or "")
        n = len(words)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0:
                a = h // 10 % n
                p = 1 + (n - a) // (3 + h // 10 % 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = runs_by_hand(words) if n != 16000 else [(0, n, 4)]
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        want[(i, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want


def test_runs_of_nothing(spark):
    assert periods.periodic_runs(table(spark, [(1, "a", "en")]).where("false")).count() == 0


def test_links_broadcast_nothing(spark):
    """Tables of fingerprints and edges unpack to far more than their files' size, so no join of them may go through the driver."""
    from tallywheel.llm import components
    from tallywheel.llm.common import settled

    fps = settled(spark.range(3000).selectExpr("id * 2654435761 AS fp"), "fps")
    edges = settled(spark.range(3000).selectExpr("id + 1 AS v", "id AS m"), "edges")
    for found in (simhash._met(fps), simhash.links(fps), components._large_star(edges), components._small_star(edges)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_settled_tables_leave_no_shuffle_files(spark):
    import os

    from tallywheel.llm.common import settled

    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [str(f) for f in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for at in folders for _, _, found in os.walk(at) for f in found if f.startswith("shuffle_")}
    before = files()
    rows = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    assert rows.count() == 7
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(setting) == "false"
    left = {f for f in files() - before if f.split("_")[1] not in {x.split("_")[1] for x in before}}
    assert len({f.split("_")[1] for f in left}) <= 1  # that of the count above


def test_frequent_pairs_are_one_row_each():
    """A row for each phrase and each block, not for each of a phrase's blocks."""
    n, blocks = 500, 40
    parts = np.arange(n, dtype=np.int64)
    one = phrases._columns(parts, parts + 7, np.full(n, 2, np.int64))
    lists = phrases.pa.table({"at": [b << phrases._LOCAL for b in range(blocks)], "pairs": phrases.pa.array([one] * blocks, phrases.pa.binary())})
    got = phrases._summed(2 * blocks)(lists)
    assert got.num_rows == n + blocks
    found = [r for r in got.to_pylist() if r["id"] is not None]
    assert [(r["id"], r["a"], r["left"], r["right"]) for r in found] == [(i, 2 * blocks, i, i + 7) for i in range(n)]
    local, number = phrases._of_columns(next(r["numbers"] for r in got.to_pylist() if r["of"] == 3), 2)
    assert local.tolist() == number.tolist() == list(range(n))
    assert phrases._summed(2 * blocks + 1)(lists).num_rows == 0
