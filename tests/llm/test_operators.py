"""Each operator against brute force on small tables with nulls, blanks, ties, repeats and long texts."""

import hashlib
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Whitespace

from tallywheel.llm import chunk_store, exact_dedup, licenses, minmax_hash, mixing, packing, quality_model, quality_rules, substring_dedup, toxicity
from tallywheel.llm.components import components
from tallywheel.llm.encoder import TextEncoder, default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"
RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus():
    base = [prose(RNG.randint(1, 120)) for _ in range(40)]
    shared = prose(45)
    texts = [*base, *base[:8], None, "", " \t\n", "one two", "One  two", "a b c", shared, prose(30) + " " + shared, shared + "\n" + prose(25) + " " + shared, prose(4000)]
    for t in base[8:14]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(texts[2] + " ")
    return list(enumerate(texts, 10))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{0 if i % 3 else i % 5}", len(t or ""), "clash") for i, t in rows], SCHEMA).repartition(3)


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_exact_dedup(spark, docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split(" ")).translate({c: None for c in range(9, 14)}), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    for limit in (48 << 20, 3000):  # the second makes every task spill
        got = exact_dedup.exact_dedup(docs, table_chars=limit).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want and len(got) == len(rows)
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in exact_dedup.keep_first_copies(docs).collect()} == {i for i, w in want.items() if w[0] == i}
    assert exact_dedup.keep_first_copies(docs).columns == docs.columns


def test_grace_levels(tmp_path):
    recs = [(zlib.crc32(str(i % 50).encode()) << 32, "s", f"content {i % 50} " * 20, i % 50, i, 1) for i in range(500)]
    out = [r for b in exact_dedup.grace(recs, 2000, f"file://{tmp_path}") for r in b.to_pylist()]
    assert sorted(r["best_id"] for r in out) == list(range(50)) and {r["group_size"] for r in out} == {10}
    assert not any(tmp_path.iterdir())


def test_substring_dedup(docs, rows):
    seen, want = set(), {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = substring_dedup.substring_dedup(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 100
    assert all(sum(e - s for s, e in r["spans"]) == r["n_removed"] for r in got)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    got = minmax_hash.near_duplicates(docs, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert minmax_hash.near_duplicates(docs.limit(0), percent).count() == 0


def test_hot_group_in_blocks(spark, monkeypatch):
    """A group that hangs together by no single text: all pairs across components are found in blocks of any size."""
    monkeypatch.setattr(minmax_hash, "_BLOCK", 3)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[j * 16] = f"x{j}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minmax_hash.near_duplicates(d, 85).collect()} == {0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["v"]: r["m"] for r in components(spark.createDataFrame(chain, "v long, m long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 150: 100}


def plain_ids(texts, end=None):
    """Ids of whole texts by a tokenizer of the test's own."""
    tok = Tokenizer.from_file(default_tokenizer())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, *([] if end is None else [end])], "<u4") for t in texts]


def test_encoder():
    rnd = random.Random(1)
    alphabet = "ab'sé 1  \n\n\t\x1c\xa0.!,-日<|>\x01"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|> x", "a <|endoftext|> b", " lead", "tail ", "a\n b", "foo.\nBar, baz.", "a\n\nb\n\n\nc\n\n\n\n\nd", None, "", "it's we'll", "éÉ ñandú ßẞ naïve&&& |%%% ÀB"]
    texts += [" ".join(rnd.choice(["thé", "the", "ß.", "of&&&", "x1"]) for _ in range(5000))]
    want = [x.tolist() for x in plain_ids(texts, 7)]
    for limits in ({}, {"max_words": 50, "passing": 20}):
        e = TextEncoder(default_tokenizer(), **limits)
        for _ in range(2):
            got = [ids[a:b].tolist() for _, _, ids, at in e.encode(pa.array(texts, pa.string()), 7) for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == want


def test_encoder_takes_no_split_for_granted(tmp_path):
    tok = Tokenizer.from_file(default_tokenizer())
    tok.pre_tokenizer = Whitespace()
    tok.save(str(tmp_path / "other.json"))
    texts = ["one  two, three", "", "x\ny z"]
    got = [ids[a:b].tolist() for _, _, ids, at in TextEncoder(str(tmp_path / "other.json")).encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def encoded(rows, end):
    return dict(zip([i for i, _ in rows], plain_ids([t for _, t in rows], end), strict=True))


def test_chunk_store(spark, docs, rows, tmp_path):
    ids, start, want = encoded(rows, 0), 0, {}
    for i, _ in rows:
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    path = f"file://{tmp_path}/store"
    root = chunk_store.write_store(docs, path)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in chunk_store.read_documents(spark, path, root).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in chunk_store.read_ids(spark, path).collect()} == {i: x.tolist() for i, x in ids.items()}
    chunks = chunk_store._chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    good = [{"pos": k, "digest": r["digest"], "payload": r["payload"]} for k, r in enumerate(chunks.limit(2).collect())]
    assert len(chunk_store._whole(5, good)) == sum(len(chunk_store.unpack_ids(c["payload"])) // 4 for c in good)
    for bad, said in (({"payload": good[0]["payload"]}, "damaged"), ({"payload": None}, "missing")):
        with pytest.raises(ValueError, match=f"{said}|missing"):
            chunk_store._whole(5, [good[0], {**good[1], **bad}])
    files = sorted((tmp_path / "store" / "recipes").glob("*.parquet"))
    assert [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()] == [i for i, _ in rows] and len(files) > 1
    assert not (tmp_path / "store" / "_local").exists()
    assert root == chunk_store.write_store(docs.repartition(2), f"file://{tmp_path}/again")
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 12, "other").otherwise(F.col("text")))
    assert root != chunk_store.write_store(changed, f"file://{tmp_path}/changed")
    with pytest.raises(ValueError, match="root"):
        chunk_store.read_documents(spark, f"file://{tmp_path}/changed", root)
    empty = f"file://{tmp_path}/empty"
    chunk_store.write_store(docs.limit(0), empty)
    assert chunk_store.read_documents(spark, empty).count() == 0


def test_chunk_store_of_many_levels(spark, tmp_path, monkeypatch):
    """Nodes over three below; workers are forked with the module as it is, so the levels are folded here."""
    monkeypatch.setattr(chunk_store, "FAN", 3)
    leaves = [(k, 5 * k, 1, 5, hashlib.sha256(b"%d" % k).digest()) for k in range(20)]
    level, sizes = leaves, []
    while len(level) > 1:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*level, strict=True), chunk_store._NODE, strict=True)], schema=chunk_store._NODE)
        level = [tuple(r.values()) for b in chunk_store._folded(iter([batch])) for r in b.to_pylist()]
        sizes.append(len(level))
    assert sizes == [7, 3, 1] and level[0][1:4] == (0, 20, 100)
    with pytest.raises(ValueError, match="incomplete"):
        list(chunk_store._folded(iter([batch.slice(1)])))


def test_lost_files_of_a_store_are_found(spark, docs, tmp_path):
    def lose(name, pattern):
        path = tmp_path / name
        chunk_store.write_store(docs, f"file://{path}")
        f = max(path.glob(pattern), key=lambda f: f.stat().st_size)  # Spark writes files without rows, too
        f.unlink()
        (f.parent / f".{f.name}.crc").unlink()
        with pytest.raises(Exception, match="incomplete|differs|missing"):
            chunk_store.read_documents(spark, f"file://{path}").collect()

    for k, pattern in enumerate(("recipes/part-00000*", "recipes/part-00003*", "manifest/part*", "data/kind=chunk/part*")):
        lose(f"store{k}", pattern)
    path = tmp_path / "bare"
    chunk_store.write_store(docs, f"file://{path}")
    shutil.rmtree(path / "manifest")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        chunk_store.read_documents(spark, f"file://{path}").collect()


def test_repeated_and_null_ids_in_a_store(spark, tmp_path):
    rows = [(None, "b b"), (5, "x"), (None, None), (5, "x y z"), (5, "x"), (-3, "neg"), (5, "<|endoftext|>")]
    got = chunk_store.store_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ids = plain_ids([t for _, t in rows], 0)
    want = sorted(((i is not None, i or 0), len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:k]) for k in range(len(starts))]
    assert [i for _, _, i in starts] == [None, None, -3, 5, 5, 5, 5]


def test_damaged_chunk_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    chunk_store.write_store(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), path)
    bad = spark.read.parquet(f"{path}/data/kind=chunk").withColumn("payload", F.lit(chunk_store.pack_ids(b"\1\0\0\0")))
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{path}/data/kind=chunk")
    with pytest.raises(Exception, match="damaged"):
        chunk_store.read_documents(spark, path).collect()


def brute_substrings(rows, least=20):
    """n_words and kept words of each document, window by window."""
    first, out = {}, {}
    lists = {i: words(t) for i, t in rows}
    for i in sorted(lists):
        w = lists[i]
        gone = set()
        for at in range(len(w) - least + 1):
            window = tuple(w[at : at + least])
            if first.setdefault(window, (i, at)) != (i, at):
                gone.update(range(at, at + least))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


@pytest.mark.parametrize("length, parts", [(20, 3), (26, 7), (60, 3)])
def test_a_passage_in_most_documents_is_dealt_out(spark, monkeypatch, length, parts):
    """No key of the shuffle gets a row for each document, and the words removed are those of brute force."""
    passage = prose(length)
    rows = [(i, f"{prose(RNG.randint(0, 30))} {passage} {prose(RNG.randint(0, 30))}".strip()) for i in range(1500)] + [(9000 + i, prose(40)) for i in range(50)]
    RNG.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    texts = d.select("doc_id", F.hash("text").alias("text_key"), "text")
    hot = substring_dedup.hot_groups(texts.select("text"), 20)
    assert 0 < hot.sum() < 200
    seeds = lambda which: texts.mapInArrow(substring_dedup._seeds(20, which), substring_dedup._SEED_DDL).where("place >= 0").groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert seeds(np.zeros_like(hot)) > 1000 and seeds(hot) <= substring_dedup.HOT_LEAST
    got = {r["doc_id"]: (r["n_words"], r["kept_text"]) for r in substring_dedup.substring_dedup(d).collect()}
    assert got == {i: (n, " ".join(x.decode() for x in kept)) for i, (n, kept) in brute_substrings(rows).items()}


def test_families_that_are_alike_but_not_linked(spark, monkeypatch):
    """Texts of one template at a similarity of about 0.7, with linked ones among them, against brute force."""
    monkeypatch.setattr(minmax_hash, "_LARGE", 8)
    template, rows = [f"t{i}" for i in range(100)], []
    for k in range(90):
        text = list(template)
        text[RNG.randrange(20) : 20] = []
        for at in RNG.sample(range(len(text)), 3):
            text[at] = f"own{k}x{at}"
        rows.append((3 * k, " ".join(text)))
        if k % 9 == 0:
            rows.append((3 * k + 1, " ".join([*text, "end"])))
            rows.append((3 * k + 2, " ".join([*text[1:], f"last{k}"])))
    RNG.shuffle(rows)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minmax_hash.near_duplicates(d, 85).collect()}
    assert got == {i: root(i) for i in sets} and len(set(got.values())) > 20


def test_joined_crc():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"hello " * 50, b"world" * 9)):
        assert chunk_store.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cuts_follow_the_content():
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u4")
    ends = chunk_store.cut_points(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= chunk_store.MAX_IDS
    moved = chunk_store.cut_points(np.concatenate((ids[:100], ids)))
    assert len({e + 100 for e in ends} & set(moved)) > len(ends) // 2


def test_packing(docs, rows):
    ids = encoded(rows, 2)
    got = packing.pack_documents(docs, capacity=256, with_ids=True).collect()
    assert len(got) == sum(-(-len(x) // 256) for x in ids.values())
    by_seq = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part.tobytes() and r["ids_crc32"] == zlib.crc32(part.tobytes()) and (r["piece"] == 0 or r["length"] == 256)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(len(x) for x in ids.values())
    assert len(by_seq) <= 1.1 * -(-total // 256)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_plan_takes_every_piece():
    rnd = random.Random(3)
    for _ in range(30):
        lengths = Counter(rnd.randint(1, 100) for _ in range(rnd.randint(1, 400)))
        runs = packing.plan_packing(dict(lengths), 100)
        packed = Counter()
        for k, held in runs:
            assert sum(held) <= 100 and sum(n > 33 for n in held) <= 2 or all(n > 33 for n in held) and len(held) <= 2
            for n in held:
                packed[n] += k
        assert packed == lengths


def brute_quality(text):
    t = text or ""
    w = [x.decode() for x in words(t)]
    lines = [x for x in t.split("\n") if words(x)]
    spots = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if spots[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, rows):
    extra = [("Home | About | Login | Help", None), (" ".join(["buy now today friends"] * 12), None), ("# # # $$$ %%% &&&\n" + prose(30), None), ("Click here to accept cookies\n" + prose(40), None), ("SHOUTING LINES ARE REMOVED HERE ALWAYS\n" + prose(40), None)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, (t, _) in enumerate(extra)], "doc_id long, text string"))
    texts = dict(rows) | {1000 + k: t for k, (t, _) in enumerate(extra)}
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d).collect()}
    for i, t in texts.items():
        n, chars, symbols, dup, rep = brute_quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), i
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n) and not (r["base_failed"] and r["kept"])
    assert got[1000]["clean_text"] == "" and not got[1001]["kept"]
    assert got[1003]["kept"] and "cookies" not in got[1003]["clean_text"] and "SHOUTING" not in got[1004]["clean_text"] and got[1002]["clean_text"].count("\n") == 0
    clean = [i for i, t in rows if t and len(t.split()) >= 20 and not got[i]["base_failed"]]
    assert all(got[i]["kept"] and got[i]["clean_text"] == texts[i] for i in clean) and clean


def test_mixing(docs, rows):
    plan = mixing.mix_plan(docs, max_repeats=3.0, block_tokens=500).collect()
    tokens = {i: len(words(t)) for i, t in rows}
    source = {i: f"src{0 if i % 3 else i % 5}" for i, _ in rows}
    size = Counter()
    for i, n in tokens.items():
        size[source[i]] += n
    assert {r["doc_id"] for r in plan if r["pass"] == 0} == set(tokens)
    top = max(size.values())
    worst = max(top / s for s in size.values())
    exponent = max(0.0, 1 - np.log(3.0) / np.log(worst)) if worst > 3 else 0.0
    for s, n in size.items():
        budget = max(n, round(n**exponent * top ** (1 - exponent)))
        mine = sorted((r for r in plan if r["source"] == s and r["n_tokens"]), key=lambda r: r["before"])
        assert max(r["pass"] for r in mine) < 3
        at = 0
        for r in mine:
            assert r["before"] == at
            at += r["n_tokens"]
        assert budget <= at < budget + max(tokens.values()) + 1
    assert [r["block"] for r in sorted((r for r in plan if r["source"] == "src0"), key=lambda r: r["before"])] == sorted(r["block"] for r in plan if r["source"] == "src0")
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    mixed = mixing.mix_sources(docs, 4, max_repeats=3.0)
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in plan)


def test_target_entropy(spark):
    sizes = spark.createDataFrame([("a", 1000, 1), ("b", 10, 1), ("c", 10, 1)], "source string, tokens long, documents long")
    w = mixing.source_weights(sizes, max_repeats=None, target_entropy=0.9).collect()
    h = -sum(r["weight"] * np.log(r["weight"]) for r in w)
    assert h == pytest.approx(0.9, abs=1e-6) and sum(r["weight"] for r in w) == pytest.approx(1)
    b = mixing.source_weights(sizes, max_repeats=4.0, budget=1020).collect()
    assert max(r["budget"] / r["tokens"] for r in b) <= 4.01


def test_licenses(spark):
    lines = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "": "Her driving license and a copyright notice lay on the general's desk."}
    d = spark.createDataFrame([(f"{prose(20)}\n{x}\n{prose(10)}", f) for f, x in lines.items()] + [(None, ""), ("", ""), (prose(50), "")], "text string, findings string")
    got = licenses.license_scan(d).collect()
    assert [",".join(r["licenses"]) for r in got] == [*lines, "", "", ""]
    assert all(0 < f["score"] <= 1 and f["confirmed"] for r in got for f in r["findings"] if r["licenses"])
    assert licenses.license_scan(d.limit(0)).count() == 0


def labelled(n, bad):
    out = []
    for i in range(n):
        w = prose(RNG.randint(15, 60)).split()
        y = int(i % 4 == 0)
        if y:
            bad(w)
        out.append((i, " ".join(w), y))
    return out


def test_every_paragraph_has_the_models_verdict(spark):
    model, rng = licenses.train(), np.random.default_rng(4)
    lines = ["Released under the MIT.", "Text: CC BY 4.0", "under CC BY-NC 4.0", "under cc by 4.0", "Released under the BSD.", "", "..."]
    for t in [*[t for own in licenses.NOTICES.values() for t in own], *licenses.OTHER_NOTICES, *licenses.OTHER]:
        words = t.split()
        cuts = [sorted(rng.integers(0, len(words) + 1, 2)) for _ in range(12)]
        lines += [" ".join(words[a:b]) for a, b in cuts] + [" ".join(rng.permutation(words))]
    lines += [f.replace("{the}", "the").replace("{}", n) for f in licenses.FRAMES for n in [x for own in licenses.NAMES.values() for x in own[:2]]]
    lines += [" / ".join(rng.choice(model.vocabulary, int(rng.integers(1, 9)))) for _ in range(400)]
    want = [verdict(model, x)[0] for x in lines]
    assert {*want} == {None, licenses.UNKNOWN, *licenses.FAMILIES} and want[0] == "mit" and want[3] == "cc-by"
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["findings"] for r in licenses.license_scan(d).collect()}
    assert [got[i][0]["family"] if got[i] else None for i in range(len(lines))] == want


def verdict(model, paragraph):
    """The model's verdict on a paragraph and its score, in numpy."""
    place = {g: i for i, g in enumerate(model.vocabulary)}
    own = [place[g] for g in set(licenses.grams(licenses.words_of(paragraph))) if g in place]
    p = licenses._softmax((model.weights[own].sum(axis=0) + model.biases)[None])[0]
    k = int(p[1:-1].argmax())
    if p[1 + k] >= model.cut:
        return licenses.FAMILIES[k], float(p[1 + k])
    return (licenses.UNKNOWN, float(1 - p[0])) if 1 - p[0] >= model.cut else (None, 0.0)


def test_licences_in_other_words(spark):
    """Wordings, names and notices that the fit hasn't seen; licences of no family are unknown, and prose is nothing."""
    grant = licenses.NOTICES["mit"][0].split()
    wrapped = [""]
    for w in grant:
        wrapped = [*wrapped, w] if len(wrapped[-1]) + len(w) > 75 else [*wrapped[:-1], f"{wrapped[-1]} {w}".strip()]
    cases = [
        ("Distributed under the terms of Apache 2.0", "apache-2.0"), ("Released under GPLv3.", "gpl"), ("Code under the MPL 2.0", "mpl-2.0"), ("SPDX-License-Identifier: ISC", "unknown"),
        ("SPDX-License-Identifier: AGPL-3.0", "unknown"), ("Distributed under the Boost Software License, Version 1.0.", "unknown"), ("CC BY-SA 4.0", "unknown"), ("\n".join(f"// {x}" for x in wrapped), "mit"),
        ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("(c) 2020 Some Body. BSD licensed.", "bsd"), ("This repository is licensed under the BSD 2-clause license", "bsd"), ("This library is under LGPL v3", "lgpl"), ("Licensed under the European Union Public Licence", "unknown"),
        ("The license of the driver was revoked under the law.", None), ("He studied at MIT and works under a license from the state.", None), ("Er fuhr mit der Bahn unter dem Berg hindurch, die Lizenz lag daheim.", None),
        ("The general public may copy the apache costume, version two, for free.", None), ("", None), ("under the", None),
    ]
    filler = prose(40)
    docs = [(i, f"{filler}\n\n{x}\n\n{filler}" if i % 2 else x, f) for i, (x, f) in enumerate(cases)]
    d = spark.createDataFrame(docs, "doc_id long, text string, want string")
    model = licenses.train()
    for r in licenses.license_scan(d).collect():
        found = [f["family"] for f in r["findings"]]
        assert found == ([r["want"]] if r["want"] else []), (r["text"], found)
        assert r["licenses"] == [f for f in found if f != "unknown"]
        for f in r["findings"]:
            family, score = verdict(model, f["paragraph"])
            assert family == f["family"] and abs(score - f["score"]) < 1e-4
    rng = np.random.default_rng(99)
    lists, labels = licenses._pieces(rng)  # other draws than those of the fit
    right = [(licenses._CLASSES[y - 1] if y else None, verdict(model, " ".join(x))[0]) for x, y in list(zip(lists, labels, strict=True))[::5]]
    named = [(y, v) for y, v in right if v]
    assert sum(y is not None for y, _ in named) >= 0.97 * len(named) and sum(v is not None for y, v in right if y) >= 0.93 * sum(y is not None for y, _ in right)


def test_paragraphs(spark):
    long = "x" * 130
    cases = {"a\nb\n\nc": ["a b", "c"], f"a\n{long}\nb": ["a", long, "b"], "a\n \t\nb\r\nc": ["a", "b\r c"], "": [""], "a": ["a"], f"{'y' * 120}\n{'z' * 120}": [f"{'y' * 120} {'z' * 120}"]}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", licenses.paragraphs(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == cases


def test_toxicity(spark):
    def bad(w):
        w[RNG.randrange(len(w))] = RNG.choice(["nastyword", "nastyful", "vileword"])

    rows = labelled(900, bad)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, labels).collect()}
    held = [(got[i] >= 0.7, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.97 and all(0 <= s <= 1 for s in got.values()) and len(got) == 902
    none = toxicity.toxicity(d, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    assert toxicity.toxicity(d.limit(0), labels).count() == 0


def test_toxicity_learns_from_all_rows(spark):
    """Two rare marks stand in a few rows each, far more rows of either label don't have them; shares of 300 rows and any partitioning give one network."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(4000):
        y = i % 2
        mark = ("awful" if i % 8 == 1 else "vile" if y else "fine")
        rows.append((i, y, " ".join(rnd.choices(words, k=12) + [mark] + rnd.choices(words, k=5))))
    table = spark.createDataFrame(rows, "_id long, _label int, _text string")
    nets = [toxicity.train_on(table.repartition(n), share_rows=300) for n in (2, 5)]
    assert np.array_equal(nets[0].table, nets[1].table) and np.array_equal(nets[0].shifts, nets[1].shifts)
    keys = {k for m in ("awful", "vile", "fine") for k in toxicity.word_keys(m.encode())}
    assert keys <= set(nets[0].known.tolist())
    right = (toxicity.score_texts(nets[0], [t for _, _, t in rows]) >= 0.7) == np.array([y for _, y, _ in rows], bool)
    assert right.mean() > 0.99
    once = toxicity.train_on(table.where("_id < 3000").unionAll(table.where("_id >= 3000").selectExpr("_id", "1 - _label", "_text")), share_rows=300)
    assert not np.array_equal(once.table, nets[0].table)  # no row is left out


def plain_toxicity(net, text):
    """A score by loops over one text's words, filters and places."""
    words = [w for w in "".join(c if ord(c) > 127 or c.isalnum() or c == "'" else " " for c in text).encode().lower().split()]
    known = set(net.known.tolist())

    def vector(word):
        out = np.zeros(net.table.shape[1])
        for h in toxicity.word_keys(word):
            out += net.table[h % (len(net.table) - 2) + 2 if h in known else 1]
        return out

    at = [*map(vector, words), *[np.zeros(net.table.shape[1])] * 3]
    full = []
    for w in toxicity.WIDTHS:
        for k in range(net.filters[w].shape[2]):
            full.append(max(0.0, *[sum(float(at[i + j] @ net.filters[w][j][:, k]) for j in range(w)) + float(net.biases[w][k]) for i in range(len(words) + 1)], -9e9))
    z = sum(a * float(b) for a, b in zip(full, net.out, strict=True)) + net.out_bias
    counts = [sum(w.decode() in known_words.split() for w in words) for known_words in toxicity.FUNCTION_WORDS.values()]
    z += np.log(0.7 / 0.3) - net.shifts[counts.index(max(counts))]
    return 1 / (1 + np.exp(-z))


def test_toxicity_by_loops():
    """Each text's score is what plain loops over it alone give, whatever texts stand beside it."""

    def bad(w):
        w[RNG.randrange(len(w))] = RNG.choice(["nastyword", "nastyful", "vileword"])

    rows = labelled(500, bad)
    net = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=3)
    texts = ["", None, "nastyword", "nastyful vileword nastyword", " .;", "Le NASTYWORD, est-ce pour la maison?", *[t for _, t, _ in rows[:40]], "vileword nastyful", "", "der die das und für nastyword's Ärger"]
    want = [plain_toxicity(net, t or "") for t in texts]
    assert np.allclose(toxicity.score_texts(net, texts), want, atol=1e-4)
    assert np.allclose(toxicity.score_texts(net, texts[::-1])[::-1], want, atol=1e-4)
    assert np.allclose(np.concatenate([toxicity.score_texts(net, [t]) for t in texts]), want, atol=1e-4)
    assert len(toxicity.score_texts(net, [])) == 0


def plain_figures(text):
    words, lines = [w for w in re.split("[\x20\x09-\x0D]+", text) if w], [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    if not words:
        return [0.0] * len(quality_model.FIGURES)
    n, dense = len(words), sum(len(w.encode()) for w in words)
    share = lambda ok: sum(map(ok, text)) / dense
    fours = [tuple(words[i : i + 4]) for i in range(n - 3)]
    adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0
    again = 1 - len(set(fours)) / len(fours) if fours else 0.0
    return [np.log(1 + n), dense / n, len(set(words)) / n, share(lambda c: c in "#*$%&<>"), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), text.count("!") / n, text.count("|") / n, adjacent, again, 1 - len(set(lines)) / len(lines), np.log(1 + dense / len(lines)), (text.count(".") + text.count(",")) / n]


def test_quality_by_loops():
    """Each text's score is the sum of table entries that plain loops over figures, cuts and pairs find."""

    def bad(w):
        for k in range(0, len(w), 3):
            w[k] += "$$$" if k % 2 else "!,|"

    rows = [(t, 1 - y) for _, t, y in labelled(500, bad)]
    model = quality_model.train(quality_model.figures([t for t, _ in rows]), np.asarray([y for _, y in rows]))
    texts = ["", None, " \n", "a", "a a a a a a a a", "A1, b2! | c3.\n\nA1, b2! | c3.\n \nÄrger über 7 %", *[t for t, _ in rows[:60]]]
    want = []
    for t in texts:
        x = plain_figures(t or "")
        b = [sum(c <= v for c in cuts) for cuts, v in zip(model.cuts, quality_model.figures([t])[0], strict=True)]
        z = model.base + sum(float(tab[k]) for tab, k in zip(model.tables, b, strict=True)) + sum(float(tab[b[i], b[j]]) for i, j, tab in model.pairs)
        want.append(1 / (1 + np.exp(-(z - model.shift + np.log(0.3 / 0.7)))))
        assert np.allclose(quality_model.figures([t])[0], x, atol=1e-9)
    assert np.allclose(quality_model.score_texts(model, texts), want, atol=1e-9)
    assert len(model.pairs) > 0 and max(want) > 0.9 and min(want) < 0.1


def test_quality_model(spark):
    def bad(w):
        for k in range(0, len(w), 3):
            w[k] += "$$$"

    rows = [(i, t, 1 - y) for i, t, y in labelled(900, bad)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, " ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_model.quality_scores(d, labels).collect()}
    held = [(got[i] >= 0.3, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.97 and all(0 <= s <= 1 for s in got.values()) and len(got) == 902
    assert quality_model.quality_scores(d.limit(0), labels).count() == 0


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as P

    d, counts = docs, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, "").collect(), docs.schema)
        assert d.columns == docs.columns
        counts.append(d.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] <= counts[4]
    packed = P.STAGES[-1][1](spark, d, "").collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in d.collect())
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
