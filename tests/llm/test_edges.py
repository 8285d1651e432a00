"""Null ids and sources, repeated ids and rows, very long texts and odd columns: every operator keeps its counts."""

import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallywheel.llm import chunk_store, exact_dedup, licenses, minmax_hash, mixing, packing, quality_model, quality_rules, substring_dedup, toxicity
from tallywheel.llm.encoder import default_tokenizer

RNG = random.Random(9)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, length string, kept string, s string"


@pytest.fixture(scope="module")
def rows():
    say = lambda n: " ".join(f"v{RNG.randint(0, 900)}" for _ in range(n))
    a, b = say(60), say(80)
    texts = [(1, a), (1, a), (1, b), (None, b), (None, None), (2, ""), (3, say(30000)), (4, "x" * 50000), (5, a + " " + b), (-7, say(25)), (9, "\n\n \n")]
    return [(i, t, None, None if k % 4 == 0 else f"s{k % 2}", None, "score", "length", None, "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def test_exact(docs, rows):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert by[(1, rows[0][1])]["group_size"] == 2 and by[(1, rows[0][1])]["kept"]
    assert by[(2, "")]["group_size"] == 3 and by[(2, "")]["keep_id"] == 9 and not by[(2, "")]["kept"]
    assert by[(None, rows[3][1])]["group_size"] == 2 and not by[(None, rows[3][1])]["kept"]


def test_first_copies_are_those_that_exact_dedup_keeps(spark):
    rows = [(None, "lone"), (None, "x y"), (1, "x y"), (4, "k k"), (4, "m"), (2, "m"), (4, "k k"), (5, "kk"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = Counter((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(d).where("kept").collect())
    assert want == Counter([(None, "lone"), (1, "x y"), (4, "k k"), (4, "k k"), (2, "m"), (None, None)])
    got = exact_dedup.keep_first_copies(d)
    assert got.columns == d.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_substring(docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got[(1, 60, 0)] == 2 and got[(1, 80, 0)] == 1 and got[(None, 80, 80)] == 1 and got[(None, 0, 0)] == 1
    assert got[(5, 140, 140)] == 1 and got[(3, 30000, 0)] == 1 and got[(4, 1, 0)] == 1 and sum(got.values()) == len(rows)


def test_near(docs, rows):
    got = minmax_hash.near_duplicates(docs, 85).collect()
    assert len(got) == len(rows) and all(r["component_id"] == r["doc_id"] for r in got)
    assert {r["n_shingles"] for r in got if r["doc_id"] is None} == {0, 76}


def test_near_copies_of_each_text_of_an_id(spark):
    say = lambda: [f"v{RNG.randint(0, 900)}" for _ in range(120)]
    text, near = (lambda w: " ".join(w)), (lambda w: " ".join([*w[:-1], "other"]))
    x, y, p, q, far = say(), say(), say(), say(), say()
    rows = [(7, text(x)), (7, text(y)), (3, near(x)), (5, near(y)), (9, text(p)), (9, text(q)), (2, text(p)), (8, near(q)), (6, text(far)), (7, text(x))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minmax_hash.near_duplicates(d, 80).collect()}
    assert got == {(7, 3, False), (3, 3, True), (5, 3, False), (9, 2, False), (2, 2, True), (8, 2, False), (6, 6, True)}
    assert {r["doc_id"] for r in minmax_hash.drop_near_duplicates(d, 80).collect()} == {3, 2, 6}


def test_store_and_packing(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/s"
    chunk_store.write_store(docs, path)
    got = chunk_store.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    packed = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in packed) == at and Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in rows)
    assert zlib.crc32((2).to_bytes(4, "little")) in {r["ids_crc32"] for r in packed}


def test_native(docs, rows):
    assert quality_rules.quality_rules(docs).count() == licenses.license_scan(docs).count() == len(rows)
    plan = mixing.mix_plan(docs, max_repeats=2.0).collect()
    assert Counter(r["doc_id"] for r in plan if r["pass"] == 0) == Counter(r[0] for r in rows)


def test_mixed_rows_are_those_of_the_plan(spark):
    """Rows that share an id aren't multiplied, and equal rows go as often as the plan takes them in all."""
    say = lambda n: " ".join(f"v{RNG.randint(0, 900)}" for _ in range(n))
    rows = [(1, say(9), "a", 7), (1, say(8), "a", 7), (1, say(7), "b", None), (None, say(5), "b", 1), (None, None, "b", 1), (None, None, "b", 1), (2, "x y", "b", 3), (2, "x y", "b", 3), (2, "x y", "b", 4), (2, "x y", None, 3), (3, "", "c", 0)]
    rows += [(k, say(30), "a", k) for k in range(10, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _block int").repartition(3)
    plan = Counter(r["doc_id"] for r in mixing.mix_plan(d, max_repeats=3.0).collect())
    got = mixing.mix_sources(d, 3, max_repeats=3.0)
    assert got.columns == d.columns
    found = Counter(tuple(r) for r in got.collect())
    assert Counter({i: sum(n for r, n in found.items() if r[0] == i) for i in {r[0] for r in rows}}) == plan
    assert all(found[r] >= n for r, n in Counter(rows).items()) and set(found) == set(rows)
    assert max(found.values()) > 1 and mixing.mix_sources(d.limit(0), 3).count() == 0


def test_lines_are_judged_by_words_whatever_their_length(spark):
    url = lambda n: "click here " + "u" * n
    many = lambda n: "click here " + " ".join(["word"] * n)
    long = lambda n: "click here " + " ".join(["v" * 300] * n)
    texts = {1: url(391), 2: url(392), 3: "#" * 401, 4: url(500), 5: url(5000), 6: url(200_000), 7: many(18), 8: many(19), 9: long(18), 10: long(19), 11: "home " + "x" * 5000, 12: "home " + "x" * 5000 + " y", 13: " \t" + many(18) + " \r", 14: "home menu " + " ".join(["z" * 900] * 2), 15: many(30_000)}
    gone = {1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 14}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["clean_text"] for r in quality_rules.quality_rules(d).collect()} == {i: "" if i in gone else t for i, t in texts.items()}


def test_columns_with_the_names_of_inner_ones(spark):
    """Whatever a table calls its further columns, the stages that pass rows on leave them as they are."""
    names = ["words", "_words", "gone", "own_id", "Own_SHA256", "stays_id", "stays_sha256", "_id", "_sha256", "_w"]
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in ((1, text), (2, text), (3, text + " more"), (4, None))]
    d = spark.createDataFrame(rows, ["doc_id", "text", *names])
    cleaned = quality_rules.quality_rules(d)
    assert [tuple(r)[: len(d.columns)] for r in cleaned.orderBy("doc_id").collect()] == rows
    assert sorted(tuple(r) for r in exact_dedup.keep_first_copies(d).collect() if r["doc_id"] < 4) == [rows[0], rows[2]]
    assert sorted(tuple(r) for r in minmax_hash.drop_near_duplicates(d).collect()) == [rows[0], rows[3]]


def test_scores(spark, docs, rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality_model.quality_scores):
        got = f(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)


def test_stages_against_brute_force(spark):
    """Every stage of the pipeline on rows with null and repeated ids, equal rows and near copies."""
    say = lambda n: " ".join(f"v{RNG.randint(0, 900)}" for _ in range(n))
    base = [say(60) for _ in range(12)]
    near = " ".join([*base[0].split()[:-1], "other"])
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base, 20)]
    rows += [(1, base[0], "en", "s0", 1), (1, base[0], "en", "s0", 1), (1, base[1] + " ", "de", None, None), (None, base[2], None, None, None), (None, say(50), None, "s1", 5), (2, near, "en", "s1", 2), (3, None, "en", "s1", 0), (4, " \n", "en", "s1", 2), (20, say(70), "fr", "s2", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        return [tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, docs.schema).repartition(2), "").collect()]

    cleaned = run("quality_rules", rows)
    want = Counter((r["doc_id"], r["clean_text"], r["lang"], r["source"], len(r["clean_text"])) for r in quality_rules.quality_rules(docs).where("kept").collect())
    assert Counter(cleaned) == want and not {3, 4} & {r[0] for r in cleaned}

    once, best = run("exact_dedup", cleaned), {}
    for r in cleaned:
        key = "".join(r[1].split())
        best[key] = min(best.get(key, (0, 0)), (-len(r[1]), 2**63 - 1 if r[0] is None else r[0]))
    assert Counter(once) == Counter(r for r in cleaned if best["".join(r[1].split())][1] == (2**63 - 1 if r[0] is None else r[0]))

    apart = run("minmax_near_dedup", once)
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    links = lambda a, b: a[0] is not None and b[0] is not None and 100 * len(grams(a[1]) & grams(b[1])) >= 80 * len(grams(a[1]) | grams(b[1]))
    gone = {b[0] for a in once for b in once if a[0] != b[0] and links(a, b) and a[0] < b[0]}
    assert 2 in gone and Counter(apart) == Counter(r for r in once if r[0] not in gone)

    mixed = run("mixing", apart)
    assert set(mixed) == set(apart) and all(n <= Counter(mixed)[r] <= 2 * n for r, n in Counter(apart).items())

    packed = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    tok = Tokenizer.from_file(default_tokenizer())
    ids = Counter((r[0], zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*tok.encode(r[1], add_special_tokens=False).ids, 2]))) for r in mixed)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in packed) == ids  # all are shorter than a sequence
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    for (s, o, n), (t, p, _) in zip(spans, [*spans[1:], (-1, 0, 0)], strict=True):
        assert p == (o + n if s == t else 0) and o + n <= 1024
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert run(name, [(None, None, None, None, None)][:0]) == []


def test_stages(spark, docs):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        d = spark.createDataFrame(stage(spark, d, "").collect(), stage(spark, d, "").schema)
    assert d.count() > 0
