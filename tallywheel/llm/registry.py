"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.llm.chunk_store import store_and_read
from tallywheel.llm.common import BLANKS, documents
from tallywheel.llm.exact_dedup import exact_dedup
from tallywheel.llm.labelled import fold
from tallywheel.llm.licenses import license_scan
from tallywheel.llm.minmax_hash import near_duplicates
from tallywheel.llm.mixing import mix_plan
from tallywheel.llm.packing import pack_documents
from tallywheel.llm.periodic_runs import periodic_runs
from tallywheel.llm.phrases import collocations
from tallywheel.llm.quality_rules import BOILERPLATE, MENU_WORDS, quality_rules
from tallywheel.llm.quality_model import quality_scores
from tallywheel.llm.simhash import simhash_duplicates
from tallywheel.llm.substring_dedup import substring_dedup
from tallywheel.llm.toxicity import toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_findings", "n_unconfirmed", F.array_max(F.transform("findings", lambda s: s["score"])).alias("best_score"))


def _judged(scored: DataFrame, modulus: int, held_out: int, cut: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _judged(toxicity(docs, labels, modulus=3, held_out=1), 3, 1, 0.7)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _judged(quality_scores(docs, labels, modulus=5, held_out=0), 5, 0, 0.3)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir), min_words=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source at least once and at most four times, in blocks of a million words."""
    return mix_plan(documents(spark, sf_dir), max_repeats=4.0).select("doc_id", "source", "pass", "n_tokens", "before", "block")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one id in ten (by its CRC) has its words from a place on replaced by repetitions of those that follow it."""
    words = F.split(F.trim(F.translate("text", BLANKS, " " * len(BLANKS))), " +")
    drawn = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    placed = drawn.withColumn("a", F.expr("(h div 10) % size(w)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + (h div 10) % 8)"))
    renewed = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS int)])), ' ')")
    return placed.select("doc_id", F.when(F.col("w").isNotNull(), renewed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(documents(spark, sf_dir)))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    of = found.withColumn("top", longest)
    return of.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_toxicity, op4_quality_model, op5_substring_dedup, op6_minmax_near_dedup, op7_token_store, op8_quality_rules, op9_mixing, op10_packing, op11_phrases, op12_simhash, op13_periodic_runs)}


_PHRASES = " OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)
_MENU = ", ".join(f"'{x}'" for x in MENU_WORDS)

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content FROM documents),
        g AS (SELECT content, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.content) AS text_sha256 FROM d JOIN g USING (content)
    """,
    "op5_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
        f AS (SELECT k, min({'a': doc_id, 'b': i}) AS lead FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT win.doc_id, win.i + t AS pos FROM win JOIN f USING (k), range(20) AS r(t) WHERE win.doc_id <> lead.a OR win.i <> lead.b),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
        kept AS (SELECT doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS text FROM words LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op6_minmax_near_dedup": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
        both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r(id, m) AS (SELECT x, x FROM both_ways UNION SELECT y, m FROM r JOIN both_ways ON x = id),
        comp AS (SELECT id, min(m) AS component FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id
    """,
    "op8_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        r AS (SELECT doc_id, unnest(list(i)) AS i FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8) GROUP BY doc_id, array_to_string(w[i + 1 : i + 8], ' ') HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) AS s(k) GROUP BY doc_id),
        l AS (SELECT doc_id, line, regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') AS dense, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
        f AS (SELECT doc_id, line, length(dense) AS n,
                10 * length(regexp_replace(dense, '[^#*$%&|<>]', '', 'g')) >= length(dense)
                OR (length(dense) >= 20 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}'))
                OR (len(lw) <= 20 AND ({_PHRASES}))
                OR (len(lw) <= 10 AND 2 * len(list_filter(lw, lambda x: lower(regexp_replace(x, '[^\\p{{L}}]+', '', 'g')) IN ({_MENU}))) >= len(lw)) AS fails
              FROM l WHERE dense <> ''),
        g AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS word_chars, CAST(coalesce(sum(n) FILTER (NOT fails), 0) AS BIGINT) AS kept_chars, count(*) - count(DISTINCT line) AS dup FROM f GROUP BY doc_id),
        o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
              FROM d LEFT JOIN g USING (doc_id) LEFT JOIN rep USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * kept_chars >= word_chars AND word_chars > 0 AS kept
        FROM o
    """,
    "op9_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
        s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
        e AS (SELECT CAST(max(tokens) AS DOUBLE) / min(tokens) AS ratio, CAST(max(tokens) AS DOUBLE) AS top FROM s),
        b(k, lo, hi, ratio) AS (
            SELECT 0, CAST(0 AS DOUBLE), CASE WHEN ratio <= 4 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, ratio FROM e
            UNION ALL
            SELECT k + 1, CASE WHEN pow(ratio, 1 - (lo + hi) / 2) <= 4 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(ratio, 1 - (lo + hi) / 2) <= 4 THEN (lo + hi) / 2 ELSE hi END, ratio FROM b WHERE k < 40),
        x AS (SELECT hi FROM b WHERE k = 40),
        z AS (SELECT sum(pow(CAST(tokens AS DOUBLE), hi)) AS z FROM s, x),
        w AS (SELECT source, tokens, greatest(CAST(round(pow(CAST(tokens AS DOUBLE), hi) / z * (top / (pow(top, hi) / z))) AS BIGINT), tokens) AS budget FROM s, x, z, e),
        n AS (SELECT greatest(1, CAST(ceil(sum(budget) / 1000000.0) AS BIGINT)) AS blocks FROM w),
        p AS (SELECT d.doc_id, d.source, d.n_tokens, tokens, budget, unnest(range(CAST(greatest(1, ceil(CAST(budget AS DOUBLE) / tokens)) AS BIGINT))) AS pass FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
        q AS (SELECT *, CAST('0x' || substr(sha256('0|' || coalesce(source, '') || '|' || pass || '|' || doc_id), 1, 15) AS BIGINT) AS order_key FROM p WHERE pass = 0 OR n_tokens > 0),
        c AS (SELECT *, pass * tokens + coalesce(CAST(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY order_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM q)
        SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, n_tokens, before, least(before // greatest(1, CAST(ceil(CAST(budget AS DOUBLE) / blocks) AS BIGINT)), blocks - 1) AS block
        FROM c, n WHERE before < budget OR n_tokens = 0
    """,
    "op11_phrases": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS x(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
        cuts AS (SELECT f.*, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (SELECT c.lang, c.k, c.g, c.a, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score, cut
              FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1 : c.k]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
        inner_parts AS (SELECT lang, k, a, g[i : i + m - 1] AS part FROM (SELECT lang, k, g, a, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 4) AS x(m) WHERE k > m)),
        longest AS (SELECT lang, part, max(a) AS most FROM inner_parts GROUP BY lang, part),
        kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN longest o ON o.lang = b.lang AND o.part = b.g WHERE most IS NULL OR 100 * most < 80 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
        QUALIFY rank <= 2000
    """,
    "op13_periodic_runs": """
        WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)::BIGINT AS h FROM documents),
        q AS (SELECT *, CAST(len(w) AS BIGINT) AS n, (h // 10) % greatest(len(w), 1) AS a FROM c),
        d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END)]) ELSE w END AS w FROM q),
        t AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
        e AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
        isles AS (SELECT doc_id, p, min(i) AS start, max(i) + 1 - min(i) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS isle FROM e) GROUP BY doc_id, p, isle HAVING count(*) >= greatest(p, 12 - p)),
        runs AS (SELECT doc_id, start, length, min(p) AS period FROM isles GROUP BY doc_id, start, length),
        of AS (SELECT doc_id, count(*) AS n_runs, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY t.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period, CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM d LEFT JOIN of USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
