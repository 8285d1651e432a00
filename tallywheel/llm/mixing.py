"""Temperature mixing of sources, in DataFrame functions only.

A source with a share p of all tokens gets a weight in proportion to p to the power of an exponent
between 0 (all sources alike) and 1 (as they are). The exponent is bisected to meet a target entropy
or a limit on how often a source may be repeated. The weights are realised on a token budget: each
source's documents run through one permutation after the other until its budget is spent, and the
stream is dealt into blocks that each hold every source in its weight.

Order in a permutation comes from a hash; token sums before a document come from sums by slices of the
hash range, so neither a source nor a pass over it has to fit one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.llm.common import BLANKS_RE, settled

_KEYS = 16**15
_SLICE_DOCS = 5000
_CUTS, _ROUNDS = 64, 7


def bisect_exponent(hold) -> float:
    """The least exponent in [0, 1] that holds; from some point on all must, and 1 does.

    ``hold`` tells for many exponents at once which of them hold, so a search takes eight calls.
    """
    if hold([0.0])[0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        marks = [lo + (hi - lo) * k / _CUTS for k in range(1, _CUTS)]
        first = next((k for k, held in enumerate(hold(marks)) if held), _CUTS - 1)
        lo, hi = (marks[first - 1] if first else lo), (marks[first] if first < _CUTS - 1 else hi)
    return hi


def source_sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """tokens (words) and documents of each source with a token."""
    tokens = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(BLANKS_RE.replace("[", "[^") + "+")).cast("long")
    return docs.groupBy(docs[source_col].alias("source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("documents")).where("tokens > 0")


def _sums(sizes: DataFrame, terms) -> list:
    """One row of totals, all in one job."""
    return sizes.agg(*[total.alias(str(k)) for k, total in enumerate(terms)]).first()


def _powers(exponents: list[float]) -> list:
    return [F.pow(F.col("tokens").cast("double"), F.lit(e)) for e in exponents]


def _entropies(sizes: DataFrame, exponents: list[float]) -> list[float]:
    weights = _powers(exponents)
    r = _sums(sizes, [x for w in weights for x in (F.sum(w), F.sum(w * F.log(w)))])
    return [math.log(z) - wl / z for z, wl in zip(r[::2], r[1::2], strict=True)]


def _repeats(sizes: DataFrame, exponents: list[float], budget: int) -> list[float]:
    """How often the most repeated source is taken under each exponent."""
    r = _sums(sizes, [x for w, v in zip(_powers(exponents), _powers([e - 1.0 for e in exponents]), strict=True) for x in (F.sum(w), F.max(v))])
    return [budget * v / z for z, v in zip(r[::2], r[1::2], strict=True)]


def source_weights(sizes: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """``sizes`` with exponent, weight and budget (tokens) of each source.

    Without ``budget`` the total is the least that takes every source whole at least once; a source is
    then repeated (largest tokens / own tokens) ** (1 - exponent) times. With ``target_entropy`` (nats)
    the exponent is the largest whose weights reach it, or 0 if none does; if that breaks
    ``max_repeats`` the limit decides. Without a target it is the smallest that keeps to the limit.
    """
    ends = sizes.agg(F.max("tokens").alias("hi"), F.min("tokens").alias("lo"), F.sum("tokens").alias("all")).first()
    if ends["hi"] is None:
        return sizes.withColumns({"exponent": F.lit(1.0), "weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    ratio = ends["hi"] / ends["lo"]

    def repeats(exponents: list[float]) -> list[float]:
        return [ratio ** (1 - e) for e in exponents] if budget is None else _repeats(sizes, exponents, budget)

    if max_repeats is not None and budget is not None and budget > max_repeats * ends["all"]:
        raise ValueError("the budget needs more repeats than the limit allows")
    exponent = bisect_exponent(lambda x: [r <= max_repeats for r in repeats(x)]) if max_repeats is not None else 0.0
    if target_entropy is not None:
        flat = 1.0 - bisect_exponent(lambda x: [h >= target_entropy for h in _entropies(sizes, [1.0 - e for e in x])])
        exponent = max(exponent, flat)
    weight = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    z = sizes.agg(F.sum(weight).alias("z")).first()["z"]
    total = float(budget) if budget is not None else ends["hi"] / (ends["hi"] ** exponent / z)
    found = sizes.withColumns({"exponent": F.lit(exponent), "weight": weight / F.lit(z)})
    tokens = F.round(F.col("weight") * F.lit(total)).cast("long")
    return found.withColumn("budget", tokens if budget is not None else F.greatest(tokens, "tokens"))


def mix_plan(docs: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document and pass that the budget takes.

    Returns doc_id, source, pass (from 0), n_tokens (words), before (tokens of its source before it),
    block (0 to the number of blocks less one), order_key (rank within a block rises with it) and
    weight. A source's last document may run over its budget. A document without words takes no
    budget and goes once where its key falls in pass 0. A null source is a source of its own; a
    source without any words is carried once with weight 0 in block 0. Rows that repeat an id are
    documents of their own. An empty table gives no rows; other columns are not carried.
    """
    plan, _ = _plan(docs, max_repeats, target_entropy, budget, block_tokens, seed, id_col, source_col, text_col)
    return plan.drop("row")


def _plan(docs: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The plan with each document's ``row``, and doc_id and row of the documents that occur more than once."""
    tokens = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(BLANKS_RE.replace("[", "[^") + "+")).cast("long")
    rows = settled(docs.select(docs[id_col].cast("long").alias("doc_id"), _row_hash(docs).alias("row"), docs[source_col].alias("source"), tokens.alias("n_tokens")), "tokens")
    sizes = settled(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "sources")
    weights = source_weights(sizes.where("tokens > 0"), max_repeats, target_entropy, budget)
    total = weights.agg(F.sum("budget").alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_tokens))
    per_source = settled(
        weights.select("source", "tokens", "documents", "weight", "budget").unionAll(sizes.where("tokens = 0").select("source", "tokens", "documents", F.lit(0.0), F.lit(0).cast("long"))).select(
            F.coalesce("source", F.lit("")).alias("s"),
            F.col("source").isNull().alias("s_null"),
            "tokens",
            "weight",
            "budget",
            F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest(F.col("tokens"), F.lit(1)))).cast("int").alias("passes"),
            F.greatest(F.lit(1), F.ceil(F.col("budget") / F.lit(blocks))).cast("long").alias("per_block"),
            F.ceil(F.lit(_KEYS) / F.ceil(F.col("documents") / F.lit(_SLICE_DOCS))).cast("long").alias("slice_keys"),
        ),
        "weights",
    )
    keyed = rows.select("doc_id", "row", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "n_tokens")
    passes = keyed.join(per_source, ["s", "s_null"]).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    passes = passes.where("pass = 0 OR n_tokens > 0")
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), "s", F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    passes = passes.withColumn("order_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn("slice", F.expr("order_key div slice_keys"))
    place = ["s", "s_null", "pass", "slice"]
    sums = passes.groupBy(*place).agg(F.sum("n_tokens").alias("in_slice"))
    ahead = sums.withColumn("ahead", F.sum("in_slice").over(Window.partitionBy("s", "s_null", "pass").orderBy("slice")) - F.col("in_slice")).drop("in_slice")
    within = Window.partitionBy(*place).orderBy("order_key", "doc_id", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, -1)
    dealt = passes.join(ahead, place).withColumn("before", F.col("pass") * F.col("tokens") + F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    taken = dealt.where("before < budget OR budget = 0 OR n_tokens = 0")
    block = F.least(F.expr("before div per_block"), F.lit(blocks - 1).cast("long"))
    repeated = rows.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "row")
    found = taken.select("doc_id", "row", F.when(~F.col("s_null"), F.col("s")).alias("source"), "pass", "n_tokens", "before", block.alias("block"), "order_key", "weight")
    return found, repeated


def _row_hash(docs: DataFrame):
    """A hash that equal rows share and no others."""
    whole = F.struct(*[F.to_json(docs[c]) if "map<" in kind or kind == "variant" else docs[c] for c, kind in docs.dtypes])
    nulls = F.concat(*[F.when(docs[c].isNull(), "1").otherwise("0") for c in docs.columns])  # a hash passes over nulls
    return F.xxhash64(whole, nulls)


def mix_sources(docs: DataFrame, partitions: int, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of a mix in the order of its blocks, once for each pass that takes them; columns unchanged.

    Rows that repeat an id are documents of their own, and each goes as often as the plan takes it.
    Rows that are equal in all columns can't be told apart and are taken as often as all of them
    together. Null ids, sources and texts are kept. An empty table gives no rows.
    """
    plan, counts = _plan(docs, id_col=id_col, **options)
    plan = plan.select(F.col("doc_id").alias("plan_of"), F.col("row").alias("plan_row"), "block", "order_key")
    again = counts.select(F.col("doc_id").alias("again_of"), F.col("row").alias("again_row"))
    keyed = docs.select(docs[id_col].cast("long").alias("of"), _row_hash(docs).alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    same = F.col("of").eqNullSafe(F.col("again_of")) & (F.col("row") == F.col("again_row"))
    alone = keyed.join(again, same, "left_anti")
    one = keyed.join(again, same, "left_semi").groupBy("of", "row").agg(F.first("whole").alias("whole"))  # of equal rows one
    found = alone.unionAll(one).join(plan, F.col("of").eqNullSafe(F.col("plan_of")) & (F.col("row") == F.col("plan_row")))
    return found.repartitionByRange(partitions, "block", "order_key").sortWithinPartitions("block", "order_key").select("whole.*")
