"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are the token shares raised to an exponent and normalised:
exponent 1 keeps the shares, 0 gives every source the same weight.  The
largest exponent in [0, 1] that meets the targets is found by bisection:

* ``min_entropy``: the entropy of the weights, as a fraction of ``ln(sources)``;
* ``max_repeats``: no source may be read more than so many times.

Flattening raises entropy but also the repeats of small sources, so the
exponent is the largest that reaches the entropy, then raised as far as the
repetition limit asks (the limit wins; at exponent 1 no source is repeated
beyond the budget's share of the corpus).

Weights become rows by permuted blocks: in every pass over a source its
documents are dealt by a digest of (seed, source, pass, document) to blocks,
the blocks are taken in order while the pass's token budget lasts, and in the
block where it runs out documents are taken in digest order while the tokens
before them are below what is left.  Only block totals are summed in order, first those of
chunks of ``CHUNK`` blocks, then inside the chunk where the budget ends, and only the
one block of a pass that is cut orders documents,
so a source with a third of all rows stays spread over many tasks.  Texts are
never shuffled but those of the cut blocks.

Bisection runs over the table of sources (one row each), eight halvings for
each pass over it.

Defined cases: a null text has no tokens and such documents are never taken
(they hold nothing); a null source is a source of its own; equal rows have
equal draws and stay together; extra columns are carried unchanged; an
empty table, or one without tokens, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import keep, words

HALVINGS = 8
ROUNDS = 3  # 24 halvings: the exponent to 6e-8, then rounded
DIGITS = 6
BLOCK_TOKENS = 100_000
#: blocks whose sizes are summed in order by one task
CHUNK = 10_000
#: the table of sources and passes is broadcast up to so many (counted) rows
BROADCAST_ROWS = 100_000


def draw(*parts: Column) -> Column:
    """A value in [0, 2^60) that depends on the parts alone."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_totals(counted: DataFrame) -> DataFrame:
    """``_source, total, n, p``: tokens of every source, the number of sources, shares."""
    totals = keep(counted.groupBy("_source").agg(F.sum("_tokens").alias("total")).where("total > 0"), "mix-totals")
    whole = totals.agg(F.sum("total").alias("t"), F.count(F.lit(1)).alias("n")).first()
    return totals.withColumns({"n": F.lit(whole["n"]), "p": F.col("total") / F.lit(whole["t"])})


def _measured(totals: DataFrame, exponents: list[float], budget: int) -> list:
    """Entropy fraction and largest repeat for each exponent: one row each."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in exponents]))
    shares = totals.select("total", "n", grid.alias("a"), "p")
    powers = shares.withColumn("q", F.pow("p", "a"))
    # entropy of q/z: ln z - sum(q ln q)/z ; repeats: q/z * budget / total
    return (powers.groupBy("a").agg(
        F.max("n").alias("n"), F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("ql"),
        F.max(F.col("q") / F.col("total")).alias("top"))
        .select("a", F.when(F.col("n") > 1, (F.log("z") - F.col("ql") / F.col("z")) / F.log(F.col("n").cast("double")))
                .otherwise(1.0).alias("entropy"), (F.col("top") / F.col("z") * budget).alias("repeats"))
        .orderBy("a").collect())


def _bisect(totals: DataFrame, budget: int, good, low_is_good: bool) -> float:
    """The border between exponents for which ``good`` holds and the rest."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        steps = 1 << HALVINGS
        points = [low + (high - low) * i / steps for i in range(steps + 1)]
        rows = {r["a"]: r for r in _measured(totals, points, budget)}
        lo, hi = 0, steps
        while hi - lo > 1:  # halve over the measured points
            mid = (lo + hi) // 2
            if good(rows[points[mid]]) == low_is_good:
                lo = mid
            else:
                hi = mid
        low, high = points[lo], points[hi]
    return low if low_is_good else high


def find_exponent(totals: DataFrame, budget: int, min_entropy: float, max_repeats: float) -> float:
    ends = _measured(totals, [0.0, 1.0], budget)
    if not ends:
        return 1.0
    flat, plain = ends
    eps = 1e-9
    if plain["entropy"] >= min_entropy - eps:
        a = 1.0
    elif flat["entropy"] < min_entropy - eps:
        a = 0.0
    else:
        a = _bisect(totals, budget, lambda r: r["entropy"] >= min_entropy - eps, True)
    if a < 1.0 and _measured(totals, [a], budget)[0]["repeats"] > max_repeats + eps:
        a = max(a, 1.0 if plain["repeats"] > max_repeats + eps
                else _bisect(totals, budget, lambda r: r["repeats"] <= max_repeats + eps, False))
    return round(a, DIGITS)


def _dealt(tagged: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents once for each pass over their source, with their block."""
    plan = plan.withColumnRenamed("_source", "_plan")
    joined = tagged.join(plan, tagged["_source"].eqNullSafe(plan["_plan"])).drop("_plan")
    deal = draw(F.lit(seed), F.col("_source"), F.col("_pass"), F.col("_id"), F.lit("block"))
    return joined.withColumn("_block", deal % F.col("n_blocks"))


def mix(docs: DataFrame, budget: int | None = None, min_entropy: float = 0.95, max_repeats: float = 2.0,
        seed: int = 1, source: str = "source", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture as rows of ``docs`` with ``_pass`` (1 for the first copy),
    ``_block`` and ``_weight``.  ``budget``: tokens of the mixture, by default
    those of the corpus."""
    names = docs.columns
    tagged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(source).alias("_source"),
        F.size(words(F.col("text"))).cast("bigint").alias("_tokens"),
        F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.md5(F.coalesce("text", F.lit("")))).alias("_id"),
    ).where("_tokens > 0")
    # the texts are read twice: here for their digests and tokens, and for the rows at last
    counted = keep(tagged.drop("_doc"), "mix-counted")
    totals = source_totals(counted)
    if budget is None:
        budget = totals.agg(F.sum("total")).first()[0] or 0
    exponent = find_exponent(totals, budget, min_entropy, max_repeats)
    weights = totals.select("_source", "total", F.pow("p", F.lit(exponent)).alias("q"))
    z = weights.agg(F.sum("q")).first()[0] or 1.0
    plan = weights.select(
        "_source", "total", F.round(F.col("q") / F.lit(z), 9).alias("_weight"),
    ).withColumn("goal", F.floor(F.col("_weight") * F.lit(budget)).cast("bigint"))
    plan = plan.select(
        "_source", "_weight", F.greatest(F.ceil(F.col("total") / F.lit(block_tokens)), F.lit(1)).cast("bigint").alias("n_blocks"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.expr("(goal - 1) div total")),
            lambda k: F.least(F.col("total"), F.col("goal") - k * F.col("total")))).alias("_k", "left")
    ).withColumn("_pass", F.col("_k") + 1).where("left > 0").drop("_k")
    passes = plan.groupBy().agg(F.count(F.lit(1))).first()[0]
    if passes <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    rows = _dealt(counted, plan, seed)
    blocks = rows.groupBy("_source", "_pass", "left", "_block").agg(F.sum("_tokens").alias("size"))
    blocks = keep(blocks.withColumn("_chunk", F.expr(f"_block div {CHUNK}")), "mix-blocks")
    # the block in which a pass runs out of budget, in two levels: first among chunks of
    # blocks, then among the blocks of one chunk, so no task sorts all blocks of a hot source
    key = ["_source", "_pass"]

    def first_beyond(sizes: DataFrame, step: str, size: str, left: str) -> DataFrame:
        before = F.coalesce(F.sum(size).over(Window.partitionBy(*key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (sizes.withColumn("_room", F.col(left) - before).where(F.col(size) > F.col("_room"))
                .groupBy(*key).agg(F.min(F.struct(F.col(step).alias("at"), F.col("_room").alias("room"))).alias("c"))
                .select(F.col("_source").alias("_s"), F.col("_pass").alias("_p"), "c.at", "c.room"))

    chunk = first_beyond(blocks.groupBy(*key, "left", "_chunk").agg(F.sum("size").alias("bulk")), "_chunk", "bulk", "left")
    inside = blocks.join(chunk, blocks["_source"].eqNullSafe(chunk["_s"]) & (blocks["_pass"] == chunk["_p"]) & (blocks["_chunk"] == chunk["at"]))
    cuts = first_beyond(inside.select(*key, "_block", "size", "room"), "_block", "size", "room").withColumnRenamed("at", "cut")
    plan = plan.join(cuts, plan["_source"].eqNullSafe(cuts["_s"]) & (plan["_pass"] == cuts["_p"]), "left").drop("_s", "_p")
    if passes <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    taken = _dealt(tagged, plan, seed)
    whole = taken.where("cut is null or _block < cut")
    in_block = Window.partitionBy("_source", "_pass").orderBy("_draw", "_id").rowsBetween(Window.unboundedPreceding, -1)
    part = (taken.where("_block = cut")
            .withColumn("_draw", draw(F.lit(seed), F.col("_source"), F.col("_pass"), F.col("_id"), F.lit("order")))
            .withColumn("_run", F.coalesce(F.sum("_tokens").over(in_block), F.lit(0)))
            .where("_run < room"))
    cols = ["_doc", "_pass", "_block", "_weight", "_tokens"]
    return whole.select(*cols).unionByName(part.select(*cols)).select("_doc.*", "_pass", "_block", "_weight", "_tokens")
