"""Two-stage retrieval scoring (RET1-RET10).

Queries attend to the memory of their own group (an example / batch row):
stage 1 scores document summaries, stage 2 scores the tokens of the chosen
documents with a document-score bias.  Learned projections are outside:
query, key and value vectors arrive already in the scoring space.

Scale notes: pairs are formed by an equi-join on the group key (no cross
product); the number of query positions per group is bounded by the model,
so pairs grow linearly with the documents.  A group holding a large share
of documents is split by AQE's skew-join handling.  Softmax uses two
aggregates (max, then sum of exponentials) joined back instead of a window
over the group, so no task has to hold a whole group.  Vector sums are
``posexplode`` + partial ``sum`` per element (map-side combined).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import checkpoint_dir

EPS = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def head_slice(v: Column, head: Column | int, head_dim: int) -> Column:
    h = head if isinstance(head, Column) else F.lit(head)
    return F.slice(v, h * head_dim + 1, head_dim)


def coarse_logits(queries: DataFrame, docs: DataFrame, n_heads: int, head_dim: int, n_kv_heads: int | None = None,
                  group: str = "group_id") -> DataFrame:
    """RET1 + RET2: ``q_h . k_{h div rep} / sqrt(head_dim)`` per query
    position, head and document of the same group.

    ``queries``: group, query_id, pos, q;  ``docs``: group, doc_id, key.
    """
    kv = n_kv_heads or n_heads
    rep = n_heads // kv
    pairs = queries.join(docs.select(group, "doc_id", "key"), group)
    logits = F.transform(F.sequence(F.lit(0), F.lit(n_heads - 1)), lambda h: dot(
        head_slice(F.col("q"), h, head_dim), head_slice(F.col("key"), F.floor(h / rep).cast("int"), head_dim))
        / math.sqrt(head_dim))
    return pairs.select(group, "query_id", "pos", "doc_id", F.posexplode(logits).alias("head", "logit"))


#: parts that a softmax group is dealt to, so that a hot one spans many tasks
SOFTMAX_PARTS = 16


def softmax(df: DataFrame, keys: list[str], logit: str = "logit", out: str = "p",
            parts: int = SOFTMAX_PARTS) -> DataFrame:
    """RET3: softmax of ``logit`` within ``keys``.

    Masked entries are simply absent rows.  Maximum and sum of a group are
    aggregates; rows meet them in ``parts`` parts of their group (dealt by a hash
    of the row), and each part sums on its own first, so a group that holds
    most of the rows is never one task.  The small side has ``parts`` rows per
    group."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    on = [*keys, "_part"]

    def spread(t: DataFrame) -> DataFrame:
        return t.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    mx = df.groupBy(*keys).agg(F.max(logit).alias("_m"))
    e = (df.withColumn("_part", part).join(spread(mx), on)
         .withColumn("_e", F.exp(F.col(logit) - F.col("_m"))))
    s = e.groupBy(*on).agg(F.sum("_e").alias("_s")).groupBy(*keys).agg(F.sum("_s").alias("_s"))
    return e.join(spread(s), on).withColumn(out, F.col("_e") / F.col("_s")).drop("_m", "_e", "_s", "_part")


def doc_scores(probs: DataFrame, group: str = "group_id") -> DataFrame:
    """RET4: mean probability over heads and positions per (query, doc)."""
    return probs.groupBy(group, "query_id", "doc_id").agg(F.avg("p").alias("score"))


def weighted_sum(probs: DataFrame, values: DataFrame, keys: list[str], item: str, head_dim: int,
                 n_heads: int, n_kv_heads: int | None = None, value: str = "value") -> DataFrame:
    """RET5: ``sum_i p_i * v_i`` per ``keys`` (e.g. query, pos, head), the
    value head chosen like the key head: one partial sum for each of the
    ``head_dim`` elements, as columns of one aggregate."""
    rep = n_heads // (n_kv_heads or n_heads)
    j = probs.join(values.select(item, value), item)
    first = F.floor(F.col("head") / rep).cast("int") * head_dim
    sums = [F.sum(F.get(F.col(value), first + i) * F.col("p")).alias(f"_s{i}") for i in range(head_dim)]
    return j.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_s{i}") for i in range(head_dim)]).alias("context"))


def top_k(scores: DataFrame, k: int, part: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """RET6: the ``k`` best per ``part`` (WindowGroupLimit), with scores
    renormalised over the survivors (a window over at most ``k`` rows)."""
    w = Window.partitionBy(*part).orderBy(F.col(score).desc(), F.col(tie))
    top = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("renorm", F.col(score) / F.sum(score).over(Window.partitionBy(*part)))


#: leading coordinates whose signs name a document's block
BLOCK_BITS = 4


def pruned_top_k(queries: DataFrame, docs: DataFrame, k: int, dim: int, group: str = "group_id", bits: int = BLOCK_BITS,
                 slack: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """RET6 without scoring every pair: ``(top, stats)``.

    Documents of a group lie in blocks by the signs of their first ``bits`` coordinates
    (less the group's mean).  A block has a centroid and a radius, so no key in it scores above ``q.c + |q| r``.
    Blocks are taken by falling bound until they hold ``k`` documents; the ``k``-th
    score there bounds the answer from below, and blocks whose bound is lower are never scored.  The
    rows are those of scoring everything.  Scores are ``q.k / sqrt(dim)``, ``renorm`` is the softmax over the
    ``k`` taken.  ``stats``: ``pairs`` of queries and documents, and how many were scored."""
    key = F.col("key")
    mean = docs.groupBy(group).agg(*[F.avg(F.get(key, F.lit(i))).alias(f"_m{i}") for i in range(bits)])
    sign = sum((F.when(F.get(key, F.lit(i)) >= F.col(f"_m{i}"), 1 << i).otherwise(0) for i in range(bits)), F.lit(0))
    placed = docs.select(group, "doc_id", "key").join(mean, group).select(group, "doc_id", "key", sign.alias("_block"))
    on = [group, "_block"]
    centre = placed.groupBy(*on).agg(F.array(*[F.avg(F.get(key, F.lit(i))) for i in range(dim)]).alias("_c"), F.count(F.lit(1)).alias("_n"))
    gap = F.zip_with("key", "_c", lambda a, b: a - b)
    radius = placed.join(centre, on).groupBy(*on).agg(F.max(dot(gap, gap)).alias("_r2"), F.first("_c").alias("_c"), F.first("_n").alias("_n"))
    checkpoint_dir(docs.sparkSession)
    blocks = radius.checkpoint(eager=True)
    bound = (dot(F.col("q"), F.col("_c")) + F.sqrt(dot(F.col("q"), F.col("q")) * F.col("_r2"))) / math.sqrt(dim) + slack
    part = [group, "query_id", "pos"]
    order = Window.partitionBy(*part).orderBy(F.desc("_bound"), "_block").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** bits rows
    asked = queries.join(blocks, group).select(*part, "q", "_block", "_n", bound.alias("_bound"))
    asked = asked.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(placed, on).select(*part, "doc_id", (dot(F.col("q"), F.col("key")) / math.sqrt(dim)).alias("score"))

    best = Window.partitionBy(*part).orderBy(F.desc("score"), "doc_id")

    def first_k(scores: DataFrame) -> DataFrame:
        return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    seed = first_k(scored(asked.where(F.col("_before") < k))).checkpoint(eager=True)
    least = seed.groupBy(*part).agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_found"))
    rest = asked.where(F.col("_before") >= k).join(least, part).where(F.col("_bound") >= F.col("_least"))
    top = first_k(seed.drop("rank").unionByName(scored(rest.select(*part, "q", "_block"))))
    whole = Window.partitionBy(*part)
    top = top.withColumn("_e", F.exp(F.col("score") - F.max("score").over(whole)))
    top = top.withColumn("renorm", F.col("_e") / F.sum("_e").over(whole)).drop("_e")
    read = (F.col("_before") < k) | (F.col("_bound") >= F.col("_least"))
    stats = asked.join(least, part, "left").agg(F.sum("_n").alias("pairs"), F.sum(F.when(read, F.col("_n"))).alias("scored"))
    return top, stats


def fine_logits(queries: DataFrame, tokens: DataFrame, scores: DataFrame, n_heads: int, head_dim: int,
                n_kv_heads: int | None = None, group: str = "group_id", score: str = "score") -> DataFrame:
    """RET7 (logits): token logits plus ``log(doc score + 1e-6)``.

    ``tokens``: group, doc_id, tok_pos, key, value; ``scores``: group,
    query_id, doc_id, score (all documents, or only the RET6 survivors).
    """
    kv = n_kv_heads or n_heads
    rep = n_heads // kv
    qt = queries.join(scores.select(group, "query_id", "doc_id", F.col(score).alias("_ds")), [group, "query_id"])
    pairs = qt.join(tokens.select(group, "doc_id", "tok_pos", "key"), [group, "doc_id"])
    logits = F.transform(F.sequence(F.lit(0), F.lit(n_heads - 1)), lambda h: dot(
        head_slice(F.col("q"), h, head_dim), head_slice(F.col("key"), F.floor(h / rep).cast("int"), head_dim))
        / math.sqrt(head_dim) + F.log(F.col("_ds") + EPS))
    return pairs.select(group, "query_id", "pos", "doc_id", "tok_pos",
                        F.posexplode(logits).alias("head", "logit"))


def top_m_tokens(probs: DataFrame, m: int, part: list[str]) -> DataFrame:
    """RET8: the ``m`` most attended tokens per ``part``."""
    w = Window.partitionBy(*part).orderBy(F.col("p").desc(), F.col("doc_id"), F.col("tok_pos"))
    return probs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m)


def gated_blend(base: Column, context: Column, gate: Column | float) -> Column:
    """RET10: ``base + sigmoid(gate) * context``."""
    g = gate if isinstance(gate, Column) else F.lit(float(gate))
    sig = 1.0 / (1.0 + F.exp(-g))
    return F.zip_with(base, context, lambda a, b: a + sig * b)


def concat_heads(ctx: DataFrame, keys: list[str], n_heads: int) -> DataFrame:
    """Per-head context vectors -> one vector per ``keys`` in head order
    (``n_heads`` rows per group)."""
    return ctx.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("head", "context"))).alias("_h")) \
              .select(*keys, F.flatten(F.transform("_h", lambda x: x["context"])).alias("context"))


def coarse_round(queries: DataFrame, docs: DataFrame, n_heads: int, head_dim: int, n_kv_heads: int | None = None,
                 group: str = "group_id", checkpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """RET1-RET5 in one call: ``(doc_scores, context per query position)``.  Both read the
    probabilities: with ``checkpoint`` they are kept and computed once."""
    lg = coarse_logits(queries, docs, n_heads, head_dim, n_kv_heads, group)
    pr = softmax(lg, [group, "query_id", "pos", "head"])
    if checkpoint:
        checkpoint_dir(pr.sparkSession)
        pr = pr.checkpoint(eager=True)
    sc = doc_scores(pr, group)
    vals = docs.select(F.struct(group, "doc_id").alias("_item"), "value")
    pr2 = pr.withColumn("_item", F.struct(group, "doc_id"))
    ctx = weighted_sum(pr2, vals, [group, "query_id", "pos", "head"], "_item", head_dim, n_heads, n_kv_heads)
    return sc, concat_heads(ctx, [group, "query_id", "pos"], n_heads)


def rounds(queries: DataFrame, docs: DataFrame, n_rounds: int, weight: float, n_heads: int, head_dim: int,
           n_kv_heads: int | None = None, group: str = "group_id", checkpoint: bool = True) -> DataFrame:
    """RET9: round r's context updates the query of round r+1
    (``q' = q + weight * context``); document scores are kept per round.
    Each round's probabilities and queries are checkpointed: nothing is computed twice
    and the lineage stays short."""
    out = None
    q = queries
    for r in range(n_rounds):
        sc, ctx = coarse_round(q, docs, n_heads, head_dim, n_kv_heads, group, checkpoint and r + 1 < n_rounds)
        sc = sc.withColumn("round", F.lit(r))
        out = sc if out is None else out.unionByName(sc)
        if r + 1 < n_rounds:
            q = q.join(ctx, [group, "query_id", "pos"]).select(
                group, "query_id", "pos",
                F.zip_with("q", "context", lambda a, b: a + F.lit(weight) * b).alias("q"))
            if checkpoint:
                q = q.checkpoint(eager=True)
    return out
