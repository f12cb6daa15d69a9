"""Mixing sources to target weights, in DataFrame operations.

Token shares ``p`` become weights ``p**t / sum(p**t)``. The exponent ``t`` is bisected (63 interior points,
six bisections, in each Spark job) to the largest value whose weights still reach a target entropy, or to
the smallest whose sources repeat no more than a limit. Weights times the token budget give each source
its tokens, realised as block permutations: a source's documents are dealt into hash blocks; every epoch
orders blocks and rows by a hash of the epoch; whole epochs keep everything and the last one keeps the
rows before the remaining budget. Sums run over blocks and inside blocks, so a hot source never meets in
one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Target entropy as a share of the greatest possible, rows aimed at in a block, and the most copies.
ENTROPY = 0.97
BLOCK_ROWS = 2048
MAX_REPEATS = 4.0
SEED = "mix"
STEPS = 5
#: Parts of the rows that share a doc_id or have none, by the digest of their text, so that they don't meet in one task.
SALTS = 4096


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _salt(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")


def source_shares(rows: DataFrame) -> DataFrame:
    """``source, tokens, docs, ln_p`` of every source with tokens; a null source is a source named ''."""
    per = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")
    per = materialize(per, "sources")
    total = per.agg(F.sum("tokens")).first()[0] or 1
    return per.select("source", "tokens", "docs", F.log(F.col("tokens") / F.lit(total)).alias("ln_p"))


def bisect_exponent(shares: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights meet the target; 0 (uniform) if none does.

    Entropy falls as the exponent grows, and so the rule for entropy is ``H >= entropy * ln(sources)``. Repeats of
    the rarest source fall as it grows: the rule is the smallest exponent with ``w / p <= max_repeats``, at
    a budget of the tokens there are.
    """
    low, high, found = 0.0, 1.0, None
    for _ in range(STEPS):
        grid = [low + (high - low) * i / 64 for i in range(65)]
        t = shares.select("ln_p", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "t"))
        z = t.groupBy("i", "t").agg(F.sum(F.exp(F.col("t") * F.col("ln_p"))).alias("z"), F.sum(F.exp(F.col("t") * F.col("ln_p")) * F.col("t") * F.col("ln_p")).alias("zl"), F.max((F.col("t") - 1) * F.col("ln_p")).alias("top"), F.count("*").alias("s"))
        h = z.select("i", (F.log("z") - F.col("zl") / F.col("z")).alias("h"), (F.col("top") - F.log("z")).alias("rep"), "s").orderBy("i").collect()
        if entropy is not None:
            good = [r["i"] for r in h if r["h"] >= entropy * math.log(r["s"]) - 1e-12]
            if not good:
                return 0.0
            i = max(good)
            low, high, found = grid[i], grid[min(64, i + 1)], grid[i]
        else:
            good = [r["i"] for r in h if r["rep"] <= math.log(max_repeats) + 1e-12]
            if not good:
                return 1.0
            i = min(good)
            low, high, found = grid[max(0, i - 1)], grid[i], grid[i]
        if low == high:
            break
    return found


def mixing_plan(docs: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, copy, source, tokens, epoch, block, position`` - a row for each time a document is used.

    ``position`` orders a source's rows within an epoch, from 1. ``budget``: tokens of the mixture (default: those
    of the input). Tokens are words. Documents without words have weight 0 and are never used; a null source
    counts as ''. With both ``entropy`` and ``max_repeats``, the exponent is the larger of the two answers, so no
    source repeats beyond the limit. ``copy`` tells
    rows that share a doc_id (or have none) apart, by the digest of their text; repeated rows are used like different rows.
    ``budget`` 0: no rows.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.cast("bigint").alias("tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    copy = F.row_number().over(Window.partitionBy(_name(F.col("doc_id")), _salt("digest")).orderBy("digest"))
    rows = materialize(rows.withColumn("copy", (copy.cast("bigint") - 1) * SALTS + _salt("digest")).where("tokens > 0"), "tokens")
    shares = source_shares(rows)
    if not shares.head(1):
        return rows.select("doc_id", "copy", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("position"))
    answers = [bisect_exponent(shares, entropy)] if entropy is not None else []
    answers += [bisect_exponent(shares, None, max_repeats)] if max_repeats is not None else []
    t = max(answers)
    z = shares.agg(F.sum(F.exp(F.lit(t) * F.col("ln_p"))).alias("z"), F.sum("tokens").alias("total")).first()
    goal = F.round(F.exp(F.lit(t) * F.col("ln_p")) / F.lit(z["z"]) * F.lit(float(z["total"] if budget is None else budget))).cast("bigint")
    plan = shares.select("source", "docs", goal.alias("goal"), (goal / F.col("tokens")).cast("bigint").alias("full"), (goal % F.col("tokens")).alias("rest"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_ROWS)).cast("bigint")
    key = _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    placed = rows.join(plan, "source").withColumns({"key": key, "blocks": blocks}).withColumn("block", F.conv(F.substring("key", 1, 12), 16, 10).cast("bigint") % F.col("blocks"))
    used = placed.select("doc_id", "copy", "source", "tokens", "key", "block", "full", "rest", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch"))
    used = used.withColumn("order", _hash(F.col("epoch").cast("string"), F.col("key")))
    sizes = used.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_docs"))
    turn = Window.partitionBy("source", "epoch").orderBy(_hash(F.col("epoch").cast("string"), F.col("block").cast("string")), "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", "epoch", "block", F.coalesce(F.sum("block_tokens").over(turn), F.lit(0)).alias("before"), F.coalesce(F.sum("block_docs").over(turn), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "epoch", "block").orderBy("order", "doc_id", "copy")
    out = used.withColumns({"n": F.row_number().over(within), "own": F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))}).join(offsets, ["source", "epoch", "block"])
    fits = (F.col("epoch") < F.col("full")) | (F.col("before") + F.col("own") <= F.col("rest"))
    return out.where(fits).select("doc_id", "copy", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), "block", (F.col("ahead") + F.col("n")).cast("bigint").alias("position"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, all columns, each row as often as the plan uses it (see ``mixing_plan``).

    Rows that share a doc_id, or have none, are numbered by the digest of their text and matched by number.
    """
    numbered = docs.withColumn("__k", _name(F.col("doc_id"))).withColumn("__digest", F.md5(F.coalesce("text", F.lit(""))))
    numbered = numbered.withColumn("__salt", _salt("__digest"))
    copy = F.row_number().over(Window.partitionBy("__k", "__salt").orderBy("__digest"))
    numbered = numbered.withColumn("__copy", (copy.cast("bigint") - 1) * SALTS + F.col("__salt"))
    plan = mixing_plan(docs, **options).withColumn("__k", _name(F.col("doc_id"))).groupBy("__k", "copy").agg(F.count("*").alias("uses"))
    uses = plan.groupBy("__k", (F.col("copy") % SALTS).alias("__salt")).agg(F.map_from_entries(F.collect_list(F.struct("copy", "uses"))).alias("__uses"))
    out = numbered.join(uses, ["__k", "__salt"]).withColumn("__n", F.try_element_at("__uses", F.col("__copy"))).where("__n > 0")
    return out.withColumn("__use", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).select(docs.columns)
