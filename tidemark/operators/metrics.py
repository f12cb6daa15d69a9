"""Counters, latency distributions and quorum statistics.

Percentiles are exact and follow three index rules. Samples are first counted by value or bucket (partial
aggregation), so windows only run over distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bit_bucket(us: Column) -> Column:
    """Bucket of a latency: its bit length (0 for 0)."""
    return F.when(us == 0, 0).otherwise(F.length(F.bin(us))).cast("int")


def power_histogram(samples: DataFrame, us: str) -> DataFrame:
    """``bucket, upper, n, cum, p50, p95, p99``: percentiles are the upper bound of the first bucket that reaches floor(total p / 100)."""
    h = samples.groupBy(bit_bucket(F.col(us)).alias("bucket")).agg(F.count("*").alias("n"))
    h = h.withColumn("upper", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bucket")))
    order = Window.orderBy("bucket")  # at most 64 rows
    whole = Window.partitionBy(F.lit(1))
    h = h.withColumn("cum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(whole))
    pick = {f"p{p}": F.min(F.when(F.col("cum") >= F.expr(f"total * {p} div 100"), F.col("upper"))).over(whole) for p in (50, 95, 99)}
    return h.withColumns(pick).select("bucket", "upper", "n", "cum", *pick)


def exact_percentiles(samples: DataFrame, by: str, us: str) -> DataFrame:
    """Per ``by``: the sorted latency at floor((n - 1) p), count, integer mean, least and greatest."""
    h = samples.groupBy(by, us).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    h = h.withColumn("cum", F.sum("c").over(w.orderBy(us).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("cum") > F.expr(f"(n - 1) * {p} div 100"), F.col(us))).alias(f"p{p}")
    total = F.sum(F.col(us) * F.col("c"))
    return h.groupBy(by).agg(F.max("n").alias("n"), *(at(p) for p in (50, 95, 99)), F.expr(f"sum({us} * c) div sum(c)").alias("avg_us"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), total.alias("total_us"))


def fixed_histogram(samples: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """``bucket, n, cum, p50, p95, p99`` of equal [min, max) buckets and an overflow; percentiles are bucket midpoints."""
    width = (high - low) / buckets
    b = F.when(F.col(value) >= high, buckets).otherwise(F.floor((F.col(value) - low) / width)).cast("int")
    h = samples.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    h = h.withColumn("cum", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(whole))
    mid = F.lit(low) + (F.col("bucket") + 0.5) * width
    pick = {f"p{p}": F.min(F.when(F.col("cum") >= F.expr(f"total * {p} div 100"), mid)).over(whole) for p in (50, 95, 99)}
    return h.withColumns(pick).select("bucket", "n", "cum", *pick)


def _answers(outcomes: DataFrame) -> DataFrame:
    """A row for each task and moment: the task's ``total``, and the good answers ``upto`` then. Answers are counted by moment first."""
    h = outcomes.groupBy("task_id", "at").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
    w = Window.partitionBy("task_id")
    upto = F.sum("good").over(w.orderBy(F.asc_nulls_last("at")).rowsBetween(Window.unboundedPreceding, 0))
    return h.select("task_id", "at", upto.alias("upto"), F.sum("n").over(w).alias("total"))


def quorum(outcomes: DataFrame) -> DataFrame:
    """Per task of ``task_id, ok, at``: counts, success rate, strategies, the first answer and the moment of majority."""
    need = F.expr("total div 2") + 1
    out = _answers(outcomes).groupBy("task_id").agg(F.max("total").alias("total"), F.max("upto").alias("success"), F.min("at").alias("first_at"), F.min(F.when(F.col("upto") >= need, F.col("at"))).alias("majority_at"))
    return out.select(
        "task_id", "total", "success", (F.col("total") - F.col("success")).alias("failed"), ratio(F.col("success"), F.col("total")).alias("success_rate"),
        (F.col("success") >= need).alias("majority_ok"), (F.col("success") == F.col("total")).alias("all_ok"), "first_at", "majority_at",
    )


def pending(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Per task of ``task_id, expected``: the answers of ``task_id`` so far, those still missing and whether all are in."""
    n = answers.groupBy("task_id").agg(F.count("*").alias("n"))
    out = tasks.join(n, "task_id", "left").withColumn("answered", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.select("task_id", "expected", "answered", F.greatest(F.col("expected") - F.col("answered"), F.lit(0).cast("bigint")).alias("pending"), (F.col("answered") >= F.col("expected")).alias("complete"))


def trips(calls: DataFrame, least: int = 10, share: float = 0.5, streak: int = 5) -> DataFrame:
    """Per peer of ``peer, seq, failed``: whether a circuit breaker trips by failure share or by consecutive failures."""
    w = Window.partitionBy("peer").orderBy("seq")
    runs = calls.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("peer", "run").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    out = runs.groupBy("peer").agg(F.sum("n").alias("requests"), F.sum("bad").alias("failures"), F.max("bad").alias("longest_streak"))
    return out.withColumn("tripped", ((F.col("requests") >= least) & (F.col("failures") >= share * F.col("requests"))) | (F.col("longest_streak") >= streak))


def strategies(outcomes: DataFrame) -> DataFrame:
    """Per task of ``task_id, ok`` and strategy (all, majority, none): whether the answers satisfy it."""
    n = outcomes.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("success"))
    rules = {"all": F.col("success") == F.col("total"), "majority": F.col("success") >= F.expr("total div 2 + 1"), "none": F.lit(True)}
    return n.select("task_id", F.inline(F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("passed")) for k, v in rules.items()))))


def quorum_of(outcomes: DataFrame, k: int) -> DataFrame:
    """Per task of ``task_id, ok, at``: whether ``k`` peers answered, and when the k-th did."""
    out = _answers(outcomes).groupBy("task_id").agg(F.max("total").alias("total"), F.max("upto").alias("success"), F.min(F.when(F.col("upto") >= k, F.col("at"))).alias("reached_at"))
    return out.select("task_id", "total", "success", (F.col("success") >= k).alias("reached"), "reached_at")
