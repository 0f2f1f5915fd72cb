"""Exact linear-interpolated quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is fine
for a series (bounded by the calendar) but not for a group such as "all rows of
a fold". ``grouped_quantiles`` counts equal values first, sums the counts over
slices of the value range whose number follows the group's distinct values, and
ranks only the few slices that hold a wanted position, so no task ever sees a
whole group. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_SLICE = 50_000  # distinct values that a slice holds, roughly
MOST_SPLITS = 10_000  # split points of a group; a sketch of them stays below a few MB


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column | str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a double column per entry of ``probs``."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    values = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    size = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"))
    most = size.agg(F.max("_d").alias("d")).first()["d"] or 0
    slices = max(1, min(MOST_SPLITS, -(-most // PER_SLICE)))
    if slices == 1:
        sliced = values.withColumn("_b", F.lit(0))
    else:
        steps = F.array(*[F.lit(i / slices) for i in range(1, slices)])
        splits = values.groupBy(*by).agg(F.percentile_approx("_v", steps, F.lit(20 * slices)).alias("_s"))
        sliced = values.join(splits, by).withColumn("_b", F.size(F.filter("_s", lambda s: s < F.col("_v")))).drop("_s")
    per_slice = sliced.groupBy(*by, "_b").agg(F.sum("_n").alias("_m"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    placed = per_slice.select(
        *by,
        "_b",
        "_m",
        F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"),
        F.sum("_m").over(whole).alias("_total"),
    )
    first = F.col("_before")
    last = first + F.col("_m") - 1
    wanted = F.lit(False)
    for p in probs.values():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for at in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | ((first <= at) & (last >= at))
    needed = placed.filter(wanted).drop("_m")
    running = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sliced.join(needed, [*by, "_b"]).withColumn("_end", F.col("_before") + F.sum("_n").over(running) - 1)
    start = F.col("_end") - F.col("_n") + 1
    picks, outs = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        picks += [
            F.max(F.when((start <= lo) & (F.col("_end") >= lo), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when((start <= hi) & (F.col("_end") >= hi), F.col("_v"))).alias(f"_hi_{name}"),
        ]
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((a + (b - a) * (pos - lo)).alias(name))
    picked = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    return picked.select(*keys, *outs)
