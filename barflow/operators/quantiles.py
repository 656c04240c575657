"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import LAYOUT, Layout
from barflow.operators.series import Measure, exclusive_scan, join_per_key
from barflow.session import cut_lineage

#: Parts that a bracket of values is cut into at a time.
SPLITS = 255


def exact_quantiles(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    points: Sequence[float],
    layout: Layout = LAYOUT,
) -> DataFrame:
    """``(keys, point_id, q)``: linear-interpolation quantiles, one row per key and point.

    A wanted rank lies in a bracket of values, at first the whole group. Again and again a sketch cuts the brackets, the
    rows of each part are counted with a map-side combine, and only the parts with a wanted rank are kept as (value, count),
    until every bracket has at most ``layout.chunk_rows`` distinct values. These are sorted, a bracket in a task. A bracket of
    more values than that always has parts of its own, so each pass narrows it.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("group by at least one column; add a constant one for the whole table")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    at = F.col("_t.p") * (F.col("_total") - 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("point_id"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)])
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    low = F.floor("_at").cast("bigint")
    targets = totals.withColumn("_t", F.explode(wanted)).withColumn("_at", at).select(
        *keys,
        F.lit("").alias("_bracket"),
        F.col("_t.point_id").alias("point_id"),
        (F.col("_at") - low).alias("_frac"),
        F.explode(F.array(low, F.least(low + 1, F.col("_total") - 1))).alias("_rank"),
    )
    targets = cut_lineage(targets)
    held = rows.withColumns({"_bracket": F.lit(""), "_start": F.lit(0).cast("bigint"), "n": F.lit(1).cast("bigint")})
    while True:
        targets, held = _narrow(targets, held, keys, layout)
        largest = held.groupBy(*keys, "_bracket").count().agg(F.max("count")).first()[0] or 0
        if largest <= layout.chunk_rows:
            break
    w = Window.partitionBy(*keys, "_bracket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_to", F.col("_start") + F.sum("n").over(w)).withColumn("_from", F.col("_to") - F.col("n"))
    hit = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    found = targets.join(ranked, [*keys, "_bracket"]).where(hit)
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return found.groupBy(*keys, "point_id").agg((low + (high - low) * F.max("_frac")).alias("q"))


def _narrow(targets: DataFrame, held: DataFrame, keys: list[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """One pass: targets with the part their rank lies in as bracket, and the (value, count) rows of these parts."""
    group = [*keys, "_bracket"]
    grid = F.array(*[F.lit((k + 1) / (SPLITS + 1)) for k in range(SPLITS)])
    splits = held.groupBy(*group).agg(F.array_distinct(F.percentile_approx("_v", grid, 10_000)).alias("_splits"))
    placed = join_per_key(held, splits, group, "_v").withColumn("_part", F.size(F.filter("_splits", lambda s: s <= F.col("_v"))).cast("bigint")).drop("_splits")
    sizes = placed.groupBy(*group, "_part").agg(F.sum("n").alias("n"), F.first("_start").alias("_start"))
    before = exclusive_scan(sizes.select(*group, "_part", "n"), group, "_part", [Measure("n", "sum")], layout, levels=1)
    start = F.col("_start") + F.coalesce("c_n", F.lit(0))
    parts = sizes.join(before, [*group, "_part"]).select(*group, "_part", start.alias("_first"), (start + F.col("n")).alias("_stop"))
    name = F.concat_ws(".", "_bracket", F.col("_part").cast("string"))
    located = cut_lineage(
        targets.join(parts, group).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_stop"))).withColumn("_within", name)
    )
    wanted = located.select(*group, "_part", "_within", "_first").distinct()
    # at most two parts a point: their one row each is copied, the rows of a hot part stay dealt
    kept = join_per_key(placed.drop("_start"), wanted, [*group, "_part"], "_v")
    merged = kept.groupBy(*keys, F.col("_within").alias("_bracket"), F.col("_first").alias("_start"), "_v").agg(F.sum("n").alias("n"))
    moved = located.select(*keys, F.col("_within").alias("_bracket"), "point_id", "_frac", "_rank")
    return moved, cut_lineage(merged)
