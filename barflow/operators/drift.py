"""Population stability index, two-sample and rolling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, RESEARCH, Layout
from barflow.operators.quantiles import exact_quantiles
from barflow.operators.series import LocalOp, apply_local, join_per_key

EPS = 1e-6


def quantile_points(bins: int) -> list[float]:
    return [k / bins for k in range(bins + 1)]


def bin_edges(reference: DataFrame, value: str, keys: list[str], bins: int = RESEARCH.psi_bins) -> DataFrame:
    """Distinct inner edges of the reference sample per key (the outer edges are infinite)."""
    points = quantile_points(bins)[1:-1]
    found = exact_quantiles(reference, value, keys, points)
    return found.groupBy(*keys).agg(F.array_distinct(F.array_sort(F.collect_list("q"))).alias("inner_edges"))


def bin_of(value: Column, inner: Column) -> Column:
    """Index of the half-open bin [e_k, e_k+1) that holds ``value``."""
    return F.size(F.filter(inner, lambda e: e <= value))


def psi(
    samples: DataFrame,
    value: str,
    is_reference: str,
    keys: list[str],
    bins: int = RESEARCH.psi_bins,
    eps: float = EPS,
) -> DataFrame:
    """PSI per key between rows flagged reference and the rest. An empty side gives 0."""
    edges = bin_edges(samples.where(F.col(is_reference)), value, keys, bins)
    all_keys = samples.groupBy(*keys).agg(F.lit(1).alias("_one"))
    counted = (
        join_per_key(samples.where(F.col(value).isNotNull()), edges, keys, value)
        .groupBy(*keys, bin_of(F.col(value), F.col("inner_edges")).alias("bin"))
        .agg(
            F.count_if(F.col(is_reference)).alias("p"),
            F.count_if(~F.col(is_reference)).alias("q"),
            F.max(F.size("inner_edges") + 1).alias("n_bins"),
        )
    )
    # Bins without any row carry eps on both sides and add nothing but their share of the norm.
    sums = counted.groupBy(*keys).agg(
        F.sum("p").alias("np"),
        F.sum("q").alias("nq"),
        F.max("n_bins").alias("nb"),
        F.collect_list(F.struct("p", "q")).alias("cells"),
    )
    p_norm = F.col("np") + F.col("nb") * eps
    q_norm = F.col("nq") + F.col("nb") * eps

    def term(cp: Column, cq: Column) -> Column:
        p, q = (cp + eps) / p_norm, (cq + eps) / q_norm
        return (p - q) * F.ln(p / q)

    empty = F.col("nb") - F.size("cells")
    total = F.aggregate(F.transform("cells", lambda c: term(c.p, c.q)), F.lit(0.0), lambda a, x: a + x)
    total = total + empty * term(F.lit(0), F.lit(0))
    value_of = F.when((F.col("np") > 0) & (F.col("nq") > 0), total).otherwise(F.lit(0.0))
    scored = sums.select(*keys, value_of.alias("psi"))
    return all_keys.join(scored, keys, "left").select(*keys, F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _lerp(values: Column, point: float, n: int) -> Column:
    """Linear-interpolation quantile of a sorted array of known length."""
    at = point * (n - 1)
    low = int(at)
    part = at - low
    left = F.get(values, F.lit(low))
    return left if part == 0 else left + (F.get(values, F.lit(low + 1)) - left) * part


def psi_of_arrays(ref: Column, test: Column, n_ref: int, n_test: int, bins: int, eps: float = EPS) -> Column:
    """PSI of two array columns of known length."""
    points = quantile_points(bins)[1:-1]
    ordered = F.array(F.array_sort(ref))  # one-element arrays bind a value once for the lambda
    inner = F.array_distinct(F.transform(ordered, lambda s: F.array(*[_lerp(s, p, n_ref) for p in points]))[0])

    def from_edges(edges: Column) -> Column:
        n_bins = F.size(edges) + 1

        # counts at or above each inner edge, framed by n and 0
        def at_least(values: Column, n: int) -> Column:
            above = F.transform(edges, lambda e: F.size(F.filter(values, lambda x: x >= e)))
            return F.concat(F.array(F.lit(n)), above, F.array(F.lit(0)))

        def terms(pair: Column) -> Column:
            steps = F.sequence(F.lit(0), n_bins - 1)

            def one(k: Column) -> Column:
                p = (F.get(pair.a, k) - F.get(pair.a, k + 1) + eps) / (n_ref + n_bins * eps)
                q = (F.get(pair.b, k) - F.get(pair.b, k + 1) + eps) / (n_test + n_bins * eps)
                return (p - q) * F.ln(p / q)

            return F.aggregate(F.transform(steps, one), F.lit(0.0), lambda a, x: a + x)

        counts = F.array(F.struct(at_least(ref, n_ref).alias("a"), at_least(test, n_test).alias("b")))
        return F.transform(counts, terms)[0]

    return F.transform(F.array(inner), from_edges)[0]


def rolling_psi(
    value: str,
    ref_window: int = RESEARCH.ref_window,
    test_window: int = RESEARCH.test_window,
    threshold: float = RESEARCH.psi_threshold,
    bins: int = RESEARCH.psi_bins,
    include_current: bool = False,
) -> LocalOp:
    """Drift flag from the PSI of two adjacent trailing windows.

    The current bar is outside both windows unless ``include_current``. Needs a series whose
    ``bar_idx`` counts non-NULL values.
    """
    shift = 0 if include_current else 1
    total = ref_window + test_window

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumns(
            {
                "_ref": F.collect_list(value).over(w.rowsBetween(1 - shift - total, -shift - test_window)),
                "_test": F.collect_list(value).over(w.rowsBetween(1 - shift - test_window, -shift)),
            }
        )
        full = (F.size("_ref") == ref_window) & (F.size("_test") == test_window)
        score = psi_of_arrays(F.col("_ref"), F.col("_test"), ref_window, test_window, bins)
        df = df.withColumn("psi", F.when(full, score))
        return df.withColumn("drift", F.coalesce(F.col("psi") > threshold, F.lit(False))).drop("_ref", "_test")

    return LocalOp(total + shift, 0, apply)


def detect_drift(indexed: DataFrame, value: str, layout: Layout = LAYOUT, **options) -> DataFrame:
    return apply_local(indexed, rolling_psi(value, **options), layout=layout)
