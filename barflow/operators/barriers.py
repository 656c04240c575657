"""Triple-barrier labels, live and research variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, LIVE, RESEARCH, Layout
from barflow.operators.features import wilder_atr
from barflow.operators.series import LocalOp, apply_local

BAR = ["bar_idx", "ts", "high", "low", "close"]
OUTCOME = ["entry_time", "exit_time", "realized_return", "label", "hit_time_limit"]


def live_barrier(
    tp_atr: float = LIVE.tp_atr,
    sl_atr: float = LIVE.sl_atr,
    vertical: int = LIVE.vertical,
    expiry: str = "null",
    atr: str = "atr",
    name: str = "label",
) -> LocalOp:
    """Label of each bar from its next ``vertical`` bars; needs a full look-ahead.

    A bar that reaches both barriers counts as take-profit. Expiry without a touch is NULL
    (``expiry='null'``, the coded behaviour) or 0 (``'zero'``, the documented one).
    """
    if expiry not in ("null", "zero"):
        raise ValueError("expiry is 'null' or 'zero'")

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        later = F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, vertical))
        df = df.withColumn("_later", later)
        up = F.col("close") + tp_atr * F.col(atr)
        down = F.col("close") - sl_atr * F.col(atr)
        touch = F.get(F.filter("_later", lambda b: (b.high >= up) | (b.low <= down)), F.lit(0))
        df = df.withColumn("_touch", touch)
        label = (
            F.when(up.isNull() | (F.size("_later") < vertical), F.lit(None))
            .when(F.col("_touch.high") >= up, F.lit(1))
            .when(F.col("_touch").isNotNull(), F.lit(-1))
            .otherwise(F.lit(0 if expiry == "zero" else None))
        )
        return df.withColumn(name, label.cast("int")).drop("_later", "_touch")

    return LocalOp(0, vertical, apply)


def _outcome(later: Column, pt_mult: float, sl_mult: float) -> dict[str, Column]:
    """Barrier outcome columns for an entry row with ``close, _vol`` and its later bars."""
    up = F.col("close") + pt_mult * F.col("_vol")
    down = F.col("close") - sl_mult * F.col("_vol")
    hit = F.get(F.filter(later, lambda b: (b.high >= up) | (b.low <= down)), F.lit(0))
    return {
        "_hit": hit,
        "_end": F.coalesce(
            hit,
            F.get(later, F.size(later) - 1),
            F.struct(*BAR),
        ),
        "_up": up,
        "_down": down,
    }


def _label_from(df: DataFrame) -> DataFrame:
    ret = F.col("_end.close") / F.col("close") - 1
    both = (F.col("_hit.high") >= F.col("_up")) & (F.col("_hit.low") <= F.col("_down"))
    label = (
        F.when(both, F.when(F.col("_hit.close") >= F.col("close"), 1).otherwise(-1))
        .when(F.col("_hit.high") >= F.col("_up"), 1)
        .when(F.col("_hit").isNotNull(), -1)
        .otherwise(F.signum(ret))
    )
    return df.withColumns(
        {
            "entry_time": F.col("ts"),
            "exit_time": F.col("_end.ts"),
            "exit_idx": F.col("_end.bar_idx"),
            "realized_return": ret,
            "label": label.cast("int"),
            "hit_time_limit": F.col("_hit").isNull(),
        }
    ).drop("_hit", "_end", "_up", "_down")


def research_barrier(
    pt_mult: float = RESEARCH.pt_mult,
    sl_mult: float = RESEARCH.sl_mult,
    max_hold: int = RESEARCH.max_hold,
    vol: str = "atr",
) -> LocalOp:
    """Outcome of a position entered at each bar's close.

    Volatility is that of the previous bar (a supplied one is shifted too). A bar that touches
    both barriers is decided by its close against the entry. Exits are at the close of the exit
    bar; without a touch the position ends after ``max_hold`` bars or at the last bar.
    """

    def apply(df: DataFrame, w: WindowSpec) -> DataFrame:
        bar = F.struct(*BAR)
        df = df.withColumns(
            {
                "_vol": F.lag(vol).over(w),
                "_later": F.collect_list(bar).over(w.rowsBetween(1, max_hold)),
            }
        )
        df = df.withColumns(_outcome(F.col("_later"), pt_mult, sl_mult))
        return _label_from(df).drop("_later")

    return LocalOp(1, max_hold, apply)


def barrier_outcomes(
    indexed: DataFrame,
    events: DataFrame | None = None,
    vol: str | None = None,
    pt_mult: float = RESEARCH.pt_mult,
    sl_mult: float = RESEARCH.sl_mult,
    max_hold: int = RESEARCH.max_hold,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """``(symbol, entry_idx, entry_time, exit_time, exit_idx, entry_price, ...)`` per entry.

    ``events(symbol, entry_time)`` restricts entries; times without a bar are skipped, repeated
    events stay repeated. Rows without volatility are skipped.
    """
    ops = [] if vol else [wilder_atr(RESEARCH.atr_period, warm_up=False)]
    ops.append(research_barrier(pt_mult, sl_mult, max_hold, vol or "atr"))
    out = apply_local(indexed, *ops, layout=layout).where(F.col("_vol").isNotNull())
    if events is not None:
        out = out.join(events.select("symbol", "entry_time"), ["symbol", "entry_time"])
    return out.select(
        "symbol", F.col("bar_idx").alias("entry_idx"), "exit_idx", F.col("close").alias("entry_price"), *OUTCOME
    )


def sparse_outcomes(
    priced: DataFrame,
    events: DataFrame,
    pt_mult: float = RESEARCH.pt_mult,
    sl_mult: float = RESEARCH.sl_mult,
    max_hold: int = RESEARCH.max_hold,
) -> DataFrame:
    """The same outcomes for few events: each entry meets only its next ``max_hold`` bars.

    ``priced`` carries ``bar_idx`` and ``_vol`` (shifted volatility). The range condition
    becomes an equality on ``bar_idx``, so no pair outside the holding window is formed.
    """
    wanted = events.groupBy("symbol", F.col("entry_time").alias("ts")).agg(F.count(F.lit(1)).alias("_times"))
    entries = priced.join(wanted, ["symbol", "ts"]).where(F.col("_vol").isNotNull())
    steps = entries.select(
        "symbol",
        F.col("bar_idx").alias("entry_idx"),
        F.explode(F.sequence(F.col("bar_idx") + 1, F.col("bar_idx") + max_hold)).alias("bar_idx"),
    )
    later = (
        steps.join(priced.select("symbol", *BAR), ["symbol", "bar_idx"])
        .groupBy("symbol", "entry_idx")
        .agg(F.array_sort(F.collect_list(F.struct(*BAR))).alias("_later"))
    )
    found = entries.withColumn("entry_idx", F.col("bar_idx")).join(later, ["symbol", "entry_idx"], "left")
    found = found.withColumn("_later", F.coalesce("_later", F.array().cast(later.schema["_later"].dataType)))
    found = _label_from(found.withColumns(_outcome(F.col("_later"), pt_mult, sl_mult)))
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return repeated.select(
        "symbol", "entry_idx", "exit_idx", F.col("close").alias("entry_price"), *OUTCOME
    )


def previous(column: str, name: str) -> LocalOp:
    """The value of the bar before."""
    return LocalOp(1, 0, lambda df, w: df.withColumn(name, F.lag(column).over(w)))
