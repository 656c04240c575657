"""One symbol with almost all bars: feature and label build on long series.

``python scripts/skew.py [bars] [cpus]`` compares the chunked plan with a window per symbol.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barflow.operators import backtest, barriers, features  # noqa: E402
from barflow.operators.series import apply_local, index_bars  # noqa: E402
from barflow.session import build_session, cut_lineage  # noqa: E402

FIVE_MINUTES = 300_000_000


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 2_000_000
    cpus = sys.argv[2] if len(sys.argv) > 2 else "8"
    spark = build_session(
        "skew", f"local[{cpus}]", spark__sql__shuffle__partitions="64", spark__driver__memory="12g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    wave = 100 + 10 * F.sin(F.col("id") / 50) + (F.xxhash64("id") % 1000) / 1000.0
    bars = cut_lineage(
        spark.range(n).select(
            F.when(F.col("id") % 20 == 0, F.concat(F.lit("small"), (F.col("id") / 20 % 7).cast("int"))).otherwise(F.lit("hot")).alias("symbol"),
            F.timestamp_micros(F.col("id") * FIVE_MINUTES).alias("ts"),
            wave.alias("open"), (wave + 0.6).alias("high"), (wave - 0.6).alias("low"),
            (wave + (F.xxhash64("id", F.lit(1)) % 500) / 1000.0).alias("close"), F.lit(1.0).alias("volume"),
        )
    )

    def clock(name, build):
        begun = time.time()
        build().write.format("noop").mode("overwrite").save()
        print(f"{name:34s} {time.time() - begun:7.1f} s", flush=True)

    clock("positions, chunked", lambda: index_bars(bars, timeframe_us=FIVE_MINUTES))
    whole = Window.partitionBy("symbol").orderBy("ts")
    clock("positions, window per symbol", lambda: bars.withColumn("bar_idx", F.row_number().over(whole) - 1))
    indexed = cut_lineage(index_bars(bars, timeframe_us=FIVE_MINUTES))
    clock("features and labels, chunked", lambda: apply_local(indexed, features.feature_op(), barriers.live_barrier()))
    later = F.collect_list(F.struct("high", "low")).over(whole.rowsBetween(1, 5))
    clock(
        "lags and look-ahead, per symbol",
        lambda: bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(whole))).withColumn("later", later),
    )
    traded = indexed.withColumns({"signal": F.lit(1), "vma": F.lit(5e4), "size": F.lit(1e-6)})
    clock("equity curve, scanned", lambda: backtest.equity_curve(traded))
    spark.stop()


if __name__ == "__main__":
    main()
