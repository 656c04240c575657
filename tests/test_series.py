"""Chunked series operators against pandas on whole series, with one dominant symbol."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.config import Layout
from barflow.operators import asof, barriers, containment, drift, exits, features, fracdiff, quantiles, regime
from barflow.operators.series import Measure, apply_local, chunk_running, index_bars

SMALL = Layout(chunk_bars=64, fanout=4, levels=2)
DAY = datetime(2024, 1, 1)
SIZES = {"hot": 900, "mid": 130, "one": 1, "few": 5}


@pytest.fixture(scope="module")
def bars(make_bars):
    return make_bars(SIZES, gap=3)


def per_symbol(local, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in local.groupby("symbol", sort=False)], ignore_index=True)


def collect(df, *columns):
    return df.select("symbol", "bar_idx", *columns).toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)


def wanted(local, **columns):
    out = local[["symbol", "bar_idx"]].copy()
    for name, values in columns.items():
        out[name] = values
    return out.sort_values(["symbol", "bar_idx"]).reset_index(drop=True)


def test_positions_are_dense(bars):
    local, df = bars
    out = index_bars(df.drop("bar_idx"), layout=SMALL).toPandas()
    merged = out.merge(local, on=["symbol", "ts"])
    assert len(merged) == len(local)
    assert (merged["bar_idx_x"] == merged["bar_idx_y"]).all()


def test_chunk_has_no_more_rows_than_core_and_halo(bars):
    from barflow.operators.series import spread_halo

    _, df = bars
    sizes = spread_halo(df, 10, 5, 64).groupBy("symbol", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 64 + 15


def test_atr_matches_pandas_ewm(bars):
    local, df = bars

    def atr(g):
        before = g["close"].shift(1)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
        ew = tr.ewm(alpha=1 / 14, adjust=False)
        return pd.DataFrame({"live": tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), "research": ew.mean()})

    expected = per_symbol(local, atr)
    got = collect(
        apply_local(df, features.wilder_atr(name="live"), features.wilder_atr(warm_up=False, name="research"), layout=SMALL), "live", "research"
    )
    want = wanted(local, live=expected["live"], research=expected["research"])
    np.testing.assert_allclose(got["live"], want["live"], rtol=1e-12)
    np.testing.assert_allclose(got["research"], want["research"], rtol=1e-12)
    first = local[local["bar_idx"] == 0]
    assert np.allclose(got[got["bar_idx"] == 0]["research"].sort_values(), (first["high"] - first["low"]).sort_values())


def test_rsi_edge_cases(spark):
    up = [(("up"), i, 100.0 + i) for i in range(20)]
    flat = [("flat", i, 50.0) for i in range(20)]
    rows = [(s, DAY + timedelta(days=i), c, c, c, c, 1.0, i) for s, i, c in up + flat]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, bar_idx bigint")
    out = collect(features.build_features(df), "norm_rsi")
    assert out[(out.symbol == "up") & (out.bar_idx >= 14)]["norm_rsi"].eq(1.0).all()
    assert out[out.bar_idx < 14]["norm_rsi"].isna().all()
    assert out[out.symbol == "flat"]["norm_rsi"].isna().all()


@pytest.mark.parametrize("period", [1, 2, 3, 5])
@pytest.mark.parametrize("chunk_bars", [64, 2048])
def test_short_periods(make_bars, period, chunk_bars):
    local, df = make_bars({"a": 5000, "b": 63, "c": 1, "d": 2}, seed=11)

    def means(g):
        before = g["close"].shift(1)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
        move = g["close"].diff().iloc[1:]
        gain, loss = (side.clip(lower=0).ewm(alpha=1 / period, adjust=False, min_periods=period).mean() for side in (move, -move))
        rsi = (1 - 1 / (1 + gain / loss.where(loss > 0))).mask((loss == 0) & (gain > 0), 1.0)
        return pd.DataFrame({"atr": tr.ewm(alpha=1 / period, adjust=False, min_periods=period).mean(), "norm_rsi": rsi.reindex(g.index)})

    expected = per_symbol(local, means)
    got = collect(features.build_features(df, period, Layout(chunk_bars=chunk_bars, fanout=5)), "atr", "norm_rsi")
    want = wanted(local, atr=expected["atr"], norm_rsi=expected["norm_rsi"])
    np.testing.assert_allclose(got["atr"].astype(float), want["atr"], rtol=1e-11)
    np.testing.assert_allclose(got["norm_rsi"].astype(float), want["norm_rsi"], rtol=1e-9, atol=1e-12)


def test_ops_that_look_too_far(bars):
    with pytest.raises(ValueError):
        apply_local(bars[1], features.wilder_atr(period=2), features.volume_average(2000))


def test_averages_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(3)
    close = np.concatenate([100 + np.cumsum(rng.normal(0, 1, 1000)), np.full(4000, 0.0)])
    close[1000:] = close[999]
    rows = [("s", DAY + timedelta(hours=i), c, c + (i < 1000), c, c, 1.0, i) for i, c in enumerate(close.tolist())]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, bar_idx bigint")
    move = np.diff(close, prepend=np.nan)
    gain, loss = (pd.Series(np.maximum(sign * move, 0)[1:]).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for sign in (1, -1))
    rsi = np.concatenate([[np.nan], 1 - 1 / (1 + gain / loss)])
    for size in (64, 512, 2048):
        layout = Layout(chunk_bars=size, fanout=7)
        out = collect(apply_local(df, features.feature_op(), layout=layout), "norm_rsi", "atr").sort_values("bar_idx")
        np.testing.assert_allclose(out["norm_rsi"].to_numpy(float), rsi, rtol=1e-9)
        assert (out["atr"].to_numpy()[13:] > 0).all() and (np.diff(out["atr"].to_numpy()[1100:]) < 0).all()
        late = collect(regime.attach_regime(df, layout=layout), "volatility_regime").sort_values("bar_idx")
        assert (late["volatility_regime"].to_numpy()[1100:] == "LOW").all()


def live_reference(g, tp=1.5, sl=1.0, vertical=5):
    out = [None] * len(g)
    for t in range(len(g) - vertical):
        if np.isnan(g["atr"][t]):
            continue
        up, down = g["close"][t] + tp * g["atr"][t], g["close"][t] - sl * g["atr"][t]
        for j in range(t + 1, t + 1 + vertical):
            if g["high"][j] >= up:
                out[t] = 1
                break
            if g["low"][j] <= down:
                out[t] = -1
                break
    return pd.DataFrame({"label": pd.array(out, dtype="Int64")})


def test_live_barrier(bars):
    _, df = bars
    framed = apply_local(df, features.wilder_atr(), layout=SMALL)
    local = framed.toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    expected = per_symbol(local, live_reference)["label"]
    got = collect(apply_local(df, features.wilder_atr(), barriers.live_barrier(), layout=SMALL), "label")
    assert got["label"].astype("Int64").fillna(9).tolist() == expected.fillna(9).tolist()
    zero = collect(apply_local(df, features.wilder_atr(), barriers.live_barrier(expiry="zero"), layout=SMALL), "label")
    assert (zero["label"] == 0).any()
    assert got["label"].notna().sum() == (zero["label"].fillna(0) != 0).sum()


def test_live_tie_goes_up(spark):
    rows = [("t", DAY + timedelta(days=i), 100.0, h, l, 100.0, 1.0, i, 1.0) for i, (h, l) in enumerate([(100.5, 99.5), (110.0, 90.0)] + [(100.1, 99.9)] * 5)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, bar_idx bigint, atr double")
    out = collect(apply_local(df, barriers.live_barrier()), "label")
    assert out["label"][0] == 1


def test_research_barrier_against_loop(bars):
    _, df = bars
    local = apply_local(df, features.wilder_atr(warm_up=False), layout=SMALL).toPandas().sort_values(["symbol", "bar_idx"])
    expected = {}
    for symbol, g in local.groupby("symbol"):
        g = g.reset_index(drop=True)
        for t in range(1, len(g)):
            vol, entry = g["atr"][t - 1], g["close"][t]
            up, down = entry + 1.5 * vol, entry - vol
            end, label, timed = min(t + 5, len(g) - 1), None, True
            for j in range(t + 1, min(t + 5, len(g) - 1) + 1):
                tp, sl = g["high"][j] >= up, g["low"][j] <= down
                if tp or sl:
                    label = (1 if g["close"][j] >= entry else -1) if tp and sl else (1 if tp else -1)
                    end, timed = j, False
                    break
            ret = g["close"][end] / entry - 1
            expected[symbol, t] = (end, int(np.sign(ret)) if timed else label, timed)
    out = barriers.barrier_outcomes(df, layout=SMALL).collect()
    assert {(r.symbol, r.entry_idx): (r.exit_idx, r.label, r.hit_time_limit) for r in out} == expected


def test_sparse_outcomes_equal_window_outcomes(spark, bars):
    local, df = bars
    events = df.where((F.col("bar_idx") % 9 == 0)).select("symbol", F.col("ts").alias("entry_time"))
    events = events.unionByName(events.limit(3)).unionByName(
        spark.createDataFrame([("hot", datetime(2099, 1, 1))], "symbol string, entry_time timestamp")
    )
    priced = apply_local(df, features.wilder_atr(warm_up=False), barriers.previous("atr", "_vol"), layout=SMALL)
    a = barriers.barrier_outcomes(df, events, layout=SMALL).toPandas()
    b = barriers.sparse_outcomes(priced, events).toPandas()
    order = ["symbol", "entry_idx"]
    pd.testing.assert_frame_equal(a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True))


def test_rolling_rank_matches_pandas(bars):
    local, df = bars
    tied = df.withColumn("v", F.round("close", 0))
    expected = per_symbol(local, lambda g: pd.DataFrame({"p": g["close"].round(0).rolling(20).rank(pct=True)}))["p"]
    got = collect(apply_local(tied, regime.rolling_rank("v", 20, "p"), layout=SMALL), "p")
    want = wanted(local, p=expected)
    diff = (got["p"] - want["p"]).abs()
    # Java and numpy round halves differently; random walks have none.
    assert diff.max() < 1e-12 and (got["p"].isna() == want["p"].isna()).all()


def test_regime_class_and_mask(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.5,), (0.8,), (0.9,), (None,)], "p double")
    out = df.select(regime.regime_class(F.col("p")).alias("c"), regime.regime_mask(regime.regime_class(F.col("p"))).alias("m")).collect()
    assert [r.c for r in out] == ["LOW", "MEDIUM", "MEDIUM", "MEDIUM", "HIGH", None]
    assert [r.m for r in out] == [False, True, True, True, False, False]


def test_frac_diff(bars):
    local, df = bars
    assert fracdiff.frac_weights(1.0, 4) == [1.0, -1.0, 0.0, 0.0]
    assert fracdiff.cut_weights(0.0, 1e-4, 10) == [1.0]
    same = collect(fracdiff.frac_diff(df, d=0.0, layout=SMALL), "frac_diff")
    np.testing.assert_allclose(same["frac_diff"], wanted(local, c=local["close"])["c"])

    def reference(g):
        weights = fracdiff.cut_weights(0.4, 1e-2, len(g))  # a short series is one window
        return pd.DataFrame({"v": g["close"].rolling(len(weights)).apply(lambda x: float(np.dot(weights[::-1], x)), raw=True)})

    expected = per_symbol(local, reference)["v"]
    got = collect(fracdiff.frac_diff(df, d=0.4, threshold=1e-2, layout=SMALL), "frac_diff")
    want = wanted(local, v=expected).dropna()
    np.testing.assert_allclose(got["frac_diff"], want["v"], rtol=1e-9)
    assert fracdiff.frac_diff(df.where("symbol = 'few'"), max_lag=50, threshold=0.0, layout=SMALL).count() == 0


def test_running_product_max_and_reverse(bars):
    local, df = bars
    factor = 1.0 + (F.col("close") - F.col("open")) / F.col("open")
    out = chunk_running(df, [Measure("p", "product", factor), Measure("m", "max", F.col("close")), Measure("s", "sum", F.col("volume"))], layout=SMALL)
    got = collect(out, "p", "m", "s")
    grouped = local.assign(f=1 + (local["close"] - local["open"]) / local["open"]).groupby("symbol")
    want = wanted(local, p=grouped["f"].cumprod(), m=grouped["close"].cummax(), s=grouped["volume"].cumsum())
    for c in ("p", "m", "s"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-11)
    back = collect(chunk_running(df, [Measure("s", "sum", F.col("volume"))], layout=SMALL, reverse=True), "s")
    rev = local.iloc[::-1].groupby("symbol")["volume"].cumsum().iloc[::-1]
    np.testing.assert_allclose(back["s"], wanted(local, s=rev)["s"], rtol=1e-11)


def test_asof_keeps_matched_nulls(spark, bars):
    local, df = bars
    source = df.where(F.col("bar_idx") % 7 == 3).select(
        "symbol", (F.col("ts") - F.expr("INTERVAL 5 HOURS")).alias("ts"), F.when(F.col("bar_idx") % 2 == 0, F.col("close")).alias("x")
    )
    got = asof.asof_backward(df, source, ["x"], layout=SMALL).toPandas().sort_values(["symbol", "ts"])
    pieces = []
    src = source.toPandas()
    for symbol, g in local.groupby("symbol"):
        s = src[src.symbol == symbol].set_index("ts")["x"].sort_index()
        pieces.append(g.sort_values("ts")[["symbol", "ts"]].assign(x=s.reindex(pd.DatetimeIndex(g["ts"]), method="ffill").to_numpy()))
    want = pd.concat(pieces).sort_values(["symbol", "ts"])
    np.testing.assert_array_equal(got["x"].to_numpy(), want["x"].to_numpy())
    on_grid = asof.asof_backward(df, source, ["x"], layout=SMALL, on_grid=True).toPandas().sort_values(["symbol", "ts"])
    np.testing.assert_array_equal(on_grid["x"].to_numpy(), want["x"].to_numpy())


def test_align_without_sources(bars):
    _, df = bars
    assert asof.align(df, None, None).columns == df.columns


def test_fill_both_ways(spark, bars):
    local, df = bars
    gaps = df.withColumn("v", F.when(F.col("bar_idx") % 50 == 30, F.col("close")))
    got = collect(asof.fill_both_ways(gaps, ["v"], SMALL), "v")
    want = wanted(local, v=local["close"].where(local["bar_idx"] % 50 == 30))
    want["v"] = want.groupby("symbol")["v"].transform(lambda s: s.ffill().bfill())
    np.testing.assert_array_equal(got["v"].to_numpy(), want["v"].to_numpy())


def test_containment_against_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 400, 500), rng.integers(1, 30, 500)))]
    df = spark.createDataFrame([(s, i, DAY + timedelta(days=a), DAY + timedelta(days=b)) for s, i, a, b in rows], "symbol string, id int, entry_time timestamp, exit_time timestamp")
    got = {r.id: r.clean for r in containment.purge_contained(df, layout=SMALL).collect()}
    want = {i: not any(c <= a and b <= d and (c < a or b < d) for _, j, c, d in rows if j != i) for _, i, a, b in rows}
    assert got == want
    assert containment.purge_contained(df, None, None).where("clean").count() == 500


def test_exits_against_scan(bars):
    local, df = bars
    positions = df.where(F.col("bar_idx") % 3 == 0).select(
        "symbol", F.concat_ws("_", "symbol", "bar_idx").alias("position_id"), F.col("bar_idx").alias("entry_idx"),
        (F.col("close") * (1.02 + F.col("bar_idx") % 5 * 0.03)).alias("tp_price"), (F.col("close") * (0.98 - F.col("bar_idx") % 7 * 0.03)).alias("sl_price"),
    )
    groups = {s: g.sort_values("bar_idx") for s, g in local.groupby("symbol")}
    for fanout in (4, 256):
        out = exits.exit_join(positions, df, fanout=fanout).collect()
        assert len(out) == positions.count()
        for r in out:
            g = groups[r.symbol]
            later = g[(g["bar_idx"] > r.entry_idx) & ((g["low"] <= r.sl_price) | (g["high"] >= r.tp_price))]
            if later.empty:
                assert r.exit_idx is None and r.bars_held == len(g) - 1 - r.entry_idx
            else:
                bar = later.iloc[0]
                assert r.exit_idx == bar["bar_idx"]
                assert r.exit_reason == ("STOP_LOSS" if bar["low"] <= r.sl_price else "TAKE_PROFIT")
                assert r.exit_price == (r.sl_price if bar["low"] <= r.sl_price else r.tp_price)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=5000), np.full(3000, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values})).unionByName(spark.createDataFrame([("b", 3.0)], "k string, v double"))
    points = [0.0, 0.1, 0.5, 0.77, 1.0]
    out = {(r.k, r.point_id): r.q for r in quantiles.exact_quantiles(df, "v", ["k"], points).collect()}
    for i, p in enumerate(points):
        assert out["a", i] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert out["b", i] == 3.0


@pytest.mark.parametrize("rows", [1, 16, 700])
def test_quantiles_by_repeated_narrowing(spark, rows):
    """Brackets above the row bound are cut again; no task sorts more than the bound."""
    rng = np.random.default_rng(6)
    hot = np.concatenate([rng.lognormal(0, 3, 30_000), -rng.lognormal(0, 3, 5_000), np.full(9_000, 1.5), [-np.inf, np.inf, 0.0, -0.0]])
    rare = rng.normal(size=7)
    frame = pd.DataFrame({"k": ["hot"] * len(hot) + ["rare"] * 7 + ["none"], "v": [*hot, *rare, None]})
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    points = [0.001, 0.25, 0.5, 0.9, 0.9999]
    out = {(r.k, r.point_id): r.q for r in quantiles.exact_quantiles(df, "v", ["k"], points, Layout(chunk_rows=rows)).collect()}
    assert set(out) == {(k, i) for k in ("hot", "rare") for i in range(5)}
    for i, p in enumerate(points):
        assert out["hot", i] == pytest.approx(np.quantile(hot, p), rel=1e-12) and out["rare", i] == pytest.approx(np.quantile(rare, p), rel=1e-12)


def test_chunks_cut_by_counting(spark):
    from barflow.operators.series import Measure, depth_chunks, running

    rows = [("hot", 7, i) for i in range(3000)] + [("b", i % 5, i) for i in range(200)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    dealt = depth_chunks(df, ["k"], ["t", "id"], 100)
    assert dealt.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 100 and dealt.count() == len(rows)
    ends = dealt.groupBy("k", "_chunk").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy("k", "_chunk").collect()
    assert all(x.k != y.k or tuple(x.b) < tuple(y.a) for x, y in zip(ends, ends[1:], strict=False))
    layout = Layout(fanout=3)
    for exclusive in (False, True):
        out = running(dealt, ["k"], "_chunk", ["t", "id"], [Measure("n", "sum", F.lit(1))], layout, exclusive=exclusive).where("k = 'hot'")
        assert [r.n or 0 for r in out.orderBy("id").collect()] == [i + (not exclusive) for i in range(3000)]


def numpy_psi(ref, cur, bins=10):
    edges = np.quantile(ref, np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    edges = np.unique(edges)
    p = np.histogram(ref, edges)[0] + 1e-6
    q = np.histogram(cur, edges)[0] + 1e-6
    p, q = p / p.sum(), q / q.sum()
    return float(np.sum((p - q) * np.log(p / q)))


def test_psi(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=400), rng.normal(2, 1, 300)
    frame = pd.DataFrame({"k": "x", "v": np.concatenate([a, b]), "ref": [True] * 400 + [False] * 300})
    same = pd.DataFrame({"k": "y", "v": np.concatenate([a, a]), "ref": [True] * 400 + [False] * 400})
    lone = pd.DataFrame({"k": "z", "v": a, "ref": True})
    df = spark.createDataFrame(pd.concat([frame, same, lone]))
    out = {r.k: r.psi for r in drift.psi(df, "v", "ref", ["k"]).collect()}
    assert out["x"] == pytest.approx(numpy_psi(a, b), rel=1e-9) and out["x"] > 0.5
    assert out["y"] == pytest.approx(0.0, abs=1e-12)
    assert out["z"] == 0.0


def test_rolling_drift(bars):
    local, df = bars
    got = collect(drift.detect_drift(df, "close", layout=SMALL), "psi", "drift")
    hot = local[local.symbol == "hot"]["close"].to_numpy()
    out = got[got.symbol == "hot"].reset_index(drop=True)
    for i in (149, 150, 151, 400, 899):
        if i < 150:
            assert np.isnan(out["psi"][i]) and not out["drift"][i]
        else:
            assert out["psi"][i] == pytest.approx(numpy_psi(hot[i - 150 : i - 50], hot[i - 50 : i]), rel=1e-9)


def test_weights_of_a_column_of_degrees(spark):
    degrees = [0.0, 0.1, 0.4, 0.5, 0.9, 1.0, 1.7]
    df = spark.createDataFrame([(d,) for d in degrees], "d double")
    for threshold, limit in ((1e-3, 1000), (1e-2, 5), (1e-2, 1)):
        got = {x.d: x.w for x in df.select("d", fracdiff.cut_weights_of(F.col("d"), threshold, limit).alias("w")).collect()}
        assert got == {d: fracdiff.cut_weights(d, threshold, limit) for d in degrees}
