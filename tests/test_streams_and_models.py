"""Streams give the batch result; model jobs keep their bounds; sinks and snapshots round-trip."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.ml import importance, meta, retrain, signal, validate
from barflow.operators import drift, features, portfolio
from barflow.operators.series import apply_local
from barflow.schemas import FEATURES, OHLCV, TRADE_COLUMNS
from barflow.sources import bars as scans
from barflow.sources import sinks, snapshots, tables
from barflow.streaming import batches, models, run, state
from barflow.streaming.bars import closed_bars

DAY = datetime(2024, 1, 1)


def written_in_order(df, path, column, parts):
    """One file after another, so that each micro-batch continues the last."""
    edges = np.linspace(0, df.agg(F.max(column)).first()[0] + 1, parts + 1)
    for low, high in zip(edges[:-1], edges[1:]):
        df.where((F.col(column) >= low) & (F.col(column) < high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def test_closed_bars_only(spark, tmp_path):
    ticks = [("s", DAY + timedelta(minutes=7 * i), 100.0 + i, 1.0) for i in range(60)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, price double, size double")
    df.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    got = run.drain(closed_bars(run.read_stream(spark, df, str(tmp_path / "ticks")), "1 hour"), "t").collect()
    batch = {r.ts: r for r in scans.ticks_to_bars(df, "1 hour").collect()}
    last = max(t[1] for t in ticks) - timedelta(hours=1)
    assert {r.ts for r in got} == {t for t in batch if t + timedelta(hours=1) <= last}
    assert all(r == batch[r.ts] for r in got)


@pytest.fixture(scope="module")
def walk(make_bars):
    return make_bars({"a": 300, "b": 200}, seed=11)


def test_stream_features_equal_batch(spark, walk, tmp_path):
    _, df = walk
    path = written_in_order(df, str(tmp_path / "bars"), "bar_idx", 4)
    stream = run.drain(state.stream_features(run.read_stream(spark, df, path, files=1)), "f").toPandas().sort_values(["symbol", "ts"])
    batch = features.build_features(df).toPandas().sort_values(["symbol", "ts"])
    for c in FEATURES:
        np.testing.assert_allclose(stream[c].to_numpy(), batch[c].to_numpy(), rtol=1e-9)


def test_stream_drift_equals_batch(spark, walk, tmp_path):
    _, df = walk
    values = df.select("symbol", "ts", "bar_idx", F.col("close").alias("value"))
    path = written_in_order(values, str(tmp_path / "v"), "bar_idx", 3)
    stream = run.drain(state.stream_drift(run.read_stream(spark, values, path, files=1)), "d").toPandas().sort_values(["symbol", "ts"])
    batch = apply_local(df, drift.rolling_psi("close", include_current=True)).toPandas().sort_values(["symbol", "ts"])
    np.testing.assert_allclose(stream["psi"].to_numpy(), batch["psi"].to_numpy(), rtol=1e-9)
    assert stream["drift"].tolist() == batch["drift"].tolist()


@pytest.mark.parametrize("period", [1, 2, 14])
@pytest.mark.parametrize("carry", [None, 3.0])
def test_decayed_sums_follow_the_recursion(period, carry):
    x = np.abs(np.random.default_rng(period).normal(size=5000))
    x[:7] = 0.0
    s, want = x[0] if carry is None else carry, []
    for v in x:
        s += (v - s) / period
        want.append(s)
    got = state.decayed(x, 1.0 / period, carry)
    np.testing.assert_allclose(got, want, rtol=1e-10)
    assert (got[:7] == 0).all() or carry
    assert len(state.decayed(x[:0], 0.5, None)) == 0


@pytest.mark.parametrize("digits", [0, 1, 8])
def test_window_scores_follow_the_definition(digits):
    """With few digits many edges are equal, down to a single bin."""
    series = np.round(np.random.default_rng(digits).normal(size=260), digits)
    series[:40] = 1.0
    want = []
    for end in range(45, len(series) + 1):
        old, new = series[end - 45 : end - 15], series[end - 15 : end]
        inner = np.unique(np.quantile(old, np.arange(1, 10) / 10))
        p, q = (np.bincount(np.searchsorted(inner, x, side="right"), minlength=len(inner) + 1) + state.EPS for x in (old, new))
        p, q = p / p.sum(), q / q.sum()
        want.append(((p - q) * np.log(p / q)).sum())
    for block in (1, 50, 4096):
        np.testing.assert_allclose(state.windows_psi(series, 30, 15, 10, block), want, rtol=1e-9, atol=1e-12)
    assert len(state.windows_psi(series[:44], 30, 15, 10)) == 0


def test_stream_positions_follow_the_rules(spark, tmp_path):
    rows = []
    prices = [(100, 101, 99), (100, 104, 99), (100, 112, 88), (100, 101, 99), (100, 120, 99), (100, 101, 99)]
    for i, (close, high, low) in enumerate(prices):
        rows.append(("p", "s", DAY + timedelta(hours=i), float(high), float(low), float(close), "BUY", float(close), 110.0, 90.0, i))
    df = spark.createDataFrame(rows, "portfolio string, symbol string, ts timestamp, high double, low double, close double, signal string, price double, tp_price double, sl_price double, n int")
    path = written_in_order(df, str(tmp_path / "s"), "n", 3)
    out = run.drain(state.stream_positions(run.read_stream(spark, df, path, files=1)), "p").toPandas().sort_values("ts", kind="stable")
    closes = out[out.event == "close"]
    assert closes["exit_reason"].tolist() == ["STOP_LOSS", "TAKE_PROFIT"]  # the stop wins the tie
    assert closes["bars_held"].tolist() == [1, 1]
    assert closes["pnl_usd"].tolist() == pytest.approx([-100.0, 99.0])
    assert (out.event == "open").sum() == 3 and (out.event == "snapshot").sum() == len(prices)
    final = out[out.event == "snapshot"].iloc[-1]
    assert final["equity_usd"] == pytest.approx(9_999.0) and final["open_positions"] == 1


def test_retrain_trigger_is_idempotent(spark, tmp_path):
    calls = []
    trigger = batches.RetrainTrigger(str(tmp_path / "r"), lambda trades, milestone: calls.append((milestone, trades.count())))
    part = spark.range(99).withColumnRenamed("id", "trade")
    trigger(part, 0)
    trigger(spark.range(1).withColumnRenamed("id", "trade"), 1)
    trigger(spark.range(100).withColumnRenamed("id", "trade"), 2)
    trigger(spark.range(100).withColumnRenamed("id", "trade"), 2)
    assert calls[:2] == [(100, 100), (200, 200)]
    assert [r.milestone for r in trigger.triggers(spark).orderBy("milestone").collect()] == [100, 200]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    frame = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(
        label=y, symbol="s", bar_idx=np.arange(n), ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), close=100.0, atr=2.0
    )
    return spark.createDataFrame(frame)


NAMES = ["f0", "f1", "f2"]


def test_signal_model_round_trip(spark, labelled, tmp_path):
    model = signal.train(labelled, NAMES, estimator=signal.forest(20))
    assert model.trained_rows == 600
    scored = model.score(labelled)
    assert scored.where(F.col("prediction") == F.col("label")).count() > 540
    bad = scored.where((F.col("p_tp") < 0) | (F.col("p_sl") < 0) | (F.abs(F.col("p_tp") + F.col("p_sl") - 1) > 1e-9))
    assert bad.isEmpty()
    assert {r.reason for r in model.signals(labelled).select("reason").distinct().collect()} == {"WARMUP"}
    model.save(str(tmp_path / "m"))
    again = signal.SignalModel.load(spark, str(tmp_path / "m"))
    assert again.features == NAMES and again.trained_rows == 600
    assert again.score(labelled).select("p_tp").exceptAll(scored.select("p_tp")).isEmpty()


def test_boosted_probabilities(labelled):
    scored = signal.train(labelled, NAMES, estimator=signal.boosted(5, depth=3)).score(labelled)
    worst = scored.agg(F.max(F.col("p_tp") + F.col("p_sl")), F.min("p_tp")).first()
    assert worst[0] <= 1 + 1e-9 and worst[1] >= 0
    assert scored.where(F.col("prediction") == F.col("label")).count() > 500


def test_importance_ranks_informative_features(labelled):
    kept, scores = importance.prune_features(labelled, NAMES, lambda: signal.forest(20), keep=2, n_repeats=3)
    assert set(kept) == {"f0", "f1"} and kept[0] == "f0"
    assert importance.keep_features(scores, min_importance=0.05) == kept
    assert len(importance.select_features(labelled, NAMES, 0.1, trees=10)) == 1
    with pytest.raises(ValueError):
        importance.keep_features(scores)


def test_meta_model(spark, labelled):
    model = meta.fit_meta(labelled, NAMES, primary=signal.forest(5, maxDepth=2), meta=signal.forest(10))
    out = model.predict(labelled, 0.6)
    assert out.where(F.abs(F.col("p_down") + F.col("p_up") - 1) > 1e-9).isEmpty()
    assert {r.bet for r in out.select("bet").distinct().collect()} <= {-1, 0, 1}
    sure = labelled.withColumn("f0", F.col("label").cast("double"))
    constant = meta.fit_meta(sure, ["f0"], primary=signal.forest(5))
    assert constant.meta is None and constant.constant == 1.0
    with pytest.raises(ValueError):
        meta.fit_meta(labelled.withColumn("label", F.lit(0)), NAMES)


def test_purged_cv_and_grid(labelled):
    def rule(train, test, params):
        return test.withColumn("prediction", F.when(F.col("f0") > params.get("t", 0.0), 1).otherwise(-1))

    row = validate.nested_purged_cv(labelled, rule, 4, 5).first()
    folds = [row[f"fold_{i}"] for i in range(4)]
    assert row.mean_score == pytest.approx(np.mean(folds)) and row.std_score == pytest.approx(np.std(folds))
    grid = validate.parameter_grid(labelled, {"t": [0.0, 5.0], "u": [1, 2]}, rule, 3)
    assert grid.count() == 4 and grid.where("t = 0.0").first().mean_score > grid.where("t = 5.0").first().mean_score


def test_milestone_retrain(spark, make_bars, tmp_path):
    _, df = make_bars({"a": 400}, seed=7)
    log = df.select("symbol", F.col("ts").alias("exit_time"), (F.col("close") - F.col("open")).alias("pnl_usd"))
    path = str(tmp_path / "models")
    none, mark = retrain.maybe_retrain(df, log.limit(99), 0, path, expiry="zero", trees=5)
    assert none is None and mark == 0
    model, mark = retrain.maybe_retrain(df, log.limit(120), 0, path, expiry="zero", trees=5)
    assert mark == 100 and len(model.features) == 8
    row = spark.read.parquet(f"{path}/evolution").first()
    assert 0 <= row.oos_accuracy <= 1 and row.n_samples >= 120 and row.trade_count == 120
    assert signal.SignalModel.load(spark, row.model_path).features == model.features


def test_new_bars_publish_versions_and_the_newest_scores(spark, make_bars, tmp_path):
    _, df = make_bars({"a": 450}, seed=3)
    bars = df.select("symbol", "ts", "open", "high", "low", "close", "volume", "bar_idx")
    store = models.ModelStore(str(tmp_path / "m"))
    scorer = models.Scorer(store, str(tmp_path / "s"))
    rows = apply_local(df, features.feature_op()).where(F.col("bar_idx") >= 400)
    scorer(rows, 0)
    assert store.newest(spark) is None and scorer.results(spark).isEmpty()

    trigger = batches.RetrainTrigger(str(tmp_path / "r"), models.on_bars(store, expiry="zero", estimator=signal.bayes(), window=150), every=100)
    for k, (low, high) in enumerate([(0, 250), (250, 290), (290, 450)]):
        part = bars.where((F.col("bar_idx") >= low) & (F.col("bar_idx") < high)).drop("bar_idx")
        trigger(part, k)
        before = {r.version: r.timestamp for r in store.versions(spark).collect()}
        trigger(part, k)  # a replay trains nothing
        assert before == {r.version: r.timestamp for r in store.versions(spark).collect()}
    assert sorted(r.milestone for r in trigger.triggers(spark).collect()) == [200, 400]
    made = {r.version: r for r in store.versions(spark).collect()}
    assert sorted(made) == [200, 400] and {r.n_samples for r in made.values()} == {150} and all(r.n_features == 4 for r in made.values())

    scorer(rows, 1)
    scorer(rows, 1)
    want = signal.SignalModel.load(spark, made[400].model_path).signals(rows.dropna("any")).select("ts", "p_tp").orderBy("ts").collect()
    assert scorer.results(spark).select("ts", "p_tp").orderBy("ts").collect() == want and want


def test_half_written_versions_are_not_read(spark, tmp_path):
    store = models.ModelStore(str(tmp_path / "m"))
    store.publish(spark.createDataFrame([("one",)], "model_path string"), 9)
    store.publish(spark.createDataFrame([("two",)], "model_path string"), 10)
    (tmp_path / "m" / "model_000000000011").mkdir()
    assert [r.version for r in store.versions(spark).orderBy("version").collect()] == [9, 10]
    assert store.has(spark, 10) and not store.has(spark, 11)


def test_columns_are_normalized(spark):
    raw = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 10, "x"), (None, 2.0, 0.5, 1.5, 10, "x")], "Open double, HIGH double, low double, Close double, Volume bigint, other string")
    assert scans.normalize_columns(raw).columns == OHLCV and scans.normalize_columns(raw).count() == 1
    nested = spark.createDataFrame([((1.0,), (2.0,), (0.5,), (float("nan"),), (3.0,))], "Open struct<A:double>, High struct<A:double>, Low struct<A:double>, Close struct<A:double>, Volume struct<A:double>")
    assert scans.normalize_columns(nested).count() == 0
    with pytest.raises(ValueError):
        scans.normalize_columns(raw.drop("low"))


def test_funding_accepts_both_spellings(spark):
    a = spark.createDataFrame([(1704067200000, 0.1)], "timestamp bigint, funding_rate double")
    b = spark.createDataFrame([(1704067200000, 0.1)], "fundingTime bigint, fundingRate double")
    assert scans.scan_funding(a).collect() == scans.scan_funding(b).collect() == [(DAY, 0.1)]
    with pytest.raises(ValueError):
        scans.require_rows(a.limit(0))


@pytest.mark.parametrize("ending", ["csv", "parquet"])
def test_snapshot_round_trip_and_age(spark, make_bars, tmp_path, ending):
    _, df = make_bars({"a": 20})
    path = str(tmp_path / f"bars.{ending}")
    assert snapshots.read_snapshot(spark, path) is None
    renamed = df.select("symbol", F.col("ts").alias("timestamp"), *OHLCV)
    snapshots.write_snapshot(renamed, path)
    back = snapshots.read_snapshot(spark, path, max_age_seconds=3600)
    assert dict(back.dtypes)["timestamp"] == "timestamp"
    assert back.select(renamed.columns).exceptAll(renamed).isEmpty() and back.count() == 20
    time.sleep(2.1)
    assert snapshots.read_snapshot(spark, path, max_age_seconds=1) is None


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", DAY, DAY + timedelta(days=1), 1.0, 2.0)], "symbol string, entry_time timestamp, exit_time timestamp, entry_price double, pnl_usd double")
    path = str(tmp_path / "trades")
    sinks.append_trades(rows, path)
    sinks.append_trades(rows, path)
    sinks.append_trades(rows.drop("pnl_usd"), path)
    back = spark.read.parquet(path)
    assert back.columns == [*TRADE_COLUMNS, "exit_date"] and back.count() == 3 and back.first().side is None
    assert dict(back.dtypes)["size"] == "double" and sorted(r.pnl_usd or 0 for r in back.collect()) == [0, 2, 2]
    snaps = spark.createDataFrame([("p", DAY, 1.0), ("p", DAY + timedelta(days=1), 2.0)], "portfolio string, timestamp timestamp, cash_usd double")
    for _ in range(2):
        sinks.write_live_rows(snaps, str(tmp_path / "live"))
    sinks.write_live_rows(snaps.withColumn("portfolio", F.lit("q")).limit(1), str(tmp_path / "live"))
    live = spark.read.parquet(str(tmp_path / "live")).collect()
    assert {(r.portfolio, r.cash_usd) for r in live} >= {("p", 2.0)} and len(live) == 2


def test_admission(spark):
    sig = spark.createDataFrame([("a", "BUY", 10.0), ("b", "BUY", 10.0), ("c", "SIT_OUT", 10.0)], "symbol string, signal string, price double")
    held = spark.createDataFrame([("a",)], "symbol string")
    assert [r.symbol for r in portfolio.admit(sig, held).collect()] == ["b"]


def test_permutation_is_computed(spark):
    """Every size gives a permutation; seeds and keys give different ones."""
    from barflow.ml.importance import permuted

    for n in (1, 2, 3, 5, 12, 257, 1000):
        df = spark.range(n).select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(rep).alias("rep")) for f, rep in ((0, 0), (0, 1), (3, 0))])).alias("v"))
        out = df.select("id", "v", permuted(F.col("id"), n, 42, F.col("v.f"), F.col("v.rep")).alias("to")).collect()
        images = {}
        for r in out:
            images.setdefault(tuple(r.v), {})[r.id] = r.to
        assert all(sorted(x.values()) == list(range(n)) for x in images.values())
        if n > 100:
            orders = [tuple(x[i] for i in range(n)) for x in images.values()]
            assert len(set(orders)) == 3 and all(sum(a == i for i, a in enumerate(o)) < 8 for o in orders)


def test_rows_are_numbered_along_their_order(spark):
    from barflow.config import Layout
    from barflow.ml.importance import numbered

    df = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), (F.col("id") * 7919 % 1009).alias("ts"))
    out = numbered(df, ["symbol", "ts"], layout=Layout(chunk_rows=37, fanout=3)).orderBy("symbol", "ts").collect()
    assert [r["_id"] for r in out] == list(range(500))


def test_table_of_many_files_as_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, [0.5 + i] * 64) for i in range(20)], "vec_id bigint, embedding array<float>")
    rows.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows.where("vec_id < 3").write.parquet(str(tmp_path / "other.parquet"))
    assert run.drain(run.read_stream(spark, rows, str(tmp_path), "embeddings.parquet"), "many").count() == 20
    one = next((tmp_path / "other.parquet").glob("part-*"))
    assert 0 < run.drain(run.read_stream(spark, rows, str(one.parent), one.name), "one").count() <= 3


def test_rolling_edges_on_values(spark):
    """Values in hundredths often fall on an edge: batch and stream agree on the last bit of it, and with their SQL."""
    import duckdb

    from barflow.plans.sqlparts import ROLLING_EDGES

    rng = np.random.default_rng(5)
    values = np.round(rng.integers(0, 60, 3000) / 20 + 7.1, 2)
    frame = pd.DataFrame({"symbol": "s", "bar_idx": np.arange(3000), "close": values})
    batch = drift.detect_drift(spark.createDataFrame(frame), "close", include_current=True).orderBy("bar_idx").toPandas()["psi"].to_numpy()
    stream = state.windows_psi(values, 100, 50, 10)
    np.testing.assert_allclose(stream, batch[149:].astype(float), rtol=0, atol=1e-9)
    con = duckdb.connect()
    con.register("f", frame)
    sql = con.execute(f"SELECT a.bar_idx, {ROLLING_EDGES} FROM f a JOIN f ref ON ref.bar_idx BETWEEN a.bar_idx - 99 AND a.bar_idx WHERE a.bar_idx >= 99 GROUP BY 1 ORDER BY 1".replace("list(close)", "list(ref.close)")).fetchall()
    ordered = np.sort(np.lib.stride_tricks.sliding_window_view(values, 100), axis=1)
    for (_, edges), s in zip(sql, ordered):
        at = [k / 10 * 99 for k in range(1, 10)]
        assert edges == sorted({float(s[int(x)] + (s[int(x) + 1] - s[int(x)]) * (x - int(x))) for x in at})


def test_hourly_bars_of_events_at_one_time(spark, tmp_path):
    rows = [(i, DAY, "view", float(v), '{"k": 1}') for i, v in enumerate([5, 9, 2, 7])]
    for k, part in enumerate((rows[2:], rows[:2])):
        spark.createDataFrame(part, "event_id bigint, ts timestamp, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    bar = tables.hourly_bars(spark, str(tmp_path)).first()
    assert (bar.open, bar.close) == (5.0, 7.0)
