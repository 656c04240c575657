"""Queries: model jobs over the whole bar tables.

Those of naive Bayes come with SQL, as its fit is an aggregate; those of forests run the published sizes and are checked by
rows and bounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barflow.ml import importance, meta, retrain, signal, validate
from barflow.operators import barriers, features
from barflow.operators.portfolio import closed_trades
from barflow.operators.series import apply_local, index_bars
from barflow.operators.trades import training_rows
from barflow.plans.registry import query, r, us
from barflow.plans.sqlparts import FEATURES as FEATURES_SQL
from barflow.plans.sqlparts import live_labels, with_
from barflow.plans.trading import all_positions
from barflow.schemas import FEATURES
from barflow.session import cut_lineage, shared_dir
from barflow.sources import tables

#: Published sizes: trees of a signal forest, of a forest for feature importance and shares, and of both models of meta-labelling.
TREES, SHARE_TREES, META_TREES = 300, 50, 100


# ------------------------------------------------------------------ comparison SQL of naive Bayes
ROWS = """
lr AS (SELECT symbol, ts, close, log_return, atr, volatility_ratio, norm_rsi, label, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
         count(*) OVER (PARTITION BY symbol) AS nb, row_number() OVER (ORDER BY symbol, ts) - 1 AS rid
       FROM lab WHERE log_return IS NOT NULL AND atr IS NOT NULL AND volatility_ratio IS NOT NULL AND norm_rsi IS NOT NULL AND label IS NOT NULL)"""
ROWS_SQL = FEATURES_SQL + "," + live_labels(expiry="0") + "," + ROWS


def bayes_sql(name: str, train: str, score: str, names: list[str], by: str = "", y: str = "label") -> str:
    """CTE ``name`` (by, rid, prediction, p: map of class to probability) of a model fitted on ``train`` for each value of ``by``."""
    lead = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    mean = ", ".join(f"avg({f}) AS m_{f}, avg({f} * {f}) - avg({f}) * avg({f}) AS v_{f}" for f in names)
    widest = ", ".join(f"avg({f} * {f}) - avg({f}) * avg({f})" for f in names)
    terms = " + ".join(f"ln(v_{f} + eps) + (s.{f} - m_{f}) * (s.{f} - m_{f}) / (v_{f} + eps)" for f in names)
    return f"""
{name}_st AS (SELECT {lead}{y} AS y, count(*) AS n, {mean} FROM {train} GROUP BY {lead}{y}),
{name}_gl AS (SELECT {lead}count(*) AS total, greatest({widest}, -1) * 1e-9 AS eps FROM {train}{f" GROUP BY {by}" if by else ""}),
{name}_raw AS (SELECT {lead}rid, y, ln(n / total) - 0.5 * ({terms}) AS raw FROM {score} s JOIN {name}_st {join} JOIN {name}_gl {join}),
{name}_e AS (SELECT *, exp(raw - max(raw) OVER (PARTITION BY {lead}rid)) AS e FROM {name}_raw),
{name} AS (SELECT {lead}rid, arg_max(y, raw) AS prediction, sum(CASE WHEN y = 1 THEN e ELSE 0 END) / sum(e) AS p_up, sum(CASE WHEN y = -1 THEN e ELSE 0 END) / sum(e) AS p_down
   FROM {name}_e GROUP BY {lead}rid)"""


def labelled(spark, sf_dir):
    """Complete rows with labels -1, 0, +1, numbered per symbol."""
    frame = apply_local(
        tables.indexed_daily(spark, sf_dir), features.feature_op(), barriers.live_barrier(expiry="zero")
    )
    clean = training_rows(frame, columns=FEATURES).drop("bar_idx")
    return cut_lineage(index_bars(clean))


@query("m5_signal_forest")
def signal_forest(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model = signal.train(rows, estimator=signal.forest(TREES))
    out = model.signals(rows)
    return out.select("symbol", us(), "signal", r("p_tp"), r("p_sl"), r("p_time"), r("edge", 3))


@query("m5_signal_boosted")
def signal_boosted(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model = signal.train(rows, estimator=signal.boosted(5, depth=3))
    return model.score(rows).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_tp"), 6).alias("p_tp"))


def _fit_forest(train, test, params):
    model = signal.train(train, estimator=signal.forest(params.get("trees", 10), maxDepth=params.get("depth", 4)))
    return model.score(test)


@query("m3_purged_cv")
def purged_cv(spark, sf_dir):
    return validate.nested_purged_cv(labelled(spark, sf_dir), _fit_forest, 5, 5)


@query("m4_estimator_grid")
def estimator_grid(spark, sf_dir):
    return validate.parameter_grid(labelled(spark, sf_dir), {"depth": [2, 4]}, _fit_forest, 5, 5)


@query("m6_permutation_importance")
def permutation_importance(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model = signal.train(rows, estimator=signal.forest(SHARE_TREES))
    return importance.permutation_importance(model, rows, n_repeats=5)


@query(
    "m5_signal_bayes",
    with_(ROWS_SQL, bayes_sql("nb", "lr", "lr", FEATURES), select="""SELECT symbol, epoch_us(ts) AS ts_us, prediction, round(p_up, 6) AS p_tp, round(p_down, 6) AS p_sl,
        CASE WHEN p_up * greatest(1.5 * atr, 250) - p_down * atr - 2 * (close * 0.001 + close * 2 / 10000) > 0 AND p_up > 0.55 THEN 'BUY' ELSE 'SIT_OUT' END AS signal FROM lr JOIN nb USING (rid)"""),
)
def signal_bayes(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model = signal.train(rows, estimator=signal.bayes())
    scored = model.score(rows).select("symbol", "ts", "prediction")
    return model.signals(rows).select("symbol", "ts", "signal", "p_tp", "p_sl").join(scored, ["symbol", "ts"]).select("symbol", us(), "prediction", r("p_tp"), r("p_sl"), "signal")


FOLDS = """
fr AS (SELECT lr.*, fold, CASE WHEN i >= fold * (nb // 5) AND (fold = 4 OR i < (fold + 1) * (nb // 5)) THEN 'test'
         WHEN fold < 4 AND i >= (fold + 1) * (nb // 5) AND i < (fold + 1) * (nb // 5) + 5 THEN 'embargo' ELSE 'train' END AS role FROM lr, (SELECT unnest(range(0, 5)) AS fold)),
ftr AS (SELECT * FROM fr WHERE role = 'train'),
fte AS (SELECT * FROM fr WHERE role = 'test')"""


def _folds_sql(count: int) -> str:
    """Scores of models on the first ``count`` features."""
    name = f"cv{count}"
    return bayes_sql(name, "ftr", "fte", FEATURES[:count], "fold") + f""",
{name}_s AS (SELECT fold, avg(CASE WHEN prediction = label THEN 1e0 ELSE 0e0 END) AS score FROM fte JOIN {name} USING (fold, rid) GROUP BY fold),
{name}_r AS (SELECT {count} AS features, avg(score) AS mean_score, stddev_pop(score) AS std_score, {", ".join(f"max(CASE WHEN fold = {k} THEN score END) AS fold_{k}" for k in range(5))} FROM {name}_s)"""


SCORES = ["mean_score", "std_score", *(f"fold_{k}" for k in range(5))]
ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in SCORES)


def _fit_bayes(train, test, params):
    names = FEATURES[: params.get("features", len(FEATURES))]
    return signal.train(train, names, estimator=signal.bayes()).score(test)


@query("m3_purged_cv_bayes", with_(ROWS_SQL, FOLDS, _folds_sql(4), select=f"SELECT {ROUNDED} FROM cv4_r"))
def purged_cv_bayes(spark, sf_dir):
    out = validate.nested_purged_cv(labelled(spark, sf_dir), _fit_bayes, 5, 5)
    return out.select(*[r(c, 8) for c in SCORES])


@query(
    "m4_estimator_grid_bayes",
    with_(ROWS_SQL, FOLDS, _folds_sql(1), _folds_sql(2), _folds_sql(4), select=f"SELECT features, {ROUNDED} FROM (FROM cv1_r UNION ALL FROM cv2_r UNION ALL FROM cv4_r)"),
)
def estimator_grid_bayes(spark, sf_dir):
    out = validate.parameter_grid(labelled(spark, sf_dir), {"features": [1, 2, 4]}, _fit_bayes, 5, 5)
    return out.select("features", *[r(c, 8) for c in SCORES])


def permuted_sql(seed: int) -> str:
    """CTEs up to ``dn``: the permutation of ``importance.permuted`` for columns f and rep of ``vs``, with a walk of two steps.

    Each step is materialized, so that the engine does not merge them into one expression.
    """
    p, (k0, k1, k2, k3) = importance.PRIME, importance.KEYS
    ctes, last = [f"v0 AS MATERIALIZED (SELECT *, rid AS x, rid // b AS l, rid % b AS h FROM vs)"], "v0"
    for step in range(3):
        if step:
            ctes.append(f"v{step} AS MATERIALIZED (SELECT * REPLACE (x // b AS l, x % b AS h) FROM {last})")
            last = f"v{step}"
        for turn in range(importance.ROUNDS):
            half, other, m = ("h", "l", "a") if turn % 2 == 0 else ("l", "h", "b")
            k = f"(({seed * k0} + f * {k1} + rep * {k2} + {turn * k3}) % {p})"
            name = f"v{step}_{turn}"
            ctes.append(f"{name}t AS MATERIALIZED (SELECT *, {k} AS k, ({half} * (({k} * 48271) % {p}) + ({k} * 40692) % {p}) % {p} AS t FROM {last})")
            ctes.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (k, t) REPLACE (({other} + (t * (t + k)) % {p}) % {m} AS {other}) FROM {name}t)")
            last = name
        moved = "l * b + h" if step == 0 else "CASE WHEN x < n THEN x ELSE l * b + h END"
        ctes.append(f"w{step} AS MATERIALIZED (SELECT * REPLACE ({moved} AS x) FROM {last})")
        last = f"w{step}"
    return ",\n".join([*ctes, f"dn AS MATERIALIZED (SELECT rid, f, rep, x FROM {last})"])


SHUFFLES = f"""
sz AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM lr),
vs AS (SELECT rid, CAST(f AS BIGINT) AS f, CAST(rep AS BIGINT) AS rep, n, a, (n + a - 1) // a AS b FROM lr, sz, (SELECT unnest(range(0, 4)) AS f), (SELECT unnest(range(0, 5)) AS rep)),
{permuted_sql(42)},
shuf AS (SELECT dn.f, dn.rep, lr.rid * 100 + dn.f * 10 + dn.rep AS rid, lr.label, {", ".join(f"CASE WHEN dn.f = {i} THEN d.{c} ELSE lr.{c} END AS {c}" for i, c in enumerate(FEATURES))}
   FROM dn JOIN lr USING (rid) JOIN lr d ON d.rid = dn.x)"""
LOST = (
    bayes_sql("nb", "lr", "lr", FEATURES) + "," + bayes_sql("ns", "lr", "shuf", FEATURES)
    + f""",
bs AS (SELECT avg(CASE WHEN prediction = label THEN 1e0 ELSE 0e0 END) AS base FROM lr JOIN nb USING (rid)),
ac AS (SELECT f, rep, avg(CASE WHEN prediction = label THEN 1e0 ELSE 0e0 END) AS acc FROM shuf JOIN ns USING (rid) GROUP BY f, rep),
imp AS (SELECT CASE f {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES))} END AS feature, avg(base - acc) AS importance FROM ac, bs GROUP BY f),
rk AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM imp)"""
)


@query("m6_permutation_importance_bayes", with_(ROWS_SQL, SHUFFLES, LOST, select="SELECT feature, round(importance, 8) AS importance FROM imp"))
def permutation_importance_bayes(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model = signal.train(rows, estimator=signal.bayes())
    return importance.permutation_importance(model, rows, n_repeats=5).select("feature", r("importance", 8))


@query("k3_top_features_bayes", with_(ROWS_SQL, SHUFFLES, LOST, select="SELECT feature, round(importance, 8) AS importance, place <= 2 AS kept FROM rk"))
def top_features_bayes(spark, sf_dir):
    kept, scores = importance.prune_features(labelled(spark, sf_dir), FEATURES, signal.bayes, keep=2, n_repeats=5)
    return scores.select("feature", r("importance", 8), F.col("feature").isin(*kept).alias("kept"))


META_BAYES = (
    "act AS (SELECT *, CAST(label > 0 AS INTEGER) AS up FROM lr WHERE label <> 0)," + bayes_sql("pm", "act", "lr", FEATURES, y="CASE WHEN up = 1 THEN 1 ELSE -1 END")
    + """,
jd AS (SELECT act.*, CASE WHEN CASE WHEN p_up >= 0.5 THEN 1 WHEN p_down >= 0.5 THEN -1 ELSE 0 END = label THEN 1 ELSE -1 END AS ok FROM act JOIN pm USING (rid)),"""
    + bayes_sql("mm", "jd", "lr", FEATURES, y="ok")
    + """,
mp AS (SELECT symbol, CASE WHEN pm.p_up >= 0.5 THEN 1 WHEN pm.p_down >= 0.5 THEN -1 ELSE 0 END AS direction, mm.p_up AS ok FROM lr JOIN pm USING (rid) JOIN mm USING (rid)),
mb AS (SELECT symbol, direction, CASE WHEN direction = 1 THEN ok WHEN direction = -1 THEN 1 - ok ELSE 0.5 END AS up FROM mp)"""
)


@query(
    "m8_meta_labelling_bayes",
    with_(ROWS_SQL, META_BAYES, select="""SELECT symbol, direction, CASE WHEN up >= 0.55 THEN 1 WHEN 1 - up >= 0.55 THEN -1 ELSE 0 END AS bet, count(*) AS n, round(avg(up), 6) AS p_up
        FROM mb GROUP BY ALL"""),
)
def meta_labelling_bayes(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    out = meta.fit_meta(rows, FEATURES, primary=signal.bayes(), meta=signal.bayes()).predict(rows, 0.55)
    return out.groupBy("symbol", "direction", "bet").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_up"), 6).alias("p_up"))


@query("k3_top_features")
def top_features(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    kept, scores = importance.prune_features(rows, FEATURES, lambda: signal.forest(SHARE_TREES), keep=2, n_repeats=5)
    return scores.withColumn("kept", F.col("feature").isin(*kept))


@query("k4_feature_share")
def feature_share(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    kept = importance.select_features(rows, FEATURES, 0.5, trees=SHARE_TREES)
    return rows.select("symbol", "ts", *kept)


@query("m8_meta_labelling")
def meta_labelling(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    model = meta.fit_meta(rows, FEATURES, primary=signal.forest(META_TREES), meta=signal.forest(META_TREES))
    out = model.predict(rows, 0.55)
    return out.groupBy("symbol", "direction", "bet").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_up"), 6).alias("p_up"))


@query("m10_milestone_retrain")
def milestone_retrain(spark, sf_dir):
    positions, indexed = all_positions(spark, sf_dir, assume_warm=True)
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    _, metrics = retrain.retrain(indexed, closed_trades(positions), path, expiry="zero", trees=TREES)
    return metrics.select("n_features", "n_samples", "n_estimators", "trade_count", "oos_accuracy", "in_sample_accuracy")
