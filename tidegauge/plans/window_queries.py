"""Window primitives (W01-W22) over the five-series panel, gaps included."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import flag, shift_months
from tidegauge.plans import oracle_base as B
from tidegauge.plans.registry import query

KEY = "entity_id, series_id, period_end"
COLS = ["entity_id", "series_id", "period_end"]
V = "value"


def over_panel(t, **columns):
    return t.panel.select(*COLS, *[F.round(c, 6).alias(n) for n, c in columns.items()])


def sql_panel(**columns):
    return f"SELECT {KEY}, " + ", ".join(f"ROUND({c}, 6) AS {n}" for n, c in columns.items()) + " FROM panel"


def w():
    return W.series_window()


@query("w01_pct_change", sql=f"""SELECT {KEY}, {', '.join(f"ROUND({B.pct('value', k, B.over())}, 6) AS p{k}" for k in (1, 3, 6, 12))},
 ROUND({B.pct('padded', 1, B.over())}, 6) AS p1_pad FROM (SELECT *, LAST_VALUE(value IGNORE NULLS) OVER {B.upto()} AS padded FROM panel)""")
def w01(t):
    padded = t.panel.withColumn("padded", W.ffill(V, w()))
    changes = {f"p{k}": W.pct_change(V, k, w()) for k in (1, 3, 6, 12)}
    changes["p1_pad"] = W.pct_change("padded", 1, w(), fill="pad")
    return padded.select(*COLS, *[F.round(c, 6).alias(n) for n, c in changes.items()])


@query("w02_difference", sql=sql_panel(**{f"d{k}": f"value - LAG(value, {k}) OVER {B.over()}" for k in (1, 3, 6)}))
def w02(t):
    return over_panel(t, **{f"d{k}": W.diff(V, k, w()) for k in (1, 3, 6)})


@query("w03_deceleration", sql=f"""SELECT {KEY}, ROUND(yoy - LAG(yoy, 12) OVER {B.over()}, 6) AS decel
FROM (SELECT *, {B.pct('value', 12, B.over())} AS yoy FROM panel)""")
def w03(t):
    yoy = t.panel.withColumn("yoy", W.pct_change(V, 12, w()))
    return yoy.select(*COLS, F.round(W.diff("yoy", 12, w()), 6).alias("decel"))


@query("w04_rolling_mean", sql=sql_panel(**{f"ma{k}": B.guarded("AVG(value)", "value", B.trail(k), k) for k in (3, 6)}))
def w04(t):
    return over_panel(t, **{f"ma{k}": W.rolling_mean(V, k, w()) for k in (3, 6)})


MINIMA = {(24, 12), (36, 12), (60, 24), (6, 3)}


@query("w05_rolling_mean_min_periods", sql=sql_panel(
    **{f"ma{k}_{m}": B.guarded("AVG(value)", "value", B.trail(k), m) for k, m in sorted(MINIMA)}))
def w05(t):
    return over_panel(t, **{f"ma{k}_{m}": W.rolling_mean(V, k, w(), m) for k, m in sorted(MINIMA)})


@query("w06_rolling_std", sql=sql_panel(vol6=B.guarded("STDDEV_SAMP(value)", "value", B.trail(6), 6)))
def w06(t):
    return over_panel(t, vol6=W.rolling_std(V, 6, w()))


@query("w07_rolling_min", sql=sql_panel(low12=B.guarded("MIN(value)", "value", B.trail(12), 6)))
def w07(t):
    return over_panel(t, low12=W.rolling_min(V, 12, w(), 6))


@query("w08_forward_max", sql=f"""SELECT {KEY}, ROUND(CASE WHEN COUNT(*) OVER {B.ahead(6)} = 6 THEN MAX(value) OVER {B.ahead(6)} END, 6) AS peak
FROM panel""")
def w08(t):
    return over_panel(t, peak=W.forward_max(V, 6, w()))


BANDS = {"low": 0.33, "high": 0.67}


@query("w09_rolling_tertile", sql=sql_panel(
    **{n: B.guarded(f"QUANTILE_CONT(value, {q})", "value", B.trail(60), 12) for n, q in BANDS.items()}))
def w09(t):
    return over_panel(t, **{n: W.rolling_quantile(V, q, 60, w(), 12) for n, q in BANDS.items()})


@query("w10_expanding_mean_std", sql=sql_panel(
    m12=B.guarded("AVG(value)", "value", B.upto(), 12), s12=B.guarded("STDDEV_SAMP(value)", "value", B.upto(), 12),
    m24=B.guarded("AVG(value)", "value", B.upto(), 24), s24=B.guarded("STDDEV_SAMP(value)", "value", B.upto(), 24)))
def w10(t):
    return over_panel(
        t, m12=W.expanding_mean(V, w(), 12), s12=W.expanding_std(V, w(), 12),
        m24=W.expanding_mean(V, w(), 24), s24=W.expanding_std(V, w(), 24))


@query("w11_expanding_z", sql=sql_panel(z12=B.zscore("value", B.upto(), 12), z24=B.zscore("value", B.upto(), 24)))
def w11(t):
    return over_panel(t, z12=W.expanding_z(V, w(), 12), z24=W.expanding_z(V, w(), 24))


@query("w12_expanding_quantile_flag", sql=f"""SELECT {KEY}, ROUND(q10, 6) AS q10, ROUND(q90, 6) AS q90,
 CASE WHEN ROUND(value, 9) <= ROUND(q10, 9) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS low_flag, CASE WHEN ROUND(value, 9) >= ROUND(q90, 9) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high_flag
FROM (SELECT *, {B.guarded('QUANTILE_CONT(value, 0.1)', 'value', B.upto(), 60)} AS q10,
 {B.guarded('QUANTILE_CONT(value, 0.9)', 'value', B.upto(), 60)} AS q90 FROM panel)""")
def w12(t):
    df = t.panel.withColumns({"q10": W.expanding_quantile(V, 0.1, w(), 60), "q90": W.expanding_quantile(V, 0.9, w(), 60)})
    r = lambda c: F.round(c, 9)
    return df.select(
        *COLS, F.round("q10", 6).alias("q10"), F.round("q90", 6).alias("q90"),
        flag(r(V) <= r("q10")).alias("low_flag"), flag(r(V) >= r("q90")).alias("high_flag"))


B.add("islands", f"""SELECT entity_id, period_end, flag, SUM(new) OVER {B.upto('entity_id')} AS island FROM (
 SELECT *, CASE WHEN flag IS NOT DISTINCT FROM LAG(flag) OVER {B.over('', 'entity_id')} THEN 0 ELSE 1 END AS new FROM regime)""")


@query("w13_run_length", sql=f"""SELECT entity_id, period_end,
 CAST(SUM(flag) OVER (PARTITION BY entity_id, island ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS months_in_state FROM islands""")
def w13(t):
    we = W.by("entity_id")
    return t.regime.withColumn("rn", W.position(we)).select(
        "entity_id", "period_end", W.run_length(F.col("flag") == 1.0, we).alias("months_in_state"))


@query("w14_centred_mean", sql=f"""SELECT entity_id, period_end,
 ROUND(AVG(flag) OVER {B.over('ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING', 'entity_id')}, 6) AS rate13 FROM regime""")
def w14(t):
    return t.regime.select("entity_id", "period_end", F.round(W.centred_mean("flag", 6, W.by("entity_id")), 6).alias("rate13"))


@query("w15_tertile_state", sql=f"""SELECT {KEY}, CASE WHEN value IS NULL OR lo IS NULL OR hi IS NULL THEN NULL
 WHEN ROUND(value, 9) >= ROUND(hi, 9) THEN 'strong' WHEN ROUND(value, 9) <= ROUND(lo, 9) THEN 'weak' ELSE 'neutral' END AS state
FROM (SELECT *, {B.guarded('QUANTILE_CONT(value, 0.33)', 'value', B.trail(60), 12)} AS lo,
 {B.guarded('QUANTILE_CONT(value, 0.67)', 'value', B.trail(60), 12)} AS hi FROM panel)""")
def w15(t):
    bands = {n: W.rolling_quantile(V, q, 60, w(), 12) for n, q in BANDS.items()}
    return t.panel.withColumns(bands).select(*COLS, W.tertile_state(V, "low", "high").alias("state"))


@query("w16_last_known", sql="""SELECT entity_id, series_id, ROUND(arg_max(value, period_end) FILTER (value IS NOT NULL), 6) AS latest,
 ROUND(arg_max(value, period_end) FILTER (value IS NOT NULL AND period_end <= DATE '1999-12-31'), 6) AS at_cut FROM panel GROUP BY 1, 2""")
def w16(t):
    cut = F.lit("1999-12-31").cast("date")
    return t.panel.groupBy("entity_id", "series_id").agg(
        F.round(W.last_known(V), 6).alias("latest"), F.round(W.last_known(V, upto=cut), 6).alias("at_cut"))


@query("w17_change_3m", sql="""WITH last AS (SELECT entity_id, series_id, MAX(period_end) AS d FROM panel WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT entity_id, series_id, ROUND(arg_max(value, period_end) - arg_max(value, period_end) FILTER (period_end <= last_day(d - INTERVAL 3 MONTH)), 6) AS delta
FROM panel JOIN last USING (entity_id, series_id) WHERE value IS NOT NULL GROUP BY 1, 2""")
def w17(t):
    whole = Window.partitionBy("entity_id", "series_id")
    df = t.panel.withColumn("_d", F.max(F.when(F.col(V).isNotNull(), F.col("period_end"))).over(whole))
    before = W.last_known(V, upto=shift_months("_d", -3))
    return df.groupBy("entity_id", "series_id").agg(F.round(W.last_known(V) - before, 6).alias("delta"))


@query("w18_row_position", longs=("from_end",), sql=f"""SELECT {KEY}, ROUND(value, 6) AS value, r AS from_end FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, series_id ORDER BY period_end DESC) AS r FROM panel) WHERE r <= 12""")
def w18(t):
    newest = Window.partitionBy("entity_id", "series_id").orderBy(F.col("period_end").desc())
    return t.panel.withColumn("from_end", F.row_number().over(newest)).where("from_end <= 12").select(
        *COLS, F.round(V, 6).alias(V), "from_end")


@query("w19_first_crossing", sql="SELECT entity_id, model, MIN(period_end) FILTER (prob >= 0.8) AS first_crossing FROM score_panel GROUP BY 1, 2")
def w19(t):
    return t.score_panel.groupBy("entity_id", "model").agg(W.first_date_where(F.col("prob") >= 0.8).alias("first_crossing"))


@query("w20_rank_with_tie_break", longs=("rank",), sql="""WITH s AS (SELECT entity_id, series_id, ROUND(AVG(value), 1) AS score FROM panel GROUP BY 1, 2)
SELECT entity_id, series_id, score, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY score DESC, series_id) AS rank FROM s""")
def w20(t):
    score = t.panel.groupBy("entity_id", "series_id").agg(
        F.round(F.avg(V), 1).alias("score"))
    order = Window.partitionBy("entity_id").orderBy(F.col("score").desc(), "series_id")
    return score.withColumn("rank", F.row_number().over(order))


@query("w21_latest_per_group", sql="""SELECT entity_id, model, MAX(period_end) AS period_end, ROUND(arg_max(prob, period_end), 6) AS prob
FROM score_panel GROUP BY 1, 2""")
def w21(t):
    latest = t.score_panel.groupBy("entity_id", "model").agg(F.max(F.struct("period_end", "prob")).alias("x"))
    return latest.select("entity_id", "model", "x.period_end", F.round("x.prob", 6).alias("prob"))


@query("w22_islands", sql="""SELECT entity_id, MIN(period_end) AS start_month, MAX(period_end) AS end_month, COUNT(*) AS months
FROM islands WHERE flag = 1.0 GROUP BY entity_id, island""")
def w22(t):
    marked = W.with_islands(t.regime, F.col("flag"), W.by("entity_id"))
    return marked.where("flag = 1.0").groupBy("entity_id", "island").agg(
        F.min("period_end").alias("start_month"), F.max("period_end").alias("end_month"), F.count(F.lit(1)).alias("months")
    ).drop("island")
