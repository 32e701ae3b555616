"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.functions import windows as W
from tidegauge.plans import oracle_base as B
from tidegauge.plans.registry import query
from tidegauge.sources import catalog

KEY = "entity_id, period_end"
COLS = ["entity_id", "period_end"]

# A few catalogue series side by side.
NAMES = ["leading_T10Y3M", "leading_T10Y2Y", "monetary_DFF", "coincident_UNRATE", "financial_NFCI", "coincident_PAYEMS"]
B.add("six", f"SELECT {KEY}, " + ", ".join(f'MAX(value) FILTER (series_id = \'{n}\') AS "{n}"' for n in NAMES)
      + f" FROM macro WHERE series_id IN ({', '.join(repr(n) for n in NAMES)}) GROUP BY 1, 2")


def six(t):
    from tidegauge.operators.align import pivot_wide

    return pivot_wide(t.macro, NAMES)


@query("p01_threshold_flags", sql=f"""SELECT {KEY}, CASE WHEN leading_T10Y3M < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS inverted,
 CASE WHEN coincident_UNRATE >= 0.50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS trigger, CASE WHEN financial_NFCI > 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stress FROM six""")
def p01(t):
    return six(t).select(*COLS, S.flag(F.col("leading_T10Y3M") < 0).alias("inverted"),
                         S.flag(F.col("coincident_UNRATE") >= 0.5).alias("trigger"), S.flag(F.col("financial_NFCI") > 1.5).alias("stress"))


@query("p02_one_sided_clip", sql=f"SELECT {KEY}, ROUND(CASE WHEN leading_T10Y3M IS NOT NULL THEN LEAST(leading_T10Y3M, 0) END, 6) AS depth FROM six")
def p02(t):
    return six(t).select(*COLS, F.round(S.clip("leading_T10Y3M", high=0), 6).alias("depth"))


@query("p03_two_sided_clip", sql=f"""SELECT {KEY}, ROUND(CASE WHEN m2 IS NOT NULL THEN GREATEST(0.2, LEAST(0.8, m2)) END, 6) AS clipped,
 ROUND(CASE WHEN m2 IS NOT NULL THEN GREATEST(1e-6, LEAST(1 - 1e-6, m2 - 0.01)) END, 6) AS open FROM score_wide""")
def p03(t):
    return t.score_wide.select(*COLS, F.round(S.clip("m2", 0.2, 0.8), 6).alias("clipped"),
                               F.round(S.clip(F.col("m2") - 0.01, 1e-6, 1 - 1e-6), 6).alias("open"))


@query("p04_spread_interaction_ratio", sql=f"""SELECT {KEY}, ROUND(leading_T10Y3M - leading_T10Y2Y, 6) AS spread,
 ROUND(monetary_DFF * leading_T10Y3M, 6) AS product, ROUND(monetary_DFF / NULLIF(coincident_UNRATE, 0), 6) AS ratio FROM six""")
def p04(t):
    return six(t).select(
        *COLS, F.round(F.col("leading_T10Y3M") - F.col("leading_T10Y2Y"), 6).alias("spread"),
        F.round(F.col("monetary_DFF") * F.col("leading_T10Y3M"), 6).alias("product"),
        F.round(S.ratio("monetary_DFF", "coincident_UNRATE"), 6).alias("ratio"))


@query("p05_safe_ratio", sql=f"""SELECT {KEY}, ROUND(monetary_DFF / CASE WHEN ABS(leading_T10Y3M) > 1e-12 THEN leading_T10Y3M END, 6) AS ratio FROM six""")
def p05(t):
    return six(t).select(*COLS, F.round(S.safe_ratio("monetary_DFF", "leading_T10Y3M"), 6).alias("ratio"))


@query("p06_conjunction_flag", sql=f"""SELECT {KEY}, CASE WHEN leading_T10Y3M > 5 AND financial_NFCI < 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS both FROM six""")
def p06(t):
    return six(t).select(*COLS, S.flag((F.col("leading_T10Y3M") > 5) & (F.col("financial_NFCI") < 1)).alias("both"))


_F = [("leading_T10Y3M", "<", 0), ("leading_T10Y2Y", "<", 0), ("financial_NFCI", ">", 0)]
_FS = [f"CASE WHEN {c} {o} {v} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for c, o, v in _F]


@query("p07_flag_combinations", sql=f"""SELECT {KEY}, {' * '.join(_FS)} AS all_three, CASE WHEN {' + '.join(_FS)} >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS two_of_three FROM six""")
def p07(t):
    flags = [S.flag(F.expr(f"{c} {o} {v}")) for c, o, v in _F]
    return six(t).select(*COLS, S.all_flags(*flags).alias("all_three"), S.at_least(2, *flags).alias("two_of_three"))


@query("p08_row_mean", sql=f"""SELECT {KEY}, ROUND(AVG(value), 6) AS long_mean, ROUND(AVG(value), 6) AS wide_mean FROM macro
 WHERE series_id IN ('leading_T10Y3M', 'leading_PRFI', 'financial_DRTSCILM') GROUP BY 1, 2""")
def p08(t):
    names = ["leading_T10Y3M", "leading_PRFI", "financial_DRTSCILM"]
    picked = t.macro.where(F.col("series_id").isin(names))
    value = lambda n: F.max(F.when(F.col("series_id") == n, F.col("value")))
    return picked.groupBy(*COLS).agg(
        F.round(F.avg("value"), 6).alias("long_mean"), F.round(S.row_mean(*[value(n) for n in names]), 6).alias("wide_mean"))


@query("p09_row_spread", sql=f"""SELECT {KEY}, ROUND(MAX(prob) - MIN(prob), 6) AS spread, ROUND(STDDEV_POP(prob), 6) AS std0,
 ROUND(STDDEV_SAMP(prob), 6) AS std1 FROM score_panel WHERE model <> 'ensemble' GROUP BY 1, 2""")
def p09(t):
    return t.score_panel.where("model <> 'ensemble'").groupBy(*COLS).agg(
        F.round(F.max("prob") - F.min("prob"), 6).alias("spread"), F.round(F.stddev_pop("prob"), 6).alias("std0"),
        F.round(F.stddev_samp("prob"), 6).alias("std1"))


@query("p10_logit_decay", sql=f"""SELECT {KEY}, ROUND(LN(q / (1 - q)), 6) AS logit, ROUND(LN(1 + GREATEST(0, q - 0.2)), 6) AS log_excess,
 ROUND(POW(0.5, age / 120.0), 6) AS decay FROM (SELECT *, GREATEST(1e-6, LEAST(1 - 1e-6, m2)) AS q,
 ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY period_end DESC) - 1 AS age FROM score_wide WHERE m2 IS NOT NULL)""")
def p10(t):
    newest = Window.partitionBy("entity_id").orderBy(F.col("period_end").desc())
    known = t.score_wide.where("m2 is not null").withColumn("age", F.row_number().over(newest) - 1)
    return known.select(
        *COLS, F.round(S.logit("m2"), 6).alias("logit"), F.round(F.log1p(F.greatest(F.lit(0.0), F.col("m2") - 0.2)), 6).alias("log_excess"),
        F.round(S.half_life(F.col("age"), 120), 6).alias("decay"))


@query("p11_rounding", sql="SELECT row_id, ROUND(m3 + 0.00001, 2) AS p2, ROUND(m3 + 0.0000001, 4) AS p4 FROM score_rows")
def p11(t):
    return t.score_rows.select("row_id", F.round(F.col("m3") + 0.00001, 2).alias("p2"), F.round(F.col("m3") + 0.0000001, 4).alias("p4"))


@query("p12_rescale", sql=f"""SELECT entity_id, series_id, period_end, ROUND(value * scale, 6) AS scaled,
 ROUND(CASE WHEN MAX(value) OVER (PARTITION BY entity_id, series_id) > 1.5 THEN value / 100 ELSE value END, 6) AS detected
FROM macro JOIN series_catalog USING (series_id) WHERE category = 'reference'""")
def p12(t):
    top = F.max("value").over(Window.partitionBy("entity_id", "series_id"))
    peers = catalog.series_catalog(t.spark).where("category = 'reference'").select("series_id", "scale")
    return t.macro.join(peers, "series_id").select(
        "entity_id", "series_id", "period_end", F.round(F.col("value") * F.col("scale"), 6).alias("scaled"),
        F.round(F.when(top > 1.5, F.col("value") / 100).otherwise(F.col("value")), 6).alias("detected"))


_BAND = "CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.15 THEN 'LOW' WHEN {p} < 0.35 THEN 'MODERATE' WHEN {p} < 0.6 THEN 'ELEVATED' ELSE 'HIGH' END"


@query("p13_risk_band", sql=f"SELECT {KEY}, model, {_BAND.format(p='prob')} AS band FROM score_panel")
def p13(t):
    return t.score_panel.select(*COLS, "model", S.risk_band("prob").alias("band"))


@query("p14_relative_signal", sql=f"""WITH thr AS (SELECT model, ROUND(AVG(prob), 2) AS threshold FROM score_panel GROUP BY 1)
SELECT {KEY}, model, threshold, CASE WHEN prob < 0.3 * threshold THEN 'LOW' WHEN prob < 0.7 * threshold THEN 'MODERATE'
 WHEN prob < threshold THEN 'ELEVATED' ELSE 'HIGH' END AS signal FROM score_panel JOIN thr USING (model)""")
def p14(t):
    thresholds = t.score_panel.groupBy("model").agg(F.round(F.avg("prob"), 2).alias("threshold"))
    return t.score_panel.join(thresholds, "model").select(
        *COLS, "model", "threshold", S.relative_signal("prob", "threshold").alias("signal"))


B.add("two_horizons", """SELECT entity_id, 6 AS horizon, period_end, ensemble AS prob, 0.45 AS threshold FROM score_wide WHERE ensemble IS NOT NULL
 UNION ALL SELECT entity_id, 18, period_end, m2, 0.6 FROM score_wide WHERE m2 IS NOT NULL AND period_end <= DATE '2001-02-28'""")


def two_horizons(t):
    base = t.score_wide
    near = base.where("ensemble is not null").select(
        "entity_id", F.lit(6).alias("horizon"), "period_end", F.col("ensemble").alias("prob"), F.lit(0.45).alias("threshold"))
    far = base.where("m2 is not null and period_end <= date '2001-02-28'").select(
        "entity_id", F.lit(18).alias("horizon"), "period_end", F.col("m2").alias("prob"), F.lit(0.6).alias("threshold"))
    return near.unionByName(far)


@query("p15_secondary_horizon", sql="""WITH last AS (SELECT entity_id, horizon, threshold, arg_max(prob, period_end) AS prob FROM two_horizons GROUP BY 1, 2, 3)
SELECT a.entity_id, ROUND(a.prob, 6) AS near, ROUND(b.prob, 6) AS far, ROUND(b.prob - b.threshold, 6) AS far_gap, b.prob >= b.threshold AS far_signal
FROM last a JOIN last b ON a.entity_id = b.entity_id AND a.horizon = 6 AND b.horizon = 18""")
def p15(t):
    at = lambda h, c: F.max_by(F.when(F.col("horizon") == h, F.col(c)), F.when(F.col("horizon") == h, F.col("period_end")))
    out = two_horizons(t).groupBy("entity_id").agg(at(6, "prob").alias("near"), at(18, "prob").alias("far"), at(18, "threshold").alias("t"))
    return out.select("entity_id", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"),
                      F.round(F.col("far") - F.col("t"), 6).alias("far_gap"), (F.col("far") >= F.col("t")).alias("far_signal"))


@query("p16_name_predicates", sql="""SELECT series_id, starts_with(series_id, 'ref_') AS is_peer, ends_with(series_id, '3M') AS three_month,
 series_id LIKE '%T10%' AS ten_year, series_id IN ('coincident_UNRATE', 'leading_ICSA') AS listed, COUNT(value) AS n FROM macro GROUP BY series_id""")
def p16(t):
    s = F.col("series_id")
    return t.macro.groupBy(s).agg(F.count("value").alias("n")).select(
        s, F.startswith(s, F.lit("ref_")).alias("is_peer"), F.endswith(s, F.lit("3M")).alias("three_month"), s.contains("T10").alias("ten_year"),
        s.isin("coincident_UNRATE", "leading_ICSA").alias("listed"), "n")


@query("p17_text_coercion", sql="""SELECT o_orderkey, o_orderpriority ILIKE '%urgent%' AS urgent, TRY_CAST(CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE '?' END AS BOOLEAN) AS failed,
 TRY_CAST(split_part(txt, '/', 1) AS BIGINT) AS hits, TRY_CAST(split_part(txt, '/', 2) AS BIGINT) AS total FROM (
 SELECT *, concat(CAST(o_orderkey % 5 AS VARCHAR), '/', CAST(o_custkey % 9 AS VARCHAR)) AS txt FROM orders)""")
def p17(t):
    hits, total = S.parse_fraction("txt")
    status = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("?")
    text = F.concat_ws("/", F.col("o_orderkey") % 5, F.col("o_custkey") % 9)
    return t.read("orders").withColumn("txt", text).withColumn("status", status).select(
        "o_orderkey", F.col("o_orderpriority").ilike("%urgent%").alias("urgent"), S.parse_bool("status").alias("failed"),
        hits.alias("hits"), total.alias("total"))


@query("p18_category_lookup", sql="""SELECT series_id, description, native_freq, COUNT(value) AS n FROM macro JOIN series_catalog USING (series_id)
WHERE category = 'financial' GROUP BY 1, 2, 3""")
def p18(t):
    financial = catalog.series_catalog(t.spark).where("category = 'financial'").select("series_id", "description", "native_freq")
    return t.macro.join(financial, "series_id").groupBy("series_id", "description", "native_freq").agg(F.count("value").alias("n"))


@query("p19_range_and_horizon", sql="""WITH h AS (SELECT entity_id, COALESCE(MAX(horizon) FILTER (horizon = 12), MAX(horizon)) AS chosen FROM two_horizons GROUP BY 1)
SELECT x.entity_id, horizon, period_end, ROUND(prob, 6) AS prob FROM two_horizons x JOIN h ON x.entity_id = h.entity_id AND horizon = chosen
WHERE period_end BETWEEN DATE '1998-01-31' AND DATE '2000-12-31'""")
def p19(t):
    whole = Window.partitionBy("entity_id")
    asked = F.max(F.when(F.col("horizon") == 12, F.col("horizon"))).over(whole)
    chosen = F.coalesce(asked, F.max("horizon").over(whole))
    return two_horizons(t).withColumn("_c", chosen).where("horizon = _c and period_end between date '1998-01-31' and date '2000-12-31'").select(
        "entity_id", "horizon", "period_end", F.round("prob", 6).alias("prob"))
