"""Feature blocks (F01-F24) over the catalogue panel, one query per block."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import features as X
from tidegauge.plans import oracle_base as B
from tidegauge.plans.registry import query
from tidegauge.sources import catalog

IDS = ["entity_id", "period_end"]
E = "entity_id"
W0, UP = B.over("", E), B.upto(E)

B.add("mw", "SELECT entity_id, period_end, " + ", ".join(f'MAX(value) FILTER (series_id = \'{n}\') AS "{n}"' for n in catalog.FEATURE_SOURCES)
      + f", ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY period_end) AS rn FROM macro WHERE series_id IN ({', '.join(repr(n) for n in catalog.FEATURE_SOURCES)}) GROUP BY 1, 2")
B.add("indicators", "SELECT * FROM macro WHERE NOT starts_with(series_id, 'ref_') AND series_id <> 'RECESSION'")
_COUNTER = ", ".join(repr(r[0]) for r in catalog.series_rows() if r[6])
B.add("at_risk", f"""SELECT entity_id, period_end, concat(series_id, '_AT_RISK') AS feature,
 CASE WHEN (series_id IN ({_COUNTER}) AND ROUND(value, 9) >= ROUND(hi, 9)) OR (series_id NOT IN ({_COUNTER}) AND ROUND(value, 9) <= ROUND(lo, 9)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
FROM (SELECT *, COUNT(value) OVER (PARTITION BY entity_id, series_id) AS n,
 {B.guarded('QUANTILE_CONT(value, 0.1)', 'value', B.upto(), 60)} AS lo, {B.guarded('QUANTILE_CONT(value, 0.9)', 'value', B.upto(), 60)} AS hi FROM indicators) WHERE n >= 60""")
_STRONG = "(" + " OR ".join(f"contains(feature, '{n}')" for n in catalog.HIGH_SIGNAL) + ")"
B.add("diffusion", f"""SELECT entity_id, period_end, AVG(value) AS AT_RISK_DIFFUSION,
 0.6 * AVG(value) FILTER ({_STRONG}) + 0.4 * AVG(value) FILTER (NOT {_STRONG}) AS AT_RISK_DIFFUSION_WEIGHTED FROM at_risk GROUP BY 1, 2""")


def flag(cond):
    return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def z(x):
    return B.zscore(x, UP, 24)


def yoy(x):
    return B.pct(x, 12, W0)


def dynamics(x, p):
    return {
        f"{p}_inverted": flag(f"{x} < 0"), f"{p}_inv_depth": f"CASE WHEN {x} IS NOT NULL THEN LEAST({x}, 0.0::DOUBLE) END",
        f"{p}_momentum": f"{x} - LAG({x}, 3) OVER {W0}",
        f"{p}_inv_duration": f"CAST(rn - COALESCE(MAX(CASE WHEN {x} < 0 THEN NULL ELSE rn END) OVER {UP}, 0) AS DOUBLE)",
        f"{p}_vs_ma24": f"{x} - {B.guarded(f'AVG({x})', x, B.trail(24, E), 12)}"}


def diff(x, k):
    return f"{x} - LAG({x}, {k}) OVER {W0}"


# Staged column definitions that restate the blocks in SQL.
STAGES = [
    {"NEAR_TERM_FORWARD_SPREAD": "leading_GS2 - leading_TB3MS", "EBP_PROXY": "financial_BAMLH0A0HYM2 - financial_BAMLC0A0CM",
     "TERM_PREMIUM_ADJ_SPREAD": "leading_T10Y3M - term_structure_THREEFYTP10", "FFR_x_SPREAD": "monetary_DFF * leading_T10Y3M",
     "VU_RATIO": "coincident_JTSJOL / NULLIF(coincident_UNEMPLOY, 0)", "GOODS_SHARE": "coincident_USGOOD / NULLIF(coincident_PAYEMS, 0)"},
    {**dynamics("leading_T10Y3M", "leading_T10Y3M"), **dynamics("leading_T10Y2Y", "leading_T10Y2Y"),
     **dynamics("NEAR_TERM_FORWARD_SPREAD", "NTFS"), **dynamics("TERM_PREMIUM_ADJ_SPREAD", "TP_ADJ_SPREAD"),
     "EBP_PROXY_Z": z("EBP_PROXY"), "baa_z": z("monetary_BAA10Y"), "ted_z": z("monetary_TEDRATE"), "NFCI_Z": z("financial_NFCI"),
     "ma3": B.guarded("AVG(coincident_UNRATE)", "coincident_UNRATE", B.trail(3, E), 3),
     "iur6": B.guarded("AVG(coincident_IURSA)", "coincident_IURSA", B.trail(6, E), 3),
     "FFR_STANCE": f"monetary_DFF - {B.guarded('AVG(monetary_DFF)', 'monetary_DFF', B.trail(36, E), 12)}",
     "HOUSE_PRICE_YOY": yoy("housing_CSUSHPINSA"), "HOUSE_PRICE_MOM3": B.pct("housing_CSUSHPINSA", 3, W0),
     "RESIDENTIAL_INV_YOY": yoy("leading_PRFI"), "RESIDENTIAL_INV_MOM3": B.pct("leading_PRFI", 3, W0),
     "DURABLES_YOY": yoy("leading_PCDG"), "DURABLES_MOM3": B.pct("leading_PCDG", 3, W0),
     "capex": yoy("leading_PNFI"), "jobs": yoy("coincident_PAYEMS"),
     "VU_RATIO_YoY": yoy("VU_RATIO"), "VU_RATIO_Z": z("VU_RATIO"), "QUITS_Z": z("coincident_JTSQUR"), "QUITS_DECLINE_YOY": yoy("coincident_JTSQUR"),
     **{f"{p}_Z": z(f"coincident_{p}") for p in ("CIVPART", "EMRATIO")},
     **{f"{p}_GAP_60M": f"coincident_{p} - " + B.guarded(f"AVG(coincident_{p})", f"coincident_{p}", B.trail(60, E), 24) for p in ("CIVPART", "EMRATIO")},
     **{f"{p}_DROP_6M": diff(f"coincident_{p}", 6) for p in ("CIVPART", "EMRATIO")},
     "GOODS_SHARE_YoY": yoy("GOODS_SHARE"), "goods": yoy("coincident_USGOOD"), "serv": yoy("coincident_USSERV"),
     "SLOOS_CI_LARGE_Z": z("financial_DRTSCILM"), "SLOOS_CI_SMALL_Z": z("financial_DRTSCIS"), "SLOOS_CONSUMER_Z": z("financial_DRTSCLCC"),
     "SLOOS_DEMAND_Z": f"-({z('financial_DRSDCILM')})", "T10Y3M_Z": z("leading_T10Y3M"), "CREDIT_GROWTH_YOY": yoy("financial_TOTALSL")},
    {"SAHM_INDICATOR": f"ma3 - {B.guarded('MIN(ma3)', 'ma3', B.trail(12, E), 6)}", "SOS_INDICATOR": f"iur6 - {B.guarded('MIN(iur6)', 'iur6', B.trail(12, E), 6)}",
     "RESIDENTIAL_INV_Z": z("RESIDENTIAL_INV_YOY"), "DURABLES_Z": z("DURABLES_YOY"), "SECTORAL_DIVERGENCE": "capex - jobs",
     "CREDIT_GROWTH_DECEL": diff("CREDIT_GROWTH_YOY", 12), "EBP_AT_RISK": flag("ROUND(EBP_PROXY_Z, 9) > 1.5"), "HOUSE_PRICE_DECLINING": flag("HOUSE_PRICE_YOY < 0")},
    {"SECTORAL_DIVERGENCE_Z": z("SECTORAL_DIVERGENCE"), "SOS_MOMENTUM": diff("SOS_INDICATOR", 3),
     "SAHM_TRIGGER": flag("ROUND(SAHM_INDICATOR, 9) >= 0.5"), "SOS_TRIGGER": flag("ROUND(SOS_INDICATOR, 9) >= 0.2"),
     "CREDIT_STRESS_INDEX": "(baa_z + ted_z) / 2", "FINANCIAL_STRESS_COMPOSITE": "(NFCI_Z + baa_z) / 2",
     "GRIGOLI_SANDRI_TRIPLE": "leading_T10Y3M_inverted * HOUSE_PRICE_DECLINING * EBP_AT_RISK",
     "RECESSION_CONFIRM_2OF3": flag("leading_T10Y3M_inverted + HOUSE_PRICE_DECLINING + EBP_AT_RISK >= 2"),
     "RESIDENTIAL_INV_DECLINING": flag("RESIDENTIAL_INV_YOY < 0"), "DURABLES_DECLINING": flag("DURABLES_YOY < 0"),
     "K_SHAPE_FLAG": flag("ROUND(capex, 9) > 0.05 AND ROUND(jobs, 9) < 0.01"), "RES_VS_NONRES_SPREAD": "RESIDENTIAL_INV_YOY - capex",
     "VU_DETERIORATION": flag("ROUND(VU_RATIO_YoY, 9) < -0.15"), "QUITS_AT_RISK": flag("ROUND(QUITS_Z, 9) < -1.0"),
     "GOODS_DECLINE_FLAG": flag("goods < 0"), "GOODS_YoY_MINUS_SERV_YoY": "goods - serv",
     "SLOOS_TIGHTENING_FLAG": flag("financial_DRTSCILM > 10"), "SLOOS_ACUTE_TIGHTENING": flag("ROUND(SLOOS_CI_LARGE_Z, 9) > 1.5"),
     "SLOOS_COMPOSITE": "list_avg(list_filter([SLOOS_CI_LARGE_Z, SLOOS_CI_SMALL_Z, SLOOS_CONSUMER_Z], lambda x: x IS NOT NULL))",
     "CREDIT_TIGHTEN_X_CURVE_INVERT": "SLOOS_CI_LARGE_Z * -T10Y3M_Z", "EBP_X_SLOOS": "EBP_PROXY_Z * SLOOS_CI_LARGE_Z"},
]
_sql = "SELECT * FROM mw"
for stage in STAGES:
    _sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM ({_sql})"
B.add("blocks", f"SELECT entity_id, period_end, {', '.join(X.ENGINEERED)} FROM ({_sql})")

STANDARD = {
    "_MoM": B.pct("value", 1, B.over()), "_3M": B.pct("value", 3, B.over()), "_6M": B.pct("value", 6, B.over()), "_YoY": B.pct("value", 12, B.over()),
    "_MA3": B.guarded("AVG(value)", "value", B.trail(3), 3), "_MA6": B.guarded("AVG(value)", "value", B.trail(6), 6),
    "_Vol6M": B.guarded("STDDEV_SAMP(value)", "value", B.trail(6), 6)}
B.add("standard", f"""SELECT entity_id, concat(series_id, suffix) AS feature, period_end, value FROM (
 SELECT entity_id, series_id, period_end, {', '.join(f'{e} AS "{s}"' for s, e in STANDARD.items())} FROM indicators)
 UNPIVOT INCLUDE NULLS (value FOR suffix IN ({', '.join(f'"{s}"' for s in STANDARD)}))""")
B.add("features_long", f"""SELECT entity_id, series_id AS feature, period_end, value FROM macro UNION ALL SELECT * FROM standard
 UNION ALL SELECT entity_id, feature, period_end, value FROM at_risk
 UNION ALL SELECT entity_id, feature, period_end, value FROM diffusion UNPIVOT INCLUDE NULLS (value FOR feature IN (AT_RISK_DIFFUSION, AT_RISK_DIFFUSION_WEIGHTED))
 UNION ALL SELECT entity_id, feature, period_end, value FROM blocks UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(X.ENGINEERED)}))""")
_LABOR, _CREDIT = (", ".join(repr(n) for n in X.block_members(b)) for b in ("labor", "credit"))
LAYER = """CASE WHEN feature = 'RECESSION' OR starts_with(feature, 'ref_') OR starts_with(feature, 'RECESSION_FORWARD_') THEN 'meta'
 WHEN feature IN ('AT_RISK_DIFFUSION', 'AT_RISK_DIFFUSION_WEIGHTED') OR ends_with(feature, '_AT_RISK') THEN 'at_risk' ELSE 'continuous' END"""
BLOCK = f"CASE WHEN feature IN ({_LABOR}) THEN 'labor' WHEN feature IN ({_CREDIT}) THEN 'credit' END"
B.add("feature_variants", """SELECT variant, f.* FROM features_long f JOIN (SELECT feature, UNNEST(list_filter([
 'hybrid', CASE WHEN layer <> 'at_risk' THEN 'continuous_only' END, CASE WHEN layer <> 'continuous' THEN 'at_risk_only' END,
 CASE WHEN layer <> 'at_risk' THEN 'pca_on_binarized' END, CASE WHEN block IS DISTINCT FROM 'labor' THEN 'hybrid_no_b2_labor' END,
 CASE WHEN block IS DISTINCT FROM 'credit' THEN 'hybrid_no_b3_credit' END], lambda x: x IS NOT NULL)) AS variant FROM (
""" + f"SELECT feature, {LAYER} AS layer, {BLOCK} AS block FROM (SELECT DISTINCT feature FROM features_long))) USING (feature)")


@query("f01_standard_transforms", sql="SELECT entity_id, feature, period_end, ROUND(value, 6) AS value FROM standard")
def f01(t):
    return X.standard_transforms(X.indicators_only(t.macro)).withColumn("value", F.round("value", 6))


def _register_block(key: str, title: str) -> None:
    names = X.BLOCKS[key]

    @query(f"{key}_{title}", sql=f"SELECT entity_id, period_end, {', '.join(f'ROUND({n}, 6) AS {n}' for n in names)} FROM blocks")
    def build(t):
        return X.wide_features(t.macro).select(*IDS, *[F.round(n, 6).alias(n) for n in names])


for _key, _title in {
    "f02": "spread_dynamics", "f03": "near_term_forward_spread", "f04": "credit_premium_proxy", "f05": "momentum_trigger",
    "f08": "stress_composites", "f09": "policy_stance", "f10": "premium_adjusted_spread", "f11": "house_price_confirm",
    "f12": "insured_rate_trigger", "f13": "investment_durables", "f14": "sectoral_divergence", "f15": "vacancy_quits",
    "f16": "participation_gaps", "f17": "goods_share", "f18": "lending_survey", "f19": "credit_interactions"}.items():
    _register_block(_key, _title)


def flags(t):
    counter = [r[0] for r in catalog.series_rows() if r[6]]
    return X.at_risk_flags(X.indicators_only(t.macro), counter)


@query("f06_at_risk_flags", sql="SELECT entity_id, feature, period_end, value FROM at_risk")
def f06(t):
    return flags(t).select("entity_id", "feature", "period_end", "value")


@query("f07_diffusion_index", sql="""SELECT entity_id, period_end, ROUND(AT_RISK_DIFFUSION, 6) AS plain, ROUND(AT_RISK_DIFFUSION_WEIGHTED, 6) AS weighted FROM diffusion""")
def f07(t):
    return X.diffusion(flags(t)).select(
        *IDS, F.round("AT_RISK_DIFFUSION", 6).alias("plain"), F.round("AT_RISK_DIFFUSION_WEIGHTED", 6).alias("weighted"))


@query("f20_feature_variants", sql="""SELECT variant, entity_id, COUNT(DISTINCT feature) AS n_features, COUNT(*) AS n_rows, COUNT(value) AS n_values
FROM feature_variants GROUP BY 1, 2""")
def f20(t):
    per_feature = X.with_variants(X.engineer(t.macro)).groupBy("variant", "entity_id", "feature").agg(
        F.count(F.lit(1)).alias("r"), F.count("value").alias("v"))
    return per_feature.groupBy("variant", "entity_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("r").alias("n_rows"), F.sum("v").alias("n_values"))


@query("f21_layer_counts", sql=f"SELECT {LAYER} AS layer, COUNT(DISTINCT feature) AS n_features FROM features_long GROUP BY 1")
def f21(t):
    return X.layer_counts(X.engineer(t.macro))


@query("f22_block_members", sql=f"""SELECT block, feature, COUNT(value) AS n_values FROM (SELECT *, {BLOCK} AS block FROM features_long) WHERE block IS NOT NULL GROUP BY 1, 2""")
def f22(t):
    return X.engineer(t.macro).withColumn("block", X.block()).where("block is not null").groupBy("block", "feature").agg(
        F.count("value").alias("n_values"))


@query("f23_flag_components")
def f23(t):
    names = [f"{n}_AT_RISK" for n in catalog.INDICATORS if n not in {q[0] for q in catalog.series_rows() if q[4] == "Q"}]
    return X.flag_components(flags(t), names)


CORE = list(catalog.MUST_INCLUDE)


@query("f24_must_include_audit", sql=f"""WITH req AS (SELECT UNNEST([{', '.join(repr(n) for n in CORE)}]) AS feature), have AS (SELECT DISTINCT variant, feature FROM feature_variants)
SELECT v.variant, r.feature FROM (SELECT DISTINCT variant FROM have) v, req r ANTI JOIN have h ON h.variant = v.variant AND h.feature = r.feature""")
def f24(t):
    return X.must_include_gaps(X.with_variants(X.engineer(t.macro)), CORE)
