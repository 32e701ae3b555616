"""Feature engineering.

Per-series transforms run once over the long panel. Cross-series blocks run on a
wide frame that only holds the sources they need: ``wide_features`` declares all of
them, and selecting a few lets the optimizer prune the rest, windows included.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.scalars import all_flags, at_least, clip, col, flag, ratio, row_mean
from tidegauge.operators.align import pivot_wide, unpivot_long
from tidegauge.sources import catalog

FLAG_DIGITS = 9
#: Rows that the standard transforms look back.
REACH = 12


# Output columns per block, in the order of the tiers.
BLOCKS = {
    "f02": [f"{s}_{x}" for s in ("leading_T10Y3M", "leading_T10Y2Y")
            for x in ("inverted", "inv_depth", "momentum", "inv_duration", "vs_ma24")],
    "f03": ["NEAR_TERM_FORWARD_SPREAD", "NTFS_inverted", "NTFS_momentum", "NTFS_inv_depth", "NTFS_inv_duration", "NTFS_vs_ma24"],
    "f04": ["EBP_PROXY", "EBP_PROXY_Z", "EBP_AT_RISK"],
    "f05": ["SAHM_INDICATOR", "SAHM_TRIGGER"],
    "f08": ["CREDIT_STRESS_INDEX", "NFCI_Z", "FINANCIAL_STRESS_COMPOSITE"],
    "f09": ["FFR_x_SPREAD", "FFR_STANCE"],
    "f10": ["TERM_PREMIUM_ADJ_SPREAD", "TP_ADJ_SPREAD_inverted", "TP_ADJ_SPREAD_momentum", "TP_ADJ_SPREAD_inv_duration", "TP_ADJ_SPREAD_vs_ma24"],
    "f11": ["HOUSE_PRICE_YOY", "HOUSE_PRICE_MOM3", "HOUSE_PRICE_DECLINING", "GRIGOLI_SANDRI_TRIPLE", "RECESSION_CONFIRM_2OF3"],
    "f12": ["SOS_INDICATOR", "SOS_TRIGGER", "SOS_MOMENTUM"],
    "f13": [f"{p}_{x}" for p in ("RESIDENTIAL_INV", "DURABLES") for x in ("YOY", "MOM3", "DECLINING", "Z")],
    "f14": ["SECTORAL_DIVERGENCE", "SECTORAL_DIVERGENCE_Z", "K_SHAPE_FLAG", "RES_VS_NONRES_SPREAD"],
    "f15": ["VU_RATIO", "VU_RATIO_YoY", "VU_RATIO_Z", "VU_DETERIORATION", "QUITS_Z", "QUITS_DECLINE_YOY", "QUITS_AT_RISK"],
    "f16": [f"{p}_{x}" for p in ("CIVPART", "EMRATIO") for x in ("Z", "GAP_60M", "DROP_6M")],
    "f17": ["GOODS_SHARE", "GOODS_SHARE_YoY", "GOODS_DECLINE_FLAG", "GOODS_YoY_MINUS_SERV_YoY"],
    "f18": ["SLOOS_CI_LARGE_Z", "SLOOS_CI_SMALL_Z", "SLOOS_CONSUMER_Z", "SLOOS_DEMAND_Z", "SLOOS_TIGHTENING_FLAG", "SLOOS_ACUTE_TIGHTENING", "SLOOS_COMPOSITE"],
    "f19": ["T10Y3M_Z", "CREDIT_TIGHTEN_X_CURVE_INVERT", "EBP_X_SLOOS", "CREDIT_GROWTH_YOY", "CREDIT_GROWTH_DECEL"],
}
ENGINEERED = [name for names in BLOCKS.values() for name in names]


def _columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def _r(x: str | Column) -> Column:
    return F.round(col(x), FLAG_DIGITS)


# ---- per-series transforms (long) -------------------------------------------


def _standard(x: str, w) -> dict[str, Column]:
    return {
        "_MoM": W.pct_change(x, 1, w), "_3M": W.pct_change(x, 3, w), "_6M": W.pct_change(x, 6, w), "_YoY": W.pct_change(x, 12, w),
        "_MA3": W.rolling_mean(x, 3, w), "_MA6": W.rolling_mean(x, 6, w), "_Vol6M": W.rolling_std(x, 6, w),
    }


def standard_transforms(panel: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Changes over 1/3/6/12 months, 3- and 6-month means, 6-month volatility of every indicator."""
    parts = _standard("value", W.series_window(*keys))
    named = panel.select(*keys, "entity_id", "series_id", "period_end", *[c.alias(s) for s, c in parts.items()])
    rows = F.array(*[F.struct(F.concat("series_id", F.lit(s)).alias("feature"), F.col(s).alias("value")) for s in parts])
    return named.select(*keys, "entity_id", "period_end", F.inline(rows))


def indicators_only(panel: DataFrame) -> DataFrame:
    return panel.where(~F.col("series_id").startswith("ref_") & (F.col("series_id") != "RECESSION"))


def _at_risk(countercyclical: list[str], minimum: int, tail: float, keys: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    """Window columns and the flag over them. Only the tail a series needs is evaluated."""
    w = W.series_window(*keys)
    counter = F.col("series_id").isin(countercyclical)
    helpers = {
        "_n": F.count("value").over(W.whole(w)),
        "_low": W.expanding_quantile(F.when(~counter, F.col("value")), tail, w, minimum),
        "_high": W.expanding_quantile(F.when(counter, F.col("value")), 1 - tail, w, minimum),
    }
    return helpers, F.when(counter, flag(_r("value") >= _r("_high"))).otherwise(flag(_r("value") <= _r("_low")))


def at_risk_flags(panel: DataFrame, countercyclical: list[str], minimum: int = 60, tail: float = 0.10, keys: tuple[str, ...] = ()) -> DataFrame:
    """1.0 while an indicator sits in the weak tail of its own history.

    A series takes part once it has ``minimum`` observations in the frame; before that
    many rows have passed, its flag is 0.0 (unknown counts as not at risk).
    """
    helpers, hit = _at_risk(countercyclical, minimum, tail, keys)
    df = panel.withColumns(helpers).where(F.col("_n") >= minimum)
    return df.select(*keys, "entity_id", "period_end", F.concat("series_id", F.lit("_AT_RISK")).alias("feature"), hit.alias("value"))


def long_features(panel: DataFrame, countercyclical: list[str], minimum: int = 60, tail: float = 0.10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Raw values, standard transforms and at-risk flags of every series from one windowed pass.

    Peers and the target keep their raw value only.
    """
    w = W.series_window(*keys)
    helpers, hit = _at_risk(countercyclical, minimum, tail, keys)
    parts = _standard("value", w)
    wide = panel.withColumns({**{f"_t{s}": c for s, c in parts.items()}, **helpers})
    name = lambda s: F.concat("series_id", F.lit(s)).alias("feature")
    raw = F.struct(F.col("series_id").alias("feature"), F.col("value").alias("value"))
    derived = [F.struct(name(s), F.col(f"_t{s}").alias("value")) for s in parts]
    risk = F.struct(name("_AT_RISK"), hit.alias("value"))
    indicator = ~F.col("series_id").startswith("ref_") & (F.col("series_id") != "RECESSION")
    rows = F.when(indicator & (F.col("_n") >= minimum), F.array(raw, *derived, risk)).when(indicator, F.array(raw, *derived)).otherwise(F.array(raw))
    return wide.select(*keys, "entity_id", "period_end", F.inline(rows))


def diffusion(flags: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of indicators at risk, plain and with strong predictors weighted 60 %."""
    strong = flags["feature"].contains(catalog.HIGH_SIGNAL[0])
    for name in catalog.HIGH_SIGNAL[1:]:
        strong = strong | F.col("feature").contains(name)
    weighted = F.avg(F.when(strong, F.col("value"))) * 0.6 + F.avg(F.when(~strong, F.col("value"))) * 0.4
    return flags.groupBy(*keys, "entity_id", "period_end").agg(
        F.avg("value").alias("AT_RISK_DIFFUSION"), weighted.alias("AT_RISK_DIFFUSION_WEIGHTED"))


# ---- cross-series blocks (wide) ----------------------------------------------


def _spread_dynamics(x: str, prefix: str, w) -> dict[str, Column]:
    return {
        f"{prefix}_inverted": flag(col(x) < 0),
        f"{prefix}_inv_depth": clip(x, high=0),
        f"{prefix}_momentum": W.diff(x, 3, w),
        f"{prefix}_inv_duration": W.run_length(col(x) < 0, w, "_rn").cast("double"),
        f"{prefix}_vs_ma24": col(x) - W.rolling_mean(x, 24, w, 12),
    }


def wide_features(panel: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All cross-series columns of the tiers, from a long panel with the catalogue's series names."""
    wide = pivot_wide(panel, catalog.FEATURE_SOURCES, [*keys, "entity_id", "period_end"])
    w = W.by(*keys, "entity_id")
    c = F.col

    # Row-wise combinations of sources.
    level = _columns(wide, {
        "_rn": F.row_number().over(w),
        "NEAR_TERM_FORWARD_SPREAD": c("leading_GS2") - c("leading_TB3MS"),
        "EBP_PROXY": c("financial_BAMLH0A0HYM2") - c("financial_BAMLC0A0CM"),
        "TERM_PREMIUM_ADJ_SPREAD": c("leading_T10Y3M") - c("term_structure_THREEFYTP10"),
        "FFR_x_SPREAD": c("monetary_DFF") * c("leading_T10Y3M"),
        "VU_RATIO": ratio("coincident_JTSJOL", "coincident_UNEMPLOY"),
        "GOODS_SHARE": ratio("coincident_USGOOD", "coincident_PAYEMS"),
    })

    # First layer of windows: everything that looks at sources or levels.
    yoy = lambda x: W.pct_change(x, 12, w)
    z = lambda x: W.expanding_z(x, w, 24)
    first = _columns(level, {
        **_spread_dynamics("leading_T10Y3M", "leading_T10Y3M", w),
        **_spread_dynamics("leading_T10Y2Y", "leading_T10Y2Y", w),
        **_spread_dynamics("NEAR_TERM_FORWARD_SPREAD", "NTFS", w),
        **_spread_dynamics("TERM_PREMIUM_ADJ_SPREAD", "TP_ADJ_SPREAD", w),
        "EBP_PROXY_Z": z("EBP_PROXY"), "_baa_z": z("monetary_BAA10Y"), "_ted_z": z("monetary_TEDRATE"), "NFCI_Z": z("financial_NFCI"),
        "_unrate_ma3": W.rolling_mean("coincident_UNRATE", 3, w), "_iur_ma6": W.rolling_mean("coincident_IURSA", 6, w, 3),
        "FFR_STANCE": c("monetary_DFF") - W.rolling_mean("monetary_DFF", 36, w, 12),
        "HOUSE_PRICE_YOY": yoy("housing_CSUSHPINSA"), "HOUSE_PRICE_MOM3": W.pct_change("housing_CSUSHPINSA", 3, w),
        "RESIDENTIAL_INV_YOY": yoy("leading_PRFI"), "RESIDENTIAL_INV_MOM3": W.pct_change("leading_PRFI", 3, w),
        "DURABLES_YOY": yoy("leading_PCDG"), "DURABLES_MOM3": W.pct_change("leading_PCDG", 3, w),
        "_capex_yoy": yoy("leading_PNFI"), "_payems_yoy": yoy("coincident_PAYEMS"),
        "VU_RATIO_YoY": yoy("VU_RATIO"), "VU_RATIO_Z": z("VU_RATIO"),
        "QUITS_Z": z("coincident_JTSQUR"), "QUITS_DECLINE_YOY": yoy("coincident_JTSQUR"),
        **{f"{p}_Z": z(f"coincident_{p}") for p in ("CIVPART", "EMRATIO")},
        **{f"{p}_GAP_60M": c(f"coincident_{p}") - W.rolling_mean(f"coincident_{p}", 60, w, 24) for p in ("CIVPART", "EMRATIO")},
        **{f"{p}_DROP_6M": W.diff(f"coincident_{p}", 6, w) for p in ("CIVPART", "EMRATIO")},
        "GOODS_SHARE_YoY": yoy("GOODS_SHARE"), "_goods_yoy": yoy("coincident_USGOOD"), "_serv_yoy": yoy("coincident_USSERV"),
        "SLOOS_CI_LARGE_Z": z("financial_DRTSCILM"), "SLOOS_CI_SMALL_Z": z("financial_DRTSCIS"),
        "SLOOS_CONSUMER_Z": z("financial_DRTSCLCC"), "SLOOS_DEMAND_Z": -z("financial_DRSDCILM"),
        "T10Y3M_Z": z("leading_T10Y3M"), "CREDIT_GROWTH_YOY": yoy("financial_TOTALSL"),
    })

    # Second layer: windows over first-layer results, then row-wise flags.
    second = _columns(first, {
        "SAHM_INDICATOR": c("_unrate_ma3") - W.rolling_min("_unrate_ma3", 12, w, 6),
        "SOS_INDICATOR": c("_iur_ma6") - W.rolling_min("_iur_ma6", 12, w, 6),
        "RESIDENTIAL_INV_Z": z("RESIDENTIAL_INV_YOY"), "DURABLES_Z": z("DURABLES_YOY"),
        "SECTORAL_DIVERGENCE": c("_capex_yoy") - c("_payems_yoy"),
        "CREDIT_GROWTH_DECEL": W.diff("CREDIT_GROWTH_YOY", 12, w),
        "EBP_AT_RISK": flag(_r("EBP_PROXY_Z") > 1.5),
        "HOUSE_PRICE_DECLINING": flag(c("HOUSE_PRICE_YOY") < 0),
    })
    third = _columns(second, {"SECTORAL_DIVERGENCE_Z": z("SECTORAL_DIVERGENCE"), "SOS_MOMENTUM": W.diff("SOS_INDICATOR", 3, w)})
    confirm = (c("leading_T10Y3M_inverted"), c("HOUSE_PRICE_DECLINING"), c("EBP_AT_RISK"))
    final = _columns(third, {
        "SAHM_TRIGGER": flag(_r("SAHM_INDICATOR") >= 0.5), "SOS_TRIGGER": flag(_r("SOS_INDICATOR") >= 0.2),
        "CREDIT_STRESS_INDEX": (c("_baa_z") + c("_ted_z")) / 2, "FINANCIAL_STRESS_COMPOSITE": (c("NFCI_Z") + c("_baa_z")) / 2,
        "GRIGOLI_SANDRI_TRIPLE": all_flags(*confirm), "RECESSION_CONFIRM_2OF3": at_least(2, *confirm),
        "RESIDENTIAL_INV_DECLINING": flag(c("RESIDENTIAL_INV_YOY") < 0), "DURABLES_DECLINING": flag(c("DURABLES_YOY") < 0),
        "K_SHAPE_FLAG": flag((_r("_capex_yoy") > 0.05) & (_r("_payems_yoy") < 0.01)),
        "RES_VS_NONRES_SPREAD": c("RESIDENTIAL_INV_YOY") - c("_capex_yoy"),
        "VU_DETERIORATION": flag(_r("VU_RATIO_YoY") < -0.15), "QUITS_AT_RISK": flag(_r("QUITS_Z") < -1.0),
        "GOODS_DECLINE_FLAG": flag(c("_goods_yoy") < 0), "GOODS_YoY_MINUS_SERV_YoY": c("_goods_yoy") - c("_serv_yoy"),
        "SLOOS_TIGHTENING_FLAG": flag(c("financial_DRTSCILM") > 10), "SLOOS_ACUTE_TIGHTENING": flag(_r("SLOOS_CI_LARGE_Z") > 1.5),
        "SLOOS_COMPOSITE": row_mean("SLOOS_CI_LARGE_Z", "SLOOS_CI_SMALL_Z", "SLOOS_CONSUMER_Z"),
        "CREDIT_TIGHTEN_X_CURVE_INVERT": c("SLOOS_CI_LARGE_Z") * -c("T10Y3M_Z"),
        "EBP_X_SLOOS": c("EBP_PROXY_Z") * c("SLOOS_CI_LARGE_Z"),
    })
    return final.select(*keys, "entity_id", "period_end", *ENGINEERED)


def engineer(panel: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The whole feature frame in long form: raw series, transforms, flags, diffusion and blocks."""
    cols = [*keys, "entity_id", "feature", "period_end", "value"]
    ids = [*keys, "entity_id", "period_end"]
    counter = [r[0] for r in catalog.series_rows() if r[6]]
    spread = diffusion(at_risk_flags(indicators_only(panel), counter, keys=keys), keys)
    parts = [
        long_features(panel, counter, keys=keys),
        unpivot_long(spread, list(catalog.DIFFUSION_FEATURES), ids),
        unpivot_long(wide_features(panel, keys), ENGINEERED, ids),
    ]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))


# ---- feature catalogue and variants -------------------------------------------


def layer(feature: str = "feature") -> Column:
    """meta, at_risk or continuous, from the feature's name."""
    f = F.col(feature)
    meta = (f == "RECESSION") | f.startswith("ref_") | f.startswith("RECESSION_FORWARD_")
    return F.when(meta, "meta").when(f.isin(*catalog.DIFFUSION_FEATURES) | f.endswith("_AT_RISK"), "at_risk").otherwise("continuous")


def block_members(name: str) -> list[str]:
    raw = list(catalog.BLOCK_RAW[name])
    return [*catalog.BLOCK_ENGINEERED[name], *raw] + [r + s for r in raw for s in catalog.STANDARD_SUFFIXES]


def block(feature: str = "feature") -> Column:
    f = F.col(feature)
    return F.when(f.isin(block_members("labor")), "labor").when(f.isin(block_members("credit")), "credit")


def with_variants(features: DataFrame, variants: tuple[str, ...] = catalog.VARIANTS) -> DataFrame:
    """Repeat every row once per variant that keeps its feature: membership is a projection, not a join."""
    kind, part = layer(), block()
    rules = {
        "hybrid": F.lit(True),
        "continuous_only": kind != "at_risk",
        "at_risk_only": kind != "continuous",
        "pca_on_binarized": kind != "at_risk",
        "hybrid_no_b2_labor": ~part.eqNullSafe("labor"),
        "hybrid_no_b3_credit": ~part.eqNullSafe("credit"),
    }
    kept = F.array_compact(F.array(*[F.when(rules[v], F.lit(v)) for v in variants]))
    return features.select(F.explode(kept).alias("variant"), *features.columns)


def must_include_gaps(features: DataFrame, required: list[str]) -> DataFrame:
    """Required features that a variant no longer has."""
    present = features.select("variant", "feature").distinct()
    wanted = present.select("variant").distinct().select(
        "variant", F.explode(F.array(*[F.lit(r) for r in required])).alias("feature"))
    return wanted.join(present, ["variant", "feature"], "left_anti")


def flag_components(flags: DataFrame, names: list[str], k: int = 5, prefix: str = "AR_PC_") -> DataFrame:
    """Principal components of the 0/1 flag matrix; absent flags are 0.

    Spark's PCA does not centre on transform, so a scaler subtracts the means first.
    """
    wide = flags.groupBy("entity_id", "period_end").agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names])
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(wide).select("entity_id", "period_end", "v").persist()
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(vectors).transform(vectors)
    k = min(k, len(names))
    scored = PCA(k=k, inputCol="c", outputCol="pc").fit(centred).transform(centred)
    pc = vector_to_array("pc")
    return scored.select("entity_id", "period_end", *[pc[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def layer_counts(features: DataFrame) -> DataFrame:
    return features.select("feature").distinct().groupBy(layer().alias("layer")).agg(F.count(F.lit(1)).alias("n_features"))


def latest_rank(keys: list[str], order: str = "period_end") -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
