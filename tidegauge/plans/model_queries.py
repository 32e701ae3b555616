"""Model fitting and scoring (M01-M14), cross-fitted calibration (C08), model plug-in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import backtest as K
from tidegauge.operators import calibration as C
from tidegauge.operators import features as FX
from tidegauge.operators import keyed_lasso, keyed_logit
from tidegauge.operators import labels as L
from tidegauge.operators import models as M
from tidegauge.operators.align import pivot_wide
from tidegauge.plans import oracle_base as B
from tidegauge.plans.backtest_queries import Replay
from tidegauge.plans.composite_queries import labelled
from tidegauge.plans.metric_queries import r6
from tidegauge.plans.registry import query
from tidegauge.plans.serving_queries import ablation_frame
from tidegauge.session import durable
from tidegauge.sources import catalog

IDS = ["entity_id", "period_end"]
MEMBERS = {"logit": {}, "forest": {"numTrees": 40, "maxDepth": 5}}


def split(t):
    rows = ablation_frame(t)
    return rows.where("is_train"), rows.where(~F.col("is_train"))


@query("m01_standardise", sql="""SELECT entity_id, period_end, ROUND(COALESCE((m1 - AVG(m1) FILTER (rn <= 40) OVER w) / NULLIF(STDDEV_POP(m1) FILTER (rn <= 40) OVER w, 0), 0), 6) AS m1,
 ROUND(COALESCE((m2 - AVG(m2) FILTER (rn <= 40) OVER w) / NULLIF(STDDEV_POP(m2) FILTER (rn <= 40) OVER w, 0), 0), 6) AS m2 FROM labelled_n WINDOW w AS (PARTITION BY entity_id)""")
def m01(t):
    rows = L.numbered(labelled(t), ["entity_id"])
    df = keyed_logit.standardise(rows, ["entity_id"], ["m1", "m2"], F.col("rn") <= 40)
    return df.select(*IDS, *r6(df, "m1", "m2"))


@query("m02_principal_factors")
def m02(t):
    from pyspark.ml.functions import vector_to_array

    train, test = split(t)
    prep = M.Preparation(train, K.MODEL_FEATURES, factors=3)
    z = vector_to_array("z")
    return prep.apply(test).select(*IDS, F.size(z).alias("width"), *[z[len(K.MODEL_FEATURES) + i].alias(f"factor_{i + 1}") for i in range(3)])


def _member(name, **params):
    def run(t):
        train, test = split(t)
        return M.Member(name, train.persist(), K.MODEL_FEATURES, **params).score(test).select(*IDS, "y", "prob")

    return run


@query("m03_sparse_logit")
def m03(t):
    """The sparse logit on the whole feature frame, all expanding folds in the same jobs."""
    frame = Replay(t, [], [])
    rows = durable(L.time_folds(frame.base.where("y is not null")))
    width = len(frame.names)
    train = L.class_weights(rows.where("role = 'train'"), ["fold"])
    coef = keyed_lasso.fit(train, ["fold"], width, C=0.1, weight="weight")
    return keyed_lasso.score(rows.where("role = 'test'"), coef, ["fold"]).select("fold", *IDS, "y", "prob")


m04 = query("m04_forest")(_member("forest"))
m05 = query("m05_boosted_trees")(_member("boost", maxIter=30))


@query("m06_two_factor")
def m06(t):
    frame = pivot_wide(t.macro, ["leading_T10Y3M", "monetary_DFF"]).join(t.score_wide.select(*IDS, "y"), IDS, "left")
    return M.two_factor(frame.where("y is not null"), frame, ["entity_id"], "leading_T10Y3M", "monetary_DFF")


@query("m07_published_members", sql="""SELECT entity_id, series_id, period_end, ROUND(GREATEST(0.01, LEAST(0.99, GREATEST(0, LEAST(1, COALESCE(value * scale, 0.05))))), 6) AS prob FROM macro JOIN series_catalog USING (series_id) WHERE category = 'reference'""")
def m07(t):
    peers = catalog.series_catalog(t.spark).where("category = 'reference'").select("series_id", "scale")
    return M.published_member(t.macro.join(peers, "series_id")).select("entity_id", "series_id", "period_end", F.round("prob", 6).alias("prob"))


_SIGNS = list(M.COMPOSITE_SIGNS.items())
_SRC = "SELECT b.entity_id, b.period_end, " + ", ".join(f'"{c}"' for c, _ in _SIGNS) + " FROM blocks b JOIN mw ON b.entity_id = mw.entity_id AND b.period_end = mw.period_end"
B.add("aligned_source", _SRC.replace('"NEAR', 'b."NEAR').replace('"SAHM', 'b."SAHM').replace('"EBP', 'b."EBP').replace('"CREDIT', 'b."CREDIT').replace('"leading', 'mw."leading').replace('"financial', 'mw."financial'))
_Z = [f'({s} * ("{c}" - AVG("{c}") FILTER (period_end <= DATE \'1999-12-31\') OVER w) / (STDDEV_SAMP("{c}") FILTER (period_end <= DATE \'1999-12-31\') OVER w + 1e-8))' for c, s in _SIGNS]
B.add("aligned", f"SELECT entity_id, period_end, list_avg(list_filter([{', '.join(_Z)}], lambda x: x IS NOT NULL)) AS composite FROM aligned_source WINDOW w AS (PARTITION BY entity_id)")


def aligned(t):
    wide = pivot_wide(t.macro, ["leading_T10Y3M", "financial_NFCI"]).join(
        FX.wide_features(t.macro).select(*IDS, "NEAR_TERM_FORWARD_SPREAD", "SAHM_INDICATOR", "EBP_PROXY", "CREDIT_STRESS_INDEX"), IDS)
    return M.aligned_composite(wide, M.COMPOSITE_SIGNS, F.col("period_end") <= F.lit("1999-12-31").cast("date")).select(*IDS, "composite")


@query("m08_aligned_composite", sql="SELECT entity_id, period_end, ROUND(composite, 6) AS composite FROM aligned")
def m08(t):
    return aligned(t).withColumn("composite", F.round("composite", 6))


@query("m09_regime_model")
def m09(t):
    return M.regime_table(t.spark, M.fit_regimes(M.pack_series(aligned(t))))


@query("m10_regime_scores")
def m10(t):
    rows = aligned(t)
    cut = F.lit("1999-12-31").cast("date")
    par = M.fit_regimes(M.pack_series(rows.where(F.col("period_end") <= cut)))
    raw = M.regime_probability(M.pack_series(rows), par).join(t.score_wide.select(*IDS, "y"), IDS, "left")
    train = raw.where((F.col("period_end") <= cut) & F.col("y").isNotNull())
    return C.isotonic(train, raw).select(*IDS, F.col("prob").alias("raw"), F.col("calibrated").alias("prob"))


def folds(t):
    frame = ablation_frame(t).drop("is_train")
    return L.time_folds(frame)


@query("m11_out_of_fold")
def m11(t):
    return M.out_of_fold(folds(t), K.MODEL_FEATURES, MEMBERS, factors=2)


@query("m12_batch_scoring")
def m12(t):
    train, _ = split(t)
    member = M.Member("logit", train.persist(), K.MODEL_FEATURES, factors=2)
    scored = member.score(ablation_frame(t))
    fit = C.slope_intercept(member.score(train).withColumn("model", F.lit("logit")), ["model"])
    return C.apply_sigmoid(scored.withColumn("model", F.lit("logit")), fit, ["model"]).select(*IDS, "model", "prob", "calibrated")


@query("m13_feature_importance")
def m13(t):
    train = split(t)[0].persist()
    parts = [M.Member(n, train, K.MODEL_FEATURES, **p).importance(t.spark) for n, p in MEMBERS.items()]
    both = parts[0].unionByName(parts[1])
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")))


@query("m14_candidates", sql="SELECT entity_id, candidate_id, max_features, COUNT(*) AS n_rows FROM labelled, (VALUES ('baseline_50', 50), ('conservative_40', 40), ('stability_first_50', 50), ('richer_60', 60)) AS c(candidate_id, max_features) GROUP BY 1, 2, 3")
def m14(t):
    """Candidates become a key column of the training rows."""
    names = F.array(*[F.struct(F.lit(c[0]).alias("candidate_id"), F.lit(c[2]).alias("max_features")) for c in catalog.CANDIDATES])
    return labelled(t).select("entity_id", F.inline(names)).groupBy("entity_id", "candidate_id", "max_features").agg(F.count(F.lit(1)).alias("n_rows"))


@query("c08_cross_fitted_calibration")
def c08(t):
    target = split(t)[1].select(*IDS, *K.MODEL_FEATURES)
    return M.cross_fitted(folds(t), target, K.MODEL_FEATURES, "logit")


@query("r02_own_model")
def r02(t):
    from pyspark.ml.classification import DecisionTreeClassifier

    M.ESTIMATORS["tree"] = lambda n, **p: DecisionTreeClassifier(featuresCol="z", labelCol="y", weightCol="weight", maxDepth=3, seed=M.SEED)
    return _member("tree")(t)
