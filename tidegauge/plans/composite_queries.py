"""Regime composites (G01-G08), labels and splits (L01-L11), named transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.operators import align
from tidegauge.operators import composites as G
from tidegauge.operators import labels as L
from tidegauge.plans import oracle_base as B
from tidegauge.plans.align_queries import masked
from tidegauge.plans.registry import query
from tidegauge.sources import catalog

IDS = ["entity_id", "period_end"]
_SOURCES = sorted({s for c in catalog.COMPONENTS for s in c[1]})
B.add("gw", "SELECT entity_id, period_end, " + ", ".join(f'MAX(value) FILTER (series_id = \'{n}\') AS "{n}"' for n in _SOURCES)
      + f" FROM macro WHERE series_id IN ({', '.join(repr(n) for n in _SOURCES)}) GROUP BY 1, 2")
_W = B.over("", "entity_id")


def _raw(sources: str, transform: str) -> str:
    s = [f'"{x}"' for x in sources]
    level = f"({' - '.join(s)})"
    return {
        "zscore": s[0], "yoy": B.pct(s[0], 12, _W), "mom3": f"{s[0]} - LAG({s[0]}, 3) OVER {_W}", "mom1": f"{s[0]} - LAG({s[0]}, 1) OVER {_W}",
        "level": level, "level_mom3": f"{level} - LAG({level}, 3) OVER {_W}",
        "ratio": f"{s[0]} / CASE WHEN ABS({s[-1]}) > 1e-12 THEN {s[-1]} END",
        "termstruct": f"1.0 - {s[0]} / CASE WHEN ABS({s[-1]}) > 1e-12 THEN {s[-1]} END"}[transform]


B.add("composite_spec", B.values("c", "component, composite, sign", [(catalog.component_name(n, g), c, g) for n, _, _, g, c in catalog.COMPONENTS]))
B.add("component_raw", "SELECT entity_id, period_end, component, x FROM (SELECT entity_id, period_end, "
      + ", ".join(f'{_raw(s, tr)} AS "{catalog.component_name(n, g)}"' for n, s, tr, g, _ in catalog.COMPONENTS)
      + " FROM gw) UNPIVOT INCLUDE NULLS (x FOR component IN (" + ", ".join(f'"{catalog.component_name(n, g)}"' for n, _, _, g, _ in catalog.COMPONENTS) + "))")
_UPC = B.upto("entity_id, component")
B.add("component_z", f"SELECT entity_id, period_end, component, composite, sign * ({B.zscore('x', _UPC, 12)}) AS z FROM component_raw JOIN composite_spec USING (component)")
B.add("composite_levels", "SELECT entity_id, period_end, composite, AVG(z) AS value FROM component_z GROUP BY 1, 2, 3")
_TR = B.trail(60, "entity_id, composite")
B.add("composite_bands", f"""SELECT *, {B.guarded('QUANTILE_CONT(value, 0.33)', 'value', _TR, 12)} AS low,
 {B.guarded('QUANTILE_CONT(value, 0.67)', 'value', _TR, 12)} AS high FROM composite_levels""")
B.add("composite_states", """SELECT entity_id, period_end, composite, value, CASE WHEN value IS NULL OR low IS NULL OR high IS NULL THEN NULL
 WHEN ROUND(value, 9) >= ROUND(high, 9) THEN 'strong' WHEN ROUND(value, 9) <= ROUND(low, 9) THEN 'weak' ELSE 'neutral' END AS state FROM composite_bands""")


def spec(t):
    return catalog.composite_spec(t.spark)


def parts(t):
    return G.components(t.macro, spec(t))


def levels(t):
    return G.composites(parts(t))


@query("g01_component_registry", sql="""SELECT component, composite, COUNT(*) FILTER (z IS NOT NULL) AS n_scores FROM component_z GROUP BY 1, 2""")
def g01(t):
    return parts(t).groupBy("component", "composite").agg(F.count("z").alias("n_scores"))


@query("g02_component_scores", sql="SELECT entity_id, period_end, component, ROUND(z, 6) AS z FROM component_z")
def g02(t):
    return parts(t).select(*IDS, "component", F.round("z", 6).alias("z"))


@query("g03_composites", sql="SELECT entity_id, period_end, composite, ROUND(value, 6) AS value FROM composite_levels")
def g03(t):
    return levels(t).select(*IDS, "composite", F.round("value", 6).alias("value"))


@query("g04_states", sql="SELECT entity_id, period_end, composite, ROUND(value, 6) AS value, state FROM composite_states")
def g04(t):
    return G.states(levels(t)).select(*IDS, "composite", F.round("value", 6).alias("value"), "state")


@query("g05_build", sql="""SELECT 'components' AS part, COUNT(*) AS n_rows, COUNT(z) AS n_known FROM component_z
UNION ALL SELECT 'composites', COUNT(*), COUNT(value) FROM composite_levels UNION ALL SELECT 'states', COUNT(*), COUNT(state) FROM composite_states""")
def g05(t):
    built = G.build(t.macro, spec(t))
    known = {"components": "z", "composites": "value", "states": "state"}
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(known[n]).alias("n_known")).select(F.lit(n).alias("part"), "n_rows", "n_known")
              for n, df in built.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("g06_composite_kpis", sql="""WITH l AS (SELECT entity_id, composite, MAX(period_end) AS d FROM composite_states WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT entity_id, composite, ROUND(arg_max(value, period_end) FILTER (value IS NOT NULL), 6) AS latest,
 ROUND(arg_max(value, period_end) FILTER (value IS NOT NULL) - arg_max(value, period_end) FILTER (value IS NOT NULL AND period_end <= last_day(d - INTERVAL 3 MONTH)), 6) AS delta_3m,
 arg_max(state, period_end) FILTER (state IS NOT NULL) AS state FROM composite_states LEFT JOIN l USING (entity_id, composite) GROUP BY 1, 2""")
def g06(t):
    k = G.kpis(G.states(levels(t)))
    return k.select("entity_id", "composite", F.round("latest", 6).alias("latest"), F.round("delta_3m", 6).alias("delta_3m"), "state")


@query("g07_drill_down", sql="""WITH n AS (SELECT composite, COUNT(*) AS n FROM composite_spec GROUP BY 1), l AS (
 SELECT entity_id, composite, component, arg_max(z, period_end) FILTER (z IS NOT NULL) AS z FROM component_z GROUP BY 1, 2, 3)
SELECT entity_id, composite, component, ROUND(z, 6) AS z, ROUND(z / n, 6) AS contribution,
 CASE WHEN z > 0 THEN 'up' WHEN z IS NOT NULL THEN 'down' ELSE 'none' END AS direction FROM l JOIN n USING (composite)""")
def g07(t):
    d = G.drill_down(parts(t), spec(t))
    return d.withColumns({"z": F.round("z", 6), "contribution": F.round("contribution", 6)})


@query("g08_bands", sql="SELECT entity_id, period_end, composite, ROUND(low, 6) AS low, ROUND(high, 6) AS high FROM composite_bands")
def g08(t):
    return G.bands(levels(t)).select(*IDS, "composite", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_UP5 = B.upto("entity_id, component")


@query("r01_named_transforms", sql=f"""WITH raw AS (SELECT entity_id, period_end, 'accel' AS component, r - LAG(r, 6) OVER {_W} AS x FROM (
 SELECT entity_id, period_end, MAX(value) FILTER (series_id = 'revenue') / NULLIF(MAX(value) FILTER (series_id = 'orders'), 0) AS r FROM panel GROUP BY 1, 2))
SELECT entity_id, period_end, component, ROUND({B.zscore('x', _UP5, 12)}, 6) AS z FROM raw""")
def r01(t):
    own = catalog.composite_spec(t.spark, [("accel", ("revenue", "orders"), "ratio_diff6", 1, "growth")])
    parts = G.components(t.panel, own, {"ratio_diff6": lambda: F.try_divide(F.col("s0"), F.col("s1"))}, {"ratio_diff6": lambda x, w: W.diff(x, 6, w)})
    return parts.select(*IDS, "component", F.round("z", 6).alias("z"))


# ---- labels -------------------------------------------------------------------


def fwd(h, keys="entity_id"):
    return f"CASE WHEN COUNT(*) OVER {B.ahead(h, keys)} = {h} THEN MAX(flag) OVER {B.ahead(h, keys)} END"


B.add("labelled", "SELECT entity_id, period_end, flag, y, m1, m2, m3, ensemble FROM score_wide WHERE y IS NOT NULL AND ensemble IS NOT NULL")
B.add("labelled_n", "SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY period_end) AS rn, COUNT(*) OVER (PARTITION BY entity_id) AS n FROM labelled")


def labelled(t):
    return t.score_wide.where("y is not null and ensemble is not null")


@query("l01_forward_label", sql=f"SELECT entity_id, period_end, {fwd(6)} AS y FROM regime")
def l01(t):
    return L.forward_label(t.regime, 6).select(*IDS, "y")


@query("l02_multi_horizon", sql=" UNION ALL ".join(f"SELECT entity_id, period_end, {h} AS horizon, {fwd(h)} AS y FROM regime" for h in (3, 6, 12, 18)))
def l02(t):
    return L.multi_horizon(t.regime)


@query("l03_chronological_split", sql="""SELECT entity_id, CASE WHEN rn <= FLOOR(n * 0.8) THEN 'train' ELSE 'test' END AS role, COUNT(*) AS n_rows,
 MIN(period_end) AS first_month, MAX(period_end) AS last_month FROM labelled_n GROUP BY 1, 2""")
def l03(t):
    return L.chronological_split(labelled(t)).groupBy("entity_id", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("period_end").alias("first_month"), F.max("period_end").alias("last_month"))


@query("l04_nowcast_rows", sql=f"""SELECT entity_id, period_end, ROUND(m1, 6) AS m1 FROM (
 SELECT entity_id, period_end, y, COALESCE(LAST_VALUE(m1 IGNORE NULLS) OVER {B.upto('entity_id')}, 0.0) AS m1 FROM score_wide) WHERE y IS NULL""")
def l04(t):
    filled = t.score_wide.withColumn("m1", F.coalesce(W.ffill("m1", W.by("entity_id")), F.lit(0.0)))
    return filled.where("y is null").select(*IDS, F.round("m1", 6).alias("m1"))


@query("l05_time_folds", sql="""WITH f AS (SELECT *, n // 6 AS ts, UNNEST(range(5)) AS fold FROM labelled_n)
SELECT fold, entity_id, period_end, CASE WHEN rn <= n - ts * (5 - fold) THEN 'train' ELSE 'test' END AS role FROM f WHERE rn <= n - ts * (5 - fold) + ts""")
def l05(t):
    return L.time_folds(labelled(t)).select(F.col("fold").cast("bigint").alias("fold"), *IDS, "role")


B.add("origin_frame", """SELECT m.origin, m.entity_id, m.series_id, m.period_end, m.value, s.y FROM masked m LEFT JOIN score_wide s
 ON m.entity_id = s.entity_id AND m.period_end = s.period_end""")


def origin_frame(t):
    """Every series as known at each origin, with labels joined by month."""
    return masked(t).join(t.score_wide.select(*IDS, "y"), IDS, "left").select("origin", "entity_id", "series_id", "period_end", "value", "y")


@query("l06_knowable_labels", sql="""SELECT origin, entity_id, series_id, COUNT(*) AS n_rows, MAX(period_end) AS last_train_month FROM origin_frame
WHERE period_end <= last_day(origin - INTERVAL 6 MONTH) AND y IS NOT NULL GROUP BY 1, 2, 3""")
def l06(t):
    return L.knowable(origin_frame(t), 6).groupBy("origin", "entity_id", "series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("period_end").alias("last_train_month"))


@query("l07_origin_admissibility", sql="""WITH s AS (SELECT origin, entity_id, series_id, last_day(origin - INTERVAL 6 MONTH) AS label_cutoff,
 COUNT(*) FILTER (period_end <= last_day(origin - INTERVAL 6 MONTH) AND y IS NOT NULL) AS train_rows,
 CAST(COALESCE(SUM(y) FILTER (period_end <= last_day(origin - INTERVAL 6 MONTH)), 0) AS BIGINT) AS train_positives,
 COUNT(*) FILTER (period_end = origin) AS at_o, COUNT(*) FILTER (period_end = origin AND y IS NOT NULL) AS lab FROM origin_frame GROUP BY 1, 2, 3)
SELECT origin, entity_id, series_id, label_cutoff, train_rows, train_positives, CASE WHEN train_rows < 48 THEN 'insufficient_history'
 WHEN train_positives = 0 OR train_positives = train_rows THEN 'one_class' WHEN at_o = 0 THEN 'origin_missing' WHEN lab = 0 THEN 'label_unavailable' END AS reason FROM s""")
def l07(t):
    return L.origin_admissibility(origin_frame(t), 6, min_train=48, keys=["origin", "entity_id", "series_id"])


@query("l08_class_balance", sql="SELECT run_id, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, ROUND(AVG(y), 6) AS positive_rate FROM score_rows GROUP BY 1")
def l08(t):
    return t.score_rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"), F.round(F.avg("y"), 6).alias("positive_rate"))


@query("l09_class_weights", sql="""WITH s AS (SELECT run_id, COUNT(*) AS n, SUM(y) AS p FROM score_rows GROUP BY 1)
SELECT row_id, run_id, ROUND(n / NULLIF(2.0 * CASE WHEN y = 1 THEN p ELSE n - p END, 0), 6) AS weight, ROUND((n - p) / NULLIF(p, 0), 6) AS scale_pos FROM score_rows JOIN s USING (run_id)""")
def l09(t):
    return L.class_weights(t.score_rows, ["run_id"]).select(
        "row_id", "run_id", F.round("weight", 6).alias("weight"), F.round("scale_pos", 6).alias("scale_pos"))


@query("l10_recency_weights", sql="""SELECT entity_id, period_end, ROUND(w / AVG(w) OVER (PARTITION BY entity_id), 6) AS weight FROM (
 SELECT *, GREATEST(POW(0.5, (n - rn) / 24.0), 0.25) AS w FROM labelled_n)""")
def l10(t):
    return L.recency_weights(labelled(t), 24.0).select(*IDS, F.round("weight", 6).alias("weight"))


@query("l11_look_back", sql=f"""SELECT entity_id, period_end, ROUND(list_sum(p), 6) AS total, ROUND(p[1], 6) AS oldest, ROUND(p[6], 6) AS newest FROM (
 SELECT *, LIST(m1) OVER {B.over('ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING', 'entity_id')} AS p FROM labelled) WHERE len(p) = 6""")
def l11(t):
    s = L.look_back(labelled(t), ["m1", "m2"])
    at = lambda i: F.round(F.col("sequence")[i]["m1"], 6)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["m1"])
    return s.select(*IDS, F.round(total, 6).alias("total"), at(0).alias("oldest"), at(5).alias("newest"))
