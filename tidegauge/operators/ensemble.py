"""Member weights, gates, decision thresholds, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import metrics as V
from tidegauge.session import durable

SWEEP = (10, 60)
EPS_BRIER = 1e-6


def member_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """AUC, PR-AUC, Brier and inverse Brier per member; one-class groups fall back to 0.5 and 0.0."""
    table = V.metrics_table(scores, [*keys, "model"])
    return table.select(
        *keys, "model", F.coalesce("auc", F.lit(0.5)).alias("auc"), F.coalesce("pr_auc", F.lit(0.0)).alias("pr_auc"), "brier",
        (1.0 / (F.col("brier") + EPS_BRIER)).alias("inv_brier"))


def static_weights(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.withColumn("weight", F.col("inv_brier") / F.sum("inv_brier").over(Window.partitionBy(*keys)))


def decayed_weights(fold_scores: DataFrame, keys: list[str], n_folds: int, forget: float = 0.99) -> DataFrame:
    """Later folds weigh more; a member's score is AUC / (Brier + 0.01)."""
    w = F.pow(F.lit(forget), (n_folds - 1) - F.col("fold"))
    raw = fold_scores.groupBy(*keys, "model").agg((F.sum(w * F.col("auc") / (F.col("brier") + 0.01)) / F.sum(w)).alias("_s"))
    return raw.withColumn("weight", F.col("_s") / F.sum("_s").over(Window.partitionBy(*keys))).drop("_s")


def cap_and_floor(weights: DataFrame, keys: list[str], cap: float = 0.40, floor: float = 0.02, passes: int = 3, order: str = "model") -> DataFrame:
    """Cap members in the order of a column (the result depends on it), hand the excess to the others in proportion, then floor and renormalise.

    Members of a run are few; their list is folded with array functions inside one row per run.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), "model", "weight")))
    runs = weights.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["model"].alias("model"), x["weight"].alias("weight"))).alias("m"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["weight"])

    def cap_one(arr: Column, i: Column) -> Column:
        own = F.element_at(arr, i + 1)["weight"]
        excess, others = own - cap, total(arr) - own
        share = lambda x: F.when(others > 0, x["weight"] + excess * x["weight"] / others).otherwise(x["weight"])
        moved = F.transform(arr, lambda x, j: F.struct(x["model"].alias("model"), F.when(j == i, F.lit(cap)).otherwise(share(x)).alias("weight")))
        return F.when(own > cap, moved).otherwise(arr)

    steps = F.flatten(F.array_repeat(F.sequence(F.lit(0), F.size("m") - 1), passes))
    capped = runs.withColumn("m", F.aggregate(steps, F.col("m"), cap_one))
    floored = capped.withColumn("m", F.transform("m", lambda x: F.struct(x["model"].alias("model"), F.greatest(x["weight"], F.lit(floor)).alias("weight"))))
    return floored.withColumn("_t", total(F.col("m"))).select(*keys, "_t", F.inline("m")).withColumn("weight", F.col("weight") / F.col("_t")).drop("_t")


def active_members(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members close to the best on all three scores; the top two by (AUC, -Brier) if fewer than two pass."""
    run = Window.partitionBy(*keys)
    best = run.orderBy(F.col("auc").desc(), F.col("brier").asc(), "model")
    passed = (
        (F.col("auc") >= F.max("auc").over(run) - 0.10)
        & (F.col("pr_auc") >= F.max("pr_auc").over(run) * 0.90)
        & (F.col("brier") <= F.min("brier").over(run) * 2.0)
    )
    df = members.withColumns({"_ok": passed, "_rank": F.row_number().over(best)})
    enough = F.sum(F.col("_ok").cast("int")).over(run) >= 2
    return df.withColumn("active", F.when(enough, F.col("_ok")).otherwise(F.col("_rank") <= 2)).drop("_ok", "_rank")


def equal_active_weights(active: DataFrame, keys: list[str]) -> DataFrame:
    n = F.sum(F.col("active").cast("int")).over(Window.partitionBy(*keys))
    return active.withColumn("equal_weight", F.when(F.col("active"), F.try_divide(F.lit(1.0), n)).otherwise(0.0))


def renormalise(weights: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Weights over active members only; equal weights where they sum to nothing."""
    run = Window.partitionBy(*keys)
    kept = F.when(F.col("active"), F.col(weight)).otherwise(0.0)
    total = F.sum(kept).over(run)
    n = F.sum(F.col("active").cast("int")).over(run)
    equal = F.when(F.col("active"), F.try_divide(F.lit(1.0), n)).otherwise(0.0)
    return weights.withColumn(weight, F.when(total > 0, kept / total).otherwise(equal))


def shrink(weights: DataFrame, strength: float = 1.0) -> DataFrame:
    return weights.withColumn("weight", (1 - strength) * F.col("weight") + strength * F.col("equal_weight"))


def blend(scores: DataFrame, weights: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """Weighted member probability per row."""
    return scores.join(weights.select(*keys, "model", "weight"), [*keys, "model"]).groupBy(*keys, *row).agg(
        F.sum(F.col("weight") * F.col("prob")).alias("prob"))


# ---- decision thresholds -------------------------------------------------------


def grid_index(p: str = "prob") -> Column:
    """Largest whole percent i with i/100 <= p, exact for doubles: floor, corrected by one comparison each way."""
    x = F.col(p)
    i = F.floor(x * 100)
    return F.when(x >= (i + 1) / F.lit(100.0), i + 1).when(x < i / F.lit(100.0), i - 1).otherwise(i)


def threshold_sweep(scores: DataFrame, keys: list[str], low: int = SWEEP[0], high: int = SWEEP[1]) -> DataFrame:
    """Counts and rates at every threshold of the grid.

    Rows are reduced to 101 score cells per key before the grid is expanded, so the
    sweep costs one pass over the scores and no join.
    """
    y, known = F.col("y") == 1.0, F.col("prob").isNotNull() & F.col("y").isNotNull()
    cells = scores.where(known).groupBy(*keys, grid_index().alias("_i")).agg(
        F.sum(F.when(y, 1).otherwise(0)).alias("p"), F.sum(F.when(y, 0).otherwise(1)).alias("n"))
    grid = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_t"))
    hit = F.col("_i") >= F.col("_t")
    count = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("bigint")
    counts = grid.groupBy(*keys, "_t").agg(
        count(hit, "p").alias("tp"), count(hit, "n").alias("fp"), count(~hit, "p").alias("fn"), count(~hit, "n").alias("tn"))
    return counts.withColumns(V.rates("tp", "fp", "fn", "tn")).withColumn("threshold", F.col("_t") / F.lit(100.0)).drop("_t", "accuracy").withColumn("score", F.col("f1"))


ORDER = ("f1", "precision", "recall", "specificity")


def choose_threshold(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Best F1, then precision, recall, specificity, then the lower threshold; 0.5 for a single class."""
    key = F.struct(*ORDER, (-F.col("threshold")).alias("t"))
    best = sweep.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", *ORDER), key).alias("w"), F.max(F.col("tp") + F.col("fn")).alias("_p"), F.max(F.col("fp") + F.col("tn")).alias("_n"))
    one_class = (F.col("_p") == 0) | (F.col("_n") == 0)
    return best.select(*keys, F.when(one_class, 0.5).otherwise(F.col("w.threshold")).alias("threshold"), *[F.col(f"w.{c}").alias(c) for c in ORDER])


def plateau(sweep: DataFrame, keys: list[str], audit: bool = False) -> DataFrame:
    """How many thresholds are nearly as good as the winner; ``audit`` adds the range criterion."""
    key = F.struct(*ORDER, (-F.col("threshold")).alias("t"))
    w = Window.partitionBy(*keys)
    best_f1, best_t = F.max("f1").over(w), F.max_by("threshold", key).over(w)
    df = sweep.withColumns({"_f": best_f1, "_w": best_t})
    near = lambda tol: F.col("f1") >= F.col("_f") - tol
    tol = 0.005 if audit else 0.01
    inside = lambda fn: fn(F.when(near(tol), F.col("threshold")))
    out = df.groupBy(*keys).agg(
        F.max("_w").alias("winner_threshold"), F.round(F.max("_f"), 6).alias("winner_f1"),
        F.count_if(near(0.01)).alias("width_01"), F.count_if(near(0.005)).alias("width_005"),
        inside(F.min).alias("plateau_min"), inside(F.max).alias("plateau_max"))
    span = F.round(F.col("plateau_max") - F.col("plateau_min"), 4)
    flat = (F.col("width_005") >= 5) | (span >= 0.10) if audit else F.col("width_005") >= 5
    return out.withColumns({"span": span, "is_flat": flat})


def override_threshold(chosen: DataFrame, manual: str = "manual") -> DataFrame:
    return chosen.withColumn("threshold", F.coalesce(manual, "threshold"))


# ---- promotion -----------------------------------------------------------------

GATE = {"auc": 1, "pr_auc": 1, "brier": -1, "log_loss": -1}


def promotion_gate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` holds candidate_<m> and incumbent_<m>; a missing metric blocks promotion."""
    ok, better = {}, []
    for m, sign in GATE.items():
        gain = sign * (F.col(f"candidate_{m}") - F.col(f"incumbent_{m}"))
        ok[m] = F.coalesce(gain >= -1e-9, F.lit(False))
        better.append(F.coalesce(gain > 1e-6, F.lit(False)))
    blocked = F.array_compact(F.array(*[F.when(~c, F.lit(m)) for m, c in ok.items()]))
    improved = better[0] | better[1] | better[2] | better[3]
    passed = F.size("_blocked") == 0
    reason = (
        F.when(passed & F.col("_better"), "matched or improved all guardrails").when(passed, "matched incumbent on all guardrails")
        .otherwise(F.concat(F.lit("underperformed incumbent on "), F.array_join("_blocked", ", ")))
    )
    return pairs.withColumns({"_blocked": blocked, "_better": improved}).select(*keys, passed.alias("passed"), reason.alias("reason"))


def same_config(a: str, b: str) -> Column:
    """Two configurations are the same when their sorted entries are."""
    canon = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return canon(a) == canon(b)


def leave_one_out(rows: DataFrame, keys: list[str], row: list[str], members: list[str]) -> DataFrame:
    """Brier and AUC of the equal-weight mean without each member, against the mean of all.

    ``rows`` has a column per member; a missing probability is the member's mean over the keys. Rows of equal keys, row and
    label are one row with all their probabilities. Rows travel once, equal ones are counted before they are spread over the members.
    """
    means = durable(rows.groupBy(*keys).agg(*[F.avg(m).alias(f"_mean_{m}") for m in members]))
    filled = rows.join(means, keys).select(*keys, *row, "y", *[F.coalesce(m, f"_mean_{m}").alias(m) for m in members])
    own = sum((F.col(m) for m in members[1:]), F.col(members[0]))
    at = Window.partitionBy(*keys, *row, "y").orderBy(*members)
    same = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a missing sum stays missing for all rows that are one
    total = F.when(F.count(own).over(same) == F.count(F.lit(1)).over(same), F.sum(own).over(same))
    packed = filled.select(
        *keys, "y", *members, total.alias("_total"), (F.count(F.lit(1)).over(same) * len(members)).cast("double").alias("_k"),
        (F.row_number().over(at) == 1).alias("_first"))
    counted = packed.groupBy(*keys, "y", *members, "_total", "_k", "_first").agg(F.count(F.lit(1)).alias("_n"))
    without = [F.struct(F.lit(m).alias("model"), F.try_divide(F.col("_total") - F.col(m), F.col("_k") - 1).alias("prob")) for m in members]
    everyone = F.struct(F.lit("all").alias("model"), F.when(F.col("_first"), F.col("_total") / F.col("_k")).alias("prob"))
    long = counted.select(*keys, "y", "_n", F.inline(F.array(everyone, *without))).withColumn("prob", F.round("prob", 12))
    table = V.metrics_table(long, [*keys, "model"], count="_n")
    of_all = lambda m: F.max(F.when(F.col("model") == "all", F.col(m))).over(Window.partitionBy(*keys))
    both = table.select(*keys, "model", "brier", "auc", of_all("brier").alias("_b"), of_all("auc").alias("reference_auc"))
    return both.where("model <> 'all'").select(
        *keys, "model", F.col("brier").alias("brier_without"), (F.col("brier") - F.col("_b")).alias("brier_delta"),
        F.col("auc").alias("auc_without"), F.col("_b").alias("reference_brier"), "reference_auc")
