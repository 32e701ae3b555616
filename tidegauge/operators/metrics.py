"""Classification metrics as grouped aggregations over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as W
from tidegauge.functions.ordered import cumulate, cumulate_small, score_cells
from tidegauge.functions.scalars import clip

COUNTS = ["tp", "fp"]


def zero_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rank_aggregates() -> dict[str, Column]:
    """AUC (ties count half) and average precision over cumulated cells; NULL for one class."""
    tp, fp, ctp, cfp = (F.col(x).cast("double") for x in ("tp", "fp", "c_tp", "c_fp"))
    pairs = F.max("t_tp").cast("double") * F.max("t_fp")
    auc = F.try_divide(F.sum(fp * (ctp - tp / 2)), pairs)
    ap = F.try_divide(F.sum(tp * ctp / (ctp + cfp)), F.max("t_tp").cast("double"))
    return {"auc": auc, "pr_auc": ap}


def loss_aggregates(eps: float = 1e-7) -> dict[str, Column]:
    p, tp, fp = F.col("prob"), F.col("tp"), F.col("fp")
    q = clip(p, eps, 1 - eps)
    n = F.sum(tp + fp).cast("double")
    return {
        "brier": F.sum(tp * F.pow(1 - p, 2) + fp * F.pow(p, 2)) / n,
        "log_loss": F.sum(-(tp * F.ln(q) + fp * F.ln(1 - q))) / n,
    }


def confusion_aggregates(threshold: Column) -> dict[str, Column]:
    hit = F.col("prob") >= threshold
    count = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("bigint")
    return {"n_tp": count(hit, "tp"), "n_fp": count(hit, "fp"), "n_fn": count(~hit, "tp"), "n_tn": count(~hit, "fp")}


def rates(tp="n_tp", fp="n_fp", fn="n_fn", tn="n_tn") -> dict[str, Column]:
    """Precision, recall and relatives from counts; a zero denominator gives 0."""
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    precision, recall, specificity = zero_div(a, a + b), zero_div(a, a + c), zero_div(d, d + b)
    return {
        "precision": precision, "recall": recall, "specificity": specificity,
        "f1": zero_div(2 * precision * recall, precision + recall),
        "f2": zero_div(5 * precision * recall, 4 * precision + recall),
        "accuracy": zero_div(a + d, a + b + c + d), "youdens_j": recall + specificity - 1,
    }


def metrics_table(scores: DataFrame, keys: list[str], threshold: float | str = 0.5, eps: float = 1e-7, count: str | None = None) -> DataFrame:
    """Every metric per key. ``threshold`` is a number or a column of ``scores`` that is constant per key; ``count`` says how many rows a row stands for."""
    group = [*keys, threshold] if isinstance(threshold, str) else keys
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    ranked = cumulate(score_cells(scores, group, count=count), group, COUNTS)
    named = {**rank_aggregates(), **loss_aggregates(eps), **confusion_aggregates(cut)}
    table = ranked.groupBy(*group).agg(*[c.alias(n) for n, c in named.items()])
    return table.withColumns(rates())


def best_per_metric(table: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Best model per metric: losses are minimised. Equal values go to the first name."""
    low, high = ("brier", "log_loss"), ("auc", "pr_auc", "precision", "recall", "f1", "accuracy", "specificity", "youdens_j")
    rows = [F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 9).alias("v"), F.lit(-1.0 if m in low else 1.0).alias("s")) for m in (*high, *low)]
    long = table.select(*keys, model, F.inline(F.array(*rows))).where("v is not null")
    order = Window.partitionBy(*keys, "metric").orderBy((F.col("v") * F.col("s")).desc(), model)
    return long.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, "metric", F.col(model).alias("best_model"), F.col("v").alias("best_value"))


def rolling_metrics(scores: DataFrame, keys: list[str], window: int, threshold: float, eps: float = 1e-7) -> DataFrame:
    """Metrics over every trailing window of labelled rows.

    Each row is repeated for the windows it belongs to; the repetition stays inside the
    key's partition, and no window is longer than ``window`` rows.
    """
    w = Window.partitionBy(*keys)
    rows = scores.where("y is not null and prob is not null").withColumns({
        "_r": F.row_number().over(w.orderBy("period_end")), "_n": F.count(F.lit(1)).over(w)})
    last = F.least(F.col("_r") + (window - 1), F.col("_n"))
    first = F.greatest(F.col("_r"), F.lit(window))
    spread = rows.where(first <= last).select(
        *keys, "period_end", "y", clip("prob", eps, 1 - eps).alias("prob"), F.explode(F.sequence(first, last)).alias("_end"))
    group = [*keys, "_end"]
    cells = spread.groupBy(*group, "prob").agg(
        F.sum(F.when(F.col("y") == 1.0, 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y") == 1.0, 0).otherwise(1)).alias("fp"),
        F.min("period_end").alias("_a"), F.max("period_end").alias("_z"))
    ranked = cumulate_small(cells, group, COUNTS)
    named = {**rank_aggregates(), **loss_aggregates(eps), **confusion_aggregates(F.lit(float(threshold)))}
    out = ranked.groupBy(*group).agg(
        F.min("_a").alias("window_start"), F.max("_z").alias("window_end"), F.sum(F.col("tp") + F.col("fp")).alias("months"),
        F.sum("tp").alias("positives"), *[c.alias(n) for n, c in named.items()])
    return out.withColumns(rates()).drop("_end", "f2", "accuracy", "log_loss")


def deltas(table: DataFrame, keys: list[str], metrics: list[str], side: str, challenger: str, baseline: str) -> DataFrame:
    """Challenger minus baseline per metric, absolute and in percent, from one aggregation."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = table.select(*keys, side, F.inline(rows))
    at = lambda name: F.max(F.when(F.col(side) == name, F.col("v")))
    both = long.groupBy(*keys, "metric").agg(at(challenger).alias("challenger"), at(baseline).alias("baseline"))
    change = F.col("challenger") - F.col("baseline")
    return both.withColumns({"delta": change, "delta_pct": F.try_divide(100.0 * change, F.abs("baseline"))})


def last_known_prob(prob: str = "prob") -> Column:
    return W.last_known(prob)
