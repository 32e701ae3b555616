"""Random forests for many keys at once, grown by histograms.

A key is one fit (fold, entity, window, origin). All trees of all keys grow in the same jobs, a level at a time: tasks add up
(tree, node, feature, bin) histograms of their rows, Spark sums them, and running sums over the bins give the best
split of every node. So a forest of any number of trees and keys takes one aggregation per level.

* Features are binned once, at approximate quantiles of their key. A row goes left when its bin is at most the split's.
* A key's rows are dealt into parts of about ``part_rows`` rows, so that no task holds a whole key; a part meets its key's
  forest, whose size the parameters bound.
* How often a row is drawn for a tree (Poisson with mean 1) and which features a node may use come from hashes of the row, tree and node. A
  retried task draws the same; rows with equal ``row`` columns are drawn alike.
* A split needs ``least`` drawn rows on both sides and a positive fall of the weighted Gini impurity; ties go to the
  smaller feature and bin.

Defined results: rows without a label take no part; a null or NaN component falls into the first bin; a key with one class keeps
its trees, which are bare roots, so its rows get that class; a key without labelled rows has no trees and its rows get a null
probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import durable

POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers, by rounds of the splitmix finaliser."""
    out = np.uint64(0)
    for p in parts:
        z = np.asarray(p).astype(np.uint64) + out * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = z ^ (z >> np.uint64(31))
    return out


def draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    return np.searchsorted(POISSON, (mixed(row.view(np.uint64), [tree], [seed]) >> np.uint64(11)) / 2.0**53, side="right")


def allowed(nodes: np.ndarray, tree: int, width: int, tries: int, seed: int) -> np.ndarray:
    """The features each node may split on: (nodes, tries), ascending."""
    if tries >= width:
        return np.tile(np.arange(width), (len(nodes), 1))
    order = mixed(nodes[:, None], [[tree]], [[seed + 1]], np.arange(width)[None, :])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :tries], axis=1)


def by_tree(forest: pd.DataFrame) -> dict[int, pd.DataFrame]:
    return {int(t): part for t, part in forest.groupby("tree")}


def walk(bins: np.ndarray, tree: pd.DataFrame | None, depth: int) -> np.ndarray:
    """The node each row has come to: 1 is the root, 2v and 2v + 1 are the children of v."""
    at = np.ones(len(bins), np.int64)
    if tree is None:
        return at
    feature, cut = np.full(1 << depth, -1, np.int64), np.zeros(1 << depth, np.int64)
    feature[tree["node"]], cut[tree["node"]] = tree["feature"], tree["bin"]
    for _ in range(depth):
        inner = np.flatnonzero(at < len(feature))
        inner = inner[feature[at[inner]] >= 0]
        if not len(inner):
            break
        node = at[inner]
        at[inner] = 2 * node + (bins[inner, feature[node]] > cut[node])
    return at


def binned(rows: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Replace x by the bin of each component, the number of cuts below it."""
    below = lambda v, c: F.when(v.isNull() | F.isnan(v), 0).otherwise(F.size(F.filter(c["c"], lambda e: e < v)))
    return rows.join(cuts, keys, "left").withColumn("b", F.zip_with("x", "_cuts", below)).drop("x", "_cuts")


def quantile_cuts(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, _cuts): per component up to bins - 1 distinct approximate quantiles."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    each = rows.select(*keys, F.posexplode("x").alias("i", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    found = each.groupBy(*keys, "i").agg(F.array_distinct(F.coalesce(F.percentile_approx("v", at, 10_000), F.array().cast("array<double>"))).alias("c"))
    return found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda e: F.struct(e["c"].alias("c"))).alias("_cuts"))


def parted(rows: DataFrame, keys: list[str], row: list[str], part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_row`` (their hash) and ``_part``, and the parts of each key."""
    sizes = durable(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts")))
    dealt = rows.join(sizes, keys).withColumn("_row", F.xxhash64(*row)).withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(3)), "_parts")).drop("_parts")
    return dealt, sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))


def named(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def fit(rows: DataFrame, keys: list[str], width: int, row: list[str], trees: int = 300, depth: int = 8, least: int = 10, bins: int = 32,
        tries: int | None = None, weight: str | None = None, bootstrap: bool = True, seed: int = 42, part_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The forest (keys, tree, node, feature, bin, p, p_left, p_right, gain) and the cuts, from labelled rows (keys, row, x, y).

    ``feature`` is -1 at a node without a split; ``p`` are weighted shares of class 1; ``tries`` defaults to the root of the width.
    """
    tries = tries or math.ceil(math.sqrt(width))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    labelled = durable(rows.where(F.col("y").isNotNull()).select(*keys, F.xxhash64(*row).alias("_id"), "x", F.col("y").cast("double").alias("y"), w.alias("w")))
    cuts = durable(quantile_cuts(labelled, keys, bins))
    dealt, parts = parted(binned(labelled, cuts, keys), keys, ["_id"], part_rows)
    data = durable(dealt.drop("_id"))
    group = [*keys, "_part"]
    cell = ["tree", "node", "feature", "bin"]
    shape = f"{named(data, keys)}, tree int, node int, feature int, bin int, n double, w0 double, w1 double"

    def level(d: int):
        def add(part: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(part):
                b, ids = np.stack(part["b"].to_numpy()).astype(np.int64), part["_row"].to_numpy(np.int64)
                one, wt = part["y"].to_numpy() > 0.5, part["w"].to_numpy()
                known = by_tree(grown)
                for t in range(trees):
                    at, times = walk(b, known.get(t), depth), draws(ids, t, seed) if bootstrap else np.ones(len(ids), np.int64)
                    live = np.flatnonzero((at >= 1 << d) & (times > 0))
                    if not len(live):
                        continue
                    nodes, place = np.unique(at[live], return_inverse=True)
                    may = allowed(nodes, t, width, tries, seed)
                    index = ((place[:, None] * may.shape[1] + np.arange(may.shape[1])) * bins + np.take_along_axis(b[live], may[place], axis=1)).ravel()
                    sums = [np.bincount(index, np.repeat(v, may.shape[1]), minlength=may.size * bins)
                            for v in (times[live], (times * wt * ~one)[live], (times * wt * one)[live])]
                    full = np.flatnonzero(sums[0])
                    slot = full // bins
                    out.append(pd.DataFrame({"tree": t, "node": nodes[slot // may.shape[1]], "feature": may.ravel()[slot], "bin": full % bins,
                                             "n": sums[0][full], "w0": sums[1][full], "w1": sums[2][full]}))
            found = pd.concat(out) if out else pd.DataFrame(columns=[*cell, "n", "w0", "w1"])
            for k in reversed(keys):
                found.insert(0, k, part[k].iloc[0] if len(part) else None)
            return found

        return add

    forest = None
    for d in range(depth):
        if forest is None:
            grown = data.sparkSession.createDataFrame([], f"{named(data, group)}, tree int, node int, feature int, bin int")
        else:
            grown = forest.select(*keys, *cell).join(parts, keys)
        cells = data.groupBy(*group).cogroup(grown.groupBy(*group)).applyInPandas(level(d), shape)
        found = durable(best_splits(cells.groupBy(*keys, *cell).agg(*[F.sum(c).alias(c) for c in ("n", "w0", "w1")]), keys, least))
        forest = found if forest is None else durable(forest.unionByName(found))
        if found.where("feature >= 0").isEmpty():
            break
    return forest, cuts


def best_splits(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """One row per node: the bin after which the weighted Gini impurity falls most, by running sums over the bins."""
    node = [*keys, "tree", "node"]
    w = Window.partitionBy(*node, "feature")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_l{c}": F.sum(c).over(upto) for c in ("n", "w0", "w1")} | {f"_t{c}": F.sum(c).over(w) for c in ("n", "w0", "w1")}
    side = cells.withColumns(sums).withColumns({f"_r{c}": F.col(f"_t{c}") - F.col(f"_l{c}") for c in ("n", "w0", "w1")})
    gini = lambda s: F.coalesce(F.try_divide(2 * F.col(f"_{s}w0") * F.col(f"_{s}w1"), F.col(f"_{s}w0") + F.col(f"_{s}w1")), F.lit(0.0))
    share = lambda s: F.try_divide(F.col(f"_{s}w1"), F.col(f"_{s}w0") + F.col(f"_{s}w1"))
    # rounded, so that the order in which sums were added does not break ties
    side = side.withColumn("_gain", F.round(gini("t") - gini("l") - gini("r"), 9))
    good = (F.col("_ln") >= least) & (F.col("_rn") >= least) & (F.col("_gain") > 0)
    split = F.struct(F.col("_gain").alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), share("l").alias("l"), share("r").alias("r"))
    best = side.groupBy(*node).agg(F.max(F.when(good, split)).alias("s"), F.max_by(share("t"), "_tn").alias("p"))
    return best.select(
        *node, F.coalesce(-F.col("s.f"), F.lit(-1)).cast("int").alias("feature"), F.coalesce(-F.col("s.b"), F.lit(0)).cast("int").alias("bin"),
        "p", F.col("s.l").alias("p_left"), F.col("s.r").alias("p_right"), F.coalesce("s.gain", F.lit(0.0)).alias("gain"))


def score(rows: DataFrame, forest: DataFrame, cuts: DataFrame, keys: list[str], row: list[str], depth: int = 8, name: str = "prob", part_rows: int = 20_000) -> DataFrame:
    """(keys, row, y if present, name): the mean share of class 1 over the key's trees."""
    kept = list(dict.fromkeys([*keys, *row, *(["y"] if "y" in rows.columns else [])]))
    dealt, parts = parted(binned(rows.select(*kept, "x"), cuts, keys), keys, row, part_rows)
    group = [*keys, "_part"]

    def apply(part: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        out = part[kept].copy()
        if not len(part) or not len(grown):
            return out.assign(**{name: np.full(len(part), np.nan)})
        b, total, known = np.stack(part["b"].to_numpy()).astype(np.int64), np.zeros(len(part)), by_tree(grown)
        for tree in known.values():
            at, p = walk(b, tree, depth), np.full(2 << depth, np.nan)
            inner = tree[tree["feature"] >= 0]
            p[2 * inner["node"]], p[2 * inner["node"] + 1] = inner["p_left"], inner["p_right"]
            p[tree["node"]] = tree["p"]
            total += p[at]
        return out.assign(**{name: total / len(known)})

    scored = dealt.groupBy(*group).cogroup(forest.join(parts, keys).groupBy(*group)).applyInPandas(apply, f"{named(rows, kept)}, `{name}` double")
    return scored.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def importance(forest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, importance): falls of impurity, each tree's and then each key's made to sum to 1."""
    own = forest.where("feature >= 0").groupBy(*keys, "tree", "feature").agg(F.sum("gain").alias("g"))
    share = own.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy(*keys, "tree"))).groupBy(*keys, "feature").agg(F.sum("g").alias("g"))
    return share.withColumn("importance", F.col("g") / F.sum("g").over(Window.partitionBy(*keys))).drop("g")
