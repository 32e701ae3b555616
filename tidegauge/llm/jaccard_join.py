"""Jaccard join of word shingles with forests of R-trees over count vectors.

1. A text's distinct shingles are hashed into the groups of its size level. The counts of the groups are a point. A pair can share
   at most the sum over groups of the smaller count, so points bound overlaps.
2. Texts with equal shingle sets form a class, named by its smallest doc_id; only classes go on.
3. One tree over everything would compare each text with all of its size, so the points are dealt into a forest. Two sets at
   the limit differ in at most D shingles and there are G > D groups, hence at least G - D groups with the same shingles: a
   text goes to the cells (level, group, content of the group) of its groups, and linked texts meet in a cell. Cells
   with the same smallest member are one tree.
4. Every tree is first probed with one of its points, then, as long as that links much, with one of its largest
   component: of each component only its links with the rest matter.
5. Trees that still hold several components are built: leaves of points in the order of components and sizes, boxes of
   counts above them, 32 to a box. Pairs of boxes are followed down from the root, and a pair is left when its summed
   minima (of upper corners, over the summed maxima of lower corners) cannot reach the limit, or when both are in one component.
   In pairs of leaves the same bound leaves pairs of points.
6. Surviving pairs are verified on the full sets. Components come from star contraction.

A text of size n meets partners of a level whose smaller sets reach 100 n / percent, so it lies in one or two levels. Where all of
a text's unchanged groups may be empty it also goes to cells of its first shingles in hash order (as many as a linked set must meet). Up to about
a hundred shingles this loses no link. In higher levels cells are kept by a digest of their content so that at least 20 of those
shared by texts at the limit are expected: they miss each other with a chance of about two in a billion.

No hot tree or cell is in one task: joins on them are salted. More than 1/(4 s) of the rows, with s salts, is hot, so there are
at most 4 s hot ones to broadcast. Leaves are ranges of a total order, cut by their number of shingles.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own component; a text with fewer
words than a shingle is one shingle. Rows that share a doc_id are one document for linking. A row with a null doc_id cannot be
named: it is not linked and its component is null. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import mix, running, slices, table, text_bytes
from tidegauge.llm.components import components
from tidegauge.llm.minhash import SQL as NEAR_DUPLICATES
from tidegauge.llm.minhash import sets_of, shingle_sets
from tidegauge.llm.registry import query
from tidegauge.session import durable

EXPECTED = 14  #: cells kept for each of the G - D groups that are sure to be the same; more are in fact
LEAF = 1 << 15  #: shingles of a leaf
LEAST = 1 << 7  #: what a point counts at least, so that a leaf has at most LEAF / LEAST of them
FAN = 32
LEVEL_BITS = 7


@dataclass(frozen=True)
class Levels:
    """Size levels: level k has the pairs whose smaller set has first[k] <= size < first[k + 1]."""

    percent: int
    first: np.ndarray
    differ: np.ndarray  #: D, the most differing shingles of a linked pair
    groups: np.ndarray  #: G
    partner: np.ndarray  #: the largest set that such a pair can have

    @staticmethod
    def up_to(percent: int) -> Levels:
        first = [1]
        while len(first) <= 1 << LEVEL_BITS:
            first.append(max(first[-1] + 1, first[-1] * 3 // 2))
        first = np.array([f for f in first if f < 1 << 40], np.int64)
        largest = first[1:] - 1
        differ = largest * (100 - percent) // percent
        return Levels(percent, first[:-1], differ, differ + np.maximum(2, (differ + 1) // 2), largest * 100 // percent)

    def own(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, n, side="right") - 1


def cells_and_points(value: np.ndarray, row: np.ndarray, rows: int, levels: Levels):
    """Cell keys as (row, key) and points as (row, level, counts), from the distinct shingles of each row in ascending order."""
    n = np.bincount(row, minlength=rows)
    own = levels.own(n)
    place, content = mix(value ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(32), mix(value + np.uint64(0x9FB21C651E98DF25))
    key_rows, keys, point_rows, point_levels, points = [], [], [], [], []
    back = 0
    while True:
        level = own - back
        safe = np.maximum(level, 0)
        valid = (n > 0) & (level >= 0) & (levels.partner[safe] >= n)
        if not valid.any():
            break
        valid &= levels.differ[safe] > 0  # else only equal sets are linked
        G = np.where(valid, levels.groups[safe], 0)
        base = np.concatenate([[0], np.cumsum(G)])
        mine = valid[row]
        at_row = row[mine]
        slot = base[at_row] + ((place[mine] * G[at_row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(slot, minlength=base[-1])
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, content[mine])
        slot_row = np.repeat(np.arange(rows), G)
        slot_level = safe[slot_row]
        group = np.arange(base[-1]) - base[slot_row]
        key = mix(sums * np.uint64(0xD6E8FEB86659FD93) + mix(group.astype(np.uint64) << np.uint64(8) | slot_level.astype(np.uint64)))
        sure = (levels.groups - levels.differ)[slot_level]
        kept = (counts > 0) & (key.astype(np.float64) < np.minimum(1.0, EXPECTED / np.maximum(sure, 1)) * 2.0**64)
        key_rows.append(slot_row[kept])
        keys.append(tagged(key[kept], slot_level[kept]))
        # all groups that stay the same may be empty ones: the first shingles, of which linked sets share one
        empty = np.bincount(slot_row[counts == 0], minlength=rows)
        sparse = valid & (empty >= G - levels.differ[safe])
        if sparse.any():
            prefix = n - -(-levels.percent * n // 100) + 1
            start = np.concatenate([[0], np.cumsum(n)])[:-1]
            some = sparse[row] & (np.arange(len(row)) - start[row] < prefix[row])
            key_rows.append(row[some])
            keys.append(tagged(mix(value[some] * np.uint64(0xC2B2AE3D27D4EB4F) + safe[row[some]].astype(np.uint64)), safe[row[some]]))
        at = np.flatnonzero(valid)
        crowded = np.zeros(rows, bool)
        crowded[slot_row[counts > 255]] = True
        bytes_ = counts.astype(np.uint8).tobytes()
        point_rows.append(at)
        point_levels.append(safe[at])
        points += [b"" if crowded[i] else bytes_[base[i] : base[i + 1]] for i in at.tolist()]
        back += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *key_rows]), np.concatenate([none, *keys]), np.concatenate([none, *point_rows]), np.concatenate([none, *point_levels]), points


def tagged(key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The key with its level in the lowest bits."""
    return (key >> np.uint64(LEVEL_BITS) << np.uint64(LEVEL_BITS) | level.astype(np.uint64)).view(np.int64)


def lists(rows: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(order)))


SIGNED = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, cells array<bigint>, points array<struct<level: int, counts: binary>>"


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set (k1, k2), the keys of its cells and its points."""
    levels = Levels.up_to(percent)

    def run(batches):
        for batch in slices(batches, limit=1 << 20):
            rows = batch.num_rows
            value, row = shingle_sets(*text_bytes(batch), width)
            n = np.bincount(row, minlength=rows)
            cuts = np.concatenate([[0], np.cumsum(n)])
            names = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
                names.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
            key_row, key, point_row, point_level, points = cells_and_points(value, row, rows, levels)
            structs = pa.StructArray.from_arrays([pa.array(point_level.astype(np.int32)), pa.array(points, pa.binary())], ["level", "counts"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(names[0]), pa.array(names[1]), lists(rows, key_row, pa.array(key)), lists(rows, point_row, structs)],
                ["doc_id", "n_shingles", "k1", "k2", "cells", "points"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


# ---- joins on hot keys -----------------------------------------------------------------------------------------------

class Salts:
    """Hot values of a key: those with more than 1 / (4 s) of the rows, at most 4 s of them, get s salts."""

    def __init__(self, sizes: DataFrame, keys: list[str], size: str):
        self.keys, self.s = keys, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = sizes.agg(F.sum(size)).first()[0] or 0
        self.hot = durable(sizes.where(F.col(size) > total / (4 * self.s)).select(*keys, F.lit(True).alias("_hot")))

    def many(self, df: DataFrame, by: str) -> DataFrame:
        """Rows of which a key has many: each gets one of the salts."""
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(self.s))).otherwise(0).cast("int")
        return df.join(F.broadcast(self.hot), self.keys, "left").withColumn("salt", salt).drop("_hot")

    def one(self, df: DataFrame) -> DataFrame:
        """Rows of which a key has one: a copy for each salt."""
        every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(self.s - 1))).otherwise(F.array(F.lit(0)))
        return df.join(F.broadcast(self.hot), self.keys, "left").withColumn("salt", F.explode(every)).drop("_hot")


# ---- bounds and verification -----------------------------------------------------------------------------------------

def may_link(low_a, high_a, low_b, high_b, percent: int) -> np.ndarray:
    """Whether boxes of counts can hold a linked pair: summed minima of upper corners against summed maxima of lower ones."""
    most = np.minimum(high_a, high_b).sum(axis=-1, dtype=np.int64)
    least = np.maximum(low_a, low_b).sum(axis=-1, dtype=np.int64)
    return 100 * most >= percent * least


def near(percent: int):
    return 100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs of points (counts, c_counts) whose bound reaches the limit; an empty point has no bound."""

    def run(batches):
        for batch in batches:
            mine, other = (batch.column(batch.schema.get_field_index(c)) for c in ("counts", "c_counts"))
            keep = [not a or not b or bool(may_link(p := np.frombuffer(a, np.uint8), p, q := np.frombuffer(b, np.uint8), q, percent)) for a, b in zip(mine.to_pylist(), other.to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["level", "hub", "salt", "node", "c"])

    return pairs.select("level", "hub", "salt", "node", "c", "counts", "c_counts").mapInArrow(run, "level int, hub bigint, salt int, node bigint, c bigint")


def verified(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of rows (node, text, c, c_text) whose full sets reach the limit."""

    def run(batches):
        for batch in batches:
            for part in (p for half in slices([batch], "text", 1 << 20) for p in slices([half], "c_text", 1 << 20)):
                (v1, r1), (v2, r2) = (shingle_sets(*text_bytes(part, name), width) for name in ("text", "c_text"))
                value, row = np.concatenate([v1, v2]), np.concatenate([r1, r2])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                twin = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][twin], minlength=part.num_rows)
                total = np.bincount(r1, minlength=part.num_rows) + np.bincount(r2, minlength=part.num_rows) - common
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], ["a", "b"]).filter(pa.array((100 * common >= percent * total) & (common > 0)))

    return pairs.select("node", "text", "c", "c_text").mapInArrow(run, "a bigint, b bigint")


# ---- trees -----------------------------------------------------------------------------------------------------------

KEYS = ["level", "hub"]


def leaves_of(members: DataFrame, salts: Salts) -> DataFrame:
    """Add ``leaf``: members of a tree in the order of component and size, cut by their shingles. Components of one come first."""
    parts = members.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    # a component of several keeps together, points that are alone are ordered by size
    marked = members.join(salts.one(parts), [*KEYS, "salt", "label"], "left")
    marked = marked.withColumn("_alone", F.col("_c").isNull()).withColumn("_first", F.when(F.col("_alone"), F.col("n")).otherwise(F.col("label")))
    marked = marked.withColumn("_weight", F.greatest("n", F.lit(LEAST)))
    order = [F.col("level"), F.col("hub"), F.col("_alone").desc(), F.col("_first"), F.col("n"), F.col("node")]
    ranked = running(marked, order, {"_upto": "_weight"}, "_rank")
    return ranked.select(*members.columns, F.floor((F.col("_upto") - F.col("_weight")) / LEAF).cast("bigint").alias("leaf"))


BOX = "level int, hub bigint, id bigint, low binary, high binary, least bigint, most bigint, label bigint, open boolean"


def boxes(rows: DataFrame) -> DataFrame:
    """Bounding boxes of rows (``BOX``) by (level, hub, id); ``label`` is null where there are several, corners where there is no bound."""

    def run(batches):
        names = BOX.replace(",", "").split()[::2]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

        def found():
            now = None
            for batch in batches:
                for level, hub, id_, low, high, least, most, label, open_ in zip(*[c.to_pylist() for c in batch.columns]):
                    low, high = (np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)) if low else (None, None)
                    if now is None or now[:3] != [level, hub, id_]:
                        if now is not None:
                            yield now
                        now = [level, hub, id_, low, high, least, most, label, open_]
                        continue
                    now[3], now[4] = (None, None) if low is None or now[3] is None else (np.minimum(now[3], low), np.maximum(now[4], high))
                    now[5], now[6], now[7], now[8] = min(now[5], least), max(now[6], most), now[7] if now[7] == label else None, now[8] or open_
            if now is not None:
                yield now

        held = []
        for box in found():
            held.append([*box[:3], *(None if v is None else v.tobytes() for v in box[3:5]), *box[5:]])
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return rows.repartition("level", "hub", "id").sortWithinPartitions("level", "hub", "id").mapInArrow(run, BOX)


def descend(leaves: DataFrame, percent: int) -> DataFrame:
    """(level, hub, one, two): the pairs of different leaves that may hold links of different components, from leaf boxes.

    Boxes are put into boxes until a tree has at most ``FAN``; all pairs of those are tried, then the pairs of their children.
    """
    heights = [durable(leaves)]
    while heights[-1].groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > FAN).limit(1).count():
        heights.append(durable(boxes(heights[-1].withColumn("id", F.floor(F.col("id") / FAN).cast("bigint")))))
    pairs = None

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            keep = [
                r["one"] == r["two"] or not r["low1"] or not r["low2"]
                or bool(may_link(*(np.frombuffer(r[k], np.uint8) for k in ("low1", "high1", "low2", "high2")), percent)) for r in rows]
            yield batch.select([*KEYS, "one", "two"]).filter(pa.array(keep, pa.bool_()))

    for below in reversed(heights):
        # above the top height, every tree is one box
        child = below.withColumn("parent", F.lit(0).cast("bigint") if pairs is None else F.floor(F.col("id") / FAN).cast("bigint"))
        side = lambda k, parent: child.select(
            *KEYS, F.col("parent").alias(parent), *[F.col(c).alias(f"{c}{k}") for c in ("id", "low", "high", "least", "most", "label", "open")])
        met = side(1, "one").join(side(2, "two"), KEYS) if pairs is None else pairs.join(side(1, "one"), [*KEYS, "one"]).join(side(2, "two"), [*KEYS, "two"])
        apart = (F.col("label1").isNull() | F.col("label2").isNull() | (F.col("label1") != F.col("label2"))) & (F.col("open1") | F.col("open2"))
        sizes = 100 * F.least("most1", "most2") >= percent * F.greatest("least1", "least2")
        met = met.where((F.col("id1") == F.col("id2")) | (F.col("id1") < F.col("id2")) & apart & sizes)
        pairs = durable(met.select(*KEYS, F.col("id1").alias("one"), F.col("id2").alias("two"), "low1", "high1", "low2", "high2").mapInArrow(run, "level int, hub bigint, one bigint, two bigint"))
    return pairs.where("one < two")


def meetings(one: list[dict], two: list[dict] | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each point of a leaf, the places in the other leaf (or later in the same one) of points of other components within the bound."""
    other = one if two is None else two
    n, label, open_ = (np.array([r[k] for r in other]) for k in ("n", "label", "open"))
    counts = None if any(not r["counts"] for r in other) else np.array([np.frombuffer(r["counts"], np.uint8) for r in other])
    for i, r in enumerate(one):
        start = i + 1 if two is None else 0
        ok = (100 * np.minimum(n[start:], r["n"]) >= percent * np.maximum(n[start:], r["n"])) & (label[start:] != r["label"]) & (open_[start:] | r["open"])
        if counts is not None and r["counts"] and ok.any():
            mine = np.frombuffer(r["counts"], np.uint8)
            ok &= may_link(mine, mine, counts[start:], counts[start:], percent)
        yield i, np.flatnonzero(ok) + start


def compare(one: list[dict], two: list[dict] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links between two leaves, or within one: pairs of different components whose bound and whose sets reach the limit.

    What is linked in the leaves becomes one component, so a group of copies gives a chain of links and not all its pairs.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    other = one if two is None else two
    for i, places in meetings(one, two, percent):
        r = one[i]
        for j in places.tolist():
            o = other[j]
            if root(r["label"]) == root(o["label"]):
                continue
            common = len(np.intersect1d(r["shingles"], o["shingles"], assume_unique=True))
            if common and 100 * common >= percent * (r["n"] + o["n"] - common):
                parent[root(r["label"])] = root(o["label"])
                yield r["node"], o["node"]


TASK = [*KEYS, "one", "two"]


def by_task(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(left, right)`` on the rows of each pair of leaves (``right`` is None within a leaf), as rows of ``schema``; rows have a ``side``."""
    names, types = schema.replace(",", "").split()[::2], [{"int": pa.int32(), "bigint": pa.int64()}[t] for t in schema.replace(",", "").split()[1::2]]
    plain, with_sets = [c for c in rows.columns if c != "shingles"], "shingles" in rows.columns

    def run(batches):
        def done(now, held):
            left, right = ([r for r in held if r["side"] == k] for k in (0, 1))
            found = list(work(left, None if now[2] == now[3] else right))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

        now, held = None, []
        for batch in batches:
            arrays = batch.column(batch.schema.get_field_index("shingles")) if with_sets else None
            for i, r in enumerate(batch.select(plain).to_pylist()):
                if (key := tuple(r[k] for k in TASK)) != now:
                    if held:
                        yield done(now, held)
                    now, held = key, []
                if arrays is not None:
                    r["shingles"] = arrays[i].values.to_numpy().copy()
                held.append(r)
        if held:
            yield done(now, held)

    return rows.repartition(*TASK).sortWithinPartitions(*TASK, "side", "node").mapInArrow(run, schema)


def search(members: DataFrame, points: DataFrame, docs: DataFrame, salts: Salts, width: int, percent: int) -> DataFrame:
    """All links (a, b) that join components, from members (level, hub, salt, node, n, label, open) of trees with several components."""
    placed = durable(leaves_of(members, salts).join(points, ["node", "level"]))
    corner = [F.when(F.length("counts") > 0, F.col("counts")).alias(c) for c in ("low", "high")]
    several = placed.groupBy(*KEYS).agg(F.count_distinct("leaf").alias("_c")).where("_c > 1").select(*KEYS)
    spread = placed.join(salts.one(several), [*KEYS, "salt"])
    leaf = boxes(spread.select(*KEYS, F.col("leaf").alias("id"), *corner, F.col("n").alias("least"), F.col("n").alias("most"), "label", "open"))
    pairs = descend(leaf, percent)
    columns = ["node", "n", "label", "open", "counts"]
    alone = placed.select(*KEYS, F.col("leaf").alias("one"), F.col("leaf").alias("two"), F.lit(0).alias("side"), *columns)
    side = lambda k, name: pairs.join(placed.withColumnRenamed("leaf", name), [*KEYS, name]).select(*TASK, F.lit(k).alias("side"), *columns)
    every = alone.union(side(0, "one")).union(side(1, "two"))

    def meeting(left, right):
        """The points that meet another one: only their sets are fetched."""
        met = set()
        for i, places in meetings(left, right, percent):
            if len(places):
                met.add((0, left[i]["node"]))
                met.update((int(right is not None), (left if right is None else right)[j]["node"]) for j in places.tolist())
        key = [left[0][k] for k in TASK] if left else []
        return [(*key, side_, node) for side_, node in met]

    waiting = durable(by_task(every, meeting, "level int, hub bigint, one bigint, two bigint, side int, node bigint"))
    sets = sets_of(texts_of(docs, waiting.select("node")), width)
    of_points = placed.select(*KEYS, *columns).dropDuplicates([*KEYS, "node"])
    full = waiting.join(of_points, [*KEYS, "node"]).join(sets, "node").select(*TASK, "side", *columns, "shingles")
    return by_task(full, lambda left, right: compare(left, right, percent), "a bigint, b bigint").distinct()


SENT = 4_000_000  #: ids that may be broadcast (32 MB); beyond that texts are shuffled to them


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the documents in ``nodes``, each text of one once, written once."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string")).where("text is not null")
    ids = durable(nodes.select("node").distinct())
    texts = texts.join(F.broadcast(ids) if ids.count() <= SENT else ids, "node", "left_semi").withColumn("_h", F.xxhash64("text"))
    return durable(texts.dropDuplicates(["node", "_h"]).select("node", "text"))


def probe(outside: DataFrame, centres: DataFrame, points: DataFrame, salts: Salts, percent: int) -> DataFrame:
    """(level, hub, salt, node, c): the members of trees that pass the bound with their tree's centre (level, hub, c, c_n)."""
    c_points = centres.join(points.withColumnsRenamed({"node": "c", "counts": "c_counts"}), ["c", "level"])
    pairs = outside.join(points, ["node", "level"]).join(salts.one(c_points), [*KEYS, "salt"]).where(near(percent) & (F.col("node") != F.col("c")))
    return durable(bounded(pairs, percent).dropDuplicates(["node", "c"]))


def confirmed(pairs: DataFrame, docs: DataFrame, salts: Salts, width: int, percent: int) -> DataFrame:
    texts = texts_of(docs, pairs.select("node").union(pairs.select(F.col("c").alias("node"))))
    c_texts = pairs.select(*KEYS, "c").distinct().join(texts.withColumnsRenamed({"node": "c", "text": "c_text"}), "c")
    # a centre's text for each salt, so that no task has all its pairs
    return durable(verified(pairs.join(texts, "node").join(salts.one(c_texts), [*KEYS, "c", "salt"]), width, percent))


def links_of(members: DataFrame, points: DataFrame, docs: DataFrame, width: int, percent: int, worth: float = 0.1) -> DataFrame:
    """Labels (node, label) of all linked nodes, from the members (level, hub, node, n) of the forest.

    Trees of more than a leaf are probed again as long as the bound leaves at least the part ``worth`` of the waiting nodes.
    """
    salts = Salts(members.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c")), KEYS, "_c")
    members = durable(salts.many(members, "node"))
    first = members.groupBy(*KEYS).agg(F.min(F.struct("node", "n")).alias("m")).select(*KEYS, F.col("m.node").alias("c"), F.col("m.n").alias("c_n"))
    links = confirmed(probe(members, first, points, salts, percent), docs, salts, width, percent)
    turn = 0
    while True:
        labels = durable(components(links))
        rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        parts = rows.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.greatest("n", F.lit(LEAST))).alias("_w"))
        main = F.max_by("label", F.struct("_c", "label")).alias("main")
        several = parts.groupBy(*KEYS).agg(main, F.count(F.lit(1)).alias("_p"), F.sum("_w").alias("_w")).where("_p > 1").drop("_p")
        rows = durable(rows.join(salts.one(several), [*KEYS, "salt"]))
        if rows.isEmpty():  # every tree is one component
            return labels
        large = rows.where(F.col("_w") > LEAF)
        waiting = large.where("label != main").select("node").distinct().count()
        if waiting:
            turn += 1
            drawn = large.where("label = main").groupBy(*KEYS).agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("m"))
            pairs = probe(large.where("label != main").drop("_w"), drawn.select(*KEYS, F.col("m.node").alias("c"), F.col("m.n").alias("c_n")), points, salts, percent)
            if pairs.count() >= worth * waiting:
                new = confirmed(pairs, docs, salts, width, percent)
                if not new.isEmpty():
                    links = links.union(new)
                    continue
        last = search(rows.select(*KEYS, "salt", "node", "n", "label", (F.col("label") != F.col("main")).alias("open")), points, docs, salts, width, percent)
        return merged(labels, durable(last))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only the components that they join are contracted again."""
    if links.isEmpty():
        return labels
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(named)
    again = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    kept = labels.join(again, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return durable(kept.union(joined.join(labels, "node", "left_anti").select("node", "label")))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked to, itself included)."""
    signed = durable(signatures(docs, width, percent))
    rest = F.struct("n_shingles", "cells", "points")
    chosen = signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min_by(rest, "doc_id").alias("r"))
    chosen = durable(chosen.select("k1", "k2", "node", F.col("r.n_shingles").alias("n"), "r.cells", "r.points"))
    classes = chosen.select("k1", "k2", "node")
    every = chosen.select(F.explode("cells").alias("cell"), "node", "n")
    shared = durable(every.groupBy("cell").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_c")).where("_c > 1"))
    salts = Salts(shared, ["cell"], "_c")
    level = F.col("cell").bitwiseAND((1 << LEVEL_BITS) - 1).cast("int").alias("level")
    members = durable(salts.many(every, "node").join(salts.one(shared.select("cell", "hub")), ["cell", "salt"]).select(level, "hub", "node", "n").distinct())
    nodes = members.select("node").distinct()
    points = durable(chosen.join(nodes, "node", "left_semi").select("node", F.explode("points").alias("p")).select("node", "p.level", "p.counts"))
    labels = None if members.isEmpty() else links_of(members, points, docs, width, percent)
    named = classes.withColumn("label", F.col("node")) if labels is None else classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named.select("k1", "k2", "label"), ["k1", "k2"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label"))
    return out.select("doc_id", "n_shingles", F.coalesce(linked, F.col("doc_id")).alias("component_id"))


SQL = (
    NEAR_DUPLICATES.replace("len(w) < 3", "len(w) < 5").replace("range(1, len(w) - 1)", "range(1, len(w) - 3)")
    .replace("w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]", "array_to_string(w[i : i + 4], ' ')").replace("85 *", "80 *")
    .replace(", coalesce(component_id, d.doc_id) = d.doc_id AS kept", ""))


@query("op11_jaccard_join", SQL)
def op11(spark, folder):
    return jaccard_join(table(spark, folder, "documents"))
