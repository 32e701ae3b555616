"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes (words) are summed by source. Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; a target is the
   weight's share of all words, but at most ``most`` times the source's size, the excess being shared again by weight.
2. All targets together make a number of equal blocks. A block goes to the source with the highest quotient
   target / (2 * seats + 1), so every source has an integer number of blocks. A source whose target is below 64 blocks, where
   rounding to blocks would matter, shares single words with its like in an apportionment of their own.
3. A source is dealt into shards of about ``shard_docs`` documents by a seeded hash, and its blocks go to its shards by the same
   rule, votes being the shard's words: an integer quota per shard.
4. In a shard, documents stand in seeded order. The quota is filled with whole passes over the shard, and the rest with a
   run of blocks that starts at a seeded place and wraps around. So a document is taken whole in almost every case, and
   no document more than ``most`` times.

Highest quotients without a loop: with n sources and B blocks, a source gets between round(v * (B - n) / V) and
round(v * (B + n) / V) seats, so only about 3n quotients need ranking.

Every step is an aggregation or a rank over ranges; a hot source is spread over its shards.

Defined results: a null or empty text has size 0 and is never taken; a source without words has target 0; a null source is a
source of its own; rows that repeat count each on its own; a null doc_id is dealt like any other value; an empty table
gives an empty table. Other columns are not read by ``plan``; ``take`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import SPARK_WORD, WORD, running, slices, table
from tidegauge.llm.registry import query
from tidegauge.session import durable, settled


def apportion(votes: DataFrame, seats: Column, group: list[str], order: list[Column], vote: str, name: str) -> DataFrame:
    """Sainte-Lague: add the integer column ``name``. The ``seats`` of each group (a value that its rows share) go by
    highest quotients, ties by ``order``. Without a group, all rows are one. A group without votes gets none.
    """
    if group:
        totals = votes.groupBy(*group).agg(F.sum(vote).alias("_V"), F.count(F.lit(1)).alias("_n"))
        rows = null_safe(votes, totals, group)
    else:
        total, count = votes.agg(F.sum(vote), F.count(F.lit(1))).first()
        rows = votes.withColumn("_V", F.lit(total or 0.0)).withColumn("_n", F.lit(count))
    rows = rows.withColumn("_B", seats)
    v, V, n, B = F.col(vote), F.col("_V"), F.col("_n"), F.col("_B")
    rows = durable(rows.select(
        "*", F.when(V > 0, F.greatest(F.lit(0), F.floor(v * (B - n) / V + 0.5) - 1)).otherwise(0).cast("bigint").alias("_least"),
        F.when(V > 0, F.floor(v * (B + n) / V + 0.5) + 1).otherwise(0).cast("bigint").alias("_most")))
    tries = rows.where("_most > _least").withColumn("_seat", F.explode(F.sequence("_least", F.col("_most") - 1))).withColumn("_quotient", v / (2 * F.col("_seat") + 1))
    ranked = running(tries, [*[F.col(g).asc_nulls_last() for g in group], F.col("_quotient").desc(), *order, F.col("_seat")], {}, "_rank")
    if group:
        spare = rows.groupBy(*group).agg((F.max("_B") - F.sum("_least")).alias("_spare"))
        ranked = durable(ranked)
        ranked = null_safe(null_safe(ranked, ranked.groupBy(*group).agg(F.min("_rank").alias("_first")), group), spare, group)
        won = ranked.where(F.col("_rank") - F.col("_first") < F.col("_spare"))
    else:
        least, = rows.agg(F.max("_B") - F.sum("_least")).first()
        won = ranked.where(F.col("_rank") <= (least or 0))
    keys = [c for c in votes.columns if c != vote]
    extra = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_extra"))
    return null_safe(rows, extra, keys, "left").select(*votes.columns, (F.col("_least") + F.coalesce("_extra", F.lit(0))).alias(name))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_key_{k}" for k in keys])


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Add ``target`` to (source, source_size): weights 1, 2, 3, ... by code point, capped at ``most`` times the size."""
    weighed = durable(running(sources, [F.col("source").asc_nulls_last()], {}, "_place").withColumn("_w", ((F.col("_place") - 1) % 3 + 1).cast("double")))
    total, weights = weighed.agg(F.sum("source_size").cast("double"), F.sum("_w")).first()
    # sources in the order in which they reach their cap; those before the level are capped
    order = [(F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    filled = running(weighed, order, {"_sizes": "source_size", "_weights": "_w"}, "_turn")
    before = most * (F.col("_sizes") - F.col("source_size")).cast("double")
    level = (F.lit(total or 0.0) - before) / (F.lit(weights or 0.0) - F.col("_weights") + F.col("_w"))
    under = most * F.col("source_size") >= level * F.col("_w")
    # the first source that stays under its cap sets the level for all after it
    at = filled.agg(F.min_by(level, F.when(under, F.col("_turn")))).first()[0] or 0.0
    return weighed.select("source", "source_size", F.least(most * F.col("source_size").cast("double"), F.lit(at) * F.col("_w")).alias("target"))


def plan(docs: DataFrame, seed: int = 17, block_tokens: int = 64, shard_docs: int = 1024, most: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and what is taken.

    ``passes`` is the number of whole copies; beside them the words [from1, to1) and [from2, to2) are taken once more
    (empty ranges where from = to).
    """
    sized = durable(docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(SPARK_WORD)), F.lit(0)).cast("bigint").alias("size")))
    sources = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")))
    aimed = durable(targets(sources.select("source", "source_size"), most))
    # every source keeps its block, whatever other sources there are
    aimed = aimed.withColumn("block", F.when(F.col("target") < 64 * block_tokens, 1).otherwise(block_tokens).cast("bigint"))
    words_of = aimed.groupBy("block").agg(F.round(F.sum("target") / F.first("block")).cast("bigint").alias("_seats"))
    votes = null_safe(aimed.select("source", "target", "block"), words_of, ["block"])
    quotas = apportion(votes, F.col("_seats"), ["block"], [F.col("source").asc_nulls_last()], "target", "quota")
    known = null_safe(null_safe(sources, aimed.select("source", "target", "block"), ["source"]), quotas.select("source", "quota"), ["source"], "left")
    known = durable(known.select("source", "source_size", "target", "block", F.coalesce("quota", F.lit(0)).alias("quota"), F.ceil(F.col("_docs") / shard_docs).alias("_shards")))

    mixed = F.xxhash64("doc_id", "size", F.lit(seed))
    dealt = null_safe(sized, known.select("source", "_shards"), ["source"]).select(
        "doc_id", "source", "size", F.xxhash64("doc_id", "size", F.lit(seed + 1)).alias("_turn"), F.pmod(mixed, F.col("_shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = durable(null_safe(shards, known, ["source"]))
    votes = shards.select("source", "shard", "quota", F.col("shard_size").cast("double").alias("votes"))
    shard_quotas = apportion(votes, F.col("quota"), ["source"], [F.col("shard")], "votes", "shard_quota").select("source", "shard", "shard_quota")
    S, block = F.col("shard_size"), F.col("block")
    words = F.least(F.coalesce(F.col("shard_quota") * block, F.lit(0)), most * S)
    filled = durable(null_safe(shards, shard_quotas, ["source", "shard"]).select(
        "source", "shard", "shard_size", "source_size", "target",
        F.when(S > 0, F.floor(words / S)).otherwise(0).cast("bigint").alias("passes"),
        F.when(S > 0, words % S).otherwise(0).cast("bigint").alias("_rest"),
        # the seeded block at which the last, partial pass begins
        F.when(S > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.greatest(F.floor(S / block), F.lit(1))) * block).otherwise(0).alias("_begin")))
    within = Window.partitionBy("source", "shard").orderBy("_turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_end", F.sum("size").over(within))
    placed = null_safe(placed, filled, ["source", "shard"])
    at = F.col("_end") - F.col("size")
    clip = lambda x: F.least(F.greatest(x - at, F.lit(0)), F.col("size"))
    stop = F.col("_begin") + F.col("_rest")
    over = F.greatest(stop - S, F.lit(0))  # the part of the run that wraps around
    out = placed.select(
        "doc_id", "size", "source_size", "target", "passes", clip(F.lit(0)).alias("from1"), clip(over).alias("to1"),
        clip(F.col("_begin")).alias("from2"), clip(F.least(stop, S)).alias("to2"), "source")
    taken = F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "from1", "to1", "from2", "to2", "source")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole documents, repeated as planned, and the parts at the ends of a run.

    A part keeps its document's other columns; ``n_chars`` is counted anew. Rows that share doc_id, source and size are
    planned alike, so each of them is matched with one of their plans; only those are numbered. A text is shuffled once.
    Columns may have any names.
    """
    names, schema = docs.columns, docs.schema
    key = ["_d", "_s", "_n"]
    size = F.coalesce(F.regexp_count("text", F.lit(SPARK_WORD)), F.lit(0)).cast("bigint")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(row.alias("_row"), F.col("doc_id").cast("bigint").alias("_d"), F.col("source").cast("string").alias("_s"), size.alias("_n")).where("_n > 0")
    cuts = ("passes", "from1", "to1", "from2", "to2")
    planned = settled(lambda: plan(docs, **options).where("size > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.struct(*cuts).alias("_plan"), (F.col("taken") > 0).alias("_taken")))
    again = durable(planned.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*[F.col(k).alias(f"_again{k}") for k in key]))
    wanted = planned.where("_taken").drop("_taken")
    if again.isEmpty():
        joined = null_safe(keyed, wanted, key)
    else:
        same = [F.col(k).eqNullSafe(F.col(f"_again{k}")) for k in key]
        turn = Window.partitionBy(*key)
        copies = keyed.join(again, same, "left_semi").withColumn("_copy", F.row_number().over(turn.orderBy(F.xxhash64("_row.text"))))
        plans = wanted.join(again, same, "left_semi").withColumn("_copy", F.row_number().over(turn.orderBy("_plan")))
        joined = null_safe(keyed.join(again, same, "left_anti"), wanted, key).unionByName(null_safe(copies, plans, [*key, "_copy"]).drop("_copy"))
    types = {f.name: t for f, t in zip(schema.fields, arrow_types(schema))}

    def run(batches):
        for batch in batches:
            whole = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names)
            orders = list(zip(*[c.to_pylist() for c in batch.column(1).flatten()]))
            start = 0
            # a slice leaves as up to three copies of its texts, so slices and not whole batches are held
            for part in slices([whole], limit=1 << 20):
                yield taken(part, orders[start : start + part.num_rows], types)
                start += part.num_rows

    return joined.select("_row", "_plan").mapInArrow(run, schema)


def taken(docs: pa.RecordBatch, orders: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """The copies and parts of some documents; an order is (passes, from1, to1, from2, to2)."""
    names = docs.schema.names
    rows, texts = [], []
    for i, (text, (passes, *cuts)) in enumerate(zip(docs.column(names.index("text")).to_pylist(), orders)):
        rows += [i] * passes
        texts += [text] * passes
        marks = None
        for a, b in (cuts[:2], cuts[2:]):
            if a < b:
                marks = marks or [m.span() for m in WORD.finditer(text)]
                rows.append(i)
                texts.append(text if (a, b) == (0, len(marks)) else text[marks[a][0] : marks[b - 1][1]])
    picked = docs.take(pa.array(rows, pa.int64()))
    columns = list(picked.columns)
    columns[names.index("text")] = pa.array(texts, types["text"])
    if "n_chars" in names:
        columns[names.index("n_chars")] = pa.array(np.array([len(t) for t in texts], np.int64)).cast(types["n_chars"])
    return pa.RecordBatch.from_arrays(columns, names)


def arrow_types(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


@query("op3_mixing")
def op3(spark, folder):
    return plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
