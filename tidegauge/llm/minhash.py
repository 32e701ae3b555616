"""Near-duplicate documents by one-permutation hashing.

1. A text's distinct word shingles are hashed once. The hash range is cut into bins, and a bin's value is the least hash in
   it. An empty bin takes the value of another bin, drawn anew for every bin until one is found that was not empty
   (optimal densification: the draws depend on the bin only, so equal sets agree and two bins do not copy together).
2. Texts with equal shingle sets form a class, named by its smallest doc_id; only classes go on.
3. Bins are banded. A bucket holds the classes that agree on a whole band.
4. Candidate edges are stars: a bucket's members are compared with its smallest one, then those that are not connected
   with the bucket's largest component are compared with another member of it, drawn anew in every turn, as long as turns
   find links. Each turn gives at most one pair for a member of a bucket.
   Members that are still outside after that are compared with all the rest by exact set intersections of whole blocks, from
   which only links come out. So no link between members of a bucket is lost, and no pairs of a group are listed.
5. Links are confirmed on the full sets, taken anew from the texts. Components come from star contraction.

The number of bands makes the chance that two texts at the limit share no bucket less than one in ten million. A text with
so few shingles that it cannot reach the limit without being equal needs no bands.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own component; a text with fewer
words than a shingle is one shingle. Rows that share a doc_id are one document for linking. A row with a null doc_id cannot be named: it is not
linked, its component is null and it is kept. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER, distinct_sorted, mix, shingles, slices, table, text_bytes, word_hashes, words
from tidegauge.llm.components import components
from tidegauge.llm.registry import query
from tidegauge.session import durable, settled

ROWS = 4
MISSED = 1e-7


def bands_for(percent: int, rows: int = ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and their rows. A-Z count as a-z."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    return distinct_sorted(*shingles(word_hashes(low, starts, ends), first, width))


def sketch(value: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """One-permutation sketch with optimal densification; every row has at least one shingle."""
    bin_of = ((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    new = np.ones(len(value), bool)
    new[1:] = (bin_of[1:] != bin_of[:-1]) | (row[1:] != row[:-1])
    out, filled = np.zeros((rows, bins), np.uint64), np.zeros((rows, bins), bool)
    out[row[new], bin_of[new].astype(np.int64)] = value[new]
    filled[row[new], bin_of[new].astype(np.int64)] = True
    at, empty = np.nonzero(~filled)
    attempt = 0
    while len(at):
        source = (mix(empty.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        good = filled[at, source]
        out[at[good], empty[good]] = out[at[good], source[good]]
        at, empty = at[~good], empty[~good]
        attempt += 1
    return out


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set (k1, k2) and the keys of its buckets."""
    bands = bands_for(percent)
    # with up to this many shingles only equal sets reach the limit: n / (n + 1) is below it
    tiny = max((n for n in range(1, 400) if 100 * n < percent * (n + 1)), default=0)

    def run(batches):
        for batch in slices(batches):
            rows = batch.num_rows
            value, row = shingle_sets(*text_bytes(batch), width)
            count = np.bincount(row, minlength=rows)
            cuts = np.concatenate([[0], np.cumsum(count)])
            keys = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
                keys.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
            large = np.flatnonzero(count > tiny)
            number = np.full(rows, -1)
            number[large] = np.arange(len(large))
            own = number[row] >= 0
            cells = sketch(value[own], number[row[own]], len(large), bands * ROWS).reshape(len(large), bands, ROWS)
            bucket = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(large), bands))
            for k in range(ROWS):
                bucket = mix(bucket * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, k])
            lengths = np.zeros(rows, np.int64)
            lengths[large] = bands
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            buckets = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(bucket).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), buckets], ["doc_id", "n_shingles", "k1", "k2", "buckets"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, buckets array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets reach the limit; texts: (node, text)."""

    def run(batches):
        for batch in batches:
            start = 0
            both = [text_bytes(batch, name) for name in ("left", "right")]
            while start < batch.num_rows:
                taken = np.flatnonzero((both[0][1][start + 1 :] - both[0][1][start]) + (both[1][1][start + 1 :] - both[1][1][start]) > (4 << 20))
                stop = min(batch.num_rows, start + max(1, int(taken[0]) if len(taken) else batch.num_rows))
                rows = stop - start
                sets = []
                for data, offsets in both:
                    cut = offsets[start : stop + 1]
                    sets.append(shingle_sets(data[cut[0] : cut[-1]], cut - cut[0], width))
                (v1, r1), (v2, r2) = sets
                value, row = np.concatenate([v1, v2]), np.concatenate([r1, r2])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                twin = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][twin], minlength=rows)
                total = np.bincount(r1, minlength=rows) + np.bincount(r2, minlength=rows) - common
                linked = pa.array((100 * common >= percent * total) & (common > 0))
                yield batch.slice(start, rows).select(["a", "b"]).filter(linked)
                start = stop

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint").distinct()


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct shingles of each text."""

    def run(batches):
        for batch in slices(batches):
            value, row = shingle_sets(*text_bytes(batch), width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def common_counts(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another."""
    sides = []
    for lists in (left, right):
        size = np.asarray(lists.value_lengths())
        sides.append((lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), size)))
    (tokens, row), (other, other_row) = sides
    order = np.argsort(other, kind="stable")
    other, other_row = other[order], other_row[order]
    begin, end = np.searchsorted(other, tokens), np.searchsorted(other, tokens, side="right")
    times = end - begin
    at = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return np.bincount(np.repeat(row, times) * len(right) + other_row[at], minlength=len(left) * len(right)).reshape(len(left), len(right))


def settle(rows: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 1 << 14) -> DataFrame:
    """All links (a, b) between different labels of members of the open buckets ``rows`` (bucket, node, n, label, main).

    Buckets with the same smallest member are a family. Those members that are outside the largest component of a bucket are
    compared with the whole family, in blocks of about ``block`` shingles: a task has one block of each, and only links leave it.
    """
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("family"))
    members = rows.join(hubs, "bucket").groupBy("family", "node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("open"))
    members = durable(members)
    parts = members.groupBy("family").agg(
        F.ceil(F.sum("n") / block).cast("int").alias("ways"), F.ceil(F.sum(F.when(F.col("open"), F.col("n"))) / block).cast("int").alias("open_ways")).where("open_ways > 0")
    members = durable(members.join(parts, "family").join(sets_of(texts.join(members.select("node").distinct(), "node", "left_semi"), width), "node"))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "label", "shingles"]
    left = members.select("family", slot("ways").alias("way"), every("open_ways").alias("open_way"), *columns)
    right = members.where("open").select("family", every("ways").alias("way"), slot("open_ways").alias("open_way"), *columns)

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.combine_chunks(), two.combine_chunks()
        column = lambda t, n: t.column(n).chunk(0) if t.num_rows else pa.array([], t.schema.field(n).type)
        sets = [column(t, "shingles") for t in (one, two)]
        common = common_counts(*sets)
        total = np.asarray(sets[0].value_lengths())[:, None] + np.asarray(sets[1].value_lengths())[None, :] - common
        labels = [column(t, "label").to_numpy() for t in (one, two)]
        i, j = np.nonzero((100 * common >= percent * total) & (common > 0) & (labels[0][:, None] != labels[1][None, :]))
        return pa.table({"a": column(one, "node").take(pa.array(i)), "b": column(two, "node").take(pa.array(j))})

    keys = ["family", "way", "open_way"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a bigint, b bigint").distinct()


def links_of(entries: DataFrame, texts: DataFrame, width: int, percent: int, worth: float = 0.05) -> DataFrame:
    """Labels (node, label) of all nodes that are linked, from bucket entries (bucket, node, n)."""
    labels, tested, links, turn = None, None, None, 0
    while True:
        if labels is None:
            rows = entries.withColumn("label", F.col("node"))
            centre = rows.groupBy("bucket").agg(F.min(F.struct("node", "n", "label")).alias("c"))
            outside = rows
        else:
            rows = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            parts = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"))
            largest = parts.groupBy("bucket").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
            rows = durable(rows.join(largest.select("bucket", "main"), "bucket"))
            outside = rows.where("label != main")
            waiting = outside.select("node").distinct().count()
            if not waiting:  # in every bucket the members are connected
                return labels
            if gained < worth * waiting:
                last = settle(rows, texts, width, percent)
                every = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(last)
                return settled(lambda: components(every))
            centre = rows.where("label = main").groupBy("bucket").agg(F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", "bucket", F.lit(turn))).alias("c"))
        near = (F.col("label") != F.col("c.label")) & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
        pairs = outside.join(centre, "bucket").where(near).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        pairs = durable(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        new = durable(confirm(pairs, texts, width, percent))
        gained = new.count()
        tested = pairs if tested is None else tested.union(pairs)
        links = new if links is None else links.union(new)
        labels = settled(lambda: components(links))
        turn += 1


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked to, itself included), kept."""
    signed = durable(signatures(docs, width, percent))
    classes = durable(signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")))
    every = classes.select(F.explode("buckets").alias("bucket"), "node", F.col("n").cast("int").alias("n"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("bucket")
    entries = durable(every.join(shared, "bucket"))
    nodes = entries.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").join(nodes, "doc_id", "left_semi")
    texts = durable(texts.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).select(F.col("doc_id").alias("node"), "text"))
    labels = None if entries.isEmpty() else links_of(entries, texts, width, percent)
    named = classes.select("k1", "k2", "node")
    named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("label"))
    out = signed.drop("buckets").join(named.select("k1", "k2", "label"), ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("label")), F.col("doc_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the rows whose document is not linked to a smaller doc_id, and one row of each doc_id."""
    found = settled(lambda: near_duplicates(docs, width, percent).select("doc_id", "kept").where("doc_id is not null"))
    left = docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    again = found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("doc_id")
    if not again.isEmpty():  # rows that repeat a doc_id
        left = left.join(again, "doc_id", "left_anti").union(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT edges.b, reached.other FROM reached JOIN edges ON edges.a = reached.doc_id
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""


@query("op7_minhash", SQL)
def op7(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
