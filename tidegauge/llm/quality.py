"""Quality rules by distribution divergence.

Every text gets a histogram of character classes and one of the common words of its language. Both are compared with the
language's reference by the Jensen-Shannon distance (base 2). A reference is the mean histogram of all documents of that
language which pass the base rules, hold few symbols and are long enough. A distance only counts when the text is long enough for it
(``min_chars``, ``min_words``), and the limit widens for shorter texts, because a small sample strays further from its own
source: limit + slack / sqrt(n).

A text in a language without a list of common words, or with a null one, is judged by the base rules alone: being far from
languages it is not written in says nothing about it.

Defined results: a null or empty text has no words, fails the base rules (fewer than 10 words) and is not kept; rows repeat
if they repeat; a null doc_id stays null; an empty table gives an empty table. If no document can serve as a reference for
a language, its texts are judged by the base rules alone. ``scores`` reads no other columns; ``keep`` returns rows as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import BLANK, LOWER, mix, prefix_sums, range_hashes, repeated, shingles, slices, table, text_bytes, word_hashes, words
from tidegauge.llm.registry import query

#: Frequent function words (fixed values).
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he this are or his from at which an have but they you all were",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou elle mais aux",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este",
}
LANGUAGES = tuple(COMMON_WORDS)
LISTS = {lang: tuple(text.split()) for lang, text in COMMON_WORDS.items()}
SLOTS = max(map(len, LISTS.values())) + 1  # the last slot counts all other words

#: Classes of characters; each takes one slot.
CLASSES = ("lower", "upper", "beyond ASCII", "digit", "blank", "line end", "comma or full stop", "other sentence mark", "symbol", "other")
CLASS_OF = np.full(256, 9, np.uint8)
CLASS_OF[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
CLASS_OF[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
CLASS_OF[0xC0:] = 2
CLASS_OF[list(b"0123456789")] = 3
CLASS_OF[list(b" \t\v\f\r")] = 4
CLASS_OF[ord("\n")] = 5
CLASS_OF[list(b",.")] = 6
CLASS_OF[list(b"!?:;'\"()-")] = 7
CLASS_OF[list(b"#*$%&|<>")] = 8
CLASS_OF[0x80:0xC0] = 15  # a byte inside a character
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
ENDING = np.isin(np.arange(256), list(b".,;:!?"))


@dataclass(frozen=True)
class Limits:
    least_words: int = 10
    repeat_percent: int = 20
    reference_symbol_percent: int = 1
    min_chars: int = 200
    min_words: int = 60
    class_distance: float = 0.14
    class_slack: float = 2.0
    word_distance: float = 0.25
    word_slack: float = 1.5


def _hash_list(texts) -> np.ndarray:
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return word_hashes(data, ends - np.array([len(r) for r in raw]), ends)


class CommonWords:
    """Slot of a word in each language's histogram."""

    def __init__(self):
        every = sorted(set().union(*LISTS.values()))
        hashes = _hash_list(every)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.slot = np.full((len(LANGUAGES), len(every) + 1), SLOTS - 1, np.int64)
        for k, lang in enumerate(LANGUAGES):
            for i, j in enumerate(order):
                if every[j] in LISTS[lang]:
                    self.slot[k, i] = LISTS[lang].index(every[j])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))


@dataclass
class Measured:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_chars: np.ndarray
    classes: np.ndarray  # rows x classes
    common: np.ndarray  # rows x languages x slots

    def base_failed(self, limits: Limits) -> np.ndarray:
        return (self.n_words < limits.least_words) | (100 * self.n_repeat_words > limits.repeat_percent * self.n_words)

    def serves(self, limits: Limits) -> np.ndarray:
        """Which rows can be part of a reference."""
        plain = 100 * self.n_symbols <= limits.reference_symbol_percent * self.word_chars
        return ~self.base_failed(limits) & plain & (self.n_chars >= limits.min_chars) & (self.n_words >= limits.min_words)


def sum_by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def later_equals(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each entry, whether an earlier entry of the same row has the same value."""
    out = repeated(value, row)
    at = np.flatnonzero(out)
    _, first = np.unique(mix(value[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out[at[first]] = False
    return out


def measure(data: np.ndarray, offsets: np.ndarray, lists: CommonWords, lang: np.ndarray) -> Measured:
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    sums = prefix_sums(data)
    n_words = np.diff(first)
    row_of_word = np.repeat(np.arange(rows), n_words)
    lead = (data & 0xC0) != 0x80
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    classes = np.bincount(row_of_byte * 16 + CLASS_OF[data], minlength=rows * 16).reshape(rows, 16)[:, : len(CLASSES)]

    # lines: cut at line ends and at the ends of rows
    breaks = np.flatnonzero(data == 10)
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    line_starts = np.concatenate([[0], line_ends[:-1] + (data[np.minimum(line_ends[:-1], max(len(data) - 1, 0))] == 10 if len(data) else 0)])
    # an end of a row that is not a line end starts the next row at the same byte; a last line end starts an empty line there
    line_starts = np.minimum(line_starts, line_ends)
    has_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    line_hash = range_hashes(sums, line_starts, line_ends)
    n_dup_lines = np.bincount(line_row[later_equals(line_hash, line_row)], minlength=rows) if len(line_row) else np.zeros(rows, np.int64)

    # words in five-word windows that occur at least twice in the row
    plain = range_hashes(sums, starts, ends)
    value, row = shingles(plain, first, 5)
    twice = repeated(value, row)
    windows = np.where(n_words >= 5, n_words - 4, (n_words > 0).astype(np.int64))
    at = np.arange(len(value)) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][row] if len(value) else np.zeros(0, np.int64)
    cover = np.zeros(len(starts) + 6, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    n_repeat = np.bincount(row_of_word[np.cumsum(cover)[: len(starts)] > 0], minlength=rows)

    # common words, without one closing mark, in lower case
    stops = np.where((ends - starts > 1) & ENDING[data[ends - 1]], ends - 1, ends) if len(ends) else ends
    place = lists.places(word_hashes(LOWER[data], starts, stops)) if len(starts) else np.zeros(0, np.int64)
    common = np.zeros((rows, len(LANGUAGES), SLOTS), np.int64)
    lang_of_word = lang[row_of_word]
    for k in range(len(LANGUAGES)):  # a row needs the list of its own language only
        own = lang_of_word == k
        if own.any():
            common[:, k] = np.bincount(row_of_word[own] * SLOTS + lists.slot[k][place[own]], minlength=rows * SLOTS).reshape(rows, SLOTS)
    return Measured(n_words, sum_by_row(lead & ~BLANK[data], offsets), sum_by_row(SYMBOL[data], offsets), n_dup_lines, n_repeat, sum_by_row(lead, offsets), classes, common)


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)
        return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0.0))


def language_numbers(column: pa.Array) -> np.ndarray:
    """Number of each row's language, -1 without a list."""
    known = {lang: k for k, lang in enumerate(LANGUAGES)}
    return np.array([known.get(v, -1) for v in column.to_pylist()], np.int64)


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language with a list the mean histograms (classes, common words) over all its documents that can serve.

    Sums are made in Spark; at most one row per listed language comes to the driver.
    """
    width = len(CLASSES) + SLOTS

    def run(batches):
        lists = CommonWords()
        sums, counts = np.zeros((len(LANGUAGES), width)), np.zeros(len(LANGUAGES), np.int64)
        for batch in slices(batches):
            lang = language_numbers(batch.column(1))
            m = measure(*text_bytes(batch), lists, lang)
            good = (lang >= 0) & m.serves(limits)
            for k in range(len(LANGUAGES)):
                own = good & (lang == k)
                sums[k] += np.concatenate([shares(m.classes[own]).sum(axis=0), shares(m.common[own, k]).sum(axis=0)])
                counts[k] += own.sum()
        yield pa.RecordBatch.from_pydict({"lang": list(LANGUAGES), "n": counts, "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    parts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, n bigint, sums array<double>")
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = {}
    for row in totals.collect():  # one row per listed language
        if row["n"]:
            mean = np.round(np.array(row[2:]) / row["n"], 9)
            out[row["lang"]] = (mean[: len(CLASSES)], mean[len(CLASSES) :])
    return out


def distances(m: Measured, lang: np.ndarray, refs) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each row to its own language; NaN without a reference."""
    by_class, by_word = np.full(len(lang), np.nan), np.full(len(lang), np.nan)
    for k, name in enumerate(LANGUAGES):
        own = lang == k
        if name in refs and own.any():
            by_class[own] = divergence(shares(m.classes[own]), refs[name][0])
            by_word[own] = divergence(shares(m.common[own, k]), refs[name][1])
    return by_class, by_word


def judge(m: Measured, lang: np.ndarray, refs, limits: Limits) -> tuple[np.ndarray, ...]:
    """base_failed, class distance, word distance (NaN where too short or without a reference), kept."""
    by_class, by_word = distances(m, lang, refs)
    by_class = np.where(m.n_chars >= limits.min_chars, by_class, np.nan)
    by_word = np.where(m.n_words >= limits.min_words, by_word, np.nan)
    far = lambda d, limit, slack, n: np.nan_to_num(d, nan=0.0) > limit + slack / np.sqrt(np.maximum(n, 1))
    failed = m.base_failed(limits)
    rejected = far(by_class, limits.class_distance, limits.class_slack, m.n_chars) | far(by_word, limits.word_distance, limits.word_slack, m.n_words)
    return failed, by_class, by_word, ~failed & ~rejected


def scores(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: base counts, both distances (null where guarded) and the verdict ``kept``."""
    refs = references(docs, limits)

    def run(batches):
        lists = CommonWords()
        for batch in slices(batches):
            lang = language_numbers(batch.column(2))
            m = measure(*text_bytes(batch), lists, lang)
            failed, by_class, by_word, kept = judge(m, lang, refs, limits)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": m.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.n_dup_lines,
                "n_repeat_words": m.n_repeat_words, "base_failed": failed, "kept": kept,
                "class_distance": pa.array(by_class, from_pandas=True), "word_distance": pa.array(by_word, from_pandas=True)})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
        "class_distance double, word_distance double")


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with all their columns."""
    refs = references(docs, limits)
    lang_at = docs.columns.index("lang")

    def run(batches):
        lists = CommonWords()
        for batch in slices(batches):
            lang = language_numbers(batch.column(lang_at))
            m = measure(*text_bytes(batch), lists, lang)
            *_, kept = judge(m, lang, refs, limits)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


@query("op1_quality")
def op1(spark, folder):
    return scores(table(spark, folder, "documents"))
