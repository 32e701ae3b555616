"""Secrets in whole texts, by a trigram inverted index over blocks of rows.

Each rule's regular expression is parsed once into a Boolean query over trigrams that any match must contain (letters folded
to lower case). For every block of rows an inverted index of the trigrams that occur in some query is built: trigram ->
ascending row numbers. Intersecting and uniting postings gives a rule's candidate rows, and only those are searched with the
expression. A rule without mandatory trigrams searches every row. Blocks are independent, so nothing is shuffled.

A private key is its header line, its body and its END line, so that nothing of the secret is left when the span is replaced.

Matches are the leftmost non-overlapping ones of a rule; matches that fail the rule's condition are dropped after matching.
Spans count code points, end exclusive.

Defined results: a null or empty text has no spans; rows repeat if they repeat; a null doc_id stays null; an empty table
gives an empty table; other columns are never read by ``find_secrets``, and kept as they are by ``redact``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER, slices, table, text_bytes
from tidegauge.llm.registry import query


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: the group whose length counts
    least: int = 1  #: shorter matches are dropped
    base: bool = False
    scan: str | None = None  #: an expression with just the matches that are kept, quicker to search


KEYWORDS = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
#: What stands between the lines of a key: blanks, line ends (also written as \n), marks of quotes, comments and joined strings.
BETWEEN = r"""(?:\\[nrt]|[\s>#*|"',;\\]|\+(?=\s))"""
LABEL = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: Header, body and END line. Up to the next BEGIN or END mark everything is body; where that is no END line of a private key, the
#: body is what follows as armour headers and base64 lines, with a short last line and a checksum. A header alone counts too.
PRIVATE_KEY = rf"""-----BEGIN {LABEL}(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END {LABEL}\
|(?:{BETWEEN}*+[A-Za-z][A-Za-z0-9-]*+:\x20[^\n\\]*+)*+(?:{BETWEEN}++[A-Za-z0-9+/]{{16,}}+={{0,2}})++\
(?:{BETWEEN}++[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=\\[nr]|["']|[\x20\t\r]*(?:\n|\Z))))?(?:{BETWEEN}++=[A-Za-z0-9+/]{{4}})?)?""".replace("\\\n", "")
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True, r"[0-9a-f]{24,}"),  # both match maximal runs
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

# ---- trigram queries -------------------------------------------------------------------------------------------------
# A query is True (no condition), a trigram (three bytes), ("and", parts) or ("or", parts).

MANY = 64


def both(*parts):
    parts = tuple(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(parts):
    parts = tuple(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", parts)


def of_strings(strings) -> object:
    """What a text must contain to hold one of the strings."""
    folded = sorted({s.lower().encode() for s in strings})
    return either(both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in folded)


def alternatives(code, arg) -> set[str] | None:
    """All strings that an element can match, if they are few."""
    if code is op.LITERAL:
        return {chr(arg).lower()}
    if code is op.IN and arg[0][0] is not op.NEGATE:
        out = set()
        for kind, what in arg:
            if kind is op.LITERAL:
                out.add(chr(what).lower())
            elif kind is op.RANGE and what[1] - what[0] < 4:
                out.update(chr(c).lower() for c in range(what[0], what[1] + 1))
            else:
                return None
        return out
    if code is op.SUBPATTERN:
        return exact(arg[-1])
    if code is op.BRANCH:
        parts = [exact(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] is not op.MAXREPEAT and arg[1] <= 4:
        once = exact(arg[2])
        if once is None or len(once) ** arg[1] > MANY:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)}
    return {""} if code is op.AT else None


def exact(sequence) -> set[str] | None:
    out = {""}
    for code, arg in sequence:
        some = alternatives(code, arg)
        if some is None or len(out) * len(some) > MANY:
            return None
        out = {a + b for a in out for b in some}
    return out


def required(sequence) -> object:
    """The query of a sequence: runs of elements with few alternatives, and what the other elements require."""
    found, run = [], {""}
    for code, arg in sequence:
        some = alternatives(code, arg)
        if some is not None and len(run) * len(some) <= MANY:
            run = {a + b for a in run for b in some}
            continue
        found.append(of_strings(run))
        run = {""} if some is None or len(some) > MANY else some
        if some is None:
            if code is op.SUBPATTERN:
                found.append(required(arg[-1]))
            elif code is op.BRANCH:
                found.append(either(required(p) for p in arg[1]))
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                found.append(required(arg[2]))
    return both(*found, of_strings(run))


def trigram_query(pattern: str) -> object:
    return required(parser.parse(pattern))


def trigrams_of(q) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*map(trigrams_of, q[1]))


class Index:
    """Postings of chosen trigrams over a block of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, place: np.ndarray, trigrams: list[bytes]):
        low = LOWER[data]
        self.rows = len(offsets) - 1
        self.postings = {t: np.zeros(0, np.int64) for t in trigrams}
        if len(low) < 3:
            return
        code = (low[:-2].astype(np.int32) << 16) | (low[1:-1].astype(np.int32) << 8) | low[2:]
        which = place[code]
        at = np.flatnonzero(which)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[row + 1]
        pairs = np.unique((which[at[inside]].astype(np.int64) - 1) * self.rows + row[inside])
        cuts = np.searchsorted(pairs, np.arange(len(trigrams) + 1) * self.rows)
        for i, t in enumerate(trigrams):
            self.postings[t] = pairs[cuts[i] : cuts[i + 1]] - i * self.rows

    def candidates(self, q) -> np.ndarray:
        if q is True:
            return np.arange(self.rows)
        if isinstance(q, bytes):
            return self.postings[q]
        parts = [self.candidates(p) for p in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    place = np.zeros(1 << 24, np.int16)
    for i, t in enumerate(trigrams):
        place[int.from_bytes(t, "big")] = i + 1
    return queries, trigrams, place, [re.compile(r.scan or r.pattern) for r in rules]


def spans_of(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    out = []
    for m in expression.finditer(text):
        a, b = m.span(rule.group)
        if b - a >= rule.least:
            out.append(m.span())
    return out


def scan_block(batch: pa.RecordBatch, rules: tuple[Rule, ...], name: str = "text") -> list[list[tuple[int, int, int]]]:
    """For each row the spans (start, rule number, end), by start and then in the order of the rules."""
    queries, trigrams, place, expressions = compiled(rules)
    data, offsets = text_bytes(batch, name)
    index = Index(data, offsets, place, trigrams)
    texts = batch.column(batch.schema.get_field_index(name)).to_pylist()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        for i in index.candidates(queries[k]):
            if texts[i]:
                found[i] += [(a, k, b) for a, b in spans_of(rule, expressions[k], texts[i])]
    for spans in found:
        spans.sort()
    return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and all spans of each row: array of (kind, start, end)."""

    def run(batches):
        for batch in slices(batches):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in scan_block(batch, rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, secrets array<struct<kind:string,start:int,end:int>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """The same rows and columns; every span in ``text`` is replaced by a mark, ``n_chars`` is counted anew.

    Overlapping spans become one mark, named by the first.
    """
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(names.index("text")).to_pylist()
            for i, spans in enumerate(scan_block(batch, rules)):
                if not spans:
                    continue
                out, at = [], 0
                for a, k, b in spans:
                    if a >= at:
                        out += [texts[i][at:a], mark.format(kind=rules[k].kind)]
                    at = max(at, b)
                texts[i] = "".join([*out, texts[i][at:]])
            columns = [batch.column(j) for j in range(len(names))]
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


@query("op2_secret_scan")
def op2(spark, folder):
    spans = find_secrets(table(spark, folder, "documents"))
    base = [r.kind for r in RULES if r.base]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return spans.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
