"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(folder: str, name: str, columns: str = "*") -> list[tuple]:
    return duckdb.connect().sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def _either(s):
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in s)


ASSIGN = re.compile("(" + "|".join(_either(k) for k in ("password", "passwd", "secret", "token", "api_key", "apikey")) + r""")["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def secrets_base(text):
    text = text or ""
    kinds = [
        ("assign", [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]),
        ("access", [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]),
        ("hex", [m.span() for m in HEX.finditer(text) if len(m[0]) >= 24])]
    spans = sorted((a, k, b) for k, (_, found) in enumerate(kinds) for a, b in found)
    joined = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
    return *(len(f) for _, f in kinds), sha(joined)


def mixing_targets(sizes: dict) -> dict:
    """Excess over three times a source's size is shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**{s: Fraction(3 * v, 1) if s in capped else Fraction(0) for s, v in sizes.items()}, **capped, **share}
        capped.update({s: Fraction(3 * sizes[s]) for s in over})


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    won = [0] * len(votes)
    for _ in range(seats if any(v > 0 for v in votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def shingle_set(text, width=3):
    w = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_dup(docs: list[tuple], width=3, percent=85) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingle_set(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs)]
