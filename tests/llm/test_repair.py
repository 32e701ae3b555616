import hashlib
import itertools
import random
import re
import zlib

import pytest
from brute import rows

from tidegauge.llm import repair
from tidegauge.llm.queries import QUERIES
from tidegauge.llm.registry import importable

SOUND = re.compile(r"(s?(ua)+)?\Z")


def cheapest(found: list[tuple[str, str]]) -> tuple[int, str, list]:
    """Least (cost, audit, roles) over edit sequences, row by row from the left; rows are (initial, fault)."""
    state = {0: (0, "", ())}
    steps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}

    def better(table, place, value):
        if place not in table or value[:2] < table[place][:2]:
            table[place] = value

    def insert(table):
        for _ in range(4):
            for place, (cost, audit, roles) in list(table.items()):
                for r in "ua":
                    if (r, place) in steps:
                        better(table, steps[r, place], (cost + 2, audit + "I", (*roles, "I" + r)))

    insert(state)
    for initial, fault in found:
        new: dict = {}
        for place, (cost, audit, roles) in state.items():
            better(new, place, (cost + 3, audit + "D", (*roles, "D")))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for r in "sua":
                    if (r, place) in steps and (r == initial or r != "s"):
                        edit, price = ("K", 0) if r == initial else ("R", 2)
                        better(new, steps[r, place], (cost + price + extra, audit + edit, (*roles, edit + r)))
        insert(new)
        state = new
    return min(state[p] for p in (0, 3) if p in state)


def plain(conversations: list[tuple]) -> list[tuple]:
    """The contract in plain Python; conversations: (conv_id, turn, role, text)."""
    out = []
    for conv in {c for c, *_ in conversations}:
        kept = []
        for c, turn, role, text in conversations:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            row = [turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text]
            kept += [] if kind == 0 else [row, list(row)] if kind == 3 else [row]
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, found = set(), []
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            found.append((role[:1], "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
            seen.add((role, text))
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(found))
        cost, audit, edits = cheapest(found)
        left, lines = iter(kept), []
        for e in edits:
            if e[0] == "I":
                lines.append({"u": "user:", "a": "assistant:"}[e[1]])
                continue
            _, role, text = next(left)
            if e[0] != "D":
                lines.append(f"{role if e[0] == 'K' else {'u': 'user', 'a': 'assistant'}[e[1]]}:{text}")
        counts = [sum(f == name for _, f in found) for name in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_plain_python(spark, folder):
    assert got(QUERIES["op13_repair"](spark, folder)) == plain(rows(folder, "conversations", "conv_id, turn, role, text"))


def test_grammar_against_all_edit_sequences():
    """Every sequence of edits up to a cost, for all short rows."""
    def tries(symbols, budget, place=0, cost=0, audit=""):
        if cost > budget:
            return
        if not symbols and place in (0, 3):
            yield cost, audit
        for (role, at), to in repair.STEPS.items():
            if at == place and role != "s":
                yield from tries(symbols, budget, to, cost + 2, audit + "I")
        if symbols:
            first, rest = symbols[0], symbols[1:]
            yield from tries(rest, budget, place, cost + 3, audit + "D")
            for (role, at), to in repair.STEPS.items():
                if at == place and first != "D" and (role == first.lower() or role != "s"):
                    same = role == first.lower()
                    yield from tries(rest, budget, to, cost + (0 if same else 2) + first.isupper(), audit + ("K" if same else "R"))

    for n in range(5):
        for symbols in itertools.product("suaxDUA" if n < 4 else "suaD", repeat=n):
            cell = repair.parse("".join(symbols))
            best = min(cell[e] for e in repair.ENDS if e in cell)
            assert best == min(tries("".join(symbols), best[0])), symbols


def test_every_split_gives_the_same_cell():
    rng = random.Random(5)
    for _ in range(60):
        symbols = "".join(rng.choice("suaxDSUAX") for _ in range(rng.randint(2, 30)))
        whole = repair.parse(symbols)
        for cut in range(1, len(symbols)):
            assert repair.join(repair.parse(symbols[:cut]), repair.parse(symbols[cut:])) == whole
        best = min(whole[e] for e in repair.ENDS if e in whole)
        faults = [(s.lower(), "truncated" if s.isupper() else "") if s != "D" else ("u", "blank") for s in symbols]
        assert best == cheapest(faults)[:2]


def table(spark, found):
    importable(spark)
    df = spark.createDataFrame(found, "conv_id bigint, turn bigint, role string, text string")
    return df.selectExpr("*", "1 AS at", "'x' AS audit", "0 AS cost", "'y' AS kind", "2 AS part", "3 AS h1", "4 AS col")


def run(spark, found):
    df = table(spark, found)
    placed = repair.placed(repair.damage(df))
    heads = repair.parsed(df, placed)
    return got(repair.digests(placed, heads)), repair.repaired(placed, heads), heads


def odd_rows(seed: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for conv in [*range(25), None]:
        for _ in range(rng.choice([1, 1, 2, 5, 9, 30])):
            out.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", "User", None]), rng.choice([None, "", " \n", "So.", "Who?\t", "no end", "É!", "long " * 400 + "."])))
    return [*out, *out[:9], out[0], out[0]]


def test_odd_tables(spark):
    found = odd_rows(2)
    result, turns, _ = run(spark, found)
    assert result == plain(found)
    made: dict = {}
    for r in turns.orderBy("conv_id", "place").collect():
        made.setdefault(r["conv_id"], []).append(r["role"][0])
    assert all(SOUND.match("".join(x)) for x in made.values())
    assert run(spark, [])[0] == []


def test_conversation_over_many_tasks(spark):
    """A third of all rows in one conversation, most of them the same text."""
    rng = random.Random(8)
    hot = [(7, i // 2 if i % 5 else i, rng.choice(["user", "assistant"]), rng.choice(["Same text.", f"Text {i}.", f"cut {i}"])) for i in range(900)]
    found = hot + [(100 + i % 300, i // 300, ["user", "assistant"][i // 300 % 2], f"t{i}.") for i in range(1800)]
    assert run(spark, found)[0] == plain(found)


def test_all_rows_dropped(spark):
    dropped = [(c, t, "user", "x.") for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    result = run(spark, dropped)[0]
    assert len(result) == len({c for c, *_ in dropped}) and all(r[1:8] == (0, 0, 0, 0, 0, 0, "") and r[8] == hashlib.sha256(b"").hexdigest() for r in result)
