"""Structure repair against a brute-force search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("recordloom.llm")

from recordloom.llm import structure_repair as sr

SCHEMA = "turn long, text string, conv_id long, audit string, role string, key_a string, conv string"


def cheapest(rows):
    """Least (cost, audit) and the repaired turns, by uniform-cost search over (role initials so far, row). rows: (role, text, must go, cut)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, tail, made = heapq.heappop(heap)
        if i == len(rows) and tail in ("", "a"):
            return cost, audit, list(made)
        if (i, tail) in done:
            continue
        done.add((i, tail))

        def go(extra, letter, j, turn):
            follows = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
            if turn is None:
                heapq.heappush(heap, (cost + extra, audit + letter, j, tail, made))
            elif turn[0][:1] and turn[0][:1] in follows:
                heapq.heappush(heap, (cost + extra, audit + letter, j, turn[0][:1], (*made, turn)))

        for r in ("user", "assistant"):
            go(3, "I", i, (r, ""))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            go(4, "D", i + 1, None)
            if not gone:
                go(3 * cut, "K", i + 1, (role, text))
                for r in ("user", "assistant"):
                    go(3 + 3 * cut, "R", i + 1, (r, text))
    raise AssertionError


def brute(table):
    """The contract, row by row. table: (conv_id, turn, role, text) without ties of different texts."""
    out = {c: [] for c, *_ in table}
    for c, t, role, text in table:
        show = [" " if x is None else str(x) for x in (c, t, role, text)]
        kind = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2], show[3]
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    res = {}
    for c, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            blank, again = not text.strip(" \t\n\x0b\f\r"), (role, text) in seen
            cut = not blank and text.rstrip(" \t\n\x0b\f\r")[-1] not in ".!?"
            seen.add((role, text))
            if blank or again or cut:
                counts[0 if blank else 1 if again else 2] += 1
            faults.append((role, text, blank or again, cut))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, made = cheapest(faults)
        res[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest())
    return res


def make(seed, n=160):
    rng = random.Random(seed)
    table = []
    for c in [*range(n), None]:
        turns = rng.sample(range(14), rng.randint(1, 12)) + ([None] if rng.random() < 0.2 else [])
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ugo", "uber"])
            text = rng.choice(["yes.", "no!", "what? \n", "open end", "", " \t", None, "é.", "a" * 3 + ".", f"{c} {t}."])
            table.append((c, t, role, text))
    table += [(900, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(40)]
    table += [(901, 5, "user", "the same.")] * 3 + [(2**53 + 1, 2**53 + 3, "user", "far.")]
    return table


def test_audits_match_brute_force(spark, tmp_path):
    table = make(3)
    df = spark.createDataFrame([(t, x, c, "z", r, "k", "q") for c, t, r, x in table], SCHEMA).repartition(4)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    want = brute(table)
    got = {r.conv_id: tuple(r)[1:] for r in sr.op13_structure_repair(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, [r for r in table if r[0] == c])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5])
def test_every_short_symbol_string(n):
    roles = ["user", "assistant", "system", "other"]
    for symbols in itertools.product(range(sr.SYMBOLS), repeat=n) if n < 4 else random.Random(n).sample(list(itertools.product(range(sr.SYMBOLS), repeat=n)), 3000):
        rows = [(roles[(x - 1) // 2], "t", False, (x - 1) % 2) if x else ("user", "t", True, 0) for x in symbols]
        cost, audit, _ = cheapest(rows)
        assert sr.audit(bytes(symbols)) == (audit, cost)


def test_long_conversations_and_empty_tables(spark):
    rng = random.Random(1)
    symbols = bytes(rng.randrange(sr.SYMBOLS) for _ in range(20_003))
    edits, cost = sr.audit(symbols)
    prices = {"D": 4, "I": 3, "K": 0, "R": 3}
    rows = [x for x in edits if x != "I"]
    assert len(rows) == len(symbols)
    assert cost == sum(prices[x] for x in edits) + sum(3 for x, s in zip(rows, symbols) if x in "KR" and s and (s - 1) % 2)
    plans, repaired = sr.repair(sr.damage(spark.createDataFrame([], SCHEMA)))
    assert plans.count() == repaired.count() == 0
