"""The prefix trie against brute force over rebuilt conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("recordloom.llm")

from recordloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, depth string, turn long, text string, words string, role string, key_a string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(table):
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    rebuilt = {}
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].split()) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         sha(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))))
        for p, m in members.items()
    )


def make(seed):
    rng = random.Random(seed)
    table = []
    for c in [x for x in range(0, 230) if x % 20 or x % 40]:
        first = rng.choice(["a b", "a b", "c", None, "  "])
        for t in range(rng.randint(1, 6)):
            table.append((c, t if rng.random() < 0.95 or t else None, rng.choice(["user", "user", None, ""]), first if t == 0 else rng.choice(["x", "y z", "", "u v w"])))
    table += [(400, t, "user", f"{t % 3} word") for t in range(300)] + [(407, t, "user", f"{t % 3} word") for t in range(250)]
    table += [(2**53 + 1 - (2**53 + 1) % 20 + 7, 0, "user", "far"), (None, 0, "user", "nowhere"), (500, 3, "a", "same"), (500, 3, "a", "same")]
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_match_brute_force(spark, seed):
    table = make(seed)
    df = spark.createDataFrame([(c, "z", t, x, "w", r, "k") for c, t, r, x in table], SCHEMA).repartition(5)
    got = pt.prefix_trie(df)
    have = Counter(tuple(r)[:8] for r in got.collect())
    assert have == brute(table)


def test_references_name_the_last_turn(spark):
    table = [r for r in make(3) if r[0] is not None]
    df = spark.createDataFrame([(c, "z", t, x, "w", r, "k") for c, t, r, x in table], SCHEMA)
    own = defaultdict(list)
    for c, t, role, text in sorted(table, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    for r in pt.prefix_trie(df).collect():
        if r.depth:
            c, h = r.conv_id, zlib.crc32(str(r.conv_id).encode()) % 4
            turns = own.get(c - c % 20, [])[:h] + own[c][h:]
            assert own[r.turn_conv][r.turn_place - 1] == turns[r.depth - 1]
        else:
            assert r.turn_conv is None


def test_long_id_lists_and_products(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 3)
    rows = [(20 * i, "z", 0, "same", "w", "user", "k") for i in range(50)]
    got = {r.depth: r for r in pt.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_convs == 50 and got[1].ends_sha256 == sha(",".join(str(20 * i) for i in range(50)))
    base = pt.BASES[0]
    a, b, c = 5, 7, 11
    assert pt.product(pt.product(a, b, 1, base), c, 1, base) == pt.product(a, pt.product(b, c, 1, base), 2, base)


def test_empty_and_idless_tables(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.prefix_trie(spark.createDataFrame([(None, "z", 0, "t", "w", "r", "k")], SCHEMA)).count() == 0
