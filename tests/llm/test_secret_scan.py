"""Secret scans against every rule tried on every text."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter

import pytest

pytest.importorskip("recordloom.llm")

from recordloom.llm import secret_scan as ss

SCHEMA = "key_a string, doc_id long, text string, spans string, kinds string"


def brute(text):
    out = []
    for rank, r in enumerate(ss.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def samples(rng):
    word, low, hexes = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef"
    take = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return [
        f'Password: "{take(word, 12)}"', f"API_KEY={take(word, 5)}", f"apikey = '{take(word, 30)}'", "SECRET:=abcdefg", "token=token=abc.def",
        f"AKIA{take(string.ascii_uppercase, 16)}", "AKIA123", f"xAKIAAKIA{take(string.ascii_uppercase, 30)}", take(hexes, 24), take(hexes, 23), take(hexes, 300),
        f"gh{rng.choice('pousr')}_{take(word, 36)}", f"xoxb-{take(low, 20)}", f"sk_live_{take(word, 24)}", f"rk_test_{take(word, 16)}",
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----", f"eyJ{take(word, 12)}.eyJ{take(word, 12)}.{take(word, 12)}",
        f"https://bob:{take(word, 8)}@example.com/x", f"Postgres://u:p@db.example.com", f"AIza{take(word, 35)}", f"glpat-{take(word, 20)}",
        f"123456789:AA{take(word, 33)}", f"SK{take(hexes, 32)}", f"Authorization: Bearer {take(word, 20)}", f"npm_{take(word, 36)}", f"shpat_{take(hexes, 32)}",
    ]


def rows():
    rng = random.Random(4)
    data, n = [], 0
    for _ in range(6):
        for s in samples(rng):
            around = ["".join(rng.choice("aé ü\n😀the secret is.ab cdef") for _ in range(rng.randint(0, 30))) for _ in range(3)]
            data.append((n, f" {s} ".join(around)))
            n += 1
    data += [(n, None), (n + 1, ""), (None, "token = abcdef1"), (None, None), (n + 2, "x" * 50_000 + " password=" + "y" * 40_000 + " a" * 9000)]
    return data + data[:3] + [(1000 + i, "the same password=abcdef123") for i in range(40)]


def test_spans_match_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame([("a", i, t, "s", "k") for i, t in data], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in ss.op12_secret_scan(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in data:
        spans = brute(t)
        base = [s for s in spans if s.split(":")[0] in ss.BASE]
        counts = Counter(s.split(":")[0] for s in spans)
        want[i, *(counts[k] for k in ss.BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)] += 1
    assert got == want
    kinds = {s.split(":")[0] for _, t in data for s in brute(t)}
    assert len(kinds) >= 16


def test_queries_are_mandatory_and_selective():
    assert ss.trigram_query(r"[0-9a-f]+") == [frozenset()]
    assert ss.trigram_query(r"\b(?:SK|AC)[0-9a-f]{32}\b") == [frozenset()]
    assert ss.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert frozenset({"api", "pi_", "i_k", "_ke", "key"}) in ss.trigram_query(ss.RULES[0].pattern)
    assert ss.trigram_query("ab(c|d)e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]
    assert ss.trigram_query("(abc|x+)") == [frozenset()] and ss.trigram_query("(abc)*def") == [frozenset({"def"})]
    rng = random.Random(7)
    for s in samples(rng):
        for r in ss.RULES:
            for m in re.finditer(r.pattern, s, re.ASCII):
                assert any(a <= ss.trigrams(m[0].lower()) for a in ss.trigram_query(r.pattern)), (r, m[0])
    assert sum(frozenset() in ss.trigram_query(r.pattern) for r in ss.RULES) < 6


def test_empty_tables(spark):
    assert ss.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
