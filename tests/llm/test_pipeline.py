"""The whole corpus pipeline against brute force, stage by stage in plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

pytest.importorskip("recordloom.llm")

import regex
import xxhash

import corpus_pipeline
from recordloom.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long"


def prose(rng, n, line=9):
    words = ["".join(rng.choice(["an", "the", "re", "on", "st", "ou", "ly", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + line]) for i in range(0, n, line))


def quality(docs):
    def plain(line):
        return re.sub("[ \t\x0b-\r]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")

    per_host, holders = defaultdict(set), defaultdict(set)
    for _, t, host in docs:
        per_host[host].add(t)
        for x in t.split("\n"):
            holders[host, plain(x)].add(t)
    out = []
    for i, t, host in docs:
        words = t.split()
        wins = defaultdict(list)
        for p in range(len(words) - 4):
            wins[tuple(words[p:p + 5])].append(p)
        repeat = len({q for ps in wins.values() if len(ps) > 1 for p in ps for q in range(p, p + 5)})
        if len(words) < 10 or 100 * repeat > 20 * len(words):
            continue
        n = {k: len(holders[host, plain(x)]) for k, x in enumerate(t.split("\n")) if plain(x)}
        gone = {k for k, m in n.items() if m >= 10 and m > 0.05 * len(per_host[host])}
        lost = sum(len(x.split()) for k, x in enumerate(t.split("\n")) if k in gone)
        if lost and (len(words) - lost < 10 or lost > 0.7 * len(words)):
            continue
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), host))
    return out


def lines(docs):
    seen, out = set(), []
    for i, t, host in sorted(docs):
        ls, gone = t.split("\n"), set()
        for s in range(len(ls)):
            runs = [tuple(ls[s:e]) for e in range(s + 1, len(ls) + 1)]
            for r in runs:
                if r in seen and len(r) >= 2 and sum(len(x.split()) for x in r) >= 20:
                    gone |= set(range(s, s + len(r)))
            seen.update(runs)
        out.append((i, "\n".join(x for n, x in enumerate(ls) if n not in gone), host))
    return out


def near_duplicates(docs):
    def fingerprint(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [])
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps, root = [fingerprint(t) for _, t, _ in docs], list(range(len(docs)))  # docs are sorted: the least index has the least id
    for _ in docs:
        for a in range(len(docs)):
            for b in range(len(docs)):
                if bin(fps[a] ^ fps[b]).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in range(len(docs))):
            break
    return [d for k, d in enumerate(docs) if root[k] == k]


def decontamination(docs, items):
    def shingles(t):
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    asked = [q for q in map(shingles, items) if q]
    return [d for d in docs if not any(len(q & shingles(d[1])) >= 0.8 * len(q) for q in asked)]


def table():
    rng = random.Random(31)
    texts = [prose(rng, rng.choice([12, 40, 120, 300])) + "\nRead 2024 more HERE" for _ in range(30)]
    shared = prose(rng, 60)
    texts += [texts[3], texts[5] + " more", texts[7] + "\n" + shared, shared + "\n" + texts[8], "", None, " \n ", "one", "a a a a " * 60, texts[2] * 30]
    texts += [prose(rng, 300).replace("an", "é", 1), texts[11].rsplit("\n", 1)[0] + "\nlast word", "Read 1999 more  here\n" * 4 + prose(rng, 11)]
    return [(i, t, "en" if i % 2 else None, None if i % 5 == 4 else "h", 0, 1) for i, t in enumerate(texts)]


def test_run_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    data = table()
    items = [" ".join(data[10][1].split()[2:30]), "", "nowhere to be found at all in these texts"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [(i, t or "", host) for i, t, _, host, *_ in data]
    counts = [len(docs)]
    for stage in (quality, lines, near_duplicates):
        docs = stage(docs)
        counts.append(len(docs))
    docs = decontamination(docs, items)
    counts.append(len(docs))
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 20  # every deciding stage has work
    full = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: full.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t, _ in docs}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append((r.start, list(r.ids)))
    assert pieces.keys() == want.keys()
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == want


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
