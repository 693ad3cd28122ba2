"""The llm operators against brute force, on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("recordloom.llm")

import corpus_pipeline
from recordloom.llm import (
    components,
    decontaminate,
    language_id,
    license_scan,
    line_runs,
    packing,
    passages,
    pii,
    quality_rules,
    simhash,
    suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, key_a string"


def prose(rng, n, line=9):
    out = []
    for i in range(n):
        out.append("".join(rng.choice(["an", "the", "re", "on", "st", "ou", "ly", "er"]) for _ in range(rng.randint(1, 4))))
        if i % line == line - 1:
            out[-1] += ".\n"
    return " ".join(out)


def rows(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([12, 40, 120, 300])) for _ in range(24)]
    shared = prose(rng, 60)
    texts = base + [base[3], base[3], base[5][:-3] + "xx", base[7] + "\n" + shared, shared + "\n" + base[8], "", None, " \n ", "one", "a a a a " * 60]
    texts.append(base[2] * 40)
    out = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 4 else f"s{i % 2}", 0, 1, "x", "y") for i, t in enumerate(texts)]
    return out + [out[3], (None, base[9], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts_match_brute_force(docs):
    got = Counter(tuple(r) for r in quality_rules.verdicts(docs).select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, t, *_ in rows():
        words = (t or "").split()
        win = defaultdict(list)
        for p in range(len(words) - 4):
            win[tuple(words[p:p + 5])].append(p)
        repeat = len({q for ps in win.values() if len(ps) > 1 for p in ps for q in range(p, p + 5)})
        lines = [x for x in (t or "").split("\n") if x.split()]
        want[i, len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeat, len(words) < 10 or 100 * repeat > 20 * len(words)] += 1
    assert got == want


def test_quality_removes_host_boilerplate_but_not_copies(spark):
    rng = random.Random(1)
    data = [(i, prose(rng, 30, 99) + "\nClick HERE 2024 to subscribe", "h") for i in range(30)]
    data += [(100 + i, "the same text " * 5 + "\nof a page\nwith lines of its own", "h") for i in range(15)]
    data += [(200 + i, "Click here 1999 to  subscribe\n" * 9, "h") for i in range(2)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality_rules.clean_documents(df).collect()}
    assert all("subscribe" not in kept[i] and kept[i] == data[i][1].rsplit("\n", 1)[0] for i in range(30))
    v = {r.doc_id: r for r in quality_rules.verdicts(df).collect()}
    assert not v[200].kept and v[200].n_removed_lines == 9
    assert all(v[100 + i].n_removed_lines == 0 for i in range(15))


def test_packing_holds_every_id_once_without_padding(docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, packing.default_tokenizer()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows():
        want = full.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        have = [x for _, ids in sorted(pieces[i], key=lambda p: p[0]) for x in ids]
        assert have == want or have[::1] and i == 3 and sorted(have) == sorted(want * 2)
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)


def test_encoder_equals_the_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.Encoder(packing.default_tokenizer())
    for t in ("It's  A\ttest's don't we'LL 12345 (x)!?", "Éa Über ß ÿ À ñandú", "Σας ΟΔΟΣ ½ ² naïve x", "日本 語", "é x", "", "a" * 5000, "<|endoftext|> x",
              "hello <|endoftext|> world <|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <| x", "word <|endoftext|> é " * 30_000, "x y " * 100_000 + "ñ"):
        assert enc.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("run", [
    lambda df: packing.pack(df, packing.default_tokenizer()).select("doc_id"), lambda df: pii.find_personal_data(df).select("doc_id"),
])
def test_large_ids_beside_null_ids(spark, run):
    df = spark.createDataFrame([(2**53 + 1, "a b"), (None, "c"), (-7, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in run(df).collect()} == {2**53 + 1, None, -7}


def test_assign_prefers_the_cheapest_sequence():
    places = packing.assign([3000, 3000, 1000, 500], [4096, 4096])
    assert places[0][3] != places[1][3] and {p[0] for p in places} == {0, 1, 2, 3}
    assert sum(p[2] for p in places) == 7500


@pytest.mark.parametrize("text, kind, found", [
    ("write to john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
    ("mail jane at mail dot example dot org ok", "email", "jane at mail dot example dot org"),
    ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
    ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
    ("host one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
])
def test_disguises_are_mapped_back(text, kind, found):
    got = pii.added_spans(text, pii.detect(text))
    assert [text[s:e] for s, e in got[kind]] == [found]


@pytest.mark.parametrize("text, kind, base, added", [
    ("паul@example.com", "email", ["ul@example.com"], ["аul@example.com"]),  # the first letter is no homoglyph
    ("pаul@example.com ok", "email", ["ul@example.com"], ["pаul@example.com"]),
    ("paul@mail.exаmple.com", "email", ["paul@mail.ex"], ["paul@mail.exаmple.com"]),
    ("+1 202 555 01 two three now", "phone", ["+1 202 555 01"], ["+1 202 555 01 two three"]),
    ("paul@example.com and mаx", "email", ["paul@example.com"], []),
])
def test_longer_finds_stay_beside_the_base_spans(text, kind, base, added):
    found = pii.detect(text)
    got = pii.added_spans(text, found)
    assert [text[s:e] for s, e in found[kind]] == base
    assert [text[s:e] for s, e in got[kind]] == added


@pytest.mark.parametrize("text", [
    "visit us at example.com today", "Find more at www.example.org now", "She works at Acme.Inc as a clerk", "We start at 10.Both of us came",
    "the house at 12.5 percent. And dot com", "look at page one. two dots", "version 1 . 2 . 3 is out", "meet at noon dot",
])
def test_prose_is_left_alone(text):
    assert not any(pii.added_spans(text, pii.detect(text)).values())


@pytest.mark.parametrize("text, kind, found", [
    ("mail jane at example dot com ok", "email", "jane at example dot com"),
    ("see 192 . 168 . 1 . 1 there", "ip", "192 . 168 . 1 . 1"),
    ("a.b.c.d.e.f.g (at) mail.of.the.firm.example (dot) org!", "email", "a.b.c.d.e.f.g (at) mail.of.the.firm.example (dot) org"),
])
def test_longer_disguises(text, kind, found):
    assert [text[s:e] for s, e in pii.added_spans(text, pii.detect(text))[kind]] == [found]


def test_base_spans_match_the_contract_on_random_strings():
    import re

    def brute(t):
        out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
        out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out["card"], out["phone"] = [], []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
                out["card"].append(m.span())
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
        return out

    rng = random.Random(12)
    found = Counter()
    for alphabet in ("a@.b-", "0123.", "12 -4", "+1 ().-2", "a@.1+ -é", "0123456789 -"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            want = brute(t)
            assert pii.detect(t) == want, t
            found.update({k: len(v) for k, v in want.items()})
    assert all(found[k] > 5 for k in pii.KINDS), found


def test_registered_query_adds_spans(spark, tmp_path):
    data = [(1, "write to john (at) example [dot] com or a@b.co"), (2, "clean text"), (None, None)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op3_personal_data(spark, str(tmp_path)).collect()}
    assert got[1].n_email == 1 and got[1].spans == "email:9:36,email:40:46" and got[1].n_added == 1
    assert got[1].base_sha256 == hashlib.sha256(b"email:40:46").hexdigest() and got[2].spans == got[None].spans == ""


def test_base_identifiers_and_clean_text():
    text = "a@b.co 10.0.0.256 1.2.3.4 4111 1111 1111 1111 +49 (151) 123-4567 x@y"
    base = pii.detect(text)
    assert [text[s:e] for s, e in base["email"]] == ["a@b.co"]
    assert [text[s:e] for s, e in base["ip"]] == ["1.2.3.4"]
    assert [text[s:e] for s, e in base["phone"]] == ["+49 (151) 123-4567"]
    assert not any(pii.added_spans("look at the house. And dot com. " + prose(random.Random(2), 200), {k: [] for k in pii.KINDS}).values())
    assert pii.detect("4111-1111-1111-1111")["card"] == [(0, 19)]
    pii.detect("1" * 200_000 + "." * 1000 + "a" * 200_000)  # linear time


def test_license_suppression_and_places(spark):
    df = spark.createDataFrame([
        (1, "Licensed under the Apache License, Version 2.0. CC-BY cc by 4.0! All rights reserved"), (2, None), (None, ""),
        (3, "x GNU General Public License v3 cc by cc by"),
    ], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [(d.s, d.e, d.label) for d in got[1].detections] == [(0, 8, "apache-2.0"), (8, 10, "cc-by"), (10, 14, "cc-by-4.0")]
    assert sorted((b.s, b.label) for b in got[3].base) == [(2, "gpl"), (6, "cc-by"), (8, "cc-by")]
    assert got[2].n_words == 0 and got[None].detections == []
    assert len(license_scan.rules()) > 200


@pytest.mark.parametrize("text, labels", [
    ("GPL v3", "gpl-3"), ("GPL v 3", "gpl-3"), ("GPL version 3", "gpl-3"), ("GPL 3", "gpl-3"), ("GPL, version v3", "gpl-3"),
    ("the Apache License v2.0", "apache-2.0"), ("MPL v2", "mpl-2.0"), ("MPL v1.1", "mpl-1.1"),
    ("LGPL v2.1 or later", "lgpl-2.1-or-later"), ("GPLv3", "gpl-3"), ("GNU GPLv2 or any later version", "gpl-2-or-later"),
    ("LGPLv2.1", "lgpl-2.1"), ("GPLv2+", "gpl-2"), ("AGPLv3", "agpl-3"), ("GPL3", "gpl-3"), ("MPLv2", "mpl-2.0"),
    ("Apache", "apache"), ("gplv3x", ""), ("CC BY v4.0", "cc-by,cc-by-4.0"),
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: LicenseRef-own", "spdx"),
    ("Neither the name of " + "the holder of a very long name " * 9 + "may be used to endorse or promote products", "bsd-3"),
])
def test_license_versions_as_they_are_written(spark, text, labels):
    df = spark.createDataFrame([(1, f"see {text} here")], "doc_id long, text string")
    found = license_scan.scan_licenses(df).first()
    assert ",".join(sorted({d.label for d in found.detections} | {b.label for b in found.base})) == labels


def windows_removed(texts):
    counts = Counter(t[j:j + 200] for t in texts for j in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if counts[t[j:j + 200]] > 1:
                gone[j:j + 200] = b"\1" * 200
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone)))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix_dedup_matches_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_OCCURRENCES", hot)
    data = [((t or "").encode()) for _, t, *_ in rows()]
    want = Counter((r[0], *w) for r, w in zip(rows(), windows_removed(data)))
    got = Counter((r.doc_id, bytes(r.kept), r.n_removed) for r in suffix_dedup.dedup_substrings(docs, parts=3).collect())
    assert got == want


def test_loser_tree_merges_runs():
    rng = random.Random(5)
    runs = [{("ab"[rng.randint(0, 1)] * rng.randint(0, 9) + rng.choice("abc")).encode(): {(k, 0, i)} for i in range(40)} for k in range(5)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.encode_run(r) for r in runs]))
    assert [m[1] for m in merged] == sorted(x for r in runs for x in r)
    for before, now in zip(merged, merged[1:]):
        assert now[0] == suffix_dedup.common_prefix(before[1], now[1], 0)


def test_line_runs_delete_later_copies_only(spark):
    run = [f"line number {k} of a run with several words" for k in range(5)]
    data = [(2, "x\n" + "\n".join(run) + "\ny"), (1, "\n".join(run[:4]) + "\nown end of it"), (3, "\n".join(run) + "\n" + "\n".join(run)), (4, None), (4, None), (None, "a\nb")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in line_runs.dedup_lines(df).collect()}
    assert got[1].n_removed == 0 and got[None].n_removed == 0 and got[4].text == ""
    assert got[2].text == "x\n" + run[4] + "\ny"
    assert got[3].text == ""


@pytest.mark.parametrize("min_lines", [2, 3])
def test_line_runs_match_brute_force(spark, min_lines):
    rng = random.Random(6)
    pool = [" ".join(f"w{k}x{j}" for j in range(k % 14)) for k in range(28)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    a, b, c, d, e = ("\n".join(" ".join(f"{x}{k}{j}" for j in range(6)) for k in "pq") for x in "abcde")  # two lines of 12 words
    texts += [a + "\n" + "own line", b + "\n" + "other line", a + "\n" + b]  # adjacent short runs
    texts += ["\n".join((c, d, e)), c + "\n" + d + "\nend", "x\n" + "\n".join((c, d, e)), "\n".join((c, c, c))]
    texts += [texts[0] + "\n" + texts[1], None, ""]
    data = list(enumerate(texts))
    got = {r.doc_id: r for r in line_runs.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), min_lines=min_lines).collect()}
    seen, gone = set(), defaultdict(set)
    for i, t in data:
        lines = (t or "").split("\n")
        for s in range(len(lines)):  # runs by place: all that starts before this line is in seen
            runs = [tuple(lines[s:e]) for e in range(s + 1, len(lines) + 1)]
            for r in runs:
                if r in seen and len(r) >= min_lines and sum(len(x.split()) for x in r) >= 20:
                    gone[i] |= set(range(s, s + len(r)))
            seen.update(runs)
    for i, t in data:
        lines = (t or "").split("\n")
        assert got[i].n_removed == len(gone[i]) and got[i].text == "\n".join(x for n, x in enumerate(lines) if n not in gone[i])
    assert not gone[62] and gone[65] and sum(map(bool, gone.values())) > 2


def test_passages_find_near_copies_and_leave_the_rest(spark):
    rng = random.Random(9)
    texts = [prose(rng, 200, 999) for _ in range(6)]
    passage = prose(rng, 70, 999).split()
    edited = passage[:35] + ["changed"] + passage[36:]
    data = [(0, texts[0] + " " + " ".join(passage)), (1, " ".join(edited) + " " + texts[1]), (2, texts[2]), (3, texts[3]), (4, texts[3]), (5, None), (None, texts[4])]
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} == {frozenset((0, 1)), frozenset((3, 4))}
    near = next(r for r in got if {r.doc_id, r.partner_id} == {0, 1})
    assert near.end_word - near.first_word == 70 and near.identity == round(69 / 70, 6)


def test_passages_cover_every_repeated_window_behind_partial_holders(spark):
    rng = random.Random(21)
    texts = []
    for k in range(25):
        shared = prose(rng, 60, 999).split()
        for part in (shared[:30], shared, shared, shared[30:]):
            texts.append(" ".join([prose(rng, 25, 999), *part, prose(rng, 25, 999)]))
        # the first text may hold a part of the passage earlier as well
        texts.append(" ".join([prose(rng, 25, 999), *shared[:20], prose(rng, 25, 999), *shared[20:], prose(rng, 25, 999)]))
    data = list(enumerate(texts))
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    held, covered = defaultdict(set), defaultdict(list)
    for i, t in data:
        w = t.split()
        for p in range(len(w) - 39):
            held[tuple(w[p:p + 40])].add((i, p))
    for r in got:
        here, there = texts[r.doc_id].split()[r.first_word:r.end_word], texts[r.partner_id].split()[r.partner_first:r.partner_end]
        same = passages._gap_matches(here, there) / max(len(here), len(there))
        assert min(len(here), len(there)) >= 40 and 0.8 <= r.identity <= round(same, 6)
        covered[r.doc_id].append((r.first_word, r.end_word))
    groups = [at for at in held.values() if len({i for i, _ in at}) > 1]
    assert len(groups) >= 25 * 21
    for at in groups:
        lost = {i for i, p in at if not any(s <= p and p + 40 <= e for s, e in covered[i])}
        assert len(lost) <= 1  # the first one is a partner only


@pytest.mark.parametrize("hot", [64, 1])
def test_passages_pair_every_two_texts_whoever_comes_first(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rng = random.Random(31)
    texts, wanted, exact = [], set(), []
    for k in range(12):
        shared = prose(rng, 64, 999).split()
        changed = [f"changed{k}" if i in (20, 42) else w for i, w in enumerate(shared)]
        n = len(texts)
        # parts of the passage stand elsewhere too; the passage itself, changed, in three texts
        for part in (shared[:21], shared[20:42], shared[42:], shared, changed, [*shared[:30], "other", *shared[31:]]):
            texts.append(" ".join([prose(rng, 30, 999), *part, prose(rng, 30, 999)]))
        wanted |= {(n + 3, n + 4), (n + 3, n + 5), (n + 4, n + 5)}
    for _ in range(6):  # two passages of a pair with much between them
        one, two = prose(rng, 60, 999), prose(rng, 60, 999)
        wanted.add((len(texts), len(texts) + 1))
        exact.append((len(texts), len(texts) + 1))
        texts += [" ".join([one, prose(rng, 80, 999), two, prose(rng, 20, 999)]) for _ in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    pairs = Counter(tuple(sorted((r.doc_id, r.partner_id))) for r in got)
    assert set(pairs) <= wanted
    if hot == 64:
        assert set(pairs) == wanted
    assert all(pairs[p] == 2 for p in exact)  # each of the two passages


def test_hot_passages_cover_every_repeated_window(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT", 1)
    test_passages_cover_every_repeated_window_behind_partial_holders(spark)


def test_recall_of_changed_passages(spark):
    """Pairs of texts that share 60 or 120 words, every n-th of them changed in one; figures as in the README."""
    rng = random.Random(17)
    data, kinds = [], {}
    for size in (60, 120):
        for every in (30, 20, 15, 12, 10, 8, 6):
            for _ in range(40):
                shared = prose(rng, size, 999).split()
                changed = [f"changed{rng.random()}" if k % every == every // 2 else w for k, w in enumerate(shared)]
                kinds[len(data) + 1] = (size, every)
                for part in (shared, changed):
                    data.append((len(data), " ".join([prose(rng, 50, 999), *part, prose(rng, 50, 999)])))
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    pairs = {tuple(sorted((r.doc_id, r.partner_id))) for r in got}
    assert all(a % 2 == 0 and b == a + 1 for a, b in pairs)  # nothing else is found
    found = Counter(kinds[b] for _, b in pairs)
    recall = {k: found[k] / 40 for k in set(kinds.values())}
    assert all(v >= 0.9 for (size, every), v in recall.items() if every >= 10 or (size, every) == (120, 8)), recall
    assert recall[60, 8] >= 0.6 and recall[60, 6] >= 0.2 and recall[120, 6] >= 0.5, recall


def test_chaining_prefers_the_collinear_matches():
    chain = passages.chains([(0, 100), (10, 110), (20, 5), (20, 120), (30, 130)])[0]
    assert chain == [(0, 100), (10, 110), (20, 120), (30, 130)]


def test_seeds_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(23)
    texts = [prose(rng, n, 999) for n in (0, 1, 4, 5, 6, 21, 22, 23, 60, 300)] * 3 + ["", " \t x\x0b", "a a a a " * 60]
    keys, owner, at = passages.seeds_of(texts)
    for i, text in enumerate(texts):
        mers = passages.mers_of(passages.hashes_of(text.encode().lower().split()), passages.K)
        wanted = {j for j, m in enumerate(mers.tolist()) if m < int(passages.SHARE * 2**64)}
        width = min(passages.WINDOW, len(mers))
        wanted |= {j + int(mers[j:j + width].argmin()) for j in range(len(mers) - width + 1) if width}
        assert at[owner == i].tolist() == sorted(wanted)
        assert keys[owner == i].tolist() == mers[sorted(wanted)].tolist()
    monkeypatch.setattr(passages, "CHUNK", 10)
    assert list(passages.chunks([3, 9, 25, 2])) == [slice(0, 2), slice(2, 3), slice(3, 4)] and not list(passages.chunks([]))


def test_scores_in_line_are_those_of_the_tree():
    rng = random.Random(29)
    for _ in range(300):
        n = rng.randint(0, 14)
        matches = list(zip(*(sorted(rng.sample(range(400), n)) for _ in "ab")))
        assert passages._scores_in_line(matches) == passages._scores(matches)


def test_passages_take_texts_apart_once(spark, monkeypatch):
    """Places are those of the whole texts' words, whatever stands between them; words are cut from the text taken apart before."""
    rng = random.Random(31)
    shared = prose(rng, 60, 999).split()
    here, there = prose(rng, 100, 999).split(), prose(rng, 90, 999).split()
    changed = [*shared[:30], "changed", *shared[31:]]
    texts = ["\n\t" + " \x0b\r ".join(here + shared).upper() + "\f ", "  ".join([*there, *changed, *here[:45]])]
    made = {}
    whole = passages.common.materialise
    monkeypatch.setattr(passages.common, "materialise", lambda df, name: made.setdefault(name, df) and whole(df, name))
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {min((r.first_word, r.partner_first), (r.partner_first, r.first_word)): r for r in got}
    assert len(got) == 2
    for (a, b), n, identity in (((90, 100), 60, round(59 / 60, 6)), ((0, 150), 45, 1.0)):
        r = spans[(a, b)]
        assert r.end_word - r.first_word == n == r.partner_end - r.partner_first and r.identity == identity
    assert "regexp" not in made["passages"]._jdf.queryExecution().optimizedPlan().toString()


def test_fingerprint_and_components_match_brute_force(spark, docs):
    import xxhash

    def brute(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    data = rows()
    fps = [brute(r[1]) for r in data]
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(data):
        least[find(k)].append(r[0])
    want = Counter((r[0], fps[k], min(x for x in least[find(k)] if x is not None) if any(x is not None for x in least[find(k)]) else None) for k, r in enumerate(data))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_links_of_dense_groups_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    monkeypatch.setattr(simhash, "CHUNK", 40)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = components.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    group = {r.u for r in edges} | {r.v for r in edges}
    assert len({r.v for r in edges}) == 1 and len(group) == 300


def test_every_difference_of_three_bits_has_a_meeting_place():
    diffs = [sum(1 << b for b in bits) for n in range(1, 4) for bits in itertools.combinations(range(64), n)]
    x = np.array(diffs, dtype=np.uint64)
    met = np.zeros(len(x), dtype=bool)
    for t in range(0, 64, simhash.SEGMENT_BITS):
        rot = (x << np.uint64(t)) | (x >> np.uint64(64 - t)) if t else x
        chain = rot >> np.uint64(64 - simhash.CHAIN_BITS)
        same = np.zeros(len(x), dtype=bool)
        for third in simhash.THIRDS:
            same |= (chain & ~np.uint64(third)) == 0
        met |= same & simhash._close(rot, 3)
    assert met.all()


@pytest.mark.parametrize("max_bits", [0, 1, 3])
def test_links_are_those_of_brute_force(spark, max_bits):
    rng = random.Random(max_bits)
    fps = []
    for _ in range(400):  # pairs at 1 to 5 bits, spread or side by side
        a, n, at = rng.getrandbits(64), rng.randint(1, 5), rng.randrange(64)
        bits = rng.sample(range(64), n) if rng.random() < 0.5 else [(at + i) % 64 for i in range(n)]
        fps += [a, a ^ sum(1 << b for b in bits)]
    fps += [0, (1 << 64) - 1, 7, 1 << 63]
    want = {frozenset((a, b)) for a, b in itertools.combinations(set(fps), 2) if (a ^ b).bit_count() <= max_bits}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in set(fps)]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), max_bits).collect()
    assert {frozenset((r.u & (1 << 64) - 1, r.v & (1 << 64) - 1)) for r in found} == want


def test_decontamination_matches_brute_force(spark, docs):
    rng = random.Random(8)
    texts = [r[1] for r in rows()]
    items = [(0, " ".join(texts[10].split()[2:30])), (1, prose(rng, 30)), (2, "one"), (3, None), (4, " ".join(texts[8].split()[:33] + ["zz"] * 2)), (0, " ".join(texts[10].split()[2:30]))]
    got = Counter((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.containment_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect())

    import regex

    def shingles(t):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    want = Counter()
    for i, t, *_ in rows():
        for j, u in items:
            q, common = shingles(u), shingles(u) & shingles(t)
            if q and len(common) >= 0.8 * len(q):
                want[i, j, len(common)] += 1
    assert got == want


def test_language_model_learns_held_out_languages(spark):
    rng = random.Random(1)
    sets = {"aa": ["the", "and", "ing", "er"], "bb": ["der", "ung", "sch", "ü"]}

    def text(lang):
        return " ".join("".join(rng.choice(sets[lang]) for _ in range(3)) for _ in range(40))

    data = [(i, text("ab"[i % 2] * 2), "ab"[i % 2] * 2) for i in range(80)] + [(100, None, "aa"), (101, "12 !", "aa"), (None, text("aa"), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = language_id.fit(df, "doc_id", "text", "lang", ~language_id.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[None].lang_pred == "aa"
    assert all(got[i].lang_pred == data[i][2] and 0 <= got[i].score <= 1 for i in range(80))


def test_language_sample_takes_texts_not_copies(spark):
    from pyspark.sql import functions as F

    data = [(f"text {i % 3} of cc", "cc") for i in range(900)] + [(None, "dd")] * 900 + [(f"text {i} of dd", "dd") for i in range(4)]
    data += [(f"text {i} of ee", "ee") for i in range(500)] + [("copied of ff", "ff")] * 900 + [(f"text {i} of ff", "ff") for i in range(12)]
    data += [("", "gg"), (None, "hh")] + [(f"word{k}", f"l{k}") for k in range(70)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, text string, lang string").repartition(3)
    got = defaultdict(list)
    for r in language_id.training_sample(df, "doc_id", "text", "lang", F.lit(True), per_language=10).collect():
        got[r.lang].append(r.text)
    assert sorted(got["cc"]) == [f"text {i} of cc" for i in range(3)] and len(got["dd"]) == 4
    assert all(len(got[k]) == len(set(got[k])) == 10 for k in ("ee", "ff"))
    assert set(got) == {"cc", "dd", "ee", "ff"} | {f"l{k}" for k in range(70)}


def test_all_languages_are_learned_and_predicted():
    model = language_id.train([f"text {k}".encode() for k in range(70)], [f"l{k:02}" for k in range(70)], steps=1)
    assert len(model.languages) == 70
    p = language_id.predict(model, [b"x" * 200] * 1200)
    assert p.shape == (1200, 70) and abs(p.sum(axis=1) - 1).max() < 1e-3


def test_gradient_of_the_network():
    import numpy as np

    rng = np.random.default_rng(0)
    model = language_id.ByteGRU.fresh(["a", "b", "c"])
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = model.gradients(x, y)
    for k in ("hf", "xb", "out", "emb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        losses = []
        for d in (1e-2, -2e-2):
            model.w[k][at] += d
            losses.append(model.gradients(x, y)[0])
        model.w[k][at] += 1e-2
        assert abs((losses[0] - losses[1]) / 2e-2 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-3


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        quality_rules.verdicts(empty), packing.pack(empty, packing.default_tokenizer()), pii.find_personal_data(empty),
        license_scan.scan_licenses(empty), suffix_dedup.dedup_substrings(empty), line_runs.dedup_lines(empty),
        passages.repeated_passages(empty), simhash.near_duplicates(empty), decontaminate.containment_matches(empty, items),
        language_id.identify(empty, None),
    ):
        assert df.count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([(0, " ".join(rows()[10][1].split()[2:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now.write.parquet(str(tmp_path / name.replace(" ", "_")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    ids = {r.doc_id for r in now.collect()}
    assert 10 not in ids and 25 not in ids and {0, 1, 2} <= ids  # leaked, copied, clean
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
