"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
is removed. Sorting the suffixes of all bytes isn't needed for that: each
``LENGTH``-byte window has an anchor, the place of the least hash of 8 bytes
among its first 101 places, so equal windows have equal anchors, and the
``PREFIX`` bytes after an anchor lie within the window.

1. Anchors whose ``PREFIX`` bytes occur once (by hash count) can't be in a
   repeated window and are left out.
2. Each task sorts the suffixes at its remaining anchors (cut where the last
   window of the anchor ends, followed by the bytes before the anchor that
   its windows cover), joins equal ones, and sends front-coded sorted runs
   (common prefix length and rest) to the tasks that own the prefixes.
3. A task merges its runs with a loser tree that keeps, for every loser, its
   common prefix with the last winner, and so never compares known prefixes
   again. Neighbours that share ``PREFIX`` bytes are one group. A suffix met
   twice repeats in all its windows; other members of a group are compared
   window by window.
4. A prefix with very many occurrences (a passage that a large share of the
   documents hold, in different surroundings) would be a large group; its
   windows are dealt out by their own 128-bit hashes instead and counted with
   partial aggregation. It is the same criterion, so the result is the same.

Defined cases: null is the empty text; texts under ``LENGTH`` bytes keep all;
rows of equal text are copies of each other, whatever their ids; matches
within one document count; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 200
PREFIX = 100
SPAN = LENGTH - PREFIX + 1       # places of a window among which its anchor is
HOT_OCCURRENCES = 50_000         # of a prefix, so a group is at most some 15 MB; beyond, step 4 takes it
SEGMENT = 1 << 23                # bytes of a text that are looked at in one go
RUN_SUFFIXES = 50_000            # suffixes sorted at once by a task
PART_SUFFIXES = 20_000           # suffixes of a merge task, some 6 MB (a prefix's occurrences stay together)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of a text: place, first and last window start that belongs to it."""
    places, firsts, lasts = [], [], []
    n_windows = len(data) - LENGTH + 1
    for at in range(0, max(0, n_windows), SEGMENT):
        count = min(SEGMENT, n_windows - at)
        grams = np.ndarray((count + SPAN - 1,), dtype="<u8", buffer=data, offset=at, strides=(1,))
        v = grams * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(31)
        v &= ~np.uint64((1 << 25) - 1)
        v |= np.arange(len(v), dtype=np.uint64)  # ties: the leftmost
        step = 1
        while 2 * step <= SPAN:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        if SPAN > step:
            v = np.minimum(v[:len(v) - (SPAN - step)], v[SPAN - step:])
        place = (v[:count] & np.uint64((1 << 25) - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        places.append(place[start] + at)
        firsts.append(start + at)
        lasts.append(np.concatenate([start[1:] - 1, [count - 1]]) + at)
    if not places:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(prefix hash, the text's keys, place, first, last) of all anchors; the last three in one number."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in common.small(batches):
        keys, counts, packed = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        for text in batch["text"]:
            data = text.encode()
            a, first, last = anchors(data)
            counts.append(len(a))
            if len(a):
                keys.append(np.array([digest(data[i:i + PREFIX]) for i in a.tolist()], dtype=np.uint64).view(np.int64))
                packed.append((a << 16) | ((a - first) << 8) | (last - first))
        yield pd.DataFrame({
            "key": np.concatenate(keys), "key_a": np.repeat(batch["key_a"].to_numpy(), counts),
            "key_b": np.repeat(batch["key_b"].to_numpy(), counts), "packed": np.concatenate(packed),
        })


# ---- front-coded sorted runs -------------------------------------------------

_HEAD = struct.Struct("<HHI")
_OCCURRENCE = struct.Struct("<qqI")  # the text's two keys, the first window


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that share their first ``at`` bytes."""
    low, high = at, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while a[low:low + step] == b[low:low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def encode_run(items: dict[bytes, set[tuple[int, int, int]]]) -> bytes:
    """A sorted run: per suffix its common prefix with the one before, the rest, and its occurrences (text keys, first window)."""
    parts, before = [], b""
    for item in sorted(items):
        shared = common_prefix(before, item, 0)
        found = items[item]
        parts.append(_HEAD.pack(shared, len(item) - shared, len(found)))
        parts.append(item[shared:])
        parts += [_OCCURRENCE.pack(*o) for o in sorted(found)]
        before = item
    return b"".join(parts)


def decode_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(common prefix with the suffix before, suffix, packed occurrences) of a run, in order."""
    at, before = 0, b""
    while at < len(blob):
        shared, rest, n = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        before = before[:shared] + blob[at:at + rest]
        at += rest
        end = at + n * _OCCURRENCE.size
        yield shared, before, blob[at:end]
        at = end


def merge_runs(blobs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge sorted runs: (common prefix with the last output, suffix, packed occurrences).

    Loser tree over the runs. ``lcp[r]`` is the common prefix of run r's head
    with the last winner it was compared with on its path, which is the last
    output for all that meet. The longer common prefix wins without looking at
    a byte; equal ones are compared from there on, and the loser remembers
    what it shares with its winner.
    """
    runs = [decode_run(b) for b in blobs]
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[int, bytes, bytes] | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; sets the loser's common prefix."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = common_prefix(x, y, lcp[a])
        win, lose = (a, b) if x[n:n + 1] <= y[n:n + 1] else (b, a)
        lcp[lose] = n
        return win, lose

    losers = [0] * k
    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            win, losers[level + i] = play(winners[2 * i], winners[2 * i + 1])
            nxt.append(win)
        winners = nxt
    top = winners[0]
    while heads[top] is not None:
        yield lcp[top], heads[top][1], heads[top][2]
        heads[top] = next(runs[top], None)
        if heads[top] is not None:
            lcp[top] = heads[top][0]
        node = (k + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def suffix_item(data: bytes, place: int, first: int, last: int) -> bytes:
    """Suffix at an anchor up to the end of its last window, then the bytes its windows cover before it, and that part's length."""
    return data[place:last + LENGTH] + data[first:place] + bytes([place - first])


def _windows(item: bytes) -> list[bytes]:
    before = item[-1]
    split = len(item) - 1 - before
    context = item[split:-1] + item[:split]
    return [context[j:j + LENGTH] for j in range(len(context) - LENGTH + 1)]


def _spans_of(flags: list[bool]) -> list[tuple[int, int]]:
    """Byte stretches (from the first window's start) that the flagged windows cover."""
    out: list[tuple[int, int]] = []
    for j, on in enumerate(flags):
        if on:
            if out and out[-1][1] >= j:
                out[-1] = (out[-1][0], j + LENGTH)
            else:
                out.append((j, j + LENGTH))
    return out


def _group_rows(group: list[tuple[bytes, set[tuple[int, int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """Removed stretches (text keys, start, end) of suffixes that share their prefix."""
    seen: dict[bytes, int] = {}
    if len(group) > 1:
        for item, found in group:
            for w in _windows(item):
                seen[w] = seen.get(w, 0) + len(found)
    for item, found in group:
        if len(found) > 1:
            spans = [(0, len(item) - 1)]
        elif len(group) > 1:
            spans = _spans_of([seen[w] > 1 for w in _windows(item)])
        else:
            continue
        for key_a, key_b, first in found:
            for a, b in spans:
                yield key_a, key_b, first + a, first + b


_STRETCHES = ["key_a", "key_b", "first", "last"]


def _merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[bytes, set[tuple[int, int, int]]]] = []
    for shared, item, packed in merge_runs(list(pdf["run"])):
        found = set(_OCCURRENCE.iter_unpack(packed))
        if group and shared >= len(item) and group[-1][0] == item:
            group[-1][1].update(found)
            continue
        if group and shared < PREFIX:
            out.extend(_group_rows(group))
            group = []
        group.append((item, found))
    out.extend(_group_rows(group))
    return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 4), columns=_STRETCHES)


# ---- the job -----------------------------------------------------------------


def removed_spans(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(key_a, key_b, first, last exclusive): removed stretches of the distinct texts of ``rows`` (key_a, key_b, text); they may overlap.

    ``parts`` is the number of merge tasks; by default it follows the number of suffixes to sort.
    """
    spark = rows.sparkSession
    text_keys = ["key_a", "key_b"]
    found = common.materialise(rows.mapInPandas(_anchor_rows, "key long, key_a long, key_b long, packed long"), "suffix-anchors")
    place = F.struct("key_a", "key_b", "packed")
    # Written, here and below, so that the joins read plain tables and Spark can split a hot key's rows.
    repeated = common.materialise(
        found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
        .where("a <> b").select("key", "n", (F.col("n") > HOT_OCCURRENCES).alias("hot")),
        "suffix-repeated",
    )
    if parts is None:
        sorted_ones = repeated.where("NOT hot").agg(F.sum("n")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sorted_ones // PART_SUFFIXES))
    mark = F.struct("packed", "key", "hot")
    wanted = common.materialise(
        found.join(repeated.drop("n"), "key").groupBy(*text_keys).agg(F.collect_set(mark).alias("m"))
        .select(*text_keys, *[F.expr(f"transform(m, x -> x.{c})").alias(c) for c in ("packed", "key", "hot")]),
        "suffix-wanted",
    )
    common.drop_written(found, repeated)
    # Compressed for the shuffle; texts without a repeated prefix stay behind.
    texts = common.may_hold(rows, wanted, "key_a").where("may_hold").select(*text_keys, "text").mapInPandas(
        _packed_rows, "key_a long, key_b long, z binary"
    )
    once = texts.groupBy(*text_keys).agg(F.first("z").alias("z"))
    joined = common.materialise(once.join(wanted, text_keys), "suffix-texts")
    common.drop_written(wanted)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        held: list[dict[bytes, set[tuple[int, int, int]]]] = [{} for _ in range(parts)]
        size = 0

        def rows_of() -> pd.DataFrame:
            full = [p for p in range(parts) if held[p]]
            return pd.DataFrame({"part": full, "run": [encode_run(held[p]) for p in full]})

        for batch in common.small(batches, 200):
            for key_a, key_b, z, packed, keys, hot in zip(*(batch[c] for c in ("key_a", "key_b", "z", "packed", "key", "hot"))):
                data = zlib.decompress(z)
                for place, key, skip in zip(packed.tolist(), keys.tolist(), hot.tolist()):
                    if skip:
                        continue
                    a, first, last = _unpack(place)
                    held[key % parts].setdefault(suffix_item(data, a, first, last), set()).add((key_a, key_b, first))
                    size += 1
                if size >= RUN_SUFFIXES:
                    yield rows_of()
                    held, size = [{} for _ in range(parts)], 0
        if size:
            yield rows_of()

    def hot_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        import zlib

        for batch in common.small(batches, 50):
            digests, counts, places = [], [], [np.zeros(0, np.int64)]
            for z, packed, hot in zip(batch["z"], batch["packed"], batch["hot"]):
                data, n = zlib.decompress(z), 0
                for place, on in zip(packed.tolist(), hot.tolist()):
                    if on:
                        _, first, last = _unpack(place)
                        digests += [xxhash.xxh128_digest(data[i:i + LENGTH]) for i in range(first, last + 1)]
                        places.append(np.arange(first, last + 1))
                        n += last + 1 - first
                counts.append(n)
            both = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pd.DataFrame({
                "a": both[:, 0], "b": both[:, 1], "key_a": np.repeat(batch["key_a"].to_numpy(), counts),
                "key_b": np.repeat(batch["key_b"].to_numpy(), counts), "first": np.concatenate(places),
            })

    stretches = "key_a long, key_b long, first long, last long"
    cold = (
        joined.where("exists(hot, x -> NOT x)").mapInPandas(runs, "part int, run binary")
        .groupBy("part").applyInPandas(_merge_part, stretches)
    )
    windows = common.materialise(
        joined.where("exists(hot, x -> x)").mapInPandas(hot_windows, "a long, b long, key_a long, key_b long, first long"), "suffix-hot"
    )
    at = F.struct("key_a", "key_b", "first")
    twice = common.materialise(
        windows.groupBy("a", "b").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x <> y").select("a", "b"), "suffix-twice"
    )
    hot = windows.join(twice, ["a", "b"], "left_semi").select(*text_keys, "first", (F.col("first") + LENGTH).alias("last"))
    return cold.unionByName(hot)


def _unpack(packed: int) -> tuple[int, int, int]:
    place = packed >> 16
    first = place - (packed >> 8 & 255)
    return place, first, first + (packed & 255)


def _packed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zlib

    for batch in common.small(batches):
        yield pd.DataFrame({
            "key_a": batch["key_a"], "key_b": batch["key_b"], "z": [zlib.compress(t.encode(), 1) for t in batch["text"]],
        })


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The remaining bytes, and number of removed bytes and of maximal removed runs."""
    kept, at, n = [], 0, 0
    for a, b in sorted(spans):
        if n == 0 or a > at:
            kept.append(data[at:a])
            n += 1
        at = max(at, b)
    kept.append(data[at:])
    out = b"".join(kept)
    return out, len(data) - len(out), n


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Every document with what is left of it.

    Returns doc_id, kept (binary: the remaining UTF-8 bytes), n_bytes,
    n_removed, n_spans. ``parts`` is the number of merge tasks (default: it
    follows the number of suffixes).
    """
    text = common.text_of(text_col)
    text_keys = ["key_a", "key_b"]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *common.content_key(text))
    copies = (
        rows.where(F.octet_length("text") >= LENGTH).groupBy(*text_keys).agg(F.count("*").alias("n"))
        .where("n > 1").select(*text_keys, F.lit(True).alias("copied"))
    )
    # A text's stretches as "first-last,...": compact on the way to the cutting.
    joined_spans = F.expr("array_join(transform(array_sort(collect_set(struct(first, last))), x -> concat(x.first, '-', x.last)), ',')")
    spans = removed_spans(rows.select(*text_keys, "text"), parts).groupBy(*text_keys).agg(joined_spans.alias("spans"))
    decisions = common.materialise(spans.join(copies, text_keys, "full_outer"), "suffix-spans")
    keep = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("kept", T.BinaryType()),
        *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
    ])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.small(batches, 500):
            out = []
            for i, t, found, copied in zip(batch["id"], batch["text"], batch["spans"], batch["copied"]):
                data = t.encode()
                todo = [tuple(map(int, x.split("-"))) for x in found.split(",")] if found else []
                if copied:
                    todo = [(0, len(data))]
                out.append((i, *(lambda k, r, n: (k, len(data), r, n))(*cut_spans(data, todo))))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    joined = common.attach(rows.select(F.col("doc_id").cast("string").alias("id"), "text", *text_keys), decisions, text_keys)
    done = joined.select("id", "text", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("copied", F.lit(False)).alias("copied"))
    return done.mapInPandas(cut, schema).select(F.col("id").cast(keep).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings cut out of all documents."""
    found = dedup_substrings(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
