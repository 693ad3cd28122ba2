"""Line dedup: repeated runs of lines, by distributed prefix doubling over line ids.

A line's id is its 128-bit hash. The suffix of a document that starts at a
line is ranked by its first line, then by its first 2, 4, 8, ... lines: its
rank for 2n lines is named by the pair (rank of n lines here, rank of n lines n
further on). Ranks are counted over all documents, and only suffixes whose
rank repeats go on (a run that holds another line can't repeat), so the tables
shrink from round to round; doubling ends when no run is left that needs it.

A run qualifies with ``min_lines`` lines and ``min_words`` words. For every
line, the shortest qualifying run that starts there and the shortest one that
ends there are looked at; every line of a longer qualifying run lies in such
a run within it, and their lengths depend on their lines only. Two suffixes
share their first m lines exactly if they share the rank of their first 2^j
lines and that of the 2^j lines that end at line m (2^j <= m < 2^(j+1)). So the
suffixes with the same m and pair of ranks are the interval whose common
prefix has m lines or more, of exactly that length and not only of a power of
two. All its members but the first place are repeats. Their lines are
deleted; those that overlap or touch in a document make up its maximal
repeated runs. Short runs that only touch are never added up. Each deleted
line still stands in the earlier copy: the first of all places has none.

Defined cases: order is by doc_id (null first), then content, then line; rows
of equal doc_id and text are one document (all keep or lose the same lines);
lines without a word take part in runs; a null text is one empty line and
never a repeat of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_LINES = 2
MIN_WORDS = 20

def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = common.text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry], text.alias("text"),
        *common.content_key(F.col(id_col), text),
    )


def _place() -> Column:
    return F.struct("doc_id", "key_a", "key_b", "n")


def shortest_runs(words: list[int], min_lines: int, min_words: int) -> dict[int, set[int]]:
    """Lengths of the shortest qualifying runs from and up to each line, by their first line."""
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    found: dict[int, set[int]] = {}
    s = 0
    for e in range(1, len(words) + 1):  # s: the least start of which no run up to e is known to qualify
        while e - s >= min_lines and total[e] - total[s] >= min_words and s < e:
            found.setdefault(s, set()).add(e - s)  # the shortest from s
            s += 1
        if s:
            found.setdefault(s - 1, set()).add(e - s + 1)  # the shortest up to e
    return found


def _line_rows(batches: Iterator[pd.DataFrame], min_lines: int, min_words: int) -> Iterator[pd.DataFrame]:
    """Per line: its id (h, h2) and the lengths of the runs to look at that start there (as text)."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        counts, ids, sizes = [], [], []
        for text in batch["text"]:
            lines = text.encode().split(b"\n")
            runs = shortest_runs([len(x.split()) for x in lines], min_lines, min_words)
            counts.append(len(lines))
            ids += map(digest, lines)
            sizes += [",".join(map(str, sorted(runs[n]))) if n in runs else "" for n in range(len(lines))]
        hashes = np.frombuffer(b"".join(ids), dtype=">i8").astype(np.int64).reshape(-1, 2)
        each = np.array(counts, dtype=np.int64)
        starts = np.repeat(np.cumsum(each) - each, each)
        yield pd.DataFrame({
            "id": np.repeat(batch["id"].to_numpy(), each), "key_a": np.repeat(batch["key_a"].to_numpy(), each),
            "key_b": np.repeat(batch["key_b"].to_numpy(), each), "n": (np.arange(len(starts)) - starts).astype(np.int32),
            "h": hashes[:, 0], "h2": hashes[:, 1], "sizes": sizes,
        })


def _repeated(ranks: DataFrame, name: str) -> DataFrame:
    """The suffixes whose rank (h, h2) another one has too. Both sides are written, so Spark can split a hot rank's rows."""
    again = common.materialise(ranks.groupBy("h", "h2").agg(F.count("*").alias("places")).where("places > 1").drop("places"), f"{name}-again")
    return ranks.join(again, ["h", "h2"], "left_semi")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: key_a, key_b (of doc_id and text), first, last (line numbers from 0)."""
    keyed = _keyed(docs, id_col, text_col).withColumn("id", F.col("doc_id").cast("string"))
    lines = common.materialise(
        keyed.select("id", "key_a", "key_b", "text").mapInPandas(
            lambda batches: _line_rows(common.small(batches), min_lines, min_words),
            "id string, key_a long, key_b long, n int, h long, h2 long, sizes string",
        ),
        "lines",
    )
    at = ["key_a", "key_b", "n"]
    ranks = common.materialise(_repeated(lines, "lines").dropDuplicates(at), "line-ranks")
    common.drop_written(lines)
    size, named = 1, []
    wanted = F.transform(F.split("sizes", ","), lambda x: x.cast("int"))
    while True:
        # Runs of size to 2 * size - 1 lines: the rank here and that of the lines up to the run's end.
        runs = ranks.where("sizes <> ''").select("id", *at, "h", "h2", F.explode(wanted).alias("size"))
        here = runs.where((F.col("size") >= size) & (F.col("size") < 2 * size))
        there = ranks.select("key_a", "key_b", F.col("n").alias("end"), F.col("h").alias("g"), F.col("h2").alias("g2"))
        met = here.withColumn("end", F.col("n") + F.col("size") - size).join(there, ["key_a", "key_b", "end"])
        named.append(common.materialise(met.select("id", *at, "size", "h", "h2", "g", "g2"), "line-runs-named"))
        if runs.where(F.col("size") >= 2 * size).isEmpty():
            break
        ahead = ranks.select("key_a", "key_b", (F.col("n") - size).alias("n"), F.col("h").alias("g"), F.col("h2").alias("g2"))
        pair = ["h", "h2", "g", "g2"]
        doubled = common.materialise(
            ranks.join(ahead, at).select(
                "id", *at, F.xxhash64(*pair).alias("h"), F.xxhash64(F.lit("second"), *pair).alias("h2"), "sizes"
            ),
            "line-pairs",
        )
        before, ranks = ranks, common.materialise(_repeated(doubled, "line-pairs"), "line-ranks")
        common.drop_written(before, doubled)
        size *= 2
    keep = keyed.schema["doc_id"].dataType
    windows = functools.reduce(DataFrame.unionByName, named).withColumn("doc_id", F.col("id").cast(keep)).drop("id")
    interval = ["size", "h", "h2", "g", "g2"]
    firsts = common.materialise(
        windows.groupBy(*interval).agg(F.min(_place()).alias("rank"), F.count("*").alias("places")).where("places > 1").drop("places"),
        "line-firsts",
    )
    later = windows.join(firsts, interval).where(~F.col("rank").eqNullSafe(_place())).select(*at, "size")
    longest = later.groupBy(*at).agg(F.max("size").alias("size"))
    by_doc = Window.partitionBy("key_a", "key_b").orderBy("n")
    ends = longest.withColumn("upto", F.max(F.col("n") + F.col("size")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    return (
        ends.withColumn("run", F.sum(F.when(F.col("upto") >= F.col("n"), 0).otherwise(1)).over(by_doc))
        .groupBy("key_a", "key_b", "run")
        .agg(F.min("n").alias("first"), F.max(F.col("n") + F.col("size") - 1).alias("last"))
        .select("key_a", "key_b", "first", "last")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents without later copies of repeated line runs.

    Returns doc_id, the ``carry`` columns (prefixed ``carry_``), text (the kept
    lines), n_lines, n_removed and runs (first and last line of each deleted run).
    """
    runs = common.materialise(
        repeated_runs(docs, id_col, text_col, min_lines, min_words)
        .groupBy("key_a", "key_b").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")),
        "line-runs",
    )
    out = common.attach(_keyed(docs, id_col, text_col, carry), runs, ["key_a", "key_b"])
    out = out.withColumn("parts", F.split("text", "\n", -1))
    gone = F.expr("flatten(transform(runs, r -> sequence(r.first, r.last)))")
    out = out.withColumn("gone", F.when(F.col("runs").isNotNull(), gone))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.expr("array_join(transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i]), '\\n')")
    )
    return out.select(
        "doc_id", *[f"carry_{c}" for c in carry], text.alias("text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
        "runs",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: lines, deleted lines and runs per document, and a hash of the kept text."""
    found = dedup_lines(common.read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed",
        F.expr("coalesce(array_join(transform(runs, r -> concat(r.first, '-', r.last)), ','), '')").alias("runs"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
