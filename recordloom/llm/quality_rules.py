"""Quality rules by cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, digits to 0, white space folded) and hashed.
For every host the number of distinct documents that hold a line is counted;
lines above both limits are boilerplate of that host and are removed, and a
document that loses too much is rejected.

Defined cases: a null text is an empty one; a null host is a host of its own;
documents with the same host and text are one document to the counts (so a
group of exact copies does not turn its own lines into boilerplate) and get
the same result each; lines without a word are never counted nor removed; an
empty table gives an empty result. Columns not named in the call are ignored
unless listed in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10           # fewer words: rejected by the base rule
MAX_REPEAT_PERCENT = 20  # more words in repeated 5-word windows: rejected by the base rule
REPEAT_WINDOW = 5
MIN_LINE_DOCS = 10       # a line is boilerplate only in at least so many documents of its host ...
MAX_LINE_SHARE = 0.05    # ... and in more than this share of them
MAX_REMOVED_SHARE = 0.7  # a document that loses more of its words is depleted

_SYMBOLS = "[#*$%&|<>]"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _repeat_words() -> Column:
    """Words in 5-word windows that occur at least twice, from the column ``win_sorted``.

    ``win_sorted`` holds (hash, position) in order, so equal windows are
    neighbours; the covered words are the union of [position, position + 5).
    """
    pairs = (
        "filter(zip_with(slice(win_sorted, 1, greatest(size(win_sorted) - 1, 0)), "
        "slice(win_sorted, 2, greatest(size(win_sorted) - 1, 0)), "
        "(a, b) -> IF(a.h = b.h, array(a.p, b.p), NULL)), x -> x IS NOT NULL)"
    )
    return F.expr(
        f"cast(aggregate(sort_array(array_distinct(flatten({pairs}))), struct(0 AS n, 0 AS upto), "
        f"(a, p) -> struct(a.n + p + {REPEAT_WINDOW} - greatest(p, a.upto) AS n, p + {REPEAT_WINDOW} AS upto), "
        f"a -> a.n) AS bigint)"
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text, host = common.text_of(text_col), F.col(host_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry],
        text.alias("text"), host.alias("host"), *common.content_key(host, text),
    )


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per document, without its text: the base counts, ``lines`` of (hash of host and line, words) and the content key."""
    base = _keyed(docs, id_col, text_col, host_col)
    split = base.select(
        "*",
        common.words(F.col("text")).alias("word"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_HAS_WORD)).alias("raw"),
        F.split(
            F.regexp_replace(
                F.regexp_replace(F.lower("text"), "[1-9]", "0"), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "
            ),
            "\n", -1,
        ).alias("norm"),
    )
    counted = split.withColumn("word_hash", F.transform("word", lambda w: F.xxhash64(w)))
    counted = common.window5_hashes(counted, "word_hash", "win", only_repeats=True)
    counted = counted.select(
        "doc_id", "host", "key_a", "key_b",
        F.size("word").cast("long").alias("n_words"),
        F.length(F.array_join("word", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        "win",
        F.transform("norm", lambda x: F.trim(x)).alias("norm"),
    )
    lines = counted.withColumn(
        "lines",
        F.expr(
            "transform(norm, x -> struct(xxhash64(host, host IS NULL, x) AS h, "
            "CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END AS w))"
        ),
    ).drop("norm")
    # Most documents repeat no window: they skip the sort.
    flagged = lines.withColumn(
        "win_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(win)) = size(win) THEN cast(array() AS array<struct<h:bigint,p:int>>) "
            "ELSE sort_array(transform(win, (x, i) -> struct(x AS h, i AS p))) END"
        ),
    ).drop("win")
    return (
        flagged.withColumn("n_repeat_words", _repeat_words())
        .drop("win_sorted")
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")),
        )
    )


def frequent_lines(feats: DataFrame, min_docs: int = MIN_LINE_DOCS, max_share: float = MAX_LINE_SHARE) -> DataFrame:
    """Line hashes above the limits, from the distinct documents of each host.

    Both distinct counts are aggregated per map task before each shuffle, so a
    line that a third of all documents share is one row per task.
    """
    rows = feats.select("host", "key_a", F.explode(F.array_distinct("lines")).alias("line")).where("line.w > 0")
    per_line = (
        rows.groupBy(F.col("line.h").alias("h"), "host")
        .agg(F.count_distinct("key_a").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    per_host = feats.groupBy("host").agg(F.count_distinct("key_a").alias("host_docs"))
    joined = per_line.alias("l").join(per_host.alias("s"), F.col("l.host").eqNullSafe(F.col("s.host")))
    return joined.where(F.col("n_docs") > F.lit(max_share) * F.col("host_docs")).select("h", "n_docs")


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_LINE_DOCS,
    max_share: float = MAX_LINE_SHARE,
    max_removed_share: float = MAX_REMOVED_SHARE,
) -> DataFrame:
    """Base counts and verdict of every document, one row per input row.

    Returns doc_id, key_a, key_b (content key), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words,
    kept and gone (positions of the removed lines, null if none). The texts
    are read once; what follows works on hashes.
    """
    feats = common.materialise(features(docs, id_col, text_col, host_col), "quality-features")
    frequent = common.materialise(frequent_lines(feats, min_docs, max_share), "quality-lines")
    # One row per content; the positions stay within one document.
    removed = (
        feats.select("key_a", "key_b", F.posexplode("lines").alias("n", "line"))
        .where("line.w > 0")
        .select("key_a", "key_b", "n", F.col("line.w").alias("w"), F.col("line.h").alias("h"))
        .join(frequent, "h", "left_semi")
        .groupBy("key_a", "key_b")
        .agg(F.collect_set(F.struct("n", "w")).alias("gone"))
    )
    out = feats.drop("lines", "host").join(removed, ["key_a", "key_b"], "left")
    has = F.col("gone").isNotNull()
    out = out.withColumn(
        "n_removed_words", F.when(has, F.expr("aggregate(gone, 0L, (a, x) -> a + x.w)")).otherwise(F.lit(0).cast("long"))
    ).withColumn("n_removed_lines", F.when(has, F.size("gone").cast("long")).otherwise(F.lit(0).cast("long")))
    depleted = (F.col("n_removed_words") > 0) & (
        (F.col("n_words") - F.col("n_removed_words") < MIN_WORDS)
        | (F.col("n_removed_words") > F.lit(max_removed_share) * F.col("n_words"))
    )
    return out.select(
        "doc_id", "key_a", "key_b",
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_lines", "n_removed_words",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        F.when(has, F.expr("transform(gone, x -> x.n)")).alias("gone"),
    )


def clean_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    carry: tuple[str, ...] = (),
    **limits: float,
) -> DataFrame:
    """The documents that pass, without their boilerplate lines: doc_id, carry_*, text.

    Only documents that may have a decision (rejected, or lines to remove)
    are shuffled to it; all others stay where they are.
    """
    decisions = common.materialise(
        verdicts(docs, id_col, text_col, host_col, **limits)
        .where("NOT kept OR gone IS NOT NULL")
        .select("key_a", "key_b", "kept", "gone")
        .dropDuplicates(["key_a", "key_b"]),
        "quality-decisions",
    )
    out = common.attach(_keyed(docs, id_col, text_col, host_col, carry), decisions, ["key_a", "key_b"])
    out = out.where("kept IS NULL OR kept").withColumn(
        "parts", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1))
    )
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.expr(
            "array_join(transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i]), '\\n')"
        )
    )
    return out.select("doc_id", *[f"carry_{c}" for c in carry], clean.alias("text"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents: base counts and the line-frequency verdict."""
    return verdicts(common.read_table(spark, sf_dir, "documents")).drop("key_a", "key_b", "gone")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT doc_id, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1)
      GROUP BY doc_id),
b AS (SELECT w.doc_id, t, source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
raw AS (SELECT doc_id, source, t, unnest(string_split(
          regexp_replace(translate(lower(t), '123456789', '000000000'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS x FROM f),
l AS (SELECT doc_id, source, t, trim(x, ' ') AS x, len(string_split(trim(x, ' '), ' ')) AS nw FROM raw WHERE trim(x, ' ') <> ''),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM f GROUP BY source),
cnt AS (SELECT source, x, count(DISTINCT t) AS n FROM l GROUP BY source, x),
hot AS (SELECT cnt.source, cnt.x FROM cnt JOIN hosts ON cnt.source IS NOT DISTINCT FROM hosts.source
        WHERE n >= 10 AND n > 0.05 * docs),
rm AS (SELECT doc_id, count(*) AS nl, sum(nw) AS nwords FROM l JOIN hot
       ON l.x = hot.x AND l.source IS NOT DISTINCT FROM hot.source GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(nl, 0)::BIGINT AS n_removed_lines, coalesce(nwords, 0)::BIGINT AS n_removed_words,
       NOT base_failed AND NOT (coalesce(nwords, 0) > 0
         AND (n_words - coalesce(nwords, 0) < 10 OR coalesce(nwords, 0) > 0.7 * n_words)) AS kept
FROM f LEFT JOIN rm ON rm.doc_id = f.doc_id
"""
