"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

A test item is contained in a document when at least ``threshold`` of its
distinct word shingles are among the document's. Items are partitioned by size
(powers of two of their shingle count). A partition of upper size u keeps the
u * (1 - threshold) + 1 smallest shingle hashes of an item (bottom-k MinHash).
Of an item of q shingles at most q * (1 - threshold) may be missing, so a
document that contains it holds at least k minus that many sketch hashes: the
search misses nothing. Candidates are then checked by exact shingle strings.

The items' sketches are joined to the exploded document hashes by hash; Spark
broadcasts them only if their written table is under its broadcast limit. No
window or pair of documents is ever built, and long documents are read whole.

Defined cases: null texts and texts without a word hold nothing and match
nothing; a text shorter than a shingle is one shingle; repeated items and
documents keep one result row per input pair; rows with equal text share one
search; empty tables give an empty result; null ids stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8


def _hashed(df: DataFrame, id_col: str, text_col: str, id_name: str) -> DataFrame:
    """id, content key and distinct shingle hashes ``sh`` of lower-cased letter and digit words."""
    text = F.lower(common.text_of(text_col))
    rows = df.select(F.col(id_col).alias(id_name), text.alias("text")).select(
        id_name, "text", *common.content_key(F.col("text")),
        F.transform(
            F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w)
        ).alias("h"),
    )
    rows = common.window5_hashes(rows, "h", "win")
    return rows.withColumn(
        "sh",
        F.expr(
            "CASE WHEN size(h) = 0 THEN cast(array() AS array<bigint>) "
            "WHEN size(h) < 5 THEN array(aggregate(h, cast(size(h) AS bigint), (a, x) -> xxhash64(a, x))) ELSE win END"
        ),
    ).drop("h", "win")


def _strings(text: str) -> str:
    """SQL: distinct shingle strings of a lower-cased text."""
    w = f"regexp_extract_all({text}, r'[\\p{{L}}\\p{{N}}]+', 0)"
    return (
        f"array_distinct(aggregate(array({w}), cast(array() AS array<string>), (a, w) -> "
        "CASE WHEN size(w) = 0 THEN a WHEN size(w) < 5 THEN array(array_join(w, ' ')) "
        "ELSE transform(sequence(0, size(w) - 5), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END))"
    )


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Bottom-k sketches: item key, size q, least number of sketch hits, one row per sketch hash."""
    sized = items.select("key_a", "key_b", F.array_sort(F.array_distinct("sh")).alias("sh")).where("size(sh) > 0")
    q = F.size("sh")
    # Size partition: the least power of two that is not under q.
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(q.cast("double"))))
    sized = sized.dropDuplicates(["key_a", "key_b"]).select(
        F.col("key_a").alias("item_a"), F.col("key_b").alias("item_b"), "sh", q.alias("q"),
        # The small constant keeps floor(q * 0.2) whole where 1 - 0.8 is a little off.
        F.least(q, (F.floor(upper * F.lit(1 - threshold) + 1e-9) + 1).cast("int")).alias("k"),
        F.floor(q * F.lit(1 - threshold) + 1e-9).cast("int").alias("may_miss"),
    )
    return sized.select(
        "item_a", "item_b", "q", F.greatest(F.lit(1), F.col("k") - F.col("may_miss")).alias("least_hits"),
        F.explode(F.slice("sh", 1, F.col("k"))).alias("hash"),
    )


def containment_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Pairs of document and contained item.

    Returns doc_id, key_a, key_b (content key of the document's lower-cased
    text), item_id, n_item, n_shared (distinct shingles) and containment.
    """
    item_rows = _hashed(items, item_id_col, item_text_col, "item_id")
    sketch = common.materialise(sketches(item_rows, threshold), "decon-sketch")
    hashed = _hashed(docs, id_col, text_col, "doc_id")
    # The outer explode keeps the optimizer from repeating the hashing in a filter below it;
    # the null row of an empty document joins nothing.
    hits = (
        hashed.withColumn("sh", F.array_distinct("sh"))
        .select("key_a", "key_b", F.size("sh").alias("n"), F.explode_outer("sh").alias("hash"))
        .join(sketch, "hash")
        .where(F.col("n") >= F.ceil(F.col("q") * F.lit(threshold) - 1e-9))
    )
    candidates = common.materialise(
        hits.groupBy("key_a", "key_b", "item_a", "item_b")
        .agg(F.count_distinct("hash").alias("n_hits"), F.first("least_hits").alias("least_hits"))
        .where("n_hits >= least_hits")
        .select("key_a", "key_b", "item_a", "item_b"),
        "decon-candidates",
    )
    # Exact check, once per distinct document text and item text.
    item_sets = (
        item_rows.dropDuplicates(["key_a", "key_b"])
        .select(F.col("key_a").alias("item_a"), F.col("key_b").alias("item_b"), F.expr(_strings("text")).alias("item_set"))
        .where("size(item_set) > 0")
    )
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.lower(common.text_of(text_col)).alias("text")).select(
        "doc_id", "text", *common.content_key(F.col("text"))
    )
    # Documents meet their candidates' keys first; an item's strings come last, from a table of the items' size.
    # Only documents that may be among the candidates are shuffled.
    met = common.may_hold(keyed, candidates, "key_a").where("may_hold").drop("may_hold").join(candidates, ["key_a", "key_b"])
    pairs = met.join(item_sets, ["item_a", "item_b"])
    checked = pairs.select(
        "doc_id", "key_a", "key_b", "item_a", "item_b",
        F.size("item_set").cast("long").alias("n_item"),
        F.size(F.array_intersect("item_set", F.expr(_strings("text")))).cast("long").alias("n_shared"),
    ).where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))
    ids = item_rows.select(F.col("key_a").alias("item_a"), F.col("key_b").alias("item_b"), "item_id")
    return checked.join(ids, ["item_a", "item_b"]).select(
        "doc_id", "key_a", "key_b", "item_id", "n_item", "n_shared",
        F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, over all documents and items."""
    docs, items = (common.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return containment_matches(docs, items).drop("key_a", "key_b")


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
       FROM dw WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
       FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM (SELECT DISTINCT doc_id, s FROM ds) JOIN its USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""
